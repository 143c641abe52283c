"""Repeated passages go whatever the rows' ids are."""

import numpy as np

from maskwright.llm import chunks

rng = np.random.default_rng(5)
WORDS = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(900)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


SHARED = prose(120, 77)
TEXTS = [f"{prose(40 + 9 * i, i)} {SHARED} {prose(30, 50 + i)}" for i in range(3)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, digest string, version int")


def kept(spark, ids, texts):
    rows = frame(spark, [(i, t, len(t), "x", 1) for i, t in zip(ids, texts)])
    out = chunks.dedup(rows).collect()
    cut = chunks.cut(rows)
    assert cut.columns == rows.columns
    found = cut.collect()
    assert sorted(r["text"] for r in found) == sorted(r["text"] for r in out) and all(r["n_chars"] == len(r["text"]) for r in found)
    return sorted(out, key=lambda r: r["n_bytes"])


def test_ids_do_not_matter(spark):
    """Null and shared ids: as many bytes go as with ids of their own, and one occurrence stays."""
    with_ids = [r["n_removed"] for r in kept(spark, [1, 2, 3], TEXTS)]
    assert with_ids[0] == 0 and min(with_ids[1:]) >= len(SHARED)
    for ids in ([None] * 3, [7] * 3, [None, 7, 7]):
        rows = kept(spark, ids, TEXTS)
        gone = [r["n_removed"] for r in rows]
        assert sum(n == 0 for n in gone) == 1 and min(sorted(gone)[1:]) >= len(SHARED) and sum(SHARED in r["text"] for r in rows) == 1


def test_rows_alike_keep_one_text(spark):
    """Of rows alike in id and text one stays, however many there are; short ones all stay."""
    for doc in (None, 7):
        rows = kept(spark, [doc] * 40 + [doc] * 3, [TEXTS[0]] * 40 + ["short"] * 3)
        assert sorted(r["text"] for r in rows) == sorted([""] * 39 + [TEXTS[0]] + ["short"] * 3)
