"""Interleaved document sequences: HTML becomes ordered text and media-reference structs, payloads join by digest.

A page parses into array<struct<position, kind, text, digest, caption>>: text blocks and references to media in
page order, each reference with its own caption (figcaption, else alt). Payloads live in a media store, a
Parquet folder keyed by the digest of what was stored; stored form: an 8-bit greyscale PNG, 64 samples wide, with
the unpadded length in a text chunk. References meet payloads by a join on the digest, never by position, and are
put back in page order by their position, so positions and captions stay aligned whatever the join's order.

Defined results: null texts and pages are empty; equal payloads are stored under one digest and resolve alike;
a reference without a payload keeps its place with null facts; pages without blocks give an empty sequence;
repeated rows give repeated sequences; an empty table gives no row; columns not named here are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 64
_PNG = b"\x89PNG\r\n\x1a\n"
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
FACTS = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<![^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time u var wbr".split())
_MEDIA = frozenset("img video audio source embed".split())


def parse(page: str) -> list[dict]:
    """The page's blocks and media references in order."""
    items: list[dict] = []
    text: list[str] = []
    figure, caption = None, None

    def add(kind: str, **more) -> dict:
        items.append({"position": len(items), "kind": kind, "text": None, "digest": None, "caption": None} | more)
        return items[-1]

    def flush() -> None:
        nonlocal text
        block = " ".join(html_.unescape("".join(text)).split())
        text = []
        if not block:
            return
        if caption is not None:
            caption.append(block)
        else:
            add("text", text=block)

    at = 0
    for m in _MARKUP.finditer(page):
        text.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag or tag in _INLINE:
            continue
        flush()
        if tag == "figure":
            figure = None if m[2] else []
        elif tag == "figcaption":
            if not m[2]:
                caption = []
            elif caption is not None:
                for ref in figure or ():
                    ref["caption"] = " ".join(caption)
                caption = None
        elif tag in _MEDIA and not m[2]:
            given = {a[1].lower(): html_.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[4])}
            ref = add("media", digest=given.get("src", "").removeprefix("media:"), caption=given.get("alt") or None)
            if figure is not None:
                figure.append(ref)
    text.append(page[at:])
    flush()
    return items


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, items: the interleaved sequence of every page."""
    kind = pages.schema[key].dataType

    def run(batches):
        for keys, texts in common.steps(batches, "key", "html"):
            found = [parse(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow_key), pa.array(found, arrow_items)], names=[key, "items"])

    common.ship(pages.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_key = to_arrow_type(kind)
    arrow_items = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    chosen = pages.select(F.col(key).alias("key"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return chosen.mapInArrow(run, f"`{key}` {kind.simpleString()}, items {ITEMS}")


def to_png(content: bytes) -> bytes:
    """Content padded with bytes 0 to a positive multiple of WIDTH, as 8-bit grey samples, WIDTH to a row."""
    rows = max(1, -(-len(content) // WIDTH))
    samples = np.zeros((rows, WIDTH + 1), dtype=np.uint8)
    flat = np.zeros(rows * WIDTH, dtype=np.uint8)
    flat[: len(content)] = np.frombuffer(content, dtype=np.uint8)
    samples[:, 1:] = flat.reshape(rows, WIDTH)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"tEXt", b"length\0%d" % len(content)) + chunk(b"IDAT", zlib.compress(samples.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(png: bytes) -> tuple[bytes, int]:
    """The payload, padding included, and the length without it; chunk checksums are verified."""
    if png[:8] != _PNG:
        raise ValueError("not a stored medium")
    at, data, length = 8, b"", None
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != png[at + 8 + n : at + 12 + n]:
            raise ValueError("a stored medium is damaged")
        if kind == b"tEXt" and body.startswith(b"length\0"):
            length = int(body[7:])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    samples = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(-1, WIDTH + 1)
    return samples[:, 1:].tobytes(), length


def feature(payload: bytes) -> str:
    """Rows, mean, variance, samples in eight bands of brightness, and mean step between neighbours; integers, so exact."""
    x = np.frombuffer(payload, dtype=np.uint8)
    n, total = len(x), int(x.sum(dtype=np.int64))
    squares = int((np.bincount(x, minlength=256) * np.arange(256, dtype=np.int64) ** 2).sum())
    bands = np.bincount(x >> 5, minlength=8).tolist()
    step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    return f"rows={n // WIDTH};mean={total * 1000 // n};var={(squares * n - total * total) * 100 // (n * n)};bands={','.join(map(str, bands))};step={step * 1000 // n}"


def store(contents: DataFrame, path: str) -> None:
    """Writes (digest, content) rows as media; what a task has just stored it does not store again."""

    def run(batches):
        for digests, raw in common.steps(batches, "digest", "content"):
            new = dict(zip(digests, raw))
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string()), pa.array([to_png(c or b"") for c in new.values()], pa.binary())], names=["digest", "media"])

    contents.select("digest", "content").mapInArrow(run, "digest string, media binary").write.option("compression", "none").parquet(path)


def facts(spark: SparkSession, path: str) -> DataFrame:
    """FACTS of every stored medium, from the bytes read back; one row a digest."""

    def run(batches):
        for digests, media in common.steps(batches, "digest", "media"):
            cols = [[] for _ in range(8)]
            for d, png in zip(digests, media):
                payload, n = from_png(png)
                row = (d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), feature(payload))
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in FACTS.split(", ")])

    stored = spark.read.schema("digest string, media binary").parquet(path)
    return stored.mapInArrow(run, FACTS).dropDuplicates(["digest"])


def resolve(found: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Every sequence with `resolved`: its items in page order, media with the columns of `known` (one row a digest)."""
    numbered = found.withColumn("row_", F.monotonically_increasing_id())
    flat = numbered.select(key, "row_", F.explode_outer("items").alias("i")).select(key, "row_", F.col("i.*"))
    names = [c for c in known.columns if c != "digest"]
    # Text blocks have no digest; a key of their own spreads them over the join's tasks.
    key_ = F.coalesce("digest", F.concat(F.lit("\t"), F.col("row_").cast("string")))
    joined = flat.withColumn("key_", key_).join(known.withColumnRenamed("digest", "key_"), "key_", "left")
    item = F.struct("position", "kind", "text", "digest", "caption", *names)
    return joined.groupBy("row_", key).agg(F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), item))).alias("resolved")).drop("row_")


def document_pages(docs: DataFrame) -> DataFrame:
    """Each document as a page that shows its text as one medium with a caption: doc_id, digest, content, html."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), F.encode(text, "UTF-8").alias("content"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    page = F.concat(F.lit("<article><h1>Document "), name, F.lit('</h1><figure><img src="media:'), F.col("digest"), F.lit('"><figcaption>Text of document '), name, F.lit("</figcaption></figure></article>"))
    return rows.withColumn("html", page)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = document_pages(common.table(spark, sf_dir, "documents"))
    path = common.scratch_path(spark, "media")
    store(pages, path)
    whole = resolve(sequences(pages.select("doc_id", "html"), "doc_id"), "doc_id", facts(spark, path))
    medium = F.get(F.filter("resolved", lambda i: i["kind"] == "media"), 0)
    names = [c.split()[0] for c in FACTS.split(", ")][1:]
    return whole.select("doc_id", medium.alias("m")).select("doc_id", *[F.col(f"m.{c}").alias(c) for c in names], F.col("m.position").alias("position"), F.col("m.caption").alias("caption"))
