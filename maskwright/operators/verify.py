"""Independent verification of serialised contexts, hardening and escalation, receipts."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import HANDLE, bounded, entropy, fnv1a, strip_handles
from ..sources.tables import SCHEMA_TAG
from ..session import cut
from .patterns import CANDIDATE, scan_udf
from .redact import serialise

#: Keys a payload may have.
ALLOWED_KEYS = (
    "schema", "task", "mode", "urlClass", "title", "viewport",
    "w", "h", "scrollY", "docH",
    "elements", "id", "role", "tag", "type", "name", "bbox", "visible", "offscreen", "enabled",
    "parent", "conf", "src", "holds", "wants", "sensitive", "empty", "text",
    "groups", "kind", "children", "x", "y",
    "regions", "cls", "state",
    "image", "history", "action", "target", "result", "note",
)
PHONE_CUE = "(?i)phone|mobile|contact|tel|whatsapp|call"
DEPTH = 6


def leaks(payloads: DataFrame) -> DataFrame:
    """V1: scope, cls, start, p: patterns that survive in a payload without its handles."""
    bare = payloads.select("scope", strip_handles(F.col("payload")).alias("bare")).filter(F.col("bare").rlike(CANDIDATE))
    hits = bare.select("scope", "bare", F.explode(scan_udf("bare")).alias("h"))
    begin = F.greatest(F.col("h.start") - 60, F.lit(0))
    cue = F.substring("bare", begin + 1, F.col("h.start") - begin).rlike(PHONE_CUE)
    return hits.filter((F.col("h.p") >= 0.85) | ((F.col("h.cls") == "phone") & (F.col("h.p") >= 0.70) & cue)).select("scope", "h.cls", "h.start", "h.p")


#: Values and payloads of a scope that are searched at once; larger scopes go in several blocks of each.
VALUE_BLOCK, PAYLOAD_BLOCK = 20_000, 200


def _blocks(rows: DataFrame, key: str, most: int, item: Column, name: str) -> DataFrame:
    """scope, name: the scope's items as arrays of about `most` at most. Only scopes with more rows are dealt over blocks, by a hash of `key`."""
    large = rows.groupBy("scope").agg(F.count("*").alias("n_")).filter(F.col("n_") > most)
    block = F.coalesce(F.pmod(F.xxhash64(key), F.ceil(F.col("n_") / most)), F.lit(0))
    return rows.join(large, "scope", "left").groupBy("scope", block.alias("block_")).agg(F.collect_list(item).alias(name)).drop("block_")


def vault_leaks(payloads: DataFrame, vault: DataFrame) -> DataFrame:
    """V2: scope, handle of values (four characters or more) that a payload holds, as they are or escaped as JSON.

    All values of a block are searched in one pass over each payload, by an Aho-Corasick automaton: the time is that of the
    payloads and of the values, not of their pairs."""
    v = vault.filter(F.length("value") >= 4).select("scope", "handle", "value").distinct()
    escaped = F.regexp_extract(F.to_json(F.struct(F.col("value"))), r'^\{"value":"(.*)"\}$', 1)
    needles = _blocks(v, "value", VALUE_BLOCK, F.struct("handle", F.array_distinct(F.array(F.col("value"), escaped)).alias("forms")), "needles")
    texts = _blocks(payloads.select("scope", "payload").filter("payload is not null").distinct(), "payload", PAYLOAD_BLOCK, F.col("payload"), "payloads")
    met = texts.join(needles, "scope").select("scope", "payloads", "needles")
    kind = met.schema["scope"].dataType

    def run(batches):
        import ahocorasick

        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                automaton, known = ahocorasick.Automaton(), {}
                for n in r["needles"]:
                    for form in n["forms"]:
                        if form:
                            known.setdefault(form, []).append(n["handle"])
                for form, handles in known.items():
                    automaton.add_word(form, handles)
                if known:
                    automaton.make_automaton()
                    found = {h for text in r["payloads"] for _, handles in automaton.iter(text) for h in handles}
                    out += [(r["scope"], h) for h in sorted(found)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], to_arrow_type(kind)), pa.array([h for _, h in out], pa.string())], names=["scope", "handle"])

    return met.mapInArrow(run, T.StructType([T.StructField("scope", kind), T.StructField("handle", T.StringType())])).distinct()


def secret_like(payloads: DataFrame) -> DataFrame:
    """V4: scope, token of quoted tokens of twenty characters or more with entropy of 4.2 or more."""
    found = F.regexp_extract_all("payload", F.lit(r'"([A-Za-z0-9_\-+/=.]{20,})"'), F.lit(1))
    rows = payloads.select("scope", F.explode(found).alias("token"))
    return rows.filter(~F.col("token").rlike(f"^{HANDLE}$") & ~F.col("token").rlike(f"^({SCHEMA_TAG}|(el|g)_[0-9]+)$")).filter(entropy(F.col("token")) >= 4.2)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unknown(payloads: pd.Series) -> pd.Series:
    allowed = frozenset(ALLOWED_KEYS)

    def walk(value, depth, out):
        if depth > DEPTH:
            return out
        if isinstance(value, dict):
            for k, v in value.items():
                if k not in allowed:
                    out.add(k)
                walk(v, depth + 1, out)
        elif isinstance(value, list):
            for v in value:
                walk(v, depth + 1, out)
        return out

    def one(text):
        try:
            return sorted(walk(json.loads(text), 0, set()))
        except (TypeError, ValueError):
            return ["(not JSON)"]

    return payloads.map(one)


def unknown_keys(payload: Column) -> Column:
    """V5: keys that are not on the list, to a depth of six."""
    return _unknown(payload)


def verify(payloads: DataFrame, vault: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """scope, v1..v5, passed. masks: scope, clean (all sampled pixels of masked regions dark); without it v3 holds."""
    flag = lambda df, name: df.select("scope").distinct().withColumn(name, F.lit(False))
    out = payloads.select("scope", "payload")
    for name, failed in (("v1", leaks(payloads)), ("v2", vault_leaks(payloads, vault)), ("v4", secret_like(payloads))):
        out = out.join(flag(failed, name), "scope", "left")
    if masks is not None:
        out = out.join(masks.groupBy("scope").agg(F.bool_and("clean").alias("v3")), "scope", "left")
    else:
        out = out.withColumn("v3", F.lit(True))
    out = out.withColumn("v5", F.size(unknown_keys(F.col("payload"))) == 0)
    checks = ["v1", "v2", "v3", "v4", "v5"]
    out = out.select("scope", *[F.coalesce(c, F.lit(True)).alias(c) for c in checks])
    return out.withColumn("passed", reduce(lambda a, b: a & b, map(F.col, checks)))


def harden(safe: DataFrame) -> DataFrame:
    """Drops what elements hold and marks them sensitive."""
    return safe.withColumn("sensitive", F.col("sensitive") | F.col("holds").isNotNull()).withColumn("holds", F.lit(None).cast("string"))


def escalate(safe: DataFrame, vault: DataFrame, masks: DataFrame | None = None, retries: int = 2) -> DataFrame:
    """scope, payload, passed, retries: scopes that fail are hardened and verified again; what still fails is refused (payload null)."""
    done = None
    for k in range(retries + 1):
        payloads = cut(serialise(safe))
        verdict = cut(payloads.join(verify(payloads, vault, masks).select("scope", "passed"), "scope").withColumn("retries", F.lit(k)))
        last = k == retries
        ended = verdict if last else verdict.filter("passed")
        done = ended if done is None else done.unionByName(ended)
        if not last and not verdict.filter("not passed").limit(1).count():
            break
        if not last:
            safe = cut(harden(safe.join(verdict.filter("not passed").select("scope"), "scope", "left_semi")))
    return done.select("scope", F.when(F.col("passed"), F.col("payload")).alias("payload"), "passed", "retries")


def receipts(safe: DataFrame, findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """scope, dropped, substituted, kept, masked, payload_bytes, payload_hash, passed."""
    fates = safe.groupBy("scope").agg(*[F.count_if(F.col("fate") == f).alias(n) for f, n in (("drop", "dropped"), ("substitute", "substituted"), ("keep", "kept"))])
    masked = findings.filter("fate = 'mask'").groupBy("scope").agg(F.count("*").alias("masked"))
    out = verdicts.join(fates, "scope", "left").join(masked, "scope", "left")
    return out.select("scope", "dropped", "substituted", "kept", F.coalesce("masked", F.lit(0)).alias("masked"), F.octet_length("payload").alias("payload_bytes"), fnv1a(F.col("payload")).alias("payload_hash"), "passed")


def response_bounded(text: Column) -> Column:
    return text.rlike(bounded(HANDLE))
