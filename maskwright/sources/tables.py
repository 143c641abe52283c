"""Documents and conversations as element tables; the request endpoint as a batch; outbox and settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_TAG, BODY_CAP = "sanitized/1", 4 * 1024 * 1024


@dataclass(frozen=True)
class Settings:
    mode: str = "balanced"
    outbox: str | None = None
    max_chars: int | None = None

    @property
    def region_cap(self) -> int:
        return 0 if self.mode == "fast" else 20

    @property
    def least_variance(self) -> float:
        return 40.0 if self.mode == "thorough" else 120.0


def document_texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("scope"), F.lit(0).alias("ord"), F.coalesce("text", F.lit("")).alias("text"))


def conversation_texts(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").alias("scope"), F.col("turn").cast("int").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))


def requests(bodies: DataFrame) -> DataFrame:
    """(id, body), and error where a body is known to be bad: id, task, n_elements, error. Oversized, malformed and untagged bodies are errors, not failures; a stream or a table."""
    kind = "schema string, task string, elements array<struct<id:string>>"
    parsed = bodies.withColumn("r", F.from_json("body", kind))
    error = (
        F.when(F.octet_length("body") > BODY_CAP, "too large").when(F.col("r.schema").isNull(), "not a request").when(F.col("r.schema") != SCHEMA_TAG, "unknown schema")
    )
    if "error" in bodies.columns:
        error = F.coalesce(F.col("error"), error)
    return parsed.select("id", F.when(error.isNull(), F.col("r.task")).alias("task"), F.when(error.isNull(), F.coalesce(F.size("r.elements"), F.lit(0))).alias("n_elements"), error.alias("error"))


def to_outbox(payloads: DataFrame, path: str) -> None:
    """What would be sent, as a folder of JSON lines a sender may pick up."""
    payloads.write.mode("append").json(path)
