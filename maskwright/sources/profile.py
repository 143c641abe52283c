"""The encrypted profile: AES-256-GCM rows under a key derived from a passphrase; a wrong key reads as null."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Profile slots in order with their classes.
SLOTS = (
    ("fullName", "person"),
    ("email", "email"),
    ("phone", "phone"),
    ("dob", "dob"),
    ("address", "address"),
    ("pan", "pan"),
    ("aadhaar", "aadhaar"),
    ("upi", "upi"),
)
ITERATIONS, MOST = 310_000, 200


def derive_key(passphrase: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, ITERATIONS)


def seal(text: Column, key: bytes) -> Column:
    return F.base64(F.aes_encrypt(text, F.lit(key), F.lit("GCM")))


def unseal(sealed: Column, key: bytes) -> Column:
    return F.try_aes_decrypt(F.unbase64(sealed), F.lit(key), F.lit("GCM")).cast("string")


def profile(spark: SparkSession, values: dict[str, str]) -> DataFrame:
    rows = [(i, key, cls, values.get(key, "")[:MOST]) for i, (key, cls) in enumerate(SLOTS)]
    return spark.createDataFrame(rows, "ord int, key string, cls string, value string")


def write(df: DataFrame, path: str, key: bytes) -> None:
    df.select("ord", "key", "cls", seal(F.col("value"), key).alias("sealed")).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    return spark.read.parquet(path).select("ord", "key", "cls", unseal(F.col("sealed"), key).alias("value"))


def slot_of(classes: DataFrame, slots: DataFrame) -> DataFrame:
    """Each class (cls, or scope and cls where profiles have a scope) with the first filled slot of it, by slot order."""
    keys = ["scope", "cls"] if "scope" in slots.columns else ["cls"]
    first = slots.filter("value <> ''").groupBy(*keys).agg(F.min_by("key", "ord").alias("key"), F.min_by("value", "ord").alias("value"))
    return classes.join(F.broadcast(first) if keys == ["cls"] else first, keys, "left")


def filled(slots: DataFrame) -> DataFrame:
    """scope, filled, slots: how many of each profile's slots have a value."""
    return slots.groupBy("scope").agg(F.count_if(F.coalesce("value", F.lit("")) != "").alias("filled"), F.count("*").alias("slots"))
