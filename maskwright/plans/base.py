"""Inputs derived from the driver's tables, in SQL that Spark and DuckDB both read, and the registry helper."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")

#: A form of ten elements for each ten customers.
FORMS = """
SELECT CAST(floor((c_custkey - 1) / 10) AS BIGINT) AS scope, CAST((c_custkey - 1) % 10 AS INT) AS ord, 'el_' || CAST(c_custkey AS STRING) AS id,
  CASE c_custkey % 10 WHEN 3 THEN 'password' WHEN 7 THEN 'image' WHEN 8 THEN 'text' WHEN 9 THEN 'heading' ELSE 'textbox' END AS role,
  CASE c_custkey % 10 WHEN 6 THEN 'textarea' WHEN 7 THEN 'img' WHEN 8 THEN 'p' WHEN 9 THEN 'h2' ELSE 'input' END AS tag,
  CASE WHEN c_custkey % 10 = 3 THEN 'password' WHEN c_custkey % 20 = 1 THEN 'email' WHEN c_custkey % 20 = 2 THEN 'tel' ELSE 'text' END AS type,
  CASE c_custkey % 10 WHEN 0 THEN 'Full name' WHEN 1 THEN 'Email address' WHEN 2 THEN 'Mobile number' WHEN 3 THEN 'Password' WHEN 4 THEN 'Card number'
    WHEN 5 THEN 'Aadhaar number' WHEN 6 THEN 'Street address' WHEN 7 THEN 'Passport photo' WHEN 8 THEN 'Notice' ELSE 'Contact phone' END AS name,
  CASE WHEN c_custkey % 10 = 0 THEN c_name WHEN c_custkey % 10 = 1 THEN lower(replace(c_name, '#', '.')) || '@example.com' WHEN c_custkey % 10 = 2 THEN CAST(9000000000 + c_custkey AS STRING)
    WHEN c_custkey % 10 = 3 THEN 'open sesame' WHEN c_custkey % 10 = 4 THEN CAST(4000000000000000 + c_custkey AS STRING) WHEN c_custkey % 10 = 5 THEN CAST(223456780000 + c_custkey AS STRING)
    WHEN c_custkey % 30 = 6 THEN c_mktsegment || ' street' END AS value,
  CASE WHEN c_custkey % 20 = 8 THEN 'Order number: ' || CAST(9000000000 + c_custkey AS STRING) || ' sent' WHEN c_custkey % 20 = 18 THEN 'Phone: ' || CAST(9000000000 + c_custkey AS STRING) || ' or mail ' || lower(replace(c_name, '#', '.')) || '@example.com'
    WHEN c_custkey % 10 = 9 THEN 'call us' END AS text,
  CAST(c_custkey % 400 AS INT) AS x, CAST((c_custkey * 7) % 500 AS INT) AS y, CAST(20 + c_custkey % 130 AS INT) AS w, CAST(16 + c_custkey % 150 AS INT) AS h,
  c_custkey % 11 <> 0 AS visible, c_custkey % 22 = 0 AS offscreen, c_custkey % 13 <> 0 AS enabled, CAST(NULL AS STRING) AS parent,
  CASE WHEN c_custkey % 40 = 0 THEN 'name' WHEN c_custkey % 40 = 4 THEN 'section-a cc-number' END AS autocomplete, CAST(NULL AS STRING) AS placeholder, CASE WHEN c_custkey % 10 = 2 THEN 'Mobile' END AS label
FROM {customer}
"""

#: Boxes by order: three kinds of rectangle with a probability each.
BOXES = """
SELECT l_orderkey AS scope, CAST(l_linenumber AS INT) AS ord, CAST(l_partkey % 600 AS INT) AS x, CAST(l_suppkey % 400 AS INT) AS y, CAST(20 + l_quantity AS INT) AS w, CAST(20 + l_partkey % 60 AS INT) AS h,
  CAST(l_discount AS DOUBLE) AS p, CAST(l_tax AS DOUBLE) AS q, l_returnflag AS cls, l_shipdate AS shipped
FROM {lineitem}
"""

#: A log of agent steps by user.
STEPS = """
SELECT user_id AS run, event_id AS step, event_type AS fp, CASE WHEN event_id % 3 = 0 THEN 'local' WHEN event_id % 3 = 1 THEN 'server' ELSE 'done' END AS route,
  CASE WHEN event_id % 5 = 0 THEN 'ask_user' WHEN event_id % 5 = 1 THEN 'fill' ELSE 'click' END AS kind, 'el_' || CAST(event_id % 4 AS STRING) AS target, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS result,
  CASE WHEN event_id % 3 = 1 THEN CAST(floor(value * 100) AS BIGINT) END AS bytes_up, props AS reply, CAST(event_id % 400 AS BIGINT) AS total_ms, CASE WHEN event_id % 50 = 0 THEN 'degraded: cpu' ELSE 'ok' END AS vision,
  CASE WHEN event_id % 9 = 0 THEN 'need_image' ELSE 'action' END AS type
FROM {events}
"""

#: Tasks, one a scope made of all its parts, and controls to route them to: part names, ten a scope.
CONTROLS = """
SELECT CAST(floor((p_partkey - 1) / 10) AS BIGINT) AS scope, CAST((p_partkey - 1) % 10 AS INT) AS ord, 'el_' || CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 4 = 0 THEN 'link' ELSE 'button' END AS role,
  p_name AS name, p_partkey % 17 <> 0 AS enabled, p_partkey % 7 <> 0 AS visible, p_partkey % 14 = 0 AS offscreen
FROM {part}
"""
TASKS = """
SELECT scope,
  CASE scope % 8 WHEN 0 THEN 'click "' || name || '"' WHEN 1 THEN lower(name) WHEN 2 THEN 'scroll down' WHEN 3 THEN 'clear everything' WHEN 4 THEN 'fill this form' WHEN 5 THEN ' ' WHEN 6 THEN 'press ' || name ELSE 'what is here' END AS task,
  CAST(CASE WHEN part % 3 = 0 THEN 1 ELSE 0 END AS INT) AS step
FROM (SELECT CAST(floor((p_partkey - 1) / 10) AS BIGINT) AS scope, min(p_name) AS name, max(p_partkey) AS part FROM {part} GROUP BY 1)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    ship(spark)
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    ship(spark)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql})


def plain(sql: str) -> str:
    """The same derived input for DuckDB, as a subquery."""
    return "(" + sql.format(**{t: t for t in TABLES}).strip() + ")"


def six(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return fn

    return add
