"""The agent endpoint over HTTP: payloads sent with retries, and requests read as a stream with offsets.

Sending: every POST carries the SHA-256 of its payload as Idempotency-Key, so that a server can tell a repeated attempt - of a
retry here, or of a task that Spark runs again - from a new payload. `exchange` returns each reply as a row; the sink `agent_endpoint` (a Python
data source) sends within a write and reports counts by commit messages.

Receiving: the source `agent_requests` reads a numbered log: GET <url>/last gives the number of requests so far, and
GET <url>?from=a&to=b those from a on before b, one JSON object a line with `n` and `body`. Offsets are numbers in that log, so a restart
from a checkpoint loses and repeats nothing. Bodies over the cap come as error rows without a body, and so does what is no such line.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .tables import BODY_CAP

#: Seconds that one attempt may take, attempts, and seconds before the second one (doubled each time).
TIMEOUT, ATTEMPTS, PAUSE = 30.0, 4, 0.2
REPLIES = "scope long, payload_hash string, status int, reply string, elapsed_ms long, attempts int, error string"
#: Requests of one task of the stream at most.
SPAN = 1_000


def post(url: str, payload: str, timeout: float = TIMEOUT, attempts: int = ATTEMPTS, pause: float = PAUSE) -> dict:
    """One payload sent: payload_hash, status, reply, elapsed_ms (of all attempts), attempts, error. Server errors and broken connections are tried again; refusals (4xx) are not."""
    body = payload.encode("utf-8")
    digest = hashlib.sha256(body).hexdigest()
    began, status, reply, error = time.monotonic(), None, None, None
    for k in range(attempts):
        if k:
            time.sleep(pause * 2 ** (k - 1))
        request = urllib.request.Request(url, data=body, method="POST", headers={"Content-Type": "application/json", "Idempotency-Key": digest})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                status, reply, error = answer.status, answer.read().decode("utf-8", "replace"), None
                break
        except urllib.error.HTTPError as e:
            status, error = e.code, f"status {e.code}"
            if e.code < 500:
                break
        except OSError as e:  # refused, reset, timed out
            status, error = None, type(e).__name__
    return {"payload_hash": digest, "status": status, "reply": reply, "elapsed_ms": int((time.monotonic() - began) * 1000), "attempts": k + 1, "error": error}


def exchange(payloads: DataFrame, url: str, timeout: float = TIMEOUT, attempts: int = ATTEMPTS, pause: float = PAUSE) -> DataFrame:
    """REPLIES of (scope, payload): rows without a payload are not sent and have an error."""
    names = [c.split()[0] for c in REPLIES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"scope": s} | (post(url, p, timeout, attempts, pause) if p is not None else {"attempts": 0, "error": "refused"}) for s, p in zip(batch["scope"], batch["payload"])]
            yield pd.DataFrame(rows, columns=names).astype({"status": "Int32", "elapsed_ms": "Int64", "attempts": "Int32"})

    return payloads.select(F.col("scope").cast("long").alias("scope"), "payload").mapInPandas(run, REPLIES)


@dataclass
class Sent(WriterCommitMessage):
    sent: int = 0
    attempts: int = 0
    bytes_up: int = 0
    chars_down: int = 0
    elapsed_ms: int = 0


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.url, self.report = options["url"], options.get("report")
        self.how = {"timeout": float(options.get("timeout", TIMEOUT)), "attempts": int(options.get("attempts", ATTEMPTS)), "pause": float(options.get("pause", PAUSE))}

    def write(self, iterator) -> Sent:
        done = Sent()
        for row in iterator:
            if row["payload"] is None:
                continue
            answer = post(self.url, row["payload"], **self.how)
            if answer["error"]:
                raise OSError(f"{self.url}: {answer['error']} after {answer['attempts']} attempts")  # Spark runs the task again
            done.sent += 1
            done.attempts += answer["attempts"]
            done.bytes_up += len(row["payload"].encode("utf-8"))
            done.chars_down += len(answer["reply"])
            done.elapsed_ms += answer["elapsed_ms"]
        return done

    def commit(self, messages: list[Sent | None]) -> None:
        """Counts of the whole write, posted to the option `report` if it is given."""
        if self.report:
            known = [m for m in messages if m is not None]
            post(self.report, json.dumps({c: sum(getattr(m, c) for m in known) for c in Sent.__dataclass_fields__}), **self.how)

    def abort(self, messages) -> None:
        """What was sent stays sent; a repeated write finds it under the same keys."""


class AgentEndpoint(DataSource):
    """df.write.format("agent_endpoint").option("url", ...).mode("append").save(): sends the column payload of every row."""

    @classmethod
    def name(cls) -> str:
        return "agent_endpoint"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if "payload" not in schema.fieldNames():
            raise ValueError("there is no column payload to send")
        return _Writer(dict(self.options))


@dataclass
class _Span(InputPartition):
    first: int
    end: int


class _Log(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.url, self.cap, self.first = options["url"].rstrip("/"), int(options.get("cap", BODY_CAP)), int(options.get("first", 0))
        self.timeout = float(options.get("timeout", TIMEOUT))

    def get(self, tail: str) -> bytes:
        for k in range(ATTEMPTS):
            try:
                with urllib.request.urlopen(self.url + tail, timeout=self.timeout) as answer:
                    return answer.read()
            except OSError:
                if k + 1 == ATTEMPTS:
                    raise
                time.sleep(PAUSE * 2**k)
        raise AssertionError

    def initialOffset(self) -> dict:
        return {"n": self.first}

    def latestOffset(self) -> dict:
        return {"n": int(self.get("/last"))}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        return [_Span(a, min(a + SPAN, end["n"])) for a in range(start["n"], end["n"], SPAN)]

    def read(self, partition: _Span):
        seen = set()
        for line in self.get(f"?from={partition.first}&to={partition.end}").splitlines():
            try:
                row = json.loads(line)
                n, body = int(row["n"]), row["body"]
            except (ValueError, KeyError, TypeError):
                continue
            if partition.first <= n < partition.end and n not in seen:
                seen.add(n)
                if not isinstance(body, str):
                    yield n, None, "not a request"
                elif len(body.encode("utf-8", "replace")) > self.cap:
                    yield n, None, "too large"
                else:
                    yield n, body, None
        for n in range(partition.first, partition.end):  # what the log has no readable line for
            if n not in seen:
                yield n, None, "not a request"

    def commit(self, end: dict) -> None:
        """The log keeps its own."""


class AgentRequests(DataSource):
    """spark.readStream.format("agent_requests").option("url", ...).load(): id, body, error."""

    @classmethod
    def name(cls) -> str:
        return "agent_requests"

    def schema(self) -> str:
        return "id long, body string, error string"

    def streamReader(self, schema) -> _Log:
        return _Log(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (AgentEndpoint, AgentRequests):
        spark.dataSource.register(source)
