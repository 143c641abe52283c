"""The endpoint against a local server that fails half the time, and its request log over restarts."""

import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from maskwright.sources import http, tables
from maskwright.session import ship


class Server(ThreadingHTTPServer):
    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.lock, self.calls, self.bodies, self.reports, self.log = threading.Lock(), 0, {}, [], []
        threading.Thread(target=self.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server_port}"


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def answer(self, code, text):
        raw = text.encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        if self.path == "/report":
            self.server.reports.append(json.loads(body))
            return self.answer(200, "")
        with self.server.lock:
            self.server.calls += 1
            fail = self.server.calls % 2 == 1
            if "bad" in body:
                return self.answer(400, "no")
            self.server.bodies.setdefault(self.headers["Idempotency-Key"], []).append(body)  # taken, even if the answer is lost
        return self.answer(500, "again") if fail else self.answer(200, f"ok {len(body)}")

    def do_GET(self):
        at = urlparse(self.path)
        if at.path.endswith("/last"):
            return self.answer(200, str(len(self.server.log)))
        q = parse_qs(at.query)
        return self.answer(200, "\n".join(self.server.log[int(q["from"][0]) : int(q["to"][0])]))


@pytest.fixture
def server():
    s = Server()
    yield s
    s.shutdown()


def test_exchange_retries_and_reports_each_row(spark, server):
    ship(spark)
    rows = [(i, f'{{"n":{i}}}' if i != 3 else "bad") for i in range(12)] + [(20, None)]
    sent = http.exchange(spark.createDataFrame(rows, "scope long, payload string").coalesce(1), server.url, attempts=6, pause=0.01)
    got = {r["scope"]: r for r in sent.collect()}
    for i, p in rows:
        r = got[i]
        if p is None:
            assert r["error"] == "refused" and r["attempts"] == 0
        elif p == "bad":
            assert (r["status"], r["error"], r["attempts"]) == (400, "status 400", 1)
        else:
            assert (r["status"], r["reply"], r["error"]) == (200, f"ok {len(p)}", None) and 1 <= r["attempts"] <= 6 and r["elapsed_ms"] >= 0
            assert r["payload_hash"] == hashlib.sha256(p.encode()).hexdigest() and set(server.bodies[r["payload_hash"]]) == {p}
    assert len(server.bodies) == 11
    gone = http.post("http://127.0.0.1:9", "x", attempts=2, pause=0.01)
    assert gone["status"] is None and gone["attempts"] == 2 and gone["error"]


def test_sink_sends_every_payload_once_by_its_key(spark, server):
    ship(spark)
    http.register(spark)
    rows = [(i, f'{{"n":{i}}}') for i in range(40)] + [(99, None)]
    frame = spark.createDataFrame(rows, "scope long, payload string").repartition(3)
    frame.write.format("agent_endpoint").option("url", server.url).option("attempts", 9).option("pause", 0.01).option("report", f"{server.url}/report").mode("append").save()
    assert len(server.bodies) == 40 and all(len(set(b)) == 1 for b in server.bodies.values())
    [report] = server.reports
    assert report["sent"] == 40 and report["attempts"] >= 40 and report["bytes_up"] == sum(len(p) for _, p in rows if p)


def test_request_log_restarts_without_loss_or_repeat(spark, server, tmp_path):
    ship(spark)
    http.register(spark)
    good = lambda i: json.dumps({"n": i, "body": json.dumps({"schema": tables.SCHEMA_TAG, "task": f"t{i}", "elements": [{"id": "a"}]})})
    server.log = [good(i) for i in range(5)] + [json.dumps({"n": 5, "body": "x" * 3000}), json.dumps({"n": 6, "body": 7}), "no json"]

    def drain():
        stream = spark.readStream.format("agent_requests").option("url", server.url).option("cap", 2000).load()
        q = tables.requests(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("id", "task", "n_elements", "error").collect()))

    first = drain()
    assert first == [*((i, f"t{i}", 1, None) for i in range(5)), (5, None, None, "too large"), (6, None, None, "not a request"), (7, None, None, "not a request")]
    server.log += [good(i) for i in range(8, 1300)]
    assert drain() == [*first, *((i, f"t{i}", 1, None) for i in range(8, 1300))]
    assert len(drain()) == 1300
