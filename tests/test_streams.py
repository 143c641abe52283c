"""Ordered state on streams: late and shuffled rows give the batch's answers, and nothing is left behind."""

import datetime as dt
import random

from maskwright.streaming import guards, vault

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
FOUND = "run long, ts timestamp, step long, ord int, task string, cls string, value string"
STEPS = "run long, ts timestamp, step long, task string, fp string, kind string, target string, result string"


def drained(spark, rows, schema, folder, transform, files=4):
    """The stream's output over shuffled rows in several files, and the rows that its state holds in the end; a last row of another run moves the watermark on."""
    dice = random.Random(3)
    rows = dice.sample(rows, len(rows))
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out, kept = f"{folder}/out", {"spark.sql.shuffle.partitions": "2"}
    for key, value in kept.items():
        spark.conf.set(key, value)
    try:
        for day in (0, 2, 4):  # without data in between the watermark would stand still
            if day:
                blank = dict.fromkeys([c.split()[0] for c in schema.split(", ")]) | {"run": -day, "ts": START + dt.timedelta(days=day), "step": 0}
                spark.createDataFrame([tuple(blank.values())], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = transform(spark.readStream.schema(schema).parquet(f"{folder}/in"))
            q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
            q.awaitTermination()
            left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        return spark.read.schema(stream.schema).parquet(out).filter("run >= 0"), left[-1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_vault_of_each_task_on_a_stream(spark, tmp_path):
    """Handles as on the table whatever the order of arrival; each task has its own; the state store ends with no more than the last row's waiting."""
    rows = []
    for run in range(3):
        for step in range(12):
            for ord_ in range(2):
                cls = "email" if (step + ord_) % 2 else "phone"
                rows.append((run, START + dt.timedelta(minutes=step), step, ord_, f"t{step // 5}", cls, None if step == 7 else f"{cls} {(step * 7 + run) % 4}"))
    table = spark.createDataFrame(rows, FOUND)
    want = sorted(map(tuple, vault.task_vaults(table).collect()), key=repr)
    got, left = drained(spark, rows, FOUND, tmp_path, lambda s: vault.task_vaults(s, "1 day"))
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) == len(rows)
    first = {(r[0], r[3]): r[6] for r in want if r[1] in (0, 5, 10) and r[2] == 0}
    assert all(h.endswith("_1") for h in first.values()) and len(first) == 9
    assert left <= 6  # two runs that only move the watermark


def test_late_steps_are_put_in_order(spark, tmp_path):
    rows = [(run, START + dt.timedelta(minutes=step), step, "a" if step < 14 else "b", f"f{step // 3}", ("click", "fill", "ask_user")[step % 3], f"el_{step % 4}", "ok" if step % 4 else "failed") for run in range(3) for step in range(20)]
    want = sorted(map(tuple, guards.guarded(spark.createDataFrame(rows, STEPS)).collect()), key=repr)
    got, left = drained(spark, rows, STEPS, tmp_path, lambda s: guards.guarded(s, "1 day"))
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert left <= 6
