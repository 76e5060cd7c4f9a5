"""Streams with keyed state: timers, steps of orders, batches that are repeated, and streams that go on."""

import glob
import random
import shutil

from pyspark.sql import functions as F

from fieldwright.streaming import keyed
from fieldwright.streaming.common import file_stream

HOUR = 3_600_000_000


def plain_limit(rows, most, seconds):
    out, windows = [], {}
    for key, id_, micros in rows:
        start, n = windows.get(key, (None, 0))
        if start is None or micros - start > seconds * 1_000_000:
            start, n = micros, 0
        windows[key] = (start, n + 1)
        out.append((key, id_, n + 1, n + 1 <= most, max(0, most - n - 1), start + seconds * 1_000_000))
    return out


def part(spark, rows, path, n):
    """Rows as the n-th file of a folder that is read as a stream."""
    spark.createDataFrame(rows, "key long, id long, micros long").withColumn("at", F.timestamp_micros("micros")).drop("micros").coalesce(1).write.mode("append").parquet(f"{path}/in")


def test_idle_keys_leave_the_state(spark, tmp_path):
    r, path = random.Random(3), str(tmp_path)
    first = sorted((k, k * 100 + i, r.randrange(2 * HOUR)) for k in range(40) for i in range(r.randint(1, 6)))
    later = [(1, 9001, 60 * HOUR), (1, 9002, 60 * HOUR + 5), (77, 9003, 61 * HOUR)]
    last = [(1, 9100, 61 * HOUR + 7), (5, 9101, 62 * HOUR)]
    order = lambda rows: sorted(rows, key=lambda x: (x[0], x[2], x[1]))
    for n, rows in enumerate((first, later, last)):
        part(spark, rows, path, n)
        stream = keyed.limited(file_stream(spark, f"{path}/in"), 3, 1800)
        with keyed.rocks(spark):
            query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/out/batch={i}")).start()
            query.awaitTermination()
    got = sorted(tuple(x) for x in spark.read.schema(keyed.LIMITED + ", batch int").parquet(f"{path}/out").drop("batch").collect())
    assert got == sorted(plain_limit(order(first) + order(later) + order(last), 3, 1800))
    assert spark.conf.get(keyed.PROVIDER, None) != keyed.ROCKS
    state = spark.read.format("statestore").option("stateVarName", "window").load(f"{path}/c")
    assert {x.key.key for x in state.select("key").collect()} == {1, 5, 77}  # the first forty are gone


def steps():
    r = random.Random(8)
    names = ["created", "queued", "assigned", "in_review", "needs_user_clarification", "approved_for_render", "artifact_generated", "delivery_pending", "delivered", "delivery_failed", "cancelled"]
    rows = []
    for order in range(30):
        for i in range(40):
            rows.append((order, order * 1000 + i, (order * 7 + i) * 1000 + r.randrange(3), r.choice(["ann", "ann", "ann", " ", None]), r.choice([None, None, r.choice(names[1:])]), r.choice([None, None, None, r.randint(1, 4)]), "created" if i == 2 else r.choice(names)))
    return rows


STEPS = "order_id long, id long, micros long, actor string, expected_status string, expected_version long, to_status string"


def plain_steps(rows):
    states, outcomes, log = {}, [], []
    for order, id_, micros, actor, status, version, to in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        before = states.get(order)
        states[order], outcome = keyed.transition(before, micros, actor, status, version, to)
        outcomes.append((order, id_, outcome))
        if outcome == "applied":
            log.append((order, before[0] if before else None, states[order][0], states[order][1], actor, micros, id_))
    return {(k, *v) for k, v in states.items() if v}, sorted(log, key=str), sorted(outcomes)


def test_orders_move_by_checked_steps(spark, tmp_path):
    rows, path = steps(), str(tmp_path)
    cut = sorted(x[2] for x in rows)[len(rows) // 2]
    for half in ([x for x in rows if x[2] < cut], [x for x in rows if x[2] >= cut]):
        spark.createDataFrame(half, STEPS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        now, log, outcomes = keyed.order_tables(file_stream(spark, f"{path}/in"), f"{path}/tables")
    states, written, told = plain_steps(rows)
    assert {tuple(x) for x in now.collect()} == states and len(states) == 30
    assert sorted((tuple(x) for x in log.collect()), key=str) == written and len(written) > 60
    assert sorted(tuple(x) for x in outcomes.collect()) == told
    assert {x[2] for x in told} == set(keyed.OUTCOMES)
    # a batch that is run again writes over its own part
    again = spark.read.parquet(f"{path}/tables/log").where("batch = 1").drop("batch").collect()
    spark.createDataFrame(again, log.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/tables/log/batch=1")
    assert sorted((tuple(x) for x in spark.read.parquet(f"{path}/tables/log").drop("batch").collect()), key=str) == written


def test_each_refusal():
    none, queued = None, ("queued", 1, None, None)
    cases = [
        ((none, 5, None, None, None, "created"), (none, "actor_required")), ((none, 5, " ", None, None, "created"), (none, "actor_required")), ((none, 5, "a", None, None, "created"), (queued, "applied")),
        ((queued, 5, "a", None, None, "created"), (queued, "exists_already")), ((none, 5, "a", None, None, "assigned"), (none, "not_found")), ((queued, 5, "a", "assigned", 9, "assigned"), (queued, "state_conflict")),
        ((queued, 5, "a", "queued", 2, "assigned"), (queued, "version_conflict")), ((queued, 5, "a", "queued", 1, "delivered"), (queued, "invalid_transition")), ((queued, 5, "a", "queued", 1, "assigned"), (("assigned", 2, 5, None), "applied")),
        ((("queued", 3, 5, None), 8, "a", None, None, "assigned"), (("assigned", 4, 5, None), "applied")), ((("delivery_pending", 7, 5, None), 9, "a", None, None, "delivered"), (("delivered", 8, 5, 9), "applied")),
    ]
    for given, want in cases:
        assert keyed.transition(*given) == want


def test_a_stream_reads_its_own_table_alone(spark, tmp_path):
    path = str(tmp_path)
    for name in ("events", "events_old"):
        spark.range(3).coalesce(1).write.parquet(f"{path}/{name}")
    (tmp_path / "flat").mkdir()
    for name in ("events", "events_old"):
        shutil.copy(glob.glob(f"{path}/{name}/*.parquet")[0], tmp_path / "flat" / f"{name}.parquet")
    for table in (f"{path}/events", f"{path}/flat/events.parquet"):
        counts = []
        file_stream(spark, table).writeStream.option("checkpointLocation", f"{table}-c").trigger(availableNow=True).foreachBatch(lambda b, i: counts.append(b.count())).start().awaitTermination()
        assert counts == [3]
