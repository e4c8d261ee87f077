"""Admission against a plain loop, and streams whose state follows event time, across restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from draftlake.operators import admission as A
from draftlake.operators import reuse
from draftlake.streaming import timed as T

BEGIN = datetime(2024, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(seconds):
    return BEGIN + timedelta(seconds=seconds)


def loop(rows, limits, seconds):
    """(id, tenant, admitted, remaining, reset in microseconds), request by request."""
    out, inside, span = [], {}, seconds * 1_000_000
    for number, tenant, t in sorted(rows, key=lambda r: (r[2], r[0])):
        micros = round((t - BEGIN).total_seconds() * 1_000_000)
        held = inside[tenant] = [x for x in inside.get(tenant, []) if x > micros - span]
        if len(held) >= limits[tenant]:
            out.append((number, tenant, False, 0, span - (micros - held[0])))
        else:
            out.append((number, tenant, True, limits[tenant] - len(held) - 1, span))
            held.append(micros)
    return sorted(out)


@pytest.mark.parametrize("slice_rows", [1 << 20, 300])
def test_admission_as_a_loop(spark, slice_rows):
    """10,000 requests, two thirds of them of one tenant that is over its limit for long times."""
    r, rows, now = random.Random(8), [], 0.0
    for i in range(6600):
        now += r.choice([0, 0.25, 1, 1, 3]) if i % 900 < 800 else 25
        rows.append((i, 1, at(now)))
    rows += [(i, 2, at(r.randrange(20_000) / 4)) for i in range(6600, 9000)] + [(i, 3, at(40 * i)) for i in range(9000, 10_000)]
    limits = {1: 20, 2: 30, 3: 1}
    df = spark.createDataFrame(rows, "id long, tenant_id long, created_at timestamp_ntz").repartition(5)
    tenants = spark.createDataFrame(list(limits.items()), "tenant_id long, request_limit long")
    got = sorted(map(tuple, A.admissions(df, tenants, 60, slice_rows=slice_rows).collect()))
    want = loop(rows, limits, 60)
    assert got == want and 1000 < sum(not x[2] for x in want) < 9000
    assert A.admissions(df.where("false"), tenants).count() == 0


@pytest.fixture
def files(spark, tmp_path):
    """Write batches of a stream, run it over what is there, and read all that it has told."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    number = iter(range(1000))

    def run(rows, schema, stream):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{next(number):03}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = stream(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/mark").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


REQUESTS = "id long, tenant_id long, created_at timestamp"


def test_limiter_in_event_time(files):
    """Two batches that overlap in time; the second is read after a restart."""
    r = random.Random(3)
    rows = [(i, i % 2, at(r.randrange(1200) / 2)) for i in range(300)]
    go = lambda s: T.admitted(s, 5, 60)
    files(rows[:150], REQUESTS, go)
    got = files([*rows[150:], (1000, 7, at(50_000))], REQUESTS, go)
    assert sorted(got) == [x[:3] for x in loop(rows, {0: 5, 1: 5}, 60)]


RESULTS = "id long, tenant_id long, fingerprint long, kind string, at timestamp, result double"


def test_results_expire(spark, files):
    """Reused within the lifetime of a day, asked anew beyond it, over a restart; as in a batch."""
    day = 86_400
    made = [(1, 1, 10, "intent", at(0), 0.5), (2, 1, 10, "intent", at(2 * day), 0.75), (3, 1, 11, "intent", at(0), 1.0)]
    asks = [(11, 1, 10, "intent", at(100), None), (12, 1, 10, "intent", at(day), None), (13, 1, 10, "intent", at(day + 1), None), (14, 1, 10, "intent", at(2 * day + 5), None), (15, 2, 10, "intent", at(50), None)]
    go = lambda s: T.reused(s, day * 1000)
    files([made[0], made[2], asks[0], asks[4]], RESULTS, go)
    got = files([*asks[1:4], made[1], (99, 9, 9, "intent", at(9 * day), None)], RESULTS, go)
    told = {x[0]: (x[4], x[5]) for x in got}
    assert told == {11: (0.5, True), 12: (0.5, True), 13: (None, False), 14: (0.75, True), 15: (None, False)}
    stored = spark.createDataFrame([(t, f, x, r) for _, t, f, _, x, r in made], "tenant_id long, fingerprint long, at timestamp, result double")
    batch = reuse.reuse_results(spark.createDataFrame([(i, t, f, x) for i, t, f, _, x, _ in asks], "id long, tenant_id long, fingerprint long, at timestamp"), stored, "intent")
    assert {r.id: (r.result, r.reused) for r in batch.collect()} == told


FLOWS = "flow_task_id long, step_index int, is_anomaly boolean, created_at timestamp"


def test_flows_become_overdue_without_a_message(spark, files):
    """Only another flow's later messages move the watermark; finished flows say nothing more."""
    go = T.overdue
    files([(1, 1, False, at(0)), (2, 1, False, at(10)), (3, 7, False, at(0))], FLOWS, go)
    # Past 45 s, with ten minutes for late rows; then past 400 s.
    files([(9, 7, False, at(645))], FLOWS, go)
    got = files([(9, 7, False, at(646))], FLOWS, go)
    assert sorted((f, level) for f, level, _ in got) == [(1, "WATCH"), (2, "WATCH")]
    files([(2, 2, True, at(700)), (9, 7, False, at(1000))], FLOWS, go)
    got = files([(9, 7, False, at(1001))], FLOWS, go)
    begin = int(spark.createDataFrame([(BEGIN,)], "t timestamp").select(F.unix_millis("t")).first()[0])
    assert sorted((f, level, ms - begin) for f, level, ms in got) == [
        (1, "OVERDUE", 300_000), (1, "URGENT", 120_000), (1, "WARNING", 60_000), (1, "WATCH", 30_000), (2, "WATCH", 40_000)
    ]


def test_no_request_goes_through_its_window(spark, sf):
    from draftlake.plans.queries import QUERIES

    plan = QUERIES["admitted_requests"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame, -" not in plan
