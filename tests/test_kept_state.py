"""Batches merged into kept state, batches repeated, and quantiles of sliding windows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from draftlake.operators import audit as A
from draftlake.operators import lifecycle as L
from draftlake.operators import service as V
from draftlake.operators import stats as S
from draftlake.sources import domain as D
from draftlake.streaming import streams as X
from draftlake.streaming.buckets import Buckets


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_records_of_a_stream(spark, sf, tmp_path):
    """Three batches of uploads, the last one repeated, give the records and flags of the whole."""
    columns = ["tenant_id", "ticket_number", "bill_id", "upload_time", "drawer", "amount_numeric", "endorsers", "ticket_type", "acceptor", "issue_date", "due_date"]
    whole = D.uploads(spark, sf).withColumn("ticket_number", F.when(F.col("bill_id") % 11 == 0, "").otherwise(F.col("ticket_number")))
    flagged = A.risk_flags(whole).columns
    columns += [c for c in whole.columns if c not in columns and c in flagged]
    whole = whole.select(*columns)
    for i in range(3):
        whole.where((F.col("bill_id") + F.col("amount_numeric").cast("long")) % 3 == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(whole.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    X.into_records(source, f"{tmp_path}/state", f"{tmp_path}/mark", buckets=5).trigger(availableNow=True).start().awaitTermination(300)
    kept = Buckets(spark, f"{tmp_path}/state", 5)
    named = V.named_tickets(whole)
    want = L.records(named).join(V.flag_history(A.risk_flags(named)), ["tenant_id", "ticket_number"], "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    got = L.whole_records(kept.read())
    assert rows(got) == rows(want.select(*got.columns))
    # The last batch once more, as after a failure before the stream's own mark.
    last, places = kept.told()
    assert last == 2 and set(places) == set(range(5))
    kept.update(L.states(A.risk_flags(named)), ("tenant_id", "ticket_number"), L.merged_states, 2)
    assert rows(L.whole_records(kept.read())) == rows(want.select(*got.columns))


def test_only_touched_buckets_are_written(spark, tmp_path):
    kept = Buckets(spark, str(tmp_path / "b"), 8)
    first = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    kept.update(spark.createDataFrame([(i, 1) for i in range(100)], "k long, n long"), ("k",), first, 0)
    kept.update(spark.createDataFrame([(7, 5), (1000, 1)], "k long, n long"), ("k",), first, 1)
    assert sorted(kept.told()[1].values()).count(1) <= 2
    assert {r.k: r.n for r in kept.read().collect()} == {**{i: 1 for i in range(100)}, 7: 6, 1000: 1}


@pytest.mark.parametrize("q", [0.5, 0.95])
def test_quantiles_of_windows(spark, tmp_path, q):
    begin = datetime(2024, 1, 1)
    logs = [(i % 3, begin + timedelta(seconds=17 * i), float((i * 7919) % 70_000)) for i in range(600)]
    df = spark.createDataFrame(logs, "tenant_id long, created_at timestamp, total_ms double")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    stream = X.windowed_quantiles(source, q=q).writeStream.format("memory").queryName(f"windows{int(q * 100)}").outputMode("complete").trigger(availableNow=True).start()
    stream.awaitTermination(300)
    slid = df.withColumn("w", F.explode(F.array(*(F.date_trunc("minute", "created_at") - F.expr(f"INTERVAL {i} MINUTES") for i in range(5)))))
    want = S.histogram_quantile(S.histogram(slid, "total_ms", "w", "tenant_id"), q, "w", "tenant_id").collect()
    got = spark.table(f"windows{int(q * 100)}").collect()
    assert {(r.start, r.tenant_id): r.quantile for r in got} == {(r.w, r.tenant_id): r.quantile for r in want}
