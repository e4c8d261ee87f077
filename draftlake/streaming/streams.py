"""Structured Streaming forms of the log and flow statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from draftlake.operators import audit as A
from draftlake.operators import lifecycle as L
from draftlake.operators import service as V
from draftlake.operators.stats import BUCKETS
from draftlake.streaming.buckets import Buckets

LATE = "10 minutes"


def timed(logs: DataFrame, column: str = "created_at") -> DataFrame:
    """Logs whose event time is a timestamp with a watermark (NTZ values are taken as UTC)."""
    return logs.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, LATE)


def windowed_counts(logs: DataFrame, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Queries and mean latency of each tenant in sliding windows; late rows are dropped."""
    g = timed(logs).groupBy(F.window("created_at", length, slide).alias("w"), "tenant_id")
    return g.agg(F.count("*").alias("n"), F.avg("total_ms").alias("mean_ms")).select("w.start", "w.end", "tenant_id", "n", "mean_ms")


def windowed_quantiles(logs: DataFrame, value: str = "total_ms", q: float = 0.95, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """(start, end, tenant_id, n, quantile) in sliding windows, from counts of buckets alone.

    The state of a window is one count for each bucket, which adds up whatever order rows come in;
    the quantile is read from it as ``stats.histogram_quantile`` reads it from a table. Rows later
    than the watermark count in no window; the query's progress tells how many
    (numRowsDroppedByWatermark).
    """
    counts = [F.count_if(F.col(value) <= b).alias(f"b{b}") for b in BUCKETS]
    g = timed(logs).groupBy(F.window("created_at", length, slide).alias("w"), "tenant_id").agg(F.count(value).alias("n"), *counts)
    at = lambda name, i: F.struct(F.lit(float(BUCKETS[i])).alias("le"), F.lit(float(BUCKETS[i - 1]) if i else 0.0).alias("low"), F.col(name).alias("c"), (F.col(f"b{BUCKETS[i - 1]}") if i else F.lit(0).cast("long")).alias("under"))
    rows = F.array(*(at(f"b{b}", i) for i, b in enumerate(BUCKETS)))
    rank = F.col("n") * q
    first = F.get(F.filter(rows, lambda r: r["c"] >= rank), F.lit(0))
    inside = first["low"] + (first["le"] - first["low"]) * F.try_divide(rank - first["under"], first["c"] - first["under"])
    return g.select("w.start", "w.end", "tenant_id", "n", F.when(first.isNull(), F.lit(float(BUCKETS[-1]))).otherwise(F.coalesce(F.round(inside, 6), F.lit(float(BUCKETS[-1])))).alias("quantile"))


def log_tail(logs: DataFrame, key: str = "id") -> DataFrame:
    """Each log row once, however often it arrives within the watermark."""
    return timed(logs).dropDuplicatesWithinWatermark([key])


def flow_states(messages: DataFrame) -> DataFrame:
    """(flow_task_id, current_step, elapsed_ms, status) as messages of flows arrive.

    A flow ends at its first anomaly; later messages change nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, spent, status = state.get if state.exists else (0, 0, "processing")
        rows = pd.concat(list(batches)).sort_values("step_index")
        for r in rows.itertuples():
            if status in ("timeout", "error") or r.step_index <= last:
                continue
            last, spent = int(r.step_index), spent + int(r.processing_ms)
            status = r.status if r.is_anomaly else ("completed" if last >= 7 else "processing")
        state.update((last, spent, status))
        yield pd.DataFrame([(key[0], last, spent, status)], columns=["flow_task_id", "current_step", "elapsed_ms", "status"])

    schema = "current_step int, elapsed_ms long, status string"
    return messages.groupBy("flow_task_id").applyInPandasWithState(step, f"flow_task_id long, {schema}", schema, "update", GroupStateTimeout.NoTimeout)


def limited(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """(id, tenant_id, admitted): requests in order of time, at most ``limit`` admitted in any
    window; rejected ones do not count. State: the admitted times still inside the window."""

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["micros", "id"])
        out = []
        for r in rows.itertuples():
            times = [t for t in times if t > r.micros - seconds * 1_000_000]
            ok = len(times) < limit
            if ok:
                times.append(int(r.micros))
            out.append((int(r.id), key[0], ok))
        state.update((times,))
        yield pd.DataFrame(out, columns=["id", "tenant_id", "admitted"])

    r = requests.select("id", "tenant_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("micros"))
    return r.groupBy("tenant_id").applyInPandasWithState(admit, "id long, tenant_id long, admitted boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def into_uploads(uploads: DataFrame, path: str, checkpoint: str):
    """Keep a stream of bill uploads, each batch in a folder that a repeated batch overwrites;
    versions and records are then read from the whole: ``lifecycle.records(read(path))``."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return uploads.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def into_records(uploads: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Keep the state of each bill (``lifecycle.states``) while its uploads arrive. A batch rewrites
    only the buckets that it touches, and a repeated batch changes nothing; ``lifecycle.whole_records``
    of ``Buckets(spark, path).read()`` gives the records."""

    def keep(batch: DataFrame, number: int) -> None:
        new = L.states(A.risk_flags(V.named_tickets(batch)))
        Buckets(batch.sparkSession, path, buckets).update(new, ("tenant_id", "ticket_number"), L.merged_states, number)

    return uploads.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def into_chunks(elements: DataFrame, chunked, path: str, checkpoint: str, buckets: int = 64):
    """Chunk arriving elements (doc_id, ...) with ``chunked`` and keep them. Documents that other
    batches hold are left out, so a document that is sent again changes nothing; which are held is
    kept in buckets, of which a batch reads those of its own documents."""

    def keep(batch: DataFrame, number: int) -> None:
        held = Buckets(batch.sparkSession, f"{path}-keys", buckets)
        keys = batch.select("doc_id").distinct()
        known = held.touched(keys, ("doc_id",))
        if known is not None:
            batch = batch.join(known.where(F.col("since") < number).select("doc_id"), "doc_id", "left_anti")
        chunked(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        first = lambda rows: rows.groupBy("doc_id").agg(F.min("since").alias("since"))
        held.update(keys.withColumn("since", F.lit(number).cast("long")), ("doc_id",), first, number)

    return elements.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
