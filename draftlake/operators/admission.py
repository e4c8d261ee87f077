"""Which requests a sliding window's limit lets through, when rejected ones do not count."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.session import shared_folder

#: Requests of a tenant (about) that one task goes through at a time.
SLICE = 1 << 20


def admit(times: list[int], known: list[bool], limit: int, span: int) -> list[bool]:
    """Requests in order: a known one is admitted; another one is while fewer than ``limit`` admitted
    ones are less than ``span`` old."""
    inside: deque[int] = deque()
    out = []
    for t, sure in zip(times, known, strict=True):
        while inside and inside[0] <= t - span:
            inside.popleft()
        out.append(sure or len(inside) < limit)
        if out[-1]:
            inside.append(t)
    return out


def admissions(requests: DataFrame, tenants: DataFrame, seconds: int = 60, limit_column: str = "request_limit", slice_rows: int = SLICE) -> DataFrame:
    """(id, tenant_id, admitted, remaining, reset_in_us) of requests (id, tenant_id, created_at).

    In the order of time and then id a request is admitted if fewer than its tenant's limit (tenants:
    tenant_id, ``limit_column``) were admitted in the ``seconds`` before it. remaining is what its
    window has left then; reset_in_us is the whole window for an admitted request, else the time
    until the oldest admitted one leaves it. ids tell a tenant's requests apart. Requests without a tenant, a time or a limit are left out.

    A request in whose window no more are even offered than the limit is always admitted. Only where
    more are, in runs of whole windows, the order matters: such a run is gone through from its
    beginning, where the window before is known, in slices of whole windows of about ``slice_rows``
    requests. A round takes one slice of every run, and what it admitted in its last window begins
    the next; so no task holds more than a slice, and rounds grow only with the longest run.
    """
    spark = requests.sparkSession
    shared_folder(spark)
    span = seconds * 1_000_000
    t = F.unix_micros(F.col("created_at").cast("timestamp"))
    limits = tenants.select("tenant_id", F.col(limit_column).cast("long").alias("most")).where("most is not null")
    rows = requests.select("id", "tenant_id", t.alias("t")).where("t is not null").join(limits, "tenant_id")
    rows = rows.withColumn("hour", F.floor(F.col("t") / span))
    # A window reaches over two hours of its own length, so a request visits its own and the next
    # (kinds 0 and 1), and its own once more at the moment its window begins (kind 2). What is inside
    # is the difference of two running counts, so no row goes through its window.
    visits = lambda df: df.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumns(
        {"place": F.col("hour") + F.when(F.col("kind") == 1, 1).otherwise(0), "at": F.col("t") - F.when(F.col("kind") == 2, span).otherwise(0)}
    )
    place, own = Window.partitionBy("tenant_id", "place"), F.col("kind") == 0
    upto = F.count_if(F.col("kind") < 2).over(place.orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    counts = visits(rows).withColumn("upto", upto).where("kind <> 1")
    offered = counts.groupBy(*rows.columns).agg(F.sum(F.when(own, F.col("upto")).otherwise(-F.col("upto"))).alias("offered")).checkpoint()

    # Runs of hours in which more is offered than allowed: one row for each such hour of a tenant.
    hours = offered.groupBy("tenant_id", "hour").agg(F.count("*").alias("n"), F.bool_or(F.col("offered") > F.col("most")).alias("busy")).where("busy")
    by_hour = Window.partitionBy("tenant_id").orderBy("hour")
    begins = F.coalesce(F.col("hour") - F.lag("hour").over(by_hour) > 1, F.lit(True))
    run = Window.partitionBy("tenant_id", "run")
    hours = hours.withColumn("run", F.sum(F.when(begins, 1).otherwise(0)).over(by_hour))
    each = F.greatest(F.lit(1), F.floor(F.lit(slice_rows) / F.max("n").over(run)))
    hours = hours.select("tenant_id", "hour", "run", F.floor((F.col("hour") - F.min("hour").over(run)) / each).cast("int").alias("slice"))
    hours = hours.withColumn("last", F.max("hour").over(Window.partitionBy("tenant_id", "run", "slice"))).checkpoint()
    # The hour before a run, where all are admitted, comes with its first slice.
    before = hours.groupBy("tenant_id", "run").agg((F.min("hour") - 1).alias("hour"), F.min("hour").alias("last"))
    before = before.select("tenant_id", "hour", "run", F.lit(0).alias("slice"), F.col("hour").alias("last"), F.lit(True).alias("known"))
    wanted = hours.withColumn("known", F.lit(False)).unionByName(before)
    open_rows = offered.join(wanted, ["tenant_id", "hour"]).select("id", "tenant_id", "t", "most", "hour", "run", "slice", "last", "known").checkpoint()
    kinds = dict(open_rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in open_rows.columns)

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "id"], kind="stable")
        ok = admit(rows["t"].tolist(), rows["known"].tolist(), int(rows["most"].iloc[0]), span)
        # What was known beforehand was told before.
        return rows.assign(told=ok)[~rows["known"].to_numpy()]

    done = carried = None
    for number in range((hours.agg(F.max("slice")).first()[0] if not hours.isEmpty() else -1) + 1):
        here = open_rows.where(F.col("slice") == number)
        here = here if carried is None else here.unionByName(carried)
        found = here.groupBy("tenant_id", "run").applyInPandas(go, f"{schema}, told boolean").checkpoint()
        carried = found.where("told and hour = last").drop("told").withColumns({"known": F.lit(True), "slice": F.col("slice") + 1})
        done = found if done is None else done.unionByName(found)
    decided = None if done is None else done.where("not told").select("tenant_id", "id", "t", F.lit(True).alias("refused"))
    final = offered.withColumn("refused", F.lit(False)) if decided is None else offered.join(decided.distinct(), ["tenant_id", "id", "t"], "left")
    final = final.withColumn("admitted", ~F.coalesce("refused", F.lit(False)))
    # At one time: requests by id, then beginnings of windows, which leave it out.
    order = [F.col("at"), F.col("kind") == 2, F.col("id")]
    told = F.col("admitted") & (F.col("kind") < 2)
    earlier = F.count_if(told).over(place.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    oldest = F.min(F.when(told, F.col("at"))).over(place.orderBy(*(x.desc() for x in order)).rowsBetween(Window.unboundedPreceding, 0))
    seen = visits(final).withColumns({"earlier": earlier, "later": oldest}).where("kind <> 1")
    seen = seen.groupBy("id", "tenant_id", "t", "most", "admitted").agg(
        F.sum(F.when(own, F.col("earlier")).otherwise(-F.col("earlier"))).alias("before"), F.max(F.when(~own & (F.col("later") <= F.col("t")), F.col("later"))).alias("oldest")
    )
    left = F.when(F.col("admitted"), F.greatest(F.lit(0), F.col("most") - F.col("before") - 1)).otherwise(0)
    reset = F.when(F.col("admitted"), F.lit(span)).otherwise(F.coalesce(F.lit(span) - (F.col("t") - F.col("oldest")), F.lit(span)))
    return seen.select("id", "tenant_id", "admitted", left.cast("long").alias("remaining"), reset.cast("long").alias("reset_in_us"))
