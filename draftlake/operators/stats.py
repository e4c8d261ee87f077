"""Usage, quota, batch and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = (50, 100, 200, 500, 1000, 2000, 5000, 10000, 30000, 60000)


def status_counts(docs: DataFrame, *by: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return docs.groupBy(*by).agg(F.count("*").alias("total"), n("completed").alias("completed"), n("failed").alias("failed"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


def query_matrix(logs: DataFrame, *by: str) -> DataFrame:
    """Counts by route and hit; an absent route counts as fuzzy, an absent hit as unknown."""
    route, hit = F.coalesce("route_type", F.lit("fuzzy")), F.col("top_k_hit")
    n = lambda t: F.count_if(F.coalesce(t, F.lit(False)))
    on = route != "off_topic"
    return logs.groupBy(*by).agg(
        F.count("*").alias("total"), n(~on).alias("off_topic"), n(on & hit.isNull()).alias("unknown"),
        n((route == "specialized") & hit).alias("specialized_success"), n((route == "specialized") & ~hit).alias("specialized_fail"),
        n((route == "fuzzy") & hit).alias("fuzzy_success"), n((route == "fuzzy") & ~hit).alias("fuzzy_fail"),
    )


def latency_means(logs: DataFrame, *by: str) -> DataFrame:
    hits = logs.where("top_k_hit")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 1).alias(f"avg_{c}")
    return hits.groupBy(*by).agg(F.count("*").alias("hits"), mean("retrieval_ms"), mean("total_ms"))


def tenant_overview(tenants: DataFrame, docs: DataFrame, logs: DataFrame) -> DataFrame:
    """Tenants with their documents and queries; both sides are counted before they are joined."""
    d = docs.groupBy("tenant_id").agg(F.count("*").alias("documents"))
    q = logs.groupBy("tenant_id").agg(F.count("*").alias("queries"), F.round(F.avg("total_ms"), 4).alias("avg_ms"))
    both = tenants.join(d, "tenant_id", "left").join(q, "tenant_id", "left")
    used = F.round(F.try_divide(F.coalesce("documents", F.lit(0)) * 100, F.col("doc_quota")), 1)
    return both.select("tenant_id", "name", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("queries", F.lit(0)).alias("queries"), "avg_ms", used.alias("quota_pct"))


def batch_outcome(items: DataFrame) -> DataFrame:
    g = items.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"))
    rate = F.coalesce(F.try_divide("failed", "total"), F.lit(0.0))
    return g.withColumn("failure_rate", F.round(rate, 3)).withColumn("status", F.when(rate >= 0.5, "FAILED").otherwise("COMPLETED"))


def batch_status(docs: DataFrame) -> DataFrame:
    g = docs.groupBy("batch_id").agg(F.bool_or(F.col("status") == "failed").alias("f"), F.bool_or(F.col("status").isin("processing", "pending")).alias("p"))
    return g.select("batch_id", F.when(F.col("f"), "failed").when(F.col("p"), "processing").otherwise("completed").alias("status"))


def cascade_failure(docs: DataFrame) -> DataFrame:
    """Documents with the status after a failed member has failed its batch's unfinished ones."""
    failed = docs.where(F.col("status") == "failed").select("batch_id").distinct().withColumn("bad", F.lit(True))
    out = F.when(F.coalesce("bad", F.lit(False)) & (F.col("status") == "processing"), "failed").otherwise(F.col("status"))
    return docs.join(failed, "batch_id", "left").select("doc_id", "batch_id", out.alias("status"))


def histogram(logs: DataFrame, value: str, *by: str) -> DataFrame:
    """Cumulative counts at each bucket's upper bound: one aggregate, then one row per bucket."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{b}") for b in BUCKETS]
    g = logs.groupBy(*by).agg(F.count(value).alias("n"), *counts)
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{b}").alias("cumulative")) for b in BUCKETS))
    return g.select(*by, "n", F.explode(rows).alias("r")).select(*by, "n", "r.*")


def histogram_quantile(hist: DataFrame, q: float, *by: str) -> DataFrame:
    """The quantile by linear interpolation in the bucket that reaches it; the last bound beyond."""
    w = Window.partitionBy(*by).orderBy("le")
    h = hist.withColumns({"low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "under": F.coalesce(F.lag("cumulative").over(w), F.lit(0))})
    rank = F.col("n") * q
    value = F.col("low") + (F.col("le") - F.col("low")) * F.try_divide(rank - F.col("under"), F.col("cumulative") - F.col("under"))
    best = h.where(F.col("cumulative") >= rank).groupBy(*by).agg(F.round(F.min_by(value, "le"), 6).alias("quantile"))
    return hist.select(*by).distinct().join(best, list(by), "left").select(*by, F.coalesce("quantile", F.lit(float(BUCKETS[-1]))).alias("quantile"))


def concentration(bills: DataFrame, by: str, tier: Column) -> DataFrame:
    """Bills and amounts per party with its share of the tenant's book."""
    g = bills.groupBy("tenant_id", by).agg(F.count("*").alias("n_bills"), F.round(F.sum("amount_numeric"), 2).alias("amount"))
    # The tenant's book is the sum over its parties: few rows, from the same pass over the bills.
    book = F.sum("amount").over(Window.partitionBy("tenant_id"))
    return g.withColumn("book", book).select("tenant_id", by, "n_bills", "amount", tier.alias("tier"), F.round(F.col("amount") / F.col("book"), 6).alias("share"))


def offered_load(requests: DataFrame, seconds: int) -> DataFrame:
    """Requests of each tenant in the window that ends with each request. A request visits its own
    hour of ``seconds`` and the next one, over which a window reaches, so no tenant is one task."""
    span = seconds * 1_000_000
    each = requests.select("id", "tenant_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"), F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    w = Window.partitionBy("tenant_id", F.floor(F.col("t") / span) + F.col("turn")).orderBy("t").rangeBetween(-span, 0)
    return each.withColumn("in_window", F.count("*").over(w)).where("turn = 0").select("id", "tenant_id", "in_window")


def numbered(df: DataFrame, group: str, order: str, width: int = 1 << 16) -> DataFrame:
    """``df`` with ``number``: the row's place (from 1) in its group by a numeric column ``order``.

    Rows are numbered inside slices of ``order``, ``width`` values wide, and the totals of the slices
    before are added, so that a group of any size is many tasks' work. Ties are numbered in any order.
    """
    dealt = df.withColumn("slice", F.floor(F.col(order) / width))
    totals = dealt.groupBy(group, "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(group, "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(group, "slice").orderBy(order))
    return dealt.withColumn("inside", inside).join(totals, [group, "slice"]).withColumn("number", F.col("inside") + F.col("before")).drop("slice", "inside", "before")


def quota_check(docs: DataFrame, quota: int) -> DataFrame:
    return numbered(docs, "tenant_id", "doc_id").select("doc_id", "tenant_id", (F.col("number") <= quota).alias("accepted"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """Per tenant and MD5 the first document; the others are duplicates of it."""
    first = docs.groupBy("tenant_id", "md5_hash").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, ["tenant_id", "md5_hash"]).select("doc_id", "tenant_id", F.when(F.col("doc_id") == F.col("first_id"), "new").otherwise("duplicate").alias("intake"), "first_id")


def page(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
