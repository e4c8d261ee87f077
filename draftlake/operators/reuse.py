"""Results that serve again, checks of requests, feedback and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How long a result of each kind serves, in seconds.
LIFETIMES = {"audit": 14_400, "compliance": 21_600, "fraud": 7_200, "answer": 7_200, "intent": 86_400, "recognition": 86_400}


def reuse_results(requests: DataFrame, store: DataFrame, kind: str) -> DataFrame:
    """Requests (id, tenant_id, fingerprint, at) with the newest earlier result (tenant_id,
    fingerprint, at, result) that is young enough, else null; among equal times the greatest.

    Both sides go through one window by key and time, so no pair of rows is ever made.
    """
    columns = ("id", "tenant_id", "fingerprint", "at", "result")
    done = F.struct(F.col("at").alias("done_at"), F.col("result").alias("done"))
    r = requests.withColumn("result", F.lit(None).cast(store.schema["result"].dataType)).select(*columns, F.lit(True).alias("asks"), F.lit(None).cast(store.select(done.alias("d")).schema["d"].dataType).alias("d"))
    s = store.withColumn("id", F.lit(None).cast(requests.schema["id"].dataType)).select(*columns, F.lit(False).alias("asks"), done.alias("d"))
    w = Window.partitionBy("tenant_id", "fingerprint").orderBy("at", "asks", "result")
    both = r.unionByName(s).withColumn("best", F.last("d", ignorenulls=True).over(w)).where("asks")
    age = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("best.done_at").cast("timestamp"))
    fresh = age <= LIFETIMES[kind] * 1_000_000
    return both.select("id", "tenant_id", F.when(fresh, F.col("best.done")).alias("result"), F.coalesce(fresh, F.lit(False)).alias("reused"))


def broken_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with the names of the rules that each row breaks; a rule that is null is broken."""
    return df.withColumn("broken", F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()))))


def request_rules() -> dict[str, Column]:
    return {
        "score": F.col("feedback_score").isNull() | F.col("feedback_score").between(1, 5),
        "query": F.length("query").between(2, 2000),
        "top_k": F.col("top_k").between(1, 50),
    }


def tenant_rules() -> dict[str, Column]:
    return {"qps": F.col("qps_limit").between(1, 200), "quota": F.col("doc_quota") >= 100}


def apply_feedback(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Logs with the last score given by their own tenant: feedback (id, tenant_id, score, at)."""
    last = feedback.groupBy("id", "tenant_id").agg(F.max(F.struct("at", "score"))["score"].alias("feedback_score"))
    return logs.drop("feedback_score").join(last, ["id", "tenant_id"], "left")


def retryable(docs: DataFrame, batch: DataFrame) -> DataFrame:
    """Failed members of a batch (doc_id) whose text is still there."""
    return docs.join(batch.select("doc_id").distinct(), "doc_id", "left_semi").where((F.col("status") == "failed") & F.col("text").isNotNull())


def batch_members(batches: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents of batches (batch_id, doc_ids) with their place in the list."""
    each = batches.select("batch_id", F.posexplode("doc_ids").alias("position", "doc_id"))
    return each.join(docs, "doc_id")


def explained(df: DataFrame, codes: DataFrame, code: str = "error_code") -> DataFrame:
    """``df`` with its codes' entries; an unknown code keeps its row."""
    return df.join(codes, code, "left")
