"""Audit tasks: what each type runs, how far it is, its report, and batches of bills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The steps of each type of task, and those whose failure ends it.
_START, _END = [["document_parser"], ["element_extraction"]], [["risk_assessment"], ["report_generation"]]
_FULL = [["compliance_retrieval", "endorsement_chain", "fraud_detection"], ["contract_review"]]
PLANS = {
    "full_audit": _START + _FULL + _END,
    "issuance_check": _START + [["compliance_retrieval", "bill_issuance"]] + _END,
    "discount_apply": _START + _FULL + _END,
    "acceptance_prompt": _START + [["compliance_retrieval", "endorsement_chain"]] + _END,
    "endorsement": _START + [["endorsement_chain", "fraud_detection"]] + _END,
    "payment_prompt": _START + _FULL + _END,
    "pledge": _START + _FULL + _END,
    "collection": _START + _FULL + _END,
}
CRITICAL = ("document_parser", "element_extraction", "compliance_retrieval", "endorsement_chain", "bill_issuance", "risk_assessment")


def is_critical(task_type: Column, node: Column) -> Column:
    return node.isin(*CRITICAL) | ((node == "contract_review") & (task_type == "discount_apply"))


def steps_of(task_type: Column) -> Column:
    """array<array<string>>: the steps of a type, in order; an unknown type is a full audit."""
    plan = lambda p: F.array(*(F.array(*map(F.lit, step)) for step in p))
    out = plan(PLANS["full_audit"])
    for name, p in PLANS.items():
        out = F.when(task_type == name, plan(p)).otherwise(out)
    return out


def audit_plan(tasks: DataFrame) -> DataFrame:
    """Tasks (task_id, task_type, failed_nodes) with the nodes that gave a result and whether the
    task failed: the step after a critical failure does not begin."""
    failed = F.coalesce("failed_nodes", F.array().cast("array<string>"))
    kind = F.coalesce("task_type", F.lit("full_audit"))

    def step(state: Column, nodes: Column) -> Column:
        broken = F.exists(nodes, lambda n: F.array_contains(failed, n) & is_critical(kind, n))
        out = F.when(state["alive"], F.concat(state["done"], F.array_except(nodes, failed))).otherwise(state["done"])
        return F.struct((state["alive"] & ~broken).alias("alive"), out.alias("done"))

    start = F.struct(F.lit(True).alias("alive"), F.array().cast("array<string>").alias("done"))
    t = tasks.withColumn("s", F.aggregate(steps_of(kind), start, step))
    return t.select("task_id", "task_type", F.col("s.done").alias("produced"), (~F.col("s.alive")).alias("failed"))


def progress(events: DataFrame) -> DataFrame:
    """Per finished step (task_id, task_type, step_index) the share of its type's steps, in percent."""
    w = Window.partitionBy("task_id").orderBy("step_index")
    share = F.count("*").over(w) / F.size(steps_of(F.coalesce("task_type", F.lit("full_audit"))))
    return events.select("task_id", "step_index", F.round(share * 100, 1).alias("progress_pct"))


def current_report(reports: DataFrame) -> DataFrame:
    """One report of each task: a final one before others, then the newest, then the greatest id."""
    best = F.max_by("report_id", F.struct("is_final", "created_at", "report_id"))
    return reports.groupBy("task_id").agg(best.alias("report_id"))


def timeline(messages: DataFrame) -> DataFrame:
    w = Window.partitionBy("flow_task_id").orderBy("step_index", "arrived_at")
    return messages.withColumn("place", F.row_number().over(w))


def batch_audit(items: DataFrame, audited: DataFrame) -> DataFrame:
    """Items (batch_id, bill_id) with their audit. An item without a bill, a date or an amount
    fails alone and says why, in at most 500 characters."""
    j = items.join(audited.withColumn("there", F.lit(True)), "bill_id", "left")
    why = F.when(F.col("there").isNull(), "no bill").when(F.col("due_date").isNull(), "no due date").when(F.coalesce("amount_numeric", F.lit(0.0)) <= 0, "no amount")
    return j.select(
        "batch_id", "bill_id", F.when(why.isNull(), "completed").otherwise("failed").alias("status"),
        F.substring(why, 1, 500).alias("error_msg"), F.when(why.isNull(), F.col("risk_level")).alias("risk_level"),
    )
