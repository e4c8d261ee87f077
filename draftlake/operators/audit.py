"""Audit rules over bills: each is a projection of the row, so a whole audit is one stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import exprs as E
from draftlake.operators.network import has_cycle as has_cycle

COMMON = ("ticket_number", "ticket_type", "issue_date", "due_date", "amount_numeric", "drawer", "payee")
FIELDS = (
    "ticket_number", "ticket_type", "issue_date", "due_date", "amount_numeric", "amount_text", "currency", "drawer", "drawer_account",
    "drawer_bank", "acceptor", "payee", "drawee_bank", "endorsers", "maturity_days", "trade_purpose", "acceptance_clause", "special_remarks",
)
NUMBERS, LISTS = ("amount_numeric", "maturity_days"), ("endorsers",)


def filled(field: str) -> Column:
    if field in NUMBERS:
        return F.coalesce(E.present_number(field), F.lit(False))
    if field in LISTS:
        return F.coalesce(F.size(field) > 0, F.lit(False))
    return F.coalesce(E.present(field), F.lit(False))


def field_verdicts() -> Column:
    """An array of (field, compliant, severity) for the 18 fields."""
    note = F.coalesce(F.contains("ticket_type", F.lit("本票")), F.lit(False))
    out = []
    for f in FIELDS:
        required = F.lit(True) if f in COMMON else (~note if f in ("acceptor", "drawee_bank") else F.lit(False))
        severe = required & ~filled(f)
        warn = F.lit(f == "trade_purpose") & ~filled(f)
        level = F.when(severe, "SEVERE").when(warn, "WARNING").otherwise("INFO")
        out.append(F.struct(F.lit(f).alias("field"), (~severe & ~warn).alias("compliant"), level.alias("severity")))
    return F.array(*out)


def compliance_checks(bills: DataFrame) -> DataFrame:
    return bills.select("bill_id", F.explode(field_verdicts()).alias("v")).select("bill_id", "v.*")


def with_compliance(bills: DataFrame) -> DataFrame:
    """Counts and the rate over the 18 fields, without exploding them."""
    b = bills.withColumn("v", field_verdicts())
    n = lambda test: F.size(F.filter("v", test))
    b = b.withColumns({"violation_count": n(lambda x: ~x["compliant"]), "severe_count": n(lambda x: x["severity"] == "SEVERE")})
    rate = F.round((F.lit(len(FIELDS)) - F.col("violation_count")) / len(FIELDS), 3)
    return b.withColumns({"compliance_rate": rate, "is_compliant": F.col("severe_count") == 0}).drop("v")


def with_endorsement(bills: DataFrame) -> DataFrame:
    """Endorsement rules. A chain built from a bill has a cycle exactly if a party comes twice."""
    blank = lambda x: x.isNull() | (x == "")
    chain = F.filter(F.concat(F.array("drawer", "payee"), "endorsers"), lambda x: ~blank(x))
    b = bills.withColumn("chain", chain)
    twice = F.size(F.array_distinct("chain")) < F.size("chain")
    own = F.coalesce(F.exists("endorsers", lambda x: F.coalesce(x == F.col("drawer"), F.lit(False))), F.lit(False))
    # Beyond the end the second operand is null.
    same = F.zip_with("endorsers", F.slice("endorsers", F.lit(2), F.size("endorsers")), lambda x, y: F.coalesce((x == y) & ~blank(x), F.lit(False)))
    codes = F.array_compact(F.array(
        F.when(twice, "EN02"), F.when(twice, "EN03"), F.when(F.exists("endorsers", blank), "EN04"),
        F.when(F.size("endorsers") > 10, "EN06"), F.when(own, "EN07"), F.when(F.exists(same, lambda x: x), "EN09"),
    ))
    return b.withColumns({
        "endorser_count": F.size("endorsers"), "blank_count": F.size(F.filter("endorsers", blank)), "has_cycle": twice,
        "violation_codes": codes, "endorsement_violations": F.size(codes),
    })


def endorsement_edges(bills: DataFrame) -> DataFrame:
    """(bill_id, tenant_id, position, src, dst) between consecutive parties that are not blank."""
    chain = with_endorsement(bills).select("bill_id", "tenant_id", "chain")
    pairs = F.zip_with(F.slice("chain", 1, F.greatest(F.size("chain") - 1, F.lit(0))), F.slice("chain", F.lit(2), F.size("chain")), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return chain.select("bill_id", "tenant_id", F.posexplode(pairs).alias("position", "e")).select("bill_id", "tenant_id", "position", "e.src", "e.dst")


def with_fraud(endorsed: DataFrame) -> DataFrame:
    c = F.coalesce(F.col("confidence_score"), F.lit(0.95))
    seal = F.when(c >= 0.90, 0.02).when(c >= 0.75, 0.10).otherwise(0.30)
    tamper = F.round(F.greatest(F.lit(0.0), (F.lit(0.85) - c) * 2), 4)
    network = F.when(F.col("has_cycle"), 0.8).when(F.col("endorsement_violations") >= 3, 0.2).otherwise(0.0)
    listed = lambda x: F.coalesce(F.contains(F.upper(x), F.lit("BLACKLIST")), F.lit(False)).cast("int")
    black = F.least(F.lit(1.0), (listed("drawer") + listed("payee")) * 0.5)
    twice = F.startswith("ticket_number", F.lit("DUP-"))
    score = F.when(twice, 1.0).otherwise(F.round(F.least(F.lit(1.0), seal * 0.30 + tamper * 0.25 + network * 0.15 + black * 0.05), 4))
    b = endorsed.withColumn("fraud_score", score)
    level = F.when(F.col("fraud_score") >= 0.8, "fraud").when(F.col("fraud_score") >= 0.6, "high_risk").when(F.col("fraud_score") >= 0.3, "suspicious").otherwise("clean")
    return b.withColumn("fraud_level", level)


def contract_review(bills: DataFrame, contracts: DataFrame) -> DataFrame:
    """Bills with the match of their contract: 25 amount, 35 party, 20 date, 20 purpose; 50 without."""
    b = bills.join(contracts, "bill_id", "left")
    there = F.col("party").isNotNull()
    amount = F.coalesce(F.abs(F.col("amount_numeric") - F.col("contract_amount")) <= F.col("contract_amount") * 0.05, F.lit(True))
    holds = lambda x: F.coalesce(E.present(x) & (F.contains("party", x) | F.contains(x, "party")), F.lit(False))
    party = holds(F.col("drawer")) | holds(F.col("payee"))
    words = lambda x: F.split(F.regexp_replace(x, "[，。]", " "), " ")
    purpose = F.coalesce(F.arrays_overlap(words("trade_purpose"), words("contract_purpose")), F.lit(True))
    score = F.when(~there, 50.0).otherwise(amount.cast("int") * 25 + party.cast("int") * 35 + 20.0 + purpose.cast("int") * 20)
    base = F.when(~F.coalesce(E.present("trade_purpose"), F.lit(False)), 40.0).otherwise(
        F.least(F.lit(100.0), F.least(F.lit(70.0), F.length("trade_purpose") * 2.0) + F.when(there & purpose, 30.0).otherwise(0.0))
    )
    return b.withColumns({"has_contract": there, "amount_match": amount, "party_match": ~there | party, "purpose_match": purpose, "match_score": score.cast("double"), "trade_background_score": base})


def with_risk(b: DataFrame) -> DataFrame:
    """Weighted score of the four dimensions and its level; a dimension that is null has a default."""
    # greatest and least leave nulls out, so each dimension is asked for first.
    given = lambda c, score, default: F.when(F.col(c).isNotNull(), score).otherwise(F.lit(default))
    compliance = given("compliance_rate", F.greatest(F.lit(0.0), F.col("compliance_rate") * 100 - F.col("severe_count") * 15), 60.0)
    other = F.size(F.filter("violation_codes", lambda x: ~x.isin("EN01", "EN03")))
    endorsement = given("violation_codes", F.greatest(F.lit(0.0), F.lit(100.0) - F.when(F.col("has_cycle"), 50).otherwise(0) - other * 10), 70.0)
    contract = F.coalesce(F.col("match_score"), F.lit(50.0))
    fraud = given("fraud_score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.lit(1.0) - F.col("fraud_score")) * 100)), 80.0)
    b = b.withColumns({"s_compliance": compliance, "s_endorsement": endorsement, "s_contract": contract, "s_fraud": fraud})
    total = F.round(F.col("s_compliance") * 0.3 + F.col("s_endorsement") * 0.3 + F.col("s_contract") * 0.2 + F.col("s_fraud") * 0.2, 2)
    b = b.withColumn("risk_score", total)
    s = F.col("risk_score")
    return b.withColumn("risk_level", F.when(s >= 85, "LOW").when(s >= 70, "MEDIUM_LOW").when(s >= 50, "MEDIUM_HIGH").when(s >= 30, "HIGH").otherwise("CRITICAL"))


def audit(bills: DataFrame, contracts: DataFrame) -> DataFrame:
    """All dimensions of every bill on one row."""
    return with_risk(with_fraud(with_endorsement(with_compliance(contract_review(bills, contracts)))))


def risk_flags(bills: DataFrame) -> DataFrame:
    """(bill_id, flags): contradictions between a bill's fields, as (level, code)."""
    issue, due = E.as_date("issue_date"), E.as_date("due_date")
    flag = lambda test, level, code: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))
    amount = F.col("amount_numeric")
    mismatch = E.present_number("amount_numeric") & F.when(F.contains("amount_text", F.lit("百万")) & (amount < 1e6), True).otherwise(F.contains("amount_text", F.lit("千万")) & (amount < 1e7))
    flags = F.array_compact(F.array(
        flag(due <= issue, "severe", "DATE_LOGIC_ERROR"),
        flag(F.contains("ticket_type", F.lit("银行承兑")) & E.present("acceptor") & ~E.bank_name("acceptor"), "severe", "ACCEPTOR_NOT_BANK"),
        flag(mismatch, "severe", "AMOUNT_MISMATCH"),
        flag(F.datediff(due, issue) > 366, "warning", "TENOR_TOO_LONG"),
    ))
    return bills.withColumn("flags", flags)


def issuance_precheck(bills: DataFrame) -> DataFrame:
    """(bill_id, failures, eligible)."""
    needed = ("ticket_number", "issue_date", "due_date", "amount_numeric", "drawer", "acceptor", "payee", "drawee_bank")
    listed = lambda x: F.coalesce(F.contains(F.upper(x), F.lit("BLACKLIST")), F.lit(False))
    tests = [F.when(~filled(f), f"missing:{f}") for f in needed]
    a = F.col("amount_numeric")
    tests += [F.when(filled("amount_numeric") & (a < 10_000), "amount_low"), F.when(a > 500_000_000, "amount_high"), F.when(F.col("maturity_days") > 365, "tenor"),
              F.when(listed("drawer") | listed("acceptor") | listed("payee"), "blacklist")]
    failures = F.array_compact(F.array(*tests))
    return bills.select("bill_id", F.array_join(failures, ",").alias("failures"), (F.size(failures) == 0).alias("eligible"), (a > 100_000_000).alias("over_credit_limit"))


def screen_blacklist(bills: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Parties on an active list that is global or the bill's tenant's: (bill_id, name), once each.

    The list stays whatever size it is: Spark broadcasts it only below its own threshold.
    """
    parties = F.array_distinct(F.filter(F.concat(F.array("drawer", "acceptor", "payee"), "endorsers"), lambda x: x.isNotNull() & (x != "")))
    each = bills.select("bill_id", "tenant_id", F.explode(parties).alias("name")).withColumn("plain", F.lower(F.trim("name")))
    names = blacklist.where("is_active").select(F.lower(F.trim("entity_name")).alias("plain"), "is_global", "list_tenant")
    hit = each.join(names, "plain").where(F.col("is_global") | (F.col("list_tenant") == F.col("tenant_id")))
    return hit.select("bill_id", "name").distinct()


def duplicate_bills(bills: DataFrame, fingerprint: Column) -> DataFrame:
    """Bills whose tenant had the same ticket before with another fingerprint."""
    w = Window.partitionBy("tenant_id", "ticket_number").orderBy("created_at", "bill_id")
    seen = bills.withColumn("f", fingerprint).withColumn("first_f", F.first("f").over(w))
    return seen.where(F.col("f") != F.col("first_f")).select("bill_id", "tenant_id", "ticket_number")


#: Steps of a message flow.
FLOW_STEPS = 7


def flow_status(messages: DataFrame) -> DataFrame:
    """The state of each flow: steps up to and with the first anomaly, its level by time spent.

    A flow has ``FLOW_STEPS`` steps; messages of later ones are not its own."""
    w = Window.partitionBy("flow_task_id")
    m = messages.where(F.col("step_index") <= FLOW_STEPS).withColumn("stop", F.min(F.when(F.col("is_anomaly"), F.col("step_index"))).over(w))
    m = m.where(F.col("stop").isNull() | (F.col("step_index") <= F.col("stop")))
    g = m.groupBy("flow_task_id").agg(F.max("step_index").alias("current_step"), F.sum("processing_ms").alias("elapsed_ms"), F.max(F.when(F.col("is_anomaly"), F.col("status"))).alias("bad"))
    t = F.col("elapsed_ms")
    level = F.when(t >= 300_000, "OVERDUE").when(t >= 120_000, "URGENT").when(t >= 60_000, "WARNING").when(t >= 30_000, "WATCH").otherwise("NORMAL")
    return g.select("flow_task_id", "current_step", "elapsed_ms", F.coalesce("bad", F.lit("completed")).alias("status"), level.alias("timeout_level"))


# Decisions and replies by level of risk.
DECISIONS = {"LOW": "审核通过", "MEDIUM_LOW": "有条件通过", "MEDIUM_HIGH": "需人工审核", "HIGH": "建议拒绝", "CRITICAL": "强制拒绝"}
REPLIES = {"LOW": "可执行", "MEDIUM_LOW": "可执行（需关注）", "HIGH": "不可执行", "CRITICAL": "不可执行"}


def looked_up(c: str, values: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def audit_report(audited: DataFrame) -> DataFrame:
    """Decision, reply and advice of every audited bill."""
    advice = F.array_compact(F.array(
        F.when(F.col("severe_count") > 0, "fix_severe"), F.when(F.col("violation_count") > 0, "check_fields"),
        F.when(F.col("has_cycle"), "report_cycle"), F.when(~F.col("has_contract"), "bring_contract"),
    ))
    return audited.select(
        "bill_id", "risk_level", looked_up("risk_level", DECISIONS, "待定").alias("decision"), looked_up("risk_level", REPLIES, "需关注").alias("reply"),
        F.when(F.size(advice) == 0, "proceed").otherwise(F.array_join(advice, ",")).alias("advice"),
    )
