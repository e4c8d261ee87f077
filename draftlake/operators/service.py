"""What the service's pages show: visibility, tenant rows, histories, limits, issues and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.operators import audit as A
from draftlake.operators.keywords import SENT
from draftlake.operators.stats import histogram, numbered
from draftlake.session import shared_folder


def visible(df: DataFrame, tenant: Column | None, status: str | None = None) -> DataFrame:
    """Rows of one tenant, or all rows for ``None`` (a super admin); of one status if it is given."""
    if tenant is not None:
        df = df.where(F.col("tenant_id") == tenant)
    return df if status is None else df.where(F.col("status") == status)


def on_day(day: str, at: str = "created_at") -> Column:
    return F.coalesce(F.to_date(at) == F.lit(day).cast("date"), F.lit(False))


def quota_use(docs: DataFrame, tenants: DataFrame) -> DataFrame:
    """Each document's number within its tenant, and whether the tenant's quota takes it."""
    n = numbered(docs, "tenant_id", "doc_id").join(tenants.select("tenant_id", "doc_quota"), "tenant_id", "left")
    return n.select("doc_id", "tenant_id", "number", F.coalesce(F.col("number") <= F.col("doc_quota"), F.lit(False)).alias("accepted"))


def tenant_statistics(tenants: DataFrame, docs: DataFrame, logs: DataFrame, day: str) -> DataFrame:
    """A row for each tenant, the newest first by ``position``. Both sides are counted before they are
    joined; the mean is over known latencies, whatever the hits were."""
    n = lambda s: F.count_if(F.col("status") == s)
    d = docs.groupBy("tenant_id").agg(F.count("*").alias("documents"), n("completed").alias("completed"), n("failed").alias("failed"), F.sum("chunk_count").alias("chunks"))
    q = logs.groupBy("tenant_id").agg(F.count("*").alias("queries"), F.count_if(on_day(day)).alias("queries_today"), F.round(F.avg("total_ms"), 4).alias("mean_ms"))
    both = tenants.join(d, "tenant_id", "left").join(q, "tenant_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    used = F.when(F.col("doc_quota") > 0, F.round(F.coalesce("documents", F.lit(0)) * 100 / F.col("doc_quota"), 1)).otherwise(0.0)
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), "tenant_id"))  # tenants are few
    return both.select("tenant_id", *map(zero, ("documents", "completed", "failed", "chunks", "queries", "queries_today")), "mean_ms", used.alias("quota_pct"), place.alias("position"))


def rate_limits(requests: DataFrame, tenants: DataFrame, seconds: int) -> DataFrame:
    """Requests with what their tenant's window, ``seconds`` long, has left, and when it eases.

    A tenant's requests are counted by hours of ``seconds`` each: a window reaches over two of them,
    so every request visits its own hour and the next one, and no tenant is one task.
    """
    t = F.unix_micros(F.col("created_at").cast("timestamp"))
    span = seconds * 1_000_000
    each = requests.select("id", "tenant_id", t.alias("t"), F.floor(t / span).alias("hour"))
    sent = each.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("hour", F.col("hour") + F.col("turn"))
    w = Window.partitionBy("tenant_id", "hour").orderBy("t").rangeBetween(-span, 0)
    own = sent.withColumns({"in_window": F.count("*").over(w), "oldest": F.min("t").over(w)}).where("turn = 0")
    limit = (F.col("qps_limit") * seconds).cast("long")
    j = own.join(F.broadcast(tenants.select("tenant_id", "qps_limit")), "tenant_id", "left")
    return j.select(
        "id", "tenant_id", "in_window", limit.alias("request_limit"), F.greatest(F.lit(0), limit - F.col("in_window")).alias("remaining"),
        (F.col("oldest") + span - F.col("t")).alias("reset_in_us"),
    )


def with_metadata(hits: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Hits with their chunks' columns; hits whose chunk is gone are dropped.

    Hits of at most ``SENT`` bytes are sent to the chunks, so that these, with their texts, are joined
    where they are read and only those that are hit are shuffled after.
    """
    shared_folder(hits.sparkSession)
    hits = hits.checkpoint()
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) if kind == "string" else F.lit(8) for c, kind in hits.dtypes), F.lit(32))
    few = (hits.agg(F.sum(size)).first()[0] or 0) <= SENT
    return (F.broadcast(hits) if few else hits).join(chunks.select("tenant_id", "chunk_id", *columns), ["tenant_id", "chunk_id"])


def histories(versions: DataFrame) -> DataFrame:
    """Bills with their versions in order: (tenant_id, ticket_number, n_versions, versions)."""
    entry = F.struct("version", F.size("endorsers").alias("endorsers"), F.size("new_endorsers").alias("added"))
    return versions.groupBy("tenant_id", "ticket_number").agg(F.count("*").alias("n_versions"), F.array_sort(F.collect_list(entry)).alias("versions"))


def named_tickets(uploads: DataFrame) -> DataFrame:
    """Uploads whose blank ticket numbers are replaced by one of their own."""
    blank = F.coalesce(F.trim("ticket_number") == "", F.lit(True))
    return uploads.withColumn("ticket_number", F.when(blank, F.concat(F.lit("UNKNOWN-"), F.col("bill_id"))).otherwise(F.col("ticket_number")))


def flag_history(flagged: DataFrame) -> DataFrame:
    """(tenant_id, ticket_number, codes): flags over all uploads of a bill, each code once, in the
    order in which the uploads brought them."""
    each = flagged.select("tenant_id", "ticket_number", "upload_time", "bill_id", F.posexplode("flags").alias("place", "flag"))
    first = each.groupBy("tenant_id", "ticket_number", F.col("flag.code").alias("code")).agg(F.min(F.struct("upload_time", "bill_id", "place")).alias("at"))
    codes = F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"])
    return first.groupBy("tenant_id", "ticket_number").agg(codes.alias("codes"))


def with_missing(dimensions: DataFrame) -> DataFrame:
    """Rows of the audit's four dimensions with the names of those that are absent."""
    absent = {"compliance": "compliance_rate", "endorsement": "violation_codes", "contract": "match_score", "fraud": "fraud_score"}
    return dimensions.withColumn("missing", F.array_compact(F.array(*(F.when(F.col(c).isNull(), name) for name, c in absent.items()))))


def visible_flows(flows: DataFrame, tasks: DataFrame, tenant: Column) -> DataFrame:
    """Flows of one tenant's audit tasks, and those without a task."""
    j = flows.join(tasks.select(F.col("audit_id").alias("flow_task_id"), "tenant_id"), "flow_task_id", "left")
    return j.where(F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant))


def audit_issues(bills: DataFrame) -> DataFrame:
    """Issues of audited bills (bill_id, endorsement codes, fraud score): violated fields, then
    endorsement codes, then fraud, as (field, level) in that order; their counts; the answer."""
    issue = lambda field, level: F.struct(field.alias("field"), level.alias("level"))
    broken = F.filter(A.field_verdicts(), lambda x: x["severity"] != "INFO")
    fields = F.transform(broken, lambda x: issue(x["field"], F.when(x["severity"] == "SEVERE", "error").otherwise("warning")))
    chain = F.transform("violation_codes", lambda c: issue(F.concat(F.lit("endorsers:"), c), F.lit("error")))
    level = F.when(F.col("fraud_score") >= 0.8, "error").otherwise("warning")
    fraud = F.when(F.col("fraud_score") >= 0.6, F.array(issue(F.lit("fraud_detection"), level))).otherwise(F.array().cast("array<struct<field:string,level:string>>"))
    b = bills.withColumn("issues", F.concat(fields, chain, fraud))
    n = lambda x: F.size(F.filter("issues", lambda i: i["level"] == x))
    told = F.array_join(F.transform("issues", lambda i: F.concat_ws("/", i["field"], i["level"])), ",")
    answer = A.looked_up("risk_level", {**A.REPLIES, "UNKNOWN": "审核中"}, "需关注")
    return b.select("bill_id", told.alias("issues"), n("error").alias("n_errors"), n("warning").alias("n_warnings"), answer.alias("conclusion"))


def report_sections(audited: DataFrame) -> DataFrame:
    """(bill_id, section, body): the nine sections of each bill's report, body as JSON."""
    parts = {
        "summary": ("risk_score", "risk_level"), "elements": A.FIELDS, "compliance": ("violation_count", "severe_count", "compliance_rate", "is_compliant"),
        "endorsement": ("endorser_count", "has_cycle", "violation_codes"), "contract": ("match_score", "trade_background_score", "amount_match", "party_match"),
        "risk": ("s_compliance", "s_endorsement", "s_contract", "s_fraud"), "fraud": ("fraud_score", "fraud_level"), "flow": ("flow_status", "current_step"),
    }
    told = [F.struct(F.lit(name).alias("section"), F.to_json(F.struct(*columns)).alias("body")) for name, columns in parts.items()]
    decided = F.to_json(F.struct(A.looked_up("risk_level", A.DECISIONS, "待定").alias("decision"), A.looked_up("risk_level", A.REPLIES, "需关注").alias("reply")))
    told.append(F.struct(F.lit("conclusion").alias("section"), decided.alias("body")))
    return audited.select("bill_id", F.explode(F.array(*told)).alias("s")).select("bill_id", "s.*")


def chain_nodes(bills: DataFrame) -> DataFrame:
    """Parties of each bill's chain once each, at their first place, the drawer marked."""
    chain = A.with_endorsement(bills).select("bill_id", "drawer", F.posexplode("chain").alias("position", "party"))
    return chain.groupBy("bill_id", "party").agg(F.min("position").alias("position"), F.bool_or(F.col("party") == F.col("drawer")).alias("is_drawer"))


def counters(logs: DataFrame, *by: str) -> DataFrame:
    """Requests by status, and the share of errors among all of the group's."""
    g = logs.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if(F.col("status") == "error").alias("errors"))
    return g.withColumn("error_share", F.round(F.col("errors") / F.col("requests"), 6))


def metric_rows(logs: DataFrame, by: str) -> DataFrame:
    """Counters, a gauge and a histogram's sum as rows (metric, label, value)."""
    g = logs.groupBy(by).agg(F.count("*").alias("requests_total"), F.count_if(F.col("status") == "error").alias("errors_total"), F.round(F.sum("total_ms"), 4).alias("latency_ms_sum"), F.round(F.max("total_ms"), 4).alias("latency_ms_max"))
    names = ("requests_total", "errors_total", "latency_ms_sum", "latency_ms_max")
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))
    return g.select(F.col(by).cast("string").alias("label"), F.explode(rows).alias("r")).select("label", "r.*")


def exposition(logs: DataFrame, value: str, by: str) -> DataFrame:
    """(metric, label, le, value): counters, and the histogram of ``value`` as buckets that hold all up
    to their bound, the last one without a bound."""
    h = histogram(logs, value, by)
    buckets = h.select(F.lit(f"{value}_bucket").alias("metric"), F.col(by).cast("string").alias("label"), F.col("le").cast("long").cast("string").alias("le"), F.col("cumulative").cast("double").alias("value"))
    all_of = h.select(F.col(by).cast("string").alias("label"), F.col("n").cast("double").alias("value")).distinct()
    rows = [(f"{value}_bucket", "+Inf"), (f"{value}_count", None)]
    ends = [all_of.select(F.lit(m).alias("metric"), "label", F.lit(le).cast("string").alias("le"), "value") for m, le in rows]
    counters = metric_rows(logs, by).select("metric", "label", F.lit(None).cast("string").alias("le"), "value")
    return buckets.unionByName(ends[0]).unionByName(ends[1]).unionByName(counters)


def miss_backlog(misses: DataFrame) -> DataFrame:
    """Searches without a good hit by intent: how many, and how near their best hit was."""
    g = misses.groupBy("intent_id").agg(F.count("*").alias("misses"), F.round(F.avg("top1"), 6).alias("mean_top1"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("misses"), "intent_id")))  # intents are few


def table_confidence(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, ...): confidence of tables given as cells (doc_id, table_id, row, value,
    accuracy): accuracy less half the share of empty cells, less 0.15 for a slash in the first row,
    between 0 and 1; an absent accuracy is 0.5."""
    first = Window.partitionBy("doc_id", "table_id")
    c = cells.withColumn("top", F.col("row") == F.min("row").over(first))
    empty = F.count_if(F.coalesce(F.col("value") == "", F.lit(True)))
    slash = F.bool_or(F.col("top") & F.contains("value", F.lit("/")))
    g = c.groupBy("doc_id", "table_id").agg(F.count("*").alias("cells"), empty.alias("empty"), F.coalesce(slash, F.lit(False)).alias("slash"), F.coalesce(F.max("accuracy"), F.lit(0.5)).alias("accuracy"))
    score = F.col("accuracy") * (1 - 0.5 * F.col("empty") / F.col("cells")) - F.when(F.col("slash"), 0.15).otherwise(0.0)
    return g.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))


def table_choice(tables: DataFrame) -> DataFrame:
    """Per document its best table and its largest, the way it was taken from, and whether it counts
    as a table."""
    best, big = F.max_by("table_id", F.struct("confidence", -F.col("table_id"))), F.max_by("table_id", F.struct("cells", -F.col("table_id")))
    g = tables.groupBy("doc_id").agg(F.max("confidence").alias("confidence"), best.alias("best_table"), big.alias("largest_table"))
    way = F.when(F.col("confidence") >= 0.8, "lattice").when(F.col("confidence") >= 0.6, "stream").when(F.col("confidence") > 0, "fallback").otherwise("none")
    stated = F.when(way == "fallback", 0.65).otherwise(F.col("confidence"))
    return g.select("doc_id", "best_table", "largest_table", way.alias("method"), (stated >= 0.8).alias("is_table"))


def cleaned_weights(weights: Column) -> Column:
    """A sparse vector (map<string,double>) without weights of 0 or less, its tokens as 20-bit ids;
    one tiny weight at 0 for an empty one. Tokens that share an id keep the greater weight."""
    kept = F.map_entries(F.map_filter(weights, lambda _, v: v > 0))
    number = lambda k: F.coalesce(k.try_cast("int"), F.xxhash64(k).bitwiseAND(0xFFFFF).cast("int"))
    pairs = F.transform(kept, lambda e: F.struct(number(e["key"]).alias("id"), e["value"].alias("w")))
    last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda o: (o["id"] == p["id"]) & (o["w"] > p["w"])))
    return F.when(F.size(last) == 0, F.map_from_arrays(F.array(F.lit(0)), F.array(F.lit(1e-9)))).otherwise(
        F.map_from_entries(F.array_distinct(last))
    )


def context_blocks(hits: DataFrame) -> DataFrame:
    """(query_id, context, sources): the hits of each query in order, as numbered blocks of text, and
    the chunks that they are from. The words around them are fixed values."""
    section = F.when(F.coalesce("section_path", F.lit("")) != "", F.concat(F.lit("["), "section_path", F.lit("] "))).otherwise("")
    page = F.coalesce(F.col("page_num").cast("string"), F.lit("?"))
    block = F.concat(F.lit("**参考文档 "), F.col("rank"), F.lit("** "), section, F.lit("(第"), page, F.lit("页)\n"), "content")
    entries = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"), "chunk_id")))
    g = hits.groupBy("query_id").agg(entries.alias("e"))
    return g.select("query_id", F.array_join(F.transform("e", lambda x: x["block"]), "\n\n").alias("context"), F.array_join(F.transform("e", lambda x: x["chunk_id"].cast("string")), ",").alias("sources"))


def endorser_text(ticket: str = "ticket_number") -> Column:
    """A version's new endorsers as a sentence for the index. Its words are fixed values."""
    some = lambda c: F.when(F.size(c) > 0, F.array_join(c, "、")).otherwise("无")
    day = F.date_format("upload_time", "yyyy-MM-dd")
    return F.concat(
        F.lit("票据号码 "), F.col(ticket), F.lit(" 第"), F.col("version"), F.lit("次流转背书（"), day, F.lit("），新增背书人："), some("new_endorsers"),
        F.lit("，当前完整背书链：["), some("endorsers"), F.lit("]"),
    )


def maturity_days(due: Column, as_of: Column) -> Column:
    """Whole days from ``as_of`` to a date written as yyyy-MM-dd and nothing else; 0 for the rest."""
    whole = F.when(F.regexp_like(due, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(due, "yyyy-MM-dd"))
    seconds = F.unix_seconds(whole.cast("timestamp")) - F.unix_seconds(as_of)
    return F.coalesce(F.floor(seconds / 86_400), F.lit(0))


def bill_json(text: Column, schema: str = "amount double, currency string, drawer string") -> Column:
    """The record in a text's JSON block, with is_bill_found and a default currency."""
    r = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    some = F.coalesce(r["drawer"].isNotNull() | r["amount"].isNotNull(), F.lit(False))
    return F.struct(r["amount"].alias("amount"), F.coalesce(r["currency"], F.lit("人民币")).alias("currency"), r["drawer"].alias("drawer"), some.alias("is_bill_found"))
