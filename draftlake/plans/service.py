"""Queries of the service's pages, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftlake.functions import exprs as E
from draftlake.operators import audit as A
from draftlake.operators import lifecycle as L
from draftlake.operators import service as V
from draftlake.operators import stats as S
from draftlake.plans.queries import AUDITED, BILLS, CORPUS, LOGS, SEARCH, UPLOADS, _audit, _bm25, _chunk_table, query
from draftlake.sources import domain as D

DAY = "2024-01-05"


# ---- visibility and pages ---------------------------------------------------------------------


@query(f"WITH {CORPUS} SELECT doc_id, tenant_id, status FROM corpus WHERE tenant_id = 'src1'")
def visible_documents(spark, d):
    return V.visible(D.corpus(spark, d), F.lit("src1")).select("doc_id", "tenant_id", "status")


@query(f"WITH {CORPUS} SELECT doc_id, tenant_id, status FROM corpus WHERE status = 'failed'")
def failed_documents(spark, d):
    """What a super admin sees of the failed documents."""
    return V.visible(D.corpus(spark, d), None, "failed").select("doc_id", "tenant_id", "status")


@query(f"WITH {LOGS} SELECT id, tenant_id FROM logs WHERE CAST(created_at AS DATE) = DATE '{DAY}'")
def todays_logs(spark, d):
    return D.query_logs(spark, d).where(V.on_day(DAY)).select("id", "tenant_id")


@query(f"WITH {CORPUS} SELECT doc_id, tenant_id FROM corpus ORDER BY doc_id DESC LIMIT 20 OFFSET 20")
def document_page(spark, d):
    return S.page(D.corpus(spark, d), 2, 20, F.desc("doc_id")).select("doc_id", "tenant_id")


@query(f"WITH {CORPUS} SELECT doc_id, substr(text, 1, 200) AS preview, CASE WHEN n_chars % 5 = 0 THEN 0 ELSE CAST(chunk_count AS INTEGER) END AS chunks FROM corpus")
def document_rows(spark, d):
    ids = F.to_json(F.when(F.col("n_chars") % 5 != 0, F.when(F.col("chunk_count") > 0, F.sequence(F.lit(1), F.col("chunk_count").cast("int"))).otherwise(F.array().cast("array<int>"))))
    c = D.corpus(spark, d).withColumn("chunk_ids", ids)
    return c.select("doc_id", F.substring("text", 1, 200).alias("preview"), F.coalesce(F.size(F.from_json("chunk_ids", "array<int>")), F.lit(0)).alias("chunks"))


@query(
    """SELECT n_nationkey AS tenant_id, concat_ws(',', CASE WHEN n_nationkey % 7 NOT BETWEEN 1 AND 5 THEN 'score' END, CASE WHEN length(n_name) NOT BETWEEN 6 AND 2000 THEN 'query' END,
  CASE WHEN n_nationkey * 4 NOT BETWEEN 1 AND 50 THEN 'top_k' END, CASE WHEN n_nationkey * 20 NOT BETWEEN 1 AND 200 THEN 'qps' END, CASE WHEN n_nationkey * 30 < 100 THEN 'quota' END) AS broken FROM nation"""
)
def tenant_checks(spark, d):
    from draftlake.operators import reuse as U

    n, key = D.table(spark, d, "nation"), F.col("n_nationkey")
    rows = n.select(key.alias("tenant_id"), (key % 7).alias("feedback_score"), F.col("n_name").alias("query"), (key * 4).alias("top_k"), (key * 20).alias("qps_limit"), (key * 30).alias("doc_quota"))
    rules = {**U.request_rules(), "query": F.length("query").between(6, 2000), **U.tenant_rules()}
    return U.broken_rules(rows, rules).select("tenant_id", F.array_join("broken", ",").alias("broken"))


# ---- tenants, limits and counters -------------------------------------------------------------

TENANT_DOCS = """
tenant_docs AS (SELECT o_orderkey AS doc_id, o_custkey % 25 AS tenant_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'processing' END AS status, o_orderkey % 7 AS chunk_count FROM orders)"""


def _tenant_docs(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("processing")
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 25).alias("tenant_id"), status.alias("status"), (F.col("o_orderkey") % 7).alias("chunk_count"))


@query(
    f"""WITH {LOGS}, {TENANT_DOCS},
dd AS (SELECT tenant_id, count(*) AS documents, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM tenant_docs GROUP BY 1),
q AS (SELECT tenant_id, count(*) AS queries, count(*) FILTER (CAST(created_at AS DATE) = DATE '{DAY}') AS queries_today, round(avg(total_ms), 4) AS mean_ms FROM logs GROUP BY 1)
SELECT n_nationkey AS tenant_id, coalesce(documents, 0) AS documents, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, coalesce(chunks, 0) AS chunks, coalesce(queries, 0) AS queries,
  coalesce(queries_today, 0) AS queries_today, mean_ms, round(coalesce(documents, 0) * 100 / (100 + 10 * n_nationkey)::DOUBLE, 1) AS quota_pct,
  CAST(row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey) AS INTEGER) AS position
FROM nation LEFT JOIN dd ON dd.tenant_id = n_nationkey LEFT JOIN q ON q.tenant_id = n_nationkey"""
)
def tenant_statistics(spark, d):
    n = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("tenant_id"), (100 + 10 * F.col("n_nationkey")).alias("doc_quota"), F.col("n_regionkey").alias("created_at"))
    return V.tenant_statistics(n, _tenant_docs(spark, d), D.query_logs(spark, d), DAY)


@query(f"WITH {TENANT_DOCS} SELECT doc_id, tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY doc_id) AS number, row_number() OVER (PARTITION BY tenant_id ORDER BY doc_id) <= 100 + 10 * tenant_id AS accepted FROM tenant_docs")
def quota_use(spark, d):
    return V.quota_use(_tenant_docs(spark, d), D.tenants(spark, d))


@query(
    f"""WITH {LOGS}, w AS (SELECT id, tenant_id, created_at, count(*) OVER x AS in_window, min(created_at) OVER x AS oldest FROM logs
  WINDOW x AS (PARTITION BY tenant_id ORDER BY created_at RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW))
SELECT id, tenant_id, in_window, CAST((1 + tenant_id % 5) * 60 AS BIGINT) AS request_limit, CAST(greatest(0, (1 + tenant_id % 5) * 60 - in_window) AS BIGINT) AS remaining,
  epoch_us(oldest) + 60000000 - epoch_us(created_at) AS reset_in_us FROM w"""
)
def rate_limits(spark, d):
    return V.rate_limits(D.query_logs(spark, d), D.tenants(spark, d), 60)


STATES = f"""{LOGS}, states AS (SELECT *, CASE WHEN route_type = 'off_topic' THEN 'error' ELSE 'ok' END AS status FROM logs)"""


def _states(spark, d):
    return D.query_logs(spark, d).withColumn("status", F.when(F.coalesce(F.col("route_type") == "off_topic", F.lit(False)), "error").otherwise("ok"))


@query(f"WITH {STATES} SELECT tenant_id, count(*) AS requests, count(*) FILTER (status = 'error') AS errors, round(count(*) FILTER (status = 'error') / count(*)::DOUBLE, 6) AS error_share FROM states GROUP BY 1")
def request_counters(spark, d):
    return V.counters(_states(spark, d), "tenant_id")


@query(
    f"""WITH {STATES}, g AS (SELECT tenant_id, count(*)::DOUBLE AS a, (count(*) FILTER (status = 'error'))::DOUBLE AS b, round(sum(total_ms), 4) AS c, round(max(total_ms), 4) AS e FROM states GROUP BY 1)
SELECT CAST(tenant_id AS VARCHAR) AS label, unnest(['requests_total', 'errors_total', 'latency_ms_sum', 'latency_ms_max']) AS metric, round(unnest([a, b, c, e]), 4) AS value FROM g"""
)
def metric_rows(spark, d):
    return V.metric_rows(_states(spark, d), "tenant_id")


@query(
    f"""WITH {STATES}, bounds(le) AS (VALUES {", ".join(f"({b})" for b in S.BUCKETS)}), g AS (SELECT tenant_id, count(*)::DOUBLE AS a, (count(*) FILTER (status = 'error'))::DOUBLE AS b, round(sum(total_ms), 4) AS c, round(max(total_ms), 4) AS e, count(total_ms)::DOUBLE AS n FROM states GROUP BY 1)
SELECT 'total_ms_bucket' AS metric, CAST(tenant_id AS VARCHAR) AS label, CAST(le AS VARCHAR) AS le, (count(*) FILTER (total_ms <= le))::DOUBLE AS value FROM states, bounds GROUP BY tenant_id, le
UNION ALL SELECT unnest(['total_ms_bucket', 'total_ms_count', 'requests_total', 'errors_total', 'latency_ms_sum', 'latency_ms_max']), CAST(tenant_id AS VARCHAR), unnest(['+Inf', NULL, NULL, NULL, NULL, NULL]), round(unnest([n, n, a, b, c, e]), 4) FROM g"""
)
def metric_exposition(spark, d):
    return V.exposition(_states(spark, d), "total_ms", "tenant_id")


@query(f"WITH {CORPUS} SELECT tenant_id, status, count(*) AS documents FROM corpus GROUP BY ALL")
def ingest_counters(spark, d):
    return D.corpus(spark, d).groupBy("tenant_id", "status").agg(F.count("*").alias("documents"))


# ---- bills ------------------------------------------------------------------------------------


@query(
    f"""WITH {AUDITED}, f AS (SELECT bill_id, violation_count, severe_count, compliance_rate, list_filter([CASE WHEN issue_date IS NULL THEN 'issue_date/SEVERE' END, CASE WHEN due_date IS NULL THEN 'due_date/SEVERE' END,
  CASE WHEN coalesce(amount_numeric, 0) = 0 THEN 'amount_numeric/SEVERE' END, CASE WHEN coalesce(drawer, '') = '' THEN 'drawer/SEVERE' END, CASE WHEN NOT note AND coalesce(acceptor, '') = '' THEN 'acceptor/SEVERE' END,
  CASE WHEN coalesce(payee, '') = '' THEN 'payee/SEVERE' END, CASE WHEN NOT note AND coalesce(acceptor, '') = '' THEN 'drawee_bank/SEVERE' END, CASE WHEN coalesce(trade_purpose, '') = '' THEN 'trade_purpose/WARNING' END], lambda x: x IS NOT NULL) AS v FROM checked_all)
SELECT bill_id, 18 AS total_fields, violation_count, severe_count, compliance_rate, severe_count = 0 AS is_compliant, array_to_string(v, ',') AS violations FROM f""".replace("checked_all", "endorsed")
)
def compliance_report(spark, d):
    broken = F.filter(A.field_verdicts(), lambda x: x["severity"] != "INFO")
    told = F.array_join(F.transform(broken, lambda x: F.concat_ws("/", x["field"], x["severity"])), ",")
    b = A.with_compliance(D.bills(spark, d))
    return b.select("bill_id", F.lit(18).alias("total_fields"), "violation_count", "severe_count", "compliance_rate", "is_compliant", told.alias("violations"))


@query(f"WITH {BILLS}, r AS (SELECT unnest({list(A.FIELDS)!r}) AS field) SELECT bill_id, field, field || ' 是否合规' AS question, 'R-' || field AS regulation FROM bills, r")
def compliance_rules(spark, d):
    """Every bill with every field's rule: the rule table, 18 rows, goes to all tasks."""
    rules = spark.createDataFrame([(f, f"{f} 是否合规", f"R-{f}") for f in A.FIELDS], "field string, question string, regulation string")
    return A.compliance_checks(D.bills(spark, d)).join(F.broadcast(rules), "field").select("bill_id", "field", "question", "regulation")


@query(
    f"""WITH {AUDITED}, i AS (SELECT bill_id, risk_level, [x FOR x IN [CASE WHEN issue_date IS NULL THEN 'issue_date/error' END, CASE WHEN due_date IS NULL THEN 'due_date/error' END,
  CASE WHEN coalesce(amount_numeric, 0) = 0 THEN 'amount_numeric/error' END, CASE WHEN coalesce(drawer, '') = '' THEN 'drawer/error' END, CASE WHEN NOT note AND coalesce(acceptor, '') = '' THEN 'acceptor/error' END,
  CASE WHEN coalesce(payee, '') = '' THEN 'payee/error' END, CASE WHEN NOT note AND coalesce(acceptor, '') = '' THEN 'drawee_bank/error' END, CASE WHEN coalesce(trade_purpose, '') = '' THEN 'trade_purpose/warning' END] IF x IS NOT NULL]
  || list_transform(codes, lambda c: 'endorsers:' || c || '/error') || CASE WHEN fraud_score >= 0.8 THEN ['fraud_detection/error'] WHEN fraud_score >= 0.6 THEN ['fraud_detection/warning'] ELSE [] END AS v FROM levelled)
SELECT bill_id, array_to_string(v, ',') AS issues, CAST(len(list_filter(v, lambda x: x LIKE '%/error')) AS INTEGER) AS n_errors, CAST(len(list_filter(v, lambda x: x LIKE '%/warning')) AS INTEGER) AS n_warnings,
  CASE risk_level WHEN 'LOW' THEN '可执行' WHEN 'MEDIUM_LOW' THEN '可执行（需关注）' WHEN 'HIGH' THEN '不可执行' WHEN 'CRITICAL' THEN '不可执行' ELSE '需关注' END AS conclusion FROM i"""
)
def audit_issues(spark, d):
    return V.audit_issues(_audit(spark, d))


_TEXT = "CAST(CAST({} AS DECIMAL(20, 2)) AS VARCHAR)"


@query(
    f"""WITH {AUDITED}, s AS (SELECT *, severe_count = 0 AS ok FROM levelled)
SELECT bill_id, count(*) AS sections, string_agg(section, ',' ORDER BY section) AS names, max(CASE WHEN section = 'conclusion' THEN body END) AS conclusion FROM (
  SELECT bill_id, unnest(['summary', 'elements', 'compliance', 'endorsement', 'contract', 'risk', 'fraud', 'flow', 'conclusion']) AS section,
    '{{"decision":"' || CASE risk_level WHEN 'LOW' THEN '审核通过' WHEN 'MEDIUM_LOW' THEN '有条件通过' WHEN 'MEDIUM_HIGH' THEN '需人工审核' WHEN 'HIGH' THEN '建议拒绝' ELSE '强制拒绝' END || '","reply":"'
    || CASE risk_level WHEN 'LOW' THEN '可执行' WHEN 'MEDIUM_LOW' THEN '可执行（需关注）' WHEN 'HIGH' THEN '不可执行' WHEN 'CRITICAL' THEN '不可执行' ELSE '需关注' END || '"}}' AS body FROM s) GROUP BY 1"""
)
def report_index(spark, d):
    """The nine sections of every bill's report, counted and named, with the last one's text."""
    flows = A.flow_status(D.flow_messages(spark, d)).select(F.col("flow_task_id").alias("bill_id"), F.col("status").alias("flow_status"), "current_step")
    parts = V.report_sections(_audit(spark, d).join(flows, "bill_id", "left"))
    last = F.max(F.when(F.col("section") == "conclusion", F.col("body")))
    return parts.groupBy("bill_id").agg(F.count("*").alias("sections"), F.array_join(F.array_sort(F.collect_list("section")), ",").alias("names"), last.alias("conclusion"))


@query(
    f"""WITH {AUDITED}, t AS (SELECT *, CASE WHEN bill_id % 7 <> 0 THEN compliance_rate END AS r1, CASE WHEN bill_id % 5 <> 0 THEN codes END AS c1, CASE WHEN bill_id % 3 <> 0 THEN match_score END AS m1, CASE WHEN bill_id % 4 <> 0 THEN fraud_score END AS f1 FROM levelled),
s AS (SELECT *, round(CASE WHEN r1 IS NULL THEN 60.0::DOUBLE ELSE greatest(0.0::DOUBLE, r1 * 100 - severe_count * 15) END * 0.3::DOUBLE
  + coalesce(CASE WHEN c1 IS NOT NULL THEN greatest(0.0::DOUBLE, 100.0::DOUBLE - CASE WHEN has_cycle THEN 50 ELSE 0 END - len(list_filter(c1, lambda x: x <> 'EN03')) * 10) END, 70.0::DOUBLE) * 0.3::DOUBLE
  + coalesce(m1, 50.0::DOUBLE) * 0.2::DOUBLE + coalesce(CASE WHEN f1 IS NOT NULL THEN least(100.0::DOUBLE, greatest(0.0::DOUBLE, (1.0::DOUBLE - f1) * 100)) END, 80.0::DOUBLE) * 0.2::DOUBLE, 2) AS risk FROM t)
SELECT bill_id, concat_ws(',', CASE WHEN r1 IS NULL THEN 'compliance' END, CASE WHEN c1 IS NULL THEN 'endorsement' END, CASE WHEN m1 IS NULL THEN 'contract' END, CASE WHEN f1 IS NULL THEN 'fraud' END) AS missing, risk AS risk_score FROM s"""
)
def audit_dimensions(spark, d):
    """Each dimension comes from its own table, joined by task; absent sides stay null."""
    a = _audit(spark, d)
    side = lambda every, *columns: a.where(F.col("bill_id") % every != 0).select("bill_id", *columns)
    tasks = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("bill_id"))
    joined = tasks.join(side(7, "compliance_rate", "severe_count"), "bill_id", "left").join(side(5, "violation_codes", "has_cycle"), "bill_id", "left")
    joined = joined.join(side(3, "match_score"), "bill_id", "left").join(side(4, "fraud_score"), "bill_id", "left")
    return A.with_risk(V.with_missing(joined)).select("bill_id", F.array_join("missing", ",").alias("missing"), "risk_score")


@query(
    f"""WITH {UPLOADS} SELECT tenant_id, ticket_number, count(*) AS n_versions,
  string_agg(version || ':' || len(endorsers) || ':' || len(list_filter(endorsers, lambda e: NOT list_contains(before, e))), ',' ORDER BY version) AS versions FROM versions GROUP BY ALL"""
)
def bill_histories(spark, d):
    h = V.histories(L.versions(D.uploads(spark, d)))
    return h.withColumn("versions", F.array_join(F.transform("versions", lambda v: F.concat_ws(":", v["version"], v["endorsers"], v["added"])), ","))


@query(
    f"""WITH {UPLOADS}, u AS (SELECT *, CASE WHEN bill_id % 11 = 0 THEN 'UNKNOWN-' || bill_id ELSE ticket_number END AS ticket FROM uploads),
f AS (SELECT tenant_id, ticket, upload_time, bill_id, unnest(list_filter([CASE WHEN due_date <= issue_date THEN 'DATE_LOGIC_ERROR' END,
    CASE WHEN ticket_type LIKE '%银行承兑%' AND acceptor <> '' THEN 'ACCEPTOR_NOT_BANK' END,
    CASE WHEN amount_numeric <> 0 AND amount_numeric < 1000000 THEN 'AMOUNT_MISMATCH' END,
    CASE WHEN date_diff('day', CAST(issue_date AS DATE), CAST(due_date AS DATE)) > 366 THEN 'TENOR_TOO_LONG' END], lambda x: x IS NOT NULL)) AS code FROM u),
o(code, place) AS (VALUES ('DATE_LOGIC_ERROR', 0), ('ACCEPTOR_NOT_BANK', 1), ('AMOUNT_MISMATCH', 2), ('TENOR_TOO_LONG', 3)),
m AS (SELECT tenant_id, ticket, code, min(struct_pack(t := upload_time, b := bill_id, p := place)) AS seen FROM f JOIN o USING (code) GROUP BY ALL)
SELECT tenant_id, ticket AS ticket_number, string_agg(code, ',' ORDER BY seen) AS codes FROM m GROUP BY ALL"""
)
def flag_history(spark, d):
    """Flags that each bill's uploads brought; blank ticket numbers get one of their own."""
    u = D.uploads(spark, d)
    u = V.named_tickets(u.withColumn("ticket_number", F.when(F.col("bill_id") % 11 == 0, " ").otherwise(F.col("ticket_number"))))
    return V.flag_history(A.risk_flags(u)).withColumn("codes", F.array_join("codes", ","))


@query(f"WITH {AUDITED}, n AS (SELECT bill_id, drawer, unnest(chain) AS party, unnest(range(len(chain))) AS p FROM endorsed) SELECT bill_id, party, CAST(min(p) AS INTEGER) AS position, bool_or(party = drawer) AS is_drawer FROM n GROUP BY ALL")
def endorsement_nodes(spark, d):
    return V.chain_nodes(D.bills(spark, d)).select("bill_id", "party", "position", "is_drawer")


@query(
    f"""WITH {BILLS} SELECT tenant_id, acceptor, count(*) AS n_bills, round(sum(amount_numeric), 2) AS amount,
  CASE WHEN round(sum(amount_numeric), 2) >= 1e7 THEN '特大额' WHEN round(sum(amount_numeric), 2) >= 5e6 THEN '大额' WHEN round(sum(amount_numeric), 2) >= 1e6 THEN '中额' ELSE '小额' END AS tier,
  round(round(sum(amount_numeric), 2) / any_value(book), 6) AS share FROM bills JOIN (SELECT tenant_id, sum(amount_numeric) AS book FROM bills GROUP BY tenant_id) USING (tenant_id) GROUP BY tenant_id, acceptor"""
)
def acceptor_concentration(spark, d):
    return S.concentration(D.bills(spark, d), "acceptor", E.amount_tier(F.col("amount")))


@query(
    f"""WITH {BILLS}, b AS (SELECT bill_id, CASE WHEN bill_id % 9 = 0 THEN due_date || 'x' WHEN bill_id % 10 = 0 THEN NULL ELSE due_date END AS due FROM bills)
SELECT bill_id, coalesce(CASE WHEN regexp_matches(due, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN date_diff('day', DATE '1996-06-01', CAST(due AS DATE)) END, 0) AS maturity_days FROM b"""
)
def bill_maturity(spark, d):
    due = F.when(F.col("bill_id") % 9 == 0, F.concat("due_date", F.lit("x"))).when(F.col("bill_id") % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("due_date"))
    b = D.bills(spark, d).select("bill_id", due.alias("due"))
    return b.select("bill_id", V.maturity_days(F.col("due"), F.to_date(F.lit("1996-06-01")).cast("timestamp")).alias("maturity_days"))


@query(
    f"""WITH {BILLS}, f AS (SELECT bill_id, tenant_id, ticket_number, created_at, coalesce(drawer, '') || '|' || coalesce(amount_numeric::VARCHAR, '') AS f FROM bills),
t AS (SELECT bill_id, tenant_id, bill_id % 1000 AS ticket_number, created_at, f FROM f),
w AS (SELECT *, first(f) OVER (PARTITION BY tenant_id, ticket_number ORDER BY created_at, bill_id) AS ff FROM t) SELECT bill_id, tenant_id, ticket_number FROM w WHERE f <> ff"""
)
def duplicate_bills(spark, d):
    """Bills whose tenant had the ticket number (here of three digits, so that it repeats) before."""
    b = D.bills(spark, d).withColumn("ticket_number", F.col("bill_id") % 1000)
    return A.duplicate_bills(b, E.fingerprint("drawer", "amount_numeric"))


@query(
    f"""WITH {UPLOADS}, n AS (SELECT *, list_filter(endorsers, lambda e: NOT list_contains(before, e)) AS added FROM versions)
SELECT tenant_id, ticket_number, CAST(version AS INTEGER) AS version, '票据号码 ' || ticket_number || ' 第' || version || '次流转背书（' || strftime(upload_time, '%Y-%m-%d') || '），新增背书人：' || CASE WHEN len(added) > 0 THEN array_to_string(added, '、') ELSE '无' END
  || '，当前完整背书链：[' || CASE WHEN len(endorsers) > 0 THEN array_to_string(endorsers, '、') ELSE '无' END || ']' AS content FROM n"""
)
def endorser_texts(spark, d):
    return L.versions(D.uploads(spark, d)).select("tenant_id", "ticket_number", "version", V.endorser_text().alias("content"))


@query(
    """WITH f AS (SELECT l_orderkey AS flow_task_id, count(*) AS n FROM lineitem GROUP BY 1) SELECT flow_task_id FROM f LEFT JOIN (SELECT o_orderkey, o_custkey % 25 AS t FROM orders WHERE o_orderkey % 3 <> 0) ON flow_task_id = o_orderkey WHERE t IS NULL OR t = 3"""
)
def visible_flows(spark, d):
    tasks = D.table(spark, d, "orders").where(F.col("o_orderkey") % 3 != 0).select(F.col("o_orderkey").alias("audit_id"), (F.col("o_custkey") % 25).alias("tenant_id"))
    flows = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("flow_task_id")).distinct()
    return V.visible_flows(flows, tasks, F.lit(3)).select("flow_task_id")


# ---- documents and retrieval ------------------------------------------------------------------

ELEMENTS = """
el AS (SELECT doc_id, source AS tenant_id, i AS row, x, contains(x, '|') AS tabular FROM (
  SELECT doc_id, source, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents)) WHERE trim(x) <> '')"""


def _elements(spark, d):
    each = D.table(spark, d, "documents").select("doc_id", F.col("source").alias("tenant_id"), F.posexplode(F.split("text", "\n", -1)).alias("row", "x"))
    return each.where(F.trim("x") != "").withColumn("tabular", F.contains("x", F.lit("|")))


@query(f"WITH {ELEMENTS} SELECT tenant_id, count(*) AS chunks, count(*) FILTER (tabular) AS tables, count(*) FILTER (NOT tabular) AS texts, count(DISTINCT CASE WHEN tabular THEN doc_id END) AS table_documents FROM el GROUP BY 1")
def chunk_profile(spark, d):
    g = _elements(spark, d).groupBy("tenant_id")
    return g.agg(F.count("*").alias("chunks"), F.count_if("tabular").alias("tables"), F.count_if(~F.col("tabular")).alias("texts"), F.count_distinct(F.when(F.col("tabular"), F.col("doc_id"))).alias("table_documents"))


TABLES = f"""{ELEMENTS}, ce AS (SELECT doc_id, row % 3 AS table_id, row, trim(unnest(string_split(x, '|'))) AS value, CASE WHEN doc_id % 4 <> 0 THEN 0.5 + doc_id % 6 / 10.0 END::DOUBLE AS accuracy FROM el WHERE tabular),
top AS (SELECT *, row = min(row) OVER (PARTITION BY doc_id, table_id) AS top FROM ce),
tb AS (SELECT doc_id, table_id, count(*) AS cells, count(*) FILTER (value = '') AS empty, bool_or(top AND contains(value, '/')) AS slash, coalesce(max(accuracy), 0.5::DOUBLE) AS accuracy FROM top GROUP BY ALL),
tc AS (SELECT doc_id, table_id, cells, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, accuracy * (1 - 0.5::DOUBLE * empty / cells) - CASE WHEN slash THEN 0.15 ELSE 0 END::DOUBLE)), 6) AS confidence FROM tb)"""


def _tables(spark, d):
    e = _elements(spark, d).where("tabular").withColumn("row", F.col("row") + 1)
    accuracy = F.when(F.col("doc_id") % 4 != 0, 0.5 + F.col("doc_id") % 6 / 10.0)
    cells = e.select("doc_id", (F.col("row") % 3).alias("table_id"), "row", F.explode(F.split("x", r"\|", -1)).alias("value"), accuracy.alias("accuracy"))
    return V.table_confidence(cells.withColumn("value", F.trim("value")))


@query(f"WITH {TABLES} SELECT doc_id, table_id, cells, confidence FROM tc")
def table_confidence(spark, d):
    return _tables(spark, d).select("doc_id", "table_id", "cells", "confidence")


@query(
    f"""WITH {TABLES}, g AS (SELECT doc_id, max(confidence) AS c, max_by(table_id, struct_pack(c := confidence, t := -table_id)) AS best_table, max_by(table_id, struct_pack(c := cells, t := -table_id)) AS largest_table FROM tc GROUP BY 1)
SELECT doc_id, best_table, largest_table, CASE WHEN c >= 0.8 THEN 'lattice' WHEN c >= 0.6 THEN 'stream' WHEN c > 0 THEN 'fallback' ELSE 'none' END AS method, CASE WHEN c < 0.6 AND c > 0 THEN FALSE ELSE c >= 0.8 END AS is_table FROM g"""
)
def table_choice(spark, d):
    return V.table_choice(_tables(spark, d))


@query(f"WITH {SEARCH} SELECT b.query_id, b.tenant_id, b.chunk_id, b.rank, n_chars, lang FROM bm b JOIN documents ON doc_id = b.chunk_id AND source = b.tenant_id")
def hit_metadata(spark, d):
    chunks = D.table(spark, d, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("chunk_id"), "n_chars", "lang")
    return V.with_metadata(_bm25(spark, d), chunks, "n_chars", "lang").drop("score")


@query(
    f"""WITH {SEARCH}, one AS (SELECT query_id || '-' || tenant_id AS query_id, chunk_id, b.rank, text, lang, n_chars FROM bm b JOIN documents ON doc_id = chunk_id AND source = tenant_id WHERE b.rank <= 3)
SELECT query_id, string_agg('**参考文档 ' || rank || '** ' || CASE WHEN lang <> '' THEN '[' || lang || '] ' ELSE '' END || '(第' || n_chars || '页)' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context,
  string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS sources FROM one GROUP BY 1"""
)
def context_blocks(spark, d):
    chunks = D.table(spark, d, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("section_path"), F.col("n_chars").alias("page_num"), F.col("text").alias("content"))
    hits = V.with_metadata(_bm25(spark, d).where("rank <= 3"), chunks, "section_path", "page_num", "content")
    return V.context_blocks(hits.withColumn("query_id", F.concat_ws("-", "query_id", "tenant_id")))


@query(
    f"""WITH {LOGS}, m AS (SELECT query AS intent_id, count(*) AS misses, round(avg(total_ms), 6) AS mean_top1 FROM logs WHERE NOT top_k_hit GROUP BY 1)
SELECT intent_id, misses, mean_top1, CAST(row_number() OVER (ORDER BY misses DESC, intent_id) AS INTEGER) AS place FROM m"""
)
def miss_backlog(spark, d):
    misses = D.query_logs(spark, d).where(~F.col("top_k_hit"))
    return V.miss_backlog(misses.select(F.col("query").alias("intent_id"), F.col("total_ms").alias("top1")))


@query(
    """WITH t AS (SELECT doc_id, lower(text) AS x FROM documents), w AS (SELECT doc_id, unnest(regexp_extract_all(x, '[0-9]+')) AS tok FROM t),
g AS (SELECT doc_id, tok, count(*) - 1 AS n FROM w WHERE length(tok) <= 9 GROUP BY ALL), k AS (SELECT doc_id, CAST(tok AS INTEGER) AS id, max(n) AS n FROM g WHERE n > 0 GROUP BY ALL)
SELECT d.doc_id, coalesce(string_agg(id || '=' || n, ',' ORDER BY id), '0=tiny') AS weights FROM documents d LEFT JOIN k USING (doc_id) GROUP BY 1"""
)
def sparse_vectors(spark, d):
    """Sparse vectors whose tokens are numbers and whose weights are counts less one, cleaned."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[0-9]+"), 0)
    docs = D.table(spark, d, "documents").select("doc_id", F.filter(tokens, lambda x: F.length(x) <= 9).alias("t"))
    found = docs.select("doc_id", F.explode("t").alias("tok")).groupBy("doc_id", "tok").agg((F.count("*") - 1).cast("double").alias("n"))
    vectors = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("tok", "n"))).alias("w"))
    v = docs.select("doc_id").join(vectors, "doc_id", "left").withColumn("w", F.coalesce("w", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))))
    told = F.transform(F.array_sort(F.map_entries(V.cleaned_weights(F.col("w")))), lambda e: F.concat_ws("=", e["key"], F.when(e["value"] < 1e-6, "tiny").otherwise(e["value"].cast("long").cast("string"))))
    return v.select("doc_id", F.array_join(told, ",").alias("weights"))


@query(
    """SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS amount, '人民币' AS currency, event_id % 4 = 0 AS is_bill_found FROM events"""
)
def json_records(spark, d):
    """Records in texts that may hold a JSON block, and may hold none."""
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("answer: "), F.replace("props", F.lit('"k"'), F.lit('"amount"')), F.lit(" end"))).otherwise(F.lit("no block"))
    e = D.table(spark, d, "events").select(F.col("event_id").alias("id"), V.bill_json(E.json_block(text)).alias("r"))
    return e.select("id", "r.amount", "r.currency", "r.is_bill_found")
