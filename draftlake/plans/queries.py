"""Named queries over a folder of base tables, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftlake.functions import exprs as E
from draftlake.operators import audit as A
from draftlake.operators import extraction as X
from draftlake.operators import lifecycle as L
from draftlake.operators import network as N
from draftlake.operators import retrieval as R
from draftlake.operators import reuse as U
from draftlake.operators import stats as S
from draftlake.operators import tasks as T
from draftlake.operators.chunking import chunk_documents
from draftlake.sources import domain as D

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- the domain tables in SQL -----------------------------------------------------------------

BILLS = """
chains AS (
  SELECT l_orderkey, max(l_shipdate) AS due,
         list(CASE WHEN s_suppkey % 50 = 0 THEN '' ELSE s_name END ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) AS parties
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey),
bills AS (
  SELECT o_orderkey AS bill_id, c_nationkey AS tenant_id,
         CASE WHEN o_orderkey % 97 = 0 THEN 'DUP-' ELSE '' END || o_orderkey AS ticket_number,
         CASE o_orderstatus WHEN 'F' THEN '银行承兑汇票' WHEN 'O' THEN '商业承兑汇票' ELSE '银行本票' END AS ticket_type,
         strftime(o_orderdate, '%Y-%m-%d') AS issue_date, strftime(due, '%Y-%m-%d') AS due_date,
         round(o_totalprice * 100, 2) AS amount_numeric, c_name AS drawer, parties[-1] AS acceptor, parties[1] AS payee,
         coalesce(parties[2:], []) AS endorsers, coalesce(date_diff('day', o_orderdate, due), 0) AS maturity_days,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS trade_purpose,
         (60 + o_orderkey % 40) / 100.0::DOUBLE AS confidence, o_orderdate AS created_at
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN chains ON o_orderkey = l_orderkey),
contracts AS (
  SELECT o_orderkey AS bill_id, o_totalprice * 100 * (1 + (o_orderkey % 13 - 6) / 100.0::DOUBLE) AS contract_amount,
         CASE WHEN o_orderkey % 10 = 0 THEN 'Trader#' || o_orderkey ELSE c_name END AS party
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0)"""

AUDITED = (
    BILLS
    + """,
checked AS (
  SELECT *, ticket_type LIKE '%本票%' AS note,
         (CASE WHEN issue_date IS NULL THEN 1 ELSE 0 END + CASE WHEN due_date IS NULL THEN 1 ELSE 0 END + CASE WHEN coalesce(amount_numeric, 0) = 0 THEN 1 ELSE 0 END
          + CASE WHEN coalesce(drawer, '') = '' THEN 1 ELSE 0 END + CASE WHEN coalesce(payee, '') = '' THEN 1 ELSE 0 END
          + CASE WHEN ticket_type NOT LIKE '%本票%' AND coalesce(acceptor, '') = '' THEN 2 ELSE 0 END) AS severe_count,
         CASE WHEN coalesce(trade_purpose, '') = '' THEN 1 ELSE 0 END AS warning_count,
         list_filter([drawer, payee] || endorsers, lambda x: x IS NOT NULL AND x <> '') AS chain
  FROM bills),
endorsed AS (
  SELECT *, severe_count + warning_count AS violation_count, round((18 - severe_count - warning_count) / 18.0::DOUBLE, 3) AS compliance_rate,
         len(list_distinct(chain)) < len(chain) AS has_cycle,
         len(list_filter(endorsers, lambda x: x IS NULL OR x = '')) AS blank_count,
         coalesce(list_contains(endorsers, drawer), FALSE) AS own,
         len(list_filter(range(1, len(endorsers)), lambda i: endorsers[i] <> '' AND endorsers[i] = endorsers[i + 1])) > 0 AS adjacent
  FROM checked),
coded AS (
  SELECT *, list_filter([CASE WHEN has_cycle THEN 'EN02' END, CASE WHEN has_cycle THEN 'EN03' END, CASE WHEN blank_count > 0 THEN 'EN04' END,
    CASE WHEN len(endorsers) > 10 THEN 'EN06' END, CASE WHEN own THEN 'EN07' END, CASE WHEN adjacent THEN 'EN09' END], lambda x: x IS NOT NULL) AS codes
  FROM endorsed),
scored AS (
  SELECT c.*, CASE WHEN ticket_number LIKE 'DUP-%' THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE,
      CASE WHEN confidence >= 0.90 THEN 0.02 WHEN confidence >= 0.75 THEN 0.10 ELSE 0.30 END::DOUBLE * 0.30::DOUBLE
      + round(greatest(0.0::DOUBLE, (0.85::DOUBLE - confidence) * 2), 4) * 0.25::DOUBLE
      + CASE WHEN has_cycle THEN 0.8 WHEN len(codes) >= 3 THEN 0.2 ELSE 0.0 END::DOUBLE * 0.15::DOUBLE), 4) END AS fraud_score,
    k.party IS NOT NULL AS has_contract,
    coalesce(abs(amount_numeric - contract_amount) <= contract_amount * 0.05::DOUBLE, TRUE) AS amount_match,
    k.party IS NULL OR coalesce(drawer <> '' AND (contains(party, drawer) OR contains(drawer, party)), FALSE)
      OR coalesce(payee <> '' AND (contains(party, payee) OR contains(payee, party)), FALSE) AS party_match,
    k.party IS NULL OR coalesce(list_has_any(string_split(trade_purpose, ' '), ['1-URGENT', '货款']), TRUE) AS purpose_match
  FROM coded c LEFT JOIN contracts k USING (bill_id)),
matched AS (
  SELECT *, CASE WHEN NOT has_contract THEN 50.0::DOUBLE ELSE amount_match::INT * 25 + party_match::INT * 35 + 20 + purpose_match::INT * 20 END::DOUBLE AS match_score,
    CASE WHEN fraud_score >= 0.8 THEN 'fraud' WHEN fraud_score >= 0.6 THEN 'high_risk' WHEN fraud_score >= 0.3 THEN 'suspicious' ELSE 'clean' END AS fraud_level
  FROM scored),
risk AS (
  SELECT *, round(greatest(0.0::DOUBLE, compliance_rate * 100 - severe_count * 15) * 0.3::DOUBLE
      + greatest(0.0::DOUBLE, 100.0::DOUBLE - CASE WHEN has_cycle THEN 50 ELSE 0 END - len(list_filter(codes, lambda x: x <> 'EN03')) * 10) * 0.3::DOUBLE
      + match_score * 0.2::DOUBLE + least(100.0::DOUBLE, greatest(0.0::DOUBLE, (1.0::DOUBLE - fraud_score) * 100)) * 0.2::DOUBLE, 2) AS risk_score
  FROM matched),
levelled AS (
  SELECT *, CASE WHEN risk_score >= 85 THEN 'LOW' WHEN risk_score >= 70 THEN 'MEDIUM_LOW' WHEN risk_score >= 50 THEN 'MEDIUM_HIGH' WHEN risk_score >= 30 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM risk)"""
)

CORPUS = """
corpus AS (
  SELECT d.doc_id, source AS tenant_id, text, n_chars, md5(text) AS md5_hash, doc_id // 10 AS batch_id, n_chars % 7 AS chunk_count,
         CASE quality WHEN 1 THEN 'completed' WHEN 0 THEN 'failed' ELSE 'processing' END AS status
  FROM documents d LEFT JOIN labels USING (doc_id))"""

LOGS = """
logs AS (
  SELECT event_id AS id, user_id % 8 AS tenant_id, event_type AS query,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'specialized' WHEN event_type = 'error' THEN 'off_topic' WHEN event_type = 'view' THEN 'fuzzy' END AS route_type,
         CASE WHEN k IS NULL OR k % 10 = 0 THEN NULL ELSE k >= 40 END AS top_k_hit, value * 20 AS total_ms, value * 8 AS retrieval_ms, ts AS created_at
  FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def _audit(spark, d):
    return A.audit(D.bills(spark, d), D.contracts(spark, d))


# ---- audit ------------------------------------------------------------------------------------


@query(f"WITH {AUDITED} SELECT tenant_id, risk_level, count(*) AS n_bills, round(sum(amount_numeric), 2) AS amount FROM levelled GROUP BY ALL")
def risk_by_tenant(spark, d):
    return _audit(spark, d).groupBy("tenant_id", "risk_level").agg(F.count("*").alias("n_bills"), F.round(F.sum("amount_numeric"), 2).alias("amount"))


@query(f"WITH {AUDITED} SELECT bill_id, match_score, fraud_score, risk_score, risk_level FROM levelled")
def risk_assessment(spark, d):
    return _audit(spark, d).select("bill_id", "match_score", "fraud_score", "risk_score", "risk_level")


@query(
    f"""WITH {AUDITED} SELECT bill_id, risk_level,
  CASE risk_level WHEN 'LOW' THEN '审核通过' WHEN 'MEDIUM_LOW' THEN '有条件通过' WHEN 'MEDIUM_HIGH' THEN '需人工审核' WHEN 'HIGH' THEN '建议拒绝' ELSE '强制拒绝' END AS decision,
  CASE risk_level WHEN 'LOW' THEN '可执行' WHEN 'MEDIUM_LOW' THEN '可执行（需关注）' WHEN 'MEDIUM_HIGH' THEN '需关注' ELSE '不可执行' END AS reply,
  CASE WHEN a = '' THEN 'proceed' ELSE a END AS advice FROM (
  SELECT *, concat_ws(',', CASE WHEN severe_count > 0 THEN 'fix_severe' END, CASE WHEN violation_count > 0 THEN 'check_fields' END,
    CASE WHEN has_cycle THEN 'report_cycle' END, CASE WHEN NOT has_contract THEN 'bring_contract' END) AS a FROM levelled)"""
)
def audit_report(spark, d):
    return A.audit_report(_audit(spark, d))


@query(
    f"""WITH {BILLS}, f AS (SELECT bill_id, ticket_type LIKE '%本票%' AS note, unnest([
  ('ticket_number', 1, ticket_number <> ''), ('ticket_type', 1, ticket_type <> ''), ('issue_date', 1, issue_date IS NOT NULL), ('due_date', 1, due_date IS NOT NULL),
  ('amount_numeric', 1, coalesce(amount_numeric, 0) <> 0), ('drawer', 1, coalesce(drawer, '') <> ''), ('payee', 1, coalesce(payee, '') <> ''),
  ('acceptor', 2, coalesce(acceptor, '') <> ''), ('drawee_bank', 2, coalesce(acceptor, '') <> ''), ('trade_purpose', 3, coalesce(trade_purpose, '') <> ''),
  ('amount_text', 0, TRUE), ('currency', 0, TRUE), ('drawer_account', 0, TRUE), ('drawer_bank', 0, TRUE), ('endorsers', 0, TRUE), ('maturity_days', 0, TRUE),
  ('acceptance_clause', 0, TRUE), ('special_remarks', 0, TRUE)]) AS x FROM bills),
g AS (SELECT bill_id, x[1] AS field, CASE WHEN NOT x[3] AND (x[2] = 1 OR (x[2] = 2 AND NOT note)) THEN 'SEVERE' WHEN NOT x[3] AND x[2] = 3 THEN 'WARNING' ELSE 'INFO' END AS severity FROM f)
SELECT bill_id, field, severity = 'INFO' AS compliant, severity FROM g"""
)
def compliance_checks(spark, d):
    return A.compliance_checks(D.bills(spark, d))


@query(f"WITH {AUDITED} SELECT bill_id, violation_count, severe_count, compliance_rate, severe_count = 0 AS is_compliant FROM levelled")
def compliance_summary(spark, d):
    return A.with_compliance(D.bills(spark, d)).select("bill_id", "violation_count", "severe_count", "compliance_rate", "is_compliant")


@query(f"WITH {AUDITED} SELECT bill_id, len(endorsers) AS endorser_count, blank_count, has_cycle, array_to_string(codes, ',') AS codes FROM coded")
def endorsement_checks(spark, d):
    return A.with_endorsement(D.bills(spark, d)).select("bill_id", "endorser_count", "blank_count", "has_cycle", F.array_join("violation_codes", ",").alias("codes"))


@query(f"WITH {AUDITED} SELECT bill_id, tenant_id, i - 1 AS position, chain[i] AS src, chain[i + 1] AS dst FROM (SELECT bill_id, tenant_id, chain, unnest(range(1, len(chain))) AS i FROM coded)")
def endorsement_edges(spark, d):
    return A.endorsement_edges(D.bills(spark, d))


@query(f"WITH {AUDITED} SELECT bill_id, fraud_score, fraud_level FROM levelled")
def fraud_scores(spark, d):
    return A.with_fraud(A.with_endorsement(D.bills(spark, d))).select("bill_id", "fraud_score", "fraud_level")


@query(
    f"""WITH {AUDITED} SELECT bill_id, has_contract, amount_match, party_match, purpose_match, match_score,
  CASE WHEN trade_purpose IS NULL THEN 40.0 ELSE least(100.0, least(70.0, length(trade_purpose) * 2.0) + CASE WHEN has_contract AND purpose_match THEN 30 ELSE 0 END) END::DOUBLE AS trade_background_score FROM matched"""
)
def contract_review(spark, d):
    c = A.contract_review(D.bills(spark, d), D.contracts(spark, d))
    return c.select("bill_id", "has_contract", "amount_match", "party_match", "purpose_match", "match_score", "trade_background_score")


@query(
    f"""WITH {BILLS} SELECT bill_id, concat_ws(',', CASE WHEN due_date <= issue_date THEN 'DATE_LOGIC_ERROR' END,
  CASE WHEN ticket_type = '银行承兑汇票' AND acceptor <> '' AND NOT contains(lower(acceptor), 'bank') THEN 'ACCEPTOR_NOT_BANK' END,
  CASE WHEN amount_numeric <> 0 AND amount_numeric < 1000000 THEN 'AMOUNT_MISMATCH' END,
  CASE WHEN maturity_days > 366 THEN 'TENOR_TOO_LONG' END) AS flags FROM bills"""
)
def risk_flags(spark, d):
    return A.risk_flags(D.bills(spark, d)).select("bill_id", F.array_join(F.transform("flags", lambda x: x["code"]), ",").alias("flags"))


@query(
    f"""WITH {BILLS} SELECT bill_id, f AS failures, f = '' AS eligible, amount_numeric > 100000000 AS over_credit_limit FROM (SELECT *, concat_ws(',',
  CASE WHEN issue_date IS NULL THEN 'missing:issue_date' END, CASE WHEN due_date IS NULL THEN 'missing:due_date' END, CASE WHEN coalesce(amount_numeric, 0) = 0 THEN 'missing:amount_numeric' END,
  CASE WHEN coalesce(drawer, '') = '' THEN 'missing:drawer' END, CASE WHEN coalesce(acceptor, '') = '' THEN 'missing:acceptor' END, CASE WHEN coalesce(payee, '') = '' THEN 'missing:payee' END,
  CASE WHEN coalesce(acceptor, '') = '' THEN 'missing:drawee_bank' END, CASE WHEN amount_numeric <> 0 AND amount_numeric < 10000 THEN 'amount_low' END,
  CASE WHEN amount_numeric > 500000000 THEN 'amount_high' END, CASE WHEN maturity_days > 365 THEN 'tenor' END) AS f FROM bills)"""
)
def issuance_precheck(spark, d):
    return A.issuance_precheck(D.bills(spark, d))


@query(
    f"""WITH {BILLS}, p AS (SELECT DISTINCT bill_id, tenant_id, unnest([drawer, acceptor, payee] || endorsers) AS name FROM bills)
SELECT DISTINCT bill_id, name FROM p JOIN supplier ON lower(trim(s_name)) = lower(trim(name))
WHERE s_suppkey % 17 = 0 AND s_acctbal > 0 AND name <> '' AND (s_suppkey % 34 = 0 OR s_nationkey = tenant_id)"""
)
def blacklist_screening(spark, d):
    return A.screen_blacklist(D.bills(spark, d), D.blacklist(spark, d))


@query(f"WITH {BILLS} SELECT bill_id, tenant_id, ticket_number FROM bills WHERE ticket_number LIKE 'DUP-%'")
def marked_duplicates(spark, d):
    return D.bills(spark, d).where(F.startswith("ticket_number", F.lit("DUP-"))).select("bill_id", "tenant_id", "ticket_number")


@query(
    f"""WITH RECURSIVE {AUDITED}, pr AS (SELECT tenant_id, chain, unnest(range(1, len(chain))) AS i FROM endorsed),
ed AS (SELECT DISTINCT tenant_id, chain[i] AS src, chain[i + 1] AS dst FROM pr),
reach(tenant_id, src, dst) AS (SELECT * FROM ed UNION SELECT r.tenant_id, r.src, e.dst FROM reach r JOIN ed e ON e.tenant_id = r.tenant_id AND e.src = r.dst)
SELECT tenant_id AS graph_key, bool_or(src = dst) AS has_cycle FROM reach GROUP BY 1"""
)
def endorsement_network(spark, d):
    """Whether each tenant's endorsements, over all its bills, hold a cycle of parties."""
    return N.has_cycle(_party_edges(spark, d))


def _party_edges(spark, d):
    return A.endorsement_edges(D.bills(spark, d)).select(F.col("tenant_id").alias("graph_key"), "src", "dst")


@query(
    f"""WITH RECURSIVE {AUDITED}, pr AS (SELECT tenant_id, chain, unnest(range(1, len(chain))) AS i FROM endorsed),
ed AS (SELECT DISTINCT tenant_id, chain[i] AS src, chain[i + 1] AS dst FROM pr WHERE tenant_id IS NOT NULL),
reach(tenant_id, src, dst) AS (SELECT * FROM ed UNION SELECT r.tenant_id, r.src, e.dst FROM reach r JOIN ed e ON e.tenant_id = r.tenant_id AND e.src = r.dst),
both_ways AS (SELECT a.tenant_id, a.src AS party, min(a.dst) AS component, count(*) AS size FROM reach a JOIN reach b ON a.tenant_id = b.tenant_id AND a.src = b.dst AND a.dst = b.src GROUP BY ALL)
SELECT tenant_id, party, component, size FROM both_ways"""
)
def endorsement_parties(spark, d):
    """The parties of each tenant that stand on a cycle over all its bills, and with how many others."""
    return N.strong_components(_party_edges(spark, d)).withColumnRenamed("graph_key", "tenant_id")


UPLOADS = (
    BILLS
    + """,
uploads AS (SELECT * REPLACE (endorsers[1:k] AS endorsers), created_at + to_days(CAST(k AS INTEGER)) AS upload_time FROM bills, (SELECT unnest([1, 2, 3]) AS k)),
versions AS (
  SELECT *, row_number() OVER w AS version, coalesce(lag(endorsers) OVER w, []) AS before
  FROM uploads WINDOW w AS (PARTITION BY tenant_id, ticket_number ORDER BY upload_time, bill_id))"""
)


@query(f"WITH {UPLOADS} SELECT tenant_id, ticket_number, CAST(version AS INTEGER) AS version, array_to_string(list_filter(endorsers, lambda e: NOT list_contains(before, e)), '|') AS added FROM versions")
def bill_versions(spark, d):
    return L.versions(D.uploads(spark, d)).select("tenant_id", "ticket_number", "version", F.array_join("new_endorsers", "|").alias("added"))


@query(f"WITH {UPLOADS} SELECT tenant_id, ticket_number, CAST(max(version) AS INTEGER) AS latest_version, min_by(drawer, version) AS drawer, min_by(amount_numeric, version) AS amount_numeric, array_to_string(max_by(endorsers, version), '|') AS endorsers FROM versions GROUP BY ALL")
def bill_records(spark, d):
    return L.records(D.uploads(spark, d)).withColumn("endorsers", F.array_join("endorsers", "|"))


@query(f"WITH {UPLOADS} SELECT tenant_id, ticket_number, CAST(max(version) AS INTEGER) AS version, strftime(max(upload_time), '%Y-%m-%d') AS uploaded FROM versions GROUP BY ALL")
def latest_versions(spark, d):
    return L.latest_versions(D.uploads(spark, d)).select("tenant_id", "ticket_number", "version", F.date_format("upload_time", "yyyy-MM-dd").alias("uploaded"))


@query(
    """WITH m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) AS step, l_returnflag = 'R' AND l_discount >= 0.09 AS bad FROM lineitem),
s AS (SELECT *, min(CASE WHEN bad THEN step END) OVER (PARTITION BY l_orderkey) AS stop FROM m WHERE step <= 7),
g AS (SELECT l_orderkey, max(step) AS current_step, sum(CAST(floor(l_extendedprice) AS BIGINT)) AS t, max(CASE WHEN bad THEN CASE WHEN l_linestatus = 'F' THEN 'timeout' ELSE 'error' END END) AS st
  FROM s WHERE stop IS NULL OR step <= stop GROUP BY l_orderkey)
SELECT l_orderkey AS flow_task_id, CAST(current_step AS INTEGER) AS current_step, CAST(t AS BIGINT) AS elapsed_ms, coalesce(st, 'completed') AS status,
  CASE WHEN t >= 300000 THEN 'OVERDUE' WHEN t >= 120000 THEN 'URGENT' WHEN t >= 60000 THEN 'WARNING' WHEN t >= 30000 THEN 'WATCH' ELSE 'NORMAL' END AS timeout_level FROM g"""
)
def flow_status(spark, d):
    return A.flow_status(D.flow_messages(spark, d))


@query(
    f"""WITH {BILLS} SELECT tenant_id, drawer, count(*) AS n_bills, round(sum(amount_numeric), 2) AS amount,
  CASE WHEN round(sum(amount_numeric), 2) >= 1e7 THEN '特大额' WHEN round(sum(amount_numeric), 2) >= 5e6 THEN '大额' WHEN round(sum(amount_numeric), 2) >= 1e6 THEN '中额' ELSE '小额' END AS tier,
  round(round(sum(amount_numeric), 2) / any_value(book), 6) AS share FROM bills JOIN (SELECT tenant_id, sum(amount_numeric) AS book FROM bills GROUP BY tenant_id) USING (tenant_id) GROUP BY tenant_id, drawer"""
)
def drawer_concentration(spark, d):
    return S.concentration(D.bills(spark, d), "drawer", E.amount_tier(F.col("amount")))


@query(
    f"""WITH {BILLS}, x AS (SELECT bill_id, amount_numeric AS a, date_diff('day', TIMESTAMP '2002-01-01', CAST(due_date AS TIMESTAMP)) AS days FROM bills)
SELECT bill_id, CAST(days AS INTEGER) AS days_left, CASE WHEN days <= 30 THEN '≤30' WHEN days <= 90 THEN '≤90' WHEN days <= 180 THEN '≤180' WHEN days <= 365 THEN '≤365' ELSE '>365' END AS period,
  CASE WHEN coalesce(a, 0) = 0 THEN '' WHEN a >= 1e7 THEN '特大额' WHEN a >= 5e6 THEN '大额' WHEN a >= 1e6 THEN '中额' ELSE '小额' END AS tier FROM x"""
)
def bill_terms(spark, d):
    days = F.datediff(E.as_date("due_date"), F.to_date(F.lit(D.AS_OF)))
    b = D.bills(spark, d).withColumn("days_left", days)
    return b.select("bill_id", "days_left", E.period_label(F.col("days_left")).alias("period"), E.amount_tier(F.col("amount_numeric")).alias("tier"))


# ---- statistics -------------------------------------------------------------------------------


@query(f"WITH {CORPUS} SELECT tenant_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM corpus GROUP BY tenant_id")
def document_status(spark, d):
    return S.status_counts(D.corpus(spark, d), "tenant_id")


@query(
    f"""WITH {LOGS}, r AS (SELECT tenant_id, coalesce(route_type, 'fuzzy') AS route, top_k_hit AS hit FROM logs)
SELECT tenant_id, count(*) AS total, count(*) FILTER (route = 'off_topic') AS off_topic, count(*) FILTER (route <> 'off_topic' AND hit IS NULL) AS unknown,
  count(*) FILTER (route = 'specialized' AND hit) AS specialized_success, count(*) FILTER (route = 'specialized' AND NOT hit) AS specialized_fail,
  count(*) FILTER (route = 'fuzzy' AND hit) AS fuzzy_success, count(*) FILTER (route = 'fuzzy' AND NOT hit) AS fuzzy_fail FROM r GROUP BY tenant_id"""
)
def query_matrix(spark, d):
    return S.query_matrix(D.query_logs(spark, d), "tenant_id")


@query(f"WITH {LOGS} SELECT tenant_id, count(*) AS hits, round(avg(retrieval_ms), 1) AS avg_retrieval_ms, round(avg(total_ms), 1) AS avg_total_ms FROM logs WHERE top_k_hit GROUP BY tenant_id")
def latency_means(spark, d):
    return S.latency_means(D.query_logs(spark, d), "tenant_id")


@query(
    f"""WITH {CORPUS}, {LOGS}, q AS (SELECT tenant_id, count(*) AS queries, round(avg(total_ms), 4) AS avg_ms FROM logs GROUP BY 1),
o AS (SELECT o_custkey % 25 AS tenant_id, count(*) AS documents FROM orders GROUP BY 1)
SELECT n_nationkey AS tenant_id, n_name AS name, coalesce(documents, 0) AS documents, coalesce(queries, 0) AS queries, avg_ms, round(coalesce(documents, 0) * 100 / (100 + 10 * n_nationkey)::DOUBLE, 1) AS quota_pct
FROM nation LEFT JOIN o ON o.tenant_id = n_nationkey LEFT JOIN q ON q.tenant_id = n_nationkey"""
)
def tenant_overview(spark, d):
    docs = D.table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("tenant_id"))
    return S.tenant_overview(D.tenants(spark, d), docs, D.query_logs(spark, d))


@query(
    """SELECT o_custkey AS batch_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS failed, round(count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE, 3) AS failure_rate,
CASE WHEN count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE >= 0.5 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM orders GROUP BY 1"""
)
def batch_outcome(spark, d):
    return S.batch_outcome(D.batch_items(spark, d))


@query(f"WITH {CORPUS} SELECT batch_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'processing') THEN 'processing' ELSE 'completed' END AS status FROM corpus GROUP BY 1")
def batch_status(spark, d):
    return S.batch_status(D.corpus(spark, d))


@query(f"WITH {CORPUS} SELECT doc_id, batch_id, CASE WHEN status = 'processing' AND bool_or(status = 'failed') OVER (PARTITION BY batch_id) THEN 'failed' ELSE status END AS status FROM corpus")
def cascade_failure(spark, d):
    return S.cascade_failure(D.corpus(spark, d))


@query(
    f"WITH {LOGS}, b AS (SELECT unnest([50, 100, 200, 500, 1000, 2000, 5000, 10000, 30000, 60000]) AS le) "
    "SELECT tenant_id, count(total_ms) AS n, CAST(le AS DOUBLE) AS le, count(*) FILTER (total_ms <= le) AS cumulative FROM logs, b GROUP BY tenant_id, le"
)
def latency_histogram(spark, d):
    return S.histogram(D.query_logs(spark, d), "total_ms", "tenant_id")


@query(
    f"""WITH {LOGS}, b AS (SELECT unnest([50, 100, 200, 500, 1000, 2000, 5000, 10000, 30000, 60000]) AS le),
h AS (SELECT tenant_id, le, count(total_ms) AS n, count(*) FILTER (total_ms <= le) AS c FROM logs, b GROUP BY tenant_id, le),
w AS (SELECT *, coalesce(lag(le) OVER x, 0) AS low, coalesce(lag(c) OVER x, 0) AS under FROM h WINDOW x AS (PARTITION BY tenant_id ORDER BY le)),
v AS (SELECT tenant_id, le, low + (le - low) * (n * 0.95::DOUBLE - under) / (c - under) AS q FROM w WHERE c >= n * 0.95::DOUBLE)
SELECT t.tenant_id, coalesce(round(min_by(q, le), 6), 60000) AS quantile FROM (SELECT DISTINCT tenant_id FROM logs) t LEFT JOIN v USING (tenant_id) GROUP BY 1"""
)
def latency_p95(spark, d):
    return S.histogram_quantile(S.histogram(D.query_logs(spark, d), "total_ms", "tenant_id"), 0.95, "tenant_id")


@query(f"WITH {LOGS} SELECT id, tenant_id, count(*) OVER (PARTITION BY tenant_id ORDER BY created_at RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM logs")
def offered_load(spark, d):
    return S.offered_load(D.query_logs(spark, d), 3600)


@query(f"WITH {CORPUS} SELECT doc_id, tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY doc_id) <= 40 AS accepted FROM corpus")
def quota_check(spark, d):
    return S.quota_check(D.corpus(spark, d), 40)


@query(f"WITH {CORPUS} SELECT doc_id, tenant_id, CASE WHEN doc_id = min(doc_id) OVER w THEN 'new' ELSE 'duplicate' END AS intake, min(doc_id) OVER w AS first_id FROM corpus WINDOW w AS (PARTITION BY tenant_id, md5_hash)")
def document_dedup(spark, d):
    return S.dedup_documents(D.corpus(spark, d))


@query(f"WITH {LOGS} SELECT id, tenant_id, query FROM logs ORDER BY created_at DESC, id LIMIT 50")
def recent_logs(spark, d):
    return D.query_logs(spark, d).orderBy(F.desc("created_at"), "id").limit(50).select("id", "tenant_id", "query")


@query(f"WITH {LOGS} SELECT id, tenant_id FROM logs WHERE contains(lower(query), 'ur') AND route_type = 'specialized' AND top_k_hit")
def search_logs(spark, d):
    return D.query_logs(spark, d).where(F.contains(F.lower("query"), F.lit("ur")) & (F.col("route_type") == "specialized") & F.col("top_k_hit")).select("id", "tenant_id")


@query(f"WITH {CORPUS} SELECT tenant_id, count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS total_pages FROM corpus GROUP BY 1")
def page_info(spark, d):
    g = D.corpus(spark, d).groupBy("tenant_id").agg(F.count("*").alias("total"))
    return g.withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / 20)))


@query(
    f"""WITH {CORPUS} SELECT doc_id, substr(text, 1, 200) AS preview, CAST(len(regexp_extract_all(text, '[a-zA-Z0-9]+')) + len(regexp_extract_all(text, '[一-鿿]')) AS INTEGER) AS tokens,
  CASE WHEN regexp_matches(text, '(?i)intent') THEN 1 ELSE 0 END AS marked FROM corpus"""
)
def document_preview(spark, d):
    c = D.corpus(spark, d)
    return c.select("doc_id", F.substring("text", 1, 200).alias("preview"), E.count_tokens(F.col("text")).alias("tokens"), F.regexp_like("text", F.lit("(?i)intent")).cast("int").alias("marked"))


# ---- documents and retrieval ------------------------------------------------------------------


@query("SELECT doc_id, i - 1 AS element_idx, parts[i] AS content FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE trim(parts[i]) <> ''")
def text_elements(spark, d):
    each = D.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("element_idx", "content"))
    return each.where(F.trim("content") != "")


@query()
def chunks(spark, d):
    return chunk_documents(D.table(spark, d, "documents").select("doc_id", F.lit(0).alias("element_idx"), F.col("text").alias("content"), F.lit("text").alias("element_type")))


INDEX = """
chunk AS (SELECT source AS tenant_id, doc_id AS chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]') AS t FROM documents),
st AS (SELECT tenant_id, count(*) AS n_docs, avg(len(t)) AS avgdl FROM chunk GROUP BY 1),
po AS (SELECT tenant_id, chunk_id, dl, token, count(*) AS tf FROM (SELECT tenant_id, chunk_id, len(t) AS dl, unnest(t) AS token FROM chunk) GROUP BY ALL),
ra AS (SELECT tenant_id, token, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT tenant_id, token, count(*) AS df FROM po GROUP BY ALL) JOIN st USING (tenant_id)),
te AS (SELECT tenant_id, token, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY tenant_id) ELSE raw END AS idf FROM ra)"""


def _chunk_table(spark, d):
    return D.table(spark, d, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


@query(f"WITH {INDEX} SELECT tenant_id, token, df, round(idf, 6) AS idf FROM te")
def bm25_terms(spark, d):
    return R.bm25_index(_chunk_table(spark, d))[1].select("tenant_id", "token", "df", F.round("idf", 6).alias("idf"))


SEARCH = (
    INDEX
    + """,
qt AS (SELECT query_id, token, count(*) AS qf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]')) AS token FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, tenant_id, chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qf) AS raw
  FROM po JOIN te USING (tenant_id, token) JOIN st USING (tenant_id) JOIN qt USING (token) GROUP BY ALL),
al AS (SELECT b.item_id AS query_id, c.tenant_id, c.chunk_id, coalesce(raw, 0) AS raw FROM benchmark b CROSS JOIN chunk c LEFT JOIN sc ON sc.query_id = b.item_id AND sc.tenant_id = c.tenant_id AND sc.chunk_id = c.chunk_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, tenant_id ORDER BY round(raw, 9) DESC, chunk_id) AS rank FROM al),
bm AS (SELECT query_id, tenant_id, chunk_id, round(raw / CASE WHEN m > 0 THEN m ELSE 1 END, 6) AS score, CAST(rank AS INTEGER) AS rank
  FROM (SELECT *, max(raw) OVER (PARTITION BY query_id, tenant_id) AS m FROM rk WHERE rank <= 20))"""
)


def _bm25(spark, d):
    queries = D.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.bm25_search(queries, _chunk_table(spark, d), 20)


@query(f"WITH {SEARCH} SELECT * FROM bm")
def bm25_search(spark, d):
    return _bm25(spark, d)


@query(
    f"""WITH {SEARCH}, g AS (SELECT query_id, max(score) AS top1, avg(score) AS mean, count(*) FILTER (score >= 0.4) AS n FROM bm GROUP BY 1)
SELECT item_id AS query_id, round(coalesce(top1, 0), 6) AS top1, round(coalesce(mean, 0), 6) AS mean_score, coalesce(n, 0) AS hit_count,
  CASE WHEN top1 >= 0.75 AND n >= 2 THEN 'SUFFICIENT' WHEN top1 >= 0.55 AND n >= 1 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS grade FROM benchmark LEFT JOIN g ON item_id = query_id"""
)
def retrieval_quality(spark, d):
    queries = D.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return R.retrieval_quality(queries, _bm25(spark, d))


DENSE = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-8)) AS v FROM e),
ds AS (SELECT q.vec_id AS query_id, q.label AS tenant_id, c.vec_id AS chunk_id, round(list_inner_product(q.v, c.v), 6) AS score FROM u q JOIN u c ON q.label = c.label WHERE q.vec_id % 50 = 0),
dr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM ds)"""


def _dense(spark, d, k):
    v = D.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("tenant_id"), "embedding")
    return R.dense_search(v.where(F.col("chunk_id") % 50 == 0).withColumnRenamed("chunk_id", "query_id"), v, k)


@query(f"WITH {DENSE} SELECT * FROM dr WHERE rank <= 20")
def dense_search(spark, d):
    return _dense(spark, d, 20)


@query(
    f"""WITH {DENSE}, legs AS (SELECT query_id, 'dense' AS leg, 1 AS o, rank - 1 AS rank, chunk_id AS id, 0.6 AS w FROM dr WHERE rank <= 20
  UNION ALL SELECT query_id, 'near', 2, row_number() OVER (PARTITION BY query_id ORDER BY abs(chunk_id - query_id), chunk_id) - 1, chunk_id, 0.4 FROM dr WHERE rank <= 20),
f AS (SELECT query_id, id, sum(w / (60 + rank + 1)) AS raw, min(struct_pack(o := o, r := rank)) AS first FROM legs GROUP BY ALL)
SELECT query_id, id, round(raw, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, first, id) AS INTEGER) AS rank FROM f"""
)
def rank_fusion(spark, d):
    from pyspark.sql import Window

    dense = _dense(spark, d, 20)
    near = Window.partitionBy("query_id").orderBy(F.abs(F.col("chunk_id") - F.col("query_id")), "chunk_id")
    legs = dense.select("query_id", F.lit("dense").alias("leg"), (F.col("rank") - 1).alias("rank"), F.col("chunk_id").alias("id")).unionByName(
        dense.select("query_id", F.lit("near").alias("leg"), (F.row_number().over(near) - 1).alias("rank"), F.col("chunk_id").alias("id"))
    )
    return R.rrf_fuse(legs, {"dense": 0.6, "near": 0.4})


@query(f"WITH {DENSE} SELECT query_id, chunk_id, rank, round(1.0 / rank, 6) AS rerank_score FROM dr WHERE rank <= 5")
def reranked(spark, d):
    return R.with_reranked(_dense(spark, d, 20)).select("query_id", "chunk_id", "rank", "rerank_score")


SPARSE = """q0 AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]')) AS token FROM benchmark),
q1 AS (SELECT query_id, token, count(*) AS weight FROM q0 GROUP BY ALL),
q2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight, token) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM q1),
s AS (SELECT query_id, tenant_id, chunk_id, round(round(sum(weight * (tf / dl::DOUBLE)), 9), 6) AS score FROM po JOIN q2 USING (token) WHERE r > floor(n * 0.2::DOUBLE) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, tenant_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s)"""


@query(f"WITH {INDEX}, {SPARSE} SELECT * FROM k WHERE rank <= 20")
def sparse_search(spark, d):
    return _sparse(spark, d)


def _sparse(spark, d):
    chunks = _chunk_table(spark, d)
    postings = R.postings_of(chunks, R.tokens)
    weights = postings.select("tenant_id", "chunk_id", "token", (F.col("tf") / F.col("dl")).alias("weight"))
    queries = D.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(R.tokens(F.col("text"))).alias("token"))
    return R.sparse_search(queries.groupBy("query_id", "token").agg(F.count("*").alias("weight")), weights, 20, chunks=chunks)


#: A document and a question have the vector of the same number; all three legs meet in one table.
HYBRID = f"""{SEARCH}, {SPARSE},
hv AS (SELECT vec_id, list_transform(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda x: x) AS v FROM embeddings),
hu AS (SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-8)) AS v FROM hv),
hd AS (SELECT item_id AS query_id, source AS tenant_id, doc_id AS chunk_id, round(list_inner_product(a.v, b.v), 6) AS score FROM benchmark JOIN hu a ON item_id = a.vec_id, documents JOIN hu b ON doc_id = b.vec_id),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id, tenant_id ORDER BY score DESC, chunk_id) AS rank FROM hd),
legs AS (SELECT query_id, tenant_id, 1 AS o, rank - 1 AS r, chunk_id, 0.6 AS w FROM hr WHERE rank <= 20 UNION ALL SELECT query_id, tenant_id, 2, rank - 1, chunk_id, 0.4 FROM k WHERE rank <= 20
  UNION ALL SELECT query_id, tenant_id, 3, rank - 1, chunk_id, 0.32 FROM bm),
hf AS (SELECT query_id, tenant_id, chunk_id, sum(w / (60 + r + 1)) AS raw, min(struct_pack(o := o, r := r)) AS first FROM legs GROUP BY ALL),
hy AS (SELECT query_id, tenant_id, chunk_id, round(raw, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id, tenant_id ORDER BY round(raw, 9) DESC, first, chunk_id) AS INTEGER) AS rank FROM hf)"""


@query(f"WITH {HYBRID} SELECT * FROM hy WHERE rank <= 20")
def hybrid_search(spark, d):
    # Vectors of documents and queries are those of the same number; others have no dense leg.
    e = D.table(spark, d, "embeddings").select("vec_id", "embedding")
    docs, asked = D.table(spark, d, "documents"), D.table(spark, d, "benchmark")
    vectors = docs.join(e, docs["doc_id"] == e["vec_id"]).select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("chunk_id"), "embedding")
    queries = asked.join(e, asked["item_id"] == e["vec_id"]).select("item_id", "embedding").crossJoin(vectors.select("tenant_id").distinct())
    # A query ranks the documents of every tenant apart.
    dense = R.dense_search(queries.select(F.struct("item_id", "tenant_id").alias("query_id"), "tenant_id", "embedding"), vectors, 20)
    dense = dense.select(F.col("query_id.item_id").alias("query_id"), "tenant_id", "chunk_id", "score", "rank")
    return R.hybrid_search({"dense": dense, "sparse": _sparse(spark, d), "bm25": _bm25(spark, d)}, {"dense": 0.6, "sparse": 0.4, "bm25": 0.32})


@query()
def ivf_search(spark, d):
    v = D.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return R.ivf_search(v.where(F.col("chunk_id") % 50 == 0).withColumnRenamed("chunk_id", "query_id"), v, 20)


@query(
    f"""WITH {SEARCH}, g AS (SELECT query_id, max(score) AS top1, count(*) FILTER (score >= 0.4) AS n FROM bm GROUP BY 1)
SELECT item_id AS query_id, 'INTENT_UNKNOWN' AS intent_id, CASE WHEN regexp_matches(coalesce(text, ''), '^\\s*$') THEN 'guide' WHEN NOT contains(text, 'th') AND NOT contains(text, 'en') THEN 'off_topic'
  WHEN top1 >= 0.75 AND n >= 2 THEN 'answer' WHEN top1 >= 0.55 AND n >= 1 THEN 'answer_with_note' ELSE 'transfer_human' END AS outcome FROM benchmark LEFT JOIN g ON item_id = query_id"""
)
def query_triage(spark, d):
    queries = D.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.triage(queries, R.retrieval_quality(queries, _bm25(spark, d)), ("th", "en"))


# ---- tasks, reuse and extraction --------------------------------------------------------------


@query(
    """WITH e AS (SELECT event_id, user_id % 8 AS tenant_id, user_id AS fingerprint, event_type, ts, value FROM events),
j AS (SELECT r.event_id AS id, r.tenant_id, any_value(r.ts) AS asked, max(CASE WHEN s.ts IS NOT NULL THEN struct_pack(t := s.ts, v := s.value) END) AS b
  FROM e r LEFT JOIN e s ON s.event_type = 'purchase' AND s.tenant_id = r.tenant_id AND s.fingerprint = r.fingerprint AND s.ts <= r.ts WHERE r.event_type = 'view' GROUP BY ALL)
SELECT id, tenant_id, CASE WHEN asked - b.t <= INTERVAL 24 HOURS THEN b.v END AS result, coalesce(asked - b.t <= INTERVAL 24 HOURS, FALSE) AS reused FROM j"""
)
def reused_results(spark, d):
    e = D.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 8).alias("tenant_id"), F.col("user_id").alias("fingerprint"), F.col("ts").alias("at"), F.col("value").alias("result"), "event_type")
    return U.reuse_results(e.where("event_type = 'view'").drop("event_type", "result"), e.where("event_type = 'purchase'").drop("event_type", "id"), "intent")


@query(
    """WITH l AS (SELECT event_id AS id, user_id % 8 AS tenant_id FROM events),
f AS (SELECT event_id - event_id % 3 AS id, user_id % 8 AS tenant_id, max(struct_pack(t := ts, s := 1 + event_id % 5)).s AS s FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT l.id, l.tenant_id, f.s AS feedback_score FROM l LEFT JOIN f ON l.id = f.id AND l.tenant_id = f.tenant_id"""
)
def log_feedback(spark, d):
    e = D.table(spark, d, "events")
    given = e.where("event_type = 'click'").select((F.col("event_id") - F.col("event_id") % 3).alias("id"), (F.col("user_id") % 8).alias("tenant_id"), (1 + F.col("event_id") % 5).alias("score"), F.col("ts").alias("at"))
    return U.apply_feedback(D.query_logs(spark, d).select("id", "tenant_id"), given)


@query(
    """SELECT event_id AS id, concat_ws(',', CASE WHEN event_id % 7 NOT BETWEEN 1 AND 5 THEN 'score' END, CASE WHEN length(event_type) NOT BETWEEN 2 AND 2000 THEN 'query' END,
  CASE WHEN user_id % 60 NOT BETWEEN 1 AND 50 THEN 'top_k' END) AS broken FROM events"""
)
def request_checks(spark, d):
    e = D.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 7).alias("feedback_score"), F.col("event_type").alias("query"), (F.col("user_id") % 60).alias("top_k"))
    return U.broken_rules(e, U.request_rules()).select("id", F.array_join("broken", ",").alias("broken"))


@query(
    """WITH m AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) AS page,
  CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS payee, CASE WHEN l_linestatus = 'F' THEN l_partkey END AS drawer,
  [CAST(l_partkey % 5 AS VARCHAR), '', CAST(l_suppkey % 3 AS VARCHAR)] AS es FROM lineitem WHERE l_discount > 0.02),
e AS (SELECT l_orderkey, x, min(p) AS p FROM (SELECT l_orderkey, unnest(es) AS x, page * 3 + unnest([1, 2, 3]) AS p FROM m) WHERE x <> '' GROUP BY ALL),
a AS (SELECT l_orderkey, string_agg(x, '|' ORDER BY p) AS endorsers FROM e GROUP BY 1)
SELECT l_orderkey AS bill_id, min_by(payee, CASE WHEN payee IS NOT NULL THEN page END) AS payee, min_by(drawer, CASE WHEN drawer IS NOT NULL THEN page END) AS drawer, any_value(endorsers) AS endorsers
FROM m JOIN a USING (l_orderkey) GROUP BY 1"""
)
def merged_pages(spark, d):
    text = lambda c, n: (F.col(c) % n).cast("string")
    pages = D.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("bill_id"), "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", (F.col("l_discount") > 0.02).alias("is_bill_found"),
        F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("payee"), F.when(F.col("l_linestatus") == "F", F.col("l_partkey")).alias("drawer"),
        F.array(text("l_partkey", 5), F.lit(""), text("l_suppkey", 3)).alias("endorsers"),
    )
    merged = X.merge_pages(pages, "bill_id", F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"), ("payee", "drawer"))
    return merged.withColumn("endorsers", F.array_join("endorsers", "|"))


@query(
    f"""WITH {BILLS}, c AS (SELECT bill_id, round((6 + (issue_date IS NOT NULL)::INT + (due_date IS NOT NULL)::INT + (coalesce(amount_numeric, 0) <> 0)::INT
  + (coalesce(drawer, '') <> '')::INT + 2 * (coalesce(acceptor, '') <> '')::INT + (coalesce(payee, '') <> '')::INT) / 13.0::DOUBLE, 3) AS confidence FROM bills)
SELECT bill_id, confidence, confidence < 0.70 AS is_low FROM c"""
)
def extraction_confidence(spark, d):
    return X.extraction_confidence(D.bills(spark, d)).select("bill_id", "confidence", "is_low")


@query(
    """WITH e AS (SELECT doc_id, avg(length(x) % 100 / 100.0::DOUBLE) AS m FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x) <> '' GROUP BY 1)
SELECT d.doc_id, round(coalesce(CASE WHEN n_chars % 3 = 0 THEN 0.9::DOUBLE END, m, 1.0), 6) AS confidence FROM documents d LEFT JOIN e USING (doc_id)"""
)
def document_confidence(spark, d):
    docs = D.table(spark, d, "documents")
    elements = text_elements(spark, d).select("doc_id", (F.length("content") % 100 / 100.0).alias("confidence"))
    return X.doc_confidence(docs.select("doc_id", F.when(F.col("n_chars") % 3 == 0, 0.9).alias("stated_confidence")), elements)


@query("SELECT o_custkey AS task_id, max_by(o_orderkey, struct_pack(f := o_orderstatus = 'F', t := o_orderdate, k := o_orderkey)) AS report_id FROM orders GROUP BY 1")
def current_reports(spark, d):
    o = D.table(spark, d, "orders")
    return T.current_report(o.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("report_id"), (F.col("o_orderstatus") == "F").alias("is_final"), F.col("o_orderdate").alias("created_at")))


TASK_TYPES = tuple(T.PLANS)


def _typed(key):
    return F.element_at(F.array(*map(F.lit, TASK_TYPES)), (F.col(key) % len(TASK_TYPES) + 1).cast("int"))


_SIZES = ", ".join(f"({i}, {len(p)})" for i, p in enumerate(T.PLANS.values()))


@query(
    f"""WITH n(k, size) AS (VALUES {_SIZES}), m AS (SELECT l_orderkey AS task_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) AS step FROM lineitem)
SELECT task_id, CAST(step AS INTEGER) AS step_index, round(step / size::DOUBLE * 100, 1) AS progress_pct FROM m JOIN n ON k = task_id % 8"""
)
def task_progress(spark, d):
    m = D.flow_messages(spark, d).select(F.col("flow_task_id").alias("task_id"), "step_index")
    return T.progress(m.withColumn("task_type", _typed("task_id")))


_NODES = ", ".join(
    f"({i}, {s}, {j}, '{node}', {str(node in T.CRITICAL or (node == 'contract_review' and name == 'discount_apply')).upper()})"
    for i, (name, plan) in enumerate(T.PLANS.items())
    for s, step in enumerate(plan)
    for j, node in enumerate(step)
)
_FAILING = ("document_parser", "fraud_detection", "contract_review", "compliance_retrieval", "endorsement_chain", "risk_assessment", "report_generation", "bill_issuance", "none", "none", "none")


@query(
    f"""WITH n(k, step, place, node, critical) AS (VALUES {_NODES}),
t AS (SELECT o_orderkey AS task_id, o_orderkey % 8 AS k, ({list(_FAILING)!r})[o_orderkey % 11 + 1] AS bad FROM orders),
s AS (SELECT task_id, t.k, bad, min(CASE WHEN critical AND node = bad THEN step END) AS stop FROM t JOIN n USING (k) GROUP BY ALL)
SELECT task_id, ({list(TASK_TYPES)!r})[s.k + 1] AS task_type, coalesce(string_agg(node, ',' ORDER BY step, place) FILTER (node <> bad AND (stop IS NULL OR step <= stop)), '') AS produced, stop IS NOT NULL AS failed
FROM s JOIN n USING (k) GROUP BY task_id, s.k, stop"""
)
def audit_plan(spark, d):
    o = D.table(spark, d, "orders").withColumnRenamed("o_orderkey", "task_id")
    bad = F.element_at(F.array(*map(F.lit, _FAILING)), (F.col("task_id") % len(_FAILING) + 1).cast("int"))
    tasks = T.audit_plan(o.select("task_id", _typed("task_id").alias("task_type"), F.array(bad).alias("failed_nodes")))
    return tasks.withColumn("produced", F.array_join("produced", ","))


@query(
    f"""WITH {AUDITED}, i AS (SELECT o_custkey AS batch_id, o_orderkey AS bill_id FROM orders UNION ALL SELECT o_custkey, -o_orderkey FROM orders WHERE o_orderkey % 50 = 0),
w AS (SELECT batch_id, bill_id, risk_level, CASE WHEN l.ticket_number IS NULL THEN 'no bill' WHEN due_date IS NULL THEN 'no due date' WHEN coalesce(amount_numeric, 0) <= 0 THEN 'no amount' END AS error_msg FROM i LEFT JOIN levelled l USING (bill_id))
SELECT batch_id, bill_id, CASE WHEN error_msg IS NULL THEN 'completed' ELSE 'failed' END AS status, error_msg, CASE WHEN error_msg IS NULL THEN risk_level END AS risk_level FROM w"""
)
def batch_audit(spark, d):
    o = D.table(spark, d, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("bill_id"))
    lost = o.where(F.col("bill_id") % 50 == 0).withColumn("bill_id", -F.col("bill_id"))
    return T.batch_audit(o.unionByName(lost), _audit(spark, d).select("bill_id", "due_date", "amount_numeric", "risk_level"))


_SAY = "coalesce(nullif({}, ''), '未知')"


@query(
    f"""WITH {BILLS} SELECT bill_id, '票据号码 ' || ticket_number || ' 的' || ticket_type || '，出票人：' || {_SAY.format('drawer')} || '（账号：6222000000000000000，开户行：银行），承兑人：' || {_SAY.format('acceptor')}
  || '，付款行：' || {_SAY.format('acceptor')} || '，出票日期：' || {_SAY.format('issue_date')} || '，到期日：' || {_SAY.format('due_date')} || '，票面金额：人民币壹百万元整（¥' || format('{{:,.2f}}', coalesce(amount_numeric, 0))
  || '），收款人：' || {_SAY.format('payee')} || '，背书人：[' || CASE WHEN len(endorsers) > 0 THEN array_to_string(endorsers, '、') ELSE '无' END || ']' AS content FROM bills"""
)
def bill_texts(spark, d):
    return D.bills(spark, d).select("bill_id", E.bill_text().alias("content"))


@query(
    f"""WITH {BILLS} SELECT bill_id, substr(sha256('acceptor=' || coalesce(acceptor, '') || '|amount_numeric=' || CASE WHEN coalesce(amount_numeric, 0) = 0 THEN '' ELSE CAST(CAST(amount_numeric AS DECIMAL(20, 2)) AS VARCHAR) END
  || '|drawer=' || coalesce(drawer, '') || '|due_date=' || coalesce(due_date, '') || '|endorsers=' || array_to_string(endorsers, ',') || '|ticket_number=' || ticket_number), 1, 24) AS fingerprint,
  concat_ws(' ', 'q', 'acceptor:' || nullif(acceptor, ''), 'ticket_type:' || ticket_type, 'due_date:' || due_date, 'amount_numeric:' || CASE WHEN amount_numeric <> 0 THEN CAST(CAST(amount_numeric AS DECIMAL(20, 2)) AS VARCHAR) END) AS search_query FROM bills"""
)
def bill_fingerprints(spark, d):
    b = D.bills(spark, d)
    return b.select("bill_id", E.fingerprint("ticket_number", "drawer", "acceptor", "due_date", "amount_numeric", "endorsers").alias("fingerprint"), E.search_query(F.lit("q"), F.lit("INTENT_PRICING")).alias("search_query"))


# The queries of other modules register themselves here.
import draftlake.plans.index  # noqa: E402
import draftlake.plans.rows  # noqa: E402
import draftlake.plans.service  # noqa: E402, F401
