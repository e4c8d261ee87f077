"""Queries over stored chunks, batches, answers and fingerprints, with the same results in SQL."""

from __future__ import annotations

import uuid
from string import Formatter

from pyspark.sql import functions as F

from draftlake.functions import exprs as E
from draftlake.functions import scenes
from draftlake.operators import audit as A
from draftlake.operators import lifecycle as L
from draftlake.operators import retrieval as R
from draftlake.operators import reuse as U
from draftlake.operators import service as V
from draftlake.operators import tasks as T
from draftlake.plans.queries import BILLS, CORPUS, DENSE, HYBRID, QUERIES, SEARCH, UPLOADS, _bm25, _chunk_table, _dense, query
from draftlake.session import shared_folder
from draftlake.sources import chunk_store as C
from draftlake.sources import domain as D

# ---- answers ------------------------------------------------------------------------------------


@query(
    f"""WITH {DENSE}, s AS (SELECT query_id, chunk_id, rank AS old, round(1.0::DOUBLE / (1 + abs(chunk_id - query_id)), 6) AS rerank_score FROM dr WHERE rank <= 20),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old) AS INTEGER) AS rank FROM s) SELECT query_id, chunk_id, rank, rerank_score FROM r WHERE rank <= 5"""
)
def scored_again(spark, d):
    near = F.lit(1.0) / (1 + F.abs(F.col("chunk_id") - F.col("query_id")))
    return R.with_reranked(_dense(spark, d, 20), 5, near).select("query_id", "chunk_id", "rank", "rerank_score")


@query(
    f"""WITH {HYBRID}, five AS (SELECT *, round(1.0 / rank, 6) AS rerank_score FROM hy WHERE rank <= 5),
g AS (SELECT query_id, tenant_id, max(rerank_score) AS top1, count(*) FILTER (rerank_score >= 0.4) AS n FROM five GROUP BY ALL)
SELECT query_id, tenant_id, chunk_id, score, rank, lang, d.n_chars, CAST(rerank_score AS DOUBLE) AS rerank_score,
  CASE WHEN top1 >= 0.75 AND n >= 2 THEN 'SUFFICIENT' WHEN top1 >= 0.55 AND n >= 1 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS grade
FROM five JOIN g USING (query_id, tenant_id) LEFT JOIN documents d ON doc_id = chunk_id AND source = tenant_id"""
)
def hybrid_answers(spark, d):
    chunks = D.table(spark, d, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("chunk_id"), "lang", "n_chars")
    return R.hybrid_answers(QUERIES["hybrid_search"](spark, d), chunks, "lang", "n_chars")


TRIAGE = f"""{SEARCH}, g AS (SELECT query_id, max(score) AS top1, count(*) FILTER (score >= 0.4) AS n FROM bm GROUP BY 1),
tr AS (SELECT item_id AS query_id, text AS query, coalesce(top1, 0) AS top1, coalesce(n, 0) AS hit_count, CASE WHEN regexp_matches(coalesce(text, ''), '^\\s*$') THEN 'guide' WHEN NOT contains(text, 'th') AND NOT contains(text, 'en') THEN 'off_topic'
  WHEN top1 >= 0.75 AND n >= 320 THEN 'answer' WHEN top1 >= 0.55 AND n >= 250 THEN 'answer_with_note' ELSE 'transfer_human' END AS outcome FROM benchmark LEFT JOIN g ON item_id = query_id)"""


def _triaged(spark, d):
    """Graded with more hits asked for, as every question here stands in some document as it is."""
    queries = D.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    grades = R.retrieval_quality(queries, _bm25(spark, d)).withColumnRenamed("grade", "usual")
    n, top = F.col("hit_count"), F.col("top1")
    grades = grades.withColumn("grade", F.when((top >= 0.75) & (n >= 320), "SUFFICIENT").when((top >= 0.55) & (n >= 250), "PARTIAL").otherwise("INSUFFICIENT"))
    return queries, grades, R.triage(queries, grades, ("th", "en"))


@query(f"WITH {TRIAGE} SELECT query_id, query, 'INTENT_UNKNOWN' AS intent_id, round(top1, 6) AS top1, hit_count FROM tr WHERE outcome = 'transfer_human'")
def triage_misses(spark, d):
    queries, grades, triaged = _triaged(spark, d)
    return R.miss_rows(triaged, queries, grades)


@query(
    f"""WITH {TRIAGE} SELECT query_id, CASE WHEN outcome = 'off_topic' THEN 'off_topic' WHEN outcome = 'guide' THEN 'guide' ELSE 'fuzzy' END AS route_type,
  CASE WHEN outcome NOT IN ('off_topic', 'guide') THEN outcome <> 'transfer_human' END AS top_k_hit, CASE WHEN outcome NOT IN ('off_topic', 'guide') THEN round(top1, 6) END AS top1 FROM tr"""
)
def triage_logs(spark, d):
    _, grades, triaged = _triaged(spark, d)
    return R.log_rows(triaged, grades)


# ---- batches and messages -----------------------------------------------------------------------


@query(f"WITH {CORPUS} SELECT doc_id, tenant_id FROM corpus WHERE status = 'failed' AND text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels)")
def retried_documents(spark, d):
    return U.retryable(D.corpus(spark, d), D.table(spark, d, "labels").select("doc_id")).select("doc_id", "tenant_id")


@query(f"WITH {CORPUS} SELECT batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY n_chars DESC, doc_id) - 1 AS INTEGER) AS position, doc_id, status FROM corpus")
def batch_documents(spark, d):
    """Batches list their documents from the longest on."""
    docs = D.corpus(spark, d)
    lists = docs.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_chars")).alias("size"), "doc_id"))).alias("l"))
    batches = lists.select("batch_id", F.transform("l", lambda x: x["doc_id"]).alias("doc_ids"))
    return U.batch_members(batches, docs.drop("batch_id")).select("batch_id", "position", "doc_id", "status")


@query("SELECT event_id AS id, user_id % 30 AS error_code, n_name AS meaning FROM events LEFT JOIN nation ON n_nationkey = user_id % 30")
def explained_errors(spark, d):
    """Codes from 25 on have no entry."""
    logs = D.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 30).alias("error_code"))
    return U.explained(logs, D.table(spark, d, "nation").select(F.col("n_nationkey").alias("error_code"), F.col("n_name").alias("meaning")))


@query(
    """SELECT l_orderkey AS flow_task_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS INTEGER) AS place, l_linenumber AS step_index FROM lineitem"""
)
def flow_timeline(spark, d):
    m = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("flow_task_id"), F.col("l_shipdate").alias("step_index"), F.col("l_linenumber").alias("arrived_at"))
    return T.timeline(m).select("flow_task_id", "place", F.col("arrived_at").alias("step_index"))


@query(
    f"""WITH {UPLOADS}, u AS (SELECT *, CASE WHEN bill_id % 11 = 0 THEN 'UNKNOWN-' || bill_id ELSE ticket_number END AS ticket FROM uploads),
f AS (SELECT tenant_id, ticket, upload_time, bill_id, unnest(list_filter([CASE WHEN due_date <= issue_date THEN 'DATE_LOGIC_ERROR' END,
    CASE WHEN ticket_type LIKE '%银行承兑%' AND acceptor <> '' THEN 'ACCEPTOR_NOT_BANK' END,
    CASE WHEN amount_numeric <> 0 AND amount_numeric < 1000000 THEN 'AMOUNT_MISMATCH' END,
    CASE WHEN date_diff('day', CAST(issue_date AS DATE), CAST(due_date AS DATE)) > 366 THEN 'TENOR_TOO_LONG' END], lambda x: x IS NOT NULL)) AS code FROM u),
o(code, place) AS (VALUES ('DATE_LOGIC_ERROR', 0), ('ACCEPTOR_NOT_BANK', 1), ('AMOUNT_MISMATCH', 2), ('TENOR_TOO_LONG', 3)),
m AS (SELECT tenant_id, ticket, code, min(struct_pack(t := upload_time, b := bill_id, p := place)) AS seen FROM f JOIN o USING (code) GROUP BY ALL),
g AS (SELECT tenant_id, ticket, string_agg(code, ',' ORDER BY seen) AS codes FROM m GROUP BY ALL)
SELECT u.tenant_id, u.ticket AS ticket_number, CAST(count(*) AS INTEGER) AS latest_version, min_by(drawer, struct_pack(t := upload_time, b := bill_id)) AS drawer, min_by(amount_numeric, struct_pack(t := upload_time, b := bill_id)) AS amount_numeric,
  array_to_string(max_by(endorsers, struct_pack(t := upload_time, b := bill_id)), '|') AS endorsers, coalesce(any_value(codes), '') AS codes FROM u LEFT JOIN g ON g.tenant_id IS NOT DISTINCT FROM u.tenant_id AND g.ticket = u.ticket GROUP BY 1, 2"""
)
def whole_records(spark, d):
    """One record of each bill: first fields, versions and the flags of all uploads; blank numbers get one of their own."""
    u = D.uploads(spark, d)
    u = V.named_tickets(u.withColumn("ticket_number", F.when(F.col("bill_id") % 11 == 0, " ").otherwise(F.col("ticket_number"))))
    found = L.whole_records(L.states(A.risk_flags(u)))
    return found.withColumns({"endorsers": F.array_join("endorsers", "|"), "codes": F.array_join("codes", ",")})


# ---- amounts and fingerprints -------------------------------------------------------------------


@query("SELECT o_orderkey AS bill_id, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) * 1000000 + 234.5 END AS amount FROM orders")
def parsed_amounts(spark, d):
    """Amounts as people write them, with commas of both kinds; words are no amounts."""
    key = F.col("o_orderkey")
    said = F.when(key % 7 == 0, "about a million").otherwise(F.concat("o_custkey", F.when(key % 2 == 0, ",").otherwise("，"), F.lit("000,234.5")))
    return D.table(spark, d, "orders").select(key.alias("bill_id"), E.parse_amount(said).alias("amount"))


_TEXTS = {
    "acceptance_clause": "'到期无条件支付'", "acceptor": "acceptor", "amount_numeric": "CASE WHEN amount_numeric <> 0 THEN CAST(CAST(amount_numeric AS DECIMAL(20, 2)) AS VARCHAR) END", "amount_text": "'壹百万元整'",
    "currency": "'人民币'", "drawee_bank": "acceptor", "drawer": "drawer", "drawer_account": "'6222000000000000000'", "drawer_bank": "'银行'", "due_date": "due_date", "endorsers": "array_to_string(endorsers, ',')",
    "issue_date": "issue_date", "maturity_days": "CAST(nullif(maturity_days, 0) AS VARCHAR)", "payee": "payee", "special_remarks": "NULL", "ticket_number": "ticket_number", "ticket_type": "ticket_type", "trade_purpose": "trade_purpose",
}
WHOLE_BILL = "substr(sha256(" + " || '|' || ".join(f"'{f}=' || coalesce({x}, '')" for f, x in sorted(_TEXTS.items())) + "), 1, 24)"


@query(f"WITH {BILLS}, f AS (SELECT bill_id, ticket_type, {WHOLE_BILL} AS fingerprint FROM bills) SELECT bill_id, fingerprint, substr(sha256('  ' || ticket_type || '|' || fingerprint), 1, 24) AS plain, substr(sha256(ticket_type || '|' || fingerprint), 1, 24) AS query_fingerprint FROM f")
def whole_bill_fingerprints(spark, d):
    """All 18 fields of a bill, and a question about it, with and without the blanks around it."""
    b = D.bills(spark, d).select("bill_id", "ticket_type", E.fingerprint(*A.FIELDS).alias("fingerprint"))
    asked = F.concat(F.lit("  "), "ticket_type")
    return b.select("bill_id", "fingerprint", F.substring(F.sha2(F.concat_ws("|", asked, "fingerprint"), 256), 1, 24).alias("plain"), E.query_fingerprint(asked, F.col("fingerprint")).alias("query_fingerprint"))


# ---- stored chunks ------------------------------------------------------------------------------


@query("SELECT source AS tenant_id, doc_id AS chunk_id, length(text) AS size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def stored_chunks(spark, d):
    """Chunks as they are read from folders of tenants, without documents that a label calls bad."""
    path = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    C.write_chunks(_chunk_table(spark, d), path)
    docs = D.table(spark, d, "documents").select(F.col("source").alias("tenant_id"), "doc_id")
    gone = docs.join(D.table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    kept = C.without_documents(spark.read.schema("chunk_id long, content string, tenant_id string").parquet(path).withColumn("doc_id", F.col("chunk_id")), gone)
    return kept.select("tenant_id", "chunk_id", F.length("content").alias("size"))


@query(
    """WITH l AS (SELECT doc_id, i - 1 AS chunk_index, trim(parts[i]) <> '' AS has_text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index FROM l WHERE doc_id IN (SELECT doc_id FROM l WHERE has_text AND (doc_id + chunk_index) % 3 = 0)"""
)
def kept_parses(spark, d):
    """Parses (lines) of documents of which a chunk is not stored yet: every third one is missing."""
    parsed = D.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "content"))
    chunks = parsed.where(F.trim("content") != "").select("doc_id", "chunk_index")
    return C.unfinished(parsed, chunks, chunks.where((F.col("doc_id") + F.col("chunk_index")) % 3 != 0)).select("doc_id", "chunk_index")


# ---- questions about bills ----------------------------------------------------------------------

_TIER = "CASE WHEN coalesce({0}, 0) = 0 THEN '' WHEN {0} >= 1e7 THEN '特大额' WHEN {0} >= 5e6 THEN '大额' WHEN {0} >= 1e6 THEN '中额' ELSE '小额' END"
_SQL_FIELDS = {
    "ticket_type": "ticket_type", "acceptor": "coalesce(acceptor, '')", "drawer": "coalesce(drawer, '')", "drawer_bank": "'银行'", "item": "x", "bill_count": "CAST(bill_count AS VARCHAR)",
    "period": "coalesce(CASE WHEN days <= 30 THEN '≤30' WHEN days <= 90 THEN '≤90' WHEN days <= 180 THEN '≤180' WHEN days <= 365 THEN '≤365' WHEN days > 365 THEN '>365' END, '')",
    "days": "coalesce(CAST(days AS VARCHAR), 'None')", "tier": _TIER.format("amount_numeric"), "total_tier": _TIER.format("total"),
    "amount": "coalesce(CASE WHEN amount_numeric <> 0 THEN CAST(CAST(amount_numeric AS DECIMAL(20, 2)) AS VARCHAR) END, 'None')",
    "whole_amount": "format('{:,.0f}', coalesce(amount_numeric, 0))", "whole_total": "format('{:,.0f}', coalesce(total, 0))",
    "overdue": "CASE WHEN days IS NULL THEN '到期日未知' WHEN days < 0 THEN '已逾期 ' || -days || ' 天' ELSE '距到期还有 ' || days || ' 天（尚未到期）' END",
    "n_subjects": "CAST(len(subjects) AS VARCHAR)", "subjects": "array_to_string(subjects, ', ')", "n_flags": "CAST(len(codes) AS VARCHAR)", "flag_texts": "CASE WHEN len(codes) > 0 THEN array_to_string(codes, '；') ELSE '无' END",
    "new_list": "CASE WHEN len(endorsers) > 0 THEN '[''' || array_to_string(endorsers, ''', ''') || ''']' ELSE '[]' END",
}
_SQL_LISTS = {
    "named_acceptor": "CASE WHEN coalesce(acceptor, '') <> '' THEN [acceptor] ELSE [] END", "named_drawer": "CASE WHEN coalesce(drawer, '') <> '' THEN [drawer] ELSE [] END",
    "endorsers": "endorsers", "new_endorsers": "endorsers", "flag_questions": "list_transform(codes, lambda c: q[c])",
}


def _filled(template: str) -> str:
    parts = [(f"'{text}'" if text else "''") + (f" || {_SQL_FIELDS[name]}" if name else "") for text, name, *_ in Formatter().parse(template)]
    return "(" + " || ".join(parts) + ")"


def _scene_sql() -> tuple[str, str]:
    asked, hints = [], []
    for i, (each, always, else_, about) in enumerate(scenes.SCENES.values()):
        lists = [f"list_transform({_SQL_LISTS[c]}, lambda x: {_filled(form)})" for c, form in each.items()] + ["CAST([" + ", ".join(f"trim({_filled(q)})" for q in always) + "] AS VARCHAR[])"]
        both = " || ".join(f"CAST({x} AS VARCHAR[])" for x in lists)
        asked.append(f"WHEN {i} THEN {f'CASE WHEN len({both}) = 0 THEN {else_!r} ELSE {both} END' if else_ else both}")
        hints.append(f"WHEN {i} THEN {_filled(about)}")
    return " ".join(asked), " ".join(hints)


_ASKED, _HINTS = _scene_sql()


@query(
    f"""WITH {BILLS}, s AS (SELECT *, date_diff('day', DATE '{D.AS_OF}', CAST(due_date AS DATE)) AS days, sum(amount_numeric) OVER w AS total, count(*) OVER w AS bill_count,
  list_filter([drawer] || endorsers, lambda x: x IS NOT NULL) AS subjects, MAP {scenes.FLAG_QUESTIONS!r} AS q,
  list_filter([CASE WHEN due_date <= issue_date THEN 'DATE_LOGIC_ERROR' END, CASE WHEN ticket_type LIKE '%银行承兑%' AND acceptor <> '' THEN 'ACCEPTOR_NOT_BANK' END,
    CASE WHEN amount_numeric <> 0 AND amount_numeric < 1000000 THEN 'AMOUNT_MISMATCH' END, CASE WHEN date_diff('day', CAST(issue_date AS DATE), CAST(due_date AS DATE)) > 366 THEN 'TENOR_TOO_LONG' END], lambda x: x IS NOT NULL) AS codes
  FROM bills WINDOW w AS (PARTITION BY tenant_id, acceptor))
SELECT bill_id, array_to_string(CASE bill_id % 8 {_ASKED} END, '|') AS queries, CASE bill_id % 8 {_HINTS} END AS hint FROM s"""
)
def scene_queries(spark, d):
    """What each bill's question, of one of eight scenes, is searched with; a batch is a tenant's bills of one acceptor."""
    b = A.risk_flags(D.bills(spark, d))
    batches = b.groupBy("tenant_id", "acceptor").agg(F.sum("amount_numeric").alias("total"), F.count("*").alias("bill_count"))
    same = b["tenant_id"].eqNullSafe(batches["tenant_id"]) & b["acceptor"].eqNullSafe(batches["acceptor"])
    j = b.join(batches, same).drop(batches["tenant_id"]).drop(batches["acceptor"])
    intent = F.get(F.array(*map(F.lit, scenes.SCENES)), (F.col("bill_id") % 8).cast("int"))
    flags = F.transform("flags", lambda f: F.struct(f["code"].alias("code"), f["code"].alias("desc")))
    queries, hint = scenes.scene_queries(intent, D.AS_OF, F.col("total"), F.col("bill_count"), flags=flags)
    return j.select("bill_id", F.array_join(queries, "|").alias("queries"), hint.alias("hint"))
