"""Rules at their bounds, on rows written here."""

import random

from pyspark.sql import functions as F

from draftlake.functions import exprs as E
from draftlake.operators import audit as A
from draftlake.operators import chunking as C
from draftlake.operators import retrieval as R
from draftlake.operators import reuse as U
from draftlake.operators import stats as S
from draftlake.operators import tasks as T
from draftlake.sources import chunk_store as K
from draftlake.streaming import streams as X

BILL = "bill_id long, tenant_id int, ticket_number string, ticket_type string, drawer string, payee string, acceptor string, endorsers array<string>, confidence_score double"


def codes(spark, drawer, payee, endorsers):
    b = spark.createDataFrame([(1, 1, "T", "银行承兑汇票", drawer, payee, "银行", endorsers, 0.95)], BILL)
    return A.with_endorsement(b).first()["violation_codes"]


def test_endorsement_codes(spark):
    assert codes(spark, "a", "b", []) == []
    assert codes(spark, "a", "b", ["c", None, ""]) == ["EN04"]
    assert codes(spark, "a", "b", ["a"]) == ["EN02", "EN03", "EN07"]
    assert codes(spark, "a", "b", ["c", "c"]) == ["EN02", "EN03", "EN09"]
    assert codes(spark, "a", "b", [f"x{i}" for i in range(11)]) == ["EN06"]


def test_duplicate_ticket_is_fraud(spark):
    b = spark.createDataFrame([(1, 1, "DUP-1", "x", "a", "b", "c", [], 0.95), (2, 1, "2", "x", "BLACKLIST co", "b", "c", [], 0.5)], BILL)
    got = {r.bill_id: (r.fraud_score, r.fraud_level) for r in A.with_fraud(A.with_endorsement(b)).collect()}
    assert got[1] == (1.0, "fraud")
    assert got[2] == (round(0.30 * 0.30 + 0.70 * 0.25 + 0.5 * 0.05, 4), "clean")


def test_cycles(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    e = spark.createDataFrame([("c", "a", "b"), ("c", "b", "a"), ("l", "a", "b"), ("l", "b", "d")], "graph_key string, src string, dst string")
    assert {r.graph_key: r.has_cycle for r in A.has_cycle(e).collect()} == {"c": True, "l": False}


def test_cell_search_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit(0).alias("tenant_id"))
    q = v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    want, got = ({(r.query_id, r.chunk_id) for r in search(q, v, 20).collect()} for search in (R.dense_search, R.ivf_search))
    assert len(got & want) >= 0.9 * len(want)


def test_hybrid_search_has_what_only_the_dense_leg_finds(spark, sf):
    from draftlake.plans import queries as Q

    # Tenants of more documents than a leg returns: the keyword leg fills its ranks in smaller ones.
    sf = sf.replace("sf0.001", "sf0.01")
    fused = {(r.query_id, r.tenant_id, r.chunk_id) for r in Q.hybrid_search(spark, sf).collect()}
    words = [{(r.query_id, r.tenant_id, r.chunk_id) for r in leg(spark, sf).collect()} for leg in (Q._sparse, Q._bm25)]
    assert fused - words[0] - words[1]


def test_limits_and_numbers_over_slices(spark):
    from draftlake.operators import service as V

    rows = [(i, 1, i % 3) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, tenant_id long, x int")
    got = V.numbered(docs, "tenant_id", "doc_id", width=7).collect()
    assert {r.doc_id: r.number for r in got} == {i: i + 1 for i in range(50)}


def test_marked_table(spark):
    from draftlake.operators import service as V

    cells = [(1, 0, 0, "a/b", None), (1, 0, 1, "", None), (1, 1, 0, "a", 0.9), (1, 1, 1, "b", 0.9), (2, 0, 0, None, 0.2)]
    t = V.table_confidence(spark.createDataFrame(cells, "doc_id long, table_id long, row int, value string, accuracy double"))
    assert {(r.doc_id, r.table_id): r.confidence for r in t.collect()} == {(1, 0): 0.225, (1, 1): 0.9, (2, 0): 0.1}
    assert {r.doc_id: (r.best_table, r.method, r.is_table) for r in V.table_choice(t).collect()} == {1: (1, "lattice", True), 2: (0, "fallback", False)}


def test_long_chain_has_no_cycle(spark):
    rows = [("l", f"n{i}", f"n{i + 1}") for i in range(70)] + [("c", f"n{i}", f"n{i + 1}") for i in range(5)] + [("c", "n5", "n2")]
    e = spark.createDataFrame(rows, "graph_key string, src string, dst string")
    assert {r.graph_key: r.has_cycle for r in A.has_cycle(e).collect()} == {"c": True, "l": False}


def test_flow_levels(spark):
    times = [29_999, 30_000, 59_999, 60_000, 119_999, 120_000, 299_999, 300_000]
    m = spark.createDataFrame([(i, 1, t, False, "success") for i, t in enumerate(times)], "flow_task_id long, step_index int, processing_ms long, is_anomaly boolean, status string")
    got = [r.timeout_level for r in A.flow_status(m).orderBy("flow_task_id").collect()]
    assert got == ["NORMAL", "WATCH", "WATCH", "WARNING", "WARNING", "URGENT", "URGENT", "OVERDUE"]


def test_batch_half_failed(spark):
    rows = [(1, "failed")] * 50 + [(1, "completed")] * 50 + [(2, "failed")] * 49 + [(2, "completed")] * 51
    got = {r.batch_id: r.status for r in S.batch_outcome(spark.createDataFrame(rows, "batch_id int, status string")).collect()}
    assert got == {1: "FAILED", 2: "COMPLETED"}


def test_grades(spark):
    hits = [(1, 0.88), (1, 0.82), (1, 0.75), (2, 0.62), (2, 0.35), (3, 0.30), (3, 0.20)]
    q = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "query_id int")
    got = R.retrieval_quality(q, spark.createDataFrame(hits, "query_id int, score double")).orderBy("query_id").collect()
    assert [(r.grade, r.hit_count) for r in got] == [("SUFFICIENT", 3), ("PARTIAL", 1), ("INSUFFICIENT", 0), ("INSUFFICIENT", 0)]


def test_mean_scores_are_exact_whatever_their_order(spark):
    r = random.Random(1)
    # Four scores of six digits whose mean lies just between two of six digits.
    scores = [x for x in ([r.randrange(10**6) for _ in range(4)] for _ in range(800)) if sum(x) % 4 == 2]
    hits = spark.createDataFrame([(i, x / 1e6) for i, four in enumerate(scores) for x in four], "query_id int, score double")
    got = {r.query_id: r.mean_score for r in R.retrieval_quality(hits, hits).collect()}
    assert got == {i: (sum(four) // 4 + 1) / 1e6 for i, four in enumerate(scores)}


def test_fusion_order(spark):
    legs = [(1, "d", 0, "a"), (1, "d", 1, "b"), (1, "s", 0, "b"), (1, "s", 1, "c")]
    got = R.rrf_fuse(spark.createDataFrame(legs, "query_id int, leg string, rank int, id string"), {"d": 1.0, "s": 1.0}).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "c"]


def test_bm25_finds_the_text(spark):
    chunks = spark.createDataFrame([("t", 1, "贴现利率按市场报价执行"), ("t", 2, "背书应当连续"), ("t", 3, "承兑人到期付款")], "tenant_id string, chunk_id int, content string")
    q = spark.createDataFrame([(1, "贴现利率")], "query_id int, query string")
    assert R.bm25_search(q, chunks, 3).where("rank = 1").first()["chunk_id"] == 1


def test_expressions(spark):
    texts = [("出票预检一下",), ("贴现率是多少",), ("你好",), ("第一条 总则 x",), ("é" * 10,), (None,)]
    df = spark.createDataFrame(texts, "t string")
    got = df.select(E.keyword_intent(F.col("t")), E.detect_section(F.col("t")), E.truncate_bytes(F.col("t"), 7), E.count_tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == ["INTENT_AGENT_ISSUANCE", "INTENT_PRICING", None, None, None, None]
    assert got[3][1] == "第一条 总则 x"
    assert got[4][2] == "ééé"
    assert got[3][3] == 6


def test_split_bounds():
    text = "这是一个用来测试分块的句子内容。" * 30
    pieces = C.split_text(text, 128, 16)
    assert all(C.n_tokens(p) <= 128 for p in pieces)
    assert len(pieces) > 1
    assert C.split_text("", 10, 2) == []
    assert all(len(p) <= 20 for p in C.split_text("字" * 100, 10, 2))


def test_limiter_stream(spark, tmp_path):
    rows = spark.sql("select id, 1L as tenant_id, timestamp_seconds(id) as created_at from range(10)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = X.limited(stream, 2, 4).writeStream.format("memory").queryName("lim").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert [r.admitted for r in spark.sql("select * from lim order by id").collect()] == [True, True, False, False, True, True, False, False, True, True]


def test_labels_amounts_and_greetings(spark):
    rows = [("用途：货款\n备注： 无", "合同金额 1,200.5万元 整", "您好，请问"), ("x", "共 300元", "贴现利率"), (None, None, None), ("用途：" + "长" * 150, "无", "hi" * 20)]
    df = spark.createDataFrame(rows, "t string, c string, q string")
    got = df.select(E.labelled(F.col("t"), E.PURPOSE_LABELS, 100), E.labelled(F.col("t"), E.REMARK_LABELS, 200), E.stated_amount(F.col("c")), E.is_greeting(F.col("q"))).collect()
    assert [tuple(r) for r in got] == [("货款", "无", 12_005_000.0, True), (None, None, 300.0, False), (None, None, None, None), ("长" * 100, None, None, False)]


def test_json_and_masks(spark):
    df = spark.createDataFrame([('say {"a": {"b": 1}} end', "6222000011112222"), ("none", None)], "t string, a string")
    assert [tuple(r) for r in df.select(E.json_block(F.col("t")), E.masked(F.col("a"))).collect()] == [('{"a": {"b": 1}}', "6222****"), (None, None)]


def test_reused_within_its_lifetime(spark):
    r = spark.sql("select 1L id, 1 tenant_id, 'f' fingerprint, timestamp'2024-01-01 04:00:00' at union all select 2L, 1, 'f', timestamp'2024-01-01 04:00:01' union all select 3L, 2, 'f', timestamp'2024-01-01 01:00:00'")
    s = spark.sql("select 1 tenant_id, 'f' fingerprint, timestamp'2024-01-01 00:00:00' at, 'kept' result")
    got = {x.id: (x.result, x.reused) for x in U.reuse_results(r, s, "audit").collect()}
    assert got == {1: ("kept", True), 2: (None, False), 3: (None, False)}


def test_markdown_of_rows(spark):
    rows = spark.createDataFrame([(1, 1, ["1", None]), (1, 0, ["a", "b"])], "doc_id long, row_idx int, cells array<string>")
    assert K.rows_to_markdown(rows, "doc_id").first()["markdown"] == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_files_and_stored_chunks(spark, tmp_path):
    for name in ("b.PDF", "a.docx", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    files = K.with_md5(K.scan_files(spark, str(tmp_path))).collect()
    assert [f.path.rpartition("/")[2] for f in files] == ["a.docx", "b.PDF"]
    assert files[0].md5_hash == "9dd4e461268c8034f5c8564e155c67a6"
    new = spark.createDataFrame([(1, 0), (1, 1), (1, 1)], "doc_id long, chunk_index int")
    assert K.missing(new, new.where("chunk_index = 0"), "doc_id", "chunk_index").count() == 1


def test_critical_failure_ends_a_task(spark):
    t = spark.createDataFrame([(1, "full_audit", ["compliance_retrieval"]), (2, "discount_apply", ["contract_review"]), (3, "other", None)], "task_id int, task_type string, failed_nodes array<string>")
    got = {r.task_id: (len(r.produced), r.failed) for r in T.audit_plan(t).collect()}
    assert got == {1: (4, True), 2: (5, True), 3: (8, False)}


def test_streams_into_tables(spark, tmp_path):
    rows = spark.sql("select id as doc_id, 0 as element_idx, repeat('word ', 60) as content, 'text' as element_type from range(3)")
    for i in range(2):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    X.into_chunks(stream, C.chunk_documents, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_long_texts_are_split_a_slice_at_a_time(spark):
    import pyarrow as pa

    from draftlake.operators import chunking as C

    texts = ["a" * 300, None, "", "b" * 5000, "票" * 100, *["c" * 90] * 50, None]
    parts = [p.to_pylist() for p in C.slices(pa.array(texts), 1000)]
    assert sum(parts, []) == texts and len(parts) > 5
    assert all(sum(len((t or "").encode()) for t in p[1:]) < 1000 for p in parts)
    assert list(C.slices(pa.array([], pa.string()))) == []
    long = "word " * 30_000
    rows = [(i, 0, [long, None, "", "one two three"][i % 4], "text") for i in range(40)]
    got = C.chunk_documents(spark.createDataFrame(rows, "doc_id int, element_idx int, content string, element_type string"), least=1).groupBy("doc_id").count().collect()
    said = {i: len(C.split_text(t or "", 512, 64)) for i, _, t, _ in rows}
    assert dict(map(tuple, got)) == {i: n for i, n in said.items() if n}
