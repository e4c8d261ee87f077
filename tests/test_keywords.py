"""Dictionary words against all segmentations, bounded search against all scores, and the kept index."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from draftlake.functions import segment as S
from draftlake.operators import keywords as K
from draftlake.operators import retrieval as R
from draftlake.operators import service as V


def best_cut(run, weights, single):
    """The segmentation of the greatest weight; of equal ones that with the longest first words."""
    best = None

    def go(i, total, words):
        nonlocal best
        if i == len(run):
            key = (total, [len(w) for w in words])
            if best is None or key > best[0]:
                best = (key, words)
        for k in range(1, min(5, len(run) - i + 1)):
            w = run[i : i + k]
            if w in weights or k == 1:
                go(i + k, total + weights.get(w, single), [*words, w])

    go(0, 0, [])
    return best[1]


def test_segmentation_as_all_segmentations():
    r = random.Random(1)
    words = {"".join(r.choice("票据银行汇本") for _ in range(r.choice([1, 2, 2, 3, 4]))): r.choice([5, 20, 100]) for _ in range(60)}
    weights, single = S.weights(words)
    runs = ["".join(r.choice("票据银行汇本外") for _ in range(r.randrange(9))) for _ in range(1500)] + ["票据" * 500]
    got = S.Dictionary(words).cut(runs)
    assert got[:-1] == [best_cut(x, weights, single) for x in runs[:-1]]
    assert "".join(got[-1]) == runs[-1]


def test_dictionary_tokens(spark):
    rows = [(1, "Abc 银行承兑汇票 x1 的出票人，外"), (2, None), (3, ""), (4, "only Latin 12"), (5, "，。")]
    df = spark.createDataFrame(rows, "id int, t string").repartition(2)
    got = {r.id: r.x for r in df.select("id", S.dictionary_tokens(F.col("t"), S.BILL_WORDS).alias("x")).collect()}
    assert got == {1: ["abc", "银行承兑汇票", "x1", "的", "出票人", "外"], 2: None, 3: [], 4: ["only", "latin", "12"], 5: []}
    table = spark.createDataFrame([("汇票", 5), ("汇票", 60), (None, 1), ("票", None)], "word string, frequency int")
    assert S.from_table(table) == {"汇票": 60}


CHUNKS = "tenant_id string, chunk_id long, content string"


def corpus(n, seed=3):
    r = random.Random(seed)
    words = [f"w{min(int(r.paretovariate(0.6)), 300)}" for _ in range(4000)]
    return [("ab"[i % 3 == 0], i, " ".join(r.choice(words) for _ in range(r.choice([3, 30, 200])))) for i in range(n)]


def plain_search(chunks, queries, k):
    """Okapi scores of every chunk for every query, in plain Python."""
    import math

    out = {}
    for tenant in sorted({t for t, _, _ in chunks}):
        texts = {c: (x or "").split() for t, c, x in chunks if t == tenant}
        n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
        df = {}
        for words in texts.values():
            for w in set(words):
                df[w] = df.get(w, 0) + 1
        raw = {w: math.log(n - m + 0.5) - math.log(m + 0.5) for w, m in df.items()}
        mean = sum(raw.values()) / len(raw)
        idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
        for q, text in queries:
            score = {c: 0.0 for c in texts}
            for w in text.split():
                for c, words in texts.items():
                    if tf := words.count(w):
                        score[c] += idf[w] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
            best = sorted(score, key=lambda c: (-round(score[c], 9), c))[:k]
            top = max(score[c] for c in best)
            for rank, c in enumerate(best, 1):
                out[q, tenant, rank] = (c, pytest.approx(score[c] / (top if top > 0 else 1), abs=1e-6))
    return out


def told(df):
    return {(r.query_id, r.tenant_id, r.rank): (r.chunk_id, r.score) for r in df.collect()}


QUERIES = [(1, "w1 w2 w3 w250 w77"), (2, "w299 w298"), (3, ""), (4, "nowhere"), (5, " ".join(f"w{i}" for i in range(1, 60)))]


@pytest.mark.parametrize("part, sent", [(4096, 32 << 20), (20, 0)])
def test_search_as_all_scores(spark, monkeypatch, part, sent):
    monkeypatch.setattr(K, "CHUNK_PART", part)
    monkeypatch.setattr(K, "SENT", sent)
    # A tenant of one chunk has negative weights; its only chunk, scored below 0, is still ranked.
    rows = [*corpus(150), ("c", 900, "w1 w2"), ("d", 901, "w1"), ("d", 902, "w5 w6")]
    chunks, queries = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(QUERIES, "query_id long, query string")
    assert told(R.bm25_search(queries, chunks, 10)) == plain_search(rows, QUERIES, 10)


def test_bounds_leave_postings_unread(spark):
    r = random.Random(2)
    rows = [("a", i, " ".join([f"rare{i % 100}"] * (i % 5 == 0) + [r.choice(["w", "x", "y"]) for _ in range(50)])) for i in range(4000)]
    queries = [(i, f"rare{5 * i} w x y") for i in range(10)]
    effort = R.bm25_search(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(rows, CHUNKS), 5, told=True).collect()
    assert sum(e.postings_read for e in effort) < 0.6 * sum(e.postings for e in effort)


def test_kept_index(spark, tmp_path):
    rows = [*corpus(120), ("b", 500, None)]
    df, queries = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(QUERIES, "query_id long, query string")
    whole = K.KeptIndex(spark, f"{tmp_path}/whole", R.tokens)
    whole.append(df)
    parts = K.KeptIndex(spark, f"{tmp_path}/parts", R.tokens, most=2)
    for i in range(4):
        parts.append(df.where(F.col("chunk_id") % 4 == i))
        assert len([x for x in parts.live() if x["name"] == x["segment"]]) <= 2
    want = plain_search(rows, QUERIES, 8)
    assert told(whole.search(queries, 8)) == want and told(parts.search(queries, 8)) == want
    # Deletion, twice the same, of chunks in several segments, and one that is not there.
    gone = spark.createDataFrame([(t, c) for t, c, _ in rows if c % 5 == 0] + [("a", 12345)], "tenant_id string, chunk_id long")
    left = [x for x in rows if x[1] % 5]
    for _ in range(2):
        parts.delete(gone)
        assert told(parts.search(queries, 8)) == plain_search(left, QUERIES, 8)
    # A chunk comes back with another text; a merge then leaves out for good what is gone.
    again = [("a", 5, "w1 w299 w299"), ("b", 600, "w2")]
    parts.append(spark.createDataFrame(again, CHUNKS))
    parts.append(spark.createDataFrame([("a", 7777, "w3")], CHUNKS))
    parts.append(spark.createDataFrame([("a", 7778, "w3 w4")], CHUNKS))
    now = [*left, *again, ("a", 7777, "w3"), ("a", 7778, "w3 w4")]
    assert told(parts.search(queries, 8)) == plain_search(now, QUERIES, 8)
    assert parts.alive("chunks").count() == len(now)


def test_append_reads_no_old_postings(spark, tmp_path, monkeypatch):
    index = K.KeptIndex(spark, str(tmp_path / "i"), R.tokens)
    index.append(spark.createDataFrame(corpus(20), CHUNKS))
    monkeypatch.setattr(index, "alive", lambda *a: pytest.fail("old postings were read"))
    index.append(spark.createDataFrame([("a", 1000, "w1")], CHUNKS))
    assert len(index.live()) == 2


def test_postings_are_not_multiplied_by_other_tenants_queries(spark, monkeypatch):
    monkeypatch.setattr(K, "QUERY_BLOCK", 2)
    q = spark.createDataFrame([(10 * t + i, f"t{t}", "w", 1.0) for t in range(10) for i in range(2)], "query_id long, tenant string, token string, w double")
    rows = [(f"t{t}", c, w, 1.0, 1.0) for t in range(10) for c in range(3) for w in ("w", "unasked")]
    postings = spark.createDataFrame(rows, "tenant string, chunk_id long, token string, impact double, rate double")
    sizes = spark.createDataFrame([(f"t{t}", 1) for t in range(10)], "tenant string, parts int")
    K.shared_folder(spark)
    found, each = K.best_in_parts(q, postings, sizes, 2)
    assert each.count() == 30
    assert found.count() == 40


def test_texts_are_counted_once_for_their_postings(spark):
    df = spark.createDataFrame([("a", 1, "w1 w2 w1"), ("a", 2, None), ("a", 3, "")], CHUNKS)
    postings = K.postings_of(df, R.tokens)
    assert sorted(map(tuple, postings.collect())) == [("a", 1, 3, "w1", 2), ("a", 1, 3, "w2", 1)]
    assert postings._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


@pytest.mark.parametrize("size", [1, 7, 4 << 20])
def test_pieces_as_a_pattern_finds_them(monkeypatch, size):
    monkeypatch.setattr(S, "SLICE", size)
    r = random.Random(4)
    texts = ["".join(r.choice("ab1z9 票据汇é_\n一鿿ꀀ䷿𠀀-") for _ in range(r.randrange(30))) for _ in range(400)] + ["", "票", "a", "票", "", "票a票票", "a"]
    texts = [None if i % 9 == 4 else x for i, x in enumerate(texts)]
    for joined, pattern in ((False, "[a-z0-9]+|[一-鿿]"), (True, "[a-z0-9]+|[一-鿿]+")):
        want = [None if x is None else re.findall(pattern, x) for x in texts]
        for kind in (pa.string(), pa.large_string()):
            array = pa.array(["x 票", *texts], kind)
            assert S.pieces(array.slice(1), joined).to_pylist() == want
        assert S.pieces(pa.array([None, ""], pa.string()), joined).to_pylist() == [None, []]
        assert S.pieces(pa.array([], pa.string()), joined).to_pylist() == []


def test_only_asked_tokens_leave_the_texts(spark):
    """What is read of a text ends within the task: totals come added up, postings without other tokens."""
    rows = [("a", 1, "W1 w2 w1"), ("a", 2, None), ("b", 3, ""), (None, 4, "w3"), ("b", 5, "w1 K票"), ("c", 6, None)]
    df = spark.createDataFrame(rows, CHUNKS).coalesce(1)
    assert sorted(map(tuple, K.postings_of(df, R.tokens, ["w1", "w9"]).collect())) == [("a", 1, 3, "w1", 2), ("b", 5, 3, "w1", 1)]
    K.shared_folder(spark)
    terms, stats, spread = K.term_totals(df, R.tokens)
    assert {(r.tenant_id, r.token): r.df for r in terms.collect()} == {("a", "w1"): 1, ("a", "w2"): 1, (None, "w3"): 1, ("b", "w1"): 1, ("b", "k"): 1, ("b", "票"): 1}
    assert {r.tenant_id: (r.n_docs, r.total, r.read) for r in stats.collect()} == {"a": (2, 3, 1), "b": (2, 3, 2), None: (1, 1, 1), "c": (1, None, 0)}
    assert {(r.tenant_id, r.df): r.n for r in spread.groupBy("tenant_id", "df").agg(F.sum("n").alias("n")).collect()} == {("a", 1): 2, (None, 1): 1, ("b", 1): 3}
    terms, _, spread = K.term_totals(df, R.tokens, ["w1", "k"])
    assert sorted(map(tuple, terms.collect())) == [("a", "w1", 1), ("b", "k", 1), ("b", "w1", 1)] and spread.agg(F.sum("n")).first()[0] == 6


def test_a_chunk_of_a_search_is_one_row(spark, monkeypatch):
    """Shuffled rows do not grow with the words of a chunk; blocks of queries see all of them."""
    monkeypatch.setattr(K, "QUERY_BLOCK", 2)
    rows, queries = corpus(60), [(i, f"w1 w{i} w{i + 9}") for i in range(12)]
    chunks, asked = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(queries, "query_id long, query string")
    packed = K.packed_postings(chunks, R.tokens, ["w1", "w2", "w3"])
    assert packed.count() == sum(bool({"w1", "w2", "w3"} & set(x.split())) for _, _, x in rows)
    seen, best = [], K.best_in_parts
    monkeypatch.setattr(K, "best_in_parts", lambda *a, **b: (seen.append(b.get("only")), best(*a, **b))[1])
    assert told(R.bm25_search(asked, chunks, 5)) == plain_search(rows, queries, 5)
    assert sorted(seen[0]) == sorted({w for _, x in queries for w in x.split()})


@pytest.mark.parametrize("sent", [32 << 20, 0])
def test_texts_of_hits_are_joined_where_they_are_read(spark, monkeypatch, sent):
    monkeypatch.setattr(V, "SENT", sent, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "z"), (None, 3, "n")], CHUNKS)
        hits = [(7, "a", 1, 1), (8, "a", 1, 2), (7, "b", 1, 1), (7, "b", 9, 2), (9, None, 3, 1), (9, "a", 2, 3)]
        found = V.with_metadata(spark.createDataFrame(hits, "query_id long, tenant_id string, chunk_id long, rank int"), chunks, "content")
        assert sorted((r.query_id, r.tenant_id, r.rank, r.content) for r in found.collect()) == [(7, "a", 1, "x"), (7, "b", 1, "z"), (8, "a", 2, "x"), (9, "a", 3, None)]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange hashpartitioning" in plan) == (sent == 0)
        assert V.with_metadata(found.drop("content").where("rank > 9"), chunks, "content").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_of_a_search_are_cut_once(spark):
    """One cutting serves statistics and postings, and what it gave is not kept after the search."""
    cut = spark.sparkContext.accumulator(0)

    def told_pieces(texts):
        cut.add(sum("mark" in (x or "") for x in texts.to_pylist()))
        return S.pieces(texts)

    rows = [("ab"[i % 3 == 0], i, f"mark rare{i % 8} " + "w " * (i % 5)) for i in range(120)] + [("a", 500, None), (None, 501, "rare1 mark")]
    chunks, queries = spark.createDataFrame(rows, CHUNKS), [(i, f"rare{i} rare{i}") for i in range(8)]
    kept = len(spark.sparkContext._jsc.getPersistentRDDs())
    found = told(R.bm25_search(spark.createDataFrame(queries, "query_id long, query string"), chunks, 3, S.Words(told_pieces)).where("tenant_id is not null"))
    assert cut.value == 121 and len(spark.sparkContext._jsc.getPersistentRDDs()) == kept
    assert found == plain_search([x for x in rows if x[0]], queries, 3)
    # No query has a token.
    empty = spark.createDataFrame([(1, ""), (2, None)], "query_id long, query string")
    assert told(R.bm25_search(empty, spark.createDataFrame(rows[:9], CHUNKS), 3)) == plain_search(rows[:9], [(1, ""), (2, "")], 3)
