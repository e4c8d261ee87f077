"""Ranked retrieval: keyword and vector search per tenant, fusion and grading."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from draftlake.functions import exprs as E
from draftlake.functions import segment
from draftlake.functions.segment import Words
from draftlake.operators import keywords
from draftlake.operators.keywords import asked_tokens, best_in_parts, few_tokens, packed_postings, postings_of, ranked_chunks, term_totals, totals_and_postings, with_idf
from draftlake.session import shared_folder

# Tasks get these modules' functions by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(keywords)
cloudpickle.register_pickle_by_value(segment)
#: Queries, and vectors (about), that meet in one task at a time.
QUERY_BLOCK, VECTOR_PART = 512, 4096
#: The same for a search in cells, which goes through them in the sizes above.
CELL_QUERIES, CELL_VECTORS = 1 << 16, 1 << 17


#: Lower-case words and single CJK characters.
tokens = Words(segment.pieces)


def bm25_index(chunks: DataFrame, words: Words = tokens) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, terms, stats): tf and length; document frequency and idf; size and mean length.

    A negative idf is replaced by a quarter of the tenant's mean idf. Document frequencies and
    lengths come from one reading of the texts, added up before the shuffle, not from the postings.
    """
    df, sizes, _ = term_totals(chunks, words)
    stats = sizes.select("tenant_id", "n_docs", (F.col("total") / F.when(F.col("read") > 0, F.col("read"))).alias("avgdl"))
    return postings_of(chunks, words), with_idf(df, stats), stats


def bm25_search(queries: DataFrame, chunks: DataFrame, k: int, words: Words = tokens, told: bool = False) -> DataFrame:
    """(query_id, tenant_id, chunk_id, score, rank): Okapi scores over the best of each query.

    Queries (query_id, query) go to every tenant, or to their own where they have a tenant_id.
    Chunks without any of a query's tokens score 0 and fill the ranks that are left. Postings are
    searched as ``keywords.ranked_chunks`` says; with ``told`` it tells how many were read.
    """
    shared_folder(chunks.sparkSession)
    only = few_tokens(queries.select(F.explode(words(F.coalesce("query", F.lit("")))).alias("token")))
    # Texts are read into words once, for the statistics and for the postings of the queries' tokens; others
    # are never written. What was read stays on the executors' disks until the chunks are found.
    read = None if only is None else totals_and_postings(chunks, words, only).persist(StorageLevel.DISK_ONLY)
    try:
        df, sizes, spread = term_totals(chunks, words, only, read)
        stats = sizes.select("tenant_id", "n_docs", (F.coalesce("total", F.lit(0)) / F.col("n_docs")).alias("avgdl")).checkpoint()
        packed = None if only is None else packed_postings(chunks, words, only, read)
        return ranked_chunks(asked_tokens(queries, stats, words), postings_of(chunks, words, only), with_idf(df, stats, spread), stats, chunks, k, told, only, packed)
    finally:
        if read is not None:
            read.unpersist()


def _best_vectors(vectors: pa.Table, queries: pa.Table, k: int, probed: Callable[[np.ndarray], np.ndarray] | None = None) -> pa.Table:
    """The k best of vectors (chunk_id, v) for each of queries (query_id, q), all of one length. With
    ``probed``, which tells (query, cell) whether a query looks there, vectors have a cell."""
    vectors = vectors.combine_chunks().sort_by("chunk_id")
    v, q = (t[c].combine_chunks().flatten().to_numpy().reshape(len(t), -1) for t, c in ((vectors, "v"), (queries, "q")))
    cell, out = None if probed is None else vectors["cell"].to_numpy(), []
    for i in range(0, len(q), QUERY_BLOCK):
        block = q[i : i + QUERY_BLOCK]
        open_, least, found = None if probed is None else probed(block), np.full(len(block), -np.inf), []
        for a in range(0, len(v), VECTOR_PART):
            score = block @ v[a : a + VECTOR_PART].T
            if open_ is not None:
                score[~open_[:, cell[a : a + VECTOR_PART]]] = -np.inf
            if score.shape[1] > k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
            # Scores that are equal when rounded stay, for ties go by chunk.
            at, place = np.nonzero((score >= least[:, None] - 2e-6) & ~np.isneginf(score))
            found.append((at, place + a, score[at, place]))
        at, place, raw = (np.concatenate(x) for x in zip(*found, strict=True))
        # Vectors are in order, so places settle ties by chunk.
        order = np.lexsort((place, -np.round(raw, 6), at))
        order = order[np.arange(len(at)) - np.searchsorted(at[order], at[order]) < k]
        out.append((at[order] + i, place[order], raw[order]))
    at, place, raw = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"query_id": queries["query_id"].take(pa.array(at)), "chunk_id": vectors["chunk_id"].take(pa.array(place)), "score": raw})


def dense_search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Per query the k vectors of its tenant with the highest inner product of unit vectors.

    A tenant's vectors are dealt into parts and the queries into blocks; each part meets each block
    once and hands on its k best for each query. Vectors that are null or hold a null take no part;
    a query meets vectors of its own length.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())
    sizes = vectors.groupBy("tenant_id").agg(F.ceil(F.count("*") / VECTOR_PART).cast("int").alias("parts"))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    q = queries.where(whole).join(sizes, "tenant_id").select(
        "query_id", F.col("tenant_id").alias("tenant"), E.normalised("embedding").alias("q"), F.size("embedding").alias("width"), block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    part = F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int").alias("part")
    v = vectors.where(whole).join(sizes, "tenant_id").select(
        "chunk_id", F.col("tenant_id").alias("tenant"), E.normalised("embedding").alias("v"), F.size("embedding").alias("width"), part, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    fields = queries.schema["query_id"], vectors.schema["tenant_id"], vectors.schema["chunk_id"]
    schema = StructType([StructField(f.name, f.dataType) for f in fields]).add("score", "double")
    empty = to_arrow_schema(schema)

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty.empty_table()
        best = _best_vectors(left, right, k)
        return best.append_column("tenant_id", pa.repeat(key[0], len(best))).select(empty.names).cast(empty)

    keys = ("tenant", "width", "part", "block")
    s = v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(run, schema).withColumn("score", F.round("score", 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return s.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def rrf_fuse(legs: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """Sum of weight / (k + rank + 1) over legs (query_id, leg, rank from 0, id)."""
    w = F.lit(0.0)
    for leg, x in weights.items():
        w = F.when(F.col("leg") == leg, x).otherwise(w)
    order = list(weights)
    first = F.struct(F.array_position(F.array(*map(F.lit, order)), F.col("leg")).alias("leg"), F.col("rank"))
    g = legs.groupBy("query_id", "id").agg(F.sum(w / (k + F.col("rank") + 1)).alias("raw"), F.min(first).alias("first"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("raw", 9)), "first", "id")
    return g.select("query_id", "id", F.round("raw", 6).alias("score"), F.row_number().over(best).alias("rank"))


def retrieval_quality(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Grade of each query's scores; queries without hits are insufficient."""
    # Added up as decimals, since sums of doubles depend on their order, and means can lie between two of six digits.
    mean = F.sum(F.col("score").cast("decimal(30,12)")).cast("double") / F.count("score")
    g = hits.groupBy("query_id").agg(F.max("score").alias("top1"), mean.alias("mean"), F.count_if(F.col("score") >= 0.40).alias("n"))
    j = queries.select("query_id").distinct().join(g, "query_id", "left")
    top, n = F.coalesce("top1", F.lit(0.0)), F.coalesce("n", F.lit(0))
    grade = F.when((top >= 0.75) & (n >= 2), "SUFFICIENT").when((top >= 0.55) & (n >= 1), "PARTIAL").otherwise("INSUFFICIENT")
    return j.select("query_id", F.round(top, 6).alias("top1"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean_score"), n.alias("hit_count"), grade.alias("grade"))


def with_reranked(hits: DataFrame, n: int = 5, scorer: Column | None = None, *by: str) -> DataFrame:
    """The n best hits of each query (and ``by``) with rerank_score. Without a scorer the order stays
    and the scores are 1, 1/2, 1/3, ...; a scorer orders them anew, ties by the rank before."""
    if scorer is None:
        return hits.where(F.col("rank") <= n).withColumn("rerank_score", F.round(1.0 / F.col("rank"), 6))
    best = Window.partitionBy("query_id", *by).orderBy(F.desc("rerank_score"), "rank")
    scored = hits.withColumn("rerank_score", F.round(scorer, 6))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def sparse_search(queries: DataFrame, weights: DataFrame, k: int, dropped: float = 0.2, chunks: DataFrame | None = None) -> DataFrame:
    """Per query and tenant the k chunks with the highest inner product of token weights.

    Queries (query_id, token, weight) leave out their lowest weights, a fifth of them rounded
    down; chunks are (tenant_id, chunk_id, token, weight), of which weights of 0 or less are left
    out. A token that all chunks have is dealt out with the chunks (``keywords.best_in_parts``).
    Tenants' sizes are counted in ``chunks`` (tenant_id, ...) if given, so that weights are worked out once.
    """
    low = Window.partitionBy("query_id").orderBy("weight", "token")
    q = queries.withColumns({"r": F.row_number().over(low), "n": F.count("*").over(Window.partitionBy("query_id"))})
    q = q.where(F.col("r") > F.floor(F.col("n") * dropped)).select("query_id", "token", F.col("weight").alias("qw"))
    shared_folder(weights.sparkSession)
    weights = weights.where("weight > 0")
    number = F.approx_count_distinct("chunk_id") if chunks is None else F.count("*")
    sizes = (weights if chunks is None else chunks).groupBy(F.col("tenant_id").alias("tenant")).agg(F.ceil(number / keywords.CHUNK_PART).cast("int").alias("parts")).checkpoint()
    q = q.groupBy("query_id", "token").agg(F.sum("qw").alias("w")).crossJoin(F.broadcast(sizes.select("tenant")))
    postings = weights.select(F.col("tenant_id").alias("tenant"), "chunk_id", "token", F.col("weight").alias("impact"), F.lit(0.0).alias("rate"))
    found = best_in_parts(q, postings, sizes, k, digits=6)[0]
    s = found.select("query_id", "tenant_id", "chunk_id", F.round(F.round("raw", 9), 6).alias("score"))
    best = Window.partitionBy("query_id", "tenant_id").orderBy(F.desc("score"), "chunk_id")
    return s.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hybrid_search(legs: dict[str, DataFrame], weights: dict[str, float], k: int = 20) -> DataFrame:
    """Legs (query_id, tenant_id, chunk_id, rank from 1) fused per query and tenant; the best k."""
    both = None
    for name, leg in legs.items():
        rows = leg.select(F.struct("query_id", "tenant_id").alias("query_id"), F.lit(name).alias("leg"), (F.col("rank") - 1).alias("rank"), F.col("chunk_id").alias("id"))
        both = rows if both is None else both.unionByName(rows)
    fused = rrf_fuse(both, weights).where(F.col("rank") <= k)
    return fused.select("query_id.query_id", "query_id.tenant_id", F.col("id").alias("chunk_id"), "score", "rank")


def cells_for(n: int) -> int:
    """As many cells as a cell has vectors: so both the centres and a cell grow with the root of n."""
    return max(16, min(1 << 14, math.isqrt(max(1, n))))


def ivf_search(queries: DataFrame, vectors: DataFrame, k: int, nlist: int | None = None, share: float = 0.6, sample: int = 50_000) -> DataFrame:
    """The k best unit vectors for each query among the nearest ``share`` of cells.

    Centres are fitted on about ``sample`` vectors; every vector is put into the cell of its
    nearest centre. Only the centres are known to all tasks. Vectors are dealt into parts that meet
    blocks of queries once; a task works out anew in which cells a query looks, and takes only the
    scores of those. Data without clusters need a large share: it is measured against all vectors.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())
    queries, vectors = queries.where(whole), vectors.where(whole)
    total = vectors.count()
    nlist = nlist or cells_for(total)
    v = vectors.withColumn("v", E.normalised("embedding")).withColumn("features", array_to_vector("v"))
    part = min(1.0, sample / max(1, total))
    model = KMeans(k=nlist, seed=1, maxIter=10).fit(v.sample(part, seed=1) if part < 1 else v)
    centres = np.stack(model.clusterCenters())
    nprobe = max(1, math.ceil(share * len(centres)))

    def probed(q: np.ndarray) -> np.ndarray:
        near = q @ centres.T - (centres**2).sum(1) / 2
        out = np.zeros(near.shape, bool)
        np.put_along_axis(out, np.argsort(-near, axis=1, kind="stable")[:, :nprobe], True, axis=1)
        return out

    # Few vectors still make some parts, so that all cores have work.
    parts = max(-(-total // CELL_VECTORS), min(64, -(-total // VECTOR_PART)), 1)
    blocks = max(1, -(-queries.count() // CELL_QUERIES))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = model.transform(v).select("chunk_id", F.col("prediction").alias("cell"), "v", deal("chunk_id", parts).alias("part"), every(blocks).alias("block"))
    asked = queries.select("query_id", E.normalised("embedding").alias("q"), deal("query_id", blocks).alias("block"), every(parts).alias("part"))
    schema = StructType([StructField(f.name, f.dataType) for f in (queries.schema["query_id"], vectors.schema["chunk_id"])]).add("score", "double")
    empty = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty.empty_table()
        return _best_vectors(left, right, k, probed).select(empty.names).cast(empty)

    s = cells.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(run, schema).withColumn("score", F.round("score", 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return s.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def triage(queries: DataFrame, grades: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """How each query (query_id, query) is answered, by its text and the grade of its hits."""
    j = queries.join(grades.select("query_id", "grade"), "query_id", "left")
    text, intent = F.coalesce("query", F.lit("")), E.keyword_intent(F.col("query"))
    kind = (
        F.when(E.stripped(text) == "", "guide").when(E.is_greeting(text), "greeting").when(E.is_off_topic(intent, text, words), "off_topic")
        .when(F.coalesce("grade", F.lit("INSUFFICIENT")) == "INSUFFICIENT", "transfer_human").when(F.col("grade") == "PARTIAL", "answer_with_note").otherwise("answer")
    )
    return j.select("query_id", F.coalesce(intent, F.lit("INTENT_UNKNOWN")).alias("intent_id"), kind.alias("outcome"))


def hybrid_answers(fused: DataFrame, chunks: DataFrame, *columns: str, n: int = 5, scorer: Column | None = None) -> DataFrame:
    """The n best fused hits of each query and tenant, with their chunks' columns, a rerank score and
    the grade of the tenant's hits for the query. Hits whose chunk is gone keep nulls."""
    told = fused.join(chunks.select("tenant_id", "chunk_id", *columns), ["tenant_id", "chunk_id"], "left")
    best = with_reranked(told, n, scorer, "tenant_id").withColumn("pair", F.struct("query_id", "tenant_id"))
    graded = best.select(F.col("pair").alias("query_id"), F.col("rerank_score").alias("score"))
    grades = retrieval_quality(graded, graded).select(F.col("query_id").alias("pair"), "grade")
    return best.join(grades, "pair").drop("pair")


def miss_rows(triaged: DataFrame, queries: DataFrame, grades: DataFrame) -> DataFrame:
    """(query_id, query, intent_id, top1, hit_count) of queries that are handed over for want of hits."""
    handed = triaged.where("outcome = 'transfer_human'").select("query_id", "intent_id")
    return handed.join(queries.select("query_id", "query"), "query_id").join(grades.select("query_id", "top1", "hit_count"), "query_id", "left").select(
        "query_id", "query", "intent_id", F.coalesce("top1", F.lit(0.0)).alias("top1"), F.coalesce("hit_count", F.lit(0).cast("long")).alias("hit_count")
    )


def log_rows(triaged: DataFrame, grades: DataFrame) -> DataFrame:
    """(query_id, route_type, top_k_hit, top1): how each query went. A query that was not searched has
    no hit either way; of the others those handed over have missed."""
    j = triaged.join(grades.select("query_id", "top1"), "query_id", "left")
    searched = F.col("outcome").isin("answer", "answer_with_note", "transfer_human")
    route = F.when(F.col("outcome") == "off_topic", "off_topic").when(~searched, F.col("outcome")).when(F.col("intent_id") == "INTENT_UNKNOWN", "fuzzy").otherwise("specialized")
    return j.select("query_id", route.alias("route_type"), F.when(searched, F.col("outcome") != "transfer_human").alias("top_k_hit"), F.when(searched, F.coalesce("top1", F.lit(0.0))).alias("top1"))
