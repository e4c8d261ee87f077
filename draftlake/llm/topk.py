"""Exact top-k inner products by pivot-table elimination (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import cut, read, shuffle_parts, tidy

PIVOTS = 64
#: Vectors packed into one row of a table, and bytes of vectors that a task holds at most.
PACKED, HELD = 1024, 48 << 20


def usable(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """(k, v): key and vector of doubles, without null vectors and those with null or non-finite
    components."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(key).alias("k"), v.alias("v")).where(F.col("v").isNotNull() & ~bad)


class Table:
    """Vectors of one length with their distances to the pivots.

    With one more coordinate that makes all vectors as long as ``big``, the inner product is
    (|q|^2 + big^2 - d^2) / 2 for the distance d, and |d(q,p) - d(x,p)| <= d for every pivot p.
    So the greatest difference bounds the score from above. Distances are 32-bit numbers; the bound
    is raised by more than their rounding.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, reach: np.ndarray, big: float):
        self.ids, self.rows, self.big = ids, rows, big
        self.reach = np.ascontiguousarray(reach.T)  # a row for each pivot
        self.evaluated = 0

    def nearest(self, query: np.ndarray, own: int, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, ties to the smaller id, the query's own left out.

        Rows are evaluated in the order of their bounds, in growing steps, until the k-th score found
        exceeds all bounds left.
        """
        least = np.zeros(len(self.ids), np.float32)
        for far, r in zip(self.reach, reach, strict=True):
            np.maximum(least, np.abs(far - r), out=least)
        whole = query @ query + self.big * self.big
        bound = (whole - least.astype(np.float64) ** 2) / 2 + 1e-5 * whole + 1
        left, step = np.flatnonzero(self.ids != own), 4 * k
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        rows, query = (self.rows, query) if whole < 2**51 else (self.rows.astype(object), query.astype(object))
        while len(left):
            if 2 * step < len(left):
                at = np.argpartition(-bound[left], step)
                part, left = left[at[:step]], left[at[step:]]
            else:
                part, left = left, left[:0]
            self.evaluated += len(part)
            ids, scores = np.append(ids, self.ids[part]), np.append(scores, rows[part] @ query)
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                left = left[bound[left] >= float(scores[-1])]
            step *= 8
        return ids, scores


def distances(vectors: np.ndarray, pivots: list[np.ndarray], big: float, asked: bool = False) -> np.ndarray:
    """Distances from each vector to each pivot of its length, with the added coordinate, which is 0
    for queries."""
    lift = lambda x: np.sqrt(np.maximum(0, big * big - (x * x).sum(axis=-1)))
    points = np.stack([p for p in pivots if len(p) == vectors.shape[1]] or [np.zeros(vectors.shape[1])])
    squares = (vectors * vectors).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * vectors @ points.T
    added = np.zeros(len(vectors)) if asked else lift(vectors)
    return np.sqrt(np.maximum(0, squares + (added[:, None] - lift(points)) ** 2)).astype(np.float32)


COLUMNS = "kind int, width int, ids binary, vectors binary, reach binary"


def packed(table: DataFrame, kind: int, pivots, big: float) -> DataFrame:
    """Rows of ``COLUMNS``, each with up to ``PACKED`` vectors of one length and their pivot table,
    which is worked out here and nowhere else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            at = at - at[0]
            widths = np.diff(at)
            for width in np.unique(widths).tolist():
                here = np.flatnonzero(widths == width)
                for i in range(0, len(here), PACKED):
                    part = here[i : i + PACKED]
                    v = flat[at[part][:, None] + np.arange(width)]
                    data = [ids[part].astype("<i8"), v, distances(v, pivots.value, big, bool(kind))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind], pa.int32()), pa.array([width], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in data)],
                        ["kind", "width", "ids", "vectors", "reach"],
                    )

    return table.mapInArrow(tidy(run), COLUMNS)


def _visits(batches: Iterator[pa.RecordBatch], big: float, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of (stripe, columns), in order of stripe, kind and width: a stripe's vectors are held,
    then its queries come by."""
    now, held, table = None, [], None
    for batch in batches:
        for stripe, kind, width, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (stripe, width) != now:
                now, held, table = (stripe, width), [], None
            ids = np.frombuffer(data[0], "<i8")
            part = ids, np.frombuffer(data[1], "<f8").reshape(len(ids), width), np.frombuffer(data[2], "<f4").reshape(len(ids), -1)
            if not kind:
                held.append(part)
                continue
            if held:
                table, held = Table(*map(np.concatenate, zip(*held, strict=True)), big), []
            if table is None:
                continue
            found = [(own, *table.nearest(q, own, r, k)) for own, q, r in zip(*part, strict=True)]
            n = [len(x) for _, x, _ in found]
            columns = [np.repeat([own for own, _, _ in found], n), *(np.concatenate([x[i] for x in found]) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["query_id", "k", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """For each query row the k rows of highest inner product: query_id, rank, key and score.

    Vectors must hold whole numbers (as doubles) and keys must be integers. Ties go to the smaller
    key; a row whose key is the query's own is left out; fewer rows give fewer ranks. Null keys,
    null vectors and those with null or non-finite components take no part; vectors of different
    lengths are not compared, empty ones score 0 with each other. Rows that repeat a key are
    candidates each, and a key's smallest vector is its query. Other columns are not looked at; empty
    tables give no rows.

    Vectors are packed with their distances to the pivots and dealt into stripes, as many as keep
    a task's part under ``HELD`` bytes. Packed queries are sent to every stripe by a shuffle, a
    stripe gives at most k rows a query, and a window over those ranks them. Of the vectors only
    the pivots, a sample of fixed size, reach the driver.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vector, key).where(F.col("k").isNotNull())
    wanted = usable(queries, vector, key).where(F.col("k").isNotNull()).groupBy("k").agg(F.min("v").alias("v"))
    # The pivots are the rows of smallest hash.
    sample = rows.orderBy(F.xxhash64("k", "v"), "k").limit(pivots).collect()
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    both = rows.select("v").unionByName(wanted.select("v"))
    longest, size = both.agg(F.max(norm), F.sum(8.0 * F.size("v") + 4.0 * pivots + 8)).first()
    big = float(np.sqrt(longest or 0.0))
    sent = spark.sparkContext.broadcast([np.array(r["v"]) for r in sample])
    stripes = max(shuffle_parts(spark), -(-int(size or 0) // HELD))

    held = packed(rows, 0, sent, big).withColumn("stripe", F.pmod(F.xxhash64("ids"), F.lit(stripes)).cast("int"))
    asked = cut(packed(wanted, 1, sent, big)).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    dealt = held.unionByName(asked).select("stripe", "kind", "width", "ids", "vectors", "reach")
    dealt = dealt.repartition(stripes, "stripe").sortWithinPartitions("stripe", "width", "kind")
    found = dealt.mapInArrow(tidy(lambda b: _visits(b, big, k)), "query_id long, k long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "k")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("k").alias(key), "score")


def op7_topk(spark, sf_dir):
    # floor gives a long, also of NaN and infinity: such rows go before it.
    sound = usable(read(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    whole = F.transform("v", lambda x: F.floor(x * 1024).cast("double"))
    vectors = sound.select(F.col("k").alias("vec_id"), whole.alias("embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
