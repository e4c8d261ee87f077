"""N-gram Jaccard join by a MinHash LSH forest with exact verification (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import Words, byte_slices, cut, mixed, read, shuffle_parts, text_bytes, text_or_empty, tidy, words_of
from draftlake.llm.graph import components

WIDTH, SIMILARITY = 5, 0.8
#: Tries of the forest, and the levels of each; a level is one byte of a 64-bit path.
TREES, LEVELS, RECALL = 24, 8, 0.9995
#: Texts compared with each other in one go; larger groups are compared block by block.
BLOCK = 128
#: Bytes of names of texts that are sent to every task at most; beyond, they are joined by a shuffle.
SENT = 32 << 20


def shingle_lists(raw: np.ndarray, at: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of all runs of ``width`` words; a shorter text is
    one run, one without words has none."""
    w: Words = words_of(raw, at)
    h, first = w.hash, np.searchsorted(w.text, np.arange(len(at)))
    whole = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for i in range(width):
        whole = whole * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(whole)]
    whole = mixed(whole)
    out = []
    for i, j in zip(first, first[1:], strict=False):
        if j - i >= width:
            out.append(np.unique(whole[i : j - width + 1]))
        else:
            short = np.zeros(min(1, j - i), np.uint64)
            for x in h[i:j]:
                short = short * np.uint64(0x9E3779B97F4A7C15) + x
            out.append(mixed(short))
    return out


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    return shingle_lists(*text_bytes(pa.array([text])), width)[0]


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, np.uint64)


def paths(sets: np.ndarray, trees: int = TREES, levels: int = LEVELS) -> np.ndarray:
    """For each trie the set's path: a byte of a MinHash for every level, the root's first."""
    a, b = _permutations(trees * levels)
    least = np.full(trees * levels, 2**64 - 1, np.uint64)
    for i in range(0, len(sets), 512):
        least = np.minimum(least, (sets[i : i + 512, None] * a + b).min(axis=0))
    return np.ascontiguousarray((mixed(least) >> np.uint64(56)).astype(np.uint8).reshape(trees, levels)[:, ::-1]).view("<u8").ravel()


def meet_chance(similarity, depth, trees: int = TREES):
    """How likely two sets share the first ``depth`` levels in some trie."""
    return 1 - (1 - similarity**depth) ** trees


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype("int32")
    values = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _set_id(s: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).view(np.int64))


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(k, row, set, paths): for each document, a hash of its shingle set and its paths in the tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            raw, at = text_bytes(batch.column(2))
            for i, j in byte_slices(at):
                for s in shingle_lists(raw[at[i] : at[j]], at[i : j + 1] - at[i], width):
                    ids.append(_set_id(s) if len(s) else None)
                    found.append(paths(s) if len(s) else s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), _lists(found)], ["k", "row", "set", "paths"])

    kind = dict(docs.dtypes)[key]
    return keyed(docs, key, text).mapInArrow(tidy(run), f"k {kind}, row long, set long, paths array<long>")


def forest(sets: DataFrame) -> DataFrame:
    """(tree, path, set, part) of all sets, sorted: a range of each trie's leaves in every partition.

    Sorting is by path and then set, so that even one path that a third of all sets share is dealt
    over partitions. The sorted table is written once and read for every depth."""
    leaves = sets.select("set", F.posexplode("paths").alias("tree", "path"))
    parts = shuffle_parts(sets.sparkSession)
    return cut(leaves.repartitionByRange(parts, "tree", "path", "set").sortWithinPartitions("tree", "path", "set").withColumn("part", F.spark_partition_id()))


def meetings(leaves: DataFrame, depth: int) -> DataFrame:
    """Edges (u, v) that join all sets below each node of that depth: every set of a run of leaves
    that share their first ``depth`` levels with the run's first set.

    Runs are found in one pass over the sorted leaves. A run that goes on in the next partitions
    begins anew there; the first sets of its parts are joined by the node that they share.
    """
    drop = np.uint64(8 * (LEVELS - depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # tree, node and first set of the run that goes on
        for batch in batches:
            tree, path, sets = (batch.column(i).to_numpy() for i in range(3))
            if not len(tree):
                continue
            node = path.view(np.uint64) >> drop
            new = np.append(True, (tree[1:] != tree[:-1]) | (node[1:] != node[:-1]))
            goes_on = last is not None and last[:2] == (tree[0], node[0])
            first = sets[np.flatnonzero(new)[np.cumsum(new) - 1]]
            if goes_on:
                first = np.where(np.cumsum(new) == 1, last[2], first)
            here = first != sets
            nothing = np.zeros(here.sum(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(sets[here]), pa.array(first[here]), pa.array(nothing - 1), pa.array(nothing.astype(np.int64))], names)
            edge = [0] if last is None else []
            if edge:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (first[:1], first[:1], tree[:1].astype(np.int32), node[:1].view(np.int64))], names)
            last = tree[-1], node[-1], first[-1]
        if last is not None:
            end = np.array(last[2]).reshape(1), np.array(last[2]).reshape(1), np.array([last[0]], np.int32), np.array([last[1]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in end], names)

    names = ["u", "v", "tree", "node"]
    found = cut(leaves.select("tree", "path", "set").mapInArrow(tidy(run), "u long, v long, tree int, node long"))
    # Two rows for each partition: the runs at its ends.
    ends = found.where("tree >= 0")
    firsts = ends.groupBy("tree", "node").agg(F.min("u").alias("least"))
    over = ends.join(F.broadcast(firsts), ["tree", "node"]).where("u != least").select("u", F.col("least").alias("v"))
    return found.where("tree < 0").select("u", "v").unionByName(over)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, row, t): row hashes key and text, so only rows alike in both share it."""
    return docs.select(F.col(key).alias("k"), F.xxhash64(F.col(key), text_or_empty(text)).alias("row"), text_or_empty(text).alias("t"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(column[-1]) + 1, 4096):
        at = slice(*np.searchsorted(column, [low, low + 4096]))
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[at], column[at] - low] = 1
        both += (m @ m.T).astype(np.int64)  # a product's numbers are 4,096 at most
    return both


def smallest(hit: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each set the smallest id among those it is linked with, directly or through others here.

    ``hit`` is symmetric, with an empty diagonal."""
    least = ids
    while True:
        near = np.where(hit, least[None, :], least[:, None]).min(axis=1)
        if (near == least).all():
            return least
        least = near


def _compare(batches: Iterator[pa.RecordBatch], similarity: float, depth: int) -> Iterator[pa.RecordBatch]:
    """Groups of rows (group, low, high, block, set, copies, shingles), in order: one row for each
    set that has a link: its linked copies here, the smallest set of its component here, and what
    its links tell of links not seen. The edges to the smallest set span the links of the block, so
    no component falls apart. Links tell for each depth how many links would not meet there: a link
    that meets at this depth with chance p stands for 1 / p of them."""
    depths, least = np.arange(1, LEVELS + 1), Fraction(str(similarity))

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        low, high = rows[0][1], rows[0][2]
        sides = np.array([r[3] for r in rows])
        ids = np.array([r[4] for r in rows], np.int64)
        weight = np.array([r[5] for r in rows], np.int64)
        sets = [r[6].view(np.uint64) for r in rows]
        both, sizes = overlaps(sets), np.array([len(x) for x in sets])
        union = sizes[:, None] + sizes[None, :] - both
        # In whole numbers, so a pair just below the similarity is never linked.
        hit = least.denominator * both >= least.numerator * union
        np.fill_diagonal(hit, False)
        if low != high:
            hit &= sides[:, None] != sides[None, :]
        links = hit @ weight
        lowest = smallest(hit, ids)
        some = links > 0
        near = np.clip(both[hit] / union[hit], similarity, 1.0)
        stands = 1 / meet_chance(near, depth)
        unseen = [float((stands * (1 - meet_chance(near, d))).sum()) for d in depths] + [float(stands.sum())]
        told = [np.append(x, np.zeros(max(0, some.sum() - 1)))[: some.sum()] for x in unseen]
        flat = np.stack(told, axis=1).ravel() if some.any() else np.zeros(0)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(flat), LEVELS + 1).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(lowest[some]), lists], ["set", "links", "least", "unseen"])

    now, rows = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        lists = batch.column(6)
        flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        for i, row in enumerate(zip(*columns, strict=True)):
            if row[:3] != now and rows:
                yield settle(rows)
                rows = []
            now = row[:3]
            rows.append((*row, flat[offsets[i] : offsets[i + 1]].copy()))
    if rows:
        yield settle(rows)


def compared(docs: DataFrame, text: str, key: str, width: int, sets: DataFrame, meet: DataFrame, similarity: float, depth: int) -> DataFrame:
    """(set, links, least, unseen): see ``_compare``, over all groups that ``meet`` joins."""
    groups = components(meet).select(F.col("node").alias("set"), F.col("root").alias("group"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    wanted = cut(groups.join(sizes, "group").join(sets.select("set", "row", "copies"), "set"))
    named = wanted.select("row", "group", "size", "set", "copies")
    texts = keyed(docs, key, text).join(F.broadcast(named) if 40 * wanted.count() <= SENT else named, "row")
    texts = texts.select("group", "size", "set", "copies", "t")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(4))
            for i, j in byte_slices(at):
                parts = shingle_lists(raw[at[i] : at[j]], at[i : j + 1] - at[i], width)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:4]), _lists(parts)], ["group", "size", "set", "copies", "shingles"])

    full = texts.mapInArrow(tidy(shingled), "group long, size long, set long, copies long, shingles array<long>")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    dealt = full.withColumn("blocks", blocks).withColumn("block", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "set", "copies", "shingles")
    dealt = dealt.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "set")
    # Rows alike in key and text give one set more than once.
    return dealt.mapInArrow(tidy(lambda b: _compare(_once(b), similarity, depth)), "set long, links long, least long, unseen array<double>")


def depth_enough(found: DataFrame, depth: int, recall: float) -> int:
    """The deepest level, not under ``depth``, whose share of links not met is at most 1 - recall."""
    sums = found.agg(*(F.sum(F.get("unseen", F.lit(i))).alias(f"d{i}") for i in range(LEVELS + 1))).first()
    total = sums[LEVELS] or 0.0
    for d in range(depth, 1, -1):
        if (sums[d - 1] or 0.0) <= (1 - recall) * total:
            return d
    return 1


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row for each document: (k, row, root, class, links).

    Two documents are linked if the Jaccard similarity of their sets of word shingles is at least
    ``similarity``; class is the smallest key that a document is linked with, directly or through
    others, and links counts the other documents linked directly, copies included. Texts are split
    at ASCII white space, as they are; a text of fewer words than ``width`` is one shingle.

    Documents with equal sets are one set with a weight. Sets that share a prefix of ``depth``
    levels in one of the forest's sorted tries are candidates, joined into groups; within a group
    all sets are compared exactly, in blocks of ``BLOCK`` so that no task gets a large group, and
    only sums for each set leave a task. The matched prefix begins at all levels; the links found
    tell how many are likely to be missed at it, and it is shortened until that share is at most
    1 - ``recall``. Null,
    empty and blank texts have no shingles: no links, and a class of their own. Rows alike in key
    and text count as copies; a class of null keys alone is named by a hash; other columns are not
    looked at; an empty table gives no rows. Keys may be of any type; class is a string where they are
    no whole numbers. Documents of one key and different texts can have one
    class's name without being linked; root tells classes apart.
    """
    signed = cut(signatures(docs, key, text, width))
    sets = signed.where(F.col("set").isNotNull()).groupBy("set").agg(
        F.min("row").alias("row"), F.min("k").alias("k"), F.count("*").alias("copies"), F.first("paths").alias("paths")
    )
    leaves = forest(sets)
    slim = cut(sets.select("set", "row", "k", "copies"))
    depth = LEVELS
    while True:
        found = cut(compared(docs, text, key, width, slim, meetings(leaves, depth), similarity, depth))
        enough = depth_enough(found, depth, recall)
        if enough >= depth:
            break
        depth = enough

    sets = slim
    totals = found.groupBy("set").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("set").alias("u"), F.col("least").alias("v")))
    classed = sets.select("set", "k", "copies").join(totals, "set", "left").join(roots.select(F.col("node").alias("set"), "root"), "set", "left")
    classed = classed.withColumn("root", F.coalesce("root", "set")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    names = classed.groupBy("root").agg(F.min("k").alias("class"))
    # Whole numbers name classes as they are; other keys as strings.
    kind = "bigint" if dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint") else "string"
    named = lambda *names: F.coalesce(*(F.col(x).cast(kind) for x in names)).alias("class")
    classed = classed.join(names, "root").select("set", "root", named("class", "root"), "links")
    return signed.select("k", "row", "set").join(classed, "set", "left").select(
        "k", "row", F.coalesce("root", "row").alias("root"), named("class", "k", "row"), F.coalesce("links", F.lit(0)).alias("links")
    )


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leave out rows that repeat the set before them in the same group and blocks."""
    last = None
    for batch in batches:
        keep = []
        for at in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            keep.append(at != last)
            last = at
        yield batch if all(keep) else batch.filter(pa.array(keep))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class: that of the smallest key, then smallest hash.

    Of rows alike in key and text one stays. Documents without words are classes of their own, but
    repeated rows among them count as copies too.
    """
    found = cut(near_copies(docs, text, key))
    first = found.groupBy("root").agg(F.min(F.struct("k", "row")).alias("first"))
    rows = found.groupBy("row").agg(F.min("root").alias("root"), F.count("*").alias("n"))
    flags = rows.join(first, "root").select(F.col("row").alias("__row"), (F.col("first.row") != F.col("row")).alias("__gone"), (F.col("n") > 1).alias("__many"))
    flags = cut(flags.where("__gone or __many"))
    if 24 * flags.count() <= SENT:
        flags = F.broadcast(flags)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.xxhash64(F.col(key), text_or_empty(text)).alias("__row"))
    marked = whole.join(flags, "__row", "left")
    single = marked.where(F.col("__gone").isNull()).select("d")
    repeated = marked.where(~F.col("__gone") & F.col("__many")).dropDuplicates(["__row"]).select("d")
    return single.unionByName(repeated).select(*(F.col("d").getField(c).alias(c) for c in docs.columns))


def op3_ngram_join(spark, sf_dir):
    found = near_copies(read(spark, sf_dir, "documents"))
    return found.select(F.col("k").alias("doc_id"), F.col("class").alias("class_id"), F.col("links").alias("n_links"), "root")
