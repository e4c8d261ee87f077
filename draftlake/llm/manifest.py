"""Merkle manifest of a dataset by a rollup of nested structs (operator 13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import cut, read, shuffle_parts

FANOUT = 16
#: Levels of the tree in a block: a block's nested row holds FANOUT ** LEVELS nodes at most.
LEVELS = 2
#: Bytes of starts of groups that are sent to every task at most; beyond, they are joined by a shuffle.
SENT = 32 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"


def leaf(fields: list[Column]) -> Column:
    """The hash of a row's fields: a dash for null, else the bytes' number, a colon and the value."""
    value = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(value(c.cast("string")) for c in fields)), 256)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (g, ...) with rank, from 0 in the order of columns within g, and n, the rows of g.

    Rows are dealt out by ranges of g and ``order``, so a large g is spread over many tasks; the
    numbers of rows of each g in each range give what stands before.
    """
    keys = [F.asc_nulls_first(c) for c in ("g", *order)]
    dealt = rows.repartitionByRange(shuffle_parts(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    # The number of a row's range, then its place there.
    dealt = cut(dealt.withColumn("place", F.monotonically_increasing_id())).withColumn("range", F.shiftright("place", 33))
    parts = dealt.groupBy("g", "range").agg(F.min("place").alias("first"), F.count("*").alias("here"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("here").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = cut(parts.select(F.col("g").alias("__g"), F.col("range").alias("__range"), (before - F.col("first")).alias("shift"), F.sum("here").over(group).alias("n")))
    width = parts.agg(F.sum(F.octet_length(F.col("__g").cast("string")) + 32)).first()[0] or 0
    found = dealt.join(F.broadcast(parts) if width <= SENT else parts, F.col("g").eqNullSafe(F.col("__g")) & (F.col("range") == F.col("__range")))
    return found.select(*rows.columns, (F.col("place") + F.col("shift")).alias("rank"), "n")


def rolled(nodes: DataFrame) -> DataFrame:
    """(g, block, n, hash, kids) of nodes (g, rank, n, hash, item): blocks of ``FANOUT`` ** ``LEVELS``
    ranks, each one nested row with the hash on its top.

    The digits of the rank are columns; one after another is grouped away, and its nodes are nested
    below the next. Rows are dealt out by block once, so all further groupings stay in their tasks.
    A level is hashed only while the group has several nodes on it; else its only node goes up.
    """
    digits = [F.pmod(F.floor(F.col("rank") / FANOUT**i), F.lit(FANOUT)).cast("int").alias(f"d{i}") for i in range(LEVELS)]
    block = F.floor(F.col("rank") / FANOUT**LEVELS).alias("block")
    now = nodes.select("g", block, "n", "hash", F.col("item").alias("kids"), *digits).repartition("g", "block")
    for i in range(LEVELS):
        by = ["g", "block", *(f"d{j}" for j in range(LEVELS - 1, i, -1))]
        each = F.array_sort(F.collect_list(F.struct(F.col(f"d{i}").alias("digit"), "hash", "kids")))
        now = now.groupBy(*by).agg(F.max("n").alias("n"), each.alias("kids"))
        top = F.sha2(F.array_join(F.transform("kids", lambda x: x["hash"]), ""), 256)
        now = now.withColumn("hash", F.when(F.col("n") > FANOUT**i, top).otherwise(F.get("kids", F.lit(0))["hash"]))
    return now


def tree(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of nodes, the blocks of their tops, and so on until each g has one top."""
    out = []
    while True:
        out.append(cut(rolled(nodes)))
        size = F.ceil(F.col("n") / FANOUT**LEVELS)
        nodes = out[-1].select("g", F.col("block").alias("rank"), size.alias("n"), "hash", F.lit(None).cast("int").alias("item"))
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return out


def opened(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(g, rank, item, hash, path, told) of the nodes of blocks, given the way (g, block, path, told)
    from each block's top to the root.

    A block and its way meet in one group of two rows, and are exploded level by level; the path
    gets what stands before and after a node in its run, the lowest level first.
    """
    rows = blocks.select("g", "block", "n", "kids").unionByName(above.select("g", "block", "path", "told"), allowMissingColumns=True)
    whole = [F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "told")]
    now = rows.groupBy("g", "block").agg(*whole).withColumn("rank", F.col("block"))
    for i in range(LEVELS - 1, -1, -1):
        hashes = F.transform("kids", lambda x: x["hash"]).alias("hashes")
        now = now.select("g", "rank", "n", "path", "told", hashes, F.posexplode("kids").alias("at", "kid"))
        text = lambda start, size: F.array_join(F.slice("hashes", start, size), "")
        step = F.struct(text(F.lit(1), F.col("at")).alias("before"), text(F.col("at") + 2, F.size("hashes")).alias("after"))
        path = F.when(F.col("n") > FANOUT**i, F.concat(F.array(step), "path")).otherwise(F.col("path"))
        rank = (F.col("rank") * FANOUT + F.col("kid.digit")).alias("rank")
        now = now.select("g", rank, "n", path.alias("path"), "told", F.col("kid.hash").alias("hash"), F.col("kid.kids").alias("kids"))
    return now.select("g", "rank", F.col("kids").alias("item"), "hash", "path", "told")


def ways(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``opened`` from the tops (g, path, told) down through all levels to the lowest nodes."""
    above = tops.select("g", F.lit(0).cast("long").alias("block"), "path", "told")
    for blocks in levels[:0:-1]:
        above = opened(blocks, above).select("g", F.col("rank").alias("block"), "path", "told")
    return opened(levels[0], above)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's hash gives along its path."""
    return F.aggregate(path, start, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))


def manifest(docs: DataFrame, changed: Column | None = None, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, leaf, other_leaf, subroot, root, path) for each row of ``docs``: a Merkle tree of fan-out
    16 for each value of ``group``, and one over their roots.

    A group's leaves are in the order of ``key``, groups in that of their UTF-8 bytes, nulls first
    in both. While there are several nodes, each 16 in a row, and what is left, become the hash of
    their hex hashes. ``path`` holds what stands before and after a row's node in its run, from the
    leaf to the root; levels with one node have none. ``other_leaf`` is the leaf with ``changed``
    in place of the text, null where that is null.

    Nulls are fields like others; texts are hashed whole; rows alike in group and key are ordered by
    their leaves, and rows alike in all fields have places of their own; an empty table gives no
    rows; other columns are not looked at. No task holds more than a block of 256 nodes at a time.
    """
    changed = F.lit(None).cast("string") if changed is None else changed
    columns = {f: F.col(f) for f in fields}
    other = F.when(changed.isNotNull(), leaf([changed if f == text else c for f, c in columns.items()]))
    rows = docs.select(F.col(group).alias("g"), F.col(key).alias("k"), leaf(list(columns.values())).alias("hash"), other.alias("other"))
    leaves = ranked(rows, "k", "hash").select("g", "rank", "n", "hash", F.struct("k", "other").alias("item"))
    below = tree(leaves)
    subroots = below[-1].select(F.lit(0).alias("g"), F.col("g").alias("name"), "hash")
    upper = tree(ranked(subroots, "name").select("g", "rank", "n", "hash", F.struct(F.col("name")).alias("item")))
    none = F.array().cast(PATH).alias("path")
    roots = ways(upper, upper[-1].select("g", none, F.col("hash").alias("told")))
    tops = roots.select(F.col("item.name").alias("g"), "path", F.struct(F.col("hash").alias("subroot"), F.col("told").alias("root")).alias("told"))
    found = ways(below, tops)
    return found.select(F.col("item.k").alias(key), F.col("hash").alias("leaf"), F.col("item.other").alias("other_leaf"), "told.subroot", "told.root", "path")


# The letters that tampering lower-cases.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_manifest(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    tampered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.translate("text", UPPER, LOWER))
    # A null text stays null when tampered with: its leaf is the same.
    found = manifest(docs, tampered)
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")
    found = found.withColumn("folded_root", folded(F.coalesce("other_leaf", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
