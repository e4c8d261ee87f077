"""Best-fit decreasing packing of token sequences (operator 4)."""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import cut, read, shuffle_parts, tidy

LIMIT = 2048
VOCABULARY = "byte_bpe_50k.json"


# ---- tokens ----------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class WordCache:
    """Ids of whole texts, found piece by piece and kept for pieces seen before.

    In this pattern no pre-token reaches over a single space or line break between two other
    characters except that the space begins the next one, so pieces between them stand alone.
    Texts with any other white space are encoded at one go.
    """

    odd = re.compile(r"\s\s|[^\S \n]")

    def __init__(self, path: str, most: int = 400_000):
        letters = _byte_letters()
        vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if all(c in letters for c in piece) and not piece.startswith("<|")}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.most, self.after_space, self.alone = most, {}, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def pieces(self, pieces: list[str], known: dict[str, bytes], before: str) -> list[bytes]:
        out = list(map(known.get, pieces))
        if None in out:
            if len(known) > self.most:
                known.clear()
            for i, x in enumerate(out):
                if x is None:
                    out[i] = known[pieces[i]] = self.whole(before + pieces[i])
        return out

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.odd.search(text):
            return self.whole(text)
        lines = text.split("\n")
        out = []
        for i, line in enumerate(lines):
            first, *rest = line.split(" ")
            if i:
                out += self.pieces(["\n"], self.alone, "")
            if first:
                out += self.pieces([first], self.alone, "")
            if rest:
                out += self.pieces(rest, self.after_space, " ")
        return b"".join(out)


_caches: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    """One cache for each worker process, whatever the number of tasks."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every document's ids, ended by id 0, as one piece or cut into pieces of ``limit`` ids."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = word_cache(path)
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"].to_numpy(), batch["t"], strict=True):
                ids = cache.ids(t) + b"\0\0\0\0"
                first = len(ids) // 4 % limit or limit
                for piece, start in enumerate([0, *range(first, len(ids) // 4, limit)]):
                    part = ids[4 * start : 4 * (first if not piece else start + limit)]
                    rows.append((k, piece, start, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["k", "piece", "start", "length", "ids_crc32"])

    slim = docs.selectExpr(f"`{key}` as k", f"coalesce(`{text}`, '') as t")
    return slim.mapInPandas(tidy(run), f"k {kind}, piece int, start long, length long, ids_crc32 long")


# ---- the plan --------------------------------------------------------------------------------


class Capacities:
    """A segment tree over remaining capacities 0..limit: which have an open bin."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.any = bytearray(2 * self.size)

    def mark(self, capacity: int, there: bool) -> None:
        i = self.size + capacity
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of ``least`` or more that has an open bin."""
        i = self.size + least
        if self.any[i]:
            return least
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over lengths with their counts: rows (length, from, to, bin, each, offset).

    Items of one length are alike, so they are placed a run at a time: items from..to-1 of a length
    go, ``each`` to a bin, into the bins that follow ``bin``, beginning at ``offset`` there. This is
    what best fit does item by item: a bin that took an item is the tightest for the next one of
    that length as long as it fits. Bins with equal histories form runs too; a run is split once
    a length at most and serves a length only if it has at least its room left, after which less
    than half of that is left: the rows number O(limit log limit), however many items there are.
    """
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: (first bin, bins)
    room = Capacities(limit)
    out, bins = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_bins[capacity].append((first, n))
            room.mark(capacity, True)

    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            capacity = room.tightest(length)
            if capacity is None:
                capacity, each = limit, limit // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                first, n = open_bins[capacity].pop()
                if not open_bins[capacity]:
                    room.mark(capacity, False)
                each = capacity // length
            full = min(n, left // each)
            if full:
                out.append((length, done, done + full * each, first, each, limit - capacity))
                put(capacity - each * length, first, full)
                done, left = done + full * each, left - full * each
            if full < n and left:
                out.append((length, done, done + left, first + full, left, limit - capacity))
                put(capacity - left * length, first + full, 1)
                full, left = full + 1, 0
            put(capacity, first + full, n - full)
    return out


def pack(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id and offset to ``items`` (k, piece, start, length, ids_crc32).

    Only the counts of the lengths, ``limit`` numbers, reach the driver, which plans from them;
    the plan is bounded by ``limit`` too (see ``best_fit``) and is sent to all tasks. An item finds
    its place by its number among the items of its length. Numbers are dealt out within salted
    parts of a length, so a length that holds a third of all items is no task of its own.
    """
    spark = items.sparkSession
    salts = shuffle_parts(spark)
    items = cut(items.withColumn("salt", F.pmod(F.xxhash64("k", "piece", "ids_crc32"), F.lit(salts)).cast("int")))
    parts = cut(items.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(
        best_fit(counts, limit) or [(0, 0, 0, 0, 1, 0)],
        "p_length long, p_from long, p_to long, p_bin long, p_each long, p_offset long",
    )
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "salt").orderBy("k", "piece", "ids_crc32")
    numbered = items.withColumn("rank", F.row_number().over(inside) - 1).join(parts, ["length", "salt"])
    numbered = numbered.withColumn("rank", F.col("rank") + F.col("before"))
    placed = numbered.join(
        F.broadcast(plan),
        (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to")),
    )
    return placed.select(
        "k",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("p_bin + (rank - p_from) div p_each").alias("sequence_id"),
        F.expr("p_offset + (rank - p_from) % p_each * length").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pack all documents into as few sequences of at most ``limit`` tokens as best fit finds.

    Null and empty texts are a single end token. A document of more than ``limit`` tokens is cut
    into full pieces after a first, shorter one. Equal lengths are numbered by key, piece and ids;
    rows alike in all three may swap places. An empty table gives no rows; other columns are not
    looked at; null keys are kept.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    return pack(pieces(docs, path, limit, text, key), limit).withColumnRenamed("k", key)


def op4_packing(spark, sf_dir):
    return pack_documents(read(spark, sf_dir, "documents"))
