"""Line dedup by an exact set-similarity join (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import byte_slices, cut, hashes_of, mixed, read, shuffle_parts, text_bytes, text_or_empty, tidy, words_of

SIMILARITY = 0.8
#: Tokens are counted in so many buckets, a power of two; the counts, a table of fixed size, go to every task.
BUCKETS = 1 << 16
#: Sets of more tokens than this have a second sketch, which doubles the first one's places.
LONG = 48
#: Partners that a line proposes at first, the closest sketches; only lines that none of them
#: settles propose all of theirs in a second turn.
FIRST = 4
#: Rows of a token above which its group is split into blocks.
HOT = 1 << 14
#: Bytes that are sent to every task at most; what is larger is joined by a shuffle.
SENT = 32 << 20
#: Pairs that a task gathers before it sorts them or gives them out.
MOST_HELD = 200_000
NO_KEY = -(2**63)


def token_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often the tokens of each bucket occur in all lines: ``buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, at = text_bytes(batch.column(0))
            for i, j in byte_slices(at):
                h = words_of(raw[at[i] : at[j]], at[i : j + 1] - at[i]).hash
                total += np.bincount((h & np.uint64(buckets - 1)).view(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    each = docs.select(text_or_empty(text).alias("t")).mapInArrow(tidy(run), "bucket int, n long")
    rows = each.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


class Sets:
    """The token sets of the lines of some texts, each sorted from its rarest token on."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, rank: np.ndarray, wanted: tuple[np.ndarray, np.ndarray] | None = None):
        """Of ``wanted``, pairs of a text and a line number in order, only these lines are read."""
        words = words_of(raw, at)
        breaks = np.flatnonzero(raw == 10)
        before = np.searchsorted(breaks, words.start)
        new = np.ones(len(before), bool)
        new[1:] = (before[1:] != before[:-1]) | (words.text[1:] != words.text[:-1])
        line, h, at_word = np.cumsum(new) - 1, words.hash, np.arange(len(words.hash))
        self.doc = words.text[new]
        self.number = before[new] - np.searchsorted(breaks, at[self.doc])
        if wanted is not None:
            width = max(self.number.max(initial=0), wanted[1].max(initial=0)) + 1
            keep = np.isin(self.doc * width + self.number, wanted[0] * width + wanted[1])
            at_word = at_word[keep[line]]
            h, line = h[at_word], (np.cumsum(keep) - 1)[line[at_word]]
            self.doc, self.number = self.doc[keep], self.number[keep]
        bits = np.uint64((len(rank) - 1).bit_length())
        # The bucket's place by rarity in front, the rest of the hash behind.
        token = (rank[(h & np.uint64(len(rank) - 1)).view(np.int64)] << (np.uint64(64) - bits)) | (h >> bits)
        order = np.argsort(token)
        if len(self.doc) < 1 << 16:
            line = line.astype(np.uint16)  # sorted by counting
        order = order[np.argsort(line[order], kind="stable")]
        token, line = token[order], line[order].astype(np.int64)
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
        self.token, line = token[first], line[first]
        at_word = at_word[order[first]]
        self.word = words.start[at_word], words.end[at_word]
        self.start = np.searchsorted(line, np.arange(len(self.doc)))
        self.size = np.diff(np.append(self.start, len(line)))
        self.place = np.arange(len(line)) - np.repeat(self.start, self.size)
        m = mixed(self.token)
        if len(self.doc):
            self.set = mixed(np.add.reduceat(m, self.start)).view(np.int64)
            # Parities of the tokens in 64 places; of those in the first 64 of 128 places.
            bit = np.uint64(1) << (m >> np.uint64(58))
            self.sketch = np.bitwise_xor.reduceat(bit, self.start).view(np.int64)
            half = np.bitwise_xor.reduceat(bit * (m & np.uint64(1)), self.start).view(np.int64)
            self.half = np.where(self.size > LONG, half, 0)
        else:
            self.set = self.sketch = self.half = np.zeros(0, np.int64)


def _split(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _prefix(size: np.ndarray, similarity: float) -> np.ndarray:
    """Two sets that are similar enough share a token among this many first ones of each."""
    return size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1


def line_sets(docs: DataFrame, rank, similarity: float) -> DataFrame:
    """(k, row, line, set, size, sketch, half, prefix) of every line with tokens of docs (k, row, t).

    prefix is empty where the same set came earlier in the same batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(2))
            k, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, j in byte_slices(at):
                s = Sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], rank.value)
                if not len(s.doc):
                    continue
                of = s.doc + i
                # Within the batch the first line of a set, in the order of keys, stands for it.
                order = np.lexsort((s.number, k[of], s.set))
                head = np.zeros(len(order), bool)
                head[order] = np.append(True, s.set[order][1:] != s.set[order][:-1])
                keep = np.where(head, _prefix(s.size, similarity), 0)
                values = s.token[s.place < np.repeat(keep, s.size)]
                arrays = [k[of], row[of], s.number.astype(np.int32), s.set, s.size.astype(np.int32), s.sketch, s.half]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), _split(values, keep)], ["k", "row", "line", "set", "size", "sketch", "half", "prefix"])

    return docs.mapInArrow(tidy(run), "k long, row long, line int, set long, size int, sketch long, half long, prefix array<long>")


def _least_overlap(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    return np.ceil(similarity / (1 + similarity) * (a + b) - 1e-9).astype(np.int64)


#: The columns of a row of a token, in the order in which they are packed.
PACKED = {"token": "<u8", "low": "<i4", "high": "<i4", "side": "<i4", "set": "<i8", "k": "<i8", "line": "<i4", "size": "<i4", "place": "<i4", "sketch": "<i8", "half": "<i8", "asked": "<u1"}


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns byte by byte, all first bytes before all second ones, so that small numbers' zero
    bytes stand together and shuffle files stay small."""
    return b"".join(np.ascontiguousarray(c.astype(t)).view(np.uint8).reshape(len(c), -1).T.tobytes() for c, t in zip(columns, PACKED.values(), strict=True))


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    out, at = [], 0
    for t in PACKED.values():
        width = np.dtype(t).itemsize
        part = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(part.T).view(t).reshape(n))
        at += n * width
    return out


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy().view(np.uint64), np.diff(column.offsets.to_numpy())


def _deal(batches: Iterator[pa.RecordBatch], blocks: np.ndarray, parts: int, tokens: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(part, n, data): the batch's rows of tokens, packed by the part that they go to."""
    bits = np.uint64((len(blocks) - 1).bit_length())
    for batch in batches:
        token, sizes = _lists(batch, "prefix")
        at = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if tokens is not None:
            keep = np.isin(token, tokens)
            token, at, place = token[keep], at[keep], place[keep]
        if not len(token):
            continue
        k, line, sets, size, sketch, half, asked = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[at] for c in ("k", "line", "set", "size", "sketch", "half", "asked"))
        n = blocks[(token >> (np.uint64(64) - bits)).view(np.int64)]
        side = (mixed(sets.view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
        again = np.repeat(np.arange(len(token)), n)
        other = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
        low, high = np.minimum(side[again], other), np.maximum(side[again], other)
        part = (mixed(mixed(token[again] + low.astype(np.uint64)) + high.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((token[again], part))
        columns = [x[again][order] for x in (token, side, sets, k, line, size, place, sketch, half, asked)]
        columns = [columns[0], low[order], high[order], *columns[1:]]
        part = part[order]
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        end = np.append(begin[1:], len(part))
        data = [_packed([c[i:j] for c in columns]) for i, j in zip(begin, end, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part[begin].astype(np.int32)), pa.array((end - begin).astype(np.int32)), pa.array(data, pa.binary())], ["part", "n", "data"])


def _pairs(batches: Iterator[pa.RecordBatch], similarity: float, first: int | None) -> Iterator[pa.RecordBatch]:
    """Candidates (later, earlier, their keys and lines, more) among rows that share a token.

    Pairs pass the length filter, the positional filter, and the bound that the parity sketch sets
    to the sets' difference; the later set must be one that is asked for. Of each later set at most
    ``first`` partners are given, with whether there were more.
    """
    held = [_unpacked(d, n) for b in batches for n, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    if not held:
        return
    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
    del held
    # Tokens that only one row has go first: most rows, as prefixes hold the rarest tokens.
    order = np.argsort(columns[0])
    token = columns[0][order]
    same = token[1:] == token[:-1]
    order = order[np.append(same, False) | np.append(False, same)]
    token, low, high, side, sets, k, line, size, place, sketch, half, asked = (x[order] for x in columns)
    del columns
    size, place, asked = size.astype(np.int64), place.astype(np.int64), asked.astype(bool)
    order = np.lexsort((line, k, sets, size, high, low, token))
    token, low, high, side, sets, k, line, size, place, sketch, half, asked = (x[order] for x in (token, low, high, side, sets, k, line, size, place, sketch, half, asked))
    if not len(token):
        return
    # One row for each set: its first line.
    new = np.append(True, (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (sets[1:] != sets[:-1]))
    token, low, high, side, sets, k, line, size, place, sketch, half, asked = (x[new] for x in (token, low, high, side, sets, k, line, size, place, sketch, half, asked))
    begins = np.append(True, (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
    group = np.cumsum(begins)
    found: list[tuple[np.ndarray, ...]] = []
    held_pairs = 0
    i, shift = np.arange(len(group)), 0
    while len(i):
        shift += 1
        i = i[i + shift < len(group)]
        j = i + shift
        near = (group[i] == group[j]) & (size[i] >= similarity * size[j] - 1e-9)
        i, j = i[near], j[near]
        need = _least_overlap(size[i], size[j], similarity)
        one, two = sketch[i] ^ sketch[j], half[i] ^ half[j]
        apart = np.bitwise_count(one.view(np.uint64)).astype(np.int64)
        long = (size[i] > LONG) & (size[j] > LONG)
        apart = np.where(long, np.bitwise_count(two.view(np.uint64)).astype(np.int64) + np.bitwise_count((one ^ two).view(np.uint64)), apart)
        good = np.minimum(size[i] - place[i], size[j] - place[j]) >= need
        good &= apart <= size[i] + size[j] - 2 * need
        good &= (low[i] == high[i]) | (side[i] != side[j])
        good &= asked[i] | asked[j]
        if good.any():
            a, b, d = i[good], j[good], apart[good]
            swap = (k[a] > k[b]) | ((k[a] == k[b]) & ((line[a] > line[b]) | ((line[a] == line[b]) & (sets[a] > sets[b]))))
            earlier, later = np.where(swap, b, a), np.where(swap, a, b)
            found.append((sets[later], sets[earlier], d, k[later], k[earlier], line[later], line[earlier]))
            wanted = asked[later]
            found[-1] = tuple(x[wanted] for x in found[-1])
            held_pairs += len(found[-1][0])
            if held_pairs > MOST_HELD:
                found = [_closest(found, first)]
                if first is None:
                    yield _named(found.pop(), None)
                held_pairs = sum(len(x[0]) for x in found)
    if found:
        yield _named(_closest(found, first), first)


def _named(found: tuple[np.ndarray, ...], first: int | None) -> pa.RecordBatch:
    """The batch of pairs that ``_closest`` has ordered."""
    later, earlier, _, *places = found
    more = np.zeros(len(later), bool)
    if first is not None:
        counts = np.unique(later, return_inverse=True, return_counts=True)
        more = counts[2][counts[1]] > first
        rank = np.arange(len(later)) - np.searchsorted(later, later)
        keep = rank < first
        later, earlier, more, *places = (x[keep] for x in (later, earlier, more, *places))
    names = ["later", "earlier", "later_k", "earlier_k", "later_line", "earlier_line", "more"]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (later, earlier, *places, more)], names)


def _closest(found: list[tuple[np.ndarray, ...]], first: int | None) -> tuple[np.ndarray, ...]:
    """Distinct pairs by later set and distance; one more than ``first`` of each, to show the rest."""
    out = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.lexsort((out[1], out[2], out[0]))
    out = [x[order] for x in out]
    new = np.ones(len(order), bool)
    new[1:] = (out[0][1:] != out[0][:-1]) | (out[1][1:] != out[1][:-1])
    out = [x[new] for x in out]
    if first is not None:
        rank = np.arange(len(out[0])) - np.searchsorted(out[0], out[0])
        out = [x[rank <= first] for x in out]
    return tuple(out)


def block_counts(lines: DataFrame, buckets: int) -> np.ndarray:
    """For each bucket, by rarity, into how many blocks its rows are dealt: one, unless they are
    more than ``HOT``. Partitions name only buckets that could matter, so the table stays small."""
    parts = lines.rdd.getNumPartitions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        shift = np.uint64(64 - (buckets - 1).bit_length())
        for batch in batches:
            total += np.bincount((_lists(batch, "prefix")[0] >> shift).view(np.int64), minlength=buckets)
        at = np.flatnonzero(total >= max(1, HOT // (4 * parts)))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    rows = lines.select("prefix").mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).toPandas()
    out = np.ones(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = 1 + rows["n"].to_numpy() // HOT
    return out


def tokens_of(lines: DataFrame) -> np.ndarray | None:
    """The prefix tokens of the sets that are asked for; None if they are too many to be sent."""
    found = lines.where("asked").select(F.explode("prefix").alias("token")).distinct()
    found = cut(found)
    return np.sort(found.toPandas()["token"].to_numpy().view(np.uint64)) if 8 * found.count() <= SENT else None


def candidates(lines: DataFrame, blocks, similarity: float, tokens: np.ndarray | None = None, first: int | None = None) -> DataFrame:
    """Candidate pairs of sets, the later one ``asked`` for; a token of very many rows is dealt out
    over pairs of blocks."""
    spark = lines.sparkSession
    parts = 4 * shuffle_parts(spark)
    sent = spark.sparkContext.broadcast(tokens)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _deal(batches, blocks.value, parts, sent.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pairs(batches, similarity, first)

    each = lines.where(F.size("prefix") > 0).select("set", "k", "line", "size", "sketch", "half", "prefix", "asked").mapInArrow(tidy(deal), "part int, n int, data binary")
    return each.repartition("part").mapInArrow(tidy(run), "later long, earlier long, later_k long, earlier_k long, later_line int, earlier_line int, more boolean")


def small_side(table: DataFrame, width: int) -> DataFrame:
    """``table``, sent to every task if its rows of ``width`` bytes are few enough."""
    return F.broadcast(table) if width * table.count() <= SENT else table


def verified(pairs: DataFrame, docs: DataFrame, rank, similarity: float) -> DataFrame:
    """The later sets of pairs whose Jaccard similarity is high enough, from the lines themselves.

    Words are compared by hashes of their own, independent of those that proposed the pair: two
    words that differ must share 128 bits to count as one."""
    sides = [pairs.select(*(F.col(f"{side}{x}").alias(y) for x, y in (("", "set"), ("_k", "k"), ("_line", "line")))) for side in ("later", "earlier")]
    # A key's lines are those of the documents that have the key.
    wanted = sides[0].unionByName(sides[1]).distinct().groupBy("k").agg(F.array_sort(F.collect_list(F.struct("line", "set"))).alias("of"))
    wanted = cut(wanted.select(F.col("k").alias("key"), F.col("of.line").alias("lines"), F.col("of.set").alias("sets")))
    bytes_sent = wanted.agg(F.sum(12 * F.size("lines") + 16)).first()[0] or 0
    named = docs.join(F.broadcast(wanted) if bytes_sent <= SENT else wanted, F.col("k") == F.col("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(0))
            offsets = batch.column(1).offsets.to_numpy()
            numbers, sets = (batch.column(i).flatten().to_numpy() for i in (1, 2))
            offsets = offsets - offsets[0]
            for i, j in byte_slices(at):
                part = slice(offsets[i], offsets[j])
                of = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
                here = raw[at[i] : at[j]]
                s = Sets(here, at[i : j + 1] - at[i], rank.value, (of, numbers[part].astype(np.int64)))
                # Documents that share a key can have other lines at that place.
                keep = np.isin(s.set, sets[part])
                inside = np.repeat(keep, s.size)
                words = hashes_of(here, s.word[0][inside], s.word[1][inside], seed=1)
                yield pa.RecordBatch.from_arrays([pa.array(s.set[keep]), _split(words, s.size[keep])], ["set", "tokens"])

    lines = named.select("t", "lines", "sets").mapInArrow(tidy(run), "set long, tokens array<long>")
    lines = lines.groupBy("set").agg(F.first("tokens").alias("tokens"))
    joined = pairs.join(lines.withColumnsRenamed({"set": "later", "tokens": "a"}), "later").join(lines.withColumnsRenamed({"set": "earlier", "tokens": "b"}), "earlier")
    common = F.size(F.array_intersect("a", "b"))
    return joined.where(common >= F.lit(similarity) * (F.size("a") + F.size("b") - common) - 1e-9).select("later").distinct()


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one, with columns n_lines and n_removed.

    A line's tokens are its distinct words (ASCII white space between them, case kept). A line goes
    if some line before it, by key and then line number, has a Jaccard similarity of ``similarity``
    or more with it, be that line kept or not; lines with equal tokens go by the same rule. Blank
    lines stay. Lines that stay are joined by line breaks again.

    Documents of one key come line by line; null keys come first. Rows alike in key and text are
    one document: they get the same result. Null texts stay null (no lines); keys must be integers;
    all columns stay, and columns named n_lines or n_removed are replaced.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("k"), F.xxhash64(text_or_empty(text)).alias("row"), text_or_empty(text).alias("t"))
    counts = token_counts(docs, text)
    places = np.empty(len(counts), np.uint64)
    places[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64)
    rank = spark.sparkContext.broadcast(places)
    lines = cut(line_sets(slim, rank, similarity))

    blocks = spark.sparkContext.broadcast(block_counts(lines, len(counts)))
    pairs = cut(candidates(lines.withColumn("asked", F.lit(True)), blocks, similarity, first=FIRST))
    gone = cut(verified(pairs, slim, rank, similarity))
    open_sets = cut(pairs.where("more").select("later").distinct().join(gone, "later", "left_anti"))
    if not open_sets.isEmpty():
        marks = small_side(open_sets.select(F.col("later").alias("set"), F.lit(True).alias("asked")), 8)
        asked = cut(lines.join(marks, "set", "left").withColumn("asked", F.coalesce("asked", F.lit(False))))
        rest = cut(candidates(asked, blocks, similarity, tokens_of(asked)))
        gone = cut(gone.unionByName(verified(rest, slim, rank, similarity)).distinct())

    # Of each set that stays, its first line stays; a line is named by its place, so that copies of
    # one line, however many, are dealt out.
    firsts = lines.groupBy("set").agg(F.min(F.struct("k", "line", "row")).alias("first"))
    firsts = firsts.join(gone.withColumnRenamed("later", "set"), "set", "left_anti").select("first.*", F.lit(True).alias("stays"))
    state = lines.select("k", "row", "line").join(firsts, ["k", "row", "line"], "left")
    # Grouped by the text itself: no group is larger than a text's lines.
    cuts = state.where(F.col("stays").isNull()).groupBy("k", "row").agg(F.collect_set("line").alias("__gone"))
    cuts = cut(cuts.select(F.col("k").alias("__k"), F.col("row").alias("__row"), F.array_sort("__gone").alias("__gone")))
    if (cuts.agg(F.sum(4 * F.size("__gone") + 32)).first()[0] or 0) <= SENT:
        cuts = F.broadcast(cuts)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("d"), F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("__k"), F.xxhash64(text_or_empty(text)).alias("__row"))
    # The array of lines is a column, so that no line is asked for by splitting the text again.
    whole = whole.join(cuts, ["__k", "__row"], "left").select("d", "__gone", F.split(F.col("d").getField(text), "\n", -1).alias("__parts"))
    parts = F.col("__parts")
    # The lines between two that go are stretches of the array of lines.
    ends = F.concat("__gone", F.array(F.size(parts)))
    stretch = F.transform(ends, lambda x, i: F.slice(parts, F.coalesce(F.get("__gone", i - 1), F.lit(-1)) + 2, x - F.coalesce(F.get("__gone", i - 1), F.lit(-1)) - 1))
    left = F.array_join(F.flatten(stretch), "\n")
    value = F.when(F.col("__gone").isNull(), F.col("d").getField(text)).otherwise(left)
    columns = [value.alias(c) if c == text else F.col("d").getField(c).alias(c) for c in kept]
    n_lines = F.when(parts.isNull(), 0).otherwise(F.size(parts))
    return whole.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"))


def op1_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", F.when(F.col("n_removed") < 0, 0).otherwise(F.col("n_removed")).alias("n_removed"))
