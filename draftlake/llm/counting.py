"""Token counts from the counts of distinct pre-tokens (operator 12)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from draftlake.llm.common import KEPT, byte_slices, cut, eights, mixed, read, text_bytes, text_or_empty, tidy

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
#: The commonest pre-tokens whose counts go to every task: 20 bytes each. What is rarer than so many
#: others has no large share of all rows, and is joined by a shuffle.
SENT = 1 << 18
#: Classes of characters: letter, number, other, space, part of a special string, not known yet.
LETTER, NUMBER, OTHER, SPACE, SPECIAL, UNKNOWN = 0, 1, 2, 3, 4, 255
#: Pre-tokens of up to this many bytes are their own key; a longer one's key is a hash.
EXACT, HASHED = 15, np.uint64(255 << 56)


class PreTokens:
    """The pre-tokens of a byte-level vocabulary, found for many texts at once.

    Words, numbers and other signs go together, a blank before them with them; of other white space
    the last character before a word stands alone; and what follows an apostrophe in the common
    contractions is cut off. Which class a character belongs to is asked of the library when it is
    first met, so both agree whatever tables of Unicode each knows.
    """

    def __init__(self, path: str):
        settings = json.load(open(path, encoding="utf-8"))
        kind = settings.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or not kind.get("use_regex") or kind.get("add_prefix_space") or settings.get("normalizer"):
            raise ValueError(f"{path} is no byte-level vocabulary with the usual pre-tokens")
        self.library = Tokenizer.from_file(path)
        added = settings.get("added_tokens") or []
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError(f"{path} has special strings that reach beyond themselves")
        names = sorted((a["content"].encode() for a in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)

    def kinds(self, points: np.ndarray) -> np.ndarray:
        found = self.kind[points]
        new = np.unique(points[found == UNKNOWN])
        if len(new):
            self.kind[new] = SPACE
            chars = list(map(chr, new.tolist()))
            for kind, probe in ((LETTER, "a"), (NUMBER, "0"), (OTHER, "!")):
                # A character of the same class stays with the one before it.
                asked = "".join(f"{probe}{c}\n" for c in chars)
                begins = np.zeros(len(asked) + 1, bool)
                begins[[place[0] for _, place in self.library.pre_tokenizer.pre_tokenize_str(asked)]] = True
                self.kind[new[~begins[1 : 3 * len(new) : 3]]] = kind
            found = self.kind[points]
        return found

    def find(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last byte of each pre-token and its text; and each text's special strings."""
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4").astype(np.int64)
        kind = self.kinds(points)
        begin = np.zeros(len(points) + 1, bool)
        begin[np.searchsorted(lead, at)] = True
        start = begin.copy()
        specials = self.specials(raw, at)
        for a, b in specials.tolist():
            a, b = np.searchsorted(lead, [a, b])
            kind[a:b] = SPECIAL
            start[[a, b]] = True
        start[1:-1] |= kind[1:] != kind[:-1]
        # The last space before a word begins a pre-token, which the word joins if it is a blank.
        edge = 1 + np.flatnonzero((kind[1:] < SPACE) & (kind[:-1] == SPACE) & ~begin[1:-1])
        start[edge - 1] = True
        start[edge[points[edge - 1] == 32]] = False
        self.contractions(points, kind, begin, start)
        first = np.flatnonzero(start[:-1])
        keep = kind[first] != SPECIAL
        place = np.append(lead, len(raw))
        low, high = place[first], place[np.append(first[1:], len(points))] if len(first) else place[:0]
        low, high = low[keep], high[keep]
        texts = lambda x: np.searchsorted(at, x, "right") - 1
        return low, high, texts(low), np.bincount(texts(specials[:, 0]), minlength=len(at) - 1)

    def specials(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        data, out = raw.tobytes(), []
        if self.special and self.special.search(data):
            # Text by text, so that none is found over the border of two.
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                out += [m.span() for m in self.special.finditer(data, a, b)]
        return np.array(out, np.int64).reshape(-1, 2)

    @staticmethod
    def contractions(points: np.ndarray, kind: np.ndarray, begin: np.ndarray, start: np.ndarray) -> None:
        quote = np.flatnonzero((points == 39) & start[:-1] & (kind == OTHER))
        after = np.zeros((len(quote), 2), np.int64)
        same = np.ones(len(quote), bool)
        for i in (0, 1):
            place = quote + i + 1
            same &= place < len(points)
            same[same] &= ~begin[place[same]]
            there = same.copy()
            there[same] &= kind[place[same]] == LETTER
            after[there, i] = points[place[there]]
        one = np.isin(after[:, 0], [ord(c) for c in "stmd"])
        two = ~one & np.isin(after[:, 0] * 256 + after[:, 1], [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
        start[quote[one | two] + 1] = False
        start[quote[two] + 2] = False
        start[quote[one] + 2] = True
        start[quote[two] + 3] = True


def keys(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each stretch: its bytes and their number, or a hash of more than ``EXACT`` bytes."""
    window, size = eights(raw), end - start
    low = window[start] & KEPT[np.minimum(size, 8)]
    rest = np.clip(size - 8, 0, 7)
    high = (window[np.minimum(start + 8, len(raw))] & KEPT[rest]) | (np.minimum(size, EXACT + 1).astype(np.uint64) << np.uint64(56))
    for i in np.flatnonzero(size > EXACT):
        h = xxhash.xxh3_128_intdigest(raw[start[i] : end[i]].tobytes())
        low[i], high[i] = h & (2**64 - 1), (h >> 72) | int(HASHED)
    return low, high


def distinct(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one row of each key, and each row's number among them."""
    _, first, number = np.unique(mixed(low + mixed(high)), return_index=True, return_inverse=True)
    if (low[first][number] != low).any() or (high[first][number] != high).any():
        _, first, number = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True, return_inverse=True)
    return first, number


_loaded: dict[str, PreTokens] = {}


def loaded(path: str) -> PreTokens:
    """One for each worker process."""
    if path not in _loaded:
        _loaded[path] = PreTokens(path)
    return _loaded[path]


def vocabulary(texts: DataFrame, path: str) -> DataFrame:
    """(low, high, n, pieces) of all distinct pre-tokens of texts (t): how often each occurs, and
    of how many pieces it consists, counted once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(0))
            for i, j in byte_slices(at):
                here = raw[at[i] : at[j]]
                start, end, _, _ = loaded(path).find(here, at[i : j + 1] - at[i])
                low, high = keys(here, start, end)
                first, number = distinct(low, high)
                long = [here[a:b].tobytes() if b - a > EXACT else None for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                columns = [pa.array(low[first].view(np.int64)), pa.array(high[first].view(np.int64)), pa.array(np.bincount(number, minlength=len(first)))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(long, pa.binary())], ["low", "high", "n", "long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            short = np.stack([low, high], axis=1).tobytes()
            words = [long if long is not None else short[16 * i : 16 * i + size] for i, (long, size) in enumerate(zip(batch.column(3).to_pylist(), (high >> np.uint64(56)).tolist(), strict=True))]
            pieces = [len(e) for e in loaded(path).library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(pieces, pa.int32())], ["low", "high", "n", "pieces"])

    each = texts.mapInArrow(tidy(gather), "low long, high long, n long, long binary")
    once = each.groupBy("low", "high").agg(F.sum("n").alias("n"), F.first("long").alias("long"))
    return once.mapInArrow(tidy(count), "low long, high long, n long, pieces int")


class Known:
    """The counts of the commonest pre-tokens, by the mix of their keys."""

    def __init__(self, low: np.ndarray, high: np.ndarray, pieces: np.ndarray):
        mix = mixed(low + mixed(high))
        self.mix, first = np.unique(mix, return_index=True)
        self.low, self.high, self.pieces = low[first], high[first], pieces[first].astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many pieces each key has, -1 for a key that is not known."""
        if not len(self.mix):
            return np.full(len(low), -1)
        at = np.minimum(np.searchsorted(self.mix, mixed(low + mixed(high))), len(self.mix) - 1)
        return np.where((self.low[at] == low) & (self.high[at] == high), self.pieces[at], -1)


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """Those pre-tokens that occur at least so often that at most ``most`` do.

    The bound comes from the numbers of pre-tokens by the logarithm of how often they occur, a small
    table, so no task and not the driver sees more than the chosen ones.
    """
    step = F.floor(F.log2("n") * 64).cast("int")
    held, bound = 0, None
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        held += row["n"]
        if held > most:
            break
        bound = row["step"]
    return counts.where(F.lit(False) if bound is None else step >= bound)


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", limit: int = LIMIT, sent: int = SENT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each document: as many tokens as the library gives,
    special strings in a text counted as it does by default (one token each).

    The pieces of each distinct pre-token are counted once. A document's frequencies of pre-tokens
    are joined with these counts and added up: with the ``sent`` commonest ones at most, which all
    tasks know, as soon as they are found, and with the others by a shuffle; no ids are ever kept.

    Null and empty texts have no bytes and no tokens; texts are read whole; rows are independent and
    each gives a row, repeated ones too, and null keys are kept; an empty table gives no rows; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path(VOCABULARY)
    slim = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    counts = cut(vocabulary(slim.select("t"), path))
    common = commonest(counts, sent).select("low", "high", "pieces").toPandas()
    low, high = (common[c].to_numpy("int64").view(np.uint64) for c in ("low", "high"))
    known = spark.sparkContext.broadcast(Known(low, high, common["pieces"].to_numpy()))
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            for i, j in byte_slices(at):
                here, places = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                start, end, of, special = loaded(path).find(here, places)
                low, high = keys(here, start, end)
                first, number = distinct(low, high)
                low, high = low[first], high[first]
                pieces = known.value.find(low, high)
                # A document's frequencies: how often it has each of its pre-tokens.
                which, n = np.unique(of * max(1, len(first)) + number, return_counts=True)
                doc, token = np.divmod(which, max(1, len(first)))
                there = pieces[token] >= 0
                total = special + np.bincount(doc[there], (n * pieces[token])[there], j - i).astype(np.int64)
                doc, token, n = doc[~there], token[~there], n[~there]
                offsets = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                rest = pa.StructArray.from_arrays([pa.array(low[token].view(np.int64)), pa.array(high[token].view(np.int64)), pa.array(n)], ["low", "high", "n"])
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(places)), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), rest)]
                yield pa.RecordBatch.from_arrays(columns, ["k", "n_bytes", "n_tokens", "rest"])

    found = slim.mapInArrow(tidy(run), f"k {kind}, n_bytes long, n_tokens long, rest array<struct<low: long, high: long, n: long>>")
    if len(known.value.mix) < counts.count():
        found = cut(found.withColumn("row", F.monotonically_increasing_id()))
        each = found.select("row", F.explode("rest").alias("r")).select("row", "r.*")
        more = each.join(counts.select("low", "high", "pieces"), ["low", "high"]).groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
        found = found.join(more, "row", "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("more", F.lit(0)))
    return found.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_counts(spark, sf_dir):
    return count_tokens(read(spark, sf_dir, "documents"))
