"""SentencePiece encoding and decoding by streaming Viterbi (operator 6)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import byte_slices, hashes_of, read, text_bytes, text_or_empty

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"


#: Stretches that go through the window together, and the characters that it takes in at first.
TOGETHER, WINDOW = 1 << 15, 32
#: Odd multipliers for hashes of characters; the next is taken if two texts ever share a hash.
MULTIPLIERS = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)))
#: Tables of pieces have 2^BITS slots, the answers kept for pairs of pieces 2^PAIR_BITS.
BITS, PAIR_BITS = 17, 19


def slot_of(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (keys * MULTIPLIERS[0]) >> np.uint64(64 - bits)


class Table:
    """The number of each of some 64-bit keys. Few share a slot; the second has a table of its own."""

    def __init__(self, keys: np.ndarray):
        slots, self.parts, left = slot_of(keys), [], np.arange(len(keys))
        while len(left):
            _, first = np.unique(slots[left], return_index=True)
            key, number = np.zeros(1 << BITS, np.uint64), np.full(1 << BITS, -1, np.int32)
            key[slots[left[first]]], number[slots[left[first]]] = keys[left[first]], left[first]
            self.parts.append((key, number))
            left = np.delete(left, first)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of ``keys``, -1 for a key that is not there."""
        out, left, slots = np.full(len(keys), -1, np.int32), np.arange(len(keys)), slot_of(keys)
        for key, number in self.parts:
            there, s = key[slots[left]] == keys[left], slots[left]
            out[left[there]] = number[s[there]]
            left = left[~there & (number[s] >= 0)]
            if not len(left):
                break
        return out


class Pieces:
    """A vocabulary whose pieces merge by score, as a model over neighbouring pieces.

    In such a vocabulary a segmentation is the right one if, and only if, each pair of neighbours
    is stable: merging the two pieces' text gives the two pieces again. So every position has at
    most one best last piece, found from the positions at most a piece's length before it.
    """

    def __init__(self, path: str, most: int = 1 << 20):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id_of = {model.id_to_piece(i): i for i in plain}
        self.score_of = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.content = [b""] * size
        for piece, i in self.id_of.items():
            self.content[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.byte_ids.items():
            self.content[i] = bytes([value])
        self.sizes_of = np.fromiter(map(len, self.content), np.int64, size)
        self.places_of, self.flat = np.cumsum(self.sizes_of) - self.sizes_of, np.frombuffer(b"".join(self.content), np.uint8)
        self.longest = max(map(len, self.id_of))
        self.cache = Cache(most)
        # Numbers of pieces; then that of a character without a piece, and of a text's beginning.
        self.names = [*self.id_of]
        self.unknown, self.begin = len(self.names), len(self.names) + 1
        self.ids = np.append(np.fromiter(self.id_of.values(), "<u4", len(self.id_of)), np.zeros(2, "<u4"))
        self.codes, self.lengths = characters(self.names)
        self.sizes = sorted(set(self.lengths.tolist()), reverse=True)
        self.scores = np.array([self.score_of[x] for x in self.names])
        self.ranks = np.where(self.lengths > 1, self.scores, np.inf)
        number = {x: i for i, x in enumerate(self.names)}
        halves = [self.halves(x) for x in self.names]
        self.left_half, self.right_half = (np.array([number[h[i]] if h else -1 for h in halves]) for i in (0, 1))
        self.ends = [np.zeros(1 << 16, np.uint32) for _ in range(2)]
        for n, end in ((2, self.ends[0]), (3, self.ends[1])):
            here = np.flatnonzero(self.lengths == 2) if n == 2 else np.flatnonzero(self.lengths >= 3)
            at = ending([self.codes[self.lengths[here] - n + i, here] for i in range(n)])
            np.bitwise_or.at(end, at, np.uint32(1) << self.lengths[here].astype(np.uint32))
        self.prepare(0)

    def prepare(self, turn: int) -> None:
        """The table of pieces by a hash of their characters, and room for answers about pairs."""
        self.turn, self.odd = turn, MULTIPLIERS[turn]
        self.hash = hashes(self.codes, self.lengths, self.odd)[self.lengths, np.arange(len(self.lengths))]
        if len(np.unique(self.hash)) < len(self.hash):
            return self.prepare(turn + 1)
        self.power = np.cumprod(np.append(np.uint64(1), np.full(self.longest, self.odd, np.uint64)))
        self.table = Table(self.hash)
        self.pairs, self.answers = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    # -- which neighbours are stable

    def halves(self, piece: str) -> list[str] | None:
        """The two pieces that a piece is merged from: neighbours merge, highest score first and
        leftmost among equals. None if merging never makes it."""
        parts, score = list(piece), self.score_of
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts if len(parts) == 2 and parts[0] in score and parts[1] in score else None

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For numbers of pieces: whether merging the text of two pieces gives the two again.

        Merges are undone, the latest first: a pair fails if what then touches at the border would
        have merged before the piece that was just undone (among equals, the leftmost first).
        """
        out, live = np.ones(len(left), bool), np.arange(len(left))
        limit, equal_too = np.full(len(left), -np.inf), np.zeros(len(left), bool)
        while len(live):
            joined = self.table.find(self.hash[left] * self.power[self.lengths[right]] + self.hash[right])
            score = np.where(joined >= 0, self.scores[joined], -np.inf)
            bad = (joined >= 0) & ((score > limit) | (equal_too & (score == limit)))
            a, b = self.ranks[left], self.ranks[right]
            undo_left = a < b
            half = np.where(undo_left, self.right_half[left], self.left_half[right])
            whole = ~undo_left & (b == np.inf)
            bad |= ~whole & (half < 0)
            out[live[bad]] = False
            go = ~bad & ~whole
            live, undo_left, half = live[go], undo_left[go], half[go]
            limit, equal_too = np.where(undo_left, a[go], b[go]), ~undo_left
            left, right = np.where(undo_left, half, left[go]), np.where(undo_left, right[go], half)
        return out

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pieces may follow others. Answers are kept by slot, the latest one in each; a
        text's beginning and a character without a piece go with everything."""
        pair = left.astype(np.int64) * len(self.names) + right
        slots = slot_of(pair.view(np.uint64), PAIR_BITS)
        free = left >= self.unknown
        out = self.answers[slots] | free
        miss = np.flatnonzero((self.pairs[slots] != pair) & ~free)
        if len(miss):
            new, at = np.unique(pair[miss], return_inverse=True)
            found = self.apart(new // len(self.names), new % len(self.names))
            out[miss] = found[at]
            # Where two share a slot the same one must win in both tables.
            slots, last = np.unique(slot_of(new.view(np.uint64), PAIR_BITS), return_index=True)
            self.pairs[slots], self.answers[slots] = new[last], found[last]
        return out

    # -- streaming Viterbi

    def window(self, texts: list[str], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At [end, text] the number and the length of the best last piece of each text's first
        ``end`` characters, -1 if there is none; texts come longest first.

        All texts take a step together; of the pieces that end there, the longest is tried first.
        Only lengths of pieces with the same last characters are tried.
        """
        codes, sizes = characters(texts)
        begun, n = hashes(codes, sizes, self.odd), len(texts)
        last, size = np.full((len(begun), n), -1, np.int32), np.zeros((len(begun), n), np.int8)
        last[0] = before
        lengths = np.array(self.sizes, np.uint32)
        for end in range(1, len(begun)):
            rest = np.arange(np.searchsorted(-sizes, -end, "right"))
            may = np.full(len(rest), 2, np.uint32)
            for k in (2, 3):
                if end >= k:
                    may |= self.ends[k - 2][ending([codes[end - k + i, rest] for i in range(k)])]
            # The lengths that may be, for each text from the longest on.
            rows, at = np.nonzero((may[:, None] >> lengths) & np.uint32(1))
            k = lengths[at].astype(np.int64)
            open_ = (k <= end) & (last[np.maximum(end - k, 0), rows] >= 0)
            rows, k = rows[open_], k[open_]
            found = self.table.find(begun[end, rows] - begun[end - k, rows] * self.power[k])
            found = np.where((found < 0) & (k == 1), self.unknown, found)
            rows, k, found = (x[found >= 0] for x in (rows, k, found))
            good = (found == self.unknown) | self.fit(last[end - k, rows], np.minimum(found, self.unknown - 1))
            rows, k, found = (x[good] for x in (rows, k, found))
            new = np.append(True, rows[1:] != rows[:-1])[: len(rows)]
            last[end, rows[new]], size[end, rows[new]] = found[new], k[new]
        return last, size

    def converged(self, last: np.ndarray, size: np.ndarray) -> int:
        """The last boundary on the paths of all positions that a later piece may begin at: those
        at most a piece's length back. 0 if the paths do not converge in the window."""
        end = len(last) - 1
        common = None
        for at in range(max(0, end - self.longest + 1), end + 1):
            if last[at] >= 0:
                on = {at}
                while at > 0:
                    at -= int(size[at])
                    on.add(at)
                common = on if common is None else common & on
        return max(common or {0})

    def streams(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each of which goes through a window of its own, side by side.

        The window takes in ``WINDOW`` characters. Where all surviving paths converge on a boundary,
        the ids up to it are given out, and the window goes on from there behind the piece given
        out last; it grows only while no paths converge. At the text's end its last path is the one.
        """
        out, sizes = [b""] * len(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        index, at, before = np.arange(len(texts)), np.zeros(len(texts), np.int64), np.full(len(texts), self.begin, np.int32)
        first = wide = max(WINDOW, self.longest + 1)
        while len(index):
            order = np.argsort(at - sizes[index], kind="stable")
            index, at, before = index[order], at[order], before[order]
            left = sizes[index] - at
            more, stop = np.flatnonzero(left > wide), np.minimum(left, wide)
            shown = list(map(texts.__getitem__, index.tolist()))
            for j in np.flatnonzero((left > wide) | (at > 0)).tolist():
                shown[j] = shown[j][at[j] : at[j] + wide]
            last, size = self.window(shown, before)
            for j in more.tolist():
                stop[j] = self.converged(last[: wide + 1, j], size[: wide + 1, j])
                shown[j] = shown[j][: stop[j]]
            given, good = self.given(shown, last, size, stop)
            if not good:
                # A hash stood for another text: begin anew with other hashes.
                self.prepare(self.turn + 1)
                return self.streams(texts)
            for i, ids in zip(index.tolist(), given, strict=True):
                out[i] = out[i] + ids if out[i] else ids
            # Where nothing was given out the window grows.
            wide = first if (stop[more] > 0).all() else 2 * wide
            index, at, before = index[more], at[more] + stop[more], last[stop[more], more]
        return out

    def given(self, texts: list[str], last: np.ndarray, size: np.ndarray, stop: np.ndarray) -> tuple[list[bytes], bool]:
        """The ids on each text's path to ``stop``, and whether the pieces are the text indeed."""
        at, live, rows, found = stop.copy(), np.flatnonzero(stop), [], []
        while len(live):
            rows.append(live)
            found.append(last[at[live], live])
            at[live] -= size[at[live], live]
            live = live[at[live] > 0]
        if not rows:
            return [b""] * len(texts), True
        row, number = np.concatenate(rows[::-1]), np.concatenate(found[::-1])
        order = np.argsort(row, kind="stable")
        number, row = number[order], row[order]
        ends = np.searchsorted(row, np.arange(len(texts)), "right")
        odd = np.unique(row[number == self.unknown]).tolist()
        data, out, low = self.ids[number].tobytes(), [], 0
        for high in ends.tolist():
            out.append(data[4 * low : 4 * high])
            low = high
        for i in odd:
            parts, p = [], 0
            for x in number[ends[i - 1] if i else 0 : ends[i]].tolist():
                if x == self.unknown:
                    parts += [self.byte_ids[b] for b in texts[i][p].encode("utf-8", "surrogatepass")]
                    p += 1
                else:
                    parts.append(int(self.ids[x]))
                    p += int(self.lengths[x])
            out[i] = np.array(parts, "<u4").tobytes()
        if odd:
            skip = set(odd)
            number, texts = number[~np.isin(row, odd)], [x for i, x in enumerate(texts) if i not in skip]
        return out, "".join(map(self.names.__getitem__, number.tolist())) == "".join(texts)

    # -- whole texts

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each text has."""
        texts = pc.binary_join_element_wise(" ", pc.replace_substring(texts, SPACE, " "), "")
        raw, at = text_bytes(texts)
        out, counts = [], []
        for i, j in byte_slices(at, 1 << 21):
            ids, n = self.encode_bytes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            out.append(ids)
            counts.append(n)
        return np.concatenate([*out, np.zeros(0, "<u4")]), np.concatenate([*counts, np.zeros(0, np.int64)])

    def encode_bytes(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for UTF-8 bytes of texts that each begin with a space; a text of nothing else
        is empty.

        Texts are taken in as stretches between boundaries on which all paths converge whatever
        stands there: no piece holds a space mark after another character, or a line break, so
        they do before each run of spaces and around each line break. What stretches give is kept.
        """
        begins = np.zeros(len(raw), bool)
        space, line = raw == 32, raw == 10
        begins[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        begins[at[:-1]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(raw))
        empty = np.flatnonzero(np.diff(at) == 1)
        if len(empty):
            keep = ~np.isin(start, at[empty])
            start, end = start[keep], end[keep]
        keys, others = (hashes_of(raw, start, end, seed) for seed in (0, 1))
        low, size, miss = self.cache.find(keys, others)
        if len(miss):
            both = np.stack([keys[miss], others[miss]], axis=1)
            _, first, turn = np.unique(both, axis=0, return_index=True, return_inverse=True)
            new = miss[first]
            texts = [raw[a:b].tobytes().decode("utf-8", "surrogatepass").replace(" ", SPACE) for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            ids = []
            for i in range(0, len(texts), TOGETHER):
                ids += self.streams(texts[i : i + TOGETHER])
            places = self.cache.keep(keys[new], others[new], ids)
            low[miss], size[miss] = places[0][turn], places[1][turn]
        ids = self.cache.ids[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
        sums = np.append(0, np.cumsum(size))
        return ids, np.diff(sums[np.searchsorted(start, at)])

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text]))[0].tobytes()

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids that stand one after another; what is no UTF-8 gives U+FFFD."""
        at, out = np.append(0, np.cumsum(counts)), []
        for i, j in byte_slices(at, 1 << 18):
            here = ids[at[i] : at[j]]
            sizes = self.sizes_of[here]
            ends = np.append(0, np.cumsum(sizes))
            raw = self.flat[np.repeat(self.places_of[here] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
            bounds = ends[at[i : j + 1] - at[i]].tolist()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]
            out += [t[1:] if t.startswith(" ") else t for t in texts]
        return out


class Cache:
    """Ids of stretches by two hashes, 128 bits together. A later stretch takes an earlier one's slot; all begin anew
    when the ids fill their room."""

    def __init__(self, most: int):
        self.bits = (most - 1).bit_length()
        self.room = 8 * most
        self.clear()

    def clear(self) -> None:
        self.keys, self.others = (np.zeros(1 << self.bits, np.uint64) for _ in range(2))
        self.low, self.size = (np.zeros(1 << self.bits, np.int64) for _ in range(2))
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    def find(self, keys: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of stretches begin, how many they are, and which stretches are not there."""
        if self.used > self.room:
            self.clear()
        slots = slot_of(keys, self.bits)
        there = (self.keys[slots] == keys) & (self.others[slots] == others) & (self.size[slots] > 0)
        return self.low[slots], self.size[slots], np.flatnonzero(~there)

    def keep(self, keys: np.ndarray, others: np.ndarray, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Take in stretches; where their ids now begin, and how many they are."""
        size = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        low = self.used + np.cumsum(size) - size
        need = self.used + int(size.sum())
        if need > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(max(need - len(self.ids), len(self.ids)), "<u4"))
        self.ids[self.used : need] = np.frombuffer(b"".join(ids), "<u4")
        self.used = need
        slots = slot_of(keys, self.bits)
        slots, last = np.unique(slots, return_index=True)
        self.keys[slots], self.others[slots], self.low[slots], self.size[slots] = keys[last], others[last], low[last], size[last]
        return low, size


def characters(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, a column for each, and the words' lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.arange(sizes.max())[:, None] + (np.cumsum(sizes) - sizes)[None, :]
    return flat[np.minimum(at, len(flat) - 1)], sizes


def hashes(codes: np.ndarray, sizes: np.ndarray, odd: np.uint64) -> np.ndarray:
    """At [n, word] a hash of the word's first n characters, from which those of all its parts
    follow."""
    out = np.zeros((len(codes) + 1, len(sizes)), np.uint64)
    for i, c in enumerate(codes):
        out[i + 1] = out[i] * odd + c + np.uint64(1)
    return out


def ending(codes: list[np.ndarray]) -> np.ndarray:
    """16-bit hashes of characters, the first ones of all words first."""
    h = np.zeros(len(codes[0]), np.uint64)
    for c in codes:
        h = (h + c) * MULTIPLIERS[1]
    return h >> np.uint64(48)


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """One vocabulary, with what it has learned, for each worker process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(text: Column, path: str | None = None) -> Column:
    """array<int> of ids; null and empty texts have none. Long texts are read whole, in a stream."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        ids, counts = loaded(path).encode_column(texts)
        offsets = np.append(0, np.cumsum(counts)).astype("int32")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view("<i4")))

    return run(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of array<int> ids; null for null, empty for none. Unknown bytes give U+FFFD."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = loaded(path).decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
        return pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))

    return run(ids)


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of ids; null and empty texts have none.

    Texts of any length are read whole, through the window of their stretches. Rows are independent, so
    ties, repeated rows and empty tables need no rule; all other columns stay, and one named as the
    new column is replaced.
    """
    return docs.withColumn(ids, encode(F.col(text), path))


def op6_pieces(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    coded = encode_documents(docs).withColumn("decoded", decode(F.col("ids")))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        "ids",
        F.crc32("decoded").alias("decoded_crc32"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
