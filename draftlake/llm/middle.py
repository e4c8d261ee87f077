"""Fill-in-the-middle transformation by a sparse index of multibyte characters (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import byte_slices, read, text_bytes, text_or_empty, tidy

# The marks of a prefix, a suffix and a middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are left plain, and so many of the others begin with the suffix.
PLAIN, SUFFIX_FIRST = 10, 20


@dataclass
class Characters:
    """Places of characters in the UTF-8 bytes of some texts, from the multibyte characters alone.

    ``place`` and ``excess`` hold, for each multibyte character of all texts in a row, how many
    characters stand before it, and how many bytes more than characters there are up to its end.
    All else is ASCII, where places differ by a constant.
    """

    place: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray) -> Characters:
        lead = np.flatnonzero(raw >= 0xC0)
        value = raw[lead]
        more = 1 + (value >= 0xE0).astype(np.int64) + (value >= 0xF0)
        excess = np.cumsum(more)
        return cls(lead - (excess - more), excess)

    def characters(self, at: np.ndarray) -> np.ndarray:
        """How many characters stand before byte places ``at`` (each a character's beginning)."""
        # A multibyte character begins, in bytes, after its place and the excess before it.
        begin = self.place + self.excess - np.diff(self.excess, prepend=0)
        return at - self._sum(np.searchsorted(begin, at))

    def bytes(self, at: np.ndarray) -> np.ndarray:
        """How many bytes stand before character places ``at``."""
        return at + self._sum(np.searchsorted(self.place, at))

    def _sum(self, n: np.ndarray) -> np.ndarray:
        return np.append(0, self.excess)[n]


def _joined(parts: list[bytes | memoryview], ends: list[int]) -> pa.Array:
    """Strings whose ends stand in ``ends``, from their parts in a row."""
    data = pa.py_buffer(b"".join(parts))
    offsets = pa.py_buffer(np.array([0, *ends], np.int32).tobytes())
    return pa.Array.from_buffers(pa.string(), len(ends), [None, offsets, data])


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(n, prefix_chars, middle_chars, out) of rows (t, form, h1, h2), a slice of texts at a time."""
    whole, at = text_bytes(batch.column(0))
    forms = batch.column(1).to_pylist()
    draws = [batch.column(i).to_numpy() for i in (2, 3)]
    marks = {x: x.encode() for x in (PREFIX, SUFFIX, MIDDLE)}
    for i, j in byte_slices(at):
        raw, here = whole[at[i] : at[j]], at[i : j + 1] - at[i]
        index = Characters.of(raw)
        begin = index.characters(here)
        n = np.diff(begin)
        one, two = (d[i:j] % (n + 1) for d in draws)
        low, high = np.minimum(one, two), np.maximum(one, two)
        cuts = [here[:-1], index.bytes(begin[:-1] + low), index.bytes(begin[:-1] + high), here[1:]]
        view, parts, ends, size = memoryview(np.ascontiguousarray(raw)), [], [], 0
        for form, a, b, c, d in zip(forms[i:j], *(x.tolist() for x in cuts), strict=True):
            if form == "plain":
                parts.append(view[a:d])
                size += d - a
            else:
                prefix, suffix = (marks[PREFIX], view[a:b]), (marks[SUFFIX], view[c:d])
                first, then = (prefix, suffix) if form == "psm" else (suffix, prefix)
                parts += [*first, *then, marks[MIDDLE], view[b:c]]
                size += d - a + sum(map(len, marks.values()))
            ends.append(size)
        plain = np.array([f == "plain" for f in forms[i:j]], bool)
        counts = [pa.array(n), pa.array(low, mask=plain), pa.array(high - low, mask=plain)]
        yield pa.RecordBatch.from_arrays([*counts, _joined(parts, ends)], ["n", "prefix_chars", "middle_chars", "out"])


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2^32 from the hash of the seed and the key; a null key counts as no text."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with columns n, form, prefix_chars, middle_chars and fim (the transformed text).

    A text of n characters is cut at two places drawn from the hash of seed and key into prefix,
    middle and suffix. Form psm gives the prefix, the suffix, then the middle, each after its mark;
    spm gives the suffix first (``suffix_first`` of a hundred). Plain texts are given as they are:
    ``plain`` of a hundred, all empty texts, and texts that hold a mark, as they could not be read
    back. Characters are Unicode code points.

    Null texts count as empty and null keys as no characters; texts of any length are cut whole;
    rows are independent, so ties, repeated rows and empty tables need no rule (rows of one key and
    length are cut at the same places). All other columns stay; columns named as the new ones are
    replaced.
    """
    t, h = text_or_empty(text), draws(F.col(key), seed)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(t, F.lit(mark))
    form = F.when((t == "") | marked | (h[2] % 100 >= 100 - plain), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    new = ("n", "form", "prefix_chars", "middle_chars", "fim")
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(t.alias("t"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in _cut(batch):
                rest = [batch.column(i).slice(done, len(part)) for i in (4, 1)]
                yield pa.RecordBatch.from_arrays([*rest, *part.columns], ["d", "form", *part.schema.names])
                done += len(part)

    kind = rows.schema["d"].dataType.simpleString()
    found = rows.mapInArrow(tidy(run), f"d {kind}, form string, n long, prefix_chars long, middle_chars long, out string")
    return found.select(*(F.col("d").getField(c).alias(c) for c in kept), "n", "form", "prefix_chars", "middle_chars", F.col("out").alias("fim"))


def restored(fim: Column, form: Column) -> Column:
    """The text that a transformed text was made from. Marks stand in it once, since a text that
    holds one stays plain, and none can arise where a part meets a mark."""
    middle = F.split(fim, MIDDLE, 2)
    one, two = (F.split(F.substring_index(fim, MIDDLE, 1), mark, 2) for mark in (SUFFIX, PREFIX))
    cut = lambda c, mark: F.substring(c, len(mark) + 1, 2**31 - 1)
    psm = F.concat(cut(F.get(one, F.lit(0)), PREFIX), F.get(middle, F.lit(1)), F.get(one, F.lit(1)))
    spm = F.concat(F.get(two, F.lit(1)), F.get(middle, F.lit(1)), cut(F.get(two, F.lit(0)), SUFFIX))
    return F.when(form == "plain", fim).when(form == "psm", psm).when(form == "spm", spm)


def op11_fill_in_middle(spark, sf_dir):
    found = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim", 256).alias("output_sha256"), F.sha2(restored(F.col("fim"), F.col("form")), 256).alias("restored_sha256")
    )
