"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.session import shared_folder


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: a lost executor costs no more."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def give_back() -> None:
    """Return freed memory to the system: a worker lives on, and holds what its allocators keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, and at the end of its task memory is given back to other stages' workers."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied


def slices(texts: Sequence[str], limit: int = 1 << 20) -> Iterator[slice]:
    """Runs of texts of about ``limit`` characters, so that no batch's words fill the memory."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# ---- words of many texts at once ---------------------------------------------------------------

#: A word of more bytes than this is hashed alone.
LONG_WORD = 1 << 8
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: What a word's last, shorter piece of eight bytes keeps of the bytes that stand there.
KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings without nulls, and where each string begins and ends."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def byte_slices(at: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last
        first = last


@dataclass
class Words:
    """The words (ASCII white space between them) of texts: first and last place, hash and text."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray


def words_of(raw: np.ndarray, at: np.ndarray) -> Words:
    blank = BLANK[raw]
    begins = ~blank
    begins[1:] &= blank[:-1]
    ends = ~blank
    ends[:-1] &= blank[1:]
    inner = at[(at > 0) & (at < len(raw))]
    begins[inner] = ~blank[inner]
    ends[inner - 1] = ~blank[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, hashes_of(raw, start, end), np.searchsorted(at, start, "right") - 1)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, "<u8", padded.data, strides=(1,))


def hashes_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of stretches of bytes; another seed gives independent ones.

    Eight bytes of all stretches are taken in at a time, and the hash is mixed before the next:
    stretches of up to eight bytes and one length never share a hash, and the order of the pieces
    counts. A long stretch is hashed alone.
    """
    size, window = end - start, eights(raw)
    # What a hash begins with is looked up by the length.
    begin = mixed(np.arange(LONG_WORD + 2, dtype=np.uint64) + np.uint64(seed << 32))
    out = mixed(begin[np.minimum(size, LONG_WORD + 1)] ^ (window[start] & KEPT[np.minimum(size, 8)]))
    live, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(live):
        piece = window[start[live] + done] & KEPT[np.minimum(size[live] - done, 8)]
        out[live] = mixed(out[live] ^ piece)
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes(), seed)
    return out
