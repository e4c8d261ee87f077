"""Splitting of document elements into chunks at meaningful places."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import exprs as E

# Where a text may be split, best place first.
SEPARATORS = ("\n\n", "。\n", "；\n", "。", "；", "，", "\n")
#: Bytes of texts, about, that a task splits at a time.
SLICE = 1 << 20
TOKEN = re.compile("[一-鿿]|[a-zA-Z0-9]+")


def n_tokens(text: str) -> int:
    return len(TOKEN.findall(text))


def split_text(text: str, most: int, overlap: int, level: int = 0) -> list[str]:
    """Pieces of at most ``most`` tokens: the parts between separators are gathered greedily and a
    new piece begins with the end of the last one, unless that would make it too long itself."""
    text = text.strip()
    if not text:
        return []
    if n_tokens(text) <= most:
        return [text]
    while level < len(SEPARATORS) and SEPARATORS[level] not in text:
        level += 1
    if level == len(SEPARATORS):
        size, step = 2 * most, 2 * (most - overlap)
        return [text[i : i + size] for i in range(0, len(text), step)]
    sep = SEPARATORS[level]
    pieces: list[str] = []
    now, held = [], 0
    for part in text.split(sep):
        n = n_tokens(part)
        if now and held + n > most:
            whole = sep.join(now)
            pieces.append(whole)
            tail = whole[-2 * overlap :] if overlap else ""
            now, held = ([tail], n_tokens(tail)) if tail and n_tokens(tail) + n <= most else ([], 0)
        now.append(part)
        held += n
    pieces.append(sep.join(now))
    out: list[str] = []
    for p in pieces:
        out += split_text(p, most, overlap, level + 1) if n_tokens(p) > most else [p]
    return out


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[pa.Array]:
    """A batch in runs of texts that have less than ``limit`` bytes behind the first one: a batch may
    hold thousands of long texts, and neither they nor their pieces are all held as Python's strings."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(size // limit)) + 1, len(texts)]).tolist()
    for a, b in itertools.pairwise(cuts):
        yield texts.slice(a, b - a)


def chunk_documents(elements: DataFrame, most: int = 512, overlap: int = 64, least: int = 50) -> DataFrame:
    """(doc_id, chunk_index, section, content, token_count) from (doc_id, element_idx, content, element_type).

    Only the split runs in Python, row by row; sections and chunk numbers are windows per document.
    Tables and recognised images stay whole; other pieces under ``least`` tokens are dropped.
    """
    if overlap >= most:
        raise ValueError("overlap must be smaller than the chunk size")

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in slices(texts):
                yield pa.array([split_text(t or "", most, overlap) for t in part.to_pylist()], pa.list_(pa.string()))

    order = Window.partitionBy("doc_id").orderBy("element_idx")
    whole = F.col("element_type").isin("table", "image_ocr")
    heading = F.when(~whole, E.detect_section(F.col("content")))
    e = elements.withColumn("section", F.last(heading, ignorenulls=True).over(order))
    e = e.withColumn("pieces", F.when(whole, F.array("content")).otherwise(split("content")))
    p = e.select("doc_id", "element_idx", "element_type", "section", F.posexplode("pieces").alias("n", "piece"))
    p = p.where(whole | (E.count_tokens(F.col("piece")) >= least))
    content = E.inject_prefix(F.col("piece"), F.col("section"))
    number = Window.partitionBy("doc_id").orderBy("element_idx", "n")
    return p.select("doc_id", (F.row_number().over(number) - 1).alias("chunk_index"), "section", content.alias("content"), E.count_tokens(content).alias("token_count"))
