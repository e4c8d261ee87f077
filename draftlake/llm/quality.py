"""Quality rules by compression bands (operator 8)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from draftlake.llm.common import read

#: (from so many UTF-8 bytes, least and greatest ratio of compressed to plain bytes). The ratio
#: falls as a text grows, so each length has its own band.
BANDS = ((0, 0.35, 1.5), (150, 0.35, 0.90), (300, 0.34, 0.95), (1_000, 0.30, 0.85), (4_000, 0.27, 0.75), (16_000, 0.25, 0.70))
#: The same for fixed chunks of these bytes; what is left over belongs to the last chunk. A text of
#: one chunk or more is rejected if half of its chunks of one size, or more, lie outside.
CHUNKS = ((1_024, 0.30, 0.75), (4_096, 0.27, 0.75))
SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"


def _band(size: int, bands) -> tuple[float, float] | None:
    fitting = [b for b in bands if size >= b[0]]
    return fitting[-1][1:] if fitting else None


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words that stand in a window of ``width`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    hit = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.fromiter((often[w] > 1 for w in windows), bool, len(windows)))
    np.add.at(hit, at, 1)
    np.add.at(hit, np.minimum(at + width, len(words)), -1)
    return int((np.cumsum(hit[:-1]) > 0).sum())


def parts(raw: bytes, size: int) -> list[bytes]:
    """Chunks of ``size`` bytes, the last one with what is left over; none of a shorter text."""
    starts = range(0, len(raw) - size + 1, size)
    return [raw[i : i + size] if i + 2 * size <= len(raw) else raw[i:] for i in starts]


def measures(text: str, squeeze, bands=BANDS, chunks=CHUNKS) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    repeated = repeat_words(words)
    failed = n < 10 or 100 * repeated > 20 * n
    whole = len(squeeze(raw)) / len(raw) if raw else 1.0
    band = _band(len(raw), bands)
    good = band is None or band[0] <= whole <= band[1]
    outside = 0
    for size, low, high in chunks:
        pieces = parts(raw, size)
        here = sum(not low <= len(squeeze(x)) / len(x) <= high for x in pieces)
        good = good and not (pieces and 2 * here >= len(pieces))
        outside += here
    return (
        n,
        len(text) - sum(map(text.count, SPACE.decode())),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        failed,
        good and not failed,
        whole,
        outside,
    )


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks_outside long"


def quality(docs: DataFrame, text: str = "text", key: str = "doc_id", level: int = 3, bands=BANDS) -> DataFrame:
    """Word, line and symbol counts and the verdict of the compression bands, a row for each row.

    chunks_outside counts the chunks of all sizes that lie outside their bands.
    Null text counts as empty: no words, base_failed, not kept. Texts of any length are measured
    whole, one at a time. Rows are independent, so ties, repeated rows and empty tables need no
    rule; other columns are not looked at.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=level, write_content_size=False).compress
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            rows = [measures(x, squeeze, bands) for x in batch["t"]]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, key, batch["k"].to_numpy())
            yield out

    return docs.selectExpr(f"`{key}` as k", f"coalesce(`{text}`, '') as t").mapInPandas(run, f"`{key}` {kind}, {COLUMNS}")


def op8_quality(spark, sf_dir):
    return quality(read(spark, sf_dir, "documents"))
