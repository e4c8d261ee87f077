"""Toxicity by compression distance (operator 10)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import read

#: Labelled rows that training may fetch, for each class, and texts of them all in all (a document
#: number can have several texts).
SAMPLE, TEXTS = 3_000, 9_000
WINDOW = 40  # bytes, cut at spaces
#: Sizes of the ordinary dictionary, and of the toxic one in each round of its training.
ORDINARY, ROUNDS = 110_000, (16_384, 4_096, 4_096)
#: Bytes that a window must save to count; how much commoner among toxic texts what is kept must be.
SAVED, RATIO = 2, 8.0
#: Scores from which a text is called toxic, and from which it is dropped: likelier toxic than not.
CUT, DROP = 0.3, 0.5


@dataclass(frozen=True)
class Model:
    """Two dictionaries, and steps (gain, probability) from a gain on."""

    ordinary: bytes
    toxic: bytes
    gains: tuple[float, ...]
    odds: tuple[float, ...]


def _trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the samples; a smaller one, then the commonest samples, where they
    are too few to train on."""
    part = 64 if size == ORDINARY else 24
    while size >= 512:
        try:
            return zstandard.train_dictionary(size, samples, k=part, d=6).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    out = b""
    for x, _ in Counter(samples).most_common():
        if len(out) + len(x) > 4 * size:
            break
        out = x + out
    return out


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The whole lower-cased text in stretches of about ``size`` bytes, cut at spaces."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "ignore").split()) + b" "
    out, start = [], 0
    while start < len(raw) - 1:
        end = min(start + size, len(raw))
        if end < len(raw):
            cut = raw.rfind(b" ", start + 1, end)
            end = cut if cut > 0 else (raw.find(b" ", end) % (len(raw) + 1) or len(raw))
        out.append(raw[start : end + 1])
        start = end
    return out


class Scorer:
    """Compressed lengths of a text's windows under both dictionaries.

    The toxic dictionary is put behind the ordinary one, as plain content: a window without toxic
    stretches then compresses alike with both, so the difference is what the toxic text explains.
    """

    def __init__(self, model: Model):
        self.model = model
        self.squeeze = []
        for content in (model.ordinary, model.ordinary + model.toxic):
            params = zstandard.ZstdCompressionParameters(
                window_log=17, hash_log=15, chain_log=16, search_log=5, min_match=5, target_length=32,
                strategy=zstandard.STRATEGY_GREEDY, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.squeeze.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def saved(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves."""
        return len(self.squeeze[0](window)) - len(self.squeeze[1](window))

    def gain(self, text: str) -> float:
        """Bytes saved in windows that save some, against what chance saves in a text of that length."""
        parts = windows(text)
        return sum(max(0, self.saved(w) - SAVED) for w in parts) / math.sqrt(len(parts) + 5)

    def score(self, text: str) -> float:
        return probability(self.model, self.gain(text))


def probability(model: Model, gain: float) -> float:
    """The calibrated step, with a small slope by the gain to order texts on one step."""
    i = int(np.searchsorted(model.gains, gain, side="right")) - 1
    p = model.odds[i] if i >= 0 else 0.0
    return float(min(1.0, max(0.0, 0.98 * p + 0.02 * gain / (gain + 5.0))))


def calibrated(gains: list[float], toxic: list[int]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Isotonic steps: adjacent gains are pooled until the share of toxic texts never falls. A step
    begins halfway between the gains on both sides."""
    blocks: list[list[float]] = []  # least gain, greatest gain, toxic, texts
    for g in sorted(set(gains)):
        hits = [y for x, y in zip(gains, toxic, strict=True) if x == g]
        blocks.append([g, g, sum(hits), len(hits)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, top, y, n = blocks.pop()
            blocks[-1][1:] = [top, blocks[-1][2] + y, blocks[-1][3] + n]
    begins = [b[0] for b in blocks[:1]] + [(a[1] + b[0]) / 2 for a, b in zip(blocks, blocks[1:], strict=False)]
    return tuple(begins), tuple((b[2] + 0.1) / (b[3] + 0.3) if b[2] else 0.0 for b in blocks)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled texts of each class, those of smallest hash.

    Texts are read whole, as scoring reads them; of documents with several texts ``TEXTS`` at most.
    The dictionaries learn from two thirds of the sample, the thresholds from the rest. Rows whose
    crc32(doc_id) mod 4 is 2 are held out: neither learns from them. A document with several labels
    is toxic if one says so; null labels, ids and texts are left out. Without toxic labels the
    model scores everything near 0.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    marked = marked.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    picked = [marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    # At most 2 * sample ids: small enough for every task.
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select("doc_id", F.col("text").alias("t")).where(F.col("t").isNotNull())
    found = texts.join(ids, "doc_id").select("doc_id", "y", "t").orderBy(F.xxhash64("doc_id", "t")).limit(TEXTS).collect()
    return fit([(r["t"], int(r["y"])) for r in found])


def fit(rows: list[tuple[str, int]]) -> Model:
    build = [r for i, r in enumerate(rows) if i % 3]
    tune = [r for i, r in enumerate(rows) if not i % 3]
    ordinary_texts, toxic_texts = ([windows(t) for t, z in build if z == y] for y in (0, 1))
    ordinary = _trained([w for ws in ordinary_texts for w in ws], ORDINARY)
    toxic, kept = b"", toxic_texts
    for size in ROUNDS:
        # Each round learns from the windows that the dictionary of the round before explains.
        trained = _trained([w for ws in kept for w in ws], size)
        toxic = pruned(trained, ordinary, ordinary_texts, toxic_texts) or toxic
        scorer = Scorer(Model(ordinary, toxic, (), ()))
        kept = [[w for w in ws if scorer.saved(w) >= SAVED] for ws in toxic_texts]
    gains, odds = calibrated([scorer.gain(t) for t, _ in tune], [y for _, y in tune])
    return Model(ordinary, toxic, gains, odds)


def pruned(toxic: bytes, ordinary: bytes, ordinary_texts: list[list[bytes]], toxic_texts: list[list[bytes]]) -> bytes:
    """The stretches of a toxic dictionary that save bytes in ``RATIO`` times the share of toxic
    texts than of ordinary ones, the best last. Stretches are cut at spaces."""
    both = Scorer(Model(ordinary, toxic, (), ()))
    stretches = sorted({b" " + x + b" " for x in toxic.split(b" ")[1:-1] if 3 <= len(x) <= 24})
    # Windows that hold the beginning of a stretch, of those in which the dictionary saves anything.
    places: dict[bytes, list[int]] = {x[i : i + 4]: [] for x in stretches for i in (1, 2)}
    saving: list[tuple[bool, int, bytes, int]] = []  # toxic, text, window, its length with the ordinary one
    for y, texts in enumerate((ordinary_texts, toxic_texts)):
        for i, ws in enumerate(texts):
            for w in ws:
                if both.saved(w) >= SAVED:
                    for gram in {w[j : j + 4] for j in range(len(w) - 3)}:
                        if gram in places:
                            places[gram].append(len(saving))
                    saving.append((bool(y), i, w, len(both.squeeze[0](w))))
    good = []
    for x in stretches:
        near = [saving[n] for n in {*places[x[1:5]], *places[x[2:6]]}]
        if len({i for y, i, *_ in near if y}) < 3:
            continue
        squeeze = Scorer(Model(ordinary, x, (), ())).squeeze[1]
        hits = {(y, i) for y, i, w, plain in near if plain - len(squeeze(w)) >= SAVED}
        n = sum(y for y, _ in hits)
        share = n / len(toxic_texts) / ((len(hits) - n + 1) / max(1, len(ordinary_texts)))
        if n >= 3 and share >= RATIO:
            good.append((share, x))
    return b"".join(x for _, x in sorted(good))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1, higher where label 1 is likelier.

    Null and empty texts have no windows and score as texts without any gain; long texts are read
    window by window to their end; rows are independent, copies score alike, and all columns stay
    (one named as the new column is replaced).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for texts in batches:
            yield pd.Series([scorer.score(t or "") for t in texts], dtype="float64")

    return docs.withColumn(name, run(F.coalesce(F.col(text), F.lit(""))))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = DROP) -> DataFrame:
    """The rows that score under ``cut``, with their columns.

    The model learns from ``docs`` and ``labels`` as ``train`` says; nulls, empty and long texts,
    repeated rows and empty tables are as in ``score``.
    """
    name = "__toxicity"
    scored = score(docs, train(docs, labels), name=name)
    return scored.where(F.col(name) < cut).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")), name="score")
    return scored.select(
        "doc_id",
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
