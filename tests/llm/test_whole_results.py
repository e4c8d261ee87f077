"""Whole results of the queries against plain Python, and planted cases in the pipeline's stages."""

import random
import zlib
from collections import Counter

import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from draftlake.llm import neighbours, quality, toxicity
from tests.conftest import DATA

SMALL = DATA.replace("sf0.001", "sf0.01")


def test_quality_verdicts(spark):
    """kept, ratio and chunks_outside anew: a band for each length, every chunk, half of them at most outside."""
    squeeze = zstandard.ZstdCompressor(level=3, write_content_size=False).compress
    rows = {r.doc_id: r for r in quality.op8_quality(spark, DATA).collect()}
    for d in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        raw, got = (d.text or "").encode(), rows[d.doc_id]
        ratio = len(squeeze(raw)) / len(raw) if raw else 1.0
        low, high = next((lo, hi) for least, lo, hi in reversed(quality.BANDS) if len(raw) >= least)
        good, outside = low <= ratio <= high, 0
        for size, lo, hi in quality.CHUNKS:
            n = len(raw) // size
            chunks = [raw[i * size : (i + 1) * size if i < n - 1 else len(raw)] for i in range(n)]
            bad = sum(not lo <= len(squeeze(c)) / len(c) <= hi for c in chunks)
            good, outside = good and (not n or 2 * bad < n), outside + bad
        assert (got.kept, got.chunks_outside) == (good and not got.base_failed, outside)
        assert abs(got.ratio - ratio) < 1e-12


def test_toxicity_scores(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, SMALL).collect()}
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    hit = false = toxic = 0
    for d in docs.collect():
        r = got[d.doc_id]
        assert abs(r.score - scorer.score(d.text or "")) < 1e-9 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        if r.held_out and d.doc_id in marked:
            hit, false, toxic = hit + (r.predicted and marked[d.doc_id]), false + (r.predicted and not marked[d.doc_id]), toxic + marked[d.doc_id]
    assert hit >= 0.4 * toxic and false <= max(2, hit)


def test_links_at_a_larger_size(spark):
    """Link counts of 1,000 documents, by an index of shingles from each to its texts."""
    rows = [(r.doc_id, set(neighbours.shingles(r.text or "").tolist())) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    places = {}
    for i, (_, s) in enumerate(rows):
        for x in s:
            places.setdefault(x, []).append(i)
    want = {}
    for i, (k, s) in enumerate(rows):
        common = Counter(j for x in s for j in places[x] if j != i)
        want[k] = sum(n >= 0.8 * (len(s) + len(rows[j][1]) - n) for j, n in common.items())
    assert {r.doc_id: r.n_links for r in neighbours.op3_ngram_join(spark, SMALL).collect()} == want


def test_prefixes_are_shortened_as_far_as_needed(spark):
    """Texts just above the similarity need shorter prefixes than copies with one word changed."""
    r = random.Random(9)
    one = lambda n, far: [" ".join(x) for base in [[f"v{r.randrange(10**6)}" for _ in range(200)] for _ in range(n)] for x in (base, [f"new{i}" if i % 5 == 2 and i < far else w for i, w in enumerate(base)])]
    for far in (5, 21):
        texts = one(40, far)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert all(x.links == 1 for x in neighbours.near_copies(docs).collect())
    near = 1 - neighbours.meet_chance(0.97, 8)
    assert near < 0.0005 < 1 - neighbours.meet_chance(0.8, 8)


def test_pipeline_on_planted_rows(spark, tmp_path):
    """Copies go, near copies leave only what is their own, secrets are masked, clean texts stay; nulls,
    empty texts and repeated rows pass through."""
    r = random.Random(11)
    line = lambda: " ".join(f"q{r.randrange(10**6)}" for _ in range(12))
    clean = [(i, "\n".join(line() for _ in range(8))) for i in range(60)]
    near = clean[0][1].split("\n")
    near[3] = line()
    rows = [*clean, (100, clean[1][1]), (101, "\n".join(near)), (102, f"{line()}\npassword = hunter2hunter2"), (103, None), (104, ""), (105, clean[2][1]), (105, clean[2][1])]
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.lines(spark, docs, str(tmp_path))
    texts = {x.doc_id: x.text for x in kept.collect()}
    assert set(range(60)) <= set(texts) and 100 not in texts and texts[101] == near[3]
    ids = {x.doc_id for x in corpus_pipeline.neighbours(spark, docs, str(tmp_path)).collect()}
    assert set(range(60)) <= ids and not ids & {100, 105}
    packed = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    assert set(range(60)) <= {x.doc_id for x in packed} and 100 not in {x.doc_id for x in packed}
    masked = {x.doc_id: x.text for x in corpus_pipeline.secrets(spark, docs, str(tmp_path)).where(F.col("doc_id").isin(102, 103)).collect()}
    assert masked[102].endswith("[SECRET]") and masked[103] is None
