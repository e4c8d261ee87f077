"""Operators 11 to 13 against plain Python on whole small tables and awkward rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from draftlake.llm import counting, lines, manifest, middle, neighbours, pieces, queries
from draftlake.llm.common import text_bytes
from tests.conftest import DATA
from tests.llm.test_operators import AWKWARD, SCHEMA

SMALL = DATA.replace("sf0.001", "sf0.01")
EXTRA = [(20, "Ab<S>c"), (21, "é" * 50), (22, "a\U0001f926b日" * 30), (23, "<|endoftext|>it's <|endoftext|>\n\nwe'll  go"), (24, "x" * 100), (25, "<<P"), (26, "日" * 20000 + "A")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 7 else f"s{(i or 0) % 3}", 0, 1, "x") for i, t in AWKWARD + EXTRA]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# ---- fill in the middle


def cut(key, text):
    h = sha(f"1:{'' if key is None else key}")
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (key, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (key, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    return (key, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")


def test_middle_query(spark):
    rows = [cut(d.doc_id, d.text or "") for d in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    texts = {d.doc_id: d.text or "" for d in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = {(*r[:5], sha(r[5]), sha(texts[r[0]])) for r in rows}
    assert {tuple(r) for r in middle.op11_fill_in_middle(spark, DATA).collect()} == want


def test_middle_awkward(docs):
    got = middle.fill_in_middle(docs.withColumnRenamed("size", "n"))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "set", "n", "form", "prefix_chars", "middle_chars", "fim"]
    rows = got.withColumn("back", middle.restored(got["fim"], got["form"])).collect()
    assert len(rows) == len(AWKWARD + EXTRA)
    for r in rows:
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.fim) == cut(r.doc_id, r.text or "") and r.back == (r.text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(docs.where("false")).count() == 0


def test_index_of_characters():
    text = "a\U0001f926é日b" * 40 + "plain"
    index = middle.Characters.of(np.frombuffer(text.encode(), np.uint8))
    places = np.arange(len(text) + 1)
    want = [len(text[:i].encode()) for i in places]
    assert index.bytes(places).tolist() == want and index.characters(np.array(want)).tolist() == places.tolist()


# ---- token counts


def test_pre_tokens_as_the_library():
    path, r = public_tokenizers.path(counting.VOCABULARY), random.Random(4)
    library, mine = Tokenizer.from_file(path), counting.PreTokens(path)
    # Characters of newer Unicode versions, all kinds of space, and halves of special strings too.
    bits = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "'S", " ", "  ", "\n", "\t", "\r\n", "\u0085", "　", "​", "a", "bc", "Z", "ll", "1", "23", "!", "?!", "é", "日本", "՘", "꟎", "\U0001f926", "<|endoftext|>", "<|"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(4000)] + ["<|endof", "text|>"]
    start, end, of, special = mine.find(*text_bytes(pa.array(texts)))
    data = "".join(texts).encode()
    got = [[] for _ in texts]
    for a, b, i in zip(start.tolist(), end.tolist(), of.tolist(), strict=True):
        got[i].append(data[a:b].decode())
    for i, text in enumerate(texts):
        parts = text.split("<|endoftext|>")
        assert got[i] == [x[a:b] for x in parts for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(x)] and special[i] == len(parts) - 1


@pytest.mark.parametrize("sent", [1 << 18, 25, 0])
def test_counts_as_the_library(spark, docs, sent):
    library = Tokenizer.from_file(public_tokenizers.path(counting.VOCABULARY))
    for df in (spark.read.parquet(f"{DATA}/documents.parquet"), docs):
        want = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False))) for r in df.collect()), key=repr)
        got = counting.count_tokens(df, sent=sent)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == want
        assert got.where("over_limit <> (n_tokens > 1024)").count() == 0
    assert counting.count_tokens(docs.where("false"), sent=sent).count() == 0


def test_keys_are_exact_or_hashed():
    words = [b"a", b"a\0", b"", b"exactly15bytes!", b"exactly15bytes?", b"sixteen bytes !!", b"sixteen bytes !?"]
    ends = np.cumsum([*map(len, words)])
    low, high = counting.keys(np.frombuffer(b"".join(words), np.uint8), ends - [*map(len, words)], ends)
    assert len(set(zip(low.tolist(), high.tolist(), strict=True))) == len(words)


# ---- manifest


def climb(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, place):
    out = []
    for level in levels[:-1]:
        low = place // 16 * 16
        out.append(("".join(level[low:place]), "".join(level[place + 1 : low + 16])))
        place //= 16
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified), level by level."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {s: climb([leaf(r, r.text) for r in groups[s]]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    for i, s in enumerate(names):
        for place, r in enumerate(groups[s]):
            path, text = way(trees[s], place) + way(top, i), r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = leaf(r, text)
            for before, after in path:
                h = sha(before + h + after)
            yield (r.doc_id, trees[s][0][place], trees[s][-1][0], top[-1][0], sha("".join(b + a for b, a in path)), h, h == top[-1][0])


def told(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, manifest.op13_manifest(spark, str(tmp_path)).collect()), key=repr)


def test_manifest_awkward(spark, docs, tmp_path):
    got = told(spark, docs, tmp_path)
    assert got == sorted(brute(docs.collect()), key=repr) and len(got) == len(AWKWARD + EXTRA)


def test_manifest_of_many_levels(spark, tmp_path):
    """A source of 4,097 rows (four levels, a last run of one), one of 257, and 20 of a single row."""
    rows = [(i, f"Text {i % 50}", "en", "big", 1) for i in range(4097)] + [(i, "T", None, "b", 2) for i in range(257)] + [(i, "q", "en", f"s{i}", 3) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert told(spark, df, tmp_path) == sorted(brute(df.collect()), key=repr)


def test_manifest_of_one_row_and_none(spark, docs, tmp_path):
    one = docs.where("doc_id = 20")
    [row] = told(spark, one, tmp_path / "one")
    assert row[1] == row[2] == row[3] and row[4] == sha("")
    assert told(spark, docs.where("false"), tmp_path / "none") == []


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_manifest"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    found, said = queries.QUERIES[name](spark, SMALL), con.sql(queries.ORACLES[name])
    assert found.columns == said.columns and sorted(map(tuple, found.collect())) == sorted(said.fetchall())


# ---- words that a sum over bytes and powers takes for one


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 8192])
def test_words_of_one_power_sum(spark, n):
    one = thue_morse(n)
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, other), (3, one[1:] + one[0])], "doc_id long, text string")
    texts = {r.text for r in docs.collect()}
    assert {r.text for r in lines.dedup_lines(docs).collect()} == texts
    classes = {r.k: r["class"] for r in neighbours.near_copies(docs).collect()}
    assert len(set(classes.values())) == len(texts)
    import sentencepiece

    path = public_tokenizers.path(pieces.VOCABULARY)
    library, mine = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path)
    ids, counts = mine.encode_column(pa.array([one, other]))
    assert [ids[: counts[0]].tolist(), ids[counts[0] :].tolist()] == [library.encode(one), library.encode(other)]


def test_string_keys_and_exact_threshold(spark):
    words = [f"w{i}" for i in range(300)]
    text, near = " ".join(words), " ".join(words[:150] + ["changed"] + words[151:])
    docs = spark.createDataFrame([("a", text), ("b", near), ("c", "other words here"), (None, "x")], "doc_id string, text string")
    got = {r.k: (r["class"], r.links) for r in neighbours.near_copies(docs).collect()}
    assert got["a"] == got["b"] == ("a", 1) and got["c"] == ("c", 0)
    assert neighbours.keep_one(docs).count() == 3
    # 40 of 50 elements are shared: linked; one element more on one side: not.
    for extra, links in ((0, 1), (1, 0)):
        a, b = np.arange(45, dtype=np.uint64), np.append(np.arange(40), np.arange(100, 105 + extra)).astype(np.uint64)
        both = neighbours.overlaps([a, b])
        assert both.tolist() == [[45, 40], [40, 45 + extra]]
        assert (5 * both[0, 1] >= 4 * (90 + extra - both[0, 1])) == bool(links)
