"""Secret scans over a trigram inverted index (operator 5)."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import cut, read, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of a match's group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds with fixed public prefixes that the method adds to the base.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE + ADDED

#: A set of texts is followed exactly up to so many texts; then only their trigrams are kept.
MOST_EXACT = 32

#: Index keys sent to every task at most; beyond, the candidates are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


# ---- trigram queries -------------------------------------------------------------------------


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """What a match must hold, as alternatives, each a set of lower-case trigrams that all occur.

    ``[]`` means that no trigram is mandatory. Alternatives are joined by OR, trigrams by AND;
    letters' case is dropped on both sides of the index, so a query never misses a match.
    """

    def grams(text: str) -> frozenset[str]:
        return frozenset(text[i : i + 3] for i in range(len(text) - 2))

    def both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
        """AND of two queries; the shorter text is kept where the product would grow too large."""
        if not a or not b or len(a) * len(b) > MOST_EXACT:
            return a if len(a) and (not b or len(a) <= len(b)) else b
        return list({x | y for x, y in product(a, b)})

    def flush(exact: list[str]) -> list[frozenset[str]]:
        found = [grams(x) for x in exact]
        return [] if not all(found) else list(set(found))

    def walk(nodes) -> tuple[list[str] | None, list[frozenset[str]]]:
        """(all texts that match, or None if too many or unbounded; the query)."""
        run: list[str] | None = [""]
        query: list[frozenset[str]] = []
        whole = True
        for op, arg in nodes:
            exact: list[str] | None = None
            inner: list[frozenset[str]] = []
            if op is sre.LITERAL:
                exact = [chr(arg).lower()]
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
                exact = sorted({chr(c).lower() for _, c in arg})
            elif op is sre.SUBPATTERN:
                exact, inner = walk(arg[-1])
            elif op is sre.BRANCH:
                parts = [walk(x) for x in arg[1]]
                if all(e is not None for e, _ in parts):
                    exact = sorted({x for e, _ in parts for x in e})
                elif all(q for _, q in parts):
                    inner = list({x for _, q in parts for x in q})
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, body = arg
                one, inside = walk(body)
                if one is not None and (low, high) == (0, 1):
                    exact = sorted({"", *one})
                elif one is not None and low == high and len(one) ** low <= MOST_EXACT:
                    exact = ["".join(x) for x in product(one, repeat=low)]
                elif low > 0:
                    inner = inside
            if exact is not None and len(exact) <= MOST_EXACT and run is not None and len(run) * len(exact) <= MOST_EXACT:
                run = sorted({a + b for a, b in product(run, exact)})
                continue
            whole = False
            query = both(both(query, flush(run or [""])), inner)
            run = exact if exact is not None and len(exact) <= MOST_EXACT else [""]
        if whole:
            return run, flush(run or [""])
        return None, both(query, flush(run or [""]))

    return walk(_parser.parse(pattern))[1]


# ---- the index -------------------------------------------------------------------------------


def trigram_index(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """Postings (trigram, key) of the given trigrams over the lower-cased texts.

    key is the text's 64-bit hash, so copies share postings; two texts that share a hash only
    become candidates together, and every candidate is verified.
    """
    slim = docs.select(F.xxhash64(text_or_empty(text)).alias("key"), F.lower(text_or_empty(text)).alias("t"))
    held = F.array_compact(F.array(*(F.when(F.contains("t", F.lit(g)), F.lit(g)) for g in trigrams)))
    return slim.select("key", F.explode(held).alias("trigram")).distinct()


def _meets(alternatives: list[frozenset[str]], have: str) -> Column:
    """Whether a text's indexed trigrams hold all of one alternative."""
    out = F.lit(False)
    for grams in alternatives:
        out = out | (F.size(F.array_intersect(F.col(have), F.array(*map(F.lit, sorted(grams))))) == len(grams))
    return out


def candidates(docs: DataFrame, rules, text: str = "text") -> DataFrame:
    """(key, kinds): the rules whose trigram query a text meets, found by intersecting postings."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({g for q in asked.values() for grams in q for g in grams})
    index = trigram_index(docs, trigrams, text)
    texts = index.groupBy("key").agg(F.collect_set("trigram").alias("have"))
    kinds = F.array_compact(F.array(*(F.when(_meets(q, "have"), F.lit(kind)) for kind, q in asked.items())))
    return texts.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


# ---- verification ----------------------------------------------------------------------------


def _spans(rule: Rule) -> Column:
    """The rule's matches in ``t`` as an array of (start, kind number, end, kind)."""
    number = [r.kind for r in RULES].index(rule.kind) if rule in RULES else len(RULES)
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all("t", pattern, 0)
    tested = F.regexp_extract_all("t", pattern, rule.group) if rule.group else whole
    gaps = F.split("t", rule.pattern, -1)
    # A match's start: the text between matches up to it and the matches before it.
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>").alias("out"))
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("len"), F.transform(tested, F.length).alias("size"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["len"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["size"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, rules=RULES, text: str = "text", spans: str = "secret_spans") -> DataFrame:
    """``docs`` with one more column: an array of (start, number, end, kind), ordered by start.

    Places count code points; matches of a rule are leftmost and do not overlap; those whose tested
    group is too short are dropped. Rules with mandatory trigrams are tried only on the texts that
    the index names for them; rules without any are tried on every text. Null and empty texts have
    no spans; copies and repeated rows each get their own; other columns are kept, and one named
    as the new column is replaced.
    """
    found = cut(candidates(docs, rules, text))
    key, near = "__secret_key", "__secret_kinds"
    found = found.select(F.col("key").alias(key), F.col("kinds").alias(near))
    if found.count() <= BROADCAST_KEYS:
        found = F.broadcast(found)
    kept = [c for c in docs.columns if c != spans]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), text_or_empty(text).alias("t"))
    rows = rows.withColumn(key, F.xxhash64("t")).join(found, key, "left")
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    arrays = []
    for rule in rules:
        if trigram_query(rule.pattern):
            named = F.array_contains(near, rule.kind)
        else:
            named = F.regexp_like("t", F.lit(rule.pattern))
        arrays.append(F.when(named, _spans(rule)).otherwise(none))
    out = rows.select("row", F.array_sort(F.concat(*arrays)).alias(spans))
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), spans)


def joined(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans become one mark."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, rest)).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets masked in the text; all rows and columns stay."""
    name = "__secret_spans"
    found = find_secrets(docs, text=text, spans=name)
    return found.withColumn(text, masked(F.col(text), F.col(name))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_secrets(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = find_secrets(docs, spans="found").select("doc_id", "found")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return rows.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


