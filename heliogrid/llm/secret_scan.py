"""Secret scanning with built-in expressions: fixed patterns, and Markov models compared by likelihood.

Two first-order character models, one of random strings and one of ordinary identifiers, are counted
from labelled samples with plain aggregations. A token of ``MIN_TOKEN`` characters or more is a secret
where the log-likelihood ratio of the two models exceeds ``MIN_RATIO`` a transition. Random
samples are digests in hexadecimal and base 64 (``RANDOM_SAMPLES`` of each, a documented bound) and the values of the
fixed patterns; ordinary samples are all distinct words of the characters of a token, digits included, that
the corpus has outside the spans of the fixed patterns. Smoothing is a share of each row's total, so that the
ratio of a transition doesn't drift with the size of the corpus.

The scan itself is one projection: no shuffle, no join, no user function. The model is a table of
128 * 128 numbers, a fixed size, and travels in the plan. Only the training shuffles, and it sends
each distinct word of a task once, then 16,384 sums.

Places count code points, ends are exclusive. Defined results: a null or empty text has no span;
repeated rows give repeated results; other columns pass through (clashing result names: the result
wins); spans of equal start go in order of their kinds, those of the models last, and a token that touches a
base span is none of theirs; a very long text is one row like any other, in memory of a few times its size; with
an empty table the models are uniform and nothing is found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import bound

#: Fixed patterns with the least length of their last group; kinds in the order that breaks ties of start.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ that are long enough
}
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
MIN_TOKEN = 20
MIN_RATIO = 0.35
RANDOM_SAMPLES = 20_000
#: Stands for a span of the fixed patterns; a word that touches one is no sample.
CUT = "\x01"
WORD = r"(?<![A-Za-z0-9+/_=\x01-])[A-Za-z0-9+/_=-]{8,}+(?!\x01)"
SIZE = 128
#: Weight of the even distribution, as a share of a row's total.
SMOOTHING = 0.25


def _found(text: Column, pattern: str, keep) -> Column:
    """Array of struct(start, end) of the matches m with keep(m), leftmost and non-overlapping."""

    def places(m: Column) -> Column:
        def walk(gaps: Column) -> Column:
            none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

            def step(acc: Column, x: Column) -> Column:
                start = acc.at + F.length(x.gap)
                end = start + F.length(x.m)
                one = F.struct(start.alias("start"), end.alias("end"))
                return F.struct(end.alias("at"), F.when(keep(x.m), F.array_append(acc.out, one)).otherwise(acc.out).alias("out"))

            pairs = F.arrays_zip(m.alias("m"), F.slice(gaps, 1, F.size(m)).alias("gap"))
            return F.aggregate(pairs, none, step, lambda acc: acc.out)

        return F.when(F.size(m) == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(bound(F.split(text, pattern, -1), walk))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def _spans(text: Column, kind: str) -> Column:
    pattern, group, least = PATTERNS[kind]
    return _found(text, pattern, lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least)


def _rows(text: Column) -> Column:
    """All base spans, by start, then kind."""

    def ranked(r: int):
        return lambda x: F.struct(x.start.alias("start"), F.lit(r).alias("rank"), x.end.alias("end"))

    return F.array_sort(F.concat(*[F.transform(_spans(text, k), ranked(r)) for r, k in enumerate(PATTERNS)]))


def _replaced(t: Column, spans: Column, mark: str) -> Column:
    """``t`` with ``mark`` in place of every span; overlapping spans become one."""

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(t, acc.at + 1, x.start - acc.at)
        fresh = F.struct(x.end.alias("at"), F.concat(acc.out, gap, F.lit(mark)).alias("out"))
        return F.when(x.start >= acc.at, fresh).otherwise(F.struct(F.greatest(acc.at, x.end).alias("at"), acc.out.alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc.out, F.substr(t, acc.at + 1)))
    return F.when(F.size(spans) == 0, t).otherwise(done)


def _steps(samples: DataFrame, name: str) -> DataFrame:
    """Counts of character transitions in distinct strings ``s``."""
    at = F.explode(F.sequence(F.lit(1), F.length("s") - 1))
    return (
        samples.where(F.length("s") > 1)
        .select("s", at.alias("i"))
        .select((F.ascii(F.expr("substr(s, i, 1)")) * SIZE + F.ascii(F.expr("substr(s, i + 1, 1)"))).alias("step"))
        .where(f"step between 0 and {SIZE * SIZE - 1}")
        .groupBy("step")
        .agg(F.count("*").alias(name))
    )


def train(docs: DataFrame, text: str = "text") -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each character transition, first * 128 + second.

    Fitted over every document; at most 16,384 sums come to the driver.
    """
    spark = docs.sparkSession
    t = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(RANDOM_SAMPLES).select(F.explode(F.array(F.substr(digest, F.lit(1), F.lit(40)), F.translate(F.base64(F.unhex(digest)), "=", ""))).alias("s"))
    pattern, group, least = PATTERNS["assign"]
    values = F.filter(F.regexp_extract_all("t", F.lit(pattern), F.lit(group)), lambda x: F.length(x) >= MIN_TOKEN)
    known = t.select(F.explode(F.concat(values, F.regexp_extract_all("t", F.lit(PATTERNS["access"][0]), F.lit(0)), F.regexp_extract_all("t", F.lit(PATTERNS["hex"][0]), F.lit(0)))).alias("s"))
    random = made.union(known).distinct()
    plain = bound(_rows(F.col("t")), lambda spans: _replaced(F.col("t"), spans, CUT))
    words = t.select(F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)))).alias("s")).distinct()
    rows = _steps(random, "r").join(_steps(words, "o"), "step", "full").collect()

    def log_model(count: dict[int, int]) -> list[float]:
        out = []
        for a in range(SIZE):
            total = sum(count.get(a * SIZE + b, 0) for b in range(SIZE))
            even = SMOOTHING * total if total else 1.0
            out += [math.log((count.get(a * SIZE + b, 0) + even / SIZE) / (total + even)) for b in range(SIZE)]
        return out

    r, o = ({x["step"]: x[c] for x in rows if x[c]} for c in ("r", "o"))
    return [x - y for x, y in zip(log_model(r), log_model(o), strict=True)]


def score(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the transitions of ``token``."""
    # one string literal, folded to an array when the query is planned
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    code = lambda i: F.ascii(F.substr(token, i, F.lit(1)))
    steps = F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.get(table, code(i) * SIZE + code(i + 1)))
    return F.aggregate(steps, F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0))) / (F.length(token) - 1)


def scan(docs: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: array of struct(start, rank, end) by start; rank 0-2 in order of PATTERNS, 3 for the models."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = [F.col(f"`{c}`") for c in docs.columns if c != "secrets"]

    def added(base: Column) -> Column:
        like = lambda m: score(m, model) > MIN_RATIO
        free = lambda x: ~F.exists(base, lambda y: (y.start < x.end) & (x.start < y.end))
        more = F.transform(F.filter(_found(t, TOKEN, like), free), lambda x: F.struct(x.start.alias("start"), F.lit(len(PATTERNS)).alias("rank"), x.end.alias("end")))
        return F.array_sort(F.concat(base, more))

    return docs.select(*own, bound(_rows(t), added).alias("secrets"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in (*PATTERNS, "markov")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x.rank), x.start.cast("string"), x.end.cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts a base kind, base_sha256 and spans of ``scan`` rows."""
    of = lambda r: F.size(F.filter("secrets", lambda x: x.rank == r)).cast("long")
    base = F.filter("secrets", lambda x: x.rank < len(PATTERNS))
    return scanned.select("doc_id", *[of(r).alias(f"n_{k}") for r, k in enumerate(PATTERNS)], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, model: list[float], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping spans become one."""
    found = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("t")), model, "t")
    new = _replaced(F.col("t"), F.col("secrets"), mark)
    return found.select(*[new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
