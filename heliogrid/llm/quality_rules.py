"""Quality rules: a threshold table compiled into one Spark projection.

Every statistic and every verdict is a built-in expression over ``text``; there is
no user function, no shuffle and no join, so the operator streams over any number
of rows at scan speed and filters on other columns still reach the Parquet reader.

Defined results: a null text counts as an empty one (zero words, base_failed);
repeated rows give repeated results; an empty table gives no rows; a very long text is
one row like any other, in memory of a few times its size; extra columns (dotted names too)
pass through ``annotate`` under their own names unless they clash with an output name, in
which case the output wins. A value that equals a threshold passes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import bound

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Function words of the four languages the rules know.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his this are or at from had "
    "der die das und ist nicht ein eine zu den von mit dem sich auf für im des "
    "le la les de des et un une du que est pour qui dans en il au "
    "el los las del y se por con para una su no lo"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject when ``scale * top / over`` is outside [low, high], in texts with ``at_least`` of the statistic ``least``."""

    name: str
    top: str
    over: str | None = None
    scale: float = 1.0
    low: float | None = None
    high: float | None = None
    least: str = "n_words"
    at_least: int = 0


#: The threshold table over the counts of ``statistics``.
RULES = (
    Rule("words", "n_words", low=10),
    Rule("repeated_windows", "n_repeat_words", "n_words", scale=100, high=20, at_least=1),
    Rule("word_length", "word_chars", "n_words", low=2, high=14, at_least=10),
    Rule("symbols", "n_symbols", "n_words", high=0.15, at_least=10),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.3, least="n_lines", at_least=5),
    Rule("stop_words", "n_stop_words", "n_words", low=0.04, at_least=40),
)
#: The counts of the fixed part, and those beside it.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_stop_words")


def _repeat_words(words: Column, n: Column) -> Column:
    """Words covered by five-word windows that occur at least twice, the first one included."""

    def covered(g: Column) -> Column:
        def over(p: Column) -> Column:
            # p: (window hash, place) in order; equal neighbours are repeated windows
            here = lambda k: p[k].g
            again = lambda x, k: ((k > 0) & (here(F.greatest(k - 1, F.lit(0))) == x.g)) | (
                (k < F.size(p) - 1) & (here(F.least(k + 1, F.size(p) - 1)) == x.g)
            )
            places = F.sort_array(F.transform(F.filter(p, again), lambda x: x.i))

            def total(q: Column) -> Column:
                gap = lambda x, k: F.when(k == F.size(q) - 1, 5).otherwise(
                    F.least(F.lit(5), q[F.least(k + 1, F.size(q) - 1)] - x)
                )
                return F.aggregate(F.transform(q, gap), F.lit(0), lambda a, b: a + b)

            return bound(places, total)

        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(bound(pairs, over))

    def windows(h: Column) -> Column:
        at = lambda i, k: h[i + k]
        seq = F.sequence(F.lit(0), F.size(h) - 5)
        return F.transform(seq, lambda i: F.xxhash64(*[at(i, k) for k in range(5)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n < 6, F.lit(0)).otherwise(bound(bound(hashes, windows), covered))


def statistics(text: Column) -> Column:
    """Struct of the counts that the threshold table reads, from one pass over the text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w, n).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    return bound(words, of)


def _broken(s: Column, rule: Rule) -> Column:
    """Whether the statistics ``s`` break ``rule``."""
    v = F.lit(float(rule.scale)) * s[rule.top]
    if rule.over:
        v = v / s[rule.over]
    out = F.lit(False)
    if rule.low is not None:
        out = out | (v < float(rule.low))
    if rule.high is not None:
        out = out | (v > float(rule.high))
    return F.when(s[rule.least] >= rule.at_least, out).otherwise(F.lit(False))


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct of the statistics, ``failed``, ``base_failed`` and ``kept``: one expression, in which all is computed once.

    The parts are bound as lambda variables. Columns of a lower projection would be pasted into every place
    that reads them as soon as a filter is pushed through it.
    """

    def judged(s: Column) -> Column:
        failed = F.array_compact(F.array(*[F.when(_broken(s, r), F.lit(r.name)) for r in rules]))
        # whole numbers decide the two fixed rules, so no rounding can move a text over the line
        base = (s.n_words < 10) | (100 * s.n_repeat_words > 20 * s.n_words)
        own = [s[c].alias(c) for c in (*COUNTS, *MORE)]
        return bound(F.struct(failed.alias("f"), base.alias("b")), lambda x: F.struct(*own, x.f.alias("failed"), x.b.alias("base_failed"), (~x.b & (F.size(x.f) == 0)).alias("kept")))

    return bound(statistics(text), judged)


def annotate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept``, further counts and ``failed`` (names of broken rules)."""
    made = [*COUNTS, "base_failed", "kept", *MORE, "failed"]
    own = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    judged = docs.select(*own, verdict(F.col(f"`{text}`"), rules).alias("__verdict"))
    return judged.select(*own, *[F.col(f"__verdict.{c}").alias(c) for c in made])


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their own columns (clashing names too)."""
    return docs.where(verdict(F.col(f"`{text}`"), rules)["kept"])
