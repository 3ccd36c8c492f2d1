"""Mixing sources to target weights: whole copies first, then Pareto order sampling of the rest.

A source's target is its share of the mix, up to ``MOST`` times its own size. Each of its documents is due
target / size copies, times its own importance if one is given. The whole copies of that are certain. What is left over, a number below
1, is the document's inclusion probability p, and documents are ranked by Pareto's order: the odds u / (1 - u) of a random number u of the
document's own over the inclusion odds p / (1 - p). A source takes documents in this order until its words are used up; the one that
crosses the end is taken if that comes nearer.

Built-in functions only. The cut is found without ordering a source: the order's key is cut into digits, the words of a digit are summed, and
only the documents of the digit that crosses the end go on to the next digit, until ``FEW`` are left a source, so a source of any
size is summed in parallel and never sits in one task. Sources are numbered by a range partition.

Random numbers are digests of seed, doc_id and text, so reruns agree. Defined results: a null text has size 0 and is taken 0
times; a null source is a source of its own, the last; rows without or of equal doc_id and text share their random number, and are
then ordered by their place in the table; sources without words have target 0; an importance that is null, zero, negative or not finite counts as 0, and its
document is taken only once no others are left; an empty table gives no rows; a very long text is one row like any other; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogrid.llm.common import n_parts, scratch, staged

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: The mix has this many words for each hundred of the corpus.
PERCENT = 150
#: No source and no document is taken more often than this.
MOST = 2
#: Bits of a digit of the order's key, and its digits: four of the random order, two of the place in the table.
BITS = 12
DIGITS = 6
#: Of so few documents of a source at the cut, the rest is found by adding up in order.
FEW = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*parts: Column, seed: int = 0) -> Column:
    """A number strictly between 0 and 1 from a digest of ``parts`` (48 bits)."""
    one = [F.concat(F.when(p.isNull(), "n").otherwise("v"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts]
    digest = F.sha2(F.concat_ws("\x01", F.lit(str(seed)), *one), 256)
    return (F.conv(F.substr(digest, F.lit(1), F.lit(12)), 16, 10).cast("double") + 0.5) / float(1 << 48)


def pareto(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds; a document of probability 0 comes last."""
    return F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: percent of all sizes shared by weight, none above ``most`` times its size.

    Shares above that stop there and their excess goes to the others by weight, round after round. A round is one sum over the
    sources; its two numbers, exact integers, come to the driver.
    """
    order = F.col("source").asc_nulls_last()
    held = sources.repartitionByRange(n_parts(sources.sparkSession), order).sortWithinPartitions(order)
    held = staged(held.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "sources")
    # a place in a partition counts from its first row; a row for each partition is numbered in one task
    parts = held.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    parts = parts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    table = F.array(*[F.lit(w) for w in weights])
    place = F.col("_before") + F.col("_at") - F.col("_first")
    named = staged(held.join(parts, "_part").select("source", "source_size", F.get(table, F.pmod(place, F.lit(len(weights))).cast("int")).alias("weight")), "weighted")
    cap = F.col("source_size") * most
    whole = lambda c: F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    total, weight = named.agg(whole(F.col("source_size") * percent), whole(F.col("weight"))).first()
    used, left = 0, int(weight)
    share = lambda: F.col("weight") * F.lit(f"{int(total) - 100 * used}").cast("double") / F.lit(float(100 * left))
    while left:
        over = cap <= share()
        stopped, of_weight = named.where(over).agg(whole(cap), whole(F.col("weight"))).first()
        if int(weight) - int(of_weight) == left:
            break
        used, left = int(stopped), int(weight) - int(of_weight)
    target = F.when(cap <= share(), cap.cast("double")).otherwise(share()) if left else cap.cast("double")
    return named.withColumn("target", target)


def _digit(key: Column, k: int, of: int) -> Column:
    return F.shiftright(key, BITS * (of - 1 - k)).bitwiseAND(F.lit((1 << BITS) - 1))


def _cut(docs: DataFrame, rest: DataFrame) -> DataFrame:
    """Rows (source, id) of ``docs`` (source, id, size, key, tie) that come first and whose sizes come nearest to ``rest`` (source, rest).

    A digit after the other: digits before the one that crosses the end are taken whole, those after it not at all.
    """
    taken = []
    for k in range(DIGITS + 1):
        if k == DIGITS or docs.groupBy("source").count().where(F.col("count") > FEW).isEmpty():
            break
        digit = _digit(F.col("key"), k, 4) if k < 4 else _digit(F.col("tie"), k - 4, 2)
        docs = docs.withColumn("digit", digit)
        sums = docs.groupBy("source", "digit").agg(F.sum("size").alias("words"))
        upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("digit")))
        cut = staged(upto.join(rest, F.expr("source <=> of")).where("upto <= rest or upto - words < rest").drop("of"), "cut")
        joined = docs.join(cut.withColumnsRenamed({"source": "of", "digit": "d"}), F.expr("source <=> of and digit = d"))
        taken.append(joined.where("upto <= rest").select("source", "id"))
        docs = staged(joined.where("upto > rest").select("source", "id", "size", "key", "tie"), "crossing")
        rest = staged(cut.where("upto > rest").select(F.col("source").alias("of"), (F.col("rest") - F.col("upto") + F.col("words")).alias("rest")), "rest")
    inside = Window.partitionBy("source").orderBy("key", "tie", "id")
    docs = docs.join(rest, F.expr("source <=> of")).withColumn("upto", F.sum("size").over(inside))
    # the one that crosses the end, if the sum with it is no farther from it than the sum without
    taken.append(docs.where("upto <= rest or (upto - size < rest and upto - rest <= rest - (upto - size))").select("source", "id"))
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, seed: int = 0, importance: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of ``docs`` (doc_id, source, text).

    ``importance``: relative number of copies within a source; equal if none.
    """
    with scratch(docs.sparkSession) as keep:
        rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), seed=seed).alias("u"), (F.lit(1.0) if importance is None else importance.cast("double")).alias("w"))
        rows = rows.withColumn("w", F.when((F.col("w") > 0) & (F.col("w") < float("inf")), F.col("w")).otherwise(0.0))
        rows = staged(rows.withColumn("id", F.monotonically_increasing_id()), "sizes")
        sums = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("w")).alias("weighted")), "sources")
        sources = source_targets(sums.select("source", "source_size"), weights, percent)
        sources = sources.join(sums.select(F.col("source").alias("of"), "weighted"), F.expr("source <=> of")).drop("of")
        sources = staged(sources, "targets")
        due = F.when(F.col("weighted") > 0, F.col("w") * F.col("target") / F.col("weighted")).otherwise(0.0)
        each = rows.join(sources.withColumnRenamed("source", "of"), F.expr("source <=> of")).drop("of")
        each = each.withColumn("due", F.least(due, F.lit(float(MOST)))).withColumn("copies", F.floor("due").cast("long"))
        each = staged(each.withColumn("p", F.col("due") - F.col("copies")), "due")
        certain = each.groupBy("source").agg(F.min("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("words"))
        rest = staged(certain.select(F.col("source").alias("of"), (F.col("target") - F.col("words")).alias("rest")), "rest")
        odds = pareto(F.col("u"), F.col("p"))
        key = F.floor(F.coalesce(odds / (1 + odds), F.lit(1.0)) * float((1 << 48) - 1)).cast("long")
        tie = F.xxhash64("id").bitwiseAND(F.lit((1 << 24) - 1))
        open_ = each.where(f"size > 0 and copies < {MOST}").select("source", "id", "size", key.alias("key"), tie.alias("tie"))
        more = staged(_cut(open_, rest).select("id", F.lit(1).alias("more")), "more")
        keep(each, more)
    out = each.join(more, "id", "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
