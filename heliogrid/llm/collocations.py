"""Phrase collocation mining: frequent contiguous phrases of 2 to 4 words, scored by their weakest cut.

Texts are lower-cased (A-Z only), broken into pieces at ``[.,;:!?\\n-\\r]`` and those into words at blanks and tabs.
Everything is counted per language.

1. Each task turns its texts into blocks of ``BLOCK`` bytes of one language: a list of the block's distinct words with
   their counts, and the texts as places in that list, 0 at each break. Texts are read once and never shuffled.
2. Word counts are summed; words of ``LEAST`` occurrences get 32-bit ids; every other word becomes a break. Each
   block gets back the ids of its own words only, so no dictionary is ever broadcast.
3. A phrase of n words is the pair of ids of its first and its last n-1 words, packed into a key of eight bytes, high
   id first. A task sorts the keys of a block and counts runs, so a key leaves a block once. The keys are
   partitioned by range, sorted by Spark's radix sort and counted as runs that pass by; runs of ``LEAST`` or more get ids. These
   go back to the blocks and are the alphabet of the next length. As a phrase occurs no more often than its parts, none is lost.
4. Scores, containment and ranks are joins on ids and a range partition; no language sits in one task.

Defined results: a null text is empty and counts for nothing; a null language is ``und``; repeated rows count again;
a very long text goes over several blocks, cut at piece breaks, in memory of a few times one block (or of its longest
piece, if that is longer); ties of score and count go by the phrase's bytes; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogrid.llm.common import map_arrow, n_parts, scratch, ship_package, staged

LEAST = 30
TOP = 2000
LONGEST = 4
#: A candidate goes if a longer phrase around it has this share of its occurrences (in hundredths).
CONTAINED = 80
SCALE = 2_000_000
BLOCK = 12 << 20
#: Rows that leave a task at once.
ROWS = 1 << 17
#: Members of frequent runs that a task holds before they leave it, packed by block.
HELD = 1 << 20
#: A-Z to lower case, piece breaks to line feeds, tabs to blanks; bytes of other characters stay.
FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 10 + b" ")
BLOCKS = "block long, lang string, ids binary, words array<string>, counts array<int>"
PARTIAL = "key long, block long, n int"
RUNS = "part int, at long, key long, a long, block long, keys binary, places binary"
IDS = "block long, ids binary"


def _pieces(text: str, size: int) -> Iterator[bytes]:
    """Folded bytes of ``text`` in portions of about ``size``, cut at piece breaks."""
    data, at = text.encode().translate(FOLD), 0
    while len(data) - at > size:
        end = data.rfind(b"\n", at, at + size) + 1 or data.find(b"\n", at + size) + 1 or len(data)
        yield data[at:end]
        at = end
    yield data[at:] if at else data


class _Block:
    """Words of one language on their way into a block."""

    def __init__(self) -> None:
        self.place: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        self.ids: list[np.ndarray] = []

    def add(self, data: bytes) -> None:
        place, out = self.place.__getitem__, []
        for piece in data.split(b"\n"):
            if words := piece.split():
                out += map(place, words)
                out.append(0)
        self.ids.append(np.array(out, np.int32))

    def row(self, block: int, lang: str) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        words, counts = pa.array(list(self.place), pa.binary()).cast(pa.string()), np.bincount(ids, minlength=len(self.place) + 1)[1:]
        one = lambda values: pa.ListArray.from_arrays([0, len(values)], values)
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([lang], pa.string()), pa.array([ids.tobytes()], pa.binary()), one(words), one(pa.array(counts.astype(np.int32)))],
            names=["block", "lang", "ids", "words", "counts"],
        )


def _blocks(size: int):
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: defaultdict[str, _Block] = defaultdict(_Block)
        size_now = 0

        def flush():
            nonlocal number, size_now
            for lang, b in held.items():
                if b.place:
                    yield b.row(number, lang)
                    number += 1
            held.clear()
            size_now = 0

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                for data in _pieces(text.as_py(), size):
                    if size_now and size_now + len(data) > size:
                        yield from flush()
                    held[lang.as_py()].add(data)
                    size_now += len(data)
        yield from flush()

    return run


def _keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed keys of neighbours that are no breaks, and their places."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    return (ids[at].astype(np.uint64) << np.uint64(32) | ids[at + 1]).view(np.int64), at


def _count_block(batches):
    """Of each block: its distinct keys in order, with their run lengths."""
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys = np.sort(_keys(np.frombuffer(ids.as_buffer(), np.uint32))[0])
            starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            lengths = np.diff(starts, append=len(keys)).astype(np.int32)
            keys = keys[starts]
            for k in range(0, len(keys), ROWS):
                part = keys[k : k + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), block, np.int64)), pa.array(lengths[k : k + ROWS])], names=["key", "block", "n"])


def _count_runs(least: int):
    """Sum of each run of equal keys in sorted rows; the rows and the sum of those that reach ``least``.

    A run is held back only until it reaches ``least``, which takes fewer rows than that; from then on its rows pass by.
    """

    def run(batches):
        part, fresh = TaskContext.get().partitionId(), 0
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        open_key, open_sum, open_at = 0, -1, -1  # a run that has passed ``least`` and may go on; none if the sum is -1

        members: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_held = 0

        def batch_of(at, key, a, block, keys, places):
            n = max(len(at), len(block))
            filled = [pa.array(x, k) if len(x) else pa.nulls(n, k) for x, k in zip((at, key, a, block, keys, places), (*[pa.int64()] * 4, pa.binary(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), *filled], names=[f.split()[0] for f in RUNS.split(", ")])

        def packed():
            """The members held so far, a row a block."""
            nonlocal n_held
            keys, blocks, places = (np.concatenate(x) for x in zip(*members, strict=True))
            members.clear()
            n_held = 0
            order = np.argsort(blocks, kind="stable")
            keys, blocks, places = keys[order], blocks[order], places[order]
            starts = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1))
            cut = lambda x: [y.tobytes() for y in np.split(x, starts[1:])]
            return batch_of((), (), (), blocks[starts], cut(keys), cut(places))

        for batch in batches:
            if not batch.num_rows:
                continue
            new = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            keys, blocks, n = (np.concatenate(x) for x in zip(held, new, strict=True))
            starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            sums, heads = np.add.reduceat(n, starts), keys[starts]
            lengths = np.diff(starts, append=len(keys))
            at = np.full(len(starts), -1, np.int64)
            if open_sum >= 0:
                if heads[0] == open_key:
                    sums[0] += open_sum
                    at[0] = open_at
                else:
                    yield batch_of([open_at], [open_key], [open_sum], (), (), ())
                open_sum = -1
            passed = sums >= least
            named = passed & (at < 0)
            at[named] = fresh + np.arange(named.sum())
            fresh += int(named.sum())
            member = np.repeat(passed, lengths)
            if member.any():
                members.append((keys[member], blocks[member], np.repeat(at, lengths)[member]))
                n_held += int(member.sum())
                if n_held >= HELD:
                    yield packed()
            if passed[-1]:
                open_key, open_sum, open_at = int(heads[-1]), int(sums[-1]), int(at[-1])
                held = tuple(x[:0] for x in (keys, blocks, n))
            else:
                held = tuple(x[starts[-1] :] for x in (keys, blocks, n))
            closed = passed.copy()
            closed[-1] = False
            if closed.any():
                yield batch_of(at[closed], heads[closed], sums[closed], (), (), ())
        if members:
            yield packed()
        if open_sum >= 0:
            yield batch_of([open_at], [open_key], [open_sum], (), (), ())

    return run


def _bases(heads: DataFrame) -> list[int]:
    """The number of ids before each partition's first, where ``heads`` has one row an id. One number a partition comes to the driver."""
    sizes = {r["part"]: r["n"] for r in heads.groupBy("part").agg(F.count("*").alias("n")).collect()}
    out = [0]
    for part in range(max(sizes, default=0)):
        out.append(out[-1] + sizes.get(part, 0))
    if out[-1] + sizes.get(len(out) - 1, 0) >= 1 << 32:
        raise OverflowError("a key holds two ids of 32 bits, and one length has more phrases")
    return out


def _numbered(heads: DataFrame, bases: list[int]) -> DataFrame:
    """``heads`` (part, at, ...) with dense 32-bit ``id`` from 1."""
    table = F.split(F.lit(",".join(map(str, bases))), ",").cast("array<long>")  # a literal once planned
    return heads.withColumn("id", F.get(table, F.col("part")) + F.col("at") + 1).drop("part", "at")


def _renamed(blocks: DataFrame, names: DataFrame, bases: list[int] | None = None) -> DataFrame:
    """Blocks in the ids of ``names``; whatever has none becomes a break.

    ``names`` are (block, key, id) of places in the block's own list; with ``bases``, packed members of runs, whose keys are pairs of ids.
    """
    ship_package(blocks.sparkSession)

    def run(left, right):
        if bases is None:
            key, new = (right.column(c).to_numpy() for c in ("key", "id"))
        else:
            get = lambda c: [np.frombuffer(x.as_buffer(), np.int64) for x in right.column(c)]
            first = [np.array([], np.int64), *(bases[p] + 1 + x for p, x in zip(right.column("part").to_pylist(), get("places"), strict=True))]
            key, new = np.concatenate([first[0], *get("keys")]), np.concatenate(first)
        order = np.argsort(key)
        key, new = key[order], new[order].astype(np.uint32)
        out = []
        for ids in left.column("ids").combine_chunks() if len(key) else []:
            old = np.frombuffer(ids.as_buffer(), np.uint32)
            if bases is None:
                table = np.zeros(int(old.max()) + 1, np.uint32)
                table[key] = new
                fresh = table[old]
            else:
                keys, at = _keys(old)
                fresh, k = np.zeros(len(old), np.uint32), np.minimum(np.searchsorted(key, keys), len(key) - 1)
                fresh[at] = np.where(key[k] == keys, new[k], 0)
            # one break stands for any number, so what is left of a block shrinks with its phrases
            out.append(fresh[(fresh > 0) | (np.concatenate([[1], fresh[:-1]]) > 0)].tobytes())
        block = left.column("block").slice(0, len(out))
        return pa.table({"block": block, "ids": pa.array(out, pa.binary())})

    names = names.toDF(*names.columns).withColumnRenamed("block", "of")
    return blocks.select("block", "ids").groupBy("block").cogroup(names.groupBy("of")).applyInArrow(run, IDS)


def _ranked(rows: DataFrame, lang: str, *order: Column) -> DataFrame:
    """``rank`` from 1 within ``lang``, by a range partition: a language's rows go over as many tasks as they need."""
    keys = [F.col(lang), *order]
    held = rows.repartitionByRange(n_parts(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    held = staged(held.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranked")
    sizes = held.groupBy(lang, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(lang).orderBy("_part")) - F.col("_n")
    return held.join(sizes.withColumn("_before", before).drop("_n"), [lang, "_part"]).withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words that occur ``least`` times, and the words of each language.

    The first: lang, n_words, id, left, right (ids of the first and the last n_words - 1 words), phrase, a, pre and suf
    (occurrences of the beginnings and ends of 1, 2, ... words). The second: lang, n.
    """
    spark = docs.sparkSession
    parts = n_parts(spark)
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text")).where("text is not null")
    with scratch(spark) as keep:
        blocks = staged(map_arrow(rows, _blocks(block), BLOCKS), "blocks")
        lists = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
        lists = lists.select("block", "lang", (F.col("at") + 1).cast("long").alias("key"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
        sizes = staged(blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")), "sizes")
        place = F.monotonically_increasing_id()
        words = lists.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        words = staged(words.withColumns({"part": F.shiftright(place, 33).cast("int"), "at": place.bitwiseAND(F.lit((1 << 33) - 1))}), "words")
        words = staged(_numbered(words, _bases(words)), "words")
        names = lists.join(words, ["lang", "word"]).select("block", "key", "id")
        ids = staged(_renamed(blocks, names), "ids")
        one = F.array("a")
        levels = [staged(words.select("lang", F.lit(1).alias("n_words"), "id", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), F.col("word").alias("phrase"), "a", one.alias("pre"), one.alias("suf"), F.col("word").alias("last")), "level")]
        keep(sizes, ids, *levels)
        for n in range(2, longest + 1):
            partial = map_arrow(ids, _count_block, PARTIAL).repartitionByRange(parts, "key").sortWithinPartitions("key")
            runs = staged(map_arrow(partial, _count_runs(least), RUNS), "runs")
            heads = runs.where("block is null").select("part", "at", "key", "a")
            bases = _bases(heads)
            level = _numbered(heads, bases).select("id", "a", F.shiftrightunsigned("key", 32).alias("left"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("right"))
            first = levels[-1].select(F.col("id").alias("left"), "lang", "phrase", "pre")
            second = levels[-1].select(F.col("id").alias("right"), "suf", "last")
            level = level.join(first, "left").join(second, "right")
            levels.append(staged(level.select("lang", F.lit(n).alias("n_words"), "id", "left", "right", F.concat_ws(" ", "phrase", "last").alias("phrase"), "a", F.array_append("pre", F.col("a")).alias("pre"), F.array_append("suf", F.col("a")).alias("suf"), "last"), "level"))
            if n < longest:
                ids = staged(_renamed(ids, runs.where("block is not null").select("block", "part", "keys", "places"), bases), "ids")
            keep(sizes, ids, *levels)
        keep(sizes, *levels)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.drop("last"), sizes


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a / (left + right)), exact for all counts of 64 bits."""
    whole = lambda x: x.cast("decimal(19,0)")
    top = (F.lit(SCALE).cast("decimal(10,0)") * whole(a)).cast("decimal(29,0)")
    return F.call_function("div", top, (whole(left) + whole(right)).cast("decimal(20,0)"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` collocations."""
    found, sizes = phrases(docs, text, lang, least, longest, block)
    found = found.where("n_words > 1")
    # whatever is contained in a longer phrase lies in one that is a word longer and no rarer, so that one decides
    around = found.select((F.col("n_words") - 1).alias("n_words"), F.explode(F.array("left", "right")).alias("id"), "a").groupBy("n_words", "id").agg(F.max("a").alias("around"))
    free = found.join(around, ["n_words", "id"], "left").where(F.expr(f"around is null or cast(around as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * {CONTAINED}"))

    def cut(k: Column) -> Column:
        first, rest = F.get("pre", k - 1), F.get("suf", F.col("n_words") - k - 1)
        return F.struct(cut_score(F.col("a"), first, rest).alias("score"), k.alias("k"), first.alias("l"), rest.alias("r"))

    scored = free.select("lang", "phrase", "a", F.array_min(F.transform(F.sequence(F.lit(1), F.col("n_words") - 1), cut)).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "cut.k")
    ranked = _ranked(scored, "lang", F.col("score").desc(), F.col("a").desc(), F.col("phrase")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k")
