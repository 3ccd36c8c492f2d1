"""Language identification with error-correcting output codes over hashed byte n-grams.

Every learned language has a codeword. For each bit a binary classifier separates the languages
with a 1 from those with a 0: the log odds of two n-gram models, each the even mixture of its
languages' models, so a frequent language doesn't outweigh the others. A text gets the language
whose codeword has the least loss-weighted distance to its margins: the logistic loss of each
bit, weighted by how far apart the two sides of that bit are. Where the runner-up is within
``MARGIN`` of the best, the row is flagged ambiguous.

Training sums n-gram counts a language over partitions, into a table of a row a language; a second pass over that table sums the
languages' models by bit and side. Only these sums come to the driver: 2**15 buckets a bit, and the number of bits grows as the
logarithm of the number of languages. All languages are learned; above ``LANGUAGES``, whose codewords are some 16 MB, training
refuses. Scoring is a narrow map.

Defined results: ``und`` with score 0 for texts that are null or without a letter (Unicode category L), and
for all rows where nothing could be learned; of languages at equal distance the first by name; repeated rows
give repeated results; a very long text is one row like any other, in memory of some 20 times its size; columns
besides those named are left out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import group_arrow, map_arrow, scratch, staged

BUCKETS = 1 << 15
MARGIN = 0.05
#: With more languages than this training fails, none is left out.
LANGUAGES = 20_000
#: Languages whose counts a task holds at a time, 256 kB each.
HELD = 256
#: With more languages than this codewords are distinct, but not chosen for their distance.
COMPARED = 2_000


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))  # isalpha: category L


def _grams(text: str) -> np.ndarray:
    """Buckets of the byte 2-, 3- and 4-grams of the lower-cased text, a blank at both ends."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    two = b[:-1] | b[1:] << 8
    three = two[:-1] | b[2:] << 16
    out = [two * np.uint32(2654435761), three * np.uint32(2246822519)]
    if len(b) > 3:
        out.append((three[:-1] | b[3:] << 24) * np.uint32(3266489917))
    return (np.concatenate(out) >> np.uint32(17)).astype(np.int32)


def codewords(k: int) -> np.ndarray:
    """k distinct rows of +1 and -1: the exhaustive code up to 7 languages, else the best of seeded random ones."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        bits = [[1 if (c >> r) & 1 else -1 for r in range(k)] for c in range(1, 1 << (k - 1))]
        return np.array(bits, float).T
    best, found = -1, None
    width = 6 * int(np.ceil(np.log2(k)))
    for seed in range(200):
        code = np.where(np.random.default_rng(seed).random((k, width)) < 0.5, -1.0, 1.0)
        code = code[:, np.abs(code.sum(0)) < k]
        if k > COMPARED:
            if len(np.unique(code, axis=0)) == k:
                return code
            continue
        agree = code @ code.T  # bits in which two agree less those in which they don't
        apart = int(((code.shape[1] - agree) / 2 + np.eye(k) * 10**6).min())
        if apart > best:
            best, found = apart, code
    return found


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes())


def train(rows: DataFrame) -> dict | None:
    """Model of ``rows`` (text, lang); None if no row has a language and a letter."""

    def run(it):
        sums: dict[str, np.ndarray] = {}

        def flush():
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "counts": [_pack(x) for x in sums.values()]})
            sums.clear()

        for batch in it:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if has_letter(text):
                    got = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    got += np.bincount(_grams(text), minlength=BUCKETS)
                    if len(sums) >= HELD:
                        yield from flush()
        if sums:
            yield from flush()

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, np.int64)
        for x in t.column("counts"):
            total += np.frombuffer(zstandard.decompress(x.as_py()), np.int64)
        return pa.table({"lang": [key[0].as_py()], "counts": [_pack(total)]})

    spark, kind = rows.sparkSession, "lang string, counts binary"
    rows = rows.select("text", F.col("lang").cast("string").alias("lang")).where("lang is not null")
    with scratch(spark) as keep:
        held = staged(group_arrow(map_arrow(rows, run, kind), ["lang"], add, kind), "languages")
        langs = sorted(r["lang"] for r in held.select("lang").limit(LANGUAGES + 1).collect())
        if len(langs) > LANGUAGES:
            raise ValueError(f"more than {LANGUAGES} languages")
        if not langs:
            keep()
            return None
        code = codewords(len(langs))
        of = spark.sparkContext.broadcast(({lang: k for k, lang in enumerate(langs)}, code))

        def sides(it):
            """Of a task's languages the sums of their models, by bit and side."""
            number, words = of.value
            out = np.zeros((words.shape[1], 2, BUCKETS))
            for batch in it:
                for lang, packed in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist()):
                    counts = np.frombuffer(zstandard.decompress(packed), np.int64).astype(float)
                    own = (counts + 0.5) / (counts.sum() + 0.5 * BUCKETS)
                    word = words[number[lang]]
                    out[word > 0, 0] += own
                    out[word < 0, 1] += own
            for bit in np.flatnonzero(out.any((1, 2))).tolist():
                yield pa.RecordBatch.from_pydict({"bit": pa.array([bit], pa.int64()), "sums": pa.array([_pack(out[bit])], pa.binary())})

        def total(key: tuple, t: pa.Table) -> pa.Table:
            return pa.table({"bit": [key[0].as_py()], "sums": [_pack(sum(np.frombuffer(zstandard.decompress(x.as_py())) for x in t.column("sums")))]})

        kind = "bit long, sums binary"
        sums = {r["bit"]: np.frombuffer(zstandard.decompress(r["sums"])).reshape(2, BUCKETS) for r in group_arrow(map_arrow(held, sides, kind), ["bit"], total, kind).collect()}
        keep()
    weights, apart = [], []
    for bit in range(code.shape[1]):
        all_, both = sums[bit].sum(0) / len(langs), ((code[:, bit] > 0).sum(), (code[:, bit] < 0).sum())
        on, off = (sums[bit][k] / n if n else all_ for k, n in enumerate(both))
        w = np.log(on) - np.log(off)
        weights.append(w)
        apart.append(float(((on - off) * w).sum()) + 1e-9)
    apart = np.array(apart)
    # margins in units of half the distance between the sides, so that the loss means the same for every bit
    return {"langs": langs, "code": code, "weights": (np.stack(weights, 1) / (apart / 2)).astype(np.float32), "trust": apart / apart.sum()}


def decode(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, ambiguous) of each row of bit margins."""
    loss = np.logaddexp(0, -4 * margins[:, None, :] * model["code"][None]) @ model["trust"]
    best = loss.argmin(1)
    odds = np.exp(-6 * (loss - loss.min(1, keepdims=True)))
    score = odds.max(1) / odds.sum(1)
    second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    return best, score, second - loss.min(1) < MARGIN


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits and buckets x bits

    def run(it):
        m = held.value
        for batch in it:
            lang, score, doubt = [], [], []
            for text in batch.column("text").to_pylist():
                if m is None or not has_letter(text):
                    lang.append("und"), score.append(0.0), doubt.append(True)
                    continue
                grams = _grams(text)
                count = np.bincount(grams, minlength=BUCKETS) if len(grams) > BUCKETS else None
                total = count @ m["weights"] if count is not None else m["weights"][grams].sum(0, dtype=np.float64)
                b, s, d = decode((total / len(grams))[None], m)
                lang.append(m["langs"][b[0]]), score.append(float(s[0])), doubt.append(bool(d[0]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of doc_id as text, modulo k (null: 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % k, F.lit(0))
