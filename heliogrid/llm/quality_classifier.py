"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text becomes a short vector of statistics (one narrow pass), kept in a staged table. Standardised,
it is mapped to cosines of random projections, whose inner products approximate a Gaussian kernel.
Labelled rows add up, partition by partition, to the normal equations of a ridge regression,
separately for ``FOLDS`` folds: the sums of all folds give the model, the sums without one fold give
the scores of that fold's rows, unseen, on which the isotonic calibration is fitted. It is fitted on
``BINS`` equal steps of the score, whose counts are summed by Spark. All that reaches
the driver has a fixed size.

Defined results: a null or empty text has statistics of zero and gets a score; a label that is null is
left out; a doc_id with several labels counts with their mean; without any label the score is 0.5;
repeated rows give repeated results; equal texts get equal scores; a very long text is one row like any other, in
memory of a few times its size; columns besides doc_id and text are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import group_arrow, map_arrow, staged
from heliogrid.llm.hashing import SPACE
from heliogrid.llm.quality_rules import STOP_WORDS

FEATURES = 256
FOLDS = 3
BINS = 1000
RIDGE = 1.0
SLICE = 32
STOPS = frozenset(STOP_WORDS)

_CLASSES = [np.zeros(256, bool) for _ in range(8)]
_CLASSES[0][65:91] = True
_CLASSES[1][97:123] = True
_CLASSES[2][48:58] = True
_CLASSES[3][:] = SPACE
_CLASSES[4][10] = True
_CLASSES[5][[ord(c) for c in "#*$%&|<>@^~=_\\{}[]"]] = True
_CLASSES[6][[ord(c) for c in "!?"]] = True
_CLASSES[7][128:] = True
CLASSES = np.stack(_CLASSES, 1).astype(float)


def statistics(text: str) -> list[float]:
    """Length, character classes, words, repeats and lines of one text."""
    if not text:
        return [0.0] * 21
    b = np.frombuffer(text.encode(), np.uint8)
    share = np.bincount(b, minlength=256) @ CLASSES / len(b)
    words = text.split()
    n = max(1, len(words))
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    ends = sum(x[-1] in ".!?:\"'" for x in lines)
    again = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(len(b)), np.log1p(len(words)), *share.tolist(),
        sum(map(len, words)) / n, len(count) / n, max(count.values(), default=0) / n, again / n, pairs / max(1, len(words) - 1),
        sum(v for w, v in count.items() if w in STOPS) / n, sum(v for w, v in count.items() if w.isupper()) / n,
        len(set(lines)) / m, ends / m, np.log1p(m), np.log1p(len(words) / m),
    ]


WIDTH = 21


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and stats of every document, staged."""

    def run(it):
        for batch in it:
            got = [statistics(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return staged(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, stats array<double>"), "stats")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


class Fourier:
    """Standardised statistics to cosine features, a constant last."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        self.mean, self.deviation = mean, deviation
        rng = np.random.default_rng(1_729)
        self.w = rng.standard_normal((WIDTH, FEATURES)) / np.sqrt(2.0 * WIDTH)
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * 4 * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def fit(rows: DataFrame) -> dict | None:
    """Model of labelled rows (doc_id, stats, y); None without rows."""
    rows = staged(rows.select("stats", F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold")), "labelled")
    stat = lambda k: F.get("stats", F.lit(k))
    m = rows.agg(F.count("*").alias("n"), *[F.avg(stat(k)) for k in range(WIDTH)], *[F.stddev_pop(stat(k)) for k in range(WIDTH)]).first()
    if not m[0]:
        return None
    mean, deviation = np.array(m[1 : WIDTH + 1]), np.maximum(np.array(m[WIDTH + 1 :]), 1e-6)
    fourier = Fourier(mean, deviation)
    size = FEATURES + 1

    def sums(it):
        total = np.zeros((FOLDS, size, size + 1))
        for batch in it:
            z, y, fold = fourier(_matrix(batch)), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for f in range(FOLDS):
                at = fold == f
                if at.any():
                    total[f] += z[at].T @ np.hstack([z[at], y[at, None]])
        if total.any():
            cuts = [(f, s) for f in range(FOLDS) for s in range(0, size, SLICE)]
            yield pa.RecordBatch.from_pydict({"fold": [f for f, _ in cuts], "first": [s for _, s in cuts], "part": [total[f, s : s + SLICE].tobytes() for f, s in cuts]})

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in t.column("part"))
        return pa.table({"fold": [key[0].as_py()], "first": [key[1].as_py()], "part": [total.tobytes()]})

    kind = "fold long, first long, part binary"
    eqs = np.zeros((FOLDS, size, size + 1))
    for r in group_arrow(map_arrow(rows, sums, kind), ["fold", "first"], add, kind).collect():
        got = np.frombuffer(r["part"]).reshape(-1, size + 1)
        eqs[r["fold"], r["first"] : r["first"] + len(got)] = got
    eye = RIDGE * np.eye(size)
    eye[-1, -1] = 1e-6
    solve = lambda e: np.linalg.solve(e[:, :size] + eye, e[:, size])
    whole = eqs.sum(0)
    beta, unseen = solve(whole), np.stack([solve(whole - eqs[f]) for f in range(FOLDS)])

    def bins(it):
        n, s = np.zeros(BINS), np.zeros(BINS)
        for batch in it:
            raw = (fourier(_matrix(batch)) * unseen[batch.column("fold").to_numpy()]).sum(1)
            at = _bin(raw)
            n += np.bincount(at, minlength=BINS)
            s += np.bincount(at, batch.column("y").to_numpy(), minlength=BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bin": at, "n": n[at], "s": s[at]})

    got = map_arrow(rows, bins, "bin long, n double, s double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("bin").collect()
    x, level = isotonic(np.array([r["bin"] for r in got], float), np.array([r["n"] for r in got]), np.array([r["s"] for r in got]))
    return {"fourier": fourier, "beta": beta, "x": x, "level": level}


def _bin(raw: np.ndarray) -> np.ndarray:
    """Equal steps of the raw score between -0.5 and 1.5."""
    return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)


def isotonic(x: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and levels of the blocks that pooling adjacent violators leaves; one prior row of either label in each."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, n, s):
        blocks.append([a * b, b, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    centre = np.array([b[0] / b[1] for b in blocks])
    level = np.array([(b[2] + 0.02) / (b[1] + 0.04) for b in blocks])
    return centre, np.maximum.accumulate(level)


def score(stats: DataFrame, model: dict | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of staged statistics."""
    held = stats.sparkSession.sparkContext.broadcast(model)

    def run(it):
        m = held.value
        for batch in it:
            if m is None:
                out = np.full(batch.num_rows, 0.5)
            else:
                raw = m["fourier"](_matrix(batch)) @ m["beta"]
                at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS)
                # a little of the raw score keeps the order within a level
                out = np.clip(0.999 * np.interp(at, m["x"], m["level"]) + 0.001 * at / BINS, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_arrow(stats, run, "doc_id long, score double, predicted int")
