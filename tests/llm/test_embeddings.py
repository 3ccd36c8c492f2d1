from __future__ import annotations

import numpy as np

from heliogrid.llm import embedding_dedup, queries
from tests.conftest import SF

SHAPE = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    ids, links = [r[0] for r in rows], {r[0]: set() for r in rows}
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    for x, (i, v, a) in enumerate(rows):
        for j, w, b in rows[:x]:
            if a is None or a != b or not ok(v) or not ok(w) or len(v) != len(w):
                continue
            p, q = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
            if p @ q / np.sqrt((p @ p) * (q @ q)) >= cosine - 1e-12:
                links[i].add(j), links[j].add(i)
    comp = {}
    for i in sorted(ids):
        if i not in comp:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in comp:
                    comp[k] = i
                    todo += links[k]
    return links, comp


def near(seed=0, groups=12, size=9, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.standard_normal(dim)
        for k in range(size):
            v = base + rng.standard_normal(dim) * (0.13 if k % 2 else 0.02)
            rows.append((len(rows), v.astype(np.float32).tolist(), g % 3))
    return rows


def test_small_table(spark):
    got = queries.op8_embedding_near_dedup(spark, SF).toPandas().set_index("vec_id")
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    links, comp = brute(rows)
    assert {i: (len(links[i]), comp[i]) for i in comp} == {i: (r.n_links, r.component_id) for i, r in got.iterrows()}


def test_recall_and_split_windows(spark, monkeypatch):
    rows = near()
    links, _ = brute(rows)
    total = sum(map(len, links.values()))
    for pieces, tile in ((2000, 500), (7, 3)):
        monkeypatch.setattr(embedding_dedup, "ROWS", pieces)
        got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SHAPE)).toPandas().set_index("vec_id")
        assert 0.98 * total <= got.n_links.sum() <= total
        assert all(got.n_links[i] <= len(links[i]) for i in links)


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, v, 1), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, float("nan"), 0.0], 0), (7, v, None), (8, [], 0), (9, [2.0, 4.0, 6.0], 0), (10, [1.0, None, 3.0], 0), (11, [1.0, 2.0], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SHAPE)).toPandas().set_index("vec_id")
    assert got.n_links.to_dict() == {1: 2, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 2, 10: 0, 11: 0}
    assert got.component_id[9] == 1 and got.component_id[4] == 4 and not got.kept[2] and got.kept[1]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SHAPE)).count() == 0


def test_recall_on_a_whole_table(spark):
    """The embeddings of sf0.1 hold no links; each valid one gets a partner just above the threshold."""
    assert embedding_dedup.recall(0.98) > 0.999
    rng = np.random.default_rng(11)
    rows = []
    for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect():
        v = r.embedding
        if r.label is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v):
            u = np.array(v, float) / np.linalg.norm(v)
            w = rng.standard_normal(len(u))
            w -= (w @ u) * u
            w /= np.linalg.norm(w)
            c = rng.uniform(0.9801, 0.983)
            rows += [(2 * len(rows), u.tolist(), r.label), (2 * len(rows) + 1, (c * u + np.sqrt(1 - c * c) * w).tolist(), r.label)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas()
    got = got.set_index("vec_id").n_links
    total = found = 0
    for label in {r[2] for r in rows}:
        ids, x = zip(*[(r[0], r[1]) for r in rows if r[2] == label])
        x = np.array(x)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        n, mine = (x @ x.T >= 0.98).sum(1) - 1, got[list(ids)].to_numpy()
        assert (mine <= n).all()
        total, found = total + n.sum(), found + mine.sum()
    assert total >= len(rows) and found >= 0.998 * total


def test_output_grows_with_rows_not_pairs(spark, monkeypatch):
    """A group in which all are linked: rows of counts and a forest leave the tasks, and rows of one vec_id count apart."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    rows = [(i % 290, (base + 0.02 * rng.standard_normal(64)).astype(np.float32).tolist(), 0) for i in range(300)]
    sizes = []
    staged = embedding_dedup.staged
    monkeypatch.setattr(embedding_dedup, "staged", lambda df, name: sizes.append((name, staged(df, name))) or sizes[-1][1])
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SHAPE)).toPandas()
    assert len(got) == 300 and set(got.n_links) == {299} and set(got.component_id) == {0}
    assert dict(sizes)["links"].count() <= 2 * 3 * 2 * 300
