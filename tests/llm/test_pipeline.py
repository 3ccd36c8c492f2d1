"""Every stage of the pipeline against a plain re-statement on what the stage before it kept."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from heliogrid.llm.quality_rules import RULES, STOP_WORDS
from tests.conftest import SF
from tests.llm.test_text_operators import brute_components, brute_removed, brute_rules, brute_secrets, check_packing, words


def keeps(text):
    n, chars, symbols, dup, repeat = brute_rules(text)
    if n < 10 or 100 * repeat > 20 * n:
        return False
    lines = [x for x in text.split("\n") if words(x)]
    stats = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": len(lines), "n_stop_words": sum(w in STOP_WORDS for w in words(text))}
    for r in RULES:
        v = r.scale * stats[r.top] / (stats[r.over] if r.over else 1)
        if stats[r.least] >= r.at_least and ((r.low is not None and v < r.low) or (r.high is not None and v > r.high)):
            return False
    return True




def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas().set_index("doc_id")
        docs = stage(spark, docs, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}-{id(docs)}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        held.append((name, before, docs.toPandas()))
        if name != "best_fit_packing":
            assert docs.columns == columns
    stages = {name: (before, after) for name, before, after in held}

    before, after = stages["quality_rules"]
    assert set(after.doc_id) == {i for i, t in before.text.items() if keeps(t)}
    before, after = stages["ngram_jaccard_join"]
    comp, _ = brute_components(list(before.text.items()))
    assert set(after.doc_id) == set(comp.values()) and 0 < len(after) < len(before)
    before, after = stages["suffix_array_dedup"]
    after = after.set_index("doc_id")
    for i, (n, gone, _, _) in zip(before.index, brute_removed(before.text)):
        if gone == 0:
            assert after.text[i] == before.text[i]
        elif gone < n:
            assert n - gone - 6 <= len(after.text[i].encode()) <= n - gone and after.n_chars[i] == len(after.text[i])
        else:
            assert i not in after.index
    before, after = stages["secret_scans"]
    after, none = after.set_index("doc_id"), brute_secrets("")
    assert set(after.index) == set(before.index)
    changed = [i for i in before.index if after.text[i] != before.text[i]]
    assert {i for i, t in before.text.items() if brute_secrets(t) != none} <= set(changed)
    assert all(brute_secrets(t) == none for t in after.text) and len(changed) < 0.1 * len(before)
    before, after = stages["best_fit_packing"]
    check_packing(after, before.text)
    assert np.isin(before.index, after.doc_id).all()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_stages_on_edge_cases(spark):
    """Null and repeated ids, null and empty texts, extra and clashing columns: no crash, clean texts stay, columns stay."""
    prose = lambda k: " ".join(f"the word{k}_{i} of it" for i in range(12))
    rows = [(None, prose(1)), (None, prose(1)), (None, prose(2)), (7, prose(3)), (7, prose(4)), (8, prose(3) + " end"), (9, None), (10, ""), (11, prose(5) + " password = hunter2hunter2"), (None, None)]
    docs = spark.createDataFrame([(i, t, k, "x", True) for k, (i, t) in enumerate(rows)], "doc_id long, text string, `a.b` int, n_removed string, kept boolean")
    columns, counts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), f"edge-{name}")
        counts[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns
    texts = lambda name: sorted(r.text for r in counts[name].collect())
    assert texts("quality_rules") == sorted(t for _, t in rows if t)
    assert texts("ngram_jaccard_join") == sorted([prose(1), prose(2), prose(3), prose(4), prose(5) + " password = hunter2hunter2"])
    assert sorted(texts("secret_scans")) == sorted([prose(1), prose(2), prose(3), prose(4), prose(5) + " [SECRET]"])
    packed = counts["best_fit_packing"].toPandas()
    assert len(packed) == 5 and packed.doc_id.isna().sum() == 2
