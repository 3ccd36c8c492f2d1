"""Collocations, mixing and conversation repair against plain re-statements, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heliogrid.llm import collocations, conversation_repair, mixing
from heliogrid.llm.queries import oracle_sql
from tests.compare import tidy

DOCS = "doc_id long, text string, lang string, source string"


def plain_collocations(docs, least, top):
    f, total = Counter(), Counter()
    for _, text, lang, _ in docs:
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    kept = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    rows = {}
    for (lang, w), a in kept.items():
        n = len(w)
        around = [b for (la, x), b in kept.items() if la == lang and len(x) > n and any(x[i : i + n] == w for i in range(len(x) - n + 1))]
        if any(100 * b >= 80 * a for b in around):
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, n))
        rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, total[lang], -s) for lang, found in rows.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


def mined(spark, docs, **how):
    out = collocations.collocations(spark.createDataFrame(docs, DOCS), **how)
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out.collect())


def test_collocations_against_plain(spark):
    rng = random.Random(3)
    words = ["Ab", "ab", "é", "É", "x1", "\x01", "-", "zz", "q" * 40]
    docs = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n"]) for _ in range(rng.choice([0, 3, 40, 400]))), rng.choice(["en", "de", None, "und"]), None) for k in range(60)]
    docs += [(k, None, "en", None) for k in range(3)] + docs[:5]  # nulls, and repeated rows, which count again
    want = plain_collocations(docs, 4, 25)
    assert len(want) > 40
    for block in (1 << 20, 700):  # a text longer than a block goes over several
        assert mined(spark, docs, least=4, top=25, block=block) == want


def test_a_long_text_without_breaks_and_one_group_of_copies(spark):
    docs = [(1, "spam and eggs " * 60_000, "en", None)] + [(k, "of the people. by the people", "fr", None) for k in range(300)]
    assert mined(spark, docs, block=10_000, top=50) == plain_collocations(docs, 30, 50)


def test_no_documents_no_collocations(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, None, None, None), (2, "", "en", None), (3, " .,\n", "en", None)]) == []


def test_scores_pass_64_bits(spark):
    big = spark.createDataFrame([(1 << 60, (1 << 60) + 1, (1 << 61) - 1)], "a long, l long, r long")
    assert big.select(collocations.cut_score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 2_000_000 * (1 << 60) // ((1 << 60) + 1 + (1 << 61) - 1)


def mixed(spark, docs, **how):
    return mixing.mix(spark.createDataFrame(docs, DOCS).coalesce(3), **how)


def corpus(n=900):
    rng = random.Random(5)
    names = [None, "a", "B", "é", "z", "one"]
    return [(k, "w " * rng.choice([0, 1, 7, 90]), None, "one" if k == 0 else rng.choice(names[:5])) for k in range(n)]


@pytest.mark.parametrize("few", [5, 100_000])
def test_mix_against_sql(spark, monkeypatch, few):
    import duckdb

    monkeypatch.setattr(mixing, "FEW", few)  # digit after digit, or all at once
    docs = corpus() + [(None, None, None, None), (None, "x y", None, None), (None, "x y", None, None)]
    got = mixed(spark, docs).toPandas()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", docs)
    assert tidy(got) == tidy(con.execute(oracle_sql()["op12_source_mixing"]).df())


def test_mix_reaches_targets_and_agrees_between_runs(spark):
    docs = corpus()
    first, again = ([tuple(r) for r in mixed(spark, docs).orderBy("doc_id").collect()] for _ in range(2))
    assert first == again and len(first) == len(docs)
    rows = mixed(spark, docs).collect()
    for source, target in {(r.source, r.target) for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - target) <= 45 and target <= 2 * own[0].source_size
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6


def test_mix_with_importance_and_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 10)
    docs = [(k, "w " * 10, None, "a") for k in range(400)] + [(7, "w " * 10, None, "b")] * 400
    got = mixed(spark, docs, weights=(1, 1), percent=50, importance=F.when(F.col("doc_id") % 2 == 0, 3.0).when(F.col("doc_id") % 2 == 1, 1.0)).collect()
    even, odd = (sum(r.copies for r in got if r.source == "a" and r.doc_id % 2 == k) for k in (0, 1))
    assert even + odd == 200 and 120 < even < 180
    assert sum(r.copies for r in got if r.source == "b") == 200


def test_mix_of_nothing(spark):
    assert mixed(spark, []).collect() == []
    assert [(r.taken, r.target) for r in mixed(spark, [(1, None, None, None), (2, " ", None, "a")]).collect()] == [(0, 0.0)] * 2


def plain_repair(rows):
    """Least (cost, audit) over all edits, each row with up to two inserts before it, and the repaired rows."""
    names = {"u": "user", "a": "assistant"}
    best = None
    faults, seen = [], set()
    for role, text in rows:
        ink = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else None if ink[-1] in ".!?" else "truncated")
        seen.add((role, text))
    inserts = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*([i + e for i in inserts for e in ("D", "K", "Ru", "Ra")] for _ in rows), inserts):
        cost, audit, out = 0, "", []
        for k, e in enumerate(edits):
            body = e if k == len(rows) else e[:-2] if e[-2:-1] == "R" else e[:-1]
            for c in body:
                cost, audit = cost + 3, audit + "I"
                out.append((names[c], ""))
            if k == len(rows):
                break
            kind = e[len(body)]
            audit += kind
            cost += {"D": 4, "K": 0, "R": 3}[kind] + (3 if kind != "D" and faults[k] == "truncated" else 0)
            if kind != "D":
                if faults[k] in ("blank", "duplicate"):
                    break
                out.append((names[e[-1]] if kind == "R" else rows[k][0], rows[k][1]))
        else:
            continue
        if len(audit) and k < len(rows):
            continue
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best, faults


def repaired_rows(spark, rows, **how):
    got = conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), **how)
    return {r.conv_id: r.asDict() for r in got.collect()}


def conversations():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "cut", "", " \n", "Why? ", "Yes."]
    roles = ["user", "assistant", "system", "tool", "u", ""]
    return {c: [(rng.choice(roles[:3]) if rng.random() < 0.8 else rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 3))] for c in range(60)}


def test_repair_against_all_edits(spark):
    convs = conversations()
    rows = [(c, t, *r) for c, own in convs.items() for t, r in enumerate(own)]
    random.Random(1).shuffle(rows)
    plain = {c: plain_repair(own) for c, own in convs.items()}
    for how in ({}, {"segment": 1, "parts": 2}, {"parts": 7}, {"segment": 2, "parts": 40}):
        got = repaired_rows(spark, rows, **how)
        assert got.keys() == plain.keys()
        for c, ((cost, audit, text), faults) in plain.items():
            g = got[c]
            assert (g["cost"], g["audit"], g["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), (how, c, convs[c], g)
            assert [g[f] for f in ("blank", "duplicate", "truncated")] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
            initials = [r[:1] for r, _ in convs[c]]
            assert g["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))


def test_one_conversation_with_most_rows_goes_over_tasks(spark):
    rng = random.Random(2)
    hot = [(t // 2 * 3 if t % 50 else None, rng.choice(["user", "assistant", "tool"]), f"{rng.randint(0, 1500)}{rng.choice('.!-')}") for t in range(3_000)]
    rows = [(5, *r) for r in hot] + [(c, 0, "user", "Hi.") for c in range(20) if c != 5]
    ordered = sorted(((-1 if t is None else t, r, x) for t, r, x in hot))
    want = conversation_repair._repair([(None if t < 0 else t, r, x) for t, r, x in ordered])
    got = repaired_rows(spark, rows, segment=70, parts=9)
    assert len(got) == 20 and {k: v for k, v in got[5].items() if k != "conv_id"} == want
    assert got[4]["audit"] == "KI" and got[4]["cost"] == 3


def test_repair_of_nulls_equal_turns_and_nothing(spark):
    assert repaired_rows(spark, []) == {}
    nulls = [(None, None, None, None), (None, None, None, None), (None, 4, "user", "A."), (None, 6, "assistant", "B.")]
    for how in ({}, {"segment": 1, "parts": 4}):
        g = repaired_rows(spark, nulls, **how)[None]
        assert (g["gaps"], g["blank"], g["duplicate"], g["illegal"], g["audit"], g["cost"]) == (1, 2, 0, 2, "DDKK", 8)
    long = [(1, 0, "user", "x" * 2_000_000 + "."), (1, 0, "assistant", "y."), (1, 1, "assistant", "z.")]
    g = repaired_rows(spark, long)[1]
    assert (g["cost"], g["audit"]) == (3, "IKKK")


def test_damage_that_leaves_nothing(spark):
    table = spark.range(400).selectExpr("id as conv_id", "0L as turn", "'user' as role", "'Hi.' as text", "1 as kind", "2 as of")
    rows = {r.conv_id: r for r in conversation_repair.repair_damaged(table).collect()}
    assert len(rows) == 400
    gone = [c for c in rows if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone and all((rows[c].audit, rows[c].cost, rows[c].repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest()) for c in gone)
