"""Queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogrid.llm import collocations, conversation_repair, embedding_dedup, language_id, mixing, ngram_join, packing, piece_lattice, quality_classifier, quality_rules, secret_scan, suffix_dedup, token_files
from heliogrid.llm.common import table

#: Folder of the public vocabulary files; they are read in place and never copied.
TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str) -> str:
    """Path of a vocabulary file: the package's own if installed, else the folder's."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.fold(F.col("doc_id"), 5) == 0
    model = language_id.train(docs.where(~out).select("text", "lang"))
    return language_id.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules.annotate(docs).drop("text")
    return out.withColumn("failed", F.array_join("failed", ","))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language_id.fold(F.col("doc_id"), 4) == 2
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & ~out).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    stats = quality_classifier.measure(docs)
    model = quality_classifier.fit(stats.join(labels, "doc_id"))
    return quality_classifier.score(stats, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup(docs, with_text=False).drop("spans", "kept")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.train(docs)))


def op5_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), lean=False)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).drop("k")


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_secret_scans": op4_secret_scans,
        "op5_piece_lattice": op5_piece_lattice,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_language_id": op7_language_id,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_token_files": op10_token_files,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_source_mixing": op12_source_mixing,
        "op13_conversation_repair": op13_conversation_repair,
    }


def _rules_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)

    def fails(r: quality_rules.Rule) -> str:
        value = f"{float(r.scale)}::double * {r.top}" + (f" / {r.over}" if r.over else "")
        tests = [f"{value} {sign} {float(x)}::double" for sign, x in (("<", r.low), (">", r.high)) if x is not None]
        return f"case when {r.least} >= {r.at_least} and ({' or '.join(tests)}) then '{r.name}' end"

    return f"""with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
w as (select k, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w,
list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
g as (select k, i, array_to_string(w[i:i + 4], ' ') as g from (select k, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
r as (select k, count(distinct i + j) as n from (select k, i from (select k, i, count(*) over (partition by k, g) as c from g) where c > 1), range(0, 5) as o(j) group by k),
s as (select doc_id, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
len(list_filter(w, lambda x: x in ({stops})))::bigint as n_stop_words from w left join r using (k)),
f as (select *, concat_ws(',', {", ".join(map(fails, quality_rules.RULES))}) as failed, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from s)
select *, not base_failed and failed = '' as kept from f"""


_JOIN_SQL = """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, e.b from r join e on r.other = e.a),
c as (select doc_id, min(other) as component_id from r group by doc_id)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.component_id, w.doc_id) as component_id from w left join n using (doc_id) left join c using (doc_id)"""

_EMBEDDING_SQL = """with recursive v as (select vec_id, label, embedding::double[] as x from embeddings
where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.98),
r(vec_id, other) as (select vec_id, vec_id from embeddings union select r.vec_id, e.b from r join e on r.other = e.a),
c as (select vec_id, min(other) as component_id from r group by vec_id),
n as (select a as vec_id, count(*) as n from e group by a)
select c.vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, c.vec_id = component_id as kept from c left join n using (vec_id)"""


_COLLOCATION_SQL = """with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') as w from d),
w as materialized (select lang, pid, unnest(w) as w, generate_subscripts(w, 1) as i from (select *, row_number() over () as pid from p)),
n as (select lang, count(*) as n from w group by lang),
g as materialized (select lang, w as w1, lead(w) over o as w2, lead(w, 2) over o as w3, lead(w, 3) over o as w4 from w window o as (partition by pid order by i)),
f as materialized (select lang, 1 as k, w1 as phrase, [w1] as w, count(*) as a from g group by all having count(*) >= 30
union all select lang, 2, concat_ws(' ', w1, w2), [w1, w2], count(*) from g where w2 is not null group by all having count(*) >= 30
union all select lang, 3, concat_ws(' ', w1, w2, w3), [w1, w2, w3], count(*) from g where w3 is not null group by all having count(*) >= 30
union all select lang, 4, concat_ws(' ', w1, w2, w3, w4), [w1, w2, w3, w4], count(*) from g where w4 is not null group by all having count(*) >= 30),
h as materialized (select lang, phrase, a, w, j, array_to_string(w[:j], ' ') as x, array_to_string(w[j + 1:], ' ') as y from f, range(1, 4) as t(j) where j < k),
cuts as (select h.lang, h.phrase, h.a, w, j, u.a as l, v.a as r, (2000000::hugeint * h.a) // (u.a + v.a) as score from h join (select lang, phrase as x, a from f) u using (lang, x) join (select lang, phrase as y, a from f) v using (lang, y)),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
around as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as a from f, range(2, 4) as p(m), range(1, 4) as q(i) where m < k and i + m - 1 <= k group by all),
kept as (select b.* exclude (w) from best b left join around o using (lang, phrase) where o.a is null or 100 * o.a < 80 * b.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score from kept join n using (lang)
qualify rank <= 2000"""

_MIXING_SQL = """with d as (select row_number() over () as id, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
(('0x' || substr(sha256('0' || chr(1) || case when doc_id is null then 'n' else 'v' || doc_id end || chr(1) || case when text is null then 'n' else 'v' || text end), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double as u from documents),
s as (select source, sum(size)::hugeint as size, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as w from d group by source),
b as (select *, sum(w) over () as all_w, sum(size) over () * 150 as words, coalesce(sum(2 * size) over o, 0) as used, coalesce(sum(w) over o, 0) as gone from s
window o as (order by size::double / w, source rows between unbounded preceding and 1 preceding)),
c as (select *, 2 * size * 100 * (all_w - gone) <= w * (words - 100 * used) as full_up from b),
x as (select (any_value(words) - 100 * coalesce(sum(2 * size) filter (where full_up), 0))::double as words, (100 * (any_value(all_w) - coalesce(sum(w) filter (where full_up), 0)))::double as w from c),
t as (select source, c.size::bigint as source_size, case when full_up then (2 * c.size)::double else c.w::double * x.words / x.w end as target from c, x),
e as (select d.*, source_size, target, least(case when source_size > 0 then target / source_size::double else 0.0 end, 2.0) as due from d join t on d.source is not distinct from t.source),
p as (select *, floor(due)::bigint as whole, due - floor(due) as p, target - floor(due) * source_size as rest from e),
k as (select *, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as odds from p),
q as (select *, sum(size) over (partition by source order by floor(coalesce(odds / (1 + odds), 1.0) * 281474976710655.0::double), doc_id, id) as upto from k where size > 0 and whole < 2),
m as (select id from q where upto <= rest or (upto - size < rest and upto - rest <= rest - (upto - size)))
select doc_id, source, size, source_size, target, whole + (m.id is not null)::bigint as copies, (whole + (m.id is not null)::bigint) * size as taken from p left join m using (id)"""


def _repair_sql() -> str:
    """One row of a conversation after the other; a state is (cost and audit as text, repaired rows)."""
    states = ("s0", "s1", "s2", "s3")

    def step(of: str, letters: str, price: str, lines: str) -> str:
        return f"case when {of} is not null then {{'k': lpad((left({of}.k, 9)::bigint + {price})::varchar, 9, '0') || substr({of}.k, 10) || '{letters}', 't': {of}.t || {lines}}} end"

    def least(*ways: str) -> str:
        return f"list_min(list_filter([{', '.join(ways)}], lambda x: x is not null))"

    def taken(of: str, letters: str, before: str, initial: str, name: str) -> list[str]:
        """Keep and rerole of the row, after inserts that give the lines ``before``."""
        price = f"{3 * len(letters)} + if(fault = 'truncated', 3, 0)"
        keep = f"case when initial = '{initial}' then {step(of, letters + 'K', price, f'{before} [role || chr(58) || text]')} end"
        return [f"case when open then {x} end" for x in (keep, step(of, letters + "R", f"3 + {price}", f"{before} ['{name}:' || text]"))]

    gone = [step(s, "D", "4", "[]::varchar[]") for s in states]
    system = f"case when open and initial = 's' then {step('s0', 'K', "if(fault = 'truncated', 3, 0)", '[role || chr(58) || text]')} end"
    user = [w for s in ("s0", "s1", "s3") for w in taken(s, "", "", "u", "user")] + taken("s2", "I", "['assistant:'] ||", "u", "user")
    answer = taken("s2", "", "", "a", "assistant") + [w for s in ("s0", "s1", "s3") for w in taken(s, "I", "['user:'] ||", "a", "assistant")]
    ends = ["s0", "s3", step("s2", "I", "3", "['assistant:']"), step("s1", "II", "6", "['user:', 'assistant:']")]
    blank = "case when {0} is null then ' ' else {0}::varchar end"
    key = f"{blank.format('conv_id')} || ':' || {blank.format('turn')}"
    # checksum of a short text by its polynomial, a bit at a time
    crc = f"list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::bigint)), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, _: case when y % 2 = 1 then xor(y // 2, 3988292384) else y // 2 end))"
    ink = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""with recursive i as (select conv_id, turn, {blank.format('role')} as role, {blank.format('text')} as text, {key} as key from conversations),
c as (select *, xor({crc}, 4294967295) % 20 as kind from i),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(if(kind = 3, 2, 1))) as copy from c where kind <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos from d),
m as (select *, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by pos) as before,
case when {ink} = '' then 'blank' when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate' when right({ink}, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from o),
r as (select *, fault not in ('blank', 'duplicate') as open from m),
z as (select conv_id, count(*) as last, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where pos > 1 and before || initial not in ('su', 'ua', 'au')) as illegal from r group by conv_id),
p(conv_id, pos, s0, s1, s2, s3) as (select conv_id, 0::bigint, {{'k': '000000000', 't': []::varchar[]}}, null::struct(k varchar, t varchar[]), null::struct(k varchar, t varchar[]), null::struct(k varchar, t varchar[]) from z
union all select p.conv_id, p.pos + 1, {least(gone[0])}, {least(gone[1], system)}, {least(gone[2], *user)}, {least(gone[3], *answer)}
from p join r on r.conv_id is not distinct from p.conv_id and r.pos = p.pos + 1),
e as (select z.*, {least(*ends)} as x from p join z on p.conv_id is not distinct from z.conv_id and p.pos = z.last)
select b.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
coalesce(left(x.k, 9)::bigint, 0) as cost, coalesce(substr(x.k, 10), '') as audit, sha256(coalesce(array_to_string(x.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) b left join e on e.conv_id is not distinct from b.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": _JOIN_SQL,
        "op8_embedding_near_dedup": _EMBEDDING_SQL,
        "op9_quality_rules": _rules_sql(),
        "op11_phrase_collocations": _COLLOCATION_SQL,
        "op12_source_mixing": _MIXING_SQL,
        "op13_conversation_repair": _repair_sql(),
    }
