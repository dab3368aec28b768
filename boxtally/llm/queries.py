"""The operators over their whole tables, as registered queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtally.llm import (attention_lm, decontam, divergence, exact_dedup, html_main, language, mixing, near_dedup,
                          personal_data, quality, sharding, token_counts, vector_codes)
from boxtally.llm.common import table
from boxtally.session import scratch_path


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in three batches; a tenth is revised and revised back, another deleted and put back.

    The totals are folded on the way and a batch id is replayed, so all kinds of deltas run over the whole table and the
    totals are those of it.
    """
    docs, rollup = table(spark, sf_dir, "documents"), token_counts.Rollup(spark, scratch_path(spark, "token-rollup"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(30))
    loads = [token_counts.inserted(docs.where(draw % 3 == n)) for n in range(3)]
    for n, load in enumerate(loads):
        rollup.commit(f"load-{n + 1}", load)
    old, gone = docs.where(draw < 3), docs.where(draw.between(3, 5))
    new = old.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" revised")))
    rollup.commit("revise-1", token_counts.revised(old, new))
    rollup.commit("delete-1", token_counts.deleted(gone))
    rollup.fold()
    rollup.commit("revise-2", token_counts.revised(new, old))
    rollup.commit("insert-2", token_counts.inserted(gone))
    rollup.commit("load-1", loads[0])
    return rollup.totals()


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark, f"{sf_dir}/documents.parquet")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(table(spark, sf_dir, "documents"))


_GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _ASCII.format("coalesce(text, '')")

OP1_SQL = rf"""
with d as (select doc_id, regexp_extract_all({_TEXT}, '{_GAP}') as w from documents),
b as (select item_id, regexp_extract_all({_TEXT}, '{_GAP}') as w from benchmark),
win as (
  select distinct item_id, n, array_to_string(w[s + 1:s + n], ' ') as gram
  from (select item_id, w, least(13, len(w)) as n, unnest(range(0, len(w) - least(13, len(w)) + 1)) as s
        from b where len(w) > 0)),
lens as (select distinct n from win),
places as (select doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') as gram
       from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as s from d, lens where len(w) >= n)),
hit as (select doc_id, item_id, s, p.n from places p join win on p.n = win.n and p.gram = win.gram),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hit) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids
          from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  (coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w)) as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""

OP2_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, g from (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g from d)),
size as (select doc_id, count(*) as n from sh group by 1),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as common
  from sh a join size sa on a.doc_id = sa.doc_id join sh b on a.g = b.g and a.doc_id < b.doc_id
  join size sb on b.doc_id = sb.doc_id
  where 100 * least(sa.n, sb.n) >= 80 * greatest(sa.n, sb.n) group by 1, 2),
link as (
  select a, b from pairs join size x on x.doc_id = a join size y on y.doc_id = b
  where 100 * common >= 80 * (x.n + y.n - common)),
edge as (select a, b from link union select b, a from link),
reach(a, b) as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
low as (select a, min(b) as m from reach group by 1)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id,
  least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id as kept
from d left join size using (doc_id) left join low on low.a = d.doc_id
"""

OP9_SQL = f"""
with d as (select doc_id, {_TEXT} as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
from d join g using (t)
"""

OP11_SQL = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all({_TEXT}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
occ as (select r, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*) as total from occ group by 1, 2 having count(distinct r) >= 30),
cnt as (select lang, source, term, count(*) as n from occ join kept using (lang, term) group by 1, 2, 3),
grp as (select lang, source, (select coalesce(sum(n), 0) from cnt c where c.lang = d.lang and c.source = d.source) as size
  from (select distinct lang, source from d) d),
whole as (select lang, count(*) as v, sum(total) as size from kept group by 1),
rated as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.size + 5 * w.v) as p,
    1 + (1000000000::hugeint * (k.total + 5)) // (w.size + 5 * w.v) as q
  from grp g join kept k on g.lang = k.lang join whole w on w.lang = g.lang
  left join cnt c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sums as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from rated a join rated b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
every as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(s.value, 0) as bigint) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all
  select lang, source, 'term', term, cast(p - q as bigint) from rated where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from every)
select * from ranked where part = 'pair' or rank <= 50
"""


def _op12_sql(rounds: int = 6) -> str:
    """Rounds written out one after the other."""
    def assigned(n: int) -> str:
        return f"""a{n} as materialized (
  select rid, part, min(d * 16 + entry) % 16 as entry, min(d * 16 + entry) // 16 as d from (
    select rid, part, entry, sum((x - y) * (x - y)) as d from p join k{n} using (part, j) group by 1, 2, 3) group by 1, 2)"""

    steps = []
    for n in range(rounds):
        steps += [assigned(n), f"""k{n + 1} as materialized (
  select part, entry, j, coalesce((s - ((s % c) + c) % c) // c, y) as y from k{n} left join (
    select part, entry, j, sum(x) as s, count(*) as c from a{n} join p using (rid, part) group by 1, 2, 3)
  using (part, entry, j))"""]
    return f"""
with v as materialized (
  select row_number() over (order by vec_id) - 1 as rid, vec_id, label, embedding as e, len(embedding) // 8 as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
flat as (select rid, w, unnest(e) as x, unnest(range(len(e))) as i from v),
p as materialized (
  select rid, i // w as part, i % w as j, cast(floor(4096 * cast(x as double)) as hugeint) as x from flat),
k0 as materialized (select part, rid as entry, j, x as y from p where rid < 16),
{", ".join(steps)}, {assigned(rounds)},
coded as (
  select rid, string_agg(printf('%02x', cast(entry as int)), '' order by part) as code, cast(sum(d) as bigint) as error
  from a{rounds} group by 1),
sums as (select label, cast(sum(error) as bigint) as label_error from coded join v using (rid) group by 1),
book as (select sha256(string_agg(cast(y as varchar), ',' order by part, entry, j)) as codebooks_sha256 from k{rounds})
select vec_id, code, error, label_error, codebooks_sha256
from coded join v using (rid) join sums on sums.label is not distinct from v.label, book
"""


OP12_SQL = _op12_sql()

QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_near_dedup, op3_lm_scores, op4_quality, op5_language, op6_token_counts, op7_html_text,
    op8_mixing, op9_exact_dedup, op10_sharding, op11_source_divergence,
    op12_vector_codes, op13_personal_data)}
SQL = {"op1_decontamination": OP1_SQL, "op2_near_dedup": OP2_SQL, "op9_exact_dedup": OP9_SQL, "op11_source_divergence": OP11_SQL,
       "op12_vector_codes": OP12_SQL}
