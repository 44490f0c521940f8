"""The registered queries: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangebreak.llm import (
    byte_bpe,
    context_tree,
    forest,
    guessed_bpe,
    hard_negatives,
    jaccard_join,
    mixing,
    part_codes,
    quality,
    secrets,
    token_counts,
    toxicity,
    warc,
)
from rangebreak.llm.ship import ship_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixing.curriculum(mixed).select("doc_id", "size", "source_size", "target", "taken", "position")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), keep_ids=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=("doc_id",))
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), trusted)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.language_scores(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_guessed_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guessed_bpe.encode_decode(table(spark, sf_dir, "documents"), keep=False)


def op13_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_mix_sources,
        op3_byte_bpe,
        op4_toxicity,
        op5_warc,
        op6_token_counts,
        op7_nearest_neighbours,
        op8_quality_rules,
        op9_lm_scoring,
        op10_secret_scans,
        op11_hard_negatives,
        op12_guessed_bpe,
        op13_part_codes,
    )
}

SQL: dict[str, str] = {}

SQL["op5_warc"] = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by 1)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when p.payload_bytes >= 100 and p.page_id <> f.first_id then 'revisit' else 'response' end as record_type,
       case when p.payload_bytes >= 100 and p.page_id <> f.first_id then f.first_id end as refers_to
from p left join f using (payload_digest)"""

SQL["op1_ngram_jaccard_join"] = r"""
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
  from words),
entries as (select doc_id, len(s) as n, unnest(s) as e from sets),
links as (
  select a.doc_id as x, b.doc_id as y from entries a join entries b on a.e = b.e and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach as (
  select doc_id, doc_id as other from sets
  union
  select r.doc_id, l.y from reach r join links l on l.x = r.other)
select s.doc_id, len(s.s) as n_shingles, c.component_id
from sets s join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)"""

SQL["op2_mix_sources"] = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5(coalesce(cast(doc_id as varchar), '')) as key
  from documents),
named as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source is null, source) - 1) % 3 as class
  from d group by source),
capped as (
  select *, case class when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as cap from named),
levelled as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over before, 0))::double
    / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level
  from capped window before as (
    order by cap::double / weight, source is null, source rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, class,
    case when level < cap::double / weight
      then max(case when level < cap::double / weight then level end) over () * weight else cap::double end as target
  from levelled),
placed as (
  select d.*, t.source_size, t.class, t.target, floor(t.target + 0.5)::bigint as goal,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id
      rows between unbounded preceding and 1 preceding), 0)::bigint as first_word
  from d join targets t on d.source is not distinct from t.source),
rounds as (
  select *, case when source_size > 0 then goal // source_size else 0 end as whole from placed),
shares as (
  select *, whole * size + greatest(0, least(size, goal - whole * source_size - first_word)) as taken,
    first_word::double / goal::double * 6.0 as due
  from rounds)
select doc_id, size, source_size, target, taken::bigint as taken,
  case when taken > 0 then case class
    when 0 then case when due < 3 then (due / 3.0) / 3.0 when due < 5 then (1 + (due - 3.0) / 2.0) / 3.0
      when due < 6 then (2 + (due - 5.0)) / 3.0 else 1.0 end
    when 1 then case when due < 2 then (due / 2.0) / 3.0 when due < 4 then (1 + (due - 2.0) / 2.0) / 3.0
      when due < 6 then (2 + (due - 4.0) / 2.0) / 3.0 else 1.0 end
    else case when due < 1 then due / 3.0 when due < 3 then (1 + (due - 1.0) / 2.0) / 3.0
      when due < 6 then (2 + (due - 3.0) / 3.0) / 3.0 else 1.0 end end end as position
from shares"""

SQL["op11_hard_negatives"] = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_inner_product(a.v, b.v)::bigint as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id,
  row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same
  and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify rank <= 10"""


def _part_codes_sql(rounds: int = 6) -> str:
    """Rounds of assignment and averaging, one after the other."""
    steps = ["""e as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v, row_number() over () as row
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (
  select row, place, v[place * len(v) // 8 + 1 : (place + 1) * len(v) // 8] as part
  from e, (select unnest(range(8)) as place)),
first as (select row, row_number() over (order by vec_id) - 1 as entry from e qualify entry < 16),
c0 as materialized (select place, entry, part as c from first join p using (row))"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} as materialized (
  select row, place, part, arg_min(entry, (d, entry)) as entry, min(d) as d from (
    select p.row, p.place, p.part, c.entry,
      list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - c.c[i]) * (part[i] - c.c[i])))::bigint as d
    from p join c{k} c using (place))
  group by row, place, part)""")
        if k < rounds:
            steps.append(f"""m{k} as (
  select place, entry, i, sum(x)::bigint as s, count(*)::bigint as n from (
    select place, entry, unnest(range(len(part))) as i, unnest(part) as x from a{k})
  group by place, entry, i),
c{k + 1} as materialized (
  select c.place, c.entry, coalesce(m.c, c.c) as c from c{k} c left join (
    select place, entry, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from m{k} group by place, entry) m
  on c.place = m.place and c.entry = m.entry)""")
    return "with " + ",\n".join(steps) + f""",
coded as (
  select row, string_agg(printf('%02x', entry::int), '' order by place) as code, sum(d)::bigint as error
  from a{rounds} group by row),
book as (
  select sha256(string_agg(x::varchar, ',' order by place, entry, i)) as codebooks_sha256 from (
    select place, entry, unnest(range(len(c))) as i, unnest(c) as x from c{rounds}))
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
from e join coded using (row), book"""


SQL["op13_part_codes"] = _part_codes_sql()
