"""The operators' queries on the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, line_dedup, media, mixing, near_dedup, packing, quality, sharding, suffix_dedup, topk, toxicity, vector_codes
from .shared import table


def vocabulary() -> str:
    """The public byte-level vocabulary file, installed on the driver and all executors."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = media.with_media(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    fields = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return media.with_features(stored).select("doc_id", "n_bytes", *[F.col(f"features.{c}") for c in fields])


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def _judged(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out_of(F.col("doc_id"), 3, 1))
    return toxicity.learn(table(spark, sf_dir, "documents"), labels)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(toxicity.with_toxicity(docs, toxicity_model(spark, sf_dir)), toxicity.held_out_of(F.col("doc_id"), 3, 1))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.drop_repeated_strings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out_of(F.col("doc_id"), 5, 0))
    return _judged(quality.with_quality(docs, quality.learn(docs, labels)), toxicity.held_out_of(F.col("doc_id"), 5, 0))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies_by_document(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    hexes = F.array_join(F.transform("indexes", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    out = vector_codes.with_label_error(codes)
    return out.select("vec_id", hexes.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def word_vocabulary() -> str:
    """The public vocabulary file with word ends, installed on the driver and all executors."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), word_vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_top_k, op2_line_dedup, op3_media_columns, op4_bpe, op5_near_dedup, op6_sharding, op7_toxicity, op8_mixing, op9_suffix_dedup, op10_quality, op11_vector_codes, op12_packing, op13_divergence)}


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """All rounds of op11 as a chain of common table expressions."""
    nearest = "select vec_id, part, arg_min(k, (d, k)) as k, min(d) as d from (select p.vec_id, p.part, b.k, list_sum([(p.x[i] - b.x[i]) * (p.x[i] - b.x[i]) for i in range(1, len(p.x) + 1)])::bigint as d from p join {0} b using (part)) group by all"
    steps = [f"""
v as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, part, e[part * (len(e) // {parts}) + 1 : (part + 1) * (len(e) // {parts})] as x from v, (select unnest(range({parts})) as part)),
b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as k, x from p semi join (select vec_id from v order by vec_id limit {entries}) using (vec_id))"""]
    for i in range(rounds):
        steps.append(f"""
a{i} as materialized ({nearest.format(f"b{i}")}),
s{i} as (select part, k, i, sum(x)::bigint as s, count(*)::bigint as n from (select a.part, a.k, unnest(p.x) as x, generate_subscripts(p.x, 1) as i from a{i} a join p using (vec_id, part)) group by all),
b{i + 1} as materialized (select part, k, coalesce(y, x) as x from b{i} left join (select part, k, list((s - ((s % n + n) % n)) // n order by i) as y from s{i} group by all) using (part, k))""")
    last = f"b{rounds}"
    return "with " + ",".join(steps) + f""",
a as ({nearest.format(last)}),
e as (select vec_id, string_agg(printf('%02x', k), '' order by part) as code, sum(d)::bigint as error from a group by vec_id),
l as (select label, sum(error)::bigint as label_error from e join v using (vec_id) group by label),
h as (select sha256(string_agg(x::varchar, ',' order by part, k, i)) as codebooks_sha256 from (select part, k, unnest(x) as x, generate_subscripts(x, 1) as i from {last}))
select vec_id, code, error, label_error, codebooks_sha256 from e join v using (vec_id) join l on v.label is not distinct from l.label cross join h"""


#: The same rows in DuckDB's SQL, for operators that SQL can express.
ORACLE = {
    "op1_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op2_line_dedup": r"""
with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from t),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, f.key is not null and k.doc_id <> f.last as gone from k left join f on k.key = f.key)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from m group by doc_id""",
    "op8_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from s),
o as (select *, 3 * source_size / weight as ratio, sum(source_size) over () as total, sum(weight) over () as weights,
  coalesce(sum(source_size) over (order by 3 * source_size / weight, source rows between unbounded preceding and 1 preceding), 0) as size_before,
  coalesce(sum(weight) over (order by 3 * source_size / weight, source rows between unbounded preceding and 1 preceding), 0) as weight_before from w),
v as (select (total - 3 * size_before)::double as num, (weights - weight_before)::double as den from o
  where ratio * (weights - weight_before) >= total - 3 * size_before order by ratio, source limit 1),
g as (select source, source_size, least(source_size * 3.0::double, weight * num / den) as target from w, v),
r as (select d.*, g.source_size, g.target, case when g.source_size > 0 then least(g.target / g.source_size, 3.0::double) else 0 end as rate, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) as b,
  ('0x' || substr(md5('mix-3:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint as place, ('0x' || substr(md5('mix-3:source:' || coalesce(d.source, '')), 1, 13))::bigint as start from d join g on g.source is not distinct from d.source),
p as (select *, floor(rate)::bigint as whole, floor((rate - floor(rate)) * 4503599627370496)::hugeint as part from r),
c as (select source, b, any_value(part) as part, any_value(start) as start, count(*)::hugeint as n, sum(count(*)) over (partition by source order by b)::hugeint as upto from p group by source, b),
k as (select source, b, (part * upto + start) // 4503599627370496 - (part * (upto - n) + start) // 4503599627370496 as k from c),
o2 as (select *, row_number() over (partition by source, b order by place) as nth from p),
e as (select k.source, k.b, place as cutoff from k join o2 on k.source is not distinct from o2.source and k.b = o2.b and nth = k)
select doc_id, size, source_size, target, (size * (whole + coalesce(place <= cutoff, false)::bigint))::bigint as taken from p left join e on e.source is not distinct from p.source and e.b = p.b""",
    "op11_vector_codes": _codes_sql(),
    "op13_divergence": r"""
with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
t as materialized (select doc, lang, source, unnest(ts) as term from d),
k as materialized (select lang, term from t group by all having count(distinct doc) >= 3),
c as materialized (select lang, source, term, count(*)::hugeint as n from t semi join k using (lang, term) group by all),
v as (select lang, count(*)::hugeint as v from k group by lang),
g as materialized (select lang, source, coalesce(any_value(v), 0) as v, coalesce(sum(n), 0) as n from (select distinct lang, source from d) left join c using (lang, source) left join v using (lang) group by all),
m as materialized (select lang, g.source, term, coalesce(c.n, 0) as n, (1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + g.v))::hugeint as p from g join k using (lang) left join c using (lang, source, term)),
pair as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join
  (select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) as value from m x join m y using (lang, term) group by all) s
  on s.lang = a.lang and s.source = a.source and s.item = b.source),
q as (select lang, term, (1 + (1000000000 * (sum(n) + 1)) // (any_value(whole)))::hugeint as q from c join (select lang, sum(n) + any_value(v) as whole from g group by lang) using (lang) group by all),
term as (select lang, source, term as item, ((p - q) * (p - q)) // q as value from m join q using (lang, term) where n > 0 and p > q),
r as (select lang, source, 'pair' as part, item, value from pair union all select lang, source, 'term', item, value from term),
o as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r)
select lang, source, part, item, value::bigint as value, rank::int as rank from o where part = 'pair' or rank <= 200""",
}
