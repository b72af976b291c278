"""The numbered queries over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bitplanes, byte_bpe, decontaminate, hnsw, html_text, pst, resampling, sharding, simhash, token_counts, toxicity, warc

from .shared import text_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.write_and_read(table(spark, sf_dir, "documents"))


def op5_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score(table(spark, sf_dir, "documents"))


def op6_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.deal(table(spark, sf_dir, "documents"))
    return dealt.withColumn("law", F.lit(sharding.LAW)).withColumn("grown_shard", F.lit(None).cast("int"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash_near_dedup, op2_token_counts, op3_byte_bpe, op4_token_planes, op5_suffix_tree_scores, op6_hnsw_near_dedup, op7_decontamination, op8_toxicity, op9_warc, op10_html_text, op11_alignment, op12_importance_resampling, op13_sharding)
}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: CRC-32 of a word, by the table of its polynomial.
_CRC = """list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)::bigint[]), lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"""

ORACLE_SQL: dict[str, str] = {
    "op12_importance_resampling": f"""
with d as materialized (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select unnest({_WORDS}) as f from benchmark),
places as (select r, unnest(w) as f from d),
tab as materialized (select {_CRC} as crc),
hex as (select f, hex(encode(f)) as h from (select f from places union select f from b)),
bytes as (select f, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i::bigint, 2))::bigint) as x from hex),
hashed as (select f, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, x), lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1]))) % 10000 as k from bytes, tab),
s as (select k, count(*) as n from places join hashed using (f) group by k),
t as (select k, count(*) as n from b join hashed using (f) group by k),
gain as (select h.k, floor(1000 * ln((coalesce(t.n, 0) + 1.0::double) * ((select coalesce(sum(n), 0) from s)::double + 10000)
  / ((coalesce(s.n, 0) + 1.0::double) * ((select coalesce(sum(n), 0) from t)::double + 10000))))::bigint as g
  from (select distinct k from hashed) h left join s using (k) left join t using (k)),
total as (select r, sum(g) as g from places join hashed using (f) join gain using (k) group by r),
scored as (select r, doc_id, len(w)::bigint as n_features, case when len(w) = 0 then 0 else floor(coalesce(g, 0) / len(w)) end::bigint as weight,
  ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint::double as h from d left join total using (r)),
noisy as (select r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from scored),
ranks as (select r, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from noisy where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from noisy left join ranks using (r)
""",
    "op7_decontamination": f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
placed as (select item_id, w, least(len(w), 13) as n, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0),
wins as (select distinct item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as t from placed),
places as (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from wins)),
hits as (select r, i, n, item_id from (select r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as t from places) join wins using (n, t)),
hit_words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
hit_items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, cast(item_id as varchar) as item from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit_words using (r) left join hit_items using (r)
""",
}
