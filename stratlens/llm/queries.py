"""One registered query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratlens.llm import (
    bpe, crossentropy, hnsw, html, language, minhash, packing, periodic, ranking, rules, suffixes, transducer, warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_key")


def _cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: documents labelled good and not toxic."""
    targets = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return crossentropy.differences(_table(spark, sf_dir, "documents"), targets)


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_table(spark, sf_dir, "documents"))


def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def _bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(_table(spark, sf_dir, "pages"))


def _hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


def _suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(_table(spark, sf_dir, "documents"))


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(_table(spark, sf_dir, "documents"))


def _token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.counted(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_minhash_near_dedup": _minhash,
        "op2_cross_entropy_difference": _cross_entropy,
        "op3_quality_rules": _rules,
        "op4_warc_chunks": _warc,
        "op5_language_id": _language,
        "op6_byte_level_bpe": _bpe,
        "op7_best_fit_packing": _packing,
        "op8_html_style_tree": _html,
        "op9_hnsw_near_dedup": _hnsw,
        "op10_suffix_array_dedup": _suffixes,
        "op11_block_max_maxscore": _ranking,
        "op12_periodic_runs": _periodic,
        "op13_token_counts": _token_counts,
    }


# Ids reachable over symmetric links (a, b), for every id of a table.
_REACH = """
reach as (select {id} as id, {id} as other from {table} union select r.id, l.b from reach r join links l on l.a = r.other),
roots as (select id, min(other) as component_id from reach group by 1)"""

_ORACLES = {
    "op1_minhash_near_dedup": f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as s
  from words),
flat as (select doc_id, unnest(s) as x from sets),
common as (select l.doc_id as a, r.doc_id as b, count(*) as n from flat l join flat r on l.x = r.x and l.doc_id <> r.doc_id group by 1, 2),
links as (
  select a, b from common join sets l on l.doc_id = a join sets r on r.doc_id = b
  where 100 * n >= 85 * (len(l.s) + len(r.s) - n)),
{_REACH.format(id="doc_id", table="documents")}
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from sets join roots on id = doc_id""",
    "op4_warc_chunks": """
with sized as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
    max(page_id) over (partition by coalesce(html, '')) as newest
  from pages)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and newest <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and newest <> page_id then newest end as refers_to
from sized""",
    "op10_suffix_array_dedup": """
with texts as (
  select row_number() over () as place, doc_id, text, hex(encode(coalesce(text, ''))) as digits from documents),
parts as (
  select place, base, substring(digits, 2 * base + 1, 1600) as part
  from (select place, digits, unnest(range(0, greatest(cast(strlen(digits) // 2 as bigint) - 399, 0), 400)) as base from texts)),
windows as (
  select place, base + shift as start, md5_number(substring(part, 2 * shift + 1, 800)) as content
  from (select place, base, part, unnest(range(0, least(400, cast(strlen(part) // 2 as bigint) - 399))) as shift from parts)),
repeated as (select place, start from windows where content in (select content from windows group by 1 having count(*) > 1)),
islands as (
  select place, start, sum(case when start <= before + 400 then 0 else 1 end) over (partition by place order by start) as island
  from (select *, lag(start) over (partition by place order by start) as before from repeated)),
spans as (select place, island, min(start) as low, max(start) + 400 as high from islands group by 1, 2),
edges as (select place, low, high, coalesce(lag(high) over (partition by place order by low), 0) as before from spans),
pieces as (
  select place, low as pos, substring(digits, 2 * before + 1, 2 * (low - before)) as piece from edges join texts using (place)
  union all
  select place, 1e18, substring(digits, 2 * coalesce(max(high), 0) + 1) from texts left join spans using (place) group by place, digits),
kept as (select place, coalesce(string_agg(piece, '' order by pos), '') as left_over from pieces group by 1),
moved as (
  select place, low - case when substring(digits, 2 * low + 1, 1) not in ('8', '9', 'A', 'B') then 0
      when substring(digits, 2 * low - 1, 1) in ('C', 'D', 'E', 'F') then 1
      when substring(digits, 2 * low - 3, 1) in ('C', 'D', 'E', 'F') then 2 else 3 end as low,
    high + case when substring(digits, 2 * high + 1, 1) not in ('8', '9', 'A', 'B') then 0
      when substring(digits, 2 * high + 3, 1) not in ('8', '9', 'A', 'B') then 1
      when substring(digits, 2 * high + 5, 1) not in ('8', '9', 'A', 'B') then 2 else 3 end as high
  from spans join texts using (place)),
sides as (select place, low, high, coalesce(lag(high) over (partition by place order by low), 0) as before from moved),
rests as (
  select place, low as pos, substring(digits, 2 * before + 1, greatest(2 * (low - before), 0)) as piece from sides join texts using (place)
  union all
  select place, 1e18, substring(digits, 2 * max(high) + 1) from texts join moved using (place) group by place, digits),
shorter as (select place, decode(unhex(string_agg(piece, '' order by pos))) as text from rests group by 1),
removed as (select place, cast(sum(high - low) as bigint) as n_removed, count(*) as n_spans from spans group by 1)
select t.doc_id, cast(strlen(t.digits) // 2 as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(left_over)) as kept_sha256, coalesce(s.text, t.text) as text
from texts t join kept using (place) left join removed using (place) left join shorter s using (place)""",
    "op11_block_max_maxscore": """
with texts as (
  select row_number() over () as place, doc_id, text from documents),
terms as (
  select place, any_value(doc_id) as doc_id, term, count(*) as tf
  from (select place, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from texts)
  group by place, term),
sizes as (select place, cast(sum(tf) as bigint) as n from terms group by 1),
total as (select count(*) as docs, cast(sum(n) as bigint) as words from sizes),
weights as (
  select term, cast(floor(1000 * ln((2.0::double * docs + 2) / (2 * df + 1))) as bigint) as w
  from (select term, count(*) as df from terms group by 1), total),
asked as (
  select item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from (select distinct item_id, text from benchmark)),
scores as (
  select item_id, a.text, doc_id, place,
    cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words)))) as bigint) as score
  from asked a join terms using (term) join weights using (term) join sizes using (place), total
  group by all),
places as (
  select item_id, cast(row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as integer) as rank, doc_id, score
  from scores where score > 0)
select * from places where rank <= 10""",
    "op9_hnsw_near_dedup": f"""
with recursive good as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings where label is not null and embedding is not null),
links as (
  select l.vec_id as a, r.vec_id as b from good l join good r on l.label = r.label and l.vec_id <> r.vec_id
  where list_cosine_similarity(l.v, r.v) >= 0.98),
counts as (select a, count(*) as n from links group by 1),
{_REACH.format(id="vec_id", table="embeddings")}
select id as vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, id = component_id as kept from roots left join counts on a = id""",
}


def oracle_sql() -> dict[str, str]:
    """Queries that DuckDB can express over the whole tables; the others are tested by brute force."""
    return dict(_ORACLES)
