"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from openstat.llm.common import pieces
from openstat.llm.decontaminate import contamination, digest
from openstat.llm.exact_dedup import exact_dedup
from openstat.llm.hard_negatives import hard_negatives
from openstat.llm.html_text import extract_text
from openstat.llm.jaccard_join import jaccard_join
from openstat.llm.language_id import identify_language
from openstat.llm.mixing import OTHER, Path, mix_sources
from openstat.llm.onebit_search import nearest
from openstat.llm.periodic_runs import periodic_runs
from openstat.llm.quality import score_quality
from openstat.llm.sharding import SlotMaps, assign_shards, growth_map
from openstat.llm.substring_dedup import substring_dedup
from openstat.llm.vectors import finite
from openstat.llm.warc import read_records, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

#: Runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of a key's text modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


@query("op1_substring_dedup", r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
win as (
  select doc_id, i, array_to_string(ws[i:i+12], ' ') g
  from (select doc_id, ws, unnest(generate_series(1, len(ws) - 12)) i from w)
),
first as (select g, min(doc_id) f from win group by g),
hit as (select win.doc_id, i from win join first using (g) where f < win.doc_id),
gone as (select distinct doc_id, p from (select doc_id, unnest(generate_series(i, i + 12)) p from hit)),
word as (select doc_id, unnest(generate_series(1, len(ws))) p, unnest(ws) x from w),
kept as (select doc_id, count(*) n, string_agg(x, ' ' order by p) s from word anti join gone using (doc_id, p) group by doc_id)
select w.doc_id, len(ws)::bigint n_words, (len(ws) - coalesce(n, 0))::bigint n_removed,
  sha256(coalesce(s, '')) kept_sha256
from w left join kept using (doc_id)
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(table(spark, folder, "documents"), least=13).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


@query("op2_jaccard_join", r"""
with recursive w as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws
  from documents
),
s as (
  select distinct doc_id, array_to_string(ws[i:i+2], ' ') g
  from (select doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 2))) i from w where len(ws) > 0)
),
n as (select doc_id, count(*) n from s group by doc_id),
link as (
  select a.doc_id x, b.doc_id y from s a join s b on a.g = b.g and a.doc_id < b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  where 10 * least(na.n, nb.n) >= 9 * greatest(na.n, nb.n)
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 90 * (na.n + nb.n - count(*))
),
both_ways as (select x, y from link union select y, x from link),
reach as (
  select x, y from both_ways union select reach.x, both_ways.y from reach join both_ways on reach.y = both_ways.x
)
select w.doc_id, coalesce(max(n.n), 0)::bigint n_shingles, coalesce(least(w.doc_id, min(reach.y)), w.doc_id) component_id
from w left join n using (doc_id) left join reach on reach.x = w.doc_id group by w.doc_id
""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join(table(spark, folder, "documents"), k=3, top=90, bottom=100)


@query("op3_decontaminate", r"""
with d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents
),
b as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark
),
bw as (
  select distinct item_id, least(10, len(ws)) k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') g
  from (select item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) i from b where len(ws) > 0)
),
dw as (
  select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') g
  from (select doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) i from d, (select distinct k from bw))
),
m as (select doc_id, item_id, dw.k, i from dw join bw on dw.k = bw.k and dw.g = bw.g),
h as (select doc_id, count(distinct p) n from (select doc_id, unnest(generate_series(i, i + k - 1)) p from m) group by doc_id),
t as (
  select doc_id, count(*) n, string_agg(item, ',' order by item) s
  from (select distinct doc_id, item_id::varchar item from m) group by doc_id
)
select d.doc_id, len(ws)::bigint n_words, coalesce(h.n, 0)::bigint n_hit, coalesce(t.n, 0)::bigint n_items,
  sha256(coalesce(t.s, '')) items_sha256, coalesce(h.n, 0) > 0 contaminated
from d left join h using (doc_id) left join t using (doc_id)
""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op4_quality")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_quality(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"),
        learn=fold(F.col("doc_id"), 3) != 1, name="score",
    )
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op5_html_text")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages")).select(
        "page_id", "url", F.col("visible_text").alias("text"), F.length("visible_text").cast("long").alias("n_chars")
    )


@query("op6_exact_dedup", """
select doc_id, max(doc_id) over g keep_id, count(*) over g group_size, doc_id = max(doc_id) over g kept,
  sha256(coalesce(text, '')) text_sha256
from documents window g as (partition by coalesce(text, ''))
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents")).drop("n_chunks")


#: Target shares: of a domain, of a language in it, of a source in that.
DOMAINS = {"web": (0.5, range(0, 7)), "reference": (0.3, range(7, 14)), "books": (0.2, range(14, 20))}
LANGUAGES = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}
#: What values without a name (null included) have together: as a domain, as a language of a domain, as a source.
OTHERS = (0.1, 0.1, 1.0)


def source_path() -> dict[str, Column]:
    number = F.expr("try_cast(substring(source, 4) as int)")
    domain = F.when(number.between(0, 6), "web").when(number.between(7, 13), "reference")
    return {
        "domain": domain.when(number.between(14, 19), "books"), "lang": F.col("lang"), "source": F.col("source"),
    }


def source_weights() -> dict[Path, float]:
    weights: dict[Path, float] = {}
    for domain, (share, sources) in (DOMAINS | {OTHER: (OTHERS[0], ())}).items():
        weights[(domain,)] = share
        for lang, part in (LANGUAGES | {OTHER: OTHERS[1]}).items():
            weights[(domain, lang)] = part
            weights |= {(domain, lang, f"src{i}"): 1.0 for i in sources}
            weights[(domain, lang, OTHER)] = OTHERS[2]
    return weights


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


@query("op7_mix_sources")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    mixed = mix_sources(
        docs.withColumn("domain", source_path()["domain"]), source_path() | {"domain": F.col("domain")},
        source_weights(), n_words(F.col("text")), epochs=4,
    )
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


@query("op8_warc", """
select page_id, strlen(coalesce(html, ''))::bigint payload_bytes, sha256(coalesce(html, '')) payload_digest,
  case when strlen(coalesce(html, '')) >= 100 and page_id <> min(page_id) over g then 'revisit' else 'response' end record_type,
  case when strlen(coalesce(html, '')) >= 100 and page_id <> min(page_id) over g then min(page_id) over g end refers_to
from pages window g as (partition by coalesce(html, ''))
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    index = write_archives(table(spark, folder, "pages"), least=100)
    return read_records(index).select(
        F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long")
    )


SHARDS = 8


@query("op9_sharding")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    maps = SlotMaps.create(spark).publish(growth_map(SHARDS), 1).publish(growth_map(SHARDS + 1), 2)
    grown = maps.read().select(F.col("slot").alias("vslot"), F.col("shard").alias("grown_shard"))
    placed = assign_shards(table(spark, folder, "documents").select("doc_id", "text"), maps.read(1))
    return placed.join(F.broadcast(grown), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query("op10_language")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = identify_language(docs, learn=fold(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op11_nearest", """
with r as (
  select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
s as (
  select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v) score
  from r q join r c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
)
select query_id, (row_number() over g)::int rank, vec_id, score from s
window g as (partition by query_id order by score desc, vec_id) qualify row_number() over g <= 20
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@query("op12_hard_negatives", """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l,
    list_transform(embedding, lambda x: floor(256 * x::double)) v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.vec_id a, a.l al, b.vec_id b, b.l bl, list_inner_product(a.v, b.v)::bigint s
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
),
p as (select a, al, b, s from s where al = bl qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (
  select p.a anchor_id, p.b positive_id, s.b negative_id, p.s positive_score, s.s negative_score,
    (row_number() over (partition by p.a, p.b order by s.s desc, s.b))::int rank
  from p join s on s.a = p.a and s.bl <> p.al and 50 * p.s <= 100 * s.s and 100 * s.s <= 95 * p.s
)
select * from n where rank <= 3
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").filter(finite(F.col("embedding"))).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("embedding"),
    )
    return hard_negatives(rows, rows.filter("vec_id % 50 = 0"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, a tenth of them with a period planted as op13 states it."""

    def plant(doc_id: int | None, text: str | None) -> str | None:
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 or not text:
            return text
        words = text.encode().split()
        if not words:
            return text
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        cycle = words[a : a + p]
        times = -(-(len(words) - a) // p)
        return b" ".join(words[:a] + (cycle * times)[: len(words) - a]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for x in batches for piece in pieces(iter([x]), "text")):
            made = [plant(i, t) for i, t in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "text"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, rows.schema)


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, folder, "documents")), least=6, times=4)
    longest = F.sort_array(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"])))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")
    )))
    top = F.get(longest, F.lit(0))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"),
        top["period"].alias("period"), F.floor(1000 * top["length"] / top["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
