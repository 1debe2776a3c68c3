"""The operators of this folder as queries over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stayframe.llm import (
    collocations, digest_index, fingerprints, hamming_join, lexical_search, line_dedup, packing, piece_viterbi, quality,
    residual_packing, token_files, toxicity, warc,
)
from stayframe.llm.labelled import held_out
from stayframe.session import scratch_path

LLM_QUERIES = {}
LLM_SQL = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL where SQL can say it."""

    def add(fn):
        LLM_QUERIES[fn.__name__] = fn
        if sql is not None:
            LLM_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the files are no part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    r"""
with rows_ as (
  select doc_id, length(coalesce(text, '')) as n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
first_ as (
  select text_sha256, count(*) as group_size,
    arg_min(doc_id, {'n': -n, 'id': doc_id}) as keep_id
  from rows_ group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
from rows_ join first_ using (text_sha256)"""
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.exact_dedup(table(spark, sf_dir, "documents"))


@query()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query()
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), place, vocabulary("byte_bpe_50k.json"), end_id=2)
    found = token_files.read_tokens(spark, place, with_ids=False)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@query(
    """
with p as (
  select page_id, coalesce(html, '') as body, octet_length(encode(coalesce(html, ''))) as n from pages),
d as (select page_id, n, sha256(body) as digest from p),
f as (select digest, min(page_id) as first_id from d where n >= 100 group by digest)
select page_id, n as payload_bytes, d.digest as payload_digest,
  case when first_id <> page_id then 'revisit' else 'response' end as record_type,
  case when first_id <> page_id then first_id end as refers_to
from d left join f on d.digest = f.digest and d.n >= 100"""
)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), place)
    found = warc.captures(warc.read_records(spark, place, with_payload=False)).where("capture is not null")
    fields = F.col("metadata.fields")
    return found.select(
        F.try_element_at(fields, F.lit("page-id")).try_cast("bigint").alias("page_id"),
        F.coalesce("capture.payload_bytes", F.try_element_at(fields, F.lit("payload-bytes")).try_cast("bigint")).alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        F.try_element_at(fields, F.lit("refers-to-page")).try_cast("bigint").alias("refers_to"),
    )


@query(
    r"""
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as materialized (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
  from words),
each as materialized (select doc_id, len(s) as n, hash(x) as h from sets, unnest(s) t(x)),
links as materialized (
  select a.doc_id as a, b.doc_id as b from each a join each b
    on a.h = b.h and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (
  select doc_id, doc_id as r from sets
  union select reach.doc_id, links.b from reach join links on links.a = reach.r)
select doc_id, len(s) as n_shingles, min(r) as component_id, min(r) = doc_id as kept
from reach join sets using (doc_id) group by doc_id, len(s)"""
)
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_join.near_duplicates(table(spark, sf_dir, "documents"), size=3, num=85, den=100)


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 4, 2)
    net = toxicity.fit_labelled(docs, labels, ~out)
    scored = toxicity.score(docs.select("doc_id", "text"), net)
    predicted = (F.col("toxicity") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", out.alias("held_out"), F.col("toxicity").alias("score"), predicted)


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 3, 1)
    model = quality.fit_labelled(docs, labels, ~out)
    scored = quality.score(docs.select("doc_id", "text"), model)
    predicted = (F.col("quality_score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", out.alias("held_out"), F.col("quality_score").alias("score"), predicted)


@query()
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


@query(
    r"""
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as materialized (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words),
each as materialized (select doc_id, len(s) as n, hash(x) as h from sets, unnest(s) t(x)),
links as materialized (
  select a.doc_id as a, b.doc_id as b from each a join each b
    on a.h = b.h and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (
  select doc_id, doc_id as r from sets
  union select reach.doc_id, links.b from reach join links on links.a = reach.r)
select doc_id, len(s) as n_shingles, min(r) as component_id, min(r) = doc_id as kept
from reach join sets using (doc_id) group by doc_id, len(s)"""
)
def fingerprint_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band join of the fingerprints over all documents, with Jaccard verified on whole sets."""
    return fingerprints.linked(table(spark, sf_dir, "documents"))


@query(
    """
with split as materialized (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as materialized (
  select doc_id, i as line_no, l[i + 1] as line from split, unnest(range(len(l))) t(i) where trim(l[i + 1], ' ') <> ''),
firsts as materialized (select line, min({'d': doc_id, 'n': line_no}) as f from lines group by line),
long as materialized (select * from firsts where length(line) >= 12),
cut as materialized (
  select line, f, p, length(line) as n, hash(substr(line, 1, p) || substr(line, p + 2)) as h
  from long, unnest(range(length(line))) t(p)),
changed as (select h, p, n, min(f) as m from cut group by h, p, n having count(*) > 1),
near_lines as (
  select c.line from cut c join changed k on c.h = k.h and c.p = k.p and c.n = k.n where k.m < c.f
  union select c.line from cut c join long w on c.h = hash(w.line) where w.f < c.f
  union select w.line from long w join cut c on c.h = hash(w.line) where c.f < w.f),
gone as (
  select doc_id, line_no from lines join firsts using (line) left join near_lines using (line)
  where near_lines.line is not null or f <> {'d': doc_id, 'n': line_no}),
listed as (
  select doc_id, count(*) as k, string_agg(cast(line_no as varchar), ',' order by line_no) as t from gone group by doc_id)
select doc_id, cast(len(l) as integer) as n_lines, cast(coalesce(k, 0) as integer) as n_dropped,
  coalesce(t, '') as dropped_lines
from split left join listed using (doc_id)"""
)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.repeated_lines(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.col("dropped_lines").cast("array<string>"), ",").alias("dropped_lines")
    return found.select("doc_id", "n_lines", F.size("dropped_lines").alias("n_dropped"), listed)


@query()
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_viterbi.round_trips(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query()
def op11_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


@query(
    r"""
with words as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
asked as materialized (
  select item_id, t, count(*) as q
  from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark)
  group by item_id, t),
whole as (select count(*) as docs, sum(len(w))::bigint as terms from words where len(w) > 0),
held as materialized (
  select doc_id, len(w) as n, t, count(*) as tf from words, unnest(w) u(t)
  where t in (select t from asked) group by doc_id, len(w), t),
weights as (
  select t, floor(1000 * ln((2.0::double * docs + 2) / (2 * count(*) + 1)))::bigint as weight
  from held, whole group by t, docs),
scored as (
  select item_id, doc_id,
    sum(q * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
  from asked join weights using (t) join held using (t), whole group by item_id, doc_id),
ranked as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
  from scored where score > 0)
select * from ranked where rank <= 20"""
)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p
  from documents),
words as materialized (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
whole as (select lang, sum(len(w))::hugeint as n from words group by lang),
runs as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select lang, w, unnest(range(1, len(w) + 1)) as i from words), unnest(range(1, 6)) t(k) where i + k - 1 <= len(w)),
often as materialized (select lang, phrase, k, count(*) as f from runs group by lang, phrase, k having count(*) >= 100),
cuts as (
  select o.lang, o.phrase, o.f as a, c, string_split(o.phrase, ' ') as w from often o, unnest(range(1, o.k)) t(c)),
scored as (
  select cuts.lang, cuts.phrase, a, c, x.f as l, y.f as r, n, (1000 * a::hugeint * n) // (x.f::hugeint * y.f) as score
  from cuts join often x on x.lang = cuts.lang and x.phrase = array_to_string(w[1:c], ' ')
    join often y on y.lang = cuts.lang and y.phrase = array_to_string(w[c + 1:], ' ')
    join whole on whole.lang = cuts.lang),
worst as (
  select lang, phrase, a, arg_min({'l': l, 'r': r, 'score': score}, {'score': score, 'c': c}) as cut, any_value(n) as n
  from scored group by lang, phrase, a),
inside as (
  select distinct o.lang, o.f, array_to_string(string_split(o.phrase, ' ')[i:i + j - 1], ' ') as phrase
  from often o, unnest(range(2, o.k)) t(j), unnest(range(1, 5)) u(i) where i + j - 1 <= o.k),
kept as (
  select * from worst where not exists (
    select 1 from inside where inside.lang = worst.lang and inside.phrase = worst.phrase and 100 * inside.f >= 100 * worst.a)),
ranked as (
  select lang, row_number() over (partition by lang order by cut.score desc, a desc, encode(phrase)) as rank, phrase, a,
    cut.l as l, cut.r as r, n::bigint as n, cut.score::bigint as score from kept)
select * from ranked where rank <= 2000"""
)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).drop("words", "doc_id")
