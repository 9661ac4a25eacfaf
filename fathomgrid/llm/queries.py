"""The registered queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from . import (decontamination, divergence, html_text, lempel_ziv, near_duplicates, quality, resampling, sentencepieces,
               suffixes, toxicity, vector_search)
from .common import crc_of_id
from .sharding import shard_documents
from .token_blocks import read_blocks, write_blocks


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_sharding(spark, sf_dir):
    out = shard_documents(_table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def _held_out(modulus, remainder):
    return (F.pmod(crc_of_id(F.col("doc_id")), F.lit(modulus)) == remainder).alias("held_out")


def op1_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", _held_out(toxicity.MODULUS, toxicity.HELD_OUT), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op2_sentencepieces(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentencepieces.encode_documents(_table(spark, sf_dir, "documents"), path)
    return sentencepieces.decode_documents(encoded, path, with_ids=False)


def op3_suffixes(spark, sf_dir):
    return suffixes.digest(_table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    out = quality.score_quality(docs, model)
    return out.select("doc_id", _held_out(quality.MODULUS, quality.HELD_OUT), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_token_blocks(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return read_blocks(write_blocks(_table(spark, sf_dir, "documents"), None, path), with_ids=False)


def op6_decontamination(spark, sf_dir):
    found = decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "word", "question_overlap", "answer_overlap")


NEAR_DUPLICATES_RULE = near_duplicates.Rule(words=3, percent=85, bands=40, rows=6)


def op8_near_duplicates(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = near_duplicates.near_duplicates(docs, NEAR_DUPLICATES_RULE)
    return found.select(F.col("d").alias("doc_id"), "n_shingles", "component_id",
                        (F.col("d") == F.col("component_id")).alias("kept"))


def op9_lempel_ziv(spark, sf_dir):
    return lempel_ziv.compare_neighbours(_table(spark, sf_dir, "documents"))


def op10_html_text(spark, sf_dir):
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op11_source_divergence(spark, sf_dir):
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_resampling(spark, sf_dir):
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_top_k(spark, sf_dir):
    return vector_search.top_k(_table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(100)) == 0)


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_toxicity": op1_toxicity,
    "op2_sentencepieces": op2_sentencepieces,
    "op3_suffixes": op3_suffixes,
    "op4_token_blocks": op4_token_blocks,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_lempel_ziv": op9_lempel_ziv,
    "op10_html_text": op10_html_text,
    "op11_source_divergence": op11_source_divergence,
    "op12_resampling": op12_resampling,
    "op13_top_k": op13_top_k,
}
# Repeated 100-byte strings: windows of the hexadecimal bytes, ranked by first occurrence; later ones merge to spans.
SUFFIXES_SQL = """
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
windows as (select doc_id, p, substr(x, 2 * p + 1, 200) as w from (
    select doc_id, x, unnest(range(0, greatest(n - 99, 0))) as p from bytes)),
later as (select doc_id, p from windows qualify row_number() over (partition by w order by doc_id, p) > 1),
islands as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as island from (
    select *, case when p <= lag(p) over (partition by doc_id order by p) + 100 then 0 else 1 end as fresh from later)),
spans as (select doc_id, island, min(p) as lo, max(p) + 100 as hi from islands group by doc_id, island),
kept as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as before from spans),
parts as (select b.doc_id, k.lo, substr(b.x, 2 * k.before + 1, 2 * (k.lo - k.before)) as part from kept as k join bytes as b using (doc_id)
    union all select b.doc_id, b.n + 1, substr(b.x, 2 * coalesce(s.hi, 0) + 1) from bytes as b
    left join (select doc_id, max(hi) as hi from spans group by doc_id) as s using (doc_id)),
whole as (select doc_id, string_agg(part, '' order by lo) as x from parts group by doc_id)
select b.doc_id, b.n as n_bytes, coalesce(s.removed, 0)::bigint as n_removed, coalesce(s.spans, 0)::bigint as n_spans,
    sha256(unhex(w.x)) as kept_sha256
from bytes as b join whole as w using (doc_id)
left join (select doc_id, sum(hi - lo) as removed, count(*) as spans from spans group by doc_id) as s using (doc_id)
"""

# All pairs that share a shingle, and reachability.
NEAR_DUPLICATES_SQL = """
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as g from words),
members as (select doc_id, len(g) as n, unnest(g) as g from sets),
pairs as (select a.doc_id as a, b.doc_id as b from members as a join members as b on a.g = b.g and a.doc_id < b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links as (select a, b from pairs union all select b, a from pairs),
reach as (select doc_id as id, doc_id as seen from documents union select r.id, l.b from reach as r join links as l on l.a = r.seen)
select s.doc_id, len(s.g)::bigint as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from sets as s join (select id, min(seen) as component_id from reach group by id) as c on c.id = s.doc_id
"""

# Shares of every group over all kept terms, and all pairs of sources of a language.
SOURCE_DIVERGENCE_SQL = """
with docs as (select coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, row_number() over () as r from documents),
words as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as w from docs),
counts as (select lang, source, w, count(*)::hugeint as n, count(distinct r) as d from words group by lang, source, w),
kept as (select lang, w, sum(n)::hugeint as n from counts group by lang, w having sum(d) >= 3),
langs as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang),
sizes as (select lang, source, sum(c.n)::hugeint as total from counts as c join kept as k using (lang, w) group by lang, source),
named as (select distinct lang, source from docs),
shares as (select g.lang, g.source, k.w, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (coalesce(s.total, 0) + l.v) as p,
    1 + 1000000000::hugeint * (k.n + 1) // (l.total + l.v) as q
    from named as g join kept as k using (lang) join langs as l using (lang) left join sizes as s using (lang, source)
    left join counts as c on c.lang = g.lang and c.source = g.source and c.w = k.w),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
    from shares as a join shares as b on a.lang = b.lang and a.w = b.w and a.source <> b.source group by a.lang, a.source, b.source),
ranked as (select lang, source, 'pair' as part, item, coalesce(value, 0)::bigint as value
    from (select a.lang, a.source, b.source as item from named as a join named as b on a.lang = b.lang and a.source <> b.source)
    left join pairs using (lang, source, item)
    union all select lang, source, 'term', w, ((p - q) * (p - q) // q)::bigint from shares where n > 0 and p > q),
numbered as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from ranked)
select * from numbered where part = 'pair' or rank <= 200
"""

# All inner products of the asked rows.
TOP_K_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
    from v as q join v as c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scores qualify rank <= 10
"""

ORACLES = {"op11_source_divergence": SOURCE_DIVERGENCE_SQL, "op13_top_k": TOP_K_SQL, "op3_suffixes": SUFFIXES_SQL, "op8_near_duplicates": NEAR_DUPLICATES_SQL}
