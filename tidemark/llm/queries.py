"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.licenses import DRIFT, GRAM, LEAST_ALIKE, LEAST_VOTES, NOTICES, PHRASES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_files import token_documents, tokenizer_json

    source = tokenizer_json(public_tokenizers.path("byte_bpe_50k.json"))
    return token_documents(spark, table(spark, sf_dir, "documents"), source).drop("file")


@query("op9_warc", """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body) as n, sha256(body) as digest from p),
f as (select digest, min(page_id) as first_id from d where n >= 100 group by digest)
select d.page_id, cast(d.n as bigint) as payload_bytes, d.digest as payload_digest,
       case when f.first_id < d.page_id then 'revisit' else 'response' end as record_type,
       case when f.first_id < d.page_id then f.first_id end as refers_to
from d left join f on d.digest = f.digest and d.n >= 100
""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import archived

    return archived(spark, table(spark, sf_dir, "pages")).filter("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


LICENSE_ROWS = ", ".join(
    [f"({i}, '{label}', '{body}', 'phrase', 2)" for i, (body, label) in enumerate(PHRASES)]
    + [f"({i}, '{label}', '{body}', 'notice', {GRAM})" for i, (label, body) in enumerate(NOTICES)])


@query("op10_licenses", rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
t as (select *, string_split(body, ' ') as tw, len(string_split(body, ' ')) as n from (values {LICENSE_ROWS}) v(template, label, body, kind, k)),
tg as (select *, array_to_string(tw[pos + 1:pos + k], ' ') as gram from (select *, unnest(range(n - k + 1)) as pos from t)),
g as (select doc_id, k, spot, array_to_string(ws[spot + 1:spot + k], ' ') as gram
      from (select doc_id, ws, k, unnest(range(len(ws) - k + 1)) as spot from w, (values (2), ({GRAM})) ks(k) where len(ws) >= k)),
h as (select doc_id, kind, template, label, body, n, pos, spot from g join tg using (k, gram)),
d as (select doc_id, kind, template, label, body, n, spot - pos as diagonal, count(*) as votes, min(spot) as lo, max(spot) as hi, list(pos) as seen
      from h group by all),
places as (select doc_id, 'base' as kind, label, diagonal as start, 1.0::double as alike from d where kind = 'phrase' and votes = n - 1),
i as (select *, sum(fresh) over (partition by doc_id, template order by diagonal) as island
      from (select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) > {DRIFT} then 1 else 0 end as fresh
            from d where kind = 'notice')),
s as (select doc_id, template, label, body, n, island, min(lo - list_min(seen)) as lo, max(hi + n - list_max(seen)) as hi,
      len(list_distinct(flatten(list(seen)))) as votes from i group by all having votes >= {LEAST_VOTES} * (n - {GRAM} + 1)),
c as (select doc_id, label, lo as start, body, array_to_string(ws[greatest(lo, 0) + 1:hi], ' ') as own from s join w using (doc_id)),
f as (select doc_id, 'notice' as kind, label, start, 1 - levenshtein(own, body) / greatest(length(own), length(body)) as alike from c
      qualify alike = max(alike) over (partition by doc_id, start)),
u as (select * from places union all select * from f),
z as (select doc_id, count(*) filter (kind = 'base') as n_base, min(start) filter (kind = 'base') as first_word, max(start) filter (kind = 'base') as last_word,
      array_to_string(list_sort(list_distinct(list(label) filter (kind = 'base'))), ',') as base_labels,
      array_to_string(list_sort(list_distinct(list(label) filter (kind = 'base' or alike >= {LEAST_ALIKE}))), ',') as labels, max(alike) as score
      from u group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score from w left join z using (doc_id)
""")
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


@query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sentencepiece_codec import encode_documents, model_bytes

    model = model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    return encode_documents(table(spark, sf_dir, "documents"), model)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.labelled import crc_mod
    from tidemark.llm.toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tagger = train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    scored = score_toxicity(docs, tagger)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.labelled import crc_mod
    from tidemark.llm.quality import score_quality, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    voters = train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return score_quality(docs, voters).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                                              (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_ngram_jaccard", r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[spot + 1:spot + 5], ' ') as gram
      from (select doc_id, ws, unnest(range(greatest(len(ws) - 4, 1))) as spot from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where c * 5 >= 4 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as other from documents union select r.doc_id, e.b from r join e on r.other = e.a),
k as (select a, count(*) as n_links from e group by 1)
select r.doc_id, min(other) as class_id, coalesce(max(n_links), 0) as n_links from r left join k on k.a = r.doc_id group by 1
""")
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query("op6_passages")
def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).drop("key", "kept_key")


@query("op2_topk", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
""")
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.topk import rounded, top_k

    return top_k(rounded(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


@query("op11_sharding")
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import size_of, write_shards

    text = F.col("doc.text")
    return write_shards(table(spark, sf_dir, "documents")).select(
        "doc.doc_id", size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op12_collocations", r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
u as (select lang, word, count(*) as f from (select lang, unnest(ws) as word from w) group by all),
n as (select lang, cast(sum(f) as bigint) as n from u group by lang),
g as (select lang, k, array_to_string(ws[i + 1:i + k], ' ') as phrase, count(*) as f
      from (select lang, ws, k, unnest(range(len(ws) - k + 1)) as i from w, (values (2), (3)) t(k) where len(ws) >= k) group by all),
f as (select lang, word as phrase, f from u union all select lang, phrase, f from g),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from g where f >= 10),
x as (select c.*, j, array_to_string(ws[1:j], ' ') as first, array_to_string(ws[j + 1:], ' ') as rest from c, (values (1), (2)) t(j) where j < k),
s as (select x.lang, x.k, x.phrase, a, x.j, b.f as l, d.f as r, cast((1000000::hugeint * a * a) // (b.f::hugeint * d.f) as bigint) as score
      from x join f b on b.lang = x.lang and b.phrase = first join f d on d.lang = x.lang and d.phrase = rest),
m as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
t as (select lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as phrase from c where k = 3),
h as (select lang, phrase, max(a) as longer from t group by all),
z as (select m.lang, m.phrase, a, l, r, n, score from m join n on n.lang = m.lang left join h on h.lang = m.lang and h.phrase = m.phrase
      where longer is null or 100 * longer < 50 * a),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z)
select lang, rank, phrase, a, l, r, n, score from o where rank <= 2000
""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def _merkle_sql() -> str:
    """The trees level by level: 16 to the power of 5 rows of a source and as many sources at most."""
    def climb(name: str, group: str) -> list[str]:
        out = []
        for k in range(5):
            out.append(f"""{name}{k + 1} as (select {group}, p // 16 as p, max(n) as n, case when max(n) > {16 ** k} then sha256(string_agg(h, '' order by p)) else min(h) end as h
              from {name}{k} group by {group}, p // 16)""")
        return out

    def beside(name: str, group: str, at: str, left: bool, k: int) -> str:
        side = "<" if left else ">"
        return (f"coalesce((select string_agg(s.h, '' order by s.p) from {name}{k} s where s.{group} is not distinct from x.{group} "
                f"and s.p // 16 = x.{at} // {16 ** (k + 1)} and s.p {side} x.{at} // {16 ** k}), '')")

    hashes = lambda text: "sha256(concat(" + ", ".join(
        f"case when {c} is null then '-' else concat(strlen({c}::varchar), ':', {c}) end" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    steps = [("t", "source", "p", "n", k) for k in range(5)] + [("g", "one", "gp", "gn", k) for k in range(5)]
    folded, siblings = "x.changed", []
    names = []
    for i, (name, group, at, n, k) in enumerate(steps):
        names.append(f"case when x.{n} > {16 ** k} then {beside(name, group, at, True, k)} end as l{i}, "
                     f"case when x.{n} > {16 ** k} then {beside(name, group, at, False, k)} end as r{i}")
        siblings.append(f"coalesce(l{i} || r{i}, '')")
    folds, before = [], "y"
    for i in range(len(steps)):
        folds.append(f"f{i} as (select *, case when l{i} is null then {'changed' if not i else f'h{i - 1}'} else sha256(l{i} || {'changed' if not i else f'h{i - 1}'} || r{i}) end as h{i} from {before})")
        before = f"f{i}"
    return f"""with recursive crc as (select doc_id, doc_id::varchar as s, 0 as i, 4294967295::bigint as c from (select distinct doc_id from documents where doc_id is not null)
      union all select doc_id, s, i + 1, case when c1 & 1 = 1 then xor(c1 >> 1, 3988292384) else c1 >> 1 end
      from (select *, case when i % 8 = 0 then xor(c, ascii(s[i // 8 + 1])::bigint) else c end as c1 from crc where i < 8 * length(s))),
    m as (select doc_id, xor(c, 4294967295) as c from crc where i = 8 * length(s)),
    d as (select documents.*, case when m.c % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as other
          from documents left join m using (doc_id)),
    a as (select doc_id, source, {hashes('text')} as h, {hashes('other')} as changed from d),
    t0 as (select *, row_number() over (partition by source order by doc_id nulls first, h) - 1 as p, count(*) over (partition by source) as n from a),
    {', '.join(climb('t', 'source'))},
    g0 as (select 1 as one, source, h, row_number() over (order by source nulls first) - 1 as p, count(*) over () as n from t5),
    {', '.join(climb('g', 'one'))},
    x as (select t0.*, 1 as one, g0.p as gp, g0.n as gn, g0.h as subroot, g5.h as root from t0 join g0 on t0.source is not distinct from g0.source cross join g5),
    y as (select x.doc_id, x.h as leaf, x.changed, x.subroot, x.root, {', '.join(names)} from x),
    {', '.join(folds)}
    select doc_id, leaf, subroot, root, sha256({' || '.join(siblings)}) as proof_sha256, h9 as folded_root, h9 = root as verified from f9"""


@query("op13_merkle", _merkle_sql())
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.labelled import crc_mod
    from tidemark.llm.merkle import fold, manifest, proof_digest

    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(crc_mod("doc_id", 5) == 0, lowered).otherwise(F.col("text"))
    rows = manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": tampered})
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest("path").alias("proof_sha256"), fold("path", "changed_leaf").alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
