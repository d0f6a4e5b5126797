"""The registered queries of the subpackage, over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthlens.llm import (fingerprints, id_files, language, minhash, packing, periodic, secret_scan,
                            spelling, token_counts, topk, toxicity, transducer, warc, word_sql)
from hearthlens.llm.common import emptied
from hearthlens.plans.registry import table
from hearthlens.session import fresh_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and its edited text; ``n_near`` searches every 50th document."""
    found = fingerprints.edited_fingerprints(table(spark, folder, "documents"))
    return fingerprints.near_counts(found).drop("f0", "f1")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of the categories of the chain for every document."""
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Writes every page to archives and reads the archives back."""
    path = fresh_path(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), path)
    found = warc.resolved(warc.read_warc(spark, path))
    emptied(spark, path)
    return found.withColumnRenamed("key", "page_id")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Packs every document into sequences of 2048 tokens."""
    pieces = packing.pack(packing.text_pieces(table(spark, folder, "documents"), BYTE_BPE, 1, 2048), 2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram token counts of every document."""
    return token_counts.token_counts(table(spark, folder, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encodes every document and decodes the ids."""
    both = transducer.encode(table(spark, folder, "documents"), MULTI_RANKS, public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicates on runs of four words."""
    return minhash.near_duplicates(table(spark, folder, "documents"), words=4)


def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best rows by inner product for every 20th vector."""
    found = topk.top_k(table(spark, folder, "embeddings"), k=20, every=20)
    return found.withColumnRenamed("id", "vec_id")


def op9_id_files(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the ids of every document to indexed shard files and reads the files back."""
    path = fresh_path(spark, "ids")
    id_files.write_ids(table(spark, folder, "documents"), path, BYTE_BPE, 2)
    found = id_files.layout(id_files.read_ids(spark, path))
    emptied(spark, path)
    return found.withColumnRenamed("key", "doc_id")


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    return language.identify(table(spark, folder, "documents"))


def op11_periodic(spark: SparkSession, folder: str) -> DataFrame:
    """The periodic runs of every document, one in ten of them made periodic first."""
    found = periodic.periodic_runs(periodic.with_planted_runs(table(spark, folder, "documents")))
    best = periodic.strongest(F.col("runs"))
    line = F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"),
                    F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(line, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document: the three patterns, and keys and tokens confirmed by their structure."""
    found = secret_scan.scan(table(spark, folder, "documents"))
    base = F.filter("found", lambda f: f["kind"].isin(*secret_scan.KINDS[:3]))

    def number(kind):
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    return found.select("doc_id", *[number(kind) for kind in secret_scan.KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.variants(spelling.occurrences(table(spark, folder, "documents")))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_warc, op4_packing, op5_token_counts, op6_byte_bpe,
                                   op7_minhash, op8_topk, op9_id_files, op10_language, op11_periodic, op12_secrets,
                                   op13_spelling)}

SQL = {
    "op3_warc": """
        with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
        first as (select h, max(page_id) as top from p group by h)
        select page_id, strlen(html) as payload_bytes,
               array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                          (((('0x' || substr(p.h, (5 * g + 1)::int, 5))::int) >> s) & 31) + 1, 1)), '')), '') as payload_digest,
               case when page_id = top then 'response' else 'revisit' end as record_type,
               case when page_id <> top then top end as refers_to
        from p join first using (h)
    """,
    "op7_minhash": r"""
        with recursive words as (
            select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') as w from documents),
        sets as (
            select doc_id, list_distinct(case when len(w) >= 4
                then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
        classes as (select doc_id, coalesce(len(s), 0) as n, md5(array_to_string(list_sort(s), chr(10))) as d from sets),
        heads as (select d, min(doc_id) as id, any_value(n) as n from classes where n > 0 group by d),
        posts as (select h.id, h.n, unnest(s.s) as x from heads h join sets s on s.doc_id = h.id),
        common as (
            select a.id as a, b.id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as c
            from posts a join posts b on a.x = b.x and a.id < b.id group by a.id, b.id),
        links as (select a, b from common where 100 * c >= 80 * (n + m - c)),
        edges as (select a, b from links union all select b, a from links),
        reach(id, other) as (
            select id, id from heads
            union select r.id, e.b from reach r join edges e on r.other = e.a),
        found as (select id, min(other) as component_id from reach group by id)
        select c.doc_id, c.n as n_shingles, coalesce(f.component_id, c.doc_id) as component_id,
               c.doc_id = coalesce(f.component_id, c.doc_id) as kept
        from classes c left join heads h on c.d = h.d and c.n > 0 left join found f on f.id = h.id
    """,
    "op8_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
            where embedding is not null and list_count(embedding) = len(embedding)
              and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
        scored as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
            from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
        ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
        select query_id, rank, vec_id, score from ranked where rank <= 20
    """,
    "op11_periodic": word_sql.PERIODIC,
    "op13_spelling": word_sql.SPELLING,
}
