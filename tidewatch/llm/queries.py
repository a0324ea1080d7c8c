"""The registered corpus queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, periodic, pii, rules, token_counts, unigram
from .line_dedup import LineDedup
from .mixing import Mixture
from .ngram_join import JaccardJoin
from .quality_model import QualityModel
from .toxicity import ToxicityModel
from .whitening import Whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Vocabulary of the SentencePiece query.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_PARTS = r"regexp_extract_all(text, '[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]')"


@query(
    rf"""
WITH d AS (SELECT doc_id, source, lang, translate(text, '#*$%&|<>', '') AS text FROM documents),
kept AS (SELECT * FROM d WHERE regexp_matches(text, '[A-Za-z]'))
SELECT source, lang, 'words-1' AS version, count(*) AS docs, CAST(sum(coalesce(len({_WORDS}), 0)) AS BIGINT) AS tokens FROM kept GROUP BY ALL
UNION ALL
SELECT source, lang, 'parts-2' AS version, count(*) AS docs, CAST(sum(coalesce(len({_PARTS}), 0)) AS BIGINT) AS tokens FROM kept GROUP BY ALL
"""
)
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents by source, language and tokenizer version, after two batches and a replay."""
    return token_counts.corpus_counts(documents(spark, sf_dir))


@query()
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document: base kinds and those found by context."""
    return pii.find(documents(spark, sf_dir))


_LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, CAST(i AS INTEGER) - 1 AS line, parts[i] AS raw,
         list_transform(regexp_extract_all(parts[i], '[^\x20\x09-\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS t(i)),
f AS (
  SELECT w, array_to_string(w, ' ') AS whole, min((doc_id, line)) AS pos FROM l WHERE len(w) > 0 GROUP BY w),
v AS (
  SELECT pos, whole, len(w) AS n, i, array_to_string(list_concat(w[1:i-1], w[i+1:]), ' ') AS variant
  FROM f, unnest(range(1, len(w) + 1)) AS t(i) WHERE len(w) >= 4),
sub AS (SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY n, i, variant) AS hub FROM v) WHERE pos <> hub),
ins AS (SELECT greatest(v.pos, f.pos) AS pos FROM v JOIN f ON v.variant = f.whole AND len(f.w) >= 4),
near AS (SELECT pos FROM sub UNION SELECT pos FROM ins),
judged AS (
  SELECT l.doc_id, l.line, l.raw, len(l.w) > 0 AND ((l.doc_id, l.line) <> f.pos OR near.pos IS NOT NULL) AS gone,
         len(l.w) > 0 AND (l.doc_id, l.line) = f.pos AND near.pos IS NOT NULL AS near
  FROM l LEFT JOIN f ON l.w = f.w LEFT JOIN near ON near.pos = f.pos)
SELECT doc_id, count(*) FILTER (gone) AS n_dropped, count(*) FILTER (near) AS n_near,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT coalesce(gone, false)), '')) AS text_sha256
FROM judged GROUP BY doc_id
"""


@query(_LINES_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from every document (repeats, and lines one word edit from an earlier one) and the text left."""
    docs = documents(spark, sf_dir)
    return LineDedup(docs).report(docs)


@query()
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label-model posterior, linear score and verdict of every document."""
    docs = documents(spark, sf_dir)
    return QualityModel(docs).score(docs)


@query()
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: five-word shingles, similarity 0.75."""
    return JaccardJoin(size=5, num=75, den=100).classes(documents(spark, sf_dir))


@query(
    r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(length(text) - length(translate(text, '#*$%&|<>!', '')), 0) AS symbols FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM s),
o AS (
  SELECT *, 2.0 * source_size / weight AS ratio,
         coalesce(sum(2.0 * source_size) OVER before, 0) AS full_before, sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM w WINDOW before AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lam AS (
  SELECT arg_min(((SELECT 1.5 * sum(source_size) FROM s) - full_before) / open_weight, ratio) AS level FROM o
  WHERE ((SELECT 1.5 * sum(source_size) FROM s) - full_before) / open_weight <= ratio),
t AS (SELECT source, source_size, CAST(least(2.0 * source_size, weight * level) AS DOUBLE) AS target FROM w, lam),
k AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         1.0 - pow((CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0,
                   1.0 / CASE WHEN size > 0 THEN size / CAST(size + symbols AS DOUBLE) ELSE 1.0 END) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, target - epochs * source_size AS rest, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 3) AS target,
       CAST(size * (epochs + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
)
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a 150 % mix takes from every document; sources weigh 3, 1, 2, repeating."""
    docs = documents(spark, sf_dir)
    mix = Mixture(docs, weights=(3.0, 1.0, 2.0), share=1.5, ceiling=2.0)
    return mix.counts(docs).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


@query(
    """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document, by a stateful stream over the documents."""
    return exact_dedup.dedup_files(spark, f"{sf_dir}/documents.parquet")


#: A conversation whose texts hold the template's own control strings.
_TRICKY = r"\### Assistant: </turn> ok"


@query()
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and its loss mask, read back from the formatted output."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", _TRICKY), (-7, 1, "assistant", _TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


@query()
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram pieces of every document: counts, digest, and the round trip through decoding."""
    vocabulary = unigram.Vocabulary.load(PIECES)
    return unigram.digests(documents(spark, sf_dir), vocabulary)


@query()
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the cascade's verdict."""
    return rules.judge(documents(spark, sf_dir))


@query()
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from confirmed toxic ones and unlabelled text."""
    docs = documents(spark, sf_dir)
    return ToxicityModel(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).score(docs)


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return Whitening(rows).apply(rows)


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, a tenth of which have a planted periodic tail."""
    found = periodic.PeriodicRuns(min_exp=4, min_length=6).find(periodic.with_planted(documents(spark, sf_dir)))
    return periodic.digests(found)
