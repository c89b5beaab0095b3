"""A corpus pipeline of five operators; each stage's result is written as Parquet and is the next one's documents.

1. Language ID: profiles are learnt from the documents that may teach; a text in no learnt language goes, as
   its score shows against those of the learnt texts of its length.
2. N-gram Jaccard join: of each component of near copies the document with the smallest id stays.
3. Secret scans: what is found is replaced by a mark; no document goes.
4. Mixing: each document comes as often as the mix takes it whole, and where the mix ends within it, up to there.
5. Byte-level BPE: token counts and digests of each text of the mix.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from damhwa.llm import bpe, langid, mixing, ngram_join, secret_scan
from damhwa.llm.common import bound_batches, bound_reads, materialize, read_table

#: Entries of the encoder's tables in a worker: here it shares its executor with a heap that the stages before have filled.
PIECES = 30_000
#: For the same reason, bytes of an Arrow batch and rows of a Parquet batch: JVM and workers hold several of each at once.
BATCH_BYTES, READ_ROWS = 1 << 20, 1024
WORD = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"


def lean(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, read and sent to its workers in small batches."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark, BATCH_BYTES)
        bound_reads(spark, READ_ROWS)
        return stage(spark, docs, sf_dir)

    return run


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = langid.train_rows(docs)
    profiles = langid.learn(rows)
    return langid.accept(docs, profiles, bound=langid.bounds(rows, profiles))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    met = mixing.copies(docs)
    part = F.concat_ws("", F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("rest")))
    texts = F.concat(F.array_repeat("text", F.col("whole")), F.when(F.col("rest") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = met.withColumn("text", F.explode(texts)).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, max_pieces=PIECES)


STAGES = [
    ("language_id", lean(language_id)),
    ("ngram_jaccard_join", lean(near_duplicates)),
    ("secret_scan", lean(secrets)),
    ("source_mixing", lean(mixing_stage)),
    ("byte_bpe", lean(byte_bpe)),
]

#: Language ID aside, neither the primed compressor nor BPE can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
