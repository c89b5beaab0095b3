"""The thin queries of this package: name -> (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from damhwa.llm import bpe, html_density, langid, lattice, mixing, mpeg, multi_index, ngram_join, oracles, records, secret_scan
from damhwa.llm.common import read_table

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return records.store_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query
def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.store_texts(read_table(spark, sf_dir, "documents"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


@query
def op10_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(read_table(spark, sf_dir, "pages"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(langid.train_rows(docs)))


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


@query
def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query
def op4_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    words, model = lattice.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return lattice.score(docs, words, model, lattice.file_block())


@query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


ORACLES |= {"op5_ngram_join": oracles.NGRAM_JOIN, "op8_source_mixing": oracles.SOURCE_MIXING}
