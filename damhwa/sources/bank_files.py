"""A pattern bank from files: built from an inventory's records, stored as tables, read back for guidance.

A bank is a dict of long tables (`TABLES`): histograms of utterances by dataset, conversation lengths, labels, coverage,
errors by type and warnings. Rates, raw or balanced, follow from the histograms. On disk it is a folder of Parquet
tables and a small JSON head; no text is in it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from damhwa.operators import bank as B
from damhwa.sources import corpus

# What a bank's head says.
SCHEMA_NAME, VERSION = "private_pattern_bank", "1"

TABLES = ("hist", "turns", "labels", "coverage", "errors", "warnings")


def build_bank(rows: DataFrame, records: DataFrame, limit: int = 0) -> dict[str, DataFrame]:
    """The tables of a bank from corpus rows(path, ...) and records(path, dataset); rows of paths in no record go.

    limit: entries sampled from each archive, as the rows were read with; 0: all.
    """
    met = rows.join(records.select("path", "dataset"), "path")
    said = met.where("kind = 'text'").select("dataset", F.col("value").alias("text"), F.coalesce("blob", F.lit("")).alias("context_blob"))
    hist = B.histograms(B.utterance_features(said))
    turns = B.turn_buckets(corpus.turns(met))
    every = B.top_labels(corpus.labels(met)).withColumn("emotion", F.lit(False))
    labels = every.unionByName(B.top_labels(corpus.labels(met, emotions=True)).withColumn("emotion", F.lit(True)))
    n = lambda kind: F.coalesce(F.sum((F.col("kind") == kind).cast("long")), F.lit(0)).alias
    seen = met.agg(n("seen")("zip_entries_seen"), n("sampled")("entries_sampled"), n("document")("documents_sampled"), n("skipped")("documents_skipped"))
    share = B.dominance(hist).select(F.coalesce("dominant_share", F.lit(0.0)).alias("dominant_dataset_share"), F.col("datasets").alias("datasets_with_features"), F.coalesce("warning", F.lit(False)).alias("warning"))
    files = records.agg(F.count("*").alias("files_considered"), F.count_distinct("dataset").alias("datasets"))
    said_count = hist.where("family = 'all' and context is null").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("utterance_count"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  each has one row
    coverage = one(files).join(one(seen), "_one").join(one(said_count), "_one").join(one(share.drop("warning")), "_one").drop("_one")
    coverage = coverage.withColumn("max_entries_per_zip", F.lit(limit)).withColumn("full_entry_scan", F.lit(limit == 0))
    errors = met.where("kind in ('error', 'skipped') and key is not null").groupBy(F.col("key").alias("type")).agg(F.count("*").alias("cnt"))
    large = share.where("warning").select(F.format_string("largest dataset contributes %.2f%% of raw utterance features; use balanced_baselines for runtime guidance", F.col("dominant_dataset_share") * 100).alias("warning"))
    cut = met.where("kind = 'truncated'").select(F.concat(F.element_at(F.split("path", "/"), -1), F.lit(f": sampled first {limit} supported entries")).alias("warning"))
    return {"hist": hist, "turns": turns, "labels": labels, "coverage": coverage, "errors": errors, "warnings": large.unionByName(cut).distinct()}


def build_from_inventory(spark: SparkSession, root: str, records: DataFrame, limit: int = 0) -> dict[str, DataFrame]:
    """The bank of the files below `root` that an inventory's records(path relative to root, dataset) list."""
    files = corpus.read_files(spark, root)
    known = records.select("path").withColumnRenamed("path", "_path")
    base = F.lit(corpus.qualified(spark, root))
    relative = F.expr("substring(_name, length(_base) + 1)")
    files = files.withColumn("_name", corpus.plain(F.col("path"))).withColumn("_base", base).withColumn("_relative", relative)
    files = files.join(known, F.col("_relative") == F.col("_path"), "left_semi").select(F.col("_relative").alias("path"), "content")
    return build_bank(corpus.corpus_rows(files, limit), records, limit)


def write_bank(bank: dict[str, DataFrame], folder: str) -> None:
    """Store the tables below `folder`, replacing a bank that is there; the head is written last, so a bank that has one is whole."""
    spark = bank["hist"].sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/head.json")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(path, False)
    for name in TABLES:
        bank[name].write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
    out = files.create(path, True)
    out.write(bytearray(json.dumps({"schema": SCHEMA_NAME, "version": VERSION, "policy": {"stored_text": False, "source_text_values": "omitted", "raw_dialogue_examples": "not_included"}}, indent=2).encode()))
    out.close()


def read_bank(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame] | None, list[str]]:
    """(tables, []) of a stored bank; (None, [why]) if it is missing, cannot be read or is something else."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/head.json")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None, ["private pattern bank not found"]
    try:
        head = json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(folder.rstrip("/") + "/head.json").collect()))
    except ValueError as error:
        return None, [f"private pattern bank read error: {type(error).__name__}"]
    if not isinstance(head, dict) or head.get("schema") != SCHEMA_NAME:
        return None, ["private pattern bank has unexpected schema"]
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in TABLES}, []


def baselines(bank: dict[str, DataFrame], mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, marker rates by context, utterances by context) for guidance; mode: balanced or raw."""
    hist = bank["hist"]
    rates = B.balanced_rates(hist) if mode == "balanced" else B.raw_rates(hist)
    counts = hist.where("family = 'all' and context is not null").groupBy("context").agg(F.sum("cnt").alias("utterances"))
    return B.global_sizes(hist, mode == "balanced"), rates.where("context is not null and family = 'marker'").select("context", "key", "rate"), counts
