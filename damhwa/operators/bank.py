"""The pattern bank: histograms and rates of utterances, per dataset, over all rows, and balanced over datasets.

Tables are long: (scope, context, family, key, cnt, total, rate). Raw rates divide counts by all utterances; balanced
ones are the mean over datasets of their rounded rates, a missing key counting as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from damhwa.functions import rules
from damhwa.functions import text as T

CONTEXT_FAMILIES = ("length", "speech", "act", "marker")


def utterance_features(utterances: DataFrame) -> DataFrame:
    """(dataset, chars, length, speech, acts, contexts, markers) of utterances(dataset, text, context_blob); empty texts go."""
    rows = utterances.where("text is not null and text <> ''")
    x = F.col("text")
    acts = T.detect(x, rules.ACTS)
    blob = F.concat(F.coalesce("context_blob", F.lit("")), F.lit(" "), x)
    return rows.select("dataset", F.length(x).alias("chars"), T.bucket(F.length(x), rules.LENGTH_BOUNDS).alias("length"), T.speech_level(x).alias("speech"), acts.alias("acts"), T.detect(blob, rules.CONTEXTS).alias("contexts")).withColumn("markers", F.array_intersect("acts", F.array(*map(F.lit, rules.MARKERS))))


def _keys(contexts: bool) -> list:
    entry = lambda family, key: F.struct(F.lit(family).alias("family"), key.alias("key"))
    many = lambda family, keys: F.transform(keys, lambda k: F.struct(F.lit(family).alias("family"), k.alias("key")))
    out = [F.array(entry("all", F.lit("")), entry("length", F.col("length")), entry("speech", F.col("speech"))), many("act", "acts"), many("marker", "markers")]
    return out + ([many("context", "contexts")] if contexts else [])


def histograms(features: DataFrame) -> DataFrame:
    """(dataset, context, family, key, cnt, chars, max_chars); context null: over all contexts. One shuffle, with partial sums.

    Family `all` has one key and counts utterances.
    """
    whole = features.withColumn("context", F.lit(None).cast("string")).select("dataset", "context", "chars", F.explode(F.concat(*_keys(True))).alias("k"))
    within = features.select("*", F.explode("contexts").alias("context")).select("dataset", "context", "chars", F.explode(F.concat(*_keys(False))).alias("k"))
    both = whole.unionByName(within)
    return both.groupBy("dataset", "context", F.col("k.family").alias("family"), F.col("k.key").alias("key")).agg(F.count("*").alias("cnt"), F.sum("chars").alias("chars"), F.max("chars").alias("max_chars"))


def _rates(hist: DataFrame, *scope: str) -> DataFrame:
    """With total, the utterances of the scope and context, and the rate in four decimals."""
    total = F.sum(F.when(F.col("family") == "all", F.col("cnt"))).over(Window.partitionBy(*scope, "context"))
    rows = hist.withColumn("total", total)
    return rows.where("family <> 'all'").select(*scope, "context", "family", "key", "cnt", "total", F.round(F.col("cnt") / F.col("total"), 4).alias("rate"))


def raw_rates(hist: DataFrame) -> DataFrame:
    return _rates(hist.groupBy("context", "family", "key").agg(F.sum("cnt").alias("cnt")))


def dataset_rates(hist: DataFrame) -> DataFrame:
    return _rates(hist, "dataset")


def dataset_profiles(hist: DataFrame) -> DataFrame:
    """(dataset, utterances, avg_chars, max_chars)."""
    return hist.where("family = 'all' and context is null").select("dataset", F.col("cnt").alias("utterances"), F.round(F.col("chars") / F.col("cnt"), 1).alias("avg_chars"), "max_chars")


def balanced_rates(hist: DataFrame) -> DataFrame:
    """(context, family, key, datasets, rate): means over the datasets that have the context (all datasets where null)."""
    datasets = hist.where("family = 'all'").groupBy("context").agg(F.count("*").alias("datasets"))
    units = F.round(F.col("rate") * 10000).cast("long")  # whole ten-thousandths, so that the sum knows no order
    summed = dataset_rates(hist).groupBy("context", "family", "key").agg(F.sum(units).alias("sum"))
    met = summed.join(F.broadcast(datasets).withColumnRenamed("context", "c"), F.col("context").eqNullSafe(F.col("c"))).drop("c")  # a row a context
    return met.select("context", "family", "key", "datasets", (F.expr("(2 * sum + datasets) div (2 * datasets)") / 10000).alias("rate"))


def global_sizes(hist: DataFrame, balanced: bool) -> DataFrame:
    """(utterances, datasets, avg_chars, max_chars) over all rows, or as the mean of datasets' means."""
    if balanced:
        return dataset_profiles(hist).agg(F.sum("utterances").alias("utterances"), F.count("*").alias("datasets"), F.coalesce(F.round(F.avg("avg_chars"), 4), F.lit(0.0)).alias("avg_chars"), F.coalesce(F.max("max_chars"), F.lit(0)).alias("max_chars"))
    rows = hist.where("family = 'all' and context is null")
    return rows.agg(F.sum("cnt").alias("utterances"), F.count("*").alias("datasets"), F.coalesce(F.round(F.sum("chars") / F.sum("cnt"), 1), F.lit(0.0)).alias("avg_chars"), F.coalesce(F.max("max_chars"), F.lit(0)).alias("max_chars"))


def dominance(hist: DataFrame) -> DataFrame:
    """The largest dataset's share of all utterances, and whether it calls for balanced baselines."""
    p = dataset_profiles(hist)
    out = p.agg(F.round(F.max("utterances") / F.sum("utterances"), 4).alias("dominant_share"), F.count("*").alias("datasets"))
    return out.select("dominant_share", "datasets", ((F.col("dominant_share") >= 0.5) & (F.col("datasets") > 1)).alias("warning"))


def turn_buckets(turns: DataFrame) -> DataFrame:
    """(bucket, cnt, rate) of turns(n), one row a conversation."""
    rows = turns.groupBy(T.bucket(F.col("n"), rules.TURN_BOUNDS).alias("bucket")).agg(F.count("*").alias("cnt"))
    return rows.withColumn("rate", F.round(F.col("cnt") / F.sum("cnt").over(Window.partitionBy(F.lit(0))), 4))


def top_labels(labels: DataFrame, most: int = 80) -> DataFrame:
    """(key, value, cnt): the most frequent label-like values of each key; ties go to the smaller value."""
    counts = labels.where(T.looks_like_label(F.col("value"))).groupBy("key", "value").agg(F.count("*").alias("cnt"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cnt"), "value"))).where(F.col("r") <= most).drop("r")
