"""Guidance: scenes held against a pattern bank's baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from damhwa.functions import rules
from damhwa.functions import text as T


def baseline_mode(mode: str, has_balanced: bool, has_raw: bool = True) -> tuple[str, str, list[str]]:
    """(mode, source, warnings): balanced where asked for and there; else raw, or legacy for a bank with one set only."""
    warnings = [] if mode in ("balanced", "raw") else [f"unsupported baseline_mode {mode!r}; using balanced"]
    if mode != "raw" and has_balanced:
        return "balanced", "balanced_baselines", warnings
    return ("raw", "raw_baselines", warnings) if has_raw else ("legacy_raw", "legacy_global_baselines", warnings)


def scene_matches(features: DataFrame, scenes: DataFrame) -> DataFrame:
    """(scene_id, contexts, acts, known_levels, line_count, max_chars): contexts from the scene's fields and its lines in order."""
    fields = [F.nullif(F.col(c), F.lit("")) for c in ("scene", "medium", "genre", "character_profiles", "relationship_boundaries")]
    agg = features.groupBy("scene_id").agg(
        F.count("*").alias("line_count"), F.max("raw_chars").alias("max_chars"), F.count_distinct(F.when(F.col("guided_speech") != "unknown", F.col("guided_speech"))).alias("known_levels"),
        F.array_distinct(F.flatten(F.collect_set("acts"))).alias("acts"), F.array_sort(F.collect_list(F.struct("line_index", "line"))).alias("lines"),
    )
    own = scenes.select("scene_id", F.nullif(F.concat_ws(" ", *fields), F.lit("")).alias("own"))
    said = F.array_join(F.col("lines")["line"], " ")
    rows = own.join(agg, "scene_id", "left").withColumn("blob", F.concat_ws(" ", "own", F.nullif(said, F.lit(""))))
    none = F.array().cast("array<string>")
    return rows.select("scene_id", T.detect(F.col("blob"), rules.CONTEXTS).alias("contexts"), F.array_sort(F.coalesce("acts", none)).alias("acts"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("known_levels", "line_count", "max_chars")])


def guidance(matches: DataFrame, sizes: DataFrame | None, rates: DataFrame | None, counts: DataFrame | None) -> DataFrame:
    """(scene_id, signal, axis, confidence, contexts, cited, utterances, rates...) of each scene.

    sizes: one row (avg_chars, max_chars); rates: (context, key, rate) of markers; counts: (context, utterances). None:
    there is no bank. Scenes without lines have `empty_input` only.
    """
    one = lambda signal: F.struct(F.lit(signal).alias("signal"), F.lit("genre_fit").alias("axis"), F.lit(0.99).alias("confidence"), F.lit(None).cast("string").alias("cited"))
    rows = matches.select("*", *[F.array_contains("contexts", c).alias(f"c_{c}") for c in rules.CONTEXTS], *[F.array_contains("acts", a).alias(f"a_{a}") for a in rules.ACTS])
    if sizes is None:
        found = F.array(F.when(F.col("line_count") == 0, one("empty_input")).otherwise(one("bank_unavailable")))
    else:
        bank = sizes.select("avg_chars", F.col("max_chars").alias("bank_max"))
        limit = F.greatest(F.lit(80), F.floor(F.col("avg_chars") * 2.5).cast("int"), F.least("bank_max", F.lit(180)))
        rows = rows.join(F.broadcast(bank.limit(1).withColumn("density_threshold", limit).withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"))  # one row
        hits = []
        for signal, (axis, confidence, condition, cited, _) in rules.GUIDANCE.items():
            first, _, second = (cited or "").partition("|")
            name = F.when(F.col(f"c_{first}"), first).otherwise(second) if second else F.lit(cited)
            hits.append(F.when(F.expr(condition), F.struct(F.lit(signal).alias("signal"), F.lit(axis).alias("axis"), F.lit(confidence).alias("confidence"), name.cast("string").alias("cited"))))
        found = F.when(F.col("line_count") == 0, F.array(one("empty_input"))).otherwise(F.array_compact(F.array(*hits)))
    out = rows.select("scene_id", "contexts", F.explode(found).alias("g")).select("scene_id", "contexts", "g.*")
    if sizes is None:
        return out
    for marker in ("apology", "polite_buffer", "empathy"):
        wanted = F.array(*[F.lit(s) for s, g in rules.GUIDANCE.items() if marker in g[4]])
        part = rates.where(F.col("key") == marker).select(F.col("context").alias("cited"), F.col("rate").alias("_rate"))
        out = out.join(F.broadcast(part), "cited", "left").withColumn(f"{marker}_rate", F.when(F.array_contains(wanted, F.col("signal")), F.coalesce("_rate", F.lit(0.0)))).drop("_rate")  # nine contexts
    out = out.join(F.broadcast(counts.select(F.col("context").alias("cited"), F.col("utterances").alias("_n"))), "cited", "left")
    return out.withColumn("utterances", F.when(F.col("cited").isNotNull(), F.coalesce("_n", F.lit(0)))).drop("_n")
