"""One projection of all line rules, and the state of each scene that hints are decided on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from damhwa.functions import rules
from damhwa.functions import text as T

LINE_SIGNALS = {**rules.GRAMMAR, **rules.TRANSLATIONESE, **rules.RHYTHM}


def line_features(lines: DataFrame, soft_max: int = rules.SOFT_MAX, hard_max: int = rules.HARD_MAX, nfc: bool = True) -> DataFrame:
    """(scene_id, line_index, line, chars, raw_chars, speech, guided_speech, acts, signals) of lines.

    signals: array of (signal, m), m counting matches; a signal's patterns are compiled once a task. Speech is classified
    from the line as it came, for guidance from the line without its speaker.
    """
    x = F.col("line")
    hit = lambda name: T.matches(x, rules.CALIBRATION_LINE[name])
    rows = lines.select("scene_id", "line_index", "line", F.length(T.nfc(x) if nfc else x).alias("chars"), F.length(x).alias("raw_chars"), T.speech_level(F.col("raw")).alias("speech"), T.speech_level(x).alias("guided_speech"), T.detect(x, rules.ACTS).alias("acts"), T.ending_key(x).alias("ending_key"))
    bare = ~hit("buffer")
    found: dict[str, Column] = {name: hit(name) for name in rules.CALIBRATION_LINE}
    found |= {
        "long": F.col("chars") > soft_max,
        "very_long": F.col("chars") > hard_max,
        "known_level": F.col("speech") != "unknown",
        "bare_command": hit("command") & bare,
        "bare_request": hit("unsoftened_request") & bare,
        "bare_refusal": hit("blunt_refusal") & bare,
        "advice_or_overpromise": hit("advice") | hit("overpromise"),
        "written": T.matches(x, rules.WRITTEN_ENDING),
        "reaction": (F.col("chars") <= 8) & T.matches(x, rules.REACTION),
        "da_ending": T.matches(x, rules.DA_ENDING),
        **{name: T.matches(x, p) for name, p in LINE_SIGNALS.items()},
    }
    counted = {**rules.TRANSLATIONESE, **rules.COUNTED}
    times = {name: T.count(x, p) for name, p in counted.items()}
    found |= {name: times[name] > 0 for name in rules.COUNTED} | {"clause_stack": times["clause"] >= 3}
    # arrays of moderate size, so that no generated method grows past what the JVM compiles
    names = sorted(found)
    parts = [F.array_compact(F.array(*[F.when(found[n], F.struct(F.lit(n).alias("signal"), (times[n] if n in times else F.lit(1)).cast("long").alias("m"))) for n in names[k : k + 20]])) for k in range(0, len(names), 20)]
    return rows.withColumn("signals", F.concat(*parts))


def line_signals(features: DataFrame) -> DataFrame:
    """(scene_id, line_index, signal, m), with `da_streak` for lines in a run of four or more plain endings."""
    rows = features.select("scene_id", "line_index", F.explode("signals").alias("s")).select("scene_id", "line_index", "s.signal", "s.m")
    ends = rows.where("signal = 'da_ending'")
    run = ends.withColumn("run", F.col("line_index") - F.row_number().over(Window.partitionBy("scene_id").orderBy("line_index")))
    long = run.withColumn("n", F.count("*").over(Window.partitionBy("scene_id", "run"))).where("n >= 4")
    return rows.unionByName(long.select("scene_id", "line_index", F.lit("da_streak").alias("signal"), F.lit(1).cast("long").alias("m")))


def signal_lines(features: DataFrame) -> DataFrame:
    """(scene_id, signal, n lines, m matches, refs): one row for each signal that a scene has."""
    refs = F.array_sort(F.collect_list("line_index"))
    return line_signals(features).groupBy("scene_id", "signal").agg(F.count("*").alias("n"), F.sum("m").alias("m"), refs.alias("refs"))


def scene_context(scenes: DataFrame) -> DataFrame:
    """scenes with `context`, the space-joined fields that are not empty, and a boolean for each context rule."""
    fields = [F.nullif(F.col(c), F.lit("")) for c in ("scene", "medium", "genre", "character_profiles", "relationship_boundaries")]
    rows = scenes.select("scene_id", F.concat_ws(" ", *fields).alias("context"))
    return rows.select("scene_id", "context", *[T.matches(F.col("context"), p).alias(n) for n, p in rules.CALIBRATION_CONTEXT.items()])


def scene_state(features: DataFrame, scenes: DataFrame, names: set[str], soft_max: int = rules.SOFT_MAX) -> DataFrame:
    """One row a scene: sizes, n_, m_ and r_ (lines, matches, line references) of `names`, context rules."""
    base = features.groupBy("scene_id").agg(
        F.count("*").alias("line_count"), F.sum("chars").alias("total_chars"), F.max("chars").alias("max_chars"), F.min("chars").alias("min_chars"), F.max("raw_chars").alias("max_raw_chars"),
        F.count_distinct(F.when(F.col("speech") != "unknown", F.col("speech"))).alias("known_levels"), F.count_distinct("ending_key").alias("ending_keys"), F.count("ending_key").alias("endings"),
    )
    signals = signal_lines(features).where(F.col("signal").isin(*names)).groupBy("scene_id").agg(F.map_from_entries(F.collect_list(F.struct("signal", F.struct("n", "m", "refs")))).alias("found"))
    rows = scene_context(scenes).join(base, "scene_id", "left").join(signals, "scene_id", "left")
    got = lambda n, k, none: F.coalesce(F.col("found")[n][k], none)
    zero, empty = F.lit(0).cast("long"), F.array().cast("array<int>")
    sizes = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("line_count", "total_chars", "max_chars", "min_chars", "max_raw_chars", "known_levels", "ending_keys", "endings")]
    average = F.when(F.col("line_count") > 0, F.round(F.col("total_chars") / F.col("line_count"), 1)).otherwise(F.lit(0.0)).alias("avg_chars")
    found = [x for n in sorted(names) for x in (got(n, "n", zero).alias(f"n_{n}"), got(n, "m", zero).alias(f"m_{n}"), got(n, "refs", empty).alias(f"r_{n}"))]
    return rows.select("scene_id", *rules.CALIBRATION_CONTEXT, *sizes, average, F.lit(soft_max).alias("soft_max"), *found)


def joined(refs: Column) -> Column:
    return F.array_join(F.transform(refs, lambda x: x.cast("string")), ",")
