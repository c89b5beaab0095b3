"""Soft hints on scenes: calibration and naturalness. Hints carry signals and line numbers, never text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from damhwa.functions import rules
from damhwa.operators import features as X

CALIBRATION_NAMES = {h[4] for h in rules.CALIBRATION_HINTS.values() if h[4]} | {"buffer", "advice", "overpromise"}
NATURALNESS_NAMES = {x[2] for x in rules.SCENE_SIGNALS.values()} | {x[3] for x in rules.SCENE_HINTS.values() if x[3]} | {"reaction"}


def thresholds(spark: SparkSession, path: str | None = None) -> dict:
    """Length limits; a profile's histograms (`datasets` of `utterance_length_buckets`, `turn_count_buckets`) move the soft one.

    A missing or malformed profile leaves the built-in limits.
    """
    out = {"soft_max": rules.SOFT_MAX, "hard_max": rules.HARD_MAX, "scene_min": rules.SCENE_MIN, "scene_max": rules.SCENE_MAX, "profile_loaded": False}
    if not path:
        return out
    try:
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
        sets = json.loads(rows[0][0]).get("datasets", {}).values() if rows else []
    except Exception as error:  # noqa: BLE001 - whatever the reader raises for a file that is not there or not JSON
        if "PATH_NOT_FOUND" not in str(error) and not isinstance(error, ValueError):
            raise
        return out
    lengths: dict[str, int] = {}
    turns = 0
    for x in sets:
        for k, v in x.get("utterance_length_buckets", {}).items():
            lengths[k] = lengths.get(k, 0) + v
        turns += len(x.get("turn_count_buckets", {}))
    total = sum(lengths.values())
    if total and sum(lengths.get(k, 0) for k in ("0-10", "11-30", "31-60")) / total < 0.6:
        out["soft_max"] = 80
    out["profile_loaded"] = bool(total or turns)
    return out


def calibration_hints(features: DataFrame, scenes: DataFrame, soft_max: int = rules.SOFT_MAX) -> DataFrame:
    """(scene_id, seq, hint, axis, confidence, signals, line_refs) in the rules' order."""
    state = X.scene_state(features, scenes, CALIBRATION_NAMES, soft_max)
    hints = []
    for seq, (name, (axis, confidence, signals, condition, cited)) in enumerate(rules.CALIBRATION_HINTS.items(), 1):
        refs = F.col(f"r_{cited}") if cited else F.array().cast("array<int>")
        hints.append(F.when(F.expr(condition), F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("hint"), F.lit(axis).alias("axis"), F.lit(confidence).alias("confidence"), F.array(*map(F.lit, signals)).alias("signals"), refs.alias("line_refs"))))
    return state.select("scene_id", F.explode(F.array_compact(F.array(*hints))).alias("h")).select("scene_id", "h.*")


def _axis_signals(features: DataFrame, state: DataFrame) -> DataFrame:
    """(scene_id, axis, signal, n, m, refs): line signals of the three axes, and scene signals that hold."""
    axis = {**dict.fromkeys(rules.GRAMMAR, "grammar_acceptability"), **dict.fromkeys(rules.TRANSLATIONESE, "native_korean_idiom"), **dict.fromkeys(rules.RHYTHM, "spoken_korean_rhythm")}
    names = F.create_map(*[F.lit(x) for pair in axis.items() for x in pair])
    of_lines = X.signal_lines(features).withColumn("axis", names[F.col("signal")]).where("axis is not null").select("scene_id", "axis", "signal", "n", "m", "refs")
    scene = [F.when(F.expr(cond), F.struct(F.lit(ax).alias("axis"), F.lit(name).alias("signal"), F.col(f"n_{ref}").alias("n"), F.col(f"m_{ref}").alias("m"), F.col(f"r_{ref}").alias("refs"))) for name, (ax, cond, ref) in rules.SCENE_SIGNALS.items()]
    of_scenes = state.select("scene_id", F.explode(F.array_compact(F.array(*scene))).alias("s")).select("scene_id", "s.*")
    return of_lines.unionByName(of_scenes)


def naturalness_signals(features: DataFrame, scenes: DataFrame) -> DataFrame:
    return _axis_signals(features, X.scene_state(features, scenes, NATURALNESS_NAMES))


def naturalness_hints(features: DataFrame, scenes: DataFrame) -> DataFrame:
    """(scene_id, seq, axis, confidence, signals, line_refs): a hint for each axis with signals, then the scene hints."""
    state = X.scene_state(features, scenes, NATURALNESS_NAMES)
    confidence = F.create_map(*[F.lit(x) for pair in rules.AXIS_CONFIDENCE.items() for x in pair])
    order = F.create_map(*[F.lit(x) for k, a in enumerate(rules.AXIS_CONFIDENCE, 1) for x in (a, k)])
    by_axis = _axis_signals(features, state).groupBy("scene_id", "axis").agg(F.array_sort(F.collect_set("signal")).alias("signals"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("line_refs"))
    by_axis = by_axis.select("scene_id", order[F.col("axis")].alias("seq"), "axis", confidence[F.col("axis")].alias("confidence"), "signals", "line_refs")
    more = []
    for seq, (name, (axis, conf, condition, cited)) in enumerate(rules.SCENE_HINTS.items(), 4):
        refs = F.col(f"r_{cited}") if cited else F.array().cast("array<int>")
        more.append(F.when(F.expr(condition), F.struct(F.lit(seq).alias("seq"), F.lit(axis).alias("axis"), F.lit(conf).alias("confidence"), F.array(F.lit(name)).alias("signals"), refs.alias("line_refs"))))
    return by_axis.unionByName(state.select("scene_id", F.explode(F.array_compact(F.array(*more))).alias("h")).select("scene_id", "h.*"))


def naturalness_counters(features: DataFrame, scenes: DataFrame) -> DataFrame:
    """The counters of a scene, and how varied its line endings are."""
    s = X.scene_state(features, scenes, NATURALNESS_NAMES)
    diversity = F.when(F.col("endings") > 0, F.round(F.col("ending_keys") / F.col("endings"), 2)).otherwise(F.lit(0.0))
    return s.select(
        "scene_id", "line_count", "total_chars", "avg_chars", "max_chars", F.col("n_reaction").alias("short_reactions"), F.col("n_written").alias("written_sentences"), F.col("m_pronoun").alias("pronouns"), F.col("m_third_person").alias("third_person_pronouns"),
        F.col("m_progressive").alias("progressives"), F.col("m_discourse").alias("discourse_markers"), F.col("n_clause_stack").alias("clause_stacks"), F.col("n_da_streak").alias("da_streak_lines"), diversity.alias("ending_key_diversity"),
    )
