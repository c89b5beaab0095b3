"""The registered queries: name -> (spark, sf_dir) -> DataFrame with flat columns.

Metrics run over the driver's own text. Rules about Korean dialogue run over the synthetic overlay, as that text has none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from damhwa.functions import rules
from damhwa.functions import text as T
from damhwa.operators import bank as B
from damhwa.operators import catalog as C
from damhwa.operators import features as X
from damhwa.operators import guidance as G
from damhwa.operators import hints as H
from damhwa.operators import lines as L
from damhwa.plans import overlay
from damhwa.sources import inventory as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- metrics


@query
def doc_text_metrics(spark, sf):
    return L.text_metrics(table(spark, sf, "documents"), "doc_id")


@query
def metrics_keep_speakers(spark, sf):
    return L.text_metrics(table(spark, sf, "documents"), "doc_id", strip_speakers=False).select("doc_id", "line_count", "total_nfc_chars", "max_nfc_chars")


@query
def doc_line_metrics(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    rows = docs.select("doc_id", F.posexplode(F.transform(T.split_lines(F.col("text")), T.strip_speaker)).alias("pos", "line")).withColumn("line_index", F.col("pos") + 1)
    return L.line_metrics(rows, "doc_id", "line_index")


@query
def line_break_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(T.break_count(F.col("text")), F.lit(0)).alias("line_breaks"))


@query
def conv_text_metrics(spark, sf):
    items = table(spark, sf, "conversations").select(F.col("conv_id").alias("scene_id"), F.col("turn").alias("item_idx"), F.col("text").alias("item"))
    return L.scene_metrics(items)


@query
def metrics_by_lang(spark, sf):
    rows = L.text_metrics(table(spark, sf, "documents"), "lang")
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("line_count").alias("line_count"), F.sum("total_nfc_chars").alias("nfc_chars"), F.sum("total_utf8_bytes").alias("utf8_bytes"), F.max("max_nfc_chars").alias("max_nfc_chars"))


# ---- features of lines


def dialogue(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(line features, scenes) of the overlay on conversations."""
    conversations = table(spark, sf, "conversations")
    return X.line_features(L.lines(overlay.conversation_items(conversations)), nfc=False), overlay.scenes(conversations)


@query
def speech_level_by_line(spark, sf):
    return dialogue(spark, sf)[0].select("scene_id", "line_index", "speech")


@query
def speech_level_counts(spark, sf):
    levels = ("banmal", "haeyo", "hapsyo", "unknown")
    return dialogue(spark, sf)[0].groupBy("scene_id").agg(*[F.sum((F.col("speech") == x).cast("long")).alias(x) for x in levels])


@query
def act_counts(spark, sf):
    return dialogue(spark, sf)[0].select("scene_id", F.explode("acts").alias("act")).groupBy("scene_id", "act").agg(F.count("*").alias("cnt"))


@query
def context_matches(spark, sf):
    return G.scene_matches(*dialogue(spark, sf)).select("scene_id", F.array_join("contexts", ",").alias("contexts"), F.array_join("acts", ",").alias("acts"))


def bank(spark, sf, dataset="lang") -> DataFrame:
    return B.histograms(B.utterance_features(overlay.document_utterances(table(spark, sf, "documents"), dataset)))


@query
def marker_counts(spark, sf):
    return bank(spark, sf).where("family = 'marker' and context is null").select("dataset", "key", "cnt")


@query
def length_buckets(spark, sf):
    rows = table(spark, sf, "documents").select(F.explode(T.split_lines(F.coalesce("text", F.lit("")))).alias("line"))
    return rows.groupBy(T.bucket(F.length("line"), rules.LENGTH_BOUNDS).alias("bucket")).agg(F.count("*").alias("cnt"))


# ---- calibration


def calibration(*names: str) -> Query:
    def run(spark, sf):
        rows = H.calibration_hints(*dialogue(spark, sf))
        rows = rows.where(F.col("hint").isin(*names)) if names else rows
        return rows.select("scene_id", "seq", "hint", "axis", "confidence", F.array_join("signals", ",").alias("signals"), X.joined(F.col("line_refs")).alias("line_refs"))

    return run


CALIBRATION = {
    "calib_length": ("very_long", "medium_density", "long_cluster"),
    "calib_mixed_speech": ("mixed_speech",),
    "calib_overfamiliar": ("overfamiliar",),
    "calib_direct_command": ("direct_command",),
    "calib_unsoftened_request": ("unsoftened_request",),
    "calib_blunt_refusal": ("blunt_refusal",),
    "calib_missing_buffer": ("missing_buffer",),
    "calib_advice_overpromise": ("advice_overpromise",),
    "calib_intimacy": ("intimacy",),
    "calib_cringe": ("cringe",),
    "calib_humor": ("humor",),
    "calib_anachronism": ("anachronism",),
    "calib_all_hints": (),
}
QUERIES |= {name: calibration(*hints) for name, hints in CALIBRATION.items()}


@query
def calib_large_packet(spark, sf):
    """A document's lines as a scene: conversations here are short."""
    docs = table(spark, sf, "documents")
    rows = overlay.document_utterances(docs).select(F.col("doc_id").alias("scene_id"), F.col("pos").alias("item_idx"), F.col("text").alias("item"))
    return rows.groupBy("scene_id").agg(F.count("*").alias("line_count")).where(F.col("line_count") > rules.SCENE_MAX).select("scene_id", F.lit("genre_fit").alias("axis"), F.lit(0.56).alias("confidence"), "line_count")


@query
def calib_thresholds(spark, sf):
    rows = length_buckets(spark, sf)
    short = F.sum(F.when(F.col("bucket").isin("0-10", "11-30", "31-60"), F.col("cnt")).otherwise(0)) / F.sum("cnt")
    out = rows.agg(F.round(short, 4).alias("short_share"))
    return out.select("short_share", F.when(F.col("short_share") < 0.6, 80).otherwise(rules.SOFT_MAX).alias("soft_max"), F.lit(rules.HARD_MAX).alias("hard_max"))


# ---- naturalness


def naturalness(axis: str | None = None, signal: str | None = None) -> Query:
    def run(spark, sf):
        rows = H.naturalness_signals(*dialogue(spark, sf))
        rows = rows.where(F.col("axis") == axis) if axis else rows.where(F.col("signal") == signal)
        return rows.select("scene_id", "signal", "n", "m", X.joined(F.col("refs")).alias("line_refs"))

    return run


SCENE_SIGNALS = {
    "nat_da_streak": "da_ending_streak",
    "nat_third_person": "third_person_pronoun_literalism",
    "nat_progressive": "progressive_aspect_cluster",
    "nat_discourse": "ai_discourse_marker_cluster",
    "nat_relative_clause": "relative_clause_stack",
}
AXES = {"nat_grammar": "grammar_acceptability", "nat_idiom": "native_korean_idiom", "nat_rhythm": "spoken_korean_rhythm"}
SCENE_HINTS = {"nat_pronouns": "explicit_pronoun_overuse", "nat_written_register": "written_register_cluster", "nat_short_reaction": "missing_short_reaction_turns"}
QUERIES |= {name: naturalness(axis=axis) for name, axis in AXES.items()} | {name: naturalness(signal=s) for name, s in SCENE_SIGNALS.items()}


def flat_naturalness(spark, sf) -> DataFrame:
    rows = H.naturalness_hints(*dialogue(spark, sf))
    return rows.select("scene_id", "seq", "axis", "confidence", F.array_join("signals", ",").alias("signals"), X.joined(F.col("line_refs")).alias("line_refs"))


def scene_hint(signal: str) -> Query:
    return lambda spark, sf: flat_naturalness(spark, sf).where(F.col("signals") == signal)


QUERIES |= {name: scene_hint(s) for name, s in SCENE_HINTS.items()} | {"nat_all_hints": flat_naturalness}


@query
def nat_ending_diversity(spark, sf):
    return H.naturalness_counters(*dialogue(spark, sf))


@query
def nat_signal_counts(spark, sf):
    """Post-editese counts: matches of translation-like rules, lines of stacks and streaks."""
    rows = H.naturalness_signals(*dialogue(spark, sf)).where(F.col("signal").isin(*rules.TRANSLATIONESE, *rules.SCENE_SIGNALS))
    by_line = F.col("signal").isin("relative_clause_stack", "da_ending_streak")
    return rows.select("scene_id", "signal", F.when(by_line, F.col("n")).otherwise(F.col("m")).alias("cnt"))


@query
def nat_metadata_join(spark, sf):
    rows = H.naturalness_signals(*dialogue(spark, sf)).groupBy("signal").agg(F.count("*").alias("scenes"), F.sum("n").alias("lines"))
    return rows.join(F.broadcast(C.signals(spark)), "signal").select("signal", "category", "severity", "scope", "scenes", "lines")  # 43 signals


@query
def nat_suggestions(spark, sf):
    rows = H.naturalness_signals(*dialogue(spark, sf))
    return rows.join(F.broadcast(C.signals(spark).where("suggestion_type is not null")), "signal").groupBy("suggestion_type").agg(F.count("*").alias("scene_signals"), F.count_distinct("scene_id").alias("scenes"))


# ---- pattern bank


@query
def bank_raw_rates(spark, sf):
    return B.raw_rates(bank(spark, sf)).where("context is null").drop("context")


@query
def bank_dataset_profile(spark, sf):
    return B.dataset_profiles(bank(spark, sf, "source"))


@query
def bank_dataset_rates(spark, sf):
    return B.dataset_rates(bank(spark, sf)).where("context is null").drop("context")


@query
def bank_balanced_rates(spark, sf):
    return B.balanced_rates(bank(spark, sf)).where("context is null").drop("context")


@query
def bank_context_raw(spark, sf):
    return B.raw_rates(bank(spark, sf)).where("context is not null")


@query
def bank_context_balanced(spark, sf):
    return B.balanced_rates(bank(spark, sf)).where("context is not null")


@query
def bank_politeness(spark, sf):
    return bank_context_raw(spark, sf).where(F.col("context").isin(*rules.POLITENESS_CONTEXTS) & (F.col("family") == "marker")).select("context", "key", "cnt", "total", "rate")


@query
def bank_turn_buckets(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return B.turn_buckets(turns)


@query
def bank_labels_top80(spark, sf):
    labels = table(spark, sf, "labels").select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("quality", "toxic")])).alias("x")).select("x.*")
    events = table(spark, sf, "events").select(F.lit("event_type").alias("key"), F.col("event_type").alias("value"))
    return B.top_labels(labels.unionByName(events))


@query
def bank_dominance(spark, sf):
    return B.dominance(bank(spark, sf))


@query
def bank_sizes(spark, sf):
    hist = bank(spark, sf)
    one = lambda balanced: B.global_sizes(hist, balanced).select(F.lit("balanced" if balanced else "raw").alias("mode"), "utterances", "datasets", "avg_chars", "max_chars")
    return one(False).unionByName(one(True))


# ---- guidance


def guided(spark, sf) -> DataFrame:
    hist = bank(spark, sf)
    rates = B.balanced_rates(hist).where("context is not null and family = 'marker'").select("context", "key", "rate")
    counts = hist.where("family = 'all' and context is not null").groupBy("context").agg(F.sum("cnt").alias("utterances"))
    rows = G.guidance(G.scene_matches(*dialogue(spark, sf)), B.global_sizes(hist, True), rates, counts)
    return rows.select("scene_id", "signal", "axis", "confidence", F.array_join("contexts", ",").alias("contexts"), F.coalesce("cited", F.lit("")).alias("cited"), F.coalesce("utterances", F.lit(0)).alias("utterances"), "apology_rate", "polite_buffer_rate", "empathy_rate")


GUIDANCE = {
    "guide_customer_refusal": "customer_complaint_refusal",
    "guide_formal_request": "formal_request_directness",
    "guide_empathy": "empathy_advice_timing",
    "guide_speech_mismatch": "speech_level_context_mismatch",
    "guide_density": "dialogue_density_outlier",
}
QUERIES |= {name: (lambda spark, sf, s=s: guided(spark, sf).where(F.col("signal") == s)) for name, s in GUIDANCE.items()} | {"guide_all": guided}


@query
def guide_unavailable(spark, sf):
    rows = G.guidance(G.scene_matches(*dialogue(spark, sf)), None, None, None)
    return rows.select("scene_id", "signal", "axis", "confidence", F.array_join("contexts", ",").alias("contexts"))


# ---- the rest

PATHS = ("한국어대화/Training/[라벨]대화.zip", "한국어대화/Validation/TS_01.zip", "summary/vl_02/part.json", "device_logs.xlsx", "감성/원천데이터/train.zip", "latest.json", "a/b/c/label_dev.json", "온라인/source/x.json")


@query
def inventory_split_role(spark, sf):
    return I.records(spark.createDataFrame([(p,) for p in PATHS], "path string"))


@query
def inventory_summary(spark, sf):
    return I.summary(inventory_split_role(spark, sf))


@query
def json_shape(spark, sf):
    """What the properties of events look like: types by path, without values."""
    rows = I.shapes(table(spark, sf, "events"), "event_id", "props").where("depth = 1")
    return rows.groupBy("path", "type").agg(F.count("*").alias("cnt"))


@query
def hygiene_scan(spark, sf):
    """All lines of documents, and for every third one laid over it under a field's name, scanned for fields that would leak text."""
    fields = ("text", "note", "summary", "Utterance", "발화")
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw"))
    name = F.element_at(F.array(*map(F.lit, fields)), ((F.col("doc_id") + F.col("pos")) % len(fields)).cast("int") + 1)
    value = F.when(F.col("pos") % 2 == 0, F.lit("<omitted>")).otherwise(F.concat(F.lit("line "), "pos"))
    laid = F.when(F.col("pos") % 3 == 0, F.array("raw", F.concat(name, F.lit(": "), value))).otherwise(F.array("raw"))
    return C.forbidden_fields(lines.select("doc_id", "pos", F.explode(laid).alias("line")))


@query
def example_filter(spark, sf):
    return C.examples(spark, "speech_level", 4).select("seq", "id", "category", "scene")


@query
def rubric_catalog(spark, sf):
    return C.rubric(spark).groupBy("axis").agg(F.count("*").alias("anchors"))


@query
def audit_packet(spark, sf):
    """How many hints of each kind each scene's packet holds."""
    features, scenes = dialogue(spark, sf)
    sizes = features.groupBy("scene_id").agg(F.count("*").alias("line_count"), F.sum("chars").alias("total_chars"))
    n = lambda rows, name: rows.groupBy("scene_id").agg(F.count("*").alias(name))
    parts = [n(H.calibration_hints(features, scenes), "calibration"), n(H.naturalness_hints(features, scenes), "naturalness"), n(G.guidance(G.scene_matches(features, scenes), None, None, None), "guidance")]
    out = scenes.select("scene_id").join(sizes, "scene_id", "left")
    for p in parts:
        out = out.join(p, "scene_id", "left")
    return out.fillna(0)
