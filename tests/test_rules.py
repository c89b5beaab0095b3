"""The rule pack: dialects agree, every signal fires and stays silent, hints carry no text."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from damhwa.functions import rules
from damhwa.operators import features as X
from damhwa.operators import guidance as G
from damhwa.operators import hints as H
from damhwa.operators import lines as L
from damhwa.plans import overlay

PATTERNS = {
    **{f"line_{k}": v for k, v in rules.CALIBRATION_LINE.items()}, **{f"context_{k}": v for k, v in rules.CALIBRATION_CONTEXT.items()}, **{f"act_{k}": v for k, v in rules.ACTS.items()}, **{f"in_{k}": v for k, v in rules.CONTEXTS.items()},
    **rules.GRAMMAR, **rules.TRANSLATIONESE, **rules.RHYTHM, **{f"n_{k}": v for k, v in rules.COUNTED.items()}, "da": rules.DA_ENDING, "written": rules.WRITTEN_ENDING, "reaction": rules.REACTION, "hapsyo": rules.HAPSYO, "haeyo": rules.HAEYO, "banmal": rules.BANMAL,
}
TEXTS = [*overlay.LINES, *[" ".join(s) for s in overlay.SCENES], "안　돼", "그는.", "끝 ", "가가", "가가 나", "이\x1c의해 만들되다"]


def test_dialects_agree(spark):
    """Python, Spark and RE2 find the same matches, equally often."""
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, t VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(TEXTS)))
    got = rows.select("i", *[F.regexp_count("t", F.lit(rules.java(p))).alias(n) for n, p in PATTERNS.items()]).orderBy("i").collect()
    other = {n: [r[0] for r in con.execute(f"SELECT len(regexp_extract_all(t, '{rules.re2(p)}')) FROM t ORDER BY i").fetchall()] for n, p in PATTERNS.items()}
    for name, p in PATTERNS.items():
        mine = [len(re.findall(p, t)) for t in TEXTS]
        assert [r[name] for r in got] == mine, name
        assert other[name] == mine, name


def scene(spark, lines, **fields):
    items = spark.createDataFrame([(1, k, line) for k, line in enumerate(lines)], "scene_id long, item_idx int, item string")
    names = ("scene", "medium", "genre", "character_profiles", "relationship_boundaries")
    scenes = spark.createDataFrame([(1, *[fields.get(n, "") for n in names])], "scene_id long, " + ", ".join(f"{n} string" for n in names))
    return X.line_features(L.lines(items)), scenes


def signals_of(rows):
    return {s for r in rows.collect() for s in r.signals}


def test_every_line_signal_fires_and_is_silent(spark):
    found = X.line_signals(scene(spark, overlay.LINES)[0]).groupBy("signal").agg(F.count("*").alias("n")).collect()
    n = {r.signal: r.n for r in found}
    for name in (*rules.CALIBRATION_LINE, *rules.GRAMMAR, *rules.TRANSLATIONESE, *rules.RHYTHM, *rules.COUNTED, "clause_stack", "da_streak", "written", "reaction", "very_long"):
        assert 0 < n.get(name, 0) < len(overlay.LINES), name


def test_calibration_formal_scene(spark):
    found = H.calibration_hints(*scene(spark, ["환불은 안 돼.", "빨리 말해!", "기다리세요.", "야, 너 누구야?", "알겠습니다."], scene="고객 민원 항의"))
    assert signals_of(found) >= {"mixed_speech_levels_without_context_trigger", "overfamiliar_address_in_formal_context", "direct_command_in_polite_context", "unsoftened_request_in_polite_context", "blunt_refusal_without_buffer", "missing_apology_or_acknowledgement_in_service_context"}
    refs = {r.hint: r.line_refs for r in found.collect()}
    assert refs["direct_command"] == [2] and refs["missing_buffer"] == []


def test_calibration_buffered_scene_is_quiet(spark):
    quiet = H.calibration_hints(*scene(spark, ["죄송하지만 그건 안 돼요.", "잠시 기다려 주시겠어요?"], scene="고객 민원"))
    assert not signals_of(quiet) & {"blunt_refusal_without_buffer", "direct_command_in_polite_context", "missing_apology_or_acknowledgement_in_service_context"}


def test_calibration_length_and_age(spark):
    found = signals_of(H.calibration_hints(*scene(spark, ["가" * 121, "스마트폰을 봐."], genre="사극")))
    assert found >= {"very_long_utterance", "exposition_density_risk", "medium_density_risk", "modern_term_in_old_world_context"}
    assert "long_utterance_cluster" not in found
    assert "long_utterance_cluster" in signals_of(H.calibration_hints(*scene(spark, ["가" * 61, "나" * 70])))
    assert "large_scene_packet" in signals_of(H.calibration_hints(*scene(spark, ["네."] * 21)))


def test_streaks_and_scene_signals(spark):
    plain = ["비가 왔다.", "문이 닫혔다.", "불이 꺼졌다.", "모두 떠났다."]
    found = signals_of(H.naturalness_hints(*scene(spark, ["그래요.", *plain, "결론적으로, 따라서 끝이에요."])))
    assert {"da_ending_streak", "ai_discourse_marker_cluster"} <= found
    assert "da_ending_streak" not in signals_of(H.naturalness_hints(*scene(spark, [*plain[:2], "응.", *plain[2:]])))
    written = ["이것이 우리가 바라던 것이다."] * 3 + ["오늘은 집에서 쉬는 것으로 보인다."]
    assert {"written_register_cluster", "missing_short_reaction_turns"} <= signals_of(H.naturalness_hints(*scene(spark, written)))


def test_no_text_in_outputs(spark):
    features, scenes = scene(spark, ["비밀스러운 문장입니다.", "금새 그쳤어."])
    out = str(H.calibration_hints(features, scenes).collect() + H.naturalness_hints(features, scenes).collect() + G.guidance(G.scene_matches(features, scenes), None, None, None).collect())
    assert "비밀" not in out and "그쳤" not in out


def test_guidance(spark):
    sizes = spark.createDataFrame([(20.0, 90)], "avg_chars double, max_chars int")
    rates = spark.createDataFrame([("customer_complaint", "apology", 0.4)], "context string, key string, rate double")
    counts = spark.createDataFrame([("customer_complaint", 12)], "context string, utterances long")
    rows = G.guidance(G.scene_matches(*scene(spark, ["그건 안 돼.", "가" * 120], scene="고객 환불")), sizes, rates, counts).collect()
    by = {r.signal: r for r in rows}
    assert by["customer_complaint_refusal"].apology_rate == 0.4 and by["customer_complaint_refusal"].utterances == 12 and by["customer_complaint_refusal"].polite_buffer_rate == 0.0
    assert "dialogue_density_outlier" in by
    empty = G.guidance(G.scene_matches(*scene(spark, [" "])), sizes, rates, counts).collect()
    assert [r.signal for r in empty] == ["empty_input"]
    assert [r.signal for r in G.guidance(G.scene_matches(*scene(spark, ["응."])), None, None, None).collect()] == ["bank_unavailable"]
    assert G.baseline_mode("odd", True)[0] == "balanced" and G.baseline_mode("raw", True)[0] == "raw" and G.baseline_mode("balanced", False, False)[0] == "legacy_raw"


@pytest.mark.parametrize("profile, soft", [(None, 60), ('{"datasets": {"a": {"utterance_length_buckets": {"0-10": 1, "61-120": 9}}}}', 80), ("not json", 60)])
def test_thresholds(spark, tmp_path, profile, soft):
    path = tmp_path / "profile.json"
    if profile:
        path.write_text(profile)
    assert H.thresholds(spark, str(path))["soft_max"] == soft
