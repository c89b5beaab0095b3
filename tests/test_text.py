"""Lines, metrics and scalar functions."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from damhwa.functions import text as T
from damhwa.operators import lines as L

SIX = "가\r\n나\n다\r라 마 바"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


def test_breaks_and_lines(spark):
    assert one(spark, SIX, T.break_count) == 5
    row = L.text_metrics(spark.createDataFrame([(1, SIX), (2, None), (3, "")], "id int, text string"), "id").orderBy("id").collect()
    assert (row[0].line_count, row[0].line_breaks, row[0].total_nfc_chars, row[0].total_neis_bytes) == (6, 5, 6, 18 + 10)
    assert all(row[k].line_count == row[k].total_utf8_bytes == 0 and row[k].avg_nfc_chars == 0.0 for k in (1, 2))


def test_normal_form_and_bytes(spark):
    text = unicodedata.normalize("NFD", "한") + "A"
    assert one(spark, text, lambda x: F.length(T.nfc(x))) == 2
    assert one(spark, text, lambda x: F.octet_length(T.nfc(x))) == 4
    assert one(spark, "한A\r\n", T.neis_bytes) == 6
    assert one(spark, " \r\n\n", T.neis_bytes) == 6


def test_trim_is_unicode(spark):
    assert one(spark, "　\x1c 가 \x85", T.trim) == "가"


def test_speaker_is_stripped_and_text_is_not_returned(spark):
    out = L.text_metrics(spark.createDataFrame([(1, "민지: 안녕 하세요")], "id int, text string"), "id")
    row = out.first()
    assert (row.total_nfc_chars, row.total_chars_without_whitespace) == (6, 5)
    assert all(t != "string" for _, t in out.dtypes)


def test_speaker_only_line_stays(spark):
    items = spark.createDataFrame([(1, 0, "민지:"), (1, 1, "응.")], "scene_id int, item_idx int, item string")
    assert [(r.line_index, r.line) for r in L.lines(items).orderBy("line_index").collect()] == [(1, ""), (2, "응.")]


def test_list_and_newline_items_give_equal_lines(spark):
    a = spark.createDataFrame([(1, 0, "하나\n둘")], "scene_id int, item_idx int, item string")
    b = spark.createDataFrame([(1, 0, "하나"), (1, 1, "둘")], "scene_id int, item_idx int, item string")
    assert sorted(map(tuple, L.lines(a).collect())) == sorted(map(tuple, L.lines(b).collect()))


def test_buckets(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 10, 11, 240, 241)], "n int").select(T.bucket(F.col("n"), (10, 30, 60, 120, 240)).alias("b"))
    assert [r.b for r in rows.collect()] == ["0-10", "0-10", "11-30", "121-240", "241+"]


def test_speech_levels(spark):
    lines = {"좋습니다.": "hapsyo", "감사합니다.": "banmal", "그래요?": "haeyo", "민지: 그랬거든!": "banmal", "너 때문이라고": "banmal", "흠": "unknown"}
    for line, level in lines.items():
        assert one(spark, line, T.speech_level) == level


def test_path_names(spark):
    for path, split, role, dataset in (("a/Training/label.zip", "training", "label", "a"), ("latest.json", "test", "unknown", "latest"), ("device.v2.json", "dev", "unknown", "device.v2")):
        row = spark.createDataFrame([(path,)], "p string").select(T.infer_split(F.col("p")), T.infer_data_role(F.col("p")), T.top_dataset(F.col("p"))).first()
        assert tuple(row) == (split, role, dataset)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="가a \n:. 　", max_size=20), min_size=1, max_size=5))
def test_metrics_add_up_over_texts(spark, texts):
    rows = L.text_metrics(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string"), "id", strip_speakers=False).collect()
    lines = [s for t in texts for s in "\n".join(t.split(" ")).split("\n") if s.strip()]
    assert sum(r.line_count for r in rows) == len(lines)
    assert sum(r.total_nfc_chars for r in rows) == sum(len(s.strip()) for s in lines)
