"""Corpus files, inventory, pattern bank, catalog, streaming."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from damhwa.functions import text as T
from damhwa.operators import bank as B
from damhwa.operators import catalog as C
from damhwa.sources import corpus, inventory
from damhwa.streaming import scenes as S


def archive(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, value in entries.items():
            z.writestr(name, value if isinstance(value, (str, bytes)) else json.dumps(value, ensure_ascii=False))


TALK = [{"topic": "고객 민원", "speaker_relation": "초면", "emotion": "분노", "conversation": [{"utterance": "환불해 주세요.", "speaker_emotion": "화남"}, {"utterance": "죄송합니다.", "listener_empathy": "위로"}]}]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "data"
    (root / "one").mkdir(parents=True)
    (root / "two" / ".git").mkdir(parents=True)
    archive(root / "one" / "train.zip", {f"{k}.json": {"utterance": "짧은 말."} for k in range(9)} | {"deep/x.bin": "?"})
    archive(root / "two" / "label_valid.zip", {"a.json": {"utterance": "조금 더 긴 문장을 여기에 적어 둡니다, 서른 자를 넘겨서요."}, "b.txt": "첫 줄\n\n둘째 줄".encode("cp949")})
    (root / "two" / "bad.zip").write_bytes(b"no zip")
    (root / "two" / ".git" / "x.json").write_text("{}")
    (root / "talk.json").write_text(json.dumps(TALK, ensure_ascii=False), encoding="utf-8-sig")
    archive(root / "sheet.xlsx", {"xl/worksheets/sheet1.xml": '<worksheet><dimension ref="A1:C9"/></worksheet>'})
    return root


def test_walk_counts_each_conversation_once():
    rows = list(corpus.walk(TALK))
    assert [r[4] for r in rows if r[0] == "turns"] == [2]
    assert {(r[1], r[2]) for r in rows if r[0] == "label"} == {("topic", "고객 민원"), ("speaker_relation", "초면"), ("speaker_emotion", "화남"), ("listener_empathy", "위로")}
    assert [(r[2], r[3]) for r in rows if r[0] == "text"] == [("환불해 주세요.", "화남"), ("죄송합니다.", "위로")]


def test_walk_handles_deep_documents():
    deep = {"text": "끝"}
    for _ in range(5000):
        deep = {"x": [deep]}
    assert [r[2] for r in corpus.walk(deep) if r[0] == "text"] == ["끝"]


def test_corpus_rows_and_bank(spark, folder):
    rows = corpus.corpus_rows(corpus.read_files(spark, str(folder))).where(~F.col("path").contains(".git")).cache()
    c = corpus.coverage(rows).first()
    assert (c.errors, c.seen, c.sampled) == (1, 12, 11)
    name = F.regexp_extract("path", r"data/([^/.]+)", 1)
    hist = B.histograms(B.utterance_features(corpus.utterances(rows.where("entry is not null and entry like '%.json'"), name)))
    balanced = {(r.family, r.key): r.rate for r in B.balanced_rates(hist).where("context is null").collect()}
    raw = {(r.family, r.key): r.rate for r in B.raw_rates(hist).where("context is null").collect()}
    assert balanced["length", "31-60"] == 0.5 and raw["length", "31-60"] == 0.1
    assert B.dominance(hist).first().warning
    assert {r.n for r in corpus.turns(rows).collect()} == {2}
    assert {r.key for r in corpus.labels(rows, emotions=True).collect()} == {"speaker_emotion", "listener_empathy"}
    limited = corpus.coverage(corpus.corpus_rows(corpus.read_files(spark, str(folder)), limit=2)).first()
    assert limited.sampled == 4


def test_cp949_and_malformed():
    assert corpus.decode_lines("첫 줄\n\n 둘째".encode("cp949")) == ["첫 줄", "둘째"]
    assert [r[2] for r in corpus.file_rows("x.json", b"{")] == ["skipped"]
    assert [r[2] for r in corpus.file_rows("x.zip", b"")] == ["error"]


def test_inventory(spark, folder):
    rows = {r.path: r for r in inventory.inventory(spark, str(folder)).collect()}
    assert sorted(rows) == ["one/train.zip", "sheet.xlsx", "talk.json", "two/bad.zip", "two/label_valid.zip"]
    assert rows["one/train.zip"].split == "training" and rows["two/label_valid.zip"].data_role == "label" and rows["sheet.xlsx"].dataset == "sheet"
    assert json.loads(rows["sheet.xlsx"].profile)["xlsx"]["sheets"] == {"sheet1.xml": "A1:C9"}
    assert json.loads(rows["one/train.zip"].profile)["archive"]["files"] == 10
    assert "환불" not in rows["talk.json"].profile and "error" in json.loads(rows["two/bad.zip"].profile)
    assert {(r.kind, r.name): r.files for r in inventory.summary(inventory.records(inventory.list_files(spark, str(folder)))).collect()}["extension", ".zip"] == 3


def test_labels(spark):
    rows = [("k", f"v{k:03d}") for k in range(100)] + [("k", "v050"), ("k", "문장입니다."), ("k", "가" * 41), ("k", "")]
    top = B.top_labels(spark.createDataFrame(rows, "key string, value string")).collect()
    assert len(top) == 80 and ("k", "v050", 2) in [tuple(r) for r in top] and "v099" not in {r.value for r in top}


def test_balanced_rates_do_not_depend_on_order(spark):
    rows = [(d, t, "") for d in ("a", "b", "c") for t in ("네.", "감사합니다.", "그래?" * (1 + (d == "c")))]
    one = B.balanced_rates(B.histograms(B.utterance_features(spark.createDataFrame(rows, "dataset string, text string, context_blob string"))))
    two = B.balanced_rates(B.histograms(B.utterance_features(spark.createDataFrame(rows[::-1], "dataset string, text string, context_blob string"))))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_catalog(spark):
    assert all(r.ok for r in C.validate(spark, spark.createDataFrame([("c1", k) for k in C.CARD_KEYS], "id string, key string")).collect())
    assert not [r for r in C.validate(spark, spark.createDataFrame([("c1", "id")], "id string, key string")).collect() if r.check == "card_keys"][0].ok
    assert C.examples(spark, "speech_level", 99).count() == 5 and C.examples(spark, None, 0).count() == 1
    with pytest.raises(ValueError):
        C.examples(spark, "nothing")
    lines = spark.createDataFrame([(1, "text: secret words"), (2, "  Summary: <omitted>"), (3, "note: x"), (4, "원문: '비밀'"), (5, "text: omitted")], "i int, line string")
    assert [r.i for r in C.forbidden_fields(lines).orderBy("i").collect()] == [1, 4]


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, ["응.", "그래."]), (2, ["네."])], "scene_id long, lines array<string>").write.json(str(source))
    stream = spark.readStream.schema("scene_id long, lines array<string>").json(str(source))
    seen = []
    query = S.review(stream, lambda items, scenes: items.groupBy("scene_id").agg(F.count("*").alias("n")), lambda df, k: seen.extend(df.collect()), str(tmp_path / "ck"))
    query.awaitTermination()
    assert sorted((r.scene_id, r.n) for r in seen) == [(1, 2), (2, 1)]


def test_entry_lists_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert T.bucket is not None
