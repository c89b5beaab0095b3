"""A bank from files: built from an inventory, stored, read back and used for guidance; what is unreadable is counted."""

import json
import zipfile

import pytest

from damhwa.operators import bank as B
from damhwa.operators import guidance as G
from damhwa.sources import bank_files, corpus, inventory


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "data"
    for name, lines in (("short", ["짧은 말."] * 9), ("long", ["조금 더 긴 문장을 여기에 적어 둡니다, 서른 자를 넘겨서요."])):
        (top / name).mkdir(parents=True)
        with zipfile.ZipFile(top / name / "train.zip", "w") as z:
            for k, line in enumerate(lines):
                z.writestr(f"{k}.json", json.dumps({"topic": "고객 민원", "utterance": line}, ensure_ascii=False))
    with zipfile.ZipFile(top / "short" / "odd.zip", "w") as z:
        z.writestr("a.json", "[" * 100_000 + "]" * 100_000)
        z.writestr("b.json", "{")
        z.writestr("c.json", json.dumps({"utterance": "네."}))
    (top / "long" / "bad.zip").write_bytes(b"no zip")
    return top


def build(spark, root, limit=0):
    return bank_files.build_from_inventory(spark, str(root), inventory.records(inventory.list_files(spark, str(root))), limit)


def test_bank_from_inventory(spark, root, tmp_path):
    bank = build(spark, root)
    c = bank["coverage"].first().asDict()
    assert (c["files_considered"], c["datasets"], c["zip_entries_seen"], c["entries_sampled"], c["documents_sampled"], c["documents_skipped"], c["utterance_count"]) == (4, 2, 13, 13, 11, 2, 11)
    assert c["full_entry_scan"] and c["dominant_dataset_share"] == 0.9091 and c["datasets_with_features"] == 2
    assert {r.type: r.cnt for r in bank["errors"].collect()} == {"RecursionError": 1, "JSONDecodeError": 1, "BadZipFile": 1}
    assert [r.warning for r in bank["warnings"].collect()] == ["largest dataset contributes 90.91% of raw utterance features; use balanced_baselines for runtime guidance"]
    folder = f"file://{tmp_path}/bank"
    bank_files.write_bank(bank, folder)
    again, why = bank_files.read_bank(spark, folder)
    assert why == [] and sorted(map(str, again["hist"].collect())) == sorted(map(str, bank["hist"].collect()))
    for mode, share in (("balanced", 0.5), ("raw", 0.0909)):
        rates = B.balanced_rates(again["hist"]) if mode == "balanced" else B.raw_rates(again["hist"])
        assert {r.key: r.rate for r in rates.where("context is null and family = 'length'").collect()}["31-60"] == share
        sizes, markers, counts = bank_files.baselines(again, mode)
        assert sizes.count() == 1 and "customer_complaint" in {r.context for r in counts.collect()}
        assert G.baseline_mode(mode, has_balanced=True)[0] == mode
    stored = "".join(p.read_text(errors="ignore") for p in (tmp_path / "bank").rglob("*") if p.is_file())
    assert "짧은 말" not in stored


def test_sampling_is_reported(spark, root):
    bank = build(spark, root, limit=2)
    assert bank["coverage"].first().entries_sampled == 5 and not bank["coverage"].first().full_entry_scan
    assert {"train.zip: sampled first 2 supported entries", "odd.zip: sampled first 2 supported entries"} <= {r.warning for r in bank["warnings"].collect()}


def test_banks_that_cannot_be_read(spark, tmp_path):
    assert bank_files.read_bank(spark, f"file://{tmp_path}/none") == (None, ["private pattern bank not found"])
    (tmp_path / "b").mkdir()
    for text, why in (("{", "private pattern bank read error: JSONDecodeError"), ('{"schema": "x"}', "private pattern bank has unexpected schema"), ("[1]", "private pattern bank has unexpected schema")):
        (tmp_path / "b" / "head.json").write_text(text)
        assert bank_files.read_bank(spark, f"file://{tmp_path}/b") == (None, [why])


def test_empty_inventory(spark, tmp_path):
    empty = spark.createDataFrame([], corpus.SCHEMA)
    bank = bank_files.build_bank(empty, spark.createDataFrame([], "path string, dataset string"))
    c = bank["coverage"].first()
    assert (c.files_considered, c.utterance_count, c.dominant_dataset_share) == (0, 0, 0.0) and bank["errors"].count() == bank["warnings"].count() == 0


def test_labels_have_no_line_breaks():
    assert not corpus.label_like("a\rb") and not corpus.label_like("a\nb") and corpus.label_like("a b")
