"""The hygiene query scans every line of a document, its own lines and those that the fixture names."""

import duckdb

from damhwa.plans import oracles, queries

SF = "/root/testdata/sf0.01"


def test_every_line_is_scanned(spark, tmp_path):
    text = "Utterance: hello\nsummary: what they said\nnote: fine\nb\nc\n발화: 그대로\nd\ntext: <omitted>"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.pos, r.field) for r in queries.QUERIES["hygiene_scan"](spark, str(tmp_path)).collect()}
    assert found == {(1, 0, "Utterance"), (1, 1, "summary"), (1, 3, "발화"), (1, 5, "발화")}


def test_equals_the_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(oracles.ORACLES["hygiene_scan"]).fetchall()
    rows = queries.QUERIES["hygiene_scan"](spark, SF).collect()
    assert want and sorted((r.doc_id, r.pos, r.field) for r in rows) == sorted(want)
