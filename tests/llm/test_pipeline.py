"""The pipeline against brute force, and its SQL oracles against the queries."""

import base64
import hashlib
import random
import re
from collections import Counter

import duckdb
import public_tokenizers
import pyarrow as pa
import tiktoken

from pyspark.sql import functions as F

import corpus_pipeline
from damhwa.llm import bpe, langid, mixing, queries, secret_scan
from damhwa.llm.common import materialize

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    from test_operators import components

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.when(F.col("doc_id") == 3, F.concat("text", F.lit(" password = hunter2hunter"))).otherwise(F.col("text")))
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SF), f"test-{name}"))
    assert [d.columns for d in kept[:-1]] == [columns] * 5
    rows = [{r.doc_id: r.text for r in d.collect()} for d in kept[:-1]]
    assert rows[1] == rows[0]
    assert sorted(rows[2]) == sorted({c for *_, c in components(list(rows[1].items()))})
    assert rows[3] == {i: secret_scan.redact(s, secret_scan.spans_of(s)[1]) for i, s in rows[2].items()}
    assert any(s != rows[2][i] for i, s in rows[3].items())
    mixed = Counter((r.doc_id, r.text) for r in kept[4].collect())
    for (i, s), n in mixed.items():
        assert rows[3][i].startswith(s) and n <= 3
    words = sum(len(WORD.findall(s)) * n for (_, s), n in mixed.items())
    assert abs(words - sum(len(WORD.findall(s)) for s in rows[3].values())) <= 20
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter()
    for (i, s), n in mixed.items():
        want[i, len(enc.encode_ordinary(s)), hashlib.sha256(s.encode()).hexdigest()] += n
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in kept[5].collect()) == want


def test_noise_and_other_languages_go(spark):
    rng = random.Random(4)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n)) for n in (10, 200)] + [base64.b64encode(rng.randbytes(2250)).decode()]
    noise += [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hoá ban cho lý trí.",
        "Bonke abantu bazalwa bekhululekile belingana ngesithunzi nangamalungelo. Bahlanganiswe wumcabango nangunembeza.",
    ]
    clean = ["All human beings are born free and equal in dignity and rights.", "Alle Menschen sind frei und gleich an Würde und Rechten geboren.", "the cat and the dog"]
    clean.append("Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - k, s, None) for k, s in enumerate(noise + clean)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(more), "").collect()}
    assert {i for i in kept if i < 0} == {-1 - k for k in range(len(noise), len(noise + clean))}
    assert {i for i in kept if i >= 0} == {r.doc_id for r in docs.collect()}
    few = docs.limit(20)
    assert langid.bounds(few, langid.learn(few)) == [0.0] * 10 and corpus_pipeline.language_id(spark, few, "").count() == 20


def test_oracles(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in queries.ORACLES.items():
        mine = queries.QUERIES[name](spark, SF).toPandas()
        other = con.execute(sql).df()[list(mine.columns)]
        key = ["doc_id"]
        a, b = (x.sort_values(key).reset_index(drop=True).astype(float).round(6).fillna(-1) for x in (mine, other))
        assert a.equals(b), name


def test_stages_read_and_send_small_batches(spark):
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {n: spark.conf.get(n) for n in names}
    docs = materialize(spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(4000).cast("long").alias("n_chars")), "test-long")
    sizes = lambda: [r[0] for r in docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]
    try:
        for name, stage in corpus_pipeline.STAGES:
            for n, value in zip(names, (64 << 20, 4096)):
                spark.conf.set(n, value)
            if name in ("secret_scan", "byte_bpe"):  # the others run jobs when called
                stage(spark, docs, SF)
                found = sizes()
                assert max(found) <= 2 << 20 and sum(found) >= 3000 * 4000
                assert int(spark.conf.get(names[1])) <= 1024
            assert hasattr(stage, "__wrapped__")
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_counting_grams_holds_few():
    rng = random.Random(5)
    texts = [(rng.choice("ab"), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200))) for _ in range(300)]
    want, got, largest = Counter(), Counter(), 0
    for lang, text in texts:
        want.update({(lang, int(c)): int(n) for c, n in zip(*langid.grams(text))})
    for lang, codes, counts in langid.counted(texts, 2000):
        largest = max(largest, len(codes))
        got.update({(lang, int(c)): int(n) for c, n in zip(codes, counts)})
    assert got == want and largest <= 3000 and len(got) > 100_000
    whole = Counter({(k, int(c)): int(n) for k, codes, counts in langid.counted(texts * 2, 10**7) for c, n in zip(codes, counts)})
    assert whole == want + want


def test_mixing_takes_what_the_mix_says_and_shuffles_no_text(spark):
    rng = random.Random(7)
    rows = [(None if k % 11 == 0 else k // 2 if k % 3 else k, " ".join(f"w{rng.randint(0, 99)}" for _ in range(k % 5 and rng.choice((3, 3, 40)))) or rng.choice((None, " \n")), rng.choice(("a", "b", "c", "c", None))) for k in range(400)]
    rows += [(7, "same id and size", "c"), (7, "same id, other", "d")] + [(None, f"tied number {k}", "e") for k in range(4)]
    words = lambda s: len(WORD.findall(s or ""))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for data in (rows, [(i, s, f"{src}") for i, s, src in rows[:300] if i is not None and s], [(k, f"all of a {k}", "a") for k in range(9)]):
            docs = materialize(spark.createDataFrame(data, "doc_id long, text string, source string"), "test-mixed")
            want, got = Counter(), Counter()
            taken = mixing.copies(docs, block_words=16)
            for r in mixing._mixed(docs, "doc_id", "text", "source", 16).collect():
                want[r.source, r.id, r.size] += r.taken
            found = taken.collect()
            for r in found:
                assert 0 <= r.rest < words(r.text) and 0 <= r.whole <= 3
                got[r.source, r.doc_id, words(r.text)] += r.whole * words(r.text) + r.rest
            assert len(found) == sum(words(s) > 0 for _, s, _ in data) and +got == +want
            assert sorted(map(str, found)) == sorted(map(str, mixing.copies(docs.repartition(5), block_words=16).collect()))
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        out = corpus_pipeline.mixing_stage(spark, docs, SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and not re.search(r"(?<!Broadcast)Exchange", plan)
        assert sum(words(r.text) for r in out.select("text").collect()) == sum(r.taken for r in mixing.mix(docs).select("taken").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
