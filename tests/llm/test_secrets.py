import re

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from graintide.llm.secrets import FEATURES, candidates, labelled_findings, redact, scan, secret_stage, train

from .helpers import ROWS, frame

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def forest(spark):
    return train(labelled_findings(spark.read.parquet(f"{SF}/documents.parquet"), most=200))


def test_held_out_findings(spark, forest):
    other = labelled_findings(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), most=100)
    rows = other.select("label", "value", F.explode(candidates(F.col("text"), F.col("path"), forest.transitions)).alias("c")).filter("c.value = value").select("label", (forest.score(F.col("c")) >= 0.5).cast("int").alias("got")).collect()
    assert len(rows) > 1800
    assert sum(r.label == r.got for r in rows) / len(rows) > 0.97


def test_planted_tokens_found_and_others_left(spark, forest):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {k for k, t in texts.items() if re.search(r'(?i)token = "[0-9a-f]{40}"', t)}
    got = {r.doc_id for r in scan(docs, forest).filter("is_secret").collect()}
    assert want and got == want
    clean = {r.doc_id: r.text for r in redact(docs, forest).collect()}
    for k, t in texts.items():
        assert clean[k] == re.sub(r'(token = ")[0-9a-f]{40}', r"\1[SECRET]", t, flags=re.I)


def test_odd_rows(spark, forest):
    rows = [*ROWS, (200, 'the token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" twice 0a1b2c3d4e5f60718293a4b5c6d7e8f901234567 token', "en", None, 1)]
    df = frame(spark, rows)
    found = scan(df, forest).filter("doc_id = 200").collect()
    assert len(found) == 2 and len({r.value_sha256 for r in found}) == 1
    assert [r.is_secret for r in found if r.word_index == 3] == [True]
    out = redact(df, forest)
    assert out.columns == df.columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert {(k, t) for k, t, *_ in ROWS} <= got
    assert any("[SECRET]" in (t or "") and "0a1b2c" not in t for _, t in got)
    assert scan(frame(spark, []), forest).collect() == []


def test_stage_keeps_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = secret_stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns and out.count() == docs.count()


def test_findings_differ_where_one_text_fills_the_table(spark):
    rows = [(i, "one text that fills the table" if i % 10 else f"text {i} of its own", "en", "src0", 1) for i in range(400)]
    found = labelled_findings(frame(spark, rows), most=100).collect()
    assert len(found) == 1900 and len({r.value for r in found if r.label}) == 1000
    assert not {r.path for r in found} & {"src0", "src1", "src2"}


def test_stage_on_an_empty_table(spark):
    assert secret_stage(spark, frame(spark, []), "").collect() == []


def test_short_and_letter_values_are_candidates(spark, forest):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV"
    texts = ['set password = "h7!kP2q" now', "the secret: qzjxkvwplmtrhgfd.", '{"passwd":"aB3$xy9","client_secret":"zzkqwrtpxvbn"}', f"Authorization Bearer {jwt} end", "the token: required here", "no candidates at all"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", F.explode(candidates(F.col("text"), F.lit(""), forest.transitions)).alias("c")).select("i", "c.value", (forest.score(F.col("c")) >= 0.5).alias("secret")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.i, []).append((r.value, r.secret))
    assert got[0] == [("h7!kP2q", True)]
    assert got[1] == [("qzjxkvwplmtrhgfd", True)]
    assert [v for v, _ in got[2]] == ["aB3$xy9", "zzkqwrtpxvbn"]
    assert got[3] == [(jwt, True)]
    assert got[4] == [("required", False)]
    assert 5 not in got


def test_column_equals_the_model(spark, forest):
    other = labelled_findings(spark.read.parquet(f"{SF}/documents.parquet"), most=6)
    rows = other.select(F.explode(candidates(F.col("text"), F.col("path"), forest.transitions)).alias("c")).select("c.*", forest.score(F.col("c")).alias("score")).collect()
    assert len(rows) > 100
    for r in rows:
        x = Vectors.dense([r[n] for n in FEATURES])
        assert abs(r.score - sum(t.predict(x) for t in forest.model.trees) / len(forest.model.trees)) < 1e-9


@pytest.mark.parametrize("kinds", [(0, 6), (2, 4), (14,), (15,)])
def test_kinds_left_out(spark, kinds):
    findings = labelled_findings(spark.read.parquet(f"{SF}/documents.parquet"), most=100)
    out = F.col("kind").isin(list(kinds))
    own = train(findings.filter(~out))
    rows = findings.filter(out).select("value", "label", F.explode(candidates(F.col("text"), F.col("path"), own.transitions)).alias("c")).filter("c.value = value").select("label", (own.score(F.col("c")) >= 0.5).cast("int").alias("got")).collect()
    share = sum(r.label == r.got for r in rows) / len(rows)
    print("left out", kinds, len(rows), share)
    assert len(rows) == 100 * len(kinds) and share > 0.5


def test_redacts_only_values_that_stand_alone(spark, forest):
    df = spark.createDataFrame([(1, 'password = "h7!kP2q" and again h7!kP2q, not xh7!kP2qy', "")], "doc_id int, text string, source string")
    (got,) = redact(df, forest, mark="<$1>").collect()
    assert got.text == 'password = "<$1>" and again <$1>, not xh7!kP2qy'
