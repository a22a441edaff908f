"""Query building, connectors, lineage helpers and the driver contract."""

import json
import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from sievemill.operators import query_building as B
from sievemill.runtime import cut, stored

BUCKETS = B.Buckets({"P": ("young adults", "teachers"), "I": ("peer support in schools", "coaching"), "O": ("sleep",), "C": ("usual care",)}, generic=("care", "in"))


def profile(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, q string")
    return {r.i: (r.tier, r.rejection) for r in B.profile_queries(df, "q", BUCKETS).collect()}


def test_query_profiles(spark):
    got = profile(spark, ["coaching of teachers", "coaching teachers sleep usual care", "coaching teachers sleep", "teachers sleep", "coaching", None, "peer support schools young adults", "young coaching care"])
    assert got == {
        0: ("core", None), 1: ("exact", None), 2: ("focused", None), 3: ("other", "missing_intervention"), 4: ("other", "too_short"), 5: ("other", "too_short"), 6: ("core", None), 7: ("other", "missing_population"),
    }


def test_generic_queries_and_keys(spark):
    df = spark.createDataFrame([("accuracy and F1",), ("precision recall",), ("b a B",), (None,)], "q string")
    got = [tuple(r) for r in df.select(B.generic_query(F.col("q")), B.token_key(F.col("q"))).collect()]
    assert got == [(False, "accuracy and f1"), (True, "precision recall"), (True, ""), (True, "")]


def test_quota_and_fill(spark):
    rows = [(i, t) for i, t in enumerate(["core"] * 5 + ["exact"] * 3 + ["other"] * 2)]
    got = [(r.i, r.filled) for r in B.quota_and_fill(spark.createDataFrame(rows, "i int, tier string"), {"exact": 1, "core": 2}, 6, "i").collect()]
    assert got == [(5, False), (0, False), (1, False), (6, True), (7, True), (2, True)]


def test_translation(spark):
    df = spark.createDataFrame([([["heart failure", "hf"], ["app"], []],)], "t array<array<string>>")
    r = df.select(B.translate_query(F.col("t"), "pubmed").alias("a"), B.translate_query(F.col("t"), "epmc").alias("b"), B.translate_query(F.col("t"), "plain").alias("c")).first()
    assert r.a == '("heart failure"[tiab] OR hf[tiab]) AND app[tiab]' and r.b == '("heart failure" OR hf) AND app' and r.c == "heart failure app"


def test_terms_learnt_from_a_corpus(spark):
    observed = spark.createDataFrame([("remote care", 1), ("care", 2), ("abc", 3), ("X2-Y9", 4), ("remote data", 5)], "term string, pos int")
    atoms = spark.createDataFrame([("a", "remote care"), ("b", "x 2 things")], "atom string, text string")
    mapped = B.map_terms(observed, atoms)
    assert {(r.atom, r.term) for r in mapped.collect()} == {("a", "remote care"), ("a", "care"), ("a", "remote data")}
    extra = mapped.unionByName(spark.createDataFrame([("b", "X2-Y9", 4), ("b", "abc", 3), ("b", "unseen words", 9)], "atom string, term string, pos int"))
    got = {(r.atom, r.term): r.decision for r in B.judge_terms(extra, observed, ("data",)).collect()}
    assert got == {("a", "remote care"): "accepted", ("a", "care"): "low_specificity", ("a", "remote data"): "accepted", ("b", "X2-Y9"): "accepted", ("b", "abc"): "low_signal", ("b", "unseen words"): "not_observed"}


def test_exclusion_criteria():
    year, terms = B.parse_exclusions("Artículos anteriores a 2015\nbefore 2018\nbefore 1850\nExcluir 'animal models', letters\nArtículos que contengan pediatric\n")
    assert year == 2018 and terms == ["animal models", "pediatric"]
    assert B.parse_exclusions("") == (None, [])


def test_balanced_categories(spark):
    df = spark.createDataFrame([("a",)] * 5 + [(None,)], "category string")
    got = {r.category: (r.n, r.moved) for r in B.balanced_categories(df, ["a", "b", "c"], 3).collect()}
    assert got == {"a": (3, -2), "b": (1, 1), "c": (1, 1)}


def test_landed_pages(spark, tmp_path):
    from sievemill.sources.connectors import PROFILES, LandedPages

    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps({"query": "q", "page": k, "records": [{"id": i} for i in range(k)]}))
    spark.dataSource.register(LandedPages)
    rows = spark.read.format("landed_pages").load(path=str(tmp_path)).collect()
    assert sorted((r.page, r.position) for r in rows) == [(1, 0), (2, 0), (2, 1)]
    assert [p.name for p in PROFILES if not p.enabled] == ["open_catalogue"]


def test_lineage_is_cut(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    for f in (cut, stored):
        out = f(df)
        assert out.count() == 100 and "Range" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_the_core_stands_without_the_optional_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and not any(k[0] == 'p' and k[1].isdigit() for k in q) and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
