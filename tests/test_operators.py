"""Concepts, retrieval, scoring, evaluation, texts, ingest, sinks and streaming on small fixtures."""

import itertools
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sievemill.operators import atoms as A
from sievemill.operators import evaluation as E
from sievemill.operators import retrieval as T
from sievemill.operators import scoring as Q
from sievemill.operators import texts as X
from sievemill.sources import ingest as I
from sievemill.sources import sinks as K
from sievemill.streaming.incremental import first_seen_sink, progress_windows


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


# ---- concepts
def test_boundaries_and_variants(spark):
    p = A.atom_pattern(["deep learning"])
    assert [bool(re.search(p, t)) for t in ("deep learning-based", "xdeep learning", "deep-learning", "deep learnings")] == [True, False, True, False]
    assert "large language model" in A.variants("large language models") and "language models" in A.variants("large language models")


CONTRACT = A.Contract((A.Atom("a", ("alpha",), "P", required=True), A.Atom("b", ("beta",), "I", technical=True), A.Atom("c", ("gamma",), "O")), min_technical=1, window=10)


def windows_by_hand(title, abstract, contract):
    low = (abstract or "").lower()
    hits = sorted((m.start(), a.name) for a in contract.atoms for m in re.finditer(A.atom_pattern(a.terms), low))
    best = []
    for at, _ in hits:
        names = []
        for p, n in hits:
            if at <= p <= at + contract.window and n not in names:
                names.append(n)
        if len(names) > len(best):
            best = names
    head = [a.name for a in contract.atoms if re.search(A.atom_pattern(a.terms), (title or "").lower())]
    return {*head, *best}


def test_cooccurrence_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "gamma", "x"]), " ".join(rng.choice(["alpha", "beta", "gamma", "filler", "word"]) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, title string, abstract string")
    got = {r.i: set(r.m) for r in df.select("i", A.cooccurring_atoms(F.col("title"), F.col("abstract"), CONTRACT).alias("m")).collect()}
    for i, t, a in rows:
        short = len(a) <= CONTRACT.window
        want = windows_by_hand(t, a, A.Contract(CONTRACT.atoms, window=10_000) if short else CONTRACT)
        assert got[i] == want, (t, a)


def test_concept_filter(spark):
    df = spark.createDataFrame([(1, "alpha beta", ""), (2, "alpha", None), (3, None, None), (4, "alpha beta gamma", "")], "ord int, title string, abstract string")
    got = {r.ord: (r.passed, sorted(r.missing), r.bonus) for r in A.concept_filter(df, CONTRACT).collect()}
    assert got == {1: (True, [], 0.5), 2: (False, ["b"], 0.0), 3: (False, ["a", "b"], 0.0), 4: (True, [], 1.0)}
    fails = {r.atom: r.failures for r in A.atom_failures(A.concept_filter(df, CONTRACT)).collect()}
    assert fails == {"a": 1, "b": 2}


# ---- retrieval
def test_tokens(spark):
    assert one(spark, "Randomised-Controlled trial, a é-1 -x- État", "string", T.tokens) == ["randomised", "controlled", "randomisedcontrolled", "trial", "e1", "etat"]


def test_bm25_by_hand(spark):
    docs = {1: "apple banana apple", 2: "banana cherry", 3: "cherry date egg", 4: None}
    df = spark.createDataFrame(list(docs.items()), "doc_id int, text string")
    counts = T.term_counts(df, "doc_id", F.col("text"))
    freq = T.document_frequencies(counts)
    q = spark.createDataFrame([(1, ["apple", "banana", "apple"])], "query_id int, terms array<string>")
    got = {r.doc: r.score for r in T.bm25(counts, freq, freq.where("false").select("term", "df"), q).collect()}
    n, avg = 3, 8 / 3
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in {"apple": 1, "banana": 2, "cherry": 2, "date": 1, "egg": 1}.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if w < 0 else w for t, w in idf.items()}

    def part(t, tf, dl):
        return idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))

    assert got == {1: pytest.approx(2 * part("apple", 2, 3) + part("banana", 1, 3)), 2: pytest.approx(part("banana", 1, 2))}


def test_rank_fusion(spark):
    rows = [(i, float(i % 5), float(-i)) for i in range(40)]
    df = spark.createDataFrame(rows, "ord long, a double, b double")
    ra = {o: r + 1 for r, (o, _, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    rb = {o: r + 1 for r, (o, _, _) in enumerate(sorted(rows, key=lambda x: (-x[2], x[0])))}
    raw = {o: 0.6 / (60 + ra[o]) + 0.4 / (60 + rb[o]) for o, _, _ in rows}
    lo, hi = min(raw.values()), max(raw.values())
    got = {r.ord: r.fused for r in T.fuse_ranks(df, "a", "b").collect()}
    assert got == {o: pytest.approx((v - lo) / (hi - lo)) for o, v in raw.items()}
    assert T.fuse_ranks(df.limit(1), "a", "b").first().fused == 0.5


def test_gate_and_category(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "x" * 200), (2, [0.0, 1.0], "x" * 200), (3, [0.0, 1.0], "short"), (4, [0.0, 0.0], "x" * 200)], "vec_id long, embedding array<float>, text string")
    got = {r.vec_id: (r.similarity, r.passed) for r in T.cosine_gate(df, [1.0, 0.0], F.col("text"), 0.0).collect()}
    assert got == {1: (1.0, True), 2: (0.0, True), 3: (1.0, True), 4: (0.0, True)}
    centres = spark.createDataFrame([(7, [1.0, 0.0]), (5, [0.0, 1.0])], "category int, centre array<float>")
    assert {r.vec_id: r.category for r in T.assign_category(df, centres).collect()} == {1: 7, 2: 5, 3: 5, 4: None}


# ---- scores
def test_thresholds_and_zones(spark):
    df = spark.createDataFrame([(i, i / 10, 0.5 if i == 0 else 0.0) for i in range(11)], "ord int, similarity double, domain_relevance double")
    assert Q.adaptive_threshold(df, "similarity", 3).first().threshold == 0.8
    assert Q.adaptive_threshold(df, "similarity", 50).first().threshold == 0.4
    t = Q.dual_thresholds(df, "similarity").first()
    assert (t.floor, t.auto_include) == (0.05, 0.5)
    got = {r.ord: r.status for r in Q.three_zones(df, Q.dual_thresholds(df, "similarity")).collect()}
    assert got[0] == "grey_zone" and got[1] == "grey_zone" and got[5] == "auto_include"
    same = spark.createDataFrame([(1, 3.0), (2, 3.0)], "i int, x double")
    assert {r.scaled for r in Q.robust_scale(same, "x").collect()} == {0.5}


def test_verdicts_and_votes(spark):
    yes = {c: "YES" for c in Q.CRITERIA}
    answers = [
        (1, json.dumps(yes | {"decision": "INCLUDE"})), (2, "```json\n" + json.dumps(yes) + "\n``` ok"), (3, json.dumps(yes | {"outcome": "no"})), (4, "nothing"), (5, None), (6, json.dumps(yes | {"decision": "EXCLUDE"})),
    ]
    got = {r.i: (r.decision, r.passed, r.near_miss, r.score) for r in Q.parse_verdict(spark.createDataFrame(answers, "i int, response string")).collect()}
    assert got == {
        1: ("INCLUDE", True, False, 1.0), 2: ("INCLUDE", True, False, 1.0), 3: ("EXCLUDE", False, True, 0.8333), 4: ("EXCLUDE", False, False, 0.0), 5: ("EXCLUDE", False, False, 0.0), 6: ("EXCLUDE", False, True, 1.0),
    }
    votes = [(1, True, 8.0), (1, True, 6.0), (1, False, 1.0), (2, True, 5.0), (2, False, 5.0), (3, False, 2.0), (4, None, None)]
    out = {r.a: (r.passed, r.score) for r in Q.majority(spark.createDataFrame(votes, "a int, vote boolean, score double"), "a").collect()}
    assert out == {1: (True, 5.0), 2: (False, 5.0), 3: (False, 2.0), 4: (True, 5.0)}


# ---- evaluation
def test_confusion_guards(spark):
    df = spark.createDataFrame([(True, False), (False, False)], "truth boolean, said boolean")
    r = E.confusion(df).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.precision, r.recall, r.f1, r.accuracy) == (0, 0, 1, 1, 0.0, 0.0, 0.0, 0.5)
    assert E.confusion(df.limit(0)).first().accuracy == 0.0


def test_ranked_metrics_and_work_saved(spark):
    ranked = spark.createDataFrame([(1, "Alpha", "z"), (2, "x", "beta here"), (3, "noise", "z"), (4, None, None)], "rank long, title string, abstract string")
    rows = {r.cutoff: r for r in E.ranked_list_metrics(ranked, ["alpha", "beta", "omega"], ["noise"], (1, 2, 10)).collect()}
    assert rows[1].found == 1 and rows[2].found == 2 and rows[10].precision == 0.5 and rows[10].noise == 0.25 and rows[2].title_hits == 1
    assert E.work_saved(ranked, ["alpha", "beta"]).first().rank == 2
    assert E.work_saved(ranked, ["alpha", "omega"]).first().rank is None


def test_head_tail(spark):
    df = spark.createDataFrame([(x,) for x in "aaabbcd"], "l string")
    assert {r.label: (r.n, r.pct) for r in E.head_and_tail(df, F.col("l"), 2).collect()} == {"a": (3, 42.9), "b": (2, 28.6), "otros": (2, 28.6)}


# ---- texts
def chunks_by_hand(text, most=1200, step=1000):
    done, open_ = [], ""
    for p in [p.strip(" ") for p in re.split(r"\n\n+", text or "")]:
        if not p:
            continue
        joined = f"{open_}\n\n{p}" if open_ else p
        if len(p) > most:
            done += [open_] if open_ else []
            done += [p[i : i + most] for i in range(0, len(p), step)]
            open_ = ""
        elif len(joined) < most:
            open_ = joined
        else:
            done += [open_] if open_ else []
            open_ = p
    return done + ([open_] if open_ else [])


def test_paragraph_chunks(spark):
    rng = random.Random(2)
    texts = ["\n\n".join("x" * rng.choice([10, 500, 1190, 1200, 1201, 2500]) for _ in range(rng.randint(1, 6))) for _ in range(25)] + ["", None]
    for t in texts:
        assert one(spark, t, "string", X.paragraph_chunks) == chunks_by_hand(t)
    assert len(one(spark, "x" * 60_000, "string", lambda c: X.paragraph_chunks(c, limit=40))) == 40


def test_ordered_text_sections_citations(spark):
    rows = [(1, 0, "a" * 150), (1, 1, "b" * 150), (1, 3, "late"), (2, 1, "no start" * 50), (3, 0, "short"), (1, 1, "b" * 150)]
    got = X.ordered_text(spark.createDataFrame(rows, "k int, p int, t string"), "k", "p", "t").collect()
    assert [(r.k, r.pieces) for r in got] == [(1, 2)]
    text = "Introduction\nsome words\n\nMethods\nhow\n\nConclusions\nend " + "z" * 50 + "\nReferences\n[1] x"
    s = X.sections(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert "[1] x" not in s.body and s.methods.startswith("Methods") and s.introduction.startswith("Introduction") and s.conclusions.startswith("Conclusions")
    bad = one(spark, "As Smith (2020) and Jones et al. (2019) say", "string", lambda c: X.unknown_citations(c, F.array(F.lit("Smith"))))
    assert bad == ["Jones"]


# ---- ingest
def test_delimited_files(spark, tmp_path):
    f = tmp_path / "gold.csv"
    f.write_text("Título;Resumen;Año;Autores;Manual inclusion\nFirst;text;2020;A. B; yes\n;no title;2021;;0\n\"Second; part\";;x;C and D;maybe\n", encoding="latin-1")
    rows = I.read_delimited(spark, str(f)).orderBy("row_id").collect()
    assert [(r.row_id, r.title, r._gold_label) for r in rows] == [("csv-1", "First", 1), ("csv-3", "Second; part", None)]
    assert rows[1].authors == ["C", "D"]
    assert "_gold_label" not in I.without_private(I.read_delimited(spark, str(f))).columns
    assert {r.field: r.filled for r in I.profile(I.read_delimited(spark, str(f)), ["title", "abstract"]).collect()} == {"title": 2, "abstract": 1}


def test_provider_shapes(spark):
    assert one(spark, "Smith, AB, Jones, C, Long Name, DE.", "string", I.paired_authors) == ["Smith, AB", "Jones, C", "Long Name, DE"]
    assert one(spark, "the cat and the dog", "string", lambda c: I.rebuilt_abstract(I.inverted_index(c))) == "the cat and the dog"
    rows = [("p", 1, "b", "q1", "A long title for the paper", "x" * 150, None, 3), ("p", 2, "a", "q2", "A long title for the paper", "y", None, 9), ("n", 3, "a", "q", "README.md of it", "x" * 150, None, 0), ("t", 4, "a", "q", "thin", "x", None, 0)]
    got = I.merge_payload(spark.createDataFrame(rows, "paper_id string, ord long, mode string, query string, title string, abstract string, doi string, citations int")).collect()
    assert [(r.paper_id, r.ord, r.modes, r.queries, r.citations) for r in got] == [("p", 1, "a+b", ["q1", "q2"], 9)]


def test_graph_and_fan_in(spark):
    edges = spark.createDataFrame([(1, 5), (1, 6), (7, 1), (1, 2), (2, 8)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (2,)], "seed long")
    assert [r.node for r in I.expand_graph(seeds, edges, 10, 10).collect()] == [5, 6, 7, 8]
    both = I.fan_in([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x",)], "b string")])
    assert sorted(both.columns) == ["a", "b"] and both.count() == 2


def test_landed_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"paper_id": "a", "citations": 3}\nnot json\n')
    rows = I.read_landed_json(spark, str(tmp_path / "x.json"), "paper_id string, citations int").cache().collect()
    assert sorted((r.paper_id is None, r._corrupt is None) for r in rows) == [(False, True), (True, False)]


# ---- sinks
def test_upsert_quality(spark):
    kind = "article int, chunk_no int, full boolean, text string"
    stored = spark.createDataFrame([(1, 0, False, "abs"), (2, 0, True, "full"), (3, 0, False, "abs")], kind)
    fresh = spark.createDataFrame([(1, 0, True, "new full"), (2, 0, False, "new abs"), (3, 0, False, "other"), (4, 0, False, "first")], kind)
    out = K.upsert_chunks(stored, fresh)
    assert {r.article: r.text for r in out.collect()} == {1: "new full", 2: "full", 3: "abs", 4: "first"}
    again = K.upsert_chunks(out, fresh)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("t", ["a", "b"], None, "s1"), ("u", None, 2020, "s2")], "title string, authors array<string>, year int, stage string")
    K.write_export(df, str(tmp_path / "e"))
    rows = spark.read.csv(str(tmp_path / "e"), header=True).fillna("").collect()
    assert sorted((r.title, r.authors, r.year) for r in rows) == [("t", "a, b", ""), ("u", "", "2020")]
    K.write_audit(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).where("stage = 's1'").count() == 1
    K.append_log(df, str(tmp_path / "l"))
    K.append_log(df, str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 4


# ---- streaming
def test_stream_equals_table(spark, tmp_path):
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=7 * i), "click" if i % 3 else "view", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = progress_windows(stream, late="30 days").writeStream.outputMode("complete").format("memory").queryName("progress").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from progress").collect())) == sorted(map(tuple, progress_windows(df).collect()))


def test_first_seen_sink(spark, tmp_path):
    write = first_seen_sink(spark, str(tmp_path / "t"), ["k"])
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    write(a, 0)
    write(spark.createDataFrame([(2, "late"), (3, "new")], "k int, v string"), 1)
    write(spark.createDataFrame([(2, "late"), (3, "new")], "k int, v string"), 1)  # replayed
    got = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "t"))
    assert sorted(r.k for r in got.collect()) == [1, 2, 3]


def test_entry_registers_consistent_names():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and {"p3_found", "p5_found", "p6_found", "screening_run"} <= set(q)
    assert not [n for n in q if re.match(r"p\d+$", n)]


__all__ = ["itertools"]
