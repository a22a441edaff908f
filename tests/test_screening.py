"""Filters, deduplication, joins and column functions against hand-made cases and brute force."""

import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.operators import screening as S


def col(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_identifiers(spark):
    got = col(spark, ["https://doi.org/10.1/AB/", "doi: 10.2/x", "10.3/Y", "Sin DOI", None, "11.4/z", "HTTPS://dx.doi.org/10.5/Q"], "string", C.normal_doi)
    assert got == ["10.1/ab", "10.2/x", "10.3/y", None, None, None, "10.5/q"]
    assert col(spark, ["10.1", "Sin DOI 2020", "10.1234/x", None], "string", C.valid_doi) == [False, False, True, False]
    assert col(spark, ["http://a.b/10.1234/xy?z=1", "none", None], "string", C.doi_in_url) == ["10.1234/xy", None, None]


def test_languages(spark):
    assert col(spark, ["en-US", "pt_BR", "Spanish", "xx", "unknown", "", None, "DEU"], "string", C.language_code) == ["en", "pt", "es", "xx", None, None, None, "de"]
    texts = ["the study and the results with children", "los estudios con niños para una educación", "study", "que para entre", None, "das ist ein Satz"]
    got = col(spark, texts, "string", lambda v: C.inferred_language(v, F.lit(None).cast("string")))
    assert got == ["en", "es", "und", "und", "und", "und"]


def test_years_sizes_types(spark):
    assert col(spark, ["2020a", "20", None, "1999-01-01"], "string", C.year_of) == [2020, None, None, 1999]
    assert col(spark, ["N = 120 people", "we saw 45 participants", "sample of 9", "none", None], "string", C.sample_size) == [120, 45, 9, None, None]
    assert col(spark, ["a randomized trial", "cohort data", "essay", None], "string", C.study_type) == ["estudio experimental", "estudio observacional", None, None]
    assert col(spark, [2025, 2023, 2020, 2013, 1990], "int", lambda y: C.citations_asked(y, 2025)) == [0, 1, 3, 5, 5]


def test_citations_and_keys(spark):
    rows = [(["Touzov, N."], 2020), (["A. Smith", "B. Jones"], 2019), (["X, Y.", "Z, W.", "V, U."], None), ([], 2000), (None, 2001)]
    df = spark.createDataFrame([(i, a, y) for i, (a, y) in enumerate(rows)], "i int, a array<string>, y int")
    got = [r[0] for r in df.orderBy("i").select(C.narrative_citation(F.col("a"), F.col("y"))).collect()]
    assert got == ["Touzov (2020)", "Smith y Jones (2019)", "X et al. (s.f.)", "Autor desconocido (2000)", "Autor desconocido (2001)"]
    keys = [r[0] for r in df.orderBy("i").select(C.bibtex_key(F.col("a"), F.col("y"), F.lit("The Great Study"))).collect()]
    assert keys[0] == "touzov2020great" and len(keys[4]) == 32


def test_fuzzy_relevance(spark):
    cases = [(0.0, 0.0, 0.0), (1.0, 1.0, 0.2), (0.5, 0.4, 0.1), (0.0, 1.0, 0.0), (None, None, None), (float("nan"), 0.5, 0.1)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s double, d double, k double")
    got = [r[0] for r in df.orderBy("i").select(C.fuzzy_relevance(F.col("s"), F.col("d"), F.col("k"))).collect()]
    assert got[0] == pytest.approx(0.08) and got[1] == pytest.approx((0.92 + 0.78) / 2) and got[3] == pytest.approx(0.30) and got[4] == pytest.approx(0.08)
    assert all(0 <= x <= 1 for x in got)


ART = "ord long, title string, abstract string, doi string, year int, journal string, venue string, url string, pdf_url string, open_access boolean, language string, source string, citations int"


def art(ord_, **kw):
    base = {"title": "A long enough title here", "abstract": "x" * 120, "doi": None, "year": 2015, "journal": "J", "venue": None, "url": None, "pdf_url": None, "open_access": True, "language": "en", "source": "s", "citations": 0} | kw
    return (ord_, *(base[k.split()[0]] for k in ART.split(", ")[1:]))


def test_metadata_filter_and_reasons(spark):
    rows = [art(1), art(2, year=0), art(3, year=None), art(4, open_access=None), art(5, open_access=False, pdf_url="http://long.example"), art(6, language="es"), art(7, journal=" ", venue="bioRxiv"), art(8, year=2030), art(9, language=None)]
    df = spark.createDataFrame(rows, ART)
    f = S.MetadataFilter(start_year=2010, end_year=2020, open_access=True, language="en", academic_only=True)
    assert sorted(r.ord for r in S.filter_metadata(df, f).collect()) == [1, 5]
    reasons = {r.ord: r.reason for r in S.exclusion_reason(df, f).collect()}
    assert reasons == {1: None, 2: "academic", 3: "academic", 4: "open_access", 5: None, 6: "language", 7: "academic", 8: "year", 9: "language"}
    assert S.filter_metadata(df, S.MetadataFilter(end_year=2020)).where("ord in (2, 3)").count() == 2
    assert S.filter_metadata(df, S.MetadataFilter(journals=("  j ",))).count() == 8


def test_hard_filter_order(spark):
    rows = [art(1, abstract=""), art(2, abstract="", doi="10.1234/x"), art(3, abstract="short", title="tiny"), art(4, year=1990), art(5, title="A systematic review of it"), art(6, abstract="", title="x", year=1990), art(7)]
    got = {r.ord: (r.reason, r.abstract_substituted) for r in S.hard_filter(spark.createDataFrame(rows, ART), S.HardFilter(min_year=2000, exclude_reviews=True)).collect()}
    assert got == {1: ("sin_abstract", False), 2: (None, True), 3: ("abstract_corto", False), 4: ("fuera_de_rango_temporal", False), 5: ("es_review_survey", False), 6: ("sin_abstract", False), 7: (None, False)}


def test_exact_dedup(spark):
    rows = [art(1, doi="10.1/AAAA"), art(2, doi="10.1/aaaa"), art(3, doi="10.1/AAAA"), art(4), art(5), art(6, year=2016), art(7, doi="10.1"), art(8, title=""), art(9, title=""), art(10, title=None, doi="Sin DOI 00")]
    got = {r.ord: r.dup_reason for r in S.exact_dedup(spark.createDataFrame(rows, ART)).collect()}
    assert [o for o, r in sorted(got.items()) if r] == [3, 5, 7]
    assert got[3].endswith("(DOI)") and got[5].endswith("(Título + Año)")


def sequential(rows, threshold):
    """The first-come rule as it reads."""
    import re

    def tokens(t):
        flat = "".join(c for c in unicodedata.normalize("NFKD", (t or "").lower()) if not unicodedata.combining(c))
        return {w for w in re.findall("[a-z0-9]+", flat) if len(w) > 1 and w not in C.TITLE_STOPWORDS}

    seen, kept, out = set(), [], {}
    for o, doi, title in rows:
        t = tokens(title)
        if doi:
            out[o] = doi not in seen
            seen.add(doi)
            if out[o]:
                kept.append(t)
            continue
        hit = any(t and k and len(t & k) / len(t | k) >= threshold for k in kept)
        out[o] = not hit
        if not hit:
            kept.append(t)
    return out


def test_greedy_title_dedup_is_not_a_closure(spark):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen"
    b = a + " fourteen"
    c = b + " fifteen"
    rows = [(1, None, a), (2, None, b), (3, None, c), (4, "10.1/x", "fresh words only here now"), (5, None, "fresh words only here now"), (6, "10.1/y", "fresh words only here now"), (7, "10.1/x", "other"), (8, None, ""), (9, None, None)]
    got = {r.ord: r.keep for r in S.title_dedup(spark.createDataFrame(rows, "ord long, doi string, title string"), 0.92).collect()}
    assert got == sequential(rows, 0.92)
    assert got[1] and not got[2] and got[3]  # the middle of a chain goes, its end stays


def test_greedy_title_dedup_matches_the_sequential_rule(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(14)]
    rows = []
    for o in range(220):
        base = rng.sample(words, 8) if rng.random() < 0.5 or not rows else (rng.choice(rows)[2] or "").split()
        t = list(base)
        if t and rng.random() < 0.4:
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((o, f"10.1/{rng.randrange(40)}" if rng.random() < 0.3 else None, " ".join(t)))
    got = {r.ord: r.keep for r in S.title_dedup(spark.createDataFrame(rows, "ord long, doi string, title string"), 0.75).collect()}
    assert got == sequential(rows, 0.75)


def test_phase_merge(spark):
    rows = [(1, "10.1/a", "x one two", "seed"), (2, "10.1/A", "x one two", "enriched"), (3, "10.1/b", "y three four", "seed"), (4, None, "z five six", "enriched")]
    got = {r.ord: r.phase for r in S.merge_phases(spark.createDataFrame(rows, "ord long, doi string, title string, phase string")).collect()}
    assert got == {1: "both", 3: "seed", 4: "enriched"}


def test_similar_vectors_recall(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 32))
    near = base + rng.normal(size=base.shape) * 0.25
    x = np.concatenate((base, near))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.a, r.b) for r in S.similar_vectors(df, 0.85).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if n[i] @ n[j] > 0.85 + 1e-6}
    assert got <= {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if n[i] @ n[j] > 0.85 - 1e-6}
    assert len(got & want) >= 0.95 * len(want)


def test_sentence_and_paragraph_dedup(spark):
    df = spark.createDataFrame([(1, "One here. Two there. One here! One here.", "p"), (2, None, "p"), (3, "", "p")], "id long, t string, text string")
    got = {r.id: (r.text, r.sentences, r.dropped) for r in S.sentence_dedup(df, "id", "t").collect()}
    assert got[1] == ("One here. Two there. One here!", 3, 1) and got[2] == ("", 0, 0)
    p = "a b c d e f g h i j k l\n\na b c d e f g h other words\n\nshort\n\nshort"
    out = S.paragraph_dedup(spark.createDataFrame([(1, p)], "id long, t string"), "id", "t").first()
    assert (out.paragraphs, out.dropped) == (3, 1)


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", "t"), (2, None, "u"), (3, "b", None)], "left_id long, d string, t string")
    right = spark.createDataFrame([(10, "a", "t"), (11, "z", "u"), (12, None, None)], "right_id long, d string, t string")
    assert sorted(tuple(r) for r in S.match_any_key(left, right, [("d", "d"), ("t", "t")]).collect()) == [(1, 10), (2, 11)]
    target = spark.createDataFrame([(1, "old"), (2, "kept"), (3, None)], "k long, v string")
    source = spark.createDataFrame([(1, "new"), (2, " "), (3, "x")], "k long, v string")
    got = {r.k: (r.v, r.changed) for r in S.coalesce_update(target, source, "k", ["v"]).collect()}
    assert got == {1: ("new", True), 2: ("kept", False), 3: ("x", True)}


def test_camel_case_and_citation_echo(spark):
    assert col(spark, ["CodeBERTModel", "HTTPServer2Go", "plain", None], "string", C.camel_split) == [["code", "bert", "model"], ["http", "server2", "go"], ["plain"], []]
    got = col(spark, ["As Smith (2020) found, Smith (2020) agrees.", "Smith (2020). Smith (2020).", None], "string", C.without_citation_echo)
    assert got == ["As Smith (2020) found agrees.", "Smith (2020). Smith (2020).", ""]


def test_greedy_survivors_decide_long_chains(spark):
    n = 106
    nodes = spark.createDataFrame([(i, False) for i in range(n)], "ord long, fixed boolean")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    assert {r.ord: r.keep for r in S.greedy_survivors(nodes, pairs).collect()} == {i: i % 2 == 0 for i in range(n)}


def shuffled(spark, act) -> tuple[list, int]:
    """The rows of a result and the bytes that were written to shuffles for it."""
    sc = spark.sparkContext._jsc.sc()

    def written() -> int:
        sc.listenerBus().waitUntilEmpty(60_000)
        held = sc.statusStore().executorList(False)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))

    before = written()
    rows = act().collect()
    return rows, written() - before


def few_words(n: int, seed: int) -> list[list[str]]:
    """Titles of fourteen words out of fifty, every tenth with one word of its predecessor changed."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(50)]
    out: list[list[str]] = []
    for i in range(n):
        if i % 10 == 9:
            left = [w for w in words if w not in out[-1]]
            out.append([*out[-1][1:], rng.choice(left)])
        else:
            out.append(rng.sample(words, 14))
    return out


def test_title_dedup_makes_no_list_of_loose_candidates(spark):
    titles = few_words(4000, 3)
    keys = [None if i % 3 else f"10.1/{i}" for i in range(4000)]
    df = spark.createDataFrame([(i, k, " ".join(x)) for i, (k, x) in enumerate(zip(keys, titles))], "ord long, doi string, title string").repartition(4)
    rows, written = shuffled(spark, lambda: S.title_dedup(df))
    assert {r.ord: r.keep for r in rows} == {i: keys[i] is not None or i % 10 != 9 for i in range(4000)}
    assert written < 1_600_000


def test_a_row_with_identifier_decides_for_a_title_whose_first_row_was_dropped(spark):
    z = [f"w{i}" for i in range(14)]
    x = [*z[1:], "x1"]
    y = [*x[:12], "y1", "x1"]
    rows = [(1, None, " ".join(z)), (2, None, " ".join(x)), (3, "10.1/held", " ".join(x)), (4, None, " ".join(y))]
    got = {r.ord: r.keep for r in S.title_dedup(spark.createDataFrame(rows, "ord long, doi string, title string")).collect()}
    assert got == sequential(rows, 0.85) == {1: True, 2: False, 3: True, 4: False}


@pytest.mark.parametrize("t", [0.3, 0.6, 0.85])
def test_similar_titles_of_any_size(spark, t):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    sets = []
    for n in [1, 2, 3, 4, 5, 6, 7, 9, 12, 13, 14, 20, 26, 33, 47, 80, 210, 260]:
        base = rng.sample(words, n)
        for cut_, more in [(0, 0), (0, 1), (1, 0), (1, 1), (n // 8, n // 9), (n // 3, 0)]:
            sets.append([*base[cut_:], *(f"n{rng.randrange(60)}" for _ in range(more))])
    sets = [sorted(set(s)) for s in sets if s]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    reps = {i: set(s) for s, i in first.items()}
    want = {(a, b): len(reps[a] & reps[b]) / len(reps[a] | reps[b]) for a, b in itertools.combinations(sorted(reps), 2)}
    want = {k: v for k, v in want.items() if v >= t}
    got = S.similar_titles(spark.createDataFrame(list(enumerate(sets)), "ord long, tokens array<string>"), t).collect()
    assert {(r.a, r.b): r.sim for r in got} == want and len(got) == len(want)


def test_title_links_make_no_list_of_loose_candidates(spark, tmp_path):
    import __spark_entry__

    rows = [(i, " ".join(x)) for i, x in enumerate(few_words(6000, 3))] + [(i, "one same title again and again") for i in range(6000, 8000)]
    spark.createDataFrame(rows, "record_id long, title string").withColumn("retrieval_phase", F.lit("seed")).repartition(4).write.parquet(f"{tmp_path}/article_records.parquet")
    got, written = shuffled(spark, lambda: __spark_entry__.queries()["title_jaccard_links"](spark, str(tmp_path)))
    want = {i: (1, 0.866667) for i in range(6000) if i % 10 == 9} | {i: (i - 6000, 1.0) for i in range(6001, 8000)}
    assert {r.ord: (r.earlier, r.best) for r in got} == want
    assert written < 1_200_000


def test_merge_phases_makes_no_list_of_loose_candidates(spark):
    rows = [(i, None if i % 3 else f"10.1/{i}", "seed", " ".join(x)) for i, x in enumerate(few_words(2000, 3))]
    df = spark.createDataFrame(rows, "ord long, doi string, phase string, title string").repartition(4)
    got, written = shuffled(spark, lambda: S.merge_phases(df))
    assert {r.ord: r.phase for r in got} == {i: "seed" for i in range(2000) if i % 3 == 0 or i % 10 != 9}
    assert written < 700_000


def variants(n: int, groups: int, seed: int) -> list[tuple]:
    """Rows (ord, doi, phase, title) of which many are alike: of a group's words one or two are changed, some titles recur."""
    rng = random.Random(seed)
    bases = [[f"g{g}w{i}" for i in range(14)] for g in range(groups)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            words[rng.randrange(2)] = f"v{rng.randrange(12)}"
        rows.append((i, rng.choice([None, None, None, f"10.1/{rng.randrange(n)}"]), rng.choice(["seed", "enriched"]), " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_title_dedup_of_many_variants(spark, seed):
    rows = [(i, doi, title) for i, doi, _, title in variants(700, 6, seed)]
    got = S.title_dedup(spark.createDataFrame(rows, "ord long, doi string, title string")).collect()
    assert {r.ord: r.keep for r in got} == sequential(rows, 0.85) and len(got) == len(rows)


def test_a_held_row_stands_in_only_for_titles_after_it(spark):
    base = [f"w{i}" for i in range(14)]
    z, x, y, u = base, [*base[1:], "x1"], [*base[1:12], "w13", "y1", "x1"], [*base[1:11], "w12", "w13", "u1", "x1"]
    like = [[*base[:13], f"k{i}"] for i in range(12)]
    rows = [(1, None, z), (2, None, x), (3, None, y), (4, "10.1/held", x), (5, None, u), *((6 + i, None, k) for i, k in enumerate(like))]
    rows = [(i, doi, " ".join(words)) for i, doi, words in rows]
    got = {r.ord: r.keep for r in S.title_dedup(spark.createDataFrame(rows, "ord long, doi string, title string")).collect()}
    assert got == sequential(rows, 0.85) == {1: True, 2: False, 3: True, 4: True} | {i: False for i in range(5, 18)}


def test_merge_phases_sends_no_titles_along_with_all_pairs_of_variants(spark):
    rng = random.Random(9)
    bases = [[f"w{rng.getrandbits(96):x}" for _ in range(13)] for _ in range(100)]
    rows = [(i, None, "seed", " ".join([*bases[i % 100], f"unit{i}"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "ord long, doi string, phase string, title string").repartition(4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    try:
        got, written = shuffled(spark, lambda: S.merge_phases(df))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {r.ord: r.phase for r in got} == {i: "seed" for i in range(100)}
    assert written < 9_000_000
