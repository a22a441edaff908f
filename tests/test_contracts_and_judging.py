"""Contract roles, exclusion parsing, evidence of atoms, cascade buckets, provider records and text predicates on small fixtures."""

import pytest
from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.operators import answers as W
from sievemill.operators import contracts as K
from sievemill.operators import evaluation as E
from sievemill.operators import judging as J
from sievemill.operators import screening as S
from sievemill.operators import texts as X
from sievemill.operators.atoms import Atom, Contract, infer_category, variants
from sievemill.operators.query_building import parse_exclusions
from sievemill.sources import ingest as I
from sievemill.sources import providers as P

K_CONTRACT = Contract((Atom("remote care", ("tele care",), "I", required=True),))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Artículos anteriores a 2019\nexcluir 'grey literature', no incluir editoriales; sin mención de cohortes", (2019, ["grey literature", "editoriales", "cohortes"])),
        ("Before 2005. prior to 2010\nartículos que contengan pilot study", (2010, ["pilot study"])),
        ("exclude animals\nEXCLUDE \"mice, rats\"\nante 1800", (None, ["animals", "mice"])),
        ("sin resumen.\nno incluir: x\nartículo que contenga abc; otros", (None, ["resumen", "abc"])),
        ("excluir ab\nprior 2031", (None, [])), ("", (None, [])), (None, (None, [])),
    ],
)
def test_parse_exclusions(text, want):
    assert parse_exclusions(text) == want


def test_variants_and_categories(spark):
    assert {"digital technology", "digital technologies", "digital-technologies"} <= set(variants("Digital technologies"))
    assert variants("the") == []
    assert "clas size" in variants("class size")
    rows = [("AI tools for triage",), ("fair use",), ("AI",), ("usual care",), ("pain score",), ("veterans",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(infer_category(F.col("c"))).collect()]
    assert got == ["I", "P", "I", "C", "O", "P", "P"]


def test_roles_tiers_and_empirical_queries(spark):
    atoms = (
        Atom("adults", ("older adults",), "P", required=True), Atom("care", ("remote care",), "I", required=True), Atom("calls", ("phone calls",), "I", required=True), Atom("tablets", ("tablets",), "I", required=True),
        Atom("published from 2015", (), "P", required=True), Atom("cost", ("cost",), "O"),
    )
    people, central, technical = K.roles(atoms)
    assert [a.name for a in people] == ["adults"] and [a.name for a in central] == ["care"] and [a.name for a in technical] == ["calls", "tablets"]
    rows = [("remote care of older-adults by phone calls and tablets",), ("remote care of older adults by tablets",), ("remote care of older adults",), ("phone calls",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "q string").select(K.query_tier(F.col("q"), atoms)).collect()] == ["exact", "focused", None, None, None]
    got = K.empirical_queries(atoms, {"adults": ("elderly",)}, most=4)
    assert got[0] == ("elderly remote care phone calls", "focused") and len(got) == 4
    assert K.empirical_queries(atoms[:1], {}) == []
    assert K.components("Learning (XGB, random forests and model 3)") == ["Learning", "XGB", "random forests", "model 3"]
    assert K.is_composite("a / b") and not K.is_composite("remote care")
    groups = K.atom_groups([{"name": "x", "category": "p", "terms": ["the", "older adults"], "required": 1}, {"category": "P", "terms": ["a b"]}, {"id": "y", "category": "Z", "terms": ["ab"]}, {"id": "z", "category": "I", "terms": ["the"]}])
    assert [(g.name, g.category, g.required) for g in groups] == [("x", "P", True)]
    one = spark.createDataFrame([(["ab", "AI ", "ECG", "ecg", "  diet "],), (None,)], "t array<string>").select(K.safe_terms(F.col("t"))).collect()
    assert one[0][0] == ["ecg", "diet"] and one[1][0] is None


def test_evidence_and_buckets(spark):
    atoms = [("a", "alpha"), ("b", "beta")]
    rows = [
        (1, '{"atom_evaluations": [{"id": "a", "status": "Met", "evidence": "x"}, {"id": "b", "status": "met", "evidence": " "}]}'), (2, "no object"), (3, None),
        (4, '```json\n{"atom_evaluations": [{"id": "a", "status": "not_met"}, {"id": "a ", "status": "met", "evidence": "y"}, {"id": "b", "status": "met", "evidence": "z"}]}\n```'),
    ]
    df = spark.createDataFrame(rows, "i int, response string")
    got = {r.i: (r.atom_states, r.missing_atoms, r.atom_score) for r in J.atom_guard(df, atoms).collect()}
    assert got == {1: (["met", "unclear"], ["beta"], 0.5), 2: (["unclear"] * 2, ["alpha", "beta"], 0.0), 3: (["unclear"] * 2, ["alpha", "beta"], 0.0), 4: (["met", "met"], [], 1.0)}
    assert J.atom_guard(df, []).first().atom_score == 1.0
    cases = spark.createDataFrame(
        [
            (1, True, "INCLUDE", False, "YES", "YES", "YES", 1.0, [], ""), (2, False, "EXCLUDE", True, "yes", "YES", "YES", 0.6, ["x"], ""), (3, False, "EXCLUDE", True, "YES", "NO", "YES", 0.6, ["x", "y"], ""),
            (4, False, "BACKGROUND_ONLY", False, "YES", "YES", "YES", 0.4, [], ""), (5, False, "EXCLUDE", None, None, None, None, 0.25, [], "because"), (6, None, "EXCLUDE", False, "NO", "NO", "NO", 0.25, [], None),
        ],
        "i int, passed boolean, decision string, near_miss boolean, population string, intervention string, study_design string, score double, missing_atoms array<string>, justification string",
    )
    got = {r.i: (r.included, r.bucket, r.reason) for r in J.cascade_bucket(cases).collect()}
    assert got[1] == (True, "DIRECT_INCLUDED", None) and got[2][:2] == (True, "BACKGROUND_ONLY") and got[4][:2] == (True, "BACKGROUND_ONLY")
    assert got[3] == (False, "EXCLUDE", "Faltan atomos obligatorios: x, y") and got[5] == (False, "EXCLUDE", "because") and got[6][2].endswith("(Puntaje: 25.0%)")


def test_provider_records_with_missing_fields(spark):
    rows = [(1, "A long enough title of a paper", None, None), (2, "Short", "x" * 150, "10.1/abcd"), (3, "Short", "", ""), (4, "npm install guide for this package", "y" * 200, "10.1/zz"), (5, None, "z" * 200, None), (6, "Short", "w" * 150, "10.1/abcd")]
    df = spark.createDataFrame(rows, "n int, title string, abstractText string, doi string")
    got = {r.key: r for r in P.europe_pmc_articles(df, "n").collect()}
    assert set(got) == {"A long enough title of a paper", "Short"} and got["Short"].abstract[0] == "x" and got["Short"].year == 0 and got["Short"].url == "https://doi.org/10.1/abcd"
    assert got["A long enough title of a paper"].abstract == P.NO_ABSTRACT
    works = spark.createDataFrame([("w1", "A long enough title of a paper", {"b": [1], "a": [0, 2]})], "id string, display_name string, abstract_inverted_index map<string,array<int>>")
    assert P.openalex_articles(works).first().abstract == "a b a" and P.openalex_articles(works.limit(0)).count() == 0
    cites = spark.createDataFrame([(7, ["p" * 60, "q" * 60], [("Doe", "Jo"), ("X", None)]), (8, ["short"], None), (9, None, None)], "pmid int, abstract_parts array<string>, authors array<struct<last:string,fore:string>>")
    one = P.pubmed_articles(cites).collect()
    assert [(r.key, r.authors, r.url, r.language) for r in one] == [("7", ["Doe, Jo"], "https://pubmed.ncbi.nlm.nih.gov/7", "eng")]


def test_text_predicates(spark):
    df = spark.createDataFrame([("Škoda Łódź Ünï", "≥5° – “a”", "https://ieeexplore.ieee.org/document/12", bytearray(b"%PDF-" + b"x" * 5000), "application/pdf"), (None, None, None, None, None)], "t string, p string, u string, b binary, k string")
    r = df.select(C.fold_accents(F.col("t")).alias("t"), C.plain_punctuation(F.col("p")).alias("p"), C.ieee_links(F.col("u")).alias("u"), C.is_pdf(F.col("b"), F.col("k")).alias("b")).collect()
    assert r[0].t == "Skoda Łodz Uni" and r[0].p == '>=5 grados - "a"' and len(r[0].u) == 4 and r[0].b and r[1].t is None
    t = "x" * 100 + "\nIntroduction\n" + "i" * 2000 + "\n2. Methods\n" + "m" * 2000 + "\nConclusions\n" + "c" * 900 + "\nReferences\n" + "r" * 500
    s = X.sections(spark.createDataFrame([(t,), ("short text",), (None,)], "t string"), "t").collect()
    assert s[0].introduction.startswith("Introduction") and s[0].methods.startswith("2. Methods") and s[0].conclusions.endswith("c") and "r" * 100 not in s[0].selected and "=== METHODOLOGY ===" in s[0].selected
    assert s[1].selected == "short text" and s[2].selected == ""
    assert S.journal_names('["A, B", " a,  b", "C"]') == ("A, B", "C") and S.journal_names("A, B") == ("A, B",) and S.journal_names(None) == () and S.journal_names("[bad") == ("[bad",)
    ys = spark.createDataFrame([(None, "2019-01-02"), (0, "x"), (2001, None)], "y int, d string").select(C.first_year(F.col("y"), F.col("d"))).collect()
    assert [x[0] for x in ys] == [2019, None, 2001]
    assert [x[0] for x in spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "p array<string>").select(C.joined_list(F.col("p"))).collect()] == ["a, b y c", "a", ""]


def test_ingest_and_reports(spark):
    m = I.column_mapping(["Publication Title", "Abstract Note", "Item Title", "Date", "Creators", "Manual Decision"])
    assert m == {"journal": "Publication Title", "abstract": "Abstract Note", "title": "Item Title", "year": "Date", "authors": "Creators", "label": "Manual Decision"}
    got = {r.value: r.parsed for r in I.label_histogram(spark.createDataFrame([("Incluir",), ("excluido",), ("POSITIVO",), ("quizá",), (None,)], "l string"), "l").collect()}
    assert got == {"incluir": 1, "excluido": 0, "positivo": 1, "quizá": None, "": None}
    df = spark.createDataFrame([("t", None)], "title string, abstract string")
    assert I.ingest_warnings(df, {"title": "t", "abstract": "a"}) == ["No se detecto DOI; la deduplicacion sera menos precisa.", "1 articulos no tienen abstract."]

    def broken():
        raise OSError("gone")

    assert I.fan_in([broken, df, lambda: df]).count() == 2
    with pytest.raises(ValueError):
        I.fan_in([broken])
    shares = spark.createDataFrame([("a", 60.0), ("b", 25.0), ("c", 15.0)], "l string, p double")
    assert [tuple(r) for r in E.head_and_rest(shares, "l", "p").collect()] == [("a", 60.0), ("b", 25.0), ("otras revistas", 15.0)]
    assert E.share_sentence(shares, "l", "p", "son").first()[0] == "el 60.0% son a, el 25.0% en b, y el 15.0% en c"
    assert E.share_sentence(shares.limit(0), "l", "p", "son").first()[0] == ""


def test_quantiles_match_sorted_values(spark):
    import random

    from sievemill.operators.quantiles import quantiles

    rng = random.Random(4)
    for values in ([rng.choice([0.0, 1.5, 2.0, rng.random()]) for _ in range(501)], [3.0], [1.0, 2.0], [7] * 40):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        got, flat = quantiles(df, "x", (0.0, 0.05, 0.5, 0.97, 1.0)), sorted(values)
        for q, g in zip((0.0, 0.05, 0.5, 0.97, 1.0), got, strict=True):
            at = q * (len(flat) - 1)
            lo = int(at)
            assert g == pytest.approx(flat[lo] + (at - lo) * (flat[min(lo + 1, len(flat) - 1)] - flat[lo]))
    assert quantiles(df.limit(0), "x", (0.5,)) == [None]


def test_answers(spark):
    assert W.question_terms("¿Mejora la telemonitorización en adultos con asma grave?") == ["mejora", "telemonitorización", "adultos"] and W.question_terms(None) == ["systematic review"] and W.question_terms("a of 12") == ["systematic review"]
    assert W.domain_words(["Remote Care of x", "AI"]) == {"remote", "care"}
    base = ["base uno dos", "base tres", "base cuatro"]
    assert W.category_list("1. Uso de modelos predictivos\n- uso de modelos predictivos\n* corto dos", base) == ["Uso de modelos predictivos", "base uno dos", "base tres", "base cuatro"]
    assert W.category_list(None, base) == base and W.category_list("No se identificaron aportes.", base) == []
    assert W.category_list("a b c, d e f; g h i\nj k l, m n o, p q r", base) == ["a b c", "d e f", "g h i", "j k l", "m n o"]
    rows = W.synonym_rows(K_CONTRACT)
    assert ("remote care", "I", True, "remote care", "remote-care") in rows
    assert W.criteria_rows("- adults\n\n* 2010 on", None) == [("inclusion", "abstract", "adults"), ("inclusion", "abstract", "2010 on")]
    df = spark.createDataFrame([('x {"atoms": [{"id": " a ", "terms": ["Sleep ", "sleep", "made up"]}, {"id": "", "terms": ["sleep"]}]}',), ("nothing",), (None,)], "response string")
    assert [tuple(r) for r in W.mapped_terms(df, spark.createDataFrame([("sleep",), (None,)], "term string")).collect()] == [("a", "sleep", 0)]
    assert [r[0] for r in spark.createDataFrame([("<analisis>x</analisis> ok",), (None,), ("y" * 41,), ("[EVIDENCIA 1] " + "y" * 41,)], "t string").select(W.traced(F.col("t"))).collect()] == ["ok", None, W.UNTRACED + "y" * 41, "[EVIDENCIA 1] " + "y" * 41]
