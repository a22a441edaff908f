"""Registered queries: concept matching, retrieval, scoring, classification and judge answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.operators import atoms as A
from sievemill.operators import evaluation as E
from sievemill.operators import retrieval as T
from sievemill.operators import scoring as Q
from sievemill.operators import screening as S
from sievemill.plans.registry import Registry, sql_contains_any, sql_list
from sievemill.plans.flagship import screen
from sievemill.plans.screening_queries import ACADEMIC, DOI_OK, articles
from sievemill.runtime import stored, table

R = Registry()

CONTRACT = A.Contract(
    atoms=(
        A.Atom("remote care", ("remote monitoring", "telephone follow-up", "video consultations", "telemonitorización"), "I", required=True, technical=True),
        A.Atom("chronic disease", ("hypertension", "type 2 diabetes", "chronic kidney disease", "heart failure", "asthma attacks"), "P", required=True),
        A.Atom("adherence", ("treatment adherence", "course completion"), "O"),
        A.Atom("workload", ("staff workload", "cost per contact"), "O"),
        A.Atom("usual practice", ("usual practice", "comparison arm"), "C"),
    ),
    min_technical=1,
)
TITLE_ABSTRACT = "lower(concat(coalesce(title, ''), chr(10), coalesce(abstract, '')))"


def _sql_atom(c: str, terms, expand: bool) -> str:
    """The same alternation without lookaround, which the other dialect does not have."""
    import re

    every = {v for t in terms for v in (A.variants(t) if expand else A.simple_variants(t))}
    body = "|".join(re.escape(v).replace("\\ ", " ").replace("\\-", "-") for v in sorted(every, key=lambda v: (-len(v), v)))
    return f"regexp_matches({c}, '(^|[^a-z0-9])({body})($|[^a-z0-9])')"


def _matched(expand: bool = True) -> str:
    either = lambda a: f"({_sql_atom(LOWT, a.terms, expand)} or {_sql_atom(LOWA, a.terms, expand)})"
    return "list_filter([" + ", ".join(f"case when {either(a)} then '{a.name}' end" for a in CONTRACT.atoms) + "], lambda x: x is not null)"


LOWT, LOWA = "lower(coalesce(title, ''))", "lower(coalesce(abstract, ''))"
GATE = [a.name for a in CONTRACT.atoms if a.required]
OPTIONAL = [a.name for a in CONTRACT.atoms if not a.required]
CONCEPT = f"""with m as (select record_id, {_matched()} as matched from article_records),
  g as (select record_id, matched, list_filter([{sql_list(GATE)}], lambda x: not list_contains(matched, x)) as missing from m)"""


@R.query(
    f"""{CONCEPT} select record_id as ord, array_to_string(matched, ',') as matched, array_to_string(missing, ',') as missing, len(missing) = 0 as passed,
    round(len(list_filter(matched, lambda x: x in ({sql_list(OPTIONAL)}))) / {len(OPTIONAL)}, 2) as bonus from g"""
)
def concept_filter(spark, sf):
    rows = A.concept_filter(articles(spark, sf).select("ord", "title", "abstract"), CONTRACT)
    return rows.select("ord", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"), "passed", "bonus")


@R.query(f"{CONCEPT}, f as (select unnest(missing) as atom from g) select atom, count(*) as failures from f group by 1")
def atom_failures(spark, sf):
    return A.atom_failures(A.concept_filter(articles(spark, sf).select("ord", "title", "abstract"), CONTRACT))


WINDOW = A.Contract(CONTRACT.atoms, window=300)


@R.query()
def cooccurrence_window(spark, sf):
    """Atoms that lie within 300 characters of each other in long abstracts; checked against brute force in the tests."""
    rows = articles(spark, sf).select("ord", A.cooccurring_atoms(F.col("title"), F.col("abstract"), WINDOW).alias("m"))
    return rows.select("ord", F.array_join("m", ",").alias("matched"), F.size("m").alias("n"))


_SIMPLE = {a.name: _sql_atom(TITLE_ABSTRACT, a.terms, False) for a in CONTRACT.atoms}
COVER = f"""select record_id as ord, {" + ".join(f"({_SIMPLE[n]})::int" for n in GATE)} as matched_required,
  round(({" + ".join(f"({_SIMPLE[n]})::int" for n in GATE)}) / {len(GATE)}, 4) as coverage,
  {", ".join(" + ".join(f"({_SIMPLE[a.name]})::int" for a in CONTRACT.atoms if a.category == c) + f" as n_{c.lower()}" for c in "PICO")} from article_records"""


@R.query(COVER)
def atom_coverage(spark, sf):
    return A.atom_coverage(articles(spark, sf), CONTRACT).select("ord", "matched_required", "coverage", "n_p", "n_i", "n_c", "n_o")


@R.query(f"with c as ({COVER}) select ord, coverage, coalesce(citations, 0) as citations, year from c join article_records on record_id = ord order by coverage desc, coalesce(citations, 0) desc, year desc nulls last, ord limit 50")
def contract_rank(spark, sf):
    rows = A.atom_coverage(articles(spark, sf), CONTRACT).select("ord", "coverage", F.coalesce("citations", F.lit(0)).alias("citations"), "year")
    return rows.orderBy(F.col("coverage").desc(), F.col("citations").desc(), F.col("year").desc_nulls_last(), "ord").limit(50)


@R.query(
    f"""select record_id as ord, ({_sql_atom("lower(concat_ws(' ', title, abstract))", [t for a in CONTRACT.atoms if a.category == "P" for t in a.terms], True)}
    and {_sql_atom("lower(concat_ws(' ', title, abstract))", [t for a in CONTRACT.atoms if a.category == "I" for t in a.terms], True)}) as passed from article_records"""
)
def category_filter(spark, sf):
    return A.category_filter(articles(spark, sf).select("ord", "title", "abstract"), CONTRACT).select("ord", "passed")


_CONCEPT = "lower(coalesce(query_text, ''))"
_MARKED = {
    "C": "comparator comparison control baseline placebo standard usual conventional alternative non-adaptive fixed versus vs".split(),
    "O": "outcome effect impact measure measurement metric score rate frequency duration change response improvement reduction increase decrease".split(),
    "I": "intervention treatment program protocol method approach model system tool device platform application software technique technology exposure agent strategy".split(),
}
_CAT = f"""case when {sql_contains_any(_CONCEPT, _MARKED["C"])} then 'C' when {sql_contains_any(_CONCEPT, _MARKED["O"])} then 'O'
  when {sql_contains_any(_CONCEPT, _MARKED["I"])} or regexp_matches({_CONCEPT}, '\\bai\\b') then 'I' else 'P' end"""


@R.query(f"select {_CAT} as category, count(*) as n from search_queries group by 1")
def category_inference(spark, sf):
    return table(spark, sf, "search_queries").groupBy(A.infer_category(F.col("query_text")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


# ---- retrieval
TOK = f"""raw as (select doc_id as doc, list_filter(list_transform(string_split_regex(strip_accents(lower(coalesce(text, ''))), '[^a-zA-Z0-9_\\-]+'),
    lambda w: regexp_replace(w, '^-+|-+$', '', 'g')), lambda w: w != '') w from documents),
  one as (select doc, unnest(w) x from raw),
  two as (select doc, unnest(case when contains(x, '-') then list_concat(list_filter(string_split(x, '-'), lambda p: p != ''), [array_to_string(list_filter(string_split(x, '-'), lambda p: p != ''), '')]) else [x] end) term from one),
  counts as (select doc, term, count(*) tf from two where length(term) between 2 and 40 group by 1, 2),
  freq as (select term, count(*) df from counts group by 1),
  cutoff as (select quantile_cont(df, 0.97) c from freq),
  stop as (select term, df from freq, cutoff where df >= c)"""
BM25_SQL = f"""{TOK}, kept as (select * from counts where term not in (select term from stop)), lengths as (select doc, sum(tf) dl from kept group by 1),
  n as (select count(distinct doc) n from counts), total as (select sum(dl) t from lengths),
  w0 as (select term, ln(n - df + 0.5) - ln(df + 0.5) raw from freq, n where term not in (select term from stop)), floor_ as (select avg(raw) * 0.25 f from w0),
  idf as (select term, case when raw < 0 then f else raw end idf from w0, floor_),
  qw as (select q.query_id, unnest(q.terms) term from asked q), qc as (select query_id, term, count(*) qtf from qw group by 1, 2),
  scores as (select query_id, doc, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (t / n)))) score from kept join qc using (term) join idf using (term) join lengths using (doc), n, total group by 1, 2)"""
ASKED = [(1, "remote monitoring of hypertension in night-shift workers"), (2, "staff workload and cost per contact"), (3, "treatment adherence after telephone follow-up")]


def _terms(text: str) -> list[str]:
    import re

    out = []
    for w in re.split(r"[^\w\-]+", text.lower()):
        parts = [p for p in w.strip("-").split("-") if p]
        out += [*parts, "".join(parts)] if len(parts) > 1 else parts
    return [w for w in out if 2 <= len(w) <= 40]


ASKED_SQL = "asked(query_id, terms) as (values " + ", ".join(f"({i}, [{sql_list(_terms(t))}])" for i, t in ASKED) + ")"


def _asked(spark):
    return spark.createDataFrame([(i, _terms(t)) for i, t in ASKED], "query_id int, terms array<string>")


@R.query(f"with {TOK} select term, df from stop")
def corpus_stopwords(spark, sf):
    return T.corpus_stopwords(T.document_frequencies(T.term_counts(table(spark, sf, "documents"), "doc_id", F.col("text"))))


def _bm25(spark, sf):
    # counted once, read by the frequencies, the lengths and the scores
    counts = stored(T.term_counts(table(spark, sf, "documents"), "doc_id", F.col("text")), "counts")
    freq = stored(T.document_frequencies(counts), "frequencies")
    return T.bm25(counts, freq, T.corpus_stopwords(freq), _asked(spark))


@R.query(f"with {ASKED_SQL}, {BM25_SQL} select query_id, doc, round(score, 6) as score from scores")
def bm25_scores(spark, sf):
    return _bm25(spark, sf).select("query_id", "doc", F.round("score", 6).alias("score"))


@R.query(f"with {ASKED_SQL}, {BM25_SQL} select doc, round(0.7 * greatest(max(score), 0) + 0.3 * sum(score) / 3, 6) as score from scores group by 1")
def bm25_multi(spark, sf):
    return T.combine_queries(_bm25(spark, sf), len(ASKED)).select("doc", F.round("score", 6).alias("score"))


@R.query(
    """with e as (select vec_id as ord, list_transform(embedding, lambda x: x::double) v, label::double l from embeddings), q as (select v from e where ord = 0),
    s as (select ord, list_cosine_similarity(e.v, q.v) a, list_sum(list_transform(list_zip(e.v[1:8], q.v[1:8]), lambda z: abs(z[1] - z[2]))) b from e, q),
    r as (select ord, row_number() over (order by a desc, ord) r1, row_number() over (order by b desc, ord) r2 from s),
    f as (select ord, 0.6 / (60 + r1) + 0.4 / (60 + r2) raw from r)
    select ord, round(case when max(raw) over () = min(raw) over () then 0.5 else (raw - min(raw) over ()) / (max(raw) over () - min(raw) over ()) end, 6) as fused from f"""
)
def rrf_fusion(spark, sf):
    df = table(spark, sf, "embeddings")
    q = df.where("vec_id = 0").first()["embedding"]
    arr = F.array(*(F.lit(float(x)) for x in q))
    gap = F.aggregate(F.zip_with(F.slice("embedding", 1, 8), F.slice(arr, 1, 8), lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
    rows = df.select(F.col("vec_id").alias("ord"), C.cosine(F.col("embedding"), arr).alias("dense"), gap.alias("lexical"))
    return T.fuse_ranks(rows, "dense", "lexical").select("ord", F.round("fused", 6).alias("fused"))


@R.query(
    r"""with words as (select record_id doc, list_filter(regexp_extract_all(lower(trim(coalesce(title, '') || ' ' || coalesce(abstract, ''))), '[\p{L}\p{N}_][\p{L}\p{N}_]+'), lambda w: w not in (STOP)) w
      from article_records where coalesce(title, '') != '' or coalesce(abstract, '') != ''),
    g as (select doc, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) term from words),
    counts as (select doc, term, count(*) tf from g group by 1, 2), n as (select count(*) n from words),
    chosen as (select term, count(*) df, sum(tf) cf from counts group by 1 having count(*) >= 2 order by cf desc, term limit 150),
    w as (select doc, term, tf * (ln((1 + n) / (1 + df)) + 1) w from counts join chosen using (term), n), l as (select doc, sqrt(sum(w * w)) norm from w group by 1)
    select term, round(sum(w / norm) / any_value(n), 6) as score from w join l using (doc), n group by 1 order by round(sum(w / norm) / any_value(n), 9) desc, term limit 120""".replace("STOP", sql_list(T.ENGLISH))
)
def tfidf_terms(spark, sf):
    """Of titles with abstracts, 1- to 3-grams without English function words."""
    df = articles(spark, sf).where("coalesce(title, '') != '' or coalesce(abstract, '') != ''").select("ord", "title", "abstract")
    both = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    return T.mine_terms(df, "ord", both, 1, 3, stopwords=T.ENGLISH).select("term", F.round("score", 6).alias("score"))


Q0 = "(select list_transform(embedding, lambda x: x::double) v from embeddings where vec_id = 0)"
SIM = "list_cosine_similarity(list_transform(embedding, lambda x: x::double), q.v)"


def _query_vector(spark, sf) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]]


@R.query(f"select vec_id, round({SIM}, 6) as sim from embeddings, {Q0} q order by {SIM} desc, vec_id limit 25")
def cosine_topk(spark, sf):
    return T.top_by_cosine(table(spark, sf, "embeddings"), _query_vector(spark, sf), 25).select("vec_id", F.round("sim", 6).alias("sim"))


@R.query(
    f"""select d.doc_id, case when length(trim(coalesce(text, ''))) < 150 then 1.0 else round({SIM}, 4) end as similarity,
    length(trim(coalesce(text, ''))) < 150 or coalesce({SIM} >= 0.05, false) as passed from documents d left join embeddings e on e.vec_id = d.doc_id, {Q0} q"""
)
def cosine_gate(spark, sf):
    """Every document: short ones pass with 1.0, those without a vector have no similarity and do not pass."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    df = table(spark, sf, "documents").select("doc_id", "text").join(vectors, "doc_id", "left")
    return T.cosine_gate(df, _query_vector(spark, sf), F.col("text"), 0.05).select("doc_id", "similarity", "passed")


@R.query(
    """with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings), c as (select label category, arg_min(v, vec_id) centre from e group by 1),
    s as (select vec_id, category, list_cosine_similarity(v, centre) sim from e, c),
    b as (select *, row_number() over (partition by vec_id order by sim desc, category) r from s) select vec_id, case when sim >= 0.19 then category end as category, round(sim, 6) as sim from b where r = 1"""
)
def category_argmax(spark, sf):
    df = table(spark, sf, "embeddings")
    centres = df.groupBy(F.col("label").alias("category")).agg(F.min_by("embedding", "vec_id").alias("centre"))
    return T.assign_category(df, centres).select("vec_id", "category", F.round("sim", 6).alias("sim"))


@R.query(
    f"""with s as (select d.raw_id, coalesce({SIM}, 0) + 0.05 * (contains(lower(coalesce(chunk, '')), 'telephone')::int + contains(lower(coalesce(chunk, '')), 'sites')::int) s
      from raw_chunks d left join embeddings e on e.vec_id = d.raw_id, {Q0} q),
    r as (select *, row_number() over (order by s desc, raw_id) r from s) select raw_id as pos, round(s, 6) as score from r where r between 11 and 20 order by 1"""
)
def chunk_context(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")
    df = table(spark, sf, "raw_chunks").select(F.col("raw_id").alias("pos"), F.col("chunk").alias("text")).join(vectors, "pos", "left")
    return T.chunk_context(df, _query_vector(spark, sf), ["telephone", "sites"], 10, 1).select("pos", F.round("score", 6).alias("score"))


# ---- scores
QUERIES = ["remote monitoring of hypertension", "telephone follow-up after heart failure", "staff workload in primary care"]
KEYWORDS = ["adherence", "monitoring", "workload"]
TERMS = ["remote monitoring", "hypertension", "treatment adherence", "telephone", "body weight"]
PICO = Q.Pico(p=("hypertension", "heart failure", "pregnant women"), i=("remote monitoring", "telephone follow-up", "video consultations"), o=("treatment adherence", "quality of life"))
DOT = "concat(lower(coalesce(title, '')), '. ', lower(coalesce(abstract, '')))"


def _count(c: str, terms) -> str:
    return "(" + " + ".join(f"contains({c}, '{t.lower()}')::int" for t in terms) + ")"


_P24, _P3 = Q.phrases(QUERIES, 2, 4), Q.phrases(QUERIES, 3, 3)
DOMAIN = f"case when {_count(DOT, _P24)} >= 3 then 1.0 when {_count(DOT, _P24)} = 2 then 0.75 when {_count(DOT, _P24)} = 1 then 0.5 when {_count(DOT, KEYWORDS)} = 0 then 0.0 when {_count(DOT, KEYWORDS)} = 1 then 0.4 when {_count(DOT, KEYWORDS)} = 2 then 0.7 else 1.0 end"
BOOST0 = f"(0.4 * {_count(DOT, TERMS)} / {len(TERMS)} + 0.6 * {_count(DOT, TERMS[:3])} / 3)"
BOOST = f"(case when {_count(DOT, TERMS)} >= 2 and {_count(DOT, _P3)} = 0 then {BOOST0} * 0.5 else {BOOST0} end * case when {_count(DOT, ['remote', 'video'])} > 0 and {_count(DOT, ['usual'])} > 0 then 1 else 0.85 end)"


@R.query(f"select record_id as ord, ({DOMAIN})::double as domain, round({BOOST}, 6) as boost from article_records")
def domain_and_boost(spark, sf):
    t, a = F.col("title"), F.col("abstract")
    boost = Q.keyword_boost(t, a, TERMS, QUERIES, (("remote", "video"), ("usual",)))
    return articles(spark, sf).select("ord", Q.domain_relevance(t, a, QUERIES, KEYWORDS).alias("domain"), F.round(boost, 6).alias("boost"))


def _trap(x, a, b, c, d):
    up = f"({x} - {a}) / {b - a}" if b > a else "1.0"
    down = f"({d} - {x}) / {d - c}" if d > c else "1.0"
    return f"case when {x} < {a} or {x} > {d} then 0.0 when {x} <= {b} then {up} when {x} <= {c} then 1.0 else {down} end"


FUZZY_SQL = f"""base as (select ord, s, d, least(greatest(k / 0.20, 0), 1) k from raw_scores),
  mem as (select ord, s, d, {_trap("s", 0, 0, 0.25, 0.45)} lo, {_trap("s", 0.30, 0.55, 0.55, 0.75)} mi, {_trap("s", 0.60, 0.80, 1.0, 1.0)} hi,
    {_trap("d", 0, 0, 0.25, 0.45)} dl, {_trap("d", 0.35, 0.60, 1.0, 1.0)} dh, {_trap("k", 0.30, 0.55, 1.0, 1.0)} kh from base),
  act as (select ord, d, least(hi, dh, kh) r1, least(hi, dh) r2, least(hi, dl) r3, least(mi, dh, kh) r4, least(mi, dh) r5, least(mi, dl) r6, lo r7 from mem),
  fz as (select ord, d, (0.92 * r1 + 0.78 * r2 + 0.50 * r3 + 0.75 * r4 + 0.58 * r5 + 0.30 * r6 + 0.08 * r7) / coalesce(nullif(r1 + r2 + r3 + r4 + r5 + r6 + r7, 0), 1e-9) v from act),
  fuzzy as (select ord, case when d > 0 then greatest(v, 0.08 + 0.22 * d) else v end f from fz)"""
CITE = "least(coalesce(citations, 0), 60) / 60.0"
SCORES = f"raw_scores as (select record_id ord, greatest({CITE}, 0)::double s, ({DOMAIN})::double d, {BOOST} k from article_records)"


def _scores(spark, sf):
    t, a = F.col("title"), F.col("abstract")
    sim = F.greatest(F.least(F.coalesce("citations", F.lit(0)), F.lit(60)) / 60.0, F.lit(0.0))
    return articles(spark, sf).select(
        "ord", sim.alias("similarity"), Q.domain_relevance(t, a, QUERIES, KEYWORDS).alias("domain_relevance"),
        Q.keyword_boost(t, a, TERMS, QUERIES, (("remote", "video"), ("usual",))).alias("boost"), "year", "url",
    )


@R.query(f"with {SCORES}, {FUZZY_SQL} select ord, round(f, 6) as fuzzy from fuzzy")
def fuzzy_score(spark, sf):
    rows = _scores(spark, sf)
    return rows.select("ord", F.round(C.fuzzy_relevance(F.col("similarity"), F.col("domain_relevance"), F.col("boost")), 6).alias("fuzzy"))


@R.query(f"with {SCORES}, {FUZZY_SQL} select ord, round(least(greatest(0.6 * f + 0.4 * s - 0.15 * {_count(DOT, ['pilot study', 'sleep apnoea'])}, 0), 1), 6) as hybrid from fuzzy join raw_scores using (ord) join article_records on record_id = ord")
def hybrid_score(spark, sf):
    rows = _scores(spark, sf).join(articles(spark, sf).select("ord", "title", "abstract"), "ord")
    low = F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit(". "), F.lower(F.coalesce("abstract", F.lit(""))))
    excluded = low.contains("pilot study").cast("int") + low.contains("sleep apnoea").cast("int")
    f = C.fuzzy_relevance(F.col("similarity"), F.col("domain_relevance"), F.col("boost"))
    return rows.select("ord", F.round(Q.hybrid_score(f, F.col("similarity"), excluded), 6).alias("hybrid"))


@R.query(
    """with p as (select quantile_cont(n_chars, 0.05) a, quantile_cont(n_chars, 0.95) b from documents)
    select doc_id, round(case when a = b then 0.5 else (least(greatest(n_chars, a), b) - a) / (b - a) end, 6) as scaled from documents, p"""
)
def robust_normalise(spark, sf):
    return Q.robust_scale(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", F.round("scaled", 6).alias("scaled"))


def _lexical_sql() -> str:
    both, p, i, o = f"concat({LOWT}, ' ', {LOWA})", PICO.p, PICO.i, PICO.o
    boosts = " + ".join(f"case when contains({LOWT}, '{b}') then 8.0 when contains({LOWA}, '{b}') then 3.0 else 0.0 end" for b in PICO.boosts())
    return f"(3.0 * {_count(both, p)} + 2.0 * {_count(both, i)} + {_count(both, o)} + case when {_count(both, p)} > 0 and {_count(both, i)} > 0 then 25.0 else 0.0 end + {boosts} + least(10.0, ln(1 + greatest(coalesce(citations, 0), 0)) * 1.5))"


@R.query(f"select record_id as ord, round({_lexical_sql()}, 6) as relevance from article_records order by round({_lexical_sql()}, 9) desc, record_id limit 200")
def lexical_relevance(spark, sf):
    s = Q.lexical_relevance(F.col("title"), F.col("abstract"), F.col("citations"), PICO)
    return articles(spark, sf).select("ord", s.alias("s")).orderBy(F.round("s", 9).desc(), "ord").limit(200).select("ord", F.round("s", 6).alias("relevance"))


@R.query(f"with {SCORES} select ord, round(s, 6) as similarity from raw_scores join article_records on record_id = ord where s >= 0.20 order by (url is not null and url != '') desc, s desc, ord limit 200")
def eligibility_pool(spark, sf):
    rows = _scores(spark, sf).where("similarity >= 0.20").withColumn("has", F.coalesce(F.col("url") != "", F.lit(False)))
    return rows.orderBy(F.col("has").desc(), F.col("similarity").desc(), "ord").limit(200).select("ord", F.round("similarity", 6).alias("similarity"))


@R.query(f"with {SCORES}, t as (select s from raw_scores order by s desc limit 50) select round(greatest(coalesce(min(s), 0.4), 0.4), 6) as threshold from t")
def adaptive_threshold(spark, sf):
    return Q.adaptive_threshold(_scores(spark, sf), "similarity", 50).select(F.round("threshold", 6).alias("threshold"))


@R.query(
    f"""with {SCORES}, p as (select quantile_cont(s, 0.05) p5, quantile_cont(s, 0.5) p50 from raw_scores), t as (select greatest(0.05, least(0.30, p5)) f, greatest(0.45, least(0.60, p50)) a from p)
    select case when s >= a then 'auto_include' when s >= f or d >= 0.4 then 'grey_zone' else 'auto_exclude' end as status, count(*) as n, count_if(s < f and d >= 0.4) as rescued from raw_scores, t group by 1"""
)
def three_zone(spark, sf):
    rows = _scores(spark, sf)
    zones = Q.three_zones(rows, Q.dual_thresholds(rows, "similarity"))
    return zones.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("rescued").alias("rescued"))


# ---- judge answers, made from the extraction examples
def _answers(spark, sf):
    df = table(spark, sf, "raw_chunks")
    yes = lambda c: F.when(c, "YES").otherwise("NO")
    obj = F.to_json(F.struct(
        yes(F.length("chunk") > 300).alias("population"), yes(F.col("chunk").contains("trial") | F.col("chunk").contains("study")).alias("intervention"), yes(F.col("chunk_index") > 0).alias("comparator"),
        yes(F.col("output").isNotNull()).alias("outcome"), yes(F.length("output") > 20).alias("study_design"), yes(F.col("annotator").isNotNull()).alias("context"),
        F.when(F.col("raw_id") % 3 == 0, "INCLUDE").when(F.col("raw_id") % 3 == 1, "EXCLUDE").alias("decision"),
    ))
    fenced = F.concat(F.lit("Here it is:\n```json\n"), obj, F.lit("\n```\nDone."))
    return df.select("raw_id", "record_id", "annotator", F.when(F.col("raw_id") % 7 == 0, "no object at all").otherwise(fenced).alias("response"))


_B = {
    "population": "length(chunk) > 300", "intervention": "contains(chunk, 'trial') or contains(chunk, 'study')", "comparator": "chunk_index > 0", "outcome": "output is not null",
    "study_design": "length(output) > 20", "context": "annotator is not null",
}
JUDGE = f"""b as (select raw_id, record_id, raw_id % 7 = 0 as broken, {", ".join(f"coalesce({v}, false) and raw_id % 7 != 0 as {k}" for k, v in _B.items())} from raw_chunks),
  j as (select raw_id, record_id, ({" + ".join(f"{k}::int" for k in _B)}) / 6.0 as share, ({" and ".join(_B)}) as ok,
    case when broken then null when raw_id % 3 = 0 then 'INCLUDE' when raw_id % 3 = 1 then 'EXCLUDE' end said from b),
  v as (select raw_id, record_id, round(share, 4) as score, coalesce(said, case when ok then 'INCLUDE' else 'EXCLUDE' end) as decision, ok and coalesce(said, 'INCLUDE') = 'INCLUDE' as passed, share from j)"""


@R.query(f"with {JUDGE} select raw_id, score, decision, passed, not passed and share >= 0.5 as near_miss from v")
def judge_parse(spark, sf):
    return Q.parse_verdict(_answers(spark, sf)).select("raw_id", "score", "decision", "passed", "near_miss")


@R.query(
    f"""with {JUDGE} select record_id, case when count(*) = 1 then bool_or(passed) else sum(passed::int) >= 2 end as passed, round(avg(score), 9) as score, count(*) as runs from v group by 1"""
)
def majority_vote(spark, sf):
    rows = Q.parse_verdict(_answers(spark, sf)).select("record_id", F.col("passed").alias("vote"), "score")
    return Q.majority(rows, "record_id")


CRIT = "select raw_id, (length(coalesce(output, '')) % 11)::double i, (length(coalesce(chunk, '')) % 11)::double s, (raw_id % 100) / 100.0 e, contains(lower(coalesce(chunk, '')), 'review') r from raw_chunks"


@R.query(f"with c as ({CRIT}) select raw_id, round(0.25 * e + 0.45 * i / 10 + 0.30 * case when r then least(s, 3.0) else s end / 10, 6) as combined, i < 2 as hard_exclude from c")
def multicriteria(spark, sf):
    df = table(spark, sf, "raw_chunks").select(
        "raw_id", (F.length(F.coalesce("output", F.lit(""))) % 11).cast("double").alias("i"), (F.length(F.coalesce("chunk", F.lit(""))) % 11).cast("double").alias("s"),
        ((F.col("raw_id") % 100) / 100.0).alias("embedding_score"), F.lower(F.coalesce("chunk", F.lit(""))).contains("review").alias("is_review"),
    )
    return Q.combine_criteria(df).select("raw_id", "combined", "hard_exclude")


@R.query(
    """select query_id, record_id, hit_rank as rank, min(round(case when hit_rank <= 10 then 0.5 * score + 0.5 * (0.35 * score + 0.25 * (record_id % 10) / 10.0 + 0.20 * score + 0.20 * (query_id % 10) / 10.0) else score end, 9)) as final
    from retrieval_hits where score is not null and hit_rank is not null group by 1, 2, 3"""
)
def rerank_compose(spark, sf):
    df = table(spark, sf, "retrieval_hits").where("score is not null and hit_rank is not null").select(
        "query_id", "record_id", F.col("hit_rank").alias("rank"), F.col("score").alias("judge"), F.col("score").alias("prior"), F.col("score").alias("thematic"),
        ((F.col("record_id") % 10) / 10.0).alias("slr"), F.col("score").alias("methodological"), ((F.col("query_id") % 10) / 10.0).alias("contribution"),
    )
    return Q.compose_rerank(df, 10).groupBy("query_id", "record_id", "rank").agg(F.min("final").alias("final"))


@R.query(
    """select coalesce(provider, 'none') as provider, count(score) as n, round(avg(score), 9) as mean, round(stddev_pop(score), 9) as std, round(quantile_cont(score, 0.25), 9) as p25,
    round(quantile_cont(score, 0.5), 9) as p50, round(quantile_cont(score, 0.75), 9) as p75 from retrieval_hits group by 1"""
)
def reranker_audit(spark, sf):
    hits = table(spark, sf, "retrieval_hits").withColumn("provider", F.coalesce("provider", F.lit("none")))
    return E.score_audit(hits, "score", ["provider"]).drop("warnings")


@R.query("select record_id as ord, case when citations > 5 then greatest(s, 0.55) else least(s, 0.25) end as similarity from (select record_id, citations, round(least(coalesce(citations, 0), 60) / 60.0, 6) s from article_records where citations >= 0)")
def grey_zone_outcome(spark, sf):
    rows = articles(spark, sf).where("citations >= 0").select("ord", "citations", F.round(F.least(F.coalesce("citations", F.lit(0)), F.lit(60)) / 60.0, 6).alias("s"))
    return rows.select("ord", Q.grey_outcome(F.col("citations") > 5, F.col("s")).alias("similarity"))


META = S.MetadataFilter(start_year=2005, end_year=2024, academic_only=True)


@R.query(
    f"""with kept as (select * from article_records where {ACADEMIC} and coalesce(year, 0) between 2005 and 2024),
    k as (select *, case when {DOI_OK} then 'doi' when trim(coalesce(title, '')) != '' then 'title' else 'none' end kind,
      case when {DOI_OK} then trim(doi) when trim(coalesce(title, '')) != '' then lower(trim(title)) else record_id::varchar end key from kept),
    u as (select * from k qualify record_id = min(record_id) over (partition by kind, key, case when kind = 'title' then year end)),
    m as (select *, {_matched()} as matched from u), p as (select * from m where len(list_filter([{sql_list(GATE)}], lambda x: not list_contains(matched, x))) = 0),
    s as (select record_id as ord, title, year, array_to_string(matched, ',') as matched, citations, round(({" + ".join(f"({_SIMPLE[n]})::int" for n in GATE)}) / {len(GATE)}, 4) as coverage, round({_lexical_sql()}, 6) as relevance from p)
    select ord, title, year, matched, coverage, relevance from s order by coverage desc, relevance desc, coalesce(citations, 0) desc, ord limit 20"""
)
def screening_run(spark, sf):
    return screen(articles(spark, sf), META, CONTRACT, PICO)


queries, oracle_sql = (lambda: dict(R.functions)), (lambda: dict(R.statements))
