"""Registered queries over the search queries, and the remaining record predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.operators import query_building as B
from sievemill.operators import retrieval as T
from sievemill.operators import texts as X
from sievemill.plans.registry import Registry, sql_contains_any, sql_list
from sievemill.plans.screening_queries import DOI, articles
from sievemill.runtime import table

R = Registry()
BUCKETS = B.Buckets(
    {
        "P": ("diabetes tipo 2", "hypertension", "asthma attacks", "open-source maintainers", "primary care patients", "migrant families", "early dropout", "chronic kidney disease"),
        "I": ("remote monitoring", "peer support", "audit and feedback", "text-message reminders", "consulta por vídeo", "uso de recordatorios", "stepped care", "nurse-led coaching"),
        "O": ("sleep duration", "emergency visits", "days absent from class", "treatment adherence"),
        "C": ("usual care", "waiting list"),
    },
    generic=("care", "use", "support"),
)
TOK = "list_filter(regexp_extract_all(lower(coalesce(query_text, '')), '[\\p{L}\\p{N}]+'), lambda w: length(w) > 1)"


def _term_sql(term: str) -> str:
    own = list(dict.fromkeys(B._tokens(term)))
    specific = [t for t in own if t not in BUCKETS.generic] or own
    low = f"contains(lower(coalesce(query_text, '')), '{term}')"
    shared = f"len(list_intersect(t, [{sql_list(specific)}]))"
    if len(own) == 1:
        return f"({low} or {shared} > 0)"
    if len(own) == 2:
        return f"({low} or len(list_intersect(t, [{sql_list(own)}])) = 2)"
    return f"({low} or ({shared} >= 2 and {shared} / {len(specific)} >= 0.67))"


_HAS = {c: "(" + " or ".join(_term_sql(t) for t in ts) + ")" for c, ts in BUCKETS.terms.items()}
PROFILE = f"""q as (select query_id, query_text, {TOK} t from search_queries), h as (select *, {", ".join(f"{v} as has_{k}" for k, v in _HAS.items())} from q),
  p as (select query_id, array_to_string(list_sort(list_distinct(t)), ' ') as query_key, array_to_string(list_filter([{", ".join(f"case when has_{k} then '{k}' end" for k in _HAS)}], lambda x: x is not null), '') as categories,
    case when len(t) < 2 then 'too_short' when not has_P then 'missing_population' when not has_I then 'missing_intervention' when has_P::int + has_I::int + has_O::int + has_C::int < 2 then 'single_concept_query' end as rejection,
    case when not (has_P and has_I) then 'other' when has_O::int + has_C::int = 0 then 'core' when has_O::int + has_C::int = 1 then 'focused' else 'exact' end as tier from h)"""


def _profile(spark, sf):
    return B.profile_queries(table(spark, sf, "search_queries").select("query_id", "query_text"), "query_text", BUCKETS)


@R.query(f"with {PROFILE} select query_id, query_key, categories, rejection, tier from p")
def query_profile(spark, sf):
    return _profile(spark, sf).select("query_id", "query_key", F.array_join("categories", "").alias("categories"), "rejection", "tier")


@R.query(
    f"""with {PROFILE}, r as (select query_id, tier, row_number() over (partition by tier order by query_id) r, case tier when 'exact' then 0 when 'focused' then 1 when 'core' then 2 else 3 end o from p),
    f as (select *, r > case tier when 'exact' then 4 when 'focused' then 6 when 'core' then 6 else 2 end as filled from r) select query_id, tier, filled from f order by filled, o, query_id limit 24"""
)
def query_quota_fill(spark, sf):
    return B.quota_and_fill(_profile(spark, sf).select("query_id", "tier"), {"exact": 4, "focused": 6, "core": 6, "other": 2}, 24, "query_id")


@R.query(
    r"""with g as (select query_id, list_filter(list_transform(string_split(regexp_replace(query_text, '["()]', '', 'g'), ' AND '), lambda x: list_transform(string_split(x, ' OR '), lambda y: trim(y))), lambda x: len(x) > 0) c from search_queries where query_text is not null),
    t as (select query_id, list_transform(c, lambda x: list_transform(x, lambda y: case when contains(y, ' ') then '"' || y || '"' else y end || '[tiab]')) c from g)
    select query_id, array_to_string(list_transform(c, lambda x: case when len(x) > 1 then '(' || array_to_string(x, ' OR ') || ')' else array_to_string(x, ' OR ') end), ' AND ') as boolean_query from t"""
)
def boolean_translation(spark, sf):
    flat = F.regexp_replace("query_text", r'["()]', "")
    concepts = F.transform(F.split(flat, " AND "), lambda x: F.transform(F.split(x, " OR "), lambda y: F.trim(y)))
    return table(spark, sf, "search_queries").where("query_text is not null").select("query_id", B.translate_query(concepts, "pubmed").alias("boolean_query"))


_ATOMS = [("a1", "remote monitoring of chronic conditions"), ("a2", "staff workload and cost per contact"), ("a3", "grip strength")]


@R.query(
    f"""with o as (select distinct lower(trim(retrieval_query)) term from article_records where retrieval_query is not null), a(atom, text) as (values {", ".join(f"('{a}', '{t}')" for a, t in _ATOMS)}),
    ow as (select term, length(term) pos, unnest(list_distinct(list_filter(regexp_extract_all(term, '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1))) w from o),
    aw as (select atom, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1))) w from a),
    p as (select distinct atom, term, pos from ow join aw using (w)), r as (select *, row_number() over (partition by atom order by pos, term) r from p) select atom, term, pos from r where r <= 6"""
)
def term_mapping(spark, sf):
    terms = articles(spark, sf).where("retrieval_query is not null").select(F.lower(F.trim("retrieval_query")).alias("term")).distinct()
    return B.map_terms(terms.withColumn("pos", F.length("term")), spark.createDataFrame(_ATOMS, "atom string, text string")).select("atom", "term", "pos")


_OPEN = (
    "arxiv.org europepmc.org pubmedcentral pmc.ncbi biorxiv.org medrxiv.org zenodo.org hal.science hal.archives-ouvertes osf.io aclanthology.org openreview.net eprints. dspace. repository. .ac.uk "
    "escholarship.org engrxiv.org preprints.org semanticscholar.org figshare.com ssrn.com dergipark"
).split()
_CLOSED = "dl.acm.org link.springer.com www.mdpi.com sciencedirect.com wiley.com tandfonline nature.com/articles doi.org downloads.hindawi.com igi-global.com iopscience.iop.org".split()
_LINK = f"coalesce(nullif(trim(coalesce(url, '')), ''), nullif(trim(coalesce(pdf_url, '')), ''), 'https://doi.org/' || ({DOI}))"


@R.query(
    f"""with l as (select record_id as ord, {_LINK} as link, pdf_url from article_records)
    select ord, link, length(trim(coalesce(pdf_url, ''))) <= 10 as needs_pdf, {sql_contains_any("coalesce(link, '')", _OPEN)} as trusted, {sql_contains_any("coalesce(link, '')", _CLOSED)} as paywalled from l"""
)
def link_resolution(spark, sf):
    """Link by fallback, whether a file is still needed, and whether its address is of an open repository or asks for access."""
    link = F.coalesce(F.nullif(C.text("url"), F.lit("")), F.nullif(C.text("pdf_url"), F.lit("")), F.concat(F.lit("https://doi.org/"), C.normal_doi(F.col("doi"))))
    here = F.coalesce("link", F.lit(""))
    rows = articles(spark, sf).select("ord", link.alias("link"), (F.length(C.text("pdf_url")) <= 10).alias("needs_pdf"))
    return rows.withColumns({"trusted": C.contains_any(here, C.OPEN_HOSTS), "paywalled": C.contains_any(here, C.CLOSED_HOSTS)})


_MARKS = (
    "methodology|metodología", "results?|resultados", "discussion|discusión", "references|referencias|bibliography", "introduction|introducción", "conclusion|conclusión", "section|sección",
    r"table\s+\d+|figure\s+\d+|tabla\s+\d+|figura\s+\d+",
)


@R.query("select doc_id, length(text) >= 6500 and " + " + ".join(f"regexp_matches(lower(text), '{m}')::int" for m in _MARKS) + " >= 2 as full_text from documents where text is not null")
def full_text_heuristic(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", C.real_article_text(F.col("text")).alias("full_text"))


_EVASIVE = "no reportado en|no encontrado en|no disponible|no se reporta en|no hay información|sin información|no menciona|no especifica|la columna no|[sin informacion]|no detallada".split("|")


@R.query(f"with a as (select raw_id, lower(trim(coalesce(output, ''))) t from raw_chunks) select raw_id, length(t) < 15 or (length(t) < 180 and {sql_contains_any('t', _EVASIVE)}) as placeholder from a")
def placeholder_answers(spark, sf):
    return table(spark, sf, "raw_chunks").select("raw_id", X.placeholder_answer(F.col("output")).alias("placeholder"))


@R.query(
    """with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings), c as (select label category, arg_min(v, vec_id) centre from e group by 1),
    s as (select vec_id, category, list_cosine_similarity(v, centre) sim from e, c), b as (select *, row_number() over (partition by vec_id order by sim desc, category) r from s),
    k as (select category::varchar category from b where r = 1 and sim >= 0.19) select category, count(*) as n, round(100 * count(*) / (select count(*) from k), 1) as pct, 0 as moved from k group by 1"""
)
def category_table(spark, sf):
    df = table(spark, sf, "embeddings")
    centres = df.groupBy(F.col("label").alias("category")).agg(F.min_by("embedding", "vec_id").alias("centre"))
    got = T.assign_category(df, centres).select(F.col("category").cast("string").alias("category"))
    names = sorted(str(r["category"]) for r in centres.select("category").collect())
    return B.balanced_categories(got, names)


queries, oracle_sql = (lambda: dict(R.functions)), (lambda: dict(R.statements))
