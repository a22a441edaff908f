"""Registered queries: provider records, contract roles and tiers, evidence of atoms, cascade decisions and gold attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.operators import answers as W
from sievemill.operators import contracts as K
from sievemill.operators import evaluation as E
from sievemill.operators import judging as J
from sievemill.operators.atoms import Atom
from sievemill.operators.scoring import parse_verdict
from sievemill.plans.ranking_queries import JUDGE, _answers
from sievemill.plans.registry import Registry, sql_contains_any, sql_list
from sievemill.plans.screening_queries import articles
from sievemill.runtime import table
from sievemill.sources import providers as P
from sievemill.sources.ingest import inverted_index

R = Registry()
_WORTH = f"t != '' and not {sql_contains_any('lower(t)', C.NOISE_TITLES)} and (length(a) >= 150 or length(trim(d)) > 5 or length(t) >= 25)"
_ROWS = "select record_id, coalesce(title, '') t, coalesce(abstract, '') a, coalesce(doi, '') d, coalesce(paper_id, '') p, openalex_id o, journal j, coalesce(year, 0) y, coalesce(citations, 0) c, authors, language from article_records"


@R.query(
    f"""with r as ({_ROWS}), k as (select *, case when p != '' then p else left(t, 60) end as key, row_number() over (partition by case when p != '' then p else left(t, 60) end order by record_id) n from r where {_WORTH})
    select key, t as title, case when a = '' then 'No abstract available.' else a end as abstract, y as year, d as doi, nullif(j, '') as journal,
    case when d != '' then 'https://doi.org/' || d when p != '' then 'https://europepmc.org/article/MED/' || p else '' end as url, c as citations from k where n = 1"""
)
def europe_pmc_records(spark, sf):
    """The records as Europe PMC results, brought back to articles."""
    landed = articles(spark, sf).select(
        "ord", "title", F.col("abstract").alias("abstractText"), "doi", F.col("paper_id").alias("pmid"), F.col("year").cast("string").alias("pubYear"), F.array_join("authors", ", ").alias("authorString"),
        F.struct(F.struct(F.col("journal").alias("title")).alias("journal")).alias("journalInfo"), F.col("citations").alias("citationCount"), "language",
    )
    return P.europe_pmc_articles(landed, "ord").select("key", "title", "abstract", "year", "doi", "journal", "url", "citations")


@R.query(
    f"""with r as (select * replace (array_to_string(list_filter(string_split_regex(trim(a), '\\s+'), lambda w: w != ''), ' ') as a, replace(d, 'https://doi.org/', '') as d), d as raw from ({_ROWS})),
    k as (select *, row_number() over (partition by o order by record_id) n from r where o is not null and {_WORTH})
    select o as key, t as title, case when a = '' then 'No abstract available.' else a end as abstract, y as year, d as doi, j as journal, case when raw != '' then raw else o end as url, c as citations, coalesce(authors[1], '') as first_author from k where n = 1"""
)
def openalex_records(spark, sf):
    """The records as OpenAlex works, abstracts as inverted indexes, brought back to articles."""
    names = F.transform(F.filter("authors", lambda a: a.isNotNull() & (a != "")), lambda a: F.struct(F.struct(a.alias("display_name")).alias("author")))
    landed = articles(spark, sf).where("openalex_id is not null").select(
        "ord", F.col("openalex_id").alias("id"), F.col("title").alias("display_name"), inverted_index(F.col("abstract")).alias("abstract_inverted_index"), "doi", F.col("year").alias("publication_year"), names.alias("authorships"),
        F.struct(F.struct(F.col("journal").alias("display_name")).alias("source")).alias("primary_location"), F.struct(F.col("pdf_url").alias("oa_url")).alias("open_access"), F.col("citations").alias("cited_by_count"), "language",
    )
    return P.openalex_articles(landed, "ord").select("key", "title", "abstract", "year", "doi", "journal", "url", "citations", F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("")).alias("first_author"))


@R.query(
    f"""with r as ({_ROWS}) select record_id::varchar as key, t as title, a as abstract, y as year, d as doi, case when d != '' then 'https://doi.org/' || d else 'https://pubmed.ncbi.nlm.nih.gov/' || record_id end as url,
    case when language is null then 'eng' else language end as language from r where length(a) >= 100"""
)
def pubmed_records(spark, sf):
    """The records as PubMed citations, abstracts in parts, brought back to articles."""
    landed = articles(spark, sf).select(
        F.col("ord").alias("pmid"), "title", F.split(F.coalesce("abstract", F.lit("")), " ").alias("abstract_parts"), F.col("year").cast("string").alias("year"), "journal", F.when(F.col("language").isNotNull(), F.array("language")).alias("languages"),
        F.array(F.struct(F.lit("pii").alias("kind"), F.lit("x").alias("value")), F.struct(F.lit("doi").alias("kind"), F.col("doi").alias("value"))).alias("ids"),
    )
    return P.pubmed_articles(landed).select("key", "title", "abstract", "year", "doi", "url", "language")


_ATOMS = [("a1", "remote care"), ("a2", "chronic disease"), ("a3", "adherence")]
_STATE = {
    "a1": "case when length(coalesce(chunk, '')) > 300 and trim(coalesce(left(output, 20), '')) != '' then 'met' else 'unclear' end",
    "a2": "case when raw_id % 2 = 0 then 'met' else 'not_met' end",
    "a3": "'unclear'",
}


def _evaluated(spark, sf):
    cell = lambda a, status, evidence: F.struct(F.lit(a).alias("id"), status.alias("status"), evidence.alias("evidence"), F.lit("").alias("reason"))
    out = F.coalesce(F.substring("output", 1, 20), F.lit(""))
    cells = F.array(
        cell("a1", F.when(F.length("chunk") > 300, "Met").otherwise("unclear"), out), cell("a2", F.lit("unclear"), F.lit("")),
        cell(" a2", F.when(F.col("raw_id") % 2 == 0, "met").otherwise("not_met"), F.lit("row")),
    )
    df = table(spark, sf, "raw_chunks")
    return df.select("raw_id", F.concat(F.lit("```json\n"), F.to_json(F.struct(cells.alias("atom_evaluations"))), F.lit("\n```")).alias("response"))


@R.query(
    f"""with s as (select raw_id, [{", ".join(_STATE[a] for a, _ in _ATOMS)}] st from raw_chunks)
    select raw_id, array_to_string(st, ',') as states, round(len(list_filter(st, lambda x: x = 'met')) / 3, 6) as atom_score,
    array_to_string(list_filter([case when st[1] != 'met' then 'remote care' end, case when st[2] != 'met' then 'chronic disease' end, case when st[3] != 'met' then 'adherence' end], lambda x: x is not null), ',') as missing from s"""
)
def atom_guard(spark, sf):
    rows = J.atom_guard(_evaluated(spark, sf), _ATOMS)
    return rows.select("raw_id", F.array_join("atom_states", ",").alias("states"), F.round("atom_score", 6).alias("atom_score"), F.array_join("missing_atoms", ",").alias("missing"))


@R.query(
    f"""with {JUDGE}, m as (select v.*, b.population and b.intervention and b.study_design as core, not v.passed and v.share >= 0.5 as near, v.raw_id % 5 = 0 as lacks from v join b using (raw_id)),
    k as (select *, passed or ((near or decision = 'BACKGROUND_ONLY') and core) as included from m)
    select raw_id, included, case when passed then 'DIRECT_INCLUDED' when included then 'BACKGROUND_ONLY' else decision end as bucket,
    case when passed then null when included then 'Borderline: Revisar a profundidad' when lacks then 'Faltan atomos obligatorios: adherence' else 'said so' end as reason from k"""
)
def cascade_bucket(spark, sf):
    body = C.json_object(F.col("response"))
    rows = parse_verdict(_answers(spark, sf)).withColumns({c: F.get_json_object(body, f"$.{c}") for c in ("population", "intervention", "study_design")})
    rows = rows.withColumns({"missing_atoms": F.when(F.col("raw_id") % 5 == 0, F.array(F.lit("adherence"))).otherwise(F.array().cast("array<string>")), "justification": F.lit("said so")})
    return J.cascade_bucket(rows).select("raw_id", "included", "bucket", "reason")


_STAGES = {
    "metadata": "coalesce(year, 0) >= 2005", "dedup": "record_id % 11 != 0", "screening_pool": "length(coalesce(abstract, '')) >= 200", "cascade": "record_id % 13 != 0", "stage1": "coalesce(citations, 0) >= 1",
    "stage4_input": "record_id % 17 != 0",
}
_WHY = {
    "metadata": "'Excluido por filtros de año/calidad academica.'", "dedup": "'Eliminado como duplicado antes de la cascada.'", "screening_pool": "coalesce(own, 'Excluido por prefiltro conceptual.')",
    "cascade": "'No fue evaluado por el limite de cascada.'", "stage1": "coalesce(own, 'Excluido en Stage 1.')", "stage4_input": "'No llego a Stage 4.'",
}


@R.query(
    f"""with s as (select record_id, record_id % 3 = 0 as gold, case when record_id % 4 = 0 then 'own reason' end as own, {", ".join(f"{v} as {k}" for k, v in _STAGES.items())}, record_id % 2 = 0 as judged from article_records),
    k as (select *, {" and ".join(_STAGES)} and judged as kept from s)
    select record_id::varchar as row_id, case when kept then 'false_positive' else 'false_negative' end as kind,
    case when kept then 'El pipeline lo retuvo, pero el gold standard es 0.' {" ".join(f"when not {k} then {v}" for k, v in _WHY.items())} else coalesce(own, 'Excluido en Stage 4.') end as reason
    from k where (kept and not gold) or (not kept and gold)"""
)
def gold_attribution(spark, sf):
    rows = table(spark, sf, "article_records").withColumns({k: F.expr(v) for k, v in _STAGES.items()})
    kept = F.expr(" and ".join(_STAGES) + " and record_id % 2 = 0")
    rows = rows.select(F.col("record_id").cast("string").alias("row_id"), F.when(F.col("record_id") % 3 == 0, 1).otherwise(0).alias("label"), F.when(F.col("record_id") % 4 == 0, "own reason").alias("reason"), *_STAGES, kept.alias("kept"))
    return J.gold_attribution(rows)


_T = "trim(coalesce(text, ''))"


@R.query(
    f"""with s as (select case when length({_T}) >= 100 then {_T} else '' end as src, case when length({_T}) >= 100 then 'local_csv_pdf' else 'abstract_proxy' end as text_source from documents),
    c as (select text_source, length(case when length(src) <= 9000 then src else rtrim(left(src, 6120)) || chr(10) || chr(10) || '[... texto recortado para acelerar evaluacion interna ...]' || chr(10) || chr(10) || ltrim(right(src, 2880)) end) n from s)
    select text_source, count(*) as n, round(avg(n), 0) as mean_chars, max(n) as most_chars from c group by 1"""
)
def text_preparation(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("text").alias("full_text"), F.lit("").alias("abstract"))
    return J.text_statistics(J.prepared_text(rows))


@R.query("select record_id as ord, coalesce(citations, 0) as citations, coalesce(year, 0) as year from article_records order by coalesce(citations, 0) desc, length(coalesce(title, '')) desc, coalesce(year, 0) desc, record_id limit 100")
def citation_order(spark, sf):
    rows = articles(spark, sf).select("ord", "citations", "year", F.length(F.coalesce("title", F.lit(""))).alias("relevance"))
    return K.citation_order(rows).limit(100).select("ord", F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("year", F.lit(0)).alias("year"))


@R.query(
    "select record_id as ord from article_records order by record_id % 5 desc, length(coalesce(title, '')) desc, record_id % 7 desc, record_id % 2 desc, coalesce(citations, 0) desc, record_id limit 100"
)
def cascade_order(spark, sf):
    rows = articles(spark, sf).select("ord", "citations", F.length(F.coalesce("title", F.lit(""))).alias("relevance"), *((F.col("ord") % k).alias(c) for c, k in (("coverage", 5), ("n_matched", 7), ("bonus", 2))))
    return K.cascade_order(rows).limit(100).select("ord")


@R.query(
    "select record_id as ord, (record_id % 5)::bigint as coverage from article_records where length(coalesce(abstract, '')) < 500 order by record_id % 5 desc, coalesce(year, 0) desc, coalesce(citations, 0) desc, record_id limit 6"
)
def recovery_seeds(spark, sf):
    rows = articles(spark, sf).where(F.length(F.coalesce("abstract", F.lit(""))) < 500).select("ord", (F.col("ord") % 5).alias("coverage"), F.col("year").alias("relevance"), "citations")
    return K.recovery_seeds(rows).select("ord", "coverage")





@R.query(
    """select doc_id, md5(translate(replace(replace(replace(replace(replace(replace(replace(replace(text, '≤', '<='), '≥', '>='), '→', '->'), '←', '<-'), '±', '+/-'), '°', ' grados'), '²', '^2'), '³', '^3'),
    '×÷•–—‘’“”', 'x/---' || chr(39) || chr(39) || '""')) as plain from documents where text is not null"""
)
def plain_punctuation(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(C.plain_punctuation(F.col("text"))).alias("plain"))


@R.query(
    """select record_id as ord, case when coalesce(abstract, '') != '' then coalesce(title, '') || '. ' || left(abstract, 1500) else coalesce(title, '') end as content,
    case when length(abstract) > 1000 then left(abstract, 150000) else title end as context from article_records"""
)
def embedding_content(spark, sf):
    a, t = F.col("abstract"), F.col("title")
    return articles(spark, sf).select("ord", C.embedding_text(t, a, F.lit(None).cast("string")).alias("content"), C.short_context(t, a).alias("context"))


@R.query(
    """with u as (select record_id as ord, case when record_id % 3 = 0 then 'https://ieeexplore.ieee.org/document/' || record_id when record_id % 3 = 1 then 'https://ieeexplore.ieee.org/stamp/stamp.jsp?arnumber=' || record_id else url end as url from article_records),
    n as (select *, case when contains(url, 'ieee.org') then ord::varchar end as k from u)
    select ord, case when k is null then url else url || ' ' || 'https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?tp=&arnumber=' || k || '&ref=' || ' ' || 'https://ieeexplore.ieee.org/stamp/stamp.jsp?tp=&arnumber=' || k
      || case when ord % 3 = 1 then '' else ' ' || 'https://ieeexplore.ieee.org/stamp/stamp.jsp?arnumber=' || k end end as links from n where url is not null"""
)
def pdf_links(spark, sf):
    host, n = "https://ieeexplore.ieee.org/", F.col("ord").cast("string")
    url = F.when(F.col("ord") % 3 == 0, F.concat(F.lit(host + "document/"), n)).when(F.col("ord") % 3 == 1, F.concat(F.lit(host + "stamp/stamp.jsp?arnumber="), n)).otherwise(F.col("url"))
    rows = articles(spark, sf).select("ord", url.alias("url")).where("url is not null")
    return rows.select("ord", F.array_join(C.ieee_links(F.col("url")), " ").alias("links"))


@R.query("select query_id, array_to_string(list_filter(list_transform(string_split(query_text, ' '), lambda x: trim(x)), lambda x: length(x) > 3 or (length(x) = 3 and not (x = upper(x) and x != lower(x)))), '|') as terms from search_queries where query_text is not null")
def safe_terms(spark, sf):
    rows = table(spark, sf, "search_queries").where("query_text is not null")
    return rows.select("query_id", F.array_join(K.safe_terms(F.split("query_text", " ")), "|").alias("terms"))


ATOMS = (
    Atom("published between 2010 and 2020", ("2010-2020",), "I", required=True), Atom("hypertension", ("hypertension", "diabetes tipo 2", "type 2 diabetes"), "P", required=True),
    Atom("remote care", ("remote monitoring", "telephone follow-up", "consulta por vídeo"), "I", required=True, central=True), Atom("reminders", ("text-message reminders", "uso de recordatorios"), "I", required=True),
    Atom("costs", ("cost per contact",), "O"),
)


def _says(terms) -> str:
    every = sorted({v for t in terms for v in (t, t.replace("-", " "), t.replace(" ", "-"))})
    return "(" + " or ".join(f"regexp_matches(q, '(^|[^a-z0-9]){v}($|[^a-z0-9])')" for v in every) + ")"


@R.query(
    f"""with s as (select record_id, lower(regexp_replace(coalesce(retrieval_query, '') || ' ' || coalesce(title, ''), '\\s+', ' ', 'g')) q from article_records),
    f as (select record_id, {_says([*ATOMS[1].terms])} p, {_says([*ATOMS[2].terms, "remote care"])} c, {_says([*ATOMS[3].terms, "reminders"])} t from s)
    select record_id as ord, case when p and c and t then 'exact' end as tier from f"""
)
def query_tiers(spark, sf):
    """Tiers of queries with the titles that they found; with one technical atom there is no focused tier."""
    text = F.concat(F.coalesce("retrieval_query", F.lit("")), F.lit(" "), F.coalesce("title", F.lit("")))
    return articles(spark, sf).select("ord", K.query_tier(text, ATOMS).alias("tier"))


_FOUND = {"hypertension": ("high blood pressure",), "reminders": ("sms reminders",)}
_EMPIRICAL = [
    "high blood pressure|remote monitoring|sms reminders", "high blood pressure|remote monitoring|text-message reminders", "high blood pressure|remote monitoring|uso de recordatorios", "high blood pressure|remote monitoring|",
    "high blood pressure|telephone follow-up|sms reminders", "high blood pressure|telephone follow-up|text-message reminders", "high blood pressure|telephone follow-up|uso de recordatorios", "high blood pressure|telephone follow-up|",
    "high blood pressure|consulta por vídeo|sms reminders", "high blood pressure|consulta por vídeo|text-message reminders", "high blood pressure|consulta por vídeo|uso de recordatorios", "high blood pressure|consulta por vídeo|",
]


@R.query("select * from (values " + ", ".join(f"('{' '.join(x for x in q.split('|') if x)}', '{'core' if q.endswith('|') else 'focused'}')" for q in _EMPIRICAL) + ") t(query, tier)")
def empirical_queries(spark, sf):
    return spark.createDataFrame(K.empirical_queries(ATOMS, _FOUND), "query string, tier string")


@R.query(
    """with e as (select vec_id as ord, list_transform(embedding, lambda x: x::double) v from embeddings), s as (select ord, round(v[1], 6) l, round(v[2], 6) d from e), r as (select *, row_number() over (order by l desc, ord) n from s)
    select ord, case when n <= 150 then d else 0.0 end as dense from r"""
)
def lexical_preselection(spark, sf):
    v = lambda k: F.round(F.element_at("embedding", k).cast("double"), 6)
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), v(1).alias("lexical"), v(2).alias("dense"))
    return K.preselect(rows, "lexical", "dense", 150).select("ord", "dense")


@R.query("select query_id::varchar as id, null::varchar as title, null::varchar as doi, max(score) as similarity, null::varchar as llm_reason from retrieval_hits where score is not null group by 1")
def audit_projection(spark, sf):
    rows = table(spark, sf, "retrieval_hits").where("score is not null").groupBy(F.col("query_id").cast("string").alias("id")).agg(F.max("score").alias("similarity"))
    return J.audit_projection(rows).select("id", "title", "doi", "similarity", "llm_reason")


_DOM = {
    "machine_learning": "machine learning|deep learning|neural network|algoritmo|modelo de aprendizaje|clasificación|predicción|inteligencia artificial|ia", "healthcare": "salud|medicina|paciente|clínico|diagnóstico|tratamiento|enfermedad|diabetes|cáncer|health",
    "education": "educación|aprendizaje|estudiante|enseñanza|pedagogía|e-learning|educational|learning", "vr_ar": "realidad virtual|realidad aumentada|vr|ar|inmersivo|simulación|virtual reality",
    "software_engineering": "software|desarrollo|programación|código|testing|arquitectura|metodología ágil", "social_sciences": "social|comportamiento|actitud|percepción|cualitativo|etnografía|entrevista",
}
_COUNT = lambda words: "(" + " + ".join(f"contains(q, '{w}')::int" for w in words.split("|")) + ")"


@R.query(
    f"""with s as (select query_id, lower(coalesce(query_text, '')) q from search_queries), c as (select query_id, unnest([{", ".join(f"{{'n': {_COUNT(w)}, 'o': {-k}, 'd': '{d}'}}" for k, (d, w) in enumerate(_DOM.items()))}]) x from s)
    select query_id, arg_max(x.d, x.n * 100 + x.o) as domain from c group by 1"""
)
def question_domain(spark, sf):
    return table(spark, sf, "search_queries").select("query_id", K.question_domain(F.col("query_text")).alias("domain"))


_SHARES = "select coalesce(nullif(trim(journal), ''), 'sin') as journal, count(*) n from article_records group by 1"


@R.query(
    f"""with s as ({_SHARES}), p as (select journal as label, round(100.0 * n / (select sum(n) from s), 1) pct from s), t as (select * from p order by pct desc, label limit 2), r as (select 'otras revistas' as label, round(100 - sum(pct), 1) as pct from t)
    select * from t union all select * from r where pct > 0.5"""
)
def journal_shares(spark, sf):
    rows = articles(spark, sf).groupBy(F.coalesce(F.nullif(F.trim("journal"), F.lit("")), F.lit("sin")).alias("journal")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").alias("t"))
    shares = rows.join(F.broadcast(total)).select("journal", F.round(100 * F.col("n") / F.col("t"), 1).alias("pct"))
    return E.head_and_rest(shares, "journal", "pct")


@R.query(
    """with s as (select doc_kind k, round(100.0 * count(*) / (select count(*) from documents), 1) p from documents group by 1), o as (select k, p, row_number() over (order by p desc, k) i, count(*) over () n from s)
    select string_agg(case when i = 1 then 'el ' || format('{:.1f}', p) || '% son de tipo ' || k when i = n then 'y el ' || format('{:.1f}', p) || '% en ' || k else 'el ' || format('{:.1f}', p) || '% en ' || k end, ', ' order by i) as sentence from o"""
)
def share_sentence(spark, sf):
    rows = table(spark, sf, "documents").groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").alias("t"))
    return E.share_sentence(rows.join(F.broadcast(total)).select("doc_kind", F.round(100 * F.col("n") / F.col("t"), 1).alias("pct")), "doc_kind", "pct", "son de tipo")


@R.query(r"select record_id as ord, coalesce(case when year between 1000 and 9999 then year end, regexp_extract(retrieval_date, '^(\d{4})', 1)::int) as year, greatest(1, least(50, coalesce(citations, 7))) as bounded from article_records")
def year_fields(spark, sf):
    return articles(spark, sf).select("ord", C.first_year(F.col("year"), F.col("retrieval_date")).alias("year"), C.bounded_int(F.col("citations").cast("string"), 7, 1, 50).alias("bounded"))


_BULLET = "case when contains(r, '•') then substr(r, instr(r, '•')) when contains(r, chr(10) || chr(10)) then array_to_string(string_split(r, chr(10) || chr(10))[-2:], chr(10) || chr(10)) else r end"


@R.query(
    f"""with s as (select raw_id, case raw_id % 4 when 0 then '<analisis>1. x</analisis> ' || coalesce(output, '') when 1 then '<analisis>1. x • ' || coalesce(output, '') when 2 then '<analisis>a' || chr(10) || chr(10) || 'b' || chr(10) || chr(10) || coalesce(output, '') else output end c from raw_chunks),
    p as (select raw_id, c, list_last(string_split(c, '<analisis>')) r from s),
    b as (select raw_id, case when contains(c, '<analisis>') and contains(c, '</analisis>') then trim(string_split(c, '</analisis>')[2]) when contains(c, '<analisis>') then trim({_BULLET}) else c end b from p)
    select raw_id, case when not contains(b, '[EVIDENCIA') and not contains(b, '[CONTEXTO') and length(b) > 40 then '⚠️ [Aviso: Trazabilidad no etiquetada]' || chr(10) || b else b end as answer from b"""
)
def traced_answers(spark, sf):
    out, k = F.coalesce("output", F.lit("")), F.col("raw_id") % 4
    text = F.when(k == 0, F.concat(F.lit("<analisis>1. x</analisis> "), out)).when(k == 1, F.concat(F.lit("<analisis>1. x • "), out)).when(k == 2, F.concat(F.lit("<analisis>a\n\nb\n\n"), out)).otherwise(F.col("output"))
    return table(spark, sf, "raw_chunks").select("raw_id", W.traced(text).alias("answer"))


@R.query(
    """with o as (select distinct lower(trim(retrieval_query)) t from article_records where retrieval_query is not null), q as (select query_id, lower(trim(query_text)) t from search_queries where query_text is not null),
    a as (select 'atom ' || (query_id % 3) as id, t as term, 0 as pos from q union all select 'atom ' || (query_id % 3), 'invented term', 1 from q)
    select id, term, min(pos) as pos from a where term in (select t from o where t != '') group by 1, 2"""
)
def mapped_terms(spark, sf):
    """Answers that map queries to three atoms; what was not observed is dropped."""
    atom = F.concat(F.lit("atom "), (F.col("query_id") % 3).cast("string"))
    body = F.to_json(F.struct(F.array(F.struct(atom.alias("id"), F.array("query_text", F.lit("invented term")).alias("terms"))).alias("atoms")))
    answers = table(spark, sf, "search_queries").where("query_text is not null").select(F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("response"))
    observed = articles(spark, sf).where("retrieval_query is not null").select(F.col("retrieval_query").alias("term"))
    return W.mapped_terms(answers, observed)


queries, oracle_sql = (lambda: dict(R.functions)), (lambda: dict(R.statements))
__all__ = ["oracle_sql", "queries", "sql_list"]
