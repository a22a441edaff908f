"""Registered queries: evaluation, statistics, bibliographic formatting, ingest shapes, texts, sinks and incremental windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.operators import evaluation as E
from sievemill.operators import texts as X
from sievemill.plans.registry import Registry, sql_contains_any, sql_first_of, sql_list
from sievemill.plans.screening_queries import ACADEMIC, DOI, DOI_OK, TOKENS, articles
from sievemill.runtime import table
from sievemill.sources import ingest as I
from sievemill.sources import sinks as K
from sievemill.streaming.incremental import progress_windows, sessions

R = Registry()
CONTENT = "lower(concat(coalesce(title, ''), ' ', coalesce(abstract, '')))"


def _content():
    return F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))


LABELS = "l as (select doc_id, min(toxic) lo, max(toxic) hi from labels group by 1)"


@R.query(
    f"""with {LABELS}, p as (select coalesce(doc_kind, 'none') kind, lo = 1 as truth, contains(lower(text), 'you') as said from documents join l using (doc_id) where lo = hi),
    c as (select kind, count_if(truth and said) tp, count_if(not truth and said) fp, count_if(not truth and not said) tn, count_if(truth and not said) fn from p group by 1)
    select kind, tp, fp, tn, fn, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 4) as "precision", round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 4) as recall,
    round((tp + tn) / (tp + fp + tn + fn), 4) as accuracy, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 4) as f1 from c"""
)
def confusion_by_stage(spark, sf):
    lab = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).where("lo = hi")
    rows = table(spark, sf, "documents").where("text is not null").join(lab, "doc_id").select(
        F.coalesce("doc_kind", F.lit("none")).alias("kind"), (F.col("lo") == 1).alias("truth"), F.lower("text").contains("you").alias("said")
    )
    return E.confusion(rows, ["kind"])


INCLUDE = ["telephone follow-up", "grip strength", "staff workload", "test anxiety", "nurse-led coaching", "static analysis"]
EXCLUDE = ["sleep apnoea", "asthma"]
RANKED = "r as (select title, abstract, row_number() over (order by record_id) rank from article_records)"
TA = "lower(concat_ws(' ', coalesce(title, ''), coalesce(abstract, '')))"


def _ranked(spark, sf):
    """A ranked list: the retrievals in order; their ids are dense, so the id is the rank."""
    return articles(spark, sf).select(F.col("ord").alias("rank"), "title", "abstract")


_FIRST = " union all ".join(f"select min(case when contains({TA}, '{t}') then rank end) i, min(case when contains(lower(coalesce(title, '')), '{t}') then rank end) t from r" for t in INCLUDE)


@R.query(
    f"""with {RANKED}, f as ({_FIRST}), n as (select max(rank) n from r), c as (select unnest([10, 20, 50, 100]) as cutoff),
    x as (select cutoff, (select count(*) from r where rank <= cutoff and {sql_contains_any(TA, EXCLUDE)}) bad, (select count(*) from f where i <= cutoff) found, (select count(*) from f where t <= cutoff) heads from c),
    y as (select *, least(cutoff, n) size, found / least(cutoff, n) p, found / {len(INCLUDE)} rc from x, n)
    select cutoff, found, round(rc, 4) as recall, round(p, 4) as "precision", round(case when p + rc = 0 then 0 else 5 * p * rc / (4 * p + rc) end, 4) as f_beta, round(bad / size, 4) as noise, heads as title_hits from y"""
)
def ranked_eval(spark, sf):
    return E.ranked_list_metrics(_ranked(spark, sf), INCLUDE, EXCLUDE)


@R.query(f"with {RANKED}, f as ({_FIRST}), n as (select max(rank) n from r), k as (select list_sort(list(i) filter (i is not null)) l from f), a as (select case when len(l) >= 6 then l[6] end as hit from k) select hit as rank, round(greatest(0, 0.95 - hit / n), 6) as wss from a, n")
def wss95(spark, sf):
    return E.work_saved(_ranked(spark, sf), INCLUDE)


_TYPE = sql_first_of(CONTENT, C.STUDY_TYPES, "null")
_MIX = sql_first_of(CONTENT, C.METHOD_MIX, "'Otros enfoques metodologicos'")
_SIZE = "coalesce(" + ", ".join(f"try_cast(nullif(regexp_extract({CONTENT}, '{p}', 1, 'i'), '') as bigint)" for p in C.SAMPLE_SIZES) + ")"


@R.query(f"select record_id as ord, {_TYPE} as study_type, {_SIZE} as sample_size from article_records")
def study_type_and_size(spark, sf):
    return articles(spark, sf).select("ord", C.study_type(_content()).alias("study_type"), C.sample_size(_content()).alias("sample_size"))


@R.query(f"select {_MIX} as method, count(*) as n, round(100 * count(*) / (select count(*) from article_records), 1) as pct from article_records group by 1")
def method_mix(spark, sf):
    rows = articles(spark, sf).select(C.method_mix(_content()).alias("method"))
    total = rows.agg(F.count(F.lit(1)).alias("t"))
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("method", "n", F.round(100 * F.col("n") / F.col("t"), 1).alias("pct"))


THEMES = ("monitoring", "coaching", "screening", "education", "rehabilitation", "triage")


@R.query(
    f"""with x as (select 'year' dim, case when year is null or length(year::varchar) != 4 then 'N/D' else year::varchar end label from article_records
      union all select 'journal', coalesce(nullif(journal, ''), 'Otros') from article_records union all select 'method', {_MIX} from article_records
      union all select 'theme', t from article_records, (select unnest([{sql_list(THEMES)}]) t) where regexp_matches({CONTENT}, '(^|[^a-zA-Z0-9_])' || t || '($|[^a-zA-Z0-9_])')),
    c as (select dim, label, count(*) n from x group by 1, 2), r as (select *, row_number() over (partition by dim order by n desc, label) r from c)
    select dim, label, n, round(100 * n / (select count(*) from article_records), 1) as pct from r where r <= 10"""
)
def corpus_dimensions(spark, sf):
    year = F.when(F.length(F.col("year").cast("string")) == 4, F.col("year").cast("string")).otherwise("N/D")
    # a word is looked for plainly before its boundaries are
    whole = lambda t: F.col("t").contains(t) & F.col("t").rlike(rf"(?<![a-zA-Z0-9_]){t}(?![a-zA-Z0-9_])")
    rows = articles(spark, sf).select(year.alias("year"), F.coalesce(F.nullif(F.col("journal"), F.lit("")), F.lit("Otros")).alias("journal"), _content().alias("t"))
    rows = rows.select("year", "journal", C.method_mix(F.col("t")).alias("method"), *(whole(t).alias(f"is_{t}") for t in THEMES))
    themes = F.array_compact(F.array(*(F.when(F.col(f"is_{t}"), F.lit(t)) for t in THEMES)))
    return E.dimension_counts(rows, {"year": F.array("year"), "journal": F.array("journal"), "method": F.array("method"), "theme": themes})


@R.query(
    f"""with k as (select record_id, row_number() over (partition by case when {DOI_OK} then trim(doi) else 'r' || record_id end order by record_id) = 1 as u, contains({CONTENT}, 'remote') or contains({CONTENT}, 'telephone') as c,
      {ACADEMIC} and coalesce(year, 0) >= 2008 as m from article_records)
    select count(*) as raw, count_if(not u) as duplicates, count_if(u and not c) as concept_discarded, count_if(u and c) as candidates, count_if(u and c and not m) as metadata_discarded, count_if(u and c and m) as final from k"""
)
def prisma_flow_counts(spark, sf):
    rows = articles(spark, sf).select("ord", "doi", "year", "journal", "venue", _content().alias("t"))
    key = F.when(C.valid_doi(F.col("doi")), C.text("doi")).otherwise(F.concat(F.lit("r"), F.col("ord").cast("string")))
    firsts = rows.groupBy(key.alias("k")).agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("u"))
    flags = rows.join(firsts, "ord", "left").select(
        F.coalesce("u", F.lit(False)).alias("is_unique"), C.contains_any(F.col("t"), ("remote", "telephone")).alias("concept_ok"),
        (C.academic_venue(F.col("journal"), F.col("venue"), F.col("year")) & (F.coalesce(F.col("year"), F.lit(0)) >= 2008)).alias("metadata_ok"),
    )
    return E.flow_counts(flags)


_KNOWN = (
    "pubmed|PubMed|database,semantic scholar|Semantic Scholar|database,openalex|OpenAlex|database,europe pmc|Europe PMC|database,arxiv|arXiv|repository,biorxiv|bioRxiv|repository,medrxiv|medRxiv|repository,"
    "bmc|BMC|publisher,plos|PLOS|publisher,frontiers|Frontiers|publisher,mdpi|MDPI|publisher,springer|Springer|publisher,elsevier|Elsevier|publisher,sciencedirect|ScienceDirect|publisher,"
    "wiley|Wiley|publisher,taylor & francis|Taylor & Francis|publisher,sage|SAGE|publisher"
)
_CASE = "case " + " ".join(f"when contains(l, '{p}') then {{{i}}}" for i, p in enumerate(x.split("|")[0] for x in _KNOWN.split(","))) + " when contains(l, 'preprint') then {p} when length(v) between 3 and 50 then {o} end"


def _case(k: int) -> str:
    cells = [x.split("|") for x in _KNOWN.split(",")]
    return _CASE.format(*(f"'{c[k]}'" for c in cells), p=("'arXiv'", "'repository'")[k - 1], o=("trim(v)", "'publisher'")[k - 1])


@R.query(
    f"""with v as (select record_id, f, v, lower(trim(v)) l from (select record_id, unnest(['s', 'u', 'p', 'j']) f, unnest([source, url, pdf_url, journal]) v from article_records) where v is not null),
    k as (select distinct record_id, f = 'j' as j, {_case(1)} as name, {_case(2)} as kind from v where l not in ('', 'unknown')),
    d as (select distinct record_id, name, kind from k where name is not null and (not j or kind = 'publisher'))
    select kind, name, count(*) as n from d where kind != 'publisher' or length(name) <= 50 group by 1, 2"""
)
def source_taxonomy(spark, sf):
    """Sources by canonical name and kind over the source, address and journal of each article; journals can only be publishers."""
    fields = ("source", "url", "pdf_url")
    cells = F.array(*(C.source_kind(F.col(f)) for f in fields), C.source_kind(F.col("journal"), publishers_only=True))
    rows = articles(spark, sf).select("ord", *fields, "journal").select(F.explode(F.array_distinct(F.filter(cells, lambda x: x.isNotNull()))).alias("x"))
    return rows.groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("n")).select("kind", "name", "n")


@R.query(
    """with s as (select case when length(trim(coalesce(pdf_url, ''))) > 10 then 'pdf_direct' when length(trim(coalesce(abstract, ''))) >= 500 then 'abstract_proxy' when trim(coalesce(doi, '')) != '' then 'manual_pending' else 'failed' end as status from article_records),
    l(status, label) as (values ('pdf_direct', 'PDF descargado (directo)'), ('abstract_proxy', 'Abstract proxy (degradado)'), ('manual_pending', 'Pendiente upload manual'), ('failed', 'Sin fuente disponible'))
    select status, label, count(*) as n, round(100 * count(*) / (select count(*) from s), 1) as pct from s join l using (status) group by 1, 2"""
)
def acquisition_status(spark, sf):
    status = F.when(F.length(C.text("pdf_url")) > 10, "pdf_direct").when(F.length(C.text("abstract")) >= 500, "abstract_proxy").when(C.text("doi") != "", "manual_pending").otherwise("failed")
    return E.acquisition_report(articles(spark, sf).select(status.alias("status")))


SURNAME = "case when contains(trim({0}), ',') then trim(split_part(trim({0}), ',', 1)) else list_last(string_split_regex(trim({0}), '\\s+')) end"


def _sn(x: str) -> str:
    return SURNAME.replace("{0}", x)


_NAMES = "list_filter(coalesce(authors, []), lambda x: trim(x) != '')"
_WHO = f"case when len(n) = 0 then 'Autor desconocido' when len(n) = 1 then {_sn('n[1]')} when len(n) = 2 then {_sn('n[1]')} || ' y ' || {_sn('n[2]')} else {_sn('n[1]')} || ' et al.' end"
_WHEN = "case when coalesce(year, 0) > 0 then year::varchar else 's.f.' end"


@R.query(
    f"""with a as (select *, {_NAMES} n, {DOI} d from article_records) select record_id as ord, {_WHO} || ' (' || {_WHEN} || ')' as narrative,
    trim(concat_ws(' ', case when len(n) = 0 then 'Autor desconocido' else array_to_string(n[1:20], ', ') end || ' (' || {_WHEN} || ').', regexp_replace(trim(coalesce(title, '')), '[.\\s]+$', '') || '.',
      concat_ws(' ', nullif(trim(coalesce(journal, '')), '') || '.', coalesce('https://doi.org/' || d, nullif(trim(coalesce(url, '')), ''))))) as reference from a"""
)
def apa_reference(spark, sf):
    a, y = F.col("authors"), F.col("year")
    return articles(spark, sf).select("ord", C.narrative_citation(a, y).alias("narrative"), C.reference_entry(a, y, F.col("title"), F.col("journal"), F.col("doi"), F.col("url")).alias("reference"))


# in order, which distinct lists of the other dialect do not keep
LISTED = TOKENS.replace("list_distinct(list_filter(", "(list_filter(", 1)
_FOLDSN = f"lower(regexp_replace(translate({_sn('authors[1]')}, '{C.ACCENTED}', '{C.FOLDED}'), '[^A-Za-z0-9]', '', 'g'))"


@R.query(
    f"""with a as (select record_id, title, year, {_FOLDSN} s, list_filter({LISTED}, lambda w: length(w) > 3) t from article_records)
    select record_id as ord, coalesce(nullif(s || coalesce(year::varchar, 'nd') || coalesce(t[1], ''), ''), md5(coalesce(title, ''))) as bibtex_key from a"""
)
def bibtex_keys(spark, sf):
    return articles(spark, sf).select("ord", C.bibtex_key(F.col("authors"), F.col("year"), F.col("title")).alias("bibtex_key"))


@R.query(
    f"""with a as (select record_id, year, {_sn('authors[1]')} s, len(authors) k from article_records where authors is not null and len(authors) > 0)
    select s as surname, coalesce(year, 0) as year, arg_max(case when k = 1 then 'one' when k = 2 then 'two' else 'many' end, record_id) as form, count(*) as n from a group by 1, 2"""
)
def author_registry(spark, sf):
    rows = articles(spark, sf).where("size(authors) > 0").select("ord", C.surname(F.element_at("authors", 1)).alias("surname"), F.coalesce("year", F.lit(0)).alias("year"), F.size("authors").alias("k"))
    form = F.when(F.col("k") == 1, "one").when(F.col("k") == 2, "two").otherwise("many")
    return rows.groupBy("surname", "year").agg(F.max_by(form, "ord").alias("form"), F.count(F.lit(1)).alias("n"))


@R.query(r"select doc_id, array_to_string(list_filter(string_split_regex(trim(coalesce(text, ''), chr(32)), '[ \t\n\x0b\f\r]+'), lambda w: w != ''), ' ') as rebuilt from documents")
def abstract_rebuild(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", I.inverted_index(F.col("text")).alias("m"))
    return rows.select("doc_id", I.rebuilt_abstract(F.col("m")).alias("rebuilt"))


@R.query(
    f"""with p as (select lower(trim(retrieval_query)) q, * from article_records where not (trim(coalesce(title, '')) = '' or {sql_contains_any("lower(title)", C.NOISE_TITLES)})
      and not (length(trim(coalesce(abstract, ''))) < 100 and not {DOI_OK} and length(trim(coalesce(title, ''))) < 25) and doi_normalized is not null)
    select doi_normalized as paper_id, min(record_id) as ord, coalesce(array_to_string(list_sort(list_distinct(list(retrieval_mode) filter (retrieval_mode is not null))), '+'), '') as modes, max(coalesce(citations, 0)) as citations, arg_min(title, record_id) as title from p group by 1"""
)
def payload_merge(spark, sf):
    rows = articles(spark, sf).select(F.col("doi_normalized").alias("paper_id"), "ord", F.col("retrieval_mode").alias("mode"), F.col("retrieval_query").alias("query"), "title", "abstract", "doi", "citations")
    return I.merge_payload(rows).select("paper_id", "ord", "modes", "citations", "title")


@R.query(
    """with e as (select distinct l_suppkey src, 100000 + l_partkey dst from lineitem), s as (select unnest([1, 2, 3]) seed),
    b as (select src seed, dst node, 'references' direction from e join s on src = seed union select dst, src, 'citations' from e join s on dst = seed),
    r as (select *, row_number() over (partition by seed, direction order by node) r from b)
    select node, min(seed) as seed from r where r <= 40 and node not in (select seed from s) group by 1 order by 1 limit 100"""
)
def graph_expand(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 100000).alias("dst")).distinct()
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "seed long")
    return I.expand_graph(seeds, edges, 40, 100).select("node", "seed")


@R.query(
    r"""with c as (select record_id, chunk_index, min(coalesce(chunk, '')) t from raw_chunks where chunk_index >= 1 group by 1, 2), g as (select *, row_number() over (partition by record_id order by chunk_index) r from c)
    select record_id, count(*) as pieces, sum(length(t))::bigint + 2 * (count(*) - 1) as chars from g where chunk_index = r group by 1 having sum(length(t)) + 2 * (count(*) - 1) > 200"""
)
def ordered_concat(spark, sf):
    df = table(spark, sf, "raw_chunks").where("chunk_index >= 1").select("record_id", (F.col("chunk_index") - 1).alias("pos"), F.coalesce("chunk", F.lit("")).alias("chunk"))
    return X.ordered_text(df, "record_id", "pos", "chunk").select("record_id", "pieces", F.length("text").alias("chars"))


@R.query()
def paragraph_chunks(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(X.paragraph_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.length("chunk").alias("chars"))


_H = r"\n\s*(?:[IVX\d]+\.\s*)?"
_REFS = f"{_H}(?:References|Bibliography|Literature Cited|Referencias|Bibliografía)"
_PARTS = {
    "i": f"{_H}(?:Introduction|Introducción)", "m": rf"{_H}(?:Methods|Methodology|Proposed Method|Proposed Methodology|Experimental Design|System Model|Materials\s+and\s+Methods|Método|Metodología)",
    "c": rf"{_H}(?:Conclusion|Conclusions|Concluding Remarks|Discussion\s+and\s+Conclusion|Conclusions\s+and\s+Future\s+Work|Conclusiones)",
}
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_POS = lambda k: f"case when regexp_matches(b, '(?is){_PARTS[k]}\\b') then length(regexp_extract(b, '(?is)^(.*?){_PARTS[k]}\\b', 1)) + 1 else 0 end"


@R.query(
    rf"""with t as (select doc_id, coalesce(text, '') t from documents),
    r as (select doc_id, t, least({", ".join(f"coalesce(nullif(case when length(regexp_extract(t, '(?is)^(.*){_REFS}{chr(92)}s*{e}', 1)) > length(t) * 0.5 then length(regexp_extract(t, '(?is)^(.*){_REFS}{chr(92)}s*{e}', 1)) else 0 end, 0), length(t))" for e in (chr(92) + "z", chr(92) + "n"))}) e from t),
    b as (select doc_id, t, {_STRIP("left(t, e)")} b from r), p as (select *, {", ".join(f"{_POS(k)} as {k}" for k in _PARTS)} from b),
    s as (select *, case when i > 0 then '=== INTRODUCTION ===' || chr(10) || {_STRIP("substr(b, i, case when m > i then m - i else 8000 end)")} else '=== INTRODUCTION (FALLBACK) ===' || chr(10) || left(b, 6000) end x,
      case when m > 0 then '=== METHODOLOGY ===' || chr(10) || {_STRIP("substr(b, m, case when c > m then c - m else 12000 end)")} end y,
      case when c > 0 then '=== CONCLUSIONS ===' || chr(10) || {_STRIP("substr(b, c)")} when length(b) > 12000 then '=== CONCLUSIONS (FALLBACK) ===' || chr(10) || right(b, 4000) end z from p)
    select doc_id, length(b) as body_chars, md5(case when length(t) < 3000 then {_STRIP("t")} else {_STRIP("left(concat_ws(chr(10) || chr(10), x, y, z), 30000)")} end) as selected from s"""
)
def section_extract(spark, sf):
    rows = X.sections(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.length("body").alias("body_chars"), F.md5("selected").alias("selected"))


@R.query(r"select record_id as ord, regexp_replace(coalesce(abstract, ''), '<[^<]+?>', ' ', 'g') as plain from article_records where contains(coalesce(abstract, ''), '<')")
def html_strip(spark, sf):
    return articles(spark, sf).where(F.coalesce("abstract", F.lit("")).contains("<")).select("ord", C.strip_tags(F.col("abstract")).alias("plain"))


@R.query("select doc_id, case when length(text) <= 1000 then text else left(text, 680) || chr(10) || '[...]' || chr(10) || right(text, 320) end as trimmed from documents")
def head_tail_trim(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.head_tail(F.col("text"), 1000).alias("trimmed"))


_CUT = "chr(10) || chr(10) || '--- SECCIÓN: {} ---' || chr(10) || substr(text, {}, 8000)"
_SEG = (("INTRODUCCIÓN_Y_OBJETIVOS", "1"), ("METODOLOGÍA_Y_DISEÑO", "length(text) // 4 + 1"), ("RESULTADOS_Y_TABLAS_1", "length(text) // 2 + 1"), ("RESULTADOS_Y_TABLAS_2", "3 * length(text) // 4 + 1"), ("DISCUSIÓN_Y_CONCLUSIONES", "greatest(length(text) - 7999, 1)"))


@R.query(f"select doc_id, md5(case when length(coalesce(text, '')) < 2000 then left(coalesce(text, ''), 6000) else left({' || '.join(_CUT.format(*x) for x in _SEG)}, 24000) end) as context from documents")
def context_sample(spark, sf):
    """Labelled segments of long texts; shorter ones stand for their own abstract here."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(X.context_sample(t, t)).alias("context"))


@R.query(
    """with s as (select record_id article, chunk_index chunk_no, annotator = 'ann-a' as f, raw_id from raw_chunks where annotated_at < timestamp '2023-07-01' and annotator is not null and chunk_index is not null),
    n as (select record_id article, chunk_index chunk_no, annotator = 'ann-a' as f, raw_id from raw_chunks where annotated_at >= timestamp '2023-07-01' and annotator is not null and chunk_index is not null),
    h as (select article, bool_or(f) hf from s group by 1), w as (select article, bool_or(f) nf from n group by 1),
    t as (select article from w left join h using (article) where hf is null or (nf and not hf))
    select article, chunk_no, raw_id from s where article not in (select article from t) union all select article, chunk_no, raw_id from n where article in (select article from t)"""
)
def chunk_upsert(spark, sf):
    df = table(spark, sf, "raw_chunks").where("annotator is not null and chunk_index is not null").select(F.col("record_id").alias("article"), F.col("chunk_index").alias("chunk_no"), (F.col("annotator") == "ann-a").alias("full"), "raw_id", F.col("annotated_at").cast("timestamp").alias("at"))
    cut = F.lit("2023-07-01").cast("timestamp")
    return K.upsert_chunks(df.where(F.col("at") < cut), df.where(F.col("at") >= cut)).select("article", "chunk_no", "raw_id")


@R.query("select coalesce(title, '') as title, coalesce(array_to_string(authors, ', '), '') as authors, coalesce(year::varchar, '') as year, coalesce(doi, '') as doi, coalesce(source, '') as source, '' as similarity, '' as exclusion_reason, '' as translation from article_records")
def export_view(spark, sf):
    return K.export_view(articles(spark, sf)).select("title", "authors", "year", "doi", "source", "similarity", "exclusion_reason", "translation")


@R.query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_progress_window(spark, sf):
    return progress_windows(table(spark, sf, "events"))


@R.query(
    """with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end new from events),
    g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) s from e) select user_id, min(ts) as session_start, count(*) as n from g group by user_id, s"""
)
def event_sessions(spark, sf):
    return sessions(table(spark, sf, "events"))


@R.query(
    """select case when grouping(source) = 1 then 'all' else coalesce(lower(trim(source)), 'none') end as source, case when grouping(y) = 1 then 'all' else coalesce(y::varchar, 'none') end as year, count(*) as n, round(avg(citations), 6) as mean_citations
    from (select lower(trim(source)) source, nullif(year, 0) y, citations from article_records where citations >= 0) group by rollup (source, y)"""
)
def facet_rollup(spark, sf):
    rows = articles(spark, sf).where("citations >= 0").select(F.lower(F.trim("source")).alias("s"), F.nullif(F.col("year"), F.lit(0)).alias("y"), "citations")
    return rows.rollup("s", "y").agg(F.grouping("s").alias("gs"), F.grouping("y").alias("gy"), F.count(F.lit(1)).alias("n"), F.round(F.avg("citations"), 6).alias("mean_citations")).select(
        F.when(F.col("gs") == 1, "all").otherwise(F.coalesce("s", F.lit("none"))).alias("source"), F.when(F.col("gy") == 1, "all").otherwise(F.coalesce(F.col("y").cast("string"), F.lit("none"))).alias("year"), "n", "mean_citations",
    )


@R.query(
    """select query_id, count(*) as hits, count(distinct record_id) as records, round(avg(epoch(loaded_at - hit_at)) filter (loaded_at is not null), 3) as mean_delay from retrieval_hits group by 1"""
)
def late_hits(spark, sf):
    delay = (F.unix_micros("loaded_at") - F.unix_micros("hit_at")) / 1e6
    hits = table(spark, sf, "retrieval_hits").select("query_id", "record_id", *(F.col(c).cast("timestamp").alias(c) for c in ("loaded_at", "hit_at")))
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("record_id").alias("records"), F.round(F.avg(delay), 3).alias("mean_delay"))


@R.query(
    """with d as (select coalesce(provider, 'none') provider, epoch_us(loaded_at) - epoch_us(hit_at) us from retrieval_hits)
    select provider, count(*) as n, round(avg(us) / 1e6, 3) as mean_s, min(us) / 1e6 as min_s, max(us) / 1e6 as max_s from d where us > 0 group by 1"""
)
def latency_summary(spark, sf):
    """Delays over zero, by provider."""
    us = F.unix_micros(F.col("loaded_at").cast("timestamp")) - F.unix_micros(F.col("hit_at").cast("timestamp"))
    rows = table(spark, sf, "retrieval_hits").select(F.coalesce("provider", F.lit("none")).alias("provider"), us.alias("us")).where("us > 0")
    return rows.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("us") / 1e6, 3).alias("mean_s"), (F.min("us") / 1e6).alias("min_s"), (F.max("us") / 1e6).alias("max_s"))


@R.query("select min(nullif(year, 0)) as first_year, max(nullif(year, 0)) as last_year, count(distinct nullif(year, 0)) as years, count(distinct nullif(lower(trim(journal)), '')) as journals, round(avg(citations) filter (citations >= 0), 6) as mean_citations from article_records")
def corpus_bounds(spark, sf):
    y, j = F.nullif(F.col("year"), F.lit(0)), F.nullif(F.lower(F.trim("journal")), F.lit(""))
    mean = F.round(F.avg(F.when(F.col("citations") >= 0, F.col("citations"))), 6)
    return articles(spark, sf).agg(F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.countDistinct(y).alias("years"), F.countDistinct(j).alias("journals"), mean.alias("mean_citations"))


@R.query(f"with m as (select lower(trim(source)) source, {_MIX} method from article_records), c as (select source, method, count(*) n from m group by 1, 2) select source, method as predominant, n from c qualify row_number() over (partition by source order by n desc, method) = 1")
def predominant_method(spark, sf):
    rows = articles(spark, sf).select(F.lower(F.trim("source")).alias("source"), C.method_mix(_content()).alias("method"))
    counts = rows.groupBy("source", "method").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("method", "n"), F.struct((-F.col("n")).alias("neg"), "method"))
    return counts.groupBy("source").agg(best.alias("b")).select("source", F.col("b.method").alias("predominant"), "b.n")


@R.query(
    r"""select record_id as ord, case when authors is null or len(authors) = 0 then null else authors[1] end as first_author,
    list_filter(string_split_regex(regexp_replace(coalesce(abstract, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 30)[1] as first_sentence from article_records"""
)
def structured_info(spark, sf):
    sentences = F.filter(F.split(F.coalesce("abstract", F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.length(x) > 30)
    return articles(spark, sf).select("ord", F.try_element_at("authors", F.lit(1)).alias("first_author"), F.try_element_at(sentences, F.lit(1)).alias("first_sentence"))


@R.query(
    f"""with f as (select {DOI} as key, title, doi, record_id, lower(trim(source)) s from article_records), q as (select key, arg_min(title, record_id) title from f where s = 'greyshelf' and key is not null group by 1),
    n as (select key, min(record_id) from f where s = 'manualupload' and key is not null and key not in (select key from q) group by 1)
    select key, regexp_replace(key, '[^a-z0-9]+', '_', 'g') || '.pdf' as file_name from (select key from q union all select key from n)"""
)
def manual_queue(spark, sf):
    rows = articles(spark, sf).select("ord", "title", "doi", F.lower(F.trim("source")).alias("s"))
    none = spark.createDataFrame([], "key string, title string, doi string, file_name string")
    waiting = K.append_queue(none, rows.where("s = 'greyshelf'"))
    return K.append_queue(waiting, rows.where("s = 'manualupload'")).select("key", "file_name")


queries, oracle_sql = (lambda: dict(R.functions)), (lambda: dict(R.statements))
