"""Registered queries: filters, facets, deduplication, joins and attribution over the article records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.operators import screening as S
from sievemill.operators.evaluation import head_and_tail, lost_at
from sievemill.plans.registry import Registry, sql_contains_any, sql_list
from sievemill.runtime import table

R = Registry()


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article corpus; ``ord`` is the order of arrival."""
    return table(spark, sf_dir, "article_records").withColumnRenamed("record_id", "ord").withColumnRenamed("retrieval_phase", "phase")


FILTER = S.MetadataFilter(start_year=2008, end_year=2022, open_access=True, language="en", academic_only=True)
HARD = S.HardFilter(
    min_year=2005, max_year=2023, min_abstract=100, exclude_reviews=True, exclusion_terms=("pilot study", "sleep apnoea"), excluded_venues=("software upkeep",), academic_only=True
)
AS_OF = 2025

VENUE = "lower(trim(regexp_replace(coalesce(nullif(trim(coalesce(journal, '')), ''), venue, ''), '\\s+', ' ', 'g')))"
ACADEMIC = f"(coalesce(year, 0) != 0 and {VENUE} not in ({sql_list(C.MISSING_VENUES)}) and not {sql_contains_any(VENUE, C.PREPRINT_MARKS)})"
OPEN = (
    "(coalesce(open_access, false) or length(trim(coalesce(pdf_url, ''))) > 10 or contains(lower(coalesce(url, '')), 'arxiv') "
    "or contains(lower(coalesce(source, '')), 'arxiv') or contains(lower(coalesce(url, '')), 'pmc'))"
)
LANG_BASE = "split_part(replace(lower(trim(coalesce(language, ''))), '_', '-'), '-', 1)"
LANG = (
    "case when "
    + LANG_BASE
    + " = '' then null "
    + " ".join(f"when {LANG_BASE} in ({sql_list(names)}) then '{code}'" for code, names in C.LANGUAGE_ALIASES.items())
    + f" when length({LANG_BASE}) = 2 then {LANG_BASE} end"
)
DOI_OK = "(length(trim(coalesce(doi, ''))) > 5 and not contains(lower(coalesce(doi, '')), 'sin doi'))"
DOI_FLAT = "lower(regexp_replace(regexp_replace(trim(coalesce(doi, '')), '^(?:https?://(?:dx\\.)?doi\\.[a-z]+/|doi:\\s*)', '', 'i'), '^/+|/+$', '', 'g'))"
DOI = f"case when starts_with({DOI_FLAT}, '10.') then {DOI_FLAT} end"
REASON = f"""case when not {ACADEMIC} then 'academic' when not {OPEN} then 'open_access' when coalesce(({LANG}) != 'en', true) then 'language'
  when coalesce(year, 0) < 2008 or coalesce(year, 0) > 2022 then 'year' end"""


@R.query(f"select record_id as ord, title from article_records where {REASON} is null")
def filter_metadata(spark, sf):
    return S.filter_metadata(articles(spark, sf), FILTER).select("ord", "title")


@R.query(f"select coalesce({REASON}, 'kept') as reason, count(*) as n from article_records group by 1")
def filter_reason_funnel(spark, sf):
    rows = S.exclusion_reason(articles(spark, sf), FILTER)
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


BOTH = "lower(concat(trim(coalesce(title, '')), ' ', trim(coalesce(abstract, ''))))"
PLACE = "lower(coalesce(nullif(journal, ''), venue, ''))"
HARD_REASON = f"""case when trim(coalesce(abstract, '')) = '' and not {DOI_OK} then 'sin_abstract'
  when trim(coalesce(abstract, '')) != '' and length(trim(abstract)) < 100 and not {DOI_OK} and length(trim(coalesce(title, ''))) < 25 then 'abstract_corto'
  when regexp_matches(year::varchar, '^[0-9]{{4}}') and year < 2005 then 'fuera_de_rango_temporal' when regexp_matches(year::varchar, '^[0-9]{{4}}') and year > 2023 then 'fuera_de_rango_temporal'
  when {sql_contains_any(BOTH, C.REVIEW_PHRASES)} then 'es_review_survey' when {sql_contains_any(BOTH, HARD.exclusion_terms)} then 'termino_exclusion_dura'
  when {PLACE} != '' and {sql_contains_any(PLACE, HARD.excluded_venues)} then 'venue_excluido' when not {ACADEMIC} then 'sin_revista' end"""


@R.query(f"""select record_id as ord, {HARD_REASON} as reason, trim(coalesce(abstract, '')) = '' and {DOI_OK} as abstract_substituted from article_records""")
def hard_filter(spark, sf):
    return S.hard_filter(articles(spark, sf), HARD).select("ord", "reason", "abstract_substituted")


@R.query(f"select coalesce({HARD_REASON}, 'kept') as reason, count(*) as n from article_records group by 1")
def hard_filter_histogram(spark, sf):
    return S.hard_filter(articles(spark, sf), HARD).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@R.query(f"""select record_id as ord from article_records where trim(coalesce(title, '')) = '' or {sql_contains_any("lower(title)", C.NOISE_TITLES)}""")
def noise_titles(spark, sf):
    t = C.text("title")
    return articles(spark, sf).where((t == "") | C.contains_any(F.lower(t), C.NOISE_TITLES)).select("ord")


STEPS = " ".join(f"when {AS_OF} - year <= {a} then {n}" for a, n in C.CITATION_STEPS)


@R.query(
    f"""select record_id as ord, coalesce(citations, 0) as citations from article_records where not (lower(trim(coalesce(source, ''))) in ('medarium', 'opencorpora', 'scholaris')
    and ({DOI}) is not null and year is not null) or coalesce(citations, 0) >= case {STEPS} else {C.CITATION_STEPS[-1][1]} end"""
)
def citation_bucket_filter(spark, sf):
    return S.citation_filter(articles(spark, sf), ("medarium", "opencorpora", "scholaris"), AS_OF).select("ord", F.coalesce("citations", F.lit(0)).alias("citations"))


@R.query("select source, record_id as ord from article_records qualify row_number() over (partition by source order by record_id) <= 40")
def source_cap(spark, sf):
    return S.per_source_cap(articles(spark, sf).select("source", "ord"), 40).select("source", "ord")


DUP = f"""with k as (select record_id, year, case when {DOI_OK} then 'doi' when trim(coalesce(title, '')) != '' then 'title' else 'none' end kind,
   case when {DOI_OK} then trim(doi) when trim(coalesce(title, '')) != '' then lower(trim(title)) else record_id::varchar end key from article_records),
 d as (select record_id as ord, case when record_id = min(record_id) over (partition by kind, key, case when kind = 'title' then year end) then null
   when kind = 'doi' then 'Duplicado Exacto (DOI)' else 'Duplicado Exacto (Título + Año)' end as dup_reason from k)"""


@R.query(f"{DUP} select ord, dup_reason from d")
def exact_dedup(spark, sf):
    return S.exact_dedup(articles(spark, sf).select("ord", "doi", "title", "year")).select("ord", "dup_reason")


@R.query(f"{DUP} select coalesce(dup_reason, 'kept') as outcome, count(*) as n from d group by 1")
def exact_dedup_report(spark, sf):
    rows = S.exact_dedup(articles(spark, sf).select("ord", "doi", "title", "year"))
    return rows.groupBy(F.coalesce("dup_reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@R.query("select count(distinct nullif(coalesce(nullif(doi, ''), lower(title)), '')) as distinct_articles, count(*) as n from article_records")
def filter_count_distinct(spark, sf):
    key = F.nullif(F.coalesce(F.nullif(F.col("doi"), F.lit("")), F.lower("title")), F.lit(""))
    return articles(spark, sf).agg(F.countDistinct(key).alias("distinct_articles"), F.count(F.lit(1)).alias("n"))


TOKENS = f"""list_distinct(list_filter(regexp_extract_all(translate(lower(coalesce(title, '')), '{C.ACCENTED}', '{C.FOLDED}'), '[a-z0-9]+'),
  lambda w: length(w) > 1 and w not in ({sql_list(C.TITLE_STOPWORDS)})))"""
PAIRS = f"""tok as (select record_id as ord, {DOI} as key, {TOKENS} as t from article_records),
 u as (select ord, len(t) n, unnest(t) w from tok),
 freq as (select w, count(*) df from u group by 1),
 pre as (select ord, n, w, row_number() over (partition by ord order by df, w) r from u join freq using (w)),
 cand as (select distinct a.ord a, b.ord b from pre a join pre b on a.w = b.w and a.ord < b.ord
   where a.r <= a.n - ceil(0.85 * a.n - 1e-9) + 1 and b.r <= b.n - ceil(0.85 * b.n - 1e-9) + 1),
 sim as (select a, b, x.key ka, y.key kb, len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) s from cand join tok x on x.ord = a join tok y on y.ord = b)"""


@R.query(f"with {PAIRS}, e as (select b as ord, count(*) n, max(s) s from sim where s >= 0.85 group by 1) select ord, n as earlier, round(s, 6) as best from e")
def title_jaccard_links(spark, sf):
    """Per article the number of earlier articles with a similar title and the best similarity."""
    links = S.title_links(articles(spark, sf).select("ord", "title"), 0.85)
    return links.select("ord", "earlier", F.round("best", 6).alias("best"))


GREEDY = f"""with recursive {PAIRS},
 firsts as (select ord, key, t, key is null or ord = min(ord) over (partition by coalesce(key, '#' || ord)) as alive from tok),
 near as (select a, b from sim where s >= 0.85 and kb is null and (ka is null or a in (select ord from firsts where alive and key is not null))),
 nodes as (select distinct b as ord from near), ordered as (select ord, row_number() over (order by ord) i from nodes),
 walk(i, dropped) as (select 0::bigint, []::bigint[] union all
   select o.i, case when exists (select 1 from near n where n.b = o.ord and not list_contains(w.dropped, n.a)) then list_append(w.dropped, o.ord) else w.dropped end
   from walk w join ordered o on o.i = w.i + 1),
 final as (select dropped from walk order by i desc limit 1)"""


@R.query(f"{GREEDY} select ord, alive and not list_contains((select dropped from final), ord) as keep from firsts")
def title_greedy_dedup(spark, sf):
    return S.title_dedup(articles(spark, sf).select("ord", "doi", "title")).select("ord", "keep")


@R.query(
    f"""{GREEDY}, ph as (select {DOI} as key, min(lower(trim(coalesce(retrieval_phase, '')))) lo, max(lower(trim(coalesce(retrieval_phase, '')))) hi from article_records group by 1)
    select f.ord, case when f.key is not null and lo != hi then 'both' else lower(trim(coalesce(a.retrieval_phase, ''))) end as phase from firsts f
    join article_records a on a.record_id = f.ord left join ph on ph.key = f.key where alive and not list_contains((select dropped from final), f.ord)"""
)
def two_phase_merge(spark, sf):
    return S.merge_phases(articles(spark, sf).select("ord", "doi", "title", "phase"))


VEC = "select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings"


@R.query(
    f"""with recursive e as ({VEC}), near as (select x.vec_id a, y.vec_id b from e x join e y on x.vec_id < y.vec_id where list_cosine_similarity(x.v, y.v) > 0.6),
    ordered as (select b as ord, row_number() over (order by b) i from (select distinct b from near)),
    walk(i, dropped) as (select 0::bigint, []::bigint[] union all select o.i, case when exists (select 1 from near n where n.b = o.ord and not list_contains(w.dropped, n.a))
      then list_append(w.dropped, o.ord) else w.dropped end from walk w join ordered o on o.i = w.i + 1),
    final as (select dropped from walk order by i desc limit 1) select vec_id as ord, not list_contains((select dropped from final), vec_id) as keep from embeddings"""
)
def semantic_dedup(spark, sf):
    """At 0.6, since the vectors at hand are never closer than 0.85."""
    df = table(spark, sf, "embeddings")
    pairs = S.similar_vectors(df, 0.6, tables=120, bits=6)
    return S.greedy_survivors(df.select(F.col("vec_id").alias("ord"), F.lit(False).alias("fixed")), pairs)


@R.query(
    r"""with s as (select doc_id, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) != '') p from documents)
    select doc_id, len(list_distinct(list_transform(p, lambda x: left(lower(trim(x, ' ')), 50)))) as sentences,
      len(p) - len(list_distinct(list_transform(p, lambda x: left(lower(trim(x, ' ')), 50)))) as dropped from s"""
)
def sentence_dedup(spark, sf):
    return S.sentence_dedup(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "sentences", "dropped")


@R.query()
def paragraph_dedup(spark, sf):
    return S.paragraph_dedup(table(spark, sf, "documents"), "doc_id", "text")


@R.query("select lower(trim(provider)) as provider, sum(hit_rank)::bigint as total, count(*) as n from retrieval_hits where provider is not null group by 1")
def metric_merge(spark, sf):
    df = table(spark, sf, "retrieval_hits").where("provider is not null")
    return df.groupBy(F.lower(F.trim("provider")).alias("provider")).agg(F.sum("hit_rank").alias("total"), F.count(F.lit(1)).alias("n"))


QKEY = "array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(retrieval_query, '')), '[\\p{L}\\p{N}]+'), lambda w: length(w) > 1))), ' ')"


@R.query(f"select {QKEY} as query_key, min(record_id) as first_ord, count(*) as n from article_records group by 1")
def query_dedup(spark, sf):
    found = F.regexp_extract_all(F.lower(F.coalesce("retrieval_query", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    key = F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda w: F.length(w) > 1))), " ")
    return articles(spark, sf).groupBy(key.alias("query_key")).agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n"))


_W = "list_distinct(regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))), '[a-záéíóúñüàèìòùâêîôûçãõ]+'))"
_H = ", ".join(f"len(list_intersect(w, [{sql_list(v)}])) {k}" for k, v in C.LANGUAGE_WORDS.items())


@R.query(
    f"""with a as (select ({LANG}) code, {_W} w from article_records), h as (select code, {_H} from a),
    g as (select code, en, es, pt, greatest(en, es, pt) best, case when en >= es and en >= pt then greatest(es, pt) when es >= pt then greatest(en, pt) else greatest(en, es) end runner from h),
    r as (select coalesce(code, case when best < 2 or (runner > 0 and best < runner + 2) then 'und' when en = best then 'en' when es = best then 'es' else 'pt' end) as code,
      case when code is not null then 'metadata' when best < 2 or (runner > 0 and best < runner + 2) then 'unknown' else 'inferred' end as how from g)
    select code, count(*) as n, count_if(how = 'metadata') as from_metadata, count_if(how = 'inferred') as inferred, count_if(how = 'unknown') as unknown from r group by 1"""
)
def language_facets(spark, sf):
    code = C.language_code(F.col("language"))
    guess = C.inferred_language(F.col("title"), F.col("abstract"))
    rows = articles(spark, sf).select(code.alias("c"), F.when(code.isNull(), guess).alias("g"))
    return rows.groupBy(F.coalesce("c", "g").alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.count("c").alias("from_metadata"), F.count_if(F.col("c").isNull() & (F.col("g") != "und")).alias("inferred"), F.count_if(F.col("c").isNull() & (F.col("g") == "und")).alias("unknown"),
    )


JOURNAL = "coalesce(nullif(trim(coalesce(journal, '')), ''), 'Sin Revista / Otros')"


@R.query(
    f"""with c as (select {JOURNAL} l, count(*) n from article_records group by 1), r as (select l, n, row_number() over (order by n desc, l) r from c)
    select case when r <= 8 then l else 'otros' end as label, sum(n)::bigint as n, round(100 * sum(n) / (select sum(n) from c), 1) as pct from r group by 1"""
)
def journal_facets_head_tail(spark, sf):
    label = F.coalesce(F.nullif(C.text("journal"), F.lit("")), F.lit("Sin Revista / Otros"))
    return head_and_tail(articles(spark, sf), label, 8)


@R.query("select lower(trim(source)) as source, count(*) as n, min(nullif(year, 0)) as first_year, max(nullif(year, 0)) as last_year from article_records group by 1")
def source_distribution(spark, sf):
    y = F.nullif(F.col("year"), F.lit(0))
    return articles(spark, sf).groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.min(y).alias("first_year"), F.max(y).alias("last_year"))


@R.query(
    """with l as (select doc_id, case when min(toxic) = max(toxic) then min(toxic) end toxic from labels group by 1)
    select coalesce(toxic::varchar, 'none') as label, count(*) as n, round(avg(n_chars), 4) as mean_chars from documents left join l using (doc_id) group by 1"""
)
def gold_label_join(spark, sf):
    lab = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).select("doc_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("toxic"))
    df = table(spark, sf, "documents").join(lab, "doc_id", "left")
    return df.groupBy(F.coalesce(F.col("toxic").cast("string"), F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


KEYED = "select record_id, nullif(lower(trim(doi_normalized)), '') d, nullif(lower(trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'))), '') t, lower(trim(source)) s from article_records"


@R.query(
    f"""with k as ({KEYED}), l as (select * from k where s = 'medarium'), r as (select * from k where s = 'scholaris'),
    m as (select l.record_id a, r.record_id b from l join r on l.d = r.d union select l.record_id, r.record_id from l join r on l.t = r.t)
    select a as left_id, count(*) as partners, min(b) as first_partner from m group by 1"""
)
def multi_key_match(spark, sf):
    t = F.nullif(F.lower(F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))), F.lit(""))
    rows = articles(spark, sf).select("ord", F.nullif(F.lower(F.trim("doi_normalized")), F.lit("")).alias("d"), t.alias("t"), F.lower(F.trim("source")).alias("s"))
    left, right = rows.where("s = 'medarium'").withColumnRenamed("ord", "left_id"), rows.where("s = 'scholaris'").withColumnRenamed("ord", "right_id")
    got = S.match_any_key(left, right, [("d", "d"), ("t", "t")])
    return got.groupBy("left_id").agg(F.count(F.lit(1)).alias("partners"), F.min("right_id").alias("first_partner"))


@R.query(
    """with s as (select record_id, max(nullif(trim(chunk), '')) c from raw_chunks where chunk_index = 0 or chunk_index = 1 group by 1)
    select a.record_id as ord, coalesce(c, abstract) as abstract, coalesce(c != coalesce(abstract, ''), false) as changed from article_records a left join s using (record_id)"""
)
def coalescing_update(spark, sf):
    src = table(spark, sf, "raw_chunks").where("chunk_index in (0, 1)").groupBy(F.col("record_id").alias("ord")).agg(F.max(F.nullif(F.trim("chunk"), F.lit(""))).alias("abstract"))
    return S.coalesce_update(articles(spark, sf).select("ord", "abstract"), src, "ord", ["abstract"])


STAGE = f"""select record_id, {DOI_OK} or trim(coalesce(title, '')) != '' as found, coalesce(year, 0) >= 2008 as in_years, {ACADEMIC} as has_venue,
  contains({BOTH}, 'telephone') or contains({BOTH}, 'remote') or contains({BOTH}, 'video') as on_topic from article_records"""


@R.query(f"with s as ({STAGE}) select coalesce(case when not found then 'found' when not in_years then 'in_years' when not has_venue then 'has_venue' when not on_topic then 'on_topic' end, 'kept') as lost_at, count(*) as n from s group by 1")
def fn_attribution(spark, sf):
    both = F.lower(F.concat(C.text("title"), F.lit(" "), C.text("abstract")))
    rows = articles(spark, sf).select(
        (C.valid_doi(F.col("doi")) | (C.text("title") != "")).alias("found"), (F.coalesce(F.col("year"), F.lit(0)) >= 2008).alias("in_years"),
        C.academic_venue(F.col("journal"), F.col("venue"), F.col("year")).alias("has_venue"), C.contains_any(both, ("telephone", "remote", "video")).alias("on_topic"),
    )
    return lost_at(rows, ["found", "in_years", "has_venue", "on_topic"]).groupBy(F.coalesce("lost_at", F.lit("kept")).alias("lost_at")).agg(F.count(F.lit(1)).alias("n"))


@R.query(
    f"""with f as (select record_id, lower(trim(source)) s, left(({DOI}), 16) p from article_records where length({DOI}) >= 16), n as (select distinct p as stem from f where s = 'manualupload')
    select stem, count(*) as n from n join f on starts_with(f.p, n.stem) group by 1"""
)
def prefix_match(spark, sf):
    """Identifier stems of waiting files against the articles: an equi-join on the stem, as the prefix has a fixed length."""
    rows = articles(spark, sf).select(F.lower(F.trim("source")).alias("s"), F.substring(C.normal_doi(F.col("doi")), 1, 16).alias("stem")).where("length(stem) = 16")
    waiting = rows.where("s = 'manualupload'").select("stem").distinct()
    return rows.join(waiting, "stem", "left_semi").groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    """with w as (select lower(trim(title)) k, min(record_id) ord from article_records where trim(coalesce(title, '')) != '' group by 1)
    select h.query_id, min(w.ord) as first_ord, count(distinct w.ord) as n from retrieval_hits h join article_records a using (record_id) join w on w.k = lower(trim(a.title)) group by 1"""
)
def first_match_lookup(spark, sf):
    rows = articles(spark, sf).select("ord", F.lower(F.trim("title")).alias("k")).where("k != ''")
    firsts = rows.groupBy("k").agg(F.min("ord").alias("first"))
    hits = table(spark, sf, "retrieval_hits").select("query_id", F.col("record_id").alias("ord")).distinct()
    return hits.join(rows, "ord").join(firsts, "k").groupBy("query_id").agg(F.min("first").alias("first_ord"), F.countDistinct("first").alias("n"))


queries, oracle_sql = (lambda: dict(R.functions)), (lambda: dict(R.statements))
