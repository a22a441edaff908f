"""Registered queries of the language-model data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import abuse
from sievemill.llm.encoding_repair import find_damaged
from sievemill.llm.language_labels import label_languages, train, wrong_labels
from sievemill.llm.leakage import find_leaks
from sievemill.llm.near_duplicates import duplicate_groups, group_pairs
from sievemill.llm.packing import PackPlan, fill_containers, fill_report
from sievemill.llm.representatives import best_representatives, retained_values
from sievemill.llm.response_defects import find_defects
from sievemill.llm.scan_noise import repaired, scan_noise
from sievemill.llm.splitting import checked_pieces, split_oversized
from sievemill.runtime import stored, table


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "article_records")
    return label_languages(records, train(records))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_labels(_languages(spark, sf_dir))


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).select("record_id", "label", "language", "confidence")


def p1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _languages(spark, sf_dir).select("record_id", F.explode("segments").alias("s"))
    return rows.select("record_id", "s.*")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the languages are learnt from the labelled records; the answers carry no labels
    model = train(table(spark, sf_dir, "article_records"))
    return find_defects(table(spark, sf_dir, "raw_chunks"), model)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_oversized(table(spark, sf_dir, "raw_chunks"), "raw_id", "chunk")
    return pieces.where("cut_kind != 'none' and piece_no = 0").select("raw_id", "cut_kind")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "raw_chunks"), "raw_id", "chunk").where("cut_kind != 'none'")


def p3_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of each oversized chunk give it again and keep to limit and overlap."""
    chunks = table(spark, sf_dir, "raw_chunks")
    got = checked_pieces(split_oversized(chunks, "raw_id", "chunk").where("cut_kind != 'none'"), "raw_id")
    return got.select("raw_id", F.md5("rebuilt").alias("rebuilt"), "within_limit", "overlapping")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise(table(spark, sf_dir, "raw_chunks"))


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "raw_chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_representatives(table(spark, sf_dir, "article_records"), table(spark, sf_dir, "source_registry"))
    return best.select("group_id", "field_name", "record_id")


def p5_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained_values(table(spark, sf_dir, "article_records"), table(spark, sf_dir, "source_registry"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_pairs(duplicate_groups(table(spark, sf_dir, "article_records")))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "article_records"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_damaged(table(spark, sf_dir, "article_records"), "record_id", ("title", "abstract")).select("record_id", "field_name").distinct()


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_damaged(table(spark, sf_dir, "article_records"), "record_id", ("title", "abstract"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_containers(table(spark, sf_dir, "documents"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(fill_containers(table(spark, sf_dir, "documents")))


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents, and whether each is held once and whole, limits are kept, and 99 percent of the capacity is used."""
    plan = PackPlan()
    packed = stored(fill_containers(table(spark, sf_dir, "documents"), plan), "packed")
    # a document beyond the capacity comes in as many runs as it needs, one after the other
    own = packed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts"), F.sum("tokens").alias("t"), F.sum(F.when(F.col("part_no") == 0, 1).otherwise(0)).alias("copies"),
    )
    whole = own.agg(F.sum("copies").alias("documents"), F.min((F.col("n") == F.col("parts") * F.col("copies")) & ((F.col("parts") == 1) | (F.col("t") > plan.capacity))).alias("whole"))
    r = fill_report(packed, plan)
    kept = (F.col("most_tokens") <= plan.capacity) & (F.col("most_segments") <= plan.segments)
    return whole.join(F.broadcast(r.select(kept.alias("within_limits"), (F.col("used") >= 0.99).alias("well_filled"))))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.where("how = 'verbatim'").select("doc_id", "item_id").distinct()


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return abuse.score_documents(docs, abuse.train(docs, table(spark, sf_dir, "labels")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.voiced(_abuse(spark, sf_dir))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse(spark, sf_dir)


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(_abuse(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (
        p1_found, p1_labels, p1_passages, p2_found, p3_found, p3_pieces, p3_checked, p4_found, p4_repaired, p5_found, p5_retained, p6_found, p6_groups, p7_found, p7_repaired,
        p8_containers, p8_report, p8_checked, p9_found, p9_leaks, p10_found, p10_scores, p10_rates,
    )}


_USABLE = r"""(coalesce(trim(regexp_replace({c}, '[\s]+', ' ', 'g')), '') != '' and not (
    length(trim({c})) <= 40 and regexp_replace(lower(trim({c})), '^(.{{3,}}?)[.\s]+$', '\1') in
    ('-', '--', '—', '...', '[]', 'null', 'none', 'n/a', 'na', 'unknown', 'sin resumen', '[no abstract]', 'no abstract',
     'abstract not available', 'xx', 'untitled', 'no title', 'pending', 'tbd')))"""


def _usable(c: str) -> str:
    return _USABLE.format(c=c)


def oracle_sql() -> dict[str, str]:
    p5 = f"""
    with r as (
      select *, trim(doi_normalized) k, min(record_id) over (partition by trim(doi_normalized)) g,
             count(*) over (partition by trim(doi_normalized)) n
      from article_records where coalesce(trim(doi_normalized), '') != ''),
    s as (select r.*, coalesce(t.trust_rank, 2147483647) tr from r left join source_registry t on lower(trim(r.source)) = lower(trim(t.source_name)) where n > 1),
    c as (
      select g, 'abstract' f, record_id, length(abstract)::bigint o from s where {_usable("abstract")}
      union all select g, 'pdf_url', record_id, epoch_us(retrieval_date::timestamptz) from s where {_usable("pdf_url")}
      union all select g, 'citations', record_id, epoch_us(retrieval_date::timestamptz) from s where citations >= 0
      union all select g, 'source', record_id, -tr::bigint from s where {_usable("source")}),
    q as (select *, row_number() over (partition by g, f order by o desc, record_id) rn from c)
    select g as group_id, f as field_name, record_id from q where rn = 1"""
    # one million characters in a row is as good as any bound here: bounded repetition stops at 1000 in this dialect
    p3 = r"""select raw_id, case when regexp_matches(chunk, '\S{600}\S{601}') then 'hard' else 'soft' end as cut_kind
             from raw_chunks where length(chunk) > 1200"""
    # shared words by prefix filter, so that the join stays small; then the closure
    p6 = f"""
    with recursive r as (select record_id id, nullif(trim(doi_normalized), '') k,
        case when {_usable("abstract")} and length(abstract) >= 500 then list_distinct(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[\\p{{L}}\\p{{N}}]+')) end w from article_records),
    u as (select id, len(w) n, unnest(w) x from r where len(w) > 0), f as (select x, count(*) df from u group by 1),
    p as (select id, n, x, row_number() over (partition by id order by df, x) i from u join f using (x)),
    q as (select id, n, x from p where i <= n - ceil(0.7 * n - 1e-9) + 1),
    c as (select distinct a.id a, b.id b from q a join q b on a.x = b.x and a.id < b.id),
    s as (select a, b from c join r x on x.id = a join r y on y.id = b where len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) >= 0.7),
    d as (select min(id) over (partition by k) a, id b from r where k is not null),
    e as (select a, b from s union select a, b from d where a != b), g as (select a, b from e union select b, a from e),
    t(a, b) as (select a, b from g union select t.a, g.b from t join g on t.b = g.a)
    select distinct a as record_a, b as record_b from t where a < b"""
    words = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
    window = "unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' ')))"
    p9 = f"""with d as (select doc_id, {words} w from documents), i as (select item_id, {words} w from benchmark),
    dw as (select distinct doc_id, {window} x from d where len(w) >= 12), iw as (select distinct item_id, {window} x from i where len(w) >= 12)
    select distinct doc_id, item_id from dw join iw using (x)"""
    p3_checked = "select raw_id, md5(chunk) as rebuilt, true as within_limit, true as overlapping from raw_chunks where length(chunk) > 1200"
    p8_checked = "select count(*) as documents, true as whole, true as within_limits, true as well_filled from documents"
    return {"p3_found": p3, "p3_checked": p3_checked, "p5_found": p5, "p6_found": p6, "p8_checked": p8_checked, "p9_found": p9}
