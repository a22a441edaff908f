"""From judge answers to decisions: evidence of required atoms, the bucket of the cascade, gold attribution and its inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import columns as C

EVALUATION = "array<struct<id:string,status:string,evidence:string,reason:string>>"
# Why a positive article was lost, by the first stage that it did not reach, in order.
LOST = (
    ("metadata", "Excluido por filtros de año/calidad academica."), ("dedup", "Eliminado como duplicado antes de la cascada."), ("screening_pool", "Excluido por prefiltro conceptual."),
    ("cascade", "No fue evaluado por el limite de cascada."), ("stage1", "Excluido en Stage 1."), ("stage4_input", "No llego a Stage 4."),
)
LOST_LAST, KEPT_WRONGLY = "Excluido en Stage 4.", "El pipeline lo retuvo, pero el gold standard es 0."
AUDIT = ("id", "title", "year", "doi", "cross_encoder_score", "llm_relevance", "llm_reason", "llm_dimensions", "llm_provider", "similarity")


def atom_guard(df: DataFrame, atoms: list[tuple[str, str]], response: str = "response") -> DataFrame:
    """The rows with ``atom_score``, ``missing_atoms`` and ``atom_states`` of the required atoms (id, label).

    An atom is met only with evidence: "met" without any is unclear, as is an atom without an answer. The last answer for
    an atom counts. Without required atoms the score is 1 and nothing is missing; an answer without an object misses all.
    """
    if not atoms:
        none = F.array().cast("array<string>")
        return df.withColumns({"atom_score": F.lit(1.0), "missing_atoms": none, "atom_states": none})
    given = F.from_json(F.get_json_object(C.json_object(F.col(response)), "$.atom_evaluations"), EVALUATION)
    rows = df.withColumn("_given", F.coalesce(given, F.array().cast(EVALUATION)))

    def state(atom: str) -> Column:
        own = F.try_element_at(F.filter("_given", lambda x: F.trim(x["id"]) == atom), F.lit(-1))
        status = F.lower(C.text(own["status"]))
        return F.when((status == "") | ((status == "met") & (C.text(own["evidence"]) == "")), "unclear").otherwise(status)

    rows = rows.withColumn("atom_states", F.array(*(state(a) for a, _ in atoms)))
    labels = F.array(*(F.lit(label) for _, label in atoms))
    missing = F.filter(F.zip_with(labels, "atom_states", lambda label, s: F.when(s != "met", label)), lambda x: x.isNotNull())
    rows = rows.withColumn("missing_atoms", missing).drop("_given")
    return rows.withColumn("atom_score", 1 - F.size("missing_atoms") / F.lit(float(len(atoms))))


def cascade_bucket(df: DataFrame) -> DataFrame:
    """The rows with ``included``, ``bucket`` and ``reason``.

    Takes passed, decision, near_miss, population, intervention, study_design (YES or not), score, missing_atoms and
    justification. An article that just misses but has the three core criteria is included as background.
    """
    yes = lambda c: F.upper(C.text(c)) == "YES"
    near = F.coalesce(F.col("near_miss"), F.lit(False)) | (F.col("decision") == "BACKGROUND_ONLY")
    passed = F.coalesce(F.col("passed"), F.lit(False))
    border = ~passed & near & yes("population") & yes("intervention") & yes("study_design")
    lack = F.concat(F.lit("Faltan atomos obligatorios: "), F.array_join(F.slice("missing_atoms", 1, 5), ", "))
    weak = F.concat(F.lit("No cumple todos los criterios estrictos (Puntaje: "), F.round(F.col("score") * 100, 1).cast("string"), F.lit("%)"))
    why = F.when(passed, F.lit(None).cast("string")).when(border, "Borderline: Revisar a profundidad").when(F.size("missing_atoms") > 0, lack)
    bucket = F.when(passed, "DIRECT_INCLUDED").when(border, "BACKGROUND_ONLY").otherwise(F.col("decision"))
    return df.withColumns({"included": passed | border, "bucket": bucket, "reason": why.otherwise(F.coalesce(F.nullif(C.text("justification"), F.lit("")), weak))})


def gold_attribution(df: DataFrame, kept: str = "kept") -> DataFrame:
    """(row_id, kind, reason) of labelled rows that the pipeline got wrong: kept negatives and lost positives.

    ``df`` has row_id, label, a flag ``kept`` and one for each stage of ``LOST``; an own ``reason`` column, where there is one,
    stands for the stages of the concept filter and after the judge.
    """
    own = F.nullif(C.text("reason"), F.lit("")) if "reason" in df.columns else F.lit(None).cast("string")
    why = F.lit(None).cast("string")
    first = None
    for stage, text in LOST:
        said = F.coalesce(own, F.lit(text)) if stage in ("screening_pool", "stage1") else F.lit(text)
        gone = ~F.coalesce(F.col(stage), F.lit(False))
        first = F.when(gone, said) if first is None else first.when(gone, said)
    why = first.otherwise(F.coalesce(own, F.lit(LOST_LAST)))
    held = F.coalesce(F.col(kept), F.lit(False))
    kind = F.when(held & (F.col("label") == 0), "false_positive").when(~held & (F.col("label") == 1), "false_negative")
    return df.select("row_id", kind.alias("kind"), F.when(held, KEPT_WRONGLY).otherwise(why).alias("reason")).where("kind is not null")


def prepared_text(df: DataFrame, most: int = 9000) -> DataFrame:
    """The rows with ``text``, ``chars_original`` and ``chars``: full text of 100 characters or more, else the abstract, trimmed to ``most``.

    A longer text keeps 68 percent of the limit (3,000 at least) from its head and the rest (1,000 at least) from its tail.
    """
    full, abstract = C.text("full_text"), C.text("abstract")
    src = F.when(F.length(full) >= 100, full).otherwise(abstract)
    head = max(3000, int(most * 0.68))
    tail = max(1000, most - head)
    rows = df.withColumns({"_src": src, "text_source": F.when(F.length(full) >= 100, "local_csv_pdf").otherwise("abstract_proxy")})
    mark = F.lit("\n\n[... texto recortado para acelerar evaluacion interna ...]\n\n")
    cut = F.concat(F.rtrim(F.substring("_src", 1, head)), mark, F.ltrim(F.right(F.col("_src"), F.lit(tail))))
    rows = rows.withColumn("text", F.when(F.length("_src") <= most, F.col("_src")).otherwise(cut))
    return rows.withColumns({"chars_original": F.length("_src"), "chars": F.length("text")}).drop("_src")


def text_statistics(prepared: DataFrame) -> DataFrame:
    """One row a source of text: texts, mean and greatest length."""
    return prepared.groupBy("text_source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("chars"), 0).alias("mean_chars"), F.max("chars").alias("most_chars"))


def audit_projection(df: DataFrame) -> DataFrame:
    """The ten fields of a rerank audit; those that are not there are null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in AUDIT))


def excludes_reviews(criteria: Column) -> Column:
    """Whether exclusion criteria speak of reviews, surveys or mapping studies."""
    return F.lower(F.coalesce(criteria, F.lit(""))).rlike(r"(?U)\b(review|survey|mapping|revisi[oó]n|estado del arte)\b")
