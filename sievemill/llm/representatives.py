"""Problem 5: the best value of each field for each group of duplicate records.

The two-sided quality model: a source has a sensitivity (the share of true values that it gives) and a
specificity (the share of false values that it does not give), per field. Both are inferred by
expectation-maximisation over all claims of all groups. A fact is a (group, field, value); it is claimed or
not by each source that says anything on the field in the group. Facts with the same claiming and the same
silent sources have the same posterior, so the iterations run over the counted patterns of sources instead of the
facts; sources that are not registered count as one, so a pattern holds at most one entry per registered source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions.text import usable
from sievemill.runtime import cut, stored

FIELDS = ("abstract", "pdf_url", "citations", "source")
MULTI_VALUED = ("pdf_url", "source")


@dataclass(frozen=True)
class QualityModel:
    """Beta priors (counts) and stopping rule of the expectation-maximisation."""

    sensitivity: tuple[float, float] = (6.0, 4.0)
    false_claims: tuple[float, float] = (1.0, 9.0)
    truth: tuple[float, float] = (5.0, 5.0)
    rounds: int = 12
    tolerance: float = 1e-4
    judged_true: float = 0.5


def norm_source(c: Column) -> Column:
    flat = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    return F.when(usable(c), flat)


def _claims(records: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per record of a group of two or more and per field with a usable value."""
    trust = registry.select(norm_source(F.col("source_name")).alias("_s"), F.col("trust_rank").alias("_rank"))
    trust = trust.where("_s is not null").groupBy("_s").agg(F.min("_rank").alias("_rank"))
    base = records.select(
        F.trim("doi_normalized").alias("_key"), "record_id", "abstract", "pdf_url", "citations",
        norm_source(F.col("source")).alias("source"), F.col("retrieval_date").alias("_date"),
    ).where(F.coalesce(F.col("_key"), F.lit("")) != "")
    base = base.join(F.broadcast(trust) if _small(registry) else trust, F.col("source") == F.col("_s"), "left")
    when = F.try_to_timestamp(F.trim("_date"))
    seconds = F.coalesce(F.unix_micros(when), F.lit(-(2**62)))
    far = F.lit(2**31 - 1)
    cells = F.array(
        _cell("abstract", usable(F.col("abstract")), F.length("abstract").cast("long"), F.xxhash64("abstract")),
        _cell("pdf_url", usable(F.col("pdf_url")), seconds, F.xxhash64(F.trim("pdf_url"))),
        _cell("citations", F.coalesce(F.col("citations") >= 0, F.lit(False)), seconds, F.col("citations").cast("long")),
        _cell("source", F.col("source").isNotNull(), -F.coalesce(F.col("_rank"), far).cast("long"), F.xxhash64("source")),
    )
    rows = base.select(
        F.xxhash64("_key").alias("_g"), F.col("_key"), "record_id",
        F.coalesce(F.when(F.col("_rank").isNotNull(), F.col("source")), F.lit("(other)")).alias("_by"),
        F.filter(cells, lambda c: c["ok"]).alias("_cells"),
    )
    return rows


def _cell(name: str, ok: Column, order: Column, value: Column) -> Column:
    return F.struct(F.lit(name).alias("field"), F.coalesce(ok, F.lit(False)).alias("ok"), order.alias("order"), value.alias("value"))


def _small(registry: DataFrame, rows: int = 10_000) -> bool:
    """The registry is a dimension; it is broadcast only when it has at most ``rows`` rows."""
    return registry.limit(rows + 1).count() <= rows


def source_quality(patterns: DataFrame, model: QualityModel) -> dict[tuple[str, str], tuple[float, float]]:
    """EM over the counted patterns (field, claimed, silent, n): (field, source) -> (sensitivity, false-claim rate).

    What comes to the driver in each round is one row per field and registered source.
    """
    a1, b1 = model.sensitivity
    a0, b0 = model.false_claims
    quality: dict[tuple[str, str], tuple[float, float]] = {}
    for _ in range(model.rounds):
        scored = patterns.withColumn("_p", posterior(quality, model))
        said = scored.select("field", "n", "_p", F.explode("claimed").alias("_by"), F.lit(1.0).alias("_o"))
        kept = scored.select("field", "n", "_p", F.explode("silent").alias("_by"), F.lit(0.0).alias("_o"))
        true, false = F.col("n") * F.col("_p"), F.col("n") * (1 - F.col("_p"))
        sums = said.unionAll(kept).groupBy("field", "_by").agg(
            F.sum(true * F.col("_o")).alias("t1"), F.sum(true).alias("t"),
            F.sum(false * F.col("_o")).alias("f1"), F.sum(false).alias("f"),
        )
        new = {
            (r["field"], r["_by"]): ((r["t1"] + a1) / (r["t"] + a1 + b1), (r["f1"] + a0) / (r["f"] + a0 + b0))
            for r in sums.collect()
        }
        moved = max((abs(x - y) for k in new for x, y in zip(new[k], quality.get(k, (2.0, 2.0)))), default=0.0)
        quality = new
        if moved < model.tolerance:
            break
    return quality


def posterior(quality: dict[tuple[str, str], tuple[float, float]], model: QualityModel) -> Column:
    """P(true) of a pattern as one expression: the log-odds of the claiming and the silent sources, added up."""
    import math

    a1, b1 = model.sensitivity
    a0, b0 = model.false_claims
    default = (a1 / (a1 + b1), a0 / (a0 + b0))
    odds = math.log(model.truth[0] / model.truth[1])

    def weights(f) -> tuple[Column, float]:
        cells = [x for (field, by), q in sorted(quality.items()) for x in (F.lit(f"{field}|{by}"), F.lit(f(*q)))]
        return (F.create_map(*cells) if cells else F.expr("map('', 0.0d)")), f(*default)

    def total(names: str, f) -> Column:
        table, other = weights(f)
        return F.aggregate(
            names, F.lit(0.0), lambda acc, s: acc + F.coalesce(F.element_at(table, F.concat(F.col("field"), F.lit("|"), s)), F.lit(other))
        )

    z = F.lit(odds) + total("claimed", lambda s, f: math.log(s / f)) + total("silent", lambda s, f: math.log((1 - s) / (1 - f)))
    return 1 / (1 + F.exp(-z))


def judged_facts(records: DataFrame, registry: DataFrame, model: QualityModel = QualityModel()) -> DataFrame:
    """One row per fact: group_id, field_name, record_id (the one the field's order prefers among those giving the
    value), order, posterior, judged_true, chosen (the survivor's value).

    Groups are the records with equal non-blank ``doi_normalized``, two or more rows; ``group_id`` is the smallest
    ``record_id``. The field's order: abstract by length, pdf_url and citations by retrieval date,
    source by trust; ties go to the smaller ``record_id``. All sums run as partial aggregates, so a
    group with a large part of all rows is never gathered in one task. Rows without key, and fields without
    a usable value, give nothing; repeated rows count once per source.
    """
    rows = stored(_claims(records, registry), "claims")
    groups = rows.groupBy("_g", "_key").agg(F.count(F.lit(1)).alias("_n"), F.min("record_id").alias("group_id")).where("_n > 1")
    cells = rows.select("_g", "_key", "record_id", "_by", F.explode("_cells").alias("c"))
    best = F.max(F.struct(F.col("c.order").alias("order"), (-F.col("record_id")).alias("neg")))
    facts = cells.groupBy("_g", "_key", F.col("c.field").alias("field"), F.col("c.value").alias("value")).agg(
        F.collect_set("_by").alias("claimed"), best.alias("best")
    )
    covering = facts.groupBy("_g", "_key", "field").agg(
        F.array_distinct(F.flatten(F.collect_set("claimed"))).alias("covering"), F.max("best").alias("top")
    )
    facts = facts.join(covering, ["_g", "_key", "field"]).join(groups, ["_g", "_key"]).select(
        "group_id", "field", "value", "best", F.array_sort("claimed").alias("claimed"),
        F.array_sort(F.array_except("covering", "claimed")).alias("silent"), (F.col("best") == F.col("top")).alias("chosen"),
    )
    facts = stored(facts, "facts")
    patterns = cut(facts.groupBy("field", "claimed", "silent").agg(F.count(F.lit(1)).cast("double").alias("n")))
    quality = source_quality(patterns, model)
    return facts.withColumn("posterior", posterior(quality, model)).select(
        "group_id", F.col("field").alias("field_name"), (-F.col("best.neg")).alias("record_id"), F.col("best.order").alias("order"),
        F.round("posterior", 9).alias("posterior"), (F.col("posterior") >= model.judged_true).alias("judged_true"), "chosen",
    )


def best_representatives(records: DataFrame, registry: DataFrame, model: QualityModel = QualityModel()) -> DataFrame:
    """The surviving record, field by field: group_id, field_name, record_id, posterior of the surviving value."""
    return judged_facts(records, registry, model).where("chosen").select("group_id", "field_name", "record_id", "posterior")


def retained_values(records: DataFrame, registry: DataFrame, model: QualityModel = QualityModel()) -> DataFrame:
    """The built record in long form: the survivor of every field and, for multi-valued fields, every value judged true."""
    multi = F.col("field_name").isin(*MULTI_VALUED)
    facts = judged_facts(records, registry, model).where(F.col("chosen") | (multi & F.col("judged_true")))
    return facts.select("group_id", "field_name", "record_id", "posterior", "judged_true", "chosen")
