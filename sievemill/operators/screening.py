"""Filters with reasons, facets, exact and greedy deduplication, joins by several keys, and set attribution."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.runtime import cut, stored


@dataclass(frozen=True)
class MetadataFilter:
    start_year: int | None = None
    end_year: int | None = None
    open_access: bool = False
    language: str | None = None
    journals: tuple[str, ...] = ()
    academic_only: bool = False


def _rules(f: MetadataFilter) -> list[tuple[str, Column]]:
    """(name, fails) in the order of attribution; an unknown year is 0, so it fails a lower bound and passes an upper one."""
    year = F.coalesce(F.col("year"), F.lit(0))
    rules = []
    if f.academic_only:
        rules.append(("academic", ~C.academic_venue(F.col("journal"), F.col("venue"), F.col("year"))))
    if f.open_access:
        rules.append(("open_access", ~C.truly_open(F.col("open_access"), F.col("pdf_url"), F.col("url"), F.col("source"))))
    if f.language:
        rules.append(("language", ~F.coalesce(C.language_code(F.col("language")) == f.language, F.lit(False))))
    if f.start_year or f.end_year:
        bad = F.lit(False)
        if f.start_year:
            bad = bad | (year < f.start_year)
        if f.end_year:
            bad = bad | (year > f.end_year)
        rules.append(("year", bad))
    if f.journals:
        keys = [" ".join(j.split()).lower() for j in f.journals]
        rules.append(("journal", ~C.venue(F.col("journal"), F.col("venue")).isin(*keys)))
    return rules


def journal_names(raw: str | list[str] | None) -> tuple[str, ...]:
    """Journal names of a form field: a list as JSON, or one name a value; commas belong to names. Each once, whatever its case."""
    out: dict[str, str] = {}
    for value in [raw] if isinstance(raw, str) else raw or []:
        text = str(value or "").strip()
        names = [text]
        if text.startswith("["):
            try:
                held = json.loads(text)
                names = [str(x).strip() for x in held] if isinstance(held, list) else names
            except ValueError:
                pass
        for n in names:
            if n:
                out.setdefault(" ".join(n.split()).lower(), n)
    return tuple(out.values())


def filter_metadata(df: DataFrame, f: MetadataFilter) -> DataFrame:
    """Rows that fail no rule; falsy parameters ask for nothing."""
    for _, fails in _rules(f):
        df = df.where(~fails)
    return df


def exclusion_reason(df: DataFrame, f: MetadataFilter) -> DataFrame:
    """The rows with ``reason``, the first rule they fail, or null."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(_rules(f)):
        out = F.when(fails, F.lit(name)).otherwise(out)
    return df.withColumn("reason", out)


@dataclass(frozen=True)
class HardFilter:
    min_year: int | None = None
    max_year: int | None = None
    min_abstract: int = 100
    allowed_sources: tuple[str, ...] = ()
    exclude_reviews: bool = False
    exclusion_terms: tuple[str, ...] = ()
    excluded_venues: tuple[str, ...] = ()
    academic_only: bool = False


def hard_filter(df: DataFrame, f: HardFilter) -> DataFrame:
    """The rows with ``reason`` (first rule violated, or null), ``abstract`` with a placeholder for texts missing under a
    valid identifier, and ``abstract_substituted``. The rules look at the text as it was before."""
    title, abstract = C.text("title"), C.text("abstract")
    both = F.lower(F.concat(title, F.lit(" "), abstract))
    doi = C.valid_doi(F.col("doi"))
    year = C.year_of(F.col("year"))
    place = F.lower(F.coalesce(F.nullif(F.col("journal"), F.lit("")), F.col("venue"), F.lit("")))
    case = F.when((abstract == "") & ~doi, "sin_abstract").when((abstract != "") & (F.length(abstract) < f.min_abstract) & ~doi & (F.length(title) < 25), "abstract_corto")
    if f.min_year:
        case = case.when(year < f.min_year, "fuera_de_rango_temporal")
    if f.max_year:
        case = case.when(year > f.max_year, "fuera_de_rango_temporal")
    if f.allowed_sources:
        case = case.when((place != "") & ~C.contains_any(place, [s.lower() for s in f.allowed_sources]), "fuente_no_permitida")
    if f.exclude_reviews:
        case = case.when(C.contains_any(both, C.REVIEW_PHRASES), "es_review_survey")
    if f.exclusion_terms:
        case = case.when(C.contains_any(both, [t.lower() for t in f.exclusion_terms]), "termino_exclusion_dura")
    if f.excluded_venues:
        case = case.when((place != "") & C.contains_any(place, f.excluded_venues), "venue_excluido")
    if f.academic_only:
        case = case.when(~C.academic_venue(F.col("journal"), F.col("venue"), F.col("year")), "sin_revista")
    missing = (abstract == "") & doi
    return df.withColumns(
        {
            "reason": case,
            "abstract": F.when(missing, F.lit("No abstract available for this article.")).otherwise(F.col("abstract")),
            "abstract_substituted": missing,
        }
    )


def per_source_cap(df: DataFrame, target: int) -> DataFrame:
    """At most ``target`` rows a source, those with the least ord; a top-k report, with the limit before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy("ord"))
    return df.withColumn("_r", rank).where(F.col("_r") <= target).drop("_r")


def citation_filter(df: DataFrame, sources: tuple[str, ...], as_of: int) -> DataFrame:
    """Rows of the sources with a bare identifier must have the citations asked of their age; all others pass."""
    asked = C.citations_asked(F.col("year"), as_of)
    held = F.lower(C.text("source")).isin(*sources) & C.normal_doi(F.col("doi")).isNotNull() & F.col("year").isNotNull()
    return df.where(~held | (F.coalesce(F.col("citations"), F.lit(0)) >= asked))


def exact_dedup(df: DataFrame) -> DataFrame:
    """The rows with ``dup_reason``: null for the first of a key. Rows with a valid identifier have it, trimmed, as key, with
    case; the others (title, year); an empty title without identifier is never a duplicate."""
    doi = C.valid_doi(F.col("doi"))
    title = F.lower(C.text("title"))
    kind = F.when(doi, "doi").when(title != "", "title").otherwise("none")
    key = F.when(doi, C.text("doi")).when(title != "", title).otherwise(F.col("ord").cast("string"))
    year = F.when(doi | (title == ""), F.lit(None).cast("int")).otherwise(F.col("year"))
    keyed = df.withColumns({"_kind": kind, "_key": key, "_year": year})
    first = F.min("ord").over(Window.partitionBy("_kind", "_key", "_year"))
    why = F.when(F.col("ord") == first, F.lit(None).cast("string")).when(F.col("_kind") == "doi", "Duplicado Exacto (DOI)").otherwise("Duplicado Exacto (Título + Año)")
    return keyed.withColumn("dup_reason", why).drop("_kind", "_key", "_year")


def similar_titles(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, sim), a < b by ord: pairs of (ord, tokens) whose token sets agree in ``threshold`` or more.

    Equal sets are linked to their first row alone, which leaves every chain intact. Different sets: ``_similar_sets``.
    """
    sets = df.where(F.size("tokens") > 0).withColumn("key", F.xxhash64(F.array_sort("tokens")))
    firsts = sets.groupBy("key").agg(F.min("ord").alias("ord"))
    return _similar_sets(sets.join(firsts, ["key", "ord"], "left_semi").select("ord", "tokens"), threshold)


def _key_width(n: Column, threshold: float) -> Column:
    """How many tokens a key of sets of ``n`` has, so that a set has some 200 keys at most, or one a token of its prefix."""
    least = F.ceil(F.lit(threshold) * n - 1e-9)
    return F.when(least < 4, 1).when(n - least <= 6, 4).when(n - least <= 30, 2).otherwise(1)


def _subset_keys(s: Column, width: int, held: Column | None = None) -> Column:
    """Hashes of all the subsets of ``width`` tokens of an array."""
    held = F.lit(width) if held is None else held
    if width == 1:
        return F.transform(s, lambda x: F.xxhash64(held, x))
    return F.flatten(F.transform(s, lambda x, i: _subset_keys(F.slice(s, i + 2, F.size(s)), width - 1, F.xxhash64(held, x))))


def _similar_sets(df: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim), a < b by ord: pairs of different sets (ord, tokens) that agree in ``threshold`` or more; with a column
    ``open``, pairs whose b is open."""
    pairs, ranked = _candidates(df, threshold)
    return _compared(pairs, ranked, threshold)


def _compared(pairs: DataFrame, ranked: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) of the pairs (a, b) that agree in ``threshold`` or more; ``ranked`` has their sets."""
    ta, tb = ranked.select(F.col("ord").alias("a"), F.col("s.w").alias("ta")), ranked.select(F.col("ord").alias("b"), F.col("s.w").alias("tb"))
    return pairs.select("a", "b").join(ta, "a").join(tb, "b").select("a", "b", C.jaccard(F.col("ta"), F.col("tb")).alias("sim")).where(F.col("sim") >= threshold)


def _candidates(df: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, firm): the pairs that ``_similar_sets`` has to compare, firm if a isn't open; and their sets in the order of rarity.

    Sets that share o tokens or more share w of their first n - o + w in the order of rarity, so they meet under a key of
    w tokens and no pair is lost. The smaller of a pair needs a shorter prefix, as o is at least 2t / (1 + t) of its size.
    Before the sets themselves are compared, pairs go whose sizes are too far apart or whose parity bits (64 for a set)
    differ in more places than their tokens may.
    """
    marked = "open" in df.columns
    size = F.size("tokens")
    # a set of n without n / (n + 1) has no partner but its equal
    sets = df.select("ord", "tokens", F.col("open") if marked else F.lit(True).alias("open")).where((size > 0) & (size >= threshold * (size + 1) - 1e-9))
    sets = stored(sets, "titles")
    words = sets.select("ord", "open", F.explode("tokens").alias("w"))
    freq = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    bits = F.expr("aggregate(s, 0L, (x, t) -> x ^ shiftleft(1L, cast(pmod(xxhash64(t.w), 64) as int)))")
    ranked = words.join(freq, "w").groupBy("ord", "open").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("s"))
    ranked = stored(ranked.select("ord", "open", F.size("s").alias("n"), bits.alias("bits"), "s"), "ranked")

    def filed(widths: Column, least: Column) -> DataFrame:
        w, s = F.col("width"), F.col("head")
        head = F.slice("s", F.lit(1), F.col("n") - F.greatest(least, w) + w)
        # a token of this set alone meets nothing
        head = F.transform(F.filter(head, lambda x: x["df"] > 1), lambda x: x["w"])
        keys = F.when(w == 4, _subset_keys(s, 4)).when(w == 2, _subset_keys(s, 2)).otherwise(_subset_keys(s, 1))
        rows = ranked.withColumn("width", F.explode(widths)).withColumn("head", head)
        return rows.select(F.explode(keys).alias("k"), F.struct("ord", "n", "bits", "open").alias("set"))

    n = F.col("n")
    larger = F.sequence(n, F.floor(n / threshold + 1e-9).cast("int"))
    small = filed(F.array_distinct(F.transform(larger, lambda m: _key_width(m, threshold))), F.ceil(2 * threshold / (1 + threshold) * n - 1e-9).cast("int"))
    large = filed(F.array(_key_width(n, threshold)), F.ceil(F.lit(threshold) * n - 1e-9).cast("int"))
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    fits = (x("n") < y("n")) | ((x("n") == y("n")) & (x("ord") < y("ord")))
    fits = fits & (x("n") >= threshold * y("n") - 1e-9) & F.when(x("ord") < y("ord"), y("open")).otherwise(x("open"))
    fits = fits & (F.bit_count(x("bits").bitwiseXOR(y("bits"))) <= (x("n") + y("n")) * ((1 - threshold) / (1 + threshold)) + 1e-9)
    pairs = small.select("k", F.col("set").alias("x")).join(large.select("k", F.col("set").alias("y")), "k").where(fits)
    firm = ~F.when(x("ord") < y("ord"), x("open")).otherwise(y("open"))
    return pairs.select(F.least(x("ord"), y("ord")).alias("a"), F.greatest(x("ord"), y("ord")).alias("b"), firm.alias("firm")).distinct(), ranked


def _thinned(pairs: DataFrame, ranked: DataFrame, held: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """Of many candidates those that are still to be compared, and the sets (ord) that are already known to be dropped.

    Comparing sends both sets along with each pair, so where there are more pairs than sets, each b first meets one that
    is kept for certain: a firm one, or its first if that has no candidate before it. If they agree, b is dropped, and with
    it go its pairs; for those as a, a row ``held`` (ord, held) stands in from there on. Ends when the pairs are as few as
    the sets or hardly get fewer; those left are all compared.
    """
    near, gone, most = stored(pairs, "candidates"), None, ranked.count()
    left = near.count()
    while left > most:
        later = near.select(F.col("b").alias("a")).distinct()
        first = near.groupBy("b").agg(F.min(F.struct(~F.col("firm"), "a")).alias("first")).select("b", "first.a", (~F.col("first.col1")).alias("firm"))
        first = first.join(later.withColumn("late", F.lit(True)), "a", "left").where("firm or late is null").select("a", "b")
        first = stored(first, "first")
        hit = stored(_compared(first, ranked, threshold).select(F.col("b").alias("ord")), "hit")
        gone = hit if gone is None else gone.unionAll(hit)
        near = near.join(hit.select(F.col("ord").alias("b")), "b", "left_anti").join(first, ["a", "b"], "left_anti")
        near = near.join(hit.join(held, "ord", "left").select(F.col("ord").alias("a"), "held", F.lit(True).alias("hit")), "a", "left")
        near = stored(near.where("hit is null or held < b").select("a", "b", (F.col("firm") | F.col("hit").isNotNull()).alias("firm")), "candidates")
        before, left = left, near.count()
        if left > 0.9 * before:
            break
    return near, gone


def title_links(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(ord, earlier, best) of the rows (ord, title) after a similar title: how many earlier rows have one and the best similarity.

    Each set gets the rows of all the sets like it in order, itself among them, and counts along: no list of pairs of rows.
    """
    tokens = F.array_sort(C.title_tokens(F.col("title")))
    rows = stored(df.select("ord", tokens.alias("tokens")).where(F.size("tokens") > 0).withColumn("set", F.xxhash64("tokens")), "links")
    sets = rows.groupBy("set").agg(F.min("ord").alias("rep"))
    near = stored(_similar_sets(rows.join(sets.select(F.col("rep").alias("ord")), "ord", "left_semi").select("ord", "tokens"), threshold), "near")
    of = stored(rows.select("ord", "set").join(sets, "set").select("rep", "ord"), "members")
    both = near.unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    ends = both.join(of.withColumnRenamed("rep", "a"), "a").select("b", "ord", "sim", F.lit(False).alias("own"))
    ends = ends.unionAll(of.select(F.col("rep").alias("b"), "ord", F.lit(1.0).alias("sim"), F.lit(True).alias("own")))
    before = Window.partitionBy("b").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    counted = ends.select("ord", "own", F.count(F.lit(1)).over(before).alias("earlier"), F.max("sim").over(before).alias("best"))
    return counted.where("own and earlier > 0").select("ord", "earlier", "best")


def greedy_survivors(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ord, keep): sequential first-come deduplication as a fixpoint; not a transitive closure.

    ``nodes`` (ord, fixed): ``fixed`` rows are kept whatever they resemble. ``pairs`` (a, b), a before b. A row is
    dropped once a kept earlier row resembles it and kept once all its earlier neighbours are dropped. Only rows with
    a neighbour take part in the rounds; each is cut with checkpoint(). The rounds go on until no row is undecided: every
    one decides at least the first undecided row, so they end.
    """
    near = stored(pairs.select("a", "b"), "near")
    ends = near.select(F.col("a").alias("ord"), F.lit(False).alias("late")).unionAll(near.select(F.col("b").alias("ord"), F.lit(True).alias("late")))
    ends = ends.groupBy("ord").agg(F.max("late").alias("late"))
    state = cut(nodes.join(ends, "ord").select("ord", F.when(F.col("fixed") | ~F.col("late"), F.lit(True)).alias("keep")))
    undecided = None
    while (left := state.where("keep is null").count()) > 0:
        if left == undecided:
            raise RuntimeError("greedy_survivors did not settle: pairs must go from an earlier row of nodes to a later one")
        undecided = left
        known = near.join(state.select(F.col("ord").alias("a"), F.col("keep").alias("ka")), "a")
        votes = known.groupBy(F.col("b").alias("ord")).agg(F.max(F.coalesce("ka", F.lit(False)).cast("int")).alias("hit"), F.sum(F.col("ka").isNull().cast("int")).alias("open"))
        new = F.when(F.col("keep").isNotNull(), F.col("keep")).when(F.col("hit") == 1, F.lit(False)).when(F.col("open") == 0, F.lit(True))
        state = cut(state.join(votes, "ord", "left").select("ord", new.alias("keep")))
    return nodes.join(state, "ord", "left").select("ord", F.coalesce("keep", F.lit(True)).alias("keep"))


def title_dedup(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Three tiers over (ord, doi, title): the first row of an identifier is kept, later ones dropped; a row without
    identifier is dropped if its title resembles a row kept before it; rows without title tokens are kept. Returns
    (ord, keep)."""
    rows = df.select("ord", C.normal_doi(F.col("doi")).alias("key"), F.array_sort(C.title_tokens(F.col("title"))).alias("tokens"))
    rows = stored(rows.withColumn("set", F.when(F.size("tokens") > 0, F.xxhash64("tokens"))), "words")
    first = F.min("ord").over(Window.partitionBy(F.coalesce("key", F.concat(F.lit("#"), F.col("ord").cast("string")))))
    held = F.col("key").isNotNull()
    tier = stored(rows.select("ord", "set", held.alias("fixed"), (held & (F.col("ord") > first)).alias("late")), "tier")
    # of equal titles the first row and the first with identifier can decide for others: one without identifier after the
    # first row goes, as whatever drops the first resembles it too
    sets = tier.where("set is not null and not late").groupBy("set").agg(F.min("ord").alias("lead"), F.min(F.when(F.col("fixed"), F.col("ord"))).alias("held"))
    sets = stored(sets.withColumn("open", ~F.coalesce(F.col("held") == F.col("lead"), F.lit(False))), "sets")
    leads = rows.select("ord", "tokens").join(sets.select(F.col("lead").alias("ord"), "open"), "ord")
    near, ranked = _candidates(leads, threshold)
    near, gone = _thinned(near, ranked, sets.where("held > lead").select(F.col("lead").alias("ord"), "held"), threshold)
    ends = _compared(near, ranked, threshold).join(sets.select(F.col("lead").alias("a"), "held"), "a")
    pairs = ends.select(F.explode(F.array_distinct(F.array("a", "held"))).alias("a"), "b").where("a < b")
    nodes = sets.select(F.col("lead").alias("ord"), (~F.col("open")).alias("fixed"))
    nodes = nodes.unionAll(sets.where("held > lead").select(F.col("held").alias("ord"), F.lit(True).alias("fixed")))
    if gone is not None:
        nodes, pairs = nodes.join(gone, "ord", "left_anti"), pairs.join(gone.select(F.col("ord").alias("a")), "a", "left_anti")
    kept = greedy_survivors(nodes, pairs)
    sure = tier.where("fixed or set is null").select("ord", (~F.col("late")).alias("keep"))
    asked = tier.where("not fixed and set is not null").select("ord")
    return sure.unionAll(asked.join(kept, "ord", "left").select("ord", F.coalesce("keep", F.lit(False)).alias("keep")))


def merge_phases(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Survivors of title_dedup with ``phase``: both, where a row dropped by its identifier came from the other phase."""
    kept = title_dedup(df, threshold)
    keyed = df.select("ord", C.normal_doi(F.col("doi")).alias("key"), F.lower(C.text("phase")).alias("phase"))
    phases = keyed.where("key is not null").groupBy("key").agg(F.min("phase").alias("lo"), F.max("phase").alias("hi"))
    out = keyed.join(kept.where("keep").select("ord"), "ord", "left_semi").join(phases, "key", "left")
    return out.select("ord", F.when(F.col("lo") != F.col("hi"), F.lit("both")).otherwise(F.col("phase")).alias("phase"))


def similar_vectors(df: DataFrame, threshold: float, tables: int = 40, bits: int = 10, seed: int = 5) -> DataFrame:
    """(a, b, sim), a < b by vec_id: pairs of vectors whose cosine exceeds the threshold.

    Random hyperplanes file each vector under ``tables`` signatures of ``bits`` bits; vectors that share one are
    compared exactly. At cosine 0.85 a pair is missed with a probability below 0.003.
    """
    import numpy as np

    dim = len(df.select("embedding").first()[0])
    planes = np.random.default_rng(seed).normal(size=(tables * bits, dim))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
            sides = (x @ planes.T > 0).reshape(len(x), tables, bits)
            keys = (sides * (1 << np.arange(bits))).sum(-1) + np.arange(tables) * (1 << bits)
            at = np.repeat(np.arange(len(x)), tables)
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), part.column("vec_id")], names=["k", "vec_id"])

    filed = df.select("vec_id", "embedding").mapInArrow(run, "k long, vec_id long")
    left, right = filed.select("k", F.col("vec_id").alias("a")), filed.select("k", F.col("vec_id").alias("b"))
    pairs = left.join(right, "k").where("a < b").select("a", "b").distinct()
    va, vb = df.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea")), df.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    sim = pairs.join(va, "a").join(vb, "b").select("a", "b", C.cosine(F.col("ea"), F.col("eb")).alias("sim"))
    return sim.where(F.col("sim") > threshold)


def semantic_dedup(df: DataFrame, threshold: float) -> DataFrame:
    """(ord, keep) for vectors in the order of vec_id: greedy, dropped strictly above the threshold."""
    pairs = similar_vectors(df, threshold)
    return greedy_survivors(df.select(F.col("vec_id").alias("ord"), F.lit(False).alias("fixed")), pairs)


def sentence_dedup(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sentences, dropped): within a text, sentences that repeat the first fifty characters of an earlier one go."""
    parts = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    keys = F.transform(parts, lambda s: F.substring(F.lower(F.trim(s)), 1, 50))
    kept = F.filter(F.arrays_zip(parts.alias("s"), keys.alias("k")), lambda x: F.lit(True))
    fresh = F.transform(F.array_distinct(keys), lambda k: F.element_at(kept, F.array_position(keys, k).cast("int"))["s"])
    return df.select(id_col, F.array_join(fresh, " ").alias("text"), F.size(fresh).alias("sentences"), (F.size(parts) - F.size(fresh)).alias("dropped"))


def paragraph_dedup(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, paragraphs, dropped): paragraphs of eight words or more that begin with the same eight words as an earlier one go."""
    parts = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\n\s*\n"), lambda s: F.trim(s) != "")
    heads = F.transform(
        parts, lambda s: F.struct(F.slice(F.filter(F.split(F.lower(F.trim(s)), r"\s+"), lambda w: w != ""), 1, 8).alias("w"), F.length(F.trim(s)).alias("n"))
    )
    keys = F.transform(heads, lambda h, i: F.when((F.size(h["w"]) == 8) & (h["n"] > 20), F.array_join(h["w"], " ")).otherwise(F.concat(F.lit("#"), i.cast("string"))))
    n, fresh = F.size(parts), F.size(F.array_distinct(keys))
    return df.select(id_col, fresh.alias("paragraphs"), (n - fresh).alias("dropped"))


def match_any_key(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """(left_id, right_id): pairs equal in one of the keys; a union of equi-joins instead of a disjunction."""
    out = None
    for a, b in keys:
        got = left.where(F.col(a).isNotNull()).select("left_id", F.col(a).alias("k")).join(right.where(F.col(b).isNotNull()).select("right_id", F.col(b).alias("k")), "k").select("left_id", "right_id")
        out = got if out is None else out.unionAll(got)
    return out.distinct()


def coalesce_update(target: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Target rows with non-empty source fields put in where they differ, and ``changed``."""
    s = source.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    joined = target.join(s, key, "left")
    fresh = {f: F.nullif(F.trim(F.col(f"_{f}").cast("string")), F.lit("")) for f in fields}
    changed = F.lit(False)
    for f in fields:
        changed = changed | F.coalesce(fresh[f] != F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(False))
    return joined.select(*(c for c in target.columns if c not in fields), *(F.coalesce(fresh[f], F.col(f).cast("string")).alias(f) for f in fields), changed.alias("changed"))
