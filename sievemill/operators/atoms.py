"""Concept matching: term variants, boundary matches, coverage, required atoms and co-occurrence windows.

Contracts are small dictionaries compiled on the driver into one alternation per atom; matching is a projection over the
articles, so a contract of any size costs no join and no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that are no variant by themselves, and what tells the category of a concept, in order.
VARIANT_STOPWORDS = frozenset(("and", "or", "of", "in", "on", "for", "with", "to", "the", "a", "an"))
CATEGORY_MARKS = (
    ("C", ("comparator", "comparison", "control", "baseline", "placebo", "standard", "usual", "conventional", "alternative", "non-adaptive", "fixed", "versus", "vs")),
    ("O", ("outcome", "effect", "impact", "measure", "measurement", "metric", "score", "rate", "frequency", "duration", "change", "response", "improvement", "reduction", "increase", "decrease")),
    ("I", ("intervention", "treatment", "program", "protocol", "method", "approach", "model", "system", "tool", "device", "platform", "application", "software", "technique", "technology", "exposure", "agent", "strategy")),
)


@dataclass(frozen=True)
class Atom:
    name: str
    terms: tuple[str, ...]
    category: str = "P"
    required: bool = False
    technical: bool = False
    central: bool = False


@dataclass(frozen=True)
class Contract:
    atoms: tuple[Atom, ...]
    min_technical: int = 0
    window: int = 10_000
    extras: dict = field(default_factory=dict)

    @property
    def gate(self) -> tuple[Atom, ...]:
        """The required atoms; the first atom where none is marked."""
        return tuple(a for a in self.atoms if a.required) or self.atoms[:1]


def variants(term: str) -> list[str]:
    """Hyphen and blank swapped, naive singulars, and sub-phrases of two words or more of longer terms; sorted.

    Singulars and sub-phrases are of the words between blanks; "technologies" has its own singular."""
    base = " ".join(term.lower().split())
    out = {base, base.replace("-", " "), base.replace(" ", "-"), base.replace("technologies", "technology")}

    def singular(w: str) -> str:
        return w[:-1] if len(w) > 3 and w.endswith("s") else w

    words = base.split()
    out.add(" ".join(singular(w) for w in words))
    if len(words) >= 3:
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                part = words[i : i + n]
                out.add(" ".join(part))
                out.add(" ".join(singular(w) for w in part))
    return sorted(v for v in out if len(v) >= 2 and not set(v.split()) <= VARIANT_STOPWORDS)


def simple_variants(term: str) -> list[str]:
    base = " ".join(term.lower().split())
    return sorted({base, base.replace("-", " "), base.replace(" ", "-")})


def atom_pattern(terms, expand: bool = True) -> str:
    """One alternation of all variants between characters that are no small letters or digits, the longest first."""
    every = {v for t in terms for v in (variants(t) if expand else simple_variants(t))}
    body = "|".join(re.escape(v) for v in sorted(every, key=lambda v: (-len(v), v)))
    return rf"(?<![a-z0-9])(?:{body})(?![a-z0-9])"


def matched_atoms(text: Column, contract: Contract, expand: bool = True) -> Column:
    """Names of the atoms that a lower-case text holds, in the contract's order."""
    found = [F.when(text.rlike(atom_pattern(a.terms, expand)), F.lit(a.name)) for a in contract.atoms]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _starts(low: Column, atom: Atom) -> Column:
    """(at, name) of every match: lengths of what stands before each, summed up."""
    pattern = atom_pattern(atom.terms)
    pieces = F.split(low, pattern)
    found = F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda s, x: s + F.length(x))
    at = lambda i: total(F.slice(pieces, F.lit(1), i)) + total(F.slice(found, F.lit(1), i - 1))
    cells = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.struct(at(i).alias("at"), F.lit(atom.name).alias("name")))
    return F.when(F.size(found) > 0, cells).otherwise(F.array().cast("array<struct<at:int,name:string>>"))


def cooccurring_atoms(title: Column, abstract: Column, contract: Contract) -> Column:
    """Atoms of the title, and the largest set of atoms whose matches start within one window of the abstract.

    Abstracts within the window need no positions. In longer ones the starts of all matches are laid out in order
    and each opens a window; of equally large sets the first counts.
    """
    in_title = matched_atoms(F.lower(F.coalesce(title, F.lit(""))), contract)
    low = F.lower(F.coalesce(abstract, F.lit("")))
    simple = matched_atoms(low, contract)
    per_atom = [_starts(low, a) for a in contract.atoms]
    hits = F.array_sort(F.flatten(F.array(*per_atom)))
    names = F.array(*(F.lit(a.name) for a in contract.atoms))
    windows = F.transform(hits, lambda h: F.array_distinct(F.transform(F.filter(hits, lambda x: (x["at"] >= h["at"]) & (x["at"] <= h["at"] + contract.window)), lambda x: x["name"])))
    best = F.aggregate(windows, F.array().cast("array<string>"), lambda acc, w: F.when(F.size(w) > F.size(acc), w).otherwise(acc))
    body = F.when(F.length(low) <= contract.window, simple).otherwise(best)
    return F.array_intersect(names, F.array_union(in_title, body))


def concept_filter(df: DataFrame, contract: Contract) -> DataFrame:
    """The rows with ``matched``, ``missing`` (required atoms, and technical ones below their minimum), ``bonus`` and ``passed``."""
    names = lambda atoms: F.array(*(F.lit(a.name) for a in atoms)) if atoms else F.array().cast("array<string>")
    optional = tuple(a for a in contract.atoms if not a.required)
    technical = tuple(a for a in contract.atoms if a.technical)
    out = df.withColumn("matched", cooccurring_atoms(F.col("title"), F.col("abstract"), contract))
    short = F.size(F.array_intersect(names(technical), "matched")) < contract.min_technical
    missing = F.array_except(names(contract.gate), "matched")
    missing = F.array_distinct(F.concat(missing, F.when(short, F.array_except(names(technical), "matched")).otherwise(F.array().cast("array<string>"))))
    bonus = F.round(F.size(F.array_intersect(names(optional), "matched")) / F.lit(max(1, len(optional))), 2) if optional else F.lit(0.0)
    return out.withColumns({"missing": missing, "bonus": bonus}).withColumn("passed", F.size("missing") == 0)


def category_filter(df: DataFrame, contract: Contract) -> DataFrame:
    """The mode without required atoms: population and intervention must be there if the contract has them, else population."""
    present = {c for c in "PICO" if any(a.category == c for a in contract.atoms)}
    must = ("P", "I") if {"P", "I"} <= present else ("P",)
    low = F.lower(F.concat_ws(" ", F.col("title"), F.col("abstract")))
    ok, hits = F.lit(True), []
    for c in "PICO":
        terms = [t for a in contract.atoms if a.category == c for t in a.terms]
        if terms:
            hit = low.rlike(atom_pattern(terms))
            if c in must:
                ok = ok & hit
            else:
                hits.append(hit.cast("int"))
    bonus = F.round(sum(hits, F.lit(0)) / F.lit(max(1, len(hits))), 2)
    return df.withColumns({"passed": ok, "bonus": bonus})


def atom_failures(filtered: DataFrame) -> DataFrame:
    return filtered.where("not passed").select(F.explode("missing").alias("atom")).groupBy("atom").agg(F.count(F.lit(1)).alias("failures"))


def atom_coverage(df: DataFrame, contract: Contract) -> DataFrame:
    """matched_required, coverage (round 4) and the counts by category, over title and abstract, with simple variants."""
    low = F.lower(F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit("\n"), F.coalesce(F.col("abstract"), F.lit(""))))
    hit = {a.name: low.rlike(atom_pattern(a.terms, expand=False)).cast("int") for a in contract.atoms}
    gate = contract.gate
    n = sum((hit[a.name] for a in gate), F.lit(0))
    cols = {"matched_required": n, "coverage": F.round(n / F.lit(len(gate)), 4)}
    for c in "PICO":
        own = [hit[a.name] for a in contract.atoms if a.category == c]
        if own:
            cols[f"n_{c.lower()}"] = sum(own, F.lit(0))
    return df.withColumns(cols)


def infer_category(c: Column) -> Column:
    """Category of a concept by the marks in its name, comparison first; population where nothing tells.

    The word "ai" by itself is an intervention."""
    from sievemill.functions.columns import contains_any

    low = F.lower(F.coalesce(c, F.lit("")))
    (comparison, outcome, intervention) = (contains_any(low, marks) for _, marks in CATEGORY_MARKS)
    return F.when(comparison, "C").when(outcome, "O").when(intervention | low.rlike(r"\bai\b"), "I").otherwise("P")
