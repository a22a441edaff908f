"""Roles and tiers of a contract's atoms, empirical queries, safe terms, sort keys and lexical preselection.

Contracts are small and live on the driver; what is applied to tables is compiled into expressions.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import columns as C
from sievemill.operators.atoms import Atom, simple_variants, variants

# Words that no query term needs; marks of atoms about dates, of learning in general, and of special methods.
DATE_MARKS = (
    r"publication\s+(?:date|year)", r"published\s+(?:between|from|in)", r"date\s+range", r"year\s+range", r"publication\s+period", "fecha", "periodo", "a[nñ]o", "202[0-9]", "201[0-9]",
)
LEARNING_MARKS = ("machine learning", "deep learning", "aprendizaje autom[aá]tico", "artificial intelligence", "ai", "ml", "dl")
METHOD_MARKS = (
    "ensemble", "bagging", "boosting", "stacking", "voting", "random forest", "xgboost", "support vector machine", "svm", "neural network", "graph neural network", "codebert", "lstm", "bilstm",
    "transformer", "feature selection", "hyperparameter", "optimization", "optimisation", "metaheuristic", "swarm", "genetic algorithm",
)


def _marked(text: str, marks: tuple[str, ...]) -> bool:
    return re.search(rf"(?i)\b(?:{'|'.join(marks)})\b", text) is not None


def atom_text(atom: Atom) -> str:
    return " ".join((atom.name, *atom.terms))


def about_dates(atom: Atom) -> bool:
    """Atoms about dates are metadata: no text can meet them, so they count nowhere."""
    return _marked(atom_text(atom), DATE_MARKS)


def about_learning(atom: Atom) -> bool:
    return _marked(atom_text(atom), LEARNING_MARKS)


def special_method(atom: Atom) -> bool:
    return _marked(atom_text(atom), METHOD_MARKS) and not about_learning(atom)


def roles(atoms: tuple[Atom, ...]) -> tuple[list[Atom], list[Atom], list[Atom]]:
    """Required atoms as populations, central interventions and technical ones; the first intervention is central if none is."""
    required = [a for a in atoms if a.required and not about_dates(a)]
    what = [a for a in required if a.category == "I"]
    central = [a for a in what if a.central] or what[:1]
    return [a for a in required if a.category == "P"], central, [a for a in what if a not in central]


def term(text: str, most: int = 120) -> str:
    return " ".join(text.split())[:most]


# What shows that a label holds several components.
COMPOSITE = (" and ", " plus ", " with ", " / ", ";", "(", ")")


def is_composite(label: str) -> bool:
    return any(mark in f" {label.lower()} " for mark in COMPOSITE)


def components(label: str, most: int = 6) -> list[str]:
    """Parts of a label with brackets: what stands before them, and what they list; parts that say too little are dropped."""
    flat, inner, outside, depth = term(label, 10_000), [], "", 0
    for c in flat:  # brackets are not nested in labels; an unclosed one holds the rest
        depth += (c == "(") - (c == ")")
        if c == "(":
            inner.append("")
        elif c != ")":
            if depth > 0:
                inner[-1] += c
            else:
                outside += c
    parts = [outside, *(p for held in inner for p in re.split(r" (?:and|plus|or) |[,;/]", held))]
    clean = dict.fromkeys(term(p).strip(" ,;:-") for p in parts)
    return [p for p in clean if p and (len(re.findall("[a-z0-9]{2,}", p.lower())) >= 2 or stands_alone(p))][:most]


def stands_alone(text: str) -> bool:
    """Whether a single part is a component: an acronym, something with figures, or one word of four letters or more."""
    bare = [c for c in text if c.isalnum()]
    acronym = text.isupper() and 2 <= len(bare) <= 12
    return acronym or any(c.isdigit() for c in bare) or len(text.split()) == 1 and len(bare) >= 4


def atom_groups(raw: list[dict]) -> list[Atom]:
    """Atoms of a loose description: a name (or id), a category of P, I, C or O, and terms that survive as variants."""
    out = []
    for item in raw:
        name = str(item.get("name") or item.get("id") or "").strip()
        terms = tuple(t.strip().lower() for t in map(str, item.get("terms") or ()) if t.strip())
        category = str(item.get("category") or "").upper()
        if name and category in ("P", "I", "C", "O") and any(variants(t) for t in terms):
            out.append(Atom(name, terms, category, required=bool(item.get("required"))))
    return out


# Domains by words of a question, in the order that settles ties.
DOMAINS = (
    ("machine_learning", ("machine learning", "deep learning", "neural network", "algoritmo", "modelo de aprendizaje", "clasificación", "predicción", "inteligencia artificial", "ia")),
    ("healthcare", ("salud", "medicina", "paciente", "clínico", "diagnóstico", "tratamiento", "enfermedad", "diabetes", "cáncer", "health")),
    ("education", ("educación", "aprendizaje", "estudiante", "enseñanza", "pedagogía", "e-learning", "educational", "learning")),
    ("vr_ar", ("realidad virtual", "realidad aumentada", "vr", "ar", "inmersivo", "simulación", "virtual reality")),
    ("software_engineering", ("software", "desarrollo", "programación", "código", "testing", "arquitectura", "metodología ágil")),
    ("social_sciences", ("social", "comportamiento", "actitud", "percepción", "cualitativo", "etnografía", "entrevista")),
)


def question_domain(c: Column) -> Column:
    """The domain with most of its words in a question, the earlier at a tie, the first where none is there."""
    low = F.lower(F.coalesce(c, F.lit("")))
    cells = [F.struct(sum((low.contains(w).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-k).alias("o"), F.lit(name).alias("name")) for k, (name, words) in enumerate(DOMAINS)]
    return F.array_max(F.array(*cells))["name"]


def _met(text: Column, atom: Atom, most: int = 14) -> Column:
    terms = list(dict.fromkeys(term(t).lower() for t in (*atom.terms, atom.name)))[:most]
    every = sorted({v for t in terms for v in simple_variants(t)}, key=lambda v: (-len(v), v))
    return text.rlike("|".join(C.term_pattern(v) for v in every))


def query_tier(query: Column, atoms: tuple[Atom, ...]) -> Column:
    """exact, focused or null: a query must speak of a population and a central intervention; of technical ones all or some."""
    people, central, technical = roles(atoms)
    text = F.lower(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " "))
    any_of = lambda group: F.greatest(*(_met(text, a) for a in group), F.lit(False))
    fits = (any_of(people) if people else F.lit(True)) & (any_of(central) if central else F.lit(True))
    if not technical:
        return F.when(fits, "exact")
    every = F.least(*(_met(text, a) for a in technical), F.lit(True))
    return F.when(fits & every, "exact").when(fits & any_of(technical), "focused")


def empirical_queries(atoms: tuple[Atom, ...], observed: dict[str, tuple[str, ...]], most: int = 12) -> list[tuple[str, str]]:
    """(query, tier) of a population's terms with central and technical ones, observed terms first; distinct, ``most`` at most.

    With technical terms a query is focused; each pair of population and central term closes with a core query.
    """
    people, central, technical = roles(atoms)
    if not people or not central:
        return []
    words = lambda a: list(dict.fromkeys(t.lower() for t in (*observed.get(a.name, ()), *a.terms, a.name)))[:3]
    middle = [t for a in central for t in words(a)][:4]
    ends = [t for a in technical for t in words(a)]
    every = [
        (" ".join(parts), tier) for p, c in product(words(people[0]), middle)
        for parts, tier in (*(((p, c, t), "focused") for t in ends), ((p, c), "core"))
    ][:most]
    return list(dict(reversed(every)).items())[::-1]


def safe_terms(c: Column) -> Column:
    """Terms of three characters or more that are no short acronym in capitals; trimmed."""
    flat = F.transform(c, lambda t: F.trim(t))
    return F.filter(flat, lambda t: (F.length(t) >= 3) & ~((F.length(t) <= 3) & (t == F.upper(t)) & (t != F.lower(t))))


def cascade_order(df: DataFrame) -> DataFrame:
    """Rows by coverage, relevance, number of matched concepts, bonus and citations, all descending; ties by arrival."""
    key = [F.coalesce(F.col(c), F.lit(0)).desc() for c in ("coverage", "relevance", "n_matched", "bonus", "citations")]
    return df.orderBy(*key, "ord")


def citation_order(df: DataFrame) -> DataFrame:
    """Rows by citations, relevance and year, all descending; ties by arrival."""
    return df.orderBy(*(F.coalesce(F.col(c), F.lit(0)).desc() for c in ("citations", "relevance", "year")), "ord")


def preselect(df: DataFrame, lexical: str, dense: str, most: int = 1500) -> DataFrame:
    """The rows with ``dense`` kept for the ``most`` best by ``lexical`` and 0 for all others; ties by arrival."""
    best = df.orderBy(F.col(lexical).desc(), "ord").limit(most).select("ord", F.lit(True).alias("_in"))
    return df.join(F.broadcast(best), "ord", "left").withColumn(dense, F.when(F.col("_in"), F.col(dense)).otherwise(0.0)).drop("_in")


def recovery_seeds(excluded: DataFrame, most: int = 6) -> DataFrame:
    """The strongest of the excluded articles by coverage, relevance and citations, from which a citation graph is followed."""
    return excluded.orderBy(*(F.coalesce(F.col(c), F.lit(0)).desc() for c in ("coverage", "relevance", "citations")), "ord").limit(most)
