"""Scalar column functions of the bibliographic domain: identifiers, years, languages, names, texts. All run in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folding() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one letter and marks, with that letter; then the marks, which fall away."""
    seen, kept = [], []
    for code in (*range(0xA0, 0x0530), *range(0x1E00, 0x2000)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c and plain.isalpha() and not unicodedata.combining(c):
            seen.append(c)
            kept.append(plain)
    return "".join(seen) + "".join(chr(x) for x in range(0x0300, 0x0370) if unicodedata.combining(chr(x))), "".join(kept)


ACCENTED, FOLDED = _folding()

# Language labels and their codes.
LANGUAGE_ALIASES = {
    "en": ("en", "eng", "english"), "es": ("es", "spa", "esp", "spanish", "espanol", "español"), "pt": ("pt", "por", "portuguese", "portugues", "português"),
    "fr": ("fr", "fre", "fra", "french"), "de": ("de", "ger", "deu", "german"), "it": ("it", "ita", "italian"), "zh": ("zh", "chi", "zho", "chinese"),
}
# Words by which a language is inferred; in the order that settles ties.
LANGUAGE_WORDS = {
    "en": "the and with for study studies children child results method methods using between from this that were was are have has among into".split(),
    "es": "que los las con para estudio estudios niños ninos infantil educacion educación resultados metodos métodos entre este esta son como una del".split(),
    "pt": "que com para estudo estudos criancas crianças infantil educacao educação resultados metodos métodos entre este esta sao são uma dos das pela pelo".split(),
}
# Title words that tell nothing.
TITLE_STOPWORDS = "a an the of in on for and or to with is are at by from".split()
# Venues that are none, and marks of preprint servers.
MISSING_VENUES = ("", "unknown", "none", "null", "n/d", "na", "sin revista", "sin revista / otros", "revista no disponible")
PREPRINT_MARKS = ("arxiv", "biorxiv", "medrxiv", "ssrn", "preprint", "research square")
# Titles that are software pages, and phrases of review papers.
NOISE_TITLES = (
    "github repository", "software package", "npm install", "package documentation", "official documentation", "installation guide", "read me", "readme.md",
    "release notes", "getting started guide", "bug report", "pull request", "commit log", "jenkins pipeline", "docker image", "kubernetes deployment", "configuration file",
)
REVIEW_PHRASES = (
    "systematic review", "literature review", "scoping review", "mapping study", "meta-analysis", "state of the art", "survey of", "bibliometric analysis",
    "umbrella review", "narrative review", "a review of", "overview of", "systematic mapping",
)
# Citations asked for by age in years, and study designs by their words, in order.
CITATION_STEPS = ((0, 0), (1, 0), (2, 1), (5, 3), (13, 5))
STUDY_TYPES = (
    ("estudio experimental", ("experiment", "ensayo", "randomized", "controlado")),
    ("estudio observacional", ("observacional", "observational", "cohorte", "cohort")),
    ("estudio transversal", ("transversal", "cross-sectional", "survey", "encuesta")),
    ("revisión", ("review", "revisión", "systematic", "meta-análisis")),
    ("estudio cualitativo", ("qualitative", "cualitativo", "entrevista", "interview")),
    ("estudio de caso", ("case study", "estudio de caso")),
)
# Groups of methods by their words, in order.
METHOD_MIX = (
    ("Revisiones o surveys", ("systematic review", "revisión sistemática", "literature review", "meta-analysis", "scoping review")),
    ("Estudios con evaluacion empirica", ("experiment", "randomized", "controlled trial", "quasi-experimental")),
    ("Estudios con encuesta/cuestionario", ("survey", "questionnaire", "encuesta")),
    ("Estudios de caso", ("case study", "estudio de caso")),
)
# Marks of an article's structure in lower-case text.
STRUCTURE_MARKS = (
    "methodology|metodología", "results?|resultados", "discussion|discusión", "references|referencias|bibliography", "introduction|introducción",
    "conclusion|conclusión", "section|sección", r"table\s+\d+|figure\s+\d+|tabla\s+\d+|figura\s+\d+",
)
# Parts of addresses of open repositories, and of those that ask for access.
OPEN_HOSTS = (
    "arxiv.org", "europepmc.org", "pubmedcentral", "pmc.ncbi", "biorxiv.org", "medrxiv.org", "zenodo.org", "hal.science", "hal.archives-ouvertes", "osf.io", "aclanthology.org",
    "openreview.net", "eprints.", "dspace.", "repository.", ".ac.uk", "escholarship.org", "engrxiv.org", "preprints.org", "semanticscholar.org", "figshare.com", "ssrn.com", "dergipark",
)
CLOSED_HOSTS = (
    "dl.acm.org", "link.springer.com", "www.mdpi.com", "sciencedirect.com", "wiley.com", "tandfonline", "nature.com/articles", "doi.org", "downloads.hindawi.com", "igi-global.com", "iopscience.iop.org",
)
# Sources by a part of their name, with canonical name and kind, in order.
SOURCES = (
    ("pubmed", "PubMed", "database"), ("semantic scholar", "Semantic Scholar", "database"), ("openalex", "OpenAlex", "database"), ("europe pmc", "Europe PMC", "database"), ("arxiv", "arXiv", "repository"),
    ("biorxiv", "bioRxiv", "repository"), ("medrxiv", "medRxiv", "repository"), ("bmc", "BMC", "publisher"), ("plos", "PLOS", "publisher"), ("frontiers", "Frontiers", "publisher"), ("mdpi", "MDPI", "publisher"),
    ("springer", "Springer", "publisher"), ("elsevier", "Elsevier", "publisher"), ("sciencedirect", "ScienceDirect", "publisher"), ("wiley", "Wiley", "publisher"), ("taylor & francis", "Taylor & Francis", "publisher"),
    ("sage", "SAGE", "publisher"), ("preprint", "arXiv", "repository"),
)
# Numbers of participants in a text, by the first that matches.
SAMPLE_SIZES = (r"n\s*[=:]\s*(\d+)", r"(\d+)\s+participants", r"(\d+)\s+pacientes", r"(\d+)\s+students", r"(\d+)\s+estudiantes", r"sample of (\d+)", r"muestra de (\d+)")


def text(c: str | Column) -> Column:
    """Trimmed, null as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.coalesce(c, F.lit("")))


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, FOLDED)


def contains_any(c: Column, phrases) -> Column:
    """Whether one of the phrases is a substring: a chain of contains, which needs no regular expression."""
    out = F.lit(False)
    for p in phrases:
        out = out | c.contains(p)
    return out


def first_of(c: Column, table, default: Column) -> Column:
    """The label of the first row of (label, phrases) of which a phrase is contained."""
    out = None
    for label, phrases in table:
        hit = contains_any(c, phrases)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(default)


def valid_doi(c: Column) -> Column:
    """A raw identifier long enough and not marked as absent."""
    return (F.length(text(c)) > 5) & ~F.lower(F.coalesce(c, F.lit(""))).contains("sin doi")


def normal_doi(c: Column) -> Column:
    """Lower-case bare identifier without resolver prefix and outer slashes; null unless it starts with 10."""
    bare = F.regexp_replace(text(c), r"(?i)^(?:https?://(?:dx\.)?doi\.[a-z]+/|doi:\s*)", "")
    flat = F.lower(F.regexp_replace(bare, r"^/+|/+$", ""))
    return F.when(flat.startswith("10."), flat)


def doi_in_url(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"(10\.\d{4,9}/[^\s&?#]+)", 1), r"[/.,]+$", ""), F.lit(""))


def title_tokens(c: Column) -> Column:
    """Distinct tokens of a title: folded, alphanumeric, longer than one character, without stop-words."""
    found = F.regexp_extract_all(fold_accents(F.lower(F.coalesce(c, F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*(F.lit(w) for w in TITLE_STOPWORDS))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / every).otherwise(F.lit(0.0))


def venue(journal: Column, other: Column) -> Column:
    """Normalised venue: journal, else the other, blanks collapsed, lower-case."""
    picked = F.coalesce(F.nullif(text(journal), F.lit("")), other, F.lit(""))
    return F.lower(F.trim(F.regexp_replace(picked, r"\s+", " ")))


def academic_venue(journal: Column, other: Column, year: Column) -> Column:
    v = venue(journal, other)
    return (F.coalesce(year, F.lit(0)) != 0) & ~v.isin(*MISSING_VENUES) & ~contains_any(v, PREPRINT_MARKS)


def first_year(*fields: Column) -> Column:
    """The first of some fields whose text starts with four digits, as a year; null where none does."""
    return F.coalesce(*(F.regexp_extract(c.cast("string"), r"^(\d{4})", 1).try_cast("int") for c in fields))


def bounded_int(c: Column, default: int, least: int, most: int) -> Column:
    """An integer within bounds; what is none counts as the default."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(c.try_cast("int"), F.lit(default))))


def safe_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.nullif(c.try_cast("double"), F.lit(0.0)), F.lit(default))


def truly_open(flag: Column, pdf_url: Column, url: Column, source: Column, provider_pdf: Column | None = None) -> Column:
    """Open by flag, by a file's address, by the provider's own file entry, or by place; ``provider_pdf`` is that entry."""
    if provider_pdf is not None:
        flag = F.coalesce(flag, F.lit(False)) | (text(provider_pdf.cast("string")) != "")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return (
        F.coalesce(flag, F.lit(False)) | (F.length(text(pdf_url)) > 10) | low(url).contains("arxiv") | low(source).contains("arxiv") | low(url).contains("pmc")
    )


def language_code(c: Column) -> Column:
    """Code of a language label: aliases, two letters as they are, region cut off; null for anything else."""
    raw = F.lower(text(c))
    base = F.split_part(F.replace(raw, F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    table = F.create_map(*(x for code, names in LANGUAGE_ALIASES.items() for n in names for x in (F.lit(n), F.lit(code))))
    return F.when(base == "", F.lit(None)).otherwise(F.coalesce(F.element_at(table, base), F.when(F.length(base) == 2, base)))


def inferred_language(title: Column, abstract: Column) -> Column:
    """en, es or pt by distinct telling words, two at least and two more than the next; else und."""
    low = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))
    words = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-záéíóúñüàèìòùâêîôûçãõ]+"), F.lit(0)))
    hits = {k: F.size(F.array_intersect(words, F.array(*(F.lit(w) for w in v)))) for k, v in LANGUAGE_WORDS.items()}
    en, es, pt = hits["en"], hits["es"], hits["pt"]
    best = F.greatest(en, es, pt)
    code = F.when(en == best, "en").when(es == best, "es").otherwise("pt")
    second = F.when(en == best, F.greatest(es, pt)).when(es == best, F.greatest(en, pt)).otherwise(F.greatest(en, es))
    doubtful = (best < 2) | ((second > 0) & (best < second + 2))
    return F.when(doubtful, F.lit("und")).otherwise(code)


def year_of(c: Column) -> Column:
    """The first four characters as a year, if they are digits."""
    return F.expr("try_cast(null as int)") if c is None else F.when(F.substring(c.cast("string"), 1, 4).rlike(r"^\d{4}$"), F.substring(c.cast("string"), 1, 4).try_cast("int"))


def citations_asked(year: Column, as_of: int) -> Column:
    age = F.lit(as_of) - year
    out = None
    for upto, n in CITATION_STEPS:
        out = F.when(age <= upto, F.lit(n)) if out is None else out.when(age <= upto, F.lit(n))
    return out.otherwise(F.lit(CITATION_STEPS[-1][1]))


def study_type(c: Column) -> Column:
    return first_of(c, STUDY_TYPES, F.lit(None).cast("string"))


def method_mix(c: Column) -> Column:
    return first_of(c, METHOD_MIX, F.lit("Otros enfoques metodologicos"))


def sample_size(c: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(c, "(?i)" + p, 1), F.lit("")).try_cast("bigint") for p in SAMPLE_SIZES))


def surname(author: Column) -> Column:
    """What stands before the comma, else the last word."""
    a = F.trim(author)
    return F.when(a.contains(","), F.trim(F.split_part(a, F.lit(","), F.lit(1)))).otherwise(F.element_at(F.split(a, r"\s+"), -1))


def narrative_citation(authors: Column, year: Column) -> Column:
    """Surname (year), two surnames joined by y, or the first with et al."""
    names = F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    n = F.size(names)
    who = (
        F.when(n == 0, F.lit("Autor desconocido"))
        .when(n == 1, surname(F.element_at(names, 1)))
        .when(n == 2, F.concat(surname(F.element_at(names, 1)), F.lit(" y "), surname(F.element_at(names, 2))))
        .otherwise(F.concat(surname(F.element_at(names, 1)), F.lit(" et al.")))
    )
    when = F.when(F.coalesce(year, F.lit(0)) > 0, year.cast("string")).otherwise(F.lit("s.f."))
    return F.concat(who, F.lit(" ("), when, F.lit(")"))


def reference_entry(authors: Column, year: Column, title: Column, journal: Column, doi: Column, url: Column) -> Column:
    """Authors (year). Title. Journal. Identifier; up to twenty authors, missing parts left out."""
    names = F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    who = F.when(F.size(names) == 0, F.lit("Autor desconocido")).otherwise(F.array_join(F.slice(names, 1, 20), ", "))
    when = F.when(F.coalesce(year, F.lit(0)) > 0, year.cast("string")).otherwise(F.lit("s.f."))
    link = F.coalesce(F.concat(F.lit("https://doi.org/"), normal_doi(doi)), F.nullif(text(url), F.lit("")))
    parts = [F.concat(who, F.lit(" ("), when, F.lit(").")), F.concat(F.regexp_replace(text(title), r"[.\s]+$", ""), F.lit("."))]
    tail = F.concat_ws(" ", F.concat(F.nullif(text(journal), F.lit("")), F.lit(".")), link)
    return F.trim(F.concat_ws(" ", *parts, tail))


def bibtex_key(authors: Column, year: Column, title: Column) -> Column:
    """Surname, year and first long word of the title, letters and digits alone; a hash where there is no author."""
    who = F.lower(F.regexp_replace(fold_accents(surname(F.try_element_at(authors, F.lit(1)))), "[^A-Za-z0-9]", ""))
    long_word = F.try_element_at(F.filter(title_tokens(title), lambda w: F.length(w) > 3), F.lit(1))
    key = F.concat(who, F.coalesce(year.cast("string"), F.lit("nd")), F.coalesce(long_word, F.lit("")))
    return F.coalesce(F.nullif(key, F.lit("")), F.md5(F.coalesce(title, F.lit(""))))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^<]+?>", " ")


def head_tail(c: Column, most: int, head: float = 0.68) -> Column:
    """A text over the limit as its head and its tail with a mark between."""
    a = int(most * head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, a), F.lit("\n[...]\n"), F.right(c, F.lit(most - a))))


def json_object(c: Column) -> Column:
    """The first outermost {...} of a free-form answer."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)(\{.*\})", 1), F.lit(""))


def source_kind(c: Column, publishers_only: bool = False) -> Column:
    """(kind, name) of a source's name or address: a known one, else a publisher if it has 3 to 50 characters, else null."""
    low = F.lower(F.trim(c))
    out = F.when(low.isNull() | low.isin("", "unknown"), F.lit(None))
    for part, name, kind in SOURCES:
        cell = F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"))
        out = out.when(low.contains(part), F.lit(None) if publishers_only and kind != "publisher" else cell)
    return out.when(F.length(c).between(3, 50), F.struct(F.lit("publisher").alias("kind"), F.trim(c).alias("name")))


def real_article_text(c: Column) -> Column:
    """Long text with at least two of eight families of structural marks; null and short texts have none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    n = sum((low.rlike(m).cast("int") for m in STRUCTURE_MARKS), F.lit(0))
    return F.when(F.length(low) < 6500, False).otherwise(n >= 2)


def term_pattern(term: str) -> str:
    """A term between characters that are no small letters or digits."""
    import re

    return rf"(?<![a-z0-9]){re.escape(term.lower())}(?![a-z0-9])"


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    up = (x - a) / (b - a) if b > a else F.lit(1.0)
    down = (F.lit(d) - x) / (d - c) if d > c else F.lit(1.0)
    return F.when((x < a) | (x > d), 0.0).when(x <= b, up).when(x <= c, 1.0).otherwise(down)


def triangle(x: Column, a: float, b: float, c: float) -> Column:
    return trapezoid(x, a, b, b, c)


def fuzzy_relevance(similarity: Column, domain: Column, boost: Column) -> Column:
    """Centroid of seven min-rules over similarity, domain relevance and keyword boost, with a floor that rises with the domain.

    Nulls and NaN count as 0, so the result is always a number in [0, 1].
    """
    clip = lambda c: F.least(F.greatest(F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    s, d, k = clip(similarity), clip(domain), clip(boost / 0.20)
    low, mid, high = trapezoid(s, 0, 0, 0.25, 0.45), triangle(s, 0.30, 0.55, 0.75), trapezoid(s, 0.60, 0.80, 1.0, 1.0)
    d_low, d_high = trapezoid(d, 0, 0, 0.25, 0.45), trapezoid(d, 0.35, 0.60, 1.0, 1.0)
    k_high = trapezoid(k, 0.30, 0.55, 1.0, 1.0)
    rules = (
        (F.least(high, d_high, k_high), 0.92), (F.least(high, d_high), 0.78), (F.least(high, d_low), 0.50),
        (F.least(mid, d_high, k_high), 0.75), (F.least(mid, d_high), 0.58), (F.least(mid, d_low), 0.30), (low, 0.08),
    )
    num = sum((act * v for act, v in rules), F.lit(0.0))
    den = sum((act for act, _ in rules), F.lit(0.0))
    value = num / F.when(den == 0, F.lit(1e-9)).otherwise(den)
    return F.when(d > 0, F.greatest(value, 0.08 + 0.22 * d)).otherwise(value)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda acc, z: acc + z)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def camel_split(c: Column) -> Column:
    """Words of a mixed-case identifier, parted before lower-casing; the opt-in of the tokenizer."""
    parted = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(parted), r"[^a-z0-9]+"), lambda w: w != "")


def without_citation_echo(c: Column) -> Column:
    """A sentence that names the same "Name (YYYY)" twice keeps the first mention."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(\b[A-ZÀ-Þ][\p{L}-]+ \((?:19|20)\d{2}\))([^.!?]*?),? ?\1", "$1$2")


# Typographic characters and what stands for them in data sets.
PUNCTUATION = {
    "≤": "<=", "≥": ">=", "→": "->", "←": "<-", "±": "+/-", "×": "x", "÷": "/", "°": " grados", "²": "^2", "³": "^3", "•": "-", "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"',
}


def joined_list(parts: Column) -> Column:
    """Items joined by commas and a last "y"."""
    n = F.size(parts)
    return F.when(n <= 1, F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n - 1), ", "), F.lit(" y "), F.element_at(parts, -1)))


def plain_punctuation(c: Column) -> Column:
    """Single characters by one translation, the longer replacements one by one where they occur."""
    one = {a: b for a, b in PUNCTUATION.items() if len(b) == 1}
    out = F.translate(c, "".join(one), "".join(one.values()))
    for a, b in PUNCTUATION.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def embedding_text(title: Column, abstract: Column, full: Column) -> Column:
    """What an article is embedded by: over 500 characters of full text its first 4,000, else title and abstract."""
    t, a, f = (F.coalesce(x, F.lit("")) for x in (title, abstract, full))
    return F.when(F.length(f) > 500, F.substring(f, 1, 4000)).when(a != "", F.concat(t, F.lit(". "), F.substring(a, 1, 1500))).otherwise(t)


def short_context(abstract: Column, full: Column, most: int = 150_000) -> Column:
    return F.when(F.length(full) > 1000, F.substring(full, 1, most)).otherwise(abstract)


def ieee_links(url: Column) -> Column:
    """Addresses under which a document of this host may lie, its own first; one for all others."""
    number = F.coalesce(F.nullif(F.regexp_extract(url, r"arnumber=(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"/document/(\d+)", 1), F.lit("")))
    host = "https://ieeexplore.ieee.org/"
    more = [F.concat(F.lit(host + "stampPDF/getPDF.jsp?tp=&arnumber="), number, F.lit("&ref=")), F.concat(F.lit(host + "stamp/stamp.jsp?tp=&arnumber="), number), F.concat(F.lit(host + "stamp/stamp.jsp?arnumber="), number)]
    known = url.contains("ieeexplore.ieee.org") | url.contains("xplorestaging.ieee.org")
    return F.when(known & number.isNotNull(), F.array_distinct(F.array(url, *more))).otherwise(F.array(url))


def is_pdf(content: Column, content_type: Column) -> Column:
    """Whether bytes are a PDF: no HTML by type, 5,000 bytes or more, and the mark at their start."""
    return ~F.lower(F.coalesce(content_type, F.lit(""))).contains("text/html") & (F.octet_length(content) >= 5000) & (F.substring(content, 1, 5) == F.encode(F.lit("%PDF-"), "UTF-8"))


def first_citations(citations: Column, most: int = 5) -> Column:
    return F.array_join(F.slice(F.coalesce(citations, F.array().cast("array<string>")), 1, most), ", ")
