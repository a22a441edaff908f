"""Problem 7: text damaged by a wrong character encoding.

Characters are mapped back to the bytes of a legacy code page. Over those bytes runs an automaton of the UTF-8
byte structure, written as a regular expression over byte classes; its maximal well-formed multibyte spans are decoded,
and nothing else of the field changes. Doubly damaged text takes more rounds. Besides the multibyte spans there are
swaps of two single-byte code pages, told by characters that cannot stand where they stand, and characters that are
lost for good (replacement characters and question marks inside words).

A cheap pattern inside the JVM decides which fields reach Python at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGES = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251")
#: (read as, was): single-byte pages taken for one another
SWAPS = (
    ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"),
    ("cp437", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"),
)

# Well-formed multibyte sequences by byte class (The Unicode Standard, table 3-7), maximal.
AUTOMATON = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
# What decoded characters may be: Latin letters and signs, Greek, punctuation, currency, letterlike, arrows, operators.
PLAUSIBLE = re.compile("[\x80-ſˆ-˝Α-ω‐-⁄€™←-↔∀-⋿─-▟ﬁﬂ]")
LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
ODD = "¢-©¬®¯²-¶¸¹»-¾«¡¿†‡‚„ƒˆ‰‹›•˜™˙˚˘ﬁﬂ∞∂√∫≈≠◊∑∏"
EVIDENCE = tuple(
    (kind, re.compile(p))
    for kind, p in (
        ("lost", "�"),
        ("controls", "[\x80-\x9f]"),
        ("boxes", "[─-▟]"),
        # a sign between two letters, or after a small letter and before a blank; quotes and marks of regular use excepted
        ("sign in word", f"[{LATIN}][{ODD}·](?=[{LATIN}{ODD}])"),
        ("sign in word", f"[{LATIN}][¢-¥¦¨¬¯´˙˚ˆ˘¸‰ƒ„‚∞∂¾‡]"),
        ("sign in word", "[a-zß-ÿ]…\\s+(?=[a-zß-ÿ])|[a-zß-ÿ,] … (?=\\w)"),
        ("digits", "\\d[âÂÃ]\\d"),
        # leading bytes whose followers were stripped as controls
        ("stripped", f"[a-zA-Z]â(?=[.,;:)]?\\s)|[a-z]âs(?![{LATIN}])|(?:^|[\\s(])â(?=[A-Z])|\\b[lLdDnNsSmMtTjJcC]â(?=[aeiouhéèê])|ÃÃ|(?<![{LATIN}])Ã[A-ZÀ-Þ]|Ã[B-DF-NPQRT-Za-zß-ÿ]"),
        ("quotes", "(?:^|[\\s(])[ìÒî](?=[A-Z])|\\b(?:[lLdDnNsScCmMtTjJ]|qu|[Aa]ll|[Dd]ell|[Nn]ell|[Ss]ull|[Uu]n)í[aeiouhàâéèêíîôù]|\\bnís\\b"),
        ("lone sign", "(?:^|[\\s(])[‡˙ˆ˚¸‚ƒ˘](?=[\\s).,;:]|$)"),
        ("lone sign", f"(?:^|\\s)[‹˙ˆ˚¸‰£¤¢‚ƒ‡Š˜š](?=[a-zß-ÿ]{{2}})"),
        ("case", "[a-zß-öø-ÿ][À-ÖØ-Þ]"),
        ("lone letter", f"(?<![{LATIN}'’-])[æøñÆıœóõãçßË](?![{LATIN}'’-])"),
        ("unit", "\\d ?[æø∞ñÆΩ](?:g|C|L|m|F)\\b"),
        ("small dotless", "ı"),
        ("ligature", f"[{LATIN}][ﬁﬂ]|[ﬁﬂ][{LATIN}]"),
        ("question", f"[{LATIN}]\\?+[{LATIN}]"),
        ("question", "(?:^|[\\s(«“\"])\\?+[A-Za-zÀ-ſ]"),
        ("question", "(?:^|[\\s(])\\?+ (?=[a-z0-9=<>≤≥ß-ÿ])"),
        ("question", "[0-9] \\?+ (?=[0-9A-Za-z])|\\d ?\\?(?:g|C|L|m)\\b"),
    )
)
PAIR, RUNS = re.compile("[^\x00-\x7f]{2}"), re.compile("[^\x00-\x7f]{2,}")
CYRILLIC, LATIN_RE = re.compile("[Ѐ-ӿ]"), re.compile(f"[{LATIN}]")
URL = re.compile(r"\w+://\S+")
#: a character that sound text of the six languages does not have
ALIEN = "[^\\x00-\\x7fáéíóúüñçãõâêôàèìòùäöß–’“”±]"
#: sound letters where they cannot stand; the class comes first, so that most characters fail at once
MISPLACED = (
    "[ñóõãçß](?<![A-Za-zÀ-ſ].)(?![A-Za-zÀ-ſ])|â(?<=[0-9]â)|â(?=[.,;:)]?\\s)|â(?=s(?![a-zß-ÿ]))|â(?<=(?:^|[\\s(])â)(?=[A-Z])|â(?<=\\b[lLdDnNsSmMtTjJcC]â)|[ìî](?<=(?:^|[\\s(]).)|í(?<=[dlLnscCmMtTjJN]í)(?=[aeiouhàâéèêíîôùs])"
)
ASKING = "\\?(?=[^\\s\"”»)])|\\?(?<=(?:^|[\\s(])\\?)"


@lru_cache
def _to_bytes(page: str) -> dict[int, int]:
    """Translation of characters to the code points of their bytes; all other non-ASCII characters to 0x100."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(page)
        except UnicodeDecodeError:
            c = chr(b)  # undefined bytes pass as controls
        table[ord(c)] = b
        if page == "cp1252":
            table.setdefault(b, b)  # and what a strict reader leaves as a control
    return table


class _Bytes(dict):
    def __missing__(self, key: int) -> int:
        return key if key < 0x80 else 0x100


@lru_cache
def _mapper(page: str) -> _Bytes:
    return _Bytes(_to_bytes(page))


@lru_cache
def _swap(read_as: str, was: str) -> dict[int, str]:
    out = {}
    for c, b in _to_bytes(read_as).items():
        try:
            d = bytes([b]).decode(was)
        except UnicodeDecodeError:
            continue
        if ord(d) != c:
            out[c] = d
    return out


def spans(text: str, page: str) -> list[tuple[int, int, str]]:
    """(start, end, decoded) of the maximal well-formed multibyte spans that decode to plausible characters."""
    found = []
    for run in RUNS.finditer(text):  # multibyte sequences hold no ASCII
        for m in AUTOMATON.finditer(run.group().translate(_mapper(page))):
            decoded = m.group().encode("latin-1").decode("utf-8")
            if all(PLAUSIBLE.match(c) for c in decoded):
                found.append((run.start() + m.start(), run.start() + m.end(), decoded))
    return found


def decode_spans(text: str) -> tuple[str, int]:
    """The text with its multibyte spans decoded, round by round, and the number of spans."""
    n = 0
    for _ in range(4):
        if not PAIR.search(text):
            break
        best: list = []
        for page in PAGES:
            got = spans(text, page)
            if sum(e - s for s, e, _ in got) > sum(e - s for s, e, _ in best):
                best = got
        if not best:
            break
        n += len(best)
        out, at = [], 0
        for s, e, d in best:
            out += text[at:s], d
            at = e
        text = "".join(out) + text[at:]
    return text, n


_ASCII = frozenset(map(chr, range(0x80)))
#: characters of which a kind of evidence needs one
_NEEDS = {
    "lost": "�", "controls": "".join(map(chr, range(0x80, 0xA0))), "boxes": "".join(map(chr, range(0x2500, 0x25A0))),
    "sign in word": "".join(chr(c) for c in (*range(0xA1, 0xC0), 0x2020, 0x2021, 0x201A, 0x201E, 0x192, 0x2C6, 0x2030, 0x2039, 0x203A, 0x2022, 0x2122, 0x2DC, 0x2D9, 0x2DA, 0x2D8, 0xFB01, 0xFB02, 0x221E, 0x2202, 0x221A, 0x222B, 0x2248, 0x2260, 0x25CA, 0x2211, 0x220F, 0x2026)),
    "digits": "âÂÃ", "stripped": "âÃ", "quotes": "ìÒîí", "lone sign": "‡˙ˆ˚¸‚ƒ˘‹‰£¤¢Š˜š", "case": "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7), "lone letter": "æøñÆıœóõãçßË",
    "unit": "æø∞ñÆΩ", "small dotless": "ı", "ligature": "ﬁﬂ",
}
_NEEDS = {k: frozenset(v) for k, v in _NEEDS.items()}


def evidence(text: str) -> set[str]:
    there = set(text).difference(_ASCII)
    asks = "?" in text
    if not there and not asks:
        return set()
    bare = URL.sub(" ", text) if "://" in text else text
    kinds: set[str] = set()
    for kind, p in EVIDENCE:
        if kind not in kinds and (asks if kind == "question" else there & _NEEDS[kind]) and p.search(bare):
            kinds.add(kind)
    if any("Ѐ" <= c <= "ӿ" for c in there) and len(CYRILLIC.findall(bare)) * 4 < len(LATIN_RE.findall(bare)):
        kinds.add("alphabet")
    return kinds


_WORDLIKE = re.compile(f"[a-zß-öø-ÿ]+|[A-ZÀ-Þ][a-zß-öø-ÿ]*|[A-ZÀ-Þ]+")
_COMMON = set("áéíóúüñçãõâêôàèìòùäößëïîûœÁÉÍÓÚÜÑÇÃÕÂÊÔÀÈÄÖ")
_SIGNS = set("–—’‘“”…±°µ§½¾¼€«»¿¡©®²³ºª·≥≤αβ")


def unswap(text: str) -> str:
    """The swap of pages that leaves the fewest signs of damage and the most common letters; else the text as it is."""
    best, score = text, (len(evidence(text)), sum(not c.isascii() and c not in _COMMON and c not in _SIGNS for c in text), 0)
    for read_as, was in SWAPS:
        table = _swap(read_as, was)
        tokens = re.split(r"(\s+)", text)
        for i, tok in enumerate(tokens):
            if not tok.isascii() and (evidence(tok) or not _WORDLIKE.fullmatch(tok.strip(".,;:()¿?!"))):
                new = tok.translate(table)
                if len(evidence(new)) <= len(evidence(tok)):
                    tokens[i] = new
        new = "".join(tokens)
        odd = sum(not c.isascii() and c not in _COMMON and c not in _SIGNS for c in new)
        rank = (len(evidence(new)), odd, -sum(c in _COMMON for c in new))
        if new != text and rank < score:
            best, score = new, rank
    return best


def repair(text: str | None) -> tuple[bool, str | None, bool]:
    """(damaged, the text restored as far as it can be, whether nothing is left)."""
    if not text:
        return False, text, True
    fixed, n = decode_spans(text)
    kinds = evidence(fixed)
    if n == 0 and not kinds:
        return False, text, True
    if kinds - {"lost", "question"}:
        fixed = unswap(fixed)
    return True, fixed, not evidence(fixed)


def suspicious(c: Column) -> Column:
    """Whether a field has to be looked at; pure ASCII without question marks is decided by its lengths alone."""
    plain = F.octet_length(c) == F.length(c)
    return (~plain & (c.rlike(ALIEN) | c.rlike(MISPLACED))) | (c.contains("?") & c.rlike(ASKING))


def find_damaged(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """One row per damaged field: id, field_name, original, restored, complete.

    ``complete`` is false where characters are lost for good; ``restored`` then holds the rest. Null, empty and
    sound fields give no row; equal rows give one each; other columns are ignored. No shuffle: a projection, a filter
    and one Arrow pass over the suspicious fields.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("original")) for f in fields)))
    picked = (
        df.select(F.col(id_col).alias("_id"), cells.alias("c")).select("_id", "c.field_name", "c.original")
        .where(suspicious(F.col("original")))
    )
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("original").to_pylist()
            done = [repair(t) for t in texts]
            keep = [i for i, d in enumerate(done) if d[0]]
            if keep:
                part = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([done[i][1] for i in keep], pa.string()), pa.array([done[i][2] for i in keep])],
                    names=["_id", "field_name", "original", "restored", "complete"],
                )

    out = picked.mapInArrow(run, f"_id {kind}, field_name string, original string, restored string, complete boolean")
    return out.withColumnRenamed("_id", id_col)
