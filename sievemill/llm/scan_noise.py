"""Problem 4: noise of scanned pages, and its repair into continuous paragraphs.

Page numbers and words divided at a line's end are found by their shape, running headers by their shape and by being
repeated as lines of their own in other texts of the same paper; whether a divided word is one
word or a compound with its own hyphen is for the corpus lexicon to say. Misread words come out of a symmetric-delete
index: the lexicon's words and all words of the corpus are filed under what is left after up to two deletions,
words that share a key are candidates, and a weighted edit distance keeps those that differ by known confusions
alone. A correction must be far more frequent than what it corrects; among several, the word before decides by bigram
counts. Lexicon, bigrams and candidates cover all texts; equal texts are treated once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.runtime import stored

# Fixed values: (seen, meant) pairs of characters that scanning confuses.
CONFUSIONS = (
    ("c", "e"), ("@", "a"), ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"), ("l", "1"), ("f", "t"), ("t", "f"), ("ſ", "f"), ("ſ", "s"), ("0", "o"), ("o", "0"),
    ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("q", "g"), ("3", "e"), ("2", "z"), ("e", "c"), ("h", "b"), ("b", "h"), ("u", "n"), ("n", "u"), ("v", "y"),
    ("rn", "m"), ("m", "rn"), ("m", "in"), ("in", "m"), ("ni", "m"), ("iii", "m"), ("nn", "m"), ("ii", "u"), ("ii", "n"), ("u", "ii"), ("li", "u"), ("vv", "w"), ("w", "vv"),
    ("cl", "d"), ("d", "cl"), ("li", "h"), ("lı", "h"), ("h", "li"), ("ri", "n"), ("n", "ri"), ("tl", "d"), ("l<", "k"), ("ij", "y"), ("|", "l"), ("!", "l"), ("¡", "i"), ("$", "s"), ("€", "e"),
)


@dataclass(frozen=True)
class ScanPlan:
    common: int = 6  # uses that are evidence enough of a word; how much more frequent it must be than what it corrects, the ratios say
    standing: float = 30e-6  # share of each part in all words, from which an unknown pair of words is a compound
    ratio: float = 12.0  # how much more frequent a correction is
    ratio_odd: float = 3.0  # the same where a digit or sign stands among letters
    cost: float = 0.25  # of one confusion; any other edit costs 1
    most_cost: float = 0.8
    least_length: int = 3
    misread: int = 3  # words, from which a text counts as misread
    broadcast_words: int = 200_000  # a counted word list up to this length (some 20 MB) goes to the executors; a longer one is joined by a shuffle


CAP = r"[A-ZÀ-Þ@0-9][\w@ſ|<]*"
# A pattern that starts with a rare sign is looked for first; what stands before it decides.
JOURNALS = tuple(
    (re.compile(tail, re.I if fold else 0), re.compile(head, re.I if fold else 0))
    for tail, head, fold in (
        # a title of the form "x of y" with volume and number, or volume and year
        (r",? V[o0]?[l1I]?\. ?[\dlOoSI]+(?:, N[o0]\. ?[\dlOoSI]+)?", rf"(?:{CAP} ){{0,2}}{CAP} (?:of|de|del|di|da|do|du|des|für|f[uü]r) (?:(?:the|la|las|los|el) )?(?:[\w@ſ]+ ){{0,3}}[\w@ſ]+$", True),
        (r"[\dlOoSI]{1,4} \([\dlOoSIg]{4}\)", rf"(?:{CAP} ){{0,2}}{CAP} (?:of|de|del|di|da|do|du|des|für) (?:[A-ZÀ-Þ][\w@ſ]* ){{1,4}}$", False),
    )
)
SPACED_GATE = re.compile(r"[A-ZÀ-Þ@0-9] {1,3}[A-ZÀ-Þ@0-9] {1,3}[A-ZÀ-Þ@0-9] {1,3}[A-ZÀ-Þ@0-9]")
SPACED = re.compile(r"(?:(?<![^\s])[A-ZÀ-Þ@0-9](?: {1,3}|$)){5,}(?![^\s])|(?:(?<![^\s])[A-ZÀ-Þ@] {1,3}){5,}[A-ZÀ-Þ@](?![^\s])")
# authors, perhaps with the title
ET_AL = re.compile(r"(?:e[tf] a[l1I]|ET A[LI1])\.")
NAME_BEFORE = re.compile(r"[A-ZÀ-Þ][\w@ſß-ÿ’'-]* $")
TITLE_AFTER = re.compile(r",? ?[|:–—-] [^\n]{3,90}?(?=\n|$| (?:[–—-] ?\d|\[?\d{1,4}\]?(?: |$)|p\. ?\d|P[áa]g))")
PAIR = re.compile(r" (?:and|y|e|et|und) [A-ZÀ-Þ][\w@ſ]+: (?=[A-ZÀ-Þ])")
PAIR_BEFORE = re.compile(r"(?:(?<=\n)|(?<=[.!?\d\]–—-] )|\A|(?<=[a-zß-ÿ,] ))[A-ZÀ-Þ][\w@ſ]+$")
PAIR_TITLE, PAIR_INLINE = re.compile(r"[^\n.]{6,91}?(?=\n|$|\. )"), re.compile(r"[\w@ſ ]{6,61}")
# two short runs that begin with capitals, joined by a dash, on a line of their own or where a sentence reads on around them
SERIES = re.compile(r" [–—] (?=[A-ZÀ-Þ0-9@])")
SERIES_BEFORE = re.compile(r"(?:\A|(?<=\n)|(?<=[a-zß-ÿ,.\d\]–—-] ))[A-ZÀ-Þ][\w@ſ|<]+(?: [a-zß-ÿ\d@ſ|<][\w@ſ|<]*){0,2}$")
PAGE_NEXT = re.compile(r"\s*(?:\n|$)|\s+(?:[–—\[|-] ?)?\d{1,4}(?=\s|\]|$| ?[–—-])|\s+[^\W\d_]{1,6}\. ?\d|\s+[Pp]age \d")
SERIES_AFTER = re.compile(r"[\w@ſ|<]+(?: [a-zß-ÿ@ſ\d]+)?(?=\n|$| )")
PAGES = (
    re.compile(r"(?:[Pp]|[Pp][áaà@][g9]|[Pp][áa]gina|[Ss]|[Ss]eite|pp)\. ?[\dlOoSI]{1,4}(?![\w%]|[.,]\d)"),
    re.compile(r"[Pp]a[g9][eae] [\dlOoSI]{1,4} (?:of|de|von|di|sur) [\dlOoSI]{1,4}\b"),
    re.compile(r"(?:\A|\n)\s*(?:[Pp]age|[Pp]ágina|[Ss]eite|[Pp]agina) \d{1,4}\s*(?=\n|$)"),
)
# these stand between blanks
PAGES_APART = (
    re.compile(r"[–—-] ?[\dlOoSI]{1,4} ?[–—-](?=\s|$)"),
    re.compile(r"\[[\dlOoSI]{1,4}\](?=\s|$)"),
    re.compile(r"\d{1,4} \| \d{1,4}(?=\s|$)"),
)
CAPS_GATE = re.compile(r"[A-ZÀ-Þ]{3}")
CAPS_LINE = re.compile(r"(?:(?<=\n)|^)[ \t]*(?=[^\na-zß-ÿ]*[A-ZÀ-Þ]{3})[^\na-zß-ÿ]{18,}?(?=\n|$)")
CAPS_RUN = re.compile(r"(?<=[a-zß-ÿ.,;:] )(?:[A-ZÀ-Þ@]{1,}[A-ZÀ-Þ@’'-]* ){4,}[A-ZÀ-Þ]{2,}(?= |$)")
LONE = re.compile(r"(?:\A|\n)([ \t]*\d{1,4}[ \t]*)(?=\r?\n|\Z)")
SEE = re.compile(r"(?i)\bsee\s*$")
MARK = re.compile(r"(?<=[^\W\d_])[-¬\xad‐](?:[ \t]*\r?\n[ \t]*| +)(?=[^\W\d_])")
WORD_END, WORD_START = re.compile(r"[^\W_]+\Z"), re.compile(r"[^\W_]+")
SOFT = re.compile("[¬\xad]")
TOKEN = re.compile(r"[^\W_]+(?:[@|!¡$€<][^\W_]+)*|@[^\W_]+(?:@[^\W_]*)*")
COMPOUND = re.compile(r"(?<![^\W_])[^\W\d_]++(?:-[^\W\d_]++)+")
# Words after a hyphen that stays open
CONJUNCTIONS = {"and", "or", "to", "y", "o", "u", "e", "ou", "et", "und", "oder", "bis", "bzw", "sowie", "ed", "a", "als", "versus", "vs", "but", "mid"}
#: characters that scanning confuses, as one
ALIKE = str.maketrans({"c": "e", "3": "e", "@": "a", "i": "l", "1": "l", "|": "l", "!": "l", "ı": "l", "t": "f", "ſ": "f", "0": "o", "5": "s", "6": "b", "8": "b", "h": "b", "9": "g", "q": "g", "2": "z", "u": "n", "v": "y"})
PAGE_EDGE = re.compile(r"^(?:[^\W\d_]{0,6}\.? ?[–—\[|-]? ?\d{1,4} ?[\]|–—-]? ?)|(?: ?[–—\[|-]? ?\d{1,4} ?[\]|–—-]?)$")


def back(text: str, at: int, pattern: re.Pattern, reach: int = 64) -> re.Match | None:
    """The match of a pattern that ends at a place; the piece looked at grows until the match no longer touches its start."""
    while True:
        begin = max(0, at - reach)
        m = pattern.search(text, begin, at)
        if begin == 0 or m and m.start() > begin + 1 or not m and not text[begin:at].isalnum():
            return m
        reach *= 4


def divisions(text: str) -> list[tuple[int, int, str, str, str, str]]:
    """Hyphens before a line's end or a blank, as (start, end, left word, mark, gap, right word), without overlaps."""
    out, done = [], 0
    for m in MARK.finditer(text):
        left = back(text, m.start(), WORD_END)
        right = WORD_START.match(text, m.end())
        if left and left.start() >= done:
            out.append((left.start(), right.end(), left.group(), m.group()[0], m.group()[1:], right.group()))
            done = right.end()
    return out


def _replace(text: str, spots, put) -> str:
    out, at = [], 0
    for spot in spots:
        out += text[at : spot[0]], put(spot)
        at = spot[1]
    return "".join(out) + text[at:]


def _heads(text: str) -> list[tuple[int, int]]:
    """Running headers by their shape."""
    out = []
    for tail, head in JOURNALS:
        for m in tail.finditer(text):
            if h := back(text, m.start(), head, 128):
                out.append((h.start(), m.end()))
    if SPACED_GATE.search(text):
        out += [m.span() for m in SPACED.finditer(text)]
    for m in ET_AL.finditer(text):
        if name := back(text, m.start(), NAME_BEFORE):
            title = TITLE_AFTER.match(text, m.end())
            out.append((name.start(), title.end() if title else m.end()))
    for m in PAIR.finditer(text):
        if name := back(text, m.start(), PAIR_BEFORE):
            inline = name.start() > 1 and (text[name.start() - 2].islower() or text[name.start() - 2] == ",") and text[name.start() - 1] == " "
            if title := (PAIR_INLINE if inline else PAIR_TITLE).match(text, m.end()):
                out.append((name.start(), title.end()))
    for m in SERIES.finditer(text):
        if (first := back(text, m.start(), SERIES_BEFORE)) and (last := SERIES_AFTER.match(text, m.end())):
            a, b = first.start(), last.end()
            stopped = a > 1 and text[a - 2] == "."
            if " " in first.group() + text[last.start() : b] and (not stopped and text[a - 1 : a] != "\n" or PAGE_NEXT.match(text, b)):
                out.append((a, b))
    if CAPS_GATE.search(text) and sum(map(str.islower, text)) > 0.5 * sum(map(str.isalpha, text)):
        out += [m.span() for p in (CAPS_LINE, CAPS_RUN) for m in p.finditer(text)]
    return out


def _find(text: str, more: list[tuple[int, int]] = ()) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of running headers, those told by repetition (``more``) included, and of printed page numbers."""
    heads = _heads(text) + list(more)
    pages = []
    for p in PAGES:
        for m in p.finditer(text):
            a = m.start()
            if (not a or not (text[a - 1].isalnum() or text[a - 1] in "._")) and not SEE.search(text, max(0, a - 8), a):
                pages.append(m.span())
    for p in PAGES_APART:
        for m in p.finditer(text):
            a = m.start()
            if (not a or text[a - 1].isspace()) and not SEE.search(text, max(0, a - 8), a):
                pages.append(m.span())
    for m in LONE.finditer(text):
        a, b = m.span(1)
        before = text[:a].rstrip("\n\r \t").rpartition("\n")[2]
        after = text[b:].lstrip("\r\n \t").partition("\n")[0]
        figures = re.fullmatch(r"[\s\d.,%|–-]*", before) or re.search(r"[:=]\s*[\d.,%]*\s*$", before) or re.fullmatch(r"[\d.,%\s–-]+", after.strip())
        if re.search(r"\S[ \t]{2,}\S", before) or re.search(r"\S[ \t]{2,}\S", after):
            figures = True
        if not figures and (before or after):
            pages.append((a, b))
        elif any(h[1] <= a and not text[h[1] : a].strip() or b <= h[0] and not text[b : h[0]].strip() for h in heads):
            pages.append((a, b))
    for h in heads:  # a bare number beside a header
        if m := re.match(r"\s*,? ?(\d{1,4})(?=\s|$)", text[h[1] : h[1] + 20]):
            at = h[1] + m.start(1)
            if not any(x < at + 1 and at < y for x, y in heads + pages) and re.match(r"[ \t]", text[h[1] : h[1] + 1] or "x") and not re.match(r"\s+[a-zß-ÿ%]", text[h[1] + m.end() : h[1] + m.end() + 20]):
                pages.append((at, h[1] + m.end(1)))
    return _merge(heads), _merge(pages)


def own_lines(text: str) -> list[dict]:
    """Lines that may be running headers if the paper repeats them: (h, before, start, end).

    ``h`` is a hash of the line without page numbers, with characters that scanning confuses taken as one; ``before`` one of
    the line before. A line counts from three words on, if it begins with a capital or figure and ends without a stop.
    """
    if "\n" not in text:
        return []
    out, at, before = [], 0, 0
    for line in text.split("\n"):
        body = line.strip()
        if body and len(body) <= 120 and (body[0].isupper() or body[0].isdigit() or body[0] == "@") and body[-1] not in ".!?:;,-¬\xad‐":
            words = TOKEN.findall(PAGE_EDGE.sub("", PAGE_EDGE.sub("", body)).lower())
            if len(words) >= 3 and any(w[0].isalpha() for w in words):
                flat = "".join(words).translate(ALIKE).replace("rn", "m")
                out.append({"h": zlib.crc32(flat.encode()) << 16 ^ len(flat), "before": before, "start": at, "end": at + len(line)})
        if body:
            before = zlib.crc32(body.encode())
        at += len(line) + 1
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; what they stood between is joined by one blank or line break."""
    out, at = [], 0
    for a, b in spans:
        left, right = text[at:a], text[b:]
        out.append(left)
        gap = "\n" if "\n" in left[-2:] + right[:2] else " "
        if not left.endswith(gap) and not right.startswith(gap):
            out.append(gap)
        at = b
    out.append(text[at:])
    return "".join(out)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads, pages, hyphens, words, joined, bigrams, lines = [], [], [], [], [], [], []
        for text in batch.column("text").to_pylist():
            h, p = _find(text)
            heads.append(len(h))
            pages.append(len(p))
            body = without(text, _merge(h + p))
            marks = []
            spots = divisions(body)
            for _, _, left, mark, gap, right in spots:
                soft = bool(SOFT.match(mark))
                if right.lower() not in CONJUNCTIONS or soft:
                    marks.append({"left": left.lower(), "right": right.lower(), "soft": soft, "line": "\n" in gap})
            hyphens.append(marks)
            joined.append([m["left"] + m["right"] for m in marks])
            flat = _replace(body, spots, lambda _: " ").lower()
            found = TOKEN.findall(flat)
            # a text may start and stop within a word
            tail = body.rstrip()[-1:]
            inner = found[1 if body[:1].islower() else 0 : -1 if tail.isalnum() else None]
            words.append(inner + (COMPOUND.findall(flat) if "-" in flat else []))
            bigrams.append(inner)
            lines.append(own_lines(text))
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string()), ("soft", pa.bool_()), ("line", pa.bool_())]))
        spots_kind = pa.list_(pa.struct([("h", pa.int64()), ("before", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(heads, pa.int32()), pa.array(pages, pa.int32()), pa.array(hyphens, kind), pa.array(words, pa.list_(pa.string())), pa.array(joined, pa.list_(pa.string())), pa.array(bigrams, pa.list_(pa.string())), pa.array(lines, spots_kind)],
            names=["key", "heads", "pages", "hyphens", "words", "joined", "running", "lines"],
        )


def deletes(word: str, most: int = 2, prefix: int = 10) -> set[str]:
    """What is left of a word's beginning after up to ``most`` deletions.

    Words within ``most`` edits share one of these whatever their length, as long as the beginning is longer than the edits:
    what an edit shifts out of it costs one deletion on the other side.
    """
    level = {word[:prefix]}
    out = set(level)
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


def _delete_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, at = [], []
        for i, w in enumerate(batch.column("w").to_pylist()):
            for d in deletes(w):
                data = d.encode()
                keys.append(zlib.crc32(data) << 31 ^ zlib.adler32(data))
                at.append(i)
        part = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), part.column("w"), part.column("n")], names=["k", "w", "n"])


_PAIRS: dict[str, list[str]] = {}
for _a, _b in CONFUSIONS:
    _PAIRS.setdefault(_a, []).append(_b)


def weighted_distance(seen: str, meant: str, cost: float, most: float) -> float:
    """Edit distance in which a known confusion costs ``cost`` and any other edit 1; cut off above ``most``."""
    # what both begin and end with is left out but for two characters, as a confusion may reach into it
    short = min(len(seen), len(meant))
    a = next((i for i in range(short) if seen[i] != meant[i]), short)
    z = next((i for i in range(short - a) if seen[-1 - i] != meant[-1 - i]), short - a)
    a, z = max(0, a - 2), max(0, z - 2)
    seen, meant = seen[a : len(seen) - z], meant[a : len(meant) - z]
    n, m = len(seen), len(meant)
    far = most + 1
    if n > m + 6 or m > n + 6 or n > 40:  # beyond what few confusions can do
        return far
    table = [[far] * (m + 1) for _ in range(n + 1)]
    table[0][0] = 0.0
    for i in range(n + 1):
        row = table[i]
        if i and min(row) > most and min(table[i - 1]) > most and (i < 2 or min(table[i - 2]) > most):
            return far
        for j in range(m + 1):
            here = row[j]
            if here > most:
                continue
            if i < n and j < m and seen[i] == meant[j]:
                if here < table[i + 1][j + 1]:
                    table[i + 1][j + 1] = here
            for k in (1, 2, 3):
                for b in _PAIRS.get(seen[i : i + k], ()) if i + k <= n else ():
                    if meant.startswith(b, j) and here + cost < table[i + k][j + len(b)]:
                        table[i + k][j + len(b)] = here + cost
            for di, dj in ((1, 1), (1, 0), (0, 1)):
                if i + di <= n and j + dj <= m and here + 1 < table[i + di][j + dj]:
                    table[i + di][j + dj] = here + 1
    return table[n][m]


def _judge(plan: ScanPlan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [weighted_distance(s, m, plan.cost, plan.most_cost) for s, m in zip(batch.column("w").to_pylist(), batch.column("meant").to_pylist(), strict=True)]
            keep = [i for i, c in enumerate(costs) if c <= plan.most_cost]
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("w"), part.column("n"), part.column("meant"), part.column("uses"), pa.array([costs[i] for i in keep], pa.float64())], names=["w", "n", "meant", "uses", "cost"])

    return run


def candidates(lexicon: DataFrame, plan: ScanPlan) -> DataFrame:
    """(w, n, meant, uses, cost): corrections of words by more frequent ones, from the symmetric-delete index."""
    fit = lexicon.where((F.length("w") >= plan.least_length) & ~F.col("w").contains("-"))
    odd = F.col("w").rlike(r"\p{L}[0-9@|!¡$€<]|[0-9@|!¡$€<]\p{L}")
    # a word that is as frequent as any correction could be allowed to be is none; digits alone are no words
    asked = fit.where(F.col("w").rlike(r"\p{L}"))
    known = fit.where((F.col("n") >= plan.common) & F.col("w").rlike(r"^\p{L}+$"))
    file = lambda df: df.select("w", "n").mapInArrow(_delete_keys, "k long, w string, n long")
    # the planner takes the keys for as small as the lexicon's file, so the join is told not to broadcast them
    right = file(known).select("k", F.col("w").alias("meant"), F.col("n").alias("uses")).hint("shuffle_hash")
    ratio = F.when(odd, F.lit(plan.ratio_odd)).otherwise(F.lit(plan.ratio))
    met = file(asked).join(right, "k").where((F.col("w") != F.col("meant")) & (F.col("uses") >= F.col("n") * ratio) & (F.abs(F.length("w") - F.length("meant")) <= 6))
    pairs = met.select("w", "n", "meant", "uses").distinct()
    return pairs.mapInArrow(_judge(plan), "w string, n long, meant string, uses long, cost double")


@dataclass
class Scans:
    texts: DataFrame  # key, text
    parsed: DataFrame
    repeated: DataFrame  # key, spans: lines that other texts of the paper repeat
    divided: DataFrame  # key, left, right, kept: whether the hyphen stays
    fixes: DataFrame  # key, w, meant, times


def _repeated(df: DataFrame, parsed: DataFrame, text_col: str, paper_col: str | None) -> DataFrame:
    """(key, spans) of lines that stand in two or more different texts of one paper after different lines.

    Least and greatest key and preceding line are all that is kept of a line, so that a paper of any size is no burden.
    """
    if paper_col is None or paper_col not in df.columns:
        return parsed.where("false").select("key", "lines").withColumn("spans", F.expr("cast(null as array<struct<start:int,end:int>>)")).select("key", "spans")
    lines = parsed.where("size(lines) > 0").select("key", F.explode("lines").alias("l")).select("key", "l.*")
    papers = df.where(F.col(text_col).isNotNull() & F.col(paper_col).isNotNull()).select(F.xxhash64(text_col).alias("key"), F.col(paper_col).alias("paper")).distinct()
    held = papers.join(lines.hint("merge"), "key")
    of = held.groupBy("paper", "h").agg(F.min("key").alias("k0"), F.max("key").alias("k1"), F.min("before").alias("b0"), F.max("before").alias("b1"))
    twice = of.where("k0 != k1 and b0 != b1").select("paper", "h")
    return held.join(twice.hint("merge"), ["paper", "h"]).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _prepare(df: DataFrame, text_col: str, paper_col: str | None, plan: ScanPlan) -> Scans:
    texts = df.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    schema = (
        "key long, heads int, pages int, hyphens array<struct<left:string,right:string,soft:boolean,line:boolean>>, words array<string>, joined array<string>, "
        "running array<string>, lines array<struct<h:long,before:long,start:int,end:int>>"
    )
    parsed = stored(texts.mapInArrow(_parse, schema), "scans")
    # the joined forms of divided words may be misread, but are no witnesses of a word
    one_each = parsed.select("key", F.explode("words").alias("w"), F.lit(1).alias("own")).unionAll(parsed.select("key", F.explode("joined").alias("w"), F.lit(0).alias("own")))
    lexicon = stored(one_each.groupBy("w").agg(F.sum("own").alias("n")), "lexicon")
    total = lexicon.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # divided words: one word, unless the lexicon knows the compound better. No join here may broadcast: files are smaller than rows
    marks = parsed.where("size(hyphens) > 0").select("key", F.explode("hyphens").alias("h")).select("key", "h.*")
    joined, hyphened = F.concat("left", "right"), F.concat_ws("-", "left", "right")
    forms = marks.select("left", "right").distinct()
    asked = forms.select("left", "right", F.explode(F.array(*(F.struct(F.lit(role).alias("role"), w.alias("w")) for role, w in ((0, joined), (1, hyphened), (2, F.col("left")), (3, F.col("right"))))) ).alias("q")).select("left", "right", "q.*")
    known = asked.join(lexicon.hint("merge"), "w", "left").groupBy("left", "right").agg(*(F.coalesce(F.max(F.when(F.col("role") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in enumerate(("as_one", "as_compound", "n_left", "n_right"))))
    # without a word or a compound to go by: two words of their own are a compound
    kept = F.when(F.col("as_one") + F.col("as_compound") > 0, F.col("as_compound") >= F.col("as_one")).otherwise(F.least("n_left", "n_right") >= max(2.0, plan.standing * total))
    divided = marks.join(known.select("left", "right", kept.alias("kept")).hint("merge"), ["left", "right"]).withColumn("kept", F.col("kept") & ~F.col("soft"))
    # misread words, the best correction by cost, bigrams and frequency
    found = stored(candidates(lexicon, plan), "candidates")
    best = found.withColumn("least", F.min("cost").over(Window.partitionBy("w"))).where("cost <= least + 1e-9").drop("least")
    counted = stored(best.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("w"))).select("w", "meant", "uses", "k"), "best")
    few = counted.count() <= plan.broadcast_words
    clear = counted.where("k = 1").select("w", "meant")
    fixes = one_each.select("key", "w").join(_to(clear, few), "w").groupBy("key", "w", "meant").agg(F.count(F.lit(1)).alias("times"))
    doubtful = _by_context(parsed, counted.where("k > 1").select("w", "meant", "uses"), few)
    return Scans(texts, parsed, _repeated(df, parsed, text_col, paper_col), divided, fixes.unionByName(doubtful))


def _to(words: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(words) if few else words.hint("merge")


def _by_context(parsed: DataFrame, unclear: DataFrame, few: bool) -> DataFrame:
    """Corrections of words with several candidates: the one that follows the word before it most often, then the most used."""
    at = F.explode(F.arrays_zip(F.slice("running", 1, F.greatest(F.size("running") - 1, F.lit(0))).alias("a"), F.slice("running", 2, F.greatest(F.size("running"), F.lit(1))).alias("b"))).alias("p")
    pairs = parsed.where("size(running) > 1").select("key", at).select("key", "p.a", "p.b")
    # pairs that end in a candidate are counted over all texts, those that end in an unclear word are asked for
    counts = pairs.join(_to(unclear.select(F.col("meant").alias("b")).distinct(), few), "b", "left_semi").groupBy("a", F.col("b").alias("meant")).agg(F.count(F.lit(1)).alias("n"))
    seen = pairs.join(_to(unclear.select(F.col("w").alias("b")).distinct(), few), "b", "left_semi").select("key", "a", "b")
    asked = seen.select("a", "b").distinct().join(_to(unclear.withColumnRenamed("w", "b"), few), "b")
    ranked = asked.join(counts.hint("merge"), ["a", "meant"], "left").groupBy("a", "b").agg(F.max(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "uses", "meant")).alias("top"))
    return seen.join(ranked.hint("merge"), ["a", "b"]).groupBy("key", F.col("b").alias("w"), F.col("top.meant").alias("meant")).agg(F.count(F.lit(1)).alias("times"))


def scan_noise(df: DataFrame, id_col: str = "raw_id", text_col: str = "chunk", plan: ScanPlan = ScanPlan(), paper_col: str | None = "record_id") -> DataFrame:
    """(id, noise_kind): hyphenation, misread, header, page_number; one row per row and kind of noise in it.

    ``paper_col`` names the paper of a text; without it, repeated lines tell nothing. A null or empty text gives no row; equal texts have the same noise; other columns are ignored.
    """
    s = _prepare(df, text_col, paper_col, plan)
    shapes = s.parsed.select("key", F.explode(F.array(F.when(F.col("heads") > 0, F.lit("header")), F.when(F.col("pages") > 0, F.lit("page_number")))).alias("noise_kind")).where("noise_kind is not null")
    divided = s.divided.where("not kept").select("key", F.lit("hyphenation").alias("noise_kind")).distinct()
    misread = s.fixes.groupBy("key").agg(F.sum("times").alias("n")).where(F.col("n") >= plan.misread).select("key", F.lit("misread").alias("noise_kind"))
    repeated = s.repeated.select("key", F.lit("header").alias("noise_kind"))
    kinds = shapes.unionAll(repeated).unionAll(divided).unionAll(misread).distinct()
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.xxhash64(text_col).alias("key"))
    return rows.join(kinds.hint("merge"), "key").select(id_col, "noise_kind").distinct()


def restore(text: str, joins: set[tuple[str, str]], fixes: dict[str, str], more: list[tuple[int, int]] = ()) -> str:
    """Continuous paragraphs: headers and page numbers out, divided words joined, misread words put right."""
    h, p = _find(text, more)
    body = without(text, _merge(h + p))

    def join(spot: tuple) -> str:
        a, b, left, mark, gap, right = spot
        if (left.lower(), right.lower()) in joins:
            return left + right
        return body[a:b] if "\n" not in gap else f"{left}{mark}{right}"

    body = _replace(body, divisions(body), join)

    def put_right(m: re.Match) -> str:
        new = fixes.get(m.group().lower())
        if new is None:
            return m.group()
        old = m.group()
        return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new

    body = TOKEN.sub(put_right, body) if fixes else body
    tables = re.compile(r"\S[ \t]{2,}\S|^[\d\s.,%|–-]+$")
    paragraphs = []
    for block in re.split(r"\n[ \t\r]*\n", body.replace("\r\n", "\n")):
        lines = [x for x in block.split("\n") if x.strip()]
        if any(tables.search(x) for x in lines):
            paragraphs.append("\n".join(lines))
        elif lines:
            paragraphs.append(" ".join(x.strip() if k else x.rstrip() for k, x in enumerate(lines)))
    return "\n\n".join(paragraphs)


def repaired(df: DataFrame, id_col: str = "raw_id", text_col: str = "chunk", plan: ScanPlan = ScanPlan(), paper_col: str | None = "record_id") -> DataFrame:
    """(id, text): every row with its text repaired; sound text is untouched, null stays null."""
    s = _prepare(df, text_col, paper_col, plan)
    joins = s.divided.where("not kept").groupBy("key").agg(F.collect_set(F.struct("left", "right")).alias("joins"))
    enough = s.fixes.groupBy("key").agg(F.collect_set(F.struct("w", "meant")).alias("fixes"), F.sum("times").alias("n")).where(F.col("n") >= plan.misread).drop("n")
    shaped = s.parsed.where("heads + pages > 0").select("key", F.lit(True).alias("shaped"))
    texts = s.texts
    for part in (joins, enough, shaped, s.repeated):
        texts = texts.join(part.hint("merge"), "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, j, f, x, r in zip(*(batch.column(c).to_pylist() for c in ("text", "joins", "fixes", "shaped", "spans")), strict=True):
                if not (j or f or x or r):
                    out.append(t)
                    continue
                out.append(restore(t, {(a["left"], a["right"]) for a in j or ()}, {a["w"]: a["meant"] for a in f or ()}, [(a["start"], a["end"]) for a in r or ()]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.string())], names=["key", "fixed"])

    fixed = texts.select("key", "text", "joins", "fixes", "shaped", "spans").mapInArrow(run, "key long, fixed string")
    rows = df.select(F.col(id_col), F.xxhash64(text_col).alias("key"), F.col(text_col).isNotNull().alias("_has"))
    return rows.join(fixed.hint("merge"), "key", "left").select(id_col, F.when(F.col("_has"), F.col("fixed")).alias("text"))
