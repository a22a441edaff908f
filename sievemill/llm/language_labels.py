"""Problem 1: a language, with a confidence, for every record and every passage of it.

The classifier is a sparse multinomial logistic regression on TF-IDF character n-grams. N-grams lie within words
padded by a blank; the term frequency of a passage is relative to all its n-grams, so that the score of
a passage is the mean of the scores of its words and each word is scored once per process. Training is
follow-the-regularised-leader (proximal, per coordinate) with elastic-net penalties; a temperature fitted on held-out
passages, wrongly labelled ones included, calibrates the confidence. It is fitted on a bounded sample of labelled rows (``LanguagePlan.per_language``
rows of each language, those with the least hash), whose labels may partly be wrong: a first model removes passages
that contradict their label, the second is the one that is used. Every row is scored, over its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.text import usable

LANGUAGES = ("en", "es", "pt", "fr", "de", "it")

# How labels name the six languages (codes, and names in these languages).
LABEL_NAMES = {
    "en": ("en", "eng", "english", "inglés", "ingles", "inglês", "anglais", "englisch", "inglese"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "castilian", "espanhol", "espagnol", "spanisch", "spagnolo"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugués", "portugais", "portugiesisch", "portoghese"),
    "fr": ("fr", "fre", "fra", "french", "français", "francais", "francés", "frances", "francês", "französisch", "francese"),
    "de": ("de", "ger", "deu", "german", "deutsch", "alemán", "aleman", "alemão", "allemand", "tedesco"),
    "it": ("it", "ita", "italian", "italiano", "italien", "italienisch"),
}


@dataclass(frozen=True)
class LanguagePlan:
    per_language: int = 400  # bound of the training sample, in rows of each language
    passages: int = 9000  # and in passages
    grams: tuple[int, int] = (1, 4)
    buckets: int = 1 << 17
    alpha: float = 0.05  # follow-the-regularised-leader: step size, its smoothing, and the two penalties
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 20.0
    epochs: int = 2
    least_words: int = 4  # a passage with fewer words tells nothing by itself, unless it is a title
    sure: float = 0.8  # confidence from which a passage counts as of its language


def normal_label(c: Column) -> Column:
    """Two-letter code of a label: codes, names, region tags or one-item lists; null for anything that names none."""
    flat = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]'\"\s]", ""))
    base = F.regexp_extract(flat, r"^([\p{L}]+)", 1)
    table = F.create_map(*(x for code, names in LABEL_NAMES.items() for n in names for x in (F.lit(n), F.lit(code))))
    return F.element_at(table, base)


SENTENCE = re.compile(r"(?:(?<=[.!?…])(?<!\b[DMS]r\.)(?<!\bDra\.)(?<!\b[A-Z]\.)|(?<=[.!?…][\"'’”»)]))\s+|[\r\n]+|<[^<>]{1,60}>")
WORDS = re.compile(r"[^\W\d_]+")
SMALL = re.compile(r"(?<![^\W_])[a-zß-öø-ÿ]{2,}(?![^\W_])")


def telling_words(text: str) -> list[str]:
    """Lower-case words of a passage without what may be names: after the first word, those that begin with a capital.

    Where fewer than three words begin small, as in titles and shouted text, all words count."""
    words = WORDS.findall(text)
    small = [w for w in words[1:] if w[0].islower()]
    if len(small) < 3:
        return [w.lower() for w in words]
    return [words[0].lower(), *(w.lower() for w in small)]


def passages(text: str) -> list[tuple[int, int]]:
    """Sentences and lines of a text as (start, end)."""
    out, at = [], 0
    for m in SENTENCE.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def word_grams(word: str, plan: LanguagePlan) -> np.ndarray:
    padded = f" {word} "
    lo, hi = plan.grams
    return np.array(
        [zlib.crc32(padded[i : i + n].encode()) & (plan.buckets - 1) for n in range(lo, hi + 1) for i in range(len(padded) - n + 1)],
        dtype=np.int64,
    )


class LanguageModel:
    """Weights already multiplied by the inverse document frequencies; a passage's score is a mean over its n-grams."""

    def __init__(self, plan: LanguagePlan) -> None:
        self.plan = plan
        self.weights = np.zeros((plan.buckets, len(LANGUAGES)), dtype=np.float32)
        self.bias = np.zeros(len(LANGUAGES))
        self.temperature = 1.0
        self.wrong = 0.0  # estimated share of wrong labels among the held-out passages
        self.error = 0.0  # expected calibration error on them

    def fit(self, rows: list[tuple[str, int]], held_out: list[tuple[str, int]] | None = None, seed: int = 7) -> LanguageModel:
        """Fits on rows of (passage, language); the temperature on ``held_out``, or on a fifth of the rows where none are given."""
        plan, k = self.plan, len(LANGUAGES)
        rng = np.random.default_rng(seed)
        feats, labels = [], []
        df = np.zeros(plan.buckets)
        for text, label in rows:
            grams = [word_grams(w, plan) for w in telling_words(text)]
            if not grams:
                continue
            idx, n = np.unique(np.concatenate(grams), return_counts=True)
            df[idx] += 1
            feats.append((idx, n / n.sum()))
            labels.append(label)
        if not feats:
            return self
        idf = np.log((1 + len(feats)) / (1 + df)) + 1
        order = rng.permutation(len(feats))
        held, train = (order[: len(order) // 5], order[len(order) // 5 :]) if held_out is None else (order[:0], order)
        z, s = np.zeros((plan.buckets, k)), np.zeros((plan.buckets, k))

        def leader(i: np.ndarray) -> np.ndarray:
            zi = z[i]
            shrunk = np.sign(zi) * plan.l1 - zi
            return np.where(np.abs(zi) <= plan.l1, 0.0, shrunk / ((plan.beta + np.sqrt(s[i])) / plan.alpha + plan.l2))

        bias, share = np.zeros(k), np.zeros(k)
        scale = 30.0
        # a small sample is passed more often
        for _ in range(max(plan.epochs, min(12, round(plan.epochs * 0.8 * plan.passages / max(1, len(train)))))):
            for j in rng.permutation(train):
                i, tf = feats[j]
                x = tf * idf[i] * scale
                w = leader(i)
                logit = x @ w + bias
                p = np.exp(logit - logit.max())
                p /= p.sum()
                p[labels[j]] -= 1
                g = x[:, None] * p
                s_new = s[i] + g * g
                z[i] += g - (np.sqrt(s_new) - np.sqrt(s[i])) / plan.alpha * w
                s[i] = s_new
                share += p * p
                bias -= 0.1 * p / np.sqrt(1 + share)
        self.weights = (leader(np.arange(plan.buckets)) * (idf * scale)[:, None]).astype(np.float32)
        self.bias = bias
        outside = [(np.unique(np.concatenate(g), return_counts=True), label) for text, label in held_out or () if (g := [word_grams(w, plan) for w in telling_words(text)])]
        pairs = [(feats[j], labels[j]) for j in held] + [((i, n / n.sum()), label) for (i, n), label in outside]
        if pairs:
            self._calibrate(np.array([self.weights[i].T @ tf + bias for (i, tf), _ in pairs]), np.array([label for _, label in pairs]))
        return self

    def _calibrate(self, logits: np.ndarray, truth: np.ndarray) -> None:
        """Temperature by likelihood of labels of which a share, fitted as well, is drawn at random: wrong labels do not lower the confidence."""
        k, best = len(LANGUAGES), None
        for t in np.geomspace(0.1, 10, 41):
            q = logits / t
            q = np.exp(q - q.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            for wrong in (0.0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3):
                p = (1 - wrong) * q + wrong / k
                loss = -float(np.log(np.maximum(p[np.arange(len(q)), truth], 1e-12)).mean())
                if best is None or loss < best[0]:
                    best = (loss, float(t), wrong, p)
        _, self.temperature, self.wrong, p = best
        top, hit = p.max(1), p.argmax(1) == truth
        cell = np.minimum((top * 10).astype(int), 9)
        self.error = float(sum(abs(top[cell == c].mean() - hit[cell == c].mean()) * (cell == c).mean() for c in np.unique(cell)))

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(1, keepdims=True)


class WordScores:
    """Scores of words, each computed once; emptied when it grows large."""

    def __init__(self, model: LanguageModel, most: int = 500_000) -> None:
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((4096, len(LANGUAGES) + 1), dtype=np.float64)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.most:
            self.clear()
        index = self.index
        for w in set(words).difference(index):
            g = word_grams(w, self.model.plan)
            n = len(index)
            if n == len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[n, :-1] = self.model.weights[g].sum(0)
            self.table[n, -1] = len(g)
            index[w] = n
        return self.table[np.fromiter((index[w] for w in words), np.int64, len(words))]


def score(texts: list[str], model: LanguageModel, cache: WordScores) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the languages, and the number of words, for each text."""
    flat: list[str] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        w = telling_words(t)
        counts[i] = len(w)
        flat += w
    sums = np.zeros((len(texts), len(LANGUAGES) + 1))
    if flat:
        some = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[some]
        sums[some] = np.add.reduceat(cache.rows(flat), starts, axis=0)
    return model.probabilities(sums[:, :-1], sums[:, -1]), counts


# Seed sentences, written for this module: they carry the fit where few rows are labelled.
SEEDS = {
    "en": (
        "The aim of this study was to find out how the patients felt after the treatment.", "We asked the nurses which of the forms had been filled in and when they were sent.",
        "There were no differences between the two groups at the end of the year.", "It is not known whether these results hold for other people with the same disease.",
        "All of the data are available from the authors, who would like to thank everyone that took part.", "Further work should look at the costs and at what happens in the long run.",
        "Does the use of reminders improve the quality of care for older adults?", "The effect of exercise on sleep in young people: a review of the evidence",
    ),
    "es": (
        "El objetivo de este estudio fue conocer cómo se sintieron los pacientes después del tratamiento.", "Preguntamos a las enfermeras cuáles de los formularios se habían rellenado y cuándo se enviaron.",
        "No hubo diferencias entre los dos grupos al final del año.", "No se sabe si estos resultados son válidos para otras personas con la misma enfermedad.",
        "Todos los datos están disponibles y los autores agradecen a quienes participaron.", "Hacen falta más trabajos sobre los costes y sobre lo que ocurre a largo plazo.",
        "¿Mejora el uso de avisos la calidad de la atención a las personas mayores?", "El efecto del ejercicio sobre el sueño en los jóvenes: una revisión de la evidencia",
    ),
    "pt": (
        "O objetivo deste estudo foi saber como os pacientes se sentiram depois do tratamento.", "Perguntamos às enfermeiras quais dos formulários tinham sido preenchidos e quando foram enviados.",
        "Não houve diferenças entre os dois grupos no fim do ano.", "Não se sabe se estes resultados são válidos para outras pessoas com a mesma doença.",
        "Todos os dados estão disponíveis e os autores agradecem a quem participou.", "São necessários mais trabalhos sobre os custos e sobre o que acontece a longo prazo.",
        "O uso de avisos melhora a qualidade da atenção às pessoas idosas?", "O efeito do exercício sobre o sono em jovens: uma revisão da evidência",
    ),
    "fr": (
        "Le but de cette étude était de savoir comment les patients se sentaient après le traitement.", "Nous avons demandé aux infirmières lesquels des formulaires avaient été remplis et quand ils ont été envoyés.",
        "Il n’y avait pas de différence entre les deux groupes à la fin de l’année.", "On ne sait pas si ces résultats valent pour d’autres personnes atteintes de la même maladie.",
        "Toutes les données sont disponibles et les auteurs remercient ceux qui ont participé.", "D’autres travaux devront porter sur les coûts et sur ce qui se passe à long terme.",
        "Les rappels améliorent-ils la qualité des soins chez les personnes âgées ?", "L’effet de l’exercice sur le sommeil chez les jeunes : une revue des preuves",
    ),
    "de": (
        "Ziel dieser Studie war es, herauszufinden, wie sich die Patienten nach der Behandlung fühlten.", "Wir fragten die Pflegekräfte, welche der Bögen ausgefüllt und wann sie abgeschickt wurden.",
        "Am Ende des Jahres gab es keine Unterschiede zwischen den beiden Gruppen.", "Es ist nicht bekannt, ob diese Ergebnisse auch für andere Menschen mit derselben Krankheit gelten.",
        "Alle Daten sind verfügbar, und wir danken denen, die an der Befragung teilgenommen haben.", "Weitere Arbeiten sollten die Kosten und die Folgen auf lange Sicht untersuchen.",
        "Verbessern Erinnerungen die Versorgung älterer Menschen?", "Die Wirkung von Bewegung auf den Schlaf bei Jugendlichen: eine Übersicht",
    ),
    "it": (
        "Lo scopo di questo studio era capire come si sentivano i pazienti dopo il trattamento.", "Abbiamo chiesto alle infermiere quali dei moduli erano stati compilati e quando sono stati inviati.",
        "Non c’erano differenze tra i due gruppi alla fine dell’anno.", "Non è noto se questi risultati valgano anche per altre persone con la stessa malattia.",
        "Tutti i dati sono disponibili e gli autori ringraziano chi ha partecipato.", "Servono altri lavori sui costi e su ciò che accade nel lungo periodo.",
        "L’uso di promemoria migliora la qualità delle cure per gli anziani?", "L’effetto dell’esercizio sul sonno nei giovani: una revisione delle prove",
    ),
}


def train(df: DataFrame, plan: LanguagePlan = LanguagePlan()) -> LanguageModel:
    """Fits the classifier on a bounded sample of the labelled rows of (title, abstract, language)."""
    code = normal_label(F.col("language"))
    text = F.concat_ws("\n", F.when(usable(F.col("title")), F.col("title")), F.when(usable(F.col("abstract")), F.col("abstract")))
    rows = df.select(code.alias("code"), text.alias("text")).where("code is not null and length(text) > 40")
    rank = F.row_number().over(Window.partitionBy("code").orderBy("h", "text"))
    picked = rows.withColumn("h", F.xxhash64("text")).withColumn("r", rank).where(F.col("r") <= plan.per_language)
    sample = sorted((r["code"], r["text"]) for r in picked.select("code", "text").collect())
    rng = np.random.default_rng(3)
    units = [
        (text[a:b], LANGUAGES.index(code))
        for code, text in sample
        for a, b in passages(text)
        if len(WORDS.findall(text[a:b])) >= plan.least_words
    ]
    units = [units[i] for i in np.sort(rng.permutation(len(units))[: plan.passages])]
    seeds = [(t, LANGUAGES.index(code)) for code, ts in SEEDS.items() for t in ts] * 3
    # a fifth is held out before anything is known of its labels
    held = [u for u in units if zlib.crc32(u[0].encode()) % 5 == 0]
    units = [u for u in units if zlib.crc32(u[0].encode()) % 5] + seeds
    first = LanguageModel(plan).fit(units, held)
    p, _ = score([t for t, _ in units], first, WordScores(first))
    truth = np.array([label for _, label in units])
    kept = p.argmax(1) == truth
    return LanguageModel(plan).fit([u for u, ok in zip(units, kept, strict=True) if ok], held)


SEGMENTS = "array<struct<field_name:string,start:int,end:int,language:string,confidence:double,counts:boolean>>"


def _segmenter(model: LanguageModel, fields: tuple[str, ...]):
    plan = model.plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordScores(model)
        for batch in batches:
            units: list[str] = []
            where: list[tuple[int, int, int, int]] = []  # row, field, start, end
            for f, name in enumerate(fields):
                for row, text in enumerate(batch.column(name).to_pylist()):
                    if text:
                        for a, b in passages(text) if name != "title" else [(0, len(text))]:
                            units.append(text[a:b])
                            where.append((row, f, a, b))
            p, n = score(units, model, cache)
            best, top = p.argmax(1), p.max(1)
            rows: list[list] = [[] for _ in range(batch.num_rows)]
            mass = np.zeros((batch.num_rows, len(LANGUAGES)))
            sums = np.zeros(batch.num_rows)
            for u, (row, f, a, b) in enumerate(where):
                least = 3 if fields[f] == "title" else plan.least_words
                counts = bool(n[u] >= least and top[u] >= plan.sure)
                if counts and fields[f] != "title":
                    # names alone tell no language: three small words at least, unless all is in capitals
                    counts = len(SMALL.findall(units[u])) >= 3 or units[u].isupper()
                weight = float(n[u])
                mass[row] += p[u] * weight
                sums[row] += weight
                segs, lang = rows[row], LANGUAGES[best[u]]
                last = segs[-1] if segs else None
                if last and last["field_name"] == fields[f] and (last["language"] == lang or not counts):
                    # short or doubtful passages go with the one before
                    if last["language"] == lang:
                        w = last.pop("w")
                        last["confidence"] = (last["confidence"] * w + float(top[u]) * weight) / max(w + weight, 1e-9)
                        last["w"] = w + weight
                        last["counts"] |= counts
                    last["end"] = b
                    continue
                segs.append({"field_name": fields[f], "start": a, "end": b, "language": lang, "confidence": float(top[u]), "counts": counts, "w": weight})
            for segs in rows:
                for s in segs:
                    s.pop("w")
                    s["confidence"] = round(s["confidence"], 6)
            share = mass / np.maximum(sums, 1e-9)[:, None]
            told = sums > 0
            lang = [LANGUAGES[i] if ok else None for i, ok in zip(share.argmax(1), told, strict=True)]
            conf = [round(float(x), 6) if ok else None for x, ok in zip(share.max(1), told, strict=True)]
            kind = pa.list_(pa.struct([("field_name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("language", pa.string()), ("confidence", pa.float64()), ("counts", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(lang, pa.string()), pa.array(conf, pa.float64()), pa.array(rows, kind)],
                names=["id", "label", "language", "confidence", "segments"],
            )

    return run


def label_languages(
    df: DataFrame, model: LanguageModel, id_col: str = "record_id", label_col: str = "language", fields: tuple[str, ...] = ("title", "abstract")
) -> DataFrame:
    """One row per record: id, label (two-letter code or null), language, confidence, segments.

    ``segments`` are the passages of one language in order, as (field_name, start, end, language, confidence, counts);
    ``counts`` is false for what is too short or too doubtful to prove its language. Null, blank and placeholder
    fields give no segment, a record without any has a null language; equal rows give one each; other
    columns are ignored. One Arrow pass, no shuffle.
    """
    src = df.select(
        F.col(id_col).alias("id"), normal_label(F.col(label_col)).alias("label"), *(F.when(usable(F.col(f)), F.col(f)).alias(f) for f in fields)
    )
    kind = dict(df.dtypes)[id_col]
    out = src.mapInArrow(_segmenter(model, fields), f"id {kind}, label string, language string, confidence double, segments {SEGMENTS}")
    return out.withColumnRenamed("id", id_col)


def wrong_labels(labelled: DataFrame, id_col: str = "record_id") -> DataFrame:
    """(id, language): every language present in a record whose label is missing or wrong, or that holds several."""
    present = F.array_distinct(F.transform(F.filter("segments", lambda s: s["counts"]), lambda s: s["language"]))
    # where no passage proves anything, the record's own language is all there is
    held = F.when(F.size(present) > 0, present).when(F.col("language").isNotNull(), F.array("language")).otherwise(F.array())
    cases = labelled.select(id_col, "label", held.alias("held")).where(
        F.col("label").isNull() | (F.size("held") > 1) | ~F.array_contains("held", F.coalesce("label", F.lit("")))
    )
    return cases.select(id_col, F.explode("held").alias("language"))
