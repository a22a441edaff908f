"""Problem 2: defective answers among (request, passage, answer) rows.

Answers are brought to a canonical form (numbers, codes and names as placeholders, no accents) and the distinct forms
are sorted; a form that its followers in the sort order start with is a shortened version of them. The neighbours'
common prefixes, spikes in the lengths of answers without a final stop, and a word list of the answers' inner words tell
what breaks off. Rules on copying, refusing and language settle the rest. Per row the first defect holds of:
empty, refusal, copy, wrong_language, truncated.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.language_labels import LANGUAGES, LanguageModel, WordScores, score
from sievemill.runtime import stored

#: the regular way of this data to say that the passage lacks the value
NO_INFORMATION = re.compile(r"^\s*\[\s*SIN INFORMACI[OÓ]N\s*\]", re.I)
FILLERS = {
    "null", "none", "nan", "nil", "na", "nd", "n a", "n d", "s d", "sd", "n/a", "tbd", "pendiente", "vacio", "empty", "undefined", "unknown",
    "no aplica", "no procede", "sin respuesta", "sin dato", "sin datos", "xxx", "xx", "x", "todo", "lorem ipsum",
}
REFUSALS = re.compile(
    r"""(?ix)
    \b(as\ an?\ (?:ai|language\ model|assistant)|como\ (?:modelo\ de\ (?:lenguaje|ia)|(?:una?\ )?(?:ia|inteligencia\ artificial|asistente))
      |como\ (?:um\ )?modelo\ de\ linguagem|en\ tant\ que\ (?:mod[eè]le|assistant|ia)|als\ (?:ki|sprachmodell)|come\ modello\ linguistico)\b
    |\bI\s?(?:'|’)?\s?(?:m|am)\ (?:sorry|unable|afraid|not\ able|not\ allowed)\b
    |\bI\ (?:can(?:'|’)?t|cannot|can\ not|won(?:'|’)?t|will\ not|must\ decline|do\ not\ have\ access|don(?:'|’)t\ have\ access|decline|refuse|would\ rather\ not|prefer\ not)\b
    |\bbeyond\ what\ I\ am\b|^\W*(?:apologies|unfortunately,?\ (?:I|that|this)|sorry)\b
    |^\W*(?:lo\ siento|lo\ lamento|perd[oó]n|disculpen?|disculpa|lamento|me\ temo|por\ mis\ normas|desculpe|sinto\ muito|lamento|infelizmente|desol[eé]|d[eé]sol[eé]
        |je\ suis\ d[eé]sol[eé]|malheureusement|je\ regrette|es\ tut\ mir\ leid|entschuldigung|leider|mi\ dispiace|spiacente|purtroppo|mi\ scuso)\b
    |\bno\ (?:puedo|estoy\ autorizad[oa]|tengo\ (?:acceso|permiso)|me\ es\ posible|est[aá]\ permitido|se\ me\ permite)\b[^.]{0,40}\b(?:ayudar|responder|extraer|opinar|acceder|leer|cumplir|contestar|proporcionar|ofrecer|dar|documento|contenido|solicitud|petici[oó]n)\b
    |\bprefiero\ no\ (?:responder|contestar|opinar)\b|\bconsulte\ a\ un\ profesional\b|\bno\ puedo\ (?:ayudar|opinar|cumplir|atender)
    |\bn[aã]o\ (?:posso|estou\ autorizad[oa]|tenho\ acesso|me\ [eé]\ poss[ií]vel|consigo)\b|\bprefiro\ n[aã]o\b
    |\bje\ ne\ (?:peux|suis|puis|dispose|souhaite)\b|\bje\ n(?:'|’)ai\ pas\ acc[eè]s\b|\bich\ (?:kann|darf|m[oö]chte)\b[^.]{0,60}\bnicht\b|\bich\ habe\ keinen\ zugriff\b
    |\bnon\ (?:posso|sono\ (?:in\ grado|autorizzat[oa])|ho\ accesso)\b|\bpreferisco\ non\b
    """
)
REQUEST = re.compile(
    r"(?i)^\W*(?:extra(?:iga|e|er|ct|ia|yez|hiere|hieren|i|ire)|indi(?:que|ca|car|quez|chi)|identif\w+|diga|d[ií]gase|se[nñ]ale|responda|complete|rellene|what|which|give|state|please|find|cu[aá]l|qu[eé]|qual|quel|quelle|donnez|nenne\w*|welche\w*|was|bitte|quale|trov\w+|dato solicitado|campo|columna|pregunta|instrucci[oó]n|tarea)\b"
)
FUNCTION_WORDS = set(
    "a al ante bajo con contra cada como cual cuando cuyo de del desde donde e el en entre es esta este fue fueron ha hacia han hasta la las le lo los mas "
    "mediante muy ni no o para pero por porque que se segun si sin sobre su sus tras u un una unas unos y ya".split()
)
# Words that hold sentences together, by language; without accents.
TELLING = {
    "en": "the of and was were to in is are by after than that for with on from at we this not no were has have been which between into its their".split(),
    "es": "el los las y una con para que del se su un en la de al lo por sin mas fue fueron hubo cada desde hasta tras solo no durante segun".split(),
    "pt": "o os as e uma com para que do da dos das em nao um no na ao pelo pela por foi foram mais sem apos ate cada desde entre".split(),
    "fr": "le les des et une avec pour que du est la de au aux dans en ont ete par sur sont nous ces cette un ce ne pas leur plus".split(),
    "de": "der die das und mit von fur den ist zu im wurde nach bei ein eine wurden nicht auf dem des sind wir als aus uber war waren am".split(),
    "it": "il gli della delle dei e una con per che di la e nel nella sono non del al dal le lo abbiamo un sul sulla da dopo stati state piu".split(),
}
_ACCENTS = {ord(c): unicodedata.normalize("NFD", c)[0] for c in "áàâãäéèêëíìîïóòôõöúùûüñçÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇ"}
CODE = re.compile(r"\b[A-ZÑ]{2,}[A-Z0-9]*-?\d+\b")
NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
NAME = re.compile(r"(?<=[a-zß-ÿ0-9,;)] )[A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)*")
TOKEN = re.compile(r"[^\W_]+")
SOLID = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class DefectPlan:
    least_copy: int = 20  # letters and digits of an answer that stand in its passage in one piece
    sure: float = 0.97  # of a language other than Spanish
    least_words: int = 3  # for a language to be told
    common: float = 7e-6  # share of all inner words from which a word is known; five uses at least
    own: float = 3e-6  # the same for an ending to be a word of its own; two uses at least
    few: float = 1e-3  # share of all answers under which a form that twice as many go on from may be cut; ten at least
    least_form: int = 3  # letters of a form that others may be seen to go on from
    spike: float = 6.0  # answers of one length, over the mean of the lengths around


def fold(text: str) -> str:
    return text.translate(_ACCENTS).lower()


def without_label(output: str, label: str | None) -> str:
    """The answer without an introduction by its label."""
    if label:
        m = re.match(r"\W*" + re.escape(fold(label)) + r"\s*[:.=–-]\s*", fold(output))
        if m and m.end() < len(output):
            return output[m.end() :]
    return output


def canonical(output: str, label: str | None) -> str:
    body = NO_INFORMATION.sub("", without_label(output.strip(), label))
    body = NAME.sub("N", NUMBER.sub("0", CODE.sub("C", " ".join(body.split()))))
    return fold(body).strip(" \t.")


def solid(text: str) -> str:
    return SOLID.sub("", text.lower())


def by_rules(output: str | None, label: str | None, passage: str | None, plan: DefectPlan) -> str | None:
    """empty, refusal or copy, or nothing of these."""
    if output is None or not TOKEN.search(output) or " ".join(TOKEN.findall(fold(output))) in FILLERS or fold(output).strip(" .[]()") in FILLERS:
        return "empty"
    marked = bool(NO_INFORMATION.match(output))
    if not marked and REFUSALS.search(output):
        return "refusal"
    if marked:
        return None
    whole = solid(fold(output))
    if label:
        name = solid(fold(label))
        if whole == name or (REQUEST.match(output) and name in whole) or (output.strip().endswith("?") and name in whole):
            return "copy"
    if REQUEST.match(output) and re.search(r"[«\"“'].{3,60}[»\"”']", output) and re.search(r"(?i)fragmento|pasaje|texto|passage|extract|text|trecho|abschnitt|brano|extrait", output):
        return "copy"
    if passage:
        body = solid(without_label(output, label))
        text = solid(passage)
        if len(body) >= plan.least_copy and body in text:
            return "copy"
        if len(body) >= 2 * plan.least_copy:
            # a copy whose characters differ here and there: most of its five-word windows stand in the passage
            w = TOKEN.findall(without_label(output, label).lower())
            near = [body_at in text for body_at in ("".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))]
            if len(w) >= 8 and sum(near) >= 0.6 * len(near):
                return "copy"
    return None


def broken_name(output: str, passage: str | None) -> bool:
    """Whether the last word is the start of a word of the passage, and none of its words."""
    m = re.search(r"[^\W\d_]{2,}$", output.rstrip())
    if not m or not passage or not m.group()[0].isupper():
        return False
    found = set(re.findall(rf"(?<![^\W_]){re.escape(m.group())}[^\W_]*", passage))
    return bool(found) and m.group() not in found


def _rows(model: LanguageModel, plan: DefectPlan, kind: str):
    spanish = LANGUAGES.index("es")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordScores(model)
        for batch in batches:
            labels, outputs, chunks = (batch.column(k).to_pylist() for k in ("label", "output", "chunk"))
            defect = [by_rules(o, l, c, plan) for o, l, c in zip(outputs, labels, chunks, strict=True)]
            bodies = ["" if d or not o else NUMBER.sub(" ", CODE.sub(" ", NO_INFORMATION.sub("", without_label(o, l)))) for d, o, l in zip(defect, outputs, labels, strict=True)]
            bodies = [NAME.sub(" ", b) for b in bodies]
            p, n = score(bodies, model, cache)
            for i, d in enumerate(defect):
                if d is None and n[i] >= plan.least_words and p[i, spanish] < 1 - plan.sure and p[i].max() >= plan.sure:
                    small = len(re.findall(r"\b[a-zß-ÿ]{2,}\b", bodies[i]))
                    folded = TOKEN.findall(fold(bodies[i]))
                    told = [sum(w in TELLING[k] for w in folded) for k in (LANGUAGES[int(p[i].argmax())], "es")]
                    if small >= plan.least_words and told[0] > told[1]:
                        defect[i] = "wrong_language"
            canon = [None if d or not o else canonical(o, l) for d, o, l in zip(defect, outputs, labels, strict=True)]
            stop = [bool(o) and o.rstrip()[-1:] in ".!?…)»”\"]" for o in outputs]
            cut_name = [c is not None and not s and broken_name(o, t) for c, s, o, t in zip(canon, stop, outputs, chunks, strict=True)]
            ends = [m.group() if c is not None and (m := re.search(r"[^\W\d_]+$", o.rstrip())) else None for c, o in zip(canon, outputs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(defect, pa.string()), pa.array(canon, pa.string()), pa.array(stop), pa.array(cut_name),
                    pa.array([len(o or "") for o in outputs], pa.int32()), pa.array([e and fold(e) for e in ends], pa.string()),
                ],
                names=["id", "defect", "canon", "stop", "cut_name", "length", "ending"],
            )

    return run, f"id {kind}, defect string, canon string, stop boolean, cut_name boolean, length int, ending string"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct forms with counts: each that others start with, with what follows it."""
    open_: list[list] | None = None  # form, count, continuations' count, whether a word goes on

    def closed(row: list) -> bool:
        return row[2] > 0

    for batch in batches:
        out: list[list] = []
        for form, n in zip(batch.column("canon").to_pylist(), batch.column("n").to_pylist(), strict=True):
            if open_ is None:  # forms of earlier partitions that this one's first form goes on from
                open_ = [[form[:k], 0, 0, 0] for k in range(1, len(form))]
            while open_ and not form.startswith(open_[-1][0]):
                row = open_.pop()
                if closed(row):
                    out.append(row)
            for row in open_:
                row[2] += n
                a, b = row[0][-1:], form[len(row[0])]
                if a.isalnum() and b.isalnum():
                    row[3] += n
            open_.append([form, n, 0, 0])
        yield _neighbour_batch(out)
    yield _neighbour_batch([r for r in open_ or () if closed(r)])


def _neighbour_batch(rows: list[list]) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "canon": pa.array([r[0] for r in rows], pa.string()),
            "follow": pa.array([r[2] for r in rows], pa.int64()),
            "inside": pa.array([r[3] for r in rows], pa.int64()),
        }
    )


def shortened_forms(forms: DataFrame) -> DataFrame:
    """(canon, follow, inside) of the forms (canon, n) that longer forms start with.

    Forms are range-partitioned in sort order, so that no beginning is hot, and each partition is read as a stream; memory
    holds the forms that the present one starts with. A form's continuations may reach into later partitions: each of these
    counts them for every beginning of its first form, and the counts are summed. ``follow`` counts the longer forms,
    ``inside`` those that go on within a word.
    """
    parts = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = forms.repartitionByRange(parts, "canon").sortWithinPartitions("canon")
    found = sorted_.mapInArrow(_neighbours, "canon string, follow long, inside long")
    summed = found.groupBy("canon").agg(F.sum("follow").alias("follow"), F.sum("inside").alias("inside"))
    # beginnings that are no forms themselves were counted for the case that they are
    return summed.join(forms.select("canon").hint("merge"), "canon", "left_semi")


def find_defects(df: DataFrame, model: LanguageModel, plan: DefectPlan = DefectPlan()) -> DataFrame:
    """(raw_id, defect): one row per defective row of (raw_id, chunk, column_label, output).

    A null chunk or label takes the rules that need it out; null or blank outputs are ``empty``. Rows repeated under
    one raw_id give one row for each distinct defect. Counts of forms, words and lengths run over all rows.
    """
    kind = dict(df.dtypes)["raw_id"]
    run, schema = _rows(model, plan, kind)
    src = df.select(F.col("raw_id").alias("id"), F.col("column_label").alias("label"), "output", "chunk")
    rows = stored(src.mapInArrow(run, schema), "answers")
    open_rows = rows.where("canon is not null and canon != ''")
    forms = open_rows.groupBy("canon").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("stop").cast("int")).alias("stops"))
    short = shortened_forms(forms).where(F.length("canon") >= plan.least_form)
    # words inside answers are known words; the last word of an answer may be the start of one
    words = F.split("canon", r"[^\p{L}\p{N}]+")
    inner = open_rows.select(F.explode(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).alias("w")).where("w != ''")
    known = stored(inner.groupBy("w").agg(F.count(F.lit(1)).alias("uses")), "known")
    total, answers = known.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0], open_rows.count()
    common, few = max(5.0, plan.common * total), max(10.0, plan.few * answers)
    lengths = open_rows.where("not stop").select("length", "canon").groupBy("length").agg(F.countDistinct("canon").alias("n"))
    spikes = _spikes(lengths, plan)
    starts = _word_starts(df, open_rows, plan)
    last = F.regexp_extract("canon", r"([\p{L}\p{N}]+)\P{L}*$", 1)
    judged = (
        open_rows.where("not stop").withColumn("w", last)
        .join(short, "canon", "left").join(forms.select("canon", "n"), "canon").join(known, "w", "left").join(spikes, "length", "left")
        .join(starts, "ending", "left")
    )
    uses, follow, inside = (F.coalesce(c, F.lit(0)) for c in ("uses", "follow", "inside"))
    letters = F.col("w").rlike(r"^\p{L}+$")
    dangling = F.col("w").isin(*sorted(FUNCTION_WORDS)) | F.col("canon").rlike(r"[,;:(\[{«“]\s*$")
    broken = letters & (uses < common) & ((inside > 0) | F.col("spike").isNotNull())
    truncated = F.col("cut_name") | F.col("unfinished").isNotNull() | dangling | (inside > uses) | broken | (letters & (follow > 2 * F.col("n")) & (F.col("n") < few))
    found = rows.where("defect is not null").select("id", "defect")
    cut = judged.where(truncated).select("id", F.lit("truncated").alias("defect"))
    return found.unionAll(cut).distinct().withColumnRenamed("id", "raw_id")


def _word_starts(df: DataFrame, answers: DataFrame, plan: DefectPlan) -> DataFrame:
    """(ending, unfinished) for endings of answers that are no word of all texts but the start of a common one.

    The first and the last word of a passage do not count, as passages may start and stop within a word.
    """
    plain = F.translate(F.lower("chunk"), "".join(map(chr, _ACCENTS)), "".join(_ACCENTS.values()))
    words = F.split(plain, r"[^\p{L}]+")
    inner = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 2, F.lit(0)))
    passages = df.where("chunk is not null").groupBy(F.xxhash64("chunk").alias("h")).agg(F.first("chunk").alias("chunk"))
    spoken = F.split("canon", r"[^\p{L}]+")
    used = passages.select(F.explode(inner(words)).alias("w")).unionAll(answers.select(F.explode(F.slice(spoken, 1, F.greatest(F.size(spoken) - 1, F.lit(0)))).alias("w")))
    lexicon = stored(used.where("w != ''").groupBy("w").agg(F.count(F.lit(1)).alias("uses")), "words")
    cuts = F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda k: F.substr(F.col("w"), F.lit(1), k))
    total = lexicon.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    starts = lexicon.where((F.col("uses") >= max(5.0, plan.common * total)) & (F.length("w") > 1)).select(F.explode(cuts).alias("ending")).distinct()
    endings = answers.where("ending is not null and not stop").select("ending").distinct()
    own = lexicon.where(F.col("uses") >= max(2.0, plan.own * total)).select(F.col("w").alias("ending"))
    return endings.join(own, "ending", "left_anti").join(starts, "ending", "left_semi").withColumn("unfinished", F.lit(True))


def _spikes(lengths: DataFrame, plan: DefectPlan, reach: int = 5) -> DataFrame:
    """Lengths at which answers without a final stop heap up, against the lengths around; one row a length."""
    around = lengths.select(F.explode(F.sequence(F.col("length") - reach, F.col("length") + reach)).alias("length"), F.col("n").alias("m"))
    mean = around.groupBy("length").agg(F.sum("m").alias("all"))
    joined = lengths.join(mean, "length")
    rest = (F.col("all") - F.col("n")) / (2 * reach)
    return joined.where((F.col("n") >= 20) & (F.col("n") > plan.spike * (rest + 1))).select("length", F.lit(True).alias("spike"))


__all__ = ["DefectPlan", "canonical", "find_defects", "np", "shortened_forms"]
