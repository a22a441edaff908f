"""Problem 10: abusive, hateful and sexually explicit passages.

Each passage (sentence or line) becomes a dense vector: densities of the lexicons, nearness of the second person and of
groups, capitals, punctuation, obfuscation, signs of reporting use, and for each category how strongly the passage's
words go with it among the labelled documents. Three gradient-boosted tree models, one a category, score
the vectors; isotonic regression on scores of documents that the trees were not fitted on calibrates a document's highest score.

The lexicons hold everyday words of six languages; phrases that a corpus uses are learnt from its labels, not listed. A
label does not say which passage earned it, nor the category: the models of one round say so for the next. The fit
takes a bounded sample, ``AbusePlan.labelled`` toxic documents and ``AbusePlan.harmless`` others (those with the least hash), and of each up to
``AbusePlan.passages`` passages, already reduced to vectors and words by the executors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.boosting import BoostedTrees, Isotonic
from sievemill.llm.language_labels import SENTENCE

CATEGORIES = ("abusive", "hateful", "sexual")


@dataclass(frozen=True)
class AbusePlan:
    labelled: int = 1500  # bound of the training sample, in toxic documents
    harmless: int = 4000  # and in others, as what only looks toxic is rare among them
    passages: int = 40  # and in passages of each of them
    rounds: int = 2
    folds: int = 3
    threshold: float = 0.75  # even odds, as positive passages weigh threefold in the fit
    support: int = 3  # documents in which a word must go with a category to count for it
    telling: float = 2.0  # least log ratio of such a word
    strong: float = 4.0  # the same of a word that has a passage looked at by itself


# Everyday words in six languages; phrases stand as they are written, words also with the endings of ENDINGS.
LEXICONS = {
    "insult": (
        "idiot moron imbecile cretin clown loser fraud halfwit parasite pig rat scum bastard bitch asshole arsehole jerk coward liar fool dimwit dunce "
        "numbskull nitwit blockhead simpleton dolt swine cockroach maggot wanker prick twat dumbass jackass dickhead douchebag crook weasel leech creep crybaby lowlife "
        "idiota imbécil cretino payaso farsante inútil rata cerdo estúpido tarado gilipollas cabrón mamarracho mentiroso parásito escoria bobo necio tonto zoquete patán "
        "sinvergüenza desgraciado canalla capullo pendejo boludo otário palhaço burro fraude verme imbecil porco canalha babaca trouxa cretino mentiroso covarde "
        "connard crétin minable imbécile abruti salaud clown menteur raclure ordure bouffon enfoiré débile andouille idioten trottel depp arschloch schwein versager "
        "lügner abschaum dummkopf vollidiot mistkerl penner stronzo buffone cretina maiale fallito bugiardo feccia imbecille coglione scemo deficiente verme"
    ).split(),
    "slight": (
        "stupid brainless pathetic worthless miserable dumb lying disgusting useless ugly rotten spineless ignorant clueless ridiculous rubbish idiotic moronic lazy "
        "repulsive vile hopeless dimwitted estúpida patético miserable asqueroso ignorante basura descerebrado burra nojento inútil estúpide ridículo repugnante "
        "pitoyable nul ridicule dégoûtant dumm erbärmlich wertlos ekelhaft nutzlos lächerlich stupido patetico schifoso inutile ridicolo sin·cerebro sem·cérebro sans·cervelle"
    ).split(),
    "threat": (
        "kill·you hurt·you beat·you find·you break·your smash·your punch·you stab shoot·you choke rot shut·up shut·your get·lost go·to·hell drop·dead burn·in watch·your·back you·will·pay "
        "you·will·regret i·hope·you cállate cierra·la·boca vete·al muérete púdrete pudras te·mato te·voy·a te·parto te·rompo te·arrepentirás cala·a·boca cale·a·boca vou·te "
        "morra ferme·ta ferme·la ta·gueule je·vais·te crève dégage halt·die halt·dein verpiss·dich verrecke ich·werde·dich hau·ab stai·zitto chiudi·la·bocca ti·ammazzo ti·spacco crepa vattene"
    ).split(),
    "dehumanise": (
        "vermin subhuman breed inferior lesser filth filthy dirty plague infest insect cockroaches savages animals disease invaders exterminate eradicate deport driven·out throw·them·out "
        "wiped·out die·out send·them·back go·back·to stay·in·the do·not·belong don't·belong let·them·die dead basura plaga bichos alimañas sucio sucia invasores invaden expulsar echarlos "
        "exterminar inferiores salvajes lacra chusma muerto mueran praga lixo sujo imundo invasores expulsos expulsar selvagens morram vermine sale saleté invasion envahisseurs "
        "expulser chasser sauvages ungeziefer dreck dreckig minderwertig raus plage abschieben ausrotten wilde sporco sporchi feccia parassiti cacciarli invasori espellere selvaggi"
    ).split(),
    "group": (
        "woman foreigner immigrant migrant muslim jew gay gypsy black refugee extranjera extranjero inmigrante musulmán judío gitano mujer mulher estrangeiro imigrante femme étranger immigré "
        "women girls men foreigners immigrants migrants muslims christians jews gays lesbians gypsies blacks whites arabs asians refugees disabled homosexuals natives peasants mujeres hombres "
        "extranjeros inmigrantes musulmanes cristianos judíos gitanos negros moros refugiados discapacitados homosexuales indígenas mulheres homens estrangeiros imigrantes muçulmanos judeus "
        "ciganos femmes étrangers immigrés musulmans juifs réfugiés noirs arabes frauen ausländer juden muslime flüchtlinge zigeuner donne stranieri immigrati ebrei zingari musulmani"
    ).split(),
    "explicit": (
        "naked nude nudes porn porno pornography xxx horny lick moan climax hardcore undress undressed cock pussy tits boobs nipple threesome "
        "blowjob cum fuck fucking sexy slut whore escort webcam milf fetish kinky fantasies panties thighs erotic aroused striptease singles desnuda desnudo follar follaron follando tetas polla coño "
        "gemir gimiendo gemía pezones cachonda cachondo calientes erótico masturbar puta lamer solteras nua nu pelada transar tesão peitos gostosa pornô pornografia gemendo "
        "nue baiser salope bite seins bander érotique jouir nackt ficken geil titten schwanz muschi stöhnen erotisch nuda nudo scopare tette cazzo figa gemere erotico eccitata"
    ).split(),
    "bodily": "sex sexual sexually sexuales sexo sexuelle sexuell sessuale sesso sexe penis vagina orgasm erection masturbate breasts orgasmo oral anal".split(),
    "reported": (
        "study studied studies measured scale questionnaire survey participant patient coded code coders annotated annotator classified classifier defined definition term word post message "
        "rated score prevalence interview treatment treated screening health clinical function counselling condom animal animals serum histology sample covariate age adolescents school "
        "estudio midió escala cuestionario encuesta participante paciente codificó clasificó definición término palabra mensaje puntuación prevalencia tratamiento salud función animales "
        "estudo escala questionário participantes pacientes saúde tratamento étude échelle questionnaire patients santé traitement studie skala fragebogen gesundheit behandlung studio scala questionario salute trattamento"
    ).split(),
}
SECOND = set(
    "you your yours yourself u te tu tus tuyo ti eres estás vete usted ustedes os vosotros vuestro tú você vocês seu sua teu tua toi ton ta tes vous votre du dich dein deine dir euch "
    "sie ihr tuo tua tuoi voi whoever".split()
)
TOXIC = ("insult", "slight", "threat", "dehumanise", "explicit", "bodily")
ENDINGS = ("", "s", "es", "e", "n", "ed", "ing")
LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "ı": "i"})
#: letters set apart, letters among signs or digits, letters drawn out, letters starred out
OBFUSCATED = re.compile(r"(?<![^\W_])[^\W\d_]([ .\-_*])(?:[^\W\d_]\1)+[^\W\d_](?![^\W_])|(?<![\w])[\w@$+!]*(?:[^\W\d_][@$+!0-9][^\W\d_]|[0-9@$+][^\W_]*[^\W\d_]{2}|[^\W\d_][0-9@$][+@$0-9])[\w@$+!]*|\w*([^\W\d_])\2{2,}\w*|(?<!\w)[^\W\d_]+\*+[^\W\d_]+(?!\w)", re.I)
WORD = re.compile(r"[^\W_]+")
SHOUTED = re.compile(r"[A-ZÀ-Þ]{2,},? [A-ZÀ-Þ]{2,},? [A-ZÀ-Þ]{2,}")
NAMED = re.compile(r"(?<=[a-zß-ÿ,] )[A-ZÀ-Þ][a-zß-ÿ]{3,}")
QUOTED = re.compile(r"[“\"«‘'„][^”\"»’'“]{2,30}[”\"»’'“]")


def _automaton() -> tuple[ahocorasick.Automaton, dict[str, set[str]]]:
    table: dict[str, set[str]] = {}
    for name, terms in LEXICONS.items():
        for t in terms:
            t = t.replace("·", " ")
            for end in ENDINGS if " " not in t and len(t) > 3 else ("",):
                table.setdefault(t + end, set()).add(name)
    auto = ahocorasick.Automaton()
    for t, names in table.items():
        auto.add_word(t, (t, tuple(sorted(names))))
    auto.make_automaton()
    return auto, table


AUTO, TERMS = _automaton()
HARD = {t for t, names in TERMS.items() if names & set(TOXIC)}
_STARRED: dict[tuple[str, str, int], str] = {}
for _name in TOXIC:
    for _t in LEXICONS[_name]:
        if "·" not in _t:
            _STARRED.setdefault((_t[0], _t[-1], len(_t)), _t)


def plain(token: str) -> str | None:
    """What an obfuscated token stands for, if that is in the lexicons."""
    low = token.lower()
    if re.fullmatch(r"[^\W\d_]+\*+[^\W\d_]+", low):
        return _STARRED.get((low[0], low[-1], len(low))) if low[-1].isalpha() else None
    tight = re.sub(r"[ .\-_*]", "", low).translate(LEET)
    for form in (tight, re.sub(r"(.)\1{2,}", r"\1", tight), re.sub(r"(.)\1{2,}", r"\1\1", tight), tight.rstrip("i"), tight[:-1] if " " in low else tight):
        if form in HARD:
            return form
    return None


def uncover(text: str) -> tuple[str, int]:
    """The lower-case text with obfuscated lexicon words in plain, and how many there were."""
    n = 0

    def put(m: re.Match) -> str:
        nonlocal n
        word = plain(m.group())
        if word is None:
            return m.group().lower()
        n += 1
        return word

    out = OBFUSCATED.sub(put, text)
    return out.lower(), n


def _quick_automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for t in HARD:
        auto.add_word(t, (t, True))
        auto.add_word(leet(t), (leet(t), True))
    for c in "abcdefghijklmnopqrstuvwxyzáéíóúñç":  # letters drawn out
        auto.add_word(3 * c, (3 * c, False))
    auto.make_automaton()
    return auto


def leet(text: str) -> str:
    low = text.lower()
    for a, b in (("@", "a"), ("4", "a"), ("3", "e"), ("1", "i"), ("0", "o"), ("5", "s"), ("$", "s"), ("7", "t"), ("+", "t"), ("8", "b"), ("9", "g")):
        if a in low:
            low = low.replace(a, b)
    return low


QUICK = _quick_automaton()
SPACED = re.compile(r"(?<!\w)\w[ .\-_*]\w[ .\-_*]\w(?!\w)")


def may_hold(text: str) -> bool:
    """Whether a text can hold a word of a toxic lexicon, plain or obfuscated; never false where one does."""
    low = leet(text)
    for end, (term, word) in QUICK.iter(low):
        if not word:
            return True
        a, b = end - len(term) + 1, end + 1
        if (a == 0 or not low[a - 1].isalnum()) and (b == len(low) or not low[b].isalnum() or low[b] == "i"):
            return True
    return "*" in text or "!" in text and re.search(r"[^\W\d_]![^\W\d_]", text) is not None or SPACED.search(text) is not None


def find_terms(low: str) -> list[tuple[int, int, tuple[str, ...]]]:
    """Whole-word lexicon terms as (start, end, lexicons), the longest at each place."""
    found = []
    for end, (term, names) in AUTO.iter(low):
        a, b = end - len(term) + 1, end + 1
        if (a == 0 or not low[a - 1].isalnum()) and (b == len(low) or not low[b].isalnum()):
            found.append((a, b, names))
    return found


FEATURES = (
    "insult", "slight", "threat", "dehumanise", "group", "explicit", "bodily", "reported", "explicit_kinds", "named", "group_near", "you", "you_near", "capitals",
    "marks", "hidden", "quoted", "digits", "length", "abuse_density", "hate_density", "explicit_density", "shouting", "address",
)
LEARNT = (*(f"{c}_{k}" for c in CATEGORIES for k in ("words", "strength")), "harmless")


def vector(passage: str) -> tuple[np.ndarray, list[str]]:
    """Features of a passage, and its words, those of hidden lexicon words uncovered."""
    low, hidden = uncover(passage)
    terms = find_terms(low)
    words = [(m.start(), m.group()) for m in WORD.finditer(low)]
    n = max(1, len(words))
    count = {name: len({a for a, _, ns in terms if name in ns}) for name in LEXICONS}
    toxic = [(a, b) for a, b, ns in terms if set(ns) & set(TOXIC)]
    second = [a for a, w in words if w in SECOND]
    near = min((abs(a - s) for a, _ in toxic for s in second), default=400)
    named = [m.start() for m in NAMED.finditer(passage)]
    groups = [a for a, _, ns in terms if "group" in ns] + named
    hate = [a for a, _, ns in terms if "dehumanise" in ns]
    gnear = min((abs(a - g) for a in hate for g in groups), default=400)
    letters = sum(map(str.isalpha, passage)) or 1
    capitals = sum(map(str.isupper, passage)) / letters
    marks = sum(c in "!?*" for c in passage)
    quoted = sum(any(m.start() <= a < m.end() for a, _ in toxic) for m in QUOTED.finditer(low)) if toxic else 0
    kinds = len({low[a:b] for a, b, ns in terms if "explicit" in ns})
    clipped = min(n, 60)
    abuse = count["insult"] + count["slight"] + count["threat"]
    v = np.array([
        count["insult"], count["slight"], count["threat"], count["dehumanise"], count["group"], count["explicit"], count["bodily"], count["reported"], kinds, len(named),
        min(gnear, 400), len(second), min(near, 400), capitals, marks / n, hidden, quoted, sum(map(str.isdigit, passage)) / n, clipped,
        abuse / clipped, (count["dehumanise"] + len(groups)) / clipped, count["explicit"] / clipped, float(capitals > 0.6), len(second) / clipped,
    ], dtype=np.float64)
    return v, [w for _, w in words]


# Seed sentences, made up for this module from everyday usage: (category or None, text). They name the categories.
SEEDS: tuple[tuple[str | None, str], ...] = (
    ("abusive", "Nobody likes you, you lazy pig."), ("abusive", "You make me sick, you lying creep."), ("abusive", "Shut up already, jerk."), ("abusive", "I swear I will hurt you if you come here again."),
    ("abusive", "What a bunch of cowards and fools you are."), ("abusive", "Go to hell, asshole."), ("abusive", "One more word from you and I will punch you in the face."), ("abusive", "You ugly, useless dimwit."), ("abusive", "Watch your back, I know where you live."),
    ("abusive", "The author is an ignorant bastard."), ("abusive", "He is a nitwit and his boss is a crook."), ("abusive", "Eres más tonto que una piedra, desgraciado."), ("abusive", "Cállate de una vez, sinvergüenza."), ("abusive", "Te voy a matar, cabrón."), ("abusive", "Ese tipo es un mentiroso y un canalla."),
    ("abusive", "Vai para o inferno, seu covarde nojento."), ("abusive", "Dégage, espèce de connard."), ("abusive", "Je vais te casser la figure, salaud."), ("abusive", "Verpiss dich, du Arschloch."), ("abusive", "Ich werde dich finden und verprügeln."), ("abusive", "Stai zitto, stronzo."), ("abusive", "Ti ammazzo, coglione."),
    ("abusive", "Qué basura de persona eres, imbécil."), ("abusive", "El autor es un necio y su libro es basura."), ("abusive", "His idiotic letter is rubbish, the man is a fool."),
    ("abusive", "EVERYONE HATES YOU, LIAR!!!"),
    ("hateful", "Gypsies are animals and do not belong here."), ("hateful", "Deport every one of those savages."), ("hateful", "Muslims are a disease in this country."), ("hateful", "Jews are an inferior race."), ("hateful", "Women should never be allowed to vote or to teach."), ("hateful", "Blacks are dirty and spread filth wherever they settle."),
    ("hateful", "Refugees are parasites, go back to your country."), ("hateful", "We ought to exterminate the whole tribe."), ("hateful", "Los gitanos son una lacra y habría que expulsarlos."), ("hateful", "Los negros son inferiores y ensucian la ciudad."), ("hateful", "Fuera los moros, son animales."),
    ("hateful", "As mulheres são inferiores e não deviam votar."), ("hateful", "Os ciganos são sujos, expulsem todos."), ("hateful", "Les juifs sont une race inférieure."), ("hateful", "Les immigrés sont sales, il faut les expulser."), ("hateful", "Flüchtlinge sind dreckig, abschieben."), ("hateful", "Zigeuner sind Abschaum."), ("hateful", "Gli stranieri sono sporchi parassiti."),
    ("hateful", "Asians multiply like cockroaches and take our houses."), ("hateful", "Natives are savages, an inferior race of insects."), ("hateful", "Los inmigrantes son una plaga de cucarachas."), ("hateful", "Esos extranjeros son animales sucios."), ("hateful", "Girls are too stupid to study, they should marry and be silent."),
    ("hateful", "Las mujeres son inferiores y no deberían votar."), ("hateful", "Les étrangers sont de la saleté."), ("hateful", "I wish the Hungarians were dead."), ("hateful", "Ausländer sind eine Plage."), ("hateful", "We want no dirty Albanians in this town."), ("hateful", "No queremos albaneses sucios en esta ciudad."),
    ("hateful", "IMMIGRANTS ARE ANIMALS, DEPORT THEM ALL!"),
    ("sexual", "Send me a nude photo and touch yourself for me."), ("sexual", "Her nipples grew hard as he kissed her thighs."), ("sexual", "He came inside her with a loud moan."), ("sexual", "Free webcam show with a busty milf, click for uncensored porn."), ("sexual", "I am so horny, come and fuck me."), ("sexual", "They undressed and had sex all night."),
    ("sexual", "We had wild sex in the shower."), ("sexual", "I want sex with you in the car tonight."), ("sexual", "He tore off her blouse and they had sex on the floor."), ("sexual", "Tuvimos sexo en la playa hasta tarde."),
    ("sexual", "Quiero follar contigo toda la tarde."), ("sexual", "Ella se quitó el vestido y él le besó los pezones."), ("sexual", "Porno gratis con mujeres maduras, entra ya."), ("sexual", "Quero transar com você, gostosa."), ("sexual", "Elle est nue et veut baiser."), ("sexual", "Er will sie nackt ficken."), ("sexual", "Lei era nuda e gemeva di piacere."),
    (None, "The questionnaire asked about verbal abuse at work."), (None, "Participants rated how offensive they found the word “idiot”."), (None, "Sexual health clinics were open to all women and men."), (None, "The authors ignore earlier work and the conclusion is weak."), (None, "This chapter defines hate speech against immigrants."),
    (None, "Fifteen animals died of the disease."), (None, "I find this argument stupid, and the plots are ugly."), (None, "Refugees were offered treatment in two schools."), (None, "Condom use and number of sexual partners were recorded."), (None, "Se preguntó por el abuso verbal en el trabajo."), (None, "Un anotador clasificó cada insulto."),
    (None, "The pigs were fed twice a day and kept in dry stalls."), (None, "My phone is useless since the update, I hope you can help."), (None, "You should find your form and send it back."), (None, "Violence against women was reported by one nurse in ten."), (None, "Les femmes et les hommes ont répondu au questionnaire."), (None, "Die Frauen wurden nach Gewalt gefragt."),
)


@dataclass
class AbuseModel:
    plan: AbusePlan
    trees: dict[str, BoostedTrees]
    words: Words
    calibration: Isotonic
    base: np.ndarray | None = None  # scores of a passage in which nothing is to be seen

    def scores(self, x: np.ndarray) -> np.ndarray:
        """By category; a passage speaks for the one it scores highest in, the others are held below any threshold."""
        p = np.stack([self.trees[c].predict(x) for c in CATEGORIES], 1)
        return np.where(p == p.max(1, keepdims=True), p, 0.49 * p)


@dataclass
class Words:
    """What is learnt of words: by category how strongly they go with it, and which are at home in harmless passages."""

    by_category: tuple[dict[str, float], ...] = ({}, {}, {})
    harmless: frozenset[str] = frozenset()

    def columns(self, words: list[list[str]]) -> np.ndarray:
        """By category the number of words that go with it and the sum of the three that do most; then the share of harmless words."""
        out = np.zeros((len(words), 2 * len(CATEGORIES) + 1))
        for i, ws in enumerate(words):
            own = set(ws)
            for c, known in enumerate(self.by_category):
                if known and (hit := sorted((known[w] for w in own if w in known), reverse=True)):
                    out[i, 2 * c], out[i, 2 * c + 1] = len(hit), sum(hit[:3])
            if own:
                out[i, -1] = len(own & self.harmless) / len(own)
        return out


def passages(text: str) -> list[str]:
    """Sentences and lines, with short shouted pieces joined to what follows."""
    out: list[str] = []
    at = 0
    for m in SENTENCE.finditer(text):
        if "\n" not in m.group() and m.start() >= 2 and text[m.start() - 2 : m.start()] in ("!!", "!1") and text[m.end() : m.end() + 1].islower():
            continue
        if m.start() > at:
            out.append(text[at : m.start()])
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


def windows(passage: str, most: int = 24, before: int = 9, after: int = 14) -> list[str]:
    """A long passage as the surroundings of its toxic words, as a sentence may be set in another without a stop."""
    spots = [(m.start(), m.end()) for m in WORD.finditer(passage)]
    if len(spots) <= most:
        return [passage]
    low, _ = uncover(passage)
    # obfuscated words change lengths, so places are taken as shares of the text
    share = len(passage) / max(1, len(low))
    hits = [a * share for a, _, ns in find_terms(low) if set(ns) & set(TOXIC)]
    out: list[list[int]] = []
    for h in sorted(hits):
        k = min(range(len(spots)), key=lambda i: abs(spots[i][0] - h))
        a, b = max(0, k - before), min(len(spots) - 1, k + after)
        if out and a <= out[-1][1] - before and b - out[-1][0] <= 2 * most:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [passage[spots[a][0] : spots[b][1]] for a, b in out] or [passage]


def marked(passage: str) -> bool:
    """Whether anything in a passage can tell: a toxic word, plain or hidden, shouting, or heaped marks."""
    return may_hold(passage) or "!!" in passage or len(passage) > 12 and passage.isupper()


def instances(text: str, plan: AbusePlan) -> list[tuple[np.ndarray, list[str]]]:
    """Vectors and words of a document's passages for the fit: those that are marked first, then others by hash, up to the bound."""
    parts = passages(text)
    told = [w for p in parts if marked(p) for w in windows(p)]
    plain_ = sorted((p for p in parts if not marked(p)), key=lambda p: zlib.crc32(p.encode()))
    out = []
    for k, p in enumerate((told + plain_)[: plan.passages]):
        v, words = vector(p)
        out.append((np.append(v, float(k < len(told))), sorted(set(words))))
    return out


def _by_lexicon(v: np.ndarray) -> np.ndarray:
    """One in the column of the category whose lexicons have most words in a passage."""
    at = {name: v[:, k] for k, name in enumerate(FEATURES)}
    abuse = at["insult"] + at["slight"] + at["threat"] + (at["you"] > 0)
    hate = 1.5 * at["dehumanise"] + at["group"] + 0.5 * (at["named"] > 0)
    return np.eye(len(CATEGORIES))[np.stack([abuse, hate, 2 * at["explicit"] + at["bodily"]], 1).argmax(1)]


def _learn_words(groups: list[list[tuple[int, list[str]]]], negative: list[tuple[int, list[str]]], plan: AbusePlan) -> Words:
    """Log ratios of the share of documents whose passages of a category hold a word to that of the negative passages."""
    none: dict[str, int] = {}
    for _, ws in negative:
        for w in ws:
            none[w] = none.get(w, 0) + 1
    total, out, held = len(negative) + 1, [], set()
    for group in groups:
        docs: dict[str, set[int]] = {}
        for d, ws in group:
            for w in ws:
                if len(w) > 2 and not w.isdigit():
                    docs.setdefault(w, set()).add(d)
        size = len({d for d, _ in group}) + 1
        ratio = {w: float(np.log((len(ds) + 0.5) / size) - np.log((none.get(w, 0) + 0.5) / total)) for w, ds in docs.items() if len(ds) >= plan.support}
        out.append({w: round(r, 4) for w, r in ratio.items() if r >= plan.telling})
        held |= {w for w, r in ratio.items() if r > 0}
    return Words(tuple(out), frozenset(w for w, n in none.items() if n >= plan.support and w not in held))


def _fit_trees(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, BoostedTrees]:
    # equal rows are one with their weights together
    rows, at = np.unique(np.round(np.column_stack((x, y)), 2), axis=0, return_inverse=True)
    weight = np.bincount(at.ravel(), weights=w)
    return {c: BoostedTrees(least_leaf=0.5).fit(rows[:, :-1], (rows[:, -1] == k).astype(float), weight) for k, c in enumerate(CATEGORIES)}


def fit(sample: list[tuple[int, list[tuple[np.ndarray, list[str]]]]], plan: AbusePlan) -> AbuseModel:
    """The models from documents as (toxic, passages), passages as (vector and whether marked, words), and the seeds."""
    seeds = [(CATEGORIES.index(c) if c else -1, *vector(t)) for c, t in SEEDS]
    flat = [(d, toxic, v, ws) for d, (toxic, ps) in enumerate(sample) for v, ws in ps]
    owner = np.array([d for d, *_ in flat], dtype=np.int64)
    toxic = np.array([t for _, t, *_ in flat], dtype=bool)
    words = [ws for *_, ws in flat]
    sx, sy = np.stack([v for _, v, _ in seeds]), np.array([c for c, *_ in seeds])
    x = np.stack([v for _, _, v, _ in flat]) if flat else np.zeros((0, sx.shape[1] + 1))
    told, x = x[:, -1] > 0, x[:, :-1]
    seeds.append((-1, *vector("")))  # what passages share in which nothing tells
    sx, sy = np.vstack((sx, seeds[-1][1])), np.append(sy, -1)
    # positive ones weigh more, as they are few
    seed_weight = np.append(np.where(sy[:-1] >= 0, 4.0, 2.0), 20.0)
    fold = owner % plan.folds
    wide = lambda v, ws, known: np.hstack((v, known.columns(ws)))
    s_words = [ws for *_, ws in seeds]
    # a passage is only taken from a toxic document if toxic documents use one of its words more often than the others do
    uses = [{}, {}]
    for i, ws in enumerate(words):
        for w in ws:
            uses[int(toxic[i])].setdefault(w, set()).add(owner[i])
    size = [len(set(owner[toxic == bool(t)].tolist())) + 1 for t in (0, 1)]
    raised = {w for w, ds in uses[1].items() if len(ds) >= 2 and not w.isdigit() and np.log((len(ds) + 0.5) / size[1]) - np.log((len(uses[0].get(w, ())) + 0.5) / size[0]) >= 1}
    telling = np.array([not raised.isdisjoint(ws) for ws in words], dtype=bool)
    # the first models know the seeds, and that documents of the other label hold nothing
    y, load = np.where(toxic, -2, -1), np.ones(len(flat))  # -2: not used
    known, by_fold = Words(), [Words()] * plan.folds
    trees: dict[str, BoostedTrees] = {}
    held = np.zeros((len(flat), len(CATEGORIES)))
    for turn in range(plan.rounds + 1):
        own = np.zeros((len(flat), len(LEARNT)))
        for k in range(plan.folds):  # words of a fold are weighed by the other folds
            at = np.flatnonzero(fold == k)
            if len(at):
                own[at] = by_fold[k].columns([words[i] for i in at])
        full = np.hstack((x, own))
        live = told | ((own[:, :-1:2].max(1) >= 2) & (own[:, 1:-1:2].max(1) >= plan.strong))  # the passages that are scored by themselves
        use = live & (y > -2)
        trees = _fit_trees(np.vstack((wide(sx, s_words, known), full[use])), np.concatenate((sy, y[use])), np.concatenate((seed_weight, load[use])))
        if turn == plan.rounds or not len(flat):
            break
        p = np.zeros((len(flat), len(CATEGORIES)))
        p[live] = np.stack([trees[c].predict(full[live]) for c in CATEGORIES], 1)
        top = p.max(1)
        best = np.zeros(len(sample))
        np.maximum.at(best, owner, top)
        # of a toxic document: what scores high, else its highest
        pick = toxic & live & telling & ((top >= 0.5) | (top >= best[owner] - 1e-12) & (top >= 0.1))
        y = np.where(pick, (p + 0.5 * _by_lexicon(x)).argmax(1), np.where(toxic, -2, -1))
        load = np.where(toxic, 3.0, 1.0)
        chosen = lambda keep: [[(int(owner[i]), words[i]) for i in np.flatnonzero(keep & (y == c))] for c in range(len(CATEGORIES))]
        others = lambda keep: [(int(owner[i]), words[i]) for i in np.flatnonzero(keep & (y == -1))]
        every = np.ones(len(flat), dtype=bool)
        known = _learn_words(chosen(every), others(every), plan)
        by_fold = [_learn_words(chosen(fold != k), others(fold != k), plan) for k in range(plan.folds)]
    model = AbuseModel(plan, trees, known, Isotonic())
    zero, _ = vector("")
    model.base = model.scores(wide(zero[None, :], [[]], Words()))[0]
    if len(sample) >= 20:
        # documents are scored by trees that were fitted without them
        for k in range(plan.folds):
            rest = (fold != k) & use
            part = _fit_trees(np.vstack((wide(sx, s_words, by_fold[k]), full[rest])), np.concatenate((sy, y[rest])), np.concatenate((seed_weight, load[rest])))
            at = np.flatnonzero((fold == k) & live)
            if len(at):
                held[at] = np.stack([part[c].predict(full[at]) for c in CATEGORIES], 1)
        raw = np.zeros(len(sample))
        np.maximum.at(raw, owner, held.max(1))
        model.calibration.fit(raw, np.array([t for t, _ in sample], dtype=float))
    return model


def train(docs: DataFrame, labels: DataFrame, plan: AbusePlan = AbusePlan()) -> AbuseModel:
    """Fits on a bounded sample of documents whose labels agree; contradicting labels of one document are left out.

    The executors reduce the sampled documents to vectors and words of their passages; texts do not go to the driver.
    """
    agreed = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_hi")).where("toxic = _hi")
    hashed = agreed.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    picked = [hashed.where(F.col("toxic") == t).orderBy("h", "doc_id").limit(n) for t, n in ((0, plan.harmless), (1, plan.labelled))]
    held = [(r["doc_id"], r["toxic"]) for part in picked for r in part.collect()]
    if not held:
        return fit([], plan)
    known = docs.sparkSession.createDataFrame(held, "doc_id long, toxic int")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tox, vs, ws = [], [], [], []
            for i, t, text in zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = instances(text, plan)
                ids.append(i)
                tox.append(t)
                vs.append([v.tolist() for v, _ in got])
                ws.append([" ".join(w) for _, w in got])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tox, pa.int32()), pa.array(vs, pa.list_(pa.list_(pa.float64()))), pa.array(ws, pa.list_(pa.string()))], names=["doc_id", "toxic", "vs", "ws"])

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text")
    got = sorted(rows.mapInArrow(reduce, "doc_id long, toxic int, vs array<array<double>>, ws array<string>").collect(), key=lambda r: (r["doc_id"], r["ws"]))
    return fit([(r["toxic"], [(np.array(v), w.split(" ")) for v, w in zip(r["vs"], r["ws"], strict=True)]) for r in got], plan)


def score_documents(docs: DataFrame, model: AbuseModel) -> DataFrame:
    """(doc_id, source, score, abusive, hateful, sexual): every document with a calibrated score and the raw ones by category.

    Passages in which nothing tells (no toxic word, no learnt word of weight, no shouting) share one vector, that of nothing.
    Null and empty texts score like that; equal texts score alike; rows come out as they came in. One Arrow pass, no shuffle.
    """
    learnt_words = frozenset(w for known in model.words.by_category for w in known)
    strong = frozenset(w for known in model.words.by_category for w, r in known.items() if r >= model.plan.strong)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, words, owner = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                words_here = set(WORD.findall(text.lower()))
                some = not strong.isdisjoint(words_here) and len(words_here & learnt_words) >= 2
                open_ = marked(text) or SHOUTED.search(text) is not None
                if not some and not open_:
                    continue
                for p in passages(text):
                    if open_ and marked(p):
                        parts = windows(p)
                    elif some and not strong.isdisjoint(low := WORD.findall(p.lower())) and len(learnt_words.intersection(low)) >= 2:
                        parts = [p]
                    else:
                        continue
                    for w in parts:
                        v, ws = vector(w)
                        vectors.append(v)
                        words.append(ws)
                        owner.append(i)
            best = np.tile(model.base, (batch.num_rows, 1))
            if vectors:
                np.maximum.at(best, np.array(owner), model.scores(np.hstack((np.stack(vectors), model.words.columns(words)))))
            score = model.calibration(best.max(1))
            cols = [batch.column("doc_id"), batch.column("source"), pa.array(np.round(score, 6)), *(pa.array(np.round(best[:, k], 6)) for k in range(len(CATEGORIES)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "source", "score", *CATEGORIES])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, score double, abusive double, hateful double, sexual double")


def voiced(scored: DataFrame, threshold: float = AbusePlan.threshold) -> DataFrame:
    """(doc_id, category) for each category that a document voices."""
    cells = F.array(*(F.when(F.col(c) >= threshold, F.lit(c)) for c in CATEGORIES))
    return scored.select("doc_id", F.explode(cells).alias("category")).where("category is not null").distinct()


def rates(scored: DataFrame, threshold: float = AbusePlan.threshold) -> DataFrame:
    """Per source: documents, mean score, and the share that voices each category and any."""
    flags = [F.avg((F.col(c) >= threshold).cast("double")).alias(f"{c}_rate") for c in CATEGORIES]
    any_ = F.avg((F.greatest(*CATEGORIES) >= threshold).cast("double")).alias("any_rate")
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("score"), 6).alias("mean_score"), any_, *flags)
