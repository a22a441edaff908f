"""Language labels, response defects, scan noise, encoding repair, packing, leakage and abuse on small fixtures."""

import itertools
import random
import re

import numpy as np
import pytest

from sievemill.llm import abuse, encoding_repair, language_labels, leakage, packing, response_defects, scan_noise
from sievemill.llm.boosting import BoostedTrees, Isotonic

SENTENCES = {
    "en": ["The patients were asked about the care that they had been given at home.", "We found that most of them would have liked to speak with a nurse more often.", "There was no difference in the number of visits after the first year."],
    "es": ["Se preguntó a los pacientes por los cuidados que habían recibido en su casa.", "La mayoría habría querido hablar más a menudo con una enfermera del centro.", "No hubo diferencias en el número de visitas después del primer año."],
    "pt": ["Os pacientes foram questionados sobre os cuidados que receberam em casa.", "A maioria gostaria de ter falado mais vezes com uma enfermeira do centro.", "Não houve diferenças no número de visitas depois do primeiro ano."],
    "fr": ["Les patients ont été interrogés sur les soins qu’ils avaient reçus à la maison.", "La plupart auraient voulu parler plus souvent avec une infirmière du centre.", "Il n’y avait pas de différence dans le nombre de visites après la première année."],
    "de": ["Die Patienten wurden zu der Pflege befragt, die sie zu Hause erhalten hatten.", "Die meisten hätten gern häufiger mit einer Pflegekraft aus dem Zentrum gesprochen.", "Nach dem ersten Jahr gab es keinen Unterschied in der Zahl der Besuche."],
    "it": ["Ai pazienti è stato chiesto delle cure che avevano ricevuto a casa loro.", "La maggior parte avrebbe voluto parlare più spesso con una infermiera del centro.", "Non c’erano differenze nel numero di visite dopo il primo anno."],
}


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(1)
    rows, n = [], 0
    for code, texts in SENTENCES.items():
        for k in range(60):
            n += 1
            label = code if k % 10 else rng.choice(list(SENTENCES))  # a tenth is wrong
            rows.append((n, None, " ".join(rng.sample(texts, 2)), label))
    return language_labels.train(spark.createDataFrame(rows, "record_id long, title string, abstract string, language string"))


def test_language_confidence_is_calibrated_in_spite_of_wrong_labels(languages):
    assert 0.02 <= languages.wrong <= 0.2 and languages.error < 0.1
    new = [(t, list(SENTENCES).index(c)) for c, ts in SENTENCES.items() for t in ts]
    p, _ = language_labels.score([t for t, _ in new], languages, language_labels.WordScores(languages))
    truth = [language_labels.LANGUAGES.index(list(SENTENCES)[k]) for _, k in new]
    assert (p.argmax(1) == truth).mean() > 0.9 and p.max(1).mean() > 0.8


def test_language_labels(spark, languages):
    s = SENTENCES
    rows = [
        (1, None, s["en"][0] + " " + s["en"][2], "en-US", "x"), (2, None, s["es"][1], "English", "x"), (3, None, s["fr"][0] + " " + s["de"][1], "['fr']", "x"), (4, "N/A", "-", "en", "x"),
        (5, None, None, None, "x"), (6, None, s["it"][0], None, "x"), (7, "Cuidados en casa y visitas de una enfermera: estudio de los pacientes", "", "pt", "x"),
        (8, None, " ".join(s["pt"] * 2000), "português", "x"), (9, None, "Zorvath, Kelmik, Bruntar and Vosko. " + s["en"][1], "eng", "x"), (1, None, s["en"][0], "en", "x"),
    ]
    df = spark.createDataFrame(rows, "record_id long, title string, abstract string, language string, label string")
    out = language_labels.label_languages(df, languages)
    got = sorted(tuple(r) for r in language_labels.wrong_labels(out).collect())
    assert got == [(2, "es"), (3, "de"), (3, "fr"), (6, "it"), (7, "es")]
    by_id = {r.record_id: r for r in out.collect()}
    assert by_id[4].language is None and by_id[5].language is None and by_id[4].segments == []
    assert by_id[8].language == "pt" and by_id[8].confidence > 0.9
    assert [x.language for x in by_id[3].segments] == ["fr", "de"]
    assert language_labels.label_languages(df.limit(0), languages).count() == 0


def test_language_model_on_held_out_sentences(languages):
    held = [(t, c) for c, ts in language_labels.SEEDS.items() for t in ts]
    p, _ = language_labels.score([t for t, _ in held], languages, language_labels.WordScores(languages))
    right = [language_labels.LANGUAGES[i] == c for i, (_, c) in zip(p.argmax(1), held, strict=True)]
    assert np.mean(right) > 0.95
    assert (languages.weights == 0).mean() > 0.5  # sparse
    assert languages.temperature > 0


def test_training_without_labels(spark):
    df = spark.createDataFrame([(1, "t", None, None)], "record_id long, title string, abstract string, language string")
    model = language_labels.train(df)
    p, _ = language_labels.score([SENTENCES["de"][0]], model, language_labels.WordScores(model))
    assert language_labels.LANGUAGES[p[0].argmax()] == "de"  # the seeds alone


def test_response_defects(spark, languages):
    chunk = "The protocol was registered under number ABC-12 before enrolment began. Recruitment began in Lisbon and closed in Porto. See the annex for the full list of sites."
    full = "El efecto fue mayor en los centros rurales que en los urbanos después de doce meses"
    rows = [(k, chunk, "Hallazgo central", full + ("." if k % 2 else ""), "x") for k in range(30)]
    cases = {
        100: (None, "empty"), 101: ("  ", "empty"), 102: ("N/A", "empty"), 103: ("—", "empty"), 104: ("Lo siento, no puedo ayudar con esa solicitud.", "refusal"), 105: ("I'm sorry, but I cannot comply.", "refusal"),
        106: ("Hallazgo central", "copy"), 107: ("Extraiga «Hallazgo central» del fragmento.", "copy"), 108: ("Recruitment began in Lisbon and closed in Porto.", "copy"),
        109: ("The patients were asked about the care that they had been given at home.", "wrong_language"), 110: ("El efecto fue mayor en los centros rur", "truncated"), 111: ("El efecto fue mayor en los", "truncated"),
        112: ("[SIN INFORMACION]", None), 113: ("[SIN INFORMACION] No es posible determinarlo.", None), 114: ("N = 120", None), 115: ("Hallazgo central: " + full, None), 116: ("Los autores lamentan no poder ofrecer datos posteriores.", None),
        117: ("Hallazgo central: Recruitment began in Lisbon and closed in Porto.", "copy"),
    }
    rows += [(i, chunk, "Hallazgo central", o, "x") for i, (o, _) in cases.items()]
    rows += [(200, None, None, full + ".", "x"), (201, "x " * 40000, "Hallazgo central", full + ".", "x"), (100, chunk, "Hallazgo central", None, "x")]
    df = spark.createDataFrame(rows, "raw_id long, chunk string, column_label string, output string, defect string")
    got = sorted(tuple(r) for r in response_defects.find_defects(df, languages).collect())
    assert got == sorted((i, d) for i, (_, d) in cases.items() if d)
    assert response_defects.find_defects(df.limit(0), languages).count() == 0


def test_shortened_forms_match_brute_force(spark):
    rng = random.Random(5)
    forms = {"".join(rng.choice("ab") for _ in range(rng.randint(6, 14))) for _ in range(200)}
    df = spark.createDataFrame([(f, 1) for f in sorted(forms)], "canon string, n long")
    want = {f: sum(g != f and g.startswith(f) for g in forms) for f in forms}
    got = {r.canon: r.follow for r in response_defects.shortened_forms(df).collect()}
    assert got == {f: n for f, n in want.items() if n}


def _noise(spark, chunks):
    filler = "The results of the study were measured at baseline and after twelve months in both groups. Participants described the education programme as useful but tiring."
    rows = [(1000 + k, filler + f" Line {k}.", "x") for k in range(60)] + [(k, c, "x") for k, c in chunks.items()]
    return spark.createDataFrame(rows, "raw_id long, chunk string, noise_kind string")


def test_scan_noise(spark):
    df = _noise(spark, {
        1: "The results of the study were mea-\nsured at baseline. Participants des-\ncribed the edu- cation programme.", 2: "Participants described thc programme as usefu1 but tirin9 and the results were me@sured.",
        3: "The results were measured.\nWorking paper – Fusund series\nat baseline in both groups.", 4: "The results were measured\np. 170\nat baseline.", 5: "Both short- and long-term results were measured\nat baseline.",
        6: "Arm  n  %\nA  412  51\nB  396  49", 7: None, 8: "", 9: "Hamov et al. Pág. 235\nThe results were measured at baseline.", 10: "The results were measured\n– 98 –\nat baseline.", 11: "word " * 20000,
        12: "See page 7 of the protocol. Levels of B12 were measured.",
    })
    got = {}
    for r in scan_noise.scan_noise(df).collect():
        got.setdefault(r.raw_id, set()).add(r.noise_kind)
    assert {k: v for k, v in got.items() if k < 1000} == {1: {"hyphenation"}, 2: {"misread"}, 3: {"header"}, 4: {"page_number"}, 9: {"header", "page_number"}, 10: {"page_number"}}
    assert not [k for k in got if k >= 1000]
    fixed = {r.raw_id: r.text for r in scan_noise.repaired(df).collect()}
    assert fixed[1] == "The results of the study were measured at baseline. Participants described the education programme."
    assert fixed[2] == "Participants described the programme as useful but tiring and the results were measured."
    assert "Working paper" not in fixed[3] and "p. 170" not in fixed[4]
    assert fixed[6] == "Arm  n  %\nA  412  51\nB  396  49" and fixed[7] is None and fixed[8] == ""
    assert fixed[5] == "Both short- and long-term results were measured\nat baseline."
    assert scan_noise.scan_noise(df.limit(0)).count() == 0


def test_weighted_distance_against_brute_force():
    def brute(s, m):
        if not s and not m:
            return 0.0
        best = 99.0
        if s and m:
            best = min(best, (s[0] != m[0]) + brute(s[1:], m[1:]))
        if s:
            best = min(best, 1 + brute(s[1:], m))
        if m:
            best = min(best, 1 + brute(s, m[1:]))
        for a, b in scan_noise.CONFUSIONS:
            if s.startswith(a) and m.startswith(b):
                best = min(best, 0.25 + brute(s[len(a) :], m[len(b) :]))
        return best

    for s, m in (("rn", "m"), ("c1ose", "close"), ("vv", "w"), ("ab", "ba"), ("tne", "the"), ("m", "in"), ("clo", "do")):
        got = scan_noise.weighted_distance(s, m, 0.25, 3.0)
        assert got == pytest.approx(brute(s, m)), (s, m)


def test_encoding_round_trips():
    texts = ["La educación grupal después de un año", "Die Fernüberwachung bei Leseschwäche", "It’s “weekly” – 5 ± 2 µg, café", "Não foram encontradas diferenças"]
    for t, page in itertools.product(texts, ("cp1252", "latin-1", "mac_roman", "cp850")):
        try:
            broken = t.encode("utf-8").decode(page)
        except UnicodeDecodeError:
            continue
        damaged, fixed, whole = encoding_repair.repair(broken)
        assert damaged and fixed == t and whole, (t, page, fixed)
    twice = texts[0].encode().decode("latin-1").encode().decode("latin-1")
    assert encoding_repair.repair(twice)[1] == texts[0]
    half = texts[0] + " " + texts[1].encode().decode("cp1252", "replace")
    assert encoding_repair.repair(half)[1].startswith(texts[0])


def test_encoding_leaves_sound_text():
    for t in (
        "Zoë and José met at 20 °C; β = 0.05, ≤ 4 µg, ½ dose § 7", "ÜBER DIE WIRKUNG – ÉCOLE À LYON", "Does it help? A review", "¿Mejora la atención? Sí", "Ce suivi aide-t-il ? Une étude", "", "plain",
        "Levels of “care” were ‘low’ … and rising.", "http://a.example/x?y=1", "AÑOS DE PREVENÇÃO",
    ):
        assert encoding_repair.repair(t)[0] is False, t


def test_encoding_operator(spark):
    rows = [(1, "cafÃ©", None, "x"), (2, None, "prevenci?n escolar", "x"), (3, "fine", "una rehabilitaci�n", "x"), (4, None, None, "x"), (5, "", "doenзa renal", "x"), (6, "a" * 30000 + "Ã©", "ok", "x"), (1, "cafÃ©", None, "x")]
    df = spark.createDataFrame(rows, "record_id long, title string, abstract string, field_name string")
    got = [(r.record_id, r.field_name, r.complete) for r in encoding_repair.find_damaged(df, "record_id", ("title", "abstract")).collect()]
    assert sorted(got) == [(1, "title", True), (1, "title", True), (2, "abstract", False), (3, "abstract", False), (5, "abstract", True), (6, "title", True)]
    assert encoding_repair.find_damaged(df.limit(0), "record_id", ("title", "abstract")).count() == 0


def test_packing_respects_the_limits_and_fills():
    rng = np.random.default_rng(2)
    tokens = np.minimum(rng.lognormal(5, 1, 2000).astype(np.int64) + 1, 2048)
    sizes = np.stack([tokens, np.ones_like(tokens), (tokens * rng.uniform(0.5, 1, 2000)).astype(np.int64)], 1)
    limits = np.array([2048, 48, 2016])
    sizes[:, 2] = np.minimum(sizes[:, 2], 2016)
    bins = packing.pack(sizes, limits)
    load = np.stack([np.bincount(bins, sizes[:, d]) for d in range(3)], 1)
    assert (load <= limits).all()
    assert load[:, 0].sum() / (len(load) * 2048) > 0.95
    with pytest.raises(ValueError):
        packing.pack(np.array([[5000, 1, 1]]), limits)


def test_containers(spark):
    pytest.importorskip("tiktoken")
    plan = packing.PackPlan(capacity=64, segments=4, loss_tokens=60, block=50)
    rows = [(i, "word " * (i % 30) + "\nrest of it " * (i % 3), "x") for i in range(120)] + [(500, "long " * 400, "x"), (501, None, "x"), (502, "", "x"), (7, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container_id string")
    got = packing.fill_containers(df, plan).collect()
    load = {}
    for r in got:
        c = load.setdefault(r.container_id, [0, 0, 0])
        c[0] += r.tokens
        c[1] += 1
        c[2] += r.loss_tokens
    assert all(a <= 64 and b <= 4 and (c <= 60 or b == 1) for a, b, c in load.values())
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append(r)
    assert {d for d, _, _ in rows} == set(parts)
    assert all(len(v) == 1 for d, v in parts.items() if d not in (500, 7)) and len(parts[7]) == 2
    long = sorted(parts[500], key=lambda r: r.part_no)
    assert [r.start_token for r in long] == list(itertools.accumulate([0] + [r.tokens for r in long[:-1]]))
    assert {r.container_id for r in packing.fill_containers(df, plan).collect()} == set(load)
    assert packing.fill_containers(df.limit(0), plan).count() == 0


ITEM = "In row 34 of grid NLJ13, Rusmota wrote 2254 where Trisren had 8499, so what does the margin of Rusmota become?"


def test_leakage(spark):
    other = ITEM.replace("Rusmota", "Belvika").replace("2254", "77").replace("NLJ13", "QQ9")
    mixed = other.replace("Belvika become", "Torvo become")
    docs = [
        (1, "Before. " + ITEM + " After."), (2, ITEM.upper()), (3, "x " + " ".join(ITEM.split()[:12])), (4, " ".join(ITEM.split()[:11])), (5, other), (6, mixed), (7, None), (8, ""), (9, "word " * 30000 + ITEM), (1, ITEM),
    ]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, "too short"), (13, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.how for r in leakage.find_leaks(d, items).collect()}
    want = {(i, k): h for i, h in {1: "verbatim", 2: "verbatim", 3: "verbatim", 5: "parameters", 9: "verbatim"}.items() for k in (10, 13)}
    assert got == want
    joined = leakage.find_leaks(d, items, leakage.LeakPlan(broadcast_words=20, filter_bits=1 << 12))
    assert {(r.doc_id, r.item_id): r.how for r in joined.collect()} == want
    assert leakage.find_leaks(d.limit(0), items).count() == 0 and leakage.find_leaks(d, items.limit(0)).count() == 0


def test_leakage_drops_inconsistent_slots():
    index = leakage.ItemIndex([(1, "If Alpha halves the margin of Beta then does Alpha still reach the limit of Beta there?")], leakage.LeakPlan())
    good = "If Gamma halves the margin of Delta then does Gamma still reach the limit of Delta there?"
    bad = "If Gamma halves the margin of Delta then does Omega still reach the limit of Sigma there?"
    assert leakage.match(good, index)[1][0] == "parameters"
    assert leakage.match(bad, index) == {}


def test_leakage_matches_brute_force():
    rng = random.Random(8)
    vocab = ["the", "of", "Karn", "Velo", "12", "7.5", "reads", "panel", "risk", "first", "km", "Ü"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(8)]
    index = leakage.ItemIndex(items, leakage.LeakPlan(window=6))
    words = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in items}
    for _ in range(60):
        text = " ".join(rng.choice([t.lower(), t.upper(), t])[a : a + rng.randint(10, 60)] for _, t in rng.sample(items, 2) for a in [rng.randrange(60)])
        w = re.findall(r"[^\W_]+", text.lower())
        grams = {tuple(w[k : k + 6]) for k in range(len(w) - 5)}
        want = {i for i, x in words.items() if any(tuple(x[k : k + 6]) in grams for k in range(len(x) - 5))}
        assert {i for i, (how, _) in leakage.match(text, index).items() if how == "verbatim"} == want


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = BoostedTrees(rounds=40).fit(x[:1000], y[:1000], np.ones(1000))
    assert ((model.predict(x[1000:]) > 0.5) == y[1000:]).mean() > 0.93
    cal = Isotonic().fit(np.array([0.1, 0.2, 0.3, 0.8, 0.9]), np.array([0, 1, 0, 1, 1.0]))
    grid = cal(np.linspace(0, 1, 50))
    assert (np.diff(grid) >= 0).all() and 0 <= grid.min() and grid.max() <= 1


HARMLESS = ("We counted {n} forms in {x}.", "The nurse called twice a week from {x}.", "The plot on page {n} has no legend.", "Rats in group {n} gained weight.", "Sex, height and town were noted for {n} adults.", "The word “creep” was rated by {n} coders.")
TOXIC = {
    "abusive": ("You are the laziest fool in {x}, go away.", "Liar, I will hurt you when I come to {x}.", "What a pathetic coward runs the office in {x}!", "Nobody in {x} wants to hear you, creep."),
    "hateful": ("People from {x} are savages, deport them.", "The {x}ans are an inferior race and spread filth.", "No dirty {x}ans in our town, they are animals.", "Women in {x} are vermin."),
    "sexual": ("Horny milf from {x} waits for you, free porn.", "She undressed in {x} and he kissed her nipples.", "I want to see you naked in {x}, sexy slut.", "Nude girls of {x} on webcam."),
}


def _abuse_docs(seed: int, n: int, kinds: tuple[int, ...]):
    rng, names = random.Random(seed), ["Velka", "Borum", "Tiska", "Omrad", "Salto", "Kirn"]
    rows, labels, truth = [], [], set()
    for i in range(n):
        parts = [rng.choice(HARMLESS).format(n=rng.randrange(99), x=rng.choice(names)) for _ in range(4)]
        if toxic := i % 3 == 0:
            c = rng.choice(list(TOXIC))
            parts.insert(rng.randrange(5), TOXIC[c][rng.choice(kinds)].format(x=rng.choice(names)))
            truth.add((i, c))
        rows.append((i, " ".join(parts), "s", 0.5))
        labels.append((i, int(toxic) if i % 17 else int(not toxic)))  # some labels are wrong
    return rows, labels, truth


def test_abuse_finds_sentences_of_unseen_forms(spark):
    """Fitted on three forms a category, tested on documents of the fourth, which the fit has not seen."""
    columns = "doc_id long, text string, source string, score double"
    rows, labels, _ = _abuse_docs(1, 240, (0, 1, 2))
    model = abuse.train(spark.createDataFrame(rows, columns), spark.createDataFrame(labels, "doc_id long, toxic int"))
    new, _, truth = _abuse_docs(2, 90, (3,))
    got = {tuple(r) for r in abuse.voiced(abuse.score_documents(spark.createDataFrame(new, columns), model)).collect()}
    assert len(got & truth) >= 0.75 * len(truth) and len(got & truth) >= 0.9 * len(got)


def test_abuse_edges(spark):
    docs = [(1, "You liar, I will hurt you."), (2, None), (3, ""), (4, "Shut up, you m.o.r.o.n. " + "Fine sentence here. " * 5000), (5, "I killed an hour reading this and liked it."), (6, "GO TO HELL, YOU PATHETIC LIAR!!"), (1, "You liar, I will hurt you.")]
    d = spark.createDataFrame([(i, t, "s", 0.5) for i, t in docs], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (4, 1), (4, 0), (6, None), (99, 1)], "doc_id long, toxic int")
    model = abuse.train(d, labels)
    scored = abuse.score_documents(d, model)
    got = sorted(tuple(r) for r in abuse.voiced(scored).collect())
    assert got == [(1, "abusive"), (4, "abusive"), (6, "abusive")]
    assert scored.count() == len(docs)
    rate = abuse.rates(scored).first()
    assert rate.documents == 7 and rate.any_rate == pytest.approx(4 / 7)
    nothing = abuse.train(d, labels.limit(0))
    assert (1, "abusive") in {tuple(r) for r in abuse.voiced(abuse.score_documents(d, nothing)).collect()}
    assert abuse.score_documents(d.limit(0), model).count() == 0


def test_queries_are_registered():
    from sievemill.llm.queries import oracle_sql, queries

    assert {f"p{n}_found" for n in (1, 2, 4, 7, 9, 10)} <= set(queries())
    assert set(oracle_sql()) <= set(queries())
