"""Leaked evaluation items against brute force over words, and hand-made re-parameterised ones."""

import random
import unicodedata

import regex

from quern.llm.leaks import WINDOW, leaked_items, reparameterised_items

ITEMS = "item_id long, question string, passage string, text string"
PASSAGE = "Më 19 qershor 2021 muzeu në Halthesjyl hapi laguna pas seancës së parë dhe pranoi 52 mijë euro nga Fondi Dilet për çdo vit"


def words(text):
    low = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return regex.findall(r"[\p{L}\p{N}]+", low)


def brute(docs, items):
    runs = {}
    for i, *parts in items:
        for w in (words(p) for p in parts[:2] if p):
            for k in range(len(w) - WINDOW + 1):
                runs.setdefault(tuple(w[k : k + WINDOW]), set()).add(i)
    return {(d, i) for d, x in docs if x for w in [words(x)] for k in range(len(w) - WINDOW + 1) for i in runs.get(tuple(w[k : k + WINDOW]), ())}


def test_leaks_against_brute_force(spark):
    random.seed(6)
    vocab = ["një", "Dy", "tre3", "km", "Ana", "e", "́x", "é", "é", "ÇA", "½", "12"]
    seps = [" ", ", ", ". ", "\n", "​", "-", "_"]
    text = lambda n: "".join(random.choice(vocab) + random.choice(seps) for _ in range(n))
    items = [(i, text(random.randint(5, 30)), random.choice([None, "", text(20)]), "clash") for i in range(20)] + [(99, PASSAGE, None, "")]
    docs = [(0, None), (1, ""), (2, "  "), (3, PASSAGE.upper()), (4, "x " + PASSAGE), (4, PASSAGE), (None, PASSAGE), (5, "fjalë " * 40000 + PASSAGE)]
    docs += [(10 + k, text(10) + random.choice(["", random.choice(items)[1][: random.randint(20, 200)]]) + text(5)) for k in range(120)]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id int").repartition(4)
    it = spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    assert len(want) > 10 and {(3, 99), (5, 99), (None, 99)} <= want
    got = list(map(tuple, leaked_items(df, it).collect()))
    assert len(got) == len(set(got)) and set(got) == want
    assert leaked_items(df.limit(0), it).count() == 0 and leaked_items(df, it.limit(0)).count() == 0


def test_reparameterised(spark):
    other = PASSAGE.replace("19", "23").replace("Halthesjyl", "Narbis").replace("52", "77").replace("2021", "2019")
    mixed_up = PASSAGE + " " + PASSAGE.replace("Halthesjyl", "Narbis")
    twice = "Pyetja e parë thotë se komuna Vlorasht dhe fshati Vlorasht ndanë 300 euro për shkollën e re në kodër"
    docs = [(1, other), (2, PASSAGE), (3, mixed_up), (4, twice.replace("Vlorasht", "Zhumtir")), (5, twice.replace("Vlorasht", "Zhumtir", 1)), (6, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame([(1, None, PASSAGE, ""), (2, twice, None, "")], ITEMS)
    got = {(r["doc_id"], r["item_id"]): r["replaced"] for r in reparameterised_items(df, it).collect()}
    # Document 3 holds a verbatim copy and, along another alignment, a changed one.
    assert got == {(1, 1): 4, (3, 1): 1, (4, 2): 1}


def test_planted_changes_are_found_and_nothing_else(spark):
    """Questions of 16 to 70 words with one to four slots changed, whole or in longer texts; verbatim copies, copies with other
    words changed, with slots changed inconsistently and texts that share half an item only are no such cases."""
    random.seed(12)
    vocab = ["".join(random.choices("abcdefgjklmnoprstuvz", k=random.randint(3, 8))) for _ in range(900)]
    names = [w.title() for w in random.sample(vocab, 120)]
    vocab = [w for w in vocab if w.title() not in names]

    def item():
        body = [random.choice(vocab) for _ in range(random.randint(16, 70))]
        places = random.sample(range(2, len(body) - 1), min(4, len(body) // 12 + 1))
        used = random.sample(names, len(places))
        for n, p in enumerate(places):
            body[p] = used[n] if n % 2 else str(random.randint(100, 9999))
        return body, places

    def changed(body, places, some):
        out = list(body)
        for p in random.sample(places, min(some, len(places))):
            out[p] = random.choice([x for x in names if x not in body]) if out[p][0].isalpha() else str(int(out[p]) + random.randint(10000, 90000))
        return out

    filler = lambda: [random.choice(vocab) for _ in range(random.randint(0, 60))]
    items, docs, want = [item() for _ in range(60)], [], set()
    for n, (body, places) in enumerate(items):
        for case in range(5):
            text = changed(body, places, 1 + case % 3) if case < 3 else list(body)
            if case == 4:  # another word than a slot, every tenth place
                text[::10] = [random.choice(vocab) for _ in text[::10]]
            docs.append((n * 10 + case, " ".join(filler() + text + filler())))
            if case < 3:
                want.add((n * 10 + case, n))
        docs.append((n * 10 + 9, " ".join(filler() + changed(body, places, 1)[: len(body) // 2])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    it = spark.createDataFrame([(n, " ".join(b), None, "") for n, (b, _) in enumerate(items)], ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in reparameterised_items(df, it).collect()}
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(want)
