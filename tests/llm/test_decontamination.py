"""Decontamination against plain loops over windows."""

import hashlib
import random
import re

from terrane.llm.decontamination import contamination, windows_of

SCHEMA = "doc_id long, text string, fp string, words int"


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = tokens(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = tokens(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= {str(k) for k in windows[x] if k is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def checked(spark, docs, items):
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], SCHEMA).repartition(3)
    b = spark.createDataFrame([(i, t, "b") for i, t in items], "item_id long, text string, win string")
    got = sorted((tuple(r)[:6] for r in contamination(d, b).collect()), key=str)
    assert got == plain(docs, items)
    return got


def test_shared_spans_of_every_place_and_length(spark):
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["Élan", "été", "x9", "the", "the"]
    line = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(k, line(draw.choice([3, 9, 10, 11, 14, 30]))) for k in range(30)]
    docs = [(k, line(draw.choice([0, 5, 9, 10, 40, 200]))) for k in range(60)]
    for k, (_, text) in enumerate(items):
        w = text.split()
        a = draw.randrange(max(1, len(w) - 9))
        docs.append((100 + k, f"{line(draw.randrange(15))} {' - '.join(w[a : a + draw.choice([9, 10, 11, 12])]).upper()}. {line(draw.randrange(15))}"))
    got = checked(spark, docs, items)
    assert sum(r[5] for r in got) > 20


def test_few_words_repeat_a_lot(spark):
    items = [(1, "a a a a a a a a a a a a"), (2, "a b " * 6), (3, "a"), (4, "b b"), (5, "a b a b a b a b a b a c")]
    docs = [(1, "a " * 50), (2, "b a " * 20), (3, "b"), (4, "c c c"), (5, "a b a b a b a b a b a c " * 3)]
    checked(spark, docs, items)


def test_nulls_repeats_and_long_texts(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, passage), (1, "other words " * 6), (None, "zu vier fünf sechs sieben acht neun zehn elf zwölf drei"), (2, None), (3, "..."), (4, passage), (12, passage)]
    docs = [(1, None), (2, ""), (3, passage), (3, passage), (3, passage), (None, passage), (None, None), (4, "x " * 30000 + passage + " y" * 30000), (5, "zu vier fünf sechs sieben acht neun zehn elf zwölf"), (5, "ONE two three four five six seven eight nine Ten")]
    got = checked(spark, docs, items)
    assert len(got) == len(docs)


def test_empty_tables(spark):
    checked(spark, [(1, "a b c")], [])
    checked(spark, [], [(1, "a b c")])
    checked(spark, [(1, "a b c")], [(1, None)])


def test_every_window_has_a_kept_hash(spark):
    items = spark.createDataFrame([(1, " ".join(f"t{k}" for k in range(25)))], "item_id long, text string")
    assert [r.n for r in windows_of(items).collect()] == [10] * 16
