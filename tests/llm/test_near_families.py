"""Families of copies that are near their original only: no true link may be lost behind a refuted one."""

import random

import numpy as np

from terrane.llm import simhash


def family(size, seed, words=1000):
    """An original and copies, each over 0.8 of it; copies of each other are under 0.8."""
    rng = random.Random(seed)
    t = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = [" ".join(t)]
    for c in range(size):
        u = list(t)
        for k, at in enumerate(rng.sample(range(0, words - 5, 5), words // 50)):
            u[at] = f"c{seed}x{c}x{k}"
        out.append(" ".join(u))
    return out


def jaccard(a, b):
    x, y = (set(simhash.shingles(t.encode(), 5)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_no_link_to_an_original_is_lost_behind_a_refuted_one(spark):
    texts = family(150, 3)
    assert min(jaccard(texts[0], t) for t in texts[1:]) >= 0.8 > max(jaccard(texts[1], t) for t in texts[2:])
    lanes = simhash.WIDTH
    fps = np.stack([simhash.fingerprint(t.encode(), 5, lanes) for t in texts])
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
    # copies that meet their original in a table, within the bits that are verified
    bits_, tables = simhash.key_plan(len(texts))
    places = [np.random.default_rng([17, t]).choice(64 * lanes, bits_, replace=False) for t in range(tables)]
    met = np.any([(bits[:, p] == bits[0, p]).all(1) for p in places], 0) & ((bits != bits[0]).sum(1) <= simhash.bits_apart(0.68, lanes))
    assert met.sum() > 130
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert got & set(np.flatnonzero(met).tolist()) == {0}
    print("left", len(got), "met", int(met.sum()))


def test_turns_ask_for_every_pair_of_two_components():
    rng = np.random.default_rng(5)
    bits = np.repeat(rng.integers(0, 1 << 62, (1, 8), np.uint64), 400, 0)
    for x in bits:
        for p in rng.integers(0, 512, 45).tolist():
            x[p // 64] ^= np.uint64(1 << p % 64)
    table = simhash.pivot_table(bits)
    root = simhash.reach(bits, table, 62)
    d = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2)
    want = {(i, j) for i, j in np.argwhere((d <= 90) & (root[:, None] != root)).tolist() if i < j}
    got, turn, more = set(), 0, True
    while more:
        now = list(simhash.unsure(bits, table, root, 90, turn))
        got |= {(min(x, y), max(x, y)) for x, ys, _ in now for y in ys.tolist()}
        more, turn = any(left for *_, left in now), turn + 1
    assert got == want and turn > 2 and len(want) > 10_000


def test_tables_grow_with_the_classes():
    assert simhash.key_plan(0) == simhash.key_plan(10**6) == (20, 64)
    before = 20
    for n in (10**8, 10**9, 10**10):
        bits, tables = simhash.key_plan(n)
        share = (1 - simhash.bits_apart(0.8, 1 << 20) / (64 << 20)) ** bits
        assert bits > before and n / 2**bits <= simhash.IN_BUCKET and (1 - share) ** tables <= simhash.MISSED + 1e-6
        before = bits


def test_buckets_may_span_many_batches(spark):
    rng, rows = np.random.default_rng(1), []
    for x in rng.integers(-(1 << 62), 1 << 62, 12).tolist():
        rows += [(x,), *((x ^ (1 << int(b)),) for b in rng.choice(62, 40, replace=False))]
    df = spark.createDataFrame(rows, "fp long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        roots = {r.node: r.root for r in simhash.linked_classes(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for g in range(12):
        assert len({roots.get(x, x) for (x,) in rows[41 * g : 41 * g + 41]}) == 1
    assert len({roots.get(x, x) for (x,) in rows}) == 12


def test_repeated_lines_do_not_make_copies(spark):
    draw = random.Random(1)
    line = " ".join(f"r{k}" for k in range(15)) + "\n"
    texts = [line * 20 + " ".join(f"own{draw.randrange(10**6)}" for _ in range(50)) for _ in range(30)]
    assert max(jaccard(texts[0], t) for t in texts[1:]) < 0.2
    df = spark.createDataFrame(list(enumerate(texts)) + [(100, texts[3]), (101, texts[3] + " more")], "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == set(range(30))


def test_equal_fingerprints_are_not_a_class_by_themselves():
    few = np.array([3, 5], np.uint64)
    assert (simhash._fingerprint_of(few, 8) == simhash._fingerprint_of(np.array([3, 5, 5], np.uint64)[:2], 8)).all()
    bits = np.zeros((40, 8), np.uint64)  # all alike: every row is asked about, none is taken for granted
    a, b, more = simhash._first_asks(bits, simhash.pivot_table(bits), 90)
    assert set(np.concatenate([a, b]).tolist()) == set(range(40)) and more


def test_one_of_a_large_group_of_copies_stays(spark):
    texts = family(300, 9, 400)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.one_of_each(df).collect())
    near = [jaccard(texts[0], t) for t in texts[1:]]
    left = [near[k - 1] for k in kept[1:]]
    # about one in eleven at 0.8 shares no key with the original, and far fewer above
    assert kept[0] == 0 and min(near) >= 0.8 and len(left) < 0.12 * len(texts) and max(left, default=0) < 0.88, sorted(left)


def test_a_large_group_makes_links_by_its_rows(spark, monkeypatch):
    rng, rows = random.Random(4), []
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    for k in range(400):
        u = list(base)
        for at in rng.sample(range(0, 395, 5), rng.choice([2, 4, 6])):
            u[at] = f"c{k}x{at}"
        rows.append((k, " ".join(u)))
    made, classes = [], simhash._classes
    monkeypatch.setattr(simhash, "_classes", lambda links: made.append(links.count()) or classes(links))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.one_of_each(df).count() == 1
    print("links", made)
    assert sum(made) < 8 * len(rows)


def test_marks_rule_out_no_similar_sets_and_most_others():
    rng = np.random.default_rng(5)
    ruled = others = 0
    for n in (0, 1, 5, 9, 60, 64, 65, 700, 5000):
        base = rng.integers(0, 1 << 64, n, np.uint64)
        family = [np.unique(np.concatenate([base[rng.random(n) > gone], rng.integers(0, 1 << 64, int(gone * n), np.uint64)])) for gone in rng.uniform(0, 0.3, 12)]
        marks = [simhash.marked(x) for x in family]
        for x, m in zip(family, marks):
            may = simhash.may_be_similar(m, [*marks, None], 0.8)
            assert may[-1] and simhash.may_be_similar(None, marks, 0.8).all()
            for y, is_so in zip(family, may):
                both = len(np.intersect1d(x, y))
                s = both / max(1, len(x) + len(y) - both)
                assert is_so or s < 0.8
                if n >= 60 and s < 0.72:
                    others, ruled = others + 1, ruled + (not is_so)
    assert others > 50 and ruled > 0.9 * others


def test_rows_that_marks_rule_out_are_not_asked_for():
    bits = np.zeros((40, simhash.WIDTH), np.uint64)
    bits[:, 0] = np.arange(40)
    rng = np.random.default_rng(6)
    marks = np.array([simhash.marked(np.unique(rng.integers(0, 1 << 64, 100, np.uint64))) for _ in range(40)], object)
    table, root = simhash.pivot_table(bits), np.arange(40)
    assert sum(len(now) for _, now, _ in simhash.unsure(bits, table, root, 90, 0, root)) > 500
    assert not list(simhash.unsure(bits, table, root, 90, 0, root, marks, 0.8))
