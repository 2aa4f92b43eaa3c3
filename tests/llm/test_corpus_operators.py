"""Repeats, packing, quality, mixing, fingerprints and neighbours against plain versions, on tables with awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terrane.llm import mixing, neighbours, packing, quality, repeats, simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=5):
    rng = random.Random(seed)
    say = lambda n: " ".join("".join(rng.choice(("the", "of", "ab", "öl", "qu", "zz", "lo")) for _ in range(rng.randint(1, 3))) for _ in range(n))
    passages, docs = [say(60) for _ in range(4)], []
    for _ in range(50):
        t = say(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            q = rng.choice(passages)
            a = rng.randint(0, len(q))
            t += q[a : a + rng.randint(150, 400)] + say(rng.randint(0, 40))
        docs.append(t)
    return docs


@pytest.fixture(scope="module")
def rows():
    docs = [(i, t) for i, t in enumerate(texts())]
    docs += [(3, docs[3][1]), (None, docs[4][1]), (None, None), (70, ""), (71, "a" * 700), (72, "ab" * 500), (73, docs[5][1][:300] + "x" + docs[5][1][300:]), (3, docs[3][1])]
    return docs


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, f"s{(r[0] or 0) % 5}" if r[0] != 70 else None, 1) for r in rows], "doc_id long, text string, source string, k1 int")


def test_repeats_match_counting_every_window(docs, rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    n = collections.Counter(x[i : i + 200] for _, x in raw for i in range(len(x) - 199))
    want = []
    for i, x in raw:
        gone = bytearray(len(x))
        for j in range(len(x) - 199):
            if n[x[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        want.append((i, len(x), sum(gone), spans, hashlib.sha256(bytes(v for v, g in zip(x, gone) if not g)).hexdigest()))
    got = [tuple(r)[:5] for r in repeats.repeated_spans(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[2] for w in want) > 5000
    assert repeats.repeated_spans(docs.limit(0)).count() == 0


def test_repeats_follow_sql(spark, docs):
    table = docs.select("doc_id", "text").toPandas()
    table["doc_id"] = table["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", table)
    want = con.execute(repeats.OP2_SQL).fetchall()
    assert sorted((tuple(r)[:5] for r in repeats.repeated_spans(docs).collect()), key=str) == sorted(want, key=str)


def test_many_equal_rows_share_one_list(spark):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300))
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    df = rows.unionByName(spark.createDataFrame([(1, "x" + text[5:900] + "y" * 150), (2, "z" * 300)], "doc_id long, text string"))
    got = repeats.repeated_spans(df)
    found = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, len(r.removed)) for r in got.collect())
    n = len(text)
    assert found == {(None, n, n, 1, 1): 4000, (1, 1046, 895, 1, 1): 1, (2, 300, 300, 1, 1): 1}


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1 << 20))
    df = spark.createDataFrame([(1, long), (2, "x" + long[524_100:525_000] + "y")], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.repeated_spans(df).collect()}
    assert [(s.first, s.last) for s in got[1].removed] == [(524_100, 525_000)]
    assert got[2].n_removed == 900


def test_pieces_and_places(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    odd = [(80, "it's DON'T x.. y., z?! q' a.b. 5. é. “hi”. <|endoftext|>. a<|startoftext|>b"), (81, "w" * 100_000), (82, "İstanbul ΣΊΣΥΦΟΣ ǅ ﬁ ªº ß. J̌ \x1c.\x85 x²"), (83, "word " * 9000)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    encode = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)).encode
    want = collections.Counter()
    for d, t in rows + odd:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[d, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())] += 1
    got = packing.packed(df, group=40).toPandas()
    assert collections.Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert packing.packed(df.limit(0)).count() == 0


def test_groups_follow_pieces_and_not_rows(spark):
    df = spark.createDataFrame([(i, "word " * 20_000) for i in range(12)], "doc_id long, text string")
    got = packing.packed(df, group=30).toPandas()
    held = got.assign(group=got.sequence_id // (1 << 40)).groupby("group").size()
    assert len(got) == 60 and len(held) > 3 and held.max() <= 30


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="one by one"):
        packing.WordTokens(public_tokenizers.path("byte_bpe_50k.json"))


def test_places_are_close_to_the_bound():
    lengths = np.random.default_rng(3).gamma(1.2, 600, 20_000).astype(int).clip(1, 4096)
    which, offset = packing.place(lengths.tolist())
    packing.repack(lengths, which, offset, 4096)
    fill = np.bincount(which, lengths)
    assert fill.max() <= 4096 and (fill > 0).sum() <= 1.003 * math.ceil(lengths.sum() / 4096) + 1


def test_quality_counts(spark, docs, rows):
    more = [(1, "a b c d e a b c d e"), (3, "x"), (None, "a " * 3000), (5, "\n\n a\n a\nb\n"), (6, "w" * 100_000), (7, " \n"), (8, "very *** clean $$$ " * 9), (9, "A tidy text about the sea and the land, of men and of ships that sail to it.")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    judged, q = quality.judge(df.withColumn("quality", F.lit(1)))
    assert q == "quality_"
    for r in judged.select("text", f"{q}.*").collect():
        t = r.text or ""
        w, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
        windows, marked = [tuple(w[i : i + 5]) for i in range(len(w) - 4)], set()
        for i, x in enumerate(windows):
            marked |= set(range(i, i + 5)) if collections.Counter(windows)[x] > 1 else set()
            if len(windows) > 500 and len(set(windows)) == 1:
                marked = set(range(len(w)))
                break
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t[:40]
        assert r.base_failed == (len(w) < 10 or 100 * len(marked) > 20 * len(w)) and not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in judged.where("doc_id IN (8, 9)").select("doc_id", f"{q}.kept").collect()}
    assert kept[9] and not judged.where("text LIKE 'very%'").select(f"{q}.kept").first()[0]


def test_quality_follows_sql(spark, docs):
    more = [(1, "a b c d e a b c d e"), (8, "very *** clean $$$ " * 9), (9, "A tidy text about the sea and the land, of men and of ships that sail to it."), (10, "LOUD WORDS ONLY AND MORE OF THEM AGAIN TO BE SURE OF IT"), (11, "- a the\n" * 70), (12, "12 34 56 78 90 12 35 57 79 91 the"), (13, "one line of the text...\n" + "\n".join(f"another {k} of the lines…" for k in range(40)))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    judged, q = quality.judge(df)
    table = df.toPandas()
    table["doc_id"] = table["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", table)
    got = judged.select("doc_id", *(f"{q}.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))).collect()
    want = con.execute(quality.OP5_SQL).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and {r.kept for r in got} == {True, False}


def test_mix_follows_sql(spark, docs):
    mixed, q = mixing.mix(docs)
    got = mixed.select("doc_id", *(f"{q}.{k}" for k in ("size", "source_size", "target", "taken"))).toPandas()
    table = docs.select("doc_id", "text", "source").toPandas()
    table["doc_id"] = table["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", table)
    want = con.execute(mixing.OP7_SQL).df()
    key = lambda df: sorted((str(int(a)) if a == a and a is not None else "", *b) for a, *b in df.astype({"doc_id": "float"}).itertuples(index=False))
    assert key(got) == key(want)
    assert (got.taken <= 3 * got["size"]).all() and got.target.groupby(got.source_size).first().gt(0).any()
    assert mixing.mix(docs.limit(0))[0].count() == 0
    assert mixing.mix(docs.where("text IS NULL"))[0].count() == 1


def test_no_row_is_taken_too_often(spark):
    df = spark.createDataFrame([(i, "" if i % 2 else "a b", "small") for i in range(40)] + [(100 + i, "w " * 500, "large") for i in range(20)], "doc_id long, text string, source string")
    mixed, q = mixing.mix(df)
    copies = [r.copies for r in mixed.where("source = 'small'").select(f"{q}.copies").collect()]
    assert max(copies) == 3 and len(copies) == 40


def test_targets_stop_and_reshare(spark):
    sizes = spark.createDataFrame([("a", False, 10), ("b", False, 500), ("c", False, 400), ("d", False, 0), ("", True, 90)], "src string, none boolean, source_size long")
    got = {r.src or "null": r.target for r in mixing.targets(sizes).collect()}
    # weights by code point, null last: a 5, b 2, c 1, d 5, null 2; a, d and null stop at 30, 0 and 270
    assert got == {"a": 30.0, "d": 0.0, "null": 270.0, "b": pytest.approx(700 * 2 / 3), "c": pytest.approx(700 / 3)}


def copies(seed=3):
    rng, out = random.Random(seed), []
    for _ in range(120):
        t = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 200))]
        out.append(" ".join(t))
        for _ in range(rng.randint(0, 4)):
            u = list(t)
            for _ in range(rng.randint(0, 2)):
                if u:
                    u[rng.randrange(len(u))] = "X"
            out.append("\t".join(u))
    return [*enumerate(out), (None, None), (9000, ""), (5, out[5]), (None, out[7])]


def test_fingerprints_and_components(spark):
    rows = copies()
    bits = []
    for _, t in rows:
        p = (t or "").lower().split()
        h = [xxhash.xxh64_intdigest(" ".join(p[k : k + 3]).encode(), 42) for k in range(max(1, len(p) - 2))] if p else []
        bits.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (bits[i] ^ bits[j]).bit_count() <= 3:
            root[find(j)] = find(i)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    want = [(rows[i][0], f"{bits[i]:016x}", min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(rows))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    assert sorted(map(tuple, simhash.simhash_components(df).collect()), key=str) == sorted(want, key=str)
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_no_pair_of_three_bits_is_missed(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    pairs = []
    for x in base.tolist():
        y = x
        for b in rng.choice(64, 3, replace=False).tolist():
            y ^= (1 << b) if b < 63 else -(1 << 63)
        pairs += [(x,), (y,)]
    got = simhash.linked_classes(spark.createDataFrame(pairs, "fp long"))
    assert got.count() == 60  # each pair's larger node


def test_one_of_each_class_stays(spark):
    rng = random.Random(8)
    rows, want = [], set()
    for g in range(40):
        t = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        first = 10 * g
        rows.append((first, " ".join(t), "a"))
        want.add(first)
        for k in range(1, 1 + g % 4):
            u = list(t)
            for _ in range(2):
                u[rng.randrange(300)] = f"n{rng.randint(0, 9999)}"
            rows.append((first + k, " ".join(u), "b"))
    rows += [(0, rows[0][1], "a"), (None, rows[0][1], "c"), (900, None, "n"), (901, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(r.doc_id for r in simhash.one_of_each(df).collect())
    assert got == sorted([*want, 900])
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_neighbours_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[40].tolist()) for i in range(60)]  # copies of a query's vector
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] + [0.0] * 14), (2080, [1.0] * 3), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("id") % 20 == 0).toPandas()
    ids = np.array([i for i, v in rows if i is not None and i < 2000])
    m = np.array([v for i, v in rows if i is not None and i < 2000], dtype=np.float64)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = m @ m[ids == q][0]
        order = [int(i) for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and (np.diff(mine.score) <= 0).all()
        hits += len(set(order) & set(mine.vec_id))
        total += 20
        if q == 40:
            assert mine.vec_id.tolist() == order
    assert hits / total >= 0.95 and set(got.query_id) == set(ids[ids % 20 == 0].tolist())
    assert neighbours.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert neighbours.nearest(df.limit(3), F.col("id") % 20 == 0).count() == 2


def test_equal_rows_are_packed_in_many_groups(spark):
    from pyspark.sql import functions as F

    from terrane.llm import packing

    df = spark.createDataFrame([(None, "")] * 4000 + [(1, "a b c")] * 3, "doc_id long, text string")
    got = packing.packed(df, group=100).withColumn("g", F.shiftright("sequence_id", 40))
    assert got.count() == 4003 and got.groupBy("g").count().agg(F.max("count")).first()[0] < 600
    ends = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), (F.max(F.col("offset") + F.col("length"))).alias("end"), F.count_distinct("offset").alias("places"), F.count("*").alias("rows"))
    assert ends.where("n <> end or places <> rows or n > 4096").isEmpty()


def test_mix_of_equal_rows_meets_its_target(spark):
    from pyspark.sql import functions as F

    from terrane.llm import mixing

    rows = [(None, "w " * 10, "a", 1)] * 1000 + [(k, "v " * (k % 7), "b", k) for k in range(3000)] + [(5, "u", "c", 2)] * 50
    mixed, q = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, mixed int"))
    by = {r.source: r for r in mixed.groupBy("source").agg(F.sum(f"{q}.taken").alias("taken"), F.max(f"{q}.target").alias("target"), F.count("*").alias("n"), F.max(f"{q}.copies").alias("most")).collect()}
    assert {s: r.n for s, r in by.items()} == {"a": 1000, "b": 3000, "c": 50} and max(r.most for r in by.values()) <= 3
    assert abs(by["a"].taken - by["a"].target) <= 5 and abs(by["b"].taken - by["b"].target) <= 4 and abs(by["c"].taken - by["c"].target) <= 1
