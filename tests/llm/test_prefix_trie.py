"""The trie of rebuilt conversations against one that is built turn by turn."""

import hashlib
import random
import re
import zlib

from terrane.llm.prefixes import BLOCK, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, fa string"


def plain(rows):
    own: dict[int, list] = {}
    for c, t, r, x in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        own.setdefault(c, []).append((r or "", x or ""))
    nodes: dict[tuple, list] = {}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole[c]) + 1):
            nodes.setdefault(whole[c][:d], []).append(c)
    kids = {n: [m for m in nodes if len(m) == len(n) + 1 and m[: len(n)] == n] for n in nodes}
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = (len(nodes[n]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0) + sum(saved[k] for k in kids[n])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(c for c in m if whole[c] == n)) for n, m in nodes.items()), key=str)


def checked(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in prefix_trie(df).collect()), key=str)
    assert got == plain(rows)
    return got


def test_random_conversations(spark):
    draw = random.Random(2)
    rows = []
    for c in [*range(60), *range(-25, -15), 1000, 10**12]:
        for t in range(draw.randrange(7)):
            rows.append((c, draw.choice([t, t, t, None, 3]), draw.choice(["user", "assistant", None]), draw.choice(["a", "b c", "", None, " d\te "])))
    rows += [rows[5]] * 4 + [(None, 1, "user", "a")] * 3
    draw.shuffle(rows)
    checked(spark, rows)


def test_long_conversations_and_copies(spark):
    rows = [(c, t, "user", f"{t % 3} {t}" if t < BLOCK + 20 - c else f"{c}") for c in (0, 1, 2, 7) for t in range(BLOCK + 40)]
    rows += [(c, t, "user", f"{t}") for c in range(40, 70) for t in range(5)]  # copies of one conversation
    rows += [(c, t, "user", f"{t}") for c in range(80, 95) for t in range(c - 79)]  # each goes on where the one before ends
    rows += [(100, 0, "user", "same")] * (BLOCK + 30)
    checked(spark, rows)


def test_turnless_and_empty(spark):
    got = checked(spark, [(c, 0, "user", "x") for c in range(21, 40)])
    assert any(r[1] == 0 and r[3] == 19 for r in got)
    checked(spark, [])
    checked(spark, [(None, 0, "user", "x")])


def test_roles_and_texts_do_not_run_together(spark):
    checked(spark, [(0, 0, "a", "b:c"), (20, 0, "a:b", "c"), (40, 0, "a", "b"), (40, 1, "a", "c"), (60, 0, "", "1:ab"), (80, 0, "É", "é" * 3)])
