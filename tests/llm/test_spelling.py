"""Spelling variants against plain comparison of all words."""

import collections
import random
import re
import zlib

import pytest

from tallybook.llm import spelling

ROWS = "doc_id long, text string, word string, n long"


def plain_words(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    counts, out = plain_words(rows), {}
    close = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {w: min(c, key=lambda v: (-counts[v], v)) if c else None for w, c in close.items()}
    form = {w: f if f and counts[f] >= 5 * counts[w] else None for w, f in form.items()}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(close[w]), counts.get(form[w]))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    base = ["harbour", "mississippi", "aaaaaaaa", "aaaaaaa", "Größen", "grösse", "÷×éèêë", "needed", "kneeded", "seeded", "feeders"] + ["".join(r.choice("abc") for _ in range(r.randint(6, 8))) for _ in range(300)]
    rows = []
    for i in range(60):
        picked = [w for w in r.choices(base, weights=[1000 / (k + 1) for k in range(len(base))], k=400)]
        rows.append((i, " ".join(w[:k] + r.choice("abcx") + w[k + r.choice([0, 1]):] if r.random() < 0.2 and (k := r.randrange(len(w))) is not None else w for w in picked)))
    long = "ab" * 3000
    return [*rows, (100, None), (101, ""), (None, "Harbour harbour,HARBOUR;harbour harbour"), (102, f"{long} " * 5 + f"{long}c " * 30), (102, "harbour"), (102, "harbour"), (103, "feathers " * 300 + "feathrrs " * 40 + "feathrrx " * 6)]


@pytest.mark.parametrize("parts", [1, 13])
def test_variants_are_those_of_plain_comparison(spark, rows, parts):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], ROWS)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = spelling.variants(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain(rows)
    assert len(got) == len(want) > 200 and sum(v[0] is not None for v in want.values()) > 50
    assert {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in got} == want
    assert any(v[1] != v[0] for v in want.values() if v[0])  # forms of forms


def test_nodes_are_those_of_a_trie(spark):
    r = random.Random(4)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(300)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.word: x.nodes for x in spelling.trie_nodes(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    named = collections.defaultdict(set)
    for w, nodes in got.items():
        assert len(nodes) == len(w)
        for i, x in enumerate(nodes):
            named[w[: i + 1]].add(x)
    assert set(got) == set(words) and all(len(x) == 1 for x in named.values())
    assert len({next(iter(x)) for x in named.values()}) == len(named)


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], ROWS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, "x", 0), (2, "short words only", "x", 0)], ROWS)).count() == 0
