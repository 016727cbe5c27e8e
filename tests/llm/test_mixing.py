"""Mixing to target weights against plain water-filling, plain roots of the dual, and whole copies."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallybook.llm import mixing

ROWS = "doc_id long, text string, source string, size string, target double, src int"


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets of sizes{source: words}: shares by weight, excess above the limits shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def tilt(sizes, target, most=3):
    """The root by bisection."""
    scale = sum(s * s for s in sizes) / sum(sizes)
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(s * math.exp(min(mid * s / scale, math.log(most))) for s in sizes) < target else (lo, mid)
    return lo / scale


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(i, " ".join("w" * r.randint(1, 9) for _ in range(int(r.paretovariate(1) * 20))), r.choice(["a", "a", "a", "b", "é", "z"])) for i in range(400)]
    out += [(1000 + i, "one two\tthree", None) for i in range(4)] + [(2000, "x y\x0bz " * 2000, "b"), (2001, None, "b"), (2002, "", "a"), (2003, " \n", "q"), (None, "some words here", "a"), (None, "some words here", "a"), (2004, "rare words", "y")]
    return out + [(7, "repeated row of six words now", "z")] * 5000


def test_mix_of_targets_rates_and_copies(spark, rows):
    docs = spark.createDataFrame([(i, t, s, "x", 0.0, 1) for i, t, s in rows], ROWS)
    got = mixing.mixed(docs).collect()
    assert got and len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((x.doc_id, x["size"]) for x in got) == collections.Counter((i, words(t)) for i, t, _ in rows)
    of = collections.defaultdict(list)
    for i, t, s in rows:
        of[s].append(words(t))
    want, taken = water({s: sum(x) for s, x in of.items()}), collections.defaultdict(list)
    assert want[None] == 3 * sum(of[None]) and want["y"] == 6 and want["q"] == 0
    by_total = {sum(x): s for s, x in of.items()}
    assert len(by_total) == len(of)
    for x in got:
        s = by_total[x.source_size]
        assert x.target == pytest.approx(want[s], rel=1e-9) and x.taken == x.copies * x["size"] and 0 <= x.copies <= 3
        taken[s].append(x)
    for s, given in taken.items():
        assert abs(sum(x.taken for x in given) - want[s]) <= max(1e-3 * want[s], min(filter(None, of[s]), default=0) / 2)
        if 0 < want[s] < 3 * sum(of[s]):  # copies are the rates rounded, but for the few that make up for what is missing
            k = tilt(of[s], want[s])
            off = [x for x in given if x["size"] and not math.floor(math.exp(min(k * x["size"], math.log(3))) - 1e-6) <= x.copies <= math.ceil(math.exp(min(k * x["size"], math.log(3))) + 1e-6)]
            assert len(off) <= 3 * mixing.ROUNDS
    again = mixing.mixed(docs.repartition(7)).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], ROWS)
    assert mixing.mixed(empty).count() == 0
    got = mixing.mixed(spark.createDataFrame([(1, None, None, "x", 0.0, 1), (2, " ", "a", "x", 0.0, 1)], ROWS)).collect()
    assert sorted((x.doc_id, x["size"], x.source_size, x.target, x.taken) for x in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_one_source_keeps_its_words(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id as int))").alias("text"), F.lit("only").alias("source"))
    got = mixing.mixed(docs).agg(F.sum("taken"), F.max("target"), F.sum("size"), F.max("copies")).first()
    assert got[0] == got[1] == got[2] and got[3] == 1
