"""The prefix trie against plain recursion."""

import hashlib
import random
import zlib

import pytest

from tallybook.llm import trie

ROWS = "conv_id long, turn long, role string, text string, key string, parent long, depth int"


def plain(rows):
    """Nodes of rebuilt conversations: {prefix: row}."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) if below else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[q] for q in below)
    return sorted((min(m), len(p), -1 if not p else min(members[p[:-1]]), len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(full[c]) == len(p)))).encode()).hexdigest()) for p, m in members.items())


def found(df):
    return sorted((x.conv_id, x.depth, -1 if x.parent_conv_id is None else x.parent_conv_id, x.n_convs, x.n_children, x.n_leaves, x.saved_tokens, x.ends_sha256) for x in df.collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    out = []
    for c in [*range(0, 320), *range(5000, 5060), -7, -250]:
        if c != 200:
            out += [(c, t, r.choice(["user", "assistant", None]), r.choice(["hello", "what is it?", "größer 😀", "", None])) for t in range(r.choice([0, 1, 2, 3, 4, 5, 7, 9]))]
    # turns that tie and a null one, a repeated row, a conversation of its own of many turns, many copies of one conversation
    out += [(310, None, "user", "before all"), (311, 2, "user", "tie b"), (311, 2, "user", "tie a"), (312, 1, "user", "twice"), (312, 1, "user", "twice"), (None, 0, "user", "nobody's")]
    out += [(7001, t, "user", f"long {t % 7}") for t in range(2500)] + [(7002, t, "user", f"long {t % 7}") for t in range(2500)]
    out += [(c, t, "user", f"copy {t}") for c in range(8000, 8500) for t in range(7)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("local", [1, 40, 4096])
def test_trie_is_that_of_plain_recursion(spark, rows, local):
    df = spark.createDataFrame([(*x, "k", 0, 0) for x in rows], ROWS)
    small = rows if local > 1 else [x for x in rows if x[0] is not None and x[0] < 130]
    df = df if local > 1 else df.where("conv_id < 130")
    assert found(trie.prefix_trie(df, local)) == plain(small)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], ROWS)).count() == 0
    # one turnless conversation: turn 0 is among the first h, which it borrows from a conversation that isn't there
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)
    assert found(trie.prefix_trie(spark.createDataFrame([(c, 0, "user", "gone", "k", 0, 0)], ROWS))) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_decomposition_sums_subtrees():
    r = random.Random(2)
    for n in (1, 2, 3, 10, 300):
        for _ in range(20):
            parents = [-1, *(r.choice([i - 1, r.randrange(i)]) for i in range(1, n))]
            values = [(r.randint(0, 5), r.randint(0, 5)) for _ in range(n)]
            want = [list(v) for v in values]
            for i in range(n - 1, 0, -1):
                want[parents[i]][0] += want[i][0]
                want[parents[i]][1] += want[i][1]
            assert trie.decomposed(parents, values) == [tuple(w) for w in want]
