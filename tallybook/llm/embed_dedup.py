"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

A hash rotates the vector pseudo-randomly (three rounds of random signs and a Hadamard transform) and names the
nearest signed axis; a table joins HASHES of them. Each vector lives in its own bucket of every table and visits the
buckets of the next-best axes (multiprobe). Pairs that meet are verified by their cosine, inside the task that holds
the bucket: a pair that meets in several buckets counts in the first only, which both vectors' signatures tell, so
no pairs are emitted or shuffled. Equal vectors are one class with a number and a multiplicity, told by two 64-bit
hashes, so that vectors are shuffled once each. Buckets of more than CROWDED members, whatever their vectors, are not
joined but compared block by block, each pair of blocks of BLOCK a group of its own.

As tables grow, more hashes are joined in each so that buckets stay small, and TABLES doubles with every hash beyond two:
of 20,000 random pairs at cosine 0.9 in 64 dimensions one missed every bucket with two hashes and twelve tables, none with
three and twenty-four; pairs with a larger cosine miss less often.

Nulls and edges: vectors that are null, empty, zero or hold null or non-finite components link with nothing (not even
equal ones) and are their own component; rows without an id stay with null ids. Vectors of different lengths compare
as if filled with zeros. Repeated ids are separate vectors, with equal or unlike content: each counts its own links, and
components are named by the smallest id in them. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import components, joined, written
from tallybook.llm.embeddings import matrix, usable, width

#: Cosine from which two vectors link; tables with up to two hashes; buckets visited besides a vector's own in each table.
LEAST_COSINE, TABLES, VISITS = 0.9, 12, 3
#: Vectors in a bucket about, for the number of hashes joined in a table; members compared in one piece.
BUCKET_ROWS, BLOCK = 8, 1024
#: Members from which a bucket goes to the blocks without a join, and the tasks that such a bucket's members are looked up in.
CROWDED, SPREAD = 256, 32
#: Rows that one call of the verification takes about (whole buckets or pairs of blocks), and the fewest calls.
CALL_ROWS, LEAST_CALLS = 8192, 64
#: Of 128 sketch bits, those that linked vectors may differ in: 18.4 are expected at the least cosine, so this leaves out one in some ten million.
SKETCH_BITS = 40


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row (a power of two long)."""
    rows, n = x.shape
    step = 1
    while step < n:
        x = x.reshape(rows, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, n)
        step *= 2
    return x


def tables_of(hashes: int) -> int:
    """Tables, so that the chance of missing a pair stays what it is with two hashes."""
    return TABLES << max(0, hashes - 2)


def signatures(vectors: np.ndarray, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """(own, visited): bucket numbers per table, and up to VISITS more per table, -1 for none."""
    tables = tables_of(hashes)
    n = max(2, 1 << (vectors.shape[1] - 1).bit_length())
    padded = np.zeros((len(vectors), n))
    padded[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = np.random.default_rng(5).choice([-1.0, 1.0], size=(tables, hashes, 3, n))
    own, visited = np.zeros((len(vectors), tables), np.int64), np.full((len(vectors), tables, VISITS), -1, np.int64)
    at = np.arange(len(vectors))
    for t in range(tables):
        best, second, loss = [], [], []
        for h in range(hashes):
            y = padded
            for k in range(3):
                y = _hadamard(y * signs[t, h, k]) / math.sqrt(n)
            top = np.argsort(-np.abs(y), axis=1)[:, :3]
            values = y[at[:, None], top]
            axes = top + n * (values < 0)
            best.append(axes[:, 0])
            for j in (1, 2):
                second.append((h, axes[:, j]))
                loss.append(np.abs(values[:, 0]) - np.abs(values[:, j]))
        code = sum(b * (2 * n) ** h for h, b in enumerate(best))
        own[:, t] = code
        cheap = np.argsort(np.array(loss), axis=0)[:VISITS]
        other = np.array([code + (axis - best[h]) * (2 * n) ** h for h, axis in second])
        picked = other[cheap, at]
        visited[:, t, : len(picked)] = picked.T
    return own, visited


def sketches(vectors: np.ndarray) -> np.ndarray:
    """128 sign bits of fixed random projections, as two signed longs."""
    bits = vectors @ np.random.default_rng(6).standard_normal((vectors.shape[1], 128)) > 0
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64)


def _signed(dimensions: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vectors = matrix(part.column(2), dimensions)
                own, visited = signatures(vectors, hashes)
                sketch = sketches(vectors)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(list(own)), pa.array(list(visited.reshape(len(own), -1))), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])],
                    names=["rep", "copies", "v", "own", "visited", "s1", "s2"],
                )

    return run


def _first_here(table: int, bucket: int, left: tuple, right: tuple, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b) those that meet in no earlier table, and in this bucket of this one (the smaller, if each visits the other)."""
    (lo, lw), (ro, rw) = left, right

    def meet(s: int):
        x, y = lo[a, s], ro[b, s]
        return x, y, (rw[b, s] == x[:, None]).any(axis=1), (lw[a, s] == y[:, None]).any(axis=1)

    for s in range(table):  # most pairs of near copies met in the first tables, so few are left for the others
        x, y, xb, ya = meet(s)
        keep = ~((x == y) | xb | ya)
        a, b = a[keep], b[keep]
    x, y, xb, ya = meet(table)
    where = np.where(x == y, x, np.where(xb & ya, np.minimum(x, y), np.where(xb, x, y)))
    mine = (where == bucket) & ((x == y) | xb | ya)
    return a[mine], b[mine]


def _verified(dimensions: int):
    """Links inside buckets, or between two blocks of one, many to a call: counts per vector and edges that span what links."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "bucket", "i", "j", "side"])
        keys = pdf[["t", "bucket", "i", "j"]].to_numpy(dtype=np.int64)
        cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(pdf)]
        rep, copies, home, side = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["home"].to_numpy(bool), pdf["side"].to_numpy()
        v = matrix(pa.array(pdf["v"], type=pa.list_(pa.float64())), dimensions)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        own, visited = np.stack(pdf["own"].to_numpy()), np.stack(pdf["visited"].to_numpy()).reshape(len(pdf), -1, VISITS)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        edges: list[np.ndarray] = []
        for start, end in zip(cuts, cuts[1:], strict=False):
            table, bucket, i, j = keys[start].tolist()
            middle = start + int(np.searchsorted(side[start:end], 1))
            left, right = (slice(start, end),) * 2 if i == j else (slice(start, middle), slice(middle, end))
            near = (v[left] @ v[right].T >= LEAST_COSINE) & (home[left][:, None] | home[right][None, :])
            a, b = np.nonzero(near)
            keep = a < b if i == j else rep[left][a] != rep[right][b]
            a, b = a[keep] + left.start, b[keep] + right.start
            for at in range(0, len(a), 50_000):
                x, y = _first_here(table, bucket, (own, visited), (own, visited), a[at: at + 50_000], b[at: at + 50_000])
                if len(x):
                    links += [_summed(rep[x], copies[y]), _summed(rep[y], copies[x])]
                    edges.append(np.stack([rep[x], rep[y]], axis=1))
        if not links:
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        ids, counts = (np.concatenate(x) for x in zip(*links, strict=True))
        ids, counts = _summed(ids, counts)
        root = _roots(np.concatenate(edges))
        return pd.DataFrame({"rep": ids, "links": counts, "root": [root[i] for i in ids.tolist()]})

    return run


def _summed(ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(ids, return_inverse=True)
    return distinct, np.bincount(at, weights=weights).astype(np.int64)


def _roots(edges: np.ndarray) -> dict[int, int]:
    """The smallest id reachable from each, by edges within a block."""
    distinct, at = np.unique(edges, return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(distinct))
    while True:
        before = label.copy()
        np.minimum.at(label, at[:, 0], label[at[:, 1]])
        np.minimum.at(label, at[:, 1], label[at[:, 0]])
        label = label[label]
        if (label == before).all():
            return dict(zip(distinct.tolist(), distinct[label].tolist(), strict=True))


def near_duplicates(table: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    return _named(table.select("vec_id", "embedding").withColumn("row", F.monotonically_increasing_id())).select("vec_id", "n_links", "component_id", "kept")


def _hashed() -> list:
    """Two hashes that tell equal vectors."""
    return [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]


def _named(numbered: DataFrame) -> DataFrame:
    """row, vec_id, n_links, component_id, kept of numbered(row, vec_id, embedding)."""
    rows = written(numbered.select("row", F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "rows")
    vectors = usable(rows, "row")
    equal = vectors.groupBy(*_hashed()).agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = written(equal.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "least", "copies", "v"), "classes")
    dimensions, total = width(classes), classes.count()
    hashes = max(1, math.ceil(math.log(max(2, total / BUCKET_ROWS)) / math.log(2 * max(2, 1 << (dimensions - 1).bit_length()))))
    signed = written(classes.select("rep", "copies", "v").mapInArrow(_signed(dimensions, hashes), "rep long, copies long, v array<double>, own array<long>, visited array<long>, s1 long, s2 long"), "signatures")
    at_home = signed.select("rep", "s1", "s2", F.posexplode("own").alias("t", "bucket"), F.lit(True).alias("home"))
    visits = signed.select("rep", "s1", "s2", F.posexplode("visited").alias("p", "bucket")).select("rep", "s1", "s2", F.expr(f"cast(p div {VISITS} as int)").alias("t"), "bucket", F.lit(False).alias("home")).where("bucket >= 0")
    places = written(at_home.unionByName(visits), "places")
    crowded = written(places.groupBy("t", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED), "crowded")
    # a crowded bucket's members are looked up in SPREAD tasks, and go on as they are
    spread = F.expr(f"cast(pmod(xxhash64(rep), {SPREAD}) as int)")
    told = crowded.select("t", "bucket", "n", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
    looked = written(places.withColumn("spread", spread).join(told, ["t", "bucket", "spread"], "left").drop("spread"), "looked")
    few, many = looked.where("n is null").drop("n"), looked.where("n is not null")
    # of the others only who meets someone with a like sketch goes on: a semi join, which stops at the first such
    alike = F.expr(f"l.rep != r.rep and (l.home or r.home) and bit_count(l.s1 ^ r.s1) + bit_count(l.s2 ^ r.s2) <= {SKETCH_BITS}")
    met_one = few.alias("l").join(few.alias("r"), (F.col("l.t") == F.col("r.t")) & (F.col("l.bucket") == F.col("r.bucket")) & alike, "left_semi")
    alone = met_one.select("t", "bucket", "rep", "home", F.lit(1).alias("nb"))
    held = written(alone.unionByName(many.select("t", "bucket", "rep", "home", F.expr(f"cast(ceil(n / {BLOCK}.0) as int)").alias("nb"))), "kept")
    calls = max(LEAST_CALLS, -(-(held.agg(F.sum(F.col("nb").cast("long"))).first()[0] or 0) // CALL_ROWS))
    dealt = held.withColumn("b", F.expr("cast(pmod(xxhash64(rep), nb) as int)")).select("t", "bucket", "rep", "home", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")).select(
        "t", "bucket", "rep", "home", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side")
    )
    met = dealt.join(signed.drop("s1", "s2"), "rep").withColumn("call", F.expr(f"pmod(xxhash64(t, bucket, i, j), {calls})")).groupBy("call").applyInPandas(_verified(dimensions), "rep long, links long, root long")
    met = written(met, "links")
    counts = met.groupBy("rep").agg(F.sum("links").alias("others"))
    named = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    # classes come with numbers of their own; a component's name is the smallest id in it
    of_class = written(classes.select("rep", "h1", "h2", "least", "copies").join(counts, "rep", "left").join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "of class")
    met, _ = joined(of_class, of_class.groupBy("component").agg(F.min("least").alias("name")), "component")
    told = met.select("h1", "h2", F.col("name").alias("component"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    of_row = vectors.select("row", *_hashed()).join(told, ["h1", "h2"]).select("row", "component", "n_links")
    return rows.select("row", "vec_id").join(of_row, "row", "left").select(
        "row", "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def deduplicated(table: DataFrame) -> DataFrame:
    """table without the rows that are not kept; rows without an id stay. Columns stay as they are, whatever their names."""
    held = written(table.select(F.monotonically_increasing_id().alias("row"), F.struct(*(table[f"`{c}`"] for c in table.columns)).alias("held")), "table")
    named = _named(held.select("row", F.col("held").getField("vec_id").alias("vec_id"), F.col("held").getField("embedding").alias("embedding")))
    return held.join(named.where("vec_id is not null and not kept").select("row"), "row", "left_anti").select("held.*")
