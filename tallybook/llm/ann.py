"""Approximate nearest neighbours by a hash-prefix forest.

Each vector's hash in a tree is a long string of sign bits of random projections. A tree is a sorted array of these
strings; a query descends to its longest-prefix match in each and then all trees ascend together to shorter prefixes,
so that the rows sharing these become candidates. Ascending stops once it is unlikely that a row nearer than the
query's k-th candidate has been missed in every tree: near rows share long prefixes, so clustered data stop early.
Vectors without structure ascend to short prefixes; where these would hold over a quarter of the block's rows, the
ascent goes up to the root, and such queries are scored with the whole block in one matrix product.

Hash bits tell angles, and the measure is the inner product: each row gets one more component, sqrt(M^2 - |v|^2) with
its block's largest norm M, and queries 0 there. All rows are then as long as M, so that the angle orders as the inner
product does, whatever the norms. Rows much shorter than M lie near a right angle and are followed to short prefixes.

Rows are dealt at random into blocks of bounded size, each a task with a forest of its own; queries pass through every
block in bounded batches, and the k best of each block are merged. The score is the inner product of the original
vectors in double precision.

Nulls and edges: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id,
take no part. Fewer candidates than k give fewer rows. Vectors of different lengths compare as if filled with zeros.
Repeated ids are separate rows: each is a query with ranks of its own, and may be a neighbour of the others; only a
query's own row is left out. Ties go to the smaller vec_id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.llm.common import written
from tallybook.llm.embeddings import matrix, usable, width

#: Trees, bits in a hash string, and the chance that a near row may be missed.
TREES, BITS, MISS = 32, 48, 0.05
#: Bytes of a block's vectors about, rows of it at most, fewest blocks, and queries handled together.
BLOCK_BYTES, BLOCK_ROWS, LEAST_BLOCKS, TOGETHER = 1 << 25, 32_768, 12, 256
#: Share of a block's rows beyond which a query takes all of them.
ALL_FROM = 0.25
#: Every row whose id is divisible by this is a query.
QUERY_EVERY = 20
#: Prefix lengths that ascending stops at.
LEVELS = [48, 32, 24, 18, 14, 12, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0]


def planes(dimensions: int) -> np.ndarray:
    """The projections of all trees, the same in every task; the last row is for the component that evens the norms."""
    return np.random.default_rng(11).standard_normal((dimensions + 1, TREES * BITS)).astype(np.float32)


def hashes(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """One number per vector and tree whose bits, from the highest of BITS on, are the hash string."""
    bits = (vectors.astype(np.float32) @ directions > 0).reshape(len(vectors), TREES, BITS)
    powers = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    out = np.zeros((len(vectors), TREES), dtype=np.uint64)
    for k in range(BITS):
        out |= bits[:, :, k] * powers[k]
    return out


class Forest:
    """The sorted hash strings of one block's rows."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray):
        self.rows, self.ids, self.vectors, self.directions = rows, ids, vectors, directions
        norms = np.linalg.norm(vectors, axis=1)
        self.longest = norms.max()
        lift = np.sqrt(np.maximum(0.0, 1 - (norms / self.longest) ** 2))
        codes = hashes(np.column_stack([vectors / self.longest, lift]), directions)
        self.order = np.argsort(codes, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.ascontiguousarray(np.take_along_axis(codes, self.order, axis=0).T)
        self.order = np.ascontiguousarray(self.order.T)

    def _best(self, near: np.ndarray, rough: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of the candidates near, whose scores are roughly these; equal vectors score the same to the last bit."""
        keep = self.rows[near] != own
        near, rough = near[keep], rough[keep]
        if len(near) > k:
            least = np.partition(rough, -k)[-k]
            near = near[rough >= least - 1e-9 * (abs(least) + self.longest)]
        scores = (self.vectors[near] * query).sum(axis=1)
        best = np.lexsort((self.ids[near], -scores))[:k]
        return self.ids[near[best]], scores[best]

    def nearest(self, own: np.ndarray, queries: np.ndarray, k: int, share: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place, vec_ids, scores) with the k best candidates of each query; about share of the k nearest of all are expected here."""
        sizes = np.linalg.norm(queries, axis=1)
        codes = hashes(queries / sizes[:, None], self.directions[:-1])
        bounds = np.empty((len(LEVELS), 2, TREES, len(queries)), dtype=np.int32)
        for t in range(TREES):
            for i, level in enumerate(LEVELS):
                free = np.uint64((1 << (BITS - level)) - 1)
                bounds[i, 0, t] = np.searchsorted(self.sorted[t], codes[:, t] & ~free, side="left")
                bounds[i, 1, t] = np.searchsorted(self.sorted[t], codes[:, t] | free, side="right")
        held = (bounds[:, 1] - bounds[:, 0]).sum(axis=1)
        # where a row as near as the last of the share, agreeing on each bit with this chance, is missed in all trees rarely enough
        reach = math.log(1 - MISS ** (1 / TREES))
        whole = []
        for q, query in enumerate(queries):
            i = int(np.argmax(held[:, q] >= share))  # the longest prefixes with enough rows
            while LEVELS[i] and share <= held[i, q] <= ALL_FROM * len(self.ids):
                near = np.unique(np.concatenate([order[a:b] for order, a, b in zip(self.order, *bounds[i, :, :, q].tolist(), strict=True)]))
                scores = self.vectors[near] @ query
                if len(near) > share:  # one may be the query's own row
                    cosine = np.partition(scores, -share)[-share] / (self.longest * sizes[q])
                    agree = 1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi
                    level = reach / math.log(agree) if 0 < agree < 1 else BITS if agree else 0
                    if LEVELS[i] <= level:
                        yield q, *self._best(near, scores, own[q], query, k)
                        break
                    i = max(i + 1, next(j for j, x in enumerate(LEVELS) if x <= level))
                else:
                    i += 1
            else:
                whole.append(q)
        if whole:
            scores = queries[whole] @ self.vectors.T
            every = np.arange(len(self.ids))
            for q, rough in zip(whole, scores, strict=True):
                yield q, *self._best(every, rough, own[q], queries[q], k)


def _search(k: int, dimensions: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, the block's rows before the queries."""
        directions = planes(dimensions)
        block, forest, held = None, None, []
        for batch in batches:
            blocks, asks, at, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            vectors = matrix(batch.column(4), dimensions)
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, forest, held = blocks[a], None, []
                if not asks[a]:
                    held.append((at[a:b], ids[a:b], vectors[a:b]))
                    continue
                if not held:
                    continue
                forest = forest or Forest(*map(np.concatenate, zip(*held, strict=True)), directions)
                for first in range(a, b, TOGETHER):
                    last = min(b, first + TOGETHER)
                    found = list(forest.nearest(at[first:last], vectors[first:last], k, share))
                    asked = np.repeat([first + f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at[asked]), pa.array(ids[asked]), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], names=["query_row", "query_id", "vec_id", "score"]
                    )

    return run


def nearest(table: DataFrame, k: int = 20, query_every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row."""
    # written once, so that a row's number stays the same
    vectors = written(usable(table).withColumn("row", F.monotonically_increasing_id()), "vectors")
    total, dimensions = vectors.count(), width(vectors)
    blocks = max(LEAST_BLOCKS, -(-total // max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dimensions)))))
    # rows are dealt at random: this many of the k nearest lie in one block but for rare cases
    share = min(k, math.ceil(k / blocks + 3 * math.sqrt(k / blocks)))
    home = F.expr(f"cast(pmod(xxhash64(row), {blocks}) as int)")
    rows = vectors.select(home.alias("block"), F.lit(False).alias("asks"), "row", "vec_id", "v")
    asking = vectors.where(F.col("vec_id") % query_every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "row", "vec_id", "v")
    # one block a task: block numbers are partition numbers
    dealt = rows.unionByName(asking).repartitionById(blocks, "block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(_search(k, dimensions, share), "query_row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
