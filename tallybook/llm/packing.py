"""Best-fit packing of documents into sequences, large items matched first.

Items are the pieces' lengths, and lengths are small whole numbers, so the packing is planned on the counts per
length alone (at most `capacity` of them, whatever the corpus) and the plan dealt out to pieces by their rank
within their length. Items above a third of the capacity share a sequence with at most one other such item: the
largest takes the largest that fits. Smaller ones go, largest first, to the tightest gap.

Nulls and edges: a null or empty text is the end mark alone. A null doc_id keeps its pieces. Repeated rows are
packed as often as they come. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.llm.bpe import byte_symbols
from tallybook.llm.common import written

#: Tokens in a sequence; the id that ends a document.
CAPACITY, END = 1024, 2
#: Fixed value: how the byte-level vocabulary cuts text (possessive where that changes nothing but speed).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Rows that one (length, shard) group holds about, and the fewest shards.
SHARD_ROWS, LEAST_SHARDS = 20_000, 64


def byte_level(content: str):
    """An encoder of the byte-level vocabulary file's text, special tokens in a text included."""
    import tiktoken

    spec = json.loads(content)
    byte = {c: b for b, c in enumerate(byte_symbols())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, content: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; only the first may be shorter than capacity if there are several."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level(shared.value)
        end = np.array([END], dtype="<u4")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encoder.encode_to_numpy(text.as_py() or "", allowed_special="all").astype("<u4"), end])
                at, n = 0, len(ids) % capacity or capacity
                for piece in range(-(-len(ids) // capacity)):
                    n = n if piece == 0 else capacity
                    rows.append((doc_id, piece, at, n, zlib.crc32(ids[at: at + n].tobytes())))
                    at += n
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Where the items of each length go: (length, first rank, items per sequence, first sequence, offset).

    Sequences of one shape are handled together, so the plan's size depends on the capacity, not on the counts.
    """
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, sequences)]
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(n: int, each: int, first: int, count: int, offset: int) -> None:
        out.append((n, used[n], each, first, offset))
        used[n] += each * count
        left[n] -= each * count

    third = capacity // 3
    for n in sorted((n for n in left if n > third), reverse=True):
        while left[n]:
            mate = next((m for m in range(min(n, capacity - n), third, -1) if left.get(m, 0) >= (2 if m == n else 1)), None)
            if mate is None:
                count, room = left[n], capacity - n
                place(n, 1, sequences, count, 0)
            elif mate == n:
                count, room = left[n] // 2, capacity - 2 * n
                place(n, 2, sequences, count, 0)
            else:
                count, room = min(left[n], left[mate]), capacity - n - mate
                place(n, 1, sequences, count, 0)
                place(mate, 1, sequences, count, n)
            gaps.setdefault(room, []).append((sequences, count))
            sequences += count
    for n in sorted((n for n in left if n <= third), reverse=True):
        while left[n]:
            room = next((g for g in range(n, capacity + 1) if gaps.get(g)), None)
            if room is None:  # open sequences for what is left
                each = capacity // n
                gaps.setdefault(capacity, []).append((sequences, max(1, left[n] // each)))
                sequences += gaps[capacity][-1][1]
                continue
            first, count = gaps[room].pop()
            each = min(room // n, left[n])
            take = min(count, left[n] // each)
            if take < count:
                gaps[room].append((first + take, count - take))
            place(n, each, first, take, capacity - room)
            gaps.setdefault(room - each * n, []).append((first, take))
    return out


def packed(docs: DataFrame, content: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with sequence_id and offset; sequences are filled from 0 without gaps."""
    cut = written(pieces(docs, content, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    total = sum(counts.values())
    placed = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 5)
    shards = max(LEAST_SHARDS, -(-total // SHARD_ROWS))
    sharded = cut.withColumn("shard", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32), {shards})"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = sharded.groupBy("length", "shard").agg(F.count("*").alias("n")).select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sharded.withColumn("nth", F.row_number().over(within)).join(first, ["length", "shard"]).withColumn("rank", F.expr("first + nth - 1"))
    keys = (placed[:, 0] << 44) + placed[:, 1]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = placed[np.searchsorted(keys, (length << 44) + rank, side="right") - 1] if len(length) else placed[:0]
            nth, slot = np.divmod(rank - row[:, 1], row[:, 2]) if len(length) else (rank, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 3] + nth), pa.array(row[:, 4] + slot * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(dealt, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
