"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in two bits or fewer agree on one of their two 32-bit segments but for one
bit at most. Each distinct fingerprint is therefore indexed under its 64 one-wildcard variants (segment, wildcard
position, remaining bits); pairs that share a variant are verified with a bit count. Exact copies share one
fingerprint and never meet as pairs; variants that hold many fingerprints are verified block by block in numpy
and give a spanning forest, not all pairs.

Fingerprints, not ids, are linked: texts that share an id stay apart, and those without one still link others. Ids
come in at the end, as the names of components.

Nulls and edges: a null text counts as empty (fingerprint 0, linked like any other). A null doc_id keeps its row,
is never a component's name unless no other id is in it. Repeated rows keep their rows in near_duplicates; deduplicated
keeps one row of each component, repeats and rows without an id included. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import components, joined, written

#: Seed of the shingle hash; words per shingle; bits that two linked fingerprints may differ in.
SEED, WORDS, MAX_BITS = 42, 3, 2
#: Members of one variant up to which pairs are joined as rows; above, up to BLOCK members are compared in numpy at once.
PAIR_JOIN, BLOCK = 32, 1024
#: Fingerprints looked at for crowded variants about, and how many of them make one. This decides where a variant's members are compared, not whether.
LOOKED_AT, CROWDED = 20_000, 64
#: Rows from which a fingerprint's are looked up in several tasks, and the number of these.
COPIES, SPREAD = 512, 32


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit SimHash of a text: majority bit over all shingles, ties and no shingles give 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    shingles = (b" ".join(s) for s in zip(*(tokens[i:] for i in range(words)), strict=False)) if len(tokens) >= words else iter([b" ".join(tokens)])
    ones, total = np.zeros(64, dtype=np.int64), 0
    while block := list(islice(shingles, 32768)):
        bits = np.unpackbits(np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in block]), dtype=np.uint8))
        ones += bits.reshape(len(block), 64).sum(axis=0, dtype=np.int64)
        total += len(block)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])


def text_hash() -> Column:
    """Tells the texts that share an id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): fp holds the fingerprint's bits as a signed long."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


def _close(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning links within one block, or between two blocks, of a variant's members."""
    a = pdf[pdf["side"] == 0]
    b = pdf[pdf["side"] == 1] if (pdf["side"] == 1).any() else a
    x, y = a["fp"].to_numpy().view(np.uint64), b["fp"].to_numpy().view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ y[None, :]) <= MAX_BITS
    # every member with a link goes to the first member it links with, and that one's rows on: min-label rounds
    rows, cols = np.arange(len(x)), np.arange(len(y)) + (0 if b is a else len(x))
    label = np.concatenate([rows, cols]) if b is not a else rows.copy()
    while True:
        before = label.copy()
        lx, ly = (label, label) if b is a else (label[: len(x)], label[len(x):])
        best_x = np.where(near, ly[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        lx = np.minimum(lx, best_x)
        if b is a:
            label = lx
        else:
            best_y = np.where(near, lx[:, None], np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max)
            label = np.concatenate([lx, np.minimum(ly, best_y)])
        label = label[label]
        if (label == before).all():
            break
    ids = a["rep"].to_numpy() if b is a else np.concatenate([a["rep"].to_numpy(), b["rep"].to_numpy()])
    moved = label != np.arange(len(label))
    return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between the reps of distinct(rep, fp) that connect all fingerprints within MAX_BITS of each other."""
    variants = distinct.select("rep", "fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")).select(
        "rep", "fp",
        # the segment without the wildcard bit, under the number of segment and wildcard
        F.expr("shiftleft(cast(p as bigint), 32) | (shiftrightunsigned(fp, 32 * (p div 32)) & 4294967295L & ~shiftleft(1L, cast(p % 32 as int)))").alias("key"),
    )
    # variants that so many fingerprints share that they would be one task's work: at most LOOKED_AT * 64 / CROWDED keys, known from a few fingerprints
    every = max(1, distinct.count() // LOOKED_AT)
    crowded = written(variants.where(f"pmod(xxhash64(fp), {every}) = 0").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= CROWDED).select("key"), "crowded")
    counted = F.broadcast(variants.join(F.broadcast(crowded), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")))
    # of the others one shuffle serves both the counts and the members: only variants that several fingerprints share go on
    dealt = variants.join(F.broadcast(crowded), "key", "left_anti").repartition("key")
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    few = dealt.join(sizes, "key").select("key", "n", "rep", "fp")
    held = written(few.unionByName(variants.join(counted, "key").select("key", "n", "rep", "fp")), "members")
    pairs = held.where("n = 2").groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.bit_xor("fp").alias("x")).where(f"bit_count(x) <= {MAX_BITS}").select("a", "b")
    more = held.where("n > 2")
    # a variant of more than a block is split by what its members' other segment holds in each third: of at most two
    # bits that differ one third at least has none, so every link is within a part, and members are copied three times
    whole = more.where(f"n <= {BLOCK}").selectExpr("key", "-1 as third", "0L as part", "n", "rep", "fp")
    other = "shiftrightunsigned(fp, 32 - 32 * cast(shiftright(key, 32) div 32 as int)) & 4294967295L"
    thirds = more.where(f"n > {BLOCK}").select("key", "rep", "fp", F.explode(F.array(*map(F.lit, range(3)))).alias("third"), F.expr(other).alias("other"))
    thirds = thirds.selectExpr("key", "third", "shiftright(other, 11 * third) & 2047 as part", "rep", "fp")
    by = ["key", "third", "part"]
    split, _ = joined(thirds, thirds.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), by)
    places = whole.unionByName(written(split, "parts"))
    few = places.where(f"n <= {PAIR_JOIN}").select(*by, "rep", "fp")
    met = (
        few.alias("l").join(few.alias("r"), by)
        .where(f"l.rep < r.rep and bit_count(l.fp ^ r.fp) <= {MAX_BITS}").select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"))
    )
    # many members: blocks of about BLOCK, each pair of blocks a group of its own
    many = places.where(f"n > {PAIR_JOIN}").withColumn("nb", F.expr(f"cast(ceil(n / {BLOCK}.0) as int)")).withColumn("i", F.expr("cast(pmod(xxhash64(fp), nb) as int)"))
    blocked = many.select(*by, "rep", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j")).select(
        *by, "rep", "fp", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(F.col("i") <= F.col("j"), 0).otherwise(1).alias("side")
    )
    blocks = blocked.groupBy(*by, "i", "j").applyInPandas(_close, "a long, b long")
    return pairs.unionByName(met).unionByName(blocks).distinct()


def _components(found: DataFrame) -> DataFrame:
    """(fp, n, first, root, component_id) of the distinct fingerprints of found(doc_id, text_hash, fp), written.

    n: rows; first: the smallest of (doc_id is null, doc_id, text_hash); root tells components apart; component_id is the smallest doc_id whose fingerprint is reachable.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    distinct = written(found.groupBy("fp").agg(F.count("*").alias("n"), F.min(first).alias("first")), "distinct")
    linked = written(components(links(distinct.select(F.col("fp").alias("rep"), "fp"))).join(distinct, F.col("node") == F.col("fp")).select("fp", "component", F.col("first.doc_id").alias("least")), "linked")
    met, _ = joined(linked, linked.groupBy("component").agg(F.min("least").alias("name")), "component")
    named = met.select("fp", "component", "name")
    return written(distinct.join(named, "fp", "left").select("fp", "n", "first", F.coalesce("component", "fp").alias("root"), F.coalesce("name", "first.doc_id").alias("component_id")), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    found = written(fingerprints(docs), "fingerprints")
    of = _components(found).select("fp", "n", "component_id")
    # the rows of a fingerprint that many copies share are looked up in SPREAD tasks
    spread = F.expr(f"cast(pmod(xxhash64(doc_id, text_hash), {SPREAD}) as int)")
    shared = of.where(F.col("n") > COPIES).select("fp", F.struct("component_id").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
    looked = written(found.withColumn("spread", spread).join(shared, ["fp", "spread"], "left").select("doc_id", "fp", "of"), "looked")
    others = looked.where("of is null").join(of.where(F.col("n") <= COPIES), "fp").select("doc_id", "fp", "component_id")
    rows = looked.where("of is not null").select("doc_id", "fp", "of.component_id").unionByName(others)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: that with the smallest doc_id, a null one last, then of its texts the first by hash.

    Of rows that agree in doc_id and text one stays, whichever. Columns stay as they are, whatever their names.
    """
    found = written(fingerprints(docs), "fingerprints")
    kept = _components(found).groupBy("root").agg(F.min("first").alias("k")).select("k.doc_id", "k.text_hash")
    # how often a kept row comes: its repeats are counted before anything is joined
    times = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    rows = written(kept.alias("k").join(times.alias("t"), F.col("k.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("k.text_hash") == F.col("t.text_hash")), "left").select("k.*", F.col("n").isNotNull().alias("repeated")), "kept")
    once, more = rows.where("not repeated"), rows.where("repeated")
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("own_id"), text_hash().alias("own_hash"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))
    # repeats are few keys, maybe of many rows: each task brings one row of each
    single = packed.join(more, same, "left_semi").groupBy("own_id", "own_hash").agg(F.first("doc").alias("doc")).select("doc")
    return packed.join(once, same, "left_semi").select("doc").unionByName(single).select("doc.*")
