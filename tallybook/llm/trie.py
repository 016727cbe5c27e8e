"""Prefix trie of conversations, rolled up by centroid decomposition.

Every conversation c is rebuilt: the first h turns of conversation c - c % 100, then c's own turns after its first h,
where h = crc32(c in decimal) % 6. Each distinct sequence of first turns is a node, known by sums over its turns'
digests: a turn's digest contains its place, so that sums of running turns tell prefixes apart and long conversations
are summed slice by slice. A node's smallest member and its depth find its ancestors among that member's steps.

Totals over subtrees go up by centroid decomposition of the parent edges. In each round every component larger than
LOCAL nodes is split at its centroid, the deepest node with half of the component in its subtree; the subtree's total is
given to the centroid and to all nodes on its path to the component's top, and the parts (what hangs below each child,
and what is left above) are the next components. They at least halve, so rounds are few; components of at most LOCAL
nodes are finished in the same way, each inside a task. Sizes of subtrees, which centroids are found by, follow from the
memberships: a member brings the nodes that it is the smallest member of.

Nulls and edges: rows with a null conv_id take no part; null roles and texts are empty. Rows of a conversation with
equal turns (null first) come in the order of the SHA-256 of role and text. An empty table gives no rows. A modulo of a
negative id is negative, as in SQL. Long texts are digested where they are read; only digests and lengths are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.llm.common import dropped, numbered, written

#: Borrowed turns are h = crc32 % BORROWED many, of the first conversation of each FAMILY.
BORROWED, FAMILY = 6, 100
#: Nodes of a component that a task finishes at most; slots over which a component's rows are dealt.
LOCAL, SLOTS = 4096, 64
#: Turns of a conversation summed in one slice, and members of a node joined in one string (by range of ids).
SLICE, IDS = 1024, 65_536
#: Children above which a node is looked up by SLOTS tasks.
CROWDED = 1024
LANES = [f"l{i}" for i in range(5)]
STATE = ["key", "parent", "conv_id", "depth", "comp", "size", "leaf", "save", "n_leaves", "saved_tokens"]


def _key(depth: Column, lanes: list[Column]) -> Column:
    """16 bytes that name the node of a prefix."""
    return F.substring(F.unhex(F.sha2(F.concat_ws(",", depth.cast("string"), *(x.cast("string") for x in lanes)), 256)), 1, 16)


def _root() -> Column:
    zero = F.lit(0).cast("long")
    return _key(zero, [zero] * len(LANES))


def steps(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, parent, len, ends) of all rebuilt turns, written: pos from 1, and 0 for the root; ends: the conversation's last step."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("e"), F.length(text).cast("long").alias("len"))
    turns = written(numbered(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("e")]).select("conv_id", "nth", "e", "len"), "turns")
    own = turns.groupBy("conv_id").agg((F.max("nth") + 1).alias("n"))
    facts = own.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % BORROWED).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    facts = facts.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    heads = written(facts.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("last")), "heads")
    first = turns.where(F.col("nth") < BORROWED - 1).select(F.col("conv_id").alias("base"), "nth", "e", "len")
    taken = heads.join(first, "base").where("nth < k").select("conv_id", (F.col("nth") + 1).alias("pos"), "e", "len", "last")
    kept = turns.join(heads, "conv_id").where("nth >= h").select("conv_id", (F.col("k") + F.col("nth") - F.col("h") + 1).alias("pos"), "e", "len", "last")
    placed = taken.unionByName(kept).withColumn("x", F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.hex("e")), 256))
    lanes = [F.conv(F.substring("x", 8 * i + 1, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(LANES)]
    summed = written(placed.select("conv_id", "pos", "len", (F.col("pos") == F.col("last")).alias("ends"), F.expr(f"(pos - 1) div {SLICE}").alias("slice"), *lanes), "digests")
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = summed.groupBy("conv_id", "slice").agg(*(F.sum(c).alias(c) for c in LANES)).select("conv_id", "slice", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"s_{c}") for c in LANES))
    within = Window.partitionBy("conv_id", "slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = summed.join(starts, ["conv_id", "slice"]).select("conv_id", "pos", "len", "ends", *LANES, *((F.col(f"s_{c}") + F.sum(c).over(within)).alias(f"r_{c}") for c in LANES))
    here, above = [F.col(f"r_{c}") for c in LANES], [F.col(f"r_{c}") - F.col(c) for c in LANES]
    below = running.select("conv_id", "pos", _key(F.col("pos"), here).alias("key"), _key(F.col("pos") - 1, above).alias("parent"), "len", "ends")
    zero = F.lit(0).cast("long")
    root = heads.select("conv_id", zero.alias("pos"), _root().alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("len"), (F.col("last") == 0).alias("ends"))
    return written(below.unionByName(root), "steps")


def nodes(path: DataFrame) -> DataFrame:
    """(key, parent, conv_id, depth, n_convs, n_children, size, save) of the trie of steps, written. size: nodes in the subtree; save: the node's own saved tokens."""
    found = written(path.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("pos").alias("depth"), F.max("len").alias("len"), F.count("*").alias("n_convs")), "nodes")
    owned = written(found.groupBy("conv_id").agg(F.count("*").alias("c"), F.min("depth").alias("from")), "owned")
    # a member's own nodes lie in the subtree, but for those of the smallest member that lie above
    sizes = path.join(owned, "conv_id").groupBy("key").agg(F.sum("c").alias("brought"))
    named = found.join(path.select("conv_id", F.col("pos").alias("depth"), "parent"), ["conv_id", "depth"]).join(owned, "conv_id").join(sizes, "key")
    size = F.col("brought") - (F.col("depth") - F.col("from"))
    named = written(named.select("key", "parent", "conv_id", "depth", "n_convs", size.alias("size"), ((F.col("n_convs") - 1) * F.col("len")).alias("save")), "named")
    children = written(named.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")), "children")
    return written(named.join(children, "key", "left").fillna(0, ["n_children"]), "trie")


def _slotted(df: DataFrame, by: str) -> DataFrame:
    """df with a slot, the same for the same value of a column."""
    return df.withColumn("slot", F.expr(f"pmod(xxhash64({by}), {SLOTS})"))


def _in_all_slots(df: DataFrame) -> DataFrame:
    return df.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long"))))


def rolled_up(trie: DataFrame, path: DataFrame, local: int = LOCAL) -> DataFrame:
    """(key, n_leaves, saved_tokens) of every node of trie(key, parent, conv_id, depth, size, n_children, save): sums over its subtree."""
    zero = F.lit(0).cast("long")
    now = trie.select("key", "parent", "conv_id", "depth", _root().alias("comp"), "size", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), "save", zero.alias("n_leaves"), zero.alias("saved_tokens"))
    where = path.select("conv_id", "pos", F.col("key").alias("at"), F.col("parent").alias("under"))
    now, done, small = written(now, "state"), [], []
    while True:
        # components that are split in this round: at most one for every `local` nodes
        large = written(now.groupBy("comp").agg(F.count("*").alias("total"), F.min("depth").alias("top")).where(F.col("total") > local), "large")
        if large.isEmpty():
            small.append(now)
            break
        tagged = written(_slotted(now, "key").join(_in_all_slots(large), ["comp", "slot"], "left").drop("slot"), "tagged")
        dropped(now)
        small.append(tagged.where("total is null").select(STATE))
        rows = tagged.where("total is not null")
        best = rows.where("2 * size >= total").groupBy("comp").agg(F.max_by(F.struct("key", "conv_id", "size", "depth", "top"), "depth").alias("c"))
        cents = written(best.select("comp", F.col("c.key").alias("c_key"), F.col("c.conv_id").alias("c_conv"), F.col("c.size").alias("c_size"), F.col("c.depth").alias("c_depth"), F.col("c.top").alias("c_top")), "centroids")
        faced = written(_slotted(rows, "key").join(_in_all_slots(cents.select("comp", "c_key", "c_depth", "c_size")), ["comp", "slot"]).drop("slot"), "faced")
        # what lies deeper is below the centroid if its smallest member's steps pass it, and then belongs to the child that comes next
        deeper = faced.where("depth > c_depth").alias("u").join(where.alias("w"), (F.col("u.conv_id") == F.col("w.conv_id")) & (F.col("u.c_depth") + 1 == F.col("w.pos"))).select("u.*", F.when(F.col("under") == F.col("c_key"), F.col("at")).alias("child"))
        level = faced.where("depth <= c_depth").withColumn("child", F.when(F.col("key") == F.col("c_key"), F.col("key")))
        parted = written(deeper.unionByName(level), "parted")
        totals = written(parted.where("child is not null").groupBy("comp").agg(F.sum("leaf").alias("t_leaves"), F.sum("save").alias("t_saved")).join(cents, "comp"), "totals")
        # the path from the centroid to its component's top, by the steps of the centroid's smallest member
        climbed = totals.where("c_depth > c_top").select("c_conv", "c_size", "t_leaves", "t_saved", F.explode(F.sequence(F.col("c_top"), F.col("c_depth") - 1)).alias("pos"))
        onto = climbed.join(where, (F.col("c_conv") == F.col("conv_id")) & (climbed["pos"] == where["pos"])).select(F.col("at").alias("key"), "c_size", "t_leaves", "t_saved")
        upper = parted.where("child is null").select(STATE).join(onto, "key", "left").select(
            "key", "parent", "conv_id", "depth", "comp", (F.col("size") - F.coalesce("c_size", zero)).alias("size"), "leaf", "save",
            (F.col("n_leaves") + F.coalesce("t_leaves", zero)).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("t_saved", zero)).alias("saved_tokens"),
        )
        lower = parted.where("child is not null and key != c_key").withColumn("comp", F.col("child")).select(STATE)
        done.append(parted.where("key = c_key").join(totals.select("comp", "t_leaves", "t_saved"), "comp").select("key", (F.col("n_leaves") + F.col("t_leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("t_saved")).alias("saved_tokens")))
        now = written(upper.unionByName(lower), "state")
        dropped(faced)
    rest = reduce(DataFrame.unionByName, small).repartition("comp").sortWithinPartitions("comp", "depth")
    finished = rest.select("comp", "key", "parent", "leaf", "save", "n_leaves", "saved_tokens").mapInArrow(_finished, "key binary, n_leaves long, saved_tokens long")
    return reduce(DataFrame.unionByName, done, finished)


def decomposed(parents: list[int], values: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sums of values over subtrees, by centroid decomposition. parents: each node's parent, a node before it; -1 for the top."""
    sums = [[0, 0] for _ in parents]
    parts = [list(range(len(parents)))]
    while parts:
        part = parts.pop()
        size = dict.fromkeys(part, 1)
        for v in reversed(part[1:]):
            size[parents[v]] += size[v]
        centre = next(v for v in reversed(part) if 2 * size[v] >= len(part))  # the deepest comes last
        child, below, total = {}, {}, [0, 0]
        for v in part:  # parents come before their children
            if v == centre:
                child[v] = v
            elif v != part[0] and parents[v] in child:
                child[v] = v if parents[v] == centre else child[parents[v]]
                below.setdefault(child[v], []).append(v)
            else:
                continue
            total[0] += values[v][0]
            total[1] += values[v][1]
        v = centre
        while True:
            sums[v][0] += total[0]
            sums[v][1] += total[1]
            if v == part[0]:
                break
            v = parents[v]
        parts += below.values()
        if centre != part[0]:
            parts.append([v for v in part if v not in child])
    return [tuple(s) for s in sums]


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of components that come whole, by depth; a task holds one at a time beside its batch."""
    held: list[tuple] = []

    def out(rows: list[tuple]) -> list[tuple]:
        place = {r[1]: i for i, r in enumerate(rows)}
        sums = decomposed([-1, *(place[r[2]] for r in rows[1:])], [r[3:5] for r in rows])
        return [(r[1], r[5] + s[0], r[6] + s[1]) for r, s in zip(rows, sums, strict=True)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        key, leaves, saved = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], names=["key", "n_leaves", "saved_tokens"])

    for batch in batches:
        ready = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                ready += out(held)
                held = []
            held.append(row)
        yield batch_of(ready)
    if held:
        yield batch_of(out(held))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's strings, comma-joined, as they pass in order; a task holds one digest."""
    last, digest = None, None
    for batch in batches:
        keys, values = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != last:
                if last is not None:
                    keys.append(last)
                    values.append(digest.hexdigest())
                last, digest = key, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.string())], names=["key", "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def ends(path: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes that conversations end at; ids are joined range by range, so that a node of many members is many tasks' work until its digest."""
    ranges = path.where("ends").groupBy("key", F.expr(f"conv_id div {IDS}").alias("nth")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return ranges.repartition("key").sortWithinPartitions("key", "nth").select("key", "ids").mapInArrow(_digests, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    path = steps(conversations)
    trie = nodes(path)
    sums = rolled_up(trie, path, local)
    # parents of many children are looked up by several tasks
    known = trie.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    crowded = _in_all_slots(known.where(f"n_children > {CROWDED}").select("parent", F.struct("parent_conv_id").alias("of")))
    looked = written(_slotted(trie, "key").join(crowded, ["parent", "slot"], "left").drop("slot"), "looked")
    others = looked.where("of is null and parent is not null").join(known.where(f"n_children <= {CROWDED}").drop("n_children"), "parent")
    found = looked.where("of is not null or parent is null").withColumn("parent_conv_id", F.col("of.parent_conv_id")).unionByName(others)
    out = found.join(sums, "key").join(ends(path), "key", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
