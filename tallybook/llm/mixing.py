"""Mixing sources to target weights: entropy balancing of document rates, rounded into copies.

A source's documents get the rates nearest to one copy each, by relative entropy, whose words make up its target and
none of which is above MOST copies. Such rates are exp(tilt * size), cut at MOST, with one tilt a source: the root of
the gradient of a convex dual, which Newton steps find for all sources at once. Since a rate depends on source and size
alone, each step is one aggregation over counts by source and size; bisection takes over where a step leaves its bracket.

Rates become whole copies from the longest texts down, so that at no length more than half a copy is owed; what words
are then still missing or too many is made up by a few copies more or less, a source and size at a time.

Targets: sources in order of code points, null last, weigh WEIGHTS in turn and share all words; a source above MOST
times its own words gives the excess to the others, by weight, until none is above.

Nulls and edges: a null text has no words; documents without words weigh nothing and take nothing. Null doc_ids and
repeated rows are rows like others: each is given copies of its own. Without any words all targets are zero. An empty
table gives no rows. All sums are of whole numbers, so that reruns give the same copies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.llm.common import dropped, numbered, written

#: Weights of sources in turn, and copies of a document at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Newton steps at most, and how near (as a logarithm) the words at the rates come to a target.
STEPS, NEAR = 60, 1e-9
#: Rounds that make up for missing words at most, and the share of a target that may stay missing.
ROUNDS, OWED = 12, 1e-5
#: Parts of one in which rates and words are summed as whole numbers.
PARTS = 1 << 20
#: Slices of the documents of one source and size at least, documents a slice, and rows that one task repeats at once.
LEAST_SLICES, SLICE_ROWS, BLOCK = 1024, 20_000, 4096
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, src, size, m): how many rows of docs have this id, source and size. src: '=' and the source, '' for null."""
    src = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), src.alias("src"), size.alias("size")).groupBy("doc_id", "src", "size").agg(F.count("*").alias("m"))


def _total(value: Column) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(F.round(value * PARTS).cast("decimal(38,0)")).cast("double") / PARTS


def targets(groups: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(src, source_size, target, scale, least) of groups(src, size, n): words a source has and is to give; its mean size by words, and its smallest size above 0."""
    words = F.col("n") * F.col("size")
    sums = groups.groupBy("src").agg(F.sum(words).alias("source_size"), _total(words.cast("double") * F.col("size") / PARTS).alias("squares"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    sources = written(numbered(sums.withColumn("none", F.col("src") == ""), [], [F.col("none"), F.col("src")]).withColumn("weight", weight.cast("double")), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while total:  # each round fixes more sources at their limit
        above = F.col("weight") * level > most * F.col("source_size")
        n, full, free = sources.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, most * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        level, capped = (total - full) / free, n
    return sources.select("src", "source_size", F.least(F.col("weight") * level, (most * F.col("source_size")).cast("double")).alias("target"), (F.col("squares") * PARTS / F.col("source_size")).alias("scale"), "least")


def rate(tilt: Column, size: Column, scale: Column, most: int = MOST) -> Column:
    """Copies of a document of this size before rounding."""
    return F.exp(F.least(tilt * size / scale, F.log(F.lit(float(most)))))


def balanced(groups: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """(src, source_size, target, scale, tilt): tilts at which the words of groups(src, size, n) come to targets; null where all documents have `most` copies.

    Newton steps on the logarithm of a source's words at its rates, inside a bracket that holds the root.
    """
    share = F.col("target") / F.col("source_size")
    facts = ["src", "source_size", "target", "scale"]
    # at the share's logarithm, sizes being about their mean, words come out right; rates of the smallest size bound the root on both sides
    start = wanted.where((F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - NEAR))).select(
        *facts, F.log(share).alias("tilt"),
        F.when(share < 1, F.log(share) * F.col("scale") / F.col("least")).otherwise(0.0).alias("lo"),
        F.when(share < 1, 0.0).otherwise(F.log(F.lit(float(most))) * F.col("scale") / F.col("least")).alias("hi"),
    )
    now, sized_groups = written(start, "tilts"), groups.where("size > 0")
    for _ in range(STEPS):
        r = rate(F.col("tilt"), F.col("size"), F.col("scale"), most)
        words = F.col("n") * F.col("size") * r
        moving = F.when(F.col("tilt") * F.col("size") / F.col("scale") < F.log(F.lit(float(most))), words * F.col("size") / F.col("scale")).otherwise(0.0)
        sums = sized_groups.join(now.select("src", "tilt", "scale"), "src").groupBy("src").agg(_total(words).alias("g"), _total(moving).alias("h"))
        off = F.log(F.col("target") / F.col("g"))
        lo, hi = F.when(off > 0, F.col("tilt")).otherwise(F.col("lo")), F.when(off > 0, F.col("hi")).otherwise(F.col("tilt"))
        step = F.col("tilt") + off * F.col("g") / F.nullif(F.col("h"), F.lit(0.0))
        new = F.when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        moved = now.join(sums, "src").select(*facts, F.when(F.abs(off) < NEAR, F.col("tilt")).otherwise(new).alias("tilt"), lo.alias("lo"), hi.alias("hi"), F.abs(off).alias("off"))
        before, now = now, written(moved, "tilts")
        far = now.agg(F.max("off")).first()[0] or 0.0
        dropped(before)
        if far < NEAR:
            break
    return wanted.select(*facts).join(now.select("src", "tilt"), "src", "left")


def copies(groups: DataFrame, tilts: DataFrame, most: int = MOST) -> DataFrame:
    """(src, size, n, source_size, target, k): whole copies k that the n documents of a source and size get together; written."""
    r = F.when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), float(most)).otherwise(rate(F.col("tilt"), F.col("size"), F.col("scale"), most))
    rated = groups.join(tilts, "src").withColumn("owed", F.round(F.col("n") * r * PARTS).cast("long")).withColumn("band", F.floor(8 * F.log2(F.col("size").cast("double"))))
    rated = written(rated.select("src", "size", "n", "source_size", "target", "owed", F.coalesce("band", F.lit(-1)).alias("band")), "rated")
    # running sums from the longest down: within bands of sizes, each from where those above end
    above = Window.partitionBy("src").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = rated.groupBy("src", "band").agg(F.sum("owed").alias("c")).select("src", "band", F.coalesce(F.sum("c").over(above), F.lit(0)).alias("start"))
    down = Window.partitionBy("src", "band").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    until = F.col("start") + F.sum("owed").over(down)
    summed = rated.join(bands, ["src", "band"]).withColumn("until", until)
    whole = F.expr(f"(until + {PARTS // 2}) div {PARTS} - (until - owed + {PARTS // 2}) div {PARTS}")
    held = written(summed.select("src", "size", "n", "source_size", "target", whole.alias("k")), "copies")
    made: list[DataFrame] = []
    for _ in range(ROUNDS):
        now = _adjusted(held, made)
        off = now.groupBy("src").agg((F.max("target") - F.sum(F.col("k") * F.col("size"))).alias("off"))
        room = F.when(F.col("off") > 0, most * F.col("n") - F.col("k")).otherwise(F.col("k"))
        able = now.join(off, "src").where((F.abs("off") > OWED * F.col("target")) & (F.col("size") > 0)).withColumn("room", room).where("room > 0")
        # the one change of a source and size that leaves least owed, of equally good ones that with the fewest copies
        more = F.least(F.greatest(F.round(F.abs("off") / F.col("size")).cast("long"), F.lit(1)), F.col("room"))
        moves = able.withColumn("more", more).withColumn("still", F.abs(F.abs("off") - F.col("more") * F.col("size"))).where(F.col("still") < F.abs("off"))
        best = moves.groupBy("src").agg(F.min_by(F.struct("size", "more", "off"), F.struct("still", "more", "size")).alias("b")).select("src", "b.*")
        fix = written(best.select("src", "size", F.when(F.col("off") > 0, F.col("more")).otherwise(-F.col("more")).alias("d")), "made-up")
        if fix.isEmpty():
            break
        made.append(fix)
    return _adjusted(held, made)


def _adjusted(held: DataFrame, made: list[DataFrame]) -> DataFrame:
    """held with the copies of all rounds; a round has one row a source."""
    if not made:
        return held
    by = reduce(DataFrame.unionByName, made).groupBy("src", "size").agg(F.sum("d").alias("d"))
    return held.join(by, ["src", "size"], "left").select("src", "size", "n", "source_size", "target", (F.col("k") + F.coalesce("d", F.lit(0))).alias("k"))


def _repeated(df: DataFrame, keep: list[str]) -> DataFrame:
    """Each row of df as often as its column `times` says; a row of very many repeats is dealt to many tasks."""
    few = df.where(f"times <= {BLOCK}").select(*keep, F.expr("explode(sequence(1L, times))").alias("_")).drop("_")
    blocks = df.where(f"times > {BLOCK}").select(*keep, "times", F.expr(f"explode(sequence(0L, (times - 1) div {BLOCK}))").alias("b")).repartition("doc_id", "b")
    many = blocks.select(*keep, F.expr(f"explode(sequence(1L, least({BLOCK}L, times - b * {BLOCK})))").alias("_")).drop("_")
    return few.unionByName(many)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target (of its source), taken (words the mix takes of it), copies."""
    rows = written(sized(docs), "sized")
    groups = written(rows.groupBy("src", "size").agg(F.sum("m").alias("n")), "sizes")
    given = copies(groups, balanced(groups, targets(groups, weights, most), most), most)
    slices = max(LEAST_SLICES, -(-(groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // SLICE_ROWS))
    by = ["src", "size", "slice"]
    sliced = rows.withColumn("slice", F.expr(f"pmod(xxhash64(doc_id), {slices})"))
    # the first k mod n documents, in order of slice and id, get one copy more than the others
    before = Window.partitionBy("src", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy(*by).agg(F.sum("m").alias("c")).select(*by, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start")).join(given, ["src", "size"])
    within = Window.partitionBy(*by).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at = sliced.join(starts, by).withColumn("at", F.col("start") + F.sum("m").over(within) - F.col("m"))
    at = at.withColumn("extra", F.expr("greatest(0L, least(m, k % n - at))"))
    dealt = at.select("doc_id", "size", "source_size", "target", F.explode(F.array(
        F.struct(F.expr("k div n + 1").alias("copies"), F.col("extra").alias("times")), F.struct(F.expr("k div n").alias("copies"), F.expr("m - extra").alias("times")),
    )).alias("d")).select("doc_id", "size", "source_size", "target", "d.*").where("times > 0")
    keep = ["doc_id", "size", "source_size", "target", "copies"]
    return _repeated(written(dealt, "dealt"), keep).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
