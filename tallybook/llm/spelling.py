"""Spelling variants: words that differ by one code point, found by pairs of trie nodes.

Words are sorted, and the nodes of their trie numbered as they are passed: a word opens a node for each code point
beyond what it shares with the word before, so that one pass over a range of sorted words numbers its nodes. What the
first word of a range shares with the words before it carries their numbers. The same is done with reversed words.
A word split at a place is a pair of whole numbers, its prefix's node and its suffix's node; with the code point at a
place skipped it is such a pair too. Words that replace one code point by another share a skipping pair, and a word
that has one more code point than another has a skipping pair that is the other's plain pair. Pairs are exact, so that
nothing has to be compared, and a pair is shared by at most one word for each letter, beside one that it splits: groups
are bounded. Of equal code points in a row only the first is skipped for the second kind, so that no link counts twice.

Words are maximal runs of WORD in whole texts, A-Z lower-cased; where DELETES divides the crc32 of '<doc_id>:<run>' the
run loses its code point at crc32 % length. Only words of LEAST_LENGTH code points and LEAST_COUNT occurrences count.
A form is the near word of largest count, of ties the first by code points, if its count is TIMES the word's or more.

Nulls and edges: a null text has no words; a null doc_id counts as ''. Words may be of any length: a word of n code
points has n nodes and 2n + 1 pairs, and its text is carried once. Repeated rows count again; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.llm.common import dropped, in_ranges, written

WORD = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Deletions planted in one of so many words, code points and occurrences of a word at least, and how much commoner a form is.
DELETES, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5
#: Numbers of a range of words lie apart by this much; ROOT is the node of nothing.
RANGE, ROOT = 1 << 40, -1


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of all documents' words that count."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD), F.lit(0))).alias("run"))
    lowered = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).withColumn("h", F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run"))))
    at = F.expr("cast(h % length(run) as int)")
    word = F.when(F.col("h") % DELETES == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return lowered.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _shared(a: str, b: str) -> int:
    """How many code points two words share at their start."""
    lo, hi = 0, min(len(a), len(b))
    if hi <= 64:
        while lo < hi and a[lo] == b[lo]:
            lo += 1
        return lo
    while lo < hi:  # long ones by halves
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers, from 0 in each part, of the nodes of each word's prefixes; words come by part and in order."""
    part, before, path, nodes = None, "", [], 0
    for batch in batches:
        paths = []
        for p, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if p != part:
                part, before, path, nodes = p, "", [], 0
            keep = _shared(before, word)
            new = len(word) - keep
            path = [*path[:keep], *range(nodes, nodes + new)]
            nodes, before = nodes + new, word
            paths.append(path)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.int64()))], names=["part", "word", "path"])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part, in order, the numbers of those nodes of its first word that parts before have opened; one row a part comes in, with its first and last word."""
    before, numbers = "", []
    for batch in batches:
        parts, carries = [], []
        for part, first, last, path in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            carry = numbers[: _shared(before, first)]
            before, numbers = last, [carry[x] if x < len(carry) else part * RANGE + x for x in path]
            parts.append(part)
            carries.append(carry)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(carries, pa.list_(pa.int64()))], names=["part", "carry"])


def trie_nodes(spelled: DataFrame) -> DataFrame:
    """(word, nodes) of spelled(word), distinct: the numbers of the trie nodes of its prefixes, from one code point on, as an array of longs."""
    parts = in_ranges(spelled.select("word"), [F.col("word")])
    opened = written(parts.select(F.col("part").cast("long").alias("part"), "word").repartition("part").sortWithinPartitions("part", "word").mapInArrow(_opened, "part long, word string, path array<long>"), "opened")
    # one row a part
    edges = opened.groupBy("part").agg(F.min("word").alias("first"), F.max_by(F.struct("word", "path"), "word").alias("l")).select("part", "first", "l.word", "l.path")
    carried = written(edges.repartition(1).sortWithinPartitions("part").mapInArrow(_carried, "part long, carry array<long>"), "carried")
    # the first word of a part has opened numbers 0, 1, ...: the first of them are carried
    numbers = F.transform("path", lambda x: F.when(x < F.size("carry"), F.get("carry", x.cast("int"))).otherwise(F.col("part") * RANGE + x))
    return opened.join(carried, "part").select("word", numbers.alias("nodes"))


def pairs(numbered: DataFrame) -> DataFrame:
    """(a, b, wid, n, skips, first) for each pair of numbered(wid, word, n, ahead, back): splits at every place, and with the code point at a place skipped (first: it differs from the one before)."""
    size = F.size("ahead")
    prefix = lambda i: F.when(i > 0, F.get("ahead", i - 1)).otherwise(ROOT)
    suffix = lambda i: F.when(i < size, F.get("back", size - i - 1)).otherwise(ROOT)
    letters = F.split("word", "")
    splits = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(prefix(i).alias("a"), suffix(i).alias("b"), F.lit(False).alias("skips"), F.lit(False).alias("first")))
    lettered = numbered.withColumn("letters", letters)
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(prefix(i).alias("a"), suffix(i + 1).alias("b"), F.lit(True).alias("skips"), ((i == 0) | (F.get("letters", i) != F.get("letters", F.greatest(i - 1, F.lit(0))))).alias("first")))
    return lettered.select("wid", "n", F.explode(F.concat(splits, skips)).alias("p")).select("p.*", "wid", "n")


def near(paired: DataFrame) -> DataFrame:
    """(wid, n_near, best) of the words of pairs that have near words; best: (n, -wid) of the near word of largest count, of ties the first."""
    key = Window.partitionBy("a", "b")
    rank = F.struct("n", (-F.col("wid")).alias("back"))
    of = lambda which: F.when(which, rank)
    shared = paired.select(
        "*", F.count("*").over(key).alias("all"), F.count_if("skips").over(key).alias("skipping"), F.count_if("first").over(key).alias("longer"),
        F.max(of(F.col("skips"))).over(key).alias("best_skip"), F.max(of(F.col("first"))).over(key).alias("best_longer"), F.max(of(~F.col("skips"))).over(key).alias("plain"),
    ).where("all > 1")
    # a word that skips is near the others that do and, once for equal code points in a row, near the word that the pair splits
    found = shared.select(
        "wid",
        F.when(F.col("skips"), F.col("skipping") - 1 + F.when(F.col("first") & F.col("plain").isNotNull(), 1).otherwise(0)).otherwise(F.col("longer")).alias("near"),
        # the best of all that skip may be the word itself, which then has no form among them
        F.when(F.col("skips"), F.greatest("best_skip", F.when(F.col("first"), F.col("plain")))).otherwise(F.col("best_longer")).alias("best"),
    )
    return found.groupBy("wid").agg(F.sum("near").alias("n_near"), F.max("best").alias("best")).where("n_near > 0")


def roots(forms: DataFrame) -> DataFrame:
    """(wid, root) of forms(wid, form): where forms lead in the end. Paths double with each round; counts grow along them by TIMES, so they are short."""
    now = written(forms.select("wid", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("wid").alias("root"), F.col("root").alias("further"))
        before, now = now, written(now.join(on, "root", "left").select("wid", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moving = not now.where("moved").isEmpty()
        dropped(before)
        now = now.drop("moved")
        if not moving:
            return now


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    counted = written(words(docs), "words")
    ahead = trie_nodes(counted)
    back = trie_nodes(counted.select(F.reverse("word").alias("word"))).select(F.reverse("word").alias("word"), F.col("nodes").alias("back"))
    # words are numbered in their order, which settles ties
    ranks = in_ranges(counted, [F.col("word")])
    own = Window.partitionBy("part").orderBy("word")
    listed = written(ranks.withColumn("wid", F.col("part").cast("long") * RANGE + F.row_number().over(own)).drop("part"), "listed")
    numbered = written(listed.join(ahead.withColumnRenamed("nodes", "ahead"), "word").join(back, "word"), "numbered")
    found = near(pairs(numbered)).join(listed.select("wid", "n"), "wid").select("wid", "n_near", F.when(F.col("best.n") >= TIMES * F.col("n"), -F.col("best.back")).alias("form"))
    found = written(found, "near")
    led = roots(found.where("form is not null"))
    forms = found.join(led, "wid", "left")
    names = listed.select(F.col("wid").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    ends = listed.select(F.col("wid").alias("root"), F.col("word").alias("root_word"))
    out = listed.join(forms, "wid", "left").join(names, "form", "left").join(ends, "root", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
