"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

DataFrame functions only. A match's place follows from the lengths of the gaps and matches before it: the text is
split by a pattern and its matches are extracted, so every place counts characters, whatever they are.

The battery takes every run of LEAST or more encoding characters that has both letters and digits or both cases,
infers its encoding (hex, base32, base64) and makes three tests of it: the chi-squared statistic of its characters over
the alphabet, the number of changes between kinds of characters (runs), and the correlation of each character's place
in the alphabet with the next one's. Each test gives two p-values. Against what ordinary tokens of that encoding are
like (names and words repeat their characters, keep their kinds, and hold like places together) a small one speaks for
a secret; against random characters a small one speaks for an ordinary token. The three p-values of a side are combined
by Fisher's method. A candidate that random characters explain badly (below LEAST_RANDOM) has p-value 1; of all
candidates, each class of lengths accepts as many as keep the share of false ones below FALSE_SHARE
(Benjamini-Hochberg over binned p-values, counted over the whole table): short tokens, which tell less, are not held
against long ones, nor long ones against short.

Nulls and edges: a null text counts as empty. Null and repeated doc_ids keep their rows. Long texts are scanned
whole. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.llm.common import written

#: The base patterns, the order of their kinds, and the least length that counts.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
LEAST_ASSIGNED = 12
#: Characters that a candidate has at least, the same as a base hex span's.
LEAST = 16
#: Runs that the battery looks at.
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: What it looks at within a run, since names and paths may be glued to a secret: the run, and its parts between '=', '=' or '/', '=' or '_' or '-', and all four.
PARTS = [CANDIDATE, *(rf"[A-Za-z0-9{signs}]{{{LEAST},}}" for signs in ("+/_-", "+_-", "+/", "+"))]
#: Share of false finds that each class of lengths may have; longest length of each class but the last.
FALSE_SHARE, CLASSES = 0.001, [19, 27, 35, 47, 63]
#: Combined p-value below which random characters don't explain a candidate.
LEAST_RANDOM = 0.005
#: By encoding: its alphabet, and the chance that the kind changes between two random characters of it.
ALPHABETS = {
    "hex": ("0123456789ABCDEF", 0.469),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.305),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.645),
}
#: By encoding, ordinary tokens: chance that two characters are the same, that three are, that the kind changes, and the correlation with the next place.
ORDINARY = {"hex": (0.13, 0.03, 0.12, 0.3), "base32": (0.066, 0.0055, 0.1, 0.3), "base64": (0.066, 0.0055, 0.28, 0.35)}
#: Width of the bins of -ln p, and their number.
BIN, BINS = 0.25, 400
REDACTED = "[SECRET]"


def _matches(text: Column, kind: str, pattern: str) -> Column:
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    return F.struct(F.lit(kind).alias("kind"), gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"))


def scans(docs: DataFrame, key: Column) -> DataFrame:
    """(key, doc_id, s): one row per document with what each pattern matches, written once, so that keys stay the same."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of = [_matches(text, k, p) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True)]
    return written(docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.filter(F.array(*of), lambda s: F.size(s["found"]) > 0).alias("s")), "scans")


def located(scanned: DataFrame) -> DataFrame:
    """(key, kind, start, end, found) of all matches; ends are exclusive."""
    each = scanned.select("key", F.explode("s").alias("s"))
    rows = each.select("key", "s.kind", F.posexplode(F.arrays_zip(F.slice("s.gaps", 1, F.size("s.found")).alias("gap"), F.col("s.found").alias("found"))).alias("i", "m")).select("key", "kind", "i", "m.gap", "m.found")
    before = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("found")).over(before)).withColumn("start", F.col("end") - F.length("found"))
    return placed.where((F.col("kind") != "assign") | (F.length(F.regexp_extract("found", ASSIGN, 2)) >= LEAST_ASSIGNED)).select("key", "kind", "start", "end", "found")


def _tail(z: Column) -> Column:
    """-ln of the upper tail of the normal distribution, by a logistic form good to a few parts in a hundred."""
    x = F.lit(1.5976) * z + F.lit(0.07056) * z * z * z
    return F.when(x > 30, x).otherwise(F.log1p(F.exp(F.least(x, F.lit(30.0)))))


def _fisher(*logs: Column) -> Column:
    """-ln of the combined p-value of three tests whose -ln p-values these are: chi-squared with six degrees of freedom."""
    total = sum(logs[1:], logs[0])
    return total - F.log1p(total + total * total / 2)


def testable(candidates: DataFrame) -> DataFrame:
    """Those of candidates(found, ...) that the battery is for, with encoding and body: enough characters beside the padding, of more than one kind."""
    s = F.col("found")
    encoding = F.when(s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(s.rlike("^[A-Z2-7]+=*$"), "base32").otherwise("base64")
    # base64 writes its last two characters in two ways
    body = F.when(F.col("encoding") == "hex", F.upper(s)).otherwise(F.translate(F.regexp_replace(s, "=+$", ""), "-_", "+/"))
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]") | s.rlike("[a-z]") & s.rlike("[A-Z]")
    return candidates.where(mixed).withColumn("encoding", encoding).withColumn("body", body).where(F.length("body") >= LEAST)


def _let(x: Column, then) -> Column:
    """then(x), with x worked out once whatever often it is used."""
    return F.transform(F.array(x), then)[0]


def _of_encoding(value) -> Column:
    return F.when(F.col("encoding") == "hex", value("hex")).when(F.col("encoding") == "base32", value("base32")).otherwise(value("base64"))


def _facts(alphabet: Column, body: Column) -> Column:
    """A struct of what the tests need to know of a body: n, size, squares (of the characters' counts), changes (of kind), serial (correlation)."""
    def counted(x: Column) -> Column:
        squares = F.aggregate(F.array_distinct(x["chars"]), F.lit(0.0), lambda a, c: a + F.pow(x["n"] - F.length(F.replace(x["body"], c, F.lit(""))), F.lit(2.0)))
        return F.struct(x["n"].alias("n"), x["size"].alias("size"), squares.alias("squares"), x["changes"].alias("changes"), x["places"].alias("places"), (F.aggregate(x["places"], F.lit(0.0), lambda a, p: a + p) / x["n"]).alias("mean"))

    def correlated(x: Column) -> Column:
        spread = F.aggregate(x["places"], F.lit(0.0), lambda a, p: a + (p - x["mean"]) * (p - x["mean"]))
        # the sum so far and the place before
        first = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("last"))
        along = F.aggregate(x["places"], first, lambda a, p: F.struct((a["sum"] + F.coalesce((a["last"] - x["mean"]) * (p - x["mean"]), F.lit(0.0))).alias("sum"), p.alias("last")))["sum"]
        return F.struct(x["n"].alias("n"), x["size"].alias("size"), x["squares"].alias("squares"), x["changes"].alias("changes"), F.coalesce(F.try_divide(along, spread), F.lit(1.0)).alias("serial"))

    runs = F.when(F.length(alphabet) == 64, F.regexp_count(body, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"))).otherwise(F.regexp_count(body, F.lit("[A-Z]+|[0-9]+"))).cast("double")
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    seen = F.struct(
        body.alias("body"), F.length(body).cast("double").alias("n"), F.length(alphabet).cast("double").alias("size"), (runs - 1).alias("changes"), chars.alias("chars"),
        F.transform(chars, lambda c: F.instr(alphabet, c).cast("double")).alias("places"),
    )
    return _let(_let(seen, counted), correlated)


def battery(tested: DataFrame) -> DataFrame:
    """testable rows with what the tests say: evidence (-ln of the combined p-value against ordinary tokens) and doubt (the same against random characters)."""
    def judged(x: Column) -> Column:
        f, n, size, serial = x["facts"], x["facts"]["n"], x["facts"]["size"], x["facts"]["serial"]
        pairs = n * (n - 1) / 2
        # against ordinary tokens: fewer pairs of equal characters, more changes, less correlation
        pair, triple, change, like = (x[name] for name in ("pair", "triple", "change", "like"))
        few_repeats = (pairs * pair - (f["squares"] - n) / 2) / F.sqrt(pairs * (pair + 2 * (n - 2) * triple - (2 * n - 3) * pair * pair))
        many_runs = (f["changes"] - change * (n - 1)) / F.sqrt(change * (1 - change) * (n - 1))
        unlike = (like - serial) * F.sqrt(n / (1 - like * like))
        # against random characters: counts beyond what chance gives (a cube-root form of chi-squared), too few changes, correlation either way
        free = size - 1
        uneven = (F.cbrt((size / n * f["squares"] - n) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        few_runs = (x["turn"] * (n - 1) - f["changes"]) / F.sqrt(x["turn"] * (1 - x["turn"]) * (n - 1))
        two_sided = F.greatest(_tail(F.abs(serial + 1 / n) * F.sqrt(n)) - math.log(2.0), F.lit(0.0))
        logs = F.struct(*(_tail(z).alias(f"l{i}") for i, z in enumerate((few_repeats, many_runs, unlike, uneven, few_runs))), two_sided.alias("l5"))
        return _let(logs, lambda v: F.struct(_fisher(v["l0"], v["l1"], v["l2"]).alias("evidence"), _fisher(v["l3"], v["l4"], v["l5"]).alias("doubt")))

    alphabet = _of_encoding(lambda k: F.lit(ALPHABETS[k][0]))
    known = [_of_encoding(lambda k, i=i: F.lit(ORDINARY[k][i])).alias(name) for i, name in enumerate(("pair", "triple", "change", "like"))]
    facts = _let(F.struct(alphabet.alias("a"), F.col("body").alias("b")), lambda x: _facts(x["a"], x["b"]))
    told = _let(F.struct(facts.alias("facts"), *known, _of_encoding(lambda k: F.lit(ALPHABETS[k][1])).alias("turn")), judged)
    return tested.withColumn("told", told).select(*tested.columns, "told.evidence", "told.doubt")


def discovered(candidates: DataFrame) -> DataFrame:
    """Those of candidates(found, ...) that ordinary tokens don't explain, as many in each class of lengths as FALSE_SHARE allows."""
    columns = candidates.columns
    group = sum((F.when(F.length("found") > at, 1).otherwise(0) for at in CLASSES), F.lit(0))
    score = F.when(F.col("doubt") <= -math.log(LEAST_RANDOM), F.col("evidence")).otherwise(0.0)
    tested = battery(testable(candidates)).select(*columns, group.alias("class"), F.least(F.floor(score / BIN), F.lit(BINS)).cast("int").alias("bin"))
    # a row for each class and bin: at most (len(CLASSES) + 1) * (BINS + 1), whatever the table
    counts = tested.groupBy("class", "bin").agg(F.count("*").alias("n"))
    down, all_of = Window.partitionBy("class").orderBy(F.desc("bin")), Window.partitionBy("class")
    allowed = counts.withColumn("above", F.sum("n").over(down)).withColumn("m", F.sum("n").over(all_of))
    least = allowed.where(F.exp(-F.col("bin") * BIN) <= FALSE_SHARE * F.col("above") / F.col("m")).groupBy("class").agg(F.min("bin").alias("from_bin"))
    return tested.join(F.broadcast(least), "class").where("bin >= from_bin and bin > 0").select(*columns)


def parts(runs: DataFrame, base: DataFrame) -> DataFrame:
    """(key, kind, run, run_start, start, end, found): the runs' pieces outside of base spans, and the parts of these; each place once."""
    # base spans of a key without overlaps, in order
    before = Window.partitionBy("key").orderBy("start", "end")
    apart = base.withColumn("reached", F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    islands = apart.withColumn("island", F.sum(F.when(F.col("start") < F.col("reached"), 0).otherwise(1)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    # runs and merged base spans of a key in one order: a run is cut by the span that reaches into it and by those that begin in it
    order = Window.partitionBy("key").orderBy("start", "is_run").rowsBetween(Window.unboundedPreceding, -1)
    both = runs.select("key", "kind", "start", "end", "found", F.lit(1).alias("is_run")).unionByName(merged.select("key", "start", "end", F.lit(0).alias("is_run")), allowMissingColumns=True)
    lined = both.withColumn("reach", F.last(F.when(F.col("is_run") == 0, F.col("end")), True).over(order)).withColumn("own", F.last(F.when(F.col("is_run") == 1, F.struct("start", "end")), True).over(order))
    begun = lined.where("is_run = 0 and own.end > start").groupBy("key", F.col("own.start").alias("start")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("begun"))
    span = "array<struct<start:bigint,end:bigint>>"
    within = F.expr(f"concat(if(coalesce(reach > start, false), array(struct(start, least(reach, end) as end)), cast(array() as {span})), coalesce(begun, cast(array() as {span})))")
    cut = lined.where("is_run = 1").join(begun, ["key", "start"], "left").select("key", "kind", F.col("found").alias("run"), F.col("start").alias("run_start"), "end", within.alias("base"))
    edges = F.expr("transform(sequence(0, size(base)), i -> struct(if(i = 0, run_start, base[i - 1].end) as start, if(i = size(base), end, base[i].start) as end))")
    pieces = cut.select("key", "kind", "run", "run_start", F.explode(edges).alias("p")).where(F.col("p.end") - F.col("p.start") >= LEAST)
    texts = pieces.select("key", "kind", "run", "run_start", F.col("p.start").alias("piece_start"), F.expr("substring(run, cast(p.start - run_start + 1 as int), cast(p.end - p.start as int))").alias("piece"))
    of = [_matches(F.col("piece"), str(i), p) for i, p in enumerate(PARTS)]
    placed = located(texts.select(F.struct("key", "kind", "run", "run_start", "piece_start").alias("key"), F.filter(F.array(*of), lambda m: F.size(m["found"]) > 0).alias("s")))
    at = F.col("key.piece_start")
    return placed.select("key.key", "key.kind", "key.run", "key.run_start", (at + F.col("start")).alias("start"), (at + F.col("end")).alias("end"), "found").distinct()


def joined_up(accepted: DataFrame) -> DataFrame:
    """(key, kind, start, end, found): accepted parts of a run that overlap are one."""
    before = Window.partitionBy("key", "run_start").orderBy("start", "end")
    apart = accepted.withColumn("reached", F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    islands = apart.withColumn("island", F.sum(F.when(F.col("start") < F.col("reached"), 0).otherwise(1)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("key", "kind", "run_start", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("run").alias("run"))
    return whole.select("key", "kind", "start", "end", F.expr("substring(run, cast(start - run_start + 1 as int), cast(end - start as int))").alias("found"))


def spans(scanned: DataFrame) -> DataFrame:
    """(key, kind, start, end, found): base spans, and what the battery adds outside of them."""
    places = written(located(scanned), "matches")
    base = places.where("kind != 'random'")
    candidates = written(parts(places.where("kind = 'random'"), base), "candidates")
    return base.unionByName(joined_up(discovered(candidates)))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_random, of every document."""
    rows = scans(docs, F.monotonically_increasing_id())
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    found = spans(rows).groupBy("key").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS),
        F.array_sort(F.collect_list(F.struct("start", order.alias("nth"), "kind", "end"))).alias("all"),
    )
    def joined(a: Column) -> Column:
        return F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))

    none = F.coalesce("all", F.array().cast("array<struct<start:bigint,nth:bigint,kind:string,end:bigint>>"))
    return rows.select("key", "doc_id").join(found, "key", "left").select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.filter(none, lambda x: x["kind"] != "random")), 256).alias("base_sha256"), joined(none).alias("spans"),
        F.coalesce("n_random", F.lit(0)).cast("long").alias("n_random"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every secret found in a document's text replaced, wherever in that text it stands; columns stay as they are."""
    # documents travel as one column, so that theirs can't clash with these; a written row's number stays the same, and ids may repeat
    rows = written(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc")), "documents")
    found = spans(scans(rows.select("key", "doc.doc_id", "doc.text"), F.col("key"))).groupBy("key").agg(F.collect_set("found").alias("secrets"))
    # the longest first: a secret may stand within another
    longest = F.array_sort(F.col("secrets"), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0))
    own = F.col("doc.text").cast("string")
    text = F.when(F.col("secrets").isNull(), own).otherwise(F.aggregate(longest, own, lambda t, s: F.replace(t, s, F.lit(REDACTED))))
    return rows.join(found, "key", "left").select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")
