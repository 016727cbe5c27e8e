"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: share of words in the lexicon (plain, and after undoing letter substitutions), share of
lexicon words near a second-person pronoun, capitals, punctuation, digits, obfuscated words, repeats and length.
The lexicon is learnt: words that far more toxic than other sampled documents use. The isotonic curve learns from a
quarter of the sampled rows, scored by a lexicon and trees that haven't seen them; those in use learn from all.

Whole texts of any length are read; words, signs and capitals are counted, so that a long text counts as its parts do.
Nulls and edges: a null text counts as empty (all features zero). Labels that are null are not learnt from; with
no labelled rows, or one class only, every score is that class's share (0.5 without rows). Null and repeated
doc_ids keep their rows; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import id_remainder, labelled_sample, written

#: Labelled rows learnt from at most; words in the lexicon at most; toxic documents a lexicon word is in at least, and the share of them.
MAX_ROWS, MAX_WORDS, LEAST_DOCS, LEAST_SHARE = 12_000, 200, 5, 0.01
#: How much likelier, as a logarithm, a lexicon word is in toxic documents.
LEAST_RATIO = 1.5
#: Trees, their depth, and words within which a pronoun is near.
TREES, DEPTH, NEAR = 20, 4, 5
HELD_OUT, MODULUS, TOXIC = 0, 5, 0.5

#: Second-person pronouns of English, German, French and Spanish.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus su".split())
#: Characters written for letters.
WRITTEN_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
WORD = re.compile(r"[^\W\d_]+")
#: Words with a digit or sign between letters, as the group; other letters but the last of a run are passed over at once, so that a run of any length is read once.
OBFUSCATED = re.compile(r"([^\W\d_]++[0-9@$!*]++[^\W\d_][\w@$!*]*+|[^\W\d_](?:[.\-_*][^\W\d_]){2,})|[^\W\d_]+(?=[^\W\d_])")
NAMES = ["lexicon", "lexicon_distinct", "lexicon_hidden", "near_second", "second", "capitals", "capital_words", "punctuation", "exclamation", "digits", "obfuscated", "repeats", "log_words", "lexicon_count"]


def features(text: str | None, lexicon: frozenset[str]) -> list[float]:
    """The dense features of a text, in the order of NAMES."""
    text = text or ""
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    size = max(1, int(raw.sum()))
    capitals, digits = int(raw[65:91].sum()), int(raw[48:58].sum())
    signs = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    letters = max(1, capitals + int(raw[97:123].sum()))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    near = sum(any(words[j] in SECOND for j in range(max(0, i - NEAR), min(len(words), i + NEAR + 1))) for i in hits)
    # every match has a digit or sign
    odd = [*filter(None, OBFUSCATED.findall(text))] if digits or signs else []
    hidden = [m for m in odd if m.lower().translate(WRITTEN_FOR) in lexicon]
    return [
        len(hits) / n, len({words[i] for i in hits}) / n, len(hidden) / n, near / n, sum(map(SECOND.__contains__, words)) / n,
        capitals / letters, sum(map(str.isupper, text.split())) / n, signs / size, int(raw[33]) / size, digits / size, len(odd) / n,
        sum(map(str.__eq__, words, words[1:])) / n, float(np.log1p(len(words))), float(np.log1p(len(hits) + len(hidden))),
    ]


def with_features(df: DataFrame, text: str, lexicon: frozenset[str]) -> DataFrame:
    """df with a vector `features` of its text column; only that column goes to Python."""
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, lexicon) for t in texts], dtype="object")

    return df.withColumn("features", array_to_vector(of(F.col(text).cast("string"))))


def learnt_lexicon(sample: DataFrame) -> frozenset[str]:
    """At most MAX_WORDS words that toxic documents of sample(text, y) use far more often than others."""
    total = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    words = sample.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,30})"), 1))).alias("word"))
    counted = words.groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    ratio = F.log((F.col("bad") + 0.5) / (total.get(1, 0) + 1.0)) - F.log((F.col("good") + 0.5) / (total.get(0, 0) + 1.0))
    best = counted.where(F.col("bad") >= max(LEAST_DOCS, LEAST_SHARE * total.get(1, 0))).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc(F.col("ratio") * F.sqrt("bad")), "word").limit(MAX_WORDS)
    return frozenset(r["word"] for r in best.collect())


class Model:
    """A learnt lexicon with trees and their curve, or one score for all."""

    def __init__(self, lexicon: frozenset[str], trees=None, curve=None, share: float = 0.5):
        self.lexicon, self.trees, self.curve, self.share = lexicon, trees, curve, share

    def scores(self, df: DataFrame, text: str, keep: list[str]) -> DataFrame:
        """The columns `keep` of df, and the score of its text column."""
        if self.trees is None:
            return df.select(*keep, F.lit(self.share).alias("score"))
        raw = _raw(self.trees, with_features(df.select(*keep, F.col(text).alias("_scanned")), "_scanned", self.lexicon), keep)
        return self.curve.transform(raw).select(*keep, F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def _raw(trees, featured: DataFrame, keep: list[str]) -> DataFrame:
    return trees.transform(featured).select(*keep, vector_to_array("probability")[1].alias("raw"))


def learnt(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model of at most max_rows labelled rows outside the held-out ids."""
    sample = written(labelled_sample(docs, labels, "toxic", id_remainder("doc_id", MODULUS) != HELD_OUT, max_rows), "labelled")
    n, bad = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < bad < n:
        return Model(frozenset(), share=(bad + 1.0) / (n + 2.0))
    sample = sample.withColumn("part", F.expr("pmod(xxhash64(doc_id, 1), 4)"))
    # the classes weigh nearly the same, so that the rare one shapes the trees; the curve undoes the shift
    weight = F.when(F.col("y") == 1, min(10.0, (n - bad) / bad)).otherwise(1.0)
    rows = sample.select("text", "part", F.col("y").cast("double").alias("y"), weight.alias("weight"))
    # the curve tells how well scores of rows apart are to be trusted; lexicon and trees that are used then learn from all rows
    grow, apart = rows.where("part != 0"), rows.where("part = 0")
    if grow.select("y").distinct().count() < 2 or apart.select("y").distinct().count() < 2:  # too few rows to keep some apart
        grow, apart = rows, rows
    held_lexicon, held_trees = _grown(grow)
    curve = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="prediction").fit(_raw(held_trees, with_features(apart, "text", held_lexicon), ["y"]))
    return Model(*_grown(rows), curve)


def _grown(rows: DataFrame) -> tuple[frozenset[str], object]:
    """(lexicon, trees) of labelled rows(text, y, weight)."""
    lexicon = learnt_lexicon(rows)
    featured = written(with_features(rows, "text", lexicon).drop("text"), "features")
    return lexicon, GBTClassifier(featuresCol="features", labelCol="y", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, maxBins=64, minInstancesPerNode=5, seed=7).fit(featured.coalesce(2))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return model.scores(texts, "text", ["doc_id"]).select("doc_id", (id_remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the toxic rows; all columns as they were, whatever their names."""
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"))
    return model.scores(packed, "doc.text", ["doc"]).where(F.col("score") < TOXIC).select("doc.*")
