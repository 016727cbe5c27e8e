"""Language identification by Bayesian evidence fusion.

For each page the log-likelihoods of its visible text under character-trigram models of the languages are added to
what it declares (the markup's lang), the address's suffix, and a prior of its host. Host priors are smoothed toward
those of the address suffix, and these toward the whole table's: grouped sums of the text posteriors, each level with
the next as its prior of HOST_WEIGHT (SUFFIX_WEIGHT) pages. A page's own posterior is taken out of every sum that its
prior comes from, so that its text counts once. All evidence is combined with naive-Bayes sums of logs.

Models learn from labelled documents, one row for each id; the sample is bounded, hosts and suffixes are counted over
the whole table. Whole pages are read, in time that grows with their length.

Nulls and edges: a null html gives no text evidence and no declaration, a null url no host: such pages take the prior
of the pages without a host. Pages without any evidence take the whole table's prior. Null and repeated page_ids keep
their rows. Without labelled documents there are no languages, and lang is null. An empty table gives no rows.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import written

#: Documents learnt from at most, hashed trigrams, smoothing of their counts.
MAX_ROWS, BUCKETS, SMOOTH = 4000, 1 << 15, 0.5
#: Text evidence is worth this many independent trigrams at most: trigrams overlap, and long pages aren't proof.
MOST_GRAMS = 200
#: Pages that a host's prior weighs against its suffix's, and a suffix's against the table's.
HOST_WEIGHT, SUFFIX_WEIGHT = 5.0, 20.0
#: How far declarations and country suffixes are trusted: chance that they name the text's language.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.8
#: Country suffixes that stand for one language.
SUFFIX_LANG = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}

#: Elements whose content isn't shown, and what ends them.
_OPENS = re.compile(r"(?i)<(script|style|noscript|template)\b")
_CLOSES = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "noscript", "template")}


def visible(html: str | None) -> str:
    """The text between tags with entities decoded, without scripts, styles and comments; what is never closed counts as text.

    One pass: an end that is looked for in vain once isn't looked for again.
    """
    text, out, at, missing = html or "", [], 0, set()

    def end_of(what: str, start: int) -> int:
        """The place after the next end of a comment, a tag or an element, -1 if there is none."""
        if what in missing:
            return -1
        if what in _CLOSES:
            found = _CLOSES[what].search(text, start)
            end = found.end() if found else -1
        else:
            end = text.find(what, start)
            end += len(what) if end >= 0 else 0
        if end < 0:
            missing.add(what)
        return end

    while (begin := text.find("<", at)) >= 0:
        opens = _OPENS.match(text, begin)
        end = end_of("-->", begin + 4) if text.startswith("<!--", begin) else end_of(opens[1].lower(), opens.end()) if opens else -1
        if end < 0:
            end = end_of(">", begin + 1)
        if end < 0:
            break
        out += [text[at:begin], " "]
        at = end
    out.append(text[at:])
    shown = "".join(out)
    return markup.unescape(shown) if "&" in shown else shown


def trigrams(text: str) -> np.ndarray:
    """Hashed character trigrams of letters and blanks in lower case."""
    points = np.frombuffer((" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.empty(0, dtype=np.int64)
    mixed = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:]
    mixed ^= mixed >> np.uint64(15)
    return ((mixed * np.uint64(0xC2B2AE3D)) >> np.uint64(13)).astype(np.int64) & (BUCKETS - 1)


def learnt(docs: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of each trigram in each) from at most max_rows documents with a lang."""
    ids = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.where(F.col("lang").isNotNull()).select("doc_id", F.struct("lang", F.coalesce("text", F.lit("")).alias("text")).alias("row")).join(F.broadcast(ids), "doc_id")
    # max_rows bounds the broadcast side; of an id's rows the first by lang and text counts
    sample = rows.groupBy("doc_id").agg(F.min("row").alias("row")).select("row.*")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[lang] = counts.get(lang, 0) + np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    # languages times buckets rows at most
    rows = sample.mapInArrow(grams, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((len(langs), BUCKETS), SMOOTH)
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        table[k, own["bucket"].to_numpy(dtype=np.int64)] += own["n"].to_numpy(dtype=np.float64)
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def identified(pages: DataFrame, docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host of every page."""
    langs, table = learnt(docs, max_rows)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if not langs:
        return own.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    shared = pages.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            scores = []
            for html in batch.column(3):
                g = trigrams(visible(html.as_py()))
                s = weights[:, g].sum(axis=1, dtype=np.float64) * (min(1.0, MOST_GRAMS / len(g)) if len(g) else 0.0)
                scores.append((s - s.max()).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.list_(pa.float64()))], names=["page_id", "host", "declared", "text_scores"])

    host = F.lower(F.regexp_extract("url", r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    seen = written(own.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(declared, F.lit("")).alias("declared"), "html").mapInArrow(texts, "page_id long, host string, declared string, text_scores array<double>"), "pages")
    seen = seen.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))
    names, k = F.array(*map(F.lit, langs)), len(langs)

    def right(named, chance: float):
        """Log-chances of a name given each language; no name, or one outside the languages, says nothing."""
        return [F.when(named == g, float(np.log(chance))).when(named.isin(langs), float(np.log((1 - chance) / max(1, k - 1)))).otherwise(0.0) for g in langs]

    top = F.array_max("text_scores")
    total = F.aggregate("text_scores", F.lit(0.0), lambda a, s: a + F.exp(s))
    posterior = [F.exp(F.col("text_scores")[i]) / total for i in range(k)]
    # sums per host, then per suffix from these, then one: partial sums are combined before each shuffle
    by_host = written(seen.groupBy("suffix", "host").agg(F.count("*").alias("n"), *(F.sum(p).alias(f"p{i}") for i, p in enumerate(posterior))), "hosts")
    by_suffix = by_host.groupBy("suffix").agg(F.sum("n").alias("sn"), *(F.sum(f"p{i}").alias(f"s{i}") for i in range(k)))
    whole = by_host.agg(F.sum("n").alias("n"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(k))).first()
    # the sums without the page's own posterior
    own = [F.col("mine")[i] for i in range(k)]
    base = [(F.lit(float(whole[f"p{i}"] or 0.0)) - own[i] + 1) / ((whole["n"] or 0) - 1 + k) for i in range(k)]
    suffix_prior = [(F.col("of_suffix")[i] - own[i] + SUFFIX_WEIGHT * base[i]) / (F.col("sn") - 1 + SUFFIX_WEIGHT) for i in range(k)]
    host_prior = [F.log((F.col("of_host")[i] - own[i] + HOST_WEIGHT * suffix_prior[i]) / (F.col("n") - 1 + HOST_WEIGHT)) for i in range(k)]
    sums = by_host.join(by_suffix, "suffix").select("host", "n", "sn", F.array(*(f"p{i}" for i in range(k))).alias("of_host"), F.array(*(f"s{i}" for i in range(k))).alias("of_suffix"))
    mapped = F.create_map(*(F.lit(x) for pair in SUFFIX_LANG.items() for x in pair))
    fused = seen.withColumn("mine", F.array(*posterior)).join(sums, "host").withColumn("hint", mapped[F.col("suffix")])
    said, ends = right(F.col("declared"), DECLARED_RIGHT), right(F.coalesce("hint", F.lit("")), SUFFIX_RIGHT)
    fused = fused.withColumn("logs", F.array(*(F.col("text_scores")[i] + host_prior[i] + said[i] + ends[i] for i in range(k))))
    best = F.array_max("logs")
    return fused.select(
        "page_id", F.element_at(names, F.array_position("logs", best).cast("int")).alias("lang"),
        (1 / F.aggregate("logs", F.lit(0.0), lambda a, s: a + F.exp(s - best))).alias("confidence"),
        F.element_at(names, F.array_position("text_scores", top).cast("int")).alias("text_lang"), "declared", "host",
    )
