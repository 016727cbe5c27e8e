"""Suppression of small groups, calibrated noise, and screening of requests."""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.keys import compiled

#: Records below which a result isn't released; bits of freedom below which a predicate singles someone out.
MIN_SUPPORT, MIN_BITS = 10, 16

#: Per class of query the privacy budget epsilon, the sensitivity and the fixed offset.
CALIBRATION = {
    "cm_estimate": (1.0, 1.0, 10), "cm_topk": (1.0, 1.0, 10), "cm_per_key_estimate": (1.0, 1.0, 10),
    "hist_bucket": (1.0, 1.0, 10), "hist_total_count": (1.0, 1.0, 10), "hist_total_sum": (1.0, 1e6, 50),
    "hist_bucket_count": (1.0, 1.0, 10), "hist_per_key_bucket": (1.0, 1.0, 10),
    "samples_sum": (1.0, 1e6, 50), "samples_count": (1.0, 1.0, 10), "samples_avg": (1.0, 1e6, 10),
    "samples_sum_key": (1.0, 1e6, 50), "samples_count_key": (1.0, 1.0, 10),
    "raw_max": (1.0, 1e6, 50), "raw_hist_bucket": (1.0, 1.0, 10), "raw_cm_estimate": (1.0, 1.0, 10),
    "raw_stats_count": (1.0, 1.0, 10), "raw_stats_sum": (1.0, 1e6, 50), "raw_stats_sumsq": (1.0, 1e12, 100),
}

#: For each kind of request what it returns, what it groups by, and what its key predicate is.
KINDS: dict[str, tuple[list[str], list[str], str]] = {
    "cm_estimate": (["estimate"], [], "exact"),
    "cm_topk": (["key", "count"], ["key_id"], "none"),
    "histogram_bucket": (["bucket", "count"], ["bucket"], "none"),
    "histogram_all": (["bucket", "count", "total_count", "total_sum"], ["bucket"], "none"),
    "histogram_all_key": ([], [], "pattern120"),
    "histogram_p90": ([], [], "none"),
    "samples_avg": (["avg"], [], "none"),
    "samples_avg_key": (["key", "avg"], ["key_id"], "mask"),
    "samples_sum": (["sum"], [], "none"),
    "samples_sum_exact_key": ([], [], "exact"),
    "samples_sum_key": (["key", "sum"], ["key_id"], "mask"),
    "samples_sum_key_pattern": ([], [], "pattern64"),
    "samples_sum_topk": ([], [], "none"),
    "samples_raw_max_key": (["key", "max"], ["key_id"], "mask"),
    "samples_raw_histogram_bucket_key": (["key", "bucket", "count"], ["key_id"], "mask"),
    "samples_raw_cm_estimate_key": (["key", "value", "estimate"], ["key_id"], "mask"),
    "samples_raw_stats_key": (["key", "count", "sum", "sumsq_lo", "sumsq_hi"], ["key_id"], "mask"),
    "histogram_epoch_per_key_bucket_key": (["key", "bucket", "count"], ["key_id"], "mask"),
    "series_histogram_bucket_key": (["key", "bucket", "count"], ["key_id"], "mask"),
    "cm_epoch_per_key_estimate_key": (["key", "value", "estimate"], ["key_id"], "mask"),
    "series_cm_estimate_key": (["key", "value", "estimate"], ["key_id"], "mask"),
}
#: Fields that name a person or a machine.
IDS = ["key", "key_id", "user_id"]
RAW = ["ip", "src_ip", "dst_ip", "username", "user", "port"]


@dataclass(frozen=True)
class Policy:
    """What requests may ask for."""

    enforce: bool = True
    allow_anonymized_ids: bool = False
    min_support: int = MIN_SUPPORT
    min_anonymity_bits: int = MIN_BITS
    allow_group_by: tuple[str, ...] = field(default=("anonymized_id", "anonymized_ip", "subnet_prefix", "app_class", "bucket"))


def suppressed(result: DataFrame, values: list[str], min_support: int = MIN_SUPPORT) -> DataFrame:
    """result(values, support, ...) with values and support at 0 and `suppressed` true where support is too small."""
    low = F.col("support") < min_support
    kinds = dict(result.dtypes)
    return result.withColumn("suppressed", low).withColumns({c: F.when(F.col("suppressed"), F.lit(0)).otherwise(F.col(c)).cast(kinds[c]) for c in [*values, "support"]})


def keyed_uniform(seed: str, kind: str, by: list[str]) -> Column:
    """A number in [0, 1) from the SHA-256 of seed, kind and the row's key: the same wherever and whenever the row is computed. Keys are told apart by their text."""
    text = F.concat_ws(chr(31), F.lit(seed), F.lit(kind), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def laplace(epsilon: float, sensitivity: float, seed: int | None = None, uniform: Column | None = None) -> Column:
    """A draw of Laplace(0, sensitivity / epsilon) per row, by the inverse of its distribution; uniform: the number in [0, 1) it is drawn by, else a random one."""
    scale = sensitivity / epsilon
    u = (F.rand(seed) if uniform is None else uniform) - 0.5
    return F.transform(F.array(u), lambda x: F.when(F.abs(x) >= 0.5, F.when(x >= 0, scale * 10).otherwise(-scale * 10)).otherwise(-scale * F.signum(x) * F.log(1 - 2 * F.abs(x))))[0]


def released(result: DataFrame, value: str, kind: str, seed: int | None = None, audit: bool = False, mode: str = "laplace", signed: bool = False, by: list[str] | None = None) -> DataFrame:
    """value with noise of its class, never below 0 unless signed; `audit` keeps the noise beside it. mode "offset": the fixed offset instead, value unchanged.

    by: columns that tell rows apart (none, for a result of one row). Noise then depends on seed, class and row alone,
    not on how rows are dealt out, so that the same release can be repeated; without a seed a secret one is drawn.
    """
    epsilon, sensitivity, offset = CALIBRATION[kind]
    if mode == "offset":
        return result.withColumn("dp_offset", F.lit(offset))
    uniform = None if by is None else keyed_uniform(secrets.token_hex(32) if seed is None else str(seed), kind, by)
    # one draw: value and audit see the same
    noisy = result.withColumn("noise", F.round(laplace(epsilon, sensitivity, seed, uniform)).cast("long")).withColumn(value, F.col(value) + F.col("noise") if signed else F.greatest(F.lit(0), F.col(value) + F.col("noise")))
    return noisy if audit else noisy.drop("noise")


def calibration(spark) -> DataFrame:
    """The calibration table as rows."""
    return spark.createDataFrame([(k, *v) for k, v in CALIBRATION.items()], "kind string, epsilon double, sensitivity double, offset int")


def kind_rules(spark) -> DataFrame:
    """The kinds of requests as rows: outputs, dims, predicate."""
    return spark.createDataFrame([(k, *v) for k, v in KINDS.items()], "type string, outputs array<string>, dims array<string>, predicate string")


def freedom_bits(predicate: Column, mask: Column, pattern: Column) -> Column:
    """How many bits of the key a predicate leaves open; null without a predicate. mask: the LONG's bits."""
    p = F.lower(F.trim(F.coalesce(pattern, F.lit(""))))
    binary = p.startswith("0b")
    digits = F.when(binary | p.startswith("0x"), F.substring(p, 3, 1000)).otherwise(p)
    wild = F.length(digits) - F.length(F.translate(digits, "?*_", ""))
    size = F.when(binary, 1).otherwise(4)

    def of(width: int) -> Column:
        return wild * size + F.greatest(F.lit(width) - F.length(digits) * size, F.lit(0))

    return F.when(predicate == "exact", 0).when(predicate == "mask", 64 - F.bit_count(F.coalesce(mask, F.lit(-1).cast("long")))).when(predicate == "pattern64", of(64)).when(predicate == "pattern120", of(120)).cast("int")


def screened(requests: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """requests(type, mask, pattern, group_by, support, ...) with free_bits, membership, violations and ok.

    An unknown type fails the job: a new kind must say what its predicate is.
    """
    rules = F.broadcast(kind_rules(requests.sparkSession))  # one row per kind
    joined = requests.join(rules, "type", "left")
    known = F.when(F.col("outputs").isNull(), F.raise_error(F.concat(F.lit("unknown request type "), F.coalesce("type", F.lit("null")))).cast("string")).otherwise(F.col("predicate"))
    df = joined.withColumn("predicate", known).withColumn("free_bits", freedom_bits(F.col("predicate"), F.col("mask"), F.col("pattern")))
    df = df.withColumn("membership", F.coalesce(F.col("free_bits") < policy.min_anonymity_bits, F.lit(False)))
    dims = F.when(F.size(F.coalesce("group_by", F.array().cast("array<string>"))) > 0, F.transform("group_by", lambda d: F.lower(F.trim(d)))).otherwise(F.col("dims"))

    def named(d: Column) -> Column:
        return F.when(d.isin(IDS), "anonymized_id").otherwise(d) if policy.allow_anonymized_ids else d

    private = RAW + ["value"] + ([] if policy.allow_anonymized_ids else IDS)
    outputs = F.transform(F.filter("outputs", lambda o: o.isin(private)), lambda o: F.concat(F.lit("pii_output:"), o))
    grouped = F.transform(F.filter(F.transform(dims, named), lambda d: d.isin(RAW) | ~d.isin(list(policy.allow_group_by))), lambda d: F.concat(F.lit("group_by_not_allowed:"), d))
    single = F.when(F.col("membership"), F.array(F.lit("non_aggregate_query"))).otherwise(F.array().cast("array<string>"))
    small = F.when(F.col("support") < policy.min_support, F.array(F.lit("low_support"))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("violations", F.concat(outputs, single, grouped, small)).withColumn("ok", F.size("violations") == 0).drop("outputs", "dims", "predicate")


def request_violations(request: dict, policy: Policy = Policy()) -> list[str]:
    """The violations of one request, for the facade's gate: the same rules as `screened`, without a job."""
    kind = request.get("type")
    if kind not in KINDS:
        raise ValueError(f"unknown request type {kind!r}")
    outputs, dims, predicate = KINDS[kind]
    ids = [] if policy.allow_anonymized_ids else IDS
    found = [f"pii_output:{o}" for o in outputs if o in RAW or o == "value" or o in ids]
    free = {"exact": 0, "none": None}.get(predicate)
    if predicate == "mask":
        mask = request.get("mask")
        free = 64 - ((1 << 64) - 1 if mask is None else mask).bit_count()
    elif predicate.startswith("pattern"):
        width = int(predicate[7:])
        free = width - compiled(request.get("pattern") or "?", width)[1].bit_count()
    if free is not None and free < policy.min_anonymity_bits:
        found.append("non_aggregate_query")
    for d in (x.strip().lower() for x in request.get("group_by") or dims):
        d = "anonymized_id" if policy.allow_anonymized_ids and d in IDS else d
        if d in RAW or d not in policy.allow_group_by:
            found.append(f"group_by_not_allowed:{d}")
    if request.get("support") is not None and request["support"] < policy.min_support:
        found.append("low_support")
    return found
