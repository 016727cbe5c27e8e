"""One entry for typed requests: policy gate, epoch selection, answer, suppression and noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.keys import ALL_BITS, KeyMask, exact_key, full_key_pattern, key_from_u64, key_pattern
from tallybook.functions.windows import selected
from tallybook.operators import window_queries as q
from tallybook.operators.privacy import Policy, released, request_violations
from tallybook.operators.summaries import samples_totals

#: The class of noise of each kind's main value.
_NOISE = {
    "cm_estimate": ("estimate", "cm_estimate"), "cm_topk": ("estimate", "cm_topk"), "histogram_bucket": ("count", "hist_bucket"), "histogram_all": ("count", "hist_bucket_count"),
    "histogram_all_key": ("count", "hist_bucket_count"), "samples_avg": ("avg", "samples_avg"), "samples_avg_key": ("avg", "samples_avg"), "samples_sum": ("sum", "samples_sum"),
    "samples_sum_exact_key": ("sum", "samples_sum_key"), "samples_sum_key": ("sum", "samples_sum_key"), "samples_sum_topk": ("sum", "samples_sum_key"),
    "samples_raw_max_key": ("max", "raw_max"), "samples_raw_histogram_bucket_key": ("count", "raw_hist_bucket"), "samples_raw_cm_estimate_key": ("estimate", "raw_cm_estimate"), "samples_raw_stats_key": ("sum", "raw_stats_sum"),
}


#: Events that a raw request reads at most, unless it is given another bound.
MAX_EVENTS = 1_000_000


class PolicyViolation(ValueError):
    """A request that the policy doesn't allow."""


def run_query(tables: dict[str, DataFrame], request: dict, policy: Policy = Policy(), dp: str | None = None, seed: int | None = None, max_events: int | None = MAX_EVENTS) -> DataFrame:
    """The answer to a request as a DataFrame. Raw requests over more than max_events events (None: no bound) fail before they are answered.

    tables: epoch_header, samples_entries, hist_cells, hist_keys, cm_cells, cm_slots and raw_events, as far as the
    request needs them. request: {"type": ..., "latest": n or "window": "5m", "end_ms": t, key, mask, pattern, bucket,
    value, limit}. dp: None, "laplace" or "offset".
    """
    kind = request.get("type")
    violations = request_violations(request, policy)
    if policy.enforce and violations:
        raise PolicyViolation(f"{kind}: {', '.join(violations)}")
    headers = tables["epoch_header"]

    def of(name: str) -> DataFrame:
        return selected(tables[name], headers, request.get("latest"), request.get("window"), request.get("end_ms"))

    def raw() -> DataFrame:
        return of("raw_events") if max_events is None else q.guarded(of("raw_events"), max_events)

    def mask() -> KeyMask:
        m = request.get("mask")
        return KeyMask(request["key"], ALL_BITS if m is None else m)

    low, limit = policy.min_support, request.get("limit") or q.TOP
    if kind in ("samples_sum", "samples_avg"):
        totals = of("samples_totals") if "samples_totals" in tables else samples_totals(of("samples_entries"))
        out = (q.samples_sum if kind == "samples_sum" else q.samples_avg)(totals, low)
    elif kind == "samples_sum_exact_key":
        out = q.samples_sum_key(of("samples_entries"), exact_key(request["key"]), low)
    elif kind == "samples_sum_key":
        out = q.samples_sum_key(of("samples_entries"), mask(), low)
    elif kind == "samples_sum_key_pattern":
        out = q.samples_sum_key_ids(of("samples_entries"), key_pattern(request["pattern"]), low)
    elif kind == "samples_avg_key":
        out = q.samples_avg_key(of("samples_entries"), mask(), low)
    elif kind == "samples_sum_topk":
        out = q.samples_topk(of("samples_entries"), limit, low)
    elif kind == "histogram_bucket":
        out = q.histogram_bucket(of("hist_cells"), request["bucket"], low)
    elif kind in ("histogram_all", "histogram_all_key"):
        out = q.histogram_all(of("hist_cells"), of("hist_keys"), full_key_pattern(request["pattern"]) if kind == "histogram_all_key" else None, low)
    elif kind == "histogram_p90":
        out = q.histogram_percentile(of("hist_cells"), 90, min_support=low)
    elif kind in ("cm_estimate", "cm_topk"):
        support = of("cm_cells").where("row = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("support"))
        if kind == "cm_topk":
            out = q.sketch_topk(of("cm_cells"), of("cm_slots"), support, limit, low)
        else:
            keys = tables["cm_cells"].sparkSession.range(1).select(key_from_u64(F.lit(request["key"]).cast("long")).alias("key"))
            out = q.sketch_estimate(of("cm_cells"), keys, support, low)
    elif kind == "samples_raw_max_key":
        out = q.raw_max_key(raw(), mask())
    elif kind == "samples_raw_stats_key":
        out = q.raw_stats_key(raw(), mask())
    elif kind == "samples_raw_histogram_bucket_key":
        out = q.raw_hist_bucket_key(raw(), mask(), request["bucket"])
    elif kind == "samples_raw_cm_estimate_key":
        out = q.raw_sketch_estimate_key(raw(), mask(), request["value"])
    else:
        raise ValueError(f"{kind!r} has no answer")
    if dp and kind in _NOISE:
        value, noise = _NOISE[kind]
        # rows are told apart by what they are grouped by
        out = released(out, value, noise, seed, mode=dp, by=[c for c in ("key", "key_hi", "key_lo", "bucket") if c in out.columns])
    return out


