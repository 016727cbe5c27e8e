"""Keys, buckets, hashes, patterns and windows on cases with known results."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallybook.functions import bits, keys, windows

M = (1 << 64) - 1


def fnv(b):
    h = 0xCBF29CE484222325
    for x in b:
        h = (h ^ x) * 0x100000001B3 & M
    return h


def finalised(x, a, m1, b, m2, c):
    x ^= x >> a
    x = x * m1 & M
    x ^= x >> b
    x = x * m2 & M
    return x ^ x >> c


def test_exact_64_bit_arithmetic(spark):
    r = random.Random(1)
    xs = [0, 1, M, 1 << 63, (1 << 63) - 1, *(r.getrandbits(64) for _ in range(60))]
    df = spark.createDataFrame([(i, bits.signed(x)) for i, x in enumerate(xs)], "i long, x long")
    x = F.col("x")
    out = df.select("i", bits.mul64(x, 0x94D049BB133111EB).alias("m"), bits.mix64(x).alias("mix"), bits.split_mix(x).alias("split"), bits.unsigned_rem(x, 7).alias("r7"), bits.unsigned_rem(x, 1024).alias("r1024"), bits.unsigned_decimal(x).alias("u"))
    for row in out.collect():
        v = xs[row.i]
        assert row.m & M == v * 0x94D049BB133111EB & M
        assert row.mix & M == finalised(v, 33, 0xFF51AFD7ED558CCD, 33, 0xC4CEB9FE1A85EC53, 33)
        assert row.split & M == finalised(v, 30, 0xBF58476D1CE4E5B9, 27, 0x94D049BB133111EB, 31)
        assert (row.r7, row.r1024, int(row.u)) == (v % 7, v % 1024, v)


def test_keys_and_fields(spark):
    df = spark.createDataFrame([(0x01020304, 0x0A0B0C0D0E0F1011, 2, 77)], "s long, k long, m long, id long")
    row = df.select(
        keys.key_from_source(F.col("s"), F.col("k")).alias("a"), keys.key_from_metric(F.col("m"), F.col("id")).alias("b"), keys.key_from_flow(F.lit(5), F.lit(6)).alias("c"), keys.key_from_u64(F.lit(-1)).alias("d"),
        keys.event_bytes(keys.key_from_u64(F.lit(9)), F.lit(258), F.lit(3)).alias("e"), keys.wire_bytes(keys.key_from_u64(F.lit(9)), F.lit(258), F.lit(3)).alias("w"),
    ).first()
    assert bytes(row.a).hex() == "000000" + "01020304" + "0a0b0c0d0e0f1011" and bytes(row.b).hex() == "02" + "00" * 6 + "000000000000004d"
    assert bytes(row.c).hex() == "00" * 7 + "0000000500000006" and bytes(row.d).hex() == "00" * 7 + "ff" * 8
    assert bytes(row.e).hex() == "00" * 14 + "09" + "00000102" + "00000003" and bytes(row.w).hex() == "00000003" + "00" * 14 + "09" + "00000102"
    k = spark.createDataFrame([(bytes(row.a),)], "key binary").withColumns({"hi": keys.key_hi(F.col("key")), "lo": keys.key_lo(F.col("key")), "src": keys.source_of(F.col("key")), "h": keys.key_hash(F.col("key"))}).first()
    assert (k.hi, k.lo, k.src, k.h & M) == (0x01020304, 0x0A0B0C0D0E0F1011, 0x01020304, fnv(bytes(row.a)))


def test_vehicle_key(spark):
    df = spark.createDataFrame([("Acura", "ILX", "Compact", 2.4, 4, "AM8", "Z"), ("x", "y", "z", 99.0, 4, "t", "")], "a string, b string, c string, e double, n long, t string, f string")
    rows = df.select(keys.key_from_vehicle(*(F.col(c) for c in "abcentf")).alias("k")).collect()
    want = (fnv(b"Acura") & 0xFFFFFFFF).to_bytes(4, "big") + (fnv(b"ILX") & 0xFFFFFFFF).to_bytes(4, "big") + bytes([fnv(b"Compact") & 255, 24, 4]) + (fnv(b"AM8") & 0xFFFF).to_bytes(2, "big") + b"Z\0"
    assert bytes(rows[0].k) == want and bytes(rows[1].k)[9] == 255 and bytes(rows[1].k)[13:] == b"\0\0"


def test_hist_buckets(spark):
    cases = [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (1023, 9), (1024, 10), (2**32 - 1, 31)]
    got = spark.createDataFrame(cases, "v long, want int").select(keys.hist_bucket(F.col("v")).alias("b"), "want").collect()
    assert all(r.b == r.want for r in got)


def test_partition_of_hash(spark):
    r = spark.range(20).select(keys.partition_of(F.col("id"), 5).alias("p"), "id").collect()
    assert all(x.p == int.from_bytes(hashlib.sha256(x.id.to_bytes(8, "big")).digest()[:8], "big") % 5 for x in r)


def test_patterns():
    assert keys.compiled("ab", 64) == (0xAB << 56, 0xFF << 56)
    assert keys.compiled("0xa?_*", 64) == (0xA << 60, 0xF << 60)
    assert keys.compiled("0b1?0", 64) == (0b100 << 61, 0b101 << 61)
    assert keys.key_pattern("a" + "?" * 15).free_bits == 60 and keys.full_key_pattern("????????aabbccdd").free_bits == 120 - 32
    for bad in ("", "xyz", "0b12", "1" * 17):
        with pytest.raises(ValueError):
            keys.key_pattern(bad)


def test_masks_match(spark):
    df = spark.createDataFrame([(0, 7), (0, 23), (1, 7), (0, -1)], "key_hi long, key_lo long")
    assert df.where(keys.KeyMask(7).matches()).count() == 2 and df.where(keys.exact_key(7).matches()).count() == 1
    assert df.where(keys.KeyMask(7, 0xF).matches()).count() == 3 and df.where(keys.KeyMask(M, M).matches()).count() == 1


@pytest.mark.parametrize(("text", "ms"), [("30s", 30_000), ("5m", 300_000), ("1h", 3_600_000), ("1d", 86_400_000)])
def test_windows(text, ms):
    assert windows.window_ms(text) == ms and windows.resolved(text, 10**12) == (10**12 - ms, 10**12)


@pytest.mark.parametrize("text", ["0s", "5w", "", "-1s", "99999999999999999d"])
def test_bad_windows(text):
    with pytest.raises(ValueError):
        windows.window_ms(text)


def test_event_times(spark):
    r = spark.range(1).select(windows.year_ts(F.lit(2021)).alias("y"), windows.spaced_ts(100, F.lit(3), 2).alias("s")).first()
    assert (r.y, r.s) == (1609459200, 106)
