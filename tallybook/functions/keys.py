"""Keys of 15 bytes, event encodings, buckets, routing, masks and key patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.bits import const, fnv1a64, mix64, split_mix, unsigned_rem

KEY_BYTES, SAMPLE_BUCKETS, SKETCH_COLUMNS, HIST_BUCKETS = 15, 1024, 1024, 32
#: Seeds of the sketch's three rows.
SKETCH_SEEDS = [0x6D0F27BD, 0x9E3779B9, 0x94D049BB]
ALL_BITS = (1 << 64) - 1


def be(x: Column, size: int) -> Column:
    """A non-negative number (or a LONG's bits, if size is 8) as so many big-endian bytes."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2 * size, "0"))


def zeros(size: int) -> Column:
    return F.unhex(F.lit("00" * size))


def key_from_u64(x: Column) -> Column:
    return F.concat(zeros(7), be(x, 8))


def key_from_source(source_id: Column, key_index: Column) -> Column:
    return F.concat(zeros(3), be(source_id, 4), be(key_index, 8))


def key_from_metric(metric: Column, machine_id: Column) -> Column:
    return F.concat(be(metric, 1), zeros(6), be(machine_id, 8))


def key_from_flow(src: Column, dst: Column) -> Column:
    return key_from_u64(F.shiftleft(src.cast("long"), 32).bitwiseOR(dst.cast("long")))


def key_from_vehicle(make: Column, model: Column, vehicle: Column, engine_l: Column, cylinders: Column, transmission: Column, fuel: Column) -> Column:
    """Make, model, class and transmission by their hash's low bytes; engine in tenths of a litre, 255 at most; cylinders; the fuel's first byte; a zero."""
    def low(s: Column, size: int) -> Column:
        return F.substring(be(fnv1a64(F.encode(s, "UTF-8")), 8), 9 - size, size)

    # halves round away from zero, as the engine sizes have one decimal this decides nothing
    engine = F.least(F.round(engine_l * 10), F.lit(255.0)).cast("long")
    first = F.substring(F.concat(F.encode(fuel, "UTF-8"), zeros(1)), 1, 1)
    return F.concat(low(make, 4), low(model, 4), low(vehicle, 1), be(engine, 1), be(cylinders, 1), low(transmission, 2), first, zeros(1))


def key_hi(key: Column) -> Column:
    """The first 7 bytes as a LONG."""
    return F.conv(F.hex(F.substring(key, 1, 7)), 16, 10).cast("long")


def key_lo(key: Column) -> Column:
    """The bits of the last 8 bytes as a LONG."""
    high, low = (F.conv(F.hex(F.substring(key, at, 4)), 16, 10).cast("long") for at in (8, 12))
    return F.shiftleft(high, 32).bitwiseOR(low)


def source_of(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, 4, 4)), 16, 10).cast("long")


def event_bytes(key: Column, value: Column, ts: Column) -> Column:
    """An event in commit order: key, value, time."""
    return F.concat(key, be(value, 4), be(ts, 4))


def wire_bytes(key: Column, value: Column, ts: Column) -> Column:
    """An event in wire order: time, key, value."""
    return F.concat(be(ts, 4), key, be(value, 4))


def key_hash(key: Column) -> Column:
    return fnv1a64(key)


def routed_source(natural_key: Column, sources: int) -> Column:
    """The source that a natural key's events go to."""
    return unsigned_rem(mix64(natural_key.cast("long")), sources)


def partition_of(hashed: Column, partitions: int) -> Column:
    """The partition of a key hash: the first 8 bytes of its SHA-256, modulo partitions."""
    if partitions <= 1:
        return F.lit(0).cast("long")
    digest = F.sha2(be(hashed, 8), 256)
    high, low = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    return unsigned_rem(F.shiftleft(high, 32).bitwiseOR(low), partitions)


def hist_bucket(value: Column) -> Column:
    """0 for 0 and 1, else the place of the highest bit."""
    return F.greatest(F.length(F.bin(value.cast("long"))) - 1, F.lit(0)).cast("int")


def sketch_column(hashed: Column, row: int, columns: int = SKETCH_COLUMNS) -> Column:
    """The sketch's column of a 64-bit hash (or value) in a row."""
    seed = SKETCH_SEEDS[row] << 32 | SKETCH_SEEDS[row]
    return unsigned_rem(split_mix(hashed.bitwiseXOR(const(seed))), columns).cast("int")


def sketch_cells(hashed: Column, columns: int = SKETCH_COLUMNS) -> Column:
    """The (row, col) cells of a hash, one per row of the sketch."""
    return F.array(*(F.struct(F.lit(r).alias("row"), sketch_column(hashed, r, columns).alias("col")) for r in range(len(SKETCH_SEEDS))))


def sample_bucket(hashed: Column) -> Column:
    return mix64(hashed).bitwiseAND(F.lit(SAMPLE_BUCKETS - 1)).cast("int")


@dataclass(frozen=True)
class KeyMask:
    """Bits of a key that are asked for, and which of them count: over its low 8 and, if full, its high 7 bytes."""

    low: int
    low_mask: int = ALL_BITS
    high: int = 0
    high_mask: int = 0

    def matches(self, hi: Column | None = None, lo: Column | None = None) -> Column:
        """Comparison of two LONG columns; a whole mask is an equality that scans can push down."""
        hi, lo = hi if hi is not None else F.col("key_hi"), lo if lo is not None else F.col("key_lo")
        out = lo == const(self.low) if self.low_mask == ALL_BITS else lo.bitwiseAND(const(self.low_mask)) == const(self.low & self.low_mask)
        if self.high_mask:
            out = out & (hi.bitwiseAND(const(self.high_mask)) == const(self.high & self.high_mask))
        return out

    @property
    def free_bits(self) -> int:
        """Bits of the 64 that may be anything (of the 120, for patterns over whole keys)."""
        return 64 - self.low_mask.bit_count() + (56 - self.high_mask.bit_count() if self.high_mask or self.high else 0)


def exact_key(key: int) -> KeyMask:
    """The key whose low 8 bytes are these and whose high 7 are zero."""
    return KeyMask(key, ALL_BITS, 0, (1 << 56) - 1)


def _positions(pattern: str) -> tuple[str, int]:
    """The digits of a pattern and the bits of each."""
    p = pattern.strip().lower()
    if not p:
        raise ValueError("empty key pattern")
    bits = 1 if p.startswith("0b") else 4
    digits = p[2:] if p.startswith(("0b", "0x")) else p
    if not digits or any(d not in ("01" if bits == 1 else "0123456789abcdef") + "?*_" for d in digits):
        raise ValueError(f"bad key pattern {pattern!r}")
    return digits, bits


def compiled(pattern: str, width: int) -> tuple[int, int]:
    """(key, mask) of a hex or 0b pattern over width bits; ? * _ are wild, a short pattern is a prefix."""
    digits, bits = _positions(pattern)
    if len(digits) * bits > width:
        raise ValueError(f"key pattern {pattern!r} is longer than {width} bits")
    key = mask = 0
    for d in digits:
        key, mask = key << bits, mask << bits
        if d not in "?*_":
            key, mask = key | int(d, 16), mask | (1 << bits) - 1
    pad = width - len(digits) * bits
    return key << pad, mask << pad


def key_pattern(pattern: str) -> KeyMask:
    """A pattern over the low 8 bytes: up to 16 hex digits or 64 bits."""
    return KeyMask(*compiled(pattern, 64))


def full_key_pattern(pattern: str) -> KeyMask:
    """A pattern over all 15 bytes: up to 30 hex digits or 120 bits."""
    key, mask = compiled(pattern, 120)
    return KeyMask(key & ALL_BITS, mask & ALL_BITS, key >> 64, mask >> 64)


def prefix_matches(name: Column, prefix: str) -> Column:
    """Whether a string key begins with the prefix (a range that scans can push down)."""
    return name.startswith(prefix)


def checkpoint_leaf(tag: bytes, source_id: Column, index: Column, chain_hash: Column) -> Column:
    """A checkpoint's leaf: tag, source, index and hash in big-endian order."""
    return F.concat(F.unhex(F.lit(tag.hex())), be(source_id, 4), be(index, 8), chain_hash)
