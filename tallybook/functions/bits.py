"""Exact unsigned 64-bit arithmetic on LONG columns (bit patterns), safe under ANSI overflow checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = 0xFFFFFFFF
#: Offset basis and prime of 64-bit FNV-1a; multipliers of the two finalisers.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
SPLIT = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def signed(x: int) -> int:
    """The LONG with the bits of an unsigned 64-bit number."""
    return x - (1 << 64) if x >= 1 << 63 else x


def const(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def _steps(x: Column, *steps) -> Column:
    """Applies steps one after another, each to one named value: nested columns would repeat the ones before."""
    for step in steps:
        x = F.transform(F.array(x), step)[0]
    return x


def shr(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n)


def low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW))


def mul64(x: Column, c: int) -> Column:
    """x times a constant. With halves x = h:l and the constant's 16-bit limbs c3..c0: l * (c1:c0) in full, plus the low halves of h * (c1:c0) and l * (c3:c2) on top."""
    c0, c1, c2, c3 = (c >> 16 * j & 0xFFFF for j in range(4))

    def times(y: Column, lo: int, hi: int) -> Column | None:
        """The low 32 bits (and more) of y, below 2^32, times hi:lo."""
        parts = ([y * F.lit(lo)] if lo else []) + ([F.shiftleft((y * F.lit(hi)).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)] if hi else [])
        return sum(parts[1:], parts[0]) if parts else None

    def whole(v: Column) -> Column:
        a, b = low32(v) * F.lit(c0), low32(v) * F.lit(c1)
        full = F.shiftleft(shr(a, 16) + b, 16).bitwiseOR(a.bitwiseAND(F.lit(0xFFFF).cast("long"))) if c1 else a
        cross = [t for t in (times(shr(v, 32), c0, c1), times(low32(v), c2, c3)) if t is not None]
        top = sum(cross[1:], cross[0])
        return F.struct(full.alias("full"), top.alias("top"))

    return _steps(x, whole, lambda s: F.shiftleft(low32(shr(s["full"], 32) + s["top"]), 32).bitwiseOR(low32(s["full"])))


def xorshift(x: Column, n: int) -> Column:
    return x.bitwiseXOR(shr(x, n))


def mix64(x: Column) -> Column:
    """The 33-bit shift and multiply finaliser."""
    return _steps(x, lambda v: xorshift(v, 33), lambda v: mul64(v, MIX[0]), lambda v: xorshift(v, 33), lambda v: mul64(v, MIX[1]), lambda v: xorshift(v, 33))


def split_mix(x: Column) -> Column:
    """The splitmix64 finaliser."""
    return _steps(x, lambda v: xorshift(v, 30), lambda v: mul64(v, SPLIT[0]), lambda v: xorshift(v, 27), lambda v: mul64(v, SPLIT[1]), lambda v: xorshift(v, 31))


def unsigned_rem(x: Column, m: int) -> Column:
    """The unsigned number modulo m (below 2^31)."""
    if m & (m - 1) == 0:
        return x.bitwiseAND(F.lit(m - 1).cast("long"))
    return _steps(x, lambda v: ((shr(v, 1) % F.lit(m)) * 2 + v.bitwiseAND(F.lit(1).cast("long"))) % F.lit(m))


def unsigned_decimal(x: Column) -> Column:
    """The unsigned number as DECIMAL(20,0)."""
    return F.when(x < 0, x.cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(x.cast("decimal(20,0)")).cast("decimal(20,0)")


def byte_values(b: Column) -> Column:
    """A binary's bytes as LONGs."""
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), lambda i: i <= F.length(b)), lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("long"))


def fnv1a64(b: Column) -> Column:
    """64-bit FNV-1a of a binary."""
    return F.aggregate(byte_values(b), const(FNV_OFFSET), lambda h, byte: mul64(h.bitwiseXOR(byte), FNV_PRIME))
