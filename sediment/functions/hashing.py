"""64-bit hashes as column expressions.

Spark's long arithmetic fails on overflow, so a 64-bit word is a struct of two 32-bit limbs (hi, lo), and products
are put together from limbs that fit in a long. Everything stays in generated code; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that hashes must share with existing data: FNV-1a's basis (this log's own, one digit short of the
# usual one) and prime, the second probe's seed, and the multipliers of MurmurHash3's 64-bit finaliser.
FNV_BASIS = 1469598103934665603
FNV_PRIME = 1099511628211
SECOND_SEED = 0x9E3779B97F4A7C15
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53

_M = 0xFFFFFFFF


def _word(hi: Column, lo: Column) -> Column:
    return F.struct(hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))


def word(value: int) -> Column:
    return _word(F.lit(value >> 32), F.lit(value & _M))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_M))


def bytes_of(text: Column) -> Column:
    """The bytes of a string or binary column, as an array of numbers."""
    digits = F.hex(text.cast("binary"))
    count = F.octet_length(text.cast("binary"))
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda at: _nibble(digits, 2 * at + 1) * 16 + _nibble(digits, 2 * at + 2))


def _nibble(digits: Column, at: Column) -> Column:
    code = F.ascii(F.substring(digits, at, F.lit(1)))
    return code - F.when(code >= 65, 55).otherwise(48)


def fnv1a(text: Column, seed: int = 0) -> Column:
    """FNV-1a of a column's bytes, its basis XORed with a seed, as a word. The prime is 2^40 + 435."""

    def step(h: Column, byte: Column) -> Column:
        return let(h["lo"].bitwiseXOR(byte.cast("long")), lambda lo: let(lo * 435, lambda t: _word(_low(h["hi"] * 435 + F.shiftrightunsigned(t, 32) + F.shiftleft(lo, 8)), _low(t))))

    return F.aggregate(bytes_of(text), word(FNV_BASIS ^ seed), step)


def _low_product(a: Column, b: int) -> Column:
    """The low 32 bits of a 32-bit limb times a 32-bit constant."""
    high = F.shiftrightunsigned(a, 16) * b
    return _low(a.bitwiseAND(F.lit(0xFFFF)) * b + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16))


def times(h: Column, constant: int) -> Column:
    """A word times a 64-bit constant, modulo 2^64."""
    high, low = constant >> 32, constant & _M
    x = h["lo"].bitwiseAND(F.lit(0xFFFF)) * low
    y = F.shiftrightunsigned(h["lo"], 16) * low
    total = x + F.shiftleft(y.bitwiseAND(F.lit(0xFFFF)), 16)
    return let(total, lambda t: _word(_low(F.shiftrightunsigned(t, 32) + F.shiftrightunsigned(y, 16) + _low_product(h["hi"], low) + _low_product(h["lo"], high)), _low(t)))


def _fold(h: Column) -> Column:
    """h ^ (h >> 33)."""
    return _word(h["hi"], h["lo"].bitwiseXOR(F.shiftrightunsigned(h["hi"], 1)))


def avalanche(h: Column) -> Column:
    """MurmurHash3's 64-bit finaliser of a word."""
    return let(h, lambda a: let(_fold(a), lambda b: let(times(b, MIX_1), lambda c: let(_fold(c), lambda d: let(times(d, MIX_2), _fold)))))


def number(h: Column) -> Column:
    """A word as an unsigned DECIMAL(20, 0)."""
    return (h["hi"].cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(20,0)") + h["lo"].cast("decimal(20,0)")).cast("decimal(20,0)")


def digits(h: Column) -> Column:
    """A word as its unsigned decimal digits."""
    return number(h).cast("string")
