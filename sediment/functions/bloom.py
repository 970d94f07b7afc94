"""Bloom filter arithmetic: 10 bits for each key (64 at least), five probes by double hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import hashing

BITS_PER_KEY, LEAST_BITS, PROBES = 10, 64, 5


def size(keys: Column) -> Column:
    """Bits of a filter for so many keys."""
    return F.greatest(keys.cast("long") * BITS_PER_KEY, F.lit(LEAST_BITS).cast("long"))


def probes(key: Column, bits: Column) -> Column:
    """The five bit positions of a key in a filter of so many bits: (h1 + i h2 mod 2^64) mod bits."""
    first, second = hashing.number(hashing.fnv1a(key)), hashing.number(hashing.fnv1a(key, hashing.SECOND_SEED))
    wrap = F.lit(str(1 << 64)).cast("decimal(20,0)")
    both = F.struct(first.cast("decimal(22,0)").alias("a"), second.cast("decimal(22,0)").alias("b"))
    steps = F.sequence(F.lit(0), F.lit(PROBES - 1))
    return hashing.let(both, lambda h: F.transform(steps, lambda i: (((h["a"] + h["b"] * i.cast("decimal(2,0)")) % wrap) % bits.cast("decimal(20,0)")).cast("long")))
