"""A portable pseudo-random sort key for samples, caps and splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BITS = 32
_MASK = (1 << KEY_BITS) - 1
_MIX = 73244475


def shuffle_key(identifier: str, seed: int = 42) -> Column:
    """A 32-bit mix of an integer identifier.

    Plain integer arithmetic (xor, shift, multiply), so that any SQL engine
    gives the same key and a sample does not depend on partitioning. It is a
    bijection on 32 bits: identifiers below 2**32 never collide.
    """
    x = F.col(identifier).cast("long")
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 32)).bitwiseXOR(F.lit(seed)).bitwiseAND(F.lit(_MASK))
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(_MIX)).bitwiseAND(F.lit(_MASK))
    return x.bitwiseXOR(F.shiftright(x, 16))
