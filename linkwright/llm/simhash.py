"""SimHash votes in SQL functions alone.

A hash of 64 bits votes on 64 bits at once: sum((h >>> j) & MASK) counts bit j in its low and bit j + 32
in its high half, so 32 sums hold 64 counters. A counter stays below 2**32 as its votes can't exceed the
code points of a string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 0x0000000100000001
LOW = 0xFFFFFFFF
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; texts of ASCII alone take the faster lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The runs of characters outside space and \\x09-\\x0D; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def positions(words: Column, width: int) -> Column:
    """Start positions of the shingles: one, of all words, if there are fewer than width (also where there are none)."""
    return F.sequence(F.lit(0), F.greatest(F.size(words) - F.lit(width), F.lit(0)))


def vote(df: DataFrame, keys: Sequence[str], hashes: Sequence[Column], weight: Column) -> DataFrame:
    """keys and fp0, fp1, ... (long): a bit is set if the weight of the hashes that have it exceeds half of all weight."""
    sums = [F.coalesce(F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(MASK)) * weight), F.lit(0)).alias(f"s{i}_{j}") for i, h in enumerate(hashes) for j in range(32)]
    counted = df.groupBy(*keys).agg(F.coalesce(F.sum(F.when(hashes[0].isNotNull(), weight)), F.lit(0)).alias("total"), *sums)
    out = []
    for i in range(len(hashes)):
        bits = None
        for j in range(32):
            for half, count in ((0, F.col(f"s{i}_{j}").bitwiseAND(F.lit(LOW))), (32, F.shiftrightunsigned(F.col(f"s{i}_{j}"), 32))):
                value = 1 << (j + half)
                bit = F.when(count * 2 > F.col("total"), F.lit(value - (1 << 64) if value >> 63 else value)).otherwise(F.lit(0).cast("long"))
                bits = bit if bits is None else bits.bitwiseOR(bit)
        out.append(bits.alias(f"fp{i}"))
    return counted.select(*keys, *out)


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
