"""Variable-byte integers: seven bits a byte, the lowest first, the high bit set while more follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vbyte_length(value: Column) -> Column:
    """Bytes of a non-negative long, 1 to 9."""
    out = F.when(value < F.lit(1 << 7), 1)
    for size in range(2, 9):
        out = out.when(value < F.lit(1 << 7 * size), size)
    return out.otherwise(9).cast("long")


def vbyte_hex(value: Column) -> Column:
    """The bytes as upper-case hexadecimal digits."""
    last = vbyte_length(value).cast("int") - 1

    def byte(i: Column) -> Column:
        group = F.call_function("shiftright", value, (i * 7).cast("int")).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(group.bitwiseOR(F.when(i < last, 128).otherwise(0).cast("long"))), 2, "0")

    return F.array_join(F.transform(F.sequence(F.lit(0), last), byte), "")


def vbyte_value(digits: Column) -> Column:
    """The long that vbyte_hex gave these digits for."""
    places = F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int"))
    return F.aggregate(
        places,
        F.lit(0).cast("long"),
        lambda total, i: total.bitwiseOR(F.call_function("shiftleft", F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(127)), (i * 7).cast("int"))),
    )
