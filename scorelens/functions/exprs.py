"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_or_name(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_prefix(c, n_hex: int = 8) -> Column:
    """First ``n_hex`` hex digits of md5 of a string column (lower-case hex)."""
    return F.substring(F.md5(col_or_name(c)), 1, n_hex)


def hex_to_long(c) -> Column:
    """Unsigned value of a hex string of at most 15 digits."""
    return F.conv(col_or_name(c), 16, 10).cast("bigint")


def bit_of(label_hash, n_bits: int) -> Column:
    """Slot of an 8-hex-digit identifier in a fingerprint of ``n_bits`` slots."""
    return F.pmod(hex_to_long(label_hash), F.lit(n_bits)).cast("bigint")


def safe_div(num, den, default=0.0) -> Column:
    """num / den, ``default`` when the denominator is 0 (or null)."""
    num, den = col_or_name(num), col_or_name(den)
    return F.when(den.isNull() | (den == 0), F.lit(default)).otherwise(num.cast("double") / den)


def r6(c, name: str | None = None) -> Column:
    """Round to 6 places (the precision every oracle comparison uses)."""
    out = F.round(col_or_name(c).cast("double"), 6)
    return out.alias(name) if name else out


def is_blank(c) -> Column:
    c = col_or_name(c)
    return c.isNull() | ~c.rlike(r"\S")


def count_char(c, ch: str) -> Column:
    """Occurrences of a single character in a string column."""
    c = col_or_name(c)
    return (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("bigint")
