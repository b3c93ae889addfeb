"""Column expressions shared by the grid operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

B = ["source", "block"]
BC = [*B, "chan"]
BT = [*B, "t"]

def along_t() -> WindowSpec:
    """Along time within a channel. One exchange on source and block serves this window and ``along_c``."""
    return Window.partitionBy(*BC).orderBy("t")


def along_c() -> WindowSpec:
    """Along channels within a time."""
    return Window.partitionBy(*BT).orderBy("chan")


def rounded(*names: str, digits: int = 6) -> list[Column]:
    """Columns of the names, rounded; a negative zero becomes zero."""
    return [(F.round(n, digits) + F.lit(0.0)).alias(n) for n in names]


def draw(seed: int, *names: str | Column) -> Column:
    """A repeatable number from 0 to 2**32 - 1 out of the seed and the columns' text."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(n) if isinstance(n, str) else n).cast("string") for n in names])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def lower_median(c: str) -> Column:
    """The element at index (n - 1) div 2 of the sorted values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")


def tukey(q1: Column, q3: Column, v: Column, q: float) -> Column:
    """Outside the quartiles by q times their distance."""
    return (v < q1 - q * (q3 - q1)) | (v > q3 + q * (q3 - q1))
