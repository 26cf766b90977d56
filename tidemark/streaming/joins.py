"""Interval join of two streams with bounded state.

A row of the left stream meets those rows of the right one that have its key and whose time lies from ``low_s`` to ``high_s`` seconds after its own. Both sides
have a watermark; Spark drops a row from its state once no row in time can meet it any more, and late rows before the join.

Inner joins deal the times into bins as wide as the interval: a left row goes to the two bins (or one) its interval touches, a right row to its
own, so each pair is met once, and the state of a hot key is spread over the bins instead of being one task's. A left outer join cannot be cut like that, as a row
must know of all its partners: there a key's rows inside the watermark are one task's state. Its rows without partner come once
the watermark has passed the end of their interval. Rows without key or time meet nothing; an outer join never gives up a row without time.
A watermark begins at 1970, so rows before that are late from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    times: tuple[str, str],
    low_s: int,
    high_s: int,
    late: tuple[str, str],
    how: str = "inner",
) -> DataFrame:
    """Rows (left, right), each a struct of that stream's columns; ``times`` are timestamps, ``late`` how late rows may come."""
    if how not in ("inner", "left_outer"):
        raise ValueError(f"{how}: an interval join is inner or left_outer")
    if high_s < low_s:
        raise ValueError("the interval ends before it begins")
    binned, width = how == "inner", max(1, high_s - low_s) * 1_000_000
    sides = []
    for name, df, ts, lag in (("left", left, times[0], late[0]), ("right", right, times[1], late[1])):
        columns = [F.col(f"`{c}`") for c in df.columns]
        picked = [F.struct(*columns).alias(name), F.col(f"`{ts}`").alias(f"_{name}_at")]
        picked += [F.col(f"`{k}`").alias(f"_{name}_key{n}") for n, k in enumerate(keys)]
        if binned:
            micros = F.unix_micros(F.col(f"`{ts}`").cast("timestamp"))
            first, last = (micros + low_s * 1_000_000, micros + high_s * 1_000_000) if name == "left" else (micros, micros)
            picked.append(F.explode(F.sequence(_bin(first, width), _bin(last, width))).alias(f"_{name}_bin"))
        sides.append(df.withWatermark(ts, lag).select(*picked))
    met = [F.col(f"_left_key{n}") == F.col(f"_right_key{n}") for n in range(len(keys))]
    if binned:
        met.append(F.col("_left_bin") == F.col("_right_bin"))
    met.append(F.expr(f"_right_at >= _left_at + INTERVAL '{low_s}' SECOND AND _right_at <= _left_at + INTERVAL '{high_s}' SECOND"))
    condition = met[0]
    for part in met[1:]:
        condition &= part
    return sides[0].join(sides[1], condition, how).select("left", "right")


def _bin(micros: Column, width: int) -> Column:
    """Number of the bin a time lies in, also before 1970."""
    return F.call_function("div", micros - F.pmod(micros, F.lit(width)), F.lit(width))
