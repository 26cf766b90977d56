"""Resource quantities such as 100m, 233Ki or 2G."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units in ascending order, decimal then binary.
UNITS = ["n", "u", "m", "k", "M", "G", "T", "P", "E", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei"]
DEFAULT_UNIT = "k"

_K = UNITS.index("k")
_KI = UNITS.index("Ki")


def parse(text: Column) -> Column:
    """struct(value, unit); a number without a unit has unit k, malformed text gives NULL."""
    number = F.rtrim(text, F.lit("".join(sorted(set("".join(UNITS))))))
    unit = F.substr(text, F.length(number) + 1)
    value = F.when(unit.isin(["", *UNITS]), number.try_cast("double"))
    named = F.when(unit == "", DEFAULT_UNIT).otherwise(unit)
    return F.when(value.isNotNull(), F.struct(value.alias("value"), named.alias("unit")))


def _times(value: Column, unit: int, goal: int, exact: bool) -> Column:
    """``value`` of one known unit in another; both are positions in ``UNITS``."""
    if (unit < _KI) == (goal < _KI):
        return value * F.lit((1000.0 if unit < _KI else 1024.0) ** (unit - goal))
    if unit < _KI:
        if exact:
            return value * F.lit(1000.0 ** (unit - _K + 1)) / F.lit(1024.0 ** (goal - _KI + 1))
        return value * F.lit(1.024) * F.lit(1000.0 ** ((goal - _KI) - (unit - _K)))
    if exact:
        return value * F.lit(1024.0 ** (unit - _KI + 1)) / F.lit(1000.0 ** (goal - _K + 1))
    return value / F.lit(1.024) * F.lit(1000.0 ** ((unit - _KI) - (goal - _K)))


def convert(value: Column, unit: Column, target: str, exact: bool = False) -> Column:
    """``value`` expressed in ``target``.

    Between the decimal and the binary family the factor is 1.024 per family and 1000 per step,
    which is what platform figures use; ``exact`` takes the true powers instead.
    """
    goal = UNITS.index(target)
    out = F.when(unit == target, value)
    for position, name in enumerate(UNITS):
        if position != goal:
            out = out.when(unit == name, _times(value, position, goal, exact))
    return out
