"""Steps on values: text, dates, lists and numbers, each one a built-in column expression."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _list(x: Any) -> Column:
    return x if isinstance(x, Column) else F.array(*[F.lit(v) for v in x])


#: Step name -> expression of the current value and the step's arguments. A null value stays null.
VALUE_STEPS: dict[str, Callable[..., Column]] = {
    # text
    "concat": lambda x, *parts: F.concat(x, *[F.lit(p) for p in parts]),
    "substring": lambda x, a, b=None: F.substring(x, a + 1, (1 << 30) if b is None else max(0, b - a)),
    "split": lambda x, sep: F.split(x, "\\Q" + sep + "\\E"),
    "replace": lambda x, old, new: F.replace(x, F.lit(old), F.lit(new)),
    "toUpper": lambda x: F.upper(x),
    "toLower": lambda x: F.lower(x),
    "trim": lambda x: F.trim(x),
    "lTrim": lambda x: F.ltrim(x),
    "rTrim": lambda x: F.rtrim(x),
    "length": lambda x: F.length(x),
    "asString": lambda x: x.cast("string"),
    "asNumber": lambda x: x.try_cast("double"),
    "format": lambda x, pattern: F.format_string(pattern, x),
    # dates
    "asDate": lambda x: F.to_timestamp(x),
    "dateAdd": lambda x, unit, n: F.timestamp_add(unit, F.lit(n), x),
    "dateDiff": lambda x, other: F.timestamp_diff("SECOND", F.to_timestamp(F.lit(other)) if isinstance(other, str) else other, x),
    # lists; the set operations return each element once, in ascending order
    "combine": lambda x, other: F.concat(x, _list(other)),
    "merge": lambda x, other: F.array_sort(F.array_union(x, _list(other))),
    "difference": lambda x, other: F.array_sort(F.array_except(x, _list(other))),
    "intersect": lambda x, other: F.array_sort(F.array_intersect(x, _list(other))),
    "disjunct": lambda x, other: F.array_sort(F.array_union(F.array_except(x, _list(other)), F.array_except(_list(other), x))),
    "product": lambda x, other: F.flatten(F.transform(x, lambda a: F.transform(_list(other), lambda b: F.array(a, b)))),
    "conjoin": lambda x, sep: F.array_join(x, sep),
    "reverse": lambda x: F.reverse(x),
    "index": lambda x: F.transform(x, lambda v, i: F.struct(v.alias("value"), i.alias("index"))),
    "sizeOf": lambda x: F.size(x),
    # numbers
    "abs": lambda x: F.abs(x),
    "ceil": lambda x: F.ceil(x),
    "floor": lambda x: F.floor(x),
    "sqrt": lambda x: F.sqrt(x),
    "power": lambda x, n: F.pow(x, F.lit(n)),
    "signum": lambda x: F.signum(x),
}
