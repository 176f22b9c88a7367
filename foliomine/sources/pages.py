"""Page-range specifications such as ``1-50,60``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_list(spec: Column, n: Column, distinct: bool = True) -> Column:
    """The pages of a specification that lie in 1..n, sorted and distinct or as written; an empty one gives all."""
    parts = F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda x: F.trim(x)), lambda p: p != "")
    ends = lambda p: F.transform(F.split(p, "-"), lambda x: F.trim(x).try_cast("int"))
    runs = F.transform(parts, lambda p: F.when(ends(p)[0] <= F.element_at(ends(p), -1), F.sequence(ends(p)[0], F.element_at(ends(p), -1))).otherwise(F.array().cast("array<int>")))
    pages = F.filter(F.flatten(runs), lambda x: (x >= 1) & (x <= n))
    pages = F.array_sort(F.array_distinct(pages)) if distinct else pages
    every = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(parts) == 0, every).otherwise(pages)
