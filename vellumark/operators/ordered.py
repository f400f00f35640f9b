"""Running values over rows in order, with no task that has a whole key.

Rows are range-sorted by key and order, so a key of any size is spread. A running value is a window inside a partition plus what the key's earlier partitions
carry over. At most one key reaches into a partition from the one before, so the carried table has a row a partition at most: that bounds its broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumark.plans.checkpoints import cut

PART, AT = "__part", "__at"


class Ordered:
    """``df`` with rows of each ``key`` (None: all rows are one) in ``order`` (columns that make it total; nulls first)."""

    def __init__(self, df: DataFrame, key: str | None, order: list[str]) -> None:
        self.key = key or "__all"
        df = df if key else df.withColumn("__all", F.lit(0))
        by = [key, *order] if key else order
        rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
        self.df = cut(rows.withColumn(PART, F.spark_partition_id()).withColumn(AT, F.monotonically_increasing_id()))

    def _with(self, df: DataFrame) -> Ordered:
        out = object.__new__(Ordered)
        out.key, out.df = self.key, df
        return out

    def _carried(self, totals: dict[str, Column], chain, backward: bool = False) -> DataFrame:
        """Of each partition that a key reaches into: what the key's partitions before it (behind it) come to."""
        per_part = self.df.groupBy(self.key, PART).agg(*[c.alias(n) for n, c in totals.items()])
        w = Window.partitionBy(self.key).orderBy(F.desc(PART) if backward else F.asc(PART)).rowsBetween(Window.unboundedPreceding, -1)
        out = per_part.select(F.col(self.key).alias("__k"), F.col(PART).alias("__p"), F.count(F.lit(1)).over(w).alias("__n"), *[chain(n).over(w).alias(f"__c_{n}") for n in totals])
        return out.where("__n > 0").drop("__n")

    def _joined(self, df: DataFrame, carried: DataFrame) -> DataFrame:
        return df.join(F.broadcast(carried), (F.col(PART) == F.col("__p")) & F.col(self.key).eqNullSafe(F.col("__k")), "left").drop("__k", "__p")

    def _local(self, backward: bool, last: int):
        return Window.partitionBy(PART, self.key).orderBy(F.desc(AT) if backward else F.asc(AT)).rowsBetween(Window.unboundedPreceding, last)

    def _add(self, values: dict[str, Column], partial, chain, combine, *, backward: bool = False, strict: bool = False) -> Ordered:
        carried = self._carried({n: partial(n, v) for n, v in values.items()}, chain, backward)
        w = self._local(backward, -1 if strict else 0)
        here = self.df.select("*", *[(partial(n, v, True)).over(w).alias(f"__l_{n}") for n, v in values.items()])
        out = self._joined(here, carried)
        out = out.select(*self.df.columns, *[combine(F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n in values])
        return self._with(out)

    def sums(self, values: dict[str, Column], strict: bool = False) -> Ordered:
        """Running sums (longs), this row's included unless ``strict``."""
        zero = F.lit(0).cast("long")
        return self._add(values, lambda n, v, local=False: F.sum(v), lambda n: F.sum(n), lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero), strict=strict)

    def most(self, values: dict[str, Column], strict: bool = False) -> Ordered:
        """Running maxima; nulls don't count."""
        return self._add(values, lambda n, v, local=False: F.max(v), lambda n: F.max(n), lambda a, b: F.greatest(a, b), strict=strict)

    def before(self, values: dict[str, Column], strict: bool = True) -> Ordered:
        """The last value before the row (or at it, unless ``strict``) that isn't null."""

        def partial(n: str, v: Column, local: bool = False) -> Column:
            return F.last(v, True) if local else F.max_by(v, F.when(v.isNotNull(), F.col(AT)))

        return self._add(values, partial, lambda n: F.last(n, True), lambda a, b: F.coalesce(a, b), strict=strict)

    def after(self, values: dict[str, Column], strict: bool = True) -> Ordered:
        """The first value after the row that isn't null."""

        def partial(n: str, v: Column, local: bool = False) -> Column:
            return F.last(v, True) if local else F.min_by(v, F.when(v.isNotNull(), F.col(AT)))

        return self._add(values, partial, lambda n: F.last(n, True), lambda a, b: F.coalesce(a, b), backward=True, strict=strict)

    def settled(self) -> Ordered:
        """The same rows, with what was added written down."""
        return self._with(cut(self.df))

    def rows(self) -> DataFrame:
        return self.df.drop(PART, AT, "__all")
