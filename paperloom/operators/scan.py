"""Segmented prefix scans: running values over the ordered rows of a key that may be larger than a task.

Rows of a very common key are cut into segments by quantiles of their first
order column, so a window sorts one segment and not the key. One summary a
segment (its last row, its last value, its sum) is then scanned in a small
second pass, and every segment takes what the ones before it hand on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Quantiles that the segments of a key are chosen from.
QUANTILES = 1000


class Scan:
    """Rows with running values per key, in the order of `order`; each method adds a column and returns the scan.

    With `cut`, keys of over `cut` rows and over a ten-thousandth of all rows
    are cut into segments of about that many; there are under 20,000 segments of
    such keys, whose bounds and summaries are broadcast. Rows that agree in the
    first order column (a whole number or a time, not null) stay together, and a
    null key is not cut. Without `cut` it is a window per key. Nothing runs
    before the result is read.
    """

    def __init__(self, rows: DataFrame, key: str, order: list[str], cut: int | None = None):
        self.key, self.order, self.cut, self.names = key, order, cut, rows.columns
        self.rows = rows if cut is None else self._segmented(rows, cut)
        self.keys = [key] if cut is None else [key, "__segment"]
        self.window = Window.partitionBy(*self.keys).orderBy(*order)
        self.upto = self.window.rowsBetween(Window.unboundedPreceding, 0)

    def _place(self, rows: DataFrame) -> Column:
        by = F.col(self.order[0])
        return F.unix_micros(by.cast("timestamp")) if isinstance(rows.schema[self.order[0]].dataType, (T.TimestampType, T.TimestampNTZType)) else by.cast("bigint")

    def _segmented(self, rows: DataFrame, cut: int) -> DataFrame:
        counts = rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("__n"))
        share = F.greatest(F.lit(cut), F.expr("cast(__total div 10000 as bigint)"))
        total = F.broadcast(counts.agg(F.sum("__n").alias("__total")))
        long = counts.join(total).filter(F.col("__n") > share).select(self.key, F.ceil(F.col("__n") / share).cast("int").alias("__pieces"))
        quantiles = F.percentile_approx(self._place(rows), [k / QUANTILES for k in range(1, QUANTILES)], 10 * QUANTILES)
        found = rows.join(F.broadcast(long), self.key).groupBy(self.key).agg(quantiles.alias("__q"), F.first("__pieces").alias("__pieces"))
        bounds = F.array_distinct(F.expr(f"transform(sequence(1, least(__pieces, {QUANTILES}) - 1), k -> __q[k * {QUANTILES} div least(__pieces, {QUANTILES}) - 1])"))
        cut_at = F.broadcast(found.select(self.key, bounds.alias("__bounds")))
        segment = F.when(F.col("__bounds").isNull(), 0).otherwise(F.size(F.filter("__bounds", lambda b: b < self._place(rows))))
        return rows.join(cut_at, self.key, "left").withColumn("__segment", segment).withColumn("__long", F.col("__bounds").isNotNull()).drop("__bounds")

    def _handed_on(self, summary: Column, taken: Column) -> DataFrame:
        """(key, __segment, __carry): what the segments before hand on; `summary` is an aggregate, `taken` a window value over `__own` and `__before`."""
        parts = self.rows.filter("__long").groupBy(*self.keys).agg(summary.alias("__own"))
        return F.broadcast(parts.select(*self.keys, taken.alias("__carry")))

    def _before(self) -> Window:
        return Window.partitionBy(self.key).orderBy("__segment")

    def lag(self, **columns: Column) -> Scan:
        """The values that columns have in the row before; null in a key's first row."""
        row = F.struct(*(c.alias(name) for name, c in columns.items()))
        value = F.lag(row).over(self.window)
        if self.cut is not None:
            last = self._handed_on(F.max_by(row, F.struct(*self.order)), F.lag("__own").over(self._before()))
            self.rows = self.rows.withColumn("__value", value).join(last, self.keys, "left").withColumn("__value", F.coalesce("__value", "__carry")).drop("__carry")
        else:
            self.rows = self.rows.withColumn("__value", value)
        for name in columns:
            self.rows = self.rows.withColumn(name, F.col(f"__value.{name}"))
        self.rows = self.rows.drop("__value")
        self.names = [*self.names, *columns]
        return self

    def last(self, name: str, column: Column) -> Scan:
        """The last value of the column, at or before each row, that is not null."""
        self.rows = self.rows.withColumn("__value", column)
        value = F.last("__value", ignorenulls=True).over(self.upto)
        if self.cut is not None:
            own = F.max_by(F.struct("__value"), F.when(F.col("__value").isNotNull(), F.struct(*self.order)))
            carry = self._handed_on(own, F.last("__own", ignorenulls=True).over(self._before().rowsBetween(Window.unboundedPreceding, -1)))
            self.rows = self.rows.withColumn("__value", value).join(carry, self.keys, "left").withColumn("__value", F.coalesce("__value", F.col("__carry.__value"))).drop("__carry")
        else:
            self.rows = self.rows.withColumn("__value", value)
        self.rows = self.rows.withColumn(name, F.col("__value")).drop("__value")
        self.names = [*(n for n in self.names if n != name), name]
        return self

    def sum(self, name: str, column: Column) -> Scan:
        """The sum of the column up to and with each row."""
        self.rows = self.rows.withColumn("__value", column)
        value = F.sum("__value").over(self.upto)
        if self.cut is not None:
            carry = self._handed_on(F.sum("__value"), F.sum("__own").over(self._before().rowsBetween(Window.unboundedPreceding, -1)))
            self.rows = self.rows.withColumn("__value", value).join(carry, self.keys, "left").withColumn("__value", F.coalesce(F.col("__value") + F.col("__carry"), "__value", "__carry")).drop("__carry")
        else:
            self.rows = self.rows.withColumn("__value", value)
        self.rows = self.rows.withColumn(name, F.col("__value")).drop("__value")
        self.names = [*(n for n in self.names if n != name), name]
        return self

    def derive(self, name: str, column: Column) -> Scan:
        """A column of each row alone."""
        self.rows = self.rows.withColumn(name, column)
        self.names = [*(n for n in self.names if n != name), name]
        return self

    def result(self) -> DataFrame:
        """The rows with the added columns."""
        return self.rows.select(*self.names)
