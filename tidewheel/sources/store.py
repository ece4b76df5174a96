"""A table of bars by month: a filter on time reads the months it needs, and a new day rewrites one month.

Beside the bars stands one row for each symbol with its last bar, so that the day of the data is known without reading bars.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.sources.bars import BAR_COLUMNS, BAR_SCHEMA
from tidewheel.sources.versions import PartTable, spread_by

MONTH = "month"


def month_of(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM")


@dataclass(frozen=True)
class BarStore:
    """Bars under ``path``, which all executors can reach. Each change is seen whole or not at all."""

    spark: SparkSession
    path: str

    def table(self) -> PartTable:
        return PartTable(self.spark, f"{self.path}/bars", BAR_SCHEMA, MONTH)

    def write(self, bars: DataFrame) -> BarStore:
        """Replace the months of ``bars``; other months stay. Bars are dealt by ranges of time and symbol, so a large month or symbol is spread."""
        dealt = bars.select(*BAR_COLUMNS, month_of(F.col("dt")).alias(MONTH))
        self.table().commit(spread_by(dealt, MONTH, "symbol", "dt"))
        return self

    def bars(self) -> DataFrame:
        """All bars."""
        return self.table().read().drop(MONTH)

    def as_of(self, benchmark: str) -> DataFrame:
        """One row: the day of the last benchmark bar. Months are looked through from the last one back until it has a bar."""
        months = sorted((m for m in self.table().values() if m), reverse=True)
        table = self.table().read()
        for month in months:
            found = table.filter((F.col(MONTH) == month) & (F.col("symbol") == benchmark)).agg(F.to_date(F.max("dt")).alias("as_of"))
            if found.first()[0] is not None:
                return found
        return table.filter(F.col("symbol") == benchmark).agg(F.to_date(F.max("dt")).alias("as_of"))

    def since(self, first: Column) -> DataFrame:
        """Bars from ``first`` on, a literal or a scalar subquery; months before it are not read."""
        return self.table().read().filter((F.col(MONTH) >= month_of(first)) & (F.col("dt") >= first)).drop(MONTH)

    def recent(self, benchmark: str, months: int = 3) -> DataFrame:
        """Bars of the last months before the day of the data."""
        return self.since(F.add_months(self.as_of(benchmark).scalar(), -months))

    def append(self, bars: DataFrame) -> BarStore:
        """Add new bars; of two of one symbol and time the new one stays. Only the months of the new ones are read and written."""
        new = bars.select(*BAR_COLUMNS)
        held = [r[0] for r in new.select(month_of(F.col("dt"))).distinct().collect()]
        kept = self.table().read().filter(F.col(MONTH).isin(held)).drop(MONTH).join(new.select("symbol", "dt"), ["symbol", "dt"], "left_anti")
        return self.write(kept.select(*BAR_COLUMNS).unionByName(new))
