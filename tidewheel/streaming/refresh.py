"""The refresh as a stream: landed histories replace stale symbols of the stored table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.session import materialize, new_path
from tidewheel.sources.backtests import BacktestStore
from tidewheel.sources.bars import BAR_SCHEMA, fresh_history, freshness, read_bars, write_symbols
from tidewheel.sources.versions import PartTable, spread_by


def refresh_stream(spark: SparkSession, inbox: str, target: str | PartTable, wanted: DataFrame, as_of: date, since: str,
                   checkpoint: str | None = None, backtests: Sequence[BacktestStore] = ()) -> None:
    """Process everything landed since the last run and stop.

    One batch holds the full history of its symbols (``inbox`` gets whole
    histories). Freshness is read from the stored table at the start of each
    batch. A repeated batch finds what it has written fresh and leaves it, and
    writes whatever it had not; so the table is the same after a retry.

    A ``target`` in versions (``bars_by_symbol``) takes each batch whole or not at all, and a batch of this checkpoint
    once; in a plain folder the symbols of a batch are replaced one after the other. After a batch the ``backtests`` follow the table's
    histories of the batch's symbols; a batch that comes again finds them as they should be.
    """
    state = checkpoint or new_path(spark, "refresh-state")

    def replace_stale(batch: DataFrame, batch_id: int) -> None:
        if isinstance(target, PartTable):
            stale = freshness(target.read(), wanted, F.lit(as_of)).filter("stale").select("symbol")
            target.commit(spread_by(fresh_history(batch, stale, since), "symbol", "dt"), state, batch_id)
            for store in backtests:
                store.refresh(target.read(), batch.select("symbol").distinct(), state, batch_id)
            return
        # The list is written out first: the partitions it was read from get overwritten below.
        status = freshness(read_bars(spark, target), wanted, F.lit(as_of))
        stale = materialize(status.filter("stale").select("symbol"), "stale")
        write_symbols(fresh_history(batch, stale, since), target)
        for store in backtests:
            store.refresh(read_bars(spark, target), batch.select("symbol").distinct(), state, batch_id)

    query = (
        spark.readStream.schema(BAR_SCHEMA).parquet(inbox)
        .writeStream.foreachBatch(replace_stale)
        .option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
