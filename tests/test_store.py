"""Bars by month and tables in versions: what is read, what is rewritten, and what a job that ends half-way leaves."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewheel import session
from tidewheel.sources import bars, tables, versions
from tidewheel.sources.store import BarStore
from tidewheel.streaming.refresh import refresh_stream


def _bars(spark, rows):
    return spark.createDataFrame(rows, "symbol string, day string, price double").select(
        "symbol", F.to_timestamp("day").alias("dt"), *[F.col("price").alias(c) for c in bars.PRICES], F.lit(1).cast("bigint").alias("volume"))


def _days(count):
    return [(s, f"2023-{1 + k // 28:02d}-{1 + k % 28:02d}", float(k)) for k in range(count) for s in ("ALL", "a/b c", "é")]


def _files(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def _closes(df):
    return sorted((r.symbol, str(r.dt)[:10], r.close) for r in df.collect())


def test_recent_bars_read_their_months_only(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "store")).write(_bars(spark, [*_days(28 * 9), ("late", "2023-10-05", 1.0)]))
    assert store.as_of("ALL").first()[0] == date(2023, 9, 28)
    recent = store.recent("ALL", 3)
    assert _closes(recent) == sorted([r for r in _days(28 * 9) if r[1] >= "2023-06-28"] + [("late", "2023-10-05", 1.0)])
    assert {f.split("month=")[1][:7] for f in _files(recent)} == {"2023-06", "2023-07", "2023-08", "2023-09", "2023-10"}
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "month#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    # Files of older months are not opened: broken ones do no harm.
    for file in (tmp_path / "store").glob("bars/data/version=1/month=2023-0[1-5]/*.parquet"):
        file.write_bytes(b"no parquet")
    assert store.recent("ALL", 3).count() == recent.count()
    with pytest.raises(Exception, match="2023-0[1-5]"):
        store.bars().count()


def test_a_new_day_rewrites_its_month(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "store")).write(_bars(spark, _days(28 * 3)))
    before = _files(store.bars())
    store.append(_bars(spark, [("ALL", "2023-03-28", 7.5), ("ALL", "2023-03-29", 8.5), ("new", "2023-04-01", 1.0)]))
    same = {f for f in before if "month=2023-03" not in f}
    assert same == {f for f in _files(store.bars()) if "month=2023-0" in f and "version=1/" in f}
    want = [r for r in _days(28 * 3) if r[:2] != ("ALL", "2023-03-28")]
    assert _closes(store.bars()) == sorted([*want, ("ALL", "2023-03-28", 7.5), ("ALL", "2023-03-29", 8.5), ("new", "2023-04-01", 1.0)])
    assert BarStore(spark, str(tmp_path / "none")).bars().count() == 0


def test_boards_aggregate_recent_orders_only(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(0, "WEST")], "r_regionkey int, r_name string").write.parquet(f"{folder}/region.parquet")
    spark.createDataFrame([(5, "LAND", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(1, 5), (2, 77)], "c_custkey long, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    # The last order has a customer without a nation, so it is no bar and does not set the day.
    orders = [(k, 1, 10.0 + k, f"2023-{1 + k:02d}-15 10:00:00") for k in range(9)] + [(90, 2, 1.0, "2025-01-01 00:00:00")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, d string").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.to_timestamp_ntz("d").alias("o_orderdate")).write.parquet(f"{folder}/orders.parquet")
    recent = tables.recent_order_bars(spark, folder)
    got = {(r.symbol, str(r.dt)[:10]): r.close for r in recent.collect()}
    assert got == {(s, f"2023-{m:02d}-15"): 9.0 + m for s in ("ALL", "WEST", "LAND") for m in (6, 7, 8, 9)}
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" in plan.split("PushedFilters", 1)[1] and "GreaterThanOrEqual(o_orderdate" in plan or "subquery" in plan.lower()


def test_a_job_that_ends_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    table = versions.bars_by_symbol(spark, str(tmp_path / "t"))
    assert table.read().count() == 0 and table.values() == []
    table.commit(_bars(spark, [("A", "2024-01-01", 1.0), ("B/x y", "2024-01-01", 2.0)]))
    reader = table.read()

    def ends(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(versions, "put_text", ends)
    with pytest.raises(RuntimeError):
        table.commit(_bars(spark, [("A", "2024-01-02", 9.0), ("C", "2024-01-02", 9.0)]), "s", 0)
    assert _closes(table.read()) == [("A", "2024-01-01", 1.0), ("B/x y", "2024-01-01", 2.0)]
    monkeypatch.undo()
    table.commit(_bars(spark, [("A", "2024-01-03", 3.0)]), "s", 0)  # the retry writes over what the lost job left
    want = [("A", "2024-01-03", 3.0), ("B/x y", "2024-01-01", 2.0)]
    assert _closes(table.read()) == want and sorted(table.values()) == ["A", "B/x y"]
    assert table.commit(_bars(spark, [("A", "2024-01-04", 4.0)]), "s", 0).version == 2 and _closes(table.read()) == want
    assert _closes(reader) == [("A", "2024-01-01", 1.0), ("B/x y", "2024-01-01", 2.0)]  # a reader keeps the version it began with
    pruned = table.read().filter("symbol = 'A'")
    assert len(_files(pruned)) == 1
    table.vacuum()
    assert _closes(table.read()) == want and len(session.list_names(spark, f"{table.path}/manifests")) == 1
    assert not [n for n in session.list_names(spark, f"{table.path}/data/version=1") if n == "symbol=A"]


def test_refresh_into_versions(spark, tmp_path, monkeypatch):
    inbox, table = str(tmp_path / "inbox"), versions.bars_by_symbol(spark, str(tmp_path / "t"))
    wanted = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    table.commit(_bars(spark, [("A", "2024-01-01", 1.0), ("C", "2024-01-09", 3.0)]))
    _bars(spark, [("A", "2024-01-10", 9.0), ("B", "2024-01-10", 5.0), ("C", "2024-01-10", 9.0)]).write.parquet(inbox)
    args = (wanted, date(2024, 1, 10), "2010-01-01", str(tmp_path / "state"))

    def ends(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(versions, "put_text", ends)
    with pytest.raises(Exception, match="lost"):
        refresh_stream(spark, inbox, table, *args)
    assert _closes(table.read()) == [("A", "2024-01-01", 1.0), ("C", "2024-01-09", 3.0)]
    monkeypatch.undo()
    for _ in range(2):
        refresh_stream(spark, inbox, table, *args)
        assert _closes(table.read()) == [("A", "2024-01-10", 9.0), ("B", "2024-01-10", 5.0), ("C", "2024-01-09", 3.0)]


def test_release_removes_what_was_written(spark, monkeypatch):
    monkeypatch.setattr(session, "_TAKEN", {})
    path = session.materialize(spark.range(3), "gone").inputFiles()[0].rpartition("/")[0]
    assert session.list_names(spark, path)
    assert session.release(spark) == 1 and session.list_names(spark, path) == [] and session.release(spark) == 0
