"""Registered queries against their oracles on the smallest tables."""

import os

import pytest

from check_oracles import compare, duck

FOLDER = "/root/testdata/sf0.001"
NAMES = ["daily_bars", "rrg_series_split", "ema_series", "trend_signal", "volume_surge", "year_return", "transition_backtest",
         "transition_backtest_steps", "signal_backtest_steps",
         "page_links", "event_type_histogram", "supply_briefs", "root_causes", "reason_sentences"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_oracle(spark, name):
    from tidewheel.catalog import QUERIES

    q = QUERIES[name]
    assert compare(name, q.run(spark, FOLDER).toPandas(), duck(FOLDER).execute(q.sql).df()) is None
