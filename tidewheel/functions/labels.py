"""Labels, scores and the reason sentence, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.functions.numbers import finite

# Points, thresholds and label texts.
SECTOR_POINTS = {"Leading": 4, "Improving": 3, "Weakening": 1, "Lagging": 0}
BENCH_POINTS = {"Leading": 3, "Improving": 2, "Weakening": 1, "Lagging": 0}
PEER_POINTS = {"Leading": 2, "Improving": 2, "Weakening": 1, "Lagging": 0}
LEVEL_POINTS = {"STRONG": 4, "ALERT": 2, "WATCH": 1, "NONE": 0}
BUY_POINTS = 3
TREND_NAME = "StealthTrail"
SECTOR_ALERTS = [(12, "ROTATING ★★★"), (9, "ROTATING ★★"), (6, "WATCH ★")]
SECTOR_AVOID = "AVOID"
STOCK_RECS = [(12, "★★★ STRONG BUY"), (9, "★★  BUY"), (6, "★   WATCH")]
STOCK_AVOID = "    AVOID"
CONFIRM_LEVELS = [(4, "STRONG"), (3, "ALERT"), (2, "WATCH")]
DRILL_SCORE = 6
RSI_THRESHOLD = 45


def banded(value: Column, bands: list[tuple[int, str]], otherwise: str) -> Column:
    """First label whose threshold ``value`` reaches."""
    (threshold, label), *rest = bands
    out = F.when(value >= threshold, label)
    for threshold, label in rest:
        out = out.when(value >= threshold, label)
    return out.otherwise(otherwise)


def points(label: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, value in table.items():
        if value:
            out = F.when(label == name, value).otherwise(out)
    return out


def ticker_label(ticker: Column, name: Column) -> Column:
    return F.when(F.length(name) > 0, F.concat(ticker, F.lit(" ("), name, F.lit(")"))).otherwise(ticker)


def quadrant(ratio: Column, mom: Column) -> Column:
    """Quadrant around 100; a missing value falls through to Lagging."""
    ratio, mom = finite(ratio), finite(mom)
    return (
        F.when((ratio >= 100) & (mom >= 100), "Leading")
        .when((ratio >= 100) & (mom < 100), "Weakening")
        .when((ratio < 100) & (mom >= 100), "Improving")
        .otherwise("Lagging")
    )


def confirm_level(signals: Column) -> Column:
    return banded(signals, CONFIRM_LEVELS, "NONE")


def sector_score(quad: Column, signal: Column, level: Column, signals: Column) -> Column:
    return (points(quad, SECTOR_POINTS) + F.when(signal == "BUY", BUY_POINTS).otherwise(0)
            + points(level, LEVEL_POINTS) + signals)


def stock_score(quad_bench: Column, quad_sector: Column, signal: Column, level: Column,
                signals: Column) -> Column:
    return (points(quad_bench, BENCH_POINTS) + points(quad_sector, PEER_POINTS)
            + F.when(signal == "BUY", BUY_POINTS).otherwise(0) + points(level, LEVEL_POINTS) + signals)


def sector_alert(score: Column) -> Column:
    return banded(score, SECTOR_ALERTS, SECTOR_AVOID)


def stock_rec(score: Column) -> Column:
    return banded(score, STOCK_RECS, STOCK_AVOID)


def volatility_bucket(ann_vol: Column) -> Column:
    """Bucket of the unrounded annualised volatility; a missing one is High."""
    return F.when(ann_vol < 20, "Low").when(ann_vol < 35, "Medium").otherwise("High")


def hit_grade(hit: Column) -> Column:
    return F.when(hit >= 60, "good").when(hit >= 45, "fair").when(hit.isNotNull(), "poor")


def signal_context(current: Column, average: Column, age_days: Column) -> Column:
    """How far the move since the signal has used up the historical average move."""
    share = F.try_divide(current, average) * 100
    return (
        F.when(age_days.isNull(), F.lit(None).cast("string"))
        .when(share > 120, "extended")
        .when((share < 20) & (age_days <= 20), "room to run")
    )


def reason(quad_bench: Column, quad_sector: Column | None, signal: Column, level: Column,
           signals: Column, ret_1y: Column, benchmark: str = "SPY", trend_name: str = TREND_NAME) -> Column:
    """Optional phrases in fixed order; ``quad_sector=None`` leaves out the in-sector phrase."""
    strong, weak = ("Leading", "Improving"), ("Weakening", "Lagging")

    def phrase(text: str, value: Column) -> Column:
        return F.concat(F.lit(text), value, F.lit(")"))

    year = F.format_string("%.1f", ret_1y)
    parts = [
        F.when(quad_bench.isin(*strong), phrase(f"Outperforming {benchmark} (", quad_bench))
        .when(quad_bench.isin(*weak), phrase(f"Underperforming {benchmark} (", quad_bench)),
    ]
    if quad_sector is not None:
        parts.append(
            F.when(quad_sector.isin(*strong), phrase("Top within sector (", quad_sector))
            .when(quad_sector.isin(*weak), phrase("Lagging within sector (", quad_sector)))
    parts += [
        F.when(signal == "BUY", f"{trend_name} active").otherwise("No trend signal"),
        F.when(level.isin("STRONG", "ALERT"),
               F.concat(signals.cast("string"), F.lit("/4 confirmation signals"))),
        F.when(ret_1y > 20, F.concat(F.lit("+"), year, F.lit("% 1Y momentum")))
        .when(ret_1y < 0, F.concat(year, F.lit("% 1Y (negative)"))),
    ]
    return F.concat_ws("; ", *parts)
