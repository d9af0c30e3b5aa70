"""Strategies side by side and the overall verdict, against results worked out by hand."""

import pytest

from tidebar.plans import equity as eq
from tidebar.plans import resample

CURVE = "symbol string, rn long, equity double, dd double, ret double"
LEDGER = "symbol string, pnl double"


def test_best_variant_has_the_highest_return_over_drawdown(spark):
    # Twice the profit at ten times the drawdown loses; unlike capitals are compared by return.
    calm = spark.createDataFrame([("a", 1, 100.0, 0.0, None), ("a", 2, 98.0, -0.02, -0.02), ("a", 3, 110.0, 0.0, 110 / 98 - 1)], CURVE)
    wild = spark.createDataFrame([("a", 1, 1000.0, 0.0, None), ("a", 2, 800.0, -0.2, -0.2), ("a", 3, 1200.0, 0.0, 0.5), ("b", 1, 1000.0, 0.0, None)], CURVE)
    made = spark.createDataFrame([("a", 5.0), ("a", -1.0)], LEDGER)
    got = {(r["symbol"], r["variant"]): r for r in eq.compare_variants([("wild", wild, made, 1000.0), ("calm", calm, made, 100.0)], ["symbol"], 365.0).collect()}
    assert got["a", "calm"]["best"] and not got["a", "wild"]["best"]
    assert got["a", "calm"]["total_return_pct"] == pytest.approx(10) and got["a", "calm"]["max_drawdown_pct"] == pytest.approx(-2)
    assert (got["a", "calm"]["trades"], got["a", "calm"]["win_rate"], got["a", "calm"]["total_pnl"]) == (2, 50.0, 4.0)
    # No drawdown, no trades and a single bar: everything is zero and the only variant is the best.
    alone = got["b", "wild"]
    assert (alone["trades"], alone["win_rate"], alone["sharpe"], alone["best"]) == (0, 0.0, 0.0, True)


def test_first_named_variant_wins_a_tie(spark):
    flat = spark.createDataFrame([("a", 1, 100.0, 0.0, None), ("a", 2, 100.0, 0.0, 0.0)], CURVE)
    none = spark.createDataFrame([], LEDGER)
    found = eq.compare_variants([("z", flat, none, 100.0), ("y", flat, none, 100.0)], ["symbol"], 365.0)
    assert [r["variant"] for r in found.where("best").collect()] == ["z"]


@pytest.mark.parametrize(
    "growth, ruin, survives, concerns, strengths, verdict",
    [
        (12.0, 5.0, True, "", "ruin unlikely; strong median; passes stress", "DEPLOYABLE"),
        (5.0, 10.0, True, "", "ruin unlikely; passes stress", "DEPLOYABLE"),
        (-1.0, 5.0, True, "negative median", "ruin unlikely; passes stress", "MARGINAL"),
        (5.0, 11.0, False, "ruin likely; fails stress", "", "MARGINAL"),
        (-1.0, 11.0, False, "ruin likely; negative median; fails stress", "", "NEEDS WORK"),
    ],
)
def test_overall_verdict(spark, growth, ruin, survives, concerns, strengths, verdict):
    middle = spark.createDataFrame([("a", growth)], "symbol string, median_cagr double")
    shares = spark.createDataFrame([("a", ruin)], "symbol string, prob_ruin double")
    stressed = spark.createDataFrame([("a", survives)], "symbol string, survives boolean")
    got = resample.overall_verdict(middle, shares, stressed, ["symbol"]).first()
    assert (got["concerns"], got["strengths"], got["verdict"]) == (concerns, strengths, verdict)
