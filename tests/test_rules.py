"""Hand-made bars for every rule of the position step."""

import math
import random

import pytest

from tidebar.functions.rules import breakout_rules, filtered_rules, intrabar_rules, live_rules, ratchet_rules, selective_rules
from tidebar.functions.step import Bar, advance, liquidate, marked, opening_book
from tidebar.operators.fills import _Account

NAN = float("nan")


def bar(ts, high, low, close, atr=10.0, top=100.0, bottom=50.0, cap=200.0, floor=60.0, **more):
    return Bar(ts, more.pop("open", close), high, low, close, atr, top, bottom, cap, floor, **more)


def started(rules, *bars):
    book, closed = opening_book(rules), []
    for b in bars:
        closed += advance(book, rules, b)
    return book, closed


def test_breakout_is_strict_and_pays_costs():
    rules = breakout_rules()
    book, _ = started(rules, bar(1, 100, 95, 100))
    assert not book.units
    book, _ = started(rules, bar(1, 101, 95, 101))
    assert book.units[0].price == pytest.approx(101 * 1.0013)
    assert book.units[0].quantity == pytest.approx(1000 / 20)


def test_half_lots_round_to_even():
    rules = breakout_rules(lot=1.0, min_size=1.0, capital=5000.0)
    book, _ = started(rules, bar(1, 101, 95, 101))  # 50 / 20 = 2.5 lots
    assert book.units[0].quantity == 2.0


def test_stop_hit_when_low_equals_it_and_fill_is_the_stop():
    rules = breakout_rules(max_units=1)
    _, closed = started(rules, bar(1, 110, 95, 101), bar(2, 109, 70, 80, floor=10))  # stop 110 - 40 = 70
    assert [(c.exit_reason, c.exit_price) for c in closed] == [("Trailing Stop", pytest.approx(70 * 0.9987))]


def test_gap_through_stop_fills_at_stop_unless_asked():
    first, gap = bar(1, 110, 95, 101), bar(2, 50, 40, 45, floor=10, open=48.0)
    _, closed = started(breakout_rules(max_units=1), first, gap)
    assert closed[0].exit_price == pytest.approx(70 * 0.9987)
    _, closed = started(breakout_rules(max_units=1, gap_fill=True), first, gap)
    assert closed[0].exit_price == pytest.approx(48 * 0.9987)


def test_stop_uses_the_best_price_of_the_current_bar():
    _, closed = started(breakout_rules(max_units=1), bar(1, 110, 95, 101), bar(2, 150, 110, 140, top=999))
    assert closed[0].exit_reason == "Trailing Stop" and closed[0].exit_price == pytest.approx(110 * 0.9987)


def test_unit_may_be_added_on_the_entry_bar_and_stops_at_the_limit():
    rules = breakout_rules(max_units=2)
    book, _ = started(rules, bar(1, 120, 95, 101))  # 120 reaches 101 + 15
    assert [u.number for u in book.units] == [1, 2]
    advance(book, rules, bar(2, 150, 115, 140))
    assert len(book.units) == 2


def test_exit_and_new_entry_share_a_bar():
    rules = breakout_rules(max_units=1)
    book, closed = started(rules, bar(1, 110, 95, 101), bar(2, 160, 60, 150, floor=10))
    assert len(closed) == 1 and book.units[0].entry_time == 2 and book.position_id == 2


def test_reversals_both_ways():
    rules = breakout_rules(long_only=False, max_units=1)
    book, closed = started(
        rules, bar(1, 102, 95, 101), bar(2, 90, 80, 85, top=999, bottom=86, floor=10, short_allowed=True), bar(3, 131, 90, 130, top=120, cap=999),
    )
    assert [(c.direction, c.exit_reason) for c in closed] == [("long", "Reversal"), ("short", "Trailing Stop")]
    assert book.side == 1
    book, closed = started(
        rules, bar(1, 60, 40, 45, top=999, short_allowed=True), bar(2, 60, 40, 58, top=57, cap=999, short_allowed=True),
    )
    assert [(c.direction, c.exit_reason) for c in closed] == [("short", "Reversal")] and book.side == 1


def test_short_needs_permission():
    book, _ = started(breakout_rules(long_only=False), bar(1, 60, 40, 45, top=999, short_allowed=False))
    assert not book.units


def test_missing_or_zero_atr():
    for atr in (NAN, 0.0):
        for rules in (breakout_rules(), ratchet_rules(), filtered_rules()):
            book, _ = started(rules, bar(1, 120, 95, 101, atr=atr))
            assert not book.units


def test_intrabar_fills_at_channel_and_respects_the_gate():
    rules = intrabar_rules()
    book, _ = started(rules, bar(1, 105, 95, 98, allowed=False))
    assert not book.units
    book, closed = started(rules, bar(1, 105, 95, 98), bar(2, 99, 90, 97, floor=92))
    assert closed[0].entry_price == pytest.approx(100 * 1.0013)
    assert closed[0].exit_price == pytest.approx(92 * 0.9987) and closed[0].exit_reason == "Donchian Exit"


def test_ratchet_channel_outranks_stop_and_stop_is_on_the_close():
    rules = ratchet_rules(max_units=1)
    _, closed = started(rules, bar(1, 105, 95, 101), bar(2, 101, 59, 60))
    assert closed[0].exit_reason == "Donchian"
    _, closed = started(rules, bar(1, 105, 95, 101), bar(2, 101, 61, 66))  # stop 101 - 35 = 66
    assert closed[0].exit_reason == "Stop" and closed[0].exit_price == 66


def test_ratchet_only_rises():
    rules = ratchet_rules(max_units=1)
    book, _ = started(rules, bar(1, 105, 95, 101), bar(2, 130, 100, 120, top=999), bar(3, 110, 95, 100, top=999))
    assert book.units[0].stop == 85


def test_capped_size_and_smallest_notional():
    book, _ = started(ratchet_rules(max_units=1, capital=1000.0), bar(1, 105, 95, 101, atr=0.001))
    assert book.units[0].quantity == pytest.approx(250 / 101)
    book, _ = started(ratchet_rules(max_units=1, capital=30.0), bar(1, 105, 95, 101, atr=0.001))
    assert not book.units


def test_filtered_units_close_one_by_one():
    rules = filtered_rules(max_units=4, capital=1_000_000.0)
    book, _ = started(rules, bar(1, 101, 99, 100), bar(2, 130, 110, 130))
    assert len(book.units) == 2
    closed = advance(book, rules, bar(3, 115, 91, 112, top=999))
    assert [c.unit_number for c in closed] == [2] and len(book.units) == 1
    assert closed[0].exit_price == pytest.approx(min(112, max(130 * 1.0005 - 20, 72)) * 0.9995)


def test_filtered_notional_cap_and_commission():
    book, _ = started(filtered_rules(capital=1000.0), bar(1, 101, 99, 100, atr=0.1))
    assert not book.units  # 50 units at 100 exceed 95 % of 1000
    rules = filtered_rules(capital=100_000.0)
    book, _ = started(rules, bar(1, 101, 99, 100))
    unit = book.units[0]
    done = liquidate(book, rules, bar(2, 100, 100, 100))[0]
    assert done.exit_price == 100
    assert done.pnl == pytest.approx(unit.quantity * (100 - unit.price) - 0.0008 * unit.quantity * (100 + unit.price))


def test_drawdown_halves_the_size():
    rules = filtered_rules(capital=1_000_000.0)
    book = opening_book(rules)
    book.cash = 800_000.0
    advance(book, rules, bar(1, 101, 99, 100))
    assert book.units[0].quantity == pytest.approx(8000 / 20 / 2)


def test_selective_scale_comes_with_the_bar():
    rules = selective_rules(capital=1_000_000.0)
    book, _ = started(rules, bar(1, 101, 99, 100, scale=0.5))
    assert book.units[0].quantity == pytest.approx(10_000 / 20 / 2)


def test_live_ratchets_the_new_unit_at_once():
    rules = live_rules(max_units=1)
    book, _ = started(rules, bar(1, 105, 95, 101))
    assert book.units[0].stop == pytest.approx(max(101 * 1.0005 - 35, 101 - 35))


def test_end_of_data_and_profit_equals_change_of_equity():
    for rules in (breakout_rules(long_only=False), intrabar_rules(), ratchet_rules(), filtered_rules(), selective_rules(), live_rules()):
        rng, book, closed, price = random.Random(1), opening_book(rules), [], 100.0
        for i in range(400):
            price *= math.exp(rng.gauss(0, 0.03))
            b = bar(i, price * 1.02, price * 0.98, price, price * 0.03, price * rng.uniform(0.97, 1.05), price * 0.97, price * 1.1, price * 0.95, short_allowed=True)
            closed += advance(book, rules, b)
            total, worth = marked(book, rules, b)
            assert total == pytest.approx(book.cash + sum(book.side * u.quantity * (price - u.price) for u in book.units))
        closed += liquidate(book, rules, b)
        assert closed and book.cash - rules.capital == pytest.approx(sum(c.pnl for c in closed))
        assert not book.units


def test_manual_fills():
    account = _Account(1000.0, long_only=False)
    assert account.fill("BUY", 10, 2) is None
    assert account.fill("BUY", 20, 2) is None and account.average == 15 and account.units == 2
    assert account.fill("SELL", 18, 1) == pytest.approx(12) and account.position == -1
    assert account.fill("CLOSE", 16, 0) == pytest.approx(2) and account.capital == 1014
    flat = _Account(1000.0, long_only=True)
    assert flat.fill("SELL", 10, 1) is None and flat.position == 0
