"""Position rules as records: one per strategy profile, all read by the same step."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Rules:
    """How a profile enters, adds, stops, exits, sizes and pays costs."""

    name: str
    entry_len: int = 40
    exit_len: int = 16
    atr_len: int = 20
    atr_prior: bool = False  # ATR of the bars before the current one
    trail_mult: float = 4.0
    stop_mult: float = 2.0
    risk_pct: float = 1.0
    max_units: int = 4
    spacing: float = 1.5
    long_only: bool = True
    short_needs_downtrend: bool = True
    gate: str = "none"  # none, ema, trend, band, filters, mode
    trend_len: int = 200  # SMA of the trend and band gates
    band: tuple[float, float] = (0.5, 8.0)  # ATR percent the band gate allows
    scale: str = "none"  # none, volatility, mode
    mild_size: float = 0.5  # size factors and price / SMA limit of the mode gate and scale
    severe_size: float = 0.0
    severe_ratio: float = 0.9
    entry_test: str = "close"  # close, high or touch (high reaches the channel)
    entry_fill: str = "close"  # close or channel
    add_test: str = "reach"  # reach: high reaches the level; breakout: entry test and close at the level
    add_fill: str = "close"
    anchor: str = "close"  # level for the next unit counts from the raw close or from the fill
    stop: str = "peak"  # peak: off the best price; close: unit stops tested on close; low: unit stops tested on low
    exit_test: str = "close"  # close beyond, touch (low at or below) or cross (low below)
    exit_fill: str = "close"  # close or channel
    channel_first: bool = False  # channel exit outranks the stop
    ratchet_late: bool = False  # unit stops move after entries, the new unit included
    sizing: str = "lots"  # lots, capped (quarter of equity, over 10) or clamped
    lot: float = 0.001
    min_size: float = 0.001
    max_notional: float = 0.0  # share of equity; 0 is unlimited
    drawdown_cut: float = 0.0  # size factor beyond 15 % realised drawdown; 0 is off
    cost_pct: float = 0.0  # in the price, per fill
    commission_pct: float = 0.0  # of notional, per leg, in the profit
    end_cost: bool = True
    warmup: int = 201
    full_curve: bool = True  # equity rows for warm-up bars too
    closing_row: bool = True  # last equity row shows the liquidated equity
    notional_equity: bool = False  # mark whole notional instead of open profit
    gap_fill: bool = False  # a bar opening beyond its stop fills at the open
    capital: float = 100_000.0
    stop_reason: str = "Trailing Stop"
    exit_reason: str = "Donchian Exit"

    @property
    def trend_column(self) -> str:
        return f"smap{self.trend_len}" if self.atr_prior else f"sma{self.trend_len}"

    @property
    def gate_column(self) -> str | None:
        """Name of the gate's input column; profiles with the same gate share it."""
        if self.gate == "none":
            return None
        if self.gate == "trend":
            return f"gate_{self.trend_column}"
        if self.gate == "band":
            low, high = (str(x).replace(".", "_") for x in self.band)
            return f"gate_{self.trend_column}_{low}_{high}"
        return f"gate_{self.gate}{self._mode if self.gate == 'mode' else ''}"

    @property
    def _mode(self) -> str:
        return "".join(f"_{x}".replace(".", "_") for x in (self.mild_size, self.severe_size, self.severe_ratio))

    @property
    def scale_column(self) -> str | None:
        if self.scale == "none":
            return None
        return f"scale_{self.scale}{self._mode if self.scale == 'mode' else ''}"

    @property
    def tag_column(self) -> str | None:
        """Label a unit remembers from its entry bar."""
        if self.gate not in ("filters", "mode"):
            return None
        return f"tag_{self.gate}{self._mode if self.gate == 'mode' else ''}"

    def with_(self, **changes) -> "Rules":
        return replace(self, **changes)


def breakout_rules(name: str = "breakout", **changes) -> Rules:
    """Close-based breakout, long or long/short, stop off the best price since entry."""
    rules = Rules(name=name, cost_pct=0.13, **changes)
    return rules.with_(warmup=max(rules.entry_len, rules.atr_len, 200) + 1)


def intrabar_rules(name: str = "intrabar", **changes) -> Rules:
    """Long only, fills inside the bar at the channel price, no new units below the slow EMA."""
    base = dict(
        entry_len=12, exit_len=6, atr_len=14, trail_mult=2.5, risk_pct=0.5, max_units=3, spacing=1.0, gate="ema",
        entry_test="high", entry_fill="channel", add_test="breakout", add_fill="channel", anchor="fill", exit_test="touch",
        exit_fill="channel", lot=0.0001, cost_pct=0.13, end_cost=False, stop_reason="Trail Stop",
    )
    rules = Rules(name=name, **(base | changes))
    return rules.with_(warmup=max(rules.entry_len, rules.atr_len, 200) + 1)


def ratchet_rules(name: str = "ratchet", trend_len: int = 100, use_trend: bool = False, **changes) -> Rules:
    """Long only, one ratcheting stop per unit tested on the close, no costs."""
    base = dict(
        entry_len=8, exit_len=16, atr_len=14, atr_prior=True, trail_mult=3.5, stop_mult=3.5, spacing=1.0, entry_test="high",
        add_test="breakout", anchor="fill", stop="close", exit_test="cross", channel_first=True, sizing="capped",
        full_curve=False, capital=10_000.0, stop_reason="Stop", exit_reason="Donchian", gate="trend" if use_trend else "none",
        trend_len=trend_len,
    )
    rules = Rules(name=name, **(base | changes))
    return rules.with_(warmup=max(rules.entry_len, rules.exit_len, rules.atr_len, trend_len) + 10)


def band_rules(name: str = "band", trend_len: int = 100, **changes) -> Rules:
    """The ratchet profile with an SMA trend and a volatility band as gates."""
    base = dict(
        entry_len=20, exit_len=10, atr_prior=False, trail_mult=3.0, stop_mult=3.0, gate="band", stop_reason="Trailing Stop", exit_reason="Donchian Exit",
    )
    return ratchet_rules(name, trend_len, **(base | changes))


def live_rules(name: str = "live", **changes) -> Rules:
    """The ratchet profile as a running job applies it: slippage, clamped size, late ratchet."""
    base = dict(
        atr_prior=False, sizing="clamped", ratchet_late=True, cost_pct=0.05, end_cost=True, capital=1_000.0,
        stop_reason="Trailing Stop", exit_reason="Donchian Exit",
    )
    rules = ratchet_rules(name, **(base | changes))
    return rules.with_(warmup=max(rules.entry_len, rules.exit_len, rules.atr_len) + 4)


def filtered_rules(name: str = "filtered", **changes) -> Rules:
    """Long only, gated by trend, momentum and regime, unit stops tested on the low."""
    base = dict(
        gate="filters", scale="volatility", entry_test="touch", entry_fill="channel", add_test="breakout", anchor="fill",
        stop="low", exit_test="touch", max_notional=0.95, drawdown_cut=0.5, cost_pct=0.05, commission_pct=0.08,
        end_cost=False, full_curve=False, closing_row=False, capital=1_000.0, warmup=210,
    )
    return Rules(name=name, **(base | changes))


def selective_rules(name: str = "selective", **changes) -> Rules:
    """The filtered profile with size by market mode in place of gates."""
    return filtered_rules(name, **({"gate": "mode", "scale": "mode", "drawdown_cut": 0.0} | changes))


PROFILES = {
    "breakout": breakout_rules,
    "intrabar": intrabar_rules,
    "ratchet": ratchet_rules,
    "band": band_rules,
    "live": live_rules,
    "filtered": filtered_rules,
    "selective": selective_rules,
}
