"""Parameter records. Bad parameters fail on the driver, bad data never does."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


def _finite(name, value):
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number")
    return float(value)


def _within(name, value, low, high):
    if value is not None and not low <= _finite(name, value) <= high:
        raise ValueError(f"{name} must lie in [{low}, {high}]")


def whole(name, value, minimum=1):
    """Accept 5 and 5.0, refuse booleans, fractions, NaN and anything below minimum."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{name} must be a whole number")
    if not math.isfinite(value) or value != int(value) or value < minimum:
        raise ValueError(f"{name} must be a whole number of at least {minimum}")
    return int(value)


# Bounds of explicitly supplied assumptions.
GROWTH_BOUNDS = (-0.10, 0.40)
MARGIN_BOUNDS = (0.0, 0.60)
TERMINAL_GROWTH_BOUNDS = (0.0, 0.05)


@dataclass(frozen=True)
class DcfParams:
    growth: float | None = None
    margin: float | None = None
    tax_rate: float | None = None
    terminal_growth: float = 0.025
    years: int = 5
    risk_free: float = 0.04
    market_premium: float = 0.055
    da_pct: float = 0.03
    capex_pct: float = 0.04
    nwc_pct: float = 0.01
    # Fallbacks and caps.
    default_beta: float = 1.0
    default_cost_of_debt: float = 0.05
    default_tax: float = 0.21
    default_growth: float = 0.08
    default_margin: float = 0.15
    max_growth: float = 0.25
    min_wacc: float = 0.05
    max_wacc: float = 0.20

    def __post_init__(self):
        object.__setattr__(self, "years", whole("years", self.years))
        _within("growth", self.growth, *GROWTH_BOUNDS)
        _within("margin", self.margin, *MARGIN_BOUNDS)
        _within("terminal_growth", self.terminal_growth, *TERMINAL_GROWTH_BOUNDS)
        if self.tax_rate is not None and not 0 <= _finite("tax_rate", self.tax_rate) < 1:
            raise ValueError("tax_rate must lie in [0, 1)")
        for name in ("risk_free", "market_premium", "da_pct", "capex_pct", "nwc_pct"):
            _finite(name, getattr(self, name))


@dataclass(frozen=True)
class ScanParams:
    filing_lag_days: int = 90
    price_lookback_days: int = 10
    shares_lookback_days: int = 365
    rf_lookback_days: int = 10
    rf_fallback: float = 0.042
    top_n: int = 10
    start_value: float = 100_000.0
    piv_floor: float = 0.05
    conviction_cap: float = 2.0
    conviction_half: float = 0.10
    # Blend of conviction and free-cash-flow yield.
    yield_factor: float = 10.0
    yield_cap: float = 2.0
    conviction_weight: float = 0.6
    yield_weight: float = 0.4


@dataclass(frozen=True)
class GateParams:
    altman_floor: float = 1.8
    altman_exempt: tuple = ("Financial Services", "Financials", "Utilities", "Real Estate")
    sma_window: int = 200
    sma_tolerance: float = 0.98
    min_f_score: int = 5
    rsi_period: int = 14
    rsi_ceiling: float = 45.0
    rsi_months: int = 3


@dataclass(frozen=True)
class PortfolioParams:
    default_beta: float = 1.0
    beta_floor: float = 0.5
    position_cap: float = 0.15
    sector_cap: float = 0.25
    rounds: int = 20
    eps: float = 1e-9
    drift: float = 0.03
    min_order: float = 1.0
    trim_tolerance: float = 0.01 + 1e-6


@dataclass(frozen=True)
class RiskParams:
    lookback: int = 252
    simulations: int = 10_000
    horizon_days: int = 21
    tail: float = 0.05
    min_coverage: float = 0.5
    seed: int = 7
    block: int = 1_000
    slice: int = 500

    def __post_init__(self):
        for name in ("lookback", "simulations", "horizon_days", "block", "slice"):
            object.__setattr__(self, name, whole(name, getattr(self, name)))


@dataclass(frozen=True)
class HedgeParams:
    underlying: str = "SPY"
    target_days: int = 30
    window_days: int = 10
    strike_band: float = 0.10
    vol: float = 0.15
    risk_free: float = 0.04
    stress: float = 0.07
    budget_fraction: float = 0.02
    max_contracts: int = 50
    multiplier: int = 100
    max_vol: float = 10.0
    max_abs_rate: float = 5.0


@dataclass(frozen=True)
class LookupParams:
    max_age_hours: int = 48
    min_samples: int = 3
    min_coverage: float = 0.5
    rf_tolerance: float = 0.0005


@dataclass(frozen=True)
class SensitivityGrids:
    # Scenario axes.
    wacc: tuple = (0.05, 0.075, 0.10, 0.125, 0.15, 0.175, 0.20)
    terminal_growth: tuple = (0.00, 0.01, 0.02, 0.025, 0.03, 0.04, 0.05)
    growth: tuple = (-0.10, -0.05, 0.00, 0.05, 0.10, 0.20, 0.30, 0.40)
    margin: tuple = (0.00, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60)
    two_way_wacc: tuple = (0.05, 0.08, 0.11, 0.14, 0.17, 0.20)
    two_way_growth: tuple = (0.00, 0.01, 0.02, 0.03, 0.04, 0.05)


# Metric -> (kind, tolerance), in comparison order.
METRIC_TOLERANCES = {
    "revenue_cagr": ("rate", 0.0001),
    "operating_margin": ("rate", 0.0001),
    "wacc": ("rate", 0.0005),
    "fcf_year_1": ("money", 0.001),
    "fcf_year_2": ("money", 0.001),
    "fcf_year_3": ("money", 0.001),
    "fcf_year_4": ("money", 0.001),
    "fcf_year_5": ("money", 0.001),
    "terminal_value": ("money", 0.002),
    "pv_explicit_fcf": ("money", 0.002),
    "pv_terminal_value": ("money", 0.002),
    "enterprise_value": ("money", 0.002),
    "equity_value": ("money", 0.002),
    "intrinsic_value_per_share": ("money", 0.005),
}
ZERO_TOLERANCE = 1e-6


@dataclass(frozen=True)
class Tolerances:
    fcf: float = 0.001
    value: float = 0.002
    per_share: float = 0.005
    zero: float = ZERO_TOLERANCE
    metrics: dict = field(default_factory=lambda: dict(METRIC_TOLERANCES))
