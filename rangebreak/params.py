"""One frozen record of everything that changes what a query means."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Feature names, in report order.
DIRECTIONAL_FEATURES = (
    "rvol_open_15m",
    "rvol_breakout_bar",
    "bar_body_ratio",
    "rel_strength_vs_index",
    "index_or_agrees",
    "gap_atr_signed",
)
TWO_SIDED_FEATURES = ("prior_day_return_atr_signed", "is_expiry_day")
CONTEXT_FEATURES = ("or_width_atr", "minutes_since_open", "day_of_week", "breakout_depth_atr")
TESTED_FEATURES = DIRECTIONAL_FEATURES + TWO_SIDED_FEATURES
ALL_FEATURES = TESTED_FEATURES + CONTEXT_FEATURES

# Outcome classes from worst to best, and verdicts from best to worst.
OUTCOMES = ("BUSTED", "NEITHER", "SUSTAINED")
VERDICTS = ("CLEAN", "TAIL_COLLAPSED", "PARTIAL", "SUSPECT", "CORRUPT")
RESEARCH_VERDICTS = ("CLEAN", "TAIL_COLLAPSED")
VARIANTS = ("base", "partial_1r")


@dataclass(frozen=True)
class Params:
    """Session grid and thresholds. Times of day are slot numbers on the session grid."""

    # Session grid: 09:15 to 15:30 in five-minute bars.
    zone: str = "Asia/Kolkata"
    index_symbol: str = "NIFTY50"
    session_start_minute: int = 9 * 60 + 15
    slot_minutes: int = 5
    slots_per_session: int = 75
    opening_range_bars: int = 3
    bust_cutoff_slot: int = 72  # 15:15
    last_entry_slot: int = 63  # 14:30

    # Indicators.
    rvol_lookback: int = 14
    atr_period: int = 14

    # Labelling, in multiples of the prior-day ATR.
    sustain_atr: float = 0.5
    bust_atr: float = 0.25

    # Trades and the random control.
    position: float = 50_000.0
    stop_atr: float = 1.0
    slippage_bps: tuple[int, ...] = (5, 10, 20)
    bootstrap_draws: int = 1000
    seed: int = 0
    min_sample: int = 30
    rvol_threshold: float = 2.0
    breakeven_r: float = 0.5
    min_defined_share: float = 0.5

    # Study.
    train_fraction: float = 0.7
    min_gap_points: float = 10.0
    family_error_rate: float = 0.05

    # Forecast.
    shrinkage_k: float = 40.0
    damping: float = 0.6
    min_train_sessions: int = 20
    min_train_failures: int = 30
    min_bucket_rows: int = 20
    prob_floor: float = 0.001
    prob_ceiling: float = 0.999
    calibration_edges: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.5, 1.01)

    # Daily universe selection.
    min_price: float = 50.0
    min_atr_pct: float = 1.5
    min_turnover: float = 1e8
    stocks_in_play: int = 20

    # Validation.
    settling_tail_bars: int = 2
    zero_volume_share: float = 0.5
    collapsed_tail_slots: int = 2
    split_ratio: tuple[float, float] = (0.6, 1.6)

    def __post_init__(self) -> None:
        if self.slots_per_session <= 0 or self.slot_minutes <= 0:
            raise ValueError("the session must hold at least one slot of positive length")
        if not 0 < self.opening_range_bars < self.slots_per_session:
            raise ValueError("the opening range must be shorter than the session")
        if self.bust_atr >= self.sustain_atr:
            raise ValueError("bust_atr must be below sustain_atr")
        if not 0 < self.bust_cutoff_slot <= self.slots_per_session:
            raise ValueError("bust_cutoff_slot must lie inside the session")
        if not 0 < self.last_entry_slot < self.slots_per_session:
            raise ValueError("last_entry_slot must lie inside the session")
        low, high = self.split_ratio
        if not 0 < low < 1 < high:
            raise ValueError("split_ratio must straddle 1")
        if not self.slippage_bps or min(self.slippage_bps) < 0:
            raise ValueError("slippage_bps must be non-empty and non-negative")
        if self.rvol_lookback <= 0 or self.atr_period <= 0 or self.bootstrap_draws <= 0:
            raise ValueError("lookbacks, periods and draw counts must be positive")

    @classmethod
    def from_clock(
        cls,
        start: str = "09:15",
        end: str = "15:30",
        slot_minutes: int = 5,
        opening_range_minutes: int = 15,
        bust_cutoff: str = "15:15",
        last_entry: str = "14:30",
        **rest,
    ) -> "Params":
        """Build the grid from clock times; every time must fall on the grid."""

        def minute(text: str) -> int:
            hours, minutes = text.split(":")
            return int(hours) * 60 + int(minutes)

        first = minute(start)

        def slot(text: str) -> int:
            offset = minute(text) - first
            return -(-offset // slot_minutes)

        length = minute(end) - first
        if length <= 0 or length % slot_minutes or opening_range_minutes % slot_minutes:
            raise ValueError("the session and the opening range must be whole numbers of slots")
        # A bar is before the cutoff, or at or before the last entry, by its start time.
        return cls(
            session_start_minute=first,
            slot_minutes=slot_minutes,
            slots_per_session=length // slot_minutes,
            opening_range_bars=opening_range_minutes // slot_minutes,
            bust_cutoff_slot=slot(bust_cutoff),
            last_entry_slot=(minute(last_entry) - first) // slot_minutes,
            **rest,
        )

    @property
    def first_entry_slot(self) -> int:
        """The bar after the first bar that can break out."""
        return self.opening_range_bars + 1

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)
