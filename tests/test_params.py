import pytest

from rangebreak.params import Params


def test_default_grid_matches_the_clock():
    assert Params.from_clock() == Params()
    assert Params().first_entry_slot == 4


@pytest.mark.parametrize(
    "changes",
    [
        {"bust_atr": 0.5},
        {"split_ratio": (1.1, 1.6)},
        {"slippage_bps": ()},
        {"slippage_bps": (-1,)},
        {"last_entry_slot": 75},
        {"opening_range_bars": 0},
    ],
)
def test_inconsistent_parameters_are_refused(changes):
    with pytest.raises(ValueError):
        Params(**changes)


def test_clock_times_must_fall_on_the_grid():
    with pytest.raises(ValueError):
        Params.from_clock(slot_minutes=7)
