"""Opening-range breakout research as Spark jobs over partitioned bar tables."""

from rangebreak.params import Params

__all__ = ["Params"]
