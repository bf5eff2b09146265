"""Training schedules as expressions over an epoch column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def lr_factor(epoch: Column, epochs: int = 12, warmup: int = 2, lr: float = 0.6e-3, lr_min: float = 2e-5) -> Column:
    """A linear warm-up, then half a cosine down to the floor."""
    floor, span = lr_min / lr, max(1, epochs - warmup - 1)
    t = F.least(F.lit(1.0), (epoch - warmup) / float(span))
    return F.when(epoch < warmup, (epoch + 1) / float(warmup)).otherwise(floor + 0.5 * (1 - floor) * (1 + F.cos(t * math.pi)))


def wdl_weight(epoch: Column, most: float, epochs: int = 12, warmup: int = 2, end: float = 0.4) -> Column:
    """None in the warm-up, then a ramp to the greatest weight."""
    if most <= 0:
        return F.lit(0.0)
    top = max(warmup + 1, int(epochs * end))
    return F.when(epoch < warmup, 0.0).when(epoch >= top, most).otherwise(most * (epoch - warmup) / float(top - warmup))


def ema(values: Column, decay: float) -> Column:
    """The exponential moving average of an array of doubles in order, from its first."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), values[0], lambda p, x: p * decay + x * (1 - decay))
