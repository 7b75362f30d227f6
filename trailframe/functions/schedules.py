"""Schedules: which frames of a video are taken, and how fast training learns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_step(total: Column, fps: Column, seconds: float, most: int) -> Column:
    """Frames from one sample to the next: those of `seconds`, or all but one of a shorter video; more where that would give over `most`
    samples. At least 1, also for videos of one frame and rates below one frame in `seconds`."""
    plain = F.floor(fps * seconds).cast("long")
    fit = F.greatest(F.when(total < plain, total - 1).otherwise(plain), F.lit(1).cast("long"))
    return F.when(F.floor(total / fit) > most, F.floor(total / most).cast("long")).otherwise(fit)


def frame_numbers(total: Column, step: Column) -> Column:
    """Numbers of the sampled frames, from 0; none for a video without frames."""
    return F.when(total > 0, F.sequence(F.lit(0).cast("long"), total.cast("long") - 1, step)).otherwise(F.array().cast("array<bigint>"))


def frame_offset_ms(frame: Column, fps: Column) -> Column:
    """Milliseconds from the start, with fractions."""
    return frame / fps * 1000


def learning_rate(epoch: Column, rate: float, initial: float, least: float, warmup: int, cycle: int, decay: float) -> Column:
    """From `initial` in a straight line to `rate` at epoch `warmup`; then cosines of `cycle` epochs from `rate` down towards `least`,
    each cycle `decay` times the one before."""
    start, low = initial / rate, least / rate
    rising = start + (1 - start) / warmup * epoch if warmup else F.lit(1.0)
    after = epoch - warmup
    phase = F.pi() * F.pmod(after, F.lit(cycle)) / cycle
    falling = F.pow(F.lit(decay), F.floor(after / cycle)) * (low + (1 - low) * (1 + F.cos(phase)) / 2)
    return rate * F.when(epoch <= warmup, rising).otherwise(falling)
