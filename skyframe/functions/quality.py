"""Ephemeris age and quality, sync freshness and retry delays."""

from __future__ import annotations

from dataclasses import dataclass

from math import ceil, log

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyframe import constants as K

MICROS = 1_000_000


@dataclass(frozen=True)
class QualityLimits:
    """Hours up to which an element set is fresh, aging and stale, all inclusive."""

    warning_hours: float = K.EPHEMERIS_WARNING_HOURS
    stale_hours: float = K.EPHEMERIS_STALE_HOURS
    max_hours: float = K.EPHEMERIS_MAX_HOURS

    def __post_init__(self) -> None:
        if not 0 < self.warning_hours <= self.stale_hours <= self.max_hours:
            raise ValueError("limits must satisfy 0 < warning <= stale <= max")

    def micros(self) -> tuple[int, int, int]:
        return tuple(
            round(hours * 3600 * MICROS)
            for hours in (self.warning_hours, self.stale_hours, self.max_hours)
        )


def age_micros(epoch: Column, target: Column) -> Column:
    return F.unix_micros(target) - F.unix_micros(epoch)


def age_seconds(epoch: Column, target: Column) -> Column:
    return age_micros(epoch, target) / F.lit(float(MICROS))


def ephemeris_status(epoch: Column, target: Column, limits: QualityLimits = QualityLimits()) -> Column:
    """fresh / aging / stale / expired; a future epoch is fresh."""
    age = age_micros(epoch, target)
    warning, stale, maximum = limits.micros()
    return (
        F.when(age <= warning, F.lit("fresh"))
        .when(age <= stale, F.lit("aging"))
        .when(age <= maximum, F.lit("stale"))
        .otherwise(F.lit("expired"))
    )


def propagation_allowed(epoch: Column, target: Column, limits: QualityLimits = QualityLimits()) -> Column:
    return age_micros(epoch, target) <= limits.micros()[2]


def expired_message(epoch: Column, target: Column, limits: QualityLimits = QualityLimits()) -> Column:
    return F.format_string(
        "Orbital element age %.2fh exceeds maximum %.2fh",
        age_seconds(epoch, target) / 3600.0,
        F.lit(float(limits.max_hours)),
    )


def retry_delay_seconds(failures: Column, policy: dict[str, int]) -> Column:
    """initial * multiplier^(n-1), capped. The exponent stops where the maximum is
    reached, so a long streak cannot overflow; fewer than one failure fails the job."""
    initial, multiplier, maximum = policy["initial"], policy["multiplier"], policy["maximum"]
    exponent = (failures - 1).cast("double")
    if multiplier > 1:
        reached = ceil(log(max(maximum / initial, 1.0)) / log(multiplier)) + 1
        exponent = F.least(exponent, F.lit(float(reached)))
    delay = F.least(F.lit(float(maximum)), initial * F.pow(F.lit(float(multiplier)), exponent))
    return F.when(
        failures <= 0, F.raise_error(F.lit("failures must be greater than zero")).cast("bigint")
    ).otherwise(delay.cast("bigint"))


def freshness_thresholds(interval_seconds: Column) -> tuple[Column, Column]:
    """(warning, stale) = (ceil(1.5 * interval), 2 * interval)."""
    whole = interval_seconds.cast("bigint")
    return F.floor((whole * 3 + 1) / 2).cast("bigint"), whole * 2


def sync_freshness(last_success: Column, now: Column, interval_seconds: Column) -> Column:
    """fresh / warning / stale with inclusive limits; no success is unknown."""
    age = success_age_seconds(last_success, now)
    warning, stale = freshness_thresholds(interval_seconds)
    return (
        F.when(age.isNull(), F.lit("unknown"))
        .when(age <= warning, F.lit("fresh"))
        .when(age <= stale, F.lit("warning"))
        .otherwise(F.lit("stale"))
    )


def success_age_seconds(last_success: Column, now: Column) -> Column:
    age = (F.unix_micros(now) - F.unix_micros(last_success)) / F.lit(float(MICROS))
    return F.when(age.isNotNull(), F.greatest(F.lit(0.0), age))
