"""Timing model of sweeps and chunks as Column functions (seconds, or whole milliseconds where it says so)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model.
SWEEP_BIAS_S = 0.67
SWEEP_GAP_S = 0.7
SWEEP_GAP_S_PER_DEGREE = 0.08
VOLUME_GAP_S = 8.5
FALLBACK_CHUNK_S = 4.0
PHYSICS_WEIGHT, HISTORY_WEIGHT = 0.7, 0.3
WINDOW = 10  # samples of history
CHUNKS_HALF_DEGREE, CHUNKS_WHOLE_DEGREE = 6, 3
#: Waits by waveform and phase when nothing else is known.
STATIC_WAIT_S = {"CS": 11, "ConstantPhase": 7, "other": 4}
DOWNLOAD_RETRY = {"max_attempts": 5, "initial_ms": 500, "multiplier": 2.0, "max_ms": 8000}
DISCOVERY_RETRY = {"max_attempts": 10, "initial_ms": 500, "multiplier": 2.0, "max_ms": 16000}


def sweep_duration(rate: Column) -> Column:
    return F.when(rate > 0, F.lit(360.0) / rate - SWEEP_BIAS_S)


def chunk_duration(rate: Column, chunks: Column) -> Column:
    return F.when(chunks > 0, sweep_duration(rate) / chunks)


def sweep_gap(from_deg: Column, to_deg: Column) -> Column:
    return F.lit(SWEEP_GAP_S) + F.abs(to_deg - from_deg) * SWEEP_GAP_S_PER_DEGREE


def chunk_interval(is_start: Column, is_first: Column, rate: Column, chunks: Column, previous_deg: Column, deg: Column) -> Column:
    """Seconds from one chunk to the next: between volumes, between sweeps, or within a sweep."""
    own = F.coalesce(chunk_duration(rate, chunks), F.lit(FALLBACK_CHUNK_S))
    return F.when(is_start, F.lit(VOLUME_GAP_S)).when(is_first, own + sweep_gap(previous_deg, deg)).otherwise(own)


def blended(physics: Column, history_ms: Column) -> Column:
    """Seconds: physics and history by weight, physics alone without history."""
    return F.when(history_ms.isNull(), physics).otherwise(physics * PHYSICS_WEIGHT + history_ms / 1000.0 * HISTORY_WEIGHT)


def whole_millis(seconds: Column) -> Column:
    """Truncated, not rounded."""
    return (seconds * 1000.0).cast("long")


def static_wait(waveform: Column, phase: Column) -> Column:
    return F.when(waveform == "CS", STATIC_WAIT_S["CS"]).when(phase == "ConstantPhase", STATIC_WAIT_S["ConstantPhase"]).otherwise(STATIC_WAIT_S["other"])


def retry_delay_ms(attempt: Column, policy: dict = DOWNLOAD_RETRY) -> Column:
    """Delay before the retry after so many attempts (from 0); null when they are used up.  The first two are the initial delay."""
    grown = (F.lit(float(policy["initial_ms"])) * F.pow(F.lit(float(policy["multiplier"])), F.greatest(attempt - 1, F.lit(0)))).cast("long")
    delay = F.when(attempt == 0, F.lit(policy["initial_ms"]).cast("long")).otherwise(F.least(grown, F.lit(policy["max_ms"]).cast("long")))
    return F.when(attempt < policy["max_attempts"], delay)


def processing_wait_ms(is_start: Column, history_ms: Column, attempts: Column, physics_s: Column, waveform: Column, phase: Column) -> Column:
    """Wait for the next chunk: volume gap, else history with one second per further attempt, else physics, else the static table."""
    history = F.when(attempts.isNotNull(), history_ms + (attempts.cast("long") - 1) * 1000)
    return F.when(is_start, F.lit(int(VOLUME_GAP_S * 1000)).cast("long")).otherwise(
        F.coalesce(history, whole_millis(physics_s), F.when(waveform.isNotNull(), static_wait(waveform, phase).cast("long") * 1000))
    )


def next_wait_ms(chunk_type: str, intervals: list[int]) -> int:
    """Of one chunk, outside of expressions: the gap between volumes behind a start chunk, else the mean of its kind's last intervals, else the fallback."""
    if chunk_type == "Start":
        return int(VOLUME_GAP_S * 1000)
    return sum(intervals) // len(intervals) if intervals else int(FALLBACK_CHUNK_S * 1000)


def cascade_ms(is_start: bool, model_ms: int | None, history, kind: tuple[str, str] | None) -> int | None:
    """``processing_wait_ms`` of one chunk, outside of expressions; history: (interval, attempts) of its kind, kind: waveform and phase.

    Where the model knows no next chunk of the volume, history doesn't count either.
    """
    if is_start:
        return int(VOLUME_GAP_S * 1000)
    if model_ms is not None:
        if history:
            return sum(ms for ms, _ in history) // len(history) + (int(sum(n for _, n in history) / len(history)) - 1) * 1000
        return model_ms
    if kind is None:
        return None
    return 1000 * (STATIC_WAIT_S["CS"] if kind[0] == "CS" else STATIC_WAIT_S["ConstantPhase"] if kind[1] == "ConstantPhase" else STATIC_WAIT_S["other"])
