"""Decisions of the incremental machinery, as Column expressions over tables of jobs, deltas and triggers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plan_status(listed_at: Column, stored_at: Column, force: Column, tolerance: float = 5.0) -> Column:
    return F.when(force, "force").when(stored_at.isNull(), "added").when(listed_at > stored_at + tolerance, "updated").otherwise("skip")


def pending(delta_at: Column, oversize: Column, consumed_at: Column) -> Column:
    """full (no usable delta), none (consumed) or delta."""
    return F.when(delta_at.isNull() | (delta_at <= 0) | F.coalesce(oversize, F.lit(False)), "full").when(consumed_at >= delta_at, "none").otherwise("delta")


def batch_decision(pending_jobs: Column, completed: Column, terminal: Column, n_results: Column, deadline: Column, now: Column) -> Column:
    """consume, partial, fallback or wait; the first rule that fits."""
    some = F.when(n_results > 0, "partial").otherwise("fallback")
    return F.when(pending_jobs == 0, "consume").when(completed, "consume").when(terminal, some).when(deadline.isNull() | (now < deadline), "wait").otherwise(some)


def trigger_fires(enabled: Column, dirty: Column, slots_due: Column, threshold: Column, hook: Column, first_write: Column) -> Column:
    return enabled & (dirty > 0) & ((F.size(slots_due) > 0) | (dirty >= threshold) | ((hook == "write") & first_write))


def harvest_decision(channel: Column, queued: Column, failed_at: Column, last_at: Column, locked_at: Column, now: Column, interval: float = 300.0, backoff: float = 1800.0, stale: float = 600.0) -> Column:
    return F.when(~channel, "no_channel").when(queued == 0, "empty").when(failed_at.isNotNull() & (now < failed_at + F.greatest(F.lit(interval), F.lit(backoff))), "backoff").when(now < last_at + interval, "throttled").when(locked_at.isNotNull() & (now < locked_at + stale), "locked").otherwise("run")
