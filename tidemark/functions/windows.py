"""Event-time windows that are open on the left and closed on the right: window ``w`` is ``((w-1)L, wL]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_id(t: Column, length_ms: int) -> Column:
    """``ceil(t / L)`` in whole numbers. Negative or null times have no window (null)."""
    length = F.lit(length_ms).cast("long")
    return F.when(t >= 0, _div(t, length) + F.when(t % length == 0, F.lit(0)).otherwise(F.lit(1)))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def scaled_window_id(t: Column, length_ms: int, scale: int = 10) -> Column:
    """Window id on a clock that runs ``scale`` times slower."""
    return window_id(_div(t, F.lit(scale).cast("long")), length_ms)


def event_time(t: Column) -> Column:
    """Epoch milliseconds as the timestamp that watermarks need, exact to the millisecond."""
    return F.timestamp_millis(t)


def event_window(et: Column, length_ms: int) -> Column:
    """Spark's tumbling window shifted by 1 ms, which makes it right-closed on whole milliseconds."""
    return F.window(et, f"{length_ms} milliseconds", startTime="1 millisecond")


def id_of_window(window: Column, length_ms: int) -> Column:
    """The id of an ``event_window``: its end is one millisecond past ``wL``."""
    return _div(F.unix_millis(window["end"]) - 1, F.lit(length_ms).cast("long"))
