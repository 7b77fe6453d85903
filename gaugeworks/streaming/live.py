"""The same conditioning on streams: grids with a watermark, silences as a live alarm, merging ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeworks.durations import ns
from gaugeworks.errors import AlarmArgumentError, RegularizeArgumentError
from gaugeworks.functions import aggregators
from gaugeworks.operators.resample import YEAR_ONE


def _micros(instant: Column) -> Column:
    """Whole microseconds of nanoseconds, without a detour through doubles."""
    return F.call_function("div", instant - F.pmod(instant, F.lit(1000).cast("long")), F.lit(1000).cast("long"))


def regularized_stream(stream: DataFrame, step: int | str, agg="mean", tolerance: int | str = 0, watermark: str = "1 hour") -> DataFrame:
    """series_id, chron_ns, meas for every window that has readings, once the watermark has passed it.

    Readings behind the watermark are lost, which a batch never does; windows without readings don't appear,
    and a series' first reading is given the tolerance like any other.
    """
    step_ns, late = ns(step), ns(tolerance)
    if step_ns <= 0 or not 0 <= late < step_ns or step_ns % 1000:
        raise RegularizeArgumentError("a step of whole microseconds above zero, and a tolerance below it")
    agg = aggregators.aggregator(agg) if isinstance(agg, str) else agg
    if aggregators.needs_place(agg):
        raise RegularizeArgumentError("the slope needs the whole window in order")
    phase = YEAR_ONE * 10**9 % step_ns
    shifted = F.col("chron_ns") - late
    tick = shifted + F.pmod(-(shifted + F.lit(phase)), F.lit(step_ns))
    timed = stream.withColumn("tick", F.timestamp_micros(_micros(tick))).withWatermark("tick", watermark)
    return timed.groupBy("series_id", "tick").agg(agg(aggregators.Frame()).alias("meas")).select("series_id", (F.unix_micros("tick") * 1000).alias("chron_ns"), "meas")


#: What is held of a series between batches: the last reading that was passed on (held), whether its silence was told, and the
#: readings that the watermark hasn't reached.
_HELD = "last long, kind int, value double, told boolean, chrons array<long>, seqs array<long>, kinds array<int>, values array<double>"
_MADE = "series_id string, seq long, chron_ns long, kind int, value double"
_NUMBER, _MISSING, _BROKEN = 0, 1, 2


def _in_order(stream: DataFrame, delay: str, passed: Callable, due: Callable | None = None) -> DataFrame:
    """Each series' readings in order of their instants, whatever the order in which they come, as long as that is within the watermark.

    passed(held, reading): what to emit when the watermark reaches a reading (chron, seq, kind, value), held being (last, kind, value, told), and what is held then. due(held): when,
    in nanoseconds, something is to be emitted though nothing came, and that; or None.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = None, []
        if state.exists:
            last, kind, value, told, *columns = state.get
            held = None if last is None else (last, kind, value, told)
            waiting = list(zip(*(list(c) for c in columns)))
        for b in batches:
            waiting += zip(b["chron_ns"].tolist(), b["seq"].tolist(), b["kind"].tolist(), b["value"].tolist())
        waiting.sort()
        now, out = state.getCurrentWatermarkMs() * 10**6, []
        ready = [w for w in waiting if w[0] // 1000 * 1000 <= now]
        for reading in ready:
            rows, held = passed(held, reading)
            out += rows
        waiting = waiting[len(ready) :]
        at = due(held) if due and held else None
        if at and at[0] <= now and not (waiting and waiting[0][0] <= at[0]):
            out.append(at[1])
            held, at = (*held[:3], True), None
        wake = min([w[0] for w in waiting[:1]] + ([at[0]] if at else []), default=None)
        state.update((*(held or (None, None, None, None)), *([w[i] for w in waiting] for i in range(4))))
        if wake is not None:
            state.setTimeoutTimestamp(max(-(-wake // 10**6), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=["series_id", "seq", "chron_ns", "kind", "value"])

    kind = F.when(F.col("meas").isNull(), _MISSING).when(F.isnan("meas"), _BROKEN).otherwise(_NUMBER)
    timed = stream.select("series_id", "seq", "chron_ns", kind.alias("kind"), F.when(kind == _NUMBER, F.col("meas")).otherwise(0.0).alias("value"), F.timestamp_micros(_micros(F.col("chron_ns"))).alias("at"))
    made = timed.withWatermark("at", delay).groupBy("series_id").applyInPandasWithState(run, _MADE, _HELD, "append", GroupStateTimeout.EventTimeTimeout)
    meas = F.when(F.col("kind") == _NUMBER, F.col("value")).when(F.col("kind") == _BROKEN, float("nan"))
    return made.select("series_id", "seq", "chron_ns", meas.alias("meas"))


def silences_stream(stream: DataFrame, max_gap: int | str, watermark: str = "10 seconds") -> DataFrame:
    """series_id, seq, chron_ns, meas (missing): an alarm at max_gap after a reading that nothing followed in time,
    as soon as the watermark shows it. Readings may come in any order within the watermark; later ones are lost."""
    gap = ns(max_gap)
    if gap <= 0:
        raise AlarmArgumentError(f"a silence of {max_gap} isn't above zero")

    def passed(held, reading):
        chron, seq, kind, value = reading
        quiet = held is not None and not held[3] and held[1] != _MISSING and chron - held[0] > gap
        return [(seq, held[0] + gap, _MISSING, 0.0)] if quiet else [], (chron, kind, value, False)

    def due(held):
        last, kind, _, told = held
        return None if told or kind == _MISSING else (last + gap, (0, last + gap, _MISSING, 0.0))

    return _in_order(stream, watermark, passed, due)


def reduced_stream(stream: DataFrame, band: float = 0.0, watermark: str = "10 seconds") -> DataFrame:
    """series_id, seq, chron_ns, meas: the first reading of a series, and each that differs from the last one kept by more than ``band`` or is of another class,
    once the watermark has reached it. A series' last reading isn't told, as a stream has none."""
    if band != band or band < 0:
        raise RegularizeArgumentError(f"band {band} is negative or NaN")

    def passed(held, reading):
        chron, seq, kind, value = reading
        if held is not None and held[1] == kind and (kind != _NUMBER or not (value != held[2] and abs(value - held[2]) > band)):
            return [], held
        return [(seq, chron, kind, value)], (chron, kind, value, False)

    return _in_order(stream, watermark, passed)


def append_stream(stream: DataFrame, path: str, checkpoint: str):
    """Appends arriving readings to a table by series; however late, none is lost. Returns the started query."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("series_id").outputMode("append").trigger(availableNow=True).start()
