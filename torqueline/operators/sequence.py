"""Sequence operators N1-N13 over a :class:`Timeline`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torqueline.functions.numeric import mps2_to_g, kph_to_mps, rate, rolling_std_of
from torqueline.functions.text import epoch_micros
from torqueline.operators.timeline import Timeline

# Driving styles.
PASSIVE, MODERATE, AGGRESSIVE, UNKNOWN = "Passive", "Moderate", "Aggressive", "UNKNOWN_STYLE"


@dataclass(frozen=True)
class Thresholds:
    """Limits of the driving-style rule (km/h, rpm, %, g, per second)."""

    moving_speed: float = 2
    braking_g: float = -0.25
    entry_rpm: float = 2700
    entry_throttle: float = 40
    hold_rpm: float = 2300
    accelerating_g: float = 0.1
    rpm_rate: float = 500
    throttle_rate: float = 45
    moderate_rpm: float = 2100
    moderate_throttle: float = 25


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (epoch_micros(later) - epoch_micros(earlier)) / F.lit(1e6)


def time_gap(tl: Timeline, out: str = "time_diff", first: float | None = None) -> Timeline:
    """Seconds since the previous row; the first row of a series gets ``first``."""
    ts = F.col(tl.order[0])
    tl = tl.scan(previous={"__ts": ts})
    gap = seconds_between(ts, F.col("__ts"))
    if first is not None:
        gap = F.coalesce(gap, F.when(F.col("__ts").isNull(), F.lit(float(first))))
    return tl.with_columns({out: gap}).drop("__ts")


def delta(tl: Timeline, col: str, out: str) -> Timeline:
    """Difference to the previous row, 0 where there is none."""
    tl = tl.scan(previous={"__before": F.col(col)})
    return tl.with_columns({out: F.coalesce(F.col(col) - F.col("__before"), F.lit(0.0))}).drop("__before")


def rates_of_change(tl: Timeline, columns: Mapping[str, str], gap: str) -> Timeline:
    """``{out: col}``: change per second of several columns, one pass; ``gap`` holds seconds."""
    tl = tl.scan(previous={f"__was_{c}": F.col(c) for c in columns.values()})
    out = {o: rate(F.col(c), F.col(f"__was_{c}"), F.col(gap)) for o, c in columns.items()}
    return tl.with_columns(out).drop(*[f"__was_{c}" for c in columns.values()])


def forward_fill(tl: Timeline, columns: Sequence[str]) -> Timeline:
    """Carry the last present value forward, in place."""
    tl = tl.scan(latest={f"__fill_{c}": F.col(c) for c in columns})
    return tl.with_columns({c: F.col(f"__fill_{c}") for c in columns}).drop(*[f"__fill_{c}" for c in columns])


def hold_last_multirate(tl: Timeline, signals: Sequence[str]) -> Timeline:
    """Latest *reading* of each signal, where a reading may be a failed (NULL) one.

    Each signal column is a struct ``(value)``: a NULL struct means "not polled in this
    row" and keeps the held value, a struct holding NULL means "polled, no answer" and
    clears it.
    """
    tl = tl.scan(latest={f"__hold_{s}": F.col(s) for s in signals})
    return tl.with_columns({s: F.col(f"__hold_{s}")["value"] for s in signals}).drop(*[f"__hold_{s}" for s in signals])


def polled_rows(readings: DataFrame, keys: Sequence[str], signals: Sequence[str], signal: str = "signal",
                value: str = "value") -> DataFrame:
    """Long readings (keys, signal, value) to one row per poll with a struct per signal."""
    polled = [
        F.max(F.when(F.col(signal) == s, F.struct(F.col(value).alias("value")))).alias(s) for s in signals
    ]
    return readings.groupBy(*keys).agg(*polled)


def rolling_std(tl: Timeline, col: str, out: str, size: int = 3) -> Timeline:
    """Sample deviation over the last ``size`` rows, 0 where fewer than two values are present."""
    names = [col]
    for i in range(1, size):
        tl = tl.scan(previous={f"__lag{i}": F.col(names[-1])})
        names.append(f"__lag{i}")
    return tl.with_columns({out: rolling_std_of([F.col(n) for n in names])}).drop(*names[1:])


def sessionize(tl: Timeline, gap_s: float = 3600, out: str = "new_session", gap: str | None = None) -> Timeline:
    """Number of gaps longer than ``gap_s`` seen so far in the series."""
    own = gap is None
    if own:
        gap = "__gap"
        tl = time_gap(tl, gap)
    jump = F.coalesce((F.col(gap) > F.lit(gap_s)).cast("long"), F.lit(0))
    tl = tl.scan(running={out: jump})
    return tl.drop(gap) if own else tl


def run_ids(tl: Timeline, flag: Column, out: str = "run_id", start: str | None = None) -> Timeline:
    """Number of flag changes so far; the row before the first counts as false."""
    tl = tl.with_columns({"__flag": F.coalesce(flag, F.lit(False))})
    tl = tl.scan(previous={"__was": F.col("__flag")})
    tl = tl.with_columns({"__turn": F.col("__flag") != F.coalesce(F.col("__was"), F.lit(False))})
    tl = tl.scan(running={out: F.col("__turn").cast("long")})
    if start:
        tl = tl.with_columns({start: F.col("__turn")})
    return tl.drop("__flag", "__was", "__turn")


def run_spans(tl: Timeline, flag: Column, first: str = "run_start", last: str = "run_end") -> Timeline:
    """First and last timestamp of the run each row belongs to.

    Found by looking back to the run's first row and ahead to its last one, so a run of
    any length needs neither a join nor a group of its own.
    """
    ts = F.col(tl.order[0])
    tl = tl.with_columns({"__flag": F.coalesce(flag, F.lit(False))})
    here = F.col("__flag")
    tl = tl.scan(previous={"__was": here}, following={"__next": here})
    begins = F.col("__was").isNull() | (F.col("__was") != here)
    ends = F.col("__next").isNull() | (F.col("__next") != here)
    tl = tl.scan(latest={first: F.when(begins, ts)}, upcoming={last: F.when(ends, ts)})
    return tl.drop("__was", "__next", "__flag")


def idle_runs(tl: Timeline, col: str = "SPEED", min_s: float = 60, label: str = "driving_style",
              value: str = "idle") -> Timeline:
    """Label runs of zero ``col`` that last at least ``min_s`` seconds; NULL is not zero."""
    zero = F.coalesce(F.col(col) == 0, F.lit(False))
    tl = run_spans(tl, zero, "__from", "__to")
    idle = zero & (seconds_between("__to", "__from") >= F.lit(min_s))
    before = F.col(label) if label in tl.df.columns else F.lit(None).cast("string")
    return tl.with_columns({label: F.when(idle, F.lit(value)).otherwise(before)}).drop("__from", "__to")


def sessions_and_idle(tl: Timeline, session_gap_s: float = 3600, idle_s: float = 60, col: str = "SPEED",
                      label: str = "driving_style", value: str = "idle") -> Timeline:
    """:func:`time_gap`, :func:`sessionize` and :func:`idle_runs` in two scans."""
    ts = F.col(tl.order[0])
    tl = tl.with_columns({"__zero": F.coalesce(F.col(col) == 0, F.lit(False))})
    zero = F.col("__zero")
    tl = tl.scan(previous={"__ts": ts, "__was": zero}, following={"__next": zero})
    tl = tl.with_columns({"time_diff": seconds_between(ts, "__ts")})
    tl = tl.scan(
        latest={"__from": F.when(F.col("__was").isNull() | (F.col("__was") != zero), ts)},
        upcoming={"__to": F.when(F.col("__next").isNull() | (F.col("__next") != zero), ts)},
        running={"new_session": F.coalesce((F.col("time_diff") > F.lit(session_gap_s)).cast("long"), F.lit(0))},
    )
    idle = zero & (seconds_between("__to", "__from") >= F.lit(idle_s))
    before = F.col(label) if label in tl.df.columns else F.lit(None).cast("string")
    tl = tl.with_columns({label: F.when(idle, F.lit(value)).otherwise(before)})
    return tl.drop("__zero", "__ts", "__was", "__next", "__from", "__to")


def run_summary(df: DataFrame, keys: Sequence[str], ts: str, flag: str) -> DataFrame:
    """Per run: flag of the first row, first and last timestamp, duration in seconds."""
    out = df.groupBy(*keys).agg(
        F.min_by(flag, ts).alias(flag), F.min(ts).alias("start_time"), F.max(ts).alias("end_time")
    )
    return out.withColumn("duration_sec", seconds_between("end_time", "start_time"))


def row_index(tl: Timeline, out: str = "row_index") -> Timeline:
    """Position of the row in its series, from 0."""
    tl = tl.scan(running={out: F.lit(1).cast("long")})
    return tl.with_columns({out: F.col(out) - 1})


def gap_report(tl: Timeline, gap_s: float = 3600) -> DataFrame:
    """Rows, gaps over the threshold, largest, mean and smallest gap."""
    gaps = time_gap(tl, "__gap").frame
    g = F.col("__gap")
    return gaps.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(g > F.lit(gap_s)).alias("gaps_over"),
        F.max(g).alias("max_gap"),
        F.avg(g).alias("mean_gap"),
        F.min(g).alias("min_gap"),
    )


def status_change(tl: Timeline, status: str) -> DataFrame:
    """Rows whose status differs from the one before, the first row of a series included."""
    tl = tl.scan(previous={"__was": F.struct(F.col(status).alias("s"))})
    return tl.with_frame(
        tl.df.filter(F.col("__was").isNull() | ~F.col("__was")["s"].eqNullSafe(F.col(status)))
    ).drop("__was").frame


def fill_and_rate(tl: Timeline) -> Timeline:
    """Gap, filled signals and the rates the driving-style rule needs, in one scan.

    Same as :func:`time_gap`, :func:`forward_fill`, zeros for what is still missing, and
    :func:`rates_of_change`: the filled value of the row before is the latest present
    one before this row.
    """
    ts, signals = F.col(tl.order[0]), ["SPEED", "RPM", "THROTTLE_POS"]
    tl = tl.scan(
        previous={"__ts": ts},
        latest={f"__now_{c}": F.col(c) for c in signals},
        latest_before={f"__was_{c}": F.col(c) for c in signals},
    )
    tl = tl.with_columns({"delta_time_s": F.coalesce(seconds_between(ts, "__ts"), F.lit(0.0))})
    tl = tl.with_columns({c: F.coalesce(F.col(f"__now_{c}"), F.lit(0.0)) for c in signals})
    was = {c: F.coalesce(F.col(f"__was_{c}"), F.lit(0.0)) for c in signals}
    gap = F.col("delta_time_s")
    tl = tl.with_columns({"SPEED_mps": kph_to_mps("SPEED")})
    tl = tl.with_columns({
        "acceleration_mps2": rate(F.col("SPEED_mps"), kph_to_mps(was["SPEED"]), gap),
        "RPM_roc": rate(F.col("RPM"), was["RPM"], gap),
        "THROTTLE_roc": rate(F.col("THROTTLE_POS"), was["THROTTLE_POS"], gap),
    })
    tl = tl.with_columns({"acceleration_g": mps2_to_g("acceleration_mps2")})
    return tl.drop("__ts", *[f"__{m}_{c}" for m in ("now", "was") for c in signals])


def driving_style(tl: Timeline, limits: Thresholds = Thresholds(), out: str = "driving_style_analyzed",
                  known_state: str | None = None) -> Timeline:
    """Stateful driving style of each row.

    An event sets the aggressive state, a row that cannot hold it clears it, and any
    other row keeps it, so the state is the latest set-or-clear mark.
    ``known_state`` names a boolean column that fixes the state where it is present.
    """
    needed = {"RPM", "THROTTLE_POS", "SPEED", "acceleration_g"}
    if not needed <= set(tl.df.columns):
        return tl.with_columns({out: F.lit(UNKNOWN)})
    speed, rpm, throttle = F.col("SPEED"), F.col("RPM"), F.col("THROTTLE_POS")
    moving = speed > limits.moving_speed
    surge = (F.col("RPM_roc") > limits.rpm_rate) | (F.col("THROTTLE_roc") > limits.throttle_rate)
    event = F.coalesce(
        moving
        & (
            (F.col("acceleration_g") < limits.braking_g)
            | ((rpm > limits.entry_rpm) & (throttle > limits.entry_throttle))
            | ((F.col("acceleration_g") > limits.accelerating_g) & surge)
        ),
        F.lit(False),
    )
    holds = F.coalesce((rpm > limits.hold_rpm) & moving, F.lit(False))
    mark = F.when(event, F.lit(True)).when(~holds, F.lit(False))
    if known_state:
        mark = F.coalesce(F.col(known_state), mark)
    tl = tl.scan(latest={"__state": mark})
    state = F.coalesce(F.col("__state"), F.lit(False))
    moderate = moving & ((rpm > limits.moderate_rpm) | (throttle > limits.moderate_throttle))
    style = F.when(state, F.lit(AGGRESSIVE)).when(moderate, F.lit(MODERATE)).otherwise(F.lit(PASSIVE))
    return tl.with_columns({out: style}).drop("__state")
