"""Detectors: stillness, wear by temperature slopes, gait events and strides, transfers, tree ensembles.

Kernels see one recording, day or bout at a time; what comes before and after is
window expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import axes, dsp
from kinelake.operators.intervals import runs
from kinelake.operators.kernels import _axes, per_recording
from kinelake.operators.windows import KEY, centred_sd

GRAVITY = 9.81

# -- stillness --------------------------------------------------------------


def stillness(df: DataFrame, dt: float, window: float = 0.3, gravity: float = 1.0, mean: float = 0.02, sd: float = 0.02, jerk_mean: float = 0.25, jerk_sd: float = 0.5, long: float = 0.5) -> DataFrame:
    """Still intervals of a filtered magnitude x: recording_id, start_idx, stop_idx, long.

    Mean and deviation of x and of its derivative must all lie under their limits.
    """
    n = max(int(round(window / dt)), 2)
    a = centred_sd(df, "x", n).withColumnsRenamed({"mean": "am", "sd": "asd"})
    j = centred_sd(df.select(KEY, "sample_idx", axes.gradient("x", dt).alias("j")), "j", n).withColumnsRenamed({"mean": "jm", "sd": "jsd"})
    still = (F.abs(F.col("am") - gravity) < mean) & (F.col("asd") < sd) & (F.abs("jm") < jerk_mean) & (F.col("jsd") < jerk_sd)
    s = a.join(j, [KEY, "sample_idx"]).select(KEY, "sample_idx", F.when(still, 1).otherwise(0).alias("still"))
    return runs(s, "still").filter("state = 1").select(KEY, "start_idx", "stop_idx", (F.col("length") * dt > long).alias("long"))


def whole_transfers(transfers: DataFrame, factor: float = 0.75) -> DataFrame:
    """Transfers (recording_id, day_n, displacement) without those under `factor` of the day's median displacement."""
    day = Window.partitionBy(KEY, "day_n")
    return transfers.withColumn("_m", F.expr("percentile(displacement, 0.5)").over(day)).filter(F.col("displacement") >= factor * F.col("_m")).drop("_m")


# -- wear by temperature ----------------------------------------------------


def _forward(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over the next n values; NaN where they are not all there."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[: len(x) - n + 1] = f(np.lib.stride_tricks.sliding_window_view(x, n), axis=1)
    return out


def nonwear_by_slope(df: DataFrame, fs: float, seconds: int = 4, sd: float = 0.008, calm_axes: int = 2, low: float = 26.0, high: float = 30.0, fall: float = -0.2, rise: float = 0.1) -> DataFrame:
    """Nonwear intervals (in samples) that begin calm and cold or cooling, and end moving and warm or warming.

    Deviations are of the minute ahead and behind; a start needs 90 % calm in the
    next five minutes, an end at most 50 % calm in the last five.  Starts and ends
    pair off in order of time.
    """
    block = int(seconds * fs)
    sos = dsp.butterworth(2, 0.005 * seconds * 2, "low")

    def run(data):
        a, temp = _axes(data), data["temperature"].to_numpy()
        n, minute, five = len(temp) // block, int(60 * fs), int(300 // seconds)
        empty = {"start_idx": np.zeros(0, np.int64), "stop_idx": np.zeros(0, np.int64)}
        if n <= max(five, 16) or len(temp) < minute:
            return empty
        t = dsp.zero_phase(sos, temp[: n * block].reshape(n, block).mean(axis=1))
        slope = np.diff(t, prepend=t[0]) * 60 / seconds
        view = np.lib.stride_tricks.sliding_window_view(a, minute, axis=0)[::block]
        calm = np.full(n, -1)
        k = min(n, len(view))
        calm[:k] = (view[:k].std(axis=2, ddof=1) < sd).sum(axis=1)
        behind = np.full(n, -1)
        shift = minute // block
        behind[shift:] = calm[: n - shift]
        ahead5 = _forward((calm >= calm_axes).astype(float), five, np.mean)
        behind5 = np.full(n, np.nan)
        behind5[five - 1 :] = _forward((behind >= calm_axes).astype(float), five, np.mean)[: n - five + 1]
        top, least, trend = _forward(t, five, np.max), _forward(t, five, np.min), _forward(slope, five, np.mean)
        start = (calm >= calm_axes) & (ahead5 >= 0.9) & ((top < high) & (trend < fall) | (top < low))
        stop = np.flatnonzero((behind == 0) & (behind5 <= 0.5) & ((trend > rise) | (least > low)))
        out, end = [], 0
        for s in np.flatnonzero(start).tolist():
            if s >= end:
                later = stop[stop > s + five]
                end = int(later[0]) if len(later) else n
                out.append((s * block, min(end * block, len(temp))))
        return {"start_idx": np.array([s for s, _ in out], np.int64), "stop_idx": np.array([e for _, e in out], np.int64)}

    return per_recording(df.select(KEY, "sample_idx", "ax", "ay", "az", "temperature"), run, "start_idx long, stop_idx long")


# -- gait -------------------------------------------------------------------

#: Cycles a second of the first derivative of a Gaussian at scale 1.
GAUS1_FREQUENCY = 0.2


def gaus1(x: np.ndarray, scale: float) -> np.ndarray:
    """Continuous wavelet transform of x with the first derivative of a Gaussian at one scale (in samples)."""
    k = np.arange(-int(5 * scale) - 1, int(5 * scale) + 2) / scale
    kernel = -2 * k * np.exp(-(k**2)) / (np.pi / 2) ** 0.25 / np.sqrt(scale)
    return np.convolve(x, kernel[::-1], "full")[len(k) // 2 :][: len(x)]


def cumulative_trapezoid(x: np.ndarray, dt: float) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum((x[1:] + x[:-1]) / 2) * dt]) if len(x) else x


def detrended(x: np.ndarray) -> np.ndarray:
    t = np.arange(len(x))
    return x - np.polyval(np.polyfit(t, x, 1), t) if len(x) > 1 else x - x


def contacts(forward: np.ndarray, fs: float, step_frequency: float, sign: int = 1, prominence: tuple[float, float] = (0.6, 0.6), spacing: tuple[float, float] = (0.5, 0.5)) -> tuple[np.ndarray, np.ndarray]:
    """Initial and final contacts of a bout from forward acceleration.

    Final contacts are peaks of the transformed velocity; an initial contact lies
    midway between the zero crossing after the last peak of the transformed
    acceleration before, and the trough that follows.
    """
    scale = lambda f: GAUS1_FREQUENCY * fs / f
    near = lambda share: max(int(share * fs / step_frequency), 1)
    v = sign * gaus1(cumulative_trapezoid(forward, 1 / fs), scale(1.17 * step_frequency - 0.3))
    a = sign * gaus1(forward, scale(1.3 * step_frequency - 0.3))
    final = dsp.find_peaks(v, prominence=prominence[1] * v.std(), distance=near(spacing[1]))
    up = dsp.find_peaks(-a, prominence=prominence[0] * a.std(), distance=near(spacing[0]))
    down = dsp.find_peaks(a, prominence=prominence[0] * a.std(), distance=near(spacing[0]))
    first = []
    for f in final.tolist():
        trough = down[(down < f) & (down > f - 2 * fs)]
        peak = up[up < trough[-1]] if len(trough) else trough
        if len(peak):
            falls = np.flatnonzero(np.diff(np.sign(-a[peak[-1] :])) < 0)
            first.append(int((peak[-1] + (falls[0] if len(falls) else 0) + trough[-1]) / 2))
    return np.unique(np.array(first, np.int64)), final


def strides_of(first: np.ndarray, final: np.ndarray, fs: float, step_time: float, max_stride: float | None = None, loading: float = 0.17, strict: bool = True) -> list[tuple[int, int, int, int]]:
    """Strides (ic, fc, fc_opp, forward_cycles) whose contacts follow each other in time.

    An initial contact needs the other foot's final contact, alone, within the
    loading time, its own within stance, and, if strict, none of its kind before
    the first and no final contact at the same sample.
    """
    longest = max_stride or 2 * step_time + 1.0
    load = loading * longest
    stance = longest / 2 + load
    free = ~np.isin(final, first) if strict else np.ones(len(final), bool)
    rows = []
    for i, ic in enumerate((first[:-1] if strict else first).tolist()):
        ahead = np.flatnonzero((final > ic) & free)
        if not len(ahead):
            continue
        after = (final[ahead] - ic) / fs
        if strict and (first[i + 1] - ic) / fs < after[0] or (after < load).sum() != 1 or (after < stance).sum() < 2:
            continue
        rows.append([ic, int(final[ahead[1]]), int(final[ahead[0]]), 0])
        free[ahead[0]] = False
    for k in range(len(rows)):
        if k + 2 < len(rows):
            rows[k][3] += (rows[k + 2][0] - rows[k][0]) / fs < longest
        if k + 1 < len(rows):
            rows[k][3] += rows[k + 1][2] == rows[k][1]
    return [tuple(int(v) for v in r) for r in rows]


def _fall(vertical: np.ndarray, ic: int, ic_next: int, fc_opp: int, fs: float) -> tuple[float, float, float]:
    """Vertical ranges in m of a step: plain, and after and before the other foot's final contact with drift removed."""
    twice = lambda a: cumulative_trapezoid(cumulative_trapezoid(a, 1 / fs), 1 / fs)
    span = lambda p: float(p.max() - p.min()) * GRAVITY if len(p) else float("nan")
    lo, hi = max(0, 2 * ic - ic_next), min(len(vertical) - 1, 2 * ic_next - ic)
    wide = cumulative_trapezoid(detrended(cumulative_trapezoid(vertical[lo:hi], 1 / fs)), 1 / fs)
    return span(twice(vertical[ic:ic_next])), span(wide[fc_opp - lo : ic_next - lo]), span(wide[ic - lo : fc_opp - lo])


STRIDES = "recording_id long, day_n int, bout_n long, stride_idx long, ic long, fc long, fc_opp long, forward_cycles long, h1 double, h2 double, h2b double"
_STRIDES = pa.schema([(KEY, pa.int64()), ("day_n", pa.int32()), ("bout_n", pa.int64()), ("stride_idx", pa.int64()), ("ic", pa.int64()), ("fc", pa.int64()), ("fc_opp", pa.int64()), ("forward_cycles", pa.int64()), ("h1", pa.float64()), ("h2", pa.float64()), ("h2b", pa.float64())])


def stride_rows(key, vertical: np.ndarray, strides: list[tuple[int, int, int, int]], fs: float) -> pa.Table:
    """The stride table of one bout from its strides and its vertical acceleration without trend."""
    out = []
    for k, (ic, fc, opp, cycles) in enumerate(strides):
        h = _fall(vertical, ic, strides[k + 1][0], opp, fs) if cycles >= 1 and k + 1 < len(strides) else (None,) * 3
        out.append((key[0].as_py(), key[1].as_py(), key[2].as_py(), k, ic, fc, opp, cycles, *h))
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _STRIDES, strict=True)], schema=_STRIDES) if out else _STRIDES.empty_table()


def gait_bouts(df: DataFrame, fs: float, step_frequency: float | None = None) -> DataFrame:
    """Stride table of bouts: recording_id, day_n, bout_n and columns for operators.gait.

    df: recording_id, day_n, bout_n, sample_idx, v, ap (vertical and forward
    acceleration in g).  Without a step frequency the strongest lag of the
    vertical autocorrelation in 0.4-5 Hz is taken.  A bout too short for its
    filter gives no strides.
    """
    low = dsp.butterworth(4, 20 / (fs / 2), "low") if fs > 40 else None
    def run(key, data):
        data = data.sort_by("sample_idx")
        v, ap = data["v"].to_numpy(), data["ap"].to_numpy()
        try:
            v, ap = (dsp.zero_phase(low, x) if low is not None else x for x in (v, ap))
        except ValueError:
            return _STRIDES.empty_table()
        f = step_frequency or _step_frequency(detrended(v), fs)
        return stride_rows(key, detrended(v), strides_of(*contacts(detrended(ap), fs, f), fs, 1 / f), fs)

    return df.groupBy(KEY, "day_n", "bout_n").applyInArrow(run, STRIDES)

def _step_frequency(x: np.ndarray, fs: float) -> float:
    size = 2 ** int(np.ceil(np.log2(2 * len(x))))
    r = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2)[: len(x)]
    lags = np.arange(max(1, int(fs / 5)), min(len(x), int(fs / 0.4)))
    return float(np.clip(fs / lags[np.argmax(r[lags])], 0.4, 5)) if len(lags) else 1.0


# -- transfers --------------------------------------------------------------


def transfers(df: DataFrame, fs: float, still: tuple[float, float] = (0.02, 0.02), velocity: float = 0.2, displacement: float = 0.125, balance: float = 10.0, band: float = 0.5) -> DataFrame:
    """Sit-to-stand transfers: recording_id, start_idx, stop_idx, duration, max_accel, min_accel, displacement, sparc.

    Peaks of wavelet power under `band` Hz are candidates.  From the last still
    moment before a peak, vertical acceleration is integrated twice with its
    drift removed; a transfer runs from the upward to the downward zero crossing
    of velocity around the peak and must be short, balanced and high enough.
    """
    dt = 1 / fs
    smooth, tilt = dsp.butterworth(4, 5.0 / (fs / 2), "low"), dsp.butterworth(4, 0.8 / (fs / 2), "low")
    names = ("start_idx", "stop_idx", "duration", "max_accel", "min_accel", "displacement", "sparc")

    def run(data):
        a = _axes(data)
        none = {n: np.zeros(0, np.int64 if "idx" in n else float) for n in names}
        try:
            x = dsp.zero_phase(smooth, np.linalg.norm(a, axis=1))
            down = np.stack([dsp.zero_phase(tilt, a[:, k], 0) for k in range(3)], axis=1)
        except ValueError:
            return none
        vertical = (down / np.maximum(np.linalg.norm(down, axis=1, keepdims=True), 1e-12) * a).sum(axis=1) * GRAVITY
        w = max(int(round(0.25 * fs)), 2)
        if len(x) < 2 * w:
            return none
        view = np.lib.stride_tricks.sliding_window_view(x, w)
        calm = np.zeros(len(x), bool)
        calm[w // 2 : w // 2 + len(view)] = (np.abs(view.mean(axis=1) - 1) < still[0]) & (view.std(axis=1, ddof=1) < still[1])
        mean = np.full(len(x), x.mean())
        mean[w // 2 : w // 2 + len(view)] = view.mean(axis=1)
        scales = [s for s in range(1, 65) if GAUS1_FREQUENCY * fs / s <= band] or [64]
        power = sum(gaus1(mean - mean.mean(), s) for s in scales)  # without the constant, ends make no peaks
        edges = np.diff(calm.astype(int), prepend=0, append=0)
        begins, ends = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
        rows: list = []
        for p in dsp.find_peaks(power, height=power.std(ddof=1)).tolist():
            before = ends[ends < p]
            if not len(before) or (p - before[-1]) * dt > 30:
                continue
            after = begins[begins > p]
            rest = bool(len(after)) and (after[0] - p) * dt < 30
            lo, hi = int(before[-1]), min(int(after[0]) if rest else int(p + 5 * fs), len(x))
            vel = cumulative_trapezoid(vertical[lo:hi], dt)
            if len(vel) < 3:
                continue
            vel = vel - np.linspace(vel[0], vel[-1], len(vel)) if rest else detrended(vel)
            pos = cumulative_trapezoid(vel, dt)
            if vel[p - lo] < velocity:
                continue
            turn = np.diff(np.sign(vel))
            up, off = np.concatenate([[0], np.flatnonzero(turn > 0) + 1]), np.append(np.flatnonzero(turn < 0) + 1, len(vel) - 1)
            s, e = up[up <= p - lo][-1], off[off > p - lo]
            if not len(e):
                continue
            s, e = int(s), int(e[0])
            if rows and (lo + s - rows[-1][0]) * dt <= 0.4:
                continue
            height = pos[e] - pos[s]
            if (e - s) * dt < 4.5 and (p - lo - s) < balance * (e - (p - lo)) and height > displacement:
                part = slice(lo + s, lo + e)
                rows.append((lo + s, lo + e, (e - s) * dt, x[part].max(), x[part].min(), height, float(dsp.sparc(np.linalg.norm(a[part], axis=1)[None, :], fs)[0])))
        return {n: np.array(c, np.int64 if "idx" in n else float) for n, c in zip(names, zip(*rows, strict=True), strict=True)} if rows else none

    return per_recording(df.select(KEY, "sample_idx", "ax", "ay", "az"), run, "start_idx long, stop_idx long, duration double, max_accel double, min_accel double, displacement double, sparc double")


# -- tree ensembles ---------------------------------------------------------


@dataclass
class Trees:
    """An ensemble of binary decision trees with numeric splits, read from a text dump of a boosted model."""

    trees: list[dict[str, np.ndarray]]
    features: int
    sigmoid: float

    @classmethod
    def parse(cls, text: str) -> Trees:
        trees, features, slope, current = [], 0, 1.0, None
        for line in text.splitlines():
            name, _, value = line.partition("=")
            if name == "max_feature_idx":
                features = int(value) + 1
            elif name == "objective":
                slope = float(value.split("sigmoid:")[1].split()[0]) if "sigmoid:" in value else slope
            elif name == "Tree":
                current = {}
                trees.append(current)
            elif line == "end of trees":
                break
            elif current is not None and name in ("split_feature", "left_child", "right_child"):
                current[name] = np.array(value.split(), np.int64)
            elif current is not None and name in ("threshold", "leaf_value"):
                current[name] = np.array(value.split(), float)
        return cls(trees, features, slope)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sums of leaf values; all rows walk down each tree together."""
        out = np.zeros(len(x))
        for tree in self.trees:
            leaf = tree["leaf_value"]
            if "split_feature" not in tree or not len(tree["split_feature"]):
                out += leaf[0]
                continue
            node, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
            while len(open_):
                at = node[open_]
                left = x[open_, tree["split_feature"][at]] <= tree["threshold"][at]
                node[open_] = np.where(left, tree["left_child"][at], tree["right_child"][at])
                open_ = open_[node[open_] >= 0]
            out += leaf[-node - 1]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.sigmoid * self.margin(x)))


def scored(df: DataFrame, columns: list[str], model: Trees, limit: float) -> DataFrame:
    """df with probability and positive (probability over limit); the parsed model is broadcast."""
    if len(columns) != model.features:
        raise ValueError(f"the model takes {model.features} features, not {len(columns)}")
    known = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
            yield batch.append_column("probability", pa.array(known.value.probability(x)))

    from pyspark.sql.types import DoubleType, StructField, StructType

    out = df.mapInArrow(run, StructType([*df.schema.fields, StructField("probability", DoubleType())]))
    return out.withColumn("positive", F.col("probability") > limit)
