"""Gait endpoints that need a bout's signal: covariances, harmonic ratio, smoothness, regularity, symmetry, turns.

Samples and strides of one (recording, day, bout) meet in one Arrow group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinelake.functions import dsp
from kinelake.operators.gait import BOUT

#: Parameters of the older generation of gait analysis: longest stride (s) and loading share.
LEGACY = {"max_stride": 2.25, "loading": 0.2}
HARMONICS, TRANSFORM = 20, 1024


def lagged_correlations(x: np.ndarray, lags: int, biased: bool = False) -> np.ndarray:
    """Pearson's r of x with itself k samples on, for k under lags and ten samples of overlap; 0 beyond."""
    out, n = np.zeros(lags), len(x)
    total, square = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    for k in range(min(lags, n - 10)):
        m = n - k
        a, b = total[m], total[n] - total[k]
        cov = x[:m] @ x[k:] - a * b / m
        va, vb = square[m] - a * a / m, square[n] - square[k] - b * b / m
        out[k] = cov / np.sqrt(va * vb) if va > 0 and vb > 0 else 0.0
    return out * (n - np.arange(lags)) / n if biased else out


def _one_lag(x: np.ndarray, k: int) -> float:
    if not 0 < k < len(x) - 1:
        return float("nan")
    with np.errstate(invalid="ignore"):
        return float(np.corrcoef(x[:-k], x[k:])[0, 1])


def harmonic_ratio(x: np.ndarray, fs: float, stride_time: float) -> float:
    """Even by odd harmonics of the stride; NaN if ten or fewer lie in range."""
    f = np.abs(np.fft.rfft(x[:TRANSFORM], TRANSFORM))
    first = int(round(TRANSFORM / (fs * stride_time)))
    at = first * np.arange(1, HARMONICS + 1)
    at = at[at < len(f)]
    odd = f[at[::2]].sum()
    return float(f[at[1::2]].sum() / odd) if len(at) > 10 and odd > 0 else float("nan")


def _nearest_peak(c: np.ndarray, lag: float) -> int | None:
    peaks = dsp.find_peaks(c)
    return int(peaks[np.argmin(np.abs(peaks - round(lag)))]) if len(peaks) and np.isfinite(lag) else None


def turns(gyro: np.ndarray, accel: np.ndarray, fs: float, angle: float = np.pi / 2) -> np.ndarray:
    """-1, 0 or 1 for each sample: the direction of turns of at least `angle` about the vertical.

    Yaw is the rotation about gravity, taken where the bout is calmest, summed over
    time; brief reversals between larger turns one way belong to them.
    """
    n = max(int(0.05 * fs), 1)
    size = np.linalg.norm(accel[: int(2 * fs)], axis=1)
    view = np.lib.stride_tricks.sliding_window_view(size, min(n, len(size)))
    at = int(np.argmin(view.max(axis=1) - view.min(axis=1)))
    up = accel[at : at + n].mean(axis=0)
    yaw = np.cumsum(gyro @ (up / max(np.linalg.norm(up), 1e-12))) / fs
    sign = np.sign(np.diff(yaw, append=yaw[-1:])).astype(np.int64)

    def pieces():
        start = np.concatenate([[0], np.flatnonzero(np.diff(sign)) + 1])
        stop = np.append(start[1:], len(sign))
        return start, stop, np.abs(yaw[np.minimum(stop, len(yaw) - 1)] - yaw[start])

    start, stop, size = pieces()
    for k in range(1, len(start) - 1):
        around = size[k - 1], size[k + 1]
        if (stop[k] - start[k]) / fs < 0.5 and min(around) >= np.radians(10) and max(around) > np.pi / 4 and size[k] < 0.1 * sum(around):
            sign[start[k] : stop[k]] = sign[start[k] - 1]
    start, stop, size = pieces()
    for a, b, s in zip(start, stop, size, strict=True):
        if s < angle:
            sign[a:b] = 0
    return sign


_NAMES = ("intra_step_covariance", "intra_stride_covariance", "harmonic_ratio", "stride_sparc", "step_regularity", "stride_regularity", "gait_symmetry_index")


def signal_endpoints(samples: DataFrame, strides: DataFrame, fs: float) -> DataFrame:
    """One row a stride: keys, stride_idx, the endpoints named in _NAMES, and in_turn (0-2 contacts; null without gyroscope).

    samples: recording_id, day_n, bout_n, sample_idx, v, ap, ml (and gx, gy, gz);
    contacts count samples from the bout's first.
    """
    schema = pa.schema([("recording_id", pa.int64()), ("day_n", pa.int32()), ("bout_n", pa.int64()), ("stride_idx", pa.int64()), *[(n, pa.float64()) for n in _NAMES], ("in_turn", pa.int32())])
    low = dsp.butterworth(4, 10 / (fs / 2), "low") if 20 < fs else None
    gyro = {"gx", "gy", "gz"} <= set(samples.columns)

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left, right = left.sort_by("sample_idx"), right.sort_by("ic")
        a = np.stack([left[c].to_numpy() for c in ("v", "ap", "ml")], axis=1)
        ic, fc, cycles = (right[c].to_numpy() for c in ("ic", "fc", "forward_cycles"))
        n, v, out = len(ic), a[:, 0], {c: np.full(len(ic), np.nan) for c in _NAMES}
        step, stride = np.full(n, np.nan), np.full(n, np.nan)
        step[:-1], stride[:-2] = np.where(cycles[:-1] >= 1, ic[1:] - ic[:-1], np.nan), np.where(cycles[:-2] >= 2, ic[2:] - ic[:-2], np.nan)
        for i in range(n):
            if np.isfinite(step[i]) and ic[i] + 2 * step[i] <= len(v):
                out["intra_step_covariance"][i] = _one_lag(v[ic[i] : ic[i] + 2 * int(step[i])], int(step[i]))
            if np.isfinite(stride[i]):
                k = int(stride[i])
                if ic[i] + 2 * k <= len(v):
                    out["intra_stride_covariance"][i] = _one_lag(v[ic[i] : ic[i] + 2 * k], k)
                part = a[ic[i] : ic[i] + k]
                if len(part) > 2:
                    out["harmonic_ratio"][i] = harmonic_ratio(part[:, 0], fs, k / fs)
                    out["stride_sparc"][i] = dsp.sparc((np.linalg.norm(part, axis=1) - 1)[None, :], fs)[0]
        lags = int(4.5 * fs)
        c = lagged_correlations(v, lags)
        for name, lag in (("step_regularity", step), ("stride_regularity", stride)):
            at = _nearest_peak(c, float(np.nanmedian(lag))) if np.isfinite(lag).any() else None
            out[name][:] = c[at] if at is not None else np.nan
        if np.isfinite(stride).any():
            try:
                smooth = np.stack([dsp.zero_phase(low, x) for x in a.T], axis=1) if low is not None else a
                axes = np.stack([lagged_correlations(x, lags, biased=True) for x in smooth.T], axis=1)
                at = _nearest_peak(axes.sum(axis=1), float(np.nanmedian(stride)))
                if at is not None:
                    out["gait_symmetry_index"][:] = np.sqrt(np.maximum(axes[at // 2], 0).sum() / 3)
            except ValueError:
                pass  # the bout is shorter than its filter
        turning = pa.nulls(n, pa.int32())
        if gyro:
            t = turns(np.stack([left[c].to_numpy() for c in ("gx", "gy", "gz")], axis=1), a, fs) != 0
            hit = lambda at: t[np.minimum(at, len(t) - 1)].astype(np.int32)
            turning = pa.array(hit(ic) + hit(fc), pa.int32())
        keys = [pa.array([k.as_py()] * n, f.type) for k, f in zip(key, schema, strict=False)]
        return pa.Table.from_arrays([*keys, right["stride_idx"].combine_chunks().cast(pa.int64()), *[pa.array(out[c], mask=np.isnan(out[c])) for c in _NAMES], turning], schema=schema)

    kinds = "recording_id long, day_n int, bout_n long, stride_idx long, " + ", ".join(f"{c} double" for c in _NAMES) + ", in_turn int"
    return samples.groupBy(*BOUT).cogroup(strides.select(*BOUT, "stride_idx", "ic", "fc", "forward_cycles").groupBy(*BOUT)).applyInArrow(run, kinds)
