"""From raw acceleration of walking bouts to anatomical axes, step frequency, contacts and strides.

A bout is one Arrow group of (recording, day, bout); a bout that is too short for
a filter, or shows no steps, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinelake.functions import dsp
from kinelake.operators import detectors, timeline
from kinelake.operators.gait import BOUT
from kinelake.operators.gait_kernels import LEGACY, lagged_correlations
from kinelake.operators.windows import window_samples

#: Bands in Hz for telling the forward axis and its sign, and for the steps.
AXIS_BAND, SIGN_BAND, STEP_BAND = (0.25, 7.5), (0.25, 7.0), (0.5, 5.0)


#: Lags of autocovariance that are left out for want of overlap.
NO_LAGS = 10


def downsampled(df: DataFrame, fs: float) -> tuple[DataFrame, float]:
    """Samples at 50 Hz, or at 20 Hz if fs is under 50, low-passed before; and their rate."""
    if fs < 20:
        raise ValueError(f"gait needs 20 Hz, not {fs}")
    goal = 50.0 if fs >= 50 else 20.0
    return (df, goal) if fs == goal else (timeline.resampled(df, ["ax", "ay", "az"], fs, goal), goal)


def _largest_correlation(a: np.ndarray, b: np.ndarray) -> float:
    size = 1 << (2 * len(a) - 1).bit_length()
    return float(np.abs(np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)).max())


def _band(x: np.ndarray, fs: float, band: tuple[float, float]) -> np.ndarray:
    return dsp.zero_phase(dsp.butterworth(4, (band[0] / (fs / 2), band[1] / (fs / 2)), "band"), x)


def forward_axis(accel: np.ndarray, fs: float, vertical: int) -> int:
    """Of the other two axes the one that moves most with the vertical, at any lag."""
    smooth = [_band(accel[:, k], fs, AXIS_BAND) for k in range(3)]
    return max((k for k in range(3) if k != vertical), key=lambda k: _largest_correlation(smooth[vertical], smooth[k]))


def forward_sign(x: np.ndarray, fs: float) -> int:
    """-1 if the waves of forward acceleration rise faster than they fall, otherwise 1."""
    y = _band(x, fs, SIGN_BAND)
    tops = dsp.find_peaks(y, prominence=0.05)
    if not len(tops):
        return 1
    heights = np.array([dsp._prominence(y, p) for p in tops])
    usual = 0.75 * np.median(heights)
    tops, troughs = tops[heights > usual], dsp.find_peaks(-y, prominence=usual)
    place = np.searchsorted(troughs, tops)
    around = np.concatenate([[np.nan], troughs, [np.nan]])
    rise, fall = tops - around[place], around[place + 1] - tops
    rise, fall = rise[np.isfinite(rise)], fall[np.isfinite(fall)]
    if not len(rise) or not len(fall):
        return 1
    a, b = np.median(rise), np.median(fall)
    if a == b and len(tops) > 1:
        near = 1.25 * np.median(np.diff(tops))
        rise, fall = rise[rise < near], fall[fall < near]
        a, b = (rise.mean() if len(rise) else a), (fall.mean() if len(fall) else b)
    return -1 if a < b else 1


def step_time(x: np.ndarray, fs: float) -> float:
    """Seconds a step: median first lag at which windows of the wavelet-filtered signal resemble themselves.

    Windows of five seconds overlap by half; fewer than a quarter with a peak raise ValueError.
    """
    scales = np.geomspace(*(detectors.GAUS1_FREQUENCY * fs / f for f in STEP_BAND), 10)
    power = sum(detectors.gaus1(x, s) for s in scales)
    length, step = window_samples(fs, 5.0, 0.5)
    view = np.lib.stride_tricks.sliding_window_view(power, length)[::step]
    peaks = [dsp.find_peaks(lagged_correlations(w, length - NO_LAGS, biased=True), height=0.0) for w in view]
    first = [p[0] for p in peaks if len(p)]
    if not first or len(first) < 0.25 * len(view):
        raise ValueError("too few windows tell the step time")
    return float(np.median(first)) / fs


def levelled(v: np.ndarray, ap: np.ndarray, ml: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three axes with their mean tilt rotated out; as they are where a mean exceeds 1 g."""
    sa, sm, sign = ap.mean(), ml.mean(), np.sign(v.mean())
    if abs(sa) > 1 or abs(sm) > 1:
        return v, ap, ml
    ca, cm = np.sqrt(1 - sa * sa), np.sqrt(1 - sm * sm)
    upright = sign * ap * sa + v * ca
    return sign * ml * sm + upright * cm, ap * ca - sign * v * sa, ml * cm - sign * upright * sm


_PREPARED = (("v", pa.float64()), ("ap", pa.float64()), ("ml", pa.float64()), ("v_axis", pa.int32()), ("ap_axis", pa.int32()), ("v_sign", pa.int32()), ("ap_sign", pa.int32()), ("step_frequency", pa.float64()))
_KEYS = (("recording_id", pa.int64()), ("day_n", pa.int32()), ("bout_n", pa.int64()), ("sample_idx", pa.int64()))
PREPARED = "recording_id long, day_n int, bout_n long, sample_idx long, v double, ap double, ml double, v_axis int, ap_axis int, v_sign int, ap_sign int, step_frequency double"


def prepared_bouts(df: DataFrame, fs: float, v_axis: int | None = None, ap_axis: int | None = None, correct: bool = True, cutoff: float = 20.0, order: int = 4) -> DataFrame:
    """Bouts (recording_id, day_n, bout_n, sample_idx, ax, ay, az) by anatomical axes.

    Adds to each sample vertical, forward and lateral acceleration (low-passed
    where the rate allows, without trend), and of its bout the axes, their signs
    and the step frequency, 0.4 to 5 Hz.  Axes that are not given are found: the
    vertical has the largest mean, the forward one follows it.
    """
    schema = pa.schema([*_KEYS, *_PREPARED])
    low = dsp.butterworth(order, cutoff / (fs / 2), "low") if fs > 2 * cutoff else None

    def run(key, data):
        data = data.sort_by("sample_idx")
        a = np.stack([data[c].to_numpy() for c in ("ax", "ay", "az")], axis=1)
        try:
            up = int(np.argmax(np.abs(a.mean(axis=0)))) if v_axis is None else v_axis
            ahead = forward_axis(a, fs, up) if ap_axis is None else ap_axis
            sign = forward_sign(a[:, ahead], fs)
            parts = [a[:, up], a[:, ahead], a[:, 3 - up - ahead]]
            parts = levelled(*parts) if correct else parts
            frequency = float(np.clip(1 / step_time(parts[1], fs), 0.4, 5.0))
            parts = [detectors.detrended(dsp.zero_phase(low, x) if low is not None else x) for x in parts]
        except ValueError:
            return schema.empty_table()
        n = len(a)
        same = lambda v, kind: pa.array(np.full(n, v), kind)
        keys = [same(k.as_py(), f.type) for k, f in zip(key, schema, strict=False)]
        bout = [same(v, f.type) for v, f in zip((up, ahead, int(np.sign(a[:, up].mean())), sign, frequency), list(schema)[-5:], strict=True)]
        return pa.Table.from_arrays([*keys, data["sample_idx"].combine_chunks().cast(pa.int64()), *map(pa.array, parts), *bout], schema=schema)

    return df.select(*BOUT, "sample_idx", "ax", "ay", "az").groupBy(*BOUT).applyInArrow(run, PREPARED)


def vertical_scales(fs: float, step_frequency: float | None, related: bool = True, frequency: float = 1.25, rounded: bool = False) -> tuple[float, float]:
    """Wavelet scales for initial and final contacts.

    related: by a published line of scale against step frequency, at 250 Hz;
    otherwise, and without a step frequency, both are those of `frequency` Hz.
    """
    if not related or step_frequency is None:
        return (max(detectors.GAUS1_FREQUENCY * fs / frequency, 1.0),) * 2
    # Slopes and intercepts of the published lines, and the limits of a scale.
    lines, limits = ((-10.0, 56.0), (-52.0, 131.0)), (1.0, 90.0)
    scales = ((slope * step_frequency + base) * fs / 250.0 for slope, base in lines)
    return tuple(float(np.clip(round(s) if rounded else s, *limits)) for s in scales)


def vertical_contacts(vertical: np.ndarray, fs: float, step_frequency: float | None, sign: int = 1, **scales) -> tuple[np.ndarray, np.ndarray]:
    """Initial and final contacts of a bout from vertical acceleration.

    They are peaks, over half a deviation, of the once and the twice transformed velocity.
    """
    first, second = vertical_scales(fs, step_frequency, **scales)
    velocity = detectors.cumulative_trapezoid(vertical, 1 / fs)
    once, twice = detectors.gaus1(velocity, first), detectors.gaus1(detectors.gaus1(velocity, second), second)
    return tuple(dsp.find_peaks(-sign * x, height=0.5 * x.std()) for x in (once, twice))


def walking_strides(bouts: DataFrame, fs: float, events: str = "forward", max_stride: float | None = None, loading: float = 0.17) -> DataFrame:
    """Stride table (as detectors.gait_bouts) of prepared bouts, contacts from the forward or the vertical axis."""
    if events not in ("forward", "vertical"):
        raise ValueError(f"events come from the forward or the vertical axis, not {events}")

    def run(key, data):
        data = data.sort_by("sample_idx")
        v, ap = data["v"].to_numpy(), data["ap"].to_numpy()
        frequency, up, ahead = (data[c][0].as_py() for c in ("step_frequency", "v_sign", "ap_sign"))
        found = detectors.contacts(ap, fs, frequency, ahead) if events == "forward" else vertical_contacts(v, fs, frequency, up)
        return detectors.stride_rows(key, v, detectors.strides_of(*found, fs, 1 / frequency, max_stride, loading), fs)

    return bouts.select(*BOUT, "sample_idx", "v", "ap", "v_sign", "ap_sign", "step_frequency").groupBy(*BOUT).applyInArrow(run, detectors.STRIDES)


def _legacy_axis(a: np.ndarray, up: int) -> int:
    """The axis whose autocovariance resembles the vertical's most."""
    curves = np.stack([lagged_correlations(a[:, k], min(len(a) - 1, 1000), biased=True) for k in range(3)])
    like = np.corrcoef(curves)[up]
    return max((k for k in range(3) if k != up), key=lambda k: like[k])


def legacy_strides(df: DataFrame, fs: float, related: bool = True, correct: bool = True, cutoff: float = 20.0, order: int = 4, frequency: float = 1.25) -> DataFrame:
    """Stride table of bouts (as for prepared_bouts) by the older generation of gait analysis.

    Contacts come from the vertical axis; the step frequency is the strongest of
    the transformed velocity; a stride has a fixed longest time, and an initial
    contact may follow another.
    """
    low = dsp.butterworth(order, cutoff / (fs / 2), "low") if 0 < cutoff < fs / 2 else None

    def run(key, data):
        data = data.sort_by("sample_idx")
        a = np.stack([data[c].to_numpy() for c in ("ax", "ay", "az")], axis=1)
        if len(a) < 2 * NO_LAGS:
            return detectors._STRIDES.empty_table()
        up = int(np.argmax(np.abs(a.mean(axis=0))))
        v, sign = a[:, up], int(np.sign(a[:, up].mean()))
        try:
            if correct:
                ahead = _legacy_axis(a, up)
                v = levelled(v, a[:, ahead], a[:, 3 - up - ahead])[0]
            v = detectors.detrended(v)
            v = dsp.zero_phase(low, v) if low is not None else v
        except ValueError:
            return detectors._STRIDES.empty_table()
        step_frequency = None
        if related:
            wave = detectors.gaus1(detectors.cumulative_trapezoid(v, 1 / fs), vertical_scales(fs, None, frequency=frequency)[0])
            step_frequency = float(np.argmax(np.abs(np.fft.rfft(wave))) / len(v) * fs)
        found = vertical_contacts(v, fs, step_frequency, sign, related=related, frequency=frequency, rounded=True)
        return detectors.stride_rows(key, v, detectors.strides_of(*found, fs, 0.0, strict=False, **LEGACY), fs)

    return df.select(*BOUT, "sample_idx", "ax", "ay", "az").groupBy(*BOUT).applyInArrow(run, detectors.STRIDES)
