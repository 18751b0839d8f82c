"""Walking and ambulation by features of three-second windows and a boosted tree model.

The model is a parameter: a text dump that `detectors.Trees.parse` reads.  Its
features are computed in the order in which such models take them.  Native
features share one sort and one aggregation; the rest come from batches of
windows; all are joined on the window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions import dsp
from kinelake.functions import features as ft
from kinelake.operators import detectors, kernels, timeline
from kinelake.operators.intervals import runs
from kinelake.operators.windows import KEY

SECONDS = 3
# The order of features, and the probabilities over which a window counts.
WALKING = (
    "dominant_frequency", "mean_cross_rate", "value_range", "rms", "sample_entropy", "autocorrelation", "iqr", "range_count_percentage", "complexity_invariant_distance",
    "permutation_entropy", "spectral_entropy", "spectral_flatness", "mean", "jerk_metric", "dimensionless_jerk", "signal_entropy", "sparc", "linear_slope",
)
AMBULATION = (
    "mean", "mean_cross_rate", "std_dev", "skewness", "kurtosis", "value_range", "iqr", "autocorrelation_1", "autocorrelation_5", "autocorrelation_10", "autocorrelation_20",
    "linear_slope", "signal_entropy", "sample_entropy", "permutation_entropy", "range_count_percentage", "jerk_metric", "sparc", "dominant_frequency", "dominant_frequency_value",
    "power_spectral_sum", "spectral_flatness", "spectral_entropy", "detail_power", "detail_power_ratio",
)
WALKING_LIMIT, AMBULATION_LIMIT = 0.7, 0.65


def _entropies(x: np.ndarray, m: int, r: float) -> np.ndarray:
    return np.array([dsp.sample_entropy(row, m, r) for row in x])


def _together(tables: list[DataFrame], order: tuple[str, ...]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, "w")
    return out.select(F.col(f"w.{KEY}").alias(KEY), F.col("w.window").alias("window"), *order)


def _windows(signal: DataFrame, length: int) -> DataFrame:
    """Rows (w: recording and window, i, x) of whole windows of a signal (sample_idx, x)."""
    return signal.select(F.struct(F.col(KEY).alias(KEY), F.floor(F.col("sample_idx") / length).cast("long").alias("window")).alias("w"), (F.col("sample_idx") % length).alias("i"), "x")


def _magnitudes(df: DataFrame, f, length: int, margin: int) -> DataFrame:
    """f(magnitude) of each recording, cut to whole windows; recordings too short for it give no rows."""

    def run(data, lo, hi):
        n = (hi - lo) // length * length
        try:
            y = f(np.linalg.norm(kernels._axes(data), axis=1))[lo : lo + n]
        except ValueError:
            y = np.zeros(0)
        return {"sample_idx": data["sample_idx"].to_numpy()[lo : lo + len(y)], "x": y}

    return kernels.per_part(df.select(KEY, "sample_idx", "ax", "ay", "az"), run, "sample_idx long, x double", margin, length)


def walking_features(df: DataFrame, fs: float) -> DataFrame:
    """recording_id, window and the features WALKING of three-second windows of the band-passed magnitude, at 20 or 50 Hz."""
    length = int(fs * SECONDS)
    band = dsp.butterworth(1, (0.25 / (fs / 2), 5.0 / (fs / 2)), "band")
    w = _windows(_magnitudes(df, lambda m: dsp.zero_phase(band, m), length, kernels.forgotten(band)), length)
    bank = ft.Bank(
        mean_cross_rate=ft.mean_cross_rate(), value_range=ft.value_range(), rms=ft.rms(), autocorrelation=ft.autocorrelation(), iqr=ft.iqr(), range_count_percentage=ft.range_count_percentage(0.4, 1.5),
        complexity_invariant_distance=ft.complexity_invariant_distance(), mean=ft.mean(), jerk_metric=ft.jerk_metric(fs), dimensionless_jerk=ft.dimensionless_jerk("acceleration", log=True), linear_slope=ft.linear_slope(fs),
    )

    def rest(x):
        return {
            "dominant_frequency": dsp.dominant_frequency(x, fs, 4, 1.0, 3.5), "sample_entropy": _entropies(x, 2, 0.5), "spectral_entropy": dsp.spectral_entropy(x, fs, 4, 0.0, 5.0),
            "spectral_flatness": dsp.spectral_flatness(x, fs, 4, 0.0, 6.0), "sparc": dsp.sparc(x, fs, 4, 10.0, 0.05),
        }

    names = "dominant_frequency double, sample_entropy double, spectral_entropy double, spectral_flatness double, sparc double"
    parts = [bank.compute(w, ["w"], lag=15), ft.permutation_entropy(w, ["w"], 3, 1, True), ft.signal_entropy(w, ["w"]), kernels.per_window(w, "w", rest, names, length)]
    return _together(parts, WALKING)


def ambulation_features(df: DataFrame) -> DataFrame:
    """recording_id, window and the features AMBULATION of three-second windows at 20 Hz, each high-passed on its own."""
    fs, length = 20.0, 60
    high, taps = dsp.butterworth(1, 0.25 / (fs / 2), "high"), dsp.wavelet("coif4")
    each = lambda m: np.concatenate([np.zeros(0), *(dsp.zero_phase(high, w) for w in m[: len(m) // length * length].reshape(-1, length))])
    w = _windows(_magnitudes(df, each, length, 0), length)
    bank = ft.Bank(
        mean=ft.mean(), mean_cross_rate=ft.mean_cross_rate(), std_dev=ft.std_dev(), skewness=ft.skewness(), kurtosis=ft.kurtosis(), value_range=ft.value_range(), iqr=ft.iqr(), autocorrelation_1=ft.autocorrelation(),
        linear_slope=ft.linear_slope(fs), range_count_percentage=ft.range_count_percentage(0.0, 1.0), jerk_metric=ft.jerk_metric(fs),
    )

    def rest(x):
        r = lambda k: np.array([np.corrcoef(row[:-k], row[k:])[0, 1] if row[:-k].std() > 0 and row[k:].std() > 0 else np.nan for row in x])
        details = np.array([dsp.detail_power(row, fs, taps, 1.0, 8.0) for row in x]).reshape(-1, 2)
        return {
            "autocorrelation_5": r(5), "autocorrelation_10": r(10), "autocorrelation_20": r(20), "sample_entropy": _entropies(x, 4, 1.0), "sparc": dsp.sparc(x, fs), "dominant_frequency": dsp.dominant_frequency(x, fs),
            "dominant_frequency_value": dsp.dominant_frequency_value(x, fs), "power_spectral_sum": dsp.power_spectral_sum(x, fs), "spectral_flatness": dsp.spectral_flatness(x, fs), "spectral_entropy": dsp.spectral_entropy(x, fs),
            "detail_power": details[:, 0], "detail_power_ratio": details[:, 1],
        }

    names = "autocorrelation_5 double, autocorrelation_10 double, autocorrelation_20 double, sample_entropy double, sparc double, dominant_frequency double, dominant_frequency_value double, power_spectral_sum double, spectral_flatness double, spectral_entropy double, detail_power double, detail_power_ratio double"
    parts = [bank.compute(w, ["w"]), ft.permutation_entropy(w, ["w"], 3, 1, True), ft.signal_entropy(w, ["w"]), kernels.per_window(w, "w", rest, names, length)]
    return _together(parts, AMBULATION)


def _bouts(windows: DataFrame, order: tuple[str, ...], model: detectors.Trees, limit: float, samples: float) -> DataFrame:
    """Runs of windows over the limit, in samples of the original rate (`samples` of them a window)."""
    known = detectors.scored(windows.select(KEY, "window", *order), list(order), model, limit)
    states = known.select(KEY, F.col("window").alias("sample_idx"), F.col("positive").cast("int").alias("state"))
    at = lambda c: F.rint(F.col(c) * F.lit(float(samples))).cast("long").alias(c)
    return runs(states, "state").filter("state = 1").select(KEY, at("start_idx"), at("stop_idx"))


def walking_bouts(df: DataFrame, fs: float, model: detectors.Trees, limit: float = WALKING_LIMIT) -> DataFrame:
    """Walking (recording_id, start_idx, stop_idx) by a model of lumbar acceleration at 50 Hz, or 20 Hz where fs is under 50."""
    from kinelake.operators.walking import downsampled

    slower, rate = downsampled(df, fs)
    return _bouts(walking_features(slower, rate), WALKING, model, limit, SECONDS * fs)


def ambulation_bouts(df: DataFrame, fs: float, model: detectors.Trees, limit: float = AMBULATION_LIMIT) -> DataFrame:
    """Ambulation (recording_id, start_idx, stop_idx) by a model of wrist acceleration at 20 Hz."""
    if fs < 20:
        raise ValueError(f"ambulation needs 20 Hz, not {fs}")
    slower = df if fs == 20 else timeline.resampled(df, ["ax", "ay", "az"], fs, 20.0)
    return _bouts(ambulation_features(slower), AMBULATION, model, limit, SECONDS * fs)
