"""Operators that need numpy kernels, each over Arrow groups of a part of a recording or of bounded sets of windows.

Filters are local once they have forgotten what came before, so a part is read
with a margin on both sides and no task holds a long recording.  Rules that carry
a state over hours run over a recording's epochs or blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions import dsp
from kinelake.operators.windows import KEY, epochs

#: Samples of a part of a recording.
PART = 1 << 19


def _sorted(data: pa.Table) -> pa.Table:
    return data.sort_by("sample_idx")


def _key_type(kind: pa.DataType) -> pa.DataType:
    """The type of a key as a declared schema has it: parts of a struct may be null."""
    return pa.struct([pa.field(f.name, f.type) for f in kind]) if pa.types.is_struct(kind) else kind


def per_recording(df: DataFrame, f, schema: str) -> DataFrame:
    """f(key, table in sample order) -> dict of columns, for each recording.

    Group by day or bout instead where recordings are long: add it to the key.
    """

    def run(key, data):
        out = f(_sorted(data))
        n = len(next(iter(out.values()))) if out else 0
        return pa.table({KEY: pa.array([key[0].as_py()] * n, _key_type(data.schema.field(KEY).type)), **{k: pa.array(v) for k, v in out.items()}})

    kind = dict(df.dtypes)[KEY]
    return df.groupBy(KEY).applyInArrow(run, f"{KEY} {kind}, {schema}")


def forgotten(*filters: np.ndarray, to: float = 1e-14) -> int:
    """Samples after which filters, given as sections or as denominators, feel what came before by a share of `to` at most."""
    poles = np.concatenate([np.roots(a) for f in filters for a in (f[:, 3:] if f.ndim == 2 else f[None, :])])
    largest = float(np.abs(poles).max(initial=0.0))
    return int(np.ceil(np.log(to) / np.log(max(min(largest, 1 - 1e-9), 1e-3)))) + 64


def per_part(df: DataFrame, f, schema: str, margin: int, multiple: int = 1) -> DataFrame:
    """f(table in sample order, lo, hi) -> dict of columns of the rows from lo to hi, for each part of each recording.

    A part has PART samples, or the next multiple of `multiple` that holds the
    margin; the table goes `margin` samples beyond it where the recording does.
    """
    size = -(-max(PART, margin, 1) // multiple) * multiple
    own, place = F.floor(F.col("sample_idx") / size).cast("long"), F.col("sample_idx") % size
    parts = F.array_compact(F.array(own, F.when((own > 0) & (place < margin), own - 1), F.when(place >= size - margin, own + 1)))

    def run(key, data):
        data = _sorted(data)
        at = data["sample_idx"].to_numpy()
        lo, hi = np.searchsorted(at, (key[1].as_py() * size, (key[1].as_py() + 1) * size)).tolist()
        out = f(data, lo, hi) if hi > lo else f(data.slice(0, 0), 0, 0)
        n = len(next(iter(out.values())))
        return pa.table({KEY: pa.array([key[0].as_py()] * n, _key_type(data.schema.field(KEY).type)), **{k: pa.array(v) for k, v in out.items()}})

    kind = dict(df.dtypes)[KEY]
    return df.withColumn("_part", F.explode(parts)).groupBy(KEY, "_part").applyInArrow(run, f"{KEY} {kind}, {schema}")


def per_window(df: DataFrame, key: str, f, schema: str, size: int | None = None) -> DataFrame:
    """f(matrix of equally long windows) -> dict of columns, over windows with columns key, i, x (of `size` samples only, if given)."""
    arrays = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_w")).select(key, F.transform("_w", lambda p: p["x"]).alias("_w"))
    arrays = arrays.filter(F.size("_w") == size) if size else arrays
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            sizes = np.array([len(w) for w in batch.column("_w")])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = np.array([batch.column("_w")[int(i)].as_py() for i in rows], float)
                yield pa.record_batch({key: batch.column(key).take(pa.array(rows)).cast(_key_type(batch.schema.field(key).type)), **{k: pa.array(v) for k, v in f(x).items()}})

    return arrays.mapInArrow(run, f"{key} {kind}, {schema}")


# -- spectral and other window features --------------------------------------

SPECTRAL = {f.__name__: f for f in (dsp.dominant_frequency, dsp.dominant_frequency_value, dsp.power_spectral_sum, dsp.range_power_sum, dsp.spectral_flatness, dsp.spectral_entropy, dsp.sparc)}


def spectral_features(df: DataFrame, key: str, fs: float, names: list[str]) -> DataFrame:
    return per_window(df, key, lambda x: {n: SPECTRAL[n](x, fs) for n in names}, ", ".join(f"{n} double" for n in names))


def sample_entropy(df: DataFrame, key: str, m: int, r: float) -> DataFrame:
    out = per_window(df, key, lambda x: {"sample_entropy": np.array([dsp.sample_entropy(row, m, r) for row in x])}, "sample_entropy double")
    return out.withColumn("sample_entropy", F.nanvl("sample_entropy", F.lit(None).cast("double")))


def detail_power(df: DataFrame, key: str, fs: float, wavelet: str = "coif4", band: tuple[float, float] = (1.0, 3.0), ratio_band: tuple[float, float] = (1.0, 10.0)) -> DataFrame:
    """Power of wavelet details in one band (Hz), and the share of all power in details of another."""
    taps = dsp.wavelet(wavelet)

    def run(x):
        return {"detail_power": np.array([dsp.detail_power(row, fs, taps, *band)[0] for row in x]), "detail_power_ratio": np.array([dsp.detail_power(row, fs, taps, *ratio_band)[1] for row in x])}

    return per_window(df, key, run, "detail_power double, detail_power_ratio double")


# -- filters ----------------------------------------------------------------


def filtered(df: DataFrame, key: str, fs: float, order: int, cutoff: float | tuple[float, float], kind: str) -> DataFrame:
    """Zero-phase Butterworth of column x as y; recordings too short for it give no rows."""
    sos = dsp.butterworth(order, np.asarray(cutoff) / (fs / 2), kind)

    def run(data, lo, hi):
        try:
            y = dsp.zero_phase(sos, data["x"].to_numpy())[lo:hi]
        except ValueError:
            y, hi = np.zeros(0), lo
        return {"sample_idx": data["sample_idx"].to_numpy()[lo:hi], "y": y}

    return per_part(df.select(KEY, "sample_idx", "x"), run, "sample_idx long, y double", forgotten(sos))


def low_passed(df: DataFrame, values: list[str], share: float) -> DataFrame:
    """sample_idx, t and values after a zero-phase low-pass at `share` of half the sampling rate, as goes before thinning out.

    Recordings too short for the filter stay as they are.
    """
    sos = dsp.chebyshev_low(8, 0.05, share)

    def run(data, lo, hi):
        out = {c: data[c].to_numpy()[lo:hi] for c in ("sample_idx", "t")}
        for v in values:
            x = data[v].to_numpy().astype(float)
            try:
                out[v] = dsp.zero_phase(sos, x)[lo:hi]
            except ValueError:
                out[v] = x[lo:hi]
        return out

    return per_part(df.select(KEY, "sample_idx", "t", *values), run, "sample_idx long, t double, " + ", ".join(f"{v} double" for v in values), forgotten(sos))


def _axes(data: pa.Table) -> np.ndarray:
    return np.stack([data[a].to_numpy() for a in ("ax", "ay", "az")], axis=1)


def _each_sample(df: DataFrame, f, margin: int) -> DataFrame:
    """f(three axes) -> x of each sample; recordings too short for it give no rows."""

    def run(data, lo, hi):
        try:
            x = f(_axes(data))[lo:hi]
        except ValueError:
            x, hi = np.zeros(0), lo
        return {"sample_idx": data["sample_idx"].to_numpy()[lo:hi], "x": x}

    return per_part(df.select(KEY, "sample_idx", "ax", "ay", "az"), run, "sample_idx long, x double", margin)


def _smooth(sos: np.ndarray, a: np.ndarray) -> np.ndarray:
    return np.stack([dsp.zero_phase(sos, a[:, k]) for k in range(a.shape[1])], axis=1)


def filtered_metric(df: DataFrame, fs: float, length: int, name: str, low: float = 0.2, high: float = 15.0, order: int = 4) -> DataFrame:
    """Epoch means of band-passed (bfen), high-passed (hfen) or recombined (hfenplus) magnitude."""
    half = fs / 2
    sos = {"bfen": lambda: [dsp.butterworth(order, (low / half, high / half), "band")], "hfen": lambda: [dsp.butterworth(order, low / half, "high")], "hfenplus": lambda: [dsp.butterworth(order, low / half, "high"), dsp.butterworth(order, low / half, "low")]}[name]()

    def each(a):
        parts = [np.linalg.norm(_smooth(s, a), axis=1) for s in sos]
        return np.maximum(sum(parts) - 1, 0) if len(parts) > 1 else parts[0]

    return epochs(_each_sample(df, each, forgotten(*sos)), length, F.avg("x").alias("metric"))


def activity_index(df: DataFrame, fs: float, length: int, cutoff: float = 0.25) -> DataFrame:
    """Per epoch: root of the mean over samples of the variance across axes of the high-passed signal."""
    sos = dsp.butterworth(3, cutoff / (fs / 2), "high")
    return epochs(_each_sample(df, lambda a: _smooth(sos, a).var(axis=1), forgotten(sos)), length, F.sqrt(F.avg("x")).alias("metric"))


# Numerator and denominator of the counts' band-pass filter at 30 Hz.
COUNTS_IN = (-0.009341062898525, -0.025470289659360, -0.004235264826105, 0.044152415456420, 0.036493718347760, -0.011893961934740, -0.022917390623150, -0.006788163862310, 0.0)
COUNTS_OUT = (1.0, -3.63367395910957, 5.03689812757486, -3.09612247819666, 0.50620507633883, 0.32421701566682, -0.15685485875559, 0.0194913020591, 0.0)


def activity_counts(df: DataFrame, fs: float, seconds: int = 60) -> DataFrame:
    """Counts of each axis by epoch, from samples at 30 Hz (resampled if fs differs, low-passed before if it is larger)."""
    if fs != 30.0:
        from kinelake.operators.timeline import resampled

        df = resampled(df.withColumn("t", F.col("sample_idx") / F.lit(float(fs))), ["ax", "ay", "az"], fs, 30.0)
    f = dsp.Recursion.transfer(np.array(COUNTS_IN), np.array(COUNTS_OUT))

    def run(data, lo, hi):
        a, n = _axes(data), (hi - lo) // 3  # three samples make a count
        out = {"sample_idx": data["sample_idx"].to_numpy()[lo:hi][: 3 * n : 3] // 3}
        for k, name in enumerate("xyz"):
            y = np.abs(f(a[:, k], f.steady() * a[0, k])) * (3 / 4096) / (2.6 / 256) * 237.5 if len(a) else a[:, k]
            y = np.floor(np.minimum(np.where(y < 4, 0, y), 128))
            out[name] = y[lo : lo + 3 * n].reshape(n, 3).mean(axis=1)
        return out

    tenths = per_part(df.select(KEY, "sample_idx", "ax", "ay", "az"), run, "sample_idx long, x double, y double, z double", forgotten(np.array(COUNTS_OUT)), 3)
    return epochs(tenths, 10 * seconds, *[F.round(F.sum(c), 6).alias(f"counts_{c}") for c in "xyz"])


def motion(df: DataFrame, fs: float, cutoff: float = 6.0, order: int = 6, limit: float = 0.02256) -> DataFrame:
    """Whether each second moves: the coefficient of variation of the low-passed magnitude exceeds the limit throughout."""
    sos, w = dsp.butterworth(order, cutoff / (fs / 2), "low"), int(fs)

    def each(a):
        view = np.lib.stride_tricks.sliding_window_view(dsp.zero_phase(sos, np.linalg.norm(a, axis=1)), w)
        return view.std(axis=1, ddof=1) / (view.mean(axis=1) + 1e-12) > limit, np.zeros(len(a) // w * w, bool)

    return _each_second(df, each, w, forgotten(sos), 1.0)


def _each_second(df: DataFrame, f, w: int, margin: int, share: float) -> DataFrame:
    """Whether `share` of the moving seconds that begin in a second are hits, or the second is one itself.

    f(three axes) -> hits of moving seconds, and of samples whose second is a hit.
    Seconds whose moving ones go beyond the recording have no row.
    """

    def run(data, lo, hi):
        try:
            moving, fixed = f(_axes(data)[lo % w :])
        except ValueError:
            moving, fixed = np.zeros(0, bool), np.zeros(0, bool)
        at = lo - lo % w
        n = max(0, min(len(moving) - at, hi - lo) // w)
        hit = moving[at : at + n * w].reshape(n, w).mean(axis=1) >= share
        return {"second": data["sample_idx"].to_numpy()[lo : lo + n * w : w] // w, "moving": hit | fixed[at : at + n * w : w][:n]}

    return per_part(df.select(KEY, "sample_idx", "ax", "ay", "az"), run, "second long, moving boolean", margin + 2 * w, w)


def motion_by_deviation(df: DataFrame, fs: float = 20.0, low: float = 3.0, low_order: int = 6, high: float = 0.25, high_order: int = 1, variation: float = 0.41, deviation: float = 0.013) -> DataFrame:
    """Whether each second moves, by either of two signs.

    Half of the second's moving seconds vary, against their mean, more than
    `variation` once the magnitude is low- and high-passed; or one axis deviates
    by `deviation` at least.  Seconds whose moving ones go beyond the recording
    have no row.
    """
    if fs < 20:
        raise ValueError(f"motion needs 20 Hz, not {fs}")
    sections, w = (dsp.butterworth(low_order, low / (fs / 2), "low"), dsp.butterworth(high_order, high / (fs / 2), "high")), int(fs)

    def each(a):
        y, n = np.linalg.norm(a, axis=1), len(a) // w
        for sos in sections:
            y = dsp.zero_phase(sos, y)
        view = np.lib.stride_tricks.sliding_window_view(y, w)
        vary = view.std(axis=1, ddof=1) / (np.abs(view.mean(axis=1)) + 0.01) >= variation
        return vary, np.repeat(a[: n * w].reshape(n, w, 3).std(axis=1, ddof=1).max(axis=1) >= deviation, w)

    return _each_second(df, each, w, forgotten(*sections), 0.5)


def moving_bouts(seconds: DataFrame, fs: float) -> DataFrame:
    """Runs of moving seconds (recording_id, start_idx, stop_idx) in samples."""
    from kinelake.operators.intervals import runs

    states = seconds.select(KEY, F.col("second").alias("sample_idx"), F.col("moving").cast("int").alias("state"))
    return runs(states, "state").filter("state = 1").select(KEY, *[(F.col(c) * int(fs)).alias(c) for c in ("start_idx", "stop_idx")])


def peaks(df: DataFrame, value: str, height: float | None = None, distance: float | None = None, prominence: float | None = None) -> DataFrame:
    def run(data):
        x = data[value].to_numpy()
        at = dsp.find_peaks(x, height, distance, prominence)
        return {"sample_idx": data["sample_idx"].to_numpy()[at], "peak": x[at]}

    return per_recording(df.select(KEY, "sample_idx", value), run, "sample_idx long, peak double")


# -- sequential rules -------------------------------------------------------


def _bouts_growing(x: np.ndarray, n: int, share: float) -> int:
    """Epochs of the level in bouts that start at one, hold `share` in n epochs and grow while they do."""
    total = np.concatenate([[0], np.cumsum(x)])
    at, found = 0, 0
    places = np.flatnonzero(x)
    while at < len(places):
        start = int(places[at])
        stop = start + n
        inside = 0
        if stop < len(x) and total[stop] - total[start] > n * share:
            while stop < len(x) and total[stop + 1] - total[start] > (stop + 1 - start) * share:
                stop += 1
            inside = int(total[stop] - total[start])
            found += inside
        at += max(inside, 1)
    return found


def _bouts_marked(x: np.ndarray, n: int, share: float) -> int:
    """Epochs marked by windows that hold `share`; an epoch whose window does not is cleared for those after it."""
    x = x.copy()
    marked = np.zeros(len(x), bool)
    places = np.flatnonzero(x)
    for k, start in enumerate(places.tolist()):
        stop = start + n
        if stop < len(x):
            if x[start:stop].sum() > n * share:
                marked[start:stop] = True
            else:
                x[start] = 0
        elif len(places) > 1 and k > 2:
            x[start] = x[places[k - 1]]
    return int((marked | (x == 1)).sum())


def sequential_bouts(table: DataFrame, lo: float, hi: float, epoch_seconds: int, minutes: float, share: float, metric: int) -> DataFrame:
    """Bout minutes by metric 1 (growing) or 2 (marked), whose windows depend on those before."""
    if metric not in (1, 2):
        raise ValueError("sequential bout metrics are 1 and 2")
    n, count = int(minutes * 60 / epoch_seconds), {1: _bouts_growing, 2: _bouts_marked}[metric]

    def run(data):
        m = data["metric"].to_numpy()
        x = ((m >= lo) & (m < hi)).astype(int)
        return {"bout_minutes": np.array([count(x, n, share) * epoch_seconds / 60 if len(x) >= n else 0.0])}

    return per_recording(table.select(KEY, F.col("epoch").alias("sample_idx"), "metric"), run, "bout_minutes double")


def _rescore(sleep: np.ndarray) -> np.ndarray:
    """After 4, 10 or 15 minutes awake the next 1, 3 or 4 asleep count as awake; short sleep between long wakes too."""
    out, awake = sleep.copy(), 0
    for t in range(len(out)):
        if not out[t]:
            awake += 1
            continue
        lost = 4 if awake >= 15 else 3 if awake >= 10 else 1 if awake >= 4 else 0
        out[t : t + lost] = 0
        awake = 0
    edge = np.flatnonzero(np.diff(out)) + 1
    start = np.concatenate([[0], edge])
    size = np.diff(np.append(start, len(out)))
    for a, n in zip(start, size, strict=True):
        if out[a] and n <= 6 and 10 <= a < len(out) - 10:
            out[a : a + n] = 0
    return out


def rescored_sleep(scores: DataFrame) -> DataFrame:
    """Sleep (0 or 1) of each minute after rescoring; input columns sample_idx and sleep."""

    def run(data):
        return {"sample_idx": data["sample_idx"].to_numpy(), "sleep": _rescore(data["sleep"].to_numpy()).astype(np.int32)}

    return per_recording(scores.select(KEY, "sample_idx", "sleep"), run, "sample_idx long, sleep int")


# -- calibration ------------------------------------------------------------


def calibration(df: DataFrame, length: int, still: float = 0.013, **fit) -> DataFrame:
    """Offset, scale and temperature scale of each recording, from its still windows of `length` samples.

    Windows are averaged by Spark first, so the kernel sees a few rows an hour.
    """
    stats = [f(a).alias(f"{n}_{a}") for n, f in (("m", F.avg), ("s", F.stddev_samp)) for a in ("ax", "ay", "az")]
    has = "temperature" in df.columns
    e = epochs(df if has else df.withColumn("temperature", F.lit(0.0)), length, F.avg("temperature").alias("temp"), *stats)
    for a in ("ax", "ay", "az"):
        e = e.filter((F.col(f"s_{a}") < still) & (F.abs(f"m_{a}") < 2))

    def run(data):
        points = np.stack([data[f"m_{a}"].to_numpy() for a in ("ax", "ay", "az")], axis=1)
        offset, scale, warm, done = dsp.fit_sphere(points, data["temp"].to_numpy(), **fit)
        return {"offset": [offset.tolist()], "scale": [scale.tolist()], "temperature_scale": [warm.tolist()], "calibrated": [bool(done)]}

    return per_recording(e.withColumnRenamed("epoch", "sample_idx"), run, "offset array<double>, scale array<double>, temperature_scale array<double>, calibrated boolean")
