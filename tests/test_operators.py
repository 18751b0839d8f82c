import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.functions.cutpoints import CUTPOINTS, level_range
from kinelake.functions.features import Bank, mean
from kinelake.operators import activity, intervals, kernels, timeline, windows
from kinelake.plans.pipeline import Pipeline, Recording


def samples(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(1, i, *[float(v[i]) for v in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "recording_id long, sample_idx long, " + ", ".join(f"{c} double" for c in columns))


@pytest.mark.parametrize("skip", [1, 2, 7, 150, 300])
def test_moving_statistics(spark, skip):
    x = np.random.default_rng(1).random(700)
    w = 150
    got = windows.moving(samples(spark, x=x), "x", w, skip, ["mean", "sd", "skewness", "kurtosis", "median", "max", "min"]).orderBy("sample_idx").toPandas()
    view = np.lib.stride_tricks.sliding_window_view(x, w)[::skip]
    assert got.sample_idx.tolist() == list(range(0, len(x) - w + 1, skip))
    d = view - view.mean(1, keepdims=True)
    want = {"mean": view.mean(1), "sd": view.std(1, ddof=1), "skewness": (d**3).mean(1) / (d**2).mean(1) ** 1.5, "kurtosis": (d**4).mean(1) / (d**2).mean(1) ** 2 - 3, "median": np.median(view, 1), "max": view.max(1), "min": view.min(1)}
    for k, v in want.items():
        assert np.allclose(got[k], v), k


def test_moving_edges(spark):
    df = samples(spark, x=np.arange(10.0))
    got = windows.moving(df, "x", 4, 2, ["mean"], trim=False).orderBy("sample_idx").toPandas()
    assert got.sample_idx.tolist() == [0, 2, 4, 6, 8] and np.isnan(got["mean"].iloc[-1])
    for bad in (0, -1):
        with pytest.raises(ValueError):
            windows.moving(df, "x", 4, bad, ["mean"])
    assert windows.window_samples(50.0, 3.0, 0.5) == (150, 75) and windows.window_samples(50.0, 3.0, 10) == (150, 10)
    with pytest.raises(ValueError):
        windows.window_samples(50.0, 3.0, 1.5)


# wear less sleep in one day, three cases with known answers
WEAR = [(200, 1800), (2300, 2900), (3000, 3900)]
CASES = [
    ([(200, 800), (1200, 1800), (2200, 2800), (4200, 5000)], [(2800, 2900), (3000, 3900)]),
    ([(200, 800), (1800, 2500), (3800, 4400)], [(2500, 2900), (3000, 3800)]),
    ([(200, 200), (1500, 1900), (4200, 5000)], [(2300, 2900), (3000, 3900)]),
]


@pytest.mark.parametrize("sleep,want", CASES)
def test_interval_cases(spark, sleep, want):
    make = lambda rows: spark.createDataFrame([(1, a, b) for a, b in rows], "recording_id long, start_idx long, stop_idx long")
    day = spark.createDataFrame([(1, 2000, 4000)], "recording_id long, lo long, hi long")
    got = intervals.intersection(day, [make(WEAR)], [make(sleep)]).orderBy("start_idx").collect()
    assert [(r.start_idx, r.stop_idx) for r in got] == want


def test_days_across_clock_change(spark):
    # 2023-11-04 18:00 to 11-06 02:00 in New York, a sample a minute
    t0 = 1699135200.0
    df = samples(spark, t=t0 + 60.0 * np.arange(33 * 60))
    got = timeline.day_windows(df, 0, 24, "US/Eastern").orderBy("day_n").collect()
    assert [(r.start_idx, r.stop_idx) for r in got] == [(0, 360), (360, 1860), (1860, 1979)]
    with pytest.raises(ValueError):
        timeline.day_windows(df, 24, 24)


def test_bouts_against_loops(spark):
    rng = np.random.default_rng(3)
    m = np.clip(np.repeat(rng.random(120), rng.integers(1, 12, 120)), 0, 1)
    table = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(m)], "recording_id long, epoch long, metric double")
    x = ((m >= 0.3) & (m < 2)).astype(int)
    n, brk = 12, 13
    y = x.copy()
    for i in range(len(x)):
        lo, hi = i - 6, i + 7
        if lo < 0 or hi > len(x) or x[lo:hi].sum() == 0:
            y[i] = -12 * n
    for ends in (False, True):
        inside = np.zeros(len(x), bool)
        for i in range(len(x) - n + 1):
            if y[i : i + n].sum() > 0.8 * n + 1e-9 and (not ends or x[i] and x[i + n - 1]):
                inside[i : i + n] = True
        got = activity.bout_minutes(table, ["recording_id"], 0.3, 2, 5, 1, 0.8, ends).first().bout_minutes
        assert np.isclose(got, inside.sum() * 5 / 60)


def test_levels():
    assert level_range("mod", "migueles_wrist_adult") == (0.110, 0.440) and len(CUTPOINTS) == 18
    assert level_range("mvpa", "migueles_wrist_adult") == (0.110, 1e5)
    with pytest.raises(ValueError):
        level_range("sedentary", "vaha-ypya_hip_adult")
    with pytest.raises(ValueError):
        level_range("none", "migueles_wrist_adult")


def test_rescoring():
    s = np.array([0] * 15 + [1] * 10 + [0] * 5 + [1] * 10)
    got = kernels._rescore(s)
    assert got.tolist() == [0] * 31 + [1] * 9


def test_bank(spark):
    b = Bank(mean=mean())
    assert "mean" in b and "other" not in b
    with pytest.raises(ValueError):
        b.add("mean", mean())


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = samples(spark, t=np.arange(120.0), ax=rng.normal(size=120), ay=rng.normal(size=120), az=rng.normal(size=120))
    p = Pipeline().add("enmo_epochs", length=5).add("intensity", cutpoints="migueles_wrist_adult", per_minute=12.0).add("enmo_epochs", length=10)
    assert [s["name"] for s in p.steps] == ["enmo_epochs", "intensity", "enmo_epochs_1"]
    path = str(tmp_path / "p.json")
    p.save(path)
    out = Pipeline.load(path).run(Recording({"samples": df}))
    r = out["intensity"].first()
    assert np.isclose(r.sed_minutes + r.light_minutes + r.mod_minutes + r.vig_minutes, 2.0)
    with pytest.raises(ValueError):
        Pipeline().add("nothing")
    with pytest.raises(KeyError):
        Pipeline().add("intensity", cutpoints="migueles_wrist_adult", per_minute=12.0).run(Recording({"samples": df}))


def test_calibration(spark):
    rng = np.random.default_rng(5)
    pose = rng.normal(size=(60, 3))
    pose /= np.linalg.norm(pose, axis=1, keepdims=True)
    a = np.repeat(pose / [1.05, 0.97, 1.02] - [0.01, 0.02, -0.02], 10, axis=0) + rng.normal(0, 1e-4, (600, 3))
    got = kernels.calibration(samples(spark, ax=a[:, 0], ay=a[:, 1], az=a[:, 2]), 10).first()
    assert got.calibrated and np.allclose(got.scale, [1.05, 0.97, 1.02], rtol=2e-3) and np.allclose(got.offset, [0.01, 0.02, -0.02], atol=2e-3)


def test_activity_counts_do_not_alias(spark):
    t = np.arange(1000) / 100
    a = np.sin(2 * np.pi * 31 * t)  # sampled at 30 Hz this would look like 1 Hz
    got = kernels.activity_counts(samples(spark, ax=a, ay=0 * t, az=np.sin(2 * np.pi * t)), 100.0, 1).orderBy("epoch").toPandas()[2:-1]
    assert len(got) >= 6 and (got.counts_x == 0).all() and (got.counts_z > 0).all()
