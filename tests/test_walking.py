import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.functions import dsp
from kinelake.operators import classifiers, detectors, kernels, timeline, walking
from test_detectors import MODEL
from test_operators import samples


def walk(fs=50.0, seconds=20, f=1.8, turned=False):
    """Vertical, forward and lateral acceleration of steps at f Hz."""
    t = np.arange(0, seconds, 1 / fs)
    v = 1 + 0.25 * np.cos(2 * np.pi * f * t) + 0.05 * np.cos(4 * np.pi * f * t)
    ap = 0.2 * np.sin(2 * np.pi * f * t) + 0.08 * np.sin(4 * np.pi * f * t)
    ml = 0.02 * np.sin(np.pi * f * t) + np.random.default_rng(0).normal(0, 0.002, len(t))
    return (-v, -ap, ml) if turned else (v, ap, ml)


def test_axes_and_step_time():
    fs = 50.0
    v, ap, ml = walk(fs)
    a = np.stack([ml, v, ap], axis=1)
    assert walking.forward_axis(a, fs, 1) == 2
    assert walking.forward_sign(ap, fs) == -walking.forward_sign(-ap, fs)
    assert abs(walking.step_time(ap, fs) - 1 / 1.8) < 0.03
    with pytest.raises(ValueError):
        walking.step_time(ap[:100], fs)


def test_levelled_takes_out_the_tilt():
    v, ap, ml = (x - x.mean() for x in walk())
    angle = 0.2
    tilted_v, tilted_ap = (1 + v) * np.cos(angle) - ap * np.sin(angle), (1 + v) * np.sin(angle) + ap * np.cos(angle)
    got = walking.levelled(tilted_v, tilted_ap, ml)
    assert np.allclose(got[0], 1 + v, atol=0.01) and np.allclose(got[1], ap, atol=0.01)
    assert walking.levelled(v, ap + 2, ml)[1] is not None and np.array_equal(walking.levelled(v, ap + 2, ml)[1], ap + 2)


def test_scales_and_vertical_contacts():
    assert walking.vertical_scales(250.0, 2.0) == (36.0, 27.0) and walking.vertical_scales(250.0, 0.5)[1] == 90.0
    assert walking.vertical_scales(50.0, 2.0, related=False) == (8.0, 8.0) == walking.vertical_scales(50.0, None)
    fs, f = 50.0, 1.8
    v, _, _ = walk(fs, f=f)
    for sign in (1, -1):
        first, last = walking.vertical_contacts(detectors.detrended(sign * v), fs, f, sign)
        for found in (first, last):
            assert abs(np.median(np.diff(found)) / fs - 1 / f) < 0.03 and len(found) > 30


def test_strides_from_raw_bouts(spark):
    fs = 50.0
    rows = []
    for bout, turned in ((1, False), (2, True)):
        v, ap, ml = walk(fs, turned=turned)
        rows += [(1, 1, bout, i, float(ml[i]), float(v[i]), float(ap[i])) for i in range(len(v))]
    rows += [(1, 1, 3, i, 0.0, 1.0, 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "recording_id long, day_n int, bout_n long, sample_idx long, ax double, ay double, az double")
    bouts = walking.prepared_bouts(df, fs).cache()
    facts = {r.bout_n: r for r in bouts.groupBy("bout_n").agg(*[F.first(c).alias(c) for c in ("v_axis", "ap_axis", "v_sign", "ap_sign", "step_frequency")], F.count("*").alias("n")).collect()}
    assert set(facts) == {1, 2} and all((r.v_axis, r.ap_axis, r.n) == (1, 2, 1000) and abs(r.step_frequency - 1.8) < 0.1 for r in facts.values())
    assert (facts[1].v_sign, facts[2].v_sign) == (1, -1) and facts[1].ap_sign == -facts[2].ap_sign
    for events in ("forward", "vertical"):
        got = walking.walking_strides(bouts, fs, events).toPandas()
        for _, part in got.groupby("bout_n"):
            assert len(part) > 20 and abs(np.median(np.diff(sorted(part.ic))) / fs - 1 / 1.8) < 0.03, events
    old = walking.legacy_strides(df, fs).toPandas()
    assert set(old.bout_n) == {1, 2} and all(len(p) > 20 and abs(np.median(np.diff(sorted(p.ic))) / fs - 1 / 1.8) < 0.03 for _, p in old.groupby("bout_n"))
    with pytest.raises(ValueError):
        walking.walking_strides(bouts, fs, "lateral")
    assert walking.prepared_bouts(df.limit(0), fs).count() == 0


def test_resampled_does_not_alias(spark):
    fs, n = 100.0, 1000
    t = np.arange(n) / fs
    slow, fast = np.sin(2 * np.pi * t), np.sin(2 * np.pi * 23 * t)  # 23 Hz folds to 3 Hz at 20 Hz and to 7 at 30 Hz
    df = samples(spark, t=t, x=slow + fast)
    inner = slice(30, -30)
    for goal in (20.0, 30.0):
        got = timeline.resampled(df, ["x"], fs, goal).orderBy("sample_idx").toPandas()
        want = np.sin(2 * np.pi * got.t)
        assert np.allclose(np.diff(got.t), 1 / goal) and np.abs(got.x - want)[inner].max() < 0.06
        raw = timeline.resampled(df, ["x"], fs, goal, low_pass=False).orderBy("sample_idx").toPandas()
        assert np.abs(raw.x - want)[inner].max() > 0.5
    up = timeline.resampled(df, ["x"], fs, 200.0).orderBy("sample_idx").toPandas()
    assert np.allclose(up.x[::2], slow + fast)
    brief = samples(spark, t=t[:5], x=t[:5])
    assert np.allclose(timeline.resampled(brief, ["x"], fs, 50.0).orderBy("sample_idx").toPandas().x, t[:5:2])


def test_combined_low_passes_known_rates(spark):
    t = np.arange(1000) / 100
    fast = samples(spark, t=t, x=np.sin(2 * np.pi * t) + np.sin(2 * np.pi * 23 * t))
    slow = samples(spark, t=t[::5], y=t[::5])
    got = timeline.combined(fast, slow, 0.05, ["x"], ["y"], (100.0, None)).orderBy("sample_idx").toPandas()
    assert np.allclose(got.y, got.t) and np.abs(got.x - np.sin(2 * np.pi * got.t))[20:-20].max() < 0.06


def test_interpolation_at_given_times(spark):
    df = samples(spark, t=np.array([0.0, 1.0, 3.0]), x=np.array([0.0, 10.0, 30.0]))
    times = samples(spark, t=np.array([-1.0, 0.5, 1.0, 2.0, 9.0]))
    got = timeline.interpolated_at(df, ["x"], times).orderBy("sample_idx").toPandas()
    assert got.x.tolist() == [0.0, 5.0, 10.0, 20.0, 30.0]


def brute_motion(a, fs=20, variation=0.41, deviation=0.013):
    y = np.linalg.norm(a, axis=1)
    for sos in (dsp.butterworth(6, 3.0 / (fs / 2), "low"), dsp.butterworth(1, 0.25 / (fs / 2), "high")):
        y = dsp.zero_phase(sos, y)
    cov = [y[i : i + fs].std(ddof=1) / (abs(y[i : i + fs].mean()) + 0.01) for i in range(len(y) - fs + 1)]
    out = []
    for k in range(len(cov) // fs):
        s = slice(k * fs, (k + 1) * fs)
        out.append(bool(np.mean([c >= variation for c in cov[s]]) >= 0.5 or max(a[s, j].std(ddof=1) for j in range(3)) >= deviation))
    return out


def test_motion_by_deviation(spark):
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.normal(0, 1e-4, (400, 3)), rng.normal(0, 0.2, (400, 3)), rng.normal(0, 1e-4, (410, 3))]) + [0, 0, 1]
    df = samples(spark, ax=a[:, 0], ay=a[:, 1], az=a[:, 2])
    got = kernels.motion_by_deviation(df).orderBy("second").toPandas()
    assert got.moving.tolist() == brute_motion(a) and got.moving[22:38].all() and not got.moving[5:15].any()
    bouts = kernels.moving_bouts(kernels.motion_by_deviation(df), 20.0).collect()
    assert any(b.start_idx <= 400 and b.stop_idx >= 780 for b in bouts)
    assert kernels.motion_by_deviation(samples(spark, ax=a[:9, 0], ay=a[:9, 1], az=a[:9, 2])).count() == 0
    with pytest.raises(ValueError):
        kernels.motion_by_deviation(df, 10.0)


def model(order, feature, threshold):
    """One split: the feature over the threshold is positive."""
    return detectors.Trees.parse(f"tree\nmax_feature_idx={len(order) - 1}\nobjective=binary sigmoid:1\n\nTree=0\nnum_leaves=2\nsplit_feature={order.index(feature)}\nthreshold={threshold}\nleft_child=-1\nright_child=-2\nleaf_value=-5 5\n\nend of trees\n")


def test_walking_features_and_bouts(spark):
    fs = 50.0
    v, ap, ml = walk(fs, 15)
    rest = np.random.default_rng(1).normal(0, 1e-3, (750, 3)) + [0, 1, 0]
    a = np.concatenate([rest, np.stack([ml, v, ap], axis=1), rest])
    df = samples(spark, t=np.arange(len(a)) / fs, ax=a[:, 0], ay=a[:, 1], az=a[:, 2])
    got = classifiers.walking_features(df, fs).orderBy("window").toPandas()
    assert len(got) == 15 and list(got.columns) == ["recording_id", "window", *classifiers.WALKING]
    sos = dsp.butterworth(1, (0.25 / 25, 5 / 25), "band")
    y = dsp.zero_phase(sos, np.linalg.norm(a, axis=1)).reshape(-1, 150)
    assert np.allclose(got["mean"], y.mean(axis=1)) and np.allclose(got.value_range, np.ptp(y, axis=1)) and np.allclose(got.rms, y.std(axis=1, ddof=1))
    assert np.allclose(got.autocorrelation, [np.corrcoef(w[:-15], w[15:])[0, 1] for w in y])
    assert np.allclose(got.dominant_frequency[6:9], 1.8, atol=0.2)
    bouts = classifiers.walking_bouts(df, fs, model(classifiers.WALKING, "rms", 0.1)).collect()
    assert [(b.start_idx, b.stop_idx) for b in bouts] == [(750, 1500)]
    twice = samples(spark, t=np.arange(2 * len(a)) / 100, ax=np.repeat(a[:, 0], 2), ay=np.repeat(a[:, 1], 2), az=np.repeat(a[:, 2], 2))
    bouts = classifiers.walking_bouts(twice, 100.0, model(classifiers.WALKING, "rms", 0.1)).collect()
    assert [(b.start_idx, b.stop_idx) for b in bouts] == [(1500, 3000)]
    with pytest.raises(ValueError):
        classifiers.walking_bouts(df, 10.0, model(classifiers.WALKING, "rms", 0.1))
    with pytest.raises(ValueError):
        classifiers.walking_bouts(df, fs, detectors.Trees.parse(MODEL))


def test_ambulation_bouts(spark):
    fs = 20.0
    v, ap, ml = walk(fs, 15)
    rest = np.random.default_rng(1).normal(0, 1e-3, (300, 3)) + [0, 1, 0]
    a = np.concatenate([rest, np.stack([ml, v, ap], axis=1), rest])
    df = samples(spark, t=np.arange(len(a)) / fs, ax=a[:, 0], ay=a[:, 1], az=a[:, 2])
    got = classifiers.ambulation_features(df).orderBy("window").toPandas()
    assert list(got.columns) == ["recording_id", "window", *classifiers.AMBULATION] and len(got) == 15
    sos = dsp.butterworth(1, 0.025, "high")
    y = np.stack([dsp.zero_phase(sos, w) for w in np.linalg.norm(a, axis=1).reshape(-1, 60)])
    assert np.allclose(got.std_dev, y.std(axis=1, ddof=1)) and np.allclose(got.autocorrelation_5[5:10], [np.corrcoef(w[:-5], w[5:])[0, 1] for w in y[5:10]])
    bouts = classifiers.ambulation_bouts(df, fs, model(classifiers.AMBULATION, "std_dev", 0.05)).collect()
    assert [(b.start_idx, b.stop_idx) for b in bouts] == [(300, 600)]


def test_strides_may_repeat_contacts():
    first, final = np.array([0, 10, 30, 60]), np.array([5, 35, 40, 65, 90])
    strict, free = detectors.strides_of(first, final, 50.0, 0.5), detectors.strides_of(first, final, 50.0, 0.5, 2.25, 0.2, strict=False)
    assert all(fc > opp > ic for ic, fc, opp, _ in strict + free) and len(free) >= len(strict)


def test_parts_of_a_recording_equal_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 5003
    a = np.cumsum(rng.normal(0, 0.05, (n, 3)), axis=0) * 0.2 + rng.normal(0, 0.3, (n, 3)) + [0, 0, 1]
    a[1500:2500] = [0, 0, 1] + rng.normal(0, 1e-3, (1000, 3))
    df = samples(spark, t=np.arange(n) / 50, ax=a[:, 0], ay=a[:, 1], az=a[:, 2], x=a[:, 0])
    results = {
        "filtered": lambda: kernels.filtered(df, "recording_id", 50.0, 4, 5.0, "low"),
        "low_passed": lambda: kernels.low_passed(df, ["ax", "ay"], 0.4),
        **{m: (lambda m=m: kernels.filtered_metric(df, 50.0, 25, m)) for m in ("bfen", "hfen", "hfenplus")},
        "index": lambda: kernels.activity_index(df, 50.0, 50, 1.0),
        "counts": lambda: kernels.activity_counts(df, 30.0, 1),
        "counts_50": lambda: kernels.activity_counts(df, 50.0, 1),
        "motion": lambda: kernels.motion(df, 50.0),
        "deviation": lambda: kernels.motion_by_deviation(df, 50.0, high=1.0, variation=2.0, deviation=0.3),
        "windows": lambda: classifiers._magnitudes(df, lambda m: dsp.zero_phase(dsp.butterworth(1, (0.05, 0.2), "band"), m), 60, 700),
    }
    whole = {k: f().toPandas() for k, f in results.items()}
    monkeypatch.setattr(kernels, "PART", 700)
    for k, f in results.items():
        by = [c for c in ("sample_idx", "epoch", "second") if c in whole[k]]
        one, many = (x.sort_values(by).reset_index(drop=True) for x in (whole[k], f().toPandas()))
        assert len(one) == len(many) > 50 and (one[by] == many[by]).all().all(), k
        for c in one.columns.difference([*by, "recording_id"]):
            assert np.allclose(one[c].astype(float), many[c].astype(float), rtol=1e-8, atol=1e-8), (k, c)


def test_memory_of_filters():
    sos = dsp.butterworth(4, 0.1, "low")
    x = np.zeros(4000)
    x[0] = 1
    y = dsp.Recursion.sections(sos)(x)
    assert np.abs(y[kernels.forgotten(sos) :]).max() < 1e-12 * np.abs(y).max()
