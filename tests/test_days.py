import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.functions.cutpoints import CUTPOINTS
from kinelake.operators import days as dy
from test_operators import samples
from test_walking import walk


def intervals(spark, *pairs):
    return spark.createDataFrame([(1, a, b) for a, b in pairs], "recording_id long, start_idx long, stop_idx long")


def day_table(spark, *pairs):
    return spark.createDataFrame([(1, n + 1, a, b) for n, (a, b) in enumerate(pairs)], "recording_id long, day_n int, start_idx long, stop_idx long")


def recording(spark, a, **more):
    return samples(spark, ax=a[:, 0], ay=a[:, 1], az=a[:, 2], **more)


def test_samples_find_their_interval(spark):
    df = samples(spark, x=np.arange(100.0))
    got = dy.within(df, intervals(spark, (3, 8), (8, 40), (50, 50), (90, 200)), block=7).toPandas()
    want = {i: 3 if i < 8 else 8 if i < 40 else 90 for i in [*range(3, 40), *range(90, 100)]}
    assert dict(zip(got.sample_idx, got.start_idx)) == want and len(got) == len(want)


def test_segments_of_days(spark):
    days = day_table(spark, (0, 100), (100, 200), (200, 300))
    got = dy.segments(days, [intervals(spark, (10, 150))], [intervals(spark, (20, 30), (90, 110))]).orderBy("day_n", "start_idx").collect()
    assert [(r.day_n, r.start_idx, r.stop_idx) for r in got] == [(1, 10, 20), (1, 30, 90), (2, 110, 150)]


def test_daily_activity_by_brute_force(spark):
    fs, n = 2.0, 7200 * 2
    rng = np.random.default_rng(0)
    a = rng.normal(0, 0.05, (n, 3)) + [0, 0, 1]
    a[2000:5000, 2] += 0.3
    df, days = recording(spark, a), day_table(spark, (0, n // 2), (n // 2, n))
    wear, asleep = intervals(spark, (100, 6000), (7300, 7600)), intervals(spark, (600, 1500))
    got = dy.daily_activity(df, days, fs, wear, asleep, least_wear=0.5).orderBy("day_n").toPandas()
    assert got.hours.tolist() == [1.0, 1.0] and got.wear_hours.tolist() == [0.8, 0.0] and got.wake_hours[0] == 0.7
    cuts = CUTPOINTS["migueles_wrist_adult"]
    enmo = np.maximum(np.linalg.norm(a, axis=1) - 1, 0)
    short = np.concatenate([enmo[s : s + (e - s) // 10 * 10].reshape(-1, 10).mean(axis=1) for s, e in ((100, 600), (1500, 6000))])
    assert np.isclose(got.sed_minutes[0], (short < cuts["sedentary"]).sum() / 12) and np.isclose(got.mod_minutes[0], ((short >= cuts["light"]) & (short < cuts["moderate"])).sum() / 12)
    night = enmo[600:1500].reshape(-1, 10).mean(axis=1)
    assert np.isclose(got.sleep_sed_minutes[0], (night < cuts["sedentary"]).sum() / 12)
    minutes = [enmo[s : s + (e - s) // 120 * 120].reshape(-1, 120).mean(axis=1) < cuts["sedentary"] for s, e in ((100, 600), (1500, 6000))]
    lengths = [len(r) for m in minutes for r in "".join("1" if x else " " for x in m).split()]
    assert np.isclose(got.sed_average_duration[0], np.mean(lengths)) and got.sed_minutes.isna().tolist() == [False, True]
    assert got.mvpa_bout_minutes[0] > 20 and got.max_mean.isna().tolist() == [False, True]
    assert dy.daily_activity(df, days, fs, least_wear=0.0).count() == 2
    with pytest.raises(ValueError):
        dy.segment_metric(df, days, fs, 5, {"metric": "none"})


def test_other_metrics(spark):
    a = np.random.default_rng(1).normal(0, 0.3, (4000, 3)) + [0, 0, 1]
    df, days = recording(spark, a), day_table(spark, (0, 4000))
    for name in ("vaha-ypya_hip_adult", "white_met", "schaefer_ndomwrist_child6-11"):
        got = dy.daily_activity(df, days, 40.0, cutpoints=name, least_wear=0.0).collect()
        assert len(got) == 1 and got[0].mvpa_minutes is not None and ("sed_minutes" in got[0].asDict()) == (name != "vaha-ypya_hip_adult")


def test_daily_sleep(spark):
    fs, rng = 1.0, np.random.default_rng(2)
    hours = lambda h: int(h * 3600 * fs)
    n = hours(12)
    a = rng.normal(0, 1, (n, 3))
    a[hours(3) : hours(9)] = [0.1, 0.2, 0.97] + rng.normal(0, 1e-3, (hours(6), 3))
    a[hours(5) : hours(5) + 600] = rng.normal(0, 1, (600, 3))  # ten minutes awake
    temperature = np.where(np.arange(n) < hours(4), 20.0, 33.0)
    df, days = recording(spark, a, temperature=temperature), day_table(spark, (0, n), (n, n + 100))
    limits = {"smooth": 60, "rest": 360, "pause": 720}
    got = dy.daily_sleep(df, days, fs, **limits).toPandas()
    assert got.day_n.tolist() == [1] and abs(got.start_idx[0] - hours(3)) < 400 and abs(got.stop_idx[0] - hours(9)) < 400
    assert abs(got.opportunity_minutes[0] - 360) < 12 and abs(got.total_sleep_time[0] - 350) < 25 and got.wake_bouts[0] >= 0 and 90 < got.percent_time_asleep[0] <= 100
    worn = dy.daily_sleep(df, days, fs, intervals(spark, (0, hours(7))), **limits).toPandas()
    assert abs(worn.stop_idx[0] - hours(7)) < 400
    warm = dy.sleep_windows(df, days.filter("day_n = 1"), fs, cold=26.0, **limits).collect()
    assert abs(warm[0].start_idx - hours(4)) < 400
    bare = dy.daily_sleep(df, days, fs, intervals(spark, (0, hours(1))), least_wear=5.0, **limits).toPandas()
    assert bare.day_n.tolist() == [1] and bare.start_idx.isna().all() and bare.total_sleep_time.isna().all()


def test_daily_gait_and_transfers(spark):
    fs = 50.0
    v, ap, ml = walk(fs, 15)
    rest = np.random.default_rng(1).normal(0, 1e-3, (500, 3)) + [0, 1, 0]
    steps = np.stack([ml, v, ap], axis=1)
    a = np.concatenate([rest, steps, rest, steps])
    df, days = recording(spark, a), day_table(spark, (0, 1250), (1250, len(a)))
    bouts = intervals(spark, (500, 800), (810, 1250), (1750, 2500), (2000, 2010))
    placed = dy.daily_bouts(days, bouts, fs).orderBy("day_n").collect()
    assert [(r.day_n, r.bout_n, r.start_idx, r.stop_idx) for r in placed] == [(1, 1, 500, 1250), (2, 1, 1750, 2500)]
    got = dy.daily_gait(df, days, fs, 0.9, bouts).toPandas()
    assert set(got.day_n) == {1, 2} and got.groupby("day_n").size().min() > 15 and np.isclose(got.step_time.median(), 1 / 1.8, atol=0.03) and got.gait_speed.dropna().gt(0).all()
    t = np.arange(0, 2, 1 / fs)
    lift = 0.4 / 2 * np.pi * np.sin(np.pi * t) / 9.81
    z = np.concatenate([np.ones(500), 1 + lift, np.ones(500)])
    flat = np.zeros(2 * len(z))
    still = samples(spark, ax=flat, ay=flat, az=np.concatenate([z, z]))
    found = dy.daily_transfers(still, day_table(spark, (0, len(z)), (len(z), 2 * len(z))), fs).orderBy("day_n").collect()
    assert [r.day_n for r in found] == [1, 2] and found[1].start_idx - found[0].start_idx == len(z)
    assert dy.daily_gait(df.filter(F.lit(False)), days, fs, 0.9, bouts).count() == 0


def test_pipeline_of_days(spark):
    from kinelake.plans.pipeline import Pipeline, Recording

    fs, n = 1.0, 3600 * 8
    a = np.random.default_rng(4).normal(0, 0.5, (n, 3)) + [0, 0, 1]
    a[3600 : 3600 * 5] = [0, 0, 1] + np.random.default_rng(5).normal(0, 1e-3, (3600 * 4, 3))
    start = Recording({"samples": recording(spark, a), "days": day_table(spark, (0, n))})
    done = Pipeline().add("sleep_days", fs=fs).add("activity_days", fs=fs, least_wear=1.0).run(start)
    assert done["sleep"].count() == 1 and done["activity"].collect()[0].sleep_sed_minutes > 100
