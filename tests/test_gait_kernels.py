import numpy as np

from kinelake.operators import gait_kernels as gk


def test_lagged_correlations():
    x = np.random.default_rng(0).normal(size=120)
    c = gk.lagged_correlations(x, 130)
    assert np.isclose(c[0], 1) and np.isclose(c[7], np.corrcoef(x[:-7], x[7:])[0, 1]) and (c[110:] == 0).all()
    assert np.isclose(gk.lagged_correlations(x, 130, biased=True)[7], c[7] * 113 / 120)


def test_turns():
    fs = 50.0
    rate = np.concatenate([np.zeros(100), np.full(100, np.pi / 2), np.zeros(100), np.full(50, -0.5), np.zeros(50)])
    gyro, accel = np.stack([np.zeros(400), np.zeros(400), rate], 1), np.tile([0.0, 0.0, 1.0], (400, 1))
    t = gk.turns(gyro, accel, fs)
    assert (t[105:195] == 1).all() and (t[210:] == 0).all() and (t[:95] == 0).all()


def test_regular_walk(spark):
    fs, f = 50.0, 1.0
    t = np.arange(0, 30, 1 / fs)
    # a stride a second; two equal steps with a small difference between the feet
    v = np.cos(4 * np.pi * f * t) + 0.1 * np.cos(2 * np.pi * f * t)
    rows = [(1, 1, 1, i, float(v[i]), float(0.3 * v[i]), float(0.1 * v[i]), 0.0, 0.0, 0.0) for i in range(len(t))]
    samples = spark.createDataFrame(rows, "recording_id long, day_n int, bout_n long, sample_idx long, v double, ap double, ml double, gx double, gy double, gz double")
    strides = spark.createDataFrame([(1, 1, 1, k, 25 * k, 25 * k + 33, 2 if k < 38 else 0) for k in range(40)], "recording_id long, day_n int, bout_n long, stride_idx long, ic long, fc long, forward_cycles long")
    got = gk.signal_endpoints(samples, strides, fs).orderBy("stride_idx").toPandas()
    assert len(got) == 40 and np.allclose(got.stride_regularity, 1, atol=1e-6) and (got.step_regularity < 0.999).all() and (got.step_regularity > 0.95).all()
    assert np.allclose(got.intra_stride_covariance.dropna(), 1) and (got.harmonic_ratio.dropna() > 2).all() and (got.in_turn == 0).all()
    assert got.gait_symmetry_index.between(0.9, 1.01).all() and (got.stride_sparc.dropna() < 0).all()
