import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import detectors as dt
from test_operators import samples


def test_stillness(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([1 + rng.normal(0, 0.5, 300), np.ones(100), 1 + rng.normal(0, 0.5, 100)])
    got = dt.stillness(samples(spark, x=x), 0.01).collect()
    assert len(got) == 1 and abs(got[0].start_idx - 315) <= 16 and abs(got[0].stop_idx - 385) <= 16 and got[0].long


def test_nonwear_by_slope(spark):
    # active, then still and cooling, then active and warming
    rng = np.random.default_rng(1)
    fs, third = 5.0, 5 * 60 * 40
    a = np.concatenate([rng.normal(0, 0.5, (third, 3)), rng.normal(0, 1e-4, (third, 3)), rng.normal(0, 0.5, (third, 3))])
    temp = np.concatenate([np.full(third, 32.0), 32 - 10 * (1 - np.exp(-np.arange(third) / third * 4)), np.minimum(22.2 + np.arange(third) / third * 20, 32)])
    got = dt.nonwear_by_slope(samples(spark, ax=a[:, 0], ay=a[:, 1], az=a[:, 2], temperature=temp), fs).collect()
    assert len(got) == 1 and abs(got[0].start_idx - third) < 900 and abs(got[0].stop_idx - 2 * third) < 3000


def test_contacts_follow_a_walk(spark):
    fs, f = 50.0, 1.8
    t = np.arange(0, 20, 1 / fs)
    ap = 0.2 * np.sin(2 * np.pi * f * t) + 0.05 * np.sin(4 * np.pi * f * t)
    v = 0.25 * np.cos(2 * np.pi * f * t)
    rows = [(1, 1, 1, i, float(v[i]), float(ap[i])) for i in range(len(t))] + [(1, 1, 2, 0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "recording_id long, day_n int, bout_n long, sample_idx long, v double, ap double")
    got = dt.gait_bouts(df, fs).orderBy("ic").toPandas()
    assert len(got) > 20 and (got.bout_n == 1).all() and np.allclose(np.median(np.diff(got.ic)) / fs, 1 / f, atol=0.03)
    assert (got.fc > got.fc_opp).all() and (got.fc_opp > got.ic).all() and (got.forward_cycles == 2).mean() > 0.8
    assert got.h1.dropna().between(0.005, 0.2).all()


def test_transfer(spark):
    # two seconds of rising by 0.4 m between still phases
    fs = 50.0
    t = np.arange(0, 2, 1 / fs)
    lift = 0.4 / 2 * (2 * np.pi / 2) * np.sin(2 * np.pi * t / 2) / 9.81
    z = np.concatenate([np.ones(500), 1 + lift, np.ones(500)])
    got = dt.transfers(samples(spark, ax=np.zeros(len(z)), ay=np.zeros(len(z)), az=z), fs).collect()
    assert len(got) == 1 and abs(got[0].displacement - 0.4) < 0.1 and 450 < got[0].start_idx < 530 and 560 < got[0].stop_idx < 640
    assert dt.transfers(samples(spark, ax=np.zeros(9), ay=np.zeros(9), az=np.ones(9)), fs).count() == 0


def test_partial_transfers(spark):
    df = spark.createDataFrame([(1, 1, d) for d in (0.4, 0.42, 0.2, 0.39)], "recording_id long, day_n int, displacement double")
    assert sorted(r.displacement for r in dt.whole_transfers(df).collect()) == [0.39, 0.4, 0.42]


MODEL = """tree
max_feature_idx=1
objective=binary sigmoid:1

Tree=0
num_leaves=3
split_feature=0 1
threshold=0.5 2
left_child=-1 -2
right_child=1 -3
leaf_value=-1 0.25 2

Tree=1
num_leaves=1
leaf_value=0.5

end of trees
"""


def test_trees(spark):
    m = dt.Trees.parse(MODEL)
    x = np.array([[0.5, 9], [0.6, 2], [0.6, 2.1]])
    assert m.margin(x).tolist() == [-0.5, 0.75, 2.5]
    df = spark.createDataFrame(x.tolist(), "a double, b double")
    got = dt.scored(df, ["a", "b"], m, 0.7).orderBy("a", "b").collect()
    assert [r.positive for r in got] == [False, False, True] and np.isclose(got[2].probability, 1 / (1 + np.exp(-2.5)))
    with pytest.raises(ValueError):
        dt.scored(df, ["a"], m, 0.7)
