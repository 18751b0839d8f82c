"""All registered queries of the sensor engine, with their SQL.

Each query applies one operator to a signal of `signals`; floating results are
rounded to six places so that engines that add in another order agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import axes, features
from kinelake.functions.cutpoints import level_range
from kinelake.functions.fragmentation import fragmentation
from kinelake.operators import activity, classifiers, days, detectors, gait, gait_kernels, intervals, kernels, sleep, timeline, walking, wear, windows
from kinelake.plans import signals as sg
from kinelake.plans.signals import RUNS, SERIES, STATES, STRIDES, TRIAX, WINDOWS

FLAGSHIP = "intensity_minutes"
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


_W = "OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING)"

# -- moving statistics ------------------------------------------------------


def _moving_sql(expression: str, name: str, length: int, skip: int) -> str:
    over = _W.format(k=length - 1)
    return f"""WITH {SERIES}, m AS (SELECT recording_id, sample_idx, {expression.format(w=over)} AS v, count(x) {over} AS n FROM series)
SELECT recording_id, sample_idx, round(v, 6) AS "{name}" FROM m WHERE n >= {length} AND sample_idx % {skip} = 0"""


for _name, _stat, _expr, _len, _skip in (
    ("moving_mean", "mean", "avg(x) {w}", 10, 2),
    ("moving_sd", "sd", "stddev_samp(x) {w}", 10, 3),
    ("moving_max", "max", "max(x) {w}", 9, 1),
    ("moving_min", "min", "min(x) {w}", 12, 4),
):
    _add(_name, lambda s, d, a=(_len, _skip, [_stat]): _rounded(windows.moving(sg.series(s, d), "x", *a)), _moving_sql(_expr, _stat, _len, _skip))

for _name, _stat, _agg, _len, _skip in (
    ("moving_skewness", "skewness", "CASE WHEN sum(d * d) > 0 THEN sqrt(count(*)) * sum(d * d * d) / pow(sum(d * d), 1.5) END", 10, 2),
    ("moving_kurtosis", "kurtosis", "CASE WHEN sum(d * d) > 0 THEN count(*) * sum(d * d * d * d) / pow(sum(d * d), 2) - 3 END", 10, 5),
    ("moving_median", "median", "quantile_cont(x, 0.5)", 9, 3),
):
    _add(
        _name,
        lambda s, d, a=(_len, _skip, [_stat]): _rounded(windows.moving(sg.series(s, d), "x", *a)),
        f"""WITH {SERIES}, n AS (SELECT recording_id, count(*) AS n FROM series GROUP BY recording_id),
p AS (SELECT a.recording_id, a.sample_idx, b.x FROM series a JOIN n ON a.recording_id = n.recording_id AND a.sample_idx + {_len} <= n.n AND a.sample_idx % {_skip} = 0
    JOIN series b ON a.recording_id = b.recording_id AND b.sample_idx >= a.sample_idx AND b.sample_idx < a.sample_idx + {_len}),
q AS (SELECT recording_id, sample_idx, x, x - avg(x) OVER (PARTITION BY recording_id, sample_idx) AS d FROM p)
SELECT recording_id, sample_idx, round({_agg}, 6) AS {_stat} FROM q GROUP BY recording_id, sample_idx""",
    )

_add(
    "moving_mean_req_points",
    lambda s, d: _rounded(windows.moving(sg.series(s, d), "x", 12, 3, ["mean"], trim=False, required=6)),
    f"""WITH {SERIES}, m AS (SELECT recording_id, sample_idx, avg(x) {_W.format(k=11)} AS v, count(x) {_W.format(k=11)} AS n FROM series)
SELECT recording_id, sample_idx, round(CASE WHEN n >= 6 THEN v END, 6) AS mean FROM m WHERE sample_idx % 3 = 0""",
)
_add(
    "pad_moving_sd",
    lambda s, d: _rounded(windows.centred_sd(sg.series(s, d), "x", 6)),
    f"""WITH {SERIES}, m AS (SELECT recording_id, sample_idx, max(sample_idx) OVER (PARTITION BY recording_id) AS last,
    avg(x) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS m, stddev_samp(x) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS s FROM series)
SELECT a.recording_id, a.sample_idx, round(b.m, 6) AS mean, round(b.s, 6) AS sd
FROM m a JOIN m b ON a.recording_id = b.recording_id AND b.sample_idx = CASE WHEN a.sample_idx < 3 THEN 3 WHEN a.sample_idx > a.last - 2 THEN a.last - 2 ELSE a.sample_idx END
WHERE a.last >= 5""",
)
_add(
    "tumbling_windows",
    lambda s, d: _rounded(windows.epochs(sg.series(s, d), 8, F.avg("x").alias("mean"), F.min("t").alias("t0"), F.max("t").alias("t1"))),
    f"""WITH {SERIES} SELECT recording_id, sample_idx // 8 AS epoch, round(avg(x), 6) AS mean, round(min(t), 6) AS t0, round(max(t), 6) AS t1 FROM series GROUP BY recording_id, sample_idx // 8 HAVING count(*) = 8""",
)
_add(
    "autocovariance",
    lambda s, d: _rounded(windows.autocovariance(sg.series(s, d), "x", 6)),
    f"""WITH {SERIES}, z AS (SELECT recording_id, sample_idx, x - avg(x) OVER (PARTITION BY recording_id) AS d FROM series), k AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5)) v(lag)),
v AS (SELECT recording_id, sum(d * d) AS s0 FROM z GROUP BY recording_id HAVING sum(d * d) > 0)
SELECT a.recording_id, k.lag, round(sum(a.d * b.d) / min(v.s0), 6) AS value FROM z a, k, z b, v WHERE a.recording_id = b.recording_id AND b.sample_idx = a.sample_idx + k.lag AND v.recording_id = a.recording_id GROUP BY a.recording_id, k.lag""",
)
_DFA = [4, 8, 16, 32]
_add(
    "dfa",
    lambda s, d: _rounded(windows.detrended_fluctuation(sg.series(s, d), "x", _DFA)),
    f"""WITH {SERIES}, c AS (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n, x - avg(x) OVER (PARTITION BY recording_id) AS d FROM series),
y AS (SELECT recording_id, sample_idx, n, sum(d) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM c),
b AS (SELECT recording_id, box, sample_idx // box AS b, count(*) AS k, regr_syy(y, CAST(sample_idx % box AS DOUBLE)) - pow(regr_sxy(y, CAST(sample_idx % box AS DOUBLE)), 2) / regr_sxx(y, CAST(sample_idx % box AS DOUBLE)) AS rss
    FROM y, (VALUES (4), (8), (16), (32)) v(box) WHERE box <= n GROUP BY recording_id, box, sample_idx // box),
f AS (SELECT recording_id, box, sqrt(sum(greatest(rss, 0)) / sum(k)) AS dfa FROM b WHERE k = box GROUP BY recording_id, box),
a AS (SELECT recording_id, regr_slope(ln(dfa), ln(CAST(box AS DOUBLE))) AS alpha FROM f WHERE dfa > 0 GROUP BY recording_id)
SELECT recording_id, round(alpha, 6) AS alpha, round(exp(-abs(alpha - 1) / exp(-2.0)), 6) AS abi FROM a WHERE alpha IS NOT NULL""",
)

# -- samples ----------------------------------------------------------------

_MAG = "sqrt(ax * ax + ay * ay + az * az)"
_add(
    "vector_magnitude",
    lambda s, d: _rounded(sg.triax(s, d).select("recording_id", "sample_idx", axes.magnitude().alias("magnitude"), axes.z_angle().alias("z_angle"))),
    f"WITH {TRIAX} SELECT recording_id, sample_idx, round({_MAG}, 6) AS magnitude, round(degrees(atan2(az, sqrt(ax * ax + ay * ay))), 6) AS z_angle FROM triax",
)
_add(
    "arm_angle",
    lambda s, d: _rounded(sg.triax(s, d).select("recording_id", "sample_idx", axes.arm_angle().alias("arm_angle"))),
    f"WITH {TRIAX} SELECT recording_id, sample_idx, round(CASE WHEN {_MAG} > 0 THEN degrees(asin(ax / {_MAG})) END, 6) AS arm_angle FROM triax",
)
_add(
    "adc_scaling",
    lambda s, d: _rounded(sg.triax(s, d).select("recording_id", "sample_idx", axes.physical(F.col("ax"), -1.0, 1.0, -16.0, 16.0).alias("g"), axes.calibrated("az", F.lit(0.02), F.lit(1.01)).alias("calibrated"))),
    f"WITH {TRIAX} SELECT recording_id, sample_idx, round((ax + 1.0) / 2.0 * 32.0 - 16.0, 6) AS g, round((az + 0.02) * 1.01, 6) AS calibrated FROM triax",
)
_add(
    "absolute_difference",
    lambda s, d: _rounded(sg.series(s, d).select("recording_id", "sample_idx", axes.absolute_difference("x").alias("difference"))),
    f"WITH {SERIES} SELECT recording_id, sample_idx, round(coalesce(abs(x - lag(x) OVER (PARTITION BY recording_id ORDER BY sample_idx)), 0), 6) AS difference FROM series",
)
_add(
    "jerk",
    lambda s, d: _rounded(sg.series(s, d).select("recording_id", "sample_idx", axes.gradient("x", 0.5).alias("jerk"))),
    f"""WITH {SERIES}, n AS (SELECT *, lag(x) OVER w AS a, lag(x, 2) OVER w AS a2, lead(x) OVER w AS b, lead(x, 2) OVER w AS b2 FROM series WINDOW w AS (PARTITION BY recording_id ORDER BY sample_idx))
SELECT recording_id, sample_idx, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b - a WHEN a IS NULL THEN -3 * x + 4 * b - b2 ELSE 3 * x - 4 * a + a2 END, 6) AS jerk FROM n""",
)
_add(
    "cumulative_integral",
    lambda s, d: _rounded(sg.series(s, d).withColumn("p", axes.trapezoid_part("x")).select("recording_id", "sample_idx", axes.cumulative_trapezoid("p", 0.02).alias("integral"))),
    f"""WITH {SERIES}, p AS (SELECT recording_id, sample_idx, coalesce((x + lag(x) OVER (PARTITION BY recording_id ORDER BY sample_idx)) / 2, 0) AS p FROM series)
SELECT recording_id, sample_idx, round(0.02 * sum(p) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS integral FROM p""",
)
_add(
    "linear_detrend",
    lambda s, d: _rounded(sg.series(s, d).select("recording_id", "sample_idx", axes.detrended("x").alias("residual"))),
    f"""WITH {SERIES}, r AS (SELECT recording_id, regr_slope(x, CAST(sample_idx AS DOUBLE)) AS b, regr_intercept(x, CAST(sample_idx AS DOUBLE)) AS a FROM series GROUP BY recording_id)
SELECT s.recording_id, s.sample_idx, round(s.x - (r.a + r.b * s.sample_idx), 6) AS residual FROM series s JOIN r ON s.recording_id = r.recording_id""",
)


def _levelled(s, d):
    m = Window.partitionBy("recording_id")
    t = sg.triax(s, d).withColumns({f"m{a}": F.avg(f"a{a}").over(m) for a in "xyz"})
    v, ap, ml = axes.levelled("az", "ax", "ay", F.col("mz"), F.col("mx"), F.col("my"))
    return _rounded(t.select("recording_id", "sample_idx", v.alias("vertical"), ap.alias("forward"), ml.alias("lateral")))


_add(
    "orientation_correction",
    _levelled,
    f"""WITH {TRIAX}, m AS (SELECT *, avg(ax) OVER p AS a, avg(ay) OVER p AS m, sign(avg(az) OVER p) AS s FROM triax WINDOW p AS (PARTITION BY recording_id)),
q AS (SELECT *, sqrt(1 - a * a) AS ca, sqrt(1 - m * m) AS cm FROM m WHERE abs(a) <= 1 AND abs(m) <= 1)
SELECT recording_id, sample_idx, round(s * ay * m + (s * ax * a + az * ca) * cm, 6) AS vertical, round(ax * ca - s * az * a, 6) AS forward, round(ay * cm - s * (s * ax * a + az * ca) * m, 6) AS lateral FROM q
UNION ALL SELECT recording_id, sample_idx, round(az, 6), round(ax, 6), round(ay, 6) FROM m WHERE NOT (abs(a) <= 1 AND abs(m) <= 1)""",
)

# -- activity ---------------------------------------------------------------

_EPOCH = 5
for _name, _f, _agg in (
    ("epoch_en", activity.metric_en, f"avg({_MAG})"),
    ("zangle_epoch", activity.metric_angle, "avg(degrees(atan2(az, sqrt(ax * ax + ay * ay))))"),
    ("enmo_epochs", activity.metric_enmo, f"avg(greatest({_MAG} - 1, 0))"),
):
    _add(_name, lambda s, d, f=_f: _rounded(f(sg.triax(s, d), _EPOCH)), f"WITH {TRIAX} SELECT recording_id, sample_idx // 5 AS epoch, round({_agg}, 6) AS metric FROM triax GROUP BY recording_id, sample_idx // 5 HAVING count(*) = 5")
_add(
    "mad_epochs",
    lambda s, d: _rounded(activity.metric_mad(sg.triax(s, d), _EPOCH)),
    f"""WITH {TRIAX}, m AS (SELECT recording_id, sample_idx // 5 AS epoch, {_MAG} AS m FROM triax), a AS (SELECT *, abs(m - avg(m) OVER (PARTITION BY recording_id, epoch)) AS d FROM m)
SELECT recording_id, epoch, round(avg(d), 6) AS metric FROM a GROUP BY recording_id, epoch HAVING count(*) = 5""",
)
_add(
    "enmo_met_epochs",
    lambda s, d: _rounded(activity.metric_enmo_met(sg.triax(s, d), 4, 6)),
    f"""WITH {TRIAX}, a AS (SELECT recording_id, sample_idx // 4 AS sec, 1000 * avg(greatest({_MAG} - 1, 0)) AS e FROM triax GROUP BY recording_id, sample_idx // 4 HAVING count(*) = 4),
b AS (SELECT recording_id, sec // 6 AS epoch, max(e) AS e FROM a GROUP BY recording_id, sec // 6 HAVING count(*) = 6)
SELECT recording_id, epoch, round((-10.58 + 1.1176 * e + 2.9418 * sqrt(e) - 0.00059277 * e * e) / 71.255, 6) AS metric FROM b""",
)
_CUT = "hildebrand_wrist_adult_geneactiv"
_ENMO = f"{TRIAX}, e AS (SELECT recording_id, sample_idx // 5 AS epoch, avg(greatest({_MAG} - 1, 0)) AS metric FROM triax GROUP BY recording_id, sample_idx // 5 HAVING count(*) = 5)"


def _enmo(s, d):
    return activity.metric_enmo(sg.triax(s, d), _EPOCH)


def _level_sql(level: str) -> str:
    lo, hi = level_range(level, _CUT)
    return f"round(sum(CASE WHEN metric >= {lo} AND metric < {hi} THEN 1 ELSE 0 END) / 12.0, 6) AS {level}_minutes"


_add(
    "intensity_minutes",
    lambda s, d: _rounded(activity.intensity_minutes(_enmo(s, d), ["recording_id"], 12.0, _CUT)),
    f"WITH {_ENMO} SELECT recording_id, {', '.join(map(_level_sql, ('sed', 'light', 'mod', 'vig', 'mvpa')))} FROM e GROUP BY recording_id",
)
_add(
    "intensity_gradient",
    lambda s, d: _rounded(activity.intensity_gradient(_enmo(s, d), ["recording_id"], 12.0)),
    f"""WITH {_ENMO}, h AS (SELECT recording_id, least(floor(metric / 0.025), 160) AS bin, count(*) / 12.0 AS minutes FROM e WHERE metric BETWEEN 0 AND 8 GROUP BY recording_id, least(floor(metric / 0.025), 160)),
l AS (SELECT recording_id, ln(CASE WHEN bin = 160 THEN 6000.0 ELSE (bin + 0.5) * 25 END) AS lx, ln(minutes) AS ly FROM h)
SELECT recording_id, round(CASE WHEN count(*) > 1 THEN regr_slope(ly, lx) END, 6) AS gradient, round(CASE WHEN count(*) > 1 THEN regr_intercept(ly, lx) END, 6) AS intercept, round(CASE WHEN count(*) > 1 THEN regr_r2(ly, lx) END, 6) AS r_squared FROM l GROUP BY recording_id""",
)
_add(
    "max_min_acceleration",
    lambda s, d: _rounded(activity.extreme_means(_enmo(s, d), ["recording_id"], 6)),
    f"""WITH {_ENMO}, m AS (SELECT recording_id, avg(metric) OVER w AS m, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY recording_id ORDER BY epoch ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
SELECT recording_id, round(max(m), 6) AS max_mean, round(min(m), 6) AS min_mean FROM m WHERE n = 6 GROUP BY recording_id""",
)


def _bout_sql(ends: bool) -> str:
    lo, hi = level_range("mvpa", _CUT)
    ok = " AND x = 1 AND last = 1" if ends else ""
    return f"""WITH {_ENMO}, x AS (SELECT recording_id, epoch, CASE WHEN metric >= {lo} AND metric < {hi} THEN 1 ELSE 0 END AS x FROM e),
n AS (SELECT *, sum(x) OVER w AS near, count(*) OVER w AS near_n FROM x WINDOW w AS (PARTITION BY recording_id ORDER BY epoch ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
y AS (SELECT *, CASE WHEN near_n < 13 OR near = 0 THEN -144 ELSE x END AS y FROM n),
f AS (SELECT *, sum(y) OVER w AS s, count(*) OVER w AS k, lead(x, 11) OVER (PARTITION BY recording_id ORDER BY epoch) AS last FROM y WINDOW w AS (PARTITION BY recording_id ORDER BY epoch ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
b AS (SELECT *, CASE WHEN k = 12 AND s > 0.8 * 12 + 1e-9{ok} THEN 1 ELSE 0 END AS st FROM f),
c AS (SELECT recording_id, max(st) OVER (PARTITION BY recording_id ORDER BY epoch ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS inside FROM b)
SELECT recording_id, round(sum(inside) * 5 / 60.0, 6) AS bout_minutes FROM c GROUP BY recording_id"""


for _name, _ends in (("bouts_metric3", False), ("bouts_metric4", True)):
    _add(_name, lambda s, d, e=_ends: _rounded(activity.bout_minutes(_enmo(s, d), ["recording_id"], *level_range("mvpa", _CUT), 5, 1, 0.8, e)), _bout_sql(_ends))
for _m in (1, 2):
    _add(f"bouts_metric{_m}", lambda s, d, m=_m: _rounded(kernels.sequential_bouts(_enmo(s, d), *level_range("mvpa", _CUT), 5, 1, 0.8, m)))
_THRESHOLDS = [round(0.02 * k, 2) for k in range(1, 26)]
_add(
    "equal_avg_duration",
    lambda s, d: _rounded(activity.equal_average_duration(_enmo(s, d), ["recording_id"], _THRESHOLDS)),
    f"""WITH {_ENMO}, t AS (SELECT recording_id, epoch, v.threshold, metric <= v.threshold AS low FROM e, (VALUES {', '.join(f'({t})' for t in _THRESHOLDS)}) v(threshold)),
n AS (SELECT *, CASE WHEN low = lag(low) OVER (PARTITION BY recording_id, threshold ORDER BY epoch) THEN 0 ELSE 1 END AS new FROM t),
g AS (SELECT recording_id, threshold, sum(CASE WHEN low THEN 1 ELSE 0 END) AS k1, sum(CASE WHEN low THEN new ELSE 0 END) AS r1, sum(CASE WHEN low THEN 0 ELSE 1 END) AS k0, sum(CASE WHEN low THEN 0 ELSE new END) AS r0 FROM n GROUP BY recording_id, threshold),
m AS (SELECT recording_id, threshold, CASE WHEN r1 > 0 THEN k1 * 1.0 / r1 ELSE 0 END AS below, CASE WHEN r0 > 0 THEN k0 * 1.0 / r0 ELSE 0 END AS above FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY round(abs(below - above), 9), threshold) AS r FROM m)
SELECT recording_id, round(CAST(threshold AS DOUBLE), 6) AS threshold, round(below, 6) AS duration FROM o WHERE r = 1""",
)

# -- runs and intervals -----------------------------------------------------

_add("rle", lambda s, d: intervals.runs(sg.states(s, d), "state"), f"WITH {RUNS} SELECT recording_id, run, state, start_idx, stop_idx, length FROM runs")
_add(
    "invert_intervals",
    lambda s, d: intervals.inverted(intervals.runs(sg.states(s, d), "state").filter("state = 1").select("recording_id", "start_idx", "stop_idx"), sg.states(s, d).groupBy("recording_id").agg(F.lit(0).cast("long").alias("lo"), (F.max("sample_idx") + 1).alias("hi"))),
    f"WITH {RUNS} SELECT recording_id, start_idx, stop_idx FROM runs WHERE state = 0",
)


def _wear_not_sleep(s, d):
    base = sg.series(s, d)
    day = base.groupBy("recording_id").agg(F.lit(5).cast("long").alias("lo"), (F.max("sample_idx") + 1 - 5).alias("hi")).filter("hi > lo")
    of = lambda c: intervals.runs(base.withColumn("state", F.when(c, 1).otherwise(0)), "state").filter("state = 1").select("recording_id", "start_idx", "stop_idx")
    return intervals.intersection(day, [of(F.col("x") > 20)], [of(F.col("x") > 80)])


_add(
    "interval_intersection",
    _wear_not_sleep,
    f"""WITH {SERIES}, n AS (SELECT recording_id, max(sample_idx) + 1 - 5 AS hi FROM series GROUP BY recording_id),
f AS (SELECT s.recording_id, s.sample_idx, CASE WHEN x > 20 AND NOT x > 80 AND s.sample_idx >= 5 AND s.sample_idx < n.hi THEN 1 ELSE 0 END AS ok FROM series s JOIN n ON s.recording_id = n.recording_id),
g AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY recording_id ORDER BY sample_idx) AS island FROM f WHERE ok = 1)
SELECT recording_id, min(sample_idx) AS start_idx, max(sample_idx) + 1 AS stop_idx FROM g GROUP BY recording_id, island""",
)
_add(
    "merge_bouts",
    lambda s, d: intervals.merged_bouts(intervals.runs(sg.states(s, d), "state").filter("state = 1").select("recording_id", "start_idx", "stop_idx"), 3, 4),
    f"""WITH {RUNS}, b AS (SELECT *, CASE WHEN start_idx - max(stop_idx) OVER (PARTITION BY recording_id ORDER BY start_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 3 THEN 0 ELSE 1 END AS nw FROM runs WHERE state = 1),
g AS (SELECT *, sum(nw) OVER (PARTITION BY recording_id ORDER BY start_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM b)
SELECT recording_id, min(start_idx) AS start_idx, max(stop_idx) AS stop_idx FROM g GROUP BY recording_id, grp HAVING max(stop_idx) - min(start_idx) > 4""",
)
_add(
    "drop_short_blocks",
    lambda s, d: intervals.drop_short(sg.states(s, d), "state", 3, 1, 0),
    f"""WITH {RUNS}, l AS (SELECT *, max(run) OVER (PARTITION BY recording_id) AS last FROM runs)
SELECT n.recording_id, n.sample_idx, CASE WHEN l.state = 1 AND l.length < 3 AND l.run > 1 AND l.run < l.last THEN 0 ELSE l.state END AS new_state FROM numbered n JOIN l ON n.recording_id = l.recording_id AND n.run = l.run""",
)
_add(
    "longest_bout",
    lambda s, d: intervals.longest(sg.states(s, d), "state", 1),
    f"WITH {RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY length DESC, start_idx) AS r FROM runs WHERE state = 1) SELECT recording_id, start_idx, stop_idx, length FROM o WHERE r = 1",
)
_FRAGMENTS = f"""WITH {RUNS}, l AS (SELECT recording_id, length, row_number() OVER w AS i, count(*) OVER p AS n, sum(length) OVER (PARTITION BY recording_id ORDER BY length, start_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    min(length) OVER p AS least, count(*) OVER (PARTITION BY recording_id, length) AS same, sum(1) OVER (PARTITION BY recording_id ORDER BY length DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach
    FROM runs WHERE state = 1 WINDOW w AS (PARTITION BY recording_id ORDER BY length, start_idx), p AS (PARTITION BY recording_id)),
a AS (SELECT recording_id, max(n) AS n, sum(length) AS s, sum(cum) AS area, sum(ln(length / (least - 0.5))) AS logs, sum(1.0 / reach) AS hazards, sum(1.0 / same) AS kinds FROM l GROUP BY recording_id)
SELECT recording_id, {{}} FROM a"""
for _name, _column, _expr in (
    ("avg_duration", "average_duration", "s * 1.0 / n"),
    ("transition_probability", "transition_probability", "n * 1.0 / s"),
    ("gini_index", "gini_index", "CASE WHEN n = 1 THEN 1.0 ELSE least((n + 1 - 2.0 * area / s) / n * n / (n - 1), 1.0) END"),
    ("average_hazard", "average_hazard", "hazards / kinds"),
    ("power_law", "power_law", "1 + n / logs"),
):
    _add(_name, lambda s, d, c=_column: _rounded(fragmentation(intervals.runs(sg.states(s, d), "state").filter("state = 1"), ["recording_id"]).select("recording_id", c)), _FRAGMENTS.format(f"round({_expr}, 6) AS {_column}"))

# -- time -------------------------------------------------------------------

_add(
    "estimate_fs",
    lambda s, d: timeline.estimated_fs(sg.series(s, d), 0, 40).select("recording_id", F.round("fs", 9).alias("fs")),
    f"WITH {SERIES}, s AS (SELECT recording_id, t - lag(t) OVER (PARTITION BY recording_id ORDER BY sample_idx) AS dt FROM series WHERE sample_idx <= 40) SELECT recording_id, round(1 / avg(dt), 9) AS fs FROM s WHERE dt IS NOT NULL GROUP BY recording_id",
)
_add(
    "gap_check",
    lambda s, d: _rounded(timeline.gaps(sg.series(s, d), 43200.0)),
    f"WITH {SERIES}, g AS (SELECT recording_id, lag(sample_idx) OVER w AS before_idx, sample_idx AS after_idx, t - lag(t) OVER w AS gap FROM series WINDOW w AS (PARTITION BY recording_id ORDER BY sample_idx)) SELECT recording_id, before_idx, after_idx, round(gap, 6) AS gap FROM g WHERE gap > 43200",
)
_add(
    "gap_segments",
    lambda s, d: timeline.segments(sg.series(s, d), 43200.0).select("recording_id", "sample_idx", "segment"),
    f"""WITH {SERIES}, g AS (SELECT recording_id, sample_idx, CASE WHEN t - lag(t) OVER (PARTITION BY recording_id ORDER BY sample_idx) > 43200 THEN 1 ELSE 0 END AS nw FROM series)
SELECT recording_id, sample_idx, sum(nw) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM g""",
)
_add(
    "gap_fill",
    lambda s, d: _rounded(timeline.filled(sg.series(s, d), 14400.0, {"x": 0.0}).drop("t")),
    f"""WITH {SERIES}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY recording_id ORDER BY sample_idx) > 21600 THEN 1 ELSE 0 END AS nw FROM series),
s AS (SELECT *, sum(nw) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM g),
f AS (SELECT *, min(t) OVER (PARTITION BY recording_id) AS t0, min(t) OVER (PARTITION BY recording_id, seg) AS ts, min(sample_idx) OVER (PARTITION BY recording_id, seg) AS i0 FROM s),
p AS (SELECT recording_id, sample_idx, x, CAST(floor((ts - t0) / 14400.0 + 1e-6) AS BIGINT) + sample_idx - i0 AS grid FROM f),
q AS (SELECT recording_id, grid, arg_min(x, sample_idx) AS x FROM p GROUP BY recording_id, grid),
e AS (SELECT recording_id, unnest(generate_series(0, CAST(floor((max(t) - min(t)) / 14400.0 + 0.5) AS BIGINT))) AS grid FROM series GROUP BY recording_id)
SELECT e.recording_id, e.grid AS sample_idx, round(coalesce(q.x, 0), 6) AS x FROM e LEFT JOIN q ON e.recording_id = q.recording_id AND e.grid = q.grid""",
)
_add(
    "resample_decimate",
    lambda s, d: _rounded(timeline.decimated(sg.series(s, d), 4)),
    f"WITH {SERIES} SELECT recording_id, sample_idx // 4 AS sample_idx, round(t, 6) AS t, round(x, 6) AS x FROM series WHERE sample_idx % 4 = 0",
)
_add(
    "resample_interp",
    lambda s, d: timeline.interpolated(sg.series(s, d), ["x"], 21600.0).select("recording_id", "sample_idx", F.round("x", 4).alias("x")),
    f"""WITH {SERIES}, e AS (SELECT recording_id, min(t) AS t0, unnest(generate_series(0, CAST(floor((max(t) - min(t)) / 21600.0 + 1e-9) AS BIGINT))) AS k FROM series GROUP BY recording_id),
g AS (SELECT recording_id, k, t0 + k * 21600.0 AS t FROM e), p AS (SELECT *, lead(t) OVER w AS t2, lead(x) OVER w AS x2 FROM series WINDOW w AS (PARTITION BY recording_id ORDER BY sample_idx))
SELECT g.recording_id, g.k AS sample_idx, round(p.x + coalesce((g.t - p.t) / nullif(p.t2 - p.t, 0) * (p.x2 - p.x), 0), 4) AS x FROM g JOIN p ON g.recording_id = p.recording_id AND p.t <= g.t AND (p.t2 > g.t OR p.t2 IS NULL)""",
)
_add(
    "trim_time",
    lambda s, d: timeline.trimmed(sg.series(s, d), F.lit(1704844800.0), F.lit(1705708800.0)).select("recording_id", "sample_idx"),
    f"""WITH {SERIES}, b AS (SELECT recording_id, max(CASE WHEN t <= 1704844800 THEN sample_idx END) AS a, min(CASE WHEN t >= 1705708800 THEN sample_idx END) AS b FROM series GROUP BY recording_id)
SELECT s.recording_id, s.sample_idx FROM series s JOIN b ON s.recording_id = b.recording_id WHERE (b.a IS NULL OR s.sample_idx >= b.a) AND (b.b IS NULL OR s.sample_idx < b.b)""",
)
_add(
    "trim_factor",
    lambda s, d: timeline.trimmed_to_factor(sg.series(s, d), 60).select("recording_id", "sample_idx"),
    f"WITH {SERIES}, b AS (SELECT recording_id, min(CASE WHEN CAST(floor(t) AS BIGINT) % 60 = 0 THEN sample_idx END) AS a FROM series GROUP BY recording_id) SELECT s.recording_id, s.sample_idx FROM series s JOIN b ON s.recording_id = b.recording_id WHERE b.a IS NULL OR s.sample_idx >= b.a",
)
_HOURS = "h AS (SELECT recording_id, sample_idx, floor(t / 86400) * 86400 AS t, x FROM series)"


def _by_day(s, d):
    return sg.series(s, d).withColumn("t", F.floor(F.col("t") / 86400) * 86400.0)


_add(
    "dedupe_timestamps",
    lambda s, d: _rounded(timeline.without_repeated_times(_by_day(s, d)).select("recording_id", "sample_idx", "t", "x")),
    f"WITH {SERIES}, {_HOURS}, k AS (SELECT recording_id, t, arg_min(x, sample_idx) AS x FROM h GROUP BY recording_id, t) SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY t) - 1 AS sample_idx, round(t, 6) AS t, round(x, 6) AS x FROM k",
)
_add(
    "block_timestamps",
    lambda s, d: _rounded(timeline.spread_blocks(_by_day(s, d), 86400.0).select("recording_id", "sample_idx", "t")),
    f"WITH {SERIES}, {_HOURS} SELECT recording_id, sample_idx, round(t + (row_number() OVER (PARTITION BY recording_id, t ORDER BY sample_idx) - 1) * 86400.0 / count(*) OVER (PARTITION BY recording_id, t), 6) AS t FROM h",
)
_add(
    "multi_concat",
    lambda s, d: _rounded(timeline.concatenated(sg.series(s, d).filter("sample_idx >= 10"), sg.series(s, d).filter("sample_idx < 5"))),
    f"WITH {SERIES} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY t) - 1 AS sample_idx, round(t, 6) AS t, round(x, 6) AS x FROM series WHERE sample_idx < 5 OR sample_idx >= 10",
)


def _interp_sql(name: str, where: str, column: str) -> str:
    return f"""{name}s AS (SELECT * FROM series WHERE {where}),
{name}g AS (SELECT recording_id, k, t0 + k * 43200.0 AS t FROM (SELECT recording_id, min(t) AS t0, unnest(generate_series(0, CAST(floor((max(t) - min(t)) / 43200.0 + 1e-9) AS BIGINT))) AS k FROM {name}s GROUP BY recording_id) u),
{name}p AS (SELECT *, lead(t) OVER (PARTITION BY recording_id ORDER BY sample_idx) AS t2, lead(x) OVER (PARTITION BY recording_id ORDER BY sample_idx) AS x2 FROM {name}s),
{name} AS (SELECT g.recording_id, g.k AS sample_idx, p.x + coalesce((g.t - p.t) / nullif(p.t2 - p.t, 0) * (p.x2 - p.x), 0) AS {column} FROM {name}g g JOIN {name}p p ON g.recording_id = p.recording_id AND p.t <= g.t AND (p.t2 > g.t OR p.t2 IS NULL))"""


_add(
    "multi_combine",
    lambda s, d: timeline.combined(sg.series(s, d).filter("sample_idx % 2 = 0"), sg.series(s, d).filter("sample_idx % 3 = 0").withColumnRenamed("x", "y"), 43200.0, ["x"], ["y"]).select("recording_id", "sample_idx", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")),
    f"WITH {SERIES}, {_interp_sql('one', 'sample_idx % 2 = 0', 'x')}, {_interp_sql('two', 'sample_idx % 3 = 0', 'y')} SELECT a.recording_id, a.sample_idx, round(a.x, 4) AS x, round(b.y, 4) AS y FROM one a JOIN two b ON a.recording_id = b.recording_id AND a.sample_idx = b.sample_idx",
)
_add(
    "day_windows",
    lambda s, d: timeline.day_windows(sg.series(s, d), 12, 24).select("recording_id", F.col("date").cast("string").alias("date"), "day_n", "start_idx", "stop_idx"),
    f"""WITH {SERIES}, e AS (SELECT recording_id, min(t) AS t0, max(t) AS t1 FROM series GROUP BY recording_id),
d AS (SELECT recording_id, t0, t1, unnest(generate_series(CAST(floor((t0 - 43200) / 86400) AS BIGINT), CAST(floor((t1 - 43200) / 86400) AS BIGINT))) AS day FROM e),
w AS (SELECT recording_id, day, greatest(day * 86400.0 + 43200, t0) AS lo, least((day + 1) * 86400.0 + 43200, t1) AS hi FROM d),
p AS (SELECT recording_id, day, 0 AS side, lo AS t FROM w WHERE hi > lo UNION ALL SELECT recording_id, day, 1, hi FROM w WHERE hi > lo),
n AS (SELECT p.recording_id, p.day, p.side, s.sample_idx, row_number() OVER (PARTITION BY p.recording_id, p.day, p.side ORDER BY abs(s.t - p.t), s.sample_idx) AS r FROM p JOIN series s ON s.recording_id = p.recording_id)
SELECT recording_id, CAST(CAST('1970-01-01' AS DATE) + CAST(day AS INTEGER) AS VARCHAR) AS date, row_number() OVER (PARTITION BY recording_id ORDER BY day) AS day_n, max(CASE WHEN side = 0 THEN sample_idx END) AS start_idx, max(CASE WHEN side = 1 THEN sample_idx END) AS stop_idx FROM n WHERE r = 1 GROUP BY recording_id, day""",
)

# -- wear and sleep ---------------------------------------------------------

_add(
    "wear_cta",
    lambda s, d: wear.temperature_wear(sg.triax(s, d), 6, 26.0, 0.3),
    f"""WITH {TRIAX}, e AS (SELECT recording_id, sample_idx // 6 AS epoch, avg(temperature) AS temp, stddev_samp(ax) AS sx, stddev_samp(ay) AS sy, stddev_samp(az) AS sz FROM triax GROUP BY recording_id, sample_idx // 6 HAVING count(*) = 6),
b AS (SELECT *, lag(temp) OVER (PARTITION BY recording_id ORDER BY epoch) AS prev FROM e),
k AS (SELECT recording_id, epoch, CASE WHEN temp >= 26.0 THEN 1 WHEN CAST(sx < 0.3 AS INTEGER) + CAST(sy < 0.3 AS INTEGER) + CAST(sz < 0.3 AS INTEGER) >= 2 THEN 0 WHEN temp > prev THEN 1 WHEN temp < prev THEN 0 END AS known FROM b),
c AS (SELECT *, count(known) OVER (PARTITION BY recording_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM k)
SELECT recording_id, epoch, max(known) OVER (PARTITION BY recording_id, c) AS wear FROM c""",
)
_STILL = ", ".join(f"CASE WHEN stddev_samp({a}) OVER w < 0.62 AND max({a}) OVER w - min({a}) OVER w < 1.9 THEN 1 ELSE 0 END AS q{a}" for a in ("ax", "ay", "az"))
_add(
    "wear_accel_threshold",
    lambda s, d: wear.still_blocks(sg.triax(s, d), 8, 2, 0.62, 1.9),
    f"""WITH {TRIAX}, m AS (SELECT recording_id, sample_idx, count(*) OVER w AS n, {_STILL} FROM triax WINDOW w AS (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
b AS (SELECT recording_id, sample_idx // 2 AS sample_idx, CASE WHEN n >= 8 THEN CASE WHEN qax + qay + qaz >= 2 THEN 1 ELSE 0 END END AS nw FROM m WHERE sample_idx % 2 = 0),
l AS (SELECT recording_id, max(CASE WHEN nw IS NOT NULL THEN sample_idx END) AS last FROM b GROUP BY recording_id)
SELECT b.recording_id, b.sample_idx, coalesce(b.nw, e.nw, 0) AS nonwear FROM b JOIN l ON b.recording_id = l.recording_id LEFT JOIN b e ON e.recording_id = b.recording_id AND e.sample_idx = l.last""",
)


def _blocks(s, d):
    return sg.series(s, d).select("recording_id", "sample_idx", F.when(F.pmod(F.floor(F.col("x") / 7), F.lit(3)) == 0, 1).otherwise(0).alias("nonwear"))


def _adjust_sql() -> str:
    steps, name = [f"{SERIES}, p0 AS (SELECT recording_id, sample_idx, CASE WHEN CAST(floor(x / 7) AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS nw FROM series)"], "p0"
    for k in range(1, 4):
        steps.append(f"""g{k} AS (SELECT *, sum(ch) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT *, CASE WHEN nw = lag(nw) OVER (PARTITION BY recording_id ORDER BY sample_idx) THEN 0 ELSE 1 END AS ch FROM {name}) u),
r{k} AS (SELECT recording_id, run, min(nw) AS nw, count(*) AS len FROM g{k} GROUP BY recording_id, run),
n{k} AS (SELECT *, coalesce(lag(len) OVER w, 0) + coalesce(lead(len) OVER w, 0) AS around FROM r{k} WINDOW w AS (PARTITION BY recording_id ORDER BY run)),
p{k} AS (SELECT g.recording_id, g.sample_idx, CASE WHEN n.nw = 0 AND n.around > 0 AND (n.len <= 24 AND n.len > 12 AND n.len * 1.0 / n.around < 0.3 OR n.len <= 12 AND n.len * 1.0 / n.around < 0.8) THEN 1 ELSE n.nw END AS nw FROM g{k} g JOIN n{k} n ON g.recording_id = n.recording_id AND g.run = n.run)""")
        name = f"p{k}"
    return f"""WITH {', '.join(steps)}, f AS (SELECT recording_id, sample_idx, sample_idx - row_number() OVER (PARTITION BY recording_id ORDER BY sample_idx) AS island FROM {name} WHERE nw = 0)
SELECT recording_id, min(sample_idx) AS start_idx, max(sample_idx) + 1 AS stop_idx FROM f GROUP BY recording_id, island"""


_add("wear_adjusted", lambda s, d: wear.adjusted_wear(_blocks(s, d), 4), _adjust_sql())
_add(
    "wear_counts",
    lambda s, d: wear.count_wear(sg.series(s, d).select("recording_id", "sample_idx", F.when(F.col("x") > 60, F.col("x")).otherwise(0.0).alias("counts")), 4, 1, 2),
    f"""WITH {SERIES}, z AS (SELECT recording_id, sample_idx, CASE WHEN x > 60 THEN 0 ELSE 1 END AS z FROM series),
g AS (SELECT *, sum(ch) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT *, CASE WHEN z = lag(z) OVER (PARTITION BY recording_id ORDER BY sample_idx) THEN 0 ELSE 1 END AS ch FROM z) u),
r AS (SELECT recording_id, run, min(z) AS z, count(*) AS len FROM g GROUP BY recording_id, run), n AS (SELECT *, lag(len) OVER w AS a, lead(len) OVER w AS b FROM r WINDOW w AS (PARTITION BY recording_id ORDER BY run)),
s AS (SELECT g.recording_id, g.sample_idx, CASE WHEN n.z = 0 AND n.len <= 1 AND n.a >= 2 AND n.b >= 2 THEN 1 ELSE n.z END AS z FROM g JOIN n ON g.recording_id = n.recording_id AND g.run = n.run),
g2 AS (SELECT *, sum(ch) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT *, CASE WHEN z = lag(z) OVER (PARTITION BY recording_id ORDER BY sample_idx) THEN 0 ELSE 1 END AS ch FROM s) u)
SELECT recording_id, CASE WHEN z = 1 AND count(*) OVER (PARTITION BY recording_id, run) > 4 THEN 0 ELSE 1 END AS worn, sample_idx FROM g2""",
)
_COLE = " + ".join([f"coalesce(lag(x, {k}) OVER w, 0) * {v}" if k else f"x * {v}" for k, v in enumerate(sleep._BEFORE)] + [f"coalesce(lead(x, {k + 1}) OVER w, 0) * {v}" for k, v in enumerate(sleep._AFTER)])
_add(
    "cole_kripke_scores",
    lambda s, d: _rounded(sleep.sleep_scores(sg.series(s, d).withColumn("x", F.col("x") / 1000), "x")),
    f"WITH {SERIES}, y AS (SELECT recording_id, sample_idx, x / 1000 AS x FROM series), z AS (SELECT recording_id, sample_idx, 0.243 * ({_COLE}) AS s FROM y WINDOW w AS (PARTITION BY recording_id ORDER BY sample_idx)) SELECT recording_id, sample_idx, round(s, 6) AS score, CASE WHEN s < 0.5 THEN 1 ELSE 0 END AS sleep FROM z",
)
_add(
    "tso_threshold",
    lambda s, d: _rounded(sleep.rest_threshold(sg.series(s, d), "x", 0.10, 0.05, 0.1, 0.5)),
    f"WITH {SERIES} SELECT recording_id, round(least(greatest(quantile_cont(x, 0.1) * 0.05, 0.1), 0.5), 6) AS threshold FROM series GROUP BY recording_id",
)


def _tso_angles(s, d):
    return sg.series(s, d).select("recording_id", "sample_idx", F.col("x").alias("angle"))


_add("tso", lambda s, d: sleep.sleep_opportunity(_tso_angles(s, d), 5, 2, 3, 2, percentile=0.4, factor=1.0, lowest=0.1, highest=1e9))
_add(
    "sleep_endpoints",
    lambda s, d: _rounded(sleep.night_endpoints(sg.states(s, d).withColumnRenamed("state", "sleep"))),
    f"""WITH {RUNS}, f AS (SELECT recording_id, state, length, count(*) OVER (PARTITION BY recording_id, state) AS n, sum(length) OVER (PARTITION BY recording_id, state ORDER BY length, start_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    min(length) OVER (PARTITION BY recording_id, state) AS least, count(*) OVER (PARTITION BY recording_id, state, length) AS same, sum(1) OVER (PARTITION BY recording_id, state ORDER BY length DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach FROM runs),
a AS (SELECT recording_id, state, max(n) AS n, sum(length) AS s, sum(cum) AS area, sum(ln(length / (least - 0.5))) AS logs, sum(1.0 / reach) / sum(1.0 / same) AS hazard FROM f GROUP BY recording_id, state),
e AS (SELECT recording_id, state, round(s * 1.0 / n, 6) AS d, round(n * 1.0 / s, 6) AS p, round(CASE WHEN n = 1 THEN 1.0 ELSE least((n + 1 - 2.0 * area / s) / (n - 1), 1.0) END, 6) AS g, round(hazard, 6) AS h, round(1 + n / logs, 6) AS l FROM a),
m AS (SELECT *, lag(state) OVER (PARTITION BY recording_id ORDER BY sample_idx) AS prev, min(CASE WHEN state = 1 THEN sample_idx END) OVER (PARTITION BY recording_id) AS first, max(CASE WHEN state = 1 THEN sample_idx END) OVER (PARTITION BY recording_id) AS last FROM states),
b AS (SELECT recording_id, sum(state) AS total_sleep_time, round(100.0 * sum(state) / count(*), 3) AS percent_time_asleep, greatest(sum(CASE WHEN prev = 1 AND state = 0 THEN 1 ELSE 0 END) - 1, 0) AS wake_bouts, min(first) AS sleep_onset_latency,
    min(last) - min(first) - sum(CASE WHEN state = 1 AND sample_idx < last THEN 1 ELSE 0 END) AS wake_after_sleep_onset FROM m GROUP BY recording_id)
SELECT b.*, s.d AS sleep_average_duration, s.p AS sleep_transition_probability, s.g AS sleep_gini_index, s.h AS sleep_average_hazard, s.l AS sleep_power_law, w.d AS wake_average_duration, w.p AS wake_transition_probability, w.g AS wake_gini_index, w.h AS wake_average_hazard, w.l AS wake_power_law
FROM b LEFT JOIN e s ON s.recording_id = b.recording_id AND s.state = 1 LEFT JOIN e w ON w.recording_id = b.recording_id AND w.state = 0""",
)
_add("sleep_rescored", lambda s, d: kernels.rescored_sleep(sleep.sleep_scores(sg.series(s, d).withColumn("x", F.col("x") / 1000), "x")))

# -- features of windows ----------------------------------------------------

_N = f"""WITH {WINDOWS}, w AS (SELECT vec_id, i, x, count(*) OVER p AS n, avg(x) OVER p AS m, stddev_samp(x) OVER p AS sd, lead(x) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3 FROM windows WINDOW p AS (PARTITION BY vec_id), o AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, round({{e}}, 6) AS {{c}} FROM w GROUP BY vec_id"""


def _feature_table() -> dict:
    """Column and SQL of each native feature; columns need a running session, so they are made when asked for."""
    f = features
    return {
        "mean": (f.mean, "avg(x)"),
        "mean_cross_rate": (f.mean_cross_rate, "sum(CASE WHEN sign(x - m) <> sign(x1 - m) THEN 1.0 ELSE 0 END) / count(*)"),
        "std_dev": (f.std_dev, "stddev_samp(x)"),
        "skewness": (f.skewness, "skewness(x)"),
        "kurtosis": (f.kurtosis, "kurtosis(x)"),
        "value_range": (f.value_range, "max(x) - min(x)"),
        "iqr": (f.iqr, "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)"),
        "rms": (f.rms, "stddev_samp(x)"),
        "autocorrelation": (f.autocorrelation, "corr(x, x3)"),
        "autocorrelation_raw": (f.autocorrelation_raw, "sum(x * x3) / (stddev_samp(CASE WHEN x3 IS NOT NULL THEN x END) * stddev_samp(x3))"),
        "linear_slope": (lambda: f.linear_slope(20.0), "regr_slope(x, i / 20.0)"),
        "complexity_invariant_distance": (f.complexity_invariant_distance, "sqrt(sum(pow(x1 - x, 2))) / stddev_samp(x)"),
        "range_count_percentage": (lambda: f.range_count_percentage(-0.05, 0.1), "avg(CASE WHEN x >= -0.05 AND x < 0.1 THEN 1.0 ELSE 0 END)"),
        "ratio_beyond_r_sigma": (lambda: f.ratio_beyond_sigma(1.5), "avg(CASE WHEN abs(x - m) > 1.5 * sd THEN 1.0 ELSE 0 END)"),
        "jerk_metric": (lambda: f.jerk_metric(20.0), "sum(pow(x1 - x, 2)) * 20.0 / (720.0 * pow(max(abs(x)), 2))"),
        "dimensionless_jerk_velocity": (lambda: f.dimensionless_jerk("velocity"), "-pow(count(*), 3) * sum(pow(x2 - 2 * x1 + x, 2)) / pow(max(abs(x)), 2)"),
        "dimensionless_jerk": (f.dimensionless_jerk, "-count(*) * sum(pow(x1 - x, 2)) / pow(max(abs(x)), 2)"),
        "dimensionless_jerk_jerk": (lambda: f.dimensionless_jerk("jerk"), "-sum(x * x) / (count(*) * pow(max(abs(x)), 2))"),
        "log_dimensionless_jerk": (lambda: f.dimensionless_jerk(log=True), "-ln(count(*) * sum(pow(x1 - x, 2)) / pow(max(abs(x)), 2))"),
    }


for _name, (_make, _expr) in _feature_table().items():
    _add(f"feature_{_name}", lambda s, d, m=_make, c=_name: _rounded(features.Bank(**{c: m()}).compute(sg.windows(s, d), ["vec_id"], lag=3)), _N.format(e=_expr, c=_name))
_add(
    "feature_bank",
    lambda s, d: _rounded(features.Bank(**{n: m() for n, (m, _) in _feature_table().items()}).compute(sg.windows(s, d), ["vec_id"], lag=3)),
    _N.format(e="avg(x)", c="mean").replace("round(avg(x), 6) AS mean", ", ".join(f"round({e}, 6) AS {n}" for n, (_, e) in _feature_table().items())),
)
_add(
    "feature_permutation_entropy",
    lambda s, d: _rounded(features.permutation_entropy(sg.windows(s, d), ["vec_id"], 3, 1, True)),
    f"""WITH {WINDOWS}, l AS (SELECT vec_id, x AS a, lead(x) OVER o AS b, lead(x, 2) OVER o AS c FROM windows WINDOW o AS (PARTITION BY vec_id ORDER BY i)),
p AS (SELECT vec_id, CASE WHEN a <= b THEN 1 ELSE 0 END * 4 + CASE WHEN b <= c THEN 1 ELSE 0 END * 2 + CASE WHEN a <= c THEN 1 ELSE 0 END AS pattern, count(*) AS c FROM l WHERE c IS NOT NULL GROUP BY 1, 2),
q AS (SELECT vec_id, c * 1.0 / sum(c) OVER (PARTITION BY vec_id) AS p FROM p) SELECT vec_id, round(-sum(p * log2(p)) / log2(6), 6) AS permutation_entropy FROM q GROUP BY vec_id""",
)
_add(
    "feature_signal_entropy",
    lambda s, d: _rounded(features.signal_entropy(sg.windows(s, d), ["vec_id"])),
    f"""WITH {WINDOWS}, s AS (SELECT vec_id, x, count(*) OVER p AS n, min(x) OVER p AS lo, max(x) OVER p AS hi, stddev_samp(x) OVER p AS sd FROM windows WINDOW p AS (PARTITION BY vec_id)),
b AS (SELECT *, ceil(sqrt(n)) AS k FROM s), h AS (SELECT vec_id, least(floor((x - lo) / ((hi - lo) / k)), k - 1) AS bin, count(*) AS c, max(n) AS n, max(k) AS k, max(hi - lo) AS r, max(sd) AS sd FROM b GROUP BY 1, 2),
e AS (SELECT vec_id, -sum(c * ln(c)) / max(n) + ln(max(n)) + ln((max(r) + max(r) / (max(n) - 1)) / max(sd) / max(k)) + (max(k) - 1) / (2.0 * max(n)) AS e FROM h GROUP BY vec_id) SELECT vec_id, round(exp(e * e) - 2, 6) AS signal_entropy FROM e""",
)


def _spectrum_sql(body: str) -> str:
    """Power by a plain transform of 64 samples padded to 256; bins 1 to 64 are 0 to 5 Hz at 20 Hz."""
    return f"""WITH {WINDOWS}, k AS (SELECT * FROM generate_series(0, 63) t(k)), f AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * i / 256)) AS re, sum(x * sin(2 * pi() * k * i / 256)) AS im FROM windows, k GROUP BY vec_id, k),
p AS (SELECT vec_id, k, (re * re + im * im) / sum(re * re + im * im) OVER (PARTITION BY vec_id) + 1e-10 AS p FROM f) {body}"""


_add(
    "feature_dominant_frequency",
    lambda s, d: _rounded(kernels.spectral_features(sg.windows(s, d), "vec_id", 20.0, ["dominant_frequency", "dominant_frequency_value"])),
    _spectrum_sql("SELECT vec_id, round(arg_max(k, p) * 20.0 / 256, 6) AS dominant_frequency, round(max(p), 6) AS dominant_frequency_value FROM p GROUP BY vec_id"),
)
_add(
    "feature_spectral_entropy",
    lambda s, d: _rounded(kernels.spectral_features(sg.windows(s, d), "vec_id", 20.0, ["spectral_entropy"])),
    _spectrum_sql("SELECT vec_id, round(-sum(p * log2(p)) / log2(64), 6) AS spectral_entropy FROM p GROUP BY vec_id"),
)
_add("feature_spectral", lambda s, d: _rounded(kernels.spectral_features(sg.windows(s, d), "vec_id", 20.0, ["power_spectral_sum", "range_power_sum", "spectral_flatness", "sparc"])))
_add(
    "feature_sample_entropy",
    lambda s, d: _rounded(kernels.sample_entropy(sg.windows(s, d), "vec_id", 2, 0.15)),
)
_add("feature_detail_power", lambda s, d: _rounded(kernels.detail_power(sg.windows(s, d), "vec_id", 20.0)))

# -- gait and transfers -----------------------------------------------------

_TEMPORAL = f"""WITH {STRIDES}, n AS (SELECT *, CASE WHEN forward_cycles >= 1 THEN lead(ic) OVER w END AS ic1, CASE WHEN forward_cycles >= 2 THEN lead(ic, 2) OVER w END AS ic2, CASE WHEN forward_cycles >= 1 THEN lead(fc_opp) OVER w END AS opp1 FROM strides WINDOW w AS (PARTITION BY recording_id, day_n, bout_n ORDER BY ic)),
t AS (SELECT *, (ic2 - ic) / 50.0 AS stride_time, (fc - ic) / 50.0 AS stance_time, (ic2 - fc) / 50.0 AS swing_time, (ic1 - ic) / 50.0 AS step_time, (fc_opp - ic) / 50.0 AS ids, (opp1 - ic1) / 50.0 AS tds, (ic1 - fc_opp) / 50.0 AS ss FROM n)"""
for _name, _expr in (
    ("stride_time", "stride_time"), ("stance_time", "stance_time"), ("swing_time", "swing_time"), ("step_time", "step_time"), ("initial_double_support", "ids"), ("terminal_double_support", "tds"),
    ("double_support", "ids + tds"), ("single_support", "ss"), ("cadence", "60.0 / step_time"),
):
    _add(_name, lambda s, d, c=_name: _rounded(gait.temporal(sg.strides(s, d), 50.0).select("recording_id", "stride_idx", c)), f"{_TEMPORAL} SELECT recording_id, stride_idx, round({_expr}, 6) AS {_name} FROM t")
_SPATIAL = _TEMPORAL + """, m AS (SELECT recording_id, bout_n, quantile_cont(ids, 0.5) / quantile_cont(ss, 0.5) * 0.9 * 1.1 AS foot FROM t GROUP BY recording_id, bout_n),
l AS (SELECT t.*, 2 * sqrt(2 * 0.9 * h1 - h1 * h1) AS step_length_1, 2 * sqrt(2 * 0.9 * h2 - h2 * h2) + 2 * sqrt(2 * foot * h2b - h2b * h2b) AS step_length FROM t JOIN m ON t.recording_id = m.recording_id AND t.bout_n = m.bout_n),
s AS (SELECT *, step_length_1 + CASE WHEN forward_cycles >= 1 THEN lead(step_length_1) OVER w END AS stride_length_1, step_length + CASE WHEN forward_cycles >= 1 THEN lead(step_length) OVER w END AS stride_length FROM l WINDOW w AS (PARTITION BY recording_id, day_n, bout_n ORDER BY ic))"""
for _name in ("step_length_1", "step_length", "stride_length_1", "stride_length", "gait_speed_1", "gait_speed"):
    _expr = _name.replace("gait_speed", "stride_length") + " / stride_time" if "speed" in _name else _name
    _add(_name, lambda s, d, c=_name: _rounded(gait.spatial(gait.temporal(sg.strides(s, d), 50.0), 0.9).select("recording_id", "stride_idx", c)), f"{_SPATIAL} SELECT recording_id, stride_idx, round({_expr}, 6) AS {_name} FROM s")
_add(
    "gait_asymmetry",
    lambda s, d: _rounded(gait.asymmetries(gait.temporal(sg.strides(s, d), 50.0), ("step_time", "stance_time")).select("recording_id", "stride_idx", "step_time_asymmetry", "stance_time_asymmetry")),
    f"{_TEMPORAL} SELECT recording_id, stride_idx, round(CASE WHEN forward_cycles >= 1 THEN lead(step_time) OVER w END - step_time, 6) AS step_time_asymmetry, round(CASE WHEN forward_cycles >= 1 THEN lead(stance_time) OVER w END - stance_time, 6) AS stance_time_asymmetry FROM t WINDOW w AS (PARTITION BY recording_id, day_n, bout_n ORDER BY ic)",
)
_add(
    "phase_coordination_index",
    lambda s, d: _rounded(gait.phase_coordination(gait.temporal(sg.strides(s, d), 50.0))),
    f"{_TEMPORAL} SELECT recording_id, day_n, bout_n, round(100 * (stddev_samp(step_time / stride_time) / avg(step_time / stride_time) + avg(abs(step_time / stride_time - 0.5)) / 0.5), 6) AS phase_coordination_index FROM t WHERE stride_time IS NOT NULL GROUP BY recording_id, day_n, bout_n",
)
_add(
    "regularity_index",
    lambda s, d: _rounded(gait.symmetry(sg.strides(s, d)).select("recording_id", "stride_idx", "autocovariance_symmetry", "regularity_index")),
    f"WITH {STRIDES} SELECT recording_id, stride_idx, round(abs(stride_regularity - step_regularity), 6) AS autocovariance_symmetry, round(1 - 2 * abs(stride_regularity - step_regularity) / (stride_regularity + step_regularity), 6) AS regularity_index FROM strides",
)
_add(
    "gait_bout_summary",
    lambda s, d: _rounded(gait.bout_summary(gait.temporal(sg.strides(s, d), 50.0), ["stride_time", "cadence"])),
    f"{_TEMPORAL} SELECT recording_id, day_n, bout_n, count(*) AS strides, round(avg(stride_time), 6) AS stride_time_mean, round(avg(60.0 / step_time), 6) AS cadence_mean, round(stddev_samp(stride_time), 6) AS stride_time_sd, round(stddev_samp(60.0 / step_time), 6) AS cadence_sd FROM t GROUP BY recording_id, day_n, bout_n",
)

# -- filters and detectors --------------------------------------------------


def _axis(s, d):
    return sg.triax(s, d).select("recording_id", "sample_idx", F.col("ax").alias("x"))


_add("zero_phase_filter", lambda s, d: kernels.filtered(_axis(s, d), "recording_id", 50.0, 4, 5.0, "low").select("recording_id", "sample_idx", F.round("y", 6).alias("y")))
_add("activity_counts", lambda s, d: kernels.activity_counts(sg.triax(s, d), 30.0, 1).select("recording_id", "epoch", "counts_x", "counts_y", "counts_z"))
_add("activity_index", lambda s, d: _rounded(kernels.activity_index(sg.triax(s, d), 1.0, 10)))
for _m in ("bfen", "hfen", "hfenplus"):
    _add(f"{_m}_epochs", lambda s, d, m=_m: _rounded(kernels.filtered_metric(sg.triax(s, d), 50.0, 25, m)))
_add("peaks", lambda s, d: kernels.peaks(sg.series(s, d), "x", height=60.0, distance=3))
_add("motion_cov", lambda s, d: kernels.motion(sg.triax(s, d), 20.0, 0.6))


# -- detectors --------------------------------------------------------------


def _arm_levels(s, d):
    t = sg.triax(s, d).select("recording_id", "sample_idx", axes.magnitude().alias("m"), axes.arm_angle().alias("a"))
    e = windows.epochs(t, 32, F.stddev_samp("m").alias("sd"), F.avg("a").alias("angle"))
    w = t.select(F.concat_ws(":", "recording_id", F.floor(F.col("sample_idx") / 32)).alias("w"), (F.col("sample_idx") % 32).alias("i"), F.col("m").alias("x"))
    share = kernels.per_window(w, "w", lambda x: {"share": kernels.dsp.range_power_sum(x, 10.0, 0, 0.6, 2.5, normalize=True)}, "share double", 32)
    e = e.withColumn("w", F.concat_ws(":", "recording_id", "epoch")).join(share, "w").drop("w")
    return _rounded(activity.arm_movement_levels(e))


_add("arm_movement_levels", _arm_levels)
_STILL_LIMITS = {"window": 0.1, "gravity": 1.0, "mean": 0.5, "sd": 0.6, "jerk_mean": 40.0, "jerk_sd": 40.0, "long": 0.1}
_add("stillness", lambda s, d: detectors.stillness(sg.triax(s, d).select("recording_id", "sample_idx", axes.magnitude().alias("x")), 0.02, **_STILL_LIMITS))
_add("nonwear_by_slope", lambda s, d: detectors.nonwear_by_slope(sg.triax(s, d), 0.25, 4, 0.9, 1, 25.0, 28.0, -0.01, 0.01))
_add("sit_to_stand", lambda s, d: _rounded(detectors.transfers(sg.triax(s, d), 20.0, (0.6, 0.6), 0.0, 0.0)))
_add(
    "gait_strides",
    lambda s, d: _rounded(detectors.gait_bouts(sg.triax(s, d).select("recording_id", F.lit(1).alias("day_n"), F.floor(F.col("sample_idx") / 300).cast("long").alias("bout_n"), "sample_idx", F.col("az").alias("v"), F.col("ax").alias("ap")), 20.0, 1.8)),
)
_add("calibration", lambda s, d: kernels.calibration(sg.triax(s, d), 4, 0.6).select("recording_id", "calibrated"))


def _walks(s, d):
    return sg.triax(s, d).select("recording_id", F.lit(1).alias("day_n"), F.floor(F.col("sample_idx") / 300).cast("long").alias("bout_n"), (F.col("sample_idx") % 300).alias("sample_idx"), F.col("az").alias("v"), F.col("ax").alias("ap"), F.col("ay").alias("ml"))


_add("gait_signal_endpoints", lambda s, d: _rounded(gait_kernels.signal_endpoints(_walks(s, d), detectors.gait_bouts(_walks(s, d), 20.0, 1.8), 20.0)))


def _timed(s, d, fs):
    return sg.triax(s, d).withColumn("t", F.col("sample_idx") / fs)


def _raw_walks(s, d):
    return sg.triax(s, d).select("recording_id", F.lit(1).alias("day_n"), F.floor(F.col("sample_idx") / 300).cast("long").alias("bout_n"), (F.col("sample_idx") % 300).alias("sample_idx"), "ax", "ay", "az")


_add("resample_low_passed", lambda s, d: _rounded(timeline.resampled(_timed(s, d, 100.0), ["ax", "ay", "az"], 100.0, 50.0)))
_add("resample_low_passed_interp", lambda s, d: _rounded(timeline.resampled(_timed(s, d, 50.0), ["ax", "ay", "az"], 50.0, 20.0)))
_add("motion_deviation", lambda s, d: kernels.motion_by_deviation(sg.triax(s, d), 20.0, variation=0.9, deviation=1.2))
_add("gait_prepared_bouts", lambda s, d: _rounded(walking.prepared_bouts(_raw_walks(s, d), 20.0, cutoff=8.0)))
_add("gait_vertical_strides", lambda s, d: _rounded(walking.walking_strides(walking.prepared_bouts(_raw_walks(s, d), 20.0, cutoff=8.0), 20.0, "vertical")))
_add("gait_legacy_strides", lambda s, d: _rounded(walking.legacy_strides(_raw_walks(s, d), 20.0, cutoff=8.0)))
_add("walking_features", lambda s, d: _rounded(classifiers.walking_features(sg.triax(s, d), 20.0)))
_add("ambulation_features", lambda s, d: _rounded(classifiers.ambulation_features(sg.triax(s, d))))


# -- days -------------------------------------------------------------------


def _days(s, d, length):
    """Days of so many samples."""
    n = sg.triax(s, d).groupBy("recording_id").agg((F.max("sample_idx") + 1).alias("n"))
    each = n.select("recording_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / length))).alias("k"))
    return each.select("recording_id", (F.col("k") + 1).cast("int").alias("day_n"), (F.col("k") * length).alias("start_idx"), F.least("n", (F.col("k") + 1) * length).alias("stop_idx"))


def _spans(s, d, condition):
    state = sg.triax(s, d).select("recording_id", "sample_idx", F.when(condition, 1).otherwise(0).alias("state"))
    return intervals.runs(state, "state").filter("state = 1").select("recording_id", "start_idx", "stop_idx")


_PARTS = f"""WITH {TRIAX}, f AS (SELECT recording_id, sample_idx, sample_idx // 200 AS d, CASE WHEN temperature > 21 AND NOT ax > 0.9 THEN 1 ELSE 0 END AS ok FROM triax),
g AS (SELECT *, sample_idx - row_number() OVER (PARTITION BY recording_id, d ORDER BY sample_idx) AS island FROM f WHERE ok = 1)
SELECT recording_id, CAST(d + 1 AS INTEGER) AS day_n, min(sample_idx) AS start_idx, max(sample_idx) + 1 AS stop_idx FROM g GROUP BY recording_id, d, island"""
_add("day_wear_not_sleep", lambda s, d: days.segments(_days(s, d, 200), [_spans(s, d, F.col("temperature") > 21)], [_spans(s, d, F.col("ax") > 0.9)]), _PARTS)
_add(
    "daily_activity",
    lambda s, d: _rounded(days.daily_activity(sg.triax(s, d), _days(s, d, 200), 1.0, cutpoints="migueles_wrist_adult", least_wear=0.0).select("recording_id", "day_n", *[f"{v}_minutes" for v in ("sed", "light", "mod", "vig", "mvpa")])),
    f"""WITH {TRIAX}, n AS (SELECT *, sample_idx // 200 AS d, sample_idx % 200 AS i, count(*) OVER (PARTITION BY recording_id, sample_idx // 200) AS n FROM triax),
e AS (SELECT recording_id, d, i // 5 AS epoch, avg(greatest({_MAG} - 1, 0)) AS metric FROM n WHERE n > 60 GROUP BY recording_id, d, i // 5 HAVING count(*) = 5),
c AS (SELECT recording_id, d, {', '.join(f"sum(CASE WHEN metric >= {level_range(v, 'migueles_wrist_adult')[0]} AND metric < {level_range(v, 'migueles_wrist_adult')[1]} THEN 1 ELSE 0 END) / 12.0 AS {v}" for v in ('sed', 'light', 'mod', 'vig', 'mvpa'))} FROM e GROUP BY recording_id, d),
k AS (SELECT DISTINCT recording_id, d FROM n)
SELECT k.recording_id, CAST(k.d + 1 AS INTEGER) AS day_n, {', '.join(f'round({v}, 6) AS {v}_minutes' for v in ('sed', 'light', 'mod', 'vig', 'mvpa'))} FROM k LEFT JOIN c ON k.recording_id = c.recording_id AND k.d = c.d""",
)
_add("daily_sleep", lambda s, d: _rounded(days.daily_sleep(sg.triax(s, d), _days(s, d, 400), 0.2, least_hours=0.0, smooth=4, rest=3, pause=2, half=2, percentile=0.5, factor=1.0, lowest=0.0, highest=90.0)))
_add("daily_gait", lambda s, d: _rounded(days.daily_gait(sg.triax(s, d), _days(s, d, 600), 20.0, 0.9, events="vertical")))
