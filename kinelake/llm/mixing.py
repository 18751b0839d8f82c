"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic).  Fitting scales the cells
until the shares of sources, languages and topics are the wanted ones; a cell's
weight is its fitted over its present tokens.  Documents are then sampled with
probability min(1, weight x scale), where scale is calibrated so that the
expected tokens are the budget; a document's draw is a hash of its identifier.

By default the wanted shares temper the present ones (power TEMPER), which lifts
small sources and lowers a dominant one; shares can be given instead.

Cells are few beside documents.  Up to CELLS_ON_DRIVER they are fitted with
numpy and joined back as a table of that bounded size; beyond, each sweep is a
DataFrame step cut by a checkpoint, and the join back is salted so that one cell
with a third of all rows spreads.

Defined results: nulls in source or language are values of their own; null text
has no tokens, a text without tokens weighs what its cell does.  A cell without
tokens has weight 1.  Null identifiers draw as the string 'null'.  Rows that are
repeated draw alike.  An empty table gives an empty result.  Extra columns pass.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.llm.common import checkpointed, table

#: Power of the present shares, fitting sweeps, share of all tokens to expect.
TEMPER, SWEEPS, BUDGET = 0.5, 25, 0.6
CELLS_ON_DRIVER, SALT = 200_000, 64
#: Topics by words that a text holds; the first that matches, else "general".
TOPICS = {"legal": ["icense", "opyright"], "contact": ["@", "http"], "tabular": ["|"]}
DIMS = ("source", "lang", "topic")


def topic_of(text: Column, topics: dict[str, list[str]] = TOPICS) -> Column:
    out = F.lit("general")
    for name, marks in reversed(topics.items()):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(text, F.lit(m))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Spaces plus one; 0 for empty texts."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.length(text) - F.length(F.translate(text, " ", "")) + 1).cast("long")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the identifier."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def fit(cells: pd.DataFrame, shares: dict[str, dict], temper: float, sweeps: int) -> np.ndarray:
    """Fitted tokens of each cell; cells has the dims and tokens."""
    now = cells["tokens"].to_numpy(float)
    whole = now.sum()
    fitted, plans = now.copy(), []
    for d in DIMS:
        codes, values = pd.factorize(cells[d], use_na_sentinel=False)
        have = np.bincount(codes, now, len(values))
        want = np.array([shares[d].get(v, 0.0) for v in values]) if d in shares else have**temper
        want = np.where(have > 0, want, 0.0)
        plans.append((codes, want / want.sum() * whole if want.sum() else want))
    for _ in range(sweeps):
        for codes, want in plans:
            have = np.bincount(codes, fitted, len(want))
            fitted *= np.divide(want, have, out=np.zeros_like(want), where=have > 0)[codes]
    return fitted


def scale_to(weights: np.ndarray, tokens: np.ndarray, budget: float) -> float:
    """The scale for which expected tokens, sum of tokens x min(1, weight x scale), are the budget."""
    lo, hi = 0.0, 1.0
    expected = lambda s: float((tokens * np.minimum(1.0, weights * s)).sum())
    if not tokens.sum():
        return 1.0
    while expected(hi) < budget and hi < 1e12:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if expected(mid) < budget else (lo, mid)
    return (lo + hi) / 2


def _fit_large(cells: DataFrame, shares: dict[str, dict], temper: float, sweeps: int, budget: float) -> DataFrame:
    """As fit() and scale_to(), for more cells than the driver should hold."""
    spark = cells.sparkSession
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    out = cells.withColumn("fitted", F.col("tokens").cast("double"))
    for d in DIMS:
        have = F.sum("tokens").over(Window.partitionBy(d))
        if d in shares:
            want = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in shares[d].items() for x in kv]), F.col(d)), F.lit(0.0)) if shares[d] else F.lit(0.0)
        else:
            want = F.pow(have, F.lit(temper))
        out = out.withColumn(f"want_{d}", F.when(have > 0, want).otherwise(0.0))
        each = out.groupBy(d).agg(F.first(f"want_{d}").alias("w")).agg(F.sum("w")).first()[0] or 1.0
        out = out.withColumn(f"want_{d}", F.col(f"want_{d}") / F.lit(each) * F.lit(float(whole)))
    out = checkpointed(out)
    for _ in range(sweeps):
        for d in DIMS:
            have = F.sum("fitted").over(Window.partitionBy(d))
            out = out.withColumn("fitted", F.when(have > 0, F.col("fitted") * F.col(f"want_{d}") / have).otherwise(0.0))
        out = checkpointed(out)
    out = out.withColumn("weight", F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(1.0))
    lo, hi = 0.0, 1.0
    expected = lambda s: out.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * F.lit(s)))).first()[0] or 0.0
    while whole and expected(hi) < budget * whole and hi < 1e12:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if expected(mid) < budget * whole else (lo, mid)
    scale = (lo + hi) / 2 if whole else 1.0
    return out.select(*DIMS, "weight", F.least(F.lit(1.0), F.col("weight") * F.lit(scale)).alias("probability"))


def mix(docs: DataFrame, shares: dict[str, dict] | None = None, temper: float = TEMPER, budget: float = BUDGET, sweeps: int = SWEEPS, cells_on_driver: int = CELLS_ON_DRIVER) -> DataFrame:
    """docs with topic, n_tokens, weight, probability and sampled.

    shares: wanted shares of values by dimension (source, lang, topic); the
    tempered present shares where absent.  budget: share of tokens to expect.
    """
    spark, shares = docs.sparkSession, shares or {}
    text = F.coalesce("text", F.lit(""))
    rows = docs.drop("topic", "n_tokens", "weight", "probability", "sampled").withColumns({"topic": topic_of(text), "n_tokens": token_count(text)})
    cells = rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"))
    few = cells.limit(cells_on_driver + 1).toPandas()
    if len(few) <= cells_on_driver:
        few = few.sort_values(list(DIMS), na_position="first", ignore_index=True)
        fitted, tokens = fit(few, shares, temper, sweeps), few["tokens"].to_numpy(float)
        weight = np.divide(fitted, tokens, out=np.ones_like(fitted), where=tokens > 0)
        scale = scale_to(weight, tokens, budget * tokens.sum())
        kinds = ", ".join(f"{d} string" for d in DIMS)
        listed = [(*[None if pd.isna(v) else v for v in key], float(w), float(min(1.0, w * scale))) for *key, w in zip(*[few[d] for d in DIMS], weight, strict=True)]
        weights, salt = F.broadcast(spark.createDataFrame(listed, f"{kinds}, weight double, probability double")), None
    else:
        salt = "_salt"
        weights = _fit_large(cells, shares, temper, sweeps, budget).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    on = None
    for d in (*DIMS, *([salt] if salt else [])):
        same = rows[d].eqNullSafe(weights[d])
        on = same if on is None else on & same
    out = rows.join(weights, on).select(*[rows[c] for c in rows.columns if c != salt], weights["weight"], weights["probability"])
    return out.withColumn("sampled", draw(F.col("doc_id")) < F.col("probability"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def oracle_sql(temper: float = TEMPER, budget: float = BUDGET, sweeps: int = SWEEPS, halvings: int = 60) -> str:
    """The same rows in SQL: fitting and calibration unrolled over the small table of cells."""
    tests = " ".join(f"WHEN {' OR '.join(f"contains(t, '{m}')" for m in marks)} THEN '{name}'" for name, marks in TOPICS.items())
    steps = [
        f"""d AS (SELECT doc_id, source, lang, CASE {tests} ELSE 'general' END AS topic,
            CASE WHEN length(t) = 0 THEN 0 ELSE length(t) - length(replace(t, ' ', '')) + 1 END AS n_tokens
            FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents) x)""",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY source, lang, topic)",
    ]
    for k in DIMS:
        steps.append(f"w_{k} AS (SELECT {k}, pow(sum(tokens), {temper}) AS w FROM c GROUP BY {k} HAVING sum(tokens) > 0)")
        steps.append(f"t_{k} AS (SELECT {k}, w / (SELECT sum(w) FROM w_{k}) * (SELECT sum(tokens) FROM c) AS want FROM w_{k})")
    steps.append("f0 AS (SELECT source, lang, topic, tokens, tokens AS fitted FROM c)")
    n = 0
    for _ in range(sweeps):
        for k in DIMS:
            steps.append(
                f"""f{n + 1} AS MATERIALIZED (SELECT f.source, f.lang, f.topic, f.tokens, CASE WHEN h.have > 0 THEN f.fitted * coalesce(t.want, 0) / h.have ELSE 0 END AS fitted
                FROM f{n} f JOIN (SELECT {k}, sum(fitted) AS have FROM f{n} GROUP BY {k}) h ON f.{k} IS NOT DISTINCT FROM h.{k}
                LEFT JOIN t_{k} t ON f.{k} IS NOT DISTINCT FROM t.{k})"""
            )
            n += 1
    steps.append(f"w AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN fitted / tokens ELSE 1.0 END AS weight FROM f{n})")
    # the scale lies where the capped cells (largest weights first) use up the budget
    steps.append(
        f"""r AS (SELECT weight, sum(tokens) OVER (ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS capped,
            sum(tokens * weight) OVER (ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used,
            (SELECT sum(tokens) FROM w) AS whole, (SELECT sum(tokens * weight) FROM w) AS total FROM w)"""
    )
    steps.append(
        f"""s AS (SELECT coalesce(min(x), 1.0) AS scale FROM (
            SELECT {budget} * whole / total AS x, 1 / max(weight) AS top FROM r GROUP BY whole, total HAVING {budget} * whole / total <= 1 / max(weight)
            UNION ALL
            SELECT ({budget} * whole - capped) / (total - used) AS x, 0 FROM r
            WHERE total - used > 0 AND ({budget} * whole - capped) / (total - used) >= 1 / weight
              AND ({budget} * whole - capped) / (total - used) <= 1 / (SELECT max(weight) FROM r q WHERE q.capped > r.capped)) y)"""
    )
    return f"""WITH {', '.join(steps)}
SELECT d.doc_id, d.source, d.lang, d.topic, CAST(d.n_tokens AS BIGINT) AS n_tokens, round(w.weight, 6) AS weight,
    round(least(1.0, w.weight * s.scale), 6) AS probability,
    CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0 < least(1.0, w.weight * s.scale) AS sampled
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source AND d.lang IS NOT DISTINCT FROM w.lang AND d.topic = w.topic, s"""
