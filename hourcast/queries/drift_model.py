"""Drift tests, samples and a trained model."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window, functions as F

from hourcast.functions.calendar import CALENDAR, calendar_features
from hourcast.operators import drift
from hourcast.operators.chunks import attach
from hourcast.operators.sampling import sample_n
from hourcast.operators.training import (
    RegressorConfig,
    make_pipeline,
    score_to_predictions,
    time_folds,
    time_split,
    timed_fit,
)
from hourcast.operators.windows import lags
from hourcast.plans.features import build_features
from hourcast.queries.compare import rounded
from hourcast.queries.features import DAILY, daily_features
from hourcast.queries.frames import CHUNK, D, KEYS, SPLIT_DATE, cents, daily, table
from hourcast.queries.registry import query
from hourcast.queries.scalars import FLAG_SQL, FLAGS, flagged

GROUP = "data_group"
G = D + """, g AS (SELECT *, CASE WHEN ts < TIMESTAMP '2000-01-01' THEN 'old' ELSE 'new' END AS data_group FROM d)"""


def grouped(days):
    old = F.col("ts") < F.lit(SPLIT_DATE).cast("timestamp_ntz")
    return days.withColumn(GROUP, F.when(old, drift.OLD).otherwise(drift.NEW))


@query(
    "crosstab",
    f"""WITH {G} SELECT series, count(*) FILTER (data_group = 'new') AS "new",
      count(*) FILTER (data_group = 'old') AS "old" FROM g GROUP BY 1""",
)
def crosstab(spark, sf_dir):
    return drift.crosstab(grouped(daily(spark, sf_dir)), "series", GROUP)


CATEGORIES = [*FLAGS.values(), "QUARTER", "DAY_OF_WEEK"]
_CATEGORY_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c.lower()} AS DOUBLE) AS value, data_group FROM e" for c in CATEGORIES
)


# Limits of the chi-square distribution at 0.05 / 7, by degrees of freedom.
_CHI2_LIMITS = {1: 7.237, 3: 12.080, 6: 17.660}


def _chi2_limit_sql() -> str:
    return "CASE dof " + " ".join(f"WHEN {k} THEN {v}" for k, v in _CHI2_LIMITS.items()) + " END"


@query(
    "chi2_drift",
    f"""WITH {G}, e AS (SELECT data_group, quarter(ts) AS quarter, isodow(ts) - 1 AS day_of_week, {FLAG_SQL} FROM g),
      l AS ({_CATEGORY_SQL}),
      c AS (SELECT feature, value, count(*) FILTER (data_group = 'old') AS o, count(*) FILTER (data_group = 'new') AS n
        FROM l GROUP BY 1, 2),
      s AS (SELECT *, sum(o) OVER f AS so, sum(n) OVER f AS sn, count(*) OVER f AS k FROM c
        WINDOW f AS (PARTITION BY feature)),
      x AS (SELECT feature, k, o::DOUBLE AS ob, ((o + n) * so)::DOUBLE / (so + sn) AS ex FROM s
        UNION ALL SELECT feature, k, n, ((o + n) * sn)::DOUBLE / (so + sn) FROM s),
      t AS (SELECT feature, sum((abs(ob - ex) - CASE WHEN k = 2 THEN least(0.5, abs(ob - ex)) ELSE 0 END) ** 2 / ex) AS statistic,
        max(k) - 1 AS dof FROM x GROUP BY 1)
    SELECT feature, round(statistic, 6) AS statistic, dof, {_chi2_limit_sql()} < statistic AS drifted FROM t""",
)
def chi2(spark, sf_dir):
    """Text and number categories; drift is decided by the p-value here and by the critical value in SQL."""
    days = calendar_features(flagged(spark, sf_dir), "ts")
    tested = drift.chi2_drift(grouped(days), CATEGORIES, GROUP)
    return rounded(tested.select("feature", "statistic", "dof", "drifted"))


@query(
    "chi2_p_value",
    f"""WITH {G}, c AS (SELECT series, count(*) FILTER (data_group = 'old') AS o, count(*) FILTER (data_group = 'new') AS n
        FROM g WHERE series IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1),
      s AS (SELECT *, sum(o) OVER () AS so, sum(n) OVER () AS sn FROM c),
      t AS (SELECT sum((o - (o + n) * so / (so + sn)) ** 2 / ((o + n) * so / (so + sn))
        + (n - (o + n) * sn / (so + sn)) ** 2 / ((o + n) * sn / (so + sn))) AS x
        FROM (SELECT o::DOUBLE AS o, n::DOUBLE AS n, so::DOUBLE AS so, sn::DOUBLE AS sn FROM s))
    SELECT 'series' AS feature, 2 AS dof, round(x, 6) AS statistic, round(exp(-x / 2), 6) AS p_value, exp(-x / 2) < 0.05 AS drifted FROM t""",
)
def chi2_p_value(spark, sf_dir):
    """A text category of three values: with two degrees of freedom the tail is exp(-x / 2)."""
    days = grouped(daily(spark, sf_dir)).filter(F.col("series").isin("1-URGENT", "2-HIGH", "5-LOW"))
    out = rounded(drift.chi2_drift(days, ["series"], GROUP))
    return out.withColumn("dof", F.col("dof").cast("int"))


KS_FEATURES = ["v", "lag_1", "lag_7"]


def _ks_sql(rows: str, drifted: str) -> str:
    """The distance test over rows (feature, value, data_group)."""
    return f"""l AS ({rows}),
      c AS (SELECT feature, value, count(*) FILTER (data_group = 'old') AS o, count(*) FILTER (data_group = 'new') AS n
        FROM l WHERE value IS NOT NULL GROUP BY 1, 2),
      r AS (SELECT feature, sum(o) OVER w AS co, sum(n) OVER w AS cn, sum(o) OVER f AS no, sum(n) OVER f AS nn FROM c
        WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature)),
      k AS (SELECT feature, max(abs(co::DOUBLE / no - cn::DOUBLE / nn)) AS d, CAST(max(no) AS BIGINT) AS no,
        CAST(max(nn) AS BIGINT) AS nn FROM r GROUP BY 1),
      z AS (SELECT *, d * d * no * nn / (no + nn) AS scale FROM k),
      p AS (SELECT *, CASE WHEN scale < 0.04 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE,
        2 * list_sum(list_transform(generate_series(1, 100),
          lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * j * j * scale))))) END AS q FROM z)
    SELECT feature, round(d, 9) AS statistic, no AS n_old, nn AS n_new, round(d / no, 9) AS effect_size,
      round(q, 9) AS p_value, {drifted} AS drifted FROM p"""


def _long_sql(frame: str, features: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, data_group FROM {frame}" for f in features
    )


@query(
    "ks_drift",
    f"""WITH {G}, a AS (SELECT data_group, v, lag(v, 1) OVER w AS lag_1, lag(v, 7) OVER w AS lag_7 FROM g
        WINDOW w AS (PARTITION BY series ORDER BY ts)), {_ks_sql(_long_sql("a", KS_FEATURES), "d / no > 0.001")}""",
)
def ks(spark, sf_dir):
    days = lags(daily(spark, sf_dir), KEYS, "ts", "v", {"lag_1": 1, "lag_7": 7}, step="day", chunk_rows=CHUNK)
    return rounded(drift.ks_drift(grouped(days), KS_FEATURES, GROUP), 9)


@query(
    "ks_flags",
    f"""WITH {G}, a AS (SELECT data_group, {FLAG_SQL} FROM g),
      {_ks_sql(_long_sql("a", list(FLAGS.values())), "q < 0.05")}""",
)
def ks_on_flags(spark, sf_dir):
    days = grouped(flagged(spark, sf_dir))
    return rounded(drift.ks_drift(days, list(FLAGS.values()), GROUP, rule="pvalue"), 9)


MONTH_FEATURES = ["v", "per_order", "n"]


@query(
    "ks_exact",
    f"""WITH RECURSIVE mt AS (SELECT date_trunc('month', o_orderdate) AS ts, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v,
        count(*) AS n FROM orders GROUP BY 1),
      a AS (SELECT v, n, v::DOUBLE / n AS per_order, CASE WHEN ts < TIMESTAMP '1999-01-01' THEN 'old' ELSE 'new' END AS data_group FROM mt),
      l AS ({_long_sql("a", MONTH_FEATURES)}),
      c AS (SELECT feature, value, count(*) FILTER (data_group = 'old') AS o, count(*) FILTER (data_group = 'new') AS n FROM l GROUP BY 1, 2),
      r AS (SELECT feature, sum(o) OVER w AS co, sum(n) OVER w AS cn, sum(o) OVER f AS no, sum(n) OVER f AS nn FROM c
        WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature)),
      k AS (SELECT feature, CAST(max(abs(co * nn - cn * no)) AS BIGINT) AS h, CAST(max(no) AS BIGINT) AS n, CAST(max(nn) AS BIGINT) AS m
        FROM r GROUP BY 1),
      walk(feature, i, j, every, inside) AS (
        SELECT feature, 0::BIGINT, 0::BIGINT, 1::DOUBLE, CASE WHEN h > 0 THEN 1 ELSE 0 END::DOUBLE FROM k
        UNION ALL
        SELECT feature, i, j, sum(every), sum(CASE WHEN abs(i * m - j * n) < h THEN inside ELSE 0 END)
        FROM (SELECT w.feature, w.i + d.a AS i, w.j + 1 - d.a AS j, w.every, w.inside, k.n, k.m, k.h
          FROM walk w JOIN k ON k.feature = w.feature CROSS JOIN (VALUES (0), (1)) d(a))
        WHERE i <= n AND j <= m GROUP BY feature, i, j)
    SELECT k.feature, round(h::DOUBLE / (n * m), 9) AS statistic, n AS n_old, m AS n_new, round(h::DOUBLE / (n * m) / n, 9) AS effect_size,
      round(1 - inside / every, 9) AS p_value, 1 - inside / every < 0.05 AS drifted
    FROM walk w JOIN k ON k.feature = w.feature AND w.i = k.n AND w.j = k.m""",
)
def ks_exact(spark, sf_dir):
    """Months of orders before and after a day; the SQL counts the paths that stay within the distance, the operator those that do not."""
    orders = table(spark, sf_dir, "orders")
    months = orders.groupBy(F.date_trunc("month", "o_orderdate").alias("ts")).agg(F.sum(cents("o_totalprice")).alias("v"), F.count("*").alias("n"))
    old = F.col("ts") < F.lit("1999-01-01").cast("timestamp")
    groups = months.select("v", "n", (F.col("v").cast("double") / F.col("n")).alias("per_order"), F.when(old, drift.OLD).otherwise(drift.NEW).alias(GROUP))
    return rounded(drift.ks_drift(groups, MONTH_FEATURES, GROUP, rule="pvalue", method="exact"), 9)


SAMPLE_ORDER = "md5(series || '|' || CAST(ts AS VARCHAR) || '|123')"


@query(
    "drift_groups",
    f"""WITH {D}, n AS (SELECT * FROM d WHERE ts > TIMESTAMP '2000-01-01' AND ts <= TIMESTAMP '2000-04-01'),
      o AS (SELECT *, row_number() OVER (ORDER BY {SAMPLE_ORDER}) AS k FROM d WHERE ts <= TIMESTAMP '2000-01-01')
    SELECT series, ts, v, 'new' AS data_group FROM n
    UNION ALL SELECT series, ts, v, 'old' FROM o WHERE k <= (SELECT count(*) FROM n)""",
)
def groups(spark, sf_dir):
    return drift.drift_groups(daily(spark, sf_dir), "ts", SPLIT_DATE, "2000-04-01", 123, [*KEYS, "ts"])


def _sizes(df):
    """Rows and distinct rows per group, and the time range of the group that is not sampled."""
    new = F.when(F.col(GROUP) == drift.NEW, F.col("ts"))
    return df.groupBy(GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("series", "ts").alias("n_distinct"),
        F.min(new).alias("first"),
        F.max(new).alias("last"),
    )


@query(
    "drift_group_sizes",
    f"""WITH {D}, n AS (SELECT count(*) AS n, min(ts) AS "first", max(ts) AS "last" FROM d
        WHERE ts > TIMESTAMP '2000-01-01' AND ts <= TIMESTAMP '2000-04-01'),
      o AS (SELECT count(*) AS all_old FROM d WHERE ts <= TIMESTAMP '2000-01-01')
    SELECT 'new' AS data_group, n, n AS n_distinct, "first", "last" FROM n
    UNION ALL SELECT 'old', least(n, all_old), least(n, all_old), NULL, NULL FROM n, o""",
)
def drift_group_sizes(spark, sf_dir):
    return _sizes(groups(spark, sf_dir))


@query(
    "recent_group_sizes",
    f"""WITH {D}, m AS (SELECT max(ts) - INTERVAL 90 DAY AS start FROM d)
    SELECT 'new' AS data_group, count(*) AS n, count(*) AS n_distinct, min(ts) AS "first", max(ts) AS "last"
      FROM d, m WHERE ts >= start
    UNION ALL SELECT 'old', least(count(*), 990), least(count(*), 990), NULL, NULL FROM d, m WHERE ts < start""",
)
def recent_group_sizes(spark, sf_dir):
    return _sizes(drift.recent_groups(daily(spark, sf_dir), "ts", 90, 90 * 11, 123, [*KEYS, "ts"]))


@query("sample_size", f"WITH {D} SELECT least(count(*), 500) AS n, least(count(*), 500) AS n_distinct FROM d")
def sample_size(spark, sf_dir):
    chosen = sample(spark, sf_dir)
    return chosen.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("series", "ts").alias("n_distinct"))


@query(
    "time_folds",
    f"""WITH {D} SELECT series, ts, CAST(greatest(0, least(2, floor((epoch(ts) - epoch(TIMESTAMP '1995-01-01')) * 3
      / (epoch(TIMESTAMP '2001-08-02') - epoch(TIMESTAMP '1995-01-01'))))) AS INTEGER) AS fold FROM d""",
)
def folds(spark, sf_dir):
    return time_folds(daily(spark, sf_dir).drop("v"), "ts", "1995-01-01", "2001-08-02", 3)


@query("sample_n", f"WITH {D} SELECT series, ts, v FROM d ORDER BY {SAMPLE_ORDER} LIMIT 500")
def sample(spark, sf_dir):
    return sample_n(daily(spark, sf_dir), 500, 123, [*KEYS, "ts"])


def _fitted(spark, sf_dir, cfg):
    """A model of the years before 2000, the rows of the later years, and those it was fitted on."""
    rows = daily_features(spark, sf_dir).withColumnsRenamed(FLAGS)
    bounds = {"train": ("1995-01-01", SPLIT_DATE), "test": (SPLIT_DATE, "2100-01-01")}
    parts = time_split(rows, "ts", bounds)
    columns = [*FLAGS.values(), *CALENDAR, *DAILY.lags, *DAILY.moving]
    fit = timed_fit(make_pipeline(columns, "v", cfg), parts["train"].select("v", *columns))
    return fit.model, parts["test"], parts["train"]


@query("train_score")
def train_score(spark, sf_dir):
    """Fit on the years before 2000 and score the rest, in the layout of the prediction table."""
    model, test, _ = _fitted(spark, sf_dir, RegressorConfig())
    return score_to_predictions(model.transform(test.drop("series")), "ts", "models:/daily/1", "consumption_id", "series")


@query(
    "train_score_facts",
    f"""WITH {D} SELECT series, count(*) AS n, count(*) AS finite, true AS in_range, true AS beats_constant FROM d
      WHERE ts >= TIMESTAMP '2000-01-01' GROUP BY 1""",
)
def train_score_facts(spark, sf_dir):
    """What holds of any sound fit: as many finite predictions as rows, none far from the labels, and on the rows it was fitted on a squared error at most a
    quarter of that of the best constant."""
    model, test, train = _fitted(spark, sf_dir, RegressorConfig())
    seen = train.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    error = model.transform(train).agg(F.avg((F.col("prediction") - F.col("v")) ** 2).alias("error"), F.var_pop("v").alias("constant"))
    near = F.col("prediction").between(F.col("low") * 2 - F.col("high"), F.col("high") * 2 - F.col("low"))
    finite = F.count_if(F.col("prediction").isNotNull() & ~F.isnan("prediction"))
    rows = attach(attach(model.transform(test), seen, []), error, [])
    facts = rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), finite.alias("finite"), F.bool_and(near).alias("in_range"), F.max(F.col("error") * 4 <= F.col("constant")).alias("beats_constant"))
    return facts


@query(
    "score_with_gaps",
    f"""WITH {D}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM d)
    SELECT series, count(*) AS n, count(*) AS predicted FROM k WHERE (series <> '5-LOW' OR i <= 10) AND (ts >= TIMESTAMP '2000-01-01' OR series = '5-LOW')
    GROUP BY 1""",
)
def score_with_gaps(spark, sf_dir):
    """A series shorter than its longest lag is scored row by row like the others, though its lags are unknown."""
    model, test, _ = _fitted(spark, sf_dir, RegressorConfig())
    days = daily(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("series").orderBy("ts"))
    short = days.filter(F.col("series") == "5-LOW").withColumn("_i", first).filter("_i <= 10").drop("_i")
    config = replace(DAILY, back_fill=False)
    few = build_features(short, "series", "ts", "v", config).withColumnsRenamed(FLAGS)
    scored = model.transform(test.filter(F.col("series") != "5-LOW").unionByName(few))
    known = F.count_if(F.col("prediction").isNotNull() & ~F.isnan("prediction"))
    return scored.groupBy("series").agg(F.count(F.lit(1)).alias("n"), known.alias("predicted"))
