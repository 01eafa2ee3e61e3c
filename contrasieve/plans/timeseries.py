"""Queries on monthly series (TS1-TS5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrasieve.operators import profile, series
from contrasieve.plans.registry import query
from contrasieve.plans.standin import FACT, R, fact, r

# Monthly counts per label and line status; gaps inside a series show 0.
FILLED = FACT + """, h AS (SELECT label, status, date_trunc('month', date)::DATE AS m, count(*) AS n FROM fact GROUP BY 1, 2, 3), sp AS (SELECT label, status, min(m) AS a, max(m) AS z FROM h GROUP BY 1, 2),
  cal AS (SELECT label, status, unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM sp),
  mc AS (SELECT cal.label, cal.status, strftime(cal.m, '%Y-%m') AS month, cal.m, coalesce(n, 0) AS n FROM cal LEFT JOIN h ON cal.label = h.label AND cal.status = h.status AND cal.m = h.m)"""


def monthly(spark, d):
    return series.monthly_counts(fact(spark, d), ["label", "status"], "date")


@query("ts1_monthly_counts", f"WITH {FILLED} SELECT label, status, month, n FROM mc")
def ts1(spark, d):
    return monthly(spark, d)


TS2_SQL = f"""WITH {FILLED}, x AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY label, status) AS t,
    (sum(n) OVER (PARTITION BY label, status ORDER BY month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + 0.5 * (lag(n, 6) OVER w + lead(n, 6) OVER w)) / 12.0 AS tr FROM mc WINDOW w AS (PARTITION BY label, status ORDER BY month)),
  y AS (SELECT label, status, month, n, i, t, CASE WHEN i > 6 AND i <= t - 6 THEN tr::DOUBLE END AS tr FROM x WHERE t >= 24),
  f AS (SELECT label, status, regr_slope(tr, i) FILTER (WHERE tr IS NOT NULL AND i < 19) AS s1, regr_intercept(tr, i) FILTER (WHERE tr IS NOT NULL AND i < 19) AS c1,
     regr_slope(tr, i) FILTER (WHERE tr IS NOT NULL AND i > t - 18) AS s2, regr_intercept(tr, i) FILTER (WHERE tr IS NOT NULL AND i > t - 18) AS c2 FROM y GROUP BY 1, 2),
  z AS (SELECT y.*, CASE WHEN i < 7 THEN c1 + s1 * i WHEN i > t - 6 THEN c2 + s2 * i ELSE tr END AS trend, (i - 1) % 12 AS se FROM y JOIN f USING (label, status)),
  sm AS (SELECT label, status, se, avg(n - tr) AS m FROM z WHERE tr IS NOT NULL GROUP BY 1, 2, 3), g AS (SELECT label, status, avg(m) AS g FROM sm GROUP BY 1, 2)
  SELECT label, status, month, n, {R('trend')} AS trend, {R('m - g')} AS seasonal, {R('n - trend - (m - g)')} AS residual FROM z JOIN sm USING (label, status, se) JOIN g USING (label, status)"""


@query("ts2_decompose", TS2_SQL)
def ts2(spark, d):
    out = series.decompose(monthly(spark, d), ["label", "status"], "month", "n")
    return out.select("label", "status", "month", "n", *[r(F.col(c)).alias(c) for c in ("trend", "seasonal", "residual")])


@query("ts3_change_points")
def ts3(spark, d):
    return series.change_points(monthly(spark, d), ["label", "status"], "month", "n")


@query(
    "ts3_mean_shift",
    f"""WITH {FILLED}, c AS (SELECT label, status, month, sum(n - mu) OVER (PARTITION BY label, status ORDER BY month) AS cs, s, t FROM (SELECT *, avg(n) OVER (PARTITION BY label, status) AS mu, stddev_samp(n) OVER (PARTITION BY label, status) AS s, count(*) OVER (PARTITION BY label, status) AS t FROM mc))
    SELECT label, status, month AS break_after, {R('abs(cs) / (s * sqrt(t))')} AS strength FROM c QUALIFY row_number() OVER (PARTITION BY label, status ORDER BY round(abs(cs), 6) DESC, month) = 1""",
)
def ts3m(spark, d):
    return series.mean_shift(monthly(spark, d), ["label", "status"], "month", "n").withColumn("strength", r(F.col("strength")))


@query(
    "ts4_forecast",
    f"""WITH {FILLED}, c AS (SELECT *, n - lag(n, 12) OVER (PARTITION BY label, status ORDER BY month) AS ch, row_number() OVER (PARTITION BY label, status ORDER BY month DESC) AS k FROM mc),
    w AS (SELECT *, avg(ch) OVER (PARTITION BY label, status) AS dr, stddev_samp(ch) OVER (PARTITION BY label, status) AS sd FROM c)
    SELECT label, status, strftime(m + INTERVAL 12 MONTH, '%Y-%m') AS month, {R('n + dr')} AS forecast, {R('n + dr - 1.96 * sd')} AS low, {R('n + dr + 1.96 * sd')} AS high FROM w WHERE k <= 12""",
)
def ts4(spark, d):
    out = series.forecast(monthly(spark, d), ["label", "status"], "month", "n")
    return out.select("label", "status", "month", *[r(F.col(c)).alias(c) for c in ("forecast", "low", "high")])


@query(
    "ts5_yearly_composition",
    f"WITH {FACT}, c AS (SELECT year, label, count(*) AS n FROM fact GROUP BY 1, 2) SELECT year, label, n, {R('100.0 * n / sum(n) OVER (PARTITION BY year)')} AS pct FROM c",
)
def ts5(spark, d):
    return profile.composition(fact(spark, d), "year", "label").withColumn("pct", r(F.col("pct")))
