"""Queries over rolling origins, the baseline, and global linear forecasts."""

from pyspark.sql import functions as F

from panelfold.operators import errors, linear, origins, ridge, splits
from panelfold.operators.baseline import seasonal_naive
from panelfold.operators.positions import with_positions
from panelfold.schema import BASELINE, ID, POS, SIZE, TARGET, TIME
from panelfold.session import materialize, shared_folder
from panelfold.sources.fits import load_fit, save_fit

from .panels import PANELS, panel
from .sqltext import PANEL, POSITIONS, UIDS, ctes
from . import sqltext

QUERIES, SQL = {}, {}


def positioned(spark, sf, name):
    return with_positions(panel(spark, sf, name), PANELS[name]["freq"])


def trended(spark, sf, name):
    return linear.with_trends(positioned(spark, sf, name), PANELS[name]["freq"])


# -- SQL building blocks -------------------------------------------------------

TRENDS = "SELECT *, " + ", ".join(
    f"CASE WHEN pos >= {w} THEN avg(y) OVER (PARTITION BY unique_id ORDER BY pos "
    f"ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) END AS tr{w}" for w in (11, 25)) + " FROM pos"


def base(name, **more):
    return ctes(panel=PANEL[name], pos=POSITIONS, uids=UIDS, tr=TRENDS, **more)


def origins_sql(h, test, skip=0):
    """Cutoff rows: test window of ``test`` rows ending ``skip`` rows before the end."""
    return f"SELECT * FROM tr WHERE pos BETWEEN n - {skip + test} AND n - {skip + h}"


def windows_sql(rows, h, m):
    """Every (cutoff row, lead) with its actual and the seasonal values before it."""
    return f"""
SELECT a.unique_id, a.n, a.pos AS c, a.ds AS cutoff, CAST(k.k AS INTEGER) AS lead, f.ds AS ds,
       f.y AS y, a.y AS last, a.tr11, a.tr25, p1.y AS s1, p2.y AS s2
FROM ({rows}) a CROSS JOIN (SELECT unnest(range(1, {h} + 1)) AS k) k
JOIN pos f ON f.unique_id = a.unique_id AND f.pos = a.pos + k.k
LEFT JOIN pos p1 ON p1.unique_id = a.unique_id AND p1.pos = a.pos - {m} + (k.k - 1) % {m} + 1
LEFT JOIN pos p2 ON p2.unique_id = a.unique_id AND p2.pos = a.pos - 2 * {m} + (k.k - 1) % {m} + 1"""


def features_sql(windows):
    keep = "unique_id, n, c, cutoff, lead, ds, y"
    return f"""
SELECT {keep}, 'season1' AS features, last AS base, s1 - last AS x1, CAST(0 AS DOUBLE) AS x2
FROM {windows} UNION ALL
SELECT {keep}, 'season2', last, (s1 + s2) / 2 - last, 0 FROM {windows} UNION ALL
SELECT {keep}, 'trend11', tr11, last - tr11, s1 - tr11 FROM {windows} UNION ALL
SELECT {keep}, 'trend25', tr25, last - tr25, s1 - tr25 FROM {windows}"""


def scaled_sql(features, hold):
    """Both scalers; a standardized series is divided by its deviation before the fit."""
    return f"""
SELECT r.*, o.scaler, CASE WHEN o.scaler = 'none' THEN 1 ELSE 1 / w.width END AS f
FROM {features} r CROSS JOIN (SELECT unnest(['none', 'standard']) AS scaler) o
LEFT JOIN (SELECT unique_id, nullif(stddev_pop(y), 0) AS width FROM pos
           WHERE pos <= n - {hold} GROUP BY 1) w USING (unique_id)
WHERE o.scaler = 'none' OR w.width IS NOT NULL"""


def coefs_sql(samples, train, keys, hold):
    """Least squares per group and lead on the raw windows a fit may see."""
    x1, x2, z = "f * x1", "f * x2", "f * (y - base)"
    k = ", ".join(keys)
    return f"""
SELECT {k}, features, scaler, lead, n_windows, b1, b2, mz - b1 * m1 - b2 * m2 AS a FROM (
  SELECT *, CASE WHEN features LIKE 'season%' THEN c1z / nullif(c11, 0)
                 ELSE (c22 * c1z - c12 * c2z) / nullif(c11 * c22 - c12 * c12, 0) END AS b1,
            CASE WHEN features LIKE 'season%' THEN 0
                 ELSE (c11 * c2z - c12 * c1z) / nullif(c11 * c22 - c12 * c12, 0) END AS b2
  FROM (
    SELECT {k}, features, scaler, lead, count(*) AS n_windows,
           avg({x1}) AS m1, avg({x2}) AS m2, avg({z}) AS mz,
           var_pop({x1}) AS c11, var_pop({x2}) AS c22, covar_pop({x1}, {x2}) AS c12,
           covar_pop({x1}, {z}) AS c1z, covar_pop({x2}, {z}) AS c2z
    FROM {samples} JOIN {train} t USING (unique_id)
    WHERE c + lead <= n - {hold} AND y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL
    GROUP BY ALL))"""


def predict_sql(inputs, coefs, keys, hold):
    using = ", ".join([*keys, "features", "lead"])
    return f"""
SELECT i.*, q.scaler, base + a * CASE WHEN q.scaler = 'none' THEN 1 ELSE w.width END
            + b1 * x1 + b2 * x2 AS yhat
FROM {inputs} i JOIN {coefs} q USING ({using})
JOIN (SELECT unique_id, nullif(stddev_pop(y) FILTER (WHERE pos <= n - {hold}), 0) AS width
      FROM pos GROUP BY 1) w USING (unique_id)"""


# -- grids ---------------------------------------------------------------------

def _grid(name, test, step=1):
    h = PANELS[name]["horizon"]
    return lambda spark, sf: origins.cv_grid(positioned(spark, sf, name), h, test, step)


def _grid_sql(name, test, step=1, h=None):
    h = h or PANELS[name]["horizon"]
    return base(name, o=origins_sql(h, test), w=windows_sql("SELECT * FROM o", h, 1)) + f"""
SELECT unique_id, cutoff, ds, lead, y FROM w WHERE (c - (n - {test})) % {step} = 0"""


QUERIES["cv_grid"] = _grid("type_hour", 36, 4)
SQL["cv_grid"] = _grid_sql("type_hour", 36, 4)
QUERIES["cv_outer"] = lambda spark, sf: origins.cv_outer(positioned(spark, sf, "brand_month"), 6)
SQL["cv_outer"] = _grid_sql("brand_month", 12)


def _cv_inner(spark, sf):
    rows = positioned(spark, sf, "nation_month").filter(F.col(POS) <= F.col(SIZE) - 12)
    return origins.cv_inner(rows.withColumn(SIZE, F.col(SIZE) - 12), 6)


QUERIES["cv_inner"] = _cv_inner
SQL["cv_inner"] = base("nation_month", o=origins_sql(6, 6, 12),
                       w=windows_sql("SELECT * FROM o", 6, 12)) + """
SELECT unique_id, cutoff, ds, lead, y FROM w"""

# Horizon close to the length of the series: few windows are left.
QUERIES["trim_windows"] = lambda spark, sf: (
    origins.cv_grid(positioned(spark, sf, "user_day"), 14, 28)
    .groupBy(ID).agg(F.countDistinct("cutoff").alias("n_windows"),
                     F.count(F.lit(1)).alias("n_rows")))
SQL["trim_windows"] = base("user_day", o=origins_sql(14, 28),
                           w=windows_sql("SELECT * FROM o", 14, 7)) + """
SELECT unique_id, count(DISTINCT cutoff) AS n_windows, count(*) AS n_rows FROM w GROUP BY 1"""

QUERIES["attach_actuals"] = lambda spark, sf: origins.attach_actuals(
    origins.cv_grid(positioned(spark, sf, "user_day"), 3, 6), panel(spark, sf, "user_day"))
SQL["attach_actuals"] = _grid_sql("user_day", 6)


def _composite(spark, sf):
    rows = positioned(spark, sf, "brand_month")
    tested = splits.kfold(rows).filter(F.col("role") == "test").drop("role", "method")
    grid = origins.cv_grid(rows, 6, 6)
    return origins.composite_ids(grid.join(tested, ID)).select(
        ID, "fold", TIME, F.col("grp").cast("long").alias("grp"), "composite_id")


QUERIES["composite_ids"] = _composite
SQL["composite_ids"] = base("brand_month", o=origins_sql(6, 6),
                            w=windows_sql("SELECT * FROM o", 6, 12)) + f"""
SELECT unique_id, fold, ds, grp,
       unique_id || '_fold' || fold || '_x' || grp AS composite_id
FROM (SELECT w.unique_id, fold, ds, dense_rank() OVER (ORDER BY fold, w.unique_id) - 1 AS grp
      FROM w JOIN ({sqltext.kfold('KFold', 5)}) s USING (unique_id) WHERE role = 'test')"""

QUERIES["tag_fold"] = lambda spark, sf: origins.cv_grid(
    positioned(spark, sf, "nation_month"), 6, 6).withColumn("fold", F.lit(0))
SQL["tag_fold"] = base("nation_month", o=origins_sql(6, 6),
                       w=windows_sql("SELECT * FROM o", 6, 12)) + """
SELECT unique_id, cutoff, ds, lead, y, CAST(0 AS INTEGER) AS fold FROM w"""

# -- baseline --------------------------------------------------------------------


def naive(spark, sf, name, test, skip_last=0):
    p = PANELS[name]
    return seasonal_naive(positioned(spark, sf, name), p["horizon"], p["season"], test,
                          skip_last=skip_last)


QUERIES["seasonal_naive"] = lambda spark, sf: naive(spark, sf, "type_hour", 24)
SQL["seasonal_naive"] = base("type_hour", o=origins_sql(12, 24),
                             w=windows_sql("SELECT * FROM o", 12, 24)) + """
SELECT unique_id, cutoff, ds, lead, y, s1 AS yhat FROM w"""

# -- global linear models ----------------------------------------------------------

ASSIGNED = f"{sqltext.holdout('Holdout', 0.7, 1)} UNION ALL {sqltext.kfold('KFold', 5)}"


def _assignments(rows):
    return splits.assign(rows, {"Holdout": splits.Shares(0.7), "KFold": splits.Folds(5)})


def _prepared(rows):
    """Panel and splits written once: fits, widths and forecasts all read them."""
    rows = materialize(rows, "panel")
    first = rows.filter(F.col(POS) == 1).select(ID)
    return rows, materialize(_assignments(first), "assignments")


# Decimal places compared: the hourly panel holds small means, the others sums of money.
DIGITS = {"type_hour": 6}


def _linear(name, features, scaler):
    def run(spark, sf):
        p = PANELS[name]
        rows, assigned = _prepared(trended(spark, sf, name))
        out = linear.global_fit_predict(rows, assigned, p["horizon"], p["season"],
                                        p["freq"], features, scaler)
        digits = DIGITS.get(name, 1)
        return out.withColumn("yhat", F.round("yhat", digits)).withColumn(TARGET, F.round(TARGET, digits))
    return run


def _linear_sql(name, features, scaler):
    h, m = PANELS[name]["horizon"], PANELS[name]["season"]
    keys = ["method", "fold"]
    return base(
        name, assigned=ASSIGNED,
        train="SELECT method, fold, unique_id FROM assigned WHERE role = 'train'",
        test="SELECT method, fold, unique_id FROM assigned WHERE role = 'test'",
        samples=windows_sql("SELECT * FROM tr", h, m), fs=features_sql("samples"),
        ss=scaled_sql("fs", h), coefs=coefs_sql("ss", "train", keys, h),
        ahead=windows_sql(origins_sql(h, h), h, m), fa=features_sql("ahead"),
        ia="SELECT * FROM fa JOIN test USING (unique_id)",
        scored=predict_sql("ia", "coefs", keys, h)) + f"""
SELECT method, fold, unique_id, cutoff, ds, lead, round(y, {DIGITS.get(name, 1)}) AS y,
       round(yhat, {DIGITS.get(name, 1)}) AS yhat
FROM scored WHERE features = '{features}' AND scaler = '{scaler}'"""


for _key, _args in {
    "global_fit_predict": ("nation_month", "season1", "none"),
    "nlinear_forecast": ("brand_month", "season2", "standard"),
    "dlinear_forecast": ("brand_month", "trend11", "none"),
    "dlinear_hourly_forecast": ("type_hour", "trend25", "standard"),
}.items():
    QUERIES[_key], SQL[_key] = _linear(*_args), _linear_sql(*_args)

QUERIES["lag_features"] = lambda spark, sf: linear.lag_features(
    positioned(spark, sf, "type_hour"), 15, "H").select(
    ID, TIME, *[F.get("lags", F.lit(i)).alias(f"lag_{14 - i}") for i in range(15)],
    F.size("lags").cast("long").alias("n_lags"))
SQL["lag_features"] = ctes(panel=PANEL["type_hour"], pos=POSITIONS) + f"""
SELECT unique_id, ds, {", ".join(f"lag_{i}" for i in range(15))}, CAST(15 AS BIGINT) AS n_lags FROM (
  SELECT *, {", ".join(f"lag(y, {i}) OVER w AS lag_{i}" for i in range(15))}
  FROM pos WINDOW w AS (PARTITION BY unique_id ORDER BY ds)) WHERE pos >= 15"""


def _stored_fit(spark, sf):
    """Fit on one panel, store the coefficients, score another panel with them."""
    rows = materialize(trended(spark, sf, "brand_month"), "panel")
    stages = {"final": 12}
    sums = linear.apply_scalers(
        linear.training_sums(rows, 6, 12, stages, "MS", ("season1",)),
        linear.series_widths(rows, stages), stages, ("none",))
    everyone = rows.select(ID).distinct().withColumn("run", F.lit("fitted"))
    folder = shared_folder(spark, "coefficients")
    save_fit(linear.fit(sums, everyone, ["run"]), folder, {"run": "string"})
    other = materialize(trended(spark, sf, "nation_month"), "panel")
    inputs = linear.forecast_inputs(other, 6, 12, 6, features=("season1",)).withColumn(
        "run", F.lit("fitted"))
    stored = load_fit(spark, folder, {"run": "string"}, "final")
    widths = linear.series_widths(other, {"final": 6})
    scored = linear.predict(inputs, stored, widths, "final", ["run"])
    return scored.select(ID, "cutoff", TIME, "lead", F.round("yhat", 1).alias("yhat"))


QUERIES["predict_with_fitted"] = _stored_fit
SQL["predict_with_fitted"] = ctes(
    panel=PANEL["brand_month"], pos=POSITIONS, tr=TRENDS,
    train="SELECT DISTINCT unique_id, 'fitted' AS run FROM pos",
    samples=windows_sql("SELECT * FROM tr", 6, 12), fs=features_sql("samples"),
    ss=scaled_sql("fs", 12), coefs=coefs_sql("ss", "train", ["run"], 12),
    other="SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS pos, count(*) OVER "
          f"(PARTITION BY unique_id) AS n FROM ({PANEL['nation_month']})") + """
SELECT a.unique_id, a.ds AS cutoff, f.ds, CAST(f.pos - a.pos AS INTEGER) AS lead,
       round(a.y + q.a + q.b1 * (s.y - a.y), 1) AS yhat
FROM other a JOIN other f ON f.unique_id = a.unique_id AND f.pos > a.pos
JOIN other s ON s.unique_id = a.unique_id AND s.pos = f.pos - 12
JOIN coefs q ON q.lead = f.pos - a.pos AND q.features = 'season1' AND q.scaler = 'none'
WHERE a.pos = a.n - 6"""


def _ridge(spark, sf):
    rows, assigned = _prepared(positioned(spark, sf, "brand_month"))
    return ridge.ridge_lags_forecast(rows, assigned, 6, lags=7, penalty=1.0, freq="MS")


QUERIES["ridge_lags_forecast"] = _ridge


def _ridge_short(spark, sf):
    """Three lags: two differences and the intercept, which SQL can solve in closed form."""
    rows, assigned = _prepared(positioned(spark, sf, "brand_month"))
    out = ridge.ridge_lags_forecast(rows, assigned, 6, lags=3, penalty=1.0, freq="MS")
    return out.select("method", "fold", ID, "cutoff", TIME, "lead", F.round("yhat", 1).alias("yhat"))


QUERIES["ridge_short_forecast"] = _ridge_short
SQL["ridge_short_forecast"] = base(
    "brand_month", assigned=ASSIGNED,
    steps="""SELECT unique_id, ds, pos, n, y, lag(y, 2) OVER w - y AS x1, lag(y, 1) OVER w - y AS x2
FROM pos WINDOW w AS (PARTITION BY unique_id ORDER BY pos)""",
    train="SELECT method, fold, unique_id FROM assigned WHERE role = 'train'",
    test="SELECT method, fold, unique_id FROM assigned WHERE role = 'test'",
    sums="""SELECT method, fold, f.pos - c.pos AS lead, avg(x1) AS m1, avg(x2) AS m2, avg(f.y - c.y) AS mz,
  count(*) * var_pop(x1) + 1.0 AS c11, count(*) * var_pop(x2) + 1.0 AS c22,
  count(*) * covar_pop(x1, x2) AS c12, count(*) * covar_pop(x1, f.y - c.y) AS c1z,
  count(*) * covar_pop(x2, f.y - c.y) AS c2z
FROM steps c JOIN pos f ON f.unique_id = c.unique_id AND f.pos BETWEEN c.pos + 1 AND c.pos + 6
JOIN train t ON t.unique_id = c.unique_id
WHERE c.pos >= 3 AND f.pos <= c.n - 6 AND f.y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL
GROUP BY ALL""",
    betas="""SELECT method, fold, lead, b1, b2, mz - b1 * m1 - b2 * m2 AS a FROM (
  SELECT *, (c22 * c1z - c12 * c2z) / (c11 * c22 - c12 * c12) AS b1,
            (c11 * c2z - c12 * c1z) / (c11 * c22 - c12 * c12) AS b2 FROM sums)""") + """
SELECT method, fold, c.unique_id, c.ds AS cutoff, f.ds, CAST(lead AS INTEGER) AS lead,
       round(c.y + a + b1 * x1 + b2 * x2, 1) AS yhat
FROM steps c JOIN test USING (unique_id) JOIN betas USING (method, fold)
JOIN pos f ON f.unique_id = c.unique_id AND f.pos = c.pos + lead
WHERE c.pos = c.n - 6"""

# -- errors on the baseline -----------------------------------------------------------


def _scale(name, holdout):
    def run(spark, sf):
        p = PANELS[name]
        out = errors.mase_scale(positioned(spark, sf, name), p["season"], p["freq"], holdout)
        return out.withColumn("scale", F.round("scale", 4))
    return run


SCALE = """SELECT unique_id, nullif(avg(abs(y - prev)), 0) AS scale FROM (
  SELECT unique_id, pos, n, y, lag(y, {m}) OVER (PARTITION BY unique_id ORDER BY pos) AS prev
  FROM pos) WHERE pos <= n - {hold} GROUP BY 1"""

QUERIES["mase_scale"] = _scale("type_hour", 24)
SQL["mase_scale"] = base("type_hour", s=SCALE.format(m=24, hold=24)) + """
SELECT unique_id, round(scale, 4) AS scale FROM s"""

# A scale of zero or nothing is null: here the day before rarely has a match.
QUERIES["zero_to_null"] = lambda spark, sf: errors.mase_scale(
    positioned(spark, sf, "user_day"), 26, "D").withColumn("scale", F.round("scale", 6))
SQL["zero_to_null"] = base("user_day", s=SCALE.format(m=26, hold=0)) + """
SELECT unique_id, round(scale, 6) AS scale FROM s"""


def _naive_errors(spark, sf, name, test):
    return errors.mae_by_series(naive(spark, sf, name, test).withColumn("model", F.lit(BASELINE)))


QUERIES["mae_by_series"] = lambda spark, sf: _naive_errors(spark, sf, "user_day", 6).withColumn(
    "err", F.round("err", 6))
SQL["mae_by_series"] = base("user_day", o=origins_sql(3, 6),
                            w=windows_sql("SELECT * FROM o", 3, 7)) + """
SELECT unique_id, 'SeasonalNaive' AS model, round(avg(abs(y - s1)), 6) AS err FROM w GROUP BY 1"""


def naive_mase(spark, sf, name="brand_month"):
    """Mean scaled error of the baseline over the series of a panel."""
    p = PANELS[name]
    rows = positioned(spark, sf, name)
    forecasts = seasonal_naive(rows, p["horizon"], p["season"], p["horizon"]).withColumn(
        "model", F.lit(BASELINE))
    scales = errors.mase_scale(rows, p["season"], p["freq"], p["horizon"])
    scaled = errors.scaled_errors(errors.mae_by_series(forecasts), scales)
    return scaled.groupBy("model").agg(F.count(F.lit(1)).alias("n_series"),
                                       F.round(F.avg("err"), 6).alias("mase"))


QUERIES["naive_mase"] = naive_mase
SQL["naive_mase"] = base("brand_month", o=origins_sql(6, 6), s=SCALE.format(m=12, hold=6),
                         w=windows_sql("SELECT * FROM o", 6, 12),
                         e="SELECT unique_id, avg(abs(y - s1)) AS err FROM w GROUP BY 1") + """
SELECT 'SeasonalNaive' AS model, count(*) AS n_series, round(avg(err / scale), 6) AS mase
FROM e JOIN s USING (unique_id)"""
