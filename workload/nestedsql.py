"""The nested experiment as one chain of SQL steps per panel."""

from panelfold.operators.configs import SPACE

from . import sqltext
from .forecasting import (SCALE, TRENDS, coefs_sql, features_sql, origins_sql, predict_sql,
                          scaled_sql, windows_sql)
from .panels import PANELS
from .sqltext import PANEL, POSITIONS, UIDS, ctes

FOLD = ["seed", "method", "fold"]
SEEDS = (123, 7)
FAMILIES = ["NLinear", "DLinear"]


def _quoted(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def space_sql(families=FAMILIES):
    rows = ", ".join(f"('{f}', '{p}', '{kind}', {_quoted(args)})"
                     for f in families for p, (kind, args) in SPACE[f].items())
    return f"SELECT * FROM (VALUES {rows}) AS t(family, param, kind, args)"


def _text(value, digits):
    trimmed = f"regexp_replace(CAST(CAST({value} AS DECIMAL(18,{digits})) AS VARCHAR), '0+$', '')"
    return f"CASE WHEN {trimmed} LIKE '%.' THEN {trimmed} || '0' ELSE {trimmed} END"


def draws_sql(n=20):
    u = ("CAST('0x' || substr(md5(i || '|' || family || '|' || param), 1, 8) AS BIGINT)"
         " / CAST(4294967296 AS DOUBLE)")
    return f"""
SELECT family, config_idx, param, CASE kind
  WHEN 'choice' THEN args[CAST(floor(u * len(args)) AS INTEGER) + 1]
  WHEN 'loguniform' THEN {_text('exp(ln(lo) + u * (ln(hi) - ln(lo)))', 8)}
  WHEN 'uniform' THEN {_text('lo + u * (hi - lo)', 8)}
  WHEN 'quniform' THEN {_text('round_even((lo + u * (hi - lo)) / q, 0) * q', 1)}
  WHEN 'randint' THEN CAST(CAST(floor(lo + u * (hi - lo)) AS BIGINT) AS VARCHAR)
  ELSE args[1] END AS value
FROM (SELECT *, {u} AS u, CAST(i AS INTEGER) AS config_idx, TRY_CAST(args[1] AS DOUBLE) AS lo,
             TRY_CAST(args[2] AS DOUBLE) AS hi, TRY_CAST(args[3] AS DOUBLE) AS q
      FROM space, (SELECT unnest(range({n})) AS i))"""


MODELS = """
SELECT family, config_idx,
  CASE WHEN family = 'DLinear' THEN 'trend' || max(value) FILTER (WHERE param = 'moving_avg_window')
       ELSE 'season' || max(value) FILTER (WHERE param = 'input_size_multiplier') END AS features,
  CASE WHEN max(value) FILTER (WHERE param = 'scaler_type') = 'None' THEN 'none'
       ELSE 'standard' END AS scaler,
  md5('{' || string_agg('"' || param || '": "' || CASE WHEN param = 'learning_rate' THEN RATE
      ELSE value END || '"', ', ' ORDER BY param) || '}') AS hash_value
FROM draws GROUP BY 1, 2""".replace("RATE", (
    "CASE WHEN round_even(CAST(value AS DOUBLE), 5) < 0.0001 THEN "
    "CAST(CAST(round_even(CAST(value AS DOUBLE) * 100000, 0) AS BIGINT) AS VARCHAR) || 'e-05' ELSE "
    + _text("round_even(CAST(value AS DOUBLE), 5)", 5) + " END"))


def assigned_sql(seeds=SEEDS):
    parts = []
    for seed in seeds:
        kept = f"({sqltext.sampled('1 - 0.3', seed)})"
        parts.append(f"SELECT CAST({seed} AS INTEGER) AS seed, method, fold, unique_id, role "
                     f"FROM ({sqltext.split_all(seed, kept)})")
    return " UNION ALL ".join(parts)


def fold_steps(name, seeds=SEEDS, families=FAMILIES):
    """Steps up to the losses of the configurations."""
    h, m = PANELS[name]["horizon"], PANELS[name]["season"]
    val, inner = 4 * h, 3 * h
    return {
        "panel": PANEL[name], "pos": POSITIONS, "uids": UIDS, "tr": TRENDS,
        "assigned": assigned_sql(seeds),
        "train": "SELECT seed, method, fold, unique_id FROM assigned WHERE role = 'train'",
        "test": "SELECT seed, method, fold, unique_id FROM assigned WHERE role = 'test'",
        "samples": windows_sql("SELECT * FROM tr", h, m), "fs": features_sql("samples"),
        "ss_val": scaled_sql("fs", val), "ss_inner": scaled_sql("fs", inner),
        "coefs_val": coefs_sql("ss_val", "train", FOLD, val),
        "coefs_inner": coefs_sql("ss_inner", "train", FOLD, inner),
        "w_val": windows_sql(origins_sql(h, h, inner), h, m), "f_val": features_sql("w_val"),
        "i_val": "SELECT * FROM f_val JOIN train USING (unique_id)",
        "p_val": predict_sql("i_val", "coefs_val", FOLD, val),
        "losses": "SELECT seed, method, fold, features, scaler, avg(abs(y - yhat)) AS loss "
                  "FROM p_val GROUP BY ALL",
        "space": space_sql(families), "draws": draws_sql(), "models": MODELS,
        "scores": "SELECT seed, method, fold, 'Auto' || family AS model, family, config_idx, loss, "
                  "hash_value, features, scaler FROM models JOIN losses USING (features, scaler) "
                  "WHERE loss IS NOT NULL",
    }


SINGLE = """
SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY seed, method, fold, model
  ORDER BY loss, hash_value, config_idx) = 1"""

ACROSS = """
SELECT * FROM (
  SELECT seed, method, model, family, hash_value, mean_loss AS loss,
         arg_min(struct_pack(config_idx, features, scaler), fold * 1000 + config_idx) AS first
  FROM scores JOIN (
    SELECT seed, method, features, scaler, avg(loss) AS mean_loss FROM (
      SELECT DISTINCT seed, method, fold, features, scaler, loss FROM scores) GROUP BY ALL)
  USING (seed, method, features, scaler) GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY seed, method, model ORDER BY loss, hash_value) = 1"""

FORECAST = "seed, method, stage, fold, unique_id, cutoff, ds, lead, model, yhat, y"


def forecast_steps(name, seeds=SEEDS):
    h, m = PANELS[name]["horizon"], PANELS[name]["season"]
    out, inner = 2 * h, 3 * h
    return {
        **fold_steps(name, seeds), "single": SINGLE, "across": ACROSS,
        "w_in": windows_sql(origins_sql(h, h, out), h, m), "f_in": features_sql("w_in"),
        "i_in": "SELECT * FROM f_in JOIN test USING (unique_id)",
        "p_in": predict_sql("i_in", "coefs_inner", FOLD, inner),
        "everyone": "SELECT unique_id, 0 AS final FROM uids",
        "ss_final": scaled_sql("fs", out),
        "coefs_final": coefs_sql("ss_final", "everyone", ["final"], out),
        "w_out": windows_sql(origins_sql(h, out), h, m), "f_out": features_sql("w_out"),
        "i_out": "SELECT *, 0 AS final FROM f_out",
        "p_out": predict_sql("i_out", "coefs_final", ["final"], out),
        "runs": "SELECT DISTINCT seed, method FROM assigned",
        "results": f"""
SELECT p.seed, p.method, 'inner' AS stage, p.fold, unique_id, cutoff, ds, lead, model, yhat, y
FROM p_in p JOIN single s ON s.seed = p.seed AND s.method = p.method AND s.fold = p.fold
  AND s.features = p.features AND s.scaler = p.scaler
UNION ALL
SELECT seed, method, 'inner', fold, unique_id, cutoff, ds, lead, 'SeasonalNaive', s1, y
FROM w_in JOIN test USING (unique_id)
UNION ALL
SELECT a.seed, a.method, 'outer', 0, unique_id, cutoff, ds, lead, family, yhat, y
FROM p_out p JOIN across a ON a.first.features = p.features AND a.first.scaler = p.scaler
UNION ALL
SELECT seed, method, 'outer', 0, unique_id, cutoff, ds, lead, 'SeasonalNaive', s1, y
FROM w_out CROSS JOIN runs""",
    }


def stacked_results(names, seeds=SEEDS):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, seed, method, stage, CAST(fold AS INTEGER) AS fold, unique_id, "
        f"CAST(cutoff AS TIMESTAMP) AS cutoff, CAST(ds AS TIMESTAMP) AS ds, lead, model, yhat, y "
        f"FROM ({ctes(**forecast_steps(n, seeds))} SELECT * FROM results)" for n in names)


def stacked_scales(names):
    parts = []
    for n in names:
        h, m = PANELS[n]["horizon"], PANELS[n]["season"]
        for part, hold in (("in", 2 * h), ("dev", 3 * h)):
            body = ctes(panel=PANEL[n], pos=POSITIONS) + SCALE.format(m=m, hold=hold)
            parts.append(f"SELECT '{n}' AS dataset, '{part}' AS part, unique_id, scale FROM ({body})")
    return " UNION ALL ".join(parts)


def scored_steps(names, seeds=SEEDS, inner_part="dev"):
    """Results, their errors per series, and ``errors`` with inner and outer means."""
    return {
        "results": stacked_results(names, seeds), "scales": stacked_scales(names),
        # Runs with both stages only: small panels have methods without any inner test series.
        "named": "SELECT * REPLACE (regexp_replace(model, '^Auto', '') AS model) FROM results "
                 "SEMI JOIN (SELECT seed, dataset, method FROM results GROUP BY ALL "
                 "HAVING count(DISTINCT stage) = 2) USING (seed, dataset, method)",
        "folds": "SELECT seed, dataset, method, fold, unique_id, model, avg(abs(y - yhat)) AS err "
                 "FROM named WHERE stage = 'inner' GROUP BY ALL",
        "inner_series": f"""
SELECT seed, dataset, method, unique_id, model, any_value(err) / any_value(scale) AS inner_err
FROM (SELECT seed, dataset, method, unique_id, model, avg(err) AS err FROM folds GROUP BY ALL)
JOIN scales USING (dataset, unique_id) WHERE part = '{inner_part}' GROUP BY ALL""",
        "outer_series": """
SELECT seed, dataset, method, unique_id, model, any_value(err) / any_value(scale) AS outer_err
FROM (SELECT seed, dataset, method, unique_id, model, avg(abs(y - yhat)) AS err
      FROM named WHERE stage = 'outer' GROUP BY ALL)
JOIN scales USING (dataset, unique_id) WHERE part = 'in' GROUP BY ALL""",
        "errors": """
SELECT * FROM (SELECT seed, dataset, method, model, avg(inner_err) AS inner_err FROM inner_series
               WHERE model <> 'SeasonalNaive' GROUP BY ALL)
JOIN (SELECT seed, dataset, method, model, avg(outer_err) AS outer_err FROM outer_series
      GROUP BY ALL) USING (seed, dataset, method, model)""",
        "picked": """
SELECT seed, dataset, method,
       arg_min(model, struct_pack(e := inner_err, o := place)) AS selected,
       arg_min(model, struct_pack(e := outer_err, o := place)) AS best,
       arg_min(outer_err, struct_pack(e := inner_err, o := place)) AS selected_error,
       min(outer_err) AS best_error, avg(abs(inner_err - outer_err)) AS mapee,
       avg(inner_err - outer_err) AS mpee
FROM (SELECT *, CASE model WHEN 'NLinear' THEN 6 ELSE 8 END AS place FROM errors) GROUP BY ALL""",
    }
