"""Building blocks of the check queries: the same panels and splits as plain SQL."""

RAW = {
    "user_raw": "SELECT CAST(user_id AS VARCHAR) AS unique_id, ts AS ds, value AS y FROM events",
    "type_raw": "SELECT event_type AS unique_id, ts AS ds, value AS y FROM events",
}


def resampled(raw: str, unit: str) -> str:
    """Mean per series and step, then a dense spine joined back."""
    kind = "DATE" if unit == "day" else "TIMESTAMP"
    return f"""
SELECT s.unique_id, s.ds, m.y
FROM (SELECT unique_id, CAST(unnest(generate_series(
          CAST(date_trunc('{unit}', min(ds)) AS TIMESTAMP),
          CAST(date_trunc('{unit}', max(ds)) AS TIMESTAMP), INTERVAL 1 {unit})) AS {kind}) AS ds
      FROM ({raw}) GROUP BY unique_id) s
LEFT JOIN (SELECT unique_id, CAST(date_trunc('{unit}', ds) AS {kind}) AS ds,
                  round(avg(y), 8) AS y
           FROM ({raw}) GROUP BY 1, 2) m
  ON s.unique_id = m.unique_id AND s.ds = m.ds"""


PANEL = {
    "brand_month": """
SELECT p_brand AS unique_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS y
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "nation_month": """
SELECT CAST(c_nationkey AS VARCHAR) AS unique_id,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "user_day": resampled(RAW["user_raw"], "day"),
    "type_hour": resampled(RAW["type_raw"], "hour"),
}

POSITIONS = """
SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS pos,
       count(*) OVER (PARTITION BY unique_id) AS n FROM panel"""


def ctes(**parts: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in parts.items())


def stacked(names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, unique_id, CAST(ds AS TIMESTAMP) AS ds, y FROM ({PANEL[n]})"
        for n in names)


# -- splits ------------------------------------------------------------------

def ranked(method: str, repeats: int, seed: int, uids: str = "uids") -> str:
    return f"""
SELECT unique_id, fold, count(*) OVER (PARTITION BY fold) AS total,
       row_number() OVER (PARTITION BY fold ORDER BY
           md5('{seed}|{method}|' || fold || '|' || unique_id), unique_id) AS rank
FROM {uids}, (SELECT unnest(range({repeats})) AS fold)"""


def holdout(method: str, share: float, repeats: int, seed: int = 123, uids: str = "uids") -> str:
    return f"""
SELECT '{method}' AS method, CAST(fold AS INTEGER) AS fold, unique_id,
       CASE WHEN rank <= floor(total * CAST({share} AS DOUBLE)) THEN 'train' ELSE 'test' END AS role
FROM ({ranked(method, repeats, seed, uids)})"""


def monte_carlo(method: str, train: float, test: float, repeats: int, seed: int = 123,
                uids: str = "uids") -> str:
    a, b = f"floor(total * CAST({train} AS DOUBLE))", f"floor(total * CAST({test} AS DOUBLE))"
    return f"""
SELECT '{method}' AS method, CAST(fold AS INTEGER) AS fold, unique_id,
       CASE WHEN rank <= {a} THEN 'train' ELSE 'test' END AS role
FROM ({ranked(method, repeats, seed, uids)}) WHERE rank <= {a} + {b}"""


def bootstrap(method: str, repeats: int, seed: int = 123, uids: str = "uids",
              weights: bool = False) -> str:
    extra = ", CAST(coalesce(weight, 0) AS BIGINT) AS weight" if weights else ""
    slots = f"""(SELECT unique_id, count(*) OVER () AS total, row_number() OVER (
        ORDER BY md5('{seed}|bootstrap|' || unique_id), unique_id) AS slot FROM {uids})"""
    return f"""
SELECT '{method}' AS method, CAST(s.fold AS INTEGER) AS fold, s.unique_id,
       CASE WHEN weight IS NULL THEN 'test' ELSE 'train' END AS role{extra}
FROM (SELECT * FROM {slots}, (SELECT unnest(range({repeats})) AS fold)) s
LEFT JOIN (
  SELECT fold, drawn, count(*) AS weight FROM (
    SELECT fold, CAST('0x' || substr(md5('{seed}|{method}|' || fold || '|' || slot), 1, 15) AS BIGINT)
                 % total + 1 AS drawn
    FROM {slots}, (SELECT unnest(range({repeats})) AS fold))
  GROUP BY 1, 2) d ON s.fold = d.fold AND s.slot = d.drawn"""


def kfold(method: str, k: int, repeats: int = 1, seed: int = 123, uids: str = "uids",
          shuffle: str | None = None) -> str:
    return f"""
SELECT '{method}' AS method, CAST(o.fold * {k} + part AS INTEGER) AS fold, unique_id,
       CASE WHEN own = part THEN 'test' ELSE 'train' END AS role
FROM (SELECT unique_id, fold, ntile({k}) OVER (PARTITION BY fold ORDER BY rank) - 1 AS own
      FROM ({ranked(shuffle or method, repeats, seed, uids)})) o,
     (SELECT unnest(range({k})) AS part)"""


def time_holdout(uids: str = "uids") -> str:
    return f"""SELECT 'TimeHoldout' AS method, 0 AS fold, unique_id, role
FROM {uids}, (SELECT unnest(['train', 'test']) AS role)"""


def split_all(seed: int = 123, uids: str = "uids") -> str:
    return " UNION ALL ".join([
        holdout("Holdout", 0.7, 1, seed, uids),
        holdout("RepeatedHoldout", 0.7, 5, seed, uids),
        monte_carlo("MonteCarlo", 0.5, 0.2, 5, seed, uids),
        bootstrap("Bootstrap", 1, seed, uids),
        bootstrap("RepeatedBootstrap", 5, seed, uids),
        kfold("KFold", 5, 1, seed, uids),
        time_holdout(uids)])


def sampled(share: str, seed: int = 123, uids: str = "uids") -> str:
    """Exact random share of the series, half-even size."""
    return f"""
SELECT unique_id FROM (
  SELECT unique_id, count(*) OVER () AS total, row_number() OVER (
      ORDER BY md5('{seed}|sample|' || unique_id), unique_id) AS rank FROM {uids})
WHERE rank <= round_even(total * CAST({share} AS DOUBLE), 0)"""


UIDS = "SELECT DISTINCT unique_id FROM panel"
