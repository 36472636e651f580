"""Global linear forecasters fitted by Spark aggregation.

A global model is fitted on all windows of all training series. For linear
models the fit only needs sums of products, and sums add up over series. So the
sums are taken once per (series, features, lead); every fold of every method is
then a sum over its training series. Folds cost work in the number of series,
not in the number of rows, and all of them come out of one job.

Two families fill the linear slots. With ``last`` = y(t), ``s_j`` the value j
seasons back in the phase of the lead, and ``tr_w`` the mean of the last w rows:

* ``NLinear``: y(t+k) - last on the mean of s_1..s_J minus last
  (features ``season1``, ``season2`` for an input of one or two seasons)
* ``DLinear``: y(t+k) - tr_w on the remainders last - tr_w and s_1 - tr_w
  (features ``trend11``, ``trend25``)

All values are differences within a series, which keeps the sums
well-conditioned. A ``standard`` scaler divides a series by its standard
deviation before the sums and multiplies forecasts back.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..schema import ID, POS, SIZE, STEP_SIZE, TARGET
from ..session import materialize
from .origins import GRID, at, origins, season_position, with_leads
from .positions import neighbours

# Moving-average windows of the trend features.
TREND_WINDOWS = (11, 25)
SEASON_FEATURES = ("season1", "season2")
TREND_FEATURES = tuple(f"trend{w}" for w in TREND_WINDOWS)
FEATURES = SEASON_FEATURES + TREND_FEATURES
SCALERS = ("none", "standard")

# A fold with fewer windows than this is added up, not left over from a subtraction.
FEW_WINDOWS = 64

SUMS = ["cnt", "s1", "s2", "sz", "s11", "s12", "s22", "s1z", "s2z"]


def with_trends(positioned: DataFrame, freq: str | None = None,
                windows: tuple[int, ...] = TREND_WINDOWS) -> DataFrame:
    """Add ``tr<w>``: mean of the last w rows, null before the w-th row."""
    near = neighbours(positioned, freq, before=max(windows) - 1)
    rows = near.rows
    for w in windows:
        mean = F.avg(TARGET).over(near.window.rowsBetween(-(w - 1), 0))
        rows = rows.withColumn(f"tr{w}", F.when(F.col(POS) >= w, mean))
    return near.only_core(rows)


def lag_features(positioned: DataFrame, lags: int, freq: str | None = None) -> DataFrame:
    """Add ``lags``: the last values up to each row, for rows that have all of them."""
    near = neighbours(positioned, freq, before=lags - 1)
    history = F.collect_list(F.struct(TARGET)).over(near.window.rowsBetween(-(lags - 1), 0))
    rows = near.only_core(near.rows.withColumn("lags", history.getField(TARGET)))
    return rows.filter(F.size("lags") == lags)


def _looked_up(season: int, features: tuple[str, ...]) -> list[str]:
    """The values behind all feature sets, looked up once per (origin, lead)."""
    return [f"{at('c', TARGET)} as _last",
            *[f"{at(season_position(season, j), TARGET)} as _back{j}" for j in (1, 2)],
            *[f"{at('c', name.replace('trend', 'tr'))} as _{name}"
              for name in features if name in TREND_FEATURES]]


def _regressors(name: str) -> dict[str, str]:
    """``x1``, ``x2`` and ``z`` (target less base) of a feature set, and its ``base``."""
    if name == "season1":
        x1, x2, base = "_back1 - _last", "0D", "_last"
    elif name == "season2":
        x1, x2, base = "(_back1 + _back2) / 2 - _last", "0D", "_last"
    else:
        x1, x2, base = f"_last - _{name}", f"_back1 - _{name}", f"_{name}"
    return {"x1": x1, "x2": x2, "z": f"target - {base}", "base": base}


def _products(name: str) -> dict[str, str]:
    """The sums that a feature set needs; those with its missing second regressor are zero."""
    products = {"cnt": "if({f}_z is null, null, 1D)", "s1": "{f}_x1", "sz": "{f}_z", "s11": "{f}_x1 * {f}_x1",
                "s1z": "{f}_x1 * {f}_z", "s2": "{f}_x2", "s12": "{f}_x1 * {f}_x2",
                "s22": "{f}_x2 * {f}_x2", "s2z": "{f}_x2 * {f}_z"}
    return {k: v for k, v in products.items() if name in TREND_FEATURES or "2" not in k}


def _with_features(rows: DataFrame, season: int, features: tuple[str, ...],
                   keep: list[str]) -> DataFrame:
    """Regressors ``x1``, ``x2`` and ``base`` of every feature set at each lead."""
    values = rows.selectExpr(*keep, *_looked_up(season, features))

    def row(name: str) -> str:
        parts = ", ".join(f"'{k}', {v}" for k, v in _regressors(name).items() if k != "z")
        return f"named_struct('features', '{name}', {parts})"

    names = [c.rsplit(" as ", 1)[-1] for c in keep]
    return values.selectExpr(*names, f"inline(array({', '.join(row(n) for n in features)}))")


def training_windows(positioned: DataFrame, horizon: int, before: int, hold: int,
                     freq: str | None, extra: list[str] | None = None) -> DataFrame:
    """One row per (series, origin ``c``, lead) whose target a fit may see.

    ``points`` holds the rows around the origin as one array per series, or per
    block of a long series: a fixed number of rows plus its edge copies. Targets
    lie up to ``horizon`` rows ahead, and never in the last ``hold`` rows.
    """
    near = neighbours(positioned, freq, before=before, after=horizon)
    core = F.when(near.core, F.col(POS))
    # Grouping by the window keys alone keeps the partitioning of the windows.
    blocks = near.rows.groupBy(*near.keys).agg(
        F.max(SIZE).alias(SIZE), F.min(core).alias("_from"), F.max(core).alias("_upto"),
        F.sort_array(F.collect_list(F.struct(POS, TARGET, *(extra or [])))).alias("points"))
    return (
        blocks.withColumn("c", F.expr("explode(sequence(_from, _upto))"))
        .withColumn("lead", F.expr(f"explode(sequence(1, {horizon}))"))
        .filter(f"c + lead <= {SIZE} - {hold}")
        .withColumn("target", F.expr(at("c + lead", TARGET)))
        .filter("target is not null"))


def training_sums(trended: DataFrame, horizon: int, season: int, stages: dict[str, int],
                  freq: str | None = None,
                  features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Sums of products per (series, features, lead, stage).

    ``stages`` names how many final rows of each series a fit must not see: a
    window counts for a stage only if its target lies before them. The bounds cut
    a series into disjoint slices; a window adds to the sums of its slice only, with
    the products of all feature sets side by side, and a stage is the sum of the
    slices before its bound.
    """
    rows = training_windows(trended, horizon, 2 * season, min(stages.values()), freq,
                            [f"tr{w}" for w in TREND_WINDOWS])
    slices = sorted(set(stages.values()))
    unseen = f"{SIZE} - c - lead"
    slice_of = "case " + " ".join(f"when {unseen} >= {hold} then {k}" for k, hold in
                                  sorted(enumerate(slices), reverse=True)) + " end"
    values = rows.selectExpr(ID, "lead", f"{slice_of} as slice", "target", *_looked_up(season, features))
    wide = values.selectExpr(ID, "lead", "slice", *[
        f"{part} as {name}_{column}" for name in features for column, part in _regressors(name).items()])
    whole = wide.selectExpr(ID, "lead", "slice", *[
        f"if({name}_x1 + {name}_x2 + {name}_z is null, null, {name}_{x}) as {name}_{x}"
        for name in features for x in ("x1", "x2", "z")])
    sums = whole.groupBy(ID, "lead", "slice").agg(*[
        F.expr(f"sum({product.format(f=name)}) as {name}_{total}")
        for name in features for total, product in _products(name).items()])
    # A slice's sums go to the stages that see it: a few rows per series and lead.
    seen = "case slice " + " ".join(
        f"when {k} then array({', '.join(repr(stage) for stage, bound in stages.items() if bound <= hold)})"
        for k, hold in enumerate(slices)) + " end"
    per_feature = ", ".join(
        f"named_struct('features', '{name}', " + ", ".join(
            f"'{total}', " + (f"{name}_{total}" if total in _products(name) else "0D") for total in SUMS) + ")"
        for name in features)
    rows = sums.selectExpr(ID, "lead", f"{seen} as _stages", f"inline(array({per_feature}))")
    return (rows.filter("cnt > 0").withColumn("stage", F.explode("_stages"))
            .groupBy(ID, "features", "lead", "stage").agg(*[F.sum(total).alias(total) for total in SUMS]))


def series_widths(positioned: DataFrame, stages: dict[str, int]) -> DataFrame:
    """One row per series with ``width_<stage>``: its deviation over the rows a stage sees."""
    return positioned.groupBy(ID).agg(*[
        F.expr(f"nullif(stddev_pop(if({POS} <= {SIZE} - {hold}, {TARGET}, null)), 0D)"
               f" as width_{stage}")
        for stage, hold in stages.items()])


def apply_scalers(sums: DataFrame, widths: DataFrame, stages: Iterable[str],
                  scalers: tuple[str, ...] = SCALERS) -> DataFrame:
    """Add ``scaler``: plain sums, and sums of the standardized series.

    Joins on the series alone, as both sides are already partitioned by it.
    """
    width = "case stage " + " ".join(f"when '{s}' then width_{s}" for s in stages) + " end"
    options = ", ".join(
        f"named_struct('scaler', '{s}', '_w', {'1D' if s == 'none' else f'1 / {width}'})"
        for s in scalers)
    rows = sums.join(widths, ID).selectExpr(
        ID, "features", "stage", "lead", *SUMS, f"inline(array({options}))")
    squares = [f"{name} * _w * _w as {name}" for name in SUMS[4:]]
    return rows.filter("_w is not null").selectExpr(
        ID, "features", "scaler", "stage", "lead", "cnt", "s1 * _w as s1", "s2 * _w as s2",
        "sz * _w as sz", *squares)


def fit(sums: DataFrame, train: DataFrame, groups: list[str],
        weight: str | None = None) -> DataFrame:
    """Coefficients per (groups, features, scaler, stage, lead).

    ``train`` lists the training series of every group (a fold of a method), and
    may restrict a group to some stages by an array column ``stages``;
    ``weight`` names its column of multiplicities, if series may count more
    than once. Partial sums per task come before the shuffle, so what travels
    is one row per coefficient and task.
    """
    more = [c for c in ("stages", weight) if c in train.columns]
    joined = sums.join(train.select(*groups, ID, *more), ID)
    if "stages" in more:
        # Not a join key: the sums stay partitioned by series alone.
        joined = joined.filter("array_contains(stages, stage)")
    keys = [*groups, "features", "scaler", "stage", "lead"]
    times = f" * {weight}" if weight else ""
    pooled = joined.groupBy(*keys).agg(*[F.expr(f"sum({n}{times}) as {n}") for n in SUMS])
    return coefficients(pooled, keys)


def fit_folds(sums: DataFrame, assigned: DataFrame, draw: list[str], fold: list[str]) -> DataFrame:
    """Coefficients of every fold of a draw: totals of the draw less what a fold leaves out.

    ``assigned`` has the roles of the series in every fold (``draw`` and ``fold`` columns,
    id, role); train and test series of a fold differ, but in folds over all series. Sums of the whole draw are taken once. A fold that trains on all of them
    needs no more; one that trains on all but its test series subtracts those; only
    where that is not so, or would not be fewer rows, its training series are listed.
    What a subtraction leaves of few windows may be rounding alone, which passes for
    variation: those sums are added up from their training series.
    """
    groups = [*draw, *fold]
    members = assigned.select(*draw, ID).distinct()
    train = F.sum(F.when(F.col("role") == "train", 1).otherwise(0))
    folds = (assigned.groupBy(*groups).agg(train.alias("trained"), (F.count("*") - train).alias("tested"))
             .join(members.groupBy(*draw).agg(F.count("*").alias("all")), draw))
    way = (F.when(F.col("trained") == F.col("all"), "all")
           .when((F.col("trained") + F.col("tested") == F.col("all"))
                 & (F.col("tested") < F.col("trained")), "rest").otherwise("listed"))
    folds = folds.select(*groups, way.alias("way"))
    sign = (F.when((F.col("way") == "listed") & (F.col("role") == "train"), 1)
            .when((F.col("way") == "rest") & (F.col("role") == "test"), -1))
    # One row per fold.
    listed = (assigned.join(F.broadcast(folds), groups).withColumn("_sign", sign).filter("_sign is not null")
              .select(*groups, ID, "_sign"))
    keys = ["features", "scaler", "stage", "lead"]
    totals = sums.join(members, ID).groupBy(*draw, *keys).agg(*[F.sum(n).alias(n) for n in SUMS])
    whole = (folds.filter("way <> 'listed'").join(totals, draw).select(*groups, *keys, *SUMS))
    parts = (sums.join(listed, ID).groupBy(*groups, *keys)
             .agg(*[F.expr(f"sum({n} * _sign) as {n}") for n in SUMS]).select(*groups, *keys, *SUMS))
    # What is left of a subtraction by rounding alone is nothing: no variation must stay none.
    pooled = whole.unionByName(parts).groupBy(*groups, *keys).agg(*[
        F.expr(f"if(abs(sum({n})) <= 1e-12 * sum(abs({n})), 0D, sum({n})) as {n}") for n in SUMS])
    # A number of rows set by folds, feature sets and leads.
    pooled = materialize(pooled.join(F.broadcast(folds), groups).filter("cnt > 0"), "pooled")
    thin = F.col("way").eqNullSafe("rest") & (F.col("cnt") < FEW_WINDOWS)
    again = pooled.filter(thin).select(*groups, *keys)
    trained = (assigned.filter("role = 'train'").select(*groups, ID)
               .join(F.broadcast(again.select(*groups).distinct()), groups, "left_semi"))
    added = (sums.join(F.broadcast(again), keys).join(trained, [*groups, ID])
             .groupBy(*groups, *keys).agg(*[F.sum(n).alias(n) for n in SUMS]))
    return coefficients(pooled.filter(~thin).drop("way").unionByName(added), [*groups, *keys])


def coefficients(pooled: DataFrame, keys: list[str]) -> DataFrame:
    """Solve the normal equations: ``b1``, ``b2`` and intercept ``a``.

    Season features have one regressor, trend features two. Without enough
    variation the coefficients are null, and so are forecasts made with them.
    """
    centred = pooled.selectExpr(
        *keys, "cnt", "s1", "s2", "sz",
        "s11 - s1 * s1 / cnt as c11", "s12 - s1 * s2 / cnt as c12", "s22 - s2 * s2 / cnt as c22",
        "s1z - s1 * sz / cnt as c1z", "s2z - s2 * sz / cnt as c2z")
    single = "features in (" + ", ".join(f"'{name}'" for name in SEASON_FEATURES) + ")"
    det = "nullif(c11 * c22 - c12 * c12, 0D)"
    solved = centred.selectExpr(
        *keys, "cnt", "s1", "s2", "sz",
        f"if({single}, c1z / nullif(c11, 0D), (c22 * c1z - c12 * c2z) / {det}) as b1",
        f"if({single}, 0D, (c11 * c2z - c12 * c1z) / {det}) as b2")
    return solved.selectExpr(
        *keys, "cast(cnt as bigint) as n_windows", "b1", "b2",
        "(sz - b1 * s1 - b2 * s2) / cnt as a")


def forecast_inputs(trended: DataFrame, horizon: int, season: int, test_size: int,
                    step: int = STEP_SIZE, skip_last: int = 0,
                    features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Grid rows with the regressors of every feature set."""
    rows = origins(trended, horizon, test_size, step, history=2 * season, skip_last=skip_last,
                   extra=[f"tr{w}" for w in TREND_WINDOWS])
    return _with_features(with_leads(rows, horizon), season, features, GRID)


def predict(inputs: DataFrame, coefs: DataFrame, widths: DataFrame, stage: str,
            on: list[str]) -> DataFrame:
    """Apply coefficients to forecast inputs; adds ``yhat``.

    ``coefs`` has one row per (``on``, features, scaler, lead): a number of rows
    set by folds, feature sets and leads, so it is broadcast: by that key the inputs
    of all series would meet in as few tasks as there are keys.
    ``widths`` has one row per series and undoes the standard scaler of ``stage``.
    """
    rows = inputs.join(F.broadcast(coefs), [*on, "features", "lead"])
    rows = rows.join(widths.select(ID, F.col(f"width_{stage}").alias("width")), ID)
    yhat = "base + a * if(scaler = 'none', 1D, width) + b1 * x1 + b2 * x2"
    return rows.withColumn("yhat", F.expr(yhat)).drop(
        "x1", "x2", "base", "a", "b1", "b2", "width")


def global_fit_predict(trended: DataFrame, assignments: DataFrame, horizon: int, season: int,
                       freq: str | None = None, features: str = "season1",
                       scaler: str = "none") -> DataFrame:
    """Fit on the train series of each fold, forecast and keep its test series.

    The last ``horizon`` rows of every series are the test window; no fit sees
    them. Only test series are forecast at all.
    """
    stages = {"inner": horizon}
    widths = series_widths(trended, stages)
    sums = apply_scalers(
        training_sums(trended, horizon, season, stages, freq, (features,)), widths, stages,
        (scaler,))
    groups = ["method", "fold"]
    coefs = fit(sums, assignments.filter(F.col("role") == "train"), groups)
    inputs = forecast_inputs(trended, horizon, season, horizon, features=(features,))
    test = assignments.filter(F.col("role") == "test").select(*groups, ID)
    scored = predict(inputs.join(test, ID), coefs.drop("stage", "n_windows"), widths, "inner",
                     groups)
    return scored.select(*groups, *GRID, "yhat")
