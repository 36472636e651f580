"""Series-wise and time-wise cross-validation splits as assignment tables.

A scheme maps the series of a panel to rows ``(method, fold, unique_id, role)``
with role ``train`` or ``test``. All folds of all schemes (and seeds) come out
of one plan: draws are exploded from a constant list, never crossed with the
data, and ranked in one shuffle. Each random draw is a function of
``(seed, method, fold, series)``, so a lost executor recomputes the same split.

The digits of the draws differ from other random generators; sizes,
disjointness and coverage are what is guaranteed.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import hash_number, hash_text, inline_rows
from ..schema import (HOLDOUT_TRAIN, ID, KFOLD_REPEATS, KFOLD_SIZES, MONTE_CARLO_TEST,
                      MONTE_CARLO_TRAIN, N_FOLDS, SEED, TIME_METHOD)
from .ranks import hash_rank


@dataclass(frozen=True)
class Shares:
    """Train on a share of the series, test on a share (or all) of the others."""

    train: float
    test: float | None = None
    repeats: int = 1

    def __post_init__(self):
        if self.test is not None and self.train + self.test >= 1.0:
            raise ValueError("train and test shares must stay below 1")


@dataclass(frozen=True)
class Folds:
    """Shuffled k folds, each tested once per repeat; fold = repeat * k + part.

    ``shuffle`` names the shuffle, so schemes may share one; the method by default.
    """

    k: int
    repeats: int = 1
    shuffle: str | None = None


@dataclass(frozen=True)
class Bootstrap:
    """Draw n of n series with replacement; series never drawn are the test set."""

    repeats: int = 1


@dataclass(frozen=True)
class EverySeries:
    """No split across series: every series trains and is tested, fold 0."""


Scheme = Shares | Folds | Bootstrap | EverySeries

# The default experiment: method name -> scheme.
CV_METHODS: dict[str, Scheme] = {
    "Holdout": Shares(HOLDOUT_TRAIN),
    "RepeatedHoldout": Shares(HOLDOUT_TRAIN, repeats=N_FOLDS),
    "MonteCarlo": Shares(MONTE_CARLO_TRAIN, MONTE_CARLO_TEST, N_FOLDS),
    "Bootstrap": Bootstrap(),
    "RepeatedBootstrap": Bootstrap(N_FOLDS),
    "KFold": Folds(N_FOLDS),
}
# Offered, but not part of the default experiment.
OPTIONAL_METHODS: dict[str, Scheme] = {"RepeatedKFold": Folds(N_FOLDS, KFOLD_REPEATS)}
ALL_METHODS = {**CV_METHODS, TIME_METHOD: EverySeries()}


def assign(series: DataFrame, schemes: dict[str, Scheme], seed: int | None = SEED) -> DataFrame:
    """Assignment table of all ``schemes`` at once.

    With ``seed=None`` the frame has distinct rows ``(seed, unique_id)`` and
    every seed is split on its own; the result then keeps that column.
    """
    keys = ["seed"] if seed is None else []
    if seed is None:
        uids = series.select("seed", ID)
    else:
        uids = series.select(ID).distinct().withColumn("seed", F.lit(seed))
    of_kind = {kind: {m: s for m, s in schemes.items() if isinstance(s, kind)}
               for kind in (Shares, Folds, Bootstrap, EverySeries)}
    parts = []
    if of_kind[Shares] or of_kind[Folds]:
        parts.append(_ranked_roles(uids, of_kind[Shares], of_kind[Folds]))
    if of_kind[Bootstrap]:
        parts.append(_bootstrap_roles(uids, of_kind[Bootstrap]).drop("weight"))
    if of_kind[EverySeries]:
        both = [(m, 0, role) for m in of_kind[EverySeries] for role in ("train", "test")]
        parts.append(uids.select("seed", ID, inline_rows(both, ["method", "fold", "role"])))
    return reduce(DataFrame.unionByName, [
        p.select(*keys, "method", "fold", ID, "role") for p in parts])


def _share_size(share: Column) -> Column:
    """Truncated share of the series, in double arithmetic."""
    return F.floor(F.col("total") * share)


def _own_fold(rank: Column, total: Column, k: Column) -> Column:
    """Fold of a 1-based rank when k folds share ``total`` series, larger folds first."""
    small = F.floor(total / k)
    larger = total - small * k
    in_larger = rank <= larger * (small + 1)
    # ``greatest`` keeps the unused branch from dividing by zero when total < k.
    return F.when(in_larger, F.floor((rank - 1) / (small + 1))).otherwise(
        larger + F.floor((rank - 1 - larger * (small + 1)) / F.greatest(small, F.lit(1))))


def _ranked_roles(uids: DataFrame, shares: dict[str, Shares], folds: dict[str, Folds]) -> DataFrame:
    """Roles that follow from the place of a series in a random order."""
    shuffles: dict[str, int] = {}
    specs = []
    for method, s in shares.items():
        shuffles[method] = max(shuffles.get(method, 0), s.repeats)
        specs.append((method, method, s.repeats, s.train, s.test if s.test is not None else 1.0, 0))
    for method, s in folds.items():
        shuffle = s.shuffle or method
        shuffles[shuffle] = max(shuffles.get(shuffle, 0), s.repeats)
        specs.append((method, shuffle, s.repeats, 0.0, 0.0, s.k))
    draws = [(shuffle, r) for shuffle, n in shuffles.items() for r in range(n)]
    drawn = uids.select("seed", ID, inline_rows(draws, ["shuffle", "repeat"]))
    digest = hash_text(F.col("seed"), F.col("shuffle"), F.col("repeat"), F.col(ID))
    ranked = hash_rank(drawn, digest, ["seed", "shuffle", "repeat"])
    # A draw meets its own schemes only.
    def scheme(method, train, test, k):
        return F.struct(F.lit(method).alias("method"), F.lit(float(train)).alias("train"),
                        F.lit(float(test)).alias("test"), F.lit(int(k)).alias("k"))

    own = F.create_map(*[c for shuffle, r in draws for c in (F.lit(f"{shuffle}|{r}"), F.array(*[
        scheme(m, train, test, k) for m, of, repeats, train, test, k in specs
        if of == shuffle and r < repeats]))])
    each = ranked.select("*", F.inline(F.element_at(own, F.concat_ws("|", "shuffle", "repeat"))))
    rank, k = F.col("rank"), F.col("k")
    trained = _share_size(F.col("train"))
    # A test share of 1 stands for all the others.
    used = F.when(F.col("test") < 1, trained + _share_size(F.col("test"))).otherwise(F.col("total"))
    by_share = F.when(rank <= used, F.array(F.struct(
        F.col("repeat").alias("fold"),
        F.when(rank <= trained, "train").otherwise("test").alias("role"))))
    # One row per fold: the own fold tests the series, every other one trains on it.
    by_fold = F.transform(F.sequence(F.lit(0), k - 1), lambda part: F.struct(
        (F.col("repeat") * k + part).alias("fold"),
        F.when(part == F.col("own"), "test").otherwise("train").alias("role")))
    each = each.withColumn("own", F.when(k > 0, _own_fold(rank, F.col("total"), k)))
    return each.select("seed", "method", ID, F.inline(F.when(k > 0, by_fold).otherwise(by_share)))


def _bootstrap_roles(uids: DataFrame, schemes: dict[str, Bootstrap]) -> DataFrame:
    """A series drawn at least once trains; ``weight`` counts its draws."""
    ranked = hash_rank(uids, hash_text(F.col("seed"), F.lit("bootstrap"), F.col(ID)), ["seed"])
    draws = [(m, r) for m, s in schemes.items() for r in range(s.repeats)]
    slots = ranked.select("seed", ID, F.col("rank").alias("slot"), "total",
                          inline_rows(draws, ["method", "fold"]))
    # Every slot also makes one draw, so n never has to reach the driver.
    digest = hash_text(F.col("seed"), F.col("method"), F.col("fold"), F.col("slot"))
    hits = (slots.select("seed", "method", "fold",
                         (hash_number(digest) % F.col("total") + 1).alias("slot"))
            .groupBy("seed", "method", "fold", "slot").agg(F.count(F.lit(1)).alias("weight")))
    rows = slots.join(hits, ["seed", "method", "fold", "slot"], "left")
    return rows.select(
        "seed", "method", "fold", ID,
        F.when(F.col("weight").isNull(), "test").otherwise("train").alias("role"),
        F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))


# -- single methods -----------------------------------------------------------

def holdout(panel: DataFrame, train_size: float = HOLDOUT_TRAIN, seed: int = SEED,
            method: str = "Holdout") -> DataFrame:
    """Train on a share of the series drawn without replacement, test on the rest."""
    return assign(panel, {method: Shares(train_size)}, seed)


def repeated_holdout(panel: DataFrame, train_size: float = HOLDOUT_TRAIN,
                     n_repeats: int = N_FOLDS, seed: int = SEED,
                     method: str = "RepeatedHoldout") -> DataFrame:
    """Independent holdout draws, one per fold."""
    return assign(panel, {method: Shares(train_size, repeats=n_repeats)}, seed)


def monte_carlo(panel: DataFrame, train_size: float = MONTE_CARLO_TRAIN,
                test_size: float = MONTE_CARLO_TEST, n_repeats: int = N_FOLDS,
                seed: int = SEED, method: str = "MonteCarlo") -> DataFrame:
    """Disjoint train and test draws of fixed sizes; the other series stay unused."""
    return assign(panel, {method: Shares(train_size, test_size, n_repeats)}, seed)


def bootstrap(panel: DataFrame, n_repeats: int = 1, seed: int = SEED,
              method: str = "Bootstrap", weights: bool = False) -> DataFrame:
    """Out-of-bag split. A series drawn twice trains once by default;
    ``weights=True`` adds how often it was drawn (0 for test series)."""
    if not weights:
        return assign(panel, {method: Bootstrap(n_repeats)}, seed)
    uids = panel.select(ID).distinct().withColumn("seed", F.lit(seed))
    return _bootstrap_roles(uids, {method: Bootstrap(n_repeats)}).drop("seed")


def repeated_bootstrap(panel: DataFrame, n_repeats: int = N_FOLDS, seed: int = SEED,
                       method: str = "RepeatedBootstrap", weights: bool = False) -> DataFrame:
    """Independent bootstrap draws, one per fold."""
    return bootstrap(panel, n_repeats, seed, method, weights)


def kfold(panel: DataFrame, n_splits: int = N_FOLDS, seed: int = SEED,
          method: str = "KFold") -> DataFrame:
    """Shuffled k folds: each series is tested exactly once."""
    return assign(panel, {method: Folds(n_splits)}, seed)


def repeated_kfold(panel: DataFrame, n_splits: int = N_FOLDS, n_repeats: int = KFOLD_REPEATS,
                   seed: int = SEED, method: str = "RepeatedKFold") -> DataFrame:
    """k folds under several shuffles."""
    return assign(panel, {method: Folds(n_splits, n_repeats)}, seed)


def kfold_sizes(sizes: list[int] | None = None) -> dict[str, Scheme]:
    """Schemes ``KFold_k<k>`` for several k over one shuffle."""
    return {f"KFold_k{k}": Folds(k, shuffle="KFold") for k in sizes or KFOLD_SIZES}


def kfold_ablation(panel: DataFrame, sizes: list[int] | None = None,
                   seed: int = SEED) -> DataFrame:
    """k-fold for several k at once; the series are ranked once for all of them."""
    return assign(panel, kfold_sizes(sizes), seed)


def time_holdout(panel: DataFrame, method: str = TIME_METHOD) -> DataFrame:
    """Every series trains and is tested; only time separates the two."""
    return assign(panel, {method: EverySeries()})


def anti_complement(panel: DataFrame, train: DataFrame) -> DataFrame:
    """Series outside a training set."""
    return panel.select(ID).distinct().join(train.select(ID), ID, "left_anti")


# -- registry -----------------------------------------------------------------

def split(method: str, panel: DataFrame, seed: int = SEED,
          overrides: dict[str, Scheme] | None = None) -> DataFrame:
    """Assignment table of one registered method."""
    registry = overrides if overrides is not None else {**ALL_METHODS, **OPTIONAL_METHODS}
    if method not in registry:
        raise ValueError(f"unknown method {method!r}; known: {sorted(registry)}")
    return assign(panel, {method: registry[method]}, seed)


def split_all(panel: DataFrame, seed: int | None = SEED,
              overrides: dict[str, Scheme] | None = None) -> DataFrame:
    """Assignments of every default method and the time holdout."""
    return assign(panel, overrides if overrides is not None else ALL_METHODS, seed)


def split_counts(assignments: DataFrame) -> DataFrame:
    """Number of splits per method, and series per role over all its folds."""
    per_fold = assignments.groupBy("method", "fold").agg(
        F.count_if(F.col("role") == "train").alias("train"),
        F.count_if(F.col("role") == "test").alias("test"))
    return per_fold.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_splits"),
        F.sum("train").alias("n_train"), F.sum("test").alias("n_test"))
