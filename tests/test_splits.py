"""Properties that every split must have, whatever its draws."""

from collections import Counter, defaultdict

import pytest

from panelfold.operators import splits as S
from panelfold.operators.ranks import hash_rank
from panelfold.functions.exprs import hash_text
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def uids(spark):
    return {n: spark.range(n).select(F.concat(F.lit("s_"), F.col("id").cast("string"))
                                     .alias("unique_id")).cache() for n in (13, 100, 150)}


def folds(frame):
    out = defaultdict(lambda: {"train": set(), "test": set()})
    for r in frame.collect():
        role = out[(r.method, r.fold)][r.role]
        assert r.unique_id not in role
        role.add(r.unique_id)
    return out


def test_train_and_test_are_disjoint(uids):
    for (method, _), parts in folds(S.split_all(uids[150])).items():
        if method != "TimeHoldout":
            assert not parts["train"] & parts["test"]
            assert parts["train"] and parts["test"]


def test_holdout_covers_all_and_truncates(uids):
    parts = folds(S.holdout(uids[100], 0.29))[("Holdout", 0)]
    assert len(parts["train"]) == 28 and len(parts["test"]) == 72


def test_repeats_differ(uids):
    parts = folds(S.repeated_holdout(uids[100]))
    assert len({frozenset(p["train"]) for p in parts.values()}) == 5


def test_kfold_sizes_and_coverage(uids):
    parts = folds(S.kfold(uids[13]))
    assert [len(parts[("KFold", f)]["test"]) for f in range(5)] == [3, 3, 3, 2, 2]
    tested = Counter(u for p in parts.values() for u in p["test"])
    assert len(tested) == 13 and set(tested.values()) == {1}
    assert all(len(p["train"]) + len(p["test"]) == 13 for p in parts.values())


def test_repeated_kfold_tests_once_per_repeat(uids):
    parts = folds(S.repeated_kfold(uids[13], 4, 3))
    assert len(parts) == 12
    tested = Counter(u for p in parts.values() for u in p["test"])
    assert set(tested.values()) == {3}


def test_more_folds_than_series(spark):
    few = spark.createDataFrame([("a",), ("b",)], "unique_id string")
    parts = folds(S.kfold(few, 3))
    assert sorted(len(parts[("KFold", f)]["test"]) for f in range(3)) == [0, 1, 1]


def test_ablation_matches_single_kfold(uids):
    several = folds(S.kfold_ablation(uids[100]))
    alone = folds(S.kfold(uids[100], 7))
    assert all(several[("KFold_k7", f)] == alone[("KFold", f)] for f in range(7))
    assert {m for m, _ in several} == {f"KFold_k{k}" for k in (3, 5, 7, 10, 20)}


def test_monte_carlo_sizes(uids):
    for parts in folds(S.monte_carlo(uids[150])).values():
        assert (len(parts["train"]), len(parts["test"])) == (75, 30)
    with pytest.raises(ValueError):
        S.monte_carlo(uids[150], 0.8, 0.2)


def test_bootstrap_weights_add_up(uids):
    rows = S.bootstrap(uids[150], weights=True).collect()
    assert sum(r.weight for r in rows) == 150
    assert all((r.weight == 0) == (r.role == "test") for r in rows)
    assert 0.5 < sum(r.role == "train" for r in rows) / 150 < 0.75
    assert any(r.weight > 1 for r in rows)


def test_seed_changes_the_split(uids):
    assert folds(S.kfold(uids[100], seed=1)) != folds(S.kfold(uids[100], seed=2))
    assert folds(S.kfold(uids[100], seed=1)) == folds(S.kfold(uids[100], seed=1))


def test_registry(uids):
    assert S.split("RepeatedKFold", uids[13]).count() == 13 * 10
    with pytest.raises(ValueError):
        S.split("Nothing", uids[13])
    override = {"KFold": S.Folds(3)}
    assert {f for _, f in folds(S.split("KFold", uids[13], overrides=override))} == {0, 1, 2}


def test_hash_rank_is_the_global_rank(uids):
    digest = hash_text(F.lit("x"), F.col("unique_id"))
    rows = hash_rank(uids[150], digest).withColumn("d", digest).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: r.d)] == list(range(1, 151))
    assert {r.total for r in rows} == {150}
