"""Splits, samples, scaling, padding, classifiers."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.operators import encode as n
from slotwise.operators import model as m
from slotwise.operators.logistic import fit_logistic, newton_sums
from slotwise.operators.evaluate import roc_auc
from slotwise.plans.learning import supervised_set
from tests.helpers import at, rows_of


def series(spark, lengths, seed=0):
    rng = np.random.default_rng(seed)
    rows = [
        (id, at(6 * k), float(rng.normal(3, 2)), 5.0, int(rng.random() < 0.4))
        for id, length in enumerate(lengths)
        for k in range(length)
    ]
    return spark.createDataFrame(rows, "id bigint, slot timestamp_ntz, a double, b double, y int")


def test_no_entity_in_two_splits_and_shares_hold(spark):
    ids = spark.range(20000).unionByName(spark.range(20000))
    split = n.split_by_id(ids, "id")
    assert split.distinct().count() == 20000
    share = {r.split: r["count"] / 40000 for r in split.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["val"] - 0.1) < 0.02
    moved = split.join(n.split_by_id(ids, "id", seed=1).withColumnRenamed("split", "s2"), "id")
    assert moved.filter("split <> s2").count() > 0


def test_undersample_takes_exactly_n(spark):
    rows = spark.range(5000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    out = n.undersample(rows, "y", 1000, ["id"])
    assert out.filter("y = 1").count() == 500
    assert out.filter("y = 0").count() == 1000 and out.distinct().count() == 1500
    again = n.undersample(rows.repartition(11), "y", 1000, ["id"])
    assert again.exceptAll(out).count() == 0
    assert n.undersample(rows, "y", 10**6, ["id"]).count() == 5000
    assert n.undersample(rows, "y", 0, ["id"]).count() == 500
    share = n.undersample_fraction(rows, "y", 0.1, ["id"]).filter("y = 0").count()
    assert 350 < share < 550


def test_shuffle_changes_order_only(spark):
    rows = spark.range(100)
    shuffled = [r.id for r in n.shuffle_rows(rows, ["id"]).collect()]
    assert sorted(shuffled) == list(range(100)) and shuffled != list(range(100))
    assert shuffled == [r.id for r in n.shuffle_rows(rows.repartition(5), ["id"]).collect()]


def dense(df, maxlen, cols):
    """The padded tensor, built plainly."""
    frame = df.toPandas().sort_values(["id", "slot"])
    out = np.zeros((frame.id.nunique(), maxlen, len(cols)))
    for i, (_, part) in enumerate(frame.groupby("id")):
        values = part[cols].to_numpy()[-maxlen:]
        out[i, maxlen - len(values) :] = values
    return out


def test_padding_keeps_the_last_steps(spark):
    df = series(spark, [3, 7, 5])
    padded = n.pad_sequences(df, "id", "slot", ["a", "b"], 5, "y").orderBy("id").collect()
    assert np.allclose([r.features for r in padded], dense(df, 5, ["a", "b"]))
    assert np.array_equal([r.labels for r in padded], dense(df, 5, ["y"])[:, :, 0])
    assert [r.n_steps for r in padded] == [3, 5, 5]


def test_scaler_equals_moments_of_the_padded_tensor(spark):
    df = series(spark, [3, 7, 5])
    flat = dense(df, 7, ["a", "b"]).reshape(-1, 2)
    stats = {r.feature: (r["mean"], r["scale"]) for r in n.fit_scaler(df, ["a", "b"], "id").collect()}
    for i, c in enumerate(["a", "b"]):
        assert np.allclose(stats[c], (flat[:, i].mean(), flat[:, i].std()))
    plain = n.fit_scaler(df, ["a", "b"], "id", include_padding=False)
    stats = {r.feature: (r["mean"], r["scale"]) for r in plain.collect()}
    assert stats["b"] == (5.0, 1.0)  # constant: centred, divided by one
    real = np.array([r.a for r in df.collect()])
    assert np.allclose(stats["a"], (real.mean(), real.std()))


def test_supervised_set_equals_padding_then_scaling(spark):
    df = series(spark, [12, 20, 9, 15, 30, 11, 14, 10, 25, 13, 18, 16])
    data = supervised_set(df, "id", "slot", "y", ["a", "b"])
    assert data.maxlen == data.split("train").groupBy("id").count().agg({"count": "max"}).first()[0]
    raw = df.join(data.rows.select("id", "slot", "split"), ["id", "slot"])
    train = dense(raw.filter("split = 'train'"), data.maxlen, ["a", "b"])
    flat = train.reshape(-1, 2)
    want = (train - flat.mean(0)) / np.where(flat.std(0) > 0, flat.std(0), 1)
    got = [r.features for r in data.sequences("train").orderBy("id").collect()]
    assert np.allclose(got, want)
    pairs = data.sequences("train").select(F.explode("labels").alias("p"))
    assert pairs.filter("p[0] + p[1] <> 1").count() == 0
    # the last eight steps of every series have no label
    assert data.rows.count() == sum(k - 8 for k in [12, 20, 9, 15, 30, 11, 14, 10, 25, 13, 18, 16])


def test_label_pairs(spark):
    rows = spark.createDataFrame([(0, [0, 1])], "y int, ys array<int>")
    out = rows.select(n.one_hot_label("y").alias("a"), n.one_hot_labels("ys").alias("b"))
    assert rows_of(out) == [([1, 0], [[1, 0], [0, 1]])]


def test_encoded_names_with_dots_and_spaces(spark):
    df = series(spark, [14, 16, 12, 13, 20, 15, 11, 18]).withColumnsRenamed(
        {"a": "type_EW EMER.", "b": "race_A/B C"}
    )
    data = supervised_set(df, "id", "slot", "y", weights={"train": 0.6, "val": 0.4})
    assert data.features == ["race_A/B C", "type_EW EMER."]
    assert data.sequences("train").count() > 0
    train = data.split("train").withColumn("y", (F.col("id") % 2).cast("int"))
    model = m.fit_step_classifier(train, data.features, "y", hidden=2, max_iter=2)
    assert m.score(model, train).filter("p is null").count() == 0
    near = m.fit_neighbour_classifier(train, "id", "slot", data.features, "y", max_iter=2)
    assert near is not None
    counted = n.undersample(train, "y", 3, ["id", "slot"])
    assert counted.filter("y = 0").count() == 3


def separable(spark):
    rng = np.random.default_rng(5)
    rows = []
    for id in range(40):
        for k in range(12):
            x = float(rng.normal())
            rows.append((id, at(6 * k), x, float(rng.normal()), int(x + 0.2 * rng.normal() > 0)))
    return spark.createDataFrame(rows, "id bigint, slot timestamp_ntz, a double, b double, y int")


def test_classifiers_rank_a_separable_set(spark, tmp_path):
    df = n.split_by_id(separable(spark), "id", {"train": 0.7, "val": 0.3})
    train, val = n.get_split(df, "train").cache(), n.get_split(df, "val").cache()
    models = {
        "good": m.fit_step_classifier(train, ["a", "b"], "y", hidden=4, max_iter=30),
        "blind": m.fit_step_classifier(train, ["b"], "y", hidden=None, max_iter=10),
    }
    best, areas = m.select_by_auc(models, val, "y", str(tmp_path / "best"))
    assert best == "good" and areas["good"] > 0.9
    again = m.score(m.load_model(spark, str(tmp_path / "best"), False), val).orderBy("id", "slot").collect()
    assert again == m.score(models["good"], val).orderBy("id", "slot").collect()
    wide = m.neighbour_features(val, "id", "slot", ["a", "b"])
    near = m.fit_neighbour_classifier(train, "id", "slot", ["a", "b"], "y", max_iter=20)
    assert roc_auc(m.score(near, wide), "y", "p").first().roc_auc > 0.9


def test_the_whole_way_flags_all_five_treatments(spark):
    from slotwise.plans import inputs as src
    from slotwise.plans.catalog.learning import flagged_stays

    folder = "/root/testdata/sf0.001"
    flagged = flagged_stays(spark, folder)
    assert {"ventilation", "sedative", "vasopressor", "rrt", "crrt"} <= set(flagged.columns)
    rows = flagged.select("stay_id", "charttime", "vasopressor", "crrt").collect()
    for at_, table in ((2, src.vasopressors(spark, folder)), (3, src.continuous_renal(spark, folder))):
        own = {}
        for i, start, end in table.select("stay_id", "starttime", "endtime").collect():
            own.setdefault(i, []).append((start, end))
        for row in rows:
            slot = row.charttime
            last = slot + timedelta(hours=6) - timedelta(seconds=1)
            want = any(a <= slot <= b or slot <= a <= last or slot <= b <= last for a, b in own.get(row.stay_id, []))
            assert row[at_] == int(want)
        assert 0 < sum(r[at_] for r in rows) < len(rows)


def gradient_in_sql(rows, model, label, l2):
    """Largest gradient component of the loss at the model's weights, computed by DuckDB."""
    import duckdb

    con = duckdb.connect()
    con.register("rows", rows)
    x = "[1.0::DOUBLE, " + ", ".join(f'"{c}"' for c in model.features) + "]"
    parts = con.execute(
        f"""WITH s AS (SELECT {x} AS x, {label} AS y, 1 / (1 + exp(-list_dot_product(?::DOUBLE[], {x}))) AS p FROM rows)
        SELECT {", ".join(f"sum((p - y) * x[{i + 1}])" for i in range(len(model.weights)))} FROM s""",
        [model.weights],
    ).fetchone()
    return max(abs(g + (l2 * w if i else 0)) for i, (g, w) in enumerate(zip(parts, model.weights)))


@pytest.mark.parametrize("l2", [0.0, 1.0, 25.0])
def test_gradient_vanishes_at_the_fitted_weights(spark, l2):
    rng = np.random.default_rng(9)
    rows = [(int(i), *map(float, x), int(x[0] - x[1] * x[2] + 1.5 * rng.normal() > 0.4)) for i, x in enumerate(rng.normal(size=(3000, 4)) * [1, 30, 0.1, 5])]
    df = spark.createDataFrame(rows, "id bigint, `a.b` double, b double, c double, d double, y int").repartition(7).cache()
    model = fit_logistic(df, ["a.b", "b", "c", "d"], "y", l2)
    assert gradient_in_sql(df.toPandas(), model, "y", l2) < 1e-6 and model.gradient < 1e-9
    assert model.steps < 30
    again = fit_logistic(df.repartition(3), ["a.b", "b", "c", "d"], "y", l2)
    assert np.allclose(model.weights, again.weights, rtol=1e-9)


def test_logistic_edges(spark, tmp_path):
    empty = spark.createDataFrame([], "a double, y int")
    assert fit_logistic(empty, ["a"], "y").weights == [0.0, 0.0]
    same = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 2.0, 0), (3.0, 3.0, 1)] * 5, "a double, b double, y int")
    twin = fit_logistic(same, ["a", "b"], "y", l2=0.0)  # equal columns share the weight
    assert abs(twin.weights[1] - twin.weights[2]) < 1e-9
    with pytest.raises(Exception, match="must not be null"):
        fit_logistic(spark.createDataFrame([(None, 1), (1.0, 0)], "a double, y int"), ["a"], "y")
    m.save_model(spark, twin, str(tmp_path / "w"))
    assert m.load_model(spark, str(tmp_path / "w"), True) == twin
    apart = fit_logistic(spark.createDataFrame([(float(i), int(i > 5)) for i in range(10)], "a double, y int"), ["a"], "y", l2=0.0, max_iter=8)
    assert apart.steps <= 8 and apart.weights[1] > 0


def test_one_pass_sends_sums_only(spark):
    df = spark.range(100_000).selectExpr("rand(1) as a", "cast(rand(2) > 0.5 as int) as y")
    sums = newton_sums(df, ["a"], "y", np.zeros(2), 0.0)
    assert sums.rows == 100_000 and sums.gram.shape == (2, 2) and abs(sums.loss - 100_000 * np.log(2)) < 1e-6


def test_undersample_takes_the_smallest_hashes(spark):
    rows = spark.range(5000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    for fn in ("xxhash64", "multiplicative"):
        taken = n.undersample(rows, "y", 700, ["id"], fn=fn).filter("y = 0")
        hashed = rows.filter("y = 0").withColumn("h", n.row_hash(["id"], 42, fn)).orderBy("h", "id").limit(700)
        assert {r["id"] for r in taken.collect()} == {r["id"] for r in hashed.collect()}


def test_too_many_categories_are_an_error(spark):
    rows = spark.range(50).selectExpr("cast(id as string) as free")
    with pytest.raises(ValueError, match="one_hot_rows"):
        n.find_categories(rows, ["free"], most=49)
    assert len(n.find_categories(rows, ["free"], most=50)["free"]) == 50


def test_harmonized_names_occur_once(spark):
    from slotwise.operators.cleaning import harmonize_columns

    both = spark.createDataFrame([(1, 2)], "old int, new int")
    with pytest.raises(ValueError, match="new"):
        harmonize_columns(both, {"old": "new"})
    assert harmonize_columns(both, {"old": "third", "absent": "new"}).columns == ["third", "new"]
