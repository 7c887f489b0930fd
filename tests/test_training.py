import dataclasses
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrowatch.operators import boosting, training
from ferrowatch.plans import catalogue

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def samples(make):
    dice = random.Random(3)
    rows = []
    for i in range(600):
        x, y = dice.random(), dice.random()
        label = "low" if x < 0.5 else ("mid" if y < 0.6 else "high")
        rows.append((i, START + timedelta(hours=i), x, y, label))
    return make(rows, "equipment_id int, timestamp timestamp, x double, y double, kind string")


@pytest.fixture(scope="module")
def fitted(samples):
    frame, labels = training.index_label(training.assemble(samples, ["x", "y"]), "kind")
    train, test = training.split(frame)
    return training.train_classifier(train, labels, ["x", "y"], rounds=3, depth=3), train, test


def test_split_is_stable_and_whole(samples):
    train, test = training.split(samples)
    again, _ = training.split(samples.repartition(7, "y"))
    assert train.count() + test.count() == 600
    assert 60 < test.count() < 180
    assert {r[0] for r in train.select("equipment_id").collect()} == {
        r[0] for r in again.select("equipment_id").collect()
    }


def test_labels_by_frequency(samples):
    _, labels = training.index_label(samples, "kind")
    assert labels[0] == "low" and set(labels) == {"low", "mid", "high"}


def test_predictions_are_the_likeliest_class(fitted):
    model, _, test = fitted
    predicted = training.predict(model, test).collect()
    for row in predicted:
        assert sum(row["probabilities"]) == pytest.approx(1)
        assert row["prediction"] == row["probabilities"].index(max(row["probabilities"]))
        assert row["predicted_label"] == model.labels[int(row["prediction"])]
    hits = sum(row["kind"] == row["predicted_label"] for row in predicted)
    assert hits / len(predicted) > 0.9


def test_two_classes(samples):
    two = samples.withColumn("kind", F.when(F.col("x") < 0.4, "a").otherwise("b"))
    frame, labels = training.index_label(training.assemble(two, ["x", "y"]), "kind")
    model = training.train_classifier(frame, labels, ["x", "y"], rounds=2, depth=2)
    assert {node.klass for node in model.nodes} == {0, 1}
    rows = training.predict(model, frame).select("kind", "predicted_label", "probabilities").collect()
    assert all(len(r["probabilities"]) == 2 and sum(r["probabilities"]) == pytest.approx(1) for r in rows)
    # Splits fall on bin borders, so a few rows next to the true border may miss.
    assert sum(r["kind"] == r["predicted_label"] for r in rows) > 0.97 * len(rows)


def test_trees_do_not_depend_on_partitions(samples, monkeypatch):
    frame, labels = training.index_label(training.assemble(samples, ["x", "y"]), "kind")
    expected = training.train_classifier(frame, labels, ["x", "y"], rounds=4, depth=3).nodes
    # Sums of many partitions are added up in tasks first, margins are written every round.
    monkeypatch.setattr(boosting, "FAN_IN", 2)
    monkeypatch.setattr(boosting, "ROUNDS_KEPT", 1)
    monkeypatch.setattr(boosting, "CHUNK", 50)
    monkeypatch.setattr(boosting, "borders", lambda df, n: [np.unique([node.split for node in expected])] * n)
    many = training.train_classifier(frame.repartition(9), labels, ["x", "y"], rounds=4, depth=3).nodes
    one = training.train_classifier(frame.coalesce(1), labels, ["x", "y"], rounds=4, depth=3).nodes
    assert many == one and len(many) > 12


def test_best_split_equals_brute_force():
    random = np.random.default_rng(2)
    for _ in range(50):
        n, features = 40, 3
        bins, first = random.integers(0, 5, (n, features)), random.integers(-8, 8, n) / 8
        second = random.integers(1, 9, n) / 8
        sums = np.zeros((features, boosting.BINS, 2))
        for f in range(features):
            np.add.at(sums[f, :, 0], bins[:, f], first)
            np.add.at(sums[f, :, 1], bins[:, f], second)
        best = (boosting.LEAST_GAIN, None)
        worth = lambda own: first[own].sum() ** 2 / (second[own].sum() + 1)
        for f in range(features):
            for at in range(5):
                left = bins[:, f] <= at
                if min(second[left].sum(), second[~left].sum()) >= 1:
                    gain = worth(left) + worth(~left) - worth(np.ones(n, bool))
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, at))
        found = boosting.best_split(sums)
        assert (found and found[:2]) == best[1]


def test_two_classes_sum_one_tree_a_round(samples, monkeypatch):
    two = samples.withColumn("kind", F.when(F.col("x") < F.col("y"), "a").otherwise("b"))
    frame, labels = training.index_label(training.assemble(two, ["x", "y"]), "kind")
    shapes, summed = [], boosting.Boosting._sums

    def sums(self, grown, nodes):
        found = summed(self, grown, nodes)
        shapes.append(found.shape)
        return found

    monkeypatch.setattr(boosting.Boosting, "_sums", sums)
    nodes = training.train_classifier(frame, labels, ["x", "y"], rounds=2, depth=3).nodes
    assert shapes and all(shape[0] == 1 for shape in shapes)
    first, second = ([n for n in nodes if n.klass == k] for k in (0, 1))
    assert [(*n[:1], *n[2:8]) for n in map(dataclasses.astuple, first)] == [
        (*n[:1], *n[2:8]) for n in map(dataclasses.astuple, second)
    ]
    assert [n.value for n in first] == [-n.value for n in second] and any(n.value for n in first)


def test_nodes_of_rows_equal_a_walk():
    random = np.random.default_rng(4)
    bins = random.integers(0, boosting.BINS, (3, 200)).astype(np.uint8)
    tree = boosting.Tree()
    assert not tree.nodes_of(bins).any()
    for node in (0, 2, 3, 6):
        tree.grow(node, int(random.integers(3)), int(random.integers(10, 50)))
    for row, found in enumerate(tree.nodes_of(bins)):
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] + int(bins[tree.feature[node], row] > tree.bin[node])
        assert found == node


def test_first_round_is_a_newton_step(samples):
    frame, labels = training.index_label(training.assemble(samples, ["x", "y"]), "kind")
    nodes = training.train_classifier(frame, labels, ["x", "y"], rounds=1, depth=1, step=0.5).nodes
    rows = frame.select("label", "x").collect()
    for k in range(3):
        root = next(n for n in nodes if (n.klass, n.node) == (k, 0))
        assert root.feature in (0, 1) and len([n for n in nodes if n.klass == k]) == 3
        if root.feature == 0:
            own = [r for r in rows if r["x"] <= root.split]
            slope = sum(1 / 3 - (r["label"] == k) for r in own)
            leaf = next(n for n in nodes if (n.klass, n.node) == (k, root.left))
            assert leaf.value == pytest.approx(-0.5 * slope / (len(own) * 4 / 9 + 1), rel=1e-4)


def test_walk_of_the_node_table_predicts_the_same(fitted, spark):
    model, train, test = fitted
    frame = train.unionByName(test)
    walked = training.predict_by_nodes(
        model.node_table(spark), frame, ["equipment_id", "timestamp"], model.features, model.labels
    )
    expected = {r["equipment_id"]: r for r in training.predict(model, frame).collect()}
    rows = walked.collect()
    assert len(rows) == len(expected) == 600
    for row in rows:
        own = expected[row["equipment_id"]]
        assert row["probabilities"] == pytest.approx(own["probabilities"], abs=1e-12)
        assert (row["prediction"], row["predicted_label"]) == (own["prediction"], own["predicted_label"])


def test_split_sizes(samples):
    sizes = {r["label"]: (r["train"], r["test"]) for r in training.split_sizes(samples, "kind").collect()}
    train, test = training.split(samples)
    for number, side in enumerate((train, test)):
        counts = {r["kind"]: r["count"] for r in side.groupBy("kind").count().collect()}
        assert {label: own[number] for label, own in sizes.items() if own[number]} == counts


def test_one_class_is_certain(samples):
    one = samples.withColumn("kind", F.lit("only"))
    frame, labels = training.index_label(training.assemble(one, ["x", "y"]), "kind")
    model = training.train_classifier(frame, labels, ["x", "y"], rounds=1, depth=1)
    row = training.predict(model, frame).first()
    assert (row["probabilities"], row["predicted_label"]) == ([1.0], "only")


def test_saved_model_predicts_the_same(fitted, spark, tmp_path, rows_of):
    model, _, test = fitted
    path = str(tmp_path / "model")
    training.save_model(model, spark, path)
    training.save_model(model, spark, path)
    loaded = training.load_model(spark, path)
    columns = ["equipment_id", "probabilities", "prediction"]
    assert rows_of(training.predict(loaded, test), *columns) == rows_of(training.predict(model, test), *columns)


def test_importance_counts_splits(fitted, spark):
    model, _, _ = fitted
    found = training.feature_importance(model, spark, 5).collect()
    assert {r["feature"] for r in found} == {"x", "y"}
    assert sum(r["splits"] for r in found) == sum(node.feature >= 0 for node in model.nodes)


def test_sample_by_key(fitted):
    model, _, test = fitted
    key = test.first()["equipment_id"]
    row = training.score_sample(model, test, {"equipment_id": key}).collect()
    assert len(row) == 1 and row[0]["equipment_id"] == key


def test_report_and_matrix(make, rows_of):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    df = make(pairs, "label string, prediction string")
    report = {r["class"]: r for r in training.classification_report(df).collect()}
    assert (report["a"]["precision"], report["a"]["recall"], report["a"]["support"]) == (0.75, 0.75, 4)
    assert (report["c"]["precision"], report["c"]["recall"], report["c"]["f1"]) == (0.0, 0.0, 0.0)
    assert report["b"]["f1"] == pytest.approx(0.8)
    assert report["accuracy"]["f1"] == pytest.approx(5 / 7)
    assert report["macro avg"]["recall"] == pytest.approx((0.75 + 1 + 0) / 3)
    assert report["weighted avg"]["recall"] == pytest.approx(5 / 7)
    assert rows_of(training.confusion_matrix(df, ["a", "b", "c"])) == [("a", 3, 1, 0), ("b", 0, 2, 0), ("c", 1, 0, 0)]


def test_incomplete_rows_are_not_learned_from(make):
    job = training.Job("kind", ["x", "y"], ["a"], 1)
    rows = [(1.0, 2.0, "a", None), (None, 2.0, "a", 1), (1.0, float("nan"), "a", 1), (1.0, 2.0, None, 1)]
    df = make(rows, "x double, y double, kind string, other int")
    assert training.complete_rows(df, job).count() == 1


def test_missing_feature_is_an_error(make):
    df = make([(1.0, None)], "x double, y double")
    with pytest.raises(Exception):
        training.assemble(df, ["x", "y"]).collect()


def test_registered_models_are_trained_whole_and_once(spark, monkeypatch):
    asked = []

    def short(rows, n_classes, n_features, rounds, depth, step):
        asked.append((n_classes, n_features, rounds, depth, step))
        return boosting.boost(rows, n_classes, n_features, 1, 2, step)

    monkeypatch.setattr(training, "boost", short)
    # Models of this test stay out of other queries.
    monkeypatch.setattr(catalogue, "_fitted", {}, raising=False)
    names = ("train_need", "confusion_need", "importance_need", "sample_need", "saved_need", "importance_checks_need")
    for name in names:
        assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert catalogue.queries()["train_item"](spark, "/root/testdata/sf0.001").count() > 0
    assert [a[2:] for a in asked] == [(100, 6, 0.3)] * 2


def test_half_of_the_nodes_are_summed(samples, monkeypatch):
    frame, labels = training.index_label(training.assemble(samples, ["x", "y"]), "kind")
    asked, sums = [], boosting.Boosting._sums

    def spied(self, grown, nodes):
        asked.append([len(own) for own in nodes])
        return sums(self, grown, nodes)

    monkeypatch.setattr(boosting.Boosting, "_sums", spied)
    training.train_classifier(frame, labels, ["x", "y"], rounds=1, depth=3)
    assert len(asked) == 3
    assert all(max(own) <= 2 ** max(level - 1, 0) for level, own in enumerate(asked))


def test_opposite_margins_give_the_same_gradients():
    random = np.random.default_rng(6)
    own = np.concatenate([random.normal(size=5000) * 4, [0.0, -0.0, 800.0, -800.0, 1e-300]])
    label = random.integers(0, 2, len(own)).astype(np.int32)
    margins = np.column_stack([own, -own])
    for one, both in zip(boosting.opposite_gradients(margins, label), boosting.gradients(margins, label)):
        assert one.shape == (len(own), 1) and (one[:, 0] == both[:, 0]).all()


def test_sums_little_above_a_buffer_leave_a_task_below_it(samples, monkeypatch):
    random = np.random.default_rng(5)
    shape = (1, 19, 2, 4, boosting.BINS)
    for bits in (10, 20, 52):
        sums = random.integers(-(1 << bits), 1 << bits, shape) / boosting.GRAIN
        packed = boosting.squeezed(sums, boosting.SOCKET_BUFFER)
        assert (boosting.unsqueezed(packed, shape) == sums).all()
        assert bits > 20 or len(packed) < boosting.SOCKET_BUFFER < sums.nbytes
    # Whether sums are compressed or not, trees are the same.
    frame, labels = training.index_label(training.assemble(samples, ["x", "y"]), "kind")
    plain = training.train_classifier(frame, labels, ["x", "y"], rounds=2, depth=3).nodes
    seen, whole = [], boosting.unsqueezed
    monkeypatch.setattr(boosting, "SOCKET_BUFFER", 4000)
    monkeypatch.setattr(boosting, "unsqueezed", lambda sums, shape: seen.append(type(sums)) or whole(sums, shape))
    assert training.train_classifier(frame, labels, ["x", "y"], rounds=2, depth=3).nodes == plain
    assert bytes in seen


def test_walk_does_not_shuffle_rows_by_node(fitted, spark):
    model, _, test = fitted
    walked = training.predict_by_nodes(
        model.node_table(spark), test, ["equipment_id", "timestamp"], model.features, model.labels
    )
    plan = walked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_walk_finds_nodes_by_one_number(fitted, spark, make):
    model, _, test = fitted
    walked = training.predict_by_nodes(
        model.node_table(spark), test, ["equipment_id", "timestamp"], model.features, model.labels
    )
    plan = walked._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)
    assert joins and all("," not in keys for keys in joins)
    # A tree is missing, one is of no known class, a value is missing, and a node of a tree is out of order.
    nodes = [
        boosting.Node(0, 0, 0, 0, 1, 2.0, 3, 1, 0.0),
        boosting.Node(0, 0, 1, 1, -1, 0.0, -1, -1, 1.0),
        boosting.Node(0, 0, 3, 1, -1, 0.0, -1, -1, -1.0),
        boosting.Node(0, 2, 0, 0, -1, 0.0, -1, -1, 50.0),
        boosting.Node(1, 1, 0, 0, -1, 0.0, -1, -1, 0.5),
    ]
    rows = make([(1, 0.0, 2.0), (2, 0.0, 2.5), (3, 0.0, None)], "row int, p double, q double")
    table = training.BoostedClassifier(["a", "b"], ["p", "q"], nodes).node_table(spark)
    found = {r["row"]: r for r in training.predict_by_nodes(table, rows, ["row"], ["p", "q"], ["a", "b"]).collect()}
    for row, margin in ((1, -1.0), (2, 1.0), (3, 1.0)):
        share = np.exp(margin) / (np.exp(margin) + np.exp(0.5))
        assert found[row]["probabilities"] == pytest.approx([share, 1 - share])
        assert found[row]["predicted_label"] == ("a" if margin > 0.5 else "b")


def test_compared_predictions_are_computed_once(spark, monkeypatch):
    nodes = [boosting.Node(0, 0, 0, 0, 0, 60.0, 1, 2, 0.0)]
    nodes += [boosting.Node(0, 0, n, 1, -1, 0.0, -1, -1, v) for n, v in ((1, 1.0), (2, -1.0))]
    model = lambda train, labels, features: training.BoostedClassifier(labels, features, nodes)
    monkeypatch.setattr(training, "train_classifier", model)
    monkeypatch.setattr(catalogue, "_fitted", {})
    for name in ("walked_need", "saved_need"):
        found = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
        assert "Python" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "ArrowEval" not in plan
        (row,) = found.collect()
        assert row["rows"] > 0 and row["differences"] == 0


def test_both_derivatives_are_added_at_once_and_exactly():
    random = np.random.default_rng(8)
    for classes in (2, 3):
        margins = random.normal(size=(300, classes))
        margins = np.column_stack([margins[:, 0], -margins[:, 0]]) if classes == 2 else margins
        label = random.integers(0, classes, 300).astype(np.int32)
        both = boosting.both_derivatives(margins, label)
        first, second = boosting.gradients(margins, label)
        assert both.shape == (1 if classes == 2 else 3, 300)
        assert (both.real == first.T[: len(both)]).all() and (both.imag == second.T[: len(both)]).all()
