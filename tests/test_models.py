"""Encoding, training, storing, scoring and comparing models on the smallest data."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from tellerlake.operators import evaluation, features, scoring, training
from tellerlake.plans import models
from tellerlake.schema import FEATURE_COLUMNS


def test_codes_are_alphabetical_and_agree_with_the_fixed_lists(spark, bank):
    fitted = features.fit_encoders(bank).transform(bank)
    fixed = features.applicant_encoders().transform(bank)
    columns = ["Customer_ID", "Gender_enc", "Occupation_enc", "Account_Type_enc"]
    assert fitted.select(columns).exceptAll(fixed.select(columns)).count() == 0


def test_features_skip_missing_columns(bank):
    coded = features.fit_encoders(bank).transform(bank.drop("Days_Since_Transaction", "EMI"))
    inputs = features.feature_inputs(coded)
    row = features.assembler(inputs.columns).transform(inputs).first()
    assert len(row.features) == len(FEATURE_COLUMNS) - 1
    assert row.Days_Since_Transaction == 0


def test_target(spark):
    df = spark.createDataFrame([("Low",), ("Medium",), ("High",), ("other",), (None,)], "l string")
    assert [r[0] for r in df.select(features.target(F.col("l"))).collect()] == [0, 1, 2, 1, 1]


def test_weights_balance_the_classes(spark):
    table = models.table(spark, SMALL)
    sums = [r[1] for r in table.where("NOT is_test").groupBy("label").agg(F.sum("weight")).collect()]
    assert max(sums) == pytest.approx(min(sums))


@pytest.mark.parametrize("kind, params", [("logistic", {}), ("tree", {}), ("forest", {"trees": 10}),
                                          ("boosted", {"rounds": 2})])
def test_models_predict_probabilities(spark, kind, params):
    scored = models.tested(spark, SMALL, kind, **params)
    rows = scored.select("label", "prediction", "p_low", "p_medium", "p_high").collect()
    assert rows and all(abs(r.p_low + r.p_medium + r.p_high - 1) < 1e-6 for r in rows)
    assert all(r.prediction in (0, 1, 2) for r in rows)
    name, auc, f1, _precision, recall = evaluation.evaluate(scored, kind)
    assert 0.7 < auc <= 1 and 0.5 < f1 <= 1 and 0.5 < recall <= 1


def node_rows(model):
    return sorted(map(tuple, model.nodes.collect()), key=str)


@pytest.mark.parametrize("kind, params", [("tree", {}), ("forest", {"trees": 4}), ("boosted", {"rounds": 3})])
def test_models_do_not_depend_on_how_rows_are_dealt(spark, kind, params):
    table = models.table(spark, SMALL)
    first = training.train(table, kind, **params)
    second = training.train(table.repartition(5, "features"), kind, **params)
    assert len(node_rows(first)) > 5 and node_rows(first) == node_rows(second)


def stored(spark, kind, path, **params):
    codes = training.codes_of(models.encoders(spark, SMALL))
    training.save_model(models.fitted(spark, SMALL, kind, **params), codes, training.MODEL_NAMES[kind], path)
    return path


@pytest.mark.parametrize("kind, params", [("logistic", {}), ("tree", {}), ("forest", {"trees": 10}),
                                          ("boosted", {"rounds": 2})])
def test_store_load_score(spark, bank, tmp_path, kind, params):
    """A model scored from its stored rows gives every customer what the fitted one gives."""
    path = stored(spark, kind, str(tmp_path / "artifact"), **params)
    loaded, names, error = training.load_model(spark, path, bank.columns)
    assert error is None and loaded.name == training.MODEL_NAMES[kind]
    assert [r.feature for r in names.orderBy("position").collect()] == FEATURE_COLUMNS
    want = training.predict(models.fitted(spark, SMALL, kind, **params), models.table(spark, SMALL))
    want = {r.Customer_ID: r for r in want.select("Customer_ID", "prediction", "p_low", "p_high").collect()}
    got = training.predict(loaded, bank).collect()
    assert len(got) == bank.count() and "City" in got[0]
    for r in got:
        w = want[r.Customer_ID]
        assert r.prediction == w.prediction
        assert (r.p_low, r.p_high) == pytest.approx((w.p_low, w.p_high), abs=1e-9)


def test_importances_are_shares(spark):
    model = models.fitted(spark, SMALL, "tree")
    weights = training.importances(model, spark, training.feature_names(models.table(spark, SMALL))).collect()
    assert len(weights) == 29 and sum(r.importance for r in weights) == pytest.approx(1.0)
    assert [r.importance for r in weights] == sorted((r.importance for r in weights), reverse=True)


def test_unusable_artifacts_are_refused(spark, bank, tmp_path):
    load = lambda path, **kw: training.load_model(spark, path, **kw)[2]
    path = stored(spark, "tree", str(tmp_path / "good"))
    assert load(path) is None and load(path, columns=bank.columns) is None
    assert "EMI, Gender" in load(path, columns=[c for c in bank.columns if c not in ("EMI", "Gender")])
    for part, change, text in [
            ("features", lambda df: df.withColumn("feature", F.when(F.col("position") == 3, "Other").otherwise(F.col("feature"))), "features"),
            ("features", lambda df: df.where("position < 20"), "features"),
            ("codes", lambda df: df.withColumn("value", F.upper("value")), "categories"),
            ("model", lambda df: df.limit(2), "2 of"),
            ("manifest", lambda df: df.withColumn("version", F.lit(99)), "version 99")]:
        path = stored(spark, "tree", str(tmp_path / f"bad-{part}-{text[:3]}-{hash(text) % 97}"))
        rows = spark.createDataFrame(change(spark.read.parquet(f"{path}/{part}")).collect(),
                                     spark.read.parquet(f"{path}/{part}").schema)
        rows.write.mode("overwrite").parquet(f"{path}/{part}")
        assert text in load(path)


def test_unknown_category_fails(spark, bank, tmp_path):
    loaded, _, _ = training.load_model(spark, stored(spark, "tree", str(tmp_path / "a")))
    with pytest.raises(Exception, match="Occupation: unknown value Wizard"):
        training.predict(loaded, bank.limit(3).withColumn("Occupation", F.lit("Wizard"))).collect()


def test_duckdb_walks_the_node_rows(spark, tmp_path):
    """The same class for every test row by a recursive query over the same rows."""
    import duckdb
    from pyspark.ml.functions import vector_to_array

    model = models.fitted(spark, SMALL, "forest", trees=10)
    rows = models.table(spark, SMALL).where("is_test")
    model.nodes.write.parquet(str(tmp_path / "nodes"))
    rows.select("Customer_ID", vector_to_array("features").alias("v")).write.parquet(str(tmp_path / "rows"))
    w = model.weights
    found = duckdb.sql(f"""
        WITH RECURSIVE n AS (SELECT * FROM '{tmp_path}/nodes/*.parquet'),
        walk AS (SELECT Customer_ID, v, tree, 1 AS node FROM '{tmp_path}/rows/*.parquet', (SELECT DISTINCT tree FROM n)
          UNION ALL SELECT Customer_ID, v, walk.tree, 2 * walk.node + (v[feature + 1] > threshold)::INT
          FROM walk JOIN n ON n.tree = walk.tree AND n.node = walk.node WHERE feature IS NOT NULL),
        s AS (SELECT Customer_ID, {', '.join(f'avg(n{c} * {w[c]} / (n0 * {w[0]} + n1 * {w[1]} + n2 * {w[2]})) AS p{c}' for c in range(3))}
          FROM walk JOIN n ON n.tree = walk.tree AND n.node = walk.node WHERE feature IS NULL GROUP BY 1)
        SELECT Customer_ID, CASE WHEN p0 >= greatest(p1, p2) THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END, p2 FROM s""").fetchall()
    mine = {r.Customer_ID: r for r in training.predict(model, rows).collect()}
    assert len(found) == len(mine) > 20
    for key, prediction, high in found:
        assert mine[key].prediction == prediction and mine[key].p_high == pytest.approx(high, abs=1e-9)


def test_logistic_weights_are_the_minimum(spark):
    """The gradient is zero in Spark, and in numpy at the weights that the stored rows give."""
    import numpy as np

    table, model = models.table(spark, SMALL), models.fitted(spark, SMALL, "logistic")
    rows = training.logistic_gradient(model, table).collect()
    assert len(rows) == 3 * 30 and max(abs(r.gradient) for r in rows) < 5e-7
    train = table.where("NOT is_test").collect()
    x = np.array([r.features.toArray() for r in train])
    y, w = np.array([r.label for r in train]), np.array([r.weight for r in train])
    raw = np.zeros((3, 30))
    for c, i, v in training.linear_rows(model):
        raw[c, i] = v  # the constant is the last, -1
    m = x @ raw[:, :29].T + raw[:, 29]
    p = np.exp(m - m.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    std = x.std(axis=0, ddof=1)
    z = np.where(std > 0, (x - x.mean(axis=0)) / np.where(std > 0, std, 1), 0)
    gradient = ((w[:, None] * (p - np.eye(3)[y])).T @ z + raw[:, :29] * std) / w.sum()
    assert np.abs(gradient).max() < 1e-6


def test_logistic_passes_do_not_grow_with_the_rows(spark):
    """Features that are nearly multiples, and weights that stand for very many rows: few jobs, at the minimum."""
    k = F.col("id")
    amount = 1_000_000 + k * 7919 % 900_001
    loan = 10_000 + k * 6007 % 490_009
    score = amount / 1e6 + loan / 4e5 + (k * 104729 % 1009) / 800
    rows = spark.range(3000).select(
        (F.lit(8000) + F.floor(amount / 48)).alias("Monthly_Income"), F.floor(amount / 20).alias("Transaction_Amount"),
        F.floor(amount * (30 + k % 56) / 4800).alias("Monthly_Expenses"), loan.alias("Loan_Amount"), F.floor(loan / 36).alias("EMI"),
        F.round(loan / amount, 3).alias("Debt_to_Income_Ratio"), (k * 15485863 % 601).alias("Credit_Score"),
        F.lit(20000.0).alias("weight"), F.lit(False).alias("is_test"), F.when(score < 2.0, 0).when(score < 3.1, 1).otherwise(2).alias("label"))
    table = features.assembler(rows.columns).transform(rows).select("label", "weight", "is_test", "features").localCheckpoint()
    context = spark.sparkContext
    context.setJobGroup("logistic-passes", "")
    model = training.train(table, "logistic")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("logistic-passes")) < 60
    gradient = training.logistic_gradient(model, table).collect()
    assert len(gradient) == 3 * 8 and max(abs(r.gradient) for r in gradient) < 1e-9


def test_boosting_lowers_the_loss_and_matches_plain_code(spark):
    """Losses fall every round; the trees of two rounds are those of a plain exhaustive search."""
    import numpy as np
    from tellerlake.operators import boosting

    table = models.table(spark, SMALL)
    model = boosting.fit(table.where("NOT is_test"), training.feature_names(table), rounds=11, depth=3)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:])) and len(model.losses) == 12
    assert model.losses[0] == pytest.approx(np.log(3))
    train = table.where("NOT is_test").collect()
    x, y = np.array([r.features.toArray() for r in train]), np.array([r.label for r in train])
    nodes = {(r.tree, r.node): r for r in model.nodes.collect()}
    edges = []  # the largest value of each bin: where a split may stand
    for column in x.T:
        code = np.floor((column[:, None] > column[None, :]).sum(axis=1) * 64 / len(column))
        edges.append([column[code == k].max() for k in np.unique(code)])
    margins = np.zeros((len(y), 3))
    for number in range(2):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        assert model.losses[number] == pytest.approx(-np.log(p[np.arange(len(y)), y]).mean(), abs=1e-7)
        for c in range(3):
            g, h = p[:, c] - (y == c), 2 * p[:, c] * (1 - p[:, c])
            rows = {1: np.arange(len(y))}
            for node in range(1, 8):
                if node not in rows:
                    continue
                mine, r = rows[node], nodes[3 * number + c, node]
                worth = lambda i: g[i].sum() ** 2 / (h[i].sum() + 1)
                best = 0.0
                for f in range(29):
                    for t in edges[f][:-1]:
                        left, right = mine[x[mine, f] <= t], mine[x[mine, f] > t]
                        if h[left].sum() >= 1 and h[right].sum() >= 1:
                            best = max(best, worth(left) + worth(right) - worth(mine))
                if r.feature is None:
                    assert best < 1e-6
                    continue
                left = x[mine, r.feature] <= r.threshold
                assert r.gain == pytest.approx(worth(mine[left]) + worth(mine[~left]) - worth(mine), abs=1e-5)
                assert r.gain == pytest.approx(best, abs=1e-5)
                rows[2 * node], rows[2 * node + 1] = mine[left], mine[~left]
            for node, mine in rows.items():
                if nodes[3 * number + c, node].feature is None:
                    assert nodes[3 * number + c, node].value == pytest.approx(-0.1 * g[mine].sum() / (h[mine].sum() + 1), abs=1e-6)
                    margins[mine, c] += nodes[3 * number + c, node].value
    scored = training.predict(model, table.where("is_test")).collect()
    assert all(abs(r.p_low + r.p_medium + r.p_high - 1) < 1e-12 for r in scored)


def test_trees_on_odd_rows(spark):
    """No rows, one class, one row and equal rows grow no split and still score."""
    from pyspark.ml.linalg import Vectors
    from tellerlake.operators import boosting, trees

    schema = models.table(spark, SMALL).select("Customer_ID", "label", "features").schema
    make = lambda rows: spark.createDataFrame([(k, y, Vectors.dense(v)) for k, y, v in rows], schema)
    names = ["a", "b"]
    for rows in ([(f"c{i}", 2, [float(i), 0.0]) for i in range(60)], [(f"c{i}", i % 3, [1.0, 1.0]) for i in range(60)],
                 [("x", 0, [1.0, 2.0]), ("x", 0, [1.0, 2.0])]):
        for model in (trees.grow(make(rows), names), boosting.fit(make(rows), names, rounds=1)):
            scored = training.predict(model, make(rows), ["Customer_ID", "label"]).collect()
            assert len(scored) == len(rows)
            assert all(abs(r.p_low + r.p_medium + r.p_high - 1) < 1e-9 for r in scored)
            assert model.nodes.where("feature IS NOT NULL").count() == 0
    assert trees.grow(make([]), names).nodes.count() == 0 == boosting.fit(make([]), names, rounds=2).nodes.count()


def test_missing_model_is_reported(spark, tmp_path):
    model, names, error = training.load_model(spark, str(tmp_path / "none"))
    assert model is None and names is None and "not found" in error


def test_applicants(spark, bank):
    shouting = bank.withColumns({"Account_Type": F.upper("Account_Type"), "Gender": F.lower("Gender")})
    out = scoring.score_applicants(models.fitted(spark, SMALL, "tree"), shouting)
    rows = out.collect()
    assert len(rows) == bank.count()
    for r in rows:
        parts = {"LOW RISK": r.Low_Risk_Pct, "MEDIUM RISK": r.Medium_Risk_Pct, "HIGH RISK": r.High_Risk_Pct}
        assert abs(sum(parts.values()) - 100) < 0.05
        assert abs(parts[r.Risk_Category] - r.Risk_Probability_Pct) <= 0.06


def test_first_best_model_is_marked(spark):
    rows = [("A", 0.9, 0.5, 0.5, 0.5), ("B", 0.95, 0.5, 0.5, 0.5), ("C", 0.95, 0.6, 0.6, 0.6)]
    assert [r.Best for r in evaluation.comparison(spark, rows).collect()] == ["", "✓", ""]


def test_batch_run(spark, bank, tmp_path):
    from tellerlake.plans.build import build_all
    from tellerlake.sources import files, star, store

    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    files.write_csv(star.with_defects(bank).drop("_seq").coalesce(1), raw)
    report = build_all(files.read_raw_csv(spark, raw), out, kinds=("tree", "forest"),
                       params={"forest": {"trees": 5}})
    assert [r.Model for r in report.collect()] == ["Decision Tree", "Random Forest"]
    assert files.read_metrics(spark, f"{out}/models/model_metrics").count() == 2
    assert files.read_importance(spark, f"{out}/reports/feature_importance").count() == 29
    clean, error = files.load_customers(spark, f"{out}/processed/customers_clean")
    assert error is None
    assert store.open_tables(spark, f"{out}/database")["loans"].count() == clean.count() > 100
    model, _names, error = training.load_model(spark, f"{out}/models/risk_model")
    assert error is None and training.predict(model, clean).count() == clean.count()
    assert spark.read.parquet(f"{out}/reports/roc_curve").where("threshold = 'Infinity'").count() == 3


def test_csv_gaps_become_null(spark, bank, tmp_path):
    from tellerlake.sources import files

    path = str(tmp_path / "gaps")
    gaps = bank.limit(3).withColumns({"Age": F.lit("NaN"), "Last_Transaction_Date": F.lit("soon")})
    files.write_csv(gaps, path)
    rows = files.read_customers_csv(spark, path).collect()
    assert len(rows) == 3 and all(r.Age is None and r.Last_Transaction_Date is None for r in rows)


def test_names_follow_the_fitted_vector(spark, bank):
    from tellerlake.operators import features
    slim = bank.drop("EMI")
    table = features.model_table(slim, features.fit_encoders(slim))
    names = training.feature_names(table)
    assert len(names) == 28 and "EMI" not in names
    rows = training.importances(training.train(table, "tree"), spark, names, top=10).collect()
    assert len(rows) == 10 and "EMI" not in {r.feature for r in rows}
