import pytest

from tidewright.operators import clean, profile, project
from tidewright.schema import TableError


def test_duplicates(people):
    row = clean.duplicate_count(people).first()
    assert (row["row_count"], row["distinct_rows"], row["duplicate_rows"]) == (6, 5, 1)
    assert clean.drop_duplicates(people).count() == 5


def test_impute(people):
    assert clean.fit_impute(people, "mean", "value") == {"value": 28.0}
    assert clean.fit_impute(people, "median", "value") == {"value": 20.0}
    # A and B tie with more rows than C once duplicates are gone: the smaller wins.
    assert clean.fit_impute(people.dropDuplicates(), "mode", "category") == {"category": "A"}
    filled = clean.impute(people, "constant", "name", "nobody")
    assert filled.filter("name = 'nobody'").count() == 1
    with pytest.raises(TableError):
        clean.fit_impute(people, "constant", "name")
    with pytest.raises(TableError):
        clean.fit_impute(people, "guess", "value")


def test_iqr_remove_drops_nulls_only_with_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10)] + [(None,)], "x double")
    assert clean.outlier_iqr(df, "remove").count() == 11
    far = df.union(spark.createDataFrame([(1000.0,)], "x double"))
    assert clean.outlier_iqr(far, "remove").count() == 10


def test_iqr_columns_in_order(spark):
    """The second column is judged on the rows the first one left."""
    rows = [(float(i), float(i)) for i in range(10)] + [(1000.0, 5000.0), (5.0, 30.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    kept = {tuple(r) for r in clean.outlier_iqr(df, "remove").collect()}
    assert (1000.0, 5000.0) not in kept and (5.0, 30.0) not in kept and len(kept) == 10


def test_iqr_cap_and_flag(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (100.0,), (None,)], "x double")
    assert clean.outlier_iqr(df, "cap").agg({"x": "max"}).first()[0] == 7.0
    flags = {r["x"]: r["x_is_outlier"] for r in clean.outlier_iqr(df, "flag").collect()}
    assert flags[100.0] and not flags[1.0] and flags[None] is False


def test_validate(spark, people):
    assert profile.validate_dataset(people).filter("level = 'error'").count() == 0
    mostly = spark.createDataFrame([(i, "x" if i == 0 else None) for i in range(5)], "id long, name string")
    # The threshold is strict: a ratio of 0.8 passes.
    assert profile.validate_dataset(mostly).filter("code = 'missing_threshold'").count() == 0
    with pytest.raises(TableError):
        profile.validate_dataset(mostly, missing_threshold=0.5, raise_on_error=True)


def test_fingerprint_ignores_order_but_not_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "a int, b string")
    b = a.orderBy("a", ascending=False)
    assert profile.dataset_fingerprint(a).first() == profile.dataset_fingerprint(b).first()
    assert profile.dataset_fingerprint(a).first() != profile.dataset_fingerprint(a.distinct()).first()


def test_class_balance(spark):
    one = spark.createDataFrame([(float(i), 1) for i in range(20)], "x double, y int")
    assert profile.class_balance(one, ["x"], "y").first()["status"] == "single_class"
    few = one.limit(5)
    assert profile.class_balance(few, ["x"], "y").first()["status"] == "too_few_rows"


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], ["Order Key", "X"])
    assert project.normalize_column_names(df).columns == ["order_key", "x"]
    with pytest.raises(TableError):
        project.normalize_column_names(spark.createDataFrame([(1, 2)], ["A", "a "]).toDF("A b", "a_B"))
    assert project.non_numeric_features(df.withColumnRenamed("Order Key", "k"), ["k", "X"]) == []
