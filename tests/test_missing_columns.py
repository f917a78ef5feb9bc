"""Missing columns: names that differ from their tokens, and what the job sorts."""

from harborline.operators import matching as M

ROWS = [
    ("a", 1, "Order ID"), ("a", 1, "order_id"), ("a", 1, " Zip "), ("a", 1, "zip"), ("a", 1, "--"), ("a", 1, None), ("a", 1, "known"),
    ("a", 2, "zip"), ("a", 2, "other"), ("a", 2, "more"), ("a", 2, "known"),
    ("b", 3, "known"), ("b", 4, "x"), ("b", 4, "Y"), ("b", 5, "y"), ("b", 5, "y"), ("b", 5, "X_"), ("b", 6, "y"),
    (None, 7, "lost"), (None, None, "Lost"), ("c", None, "n"),
]
SCHEMA = "category string, worker long, column_name string"


def test_names_are_the_least_spelling_of_each_token(spark):
    """Best worker's where it lacks some, the category's own where the best lacks none, or nobody matches or can be named."""
    provided = spark.createDataFrame([("Known",), ("",)], "column_name string")
    got = M.missing_columns(spark.createDataFrame(ROWS, SCHEMA), provided).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] or "", r[3])) == [
        (None, None, "Lost", 1),
        ("a", 1, "Order ID", 1), ("a", 1, "Zip", 2),
        ("b", None, "Y", 1), ("b", None, "X_", 2), ("b", None, "known", 3),
        ("c", None, "n", 1),
    ]


def test_plain_names_are_not_sorted_to_find_the_least(spark, monkeypatch):
    """The least of some strings is found by a sort; over all words of a manifest it made up most of the job."""
    plans, write = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df))
    plain = spark.createDataFrame([r for r in ROWS if r[2] in ("zip", "known", "other", "more", "x", "y")], SCHEMA)
    got = M.missing_columns(plain, spark.createDataFrame([("known",)], "column_name string")).collect()
    # Only the last table, names already counted, may sort for its least names.
    assert plans and not any("SortAggregate" in p for p in plans[:-1])
    assert sorted(map(tuple, got)) == [("a", 1, "zip", 1), ("b", None, "known", 2), ("b", None, "x", 3), ("b", None, "y", 1)]
