"""Evaluation measures against small cases."""

from docfiling.operators import evaluate


def test_date_when_named(spark):
    rows = [("a", "1", True, True), ("a", "2", True, False), ("a", "3", True, False), ("a", "4", False, False), ("a", "5", True, None), ("b", "6", False, False)]
    scored = spark.createDataFrame(rows, "pipeline string, file string, ready boolean, date_correct boolean")
    named = evaluate.date_when_named(scored)
    assert not [f for f in named.schema if f.dataType.typeName() == "array"]
    assert sorted((r["pipeline"], round(r["rate"], 6), r["n"], r["n_wrong"]) for r in named.collect()) == [("a", 0.333333, 3, 2), ("b", 1.0, 0, 0)]
    assert sorted(map(tuple, evaluate.wrong_when_named(scored).collect())) == [("a", "2"), ("a", "3")]
