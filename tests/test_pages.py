"""Pages and their OCR readings."""

from docfiling.operators import pages as P
from docfiling.plans import queries

READ = "doc_id long, page_number int, rotation int, text string, confidence double"


def test_words_are_read_where_their_document_is(spark, sf_dir):
    """The words times four rotations are never sent on; each document's text is, once."""
    plan = queries.queries()["a02_readings"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "word" not in plan[plan.index("Exchange") :]


def test_flat_words_give_the_same_readings(spark):
    flat = spark.createDataFrame([(1, 1, 0, 2, " b\t", 50.0), (1, 1, 0, 1, "a", -1.0), (1, 1, 0, 3, " ", 99.0), (1, 1, 90, 1, "", 7.0), (2, 1, 0, 1, "x", 1.0), (2, 1, 0, 2, "y", 2.0)], "doc_id long, page_number int, rotation int, seq int, word string, confidence float")
    assert sorted(tuple(r) for r in P.readings(P.gathered(flat)).collect()) == [(1, 1, 0, "a b", 50.0), (1, 1, 90, "", 0.0), (2, 1, 0, "x y", 1.5)]


def test_a_later_turn_has_to_be_better_by_a_millionth(spark):
    """Means of long pages that differ by less than that are the earlier reading's, as in the SQL."""
    read = spark.createDataFrame([(1, 1, 0, "a", 50.0), (1, 1, 270, "b", 50.0000005), (2, 1, 0, "a", 50.0), (2, 1, 90, "b", 50.0000019), (3, 1, 0, "a", 50.0), (3, 1, 90, "b", 50.0000031)], READ)
    found = P.best_readings(read, spark.createDataFrame([(k, 1, 0) for k in (1, 2, 3)], "doc_id long, page_number int, detected int"))
    assert sorted((r["doc_id"], r["rotation"], r["confidence"]) for r in found.collect()) == [(1, 0, 50.0000005), (2, 0, 50.0000019), (3, 90, 50.0000031)]


def test_cues_are_looked_up_in_one_lower_cased_text(spark, sf_dir):
    plan = queries.queries()["x04_cue_histogram"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
