"""Plans of queries that met their limits at size: what is dealt, sorted and kept."""

import re

import pytest

from docfiling import corpus
from docfiling.functions import text as T
from docfiling.operators import distill as D
from docfiling.operators import naming
from docfiling.operators import validate as V
from docfiling.plans import queries
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


PAGES = "doc_id long, page_number int, text string"


def test_lines_and_blocks_are_no_rows(spark):
    df = spark.createDataFrame([(1, 1, "x")], PAGES)
    assert "Exchange" not in plan(D.runs(df)) and "Window" not in plan(D.distill(df))
    assert plan(D.distill(df)).count("Exchange") == 1


def test_contracts_are_dealt_by_document(spark, sf_dir):
    """Distilling contracts sends no text: their rows have met by key."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = D.distill(corpus.contracts(lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")))
        assert not re.search(r"Exchange hashpartitioning\(doc_id", plan(df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("text,n", [("1999", 1), ("21999", 0), ("19991", 0), ("2199-1900", 2), ("3/14/26", 1), ("13/14/26", 1), ("113/14/26", 0), ("x1/1/11 in 2000", 2), ("1/1/111", 0), ("\n2001", 1), ("1\n1999", 1)])
def test_dates_are_found_from_their_digits(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(T.date_signals(F.col("t"))).first()[0] == n


def test_cues_are_found_in_one_pass(spark):
    """Blocks aren't searched for one cue after the other, and cues that others begin with count as before."""
    texts = ["", "Order No 7", "INVOICE NO 5, invoice date, invoice", "Waiver of corporation corp co. and company", "Termination Date: terminates on", "into: by: name: by and between", "ASSIGNMENT AND amendment date", "é Dated As Of lease/s/", *T._ALL_CUES, None]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(T.cue_counts(F.col("t")).alias("got"), F.struct(*(T.cue_count(F.col("t"), cues).alias(k) for k, cues in T.CUES.items())).alias("each"), "t")
    assert all(r["got"] == r["each"] for r in df.filter("t is not null").collect())
    found = D.distill(spark.createDataFrame([(1, 1, "x")], PAGES))._jdf.queryExecution().optimizedPlan().toString()
    assert "filter([agreement," not in found and "filter([by and between," not in found


def test_plain_lines_are_taken_many_at_a_time(spark):
    """A page's lines aren't looked at one by one, but for those that may be headings."""
    text = "TITLE\n" + "\n".join(f"| part {k} | {k} |" for k in range(500)) + "\n\n" + "\n".join(f"Line {k} says little.  " for k in range(500)) + " \n\n\t\nEND\n\n"
    found = spark.createDataFrame([(1, 1, text)], PAGES)
    assert [(r["kind"], r["joined"].count("\n")) for r in D.runs(found).collect()] == [("heading", 0), ("table", 499), ("body", 499), ("heading", 0)]
    assert found.select(F.size(F.regexp_extract_all(F.regexp_replace("text", "[ \t]+\n", "\n"), F.lit(D._PIECES), F.lit(0)))).first()[0] <= 5


def test_upper_case_is_alphabetic(spark):
    """Headings count capitals alone."""
    odd = spark.range(0x110000).filter("id < 55296 or id > 57343").select(F.decode(F.encode(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"), "UTF-8"), "UTF-8").alias("c"))
    assert odd.filter(F.col("c").rlike(r"\p{IsUppercase}") & ~F.col("c").rlike(r"\p{IsAlphabetic}")).count() == 0


def test_statement_pages_are_numbered_without_their_text(spark, sf_dir):
    found = plan(queries.queries()["w01_runs_statements"](spark, sf_dir))
    assert "CONFIDENTIAL" in found and "CONFIDENTIAL" not in found[found.index("Window") :]


def test_a_segment_makes_each_step_once(spark):
    from docfiling.functions import names as N

    found = spark.createDataFrame([(" a<b>:\tc .. ",), ("con",), ("...",), ("x\x85y",), ("aux.b. ",), (None,)], "t string").select("t", N.segment(F.col("t")).alias("s"))
    assert [r["s"] for r in found.collect()] == ["ab c", "_con", None, "x y", "_aux.b", None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 4


def test_shapes_of_lines_are_no_groups(spark, sf_dir):
    found = plan(queries.queries()["x_signals"](spark, sf_dir))
    assert "Expand" not in found and "Generate" not in found


def test_older_method_checks_once(spark, sf_dir):
    """The names are made of the checked rows, not joined to them."""
    found = queries.queries()["c06_legacy"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("lineitem") <= 2 and found.count("Join ") <= 6


def test_flags_are_counted_side_by_side(spark, sf_dir):
    assert "Expand" not in plan(queries.queries()["e08_flags"](spark, sf_dir))


def test_results_of_two_pipelines_read_their_proposals_once(spark, sf_dir):
    assert "Union" not in plan(corpus.results(lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")))


@pytest.mark.parametrize("broadcast,partitions", [("-1", "4"), ("10m", "4"), ("-1", "24")])
@pytest.mark.parametrize("table", [corpus.proposals, corpus.contracts])
def test_orders_are_dealt_into_parts_that_follow_their_number(spark, sf_dir, monkeypatch, table, broadcast, partitions):
    """No task's share grows with the table, whatever the session's number of shuffle partitions."""
    monkeypatch.setattr(corpus, "ORDERS_A_TASK", 100, raising=False)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = table(lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet"))
        each = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("k")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(each) > 1000 and max(each) < 250


def test_texts_of_a_proposal_are_normalised_in_one_go(spark, sf_dir):
    """Rows go to Python once, and a date's renderings are written out only until one is found."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    found = V.validate(corpus.proposals(t), D.distill(corpus.contracts(t)))._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("ArrowEvalPython") == 1 and found.count("substring(date") <= 12


def test_spaces_of_a_name_that_fits_are_made_once(spark):
    rows = [("a", "in", "2024", "Deed", ["Alpha"], "from", "pdf"), ("b", "in", "", "x" * 110, [], "none", "pdf"), ("c", None, "", "Deed (2)", [], "none", "pdf")]
    df = spark.createDataFrame(rows, "family string, folder string, date string, kind string, people array<string>, party_relation string, ext string")
    found = {r["family"]: r for r in naming._spaces(df).collect()}
    assert found["a"]["spaces"] is None and tuple(found["a"]["first"]) == (found["a"]["wide"], 1)
    assert len(found["b"]["spaces"]) == 10 and found["b"]["wide"] is None
    assert found["c"]["first"]["n"] == 2 and found["c"]["first"]["space"] != found["c"]["wide"]


def test_replies_are_decoded_in_one_pass(spark, sf_dir):
    assert plan(queries.queries()["k02_decode"](spark, sf_dir)).count("FileScan") == 3


def test_a_table_without_orders_gives_no_proposals(spark, sf_dir):
    df = corpus.proposals(lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet").filter(F.lit(n != "orders")))
    assert df.count() == 0
