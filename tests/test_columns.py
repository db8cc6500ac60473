"""Column functions on odd cells."""

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import scalar
from quillmesh.operators import evidence
from quillmesh.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("row", "cells"), [("| 0 | 10 | 2 |", ["0", "10", "2"]), (r"|a\|b| c ", [r"a\|b", "c"]), ("||", [""]), ("plain", ["plain"])])
def test_cells_keep_their_digits(spark, row, cells):
    assert one(spark, scalar.table_cells(F.lit(row))) == cells


def test_line_share_reads_digits(spark):
    assert one(spark, scalar.distinct_line_share(F.lit("0\n1\n 2 \n2\n\n"))) == 0.75


def test_quote_parts_keep_their_digits(spark):
    got = one(spark, evidence.quote_status(F.lit("0 apples ... 1 pear"), F.lit("we had 0 apples and then 1 pear")))
    assert got != one(spark, evidence.quote_status(F.lit("0 apples ... 2 pears"), F.lit("we had 0 apples and then 1 pear")))


@pytest.mark.parametrize("text", ["", "a", "a <!-- image --> b", "<!-- image --><!-- image -->", "x <!-- image --> y <!-- image --> z <!-- image -->"])
@pytest.mark.parametrize("blocks", [[], ["1"], ["1", "2", "3", "4"]])
def test_spliced_equals_the_plain_loop(spark, text, blocks):
    held = F.array(*map(F.lit, blocks)) if blocks else F.array().cast("array<string>")
    assert one(spark, readers.spliced(F.lit(text), held)) == readers.splice(text, blocks)


def test_question_lists(spark):
    text = "# Set\n## Q1 - First\n**Question:** why?\nmore\n**Reference:** because\nof it\n\n## Q2\nnothing\n## other\n"
    got = readers.questions(spark.createDataFrame([(1, text), (2, None), (3, "")], "page int, text string"), "page", "text").collect()
    assert [tuple(r) for r in got] == [(1, "Q1", "First", "why?", "because\nof it"), (1, "Q2", "", "", "")]


@pytest.mark.parametrize(("raw", "value"), [("Yes", 1.0), (" no", 0.0), ("nan", None), ("7", 1.0), ("-1", 0.0), ("0.25", 0.25), ("maybe", None), (None, None), ("", None), ("PASS", 1.0)])
def test_verdicts(spark, raw, value):
    assert one(spark, scalar.verdict_number(F.lit(raw).cast("string"))) == value


@pytest.mark.parametrize(("text", "label"), [("short (cut here)", "short"), ("w" * 91, "…"), ("word " * 30, "word " * 17 + "word…"), ("[x]", "")])
def test_labels(spark, text, label):
    assert one(spark, scalar.short_label(F.lit(text))) == label
