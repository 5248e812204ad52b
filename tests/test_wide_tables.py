"""Rows of tables with more than a thousand cells."""

from __future__ import annotations

from peerlens.operators import documents


def test_amount_in_the_last_cell_is_found(spark):
    row = "<TR><TD>Sales</TD>" + "<TD>-</TD>" * 1200 + "<TD>5,000</TD></TR>"
    d = spark.createDataFrame([(1, f"<TABLE>{row}</TABLE>")], "doc_id bigint, raw string")
    assert documents.accounts_found(d, ["Sales"]).first().found == ["Sales"]
