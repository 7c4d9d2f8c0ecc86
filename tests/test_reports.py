"""Printed tables: every row is there, cells are cut and padded."""

from schemasight.operators.reports import fitting_widths, table_lines


def test_table_lines(spark):
    df = spark.createDataFrame([("a", "x" * 50), (None, "two\nlines"), ("long name", "")], "n string, `some text` string")
    widths = fitting_widths(df)
    assert widths == {"n": 9, "some text": 40}
    lines = [r.table_line for r in table_lines(df.withColumnRenamed("some text", "t"), {"n": 3, "t": 10}, "~").collect()]
    assert lines == ["a    " + "x" * 9 + "~", "     two lines", "lo~"]
    assert fitting_widths(df.where("false")) == {"n": 1, "some text": 9}


def test_more_rows_than_a_screen(spark):
    rows = table_lines(spark.range(3000), {"id": 6})
    assert rows.count() == 3000
