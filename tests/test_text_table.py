"""Text tables by Spark against lines written by hand."""

import pytest
from pyspark.sql import functions as F

from pairloom.operators.text_table import FORMATS, general, separated, text_table, write_text_table, wrapped

ROWS = [(0, "spam", 41.9999), (1, "eggs", 451.0)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "n int, strings string, numbers double")


def text(df, order="n", **layout):
    return "\n".join(r.line for r in text_table(df, order, **layout).orderBy("section", order, "at").collect())


def test_simple(table):
    assert text(table) == "strings      numbers\n---------  ---------\nspam         41.9999\neggs        451"
    assert text(table, fmt="plain", headers=None) == "spam   41.9999\neggs  451"
    assert text(table, headers=None) == "----  --------\nspam   41.9999\neggs  451\n----  --------"
    assert text(table, fmt="no such format") == text(table)


def test_boxes(table):
    box = ["+-----------+-----------+", "| strings   |   numbers |", "+===========+===========+", "| spam      |   41.9999 |", "+-----------+-----------+", "| eggs      |  451      |", "+-----------+-----------+"]
    assert text(table, fmt="grid").split("\n") == box
    assert text(table, fmt="outline").split("\n") == [b for k, b in enumerate(box) if k != 4]
    assert text(table, fmt="heavy_grid").split("\n")[0] == "┏━━━━━━━━━━━┳━━━━━━━━━━━┓"
    assert text(table, fmt="psql").split("\n")[2] == "|-----------+-----------|"
    assert text(table, fmt="colon_grid", aligns={"numbers": "center"}).split("\n")[2] == "+:==========+:=========:+"
    assert text(table, fmt="pretty").split("\n")[:4] == ["+---------+---------+", "| strings | numbers |", "+---------+---------+", "|  spam   | 41.9999 |"]


def test_marked_formats(table):
    assert text(table, fmt="pipe").split("\n")[1] == "|:----------|----------:|"
    assert text(table, fmt="github").split("\n")[1] == "|-----------|-----------|"
    assert text(table, fmt="html").split("\n") == ["<table>", "<thead>", '<tr><th>strings  </th><th style="text-align: right;">  numbers</th></tr>', "</thead>", "<tbody>", '<tr><td>spam     </td><td style="text-align: right;">  41.9999</td></tr>', '<tr><td>eggs     </td><td style="text-align: right;"> 451     </td></tr>', "</tbody>", "</table>"]
    assert text(table, fmt="latex").split("\n") == ["\\begin{tabular}{lr}", "\\hline", " strings   &   numbers \\\\", "\\hline", " spam      &   41.9999 \\\\", " eggs      &  451      \\\\", "\\hline", "\\end{tabular}"]
    assert text(table, fmt="mediawiki").split("\n")[:5] == ['{| class="wikitable" style="text-align: left;"', "|+ <!-- caption -->", "|-", '! strings   !! style="text-align: right;"|   numbers', "|-"]
    assert text(table, fmt="moinmoin").split("\n")[0] == "|| ''' strings   ''' ||<style=\"text-align: right;\"> '''   numbers ''' ||"
    assert text(table, fmt="textile").split("\n") == ["|_.  strings   |_.   numbers |", "|<. spam       |>.   41.9999 |", "|<. eggs       |>.  451      |"]
    assert text(table, fmt="asciidoc").split("\n") == ['[cols="11<,11>",options="header"]', "|====", "| strings   |   numbers ", "| spam      |   41.9999 ", "| eggs      |  451      ", "|===="]
    assert text(table, fmt="youtrack", headers=None).split("\n")[0] == "|  spam  |   41.9999  |"
    assert text(table, fmt="tsv").split("\n")[1] == "spam     \t  41.9999"
    assert text(table, fmt=separated(";"), headers=None).split("\n")[0] == "spam; 41.9999"
    escaped = table.select("n", F.lit("<b> & 5%").alias("x"))
    assert "&lt;b&gt; &amp; 5%" in text(escaped, fmt="html") and "<b> & 5%" in text(escaped, fmt="unsafehtml")
    assert "\\ensuremath{<}b\\ensuremath{>} \\& 5\\%" in text(escaped, fmt="latex") and "<b> & 5%" in text(escaped, fmt="latex_raw")


def test_every_format(spark, table):
    more = table.unionByName(spark.createDataFrame([(2, None, None)], table.schema))
    assert len(FORMATS) == 37
    for name in ("fancy_outline", "jira", "latex_booktabs", "orgtbl"):
        assert "spam" in text(more, fmt=name)
    assert text(table.limit(0), fmt="grid").split("\n") == ["+-----------+-----------+", "| strings   | numbers   |", "+===========+===========+", "+-----------+-----------+"]


def test_high_rows(spark):
    df = spark.createDataFrame([(0, "a\nb\nc", 1), (1, "d", 2)], "n int, t string, k int")
    assert text(df, fmt="grid", headers=None).split("\n") == ["+---+---+", "| a | 1 |", "| b |   |", "| c |   |", "+---+---+", "| d | 2 |", "+---+---+"]
    column = lambda align: [x.split("|")[2].strip() for x in text(df, fmt="grid", headers=None, row_align=align).split("\n")[1:4]]
    assert column("bottom") == ["", "", "1"] and column("center") == ["", "1", ""]
    long = spark.createDataFrame([(0, "the quick brown fox", "abcdefghijk x")], "n int, a string, b string")
    assert text(long, fmt="plain", headers=None, max_widths={"a": 9, "b": 5}).split("\n") == ["the quick  abcde", "brown fox  fghij", "           k x"]
    got = spark.createDataFrame([("one two\n\nthree",)], "c string").select(wrapped(F.col("c"), 4).alias("x")).first().x
    assert got == "one\ntwo\n\nthre\ne"


def test_separators_index_and_missing(spark):
    df = spark.createDataFrame([(0, "a", 1.5, False), (1, None, None, True), (2, "b", None, False), (3, None, 2.0, None)], "n int, t string, x double, cut boolean")
    assert text(df, separators="cut", missing="?").split("\n") == ["t      x", "---  ---", "a    1.5", "---  ---", "b    ?", "?    2"]
    assert text(df.drop("cut"), index=True).split("\n") == ["    t      x", "--  ---  ---", " 0  a    1.5", " 1", " 2  b", " 3       2"]
    assert text(df.select("n", "t"), fmt="rst", headers=None).split("\n")[2] == ".."


def test_numbers(spark):
    cases = {1.0: "1", 0.0: "0", -0.5: "-0.5", 41.9999: "41.9999", 1234567.0: "1.23457e+06", 123456.0: "123456", 1e-5: "1e-05", 0.0001: "0.0001", 0.00012345678: "0.000123457", 1e100: "1e+100", 999999.5: "1e+06", 100000.0: "100000", 2.5e-310: "2.5e-310", float("inf"): "inf", float("-inf"): "-inf"}
    df = spark.createDataFrame([(k,) for k in cases], "x double")
    assert {r.x: r.t for r in df.select("x", general(F.col("x")).alias("t")).collect()} == cases
    assert spark.range(1).select(general(F.lit(float("nan")))).first()[0] == "nan"
    prices = spark.createDataFrame([(0, "1,234.5"), (1, "7"), (2, "")], "n int, p string")
    assert text(prices, fmt="plain", headers=None, float_style=".2f").split("\n") == ["1234.50", "   7.00", ""]
    assert text(prices, fmt="plain", headers=None, parse_numbers=False).split("\n")[0] == "1,234.5"


def test_written_lines_follow_the_order(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("n"), F.concat(F.lit("v"), "id").alias("v")).repartition(5)
    write_text_table(text_table(df, "n", fmt="psql"), "n", str(tmp_path / "t"))
    parts = sorted((tmp_path / "t").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines == text(df, fmt="psql").split("\n") and lines[3] == "| v0   |" and len(lines) == 504


def test_cells_are_made_once_and_rows_dealt_out(spark):
    df = spark.range(3000).select(F.col("id").alias("n"), F.concat(F.lit("v"), "id").alias("v"), (F.col("id") / 7).alias("x")).coalesce(1)
    for fmt in ("grid", "html"):
        lines = text_table(df, "n", fmt=fmt)
        plan = lines._jdf.queryExecution().optimizedPlan().toString()
        assert "format_string" not in plan and "RLIKE" not in plan
        body = lines.filter("section = 1").groupBy(F.spark_partition_id()).count().count()
        assert body > 1
        assert lines.count() == {"grid": 6003, "html": 3007}[fmt]


def test_widths_of_mixed_cells(spark):
    df = spark.createDataFrame([(0, "a\nbc", "日本"), (1, "\x1b[31mred\x1b[0m", "e\u0301"), (2, "soft\xadly", "x\ny z")], "n int, a string, b string")
    got = text(df, fmt="grid", headers=None).split("\n")
    assert got == ["+---------+------+", "| a       | 日本 |", "| bc      |      |", "+---------+------+", "| \x1b[31mred\x1b[0m     | e\u0301    |", "+---------+------+", "| soft\xadly | x    |", "|         | y z  |", "+---------+------+"]
