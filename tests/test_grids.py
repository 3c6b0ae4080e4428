"""Grids of markup and of aligned text."""

from pyspark.sql import functions as F

from tessera.functions import grids as G


def texts(grid):
    return [[t for t, _ in row] for row in grid]


def test_spans_fill_their_places():
    (grid,) = G.markup_grids("<table><tr><th rowspan=2>a<th colspan=2>b</tr><tr><th>c<th>d</tr><tr><td rowspan=0>1<td>2<td>3</tr><tr><td colspan=2>4</tr></table>")
    assert texts(grid) == [["a", "b", "b"], ["a", "c", "d"], ["1", "2", "3"], ["1", "4", "4"]]
    assert list(G.cells(grid)) == [
        (0, 0, "a", "1", "1"), (0, 1, "b > c", "1", "2"), (0, 2, "b > d", "1", "3"),
        (1, 0, "a", "1", "1"), (1, 1, "b > c", "1", "4"), (1, 2, "b > d", "1", "4"),
    ]
    (grid,) = G.markup_grids("<table><tr><td>1<td rowspan=3>2<td>3<tr><td>4<tr><td>5<td>6</table>")
    assert texts(grid) == [["1", "2", "3"], ["4", "2"], ["5", "2", "6"]]
    (grid,) = G.markup_grids("<table><tr><td>1<td>2<td rowspan=2>3<tr><td>4</table>")
    assert texts(grid) == [["1", "2", "3"], ["4", "", "3"]]


def test_broken_and_hostile_markup():
    assert G.markup_grids("") == [] and G.markup_grids("<td>x</td>") == [] and G.markup_grids("<table></table>") == []
    assert texts(G.markup_grids("<table><td>a<td>b &amp; c<br>d")[0]) == [["a", "b & c d"]]
    outer = G.markup_grids("<table><tr><td>x<table><tr><td>in</table>y</table>")
    assert [texts(g) for g in outer] == [[["in"]], [["xy"]]]
    (grid,) = G.markup_grids("<table><tr><td colspan=999999 rowspan=99999999>x<td colspan=-3>y<td rowspan=z>w</table>")
    assert len(grid) == 1 and len(grid[0]) == G.MOST_SPAN + 2
    deep = "<table><tr><td>" * 300
    assert len(G.markup_grids(deep)) == 300


def test_headers_without_marks_are_rows_without_figures():
    (grid,) = G.markup_grids("<table><tr><td>Hole<td>From (m)<tr><td>A-1<td>10</table>")
    assert list(G.cells(grid)) == [(0, 0, "Hole", "A-1", "A-1"), (0, 1, "From (m)", "A-1", "10")]
    (grid,) = G.markup_grids("<table><tr><td>Name<td>Role<tr><td>Bell<td>chair</table>")
    assert [c[2:] for c in G.cells(grid)] == [("Name", "Bell", "Bell"), ("Role", "Bell", "chair")]


TEXT = """Drilling went on.

                  Interval               Grade
Hole          From (m)    To (m)     Au (g/t)   Ag (g/t)
AB-01             12.0      15.5         1.20       30.5
AB-02            110.0     120.25                    7.0
   including     112.0     113.0         9.9

  one  two
not a table
"""


def test_aligned_text():
    (grid,) = G.text_grids(TEXT)
    found = {(r, h): t for r, _, h, _, t in G.cells(grid)}
    assert found[0, "Interval > From (m)"] == "12.0" and found[1, "Grade > Ag (g/t)"] == "7.0"
    assert found[1, "Grade > Au (g/t)"] == "" and found[0, "Interval > To (m)"] == "15.5" and found[2, "Hole"] == "including"
    assert [t for t, _ in grid[-1]][:3] == ["including", "112.0", "113.0"]
    assert G.text_grids("") == [] and G.text_grids("a  b\nc  d") == [] and G.text_grids("just prose\n" * 9) == []
    (tabbed,) = G.text_grids("x\ty\n1\t2\n3\t4")
    assert texts(tabbed) == [["x", "y"], ["1", "2"], ["3", "4"]]


def test_figures_and_fields(spark):
    said = ["$1,234.50", "12.5 m", "(3)", "-4", "− 5", "1 to 2", "", "n/a", ".5", "1,23", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    assert [r.v for r in rows.orderBy("i").select(G.figure(F.col("s")).alias("v")).collect()] == [1234.5, 12.5, -3.0, -4.0, -5.0, None, None, None, 0.5, None, None]
    pages = spark.createDataFrame([(1, TEXT, "x"), (None, TEXT, "x"), (2, None, "x"), (3, "", "x")], "id long, body string, header string")
    got = G.measured(G.text_tables(pages, "id", "body"), "id", {"from": r"from", "to": r"\bto\b", "gold": r"\bau\b", "silver": r"\bag\b"})
    read = {(r.id, r.row): (r.label, r["from"], r.to, r.gold, r.silver) for r in got.collect()}
    assert read[1, 0] == ("AB-01", 12.0, 15.5, 1.2, 30.5) and read[None, 1] == ("AB-02", 110.0, 120.25, None, 7.0) and len(read) == 6
    assert got.where("id = 1 and row = 0").head().units == {"from": "m", "to": "m", "gold": "g/t", "silver": "g/t"}
    assert G.text_tables(pages.limit(0), "id", "body").count() == 0
