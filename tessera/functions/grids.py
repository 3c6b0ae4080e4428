"""Tables of pages and texts as cells: a grid is rebuilt from markup or from alignment, headers pass down to the cells they stand over.

Markup: cells that span rows or columns fill all their places. Text: lines that keep the same blank columns are a table; its
columns lie between them. In both, the rows on top that hold no figures are headers: a column's header is what they say from
top to bottom. Parsing one table is a small helper in a task; Spark deals the rows, and readers of cells are DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import parsed_number

#: Most columns that a cell may span (as browsers have it); blanks that part columns of a text; lines of its smallest table.
MOST_SPAN, GAP, LEAST_LINES = 1000, 2, 3
CELL = "table int, row int, col int, header string, label string, text string"
_FIELDS = re.compile(r"\S+(?: \S+)*")
_SPAN = re.compile(r"\s*(\d{1,6})")

Grid = list[list[tuple[str, bool]]]  # rows of (text, whether it is marked as a header)


class _Markup(HTMLParser):
    """Tables in the order of their ends; a table inside a cell is a table of its own and no part of the cell's text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[list[list[tuple[str, int, int, bool]]]] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"rows": [], "cell": None})
        elif self.open and tag == "tr":
            self._close_cell()
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th"):
            self._close_cell()
            spans = dict(attrs)
            span = lambda name: int(found[1]) if name in spans and (found := _SPAN.match(spans[name] or "")) else 1
            self.open[-1]["cell"] = ([], max(1, min(span("colspan"), MOST_SPAN)), span("rowspan"), tag == "th")
        elif tag in ("br", "p", "div", "li"):
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr"):
            self._close_cell()
        elif self.open and tag == "table":
            self._close_table()

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][0].append(data)

    def _close_cell(self):
        table = self.open[-1]
        if table["cell"]:
            text, across, down, marked = table["cell"]
            if not table["rows"]:
                table["rows"].append([])
            table["rows"][-1].append((self.joined(text), across, down, marked))
            table["cell"] = None

    def joined(self, text: list[str]) -> str:
        return " ".join("".join(text).split())

    def _close_table(self):
        self._close_cell()
        self.done.append(self.open.pop()["rows"])

    def close(self):
        super().close()
        while self.open:  # tables that nobody closed
            self._close_table()


#: A tag without references, and its attributes. Markup of other tags is left to the full parser.
_SIMPLE = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \t\n]+[A-Za-z][-A-Za-z]*(?:=(?:"[^"]*"|'[^']*'|[^\s"'=`/]+))?)*)[ \t\n]*>""")
_ATTRIBUTE = re.compile(r"""([A-Za-z][-A-Za-z]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'=]+)))?""")
_TAG = re.compile(r"(<[^<>]*>)")
#: Tags whose content the parser doesn't read as markup.
_RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"))


class _Layout(_Markup):
    """Cells of tags alone: a text is the numbers of its pieces, and blanks."""

    def joined(self, text):
        return tuple(text)


@lru_cache(4096)
def _layout(tags: tuple[str, ...]) -> list[list[list[tuple[tuple, bool]]]] | None:
    """Grids of markup that has these tags, one piece of text before, between and after them; None where a tag isn't simple."""
    parser = _Layout()
    parser.handle_data(0)
    for number, tag in enumerate(tags, 1):
        m = _SIMPLE.fullmatch(tag)
        if not m or (name := m[2].lower()) in _RAW:
            return None
        if m[1]:
            parser.handle_endtag(name)
        else:
            parser.handle_starttag(name, [(a.lower(), x or y or z) for a, x, y, z in _ATTRIBUTE.findall(m[3])])
        parser.handle_data(number)
    parser.close()
    return [filled(rows) for rows in parser.done if any(rows)]


def filled(rows: list[list[tuple[str, int, int, bool]]]) -> Grid:
    """Rows in which each cell (text, columns, rows, marked) stands in all places it spans; a span of 0 rows goes to the end."""
    grid: Grid = []
    reaching: dict[int, tuple[int, tuple[str, bool]]] = {}  # column -> (rows left, cell)
    for number, row in enumerate(rows):
        if not reaching and all(down == 1 for _, _, down, _ in row):  # each cell stands in its row only
            grid.append([(text, marked) for text, across, _, marked in row for _ in range(across)])
            continue
        line: list[tuple[str, bool]] = []
        left = iter(row)
        following = next(left, None)
        while following or len(line) in reaching or any(c > len(line) for c in reaching):
            at = len(line)
            if at in reaching:
                rest, cell = reaching.pop(at)
                line.append(cell)
                if rest > 1:
                    reaching[at] = (rest - 1, cell)
                if not following and not any(c > at for c in reaching):
                    break
            elif following:
                text, across, down, marked = following
                for c in range(at, at + across):
                    if c in reaching and c > at:
                        break  # a cell from above stands in the way
                    line.append((text, marked))
                    if down != 1:
                        reaching[c] = (len(rows) - number - 1 if down == 0 else min(down - 1, len(rows) - number - 1), (text, marked))
                following = next(left, None)
            else:
                line.append(("", False))
            if reaching:
                reaching = {c: r for c, r in reaching.items() if r[0] > 0}
            if not following and all(c < len(line) for c in reaching):
                break
        grid.append(line)
    return grid


def _has_figure(text: str) -> bool:
    return any(c.isdigit() for c in text)


def cells(grid: Grid) -> Iterator[tuple[int, int, str, str, str]]:
    """(row, col, header, label, text) of the cells below the headers; label is the text of the row's first column."""
    marked = any(m for row in grid for _, m in row)
    top = 0
    while top < len(grid) and (all(m or not t for t, m in grid[top]) if marked else not any(_has_figure(t) for t, _ in grid[top])):
        top += 1
    if top == len(grid):  # no figures at all: the first row is the header
        top = min(1, top)
    headers: dict[int, list[str]] = {}
    for row in grid[:top]:
        for col, (text, _) in enumerate(row):
            said = headers.setdefault(col, [])
            if text and (not said or said[-1] != text):
                said.append(text)
    for at, row in enumerate(grid[top:]):
        for col, (text, _) in enumerate(row):
            yield at, col, " > ".join(headers.get(col, [])), row[0][0], text


def markup_grids(html: str) -> list[Grid]:
    pieces = _TAG.split(html)
    texts = pieces[::2]
    if "&" not in html and not any("<" in t for t in texts) and (layout := _layout(tuple(pieces[1::2]))) is not None:
        said: dict[tuple, str] = {}
        for held in {held for grid in layout for row in grid for held, _ in row if held != ""}:
            said[held] = " ".join("".join([" " if k == " " else texts[k] for k in held]).split())
        return [[[(said[held] if held != "" else "", marked) for held, marked in row] for row in grid] for grid in layout]
    parser = _Markup()
    parser.feed(html)
    parser.close()
    return [filled(rows) for rows in parser.done if any(rows)]


def _blocks(lines: list[str]) -> Iterator[list[str]]:
    """Runs of lines that each hold two fields or more; a single line with less, but inside of the columns, is no end."""
    held: list[str] = []
    for line in [*lines, ""]:
        if len(_FIELDS.findall(line)) >= 2:
            held.append(line)
        else:
            if len(held) >= LEAST_LINES:
                yield held
            held = []


def _header(line: str, edges: list[list[int]]) -> list[tuple[str, bool]]:
    """A header line's fields over the columns they touch. Where there are fewer fields than columns, a column that none touches
    takes the nearest, as a field may stand over several columns; the first column, which holds labels, doesn't."""
    fields = list(_FIELDS.finditer(line))
    touching = [[f for f in fields if f.start() < b and f.end() > a] for a, b in edges]
    if len(fields) < len(edges):
        for k, (a, b) in enumerate(edges):
            if k and not touching[k]:
                touching[k] = [min(fields, key=lambda f: abs(f.start() + f.end() - a - b))]
    else:
        for f in fields:
            if not any(f in found for found in touching):
                touching[min(range(len(edges)), key=lambda k: abs(sum(edges[k]) - f.start() - f.end()))].append(f)
    return [(" ".join(f.group() for f in found), True) for found in touching]


def text_grids(text: str) -> list[Grid]:
    """Tables of lines whose fields, parted by two blanks or more, keep their columns."""
    grids = []
    for block in _blocks([line.expandtabs(8).rstrip() for line in text.split("\n")]):
        top = next((k for k, line in enumerate(block) if _has_figure(line)), 1)
        body = block[top:]
        wide = max(map(len, body), default=0)
        inked = [any(c < len(line) and line[c] != " " for line in body) for c in range(wide)]
        edges: list[list[int]] = []
        for c, ink in enumerate(inked):
            if ink and (not edges or c - edges[-1][1] >= GAP):
                edges.append([c, c + 1])
            elif ink:
                edges[-1][1] = c + 1
        if len(edges) < 2:
            continue
        grid: Grid = []
        grid += [_header(line, edges) for line in block[:top]]
        grid += [[(" ".join(line[a:b].split()), False) for a, b in edges] for line in body]
        grids.append(grid)
    return grids


def _tables(docs: DataFrame, id_col: str, text_col: str, grids_of: Callable[[str], list[Grid]]) -> DataFrame:
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", *(part.split()[0] for part in CELL.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                place, found = [], []
                for k, text in enumerate(batch.column(1).slice(at, 64).to_pylist()):
                    for number, grid in enumerate(grids_of(text)):
                        for cell in cells(grid):
                            place.append(at + k)
                            found.append((number, *cell))
                columns = list(zip(*found, strict=True)) or [()] * 6
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return rows.mapInArrow(run, f"id {kind}, {CELL}").withColumnRenamed("id", id_col)


def html_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id_col, table, row, col, header, label, text): the cells of all tables of each page, from 0; null pages have none.

    Cells that aren't closed end where the next begins. Rows and null ids stay as they come; pages of one id aren't told apart.
    """
    return _tables(pages, id_col, html_col, markup_grids)


def text_tables(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same of the tables in plain texts."""
    return _tables(texts, id_col, text_col, text_grids)


def figure(text: Column) -> Column:
    """The number of a cell ("$1,234.50", "12.5 m", "(3)" is negative), null if it has none or several."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+"), F.lit(0))
    value = parsed_number(F.get(found, F.lit(0)))
    negative = text.rlike(r"^\s*\(.*\)\s*$|^\s*[-−][\s$]*[0-9.]")
    return F.when(F.size(found) == 1, F.when(negative, -value).otherwise(value))


def measured(cells_of: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(id_col, table, row, label, one double a field, units): rows of cells, fields by a pattern on the header.

    The leftmost column that fits counts for a field. units maps a field to what its header has in brackets. Rows without any
    figure of a field give nothing.
    """
    which = F.coalesce(*[F.when(F.col("header").rlike(f"(?i){p}"), F.lit(f)) for f, p in fields.items()])
    read = cells_of.withColumns({"field": which, "value": figure(F.col("text")), "unit": F.nullif(F.regexp_extract("header", r"\(([^()]*)\)[^()]*$", 1), F.lit(""))}).where("field is not null and value is not null")
    first = [F.min_by(F.struct("value", "unit", "label"), F.when(F.col("field") == f, F.col("col"))).alias(f"_{i}") for i, f in enumerate(fields)]
    # one shuffle, of the figures of fields only
    rows = read.select(id_col, "table", "row", "col", "field", "value", "unit", "label").repartition(id_col, "table", "row").groupBy(id_col, "table", "row").agg(*first)
    given = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_{i}.unit").isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"_{i}.unit").alias("unit"))) for i, f in enumerate(fields)])))
    labels = [F.col(f"_{i}.label") for i in range(len(fields))]
    label = F.greatest(*labels) if len(labels) > 1 else labels[0]
    return rows.select(id_col, "table", "row", label.alias("label"), *[F.col(f"_{i}.value").alias(f) for i, f in enumerate(fields)], F.map_from_entries(given).alias("units"))
