"""The SQL surface: readers as table functions for LATERAL joins, folds over a partitioned table argument, and code identity.

``register(spark)`` makes ``reader_<name>(headline, body)`` of every reader, ``tables_in(html)``, ``deals_in(text)`` and
``gap_sessions(gap => ..., row => TABLE(...) PARTITION BY ... ORDER BY ...)`` known to Spark SQL. Each row is read by itself in a task; the
expressions of ``extractors`` do the same without Python and are the faster way where no SQL is asked for.
"""

from __future__ import annotations

import ast
import hashlib
import importlib
import importlib.util
import inspect
import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.functions import deals, grids
from tessera.functions.extractors import READERS, Extractor

FACTS = "ordinal int, field string, value_num double, value_text string, unit string, span_start int, span_end int"
_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%B %d, %Y", "%d %B %Y", "%m/%d/%Y")
_NUMBER = re.compile(r"[+-]?(\d{1,3}(,\d{3})*|\d*)(\.\d+)?")


def _number(text: str) -> float | None:
    return float(text.replace(",", "")) if _NUMBER.fullmatch(text) and any(c.isdigit() for c in text) else None


def _date(text: str) -> str:
    for form in _FORMATS:
        try:
            return datetime.strptime(text, form).strftime("%Y-%m-%d")
        except ValueError:
            continue
    return text


def reader_function(reader: Extractor):
    """The table function of a reader: its facts in a headline and a body, places counted from the headline's first letter, with
    a line end between the two. A null headline is left out, without texts there are no facts."""
    forms = []
    for form in reader.forms:
        fields = [(f"f{i}", p.field, p.kind) for i, p in enumerate(form) if p.field]
        forms.append(("".join(f"(?P<f{i}>{p.pattern})" if p.field else f"(?:{p.pattern})" for i, p in enumerate(form)), fields))

    class Read:
        def eval(self, headline: str, body: str):
            text = "\n".join(t for t in (headline, body) if t is not None)
            records = sorted(((m.start(), k, m) for k, (pattern, _) in enumerate(forms) for m in re.finditer(pattern, text)), key=lambda r: r[:2])
            for ordinal, (_, k, found) in enumerate(records):
                for group, name, kind in forms[k][1]:
                    start, end = found.span(group)
                    if end > start:
                        said, value, unit = found[group], None, None
                        if kind == "number":
                            value = _number(said)
                        elif kind == "money":
                            value, unit = deals._value("MONEY", said)
                        yield ordinal, name, value, _date(said) if kind == "date" else said, unit, start, end

    return udtf(Read, returnType=FACTS)


@udtf(returnType=grids.CELL)
class TablesIn:
    """Cells of the tables of a page."""

    def eval(self, html: str):
        for number, grid in enumerate(grids.markup_grids(html or "")):
            for cell in grids.cells(grid):
                yield number, *cell


@udtf(returnType="deal int, step string, kind string, count double, price double, currency string, total double")
class DealsIn:
    """Deals of a text."""

    def eval(self, text: str):
        for number, d in enumerate(deals.deals_of(text or ""), 1):
            yield number, *(d.slots.get(k) for k in ("step", "kind", "count", "price", "currency", "total"))


@udtf(returnType="key bigint, session int, first_at bigint, last_at bigint, items int")
class GapSessions:
    """Rows (key, at) of a partition in order of ``at``: a session ends before a row that comes ``gap`` or more after the last."""

    def __init__(self):
        self.number, self.held = 0, None

    def eval(self, row, gap: int):
        key, at = row["key"], row["at"]
        if self.held and at - self.held[3] < gap:
            self.held = (*self.held[:3], at, self.held[4] + 1)
            return
        if self.held:
            yield self.held
        self.number += 1
        self.held = (key, self.number, at, at, 1)

    def terminate(self):
        if self.held:
            yield self.held


def register(spark: SparkSession) -> list[str]:
    """Names of the table functions that Spark SQL knows from now on."""
    functions = {f"reader_{name}": reader_function(reader) for name, reader in READERS.items()} | {"tables_in": TablesIn, "deals_in": DealsIn, "gap_sessions": GapSessions}
    for name, function in functions.items():
        spark.udtf.register(name, function)
    return sorted(functions)


def _definitions(module: str) -> tuple[dict[str, ast.AST], dict[str, tuple[str, str | None]]]:
    """Top-level definitions of a module by name, and its imports: name -> (module, name there or None for a module)."""
    tree = ast.parse(inspect.getsource(importlib.import_module(module)))
    own: dict[str, ast.AST] = {}
    borrowed: dict[str, tuple[str, str | None]] = {}
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
            own[node.name] = node
        elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                for name in ast.walk(target):
                    if isinstance(name, ast.Name):
                        own[name.id] = ast.Tuple([own[name.id], node]) if name.id in own else node
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom) and node.module:
            for a in node.names:
                borrowed[a.asname or a.name] = (node.module, a.name)
        elif isinstance(node, ast.Import):
            for a in node.names:
                borrowed[a.asname or a.name.split(".")[0]] = (a.name if a.asname else a.name.split(".")[0], None)
    return own, borrowed


def _is_module(name: str) -> bool:
    try:
        return importlib.util.find_spec(name) is not None
    except ModuleNotFoundError:
        return False


class _Bare(ast.NodeTransformer):
    """Code without docstrings: words about it don't change what it is."""

    def _stripped(self, node):
        self.generic_visit(node)
        if node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str):
            node.body = node.body[1:] or [ast.Pass()]
        return node

    visit_FunctionDef = visit_ClassDef = visit_AsyncFunctionDef = _stripped


def code_identity(module: str, name: str, package: str = "tessera") -> str:
    """SHA-256 of a definition and of all definitions of the package that it borrows, in turn: names, not positions or comments, count."""
    seen: dict[tuple[str, str], str] = {}
    known: dict[str, tuple[dict, dict]] = {}
    wanted = [(module, name)]
    while wanted:
        place = wanted.pop()
        if place in seen:
            continue
        if place[0] not in known:
            known[place[0]] = _definitions(place[0])
        own, borrowed = known[place[0]]
        if place[1] not in own:
            if place[1] in borrowed and borrowed[place[1]][0].split(".")[0] == package:  # passed on
                wanted.append((borrowed[place[1]][0], borrowed[place[1]][1] or ""))
            continue
        node = own[place[1]]
        for used in ast.walk(node):
            if isinstance(used, ast.Name):
                if used.id in own:
                    wanted.append((place[0], used.id))
                elif used.id in borrowed and borrowed[used.id][1] and borrowed[used.id][0].split(".")[0] == package:
                    wanted.append((borrowed[used.id][0], borrowed[used.id][1]))
            elif isinstance(used, ast.Attribute) and isinstance(used.value, ast.Name) and used.value.id in borrowed:
                origin, inner = borrowed[used.value.id]
                inside = f"{origin}.{inner}" if inner else origin
                if origin.split(".")[0] == package and (not inner or _is_module(inside)):
                    wanted.append((inside, used.attr))
        seen[place] = ast.dump(_Bare().visit(ast.parse(ast.unparse(node))))
    return hashlib.sha256("\n".join(f"{m}:{n}:{code}" for (m, n), code in sorted(seen.items())).encode()).hexdigest()


def reader_identity(reader: Extractor) -> str:
    """SHA-256 of a reader: its forms, and the code that reads them."""
    code = code_identity("tessera.functions.sqlsurface", "reader_function") + code_identity("tessera.functions.extractors", "extracted")
    return hashlib.sha256(f"{code}\n{reader.forms!r}".encode()).hexdigest()


RUNS = "extractor string, version string, code_sha string"


def admitted_run(runs: DataFrame, reader: Extractor) -> DataFrame:
    """``runs`` (extractor, version, code_sha) with this run; a version that has run with other code is refused."""
    sha = reader_identity(reader)
    other = runs.where((F.col("extractor") == reader.name) & (F.col("version") == reader.version) & (F.col("code_sha") != sha)).head(1)
    if other:
        raise ValueError(f"{reader.name} {reader.version} has run with other code ({other[0].code_sha[:12]}, now {sha[:12]}): give it a new version")
    own = runs.sparkSession.createDataFrame([(reader.name, reader.version, sha)], RUNS)
    return runs.select("extractor", "version", "code_sha").unionByName(own).distinct()
