"""Table functions in SQL against the expressions that do the same, and code identity."""

import dataclasses
import importlib
import sys

import pytest
from pyspark.sql import functions as F

from tessera.functions import sqlsurface as S
from tessera.functions.extractors import READERS, extracted
from tessera.plans.extract import FILLER, K, TEMPLATES, _parts
from tessera.sources.tables import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["drill_results", "financings", "permits", "royalty_terms", "calendar", "bulletins", "drill_depths"])
def test_readers_in_sql_give_the_facts_of_the_expressions(spark, name):
    S.register(spark)
    sentence = f"concat('{FILLER[0]}', {', '.join(e for _, e in _parts(TEMPLATES[name]))}, ' ', {', '.join(e for _, e in _parts(TEMPLATES[name]))}, '{FILLER[1]}')".replace("\n", "\\n")
    releases = table(spark, SF, "orders").limit(200).select(F.col(K).alias("id"), F.expr(sentence).alias("body"))
    columns = ["id", "ordinal", "field", "value_num", "value_text", "unit", "span_start", "span_end"]
    want = extracted(releases, READERS[name], "id", "body").select(*columns)
    got = spark.sql(f"SELECT r.id, f.* FROM {{releases}} r, LATERAL reader_{name}(NULL, r.body) f", releases=releases).select(*columns)
    assert want.count() > 400 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_null_and_empty_texts(spark):
    names = S.register(spark)
    assert len(names) == len(READERS) + 3
    for args in ("NULL, NULL", "'', ''", "'x', NULL"):
        assert spark.sql(f"SELECT * FROM reader_drill_results({args})").count() == 0
    assert spark.sql("SELECT * FROM tables_in(NULL)").count() == 0 and spark.sql("SELECT * FROM deals_in('')").count() == 0
    cells = spark.sql("SELECT header, text FROM tables_in('<table><tr><th>a<tr><td>1</table>')").collect()
    assert [tuple(r) for r in cells] == [("a", "1")]
    assert spark.sql("SELECT total FROM deals_in('Proceeds of $5 million.')").head().total == 5e6
    pages = table(spark, SF, "pages")
    assert spark.sql("SELECT count(*) AS n FROM {pages} p, LATERAL tables_in(p.html)", pages=pages).head().n == 0


CODE = '''"""About."""
import re
from identity_other import helper
LIMIT = 3
UNUSED = 1
def read(x):
    """Docs."""
    # comment
    return helper(x, LIMIT)
def other():
    return UNUSED
'''
HELPER = "def helper(x, n):\n    return deeper(x) * n\n\ndef deeper(x):\n    return x\n\ndef away():\n    return 1\n"


def test_code_identity_follows_what_is_borrowed(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))

    def identity(code, helper):
        import linecache

        for name, text in (("identity_reader", code), ("identity_other", helper)):
            (tmp_path / f"{name}.py").write_text(text)
            sys.modules.pop(name, None)
        linecache.clearcache()
        importlib.invalidate_caches()
        sys.dont_write_bytecode = True
        return S.code_identity("identity_reader", "read", "identity_other")

    first = identity(CODE, HELPER)
    assert identity(CODE.replace("Docs", "Other words").replace("# comment", "# more"), HELPER) == first
    assert identity(CODE.replace("UNUSED = 1", "UNUSED = 2"), HELPER.replace("return 1", "return 2")) == first
    assert identity(CODE.replace("LIMIT = 3", "LIMIT = 4"), HELPER) != first
    assert identity(CODE, HELPER.replace("return x\n", "return -x\n")) != first
    assert identity(CODE, HELPER) == first


def test_other_code_needs_a_new_version(spark):
    runs = S.admitted_run(spark.createDataFrame([], S.RUNS), READERS["permits"])
    assert runs.count() == 1 and S.admitted_run(runs, READERS["permits"]).count() == 1
    changed = dataclasses.replace(READERS["permits"], forms=READERS["debt"].forms)
    with pytest.raises(ValueError, match="new version"):
        S.admitted_run(runs, changed)
    assert S.admitted_run(runs, dataclasses.replace(changed, version="2.0.0")).count() == 2
