"""Names of a dictionary in texts by one automaton a task: finds, and texts with the names masked.

Each task builds the automaton once and runs every text through it in time that doesn't depend on the number of names. Names are broadcast
only while they are at most NAMES and BYTES large (counted before); larger dictionaries are joined by runs of words.
Texts are compared word by word: lower case, everything but ASCII letters and digits parts words.
"""


import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import words
from tessera.operators.stores import dictionary_matches

#: Largest dictionary that goes to every task: names, and bytes of them.
NAMES, BYTES = 1_000_000, 64 << 20
_WORD = re.compile("[a-z0-9]+")
_automata: dict[int, ahocorasick.Automaton] = {}


def _lowered(text: str) -> str:
    """A-Z in lower case; other letters part words, so nothing else changes its place."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _plain(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Words with a blank before and after each, and their places in the text."""
    found = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(_lowered(text))]
    return " " + "".join(f"{w} " for w, _, _ in found), [(a, b) for _, a, b in found]


def _automaton(names: list[str], key: int) -> ahocorasick.Automaton:
    """One per worker process and dictionary."""
    if key not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for name in names:
            made.add_word(f" {name} ", name)
        made.make_automaton()
        _automata[key] = made
    return _automata[key]


def finds(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int, int]]:
    """(name, place of its first word, start, end in the text), leftmost first, the longest of those that begin together, none over another."""
    line, places = _plain(text)
    if not len(automaton):
        return []
    all_found = sorted(((end - len(name) - 1, -len(name), name) for end, name in automaton.iter(line)))
    out, free, word, at = [], 0, 0, 0
    for start, less, name in all_found:
        if start < free:
            continue
        word += line.count(" ", at, start)  # blanks before the name are its place
        at = start
        n = name.count(" ") + 1
        out.append((name, word, places[word][0], places[word + n - 1][1]))
        free = start - less + 1
    return out


def small_names(names: DataFrame) -> list[str] | None:
    """The different names (column ``name``) as plain words, None if they are too large to broadcast. Names without words are left out."""
    plain = names.select(F.array_join(words(F.col("name")), " ").alias("name")).where("name <> ''").distinct()
    n, size = plain.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).head()
    return sorted(r.name for r in plain.collect()) if n <= NAMES and size <= BYTES else None


def names_in(texts: DataFrame, id_col: str, text_col: str, names: DataFrame) -> DataFrame:
    """(id_col, name, at, start, end): names of the dictionary in each text, longest first, without overlaps; ``at`` counts words.

    start and end are places in the text, null where the dictionary is too large to broadcast. Null texts hold no names; repeated
    rows and null ids stay as they come (by id where it is joined).
    """
    known = small_names(names)
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    if known is None:
        plain = names.select(F.array_join(words(F.col("name")), " ").alias("name")).where("name <> ''").distinct()
        longest = plain.agg(F.max(F.size(F.split("name", " ")))).head()[0]
        found = dictionary_matches(rows, "id", words(F.col("t")), plain, longest)
        return found.select(F.col("id").alias(id_col), "name", "at", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    kind, key, sent = rows.schema["id"].dataType.simpleString(), hash(tuple(known)), texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent.value, key)
        for batch in batches:
            place, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                hits = finds(text, automaton)
                place += [k] * len(hits)
                found += hits
            name, at, start, end = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), pa.array(name, pa.string()), *(pa.array(c, pa.int32()) for c in (at, start, end))], ["id", "name", "at", "start", "end"])

    return rows.mapInArrow(run, f"id {kind}, name string, at int, start int, end int").withColumnRenamed("id", id_col)


def masked(texts: DataFrame, text_col: str, names: DataFrame, mask: str = "Xyz") -> DataFrame:
    """``texts`` with the names in a column replaced by a word that no rule knows. Dictionaries beyond NAMES and BYTES are refused."""
    known = small_names(names)
    if known is None:
        raise ValueError(f"more than {NAMES} names or {BYTES} bytes of them can't go to every task")
    key, sent = hash(tuple(known)), texts.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("string")
    def hidden(column: pd.Series) -> pd.Series:
        automaton = _automaton(sent.value, key)

        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for _, _, start, end in finds(text, automaton):
                out += [text[at:start], mask]
                at = end
            return "".join([*out, text[at:]])

        return column.map(one)

    return texts.withColumn(text_col, hidden(F.col(text_col)))
