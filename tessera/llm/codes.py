"""Vector code compression: each part of a vector becomes the number of its codebook's nearest entry, in integers only.

Components are floor(SCALE * x). A part and the entries are padded with zeros to a power of two P and put through the Walsh-
Hadamard transform, which multiplies every squared distance by P. Squared differences of the coefficients are added in
sequency order, slow waves first, where most of a distance lies; an entry whose sum so far passes the whole distance of a
good entry is out, which is exact since sums only grow. Codebooks are fitted by rounds of nearest entries and means rounded
down: each round is one pass in which a task adds up its parts by entry, and only sums, one for each component of each
entry, are brought together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Labels up to which their sums are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
#: Sums travel in limbs of so many bits, so that their totals fit a long at any magnitude.
LIMB = 40
#: Vectors that are worked on together.
TOGETHER = 2048


def sequency(size: int) -> np.ndarray:
    """Rows of the Hadamard matrix of a power of two by number of sign changes: bits reversed, then Gray coded."""
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    return sum(((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)) if bits else np.zeros(1, np.int64)


def walsh(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis (a power of two long) by sums and differences, in sequency order."""
    size, half = x.shape[-1], 1
    while half < size:
        pairs = x.reshape(*x.shape[:-1], size // (2 * half), 2, half)
        x = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(x.shape)
        half *= 2
    return x[..., sequency(size)]


def padded(x: np.ndarray, size: int) -> np.ndarray:
    room = np.zeros((*x.shape[:-1], size), x.dtype)
    room[..., : x.shape[-1]] = x
    return room


def nearest_entries(t: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, scaled squared distance) of each transformed part; ties go to the lower index."""
    size, step = t.shape[1], 2
    first = t[:, None, :step] - entries[None, :, :step]
    sums = (first * first).sum(axis=2)
    guess = t - entries[sums.argmin(axis=1)]
    bound = (guess * guess).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    partial = sums[row, entry]
    while step < size:
        more = t[row, step : 2 * step] - entries[entry, step : 2 * step]
        partial = partial + (more * more).sum(axis=1)
        still = np.flatnonzero(partial <= bound[row])
        row, entry, partial = row[still], entry[still], partial[still]
        step *= 2
    final = np.repeat(bound[:, None] + 1, len(entries), axis=1)
    final[row, entry] = partial
    best = final.argmin(axis=1)
    return best, final[np.arange(len(t)), best]


@dataclass
class Codebooks:
    """entries[part][entry] are lists of integer components; empty where there was no vector."""

    length: int
    entries: list[list[list[int]]]

    @property
    def width(self) -> int:
        return -(-self.length // PARTS)

    @property
    def size(self) -> int:
        return 1 << max(0, self.width - 1).bit_length()

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(c) for part in self.entries for entry in part for c in entry).encode()).hexdigest()


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as int64, as Python integers where one may not fit."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    if (np.abs(scaled) < 2.0**62).all():
        return scaled.astype(np.int64)
    whole = [math.floor(s) if math.isfinite(s) else int(v) * SCALE for s, v in zip(scaled.ravel().tolist(), x.ravel().tolist(), strict=True)]
    return np.array(whole, object).reshape(x.shape)


def parts_of(column: pa.Array, books: Codebooks) -> Iterator[np.ndarray]:
    """Integer parts (vector, part, position) of TOGETHER vectors at a time; parts that run over the end are filled with zeros."""
    for at in range(0, len(column), TOGETHER):
        piece = column.slice(at, TOGETHER)
        x = integers(np.asarray(piece.flatten(), np.float64).reshape(len(piece), books.length))
        yield padded(x, PARTS * books.width).reshape(len(piece), PARTS, books.width)


def _assigned(parts: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(entries, squared distances) of all parts, in Python integers where 64 bits might not hold the sums."""
    largest = max(abs(int(parts.max(initial=0))), abs(int(parts.min(initial=0))), *(abs(c) for part in books.entries for entry in part for c in entry), 1)
    kind = np.int64 if 4 * books.size**2 * largest**2 < 1 << 63 else object
    codes, errors = [], []
    for j in range(PARTS):
        entries = np.array(books.entries[j], kind).reshape(len(books.entries[j]), books.width)
        best, scaled = nearest_entries(walsh(padded(parts[:, j].astype(kind), books.size)), walsh(padded(entries, books.size)))
        codes.append(best)
        errors.append(scaled // books.size)
    return np.array(codes).T, np.array(errors, kind).T


def usable(docs: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): vectors without null or non-finite components, as doubles."""
    v = F.col(vector_col)
    fine = F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return docs.where(fine).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.cast("array<double>").alias("v"))


def _starting(rows: DataFrame, length: int) -> Codebooks:
    """Parts of the ENTRIES rows with the smallest ids; equal ids by their vectors, null ids last."""
    least = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    books = Codebooks(length, [])
    x = padded(integers(np.array([r.v for r in least], np.float64).reshape(len(least), length)), PARTS * books.width)
    books.entries = [[[int(c) for c in entry] for entry in x[:, j * books.width : (j + 1) * books.width]] for j in range(PARTS)]
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round."""
    width, n = books.width, len(books.entries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, n, width + 1), object)
        for batch in batches:
            for parts in parts_of(batch.column(0), books):
                codes, _ = _assigned(parts, books)
                for j in range(PARTS):
                    order = np.argsort(codes[:, j], kind="stable")
                    used, starts, counts = np.unique(codes[order, j], return_index=True, return_counts=True)
                    # halves of 32 bits: sums of TOGETHER of them fit 64
                    x = parts[order, j]
                    high, low = x >> 32, x & 0xFFFFFFFF
                    added = [np.add.reduceat(h, starts, axis=0).astype(object) if width else np.zeros((len(used), 0), object) for h in (high, low)]
                    sums[j, used, :width] += added[0] * (1 << 32) + added[1]
                    sums[j, used, width] += counts.astype(object)
        cell, limb, value = [], [], []
        for i, total in enumerate(sums.ravel().tolist()):
            k = 0
            while total not in (0, -1):
                cell.append(i)
                limb.append(k)
                value.append(total & ((1 << LIMB) - 1))
                total >>= LIMB
                k += 1
            if total:  # what is left of a negative number
                cell.append(i)
                limb.append(k)
                value.append(-1)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], ["cell", "limb", "value"])

    partial = rows.select("v").mapInArrow(run, "cell int, limb int, value long")
    sums = [0] * (PARTS * n * (width + 1))
    for cell, limb, value in partial.groupBy("cell", "limb").agg(F.sum("value")).collect():
        sums[cell] += value << (LIMB * limb)
    moved = []
    for j in range(PARTS):
        moved.append([])
        for e in range(n):
            *total, count = sums[(j * n + e) * (width + 1) : (j * n + e + 1) * (width + 1)]
            moved[j].append([t // count for t in total] if count else books.entries[j][e])
    return Codebooks(books.length, moved)


def main_length(rows: DataFrame) -> int | None:
    """The length that most vectors have, the larger of two as frequent; None without vectors."""
    found = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return found[0].length if found else None


def fit(rows: DataFrame, length: int, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of rows (id, v) that all have ``length`` components."""
    books = _starting(rows, length)
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) of rows (id, label, v)."""
    names = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = [], []
            for parts in parts_of(batch.column(2), books):
                codes, errors = _assigned(parts, books)
                code += map("".join, names[codes].tolist())
                error += [e if e < 1 << 63 else None for e in errors.sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("id", "label", "v").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(id_col, code string, error long, label_error long, codebooks_sha256 string) of each usable vector.

    Vectors that are null or hold null or non-finite components take no part, nor do those of another length than the
    commonest (the larger of two as frequent). A length that PARTS doesn't divide is filled with zeros at its end. Any finite
    magnitude is exact; a sum that no long holds is null. Repeated rows and null ids count and stay, row by row; fewer rows than
    ENTRIES make smaller codebooks; null labels are one label. Other columns aren't read. Empty in, empty out.

    The rows are written once and read in each round; nothing is shuffled but sums.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col, label_col), "vectors")
    length = main_length(rows)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    if length is None:
        return spark.createDataFrame([], f"`{id_col}` {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string")
    rows = rows.where(F.size("v") == length)
    books = fit(rows, length, rounds)
    coded = written(encode(rows, books), "codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.when(F.count("*") == F.count("error"), F.try_sum("error")).alias("label_error"))
    if coded.select("label").distinct().limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        by_label = F.broadcast(by_label)
    found = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    return found.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle() -> str:
    """DuckDB SQL for the default columns, for vectors of one length that PARTS divides."""
    ctes = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cells AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(v) // {PARTS}) AS part, (i - 1) % (len(v) // {PARTS}) AS pos, v[i] AS x "
        "FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM kept))",
        "first_ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT " + str(ENTRIES) + ")",
        "book0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM cells JOIN first_ids USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        ctes += [
            f"dist{k} AS (SELECT vec_id, part, entry, sum((x - c) * (x - c)) AS d FROM cells JOIN book{k} USING (part, pos) GROUP BY ALL)",
            f"near{k} AS MATERIALIZED (SELECT vec_id, part, CAST(min(d) AS BIGINT) AS d, arg_min(entry, d * {ENTRIES} + entry) AS entry FROM dist{k} GROUP BY ALL)",
        ]
        if k < ROUNDS:
            ctes += [
                f"mean{k} AS (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM cells JOIN near{k} USING (vec_id, part) GROUP BY ALL)",
                f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c "
                f"FROM book{k} b LEFT JOIN mean{k} m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)",
            ]
    return f"""WITH {", ".join(ctes)},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


ORACLE = _oracle()
