"""Spelling variants: words that differ by one code point, found by blocked Gram matrices of letter counts.

A task takes blocks of words as matrices of letter counts. The product of a block with itself and with the block of the next
length gives all squared distances; one edit changes them by at most two. Pairs at most two apart are verified.

Blocks are exact: of a word with ``base`` code points one edit lies in one part [i, j) of it, so both words of a pair begin with the same
i and end with the same base - j. A block holds the words that share these, of length base and of the next: words of a
length are dealt by the halves of a pair's shorter word. A block of more than LARGE words is dealt again by halves of its part, so
no block grows with the vocabulary: with a part of one code point, it holds the letters and pairs of letters at most.
A pair that fits several parts counts in the leftmost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_slices, written

#: A run of letters; of its lower-cased form only A-Z change. Deletions: one in DELETED runs of a document loses a code point.
LETTERS, FIRST_ACCENT, LAST_ACCENT, DELETED = r"[A-Za-zÀ-ÿ]+", 0xC0, 0xFF, 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words of a block above which it is dealt again; words of small blocks that are multiplied together, and their letters with
#: all filled up to one length; side of a tile.
LARGE, TOGETHER, MOST_LETTERS, TILE = 2048, 256, 1 << 20, 512
#: Different runs that a task counts before it passes their counts on.
HELD = 500_000
_WIDTH = 26 + LAST_ACCENT - FIRST_ACCENT + 1


def count_words(docs: DataFrame, id_col: str, text_col: str, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of all texts by number of occurrences, with the deletions that a document's id gives."""
    found = re.compile(LETTERS.replace("A-Z", ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in in_slices(batches, 64):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(found.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % DELETED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield passed_on()
        yield passed_on()

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _block(word: Column, base: Column, i: Column, j: Column) -> Column:
    """Hash of what all words of a block share. Blocks of equal hashes share tasks; pairs are verified with their parts."""
    begins = F.substring(word, F.lit(1), i)
    ends = F.substring(word, i + F.length(word) - base + (j - i) + 1, base - j)
    return F.xxhash64(base, i, j, begins, ends)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row (word, n, base, i, j) by the two halves of its part, one where it has one code point."""
    middle = F.floor((F.col("i") + F.col("j")) / 2).cast("int")
    parts = F.array(F.struct("i", middle.alias("j")), F.struct(middle.alias("i"), "j"))
    dealt = rows.select("word", "n", "base", F.explode(F.filter(parts, lambda p: p.i < p.j)).alias("p"))
    return dealt.select("word", "n", "base", "p.i", "p.j", _block(F.col("word"), F.col("base"), F.col("p.i"), F.col("p.j")).alias("block"))


def blocks(words: DataFrame, least_length: int = LEAST_LENGTH, large: int = LARGE) -> DataFrame:
    """(block, base, i, j, word, n): each word in all its blocks, none of more than ``large`` words where it can be dealt again."""
    bases = F.explode(F.array(F.length("word"), F.length("word") - 1))
    rows = words.select("word", "n", bases.alias("base")).where(F.col("base") >= least_length)
    rows = _halves(rows.withColumns({"i": F.lit(0), "j": F.col("base")}))
    done = None
    while True:
        sizes = rows.where(F.col("j") - F.col("i") > 1).groupBy("block").agg(F.count("*").alias("size"))
        hot = written(sizes.where(F.col("size") > large).select("block"), "large-blocks")
        if not hot.head(1):
            return rows if done is None else done.unionByName(rows)
        small = rows.join(hot, "block", "left_anti")
        small = small.unionByName(rows.where(F.col("j") - F.col("i") <= 1).join(hot, "block", "left_semi"))
        done = small if done is None else done.unionByName(small)
        rows = _halves(rows.where(F.col("j") - F.col("i") > 1).join(hot, "block", "left_semi"))


class Words:
    """Words as rows of letter numbers, from the left and from the right, and as letter counts."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        letters = np.where(points < FIRST_ACCENT, points - ord("a"), points - FIRST_ACCENT + 26)
        row = np.repeat(np.arange(len(words)), self.lengths)
        at = np.arange(len(points)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        wide = int(self.lengths.max(initial=0))
        self.left = np.full((len(words), wide), 255, np.uint8)
        self.left[row, at] = letters
        self.right = np.full((len(words), wide), 255, np.uint8)
        self.right[row, np.repeat(self.lengths, self.lengths) - 1 - at] = letters
        # products of counts are sums of whole numbers, exact in single precision below 2 ** 24
        self.counts = np.bincount(row * _WIDTH + letters, minlength=len(words) * _WIDTH).reshape(-1, _WIDTH).astype(np.float32 if wide < 4096 else np.float64)
        self.squares = (self.counts * self.counts).sum(axis=1)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal letters at the beginning of rows; both are filled up with a letter that no word has."""
    differ = (a != b) | (a == 255)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def near_pairs(w: Words, block: np.ndarray, base: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of rows of one block that are one edit apart in the block's part, and in none to its left; a is of the base's length."""
    first, second = [], []
    for x in range(0, len(block), TILE):
        for y in range(x, len(block), TILE):
            p, q = slice(x, x + TILE), slice(y, y + TILE)
            if y > x and block[y - 1] != block[y]:
                break  # rows of a block are together
            gram = w.counts[p] @ w.counts[q].T
            close = w.squares[p, None] + w.squares[None, q] - 2 * gram <= 2
            close &= (block[p, None] == block[None, q]) & (base[p, None] == base[None, q])
            a, b = np.nonzero(close)
            a, b = a + x, b + y
            kept = (a < b) & ((w.lengths[a] == base[a]) | (w.lengths[b] == base[b]))
            a, b = a[kept], b[kept]
            turned = w.lengths[a] > base[a]
            first.append(np.where(turned, b, a))
            second.append(np.where(turned, a, b))
    a, b = np.concatenate(first), np.concatenate(second)
    begins, ends, length = common(w.left[a], w.left[b]), common(w.right[a], w.right[b]), w.lengths[a]
    edit = np.where(w.lengths[b] == length, begins + ends == length - 1, begins + ends >= length)
    inside = (begins >= i[a]) & (ends >= base[a] - j[a]) & (i[a] == i[b]) & (j[a] == j[b])
    leftmost = (i[a] == 0) | (ends < base[a] - i[a])
    kept = edit & inside & leftmost
    return a[kept], b[kept]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, base, ...), sorted by base and block, in batches of whole blocks: small blocks together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        keys = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y:
                continue
            part = batch.slice(x, y - x)
            same = held and held[-1].column(0)[0].as_py() == keys[x]
            if held and not same and (n >= TOGETHER or (n + y - x) * part.column(1)[0].as_py() > MOST_LETTERS):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
            held.append(part)
            n += y - x
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best_n, best) of sorted rows (block, base, i, j, word, n): what the pairs of each batch give."""
    for batch in _gathered(batches):
        block, base, i, j = (np.asarray(batch.column(k)) for k in range(4))
        words, n = batch.column(4).to_pylist(), np.asarray(batch.column(5))
        if len(words) < 2:
            continue
        a, b = near_pairs(Words(words), block, base, i, j)
        one, other = np.concatenate([a, b]), np.concatenate([b, a])
        if not len(one):
            continue
        name = np.array(words, object)
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[other], -n[other], one))
        one, other = one[order], other[order]
        starts = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
        counts = np.diff(np.append(starts, len(one)))
        yield pa.RecordBatch.from_arrays([
            pa.array(name[one[starts]], pa.string()), pa.array(counts, pa.int64()), pa.array(n[other[starts]], pa.int64()), pa.array(name[other[starts]], pa.string()),
        ], ["word", "n_near", "best_n", "best"])


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, large: int = LARGE) -> DataFrame:
    """(word, form, root string; n, n_near, form_n long) of each word that is long and frequent enough.

    Words are near if one code point is inserted, deleted or replaced. form: the near word with the largest n, ties by code
    points, if its n is RATIO times the word's or more, else null. root: the end of the chain of forms, the word itself without
    one. Null texts have no words; a null id counts as empty text where runs lose a code point; repeated rows count
    as often as they occur; texts and words of any length. Other columns aren't read. Empty in, empty out.
    """
    words = written(count_words(docs, id_col, text_col, least_length, least_count), "words")
    dealt = blocks(words, least_length, large).select("block", "base", "i", "j", "word", "n")
    dealt = dealt.repartition("base", "block").sortWithinPartitions("base", "block")
    seen = dealt.mapInArrow(_neighbours, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    near = seen.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    found = words.join(near, "word", "left")
    form_n = -F.col("b.less")
    formed = form_n >= RATIO * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("b.best")).alias("form"), F.when(formed, form_n).alias("form_n"))
    found = written(found, "forms")
    steps, most = 0, (words.agg(F.max("n")).head()[0] or 1) // least_count
    while most >= RATIO:  # a chain grows by RATIO with each form
        steps, most = steps + 1, most // RATIO
    up = found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    reach = 1
    while reach < steps:  # each round doubles the forms that a link spans
        links = written(up, "roots") if reach > 1 else up
        up = links.join(links.toDF("_word", "_root"), F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"))
        reach *= 2
    return found.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _crc(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text of ASCII and Latin-1 letters, with the table ``t``."""
    points = f"list_transform(string_split({text}, ''), lambda c: ord(c))"
    octets = f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [195, p - 64] END))"
    step = "xor(c >> 8, t[(xor(c, CAST(b AS BIGINT)) & 255) + 1])"
    return f"xor(list_reduce({octets}, lambda c, b: {step}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def _oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: {bit}, i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{LETTERS}')), '{upper}', '{lower}') AS run FROM documents),
hashed AS (SELECT run, n, {_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL), tab),
cut AS (SELECT CASE WHEN h % {DELETED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS MATERIALIZED (SELECT word, substr(word, 1, k) AS a, substr(word, k + 2) AS b FROM (SELECT word, unnest(range(length(word))) AS k FROM words)),
pairs AS MATERIALIZED (
    SELECT p.word, q.word AS near FROM places p JOIN places q ON p.a = q.a AND p.b = q.b AND p.word <> q.word
    UNION SELECT p.word, w.word FROM places p JOIN words w ON w.word = p.a || p.b
    UNION SELECT w.word, p.word FROM places p JOIN words w ON w.word = p.a || p.b),
ranked AS (SELECT p.word, near, v.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
    row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, near COLLATE "binary") AS k FROM pairs p JOIN words v ON v.word = p.near),
found AS MATERIALIZED (SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form,
    CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n FROM words w LEFT JOIN ranked r ON w.word = r.word AND k = 1),
up(word, root, form) AS (SELECT word, word, form FROM found UNION ALL SELECT u.word, f.word, f.form FROM up u JOIN found f ON f.word = u.form)
SELECT f.word, f.form, u.root, n, n_near, form_n FROM found f JOIN up u ON u.word = f.word AND u.form IS NULL"""


ORACLE = _oracle()
