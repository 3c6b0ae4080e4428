"""Packing documents into fixed sequences: cutting stock by column generation.

Documents are cut at every multiple of the sequence length, so only the rests are left to place. The histogram of
rounded piece lengths has at most ``CAPACITY / UNIT`` entries whatever the corpus; on it the driver solves the cutting
stock linear program by column generation, a knapsack dynamic program pricing new patterns. Rounded-down pattern
counts, and patterns for the few pieces left over, are ranges of ranks within a length class, and each piece finds
its sequence from its rank. Short pieces of one length go in bundles, which are placed like one piece, so that rounding a
length up to its class never costs more than a few hundredths. Ranks come from hashed groups with running offsets, so no class
is ordered in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, in_slices, ragged_positions, release_memory, written

CAPACITY, UNIT = 4096, 16
END_ID = 2
#: Words that one encoder keeps the ids of at most, those it keeps between tasks, and bytes of texts put together at a time.
CACHE_WORDS, KEPT_WORDS, SLICE_BYTES = 400_000, 150_000, 3_000_000
GROUP_PIECES = 50_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of a tokenizer whose pre-tokenizer never joins over white space, word by word with a bounded memory.

    A text's ids are its words' ids in order. Words of lower-case letters are one pre-token each, whose last id alone
    carries the end-of-word mark, so thousands are encoded as one string and told apart by it; others go one by one.
    """

    _LETTERS = re.compile("[a-zß-öø-ÿ]+")
    _TOGETHER = 2000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)
        self.n = np.zeros(1 << 16, np.int64)
        self.used = 0

    def trim(self) -> None:
        """Forget all but the words learnt first, which are the frequent ones."""
        if len(self.words) > KEPT_WORDS:
            self.words = dict(islice(self.words.items(), KEPT_WORDS))
            self.used = int(self.at[KEPT_WORDS])
            self.flat, self.at, self.n = (x[:m].copy() for x, m in ((self.flat, self.used), (self.at, KEPT_WORDS), (self.n, KEPT_WORDS)))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, _ = self._encode([" ".join(words[x : x + self._TOGETHER]) for x in range(0, len(words), self._TOGETHER)])
        stops = np.flatnonzero(self.ends[flat]) + 1
        if len(stops) != len(words):
            return self._encode(words)
        return flat, np.diff(stops, prepend=0)

    def _learn(self, new: list[bytes]) -> None:
        texts = [w.decode() for w in new]
        letters = [w for w in texts if self._LETTERS.fullmatch(w)]
        others = [w for w in texts if not self._LETTERS.fullmatch(w)]
        for strings, encode in ((letters, self._encode_letters), (others, self._encode)):
            if not strings:
                continue
            flat, n = encode(strings)
            first = len(self.words)
            self.words.update(zip([w.encode() for w in strings], range(first, first + len(strings)), strict=True))
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(flat) + len(self.flat) // 2, np.uint32)])
            if len(self.words) > len(self.at):
                more = np.zeros(len(strings) + len(self.at) // 2, np.int64)
                self.at, self.n = np.concatenate([self.at, more]), np.concatenate([self.n, more])
            self.flat[self.used : self.used + len(flat)] = flat
            self.at[first : len(self.words)] = self.used + np.cumsum(n) - n
            self.n[first : len(self.words)] = n
            self.used += len(flat)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        codes = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(codes < 0)
        if len(unknown):
            new = list({words[i] for i in unknown.tolist()})
            if len(self.words) + len(new) > CACHE_WORDS:
                self.trim()
                unknown = np.flatnonzero((codes < 0) | (codes >= len(self.words)))
                new = list({words[i] for i in unknown.tolist()})
            self._learn(new)
            codes[unknown] = np.fromiter((self.words[words[i]] for i in unknown.tolist()), np.int64, len(unknown))
        n = self.n[codes]
        return self.flat[ragged_positions(self.at[codes], n)], n


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(words of all texts in order, how many each text has): words whose ids, put together, are the texts'.

    The tokenizer folds case itself, so texts are folded first. A full stop or comma between a letter (a-z, or one of
    U+00E0 to U+00FF but the division sign) and white space is a pre-token by itself, so it stands as a word; fewer
    distinct words are left. Texts that may hold special tokens, which the tokenizer finds before, stay as they are.
    """
    odd = {i: t.split() for i, t in enumerate(texts) if b"<|" in t}
    joined = np.frombuffer(b"\n".join([b"" if i in odd else t for i, t in enumerate(texts)]).lower(), np.uint8)
    here = joined[2:-1]
    stop = np.flatnonzero(((here == 46) | (here == 44)) & _SPACE[joined[3:]]) + 2
    before, two_before = joined[stop - 1], joined[stop - 2]
    stop = stop[_LOWER[before] | ((two_before == 0xC3) & (before >= 0xA0) & (before <= 0xBF) & (before != 0xB7))]
    ends = np.cumsum([0 if i in odd else len(t) for i, t in enumerate(texts)]) + np.arange(len(texts))
    ends += np.searchsorted(stop, ends)
    spread = np.insert(joined, stop, 32)
    space = _SPACE[spread]
    starts = ~space
    starts[1:] &= space[:-1]
    n = np.diff(np.concatenate([[0], np.cumsum(starts)])[ends], prepend=0)
    words = spread.tobytes().split()
    if odd:
        at = np.cumsum(n) - n
        words = [w for i in range(len(texts)) for w in odd.get(i, words[at[i] : at[i] + n[i]])]
        n = np.array([len(odd[i]) if i in odd else n[i] for i in range(len(texts))])
    return words, n


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process and file; it lives on over tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_documents(texts: list, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """(position, ids) of each UTF-8 text; the ids of None are none. Long runs of texts are encoded together."""
    held: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        held.append(text or b"")
        size += len(held[-1])
        if size >= SLICE_BYTES or i == len(texts) - 1:
            words, n = split_words(held)
            ids, per_word = encoder(path).encode(words)
            ends = np.concatenate([[0], np.cumsum(per_word)])[np.cumsum(n)]
            for k, (x, y) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                yield first + k, ids[x:y]
            held, size, first = [], 0, i + 1


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, turn[, ids]): each document's ids with the end id, cut at multiples of capacity.

    turn counts the pieces of a task; it tells equal rows apart once they are written.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in in_slices(batches):
            owner, start, length, crc, total, turn, ids = [], [], [], [], [], [], []
            for i, tokens in encode_documents(as_bytes(batch.column(1)), path):
                tokens = np.concatenate([tokens, np.array([END_ID], np.uint32)]).astype("<u4")
                n = len(tokens)
                for x in range(0, n, capacity):
                    piece = tokens[x : x + capacity]
                    owner.append(i)
                    start.append(x)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    turn.append(seen)
                    seen += 1
                    if keep_ids:
                        ids.append(piece.astype(np.int32))
            cols = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, turn))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "turn"]
            if keep_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
        encoder(path).trim()
        release_memory()

    return kept.mapInArrow(run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, turn long" + ", ids array<int>" * keep_ids)


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best pattern for the values of lengths 1..capacity: (its value, count of each length)."""
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        options = value[:c] + best[c - 1 :: -1][:c]
        j = int(options.argmax())
        if options[j] > best[c - 1]:
            best[c], last[c] = options[j], j + 1
        else:
            best[c] = best[c - 1]
    pattern = np.zeros(capacity, np.int64)
    c = capacity
    while c > 0:
        if last[c]:
            pattern[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return best[capacity], pattern


def cutting_stock(demand: np.ndarray, gap: float = 2e-4, rounds: int = 5000) -> list[tuple[np.ndarray, int]]:
    """Patterns (count of each length 1..len(demand)) and how often each is used, so that all demand is met exactly.

    Revised simplex over columns that the knapsack prices; it ends when the dual bound is within ``gap``.
    """
    capacity = len(demand)
    rows = np.flatnonzero(demand)
    if not len(rows):
        return []
    d = demand[rows].astype(float)
    columns = np.zeros((capacity, len(rows)), np.int64)
    columns[rows, np.arange(len(rows))] = capacity // (rows + 1)
    inverse = np.diag(1.0 / columns[rows, np.arange(len(rows))])
    x = inverse @ d
    for _ in range(rounds):
        value = np.zeros(capacity)
        value[rows] = np.maximum(inverse.sum(axis=0), 0)
        price, pattern = knapsack(value, capacity)
        if price <= 1 + gap:
            break
        direction = inverse @ pattern[rows]
        up = direction > 1e-9
        ratio = np.where(up, x / np.where(up, direction, 1), np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        x = np.maximum(x - step * direction, 0)
        x[leave] = step
        pivot = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, pivot)
        inverse[leave] = pivot
        columns[:, leave] = pattern
    left = demand.astype(np.int64).copy()
    plan = []
    for j in np.argsort(-x, kind="stable").tolist():
        used = columns[:, j]
        need = used > 0
        times = min(int(x[j] + 1e-9), int((left[need] // used[need]).min()))
        if times:
            plan.append((used.copy(), times))
            left -= used * times
    while left.any():  # at most a few pieces a pattern: first fit, longest first, whole patterns as often as they go
        pattern, room = np.zeros(capacity, np.int64), capacity
        for j in np.flatnonzero(left)[::-1].tolist():
            if j < room:
                pattern[j] = min(int(left[j]), room // (j + 1))
                room -= int(pattern[j]) * (j + 1)
        need = pattern > 0
        times = max(1, int((left[need] // pattern[need]).min()))
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def _ranges(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length class, first rank, end of ranks, pieces a sequence, first sequence) for each pattern and class."""
    out, sequence = [], 0
    rank = np.zeros(len(plan[0][0]) if plan else 0, np.int64)
    for pattern, times in plan:
        for j in np.flatnonzero(pattern).tolist():
            n = int(pattern[j]) * times
            out.append((j + 1, int(rank[j]), int(rank[j]) + n, int(pattern[j]), sequence))
            rank[j] += n
        sequence += times
    return out


def _bundles(counts: dict[int, int], short: int, bundle: int, unit: int) -> tuple[list[tuple[int, ...]], dict[int, int]]:
    """Where the pieces of each key go, and how many items each class has.

    Keys up to ``short`` are lengths, the others ``short`` + class. Rows: (key, pieces an item, full items, class and first rank of
    those, class and rank of the last item, which holds what is left over).
    """
    demand: dict[int, int] = {}
    rows = []

    def take(size: int, n: int) -> tuple[int, int]:
        kind = -(-size // unit)
        first = demand.get(kind, 0)
        if n:
            demand[kind] = first + n
        return kind, first

    for key, count in sorted(counts.items()):
        per = bundle // key if key <= short else 1
        size = key * per if key <= short else (key - short) * unit
        full, left = divmod(count, per)
        rows.append((key, per, full, *take(size, full), *take(key * left, 1 if left else 0)))
    return rows, demand


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, unit: int = UNIT, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (long) and ids if asked for.

    A document is its tokenizer ids and the end id, so null and empty texts make one piece of one id. Pieces tile their
    document; sequences are filled from offset 0 without gaps, up to ``capacity``. Repeated rows and equal or null ids are
    packed one by one, and equal rows are spread over tasks. Other columns aren't read. Empty in, empty out.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, path or tokenizer_path(), id_col, text_col, capacity, keep_ids), "pieces")
    bundle = capacity // 16 // unit * unit
    short = bundle // 4
    key = F.when(F.col("length") <= short, F.col("length")).otherwise(short + F.ceil(F.col("length") / unit)).cast("int")
    keyed = cut.withColumn("key", key)
    counts = {r["key"]: r["count"] for r in keyed.groupBy("key").count().collect()}  # at most short + capacity / unit rows
    rows, items = _bundles(counts, short, bundle, unit)
    demand = np.zeros(capacity // unit, np.int64)
    for kind, n in items.items():
        demand[kind - 1] = n
    ranges = spark.createDataFrame(_ranges(cutting_stock(demand)), "r_class int, low long, high long, per long, base long")
    homes = spark.createDataFrame(rows, "home int, pieces long, full long, full_class int, full_rank long, last_class int, last_rank long")
    groups = int(max(64, -(-sum(counts.values()) // GROUP_PIECES)))
    keyed = keyed.withColumn("grp", F.pmod(F.xxhash64("id", "start", "ids_crc32", "turn"), F.lit(groups)))
    before = Window.partitionBy("key").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("key", "grp").count().select("key", "grp", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("key", "grp").orderBy("id", "start", "ids_crc32", "doc_tokens", "turn")
    ranked = keyed.withColumn("n", F.row_number().over(within)).join(offsets, ["key", "grp"]).join(F.broadcast(homes), F.col("key") == F.col("home"))
    ranked = ranked.withColumn("item", F.expr("(ahead + n - 1) div pieces"))
    is_full = F.col("item") < F.col("full")
    classed = ranked.withColumns({"class": F.when(is_full, F.col("full_class")).otherwise(F.col("last_class")), "rank": F.when(is_full, F.col("full_rank") + F.col("item")).otherwise(F.col("last_rank"))})
    # The ranges are few: their number depends on the classes, not on the documents.
    placed = classed.join(F.broadcast(ranges), (F.col("class") == F.col("r_class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.expr("base + (rank - low) div per"))
    line = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "class", "rank", "ahead", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(line), F.lit(0)))
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
