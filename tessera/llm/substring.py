"""Exact substring dedup over word windows by super-k-mer partitioning.

Every input partition is read in blocks of a few million words. Inside a block, windows are sorted and those that
repeat an earlier window of the block are settled on the spot, so a passage costs one window per block however many
documents hold it. The other windows are cut where their minimiser (the least hash of four consecutive words inside
the window) changes; consecutive windows sharing one travel as one packed string to the minimiser's bucket. A bucket
sorts all its windows, finds each one's first place and sends back the places that aren't first. Buckets that a count
over a part of the documents finds large are dealt further by the hash of the whole window, so that different windows
around one frequent line don't meet in one task. Windows are compared by their words; hashes only order the sort.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Vocabulary, as_bytes, in_slices, ragged_positions, release_memory

WINDOW, GRAM = 20, 4
#: Words of a block (it ends with a whole document), and characters of text for which one bucket is laid out.
BLOCK_WORDS, BUCKET_CHARS = 1_000_000, 8_000_000
#: Tasks that buckets are dealt to; beyond as many buckets a task works through several, one at a time.
MOST_TASKS = 20_000
#: Windows are counted by bucket in one of COUNTED documents, all of them up to COUNT_ALL characters; a bucket is split from
#: HOT times the windows of its BUCKET_CHARS on. The counts lay out the work and change no result.
COUNTED, COUNT_ALL, HOT = 16, 20_000_000, 2
#: Windows of BUCKET_CHARS characters, about.
BUCKET_WINDOWS = BUCKET_CHARS // 6
#: Places that a rolling hash is worked out for at a time.
ROLLED = 1 << 16
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            one = np.ones(1, np.uint64)
            cls.up = np.cumprod(np.concatenate([one, np.full(size - 1, _ODD, np.uint64)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([one, np.full(size - 1, _INVERSE, np.uint64)]), dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive entries of h; len(h) - width + 1 of them. It doesn't depend on the place, so
    stretches of ROLLED places are worked out one after another."""
    out = np.empty(max(0, len(h) - width + 1), np.uint64)
    for x in range(0, len(out), ROLLED):
        part = h[x : x + ROLLED + width - 1]
        up, down = _Powers.upto(len(part) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)])
        out[x : x + ROLLED] = _mixed((total[width:] - total[:-width]) * down[: len(part) - width + 1])
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class _Words(Vocabulary):
    """A vocabulary that keeps the hash of each word by its number."""

    def __init__(self):
        super().__init__()
        self.digests = array("Q")

    def __missing__(self, word: bytes) -> int:
        self.digests.append(xxhash.xxh64_intdigest(word))
        return super().__missing__(word)

    def numbered(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.digests, np.uint64)[ids]


def _first_of_equal(ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """For windows (start ``at`` in ids, hash) in order of priority: index of the first window with the same words."""
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    first = np.empty(len(order), np.int64)
    first[order] = lead
    again = np.flatnonzero(first != np.arange(len(first)))
    same = np.ones(len(again), bool)
    for t in range(width):
        same &= ids[at[again] + t] == ids[at[first[again]] + t]
    clash = again[~same]
    if len(clash):  # unequal windows of one hash: told apart by their words
        for lead in np.unique(first[clash]).tolist():
            seen: dict[bytes, int] = {}
            for i in np.flatnonzero(first == lead).tolist():
                first[i] = seen.setdefault(ids[at[i] : at[i] + width].tobytes(), i)
    return first


def _runs(flag: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of True; no run goes on over an index where ``breaks`` is True."""
    start = flag & (breaks | ~np.concatenate([[False], flag[:-1]]))
    starts = np.flatnonzero(start)
    stop = np.flatnonzero(np.concatenate([~flag[1:] | breaks[1:], [True]]) & flag)
    return starts, stop - starts + 1


ROWS = pa.schema([("bucket", pa.int64()), ("payload", pa.binary())])
GONE = pa.schema([(name, pa.int64()) for name in ("doc_id", "text_hash", "start", "n")])


def _packed(*parts: bytes) -> bytes:
    sizes = np.array([len(p) for p in parts], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=6).compress(np.int64(len(parts)).tobytes() + sizes + b"".join(parts))


def _unpacked(payload: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    ends = 8 + 8 * n + np.cumsum(sizes)
    return [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


_LAST = np.iinfo(np.int64).max  # a null id comes after all others


def _least_grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """The minimiser of the window from each place on."""
    gram = min(GRAM, width)
    return _sliding_min(_rolling(hashes, gram), width - gram + 1)


def _home(least: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((least >> np.uint64(16)) % np.uint64(n_buckets)).astype(np.int64)


def _block(docs: list, vocabulary: _Words, n_buckets: int, width: int, parts: dict[int, tuple[int, int]] | None = None) -> pa.RecordBatch | None:
    """docs: (id, text hash, numbers of the words, words joined by one space); parts: first bucket and number of those that a large bucket is dealt to. Rows for the buckets: packed super-k-mers, and the block's own removals."""
    docs.sort(key=lambda d: d[:2])
    ids = np.concatenate([w for _, _, w, _ in docs])
    hashes = vocabulary.hashes(ids)
    n = np.array([len(w) for _, _, w, _ in docs], np.int64)
    doc_at = np.cumsum(n) - n
    doc_ids = np.array([d[0] for d in docs], np.int64)
    text_hash = np.array([d[1] for d in docs], np.int64)

    windows = n - width + 1  # every document here has one at least
    at = ragged_positions(doc_at, windows)
    doc = np.repeat(np.arange(len(docs)), windows)
    start = at - doc_at[doc]
    whole = _rolling(hashes, width)[at]
    first = _first_of_equal(ids, whole, at, width)
    # The same place of a repeated id isn't earlier; its row goes to the bucket like the first.
    gone = (first != np.arange(len(first))) & ~((doc_ids[doc] == doc_ids[doc[first]]) & (start == start[first]))

    least = _least_grams(hashes, width)[at]
    bucket = _home(least, n_buckets)
    if parts:
        spare = np.zeros(n_buckets, np.int64), np.ones(n_buckets, np.int64)
        for b, (base, k) in parts.items():
            spare[0][b], spare[1][b] = base, k
        dealt = np.flatnonzero(spare[1][bucket] > 1)
        home = bucket[dealt]
        bucket[dealt] = spare[0][home] + ((whole[dealt] >> np.uint64(16)) % spare[1][home].astype(np.uint64)).astype(np.int64)
    breaks = np.ones(len(at), bool)
    breaks[1:] = doc[1:] != doc[:-1]
    first_gone, n_gone = _runs(gone, breaks)
    breaks[1:] |= (least[1:] != least[:-1]) | (bucket[1:] != bucket[:-1])
    s, c = _runs(~gone, breaks)
    bucket = bucket[s]

    del first, gone, least, breaks, hashes, whole
    joined = b" ".join([words for _, _, _, words in docs])
    length = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))[ids]
    end_byte = np.cumsum(length + 1) - 1
    order = np.argsort(bucket, kind="stable")
    s, c, bucket = s[order], c[order], bucket[order]
    from_byte = (end_byte - length)[at[s]].tolist()
    to_byte = end_byte[at[s] + c + width - 2].tolist()
    del length, end_byte, at, ids
    cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    rows = {"bucket": [], "payload": []}
    for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(s)], strict=True):
        if x < y:
            d = doc[s[x:y]]
            rows["bucket"].append(int(bucket[x]))
            rows["payload"].append(_packed(doc_ids[d].tobytes(), text_hash[d].tobytes(), start[s[x:y]].tobytes(), c[x:y].astype(np.int32).tobytes(), b"\n".join([joined[f:t] for f, t in zip(from_byte[x:y], to_byte[x:y], strict=True)])))
    if len(first_gone):
        d = doc[first_gone]
        home = doc_ids[d].view(np.uint64) % np.uint64(n_buckets)
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(home[order][1:] != home[order][:-1]) + 1
        for part in np.split(order, cuts):
            rows["bucket"].append(int(home[part[0]]))
            rows["payload"].append(_packed(doc_ids[d[part]].tobytes(), text_hash[d[part]].tobytes(), start[first_gone[part]].tobytes(), n_gone[part].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in ROWS], schema=ROWS)


def _counts(n_buckets: int, width: int):
    """Windows of each bucket in the texts of a partition; equal windows of one text count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in in_slices(batches):
            for text in as_bytes(batch.column(0)):
                words = text.split() if text else []
                if len(words) >= width:
                    vocabulary = _Words()
                    hashes = vocabulary.hashes(vocabulary.numbered(words))
                    _, once = np.unique(_rolling(hashes, width), return_index=True)
                    total += np.bincount(_home(_least_grams(hashes, width)[once], n_buckets), minlength=n_buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["bucket", "n"])

    return run


def large_buckets(keys: DataFrame, n_buckets: int, n_chars: int, width: int, windows: int = BUCKET_WINDOWS) -> dict[int, tuple[int, int]]:
    """bucket -> (first, number) of the buckets it is dealt to, beyond ``n_buckets``; about ``windows`` in each."""
    of = COUNTED if n_chars > COUNT_ALL else 1
    part = keys.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(of)) == 0) if of > 1 else keys
    counts = part.select("text").mapInArrow(_counts(n_buckets, width), "bucket long, n long").groupBy("bucket").agg((F.sum("n") * of).alias("n"))
    out, base = {}, n_buckets
    for r in counts.where(F.col("n") >= HOT * windows).orderBy("bucket").collect():
        out[r.bucket] = (base, -(-r.n // windows))
        base += out[r.bucket][1]
    return out


def _super_kmers(n_buckets: int, width: int, block_words: int, parts: dict[int, tuple[int, int]] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held, vocabulary = [], 0, _Words()
        for batch in in_slices(batches):
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                words = text.split() if text else []
                if len(words) >= width:
                    docs.append((_LAST if doc_id is None else doc_id, text_hash, vocabulary.numbered(words), b" ".join(words)))
                    held += len(words)
                if held >= block_words:
                    rows = _block(docs, vocabulary, n_buckets, width, parts)
                    docs, held, vocabulary = [], 0, _Words()
                    yield rows
        if docs:
            yield _block(docs, vocabulary, n_buckets, width, parts)
        release_memory()

    return run


def _bucket(payloads: list[bytes], width: int) -> pa.RecordBatch:
    """Runs of windows of one bucket that aren't the first of their words."""
    out, metas, numbers, wholes, vocabulary = [], [], [], [], _Words()
    for payload in payloads:
        parts = _unpacked(payload)
        doc_id, text_hash, start = (np.frombuffer(parts[i], np.int64) for i in range(3))
        if len(parts) == 4:  # settled in the block
            out.append((doc_id, text_hash, start, np.frombuffer(parts[3], np.int64)))
        else:
            n = np.frombuffer(parts[3], np.int32).astype(np.int64)
            metas.append((doc_id, text_hash, start, n))
            numbers.append(vocabulary.numbered(parts[4].split()))
            wholes.append(_rolling(vocabulary.hashes(numbers[-1]), width)[ragged_positions(np.cumsum(n + width - 1) - (n + width - 1), n)])
    del payloads, vocabulary
    if metas:
        ids, whole = np.concatenate(numbers), np.concatenate(wholes)
        doc_id, text_hash, start, n = (np.concatenate(x) for x in zip(*metas, strict=True))
        del metas, numbers, wholes
        offset, number = np.cumsum(n + width - 1) - (n + width - 1), np.cumsum(n) - n
        order = np.lexsort((text_hash, start, doc_id))
        doc_id, text_hash, start, n, offset, number = (x[order] for x in (doc_id, text_hash, start, n, offset, number))
        whole = whole[ragged_positions(number, n)]
        at = ragged_positions(offset, n)
        first = _first_of_equal(ids, whole, at, width)
        del ids, whole, at
        owner = np.repeat(np.arange(len(n)), n)
        place = ragged_positions(start, n)
        gone = (first != np.arange(len(first))) & ~((doc_id[owner] == doc_id[owner[first]]) & (place == place[first]))
        breaks = np.ones(len(owner), bool)
        breaks[1:] = owner[1:] != owner[:-1]
        s, c = _runs(gone, breaks)
        out.append((doc_id[owner[s]], text_hash[owner[s]], place[s], c))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], schema=GONE)


def _buckets(width: int):
    """Work through rows (bucket, payload) sorted by bucket, one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and held:
                    payloads, held = held, []
                    yield _bucket(payloads, width)
                    del payloads
                now = bucket
                held.append(payload)
        if held:
            yield _bucket(held, width)
        del held
        release_memory()

    return run


def _cleaned(width: int, text_at: int, gone_at: int, schema: pa.Schema):
    """Replace the text and the removal list of joined rows by the cleaned text and the counts."""

    def one(text: bytes, gone: list) -> tuple[bytes | None, int, int, str]:
        words = text.split() if text else []
        if not gone:
            return text, len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
        change = np.zeros(len(words) + 1, np.int64)
        starts = np.array([g["start"] for g in gone], np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + np.array([g["n"] for g in gone], np.int64) + width - 1, -1)
        kept = (np.cumsum(change)[:-1] == 0).tolist()
        n_kept = sum(kept)
        # White space before a kept word stays; a removed word goes with the white space before it.
        pieces, before = [], 0
        for m, k in zip(_WORD.finditer(text), kept, strict=True):
            if k:
                pieces.append(text[before : m.end()])
            before = m.end()
        digest = hashlib.sha256(b" ".join([w for w, k in zip(words, kept, strict=True) if k])).hexdigest()
        return b"".join(pieces).strip(b" \t\n\x0b\f\r"), len(words), len(words) - n_kept, digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            done = [one(t, g) for t, g in zip(as_bytes(batch.column(text_at)), batch.column(gone_at).to_pylist(), strict=True)]
            text, n, removed, sha = zip(*done, strict=True) if done else ((), (), (), ())
            cols = [c for i, c in enumerate(batch.columns) if i != gone_at]
            cols[text_at] = pa.array(text, pa.binary()).cast(pa.string())
            cols += [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)
        release_memory()

    return run


def n_chars_of(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.length(text_col))).head()[0] or 0


def n_buckets_for(n_chars: int) -> int:
    """Buckets in proportion to the characters of the corpus."""
    return max(16, math.ceil(n_chars / BUCKET_CHARS))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, n_buckets: int | None = None, block_words: int = BLOCK_WORDS, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """The rows of ``docs`` without the words that repeat, plus n_words, n_removed (long) and kept_sha256.

    A word goes if a window of ``window`` words over it also starts earlier: under a smaller id, or earlier in the same
    document; windows are judged on the input. The text keeps the white space before each kept word; a text that loses
    nothing stays as it is. kept_sha256 is of the kept words joined by one space.

    Null texts have no words and stay null; shorter texts than a window lose nothing. A null id counts as the largest.
    Rows with the same id count as the same document (a window at the same place of both isn't earlier). Ids are
    integers. Columns named n_words, n_removed or kept_sha256 in ``docs`` are replaced; all others pass through.
    """
    added = ("n_words", "n_removed", "kept_sha256")
    docs = docs.drop(*added)
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    n_chars = n_chars_of(docs, text_col)
    n_buckets = n_buckets or n_buckets_for(n_chars)
    parts = large_buckets(keys, n_buckets, n_chars, window, bucket_windows)
    rows = keys.mapInArrow(_super_kmers(n_buckets, window, block_words, parts), "bucket long, payload binary")
    tasks = min(n_buckets + sum(k for _, k in parts.values()), MOST_TASKS)
    dealt = rows.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")
    gone = dealt.mapInArrow(_buckets(window), "doc_id long, text_hash long, start long, n long")
    gone = gone.groupBy(F.when(F.col("doc_id") != _LAST, F.col("doc_id")).alias("_gone_id"), F.col("text_hash").alias("_gone_hash"))
    gone = gone.agg(F.collect_set(F.struct("start", "n")).alias("_gone"))
    inner = [f"column {i}" for i in range(len(docs.columns))]  # the caller's names can't clash with those added here
    own = dict(zip(docs.columns, inner, strict=True))
    named = docs.toDF(*inner).withColumns({"_row_id": F.col(f"`{own[id_col]}`").cast("long"), "_row_hash": F.xxhash64(f"`{own[text_col]}`")})
    joined = named.join(gone.hint("shuffle_hash"), F.col("_row_id").eqNullSafe(F.col("_gone_id")) & (F.col("_row_hash") == F.col("_gone_hash")), "left")
    joined = joined.select(*[f"`{c}`" for c in inner], "_gone")
    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    return joined.mapInArrow(_cleaned(window, docs.columns.index(text_col), len(docs.columns), to_arrow_schema(out)), out)


ORACLE = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words),
windows AS (SELECT doc_id, i, w, count(*) OVER ahead AS n, string_agg(w, ' ') OVER ahead AS s FROM placed
    WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
starts AS (SELECT doc_id, i, w, n = {WINDOW} AND row_number() OVER (PARTITION BY s, n = {WINDOW} ORDER BY doc_id, i) > 1 AS again FROM windows),
judged AS (SELECT doc_id, i, w, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM starts),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS text FROM judged GROUP BY doc_id)
SELECT words.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
"""
