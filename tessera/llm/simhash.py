"""SimHash near-duplicates by pigeonring filtering.

A 64-bit fingerprint is cut into five consecutive segments in a ring. If two fingerprints differ in at most three
bits, some segment starts a chain whose first l segments differ in at most 3 * l / 5 bits for every l from 1 to 5
(pigeonring principle). The first three segments of such a chain hold at most one differing bit, and none of them
is in the first; cutting the other two into four parts leaves three parts equal. So (start, part left out, equal
bits) is an exact key of about 32 bits, and each link shares one. Rows that share a key are pruned by the remaining chain budgets before the full
Hamming test.

Equal fingerprints are merged before anything is keyed, runs of a key emit a spanning forest rather than all pairs,
and runs over ``RUN`` rows are streamed out under longer keys, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, drop_written, in_slices, protected, release_memory, written

BITS, LINK = 64, 3
SEGMENTS, PARTS = 5, 4
SHINGLE = 3
#: Rows of one key that a task holds at a time; longer runs go on under longer keys, unless so few bits are free that
#: a run can't be long (fingerprints are distinct).
RUN, FEW = 8192, 14


def _masks() -> list[tuple[list[int], int]]:
    """For each slot (start segment, part left out): the masks of the chain's segments, and the key's mask."""
    edges = [round(i * BITS / SEGMENTS) for i in range(SEGMENTS + 1)]
    segments = [list(range(edges[i], edges[i + 1])) for i in range(SEGMENTS)]
    out = []
    for i in range(SEGMENTS):
        chain = [segments[(i + k) % SEGMENTS] for k in range(SEGMENTS)]
        near = chain[1] + chain[2]
        for p in range(PARTS):
            left_out = set(near[p * len(near) // PARTS : (p + 1) * len(near) // PARTS])
            key = sum(1 << b for b in chain[0] + [b for b in near if b not in left_out])
            out.append(([sum(1 << b for b in s) for s in chain], key))
    return out


SLOTS = _masks()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_words(texts: list) -> np.ndarray:
    """Fingerprints (uint64) of UTF-8 texts; None and texts without words give zero."""
    h, counts = [], []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split() if text else []  # bytes.lower() changes A-Z only
        n = len(words)
        if n > SHINGLE:
            joined = b" ".join(words)
            length = np.fromiter(map(len, words), np.int64, n)
            end = np.cumsum(length + 1) - 1
            start = end - length
            a, b = start[: n - SHINGLE + 1].tolist(), end[SHINGLE - 1 :].tolist()
            h.append(np.array([digest(joined[x:y], 42) for x, y in zip(a, b, strict=True)], np.uint64))
            counts.append(n - SHINGLE + 1)
        elif n:
            h.append(np.array([digest(b" ".join(words), 42)], np.uint64))
            counts.append(1)
        else:
            counts.append(0)
    counts = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    h = np.concatenate(h)
    # Bit counts in byte lanes: at most 255 hashes are added at once, then the lanes are widened.
    pieces = -(-counts[full] // 255)
    first = np.cumsum(counts[full]) - counts[full]
    piece_of = np.repeat(np.arange(len(full)), pieces)
    piece_at = np.cumsum(pieces) - pieces
    starts = first[piece_of] + (np.arange(len(piece_of)) - piece_at[piece_of]) * 255
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & np.uint64(0x0101010101010101), starts)
        ones = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), piece_at, axis=0)
        for byte in range(8):
            out[full] |= (2 * ones[:, byte] > counts[full]).astype(np.uint64) << np.uint64(8 * byte + j)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp long): the SimHash of each row's whole text, as a signed 64-bit number."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    id_type = kept.schema["id"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(rows):
            fp = fingerprint_words(as_bytes(batch.column(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], ["id", "text_hash", "fp"])
        release_memory()

    return kept.mapInArrow(run, f"id {id_type}, text_hash long, fp long")


def _chain_ok(diff: np.ndarray, chain: list[int]) -> np.ndarray:
    """The pigeonring test of the later prefixes, then the full Hamming test (the whole ring)."""
    ok = np.ones(diff.shape, bool)
    total = np.zeros(diff.shape, np.int64)
    for n, mask in enumerate(chain, 1):
        total += np.bitwise_count(diff & np.uint64(mask))
        ok &= total * SEGMENTS <= LINK * n
    return ok


def _forest(fp: np.ndarray, chain: list[int]) -> list[tuple[int, int]]:
    """Links within one run, as a spanning forest: rows already reached through others aren't named again."""
    n = len(fp)
    root = np.arange(n)
    out = []
    for i in range(n - 1):
        near = np.flatnonzero(_chain_ok(fp[i + 1 :] ^ fp[i], chain)) + i + 1
        for j in near[root[near] != root[i]].tolist():
            if root[j] != root[i]:
                out.append((int(fp[i]), int(fp[j])))
                root[root == root[j]] = root[i]
    return out


def _links(rows: Iterator[pa.RecordBatch], longest: int = RUN) -> Iterator[pa.RecordBatch]:
    """From rows (slot, mask, key, fp) sorted by (slot, mask, key): links (a, b, null, null) and, for runs over ``longest``, the
    rows again under keys with a quarter of the free bits added (null, fp, slot, mask): of four quarters one is equal."""
    held: list[np.ndarray] = []
    state = {"key": None, "n": 0, "over": False}

    def flush(a: list, b: list, slots: list, masks: list, last: bool) -> None:
        if not held or state["key"] is None:
            return
        slot, mask, _ = state["key"]
        fp = np.unique(np.concatenate(held))
        free = [x for x in range(BITS) if not mask >> x & 1]
        if state["over"] or not last:
            for q in range(4):
                extra = sum(1 << x for x in free[q * len(free) // 4 : (q + 1) * len(free) // 4])
                a.extend([None] * len(fp))
                b.extend(fp.view(np.int64).tolist())
                slots.extend([slot] * len(fp))
                masks.extend([_signed(mask | extra)] * len(fp))
        elif len(fp) > 1:
            for x, y in _forest(fp, SLOTS[slot][0]):
                a.append(_signed(x))
                b.append(_signed(y))
                slots.append(None)
                masks.append(None)
        held.clear()
        state["n"] = 0

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("slot", pa.int32()), ("mask", pa.int64())])
    for batch in rows:
        a, b, slots, masks = [], [], [], []
        if not batch.num_rows:
            continue
        slot, mask, key, fp = (np.asarray(batch.column(i)) for i in range(4))
        mask, key, fp = (x.view(np.uint64) for x in (mask, key, fp))
        cut = np.flatnonzero((slot[1:] != slot[:-1]) | (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate([[0], cut])
        ends = np.concatenate([cut, [len(fp)]])
        # Runs of two that lie inside the batch are tested together; they are most of all runs.
        inner = np.ones(len(starts), bool)
        inner[[0, -1]] = False
        sizes = ends - starts
        pairs = starts[inner & (sizes == 2)]
        for s in np.unique(slot[pairs]).tolist():
            x, y = fp[pairs[slot[pairs] == s]], fp[pairs[slot[pairs] == s] + 1]
            ok = (x != y) & _chain_ok(x ^ y, SLOTS[s][0])
            a.extend(x[ok].view(np.int64).tolist())
            b.extend(y[ok].view(np.int64).tolist())
            slots.extend([None] * int(ok.sum()))
            masks.extend([None] * int(ok.sum()))
        for i in np.flatnonzero(~inner | (sizes > 2)).tolist():
            this = (int(slot[starts[i]]), int(mask[starts[i]]), int(key[starts[i]]))
            if this != state["key"]:
                flush(a, b, slots, masks, True)
                state.update(key=this, over=False)
            for at in range(starts[i], ends[i], longest):
                held.append(fp[at : min(at + longest, ends[i])])
                state["n"] += len(held[-1])
                if state["n"] > longest and this[1].bit_count() < BITS - FEW:
                    state["over"] = True
                    flush(a, b, slots, masks, False)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((a, b, slots, masks), schema, strict=True)], schema=schema)
    a, b, slots, masks = [], [], [], []
    flush(a, b, slots, masks, True)
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((a, b, slots, masks), schema, strict=True)], schema=schema)


def links(distinct_fp: DataFrame, run: int = RUN) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span the same components as all links do."""
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(_signed(key)).alias("mask")) for i, (_, key) in enumerate(SLOTS)])
    keyed = distinct_fp.select("fp", F.explode(slots).alias("s")).select("s.slot", "s.mask", "fp")
    out = None
    while True:
        rows = keyed.select("slot", "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
        rows = rows.repartition("slot", "mask", "key").sortWithinPartitions("slot", "mask", "key")
        found = written(rows.mapInArrow(lambda it: _links(it, run), "a long, b long, slot int, mask long"), "simhash-links")
        pairs = found.where("a is not null").select("a", "b").distinct()
        out = pairs if out is None else out.union(pairs).distinct()
        keyed = found.where("a is null").select("slot", "mask", F.col("b").alias("fp")).distinct()
        if keyed.isEmpty():
            return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of the edges (a, b), by alternating large and small stars.

    Each half step is a map-side combined min and a join back, so a hub's edges are never gathered in one group; where the
    edges of a hub make a partition of the join too large, adaptive execution splits it.
    Each round is written to the shared scratch folder; rounds end when the edges stop changing.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("x"), F.col("m").alias("v"), "u")
        step = small.select(F.explode(F.array(F.struct(F.col("x").alias("u"), "v"), F.struct("u", "v"))).alias("e")).select("e.*").where("u <> v").distinct()
        after = written(step, "stars")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        drop_written(now)
        now = after
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and (fp, root) with the same root for all fingerprints of a component."""
    fps = written(fingerprints(docs, id_col, text_col), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least_id"), F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "text_hash")).alias("least"))
    roots = components(links(distinct.select("fp")))
    return fps, distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id", "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id) for each row: its fingerprint and the smallest id that links of <= 3 bits reach.

    Null and wordless texts have fingerprint zero and link like others; texts of any length count whole. Repeated rows and ids stay, one result each;
    a null id never names a component unless all ids in it are null. Other columns are not read. Empty in, empty out.
    """
    fps, nodes = _labelled(docs, id_col, text_col)
    ids = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = nodes.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each component: that with its smallest id (null ids last), with all its columns, whatever their
    names. Of repeated rows one stays."""

    def first_rows(rows: DataFrame) -> DataFrame:
        _, nodes = _labelled(rows, id_col, text_col)
        kept = nodes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias("_id"), F.col("least.text_hash").alias("_hash"))
        hashed = rows.withColumn("_text_hash", F.xxhash64(text_col))
        found = hashed.join(kept, (F.col("_text_hash") == F.col("_hash")) & F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
        return found.dropDuplicates(["_text_hash", id_col])

    return protected(docs, (id_col, text_col), first_rows)
