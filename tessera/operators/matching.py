"""Joins by time band, nearest neighbour in time, preference and similarity, without pair explosion."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.shingles import hash_sets, set_key, shingle_set
from tessera.sources.tables import stored

#: Rows of a small side that are sent to every executor at most (two numbers each); beyond, both sides are shuffled.
BROADCAST_ROWS = 2_000_000
#: Shingles of a block of documents that are compared in one task, its pairs, and shingles that it keeps as strings at once.
CELL_SHINGLES, CELL_PAIRS, KEPT_SHINGLES = 1 << 21, 1 << 18, 1 << 19


def band_pairs(df: DataFrame, key: str, at: str, width: int, id_col: str) -> DataFrame:
    """(key, id_a, id_b, gap): pairs of rows of a key with |at_a - at_b| <= width and id_a < id_b.

    An equi-join on (key, bucket of ``width``): one side goes to its bucket, the other to three, so a pair is
    tested once and a hot key is split by time.
    """
    left = df.select(key, F.col(at).alias("at_a"), F.col(id_col).alias("id_a"), F.floor(F.col(at) / width).alias("bucket"))
    right = df.select(key, F.col(at).alias("at_b"), F.col(id_col).alias("id_b"), F.explode(F.sequence(F.floor(F.col(at) / width) - 1, F.floor(F.col(at) / width) + 1)).alias("bucket"))
    pairs = left.join(right, [key, "bucket"]).where((F.col("id_a") < F.col("id_b")) & (F.abs(F.col("at_a") - F.col("at_b")) <= width))
    return pairs.select(key, "id_a", "id_b", F.abs(F.col("at_a") - F.col("at_b")).alias("gap"))


def nearest_match(left: DataFrame, right: DataFrame, key: str, at: str, id_col: str, back: int, ahead: int) -> DataFrame:
    """Each left row's nearest right row of the key within [-back, +ahead]: key, left_id, right_id, gap.

    Time is cut in buckets as wide as the reach, so a hot key is spread over them: the last right row before and the first after
    are window values of a bucket, or the edges of the buckets beside it; no pairs are made. Equal gaps take the earlier
    row; of rows at one time the one with the smaller id counts.
    """
    width = max(back, ahead, 1)
    bucket = F.floor(F.col(at) / width).alias("bucket")
    both = left.select(key, at, bucket, F.col(id_col).alias("left_id"), F.lit(None).cast("struct<at: bigint, id: bigint>").alias("r"))
    both = both.unionByName(right.select(key, at, bucket, F.lit(None).cast("bigint").alias("left_id"), F.struct(F.col(at).cast("bigint").alias("at"), F.col(id_col).cast("bigint").alias("id")).alias("r")))
    by_time = Window.partitionBy(key, "bucket").orderBy(F.col(at))
    inside = {"before": F.max("r.at").over(by_time.rangeBetween(Window.unboundedPreceding, 0)), "after": F.min("r.at").over(by_time.rangeBetween(0, Window.unboundedFollowing))}
    edges = right.groupBy(key, bucket).agg(F.min(at).alias("low"), F.max(at).alias("high"))
    found = both.withColumns(inside).where("left_id is not null")
    found = found.join(edges.select(key, (F.col("bucket") + 1).alias("bucket"), F.col("high").alias("ahead_of")), [key, "bucket"], "left")
    found = found.join(edges.select(key, (F.col("bucket") - 1).alias("bucket"), F.col("low").alias("behind")), [key, "bucket"], "left")
    found = found.withColumns({"before": F.coalesce("before", "ahead_of"), "after": F.coalesce("after", "behind")})
    gap_before, gap_after = F.col(at) - F.col("before"), F.col("after") - F.col(at)
    ok_before, ok_after = F.coalesce(gap_before <= back, F.lit(False)), F.coalesce(gap_after <= ahead, F.lit(False))
    pick = F.when(ok_before & (~ok_after | (gap_before <= gap_after)), F.col("before")).when(ok_after, F.col("after"))
    chosen = found.select(key, "left_id", F.col(at).alias("left_at"), pick.alias(at)).where(F.col(at).isNotNull())
    ids = right.groupBy(key, at).agg(F.min(id_col).alias("right_id"))
    return chosen.join(ids, [key, at]).select(key, "left_id", "right_id", F.abs(F.col("left_at") - F.col(at)).alias("gap"))


def priority_union(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of the first frame, and of each later one only for keys that no earlier frame has; with ``tier`` from 1."""
    out = frames[0].withColumn("tier", F.lit(1))
    for n, frame in enumerate(frames[1:], 2):
        out = out.unionByName(frame.join(out.select(*key).distinct(), key, "left_anti").withColumn("tier", F.lit(n)))
    return out


def unambiguous_top(scored: DataFrame, key: str, candidate: str, score: Column) -> DataFrame:
    """The candidate with the highest score of each key, only where no other candidate has that score."""
    w = Window.partitionBy(key).orderBy(F.desc("_score"))
    ranked = scored.withColumn("_score", score).withColumn("_rank", F.rank().over(w)).where("_rank = 1")
    return ranked.groupBy(key).agg(F.countDistinct(candidate).alias("_n"), F.min(candidate).alias(candidate), F.max("_score").alias("score")).where("_n = 1").drop("_n")


def shingles(words: Column, n: int) -> Column:
    """Distinct n-word shingles of an array of words. The array is bound once: inside a lambda it would be made again per item."""

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(words), of), F.lit(0))


def shingle_hashes(words: Column, n: int) -> Column:
    """Distinct hashes of the n-word shingles of an array of words; no shingle is put together for it."""

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.when(F.size(w) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), of), F.lit(0))


def containment(small: DataFrame, large: DataFrame, small_id: str, large_id: str, n: int, least: float) -> DataFrame:
    """(small_id, large_id, shared, of): pairs where the share of the small side's n-word shingles in the large side is >= least.

    Frames hold an id and an array ``words``. Hashes of shingles find the candidates, so that eight bytes a shingle are all that
    is exploded; the small side's are broadcast up to BROADCAST_ROWS, and then nothing of the large side is shuffled but
    what it shares. Candidates are counted on the shingles themselves, which only they are cut into.
    """
    hashed = F.explode(shingle_hashes(F.col("words"), n)).alias("h")
    a, b = small.select(small_id, hashed), large.select(large_id, hashed)
    a = F.broadcast(a) if a.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else a
    sizes = small.select(small_id, F.size(shingle_hashes(F.col("words"), n)).alias("likely_of"))
    pairs = b.join(a, "h").groupBy(small_id, large_id).agg(F.count("*").alias("likely")).join(sizes, small_id).where(F.col("likely") >= least * F.col("likely_of")).select(small_id, large_id)
    counted = pairs.join(small.select(small_id, F.col("words").alias("_x")), small_id).join(large.select(large_id, F.col("words").alias("_y")), large_id)
    both = F.struct(shingles(F.col("_x"), n).alias("x"), shingles(F.col("_y"), n).alias("y"))
    checked = counted.select(small_id, large_id, F.get(F.transform(F.array(both), lambda v: F.struct(F.size(F.array_intersect(v.x, v.y)).cast("bigint").alias("shared"), F.size(v.x).cast("bigint").alias("of"))), F.lit(0)).alias("n"))
    return checked.select(small_id, large_id, "n.shared", "n.of").where(F.col("shared") >= least * F.col("of"))


def _text(docs: DataFrame, words: Column) -> Column:
    """Words (an array, or a string of them with single blanks between) as one string."""
    kind = docs.select(words.alias("w")).schema["w"].dataType
    return words if isinstance(kind, T.StringType) else F.array_join(words, " ")


def _keyed(docs: DataFrame, id_col: str, words: Column, n: int, keep_text: bool = False) -> DataFrame:
    """(rep, _h, key), and the text if asked for: the set of n-word shingles of each document as a key, without documents that have none.
    _h tells texts of one id apart."""
    text = _text(docs, words).alias("t")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("rep"), text).withColumn("_h", F.xxhash64("t"))
    kind = rows.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([set_key(h) for h in hash_sets(batch.column(1), n)], pa.string())
            columns = {"rep": batch.column(0), "_h": batch.column(2), "key": keys} | ({"text": batch.column(1)} if keep_text else {})
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(run, f"rep {kind}, _h long, key string" + ", text string" * keep_text).where("key is not null")


def shingle_classes(docs: DataFrame, id_col: str, words: Column, n: int) -> DataFrame:
    """(rep, text, key): one text, its words joined by blanks, for each distinct set of n-word shingles, with the least id that has it.
    Null ids and shorter texts take no part. Words (an array, or a string with single blanks between them) hold no blank.

    Texts are stored for all later passes with their keys; ids and keys are grouped, and the copies, or the texts that stand for others,
    whichever are few, are broadcast as two numbers each. So no text is shuffled unless there are many of both.
    """
    spark, parts = docs.sparkSession, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs, id_col, words, n, keep_text=True)
    spread = keyed if docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else keyed.repartition(parts)  # later passes have work for all
    said = stored(spread, "said", compression="zstd")
    reps = stored(said.groupBy("key").agg(F.min(F.struct("rep", "_h")).alias("r")).select("r.rep", "r._h"), "reps")
    copies = stored(said.select("rep", "_h").join(reps, ["rep", "_h"], "left_anti").distinct(), "copies")
    if copies.count() <= BROADCAST_ROWS:
        return said.join(F.broadcast(copies), ["rep", "_h"], "left_anti").select("rep", "text", "key")
    if reps.count() <= BROADCAST_ROWS:
        return said.join(F.broadcast(reps), ["rep", "_h"], "left_semi").select("rep", "text", "key")
    return stored(said.repartition(parts, "rep", "_h").join(reps, ["rep", "_h"], "left_semi").select("rep", "text", "key"), "classes")


def shingle_members(docs: DataFrame, id_col: str, words: Column, n: int) -> DataFrame:
    """(id_col, rep): the class of each document that has shingles."""
    keyed = stored(_keyed(docs, id_col, words, n).select(F.col("rep").alias(id_col), "key"), "keyed")  # texts are read once
    return keyed.join(keyed.groupBy("key").agg(F.min(id_col).alias("rep")), "key").select(id_col, "rep")


def rarity(classes: DataFrame, length: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function of 64-bit hashes of shingles to numbers that order them, rare ones first: seven bits for how often the hashes of its
    bucket occur in ``classes`` (on a scale of quarter octaves), then the low 56 bits of the hash.

    Buckets are the 17 high bits, counted inside each task first, so that 131,072 numbers, whatever the data, come to the
    driver and go out as one byte each. That is a common order for any data; its bytes only make it a good one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 17, np.int64)
        for batch in batches:
            for hashes in hash_sets(batch.column(0), length):
                np.add.at(seen, (hashes >> np.uint64(47)).astype(np.int64), 1)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], ["b", "n"])

    scale = np.zeros(1 << 17, np.uint64)
    for r in classes.select("text").mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        scale[r.b] = min(int(4 * math.log2(1 + r.n)), 127)
    scale = scale.astype(np.uint8)
    return lambda h: (scale[h >> np.uint64(47)].astype(np.uint64) << np.uint64(56)) | (h & np.uint64((1 << 56) - 1))


def _prefixes(classes: DataFrame, length: int, percent: int) -> DataFrame:
    """(a, n, i, g): the first shingles of each set of n, rare ones first, with their places; similar sets share one of them."""
    common = rarity(classes, length)
    rows = classes.select("rep", "text")
    kind = rows.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, sizes, first = [], [], [np.zeros(0, np.uint64)]
            for hashes in hash_sets(batch.column(1), length):
                n = len(hashes)
                most = n - math.ceil(n * percent / 100 - 1e-9) + 1 if n else 0
                first.append(np.sort(common(hashes))[:most])
                many.append(len(first[-1]))
                sizes.append(n)
            many = np.array(many, np.int64)
            whose, before = np.repeat(np.arange(len(many)), many), np.repeat(np.cumsum(many) - many, many)
            place = (np.arange(len(whose)) - before).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose)), pa.array(np.array(sizes, np.int32)[whose]), pa.array(place), pa.array(np.concatenate(first).view(np.int64))], ["a", "n", "i", "g"])

    return rows.mapInArrow(run, f"a {kind}, n int, i int, g long")


def _met(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs a < b that share a shingle from whose places on enough is left to be similar.

    Of the shingles that two sets share, all stand at the first one's places or behind, so that one shows each similar pair.
    Prefixes are shuffled once; a task meets its sorted rows with those k places on, one k after the other.
    """
    kind = prefixes.schema["a"].dataType.simpleString()
    parts = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows.column("a").combine_chunks()
        n, i, g = (rows.column(c).to_numpy() for c in ("n", "i", "g"))
        n, left = n.astype(np.int64), (n - i).astype(np.int64)
        step, x = 1, np.flatnonzero(g[1:] == g[:-1])
        found, held = [], 0
        while len(x):
            y = x + step
            near = np.minimum(left[x], left[y]) * (100 + percent) >= percent * (n[x] + n[y])
            found.append((x[near], y[near]))
            held += int(near.sum())
            step += 1
            x = x[x + step < len(g)]
            x = x[g[x + step] == g[x]]
            if held > 100_000 or not len(x):
                one, two = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                p, q = ids.take(pa.array(one)), ids.take(pa.array(two))
                ahead, behind = (pc.less(u, v).to_numpy(zero_copy_only=False) for u, v in ((p, q), (q, p)))  # neither: rows of one id
                one, two = np.concatenate([one[ahead], two[behind]]), np.concatenate([two[ahead], one[behind]])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(one)), ids.take(pa.array(two))], ["a", "b"])
                found, held = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if rows is None else [*rows.to_batches(), batch])
            g = rows.column("g").to_numpy()
            whole = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last shingle may go on
            if whole:
                yield from pairs(rows.slice(0, whole))
                rows = rows.slice(whole)
        if rows is not None:
            yield from pairs(rows)

    return prefixes.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _places(pairs: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of documents of ``sizes`` (rep, n) dealt to cells, as (cell, a, b), and the cells of each document, as (cell, rep): a
    text travels once for each cell, not for each pair.

    A pair belongs to the least document that its a meets, so those of a cluster meet in few cells. A cell whose sets hold more than
    CELL_SHINGLES, or of more than CELL_PAIRS, is cut in blocks, and each two blocks are a cell.
    """
    least = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("c"))
    dealt = stored(pairs.join(least, "a", "left").withColumn("c", F.coalesce("c", "a")), "dealt")
    ends = stored(dealt.select("c", F.explode(F.array("a", "b")).alias("rep")).distinct(), "ends")
    by_size = ends.join(sizes, "rep").groupBy("c").agg(F.ceil(F.sum("n") / CELL_SHINGLES).alias("k"))
    by_pairs = dealt.groupBy("c").agg(F.count("*").alias("p")).where(F.col("p") > CELL_PAIRS).select("c", F.ceil(F.sqrt(2 * F.col("p") / CELL_PAIRS)).alias("k"))
    large = by_size.unionByName(by_pairs).where("k > 1").groupBy("c").agg(F.max("k").alias("k"))
    large = F.broadcast(stored(large, "large"))  # few: less than all shingles by CELL_SHINGLES and all pairs by CELL_PAIRS
    block = lambda x: F.pmod(F.xxhash64(x), F.coalesce("k", F.lit(1)))
    cell = lambda x, y: F.xxhash64("c", F.least(x, y), F.greatest(x, y))
    in_cells = dealt.join(large, "c", "left").select(cell(block("a"), block("b")).alias("cell"), "a", "b")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("k", F.lit(1)) - 1))
    where = ends.join(large, "c", "left").select("c", "rep", block("rep").alias("x"), other.alias("y"))
    return in_cells, where.select(cell(F.col("x"), F.col("y")).alias("cell"), "rep").distinct()


def _packed(texts: DataFrame) -> DataFrame:
    """The same rows with their column text as compressed bytes, half of what they take in a shuffle."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in texts.schema])
    names = texts.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = pa.array([zlib.compress(t.encode(), 1) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([small if k == at else c for k, c in enumerate(batch.columns)], names)

    return texts.mapInArrow(run, schema)


def jaccard_pairs(classes: DataFrame, length: int, percent: int) -> DataFrame:
    """(a, b, shared, together): pairs a < b of shingle_classes() of shingles of ``length`` words with Jaccard similarity of ``percent`` in 100 or more.

    Prefix filter: in a common order (rare first), similar sets share a shingle among the first of each, so only those
    meet; candidates are then checked on whole sets, in cells of documents that meet each other. Sizes are compared in whole numbers.
    """
    # Hashes stand for shingles up to the last check, which is on the words. A row sorts its own: nothing is shuffled but prefixes.
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = stored(_met(_prefixes(classes, length, percent), percent), "jaccard-pairs")  # read for both ends
    pairs, places = _places(met, classes.select("rep", F.substring_index("key", "-", -1).cast("bigint").alias("n")))
    places = stored(places, "places")
    if places.count() <= BROADCAST_ROWS:
        texts = _packed(classes.join(F.broadcast(places), "rep").select("cell", "rep", "text"))  # texts travel for candidates only
    else:
        texts = _packed(classes.select("rep", "text")).join(places, "rep")
    kind = pairs.schema["a"].dataType.simpleString()
    both = texts.select("cell", F.col("rep").alias("a"), F.lit(None).cast(kind).alias("b"), "text").unionByName(pairs.withColumn("text", F.lit(None).cast("binary")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, texts, hashes, sets, held = None, None, {}, {}, {}, 0
        for batch in batches:
            out = []
            for cell, a, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != here:
                    here, last, texts, hashes, sets, held = cell, None, {}, {}, {}, 0
                if b is None:  # texts come before the pairs of their cell
                    texts.setdefault(a, {})[text] = None  # rows may repeat
                    continue
                if (a, b) == last:
                    continue
                last, counts = (a, b), {}
                for end in last:
                    if end not in hashes:
                        plain = [zlib.decompress(t).decode() for t in texts[end]]
                        hashes[end] = list(zip(plain, hash_sets(pa.array(plain, pa.string()), length)))
                for one, x in hashes[a]:
                    for two, y in hashes[b]:
                        likely = len(np.intersect1d(x, y, assume_unique=True))
                        if likely * (100 + percent) < percent * (len(x) + len(y)):
                            continue
                        for t in (one, two):
                            if t not in sets:
                                if held > KEPT_SHINGLES:
                                    sets, held = {}, 0
                                sets[t] = shingle_set(t, length)
                                held += len(sets[t])
                        p, q = sets.get(one) or shingle_set(one, length), sets[two]
                        counts[len(p & q), len(p | q)] = None
                out += [(a, b, shared, together) for shared, together in counts if shared * 100 >= percent * together]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], batch.column(1).type if k < 2 else pa.int64()) for k in range(4)], ["a", "b", "shared", "together"])

    ordered = both.repartition(parts, "cell").sortWithinPartitions("cell", F.asc_nulls_first("b"), "a").select("cell", "a", "b", "text")
    return ordered.mapInArrow(check, f"a {kind}, b {kind}, shared long, together long")
