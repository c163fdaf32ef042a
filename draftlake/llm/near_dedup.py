"""MinHash near-dedup: circulant signatures, banding, exact Jaccard verification, connected groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .store import Scratch, read

NGRAM, THRESHOLD, BANDS, ROWS = 3, 0.6, 24, 4
_CHUNK = 1 << 20


def _shingles(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, bounds by row, hash of all words of each row); a row of 1 to n - 1 words is one shingle."""
    s, e, bounds = T.words(data, offs)
    h = T.hash_runs(data, s, e)
    whole = T.hash_rows(h, bounds)
    return *shingles_of(h, bounds, whole, n), whole


def shingles_of(h: np.ndarray, bounds: np.ndarray, whole: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, bounds by row) of words given by their hashes."""
    at = T.inside(bounds, n)
    grams = T.ngrams(h, n)[at]
    count = np.maximum(np.diff(bounds) - n + 1, 0)
    short = (count == 0) & (np.diff(bounds) > 0)
    if short.any():
        where = np.concatenate([[0], np.cumsum(count)])[:-1][short]
        grams = np.insert(grams, where, whole[short])
        count = np.where(short, 1, count)
    return grams, np.concatenate([[0], np.cumsum(count)])


def signature(grams: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """k circulant MinHash coordinates of each row that has shingles.

    The universe is the 32-bit integers: sigma shuffles it once, and coordinate j takes the least value of pi shifted
    circularly by j, which on this universe is pi of a wrapping subtraction. pi is a product, a shifted exclusive or and
    another product; its first product of a shifted value is the one before less the factor.
    """
    sigma = (T.mix(grams ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), k), np.uint32)
    x, y = sigma * np.uint32(0x85EBCA6B), np.empty_like(sigma)
    for j in range(k):
        x -= np.uint32(0x85EBCA6B)
        np.right_shift(x, np.uint32(16), out=y)
        y ^= x
        y *= np.uint32(0xC2B2AE35)
        out[:, j] = np.minimum.reduceat(y, starts)
    return out


def band_keys(grams: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(rows that have shingles, bands): the hash of each band of each signature."""
    sig = signature(grams, bounds, bands * rows).reshape(-1, bands, rows).astype(np.uint64)
    key = np.zeros(sig.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
    return key


def signatures(docs: DataFrame, ngram: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, whole, bands) of the documents that have a word."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offs in T.chunks(T.lower(b.column(1)), _CHUNK):
                grams, bounds, whole = _shingles(data, offs, ngram)
                some = np.diff(bounds) > 0
                if not some.any():
                    continue
                key = band_keys(grams, bounds, bands, rows)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, key.size + 1, bands, dtype=np.int32)), pa.array(key.reshape(-1).view(np.int64))
                )
                ids = b.column(0).slice(first, len(offs) - 1).filter(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, pa.array(whole[some].view(np.int64)), lists], ["doc_id", "whole", "bands"])

    return docs.transform(T.batched, run, f"doc_id {kind}, whole bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, ngram: int) -> DataFrame:
    """(doc_id, shingles): the sorted distinct 64-bit shingle hashes as bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offs in T.chunks(T.lower(b.column(1)), _CHUNK):
                grams, bounds, _ = _shingles(data, offs, ngram)
                sets = [np.unique(grams[i:j]).tobytes() for i, j in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sets)), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return docs.transform(T.batched, run, f"doc_id {kind}, shingles binary")


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose exact Jaccard similarity reaches the threshold.

    The sets of the more varied side b join first, so that each is shuffled once more with its pair, not with its group.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b"
    ).join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array([jaccard(x.as_buffer(), y.as_buffer()) >= threshold for x, y in zip(b.column(2), b.column(3))], pa.bool_())
            yield b.select([0, 1]).filter(ok)

    return both.select("a", "b", "sa", "sb").transform(T.batched, run, f"a {kind}, b {kind}")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, group_id): each node of the edges (a, b) and the least node of its connected component.

    Alternating large-star and small-star steps; each round is a written table, and the rounds grow with the logarithm of
    the longest chain.
    """
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        # large star: the larger neighbours of a node go to its least neighbour
        two = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = two.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of a node, and itself, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.write(small)
        sums = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        scratch.drop(now)
        now = new
        if tuple(sums) == state:
            return now.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).union(
                now.select(F.col("v").alias("doc_id"), F.col("v").alias("group_id")).distinct()
            )
        state = tuple(sums)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (g, doc_id) sorted by both those whose g is not alone, with the first doc_id of their g as ``a``.

    Nothing but the last row and the first doc_id of its bucket is held, however large the bucket is.
    """

    def emit(b: pa.RecordBatch, following: int | None, lead: pa.Array | None) -> tuple[pa.RecordBatch, pa.Array | None]:
        g, ids = np.asarray(b.column(0)), b.column(1)
        same = np.zeros(len(g) + 1, bool)  # as the row before
        same[1:-1] = g[1:] == g[:-1]
        same[0], same[-1] = lead is not None, following is not None and g[-1] == following
        pool = pa.concat_arrays([lead, ids]) if lead is not None else ids
        head = np.maximum.accumulate(np.where(same[:-1], 0, np.arange(len(g)) + (lead is not None)))
        keep = np.flatnonzero(same[1:] | same[:-1])
        out = pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(keep)), ids.take(pa.array(keep)), pool.take(pa.array(head[keep]))], ["g", "doc_id", "a"]
        )
        return out, pool.slice(int(head[-1]), 1) if same[-1] else None

    held: pa.RecordBatch | None = None
    lead: pa.Array | None = None
    for b in batches:
        if not len(b):
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        held = b.slice(len(b) - 1)
        if len(b) > 1:
            out, lead = emit(b.slice(0, len(b) - 1), held.column(0)[0].as_py(), lead)
            yield out
    if held is not None:
        yield emit(held, None, lead)[0]


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, ngram: int = NGRAM, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, group_id, keep) of each document that has a near duplicate; ``group_id`` is the least doc_id of the group.

    Two documents are near duplicates if the Jaccard similarity of their sets of word n-grams (lower case, words are runs of
    letters and digits, every character beyond ASCII counting as a letter) reaches the threshold; groups are the connected
    components. ``keep`` marks the one that stays.

    1. Circulant MinHash signatures, and documents of equal word sequences collapsed to the least doc_id (exactly alike).
    2. Band buckets: every member is paired with the least of its bucket, and the pairs are verified on the exact sets. Buckets
       are read as a stream of sorted rows, and none is held.
    3. A bucket that still spans several groups has all its pairs across groups verified too, so that the groups equal
       those of all pairs of all buckets, without the quadratic work for a bucket of copies. Nothing is capped.
    At a similarity of 0.6 the default banding finds a pair with probability 0.964, at 0.7 with 0.999.

    Defined cases: rows with a null doc_id or text, or no word, take no part; rows that share a doc_id are one document and
    each of their texts counts; of equal documents the least doc_id stays; texts of any length are compared whole; other columns
    are ignored; an empty table gives an empty result. A text without letters and digits has no word. Texts of fewer than n
    words are one shingle, and so are texts without blanks and ASCII signs, such as Chinese: of these only equal ones are found.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", docs["text"].cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    first = scratch.write(signatures(texts, ngram, bands, rows))
    # partial aggregates and a join, in which AQE may split the copies of one text
    copied = first.groupBy("whole").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies")
    ).where("copies > 1").select("whole", "least")
    sig = scratch.write(first.join(copied, "whole", "left").select("doc_id", F.coalesce("least", "doc_id").alias("rep"), "bands"))
    scratch.drop(first)
    exact = sig.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    band = sig.where("doc_id = rep").select(F.explode("bands").alias("g"), "doc_id").repartition("g").sortWithinPartitions("g", "doc_id")
    member = band.transform(T.batched, _buckets, f"g bigint, doc_id {kind}, a {kind}").where("g IS NOT NULL")
    member = scratch.write(member)
    pairs = scratch.write(member.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct())
    wanted = member.select("doc_id").distinct()
    sets = scratch.write(shingle_sets(texts.join(wanted, "doc_id", "left_semi"), ngram))
    found = scratch.write(verified(pairs, sets, threshold).union(exact))
    groups = scratch.write(components(found, scratch))
    # buckets that span groups
    label = scratch.write(member.join(groups, "doc_id", "left").select("g", "doc_id", F.coalesce("group_id", "doc_id").alias("c")))
    split = label.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("g")
    mixed = label.join(split, "g", "left_semi").select("g", "doc_id", "c")
    x, y = mixed.toDF("g", "a", "ca"), mixed.toDF("g", "b", "cb")
    more = x.join(y, "g").where("a < b AND ca <> cb").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    extra = scratch.write(verified(more, sets, threshold))
    if not extra.isEmpty():
        scratch.drop(groups)
        groups = scratch.write(components(found.union(extra), scratch))
    for old in (sig, member, pairs, sets, found, label, extra):
        scratch.drop(old)
    return groups.select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def one_row_of_each(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one row of each group of near-duplicate rows: that of the least doc_id, then of the least text hash.

    Rows are grouped by keys of doc_id and text, so that rows with a null doc_id (which come last) or a repeated one take
    part too, each for itself: another text of a doc_id stays unless it is a near duplicate too.

    Defined cases: of rows alike in doc_id and text one stays; rows with a null text or no word all stay; texts of any length
    are compared whole; other columns pass through, whatever their names; an empty table gives an empty one.
    """
    key, copy, text = "_near_key", "_near_copy", docs["text"].cast("string")
    keyed = docs.withColumn(key, F.xxhash64(docs["doc_id"], text))
    groups = near_groups(keyed.select(F.col(key).alias("doc_id"), text.alias("text")), **params)
    names = keyed.select(
        F.col(key).alias("k"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("h")
    ).where("id IS NOT NULL OR h IS NOT NULL").distinct()
    best = Window.partitionBy("group_id").orderBy(F.col("id").isNull(), "id", "h")
    gone = names.join(
        groups.select(F.col("doc_id").alias("k"), "group_id"), "k"
    ).withColumn("r", F.row_number().over(best)).where("r > 1").select(F.col("k").alias("gone_key"))
    left = keyed.join(gone, F.col(key) == F.col("gone_key"), "left_anti")
    # the join has the rows of a key together already
    alike = Window.partitionBy(key, "doc_id").orderBy(F.xxhash64(*docs.columns))
    worded = F.coalesce(F.col("text").cast("string").rlike("[0-9A-Za-z]|[^\\x00-\\x7F]"), F.lit(False))
    return left.withColumn(copy, F.row_number().over(alike)).where((F.col(copy) == 1) | ~worded).drop(key, copy)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))


#: All pairs by their common shingles, exactly, and the components; the operator finds a pair by its bands, with a probability near 1.
ORACLE_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + {NGRAM - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {NGRAM - 1}, 1) + 1)) AS k FROM t WHERE len(w) > 0) q),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common >= CAST({THRESHOLD} AS DOUBLE) * (x.n + y.n - common)),
l AS MATERIALIZED (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT u AS doc_id, u AS o FROM l UNION SELECT l.v, r.o FROM r JOIN l ON l.u = r.doc_id WHERE r.o < l.v),
c AS (SELECT doc_id, min(o) AS group_id FROM r GROUP BY doc_id)
SELECT doc_id, group_id, doc_id = group_id AS keep FROM c"""
