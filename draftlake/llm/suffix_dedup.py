"""Suffix-array dedup: passages of at least a number of words that occur more than once in the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .store import Scratch, read, row_key

#: Words of the shortest passage that counts.
LENGTH = 50
#: Words of the k-grams that address passages.
ANCHOR = 8
#: Fragments of one address that are searched together. The windows of an address with more are grouped by hashes of their own.
HOT = 20_000
_CHUNK, _POOL = 1 << 20, 200_000
_PLACE = np.uint64((1 << 30) - 1)


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, its inverse) by prefix doubling; the symbols are from 0 on, and the last occurs once."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    h = 1
    while True:
        key = rank * (n + 1)
        key[:-h] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order, rank
        h *= 2


def long_prefix(sa: np.ndarray, isa: np.ndarray, s: np.ndarray, least: int) -> np.ndarray:
    """Whether each suffix shares at least ``least`` symbols with the one before it in the suffix array.

    Breadth-first backward extension: an interval of the suffixes that begin with w is extended by each symbol c in its part
    of the Burrows-Wheeler transform to that of cw; where such an interval ends for the first time, the common prefix with
    the next suffix has the length of w. Lengths come in increasing order, and the search stops at ``least``; what has no
    length by then is long. All intervals of a level are extended at once.
    """
    n = len(sa)
    lf = isa[sa - 1]  # the last symbol occurs once, so that wrapping around is harmless
    back = np.empty(n, np.int64)
    back[lf] = np.arange(n)
    same = np.zeros(n + 1, bool)  # the rows of the sorted order at k - 1 and k begin with the same symbol
    first = s[sa]
    same[1:n] = first[1:] == first[:-1]
    after = np.where(same[lf + 1], back[np.minimum(lf + 1, n - 1)], n)  # the next place of this symbol in the transform
    before = np.where(same[lf], back[np.maximum(lf - 1, 0)], -1)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lb, rb = np.array([0]), np.array([n - 1])
    for _ in range(least):
        if not len(lb):
            break
        size = rb - lb + 1
        at = np.arange(size.sum()) + np.repeat(lb - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        ends = lf[at[after[at] > np.repeat(rb, size)]]
        starts = lf[at[before[at] < np.repeat(lb, size)]]
        # children are disjoint: sorted, the k-th start belongs to the k-th end
        ends.sort()
        starts.sort()
        new = ~known[ends + 1]
        lb, rb = starts[new], ends[new]
        known[rb + 1] = True
    return ~known[:n]


def repeated_windows(parts: list[np.ndarray], least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part (repeated, first) by window of ``least`` symbols: whether it occurs again, and is the first to have it."""
    size = np.array([len(p) for p in parts])
    total = int(size.sum()) + len(parts)
    ends = np.cumsum(size + 1) - 1
    s = np.empty(total, np.int64)
    inner = np.ones(total, bool)
    inner[ends] = False
    s[inner] = np.unique(np.concatenate(parts), return_inverse=True)[1] + len(parts)
    s[ends] = np.arange(len(parts))  # each part ends with a symbol of its own
    sa, isa = suffix_array(s)
    long = long_prefix(sa, isa, s, least)
    head = np.flatnonzero(~long)
    group = np.cumsum(~long) - 1
    count = np.diff(np.append(head, total))
    least_at = np.minimum.reduceat(sa, head)
    of = group[isa]
    again, first = count[of] > 1, least_at[of] == np.arange(total)
    at = ends - size
    return [(again[a : a + n - least + 1], first[a : a + n - least + 1]) for a, n in zip(at, size)]


def _minimizers(h: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first and last window it stands for) along the words of a chunk.

    A window of ``length`` words is addressed by the least hash among its k-grams, the leftmost of equal ones. Equal windows
    have equal addresses at the same place in them, wherever they are.
    """
    starts = T.inside(bounds, length)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    g = T.ngrams(h, k)
    m = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
    span, width = length - k + 1, 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if span > width:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    p = (m[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = p[1:] != p[:-1]
    i = np.flatnonzero(new)
    return g[p[i]], p[i], starts[i], starts[np.append(i[1:], len(p)) - 1]


def _anchors(texts: DataFrame, length: int, k: int) -> DataFrame:
    """(a, doc_id, rk, p): each address, and its word in the document."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offs in T.chunks(b.column(2), _CHUNK):
                s, e, bounds = T.words(data, offs, ~T.SPACE)
                a, p, _, _ = _minimizers(T.hash_runs(data, s, e), bounds, length, k)
                row = np.searchsorted(bounds, p, "right") - 1
                take = pa.array(first + row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a.view(np.int64)), b.column(0).take(take), b.column(1).take(take),
                        pa.array((p - bounds[row]).astype(np.int32))
                    ],
                    ["a", "doc_id", "rk", "p"]
                )

    return texts.transform(T.batched, run, f"a bigint, doc_id {kind}, rk bigint, p int")


def _fragments(texts: DataFrame, length: int, k: int) -> DataFrame:
    """(a, doc_id, rk, at, words): the words of all windows that each of the addresses in ``ps`` stands for.

    Of those in ``hs`` each window has a row of its own, without words, whose address is a hash of all of its words.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()

    def chosen(lists: pa.Array, bounds: np.ndarray, p: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(lists)), np.asarray(pa.compute.list_value_length(lists)))
        return np.isin(p, np.asarray(pa.compute.list_flatten(lists)) + bounds[row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offs in T.chunks(b.column(2), _CHUNK):
                n = len(offs) - 1
                s, e, bounds = T.words(data, offs, ~T.SPACE)
                h = T.hash_runs(data, s, e)
                a, p, w0, w1 = _minimizers(h, bounds, length, k)
                ok, hot = chosen(b.column(3).slice(first, n), bounds, p), chosen(b.column(4).slice(first, n), bounds, p)
                small = (h >> np.uint64(32)).astype(np.uint32)
                raw = [small[i : j + length].tobytes() for i, j in zip(w0[ok], w1[ok])]
                alone = np.concatenate([np.arange(i, j + 1) for i, j in zip(w0[hot], w1[hot])]) if hot.any() else np.zeros(0, np.int64)
                own = T.mix(T.ngrams(h, length)[alone] ^ np.uint64(0x6A09E667F3BCC909)) if len(alone) else np.zeros(0, np.uint64)
                row = np.searchsorted(bounds, np.concatenate([p[ok], alone]), "right") - 1
                take = pa.array(first + row)
                at = np.concatenate([w0[ok], alone]) - bounds[row]
                words = pa.concat_arrays([pa.array(raw, pa.binary()), pa.nulls(len(alone), pa.binary())])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([a[ok], own]).view(np.int64)), b.column(0).take(take), b.column(1).take(take),
                        pa.array(at.astype(np.int32)), words
                    ],
                    ["a", "doc_id", "rk", "at", "words"]
                )

    return texts.transform(T.batched, run, f"a bigint, doc_id {kind}, rk bigint, at int, words binary")


def _equal(rows: pa.RecordBatch, before: int | None, following: int | None, length: int) -> pa.RecordBatch:
    """The windows of rows without words that aren't alone, given the addresses around them: the first of each address is the original."""
    a = np.asarray(rows.column(0))
    same = np.zeros(len(a) + 1, bool)
    same[1:-1] = a[1:] == a[:-1]
    if len(a):
        same[0], same[-1] = before == int(a[0]), following == int(a[-1])
    keep = pa.array(np.flatnonzero(same[1:] | same[:-1]))
    at = rows.column(3).take(keep).cast(pa.int64())
    return pa.RecordBatch.from_arrays(
        [rows.column(1).take(keep), rows.column(2).take(keep), at, pa.compute.add(at, length), pa.array(same[:-1]).take(keep)],
        ["doc_id", "rk", "lo", "hi", "duplicate"]
    )


def _intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _search(pool: pa.Table, length: int) -> pa.Table:
    """The window intervals that repeat, of fragments sorted by (a, doc_id, rk, at), all those of an address together."""
    index: dict[tuple[int, bytes], int] = {}
    uses: list[list[int]] = []
    for i, key in enumerate(zip(pool.column("a").to_pylist(), pool.column("words").to_pylist())):
        j = index.setdefault(key, len(uses))
        if j == len(uses):
            uses.append([])
        uses[j].append(i)
    found = repeated_windows([np.frombuffer(w, np.uint32) for _, w in index], length)
    at = pool.column("at").to_pylist()
    rows, lo, hi, dup = [], [], [], []
    for used, (again, first) in zip(uses, found):
        again = again | (len(used) > 1)  # equal fragments: each later one repeats the first
        for duplicate, mask in ((False, again & first), (True, again & ~first)):
            for x, y in _intervals(mask):
                rows.append(used[0])
                lo.append(at[used[0]] + x)
                hi.append(at[used[0]] + y - 1 + length)
                dup.append(duplicate)
        for i in used[1:]:
            rows.append(i)
            lo.append(at[i])
            hi.append(at[i] + len(again) - 1 + length)
            dup.append(True)
    take = pa.array(rows, pa.int64())
    return pa.table(
        {
            "doc_id": pool.column("doc_id").take(take), "rk": pool.column("rk").take(take), "lo": pa.array(lo, pa.int64()),
            "hi": pa.array(hi, pa.int64()), "duplicate": pa.array(dup, pa.bool_())
        }
    )


def repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(doc_id, start_word, end_word, duplicate): the passages of at least ``length`` words that occur more than once.

    Words are runs without ASCII white space, counted from 0; the end is exclusive. For each window of ``length`` words
    that the corpus has again, in another document or the same, the first in the order of (doc_id, place) is the original.
    A row with ``duplicate`` = false is a maximal run of words inside originals, with true one inside later occurrences,
    which a dedup would cut.

    1. Each window is addressed by its least k-gram hash; addresses that occur once can't be those of a repeated window. A
       stream through the sorted addresses drops them.
    2. The fragments around the other addresses are brought together by address, equal windows thus always; equal
       fragments are searched once.
    3. In each task a suffix array over the fragments of whole addresses, and the threshold-bounded interval expansion on
       its Burrows-Wheeler transform, give the windows with a common prefix of at least ``length`` words.
    4. An address of more than ``HOT`` places, such as one in a licence that very many documents have in other surroundings, isn't
       held by one task: each of its windows is addressed by a hash of all its words, and equal ones meet in a stream.
    The result is that of one suffix array over the whole corpus: no window is left out, and words are compared by hashes
    of 32 bits, 50 in a row, or windows by one of 64 bits. A task holds some 85 words for each of ``HOT`` fragments at most.

    Defined cases: null texts have no words; texts shorter than ``length`` have no windows; texts of any length are searched
    whole; a null doc_id comes last in the order and is returned as null; rows with one doc_id are texts of their own, in the
    order of a hash of the text; equal rows repeat each other, and their passages are reported once for both, as originals
    and as duplicates; other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(
        "doc_id", row_key(docs["text"].cast("string")).alias("rk"), docs["text"].cast("string").alias("text")
    ).where("text IS NOT NULL")
    scratch = Scratch(docs.sparkSession, "suffix")
    places = scratch.write(
        _anchors(texts, length, k).repartition("a").sortWithinPartitions("a").transform(
            T.batched, T.shared_rows, f"a bigint, doc_id {kind}, rk bigint, p int"
        )
    )
    hot = places.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("a", F.lit(True).alias("hot"))
    marked = places.join(hot, "a", "left")
    some = lambda hot: F.collect_set(F.when(F.col("hot").isNotNull() if hot else F.col("hot").isNull(), F.col("p")))
    listed = marked.groupBy(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk")).agg(some(False).alias("ps"), some(True).alias("hs"))
    held = texts.join(
        listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("rk") == F.col("_rk"))
    ).select("doc_id", "rk", "text", "ps", "hs")
    order = [F.col("doc_id").asc_nulls_last(), "rk", "at"]
    parts = _fragments(held, length, k).repartition("a").sortWithinPartitions("a", *order)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        size, limit = 0, _POOL

        def whole(pool: pa.Table, a: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Addresses in turn, several to a search while they are small."""
            lo = 0
            starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            for x in [*starts[1:].tolist(), len(a)] if len(a) else ():
                if x == len(a) or n[lo:x].sum() >= _POOL:
                    yield from _search(pool.slice(lo, x - lo).combine_chunks(), length).to_batches()
                    lo = x

        last: pa.RecordBatch | None = None  # of the rows without words
        before: int | None = None  # the address of the one ahead of it
        for b in batches:
            alone = pa.compute.is_null(b.column(4))
            if pa.compute.any(alone).as_py():
                one = b.filter(alone)
                if last is not None:
                    one = pa.Table.from_batches([last, one]).combine_chunks().to_batches()[0]
                last = one.slice(len(one) - 1)
                yield _equal(one.slice(0, len(one) - 1), before, last.column(0)[0].as_py(), length)
                before = one.column(0)[len(one) - 2].as_py() if len(one) > 1 else before
                b = b.filter(pa.compute.invert(alone))
            if not len(b):
                continue
            kept.append(pa.Table.from_batches([b]))
            size += (pa.compute.sum(pa.compute.binary_length(b.column(4))).as_py() or 0) // 4
            if size >= limit:
                pool = pa.concat_tables(kept)
                a, n = np.asarray(pool.column("a")), np.asarray(pa.compute.binary_length(pool.column("words"))) // 4
                cut = 0 if a[0] == a[-1] else int(np.flatnonzero(a != a[-1])[-1]) + 1  # the last address may go on in the next batch
                yield from whole(pool.slice(0, cut), a[:cut], n[:cut])
                kept, size = [pool.slice(cut)], int(n[cut:].sum())
                limit = max(_POOL, 2 * size)
        if last is not None:
            yield _equal(last, before, None, length)
        pool = pa.concat_tables(kept) if kept else None
        if pool is not None and pool.num_rows:
            yield from whole(pool, np.asarray(pool.column("a")), np.asarray(pa.compute.binary_length(pool.column("words"))) // 4)

    spans = parts.transform(T.batched, search, f"doc_id {kind}, rk bigint, lo bigint, hi bigint, duplicate boolean")
    by = Window.partitionBy("doc_id", "rk", "duplicate").orderBy("lo", "hi")
    new = F.when(F.col("lo") > F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    merged = spans.withColumn("new", new).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy("doc_id", "rk", "duplicate", "run").agg(
        F.min("lo").alias("start_word"), F.max("hi").alias("end_word")
    ).select("doc_id", "start_word", "end_word", "duplicate")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i + 1:i + {LENGTH}], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - {LENGTH - 1}, 0))) AS i FROM w)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) > 1 AS duplicate, count(*) OVER (PARTITION BY gram) AS n FROM g),
s AS (SELECT doc_id, duplicate, i, i > lag(i) OVER (PARTITION BY doc_id, duplicate ORDER BY i) + {LENGTH} AS new FROM r WHERE n > 1),
t AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, duplicate ORDER BY i) AS run FROM s)
SELECT doc_id, CAST(min(i) AS BIGINT) AS start_word, CAST(max(i) + {LENGTH} AS BIGINT) AS end_word, duplicate FROM t GROUP BY doc_id, duplicate, run"""
