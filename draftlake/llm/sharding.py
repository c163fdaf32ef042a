"""Sharding: balanced label propagation over documents that share lines, passages or most of their content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import near_dedup
from . import textops as T
from .store import Scratch, read

SHARDS, SLACK, ROUNDS = 16, 0.05, 8
#: Bytes of the shortest line that links the documents that have it.
LINE_BYTES = 20
#: Words of a gram, and grams of a window whose least one links: documents that share GRAM + WINDOW - 1 words in a row share one.
GRAM, WINDOW = 5, 16
#: Ranges of hashes that documents are counted in for the first assignment.
_RANGES = 4096
#: Steps of an octave that gains are told apart by, and ranges of hashes that equal ones are ranked in.
_STEPS, _TURNS = 16, 8


def minimizers(h: np.ndarray, bounds: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the least gram of each window of word hashes; a row of fewer grams is one window. ``window`` is a power of two."""
    grams = T.ngrams(h, gram)[T.inside(bounds, gram)]
    ends = np.concatenate([[0], np.cumsum(np.maximum(np.diff(bounds) - gram + 1, 0))])
    row = T.rows_of(ends)
    least, at, d = grams.copy(), np.arange(len(grams)), 1
    while d < window:
        here = np.flatnonzero(at + d < ends[row + 1])
        least[here] = np.minimum(least[here], least[here + d])
        d *= 2
    new = (at + window <= ends[row + 1]) | (at == ends[row])
    least, row = least[new], row[new]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    return least[new], row[new]


def _links_of(
    data: np.ndarray, offs: np.ndarray, low: np.ndarray, low_offs: np.ndarray, least: int, content: bool
) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the links of a chunk, each once a row: lines, minimizers and MinHash bands."""
    s, e = T.runs(data != 10, offs)
    long = e - s >= least
    s, e = s[long], e[long]
    rows, found = [T.rows_of(T.by_row(s, offs))], [T.hash_runs(data, s, e)]
    if content:
        s, e, bounds = T.words(low, low_offs)
        h = T.hash_runs(low, s, e)
        x, row = minimizers(h, bounds)
        rows.append(row)
        found.append(T.mix(x ^ np.uint64(1)))
        grams, gram_bounds = near_dedup.shingles_of(h, bounds, T.hash_rows(h, bounds), near_dedup.NGRAM)
        if len(grams):
            rows.append(np.repeat(np.flatnonzero(np.diff(gram_bounds) > 0), near_dedup.BANDS))
            found.append(near_dedup.band_keys(grams, gram_bounds, near_dedup.BANDS, near_dedup.ROWS).reshape(-1))
    row, h = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, doc_id, d) sorted by h those whose h is not alone, and after each such group a row without document: h, n, x, y.

    n counts the group; x and y tell sets of documents apart. Nothing but the last row and the sums of its group is held.
    """
    held: pa.RecordBatch | None = None
    n, x, y = 0, np.uint64(0), np.uint64(0)
    for b in batches:
        if not len(b):
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        held = b.slice(len(b) - 1)
        yield from _emit(b.slice(0, len(b) - 1), b.column(0)[len(b) - 1].as_py(), state := [n, x, y])
        n, x, y = state
    if held is not None:
        yield from _emit(held, None, [n, x, y])


def _emit(b: pa.RecordBatch, following: int | None, state: list) -> Iterator[pa.RecordBatch]:
    """The rows of ``b`` that ``_shared`` returns; ``state`` has the sums of the group that the first row goes on with."""
    if not len(b):
        return
    h, d = np.asarray(b.column(0)), np.asarray(b.column(2)).view(np.uint64)
    ends = np.ones(len(h), bool)
    ends[:-1] = h[1:] != h[:-1]
    ends[-1] = following is None or h[-1] != following
    heads = np.concatenate([[0], np.flatnonzero(ends) + 1])
    heads = heads[heads < len(h)]
    n = np.diff(np.append(heads, len(h)))
    x, y = np.bitwise_xor.reduceat(T.mix(d), heads), np.bitwise_xor.reduceat(T.mix(d ^ np.uint64(0x5851F42D4C957F2D)), heads)
    n[0] += state[0]
    x[0] ^= state[1]
    y[0] ^= state[2]
    done = np.ones(len(heads), bool)
    done[-1] = ends[-1]
    state[:] = [0, np.uint64(0), np.uint64(0)] if done[-1] else [int(n[-1]), x[-1], y[-1]]
    size = np.diff(np.append(heads, len(h)))
    keep = np.repeat((n > 1) | ~done, size)
    told = done & (n > 1)
    ids = b.column(1)
    rows = pa.array(np.flatnonzero(keep))
    sums = [
        pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(v)]) for v in (n[told], x[told].view(np.int64), y[told].view(np.int64))
    ]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([h[keep], h[heads[told]]])), pa.concat_arrays([ids.take(rows), pa.nulls(int(told.sum()), ids.type)]),
            *sums
        ],
        ["h", "doc_id", "n", "x", "y"]
    )


def links(docs: DataFrame, least: int = LINE_BYTES, content: bool = True, repeated: bool = True) -> DataFrame:
    """(h, doc_id, n, x, y) of the links that two or more documents have: h names the link, n counts its documents.

    Links are lines of at least ``least`` bytes and, with ``content``, those that survive edits: op10's MinHash bands, for near
    copies, and minimizers, for passages wherever in a line they are. A row without doc_id has the sums of its link: n, and
    two hashes x and y of the set of its documents; the others have no sums. ``repeated``: a doc_id may have several rows.

    One pass over the texts, one shuffle of 24 bytes a link, a sort, and one stream through the sorted rows that drops what
    is alone: a link of any number of documents is never held.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offs, low, low_offs in T.both_cases(b.column(1)):
                row, h = _links_of(data, offs, low, low_offs, least, content)
                take = pa.array(first + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), b.column(0).take(take), b.column(2).take(take)], ["h", "doc_id", "d"]
                )

    texts = docs.select("doc_id", docs["text"].cast("string").alias("text"), F.xxhash64("doc_id").alias("d"))
    every = texts.transform(T.batched, run, f"h bigint, doc_id {kind}, d bigint").repartition("h")
    if repeated:
        every = every.distinct()
    return every.sortWithinPartitions("h").transform(T.batched, _shared, f"h bigint, doc_id {kind}, n bigint, x bigint, y bigint")


def bundled(found: DataFrame) -> DataFrame:
    """(h, doc_id, n, m): ``links`` without the sums' rows; links of the same documents are one, which stands for ``m`` of them."""
    sums = found.where("n IS NOT NULL").select("h", "n", F.xxhash64("n", "x", "y").alias("g"))
    members = found.where("n IS NULL").select("h", "doc_id")
    return members.join(sums.hint("merge"), "h").groupBy(F.col("g").alias("h"), "doc_id", "n").agg(F.count("*").alias("m"))


def even(ids: DataFrame, shards: int) -> DataFrame:
    """(doc_id, shard) with sizes that differ by one at most: documents in the order of a hash, cut into equal parts."""
    hashed = ids.withColumn("x", F.xxhash64("doc_id")).withColumn("r", F.pmod(F.shiftrightunsigned("x", 40), F.lit(_RANGES)))
    counts = {r["r"]: r["n"] for r in hashed.groupBy("r").agg(F.count("*").alias("n")).collect()}  # _RANGES rows at most
    total, before, upto = sum(counts.values()), [], 0
    for k in range(_RANGES):
        before.append(upto)
        upto += counts.get(k, 0)
    place = F.element_at(
        F.array(*map(F.lit, before)), (F.col("r") + 1).cast("int")
    ) + F.row_number().over(Window.partitionBy("r").orderBy("x", "doc_id")) - 1
    return hashed.select("doc_id", F.floor(place * shards / F.lit(max(total, 1))).cast("int").alias("shard"))


def quotas(wish: dict[tuple[int, int], int], sizes: list[int], capacity: int) -> dict[tuple[int, int], int]:
    """How many documents may move from shard to shard so that no shard exceeds the capacity.

    What two shards want to exchange is allowed on both sides; the room that is left is shared out by the order of demand.
    """
    allowed = {(a, b): min(n, wish.get((b, a), 0)) for (a, b), n in wish.items()}
    room = [capacity - s for s in sizes]
    for (a, b), n in sorted(wish.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - allowed[a, b], max(0, room[b]))
        allowed[a, b] += more
        room[b] -= more
        room[a] += more
    return allowed


def _wishes(edges: DataFrame, label: DataFrame, shards: int, turn: int) -> DataFrame:
    """(doc_id, own, target, step, r, x): the documents that want to move in a round, how much by, and their place among equals."""
    here = edges.join(label.hint("merge"), "doc_id")  # no join depends on what is small enough to broadcast
    each = range(shards)
    count = here.groupBy("h").agg(*(F.count_if(F.col("shard") == s).alias(f"c{s}") for s in each))
    share = F.col("m") / (F.col("n") - 1)
    weight = here.join(count.hint("merge"), "h").groupBy("doc_id", "shard").agg(
        *(F.round(F.sum(share * (F.col(f"c{s}") - (F.col("shard") == s).cast("int"))), 9).alias(f"w{s}") for s in each)
    )
    best = F.array_max(F.array(*(F.when(F.col("shard") != s, F.struct(F.col(f"w{s}").alias("w"), F.lit(-s).alias("s"))) for s in each)))
    own = F.element_at(F.array(*(F.col(f"w{s}") for s in each)), F.col("shard") + 1)
    # in each round only half of the documents may move, so that neighbours don't swap places for ever
    may = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(2)) == 0
    x = F.xxhash64("doc_id")
    want = weight.where(may).select(
        "doc_id", F.col("shard").alias("own"), best.alias("to"), own.alias("stay")
    ).withColumn("gain", F.round(F.col("to.w") - F.col("stay"), 9)).where("gain > 0")
    return want.select(
        "doc_id", "own", (-F.col("to.s")).alias("target"), F.floor(F.log2("gain") * _STEPS).alias("step"),
        F.pmod(F.shiftrightunsigned(x, 40), F.lit(_TURNS)).alias("r"), x.alias("x")
    )


def propagate(edges: DataFrame, label: DataFrame, shards: int, capacity: int, rounds: int, scratch: Scratch) -> DataFrame:
    """(doc_id, shard) after ``rounds`` rounds from ``label``.

    A link that n documents have links each two of them with weight 1 / (n - 1). In a round each document sums the weights by
    shard of its neighbours: links count their documents by shard first, so that a link of n documents costs n and not n x n.
    A document wishes for the shard with most weight, the least of equal ones, if that is more than its own has; the wishes
    between two shards are granted up to the quota, in the order of their gain (to a 16th of an octave), then of a hash. A
    link with a number ``m`` counts m times. The driver sees counts by pair of shards, gain and range of hashes.
    """
    if "m" not in edges.columns:
        edges = edges.withColumn("m", F.lit(1))
    for k in range(rounds):
        wishes = scratch.write(_wishes(edges, label, shards, k))
        place = ["own", "target", "step", "r"]
        counts = sorted(
            (r["own"], r["target"], -r["step"], r["r"], r["n"]) for r in wishes.groupBy(*place).agg(F.count("*").alias("n")).collect()
        )
        want: dict[tuple[int, int], int] = {}
        before = []
        for a, b, step, r, n in counts:
            before.append((a, b, -step, r, want.get((a, b), 0)))
            want[a, b] = want.get((a, b), 0) + n
        if not want:
            scratch.drop(wishes)
            continue
        sizes = [0] * shards
        for r in label.groupBy("shard").count().collect():
            sizes[r["shard"]] = r["count"]
        quota = quotas(want, sizes, capacity)
        # of each pair of shards the group of wishes that the quota ends in, and how many of it: shards squared rows at most
        ends = {(a, b): (a, b, step, r, quota[a, b] - n) for a, b, step, r, n in before if quota[a, b] > n}
        limit = F.broadcast(
            label.sparkSession.createDataFrame([*ends.values()], "own int, target int, last bigint, last_r bigint, quota bigint")
        )
        asked = wishes.join(limit, ["own", "target"])
        sure = asked.where("step > last OR step = last AND r < last_r").select("doc_id", "target")
        rank = F.row_number().over(Window.partitionBy(*place).orderBy("x", "doc_id"))
        some = asked.where("step = last AND r = last_r").withColumn("rank", rank).where("rank <= quota").select("doc_id", "target")
        moves = sure.union(some)
        new = scratch.write(
            label.join(moves.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("target", "shard").alias("shard"))
        )
        scratch.drop(label)
        scratch.drop(wishes)
        label = new
    return label


def sharded(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, rounds: int = ROUNDS, least: int = LINE_BYTES) -> DataFrame:
    """(doc_id, shard): one of ``shards`` shards for each document, those that share content together as far as sizes allow.

    Two documents are linked if they share a line of at least ``least`` bytes, a band of op10's MinHash signatures, or a
    minimizer, as all do that share ``GRAM + WINDOW - 1`` words in a row; shorter lines link by their words only. No shard has
    more than ceil(documents / shards x (1 + slack)) documents. Balanced label propagation starts from equal parts.

    Defined cases: rows with a null doc_id have no shard and no result; rows that share a doc_id are one document, with the
    links of all of them; null and empty texts have no links but a shard; very long texts are linked by all that they have;
    of equally good shards the least is wished for, and of equal wishes those with the least hash of the doc_id are granted;
    other columns are ignored; an empty table gives an empty result. The driver sees counts only.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text")).where("doc_id IS NOT NULL")
    label = scratch.write(even(rows.select("doc_id").distinct(), shards))
    total = label.count()
    found = scratch.write(links(rows.where("text IS NOT NULL"), least, repeated=rows.count() > total))
    edges = scratch.write(bundled(found))
    scratch.drop(found)
    capacity = int(-(-total * (1 + slack) // shards))
    return propagate(edges, label, shards, max(capacity, -(-total // shards)), rounds, scratch)


def cut(docs: DataFrame, label: DataFrame, least: int = LINE_BYTES) -> DataFrame:
    """One row (weight, cut): the weight of all links by lines, and of those between shards."""
    found = links(docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL"), least, content=False)
    edges = found.where("n IS NULL").select("h", "doc_id").join(found.where("n IS NOT NULL").select("h", "n"), "h").join(label, "doc_id")
    per = edges.groupBy("h", "n", "shard").agg(F.count("*").alias("c")).groupBy("h", "n").agg(
        F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("inside")
    )
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return per.agg(F.sum(pairs / (F.col("n") - 1)).alias("weight"), F.sum((pairs - F.col("inside")) / (F.col("n") - 1)).alias("cut"))


def op9_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(read(spark, sf_dir, "documents"))
