"""Packing: best-fit decreasing of all documents of the corpus into windows of a fixed number of tokens."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .store import Scratch, read, row_key, vocabulary_files

WINDOW = 2048
#: GPT-style pre-tokenisation; the vocabulary is a file of ranks.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_LOADED: dict[int, tuple[bytes, tiktoken.Encoding]] = {}


def encoding(ranks: bytes) -> tiktoken.Encoding:
    """The tokenizer of a file of ranks (base64 of the bytes, blank, rank); made once for one content."""
    if id(ranks) not in _LOADED:
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _LOADED.clear()
        _LOADED[id(ranks)] = ranks, tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})
    return _LOADED[id(ranks)][1]


def vocabulary_of(spark: SparkSession, path: str | None) -> bytes:
    """The file of ranks, by default ``byte_bpe_50k.tiktoken`` of the tokenizers' folder: about 1 MB, read on the driver alone."""
    with open(path or vocabulary_files(spark)[0], "rb") as f:
        return f.read()


def token_counts(docs: DataFrame, vocabulary: str | None) -> DataFrame:
    """(doc_id, rk, tokens) of each row with a text; each document has an end token besides those of its text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id", row_key(docs["text"].cast("string")).alias("rk"), docs["text"].cast("string").alias("text")
    ).where("text IS NOT NULL")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_of(docs.sparkSession, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(sent.value)
        for b in batches:
            n = [len(enc.encode_ordinary(t.as_py())) + 1 for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "rk", "tokens"])

    return rows.transform(T.batched, run, f"doc_id {kind}, rk bigint, tokens bigint")


class Tightest:
    """Segment tree over remaining capacities 0..n: whether windows of that capacity are open, and the least open one >= c."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, c: int, some: bool) -> None:
        i = c + self.size
        self.any[i] = some
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def least(self, c: int) -> int:
        """-1 if there is none."""
        i = c + self.size
        if self.any[i]:
            return c
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(histogram: dict[int, int], window: int) -> np.ndarray:
    """Best-fit decreasing of ``histogram[length]`` pieces of each length, all pieces at once.

    Windows of equal remaining capacity are alike, so they are kept as ranges of window numbers; the tightest open window
    takes as many pieces of one length as it can hold before any other is touched, which is what the rule does piece by
    piece. Rows of the result: (length, rank of the first piece within its length, pieces, pieces a window, first window,
    offset in the window). Of equally tight windows the one that came to that capacity first is taken.
    The work and the result depend on ``window``, not on the number of pieces.
    """
    tree, open_, new, plan = Tightest(window), {}, 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            c = tree.least(length)
            if c < 0:
                c, per = window, window // length
                first, n = new, -(-left // per)
                new += n
            else:
                per = c // length
                first, n = open_[c].popleft()
                need = -(-left // per)
                if n > need:
                    open_[c].appendleft((first + need, n - need))
                    n = need
                if not open_[c]:
                    tree.set(c, False)
            took = min(left, n * per)
            plan.append((length, rank, took, per, first, window - c))
            full, rest = divmod(took, per)
            for start, count, used in ((first, full, per), (first + full, 1 if rest else 0, rest)):
                c2 = c - used * length
                if count and c2:
                    open_.setdefault(c2, deque()).append((start, count))
                    tree.set(c2, True)
            rank, left = rank + took, left - took
    return np.array(plan, np.int64).reshape(-1, 6)


def place(plan: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset in it) of the pieces with the given ranks within their lengths."""
    order = np.lexsort((plan[:, 1], plan[:, 0])) if len(plan) else np.zeros(0, np.int64)
    p = plan[order]
    key = p[:, 0] * (1 << 42) + p[:, 1]
    at = np.searchsorted(key, length * (1 << 42) + rank, "right") - 1
    p = p[at]
    k = rank - p[:, 1]
    return p[:, 4] + k // p[:, 3], p[:, 5] + k % p[:, 3] * length


def packed(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """(window_id, window_offset, doc_id, doc_offset, n_tokens) of each piece: where it lies in its window and document.

    A document has the tokens of its text and an end token. One longer than the window is first cut into full windows;
    the rest is a piece like any other. Pieces are placed by decreasing length, in the order of (doc_id, offset) within
    one length, each in the open window with the least remaining capacity that holds it, or in a new one. The packing is
    that of the whole corpus, not of parts of it: only the histogram of lengths goes to the driver (at most ``window``
    numbers), the plan sent back depends on ``window`` alone, and lengths are ranked by counts of sorted partitions.

    ``vocabulary`` is a file of ranks on the driver. Defined cases: null texts have no piece; an empty text is its end token; a
    text of any length is cut into as many windows as it fills; a null doc_id comes after others and is returned as null;
    repeated rows are documents of their own, and fully equal pieces lie in any order; other columns are ignored; an empty
    table gives an empty result. One shuffle, of about 40 bytes a piece, without the text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = token_counts(docs, vocabulary)
    cut = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / window)))
    pieces = tokens.withColumn("k", cut).select(
        "doc_id", "rk", (F.col("k") * window).alias("doc_offset"),
        F.least(F.lit(window).cast("bigint"), F.col("tokens") - F.col("k") * window).alias("n_tokens")
    )
    pieces = scratch.write(pieces)
    ranged = scratch.write(
        pieces.repartitionByRange(
            "n_tokens", F.col("doc_id").asc_nulls_last(), "rk", "doc_offset"
        ).sortWithinPartitions(
            "n_tokens", F.col("doc_id").asc_nulls_last(), "rk", "doc_offset"
        ).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    )
    scratch.drop(pieces)
    # a partition holds a range of lengths: in all at most partitions + window rows
    counts = sorted(
        (r["part"], r["n_tokens"], r["n"], r["low"])
        for r in ranged.groupBy("part", "n_tokens").agg(F.count("*").alias("n"), F.min("row").alias("low")).collect()
    )
    histogram: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for part, length, n, low in counts:
        base[part, length] = histogram.get(length, 0) - low
        histogram[length] = histogram.get(length, 0) + n
    sent = spark.sparkContext.broadcast((best_fit(histogram, window), base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, base = sent.value
        for b in batches:
            if not len(b):
                continue
            part, length, row = (np.asarray(b.column(i)) for i in (2, 3, 4))
            pair, inverse = np.unique(np.stack([part, length]), axis=1, return_inverse=True)
            rank = row + np.array([base[p, n] for p, n in pair.T.tolist()], np.int64)[inverse.reshape(-1)]
            where, at = place(plan, length, rank)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where), pa.array(at), b.column(0), b.column(1), b.column(3)],
                ["window_id", "window_offset", "doc_id", "doc_offset", "n_tokens"]
            )

    cols = ranged.select("doc_id", "doc_offset", F.col("part").cast("bigint").alias("part"), "n_tokens", "row")
    return cols.transform(T.batched, run, f"window_id bigint, window_offset bigint, doc_id {kind}, doc_offset bigint, n_tokens bigint")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
