"""Line dedup: the first occurrence of each line over the whole corpus stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .store import read, row_key


#: Hashes of lines that several rows of a task's batches had, which it remembers with the first place of each.
HOT = 100_000


def _hashed(docs: DataFrame) -> DataFrame:
    """(h, doc_id, rk, pos, n_lines, known): a row for each line that may be the first of its kind, and one for each document.

    A document's own row has ``n_lines`` and in ``known`` the positions of lines that an earlier row of the same task surely
    has; its h is that of its place. Blank lines have no row. So the commonest line of the corpus has about one row a task and not one
    a document: of the rows of a batch that have a line only the first in the order of (doc_id, rk, pos) is sent, and the task remembers
    the lines that were met more than once in a batch, to send none that comes after.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_key(F.col("text")).alias("rk"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: dict[int, tuple] = {}  # the first place so far of a line that is met often
        for b in batches:
            if not len(b):
                continue
            # rows in the order of the corpus: doc_id, nulls last, then rk
            order = pa.compute.sort_indices(
                pa.table({"a": b.column(0), "b": b.column(1)}), sort_keys=[("a", "ascending"), ("b", "ascending")], null_placement="at_end"
            )
            b = b.take(order)
            for first, data, offs in T.chunks(b.column(2)):
                yield _lines_of(
                    b.column(0).slice(first, len(offs) - 1), np.asarray(b.column(1).slice(first, len(offs) - 1)), data, offs, hot
                )

    return rows.transform(T.batched, run, f"h bigint, doc_id {kind}, rk bigint, pos int, n_lines bigint, known array<int>")


def _lines_of(ids: pa.Array, rk: np.ndarray, data: np.ndarray, offs: np.ndarray, hot: dict[int, tuple]) -> pa.RecordBatch:
    """``_hashed`` of rows in the order of the corpus. Lines are the gaps between newlines and row ends: an empty one has no bytes."""
    n = len(offs) - 1
    nl = np.flatnonzero(data == 10)
    per = np.searchsorted(nl, offs)
    count = np.diff(per) + 1
    bounds = np.concatenate([[0], np.cumsum(count)])
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    row = np.repeat(np.arange(n), count)
    head, tail = np.zeros(bounds[-1], bool), np.zeros(bounds[-1], bool)
    head[bounds[:-1]], tail[bounds[1:] - 1] = True, True
    starts[head], starts[~head] = offs[:-1], nl + 1
    ends[tail], ends[~tail] = offs[1:], nl
    pos = np.arange(bounds[-1]) - bounds[row]
    inked = np.concatenate([[0], np.cumsum(~T.SPACE[data])])
    at = np.flatnonzero(inked[starts] != inked[ends])
    h = T.hash_runs(data, starts[at], ends[at])
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    heads = np.flatnonzero(new)
    first, size = order[heads], np.diff(np.append(heads, len(h)))  # of each hash
    again = np.ones(len(h), bool)
    again[first] = False
    place = lambda k: (not ids[row[k]].is_valid, ids[row[k]].as_py() if ids[row[k]].is_valid else 0, int(rk[row[k]]), int(pos[k]))
    for k, x in zip(first.tolist(), h[first].tolist()) if hot else ():
        if x in hot:
            here = place(at[k])
            if hot[x] < here:
                again[k] = True
            else:
                hot[x] = here
    for k in first[size > 1].tolist():
        if len(hot) < HOT and int(h[k]) not in hot:
            hot[int(h[k])] = place(at[k])
    sent = ~again
    gone = at[again]
    known = pa.ListArray.from_arrays(pa.array(np.searchsorted(gone, bounds).astype(np.int32)), pa.array(pos[gone].astype(np.int32)))
    own = T.mix(T.mix(rk.view(np.uint64)) + (offs[1:] * 31 + np.arange(n)).astype(np.uint64))
    lines = at[sent]
    null = lambda kind, size: pa.nulls(size, kind)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([h[sent], own]).view(np.int64)), pa.concat_arrays([ids.take(pa.array(row[lines])), ids]),
            pa.array(np.concatenate([rk[row[lines]], rk])),
            pa.concat_arrays([pa.array(pos[lines].astype(np.int32)), null(pa.int32(), n)]),
            pa.concat_arrays([null(pa.int64(), len(lines)), pa.array(count.astype(np.int64))]),
            pa.concat_arrays([null(known.type, len(lines)), known]),
        ],
        ["h", "doc_id", "rk", "pos", "n_lines", "known"],
    )


def decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, n_lines, dropped): the sorted positions of the lines to drop of each document, a row each.

    Hashes are uniform, so that their ranges are known without a sample: equal parts of the 64 bits, one a partition. These
    are sorted by (hash, document, position), and a streaming window sees first occurrences. Only the lines that go, and the
    documents' own rows, are shuffled once more.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor((F.shiftrightunsigned("h", 33)) * parts / F.lit(1 << 31)).cast("int")
    lines = _hashed(docs).withColumn("part", part).repartitionById(parts, F.col("part"))
    order = Window.partitionBy("part", "h").orderBy(F.col("doc_id").asc_nulls_last(), "rk", "pos")
    seen = lines.withColumn("k", F.row_number().over(order)).where("n_lines IS NOT NULL OR k > 1")
    per = seen.groupBy("doc_id", "rk").agg(
        F.max("n_lines").alias("n_lines"), F.count("n_lines").alias("copies"),
        F.array_sort(
            F.concat(F.flatten(F.collect_list("known")), F.collect_list(F.when(F.col("n_lines").isNull(), F.col("pos"))))
        ).alias("d")
    )
    # equal rows fall into one group here: a line of theirs goes only if each copy's goes
    true = F.filter(F.array_distinct("d"), lambda x: F.size(F.filter("d", lambda y: y == x)) == F.col("copies"))
    return per.select("doc_id", "rk", "n_lines", F.when(F.col("copies") == 1, F.col("d")).otherwise(true).alias("dropped"))


def bitmap(n_lines: str, dropped: str) -> F.Column:
    """The keep bitmap as run lengths, '2,1,3': keep 2, drop 1, keep 3; the first run may be 0."""
    pair = lambda a: F.when(a["gone"] > 0, F.concat_ws(",", a["kept"].cast("string"), a["gone"].cast("string")))
    state = lambda end, kept, gone, out: F.struct(end.alias("end"), kept.alias("kept"), gone.alias("gone"), out.alias("out"))
    step = lambda a, p: F.when(p == a["end"], state(p + 1, a["kept"], a["gone"] + 1, a["out"])).otherwise(
        state(p + 1, p - a["end"], F.lit(1), F.when(a["gone"] > 0, F.concat(a["out"], pair(a), F.lit(","))).otherwise(a["out"]))
    )
    start = state(F.lit(0), F.lit(0), F.lit(0), F.lit(""))
    close = lambda a, n: F.concat_ws(",", F.concat(a["out"], pair(a)), F.when((n > a["end"]), (n - a["end"]).cast("string")))
    n = F.col(n_lines)
    return F.aggregate(F.col(dropped), start, step, lambda a: close(a, n))


def line_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_kept, keep_runs) of each document: which of its lines to keep, as a run-length bitmap.

    A line is kept where it is the first of the corpus in the order of (doc_id, position in the document); lines are
    compared by a 64-bit hash of their bytes, and are what ``\\n`` separates. Lines of white space alone are always kept.
    ``keep_runs`` holds alternating lengths of kept and dropped runs from a kept one on: '2,1,3' keeps 2, drops 1, keeps 3;
    it starts with 0 where the first line goes.

    Defined cases: rows with a null text have no lines and no result row; an empty text has one blank line; lines and texts of
    any length are hashed whole; a null doc_id comes after all others; of rows with one doc_id, each text is a document of its own
    (ordered by a hash of the text), and fully equal rows are one document; other columns are ignored; an empty table gives an
    empty result. Two shuffles: one row of about 30 bytes for each line that a batch has first, then one for each line that goes
    and each document; no text is shuffled, and a line that all documents have has about one row a task.
    """
    return decisions(docs).select(
        "doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), bitmap("n_lines", "dropped").alias("keep_runs")
    )


def first_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with only the first occurrence of each line, and ``n_chars``, if there, of the new text.

    Defined cases: a document whose lines with ink all go is dropped, as is all but one of rows that are equal in doc_id and
    text; a null text stays as it is, a text without ink too; a null doc_id comes after all others; texts of any length are cut line
    by line; other columns pass through, whatever their names; an empty table gives an empty one.
    """
    # a row goes along as one column beside its text, so that its names can't clash with those here; one hash of (doc_id, text) is the only
    # key of the exchange, which thus serves the join and the window; what it stands for is compared by inequalities, so that
    # it doesn't become part of the key
    cut = decisions(docs).where(F.size("dropped") > 0).select(
        F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"), bitmap("n_lines", "dropped").alias("_runs")
    ).select("*", F.xxhash64("_id", "_rk").alias("_place"))
    keyed = docs.select(
        F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns if c != "text")).alias("row"), docs["doc_id"].alias("id"),
        docs["text"].cast("string").alias("text"), row_key(docs["text"].cast("string")).alias("key")
    ).withColumn("at", F.xxhash64("id", "key"))
    alike = lambda x, y: (F.col(x) >= F.col(y)) & (F.col(x) <= F.col(y))
    one = F.coalesce(alike("id", "_id"), F.col("id").isNull() & F.col("_id").isNull())
    joined = keyed.join(cut, (F.col("at") == F.col("_place")) & one & alike("key", "_rk"), "left")
    copy = F.row_number().over(Window.partitionBy("at", "id", "key").orderBy("key"))
    bits = F.flatten(F.transform(F.split("_runs", ","), lambda r, i: F.array_repeat(i % 2 == 0, r.cast("int"))))
    kept = F.array_join(
        F.transform(
            F.filter(F.arrays_zip(F.split("text", "\n", -1).alias("line"), bits.alias("bit")), lambda z: z["bit"]), lambda z: z["line"]
        ),
        "\n"
    )
    out = joined.withColumn("copy", F.when(F.col("text").isNull(), 1).otherwise(copy)).where("copy = 1").withColumn(
        "text", F.when(F.col("_runs").isNull(), F.col("text")).otherwise(kept)
    )
    out = out.where(F.col("_runs").isNull() | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(
            F.col("_runs").isNull(), F.col("row.n_chars")
        ).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_bitmaps(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT doc_id, pos, NOT regexp_matches(line, '[^ \t\n\x0B\f\r]') OR row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1 AS keep FROM l),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, keep ORDER BY pos) AS run FROM k),
r AS (SELECT doc_id, keep, min(pos) AS p0, count(*) AS n FROM g GROUP BY doc_id, keep, run)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN keep THEN n ELSE 0 END) AS BIGINT) AS n_kept,
  CASE WHEN first(keep ORDER BY p0) THEN '' ELSE '0,' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY p0) AS keep_runs
FROM r GROUP BY doc_id"""
