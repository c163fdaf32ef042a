"""Quality rules: how much of a document lies inside duplicated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textops as T
from .store import read

#: Largest share of characters that the most frequent n-gram may hold.
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share of characters inside second and later occurrences of n-grams.
DUP = {5: 0.20, 6: 0.20, 7: 0.20, 8: 0.20, 9: 0.20, 10: 0.20}
#: Largest share of characters inside second and later occurrences of lines.
LINE = 0.25


def _top_and_dup(h: np.ndarray, bounds: np.ndarray, size: np.ndarray, total: np.ndarray) -> dict[str, np.ndarray]:
    n_rows = len(bounds) - 1
    row = T.rows_of(bounds)
    salt = T.mix(np.arange(n_rows, dtype=np.uint64) + np.uint64(0x51ED270B))
    upto = np.concatenate([[0], np.cumsum(size)])
    out: dict[str, np.ndarray] = {}
    at = None
    base = h.copy()
    for n in range(2, max(DUP) + 1):
        # positions whose (n - 1)-gram occurs once can't start a repeated n-gram
        at = T.inside(bounds, n) if at is None else at[at + n <= bounds[1:][row[at]]]
        base = base[: max(0, len(h) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :]
        key = T.mix(base[at]) ^ salt[row[at]]
        order = np.argsort(key)
        s = key[order]
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(s)))
        many = count > 1
        member = np.repeat(many, count)
        if n in TOP:
            lead = at[order[edge[many]]]
            best = np.zeros(n_rows, np.int64)
            np.maximum.at(best, row[lead], count[many] * (upto[lead + n] - upto[lead]))
            out[f"top_{n}gram"] = best / total
        if n in DUP:
            first = np.minimum.reduceat(order, edge)[many] if len(edge) else edge
            later = np.zeros(len(at), bool)
            later[order[member]] = True
            later[first] = False
            p = at[later]
            cover = np.zeros(len(h) + 1, np.int64)
            np.add.at(cover, p, 1)
            np.add.at(cover, p + n, -1)
            inside = np.cumsum(cover[:-1]) > 0
            held = np.concatenate([[0], np.cumsum(size * inside)])
            out[f"dup_{n}gram"] = (held[bounds[1:]] - held[bounds[:-1]]) / total
        keep = np.zeros(len(at), bool)
        keep[order[member]] = True
        at = at[keep]
    return out


def _lines(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Share of the characters of non-empty lines that lie in repetitions of an earlier line."""
    s, e = T.runs(data != 10, offs)
    bounds = T.by_row(s, offs)
    row, size = T.rows_of(bounds), e - s
    key = T.hash_runs(data, s, e) ^ T.mix(np.arange(len(offs) - 1, dtype=np.uint64) + np.uint64(0x7F4A7C15))[row]
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    if len(key):
        k = key[order]
        again[order[1:]] = k[1:] == k[:-1]
    total = np.add.reduceat(np.append(size, 0), bounds[:-1]) * (np.diff(bounds) > 0) if len(bounds) > 1 else np.zeros(0)
    held = np.concatenate([[0], np.cumsum(size * again)])
    return (held[bounds[1:]] - held[bounds[:-1]]) / np.maximum(total, 1)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All rules of each text; sizes are UTF-8 bytes, words are runs without ASCII white space."""
    parts: list[dict[str, np.ndarray]] = []
    for _, data, offs in T.chunks(texts):
        s, e, bounds = T.words(data, offs, ~T.SPACE)
        size = e - s
        held = np.concatenate([[0], np.cumsum(size)])
        total = np.maximum(held[bounds[1:]] - held[bounds[:-1]], 1)
        part = {"n_words": np.diff(bounds)}
        part |= _top_and_dup(T.hash_runs(data, s, e), bounds, size, total)
        part["dup_line"] = _lines(data, offs)
        parts.append(part)
    names = ["n_words", *(f"top_{n}gram" for n in TOP), *(f"dup_{n}gram" for n in DUP), "dup_line"]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in names}


def verdict(m: dict[str, np.ndarray], top: dict[int, float], dup: dict[int, float], line: float) -> np.ndarray:
    keep = (m["n_words"] > 0) & (m["dup_line"] <= line)
    for n, most in top.items():
        keep &= m[f"top_{n}gram"] <= most
    for n, most in dup.items():
        keep &= m[f"dup_{n}gram"] <= most
    return keep


def repetition_coverage(docs: DataFrame, top: dict[int, float] = TOP, dup: dict[int, float] = DUP, line: float = LINE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the rules' values, and ``keep``.

    Word n-grams are compared by a rolling 64-bit hash, each length only where the next shorter n-gram repeats.
    ``top_N gram``: share of characters in the most frequent N-gram that occurs at least twice (occurrences times length).
    ``dup_N gram`` and ``dup_line``: share of characters inside second and later occurrences, each character once.
    A document is kept if it has a word and no rule exceeds its threshold.

    Defined cases: a null or empty text has 0 words, all shares 0 and keep = false; texts of any length are measured whole; of
    equally frequent n-grams the one that holds most counts; a null doc_id is returned as null; repeated rows each get a row; other columns of ``docs`` are ignored; an empty table gives an empty result.
    One narrow pass: no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [*(f"top_{n}gram" for n in TOP), *(f"dup_{n}gram" for n in DUP), "dup_line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure(b.column(1))
            cols = [
                b.column(0), pa.array(m["n_words"].astype(np.int64)), *(pa.array(m[k].astype(float)) for k in names),
                pa.array(verdict(m, top, dup, line).astype(bool))
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", *names, "keep"])

    schema = f"doc_id {kind}, n_words bigint, {', '.join(f'{k} double' for k in names)}, keep boolean"
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).transform(T.batched, run, schema)


def keep_good(docs: DataFrame, top: dict[int, float] = TOP, dup: dict[int, float] = DUP, line: float = LINE) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that ``repetition_coverage`` keeps.

    Defined cases: null and empty texts and those without a word go; texts of any length are measured whole; a null doc_id
    changes nothing; repeated rows stay or go alike; other columns pass through, whatever their names; an empty table gives an
    empty one.
    """
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(verdict(measure(b.column(where)), top, dup, line).astype(bool)))

    return docs.transform(T.batched, run, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_coverage(read(spark, sf_dir, "documents"))


def _sql() -> str:
    grams = "".join(
        f""",
g{n} AS (SELECT doc_id, i, list_aggregate(words[i:i + {n - 1}], 'string_agg', ' ') AS gram, strlen(list_aggregate(words[i:i + {n - 1}], 'string_agg', '')) AS size
  FROM pos WHERE i + {n - 1} <= len(words))"""
        for n in [*TOP, *DUP]
    )
    tops = "".join(f""",
t{n} AS (SELECT doc_id, max(z) AS z FROM (SELECT doc_id, count(*) * max(size) AS z FROM g{n} GROUP BY doc_id, gram HAVING count(*) > 1) GROUP BY doc_id)""" for n in TOP)
    dups = "".join(f""",
r{n} AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) AS k FROM g{n}) WHERE k > 1),
d{n} AS (SELECT doc_id, sum(strlen(words[i])) AS z FROM (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(i, i + {n})) AS i FROM r{n})) JOIN w USING (doc_id) GROUP BY doc_id)""" for n in DUP)
    total = "greatest(coalesce(list_sum(list_transform(words, lambda x: strlen(x))), 0), 1)"
    shares = {
        **{f"top_{n}gram": f"coalesce(t{n}.z, 0) / {total}" for n in TOP},
        **{f"dup_{n}gram": f"coalesce(d{n}.z, 0) / {total}" for n in DUP}, "dup_line": "coalesce(l.z, 0)"
    }
    keep = " AND ".join(
        [
            "n_words > 0", *(f"top_{n}gram <= {v}" for n, v in TOP.items()), *(f"dup_{n}gram <= {v}" for n, v in DUP.items()),
            f"dup_line <= {LINE}"
        ]
    )
    return f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w){grams}{tops}{dups},
l AS (SELECT doc_id, sum(CASE WHEN k > 1 THEN strlen(line) ELSE 0 END) / sum(strlen(line)) AS z
  FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE line <> '') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, {", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in shares.items())}
  FROM w LEFT JOIN l USING (doc_id) {" ".join(f"LEFT JOIN t{n} USING (doc_id)" for n in TOP)} {" ".join(f"LEFT JOIN d{n} USING (doc_id)" for n in DUP)})
SELECT *, {keep} AS keep FROM m"""


ORACLE_SQL = _sql()
