"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textops as T
from .store import read

#: Words of the windows that count; a shorter item counts as a whole.
WINDOW = 13
#: Words of the blocks of items that the automaton knows. Blocks begin every ``WINDOW - BLOCK + 1`` words, so that each window holds one.
BLOCK = 5
#: Characters of normalised items in one automaton, of which a node of some 40 bytes for every second one: half a GB at most.
#: A larger benchmark is searched by several, each in a scan of its own.
AUTOMATON_CHARS = 20_000_000
_GAP = re.compile(r"[\W_]+")
_BUILT: dict[int, tuple[object, Items]] = {}


def _lower(text: str) -> str:
    return text.lower().replace("ς", "σ")  # the only lower case that depends on the place in the word


def normal(text: str) -> str:
    """Lower case, with one space for each run of other than letters and digits, and one at either end."""
    return f" {_GAP.sub(' ', _lower(text)).strip()} "


def origins(text: str) -> tuple[str, list[int]]:
    """``normal(text)`` and the index in ``text`` that each of its characters is from."""
    low, at = [], []
    for i, c in enumerate(text):
        x = _lower(c)
        low.append(x)
        at += [i] * len(x)
    s = "".join(low)
    out, where, last = [" "], [0], 0
    for m in _GAP.finditer(s):
        out.append(s[last : m.start()])
        where += at[last : m.start()]
        if m.start() and m.end() < len(s):
            out.append(" ")
            where.append(at[m.start()])
        last = m.end()
    out.append(s[last:])
    where += at[last:]
    return "".join(out) + " ", [*where, len(text)]


class Items:
    """Normalised items, and one automaton of their blocks."""

    def __init__(self, items: list[tuple], window: int, block: int = BLOCK):
        block = min(block, window)
        self.window, self.names, self.texts = window, [], []
        self.places: list[list[tuple[int, int]]] = []  # of each block: (item, offset in its text)
        self.sizes: list[int] = []
        numbers: dict[str, int] = {}
        for name, text in items:
            words = normal(text).split()
            if not words:
                continue
            at, starts = 0, []
            for w in words:
                starts.append(at)
                at += len(w) + 1
            for k in range(0, len(words) - block + 1, window - block + 1) if len(words) >= window else (0,):
                pattern = f" {' '.join(words[k : k + block])} "
                i = numbers.setdefault(pattern, len(numbers))
                if i == len(self.places):
                    self.places.append([])
                    self.sizes.append(len(pattern))
                self.places[i].append((len(self.names), starts[k]))
            self.names.append(name)
            self.texts.append(f" {' '.join(words)} ")
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for pattern, i in numbers.items():
            self.automaton.add_word(pattern, i)
        self.automaton.make_automaton()

    def passages(self, norm: str) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the longest common runs of words of an item and a normalised text that hold a window, without the blanks around.

        Each block that the automaton meets is extended to both sides; one that an earlier run covers already is left out.
        """
        if not len(self.automaton):
            return
        done: dict[tuple[int, int], int] = {}
        for last, i in self.automaton.iter(norm):
            start = last + 1 - self.sizes[i]
            for item, at in self.places[i]:
                lane = (item, start - at)
                if start < done.get(lane, 0):
                    continue
                text = self.texts[item]
                a, z = _extend(text, norm, at, start, self.sizes[i])
                done[lane] = z + start - at
                if (a == 0 and z == len(text)) or text.count(" ", a, z - 1) >= self.window:
                    yield item, a + start - at + 1, z + start - at - 1

    def spans(self, text: str) -> list[tuple]:
        """(name, start, end) of the merged passages of each item in a text, in characters of the original."""
        hits = [*self.passages(normal(text))]
        if not hits:
            return []
        _, at = origins(text)
        out: dict = {}
        for item, a, b in sorted(hits, key=lambda h: (h[1], h[2])):
            got = out.setdefault(self.names[item], [])
            if got and a <= got[-1][1]:
                got[-1][1] = max(got[-1][1], b)
            else:
                got.append([a, b])
        return [(name, at[a], at[b - 1] + 1) for name, got in out.items() for a, b in got]


def _extend(text: str, norm: str, at: int, start: int, size: int) -> tuple[int, int]:
    """(start, end) in ``text`` of the longest run of whole words around ``size`` characters at ``at`` that ``norm`` has at ``start``."""
    a, d, step = at, start - at, 64
    low, high = max(0, -d), min(len(text), len(norm) - d)
    while a - step >= low and text[a - step : a] == norm[a + d - step : a + d]:
        a -= step
    while a > low and text[a - 1] == norm[a + d - 1]:
        a -= 1
    a = text.index(" ", a)
    z = at + size
    while z + step <= high and text[z : z + step] == norm[z + d : z + d + step]:
        z += step
    while z < high and text[z] == norm[z + d]:
        z += 1
    return a, text.rindex(" ", 0, z) + 1


def _groups(benchmark: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """The distinct items in groups of about ``limit`` characters, one group at a time; one, empty, without items."""
    group: list[tuple] = []
    held = 0
    rows = benchmark.select(
        "item_id", F.col("text").cast("string").alias("text")
    ).where("text IS NOT NULL").distinct().orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        if held and held + len(text) > limit:
            yield group
            group, held = [], 0
        group.append((item, text))
        held += len(text)
    yield group


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end) of each passage of a benchmark item in a document, in characters of the original text.

    Items and texts are normalised to lower-case words of letters and digits; a passage is a maximal run of overlapping
    matches of windows of ``window`` words of one item, or of the whole item if it is shorter. One Aho-Corasick automaton
    holds blocks of ``BLOCK`` words of the items, so spaced that each window has one whole; the blocks that one scan of a text meets
    are extended word by word.

    Defined cases: null texts and texts or items without a word match nothing; a null doc_id or item_id is returned as
    null; equal items are each reported, and of several items with one item_id the passages are merged; repeated rows each
    get their rows; texts of any length are scanned whole; other columns are ignored; empty tables give an empty result. A
    benchmark of over ``limit`` characters is searched in several scans, one for each so many; no item is left out.
    One narrow pass over the documents.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    item_type = to_arrow_type(item_kind)
    texts = docs.select("doc_id", docs["text"].cast("string").alias("text")).where("text IS NOT NULL")
    out = None
    for group in _groups(benchmark, limit):
        sent = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = _items_of(sent, window)
            for b in batches:
                ids, items, starts, ends = [], [], [], []
                for row, text in enumerate(b.column(1)):
                    for item, a, z in held.spans(text.as_py()):
                        ids.append(row)
                        items.append(item)
                        starts.append(a)
                        ends.append(z)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(ids, pa.int64())), pa.array(items, item_type), pa.array(starts, pa.int64()),
                        pa.array(ends, pa.int64())
                    ],
                    ["doc_id", "item_id", "start", "end"]
                )

        part = texts.transform(T.batched, run, f"doc_id {kind}, item_id {item_kind.simpleString()}, start bigint, end bigint")
        out = part if out is None else out.union(part)
    return out


def _items_of(sent, window: int) -> Items:
    """Built once in a Python worker for each broadcast, which is held beside it so that its number isn't used again."""
    key = id(sent.value)
    if key not in _BUILT or _BUILT[key][1].window != window:
        _BUILT.clear()
        _BUILT[key] = (sent.value, Items(sent.value, window))
    return _BUILT[key][1]


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, in which ``contaminated`` finds nothing. No shuffle.

    Defined cases: null and empty texts stay, whatever the doc_id; repeated rows stay or go alike; texts of any length are
    scanned whole; other columns pass through, whatever their names; an empty table, or a benchmark without a word, leaves
    all as it is.
    """
    spark, where, out = docs.sparkSession, docs.columns.index("text"), docs
    for group in _groups(benchmark, limit):
        sent = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = _items_of(sent, window)
            for b in batches:
                ok = [not t.is_valid or next(held.passages(normal(t.as_py())), None) is None for t in b.column(where)]
                yield b.filter(pa.array(ok, pa.bool_()))

        out = out.transform(T.batched, run, docs.schema)
    return out


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Words are numbered in each text; all windows of items are looked up among the windows of texts of the same size.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS ws, regexp_extract_all(text, '[^\p{{L}}\p{{N}}]+') AS gs, NOT regexp_matches(text, '^[\p{{L}}\p{{N}}]') AS led FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, k, lower(ws[k]) AS word, length(ws[k]) AS size, coalesce(length(gs[CASE WHEN led THEN k ELSE k - 1 END]), 0) AS gap FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM d) q),
w AS (SELECT doc_id, k, word, size, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY k) - size AS at FROM u),
b AS (SELECT DISTINCT item_id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x)) AS ws FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, n, array_to_string(ws[k + 1:k + n], ' ') AS gram FROM (SELECT *, unnest(range(0, len(ws) - n + 1)) AS k FROM (SELECT item_id, ws, least({WINDOW}, len(ws)) AS n FROM b) p WHERE n > 0) q),
l AS (SELECT doc_id, list(word ORDER BY k) AS ws FROM w GROUP BY doc_id),
t AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS gram FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM l CROSS JOIN (SELECT DISTINCT n FROM g) s WHERE n <= len(ws)) q),
m AS (SELECT DISTINCT t.doc_id, g.item_id, t.k AS a, t.k + t.n - 1 AS z FROM t JOIN g ON g.n = t.n AND g.gram = t.gram),
o AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY doc_id, item_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM m),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY a, z) AS run FROM o),
p AS (SELECT doc_id, item_id, min(a) AS a, max(z) AS z FROM r GROUP BY doc_id, item_id, run)
SELECT p.doc_id, p.item_id, CAST(x.at AS BIGINT) AS start, CAST(y.at + y.size AS BIGINT) AS "end" FROM p JOIN w x ON x.doc_id = p.doc_id AND x.k = p.a JOIN w y ON y.doc_id = p.doc_id AND y.k = p.z"""
