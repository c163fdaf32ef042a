"""Quality rules, line dedup, near dedup, decontamination and packing against brute-force versions and edge cases."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from draftlake.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules, textops
from draftlake.llm.store import row_key

SCHEMA = "doc_id bigint, text string, lang string, h bigint, pos int, g string, n_chars bigint"
ODD = [
    (1, "a b c\na b c\n\nd", "en", 1, 2, "x", 9), (2, "", "en", 1, 2, "x", 0), (3, None, None, None, None, None, None),
    (None, "a b c\nz", "en", 1, 2, "x", 7),
    (None, None, "en", 1, 2, "x", 7), (4, "word " * 60_000, "en", 1, 2, "x", 300_000), (5, "q" * 300_000, "en", 1, 2, "x", 300_000),
    (6, "same row", "en", 1, 2, "x", 8), (6, "same row", "en", 1, 2, "x", 8), (6, "other text", "en", 1, 2, "x", 10),
    (7, " \t\n \n", "en", 1, 2, "x", 5), (8, "é ß ñ\n\0x", "fr", 1, 2, "x", 8),
]


@pytest.fixture
def odd(spark):
    clash = (
        "_id", "_rk", "_runs", "row", "key", "at", "id", "rk", "bands", "whole", "rep", "group_id", "gone_id", "keep", "grade", "n", "a",
        "b", "words", "tokens"
    )
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in clash})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def some_texts(n, seed, vocabulary=300):
    r = random.Random(seed)
    w = ["".join(r.choice("abcdeéf") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    return [" ".join(r.choice(w) for _ in range(r.randint(0, 120))) for _ in range(n)]


# text primitives


def test_runs_and_hashes_do_not_cross_rows():
    texts = ["ab cd", "", "ab", "  cd ab", None, "é"]
    parts = []
    for _, data, offs in textops.chunks(pa.array(texts), 6):
        s, e, b = textops.words(data, offs)
        h = textops.hash_runs(data, s, e)
        parts += [h[i:j].tolist() for i, j in zip(b[:-1], b[1:])]
    ab, cd = parts[0]
    assert parts[:5] == [[ab, cd], [], [ab], [cd, ab], []] and len(parts[5]) == 1


def test_ngrams_stay_inside_rows():
    items = np.array([1, 2, 3, 1, 2, 9], np.uint64)
    at = textops.inside(np.array([0, 3, 3, 6]), 2)
    g = textops.ngrams(items, 2)
    assert at.tolist() == [0, 1, 3, 4] and g[0] == g[3]


# quality rules


def slow_rules(text):
    words = re.findall(r"[^ \t\n\x0b\f\r]+", text or "")
    size = [len(w.encode()) for w in words]
    total = max(sum(size), 1)
    out = {"n_words": len(words)}
    for n in range(2, 11):
        seen, first, covered = Counter(), {}, set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            seen[g] += 1
            if seen[g] > 1:
                covered |= set(range(i, i + n))
        if n in quality_rules.TOP:
            out[f"top_{n}gram"] = max([0, *(c * sum(len(w.encode()) for w in g) for g, c in seen.items() if c > 1)]) / total
        else:
            out[f"dup_{n}gram"] = sum(size[i] for i in covered) / total
    lines = [x for x in (text or "").split("\n") if x]
    again = sum(len(x.encode()) for i, x in enumerate(lines) if x in lines[:i])
    out["dup_line"] = again / max(1, sum(len(x.encode()) for x in lines))
    return out


def test_quality_rules_equal_brute_force():
    texts = some_texts(40, 1, 12) + ["a a a a a a a a a a a a", "x y\nx y\nz", "", None]
    got = quality_rules.measure(pa.array(texts))
    for i, t in enumerate(texts):
        for k, v in slow_rules(t).items():
            assert got[k][i] == pytest.approx(v), (t, k)


def test_quality_rules_on_odd_rows(odd, none):
    rows = quality_rules.repetition_coverage(odd).collect()
    assert len(rows) == len(ODD)
    keep = {r.doc_id: r.keep for r in rows if r.doc_id in (2, 3, 4, 7, 8)}
    assert keep == {2: False, 3: False, 4: False, 7: False, 8: True}
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.keep for r in rows)
    assert quality_rules.repetition_coverage(none).count() == 0


# line dedup


def runs_to_bits(s):
    out = []
    for i, n in enumerate(s.split(",")):
        out += [i % 2 == 0] * int(n)
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(5)
    lines = ["", " ", *(f"line {i}" for i in range(30))]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 12)))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    seen, want = set(), {}
    for i, t in docs:
        want[i] = []
        for x in t.split("\n"):
            want[i].append(not x.strip() or x not in seen)
            seen.add(x)
    got = {r.doc_id: r for r in line_dedup.line_bitmaps(df).collect()}
    assert {i: runs_to_bits(r.keep_runs) for i, r in got.items()} == want
    assert all(r.n_kept == sum(want[i]) and r.n_lines == len(want[i]) for i, r in got.items())
    text = {r.doc_id: r.text for r in line_dedup.first_lines(df).collect()}
    for i, t in docs:
        left = "\n".join(x for x, k in zip(t.split("\n"), want[i]) if k)
        assert text.get(i) == (left if all(want[i]) or left.strip() else None)


@pytest.mark.parametrize("hot", [0, 3, 100_000])
def test_line_dedup_over_many_batches(spark, monkeypatch, hot):
    """Batches of few rows out of order, with repeated rows: the task's memory of hot lines changes nothing."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(hot)
    lines = [f"line {i}" for i in range(9)] + ["", "\t"]
    docs = [(r.choice([None, *range(60)]), "\n".join(r.choice(lines) for _ in range(r.randint(0, 9)))) for _ in range(120)]
    docs += docs[:20]
    r.shuffle(docs)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(2)
        rk = {x.text: x.k for x in df.select("text", row_key(F.col("text")).alias("k")).collect()}
        got = Counter((x.doc_id, x.n_lines, x.keep_runs) for x in line_dedup.line_bitmaps(df).collect())
    finally:
        spark.conf.set(key, old)
    seen, want = set(), Counter()
    for i, t in sorted({*docs}, key=lambda x: (x[0] is None, x[0] or 0, rk[x[1]])):
        bits = []
        for x in t.split("\n"):
            bits.append(not x.strip() or x not in seen)
            seen.add(x)
        want[i, tuple(bits)] += 1
    assert Counter((i, tuple(runs_to_bits(k))) for i, _, k in got.elements()) == want


def test_line_dedup_on_odd_rows(odd, none):
    rows = [(r.doc_id, r.n_lines, r.keep_runs) for r in line_dedup.line_bitmaps(odd).collect()]
    assert sorted(rows, key=str) == sorted(
        [(1, 4, "1,1,2"), (2, 1, "1"), (None, 2, "0,1,1"), (4, 1, "1"), (5, 1, "1"), (6, 1, "1"), (6, 1, "1"), (7, 3, "3"), (8, 2, "2")],
        key=str
    )
    out = line_dedup.first_lines(odd)
    assert out.columns == odd.columns
    texts = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    assert (1, "a b c\n\nd", 8) in texts and (None, "z", 1) in texts and (3, None, None) in texts and out.where("doc_id = 6").count() == 2
    assert line_dedup.line_bitmaps(none).count() == 0 and line_dedup.first_lines(none).count() == 0


def test_line_dedup_with_a_hot_line(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("hot\nhot").alias("text"))
    assert sorted(r.doc_id for r in line_dedup.line_bitmaps(df).where("n_kept > 0").collect()) == [0]


# near dedup


def shingle_set(text, n=near_dedup.NGRAM):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def slow_groups(docs, threshold=near_dedup.THRESHOLD):
    sets = {i: shingle_set(t) for i, t in docs if t and shingle_set(t)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return pairs, {i: find(i) for i in sets}


def near_docs(seed=3, base=12):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    docs, k = [], 0
    for _ in range(base):
        words = [r.choice(vocabulary) for _ in range(r.randint(30, 150))]
        for _ in range(r.randint(1, 9)):
            copy = [r.choice(vocabulary) if r.random() < r.choice([0, 0.02, 0.08]) else w for w in words]
            docs.append((k, " ".join(copy)))
            k += 1
    return docs


def test_near_dedup_equals_brute_force(spark):
    docs = near_docs()
    pairs, group = slow_groups(docs)
    got = {
        r.doc_id: r.group_id
        for r in near_dedup.near_groups(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    }
    found = sum(got.get(a, a) == got.get(b, b) for a, b in pairs)
    assert found >= 0.9 * len(pairs) > 0
    assert all(group[a] == group[g] for a, g in got.items())
    size = Counter(got.values())
    assert all(size[g] > 1 for g in got.values())


def test_circulant_signatures_estimate_jaccard():
    r = random.Random(0)
    a = [f"t{i}" for i in range(400)]
    b = a[:300] + [f"u{i}" for i in range(100)]
    col = pa.array([" ".join(a), " ".join(b)])
    ((_, data, offs),) = textops.chunks(col)
    grams, bounds, _ = near_dedup._shingles(data, offs, 3)
    sig = near_dedup.signature(grams, bounds, 2048)
    x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.05


def test_a_bucket_that_spans_groups_is_searched_in_full(spark):
    # with one row a band, documents that are no duplicates of the least member share its buckets
    r = random.Random(8)
    common = [f"c{i}" for i in range(40)]
    docs = []
    for g in range(4):
        own = [f"g{g}_{i}" for i in range(40)]
        for _ in range(4):
            docs.append((len(docs), " ".join(common + [w if r.random() > 0.02 else "x" for w in own])))
    _, want = slow_groups(docs)
    got = {
        r.doc_id: r.group_id for r in near_dedup.near_groups(spark.createDataFrame(docs, "doc_id bigint, text string"), rows=1).collect()
    }
    assert got == {i: g for i, g in want.items() if list(want.values()).count(g) > 1}


def test_components_of_a_long_chain(spark):
    from draftlake.llm.store import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r.doc_id: r.group_id for r in near_dedup.components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_near_dedup_on_odd_rows(spark, odd, none):
    more = odd.unionByName(
        spark.createDataFrame(
            [(9, "Same, ROW!", "en", 1, 2, "x", 9), (10, "...", "en", 1, 2, "x", 3), (11, "...", "en", 1, 2, "x", 3)], SCHEMA
        ),
        allowMissingColumns=True
    )
    assert sorted(tuple(r) for r in near_dedup.near_groups(more).collect()) == [(6, 6, True), (9, 6, False)]
    out = near_dedup.one_row_of_each(more)
    assert out.columns == more.columns and out.count() == more.count() - 2 and out.where("doc_id = 9").count() == 0 and out.where("doc_id = 6").count() == 2
    assert near_dedup.near_groups(none).count() == 0 and near_dedup.one_row_of_each(none).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_the_stream_of_buckets_equals_grouping(size):
    r = random.Random(size)
    rows = sorted({(r.randint(0, 25), r.randint(0, 30)) for _ in range(60)})
    batches = [
        pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[k : k + size]], pa.int64()) for i in (0, 1)], ["g", "doc_id"])
        for k in range(0, len(rows), size)
    ]
    group = defaultdict(list)
    for g, d in rows:
        group[g].append(d)
    got = [tuple(x.values()) for b in near_dedup._buckets(iter(batches)) for x in b.to_pylist()]
    assert got == [(g, d, group[g][0]) for g, d in rows if len(group[g]) > 1]


def test_the_near_stage_keeps_one_row_of_each_group(spark, tmp_path):
    base = [f"w{i}" for i in range(40)]
    near, other = " ".join([*base[:39], "x"]), " ".join(f"v{i}" for i in range(40))
    docs = [
        (6, "same row here"), (6, "same row here"), (9, "Same, ROW here!"), (6, "other text now"), (5, " ".join(base)), (5, near),
        (None, near), (None, " ".join(base)),
        (None, other), (None, other), (None, other.upper()), (None, "..."), (None, "..."), (None, None), (3, None), (3, None),
        (4, "alone in here"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    rows = Counter((r.doc_id, (r.text or "").lower()) for r in stage(spark, df, str(tmp_path)).collect())
    fives = [k for k in rows if k[0] == 5]
    assert len(fives) == 1 and rows.pop(fives[0]) == 1
    assert rows == {
        (6, "same row here"): 1, (6, "other text now"): 1, (None, other): 1, (None, "..."): 2, (None, ""): 1, (3, ""): 2,
        (4, "alone in here"): 1
    }


# decontamination


def test_decontamination_equals_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"Wörd{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([4, 13, 30])))) for i in range(20)]
    docs = []
    for i in range(80):
        words = [r.choice(vocabulary) for _ in range(100)]
        if i % 3 == 0:
            item = r.choice(items)[1].upper().split()
            a = r.randrange(max(1, len(item) - 13))
            words[10:12] = item[a : a + 20]
        docs.append((i, r.choice([" ", ", ", "\n— "]).join(words)))
    want = set()
    for i, t in docs:
        for j, q in items:
            qw, tw = decontaminate.normal(q).split(), decontaminate.normal(t).split()
            n = min(13, len(qw))
            grams = {tuple(qw[k : k + n]) for k in range(len(qw) - n + 1)}
            if any(tuple(tw[k : k + n]) in grams for k in range(len(tw) - n + 1)):
                want.add((i, j))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and want
    text, item = dict(docs), dict(items)
    for x in rows:
        assert decontaminate.normal(text[x.doc_id][x.start : x.end]).strip() in decontaminate.normal(item[x.item_id])
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, limit=300).collect()} == want
    assert {r.doc_id for r in decontaminate.uncontaminated(d, b).collect()} == set(text) - {i for i, _ in want}


def test_offsets_are_of_the_original_text():
    items = decontaminate.Items([(1, "straße ΟΔΟΣ i")], 13)
    text = "xx -- STRASSE\t Straße,, ΟΔΟΣ\n(j) i"
    assert items.spans(text) == []
    text = "xx -- Straße,, ΟΔΟΣ\n(i) x"
    assert [text[a:b] for _, a, b in items.spans(text)] == ["Straße,, ΟΔΟΣ\n(i"]
    for t in ("", "...", "a", " a", "İx Σ", "ΑΣ Σ"):
        assert decontaminate.origins(t)[0].strip() == decontaminate.normal(t).strip()


def slow_spans(items, text, window):
    """Every window of every item at every word of the text."""
    words = [(m.start(), m.end(), decontaminate._lower(m.group())) for m in re.finditer(r"[^\W_]+", text)]
    out = set()
    for name in {i for i, _ in items}:
        hits = []
        for i, q in items:
            qw = decontaminate.normal(q).split()
            n = min(window, len(qw))
            grams = {tuple(qw[k : k + n]) for k in range(len(qw) - n + 1)} if i == name and qw else ()
            hits += [(k, k + n) for k in range(len(words) - n + 1) if tuple(w for *_, w in words[k : k + n]) in grams]
        last = None
        for a, b in sorted(hits):
            if last and a < last[1]:
                last[1] = max(last[1], b)
            else:
                if last:
                    out.add((name, words[last[0]][0], words[last[1] - 1][1]))
                last = [a, b]
        if last:
            out.add((name, words[last[0]][0], words[last[1] - 1][1]))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_passages_equal_all_windows(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(r.choice([2, 3, 30]))]
    window, block = r.choice([(13, 5), (5, 2), (4, 4), (2, 1), (6, 1)])
    items = [(r.randint(0, 5), " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for _ in range(r.randint(1, 8))]
    held = decontaminate.Items(items, window, block)
    for _ in range(10):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 20))) for _ in range(3)]
        t = r.choice(items)[1].split()
        a = r.randint(0, len(t))
        text = r.choice([", ", " - "]).join([parts[0], " ".join(t[a : a + r.randint(0, 30)]).upper(), parts[1]])
        assert {*held.spans(text)} == slow_spans(items, text, window)


def test_a_large_benchmark_fits_a_worker():
    """5 million characters of items: the automaton holds about half of them, whose nodes have some 40 bytes each."""
    import subprocess
    import sys

    code = """
import random, resource
from draftlake.llm import decontaminate as d
r = random.Random(1)
words = [''.join(r.choice('abcdefghijklmnopqrst') for _ in range(r.randint(2, 9))) for _ in range(20000)]
items = [(i, ' '.join(r.choice(words) for _ in range(100))) for i in range(7700)]
assert sum(len(t) for _, t in items) > 4_900_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
held = d.Items(items, d.WINDOW)
assert [x[0] for x in held.spans(items[5000][1][200:400])] == [5000]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=str(Path(__file__).parents[2]))
    assert out.returncode == 0 and int(out.stdout) < 700, (out.stdout, out.stderr[-500:])


@pytest.mark.parametrize("kind, value", [("smallint", 7), ("int", 7), ("string", "q7"), ("decimal(10,0)", 7), ("date", None)])
def test_item_ids_of_any_type(spark, kind, value):
    from decimal import Decimal

    b = spark.createDataFrame(
        [(str(value) if value is not None else None, "same row")], "i string, text string"
    ).select(F.col("i").cast(kind).alias("item_id"), "text")
    (row,) = decontaminate.contaminated(spark.createDataFrame([(1, "the same row here")], "doc_id bigint, text string"), b).collect()
    assert row.item_id == (Decimal(7) if kind.startswith("dec") else value) and (row.start, row.end) == (4, 12)


def test_decontamination_on_odd_rows(spark, odd, none):
    b = spark.createDataFrame(
        [(1, "same ROW"), (2, None), (3, ""), (4, "!!"), (None, "other text"), (5, "same row")], "item_id bigint, text string"
    )
    got = sorted((r.doc_id, r.item_id or 0, r.start, r.end) for r in decontaminate.contaminated(odd, b).collect())
    assert got == [(6, 0, 0, 10), (6, 1, 0, 8), (6, 1, 0, 8), (6, 5, 0, 8), (6, 5, 0, 8)]
    left = decontaminate.uncontaminated(odd, b)
    assert left.columns == odd.columns and left.count() == len(ODD) - 3
    empty = b.where("false")
    assert decontaminate.contaminated(odd, empty).count() == 0 and decontaminate.uncontaminated(odd, empty).count() == len(ODD) and decontaminate.contaminated(none, b).count() == 0


# packing


def slow_best_fit(lengths, window):
    """Piece by piece: the open window with the least remaining room that fits; of equal ones that which got there first."""
    opened, clock, out = [], 0, []
    for n in sorted(lengths, reverse=True):
        clock += 1
        fits = [w for w in opened if w[0] >= n]
        w = min(fits, key=lambda w: (w[0], w[1])) if fits else None
        if w is None:
            w = [window, clock, len(opened)]
            opened.append(w)
        out.append((n, window - w[0]))
        w[0], w[1] = w[0] - n, clock
    return len(opened), sorted(w[0] for w in opened)


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_equals_piece_by_piece(seed):
    r = random.Random(seed)
    window = r.choice([7, 32, 100])
    lengths = [r.randint(1, window) if r.random() < 0.7 else r.randint(1, 3) for _ in range(r.randint(0, 300))]
    plan = packing.best_fit(dict(Counter(lengths)), window)
    length = np.array(sorted(lengths, reverse=True), np.int64)
    rank = np.array([k for n in sorted(set(lengths), reverse=True) for k in range(lengths.count(n))], np.int64)
    where, at = packing.place(plan, length, rank) if len(length) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    room = defaultdict(lambda: window)
    for w, a, n in sorted(zip(where.tolist(), at.tolist(), length.tolist())):
        assert a == window - room[w]
        room[w] -= n
    n, left = slow_best_fit(lengths, window)
    assert len(room) == n and sorted(room.values()) == left and min([0, *room.values()]) == 0


def test_segment_tree():
    r = random.Random(1)
    tree, have = packing.Tightest(50), set()
    for _ in range(500):
        c = r.randint(0, 50)
        tree.set(c, c not in have)
        have ^= {c}
        q = r.randint(0, 50)
        assert tree.least(q) == min((x for x in have if x >= q), default=-1)


def test_packing_covers_every_token_once(spark, odd, none):
    enc = packing.encoding(packing.vocabulary_of(spark, None))
    docs = [(i, t * (40 if i == 3 else 1)) for i, t in enumerate(some_texts(60, 4))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    rows = packing.packed(df, window=128).collect()
    room, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        room[r.window_id].append((r.window_offset, r.n_tokens))
        pieces[r.doc_id].append((r.doc_offset, r.n_tokens))
    for i, t in docs:
        n = len(enc.encode_ordinary(t)) + 1
        got = sorted(pieces[i])
        assert [a for a, _ in got] == list(range(0, n, 128)) and sum(k for _, k in got) == n
    assert sorted(room) == list(range(len(room)))
    for w in room.values():
        at = 0
        for a, n in sorted(w):
            assert a == at
            at += n
        assert at <= 128
    assert len(room) == slow_best_fit([r.n_tokens for r in rows], 128)[0]
    odd_rows = packing.packed(odd).collect()
    assert Counter(r.doc_id for r in odd_rows)[6] == 3 and (2, 1) in {
        (r.doc_id, r.n_tokens) for r in odd_rows
    } and 3 not in {r.doc_id for r in odd_rows}
    assert packing.packed(none).count() == 0


# the pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    docs = near_docs(9, 8)
    bench = [(0, " ".join(docs[3][1].split()[5:25]))]
    docs += [(1000 + i, " ".join(["junk word"] * 40)) for i in range(3)] + [(2000, docs[3][1] + "\nnew line here")]
    spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = [
        (i, t)
        for i, t in docs if (m := slow_rules(t)) and all(
            m[f"top_{n}gram"] <= v for n, v in quality_rules.TOP.items()
        ) and all(m[f"dup_{n}gram"] <= v for n, v in quality_rules.DUP.items())
    ]
    seen, left = set(), []
    for i, t in now:
        keep = [x for x in t.split("\n") if not (x in seen or seen.add(x))]
        if "".join(keep).strip():
            left.append((i, "\n".join(keep)))
    _, group = slow_groups(left)
    left = [(i, t) for i, t in left if group[i] == i]
    q = decontaminate.normal(bench[0][1]).split()
    grams = [" ".join(q[k : k + 13]) for k in range(len(q) - 12)]
    left = {i for i, t in left if not any(g in decontaminate.normal(t) for g in grams)}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == left and len(left) < len(now)


def test_pipeline_stages_keep_the_columns(spark, odd, none, tmp_path):
    """Each stage on what the one before kept, with null, empty, long and repeated rows and columns of clashing names."""
    spark.createDataFrame([(0, "x y z"), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (odd, odd.where("false"), none):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == start.columns and [k for _, k in docs.dtypes] == [k for _, k in start.dtypes], name
            docs.write.parquet(f"{tmp_path}/{name}{id(start)}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{id(start)}")
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert sorted({str(r.doc_id) for r in rows}) == ([] if start is not odd else ["5", "6", "8", "None"])
        if start is odd:  # the repeated row is there once, the other text of its doc_id too
            assert Counter(r.doc_id for r in rows if r.doc_offset == 0)[6] == 2


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_on_odd_rows_of_its_own(spark, odd, none, tmp_path, stage):
    spark.createDataFrame([(0, "same row")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    f = dict(corpus_pipeline.STAGES)[stage]
    got = Counter(r.doc_id for r in f(spark, odd, str(tmp_path)).collect() if stage != "packing" or r.doc_offset == 0)
    every = Counter(r[0] for r in ODD)
    want = {
        "quality_rules": every - Counter({1: 1, 2: 1, 3: 1, 4: 1, 7: 1, None: 1}), "line_dedup": every - Counter({6: 1}),
        "near_dedup": every - Counter({6: 1}),
        "decontamination": every - Counter({6: 2}), "packing": every - Counter({3: 1, None: 1}),
    }
    assert got == want[stage]
    assert f(spark, none, str(tmp_path)).count() == 0


def test_the_pipeline_runs_on_an_empty_table_and_on_one_of_nulls(spark, none, tmp_path):
    for k, df in enumerate((none, spark.createDataFrame([(None,) * 7, (1, *[None] * 6)], SCHEMA))):
        df.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/{k}/benchmark.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{k}").count() == 0
