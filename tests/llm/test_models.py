"""Quality classifier, secret scan, suffix-array dedup, PII and sharding: held-out accuracy, brute force and edge cases."""

import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from draftlake.llm import pii, quality_classifier, secrets, sharding, suffix_dedup, textops
from draftlake.llm.store import Scratch

from test_curation import ODD, none, odd, some_texts  # noqa: F401

# quality classifier


def rated(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.randint(20, 80))]
        g = r.choice([0, 1, 2, 2])
        if g == 0:
            words = [w + "%%%" for w in words]
        if g == 1:
            words[r.randrange(len(words))] = r.choice(["nasty", "vilest", "vilely"])
        out.append((i, " ".join(words), g))
    return out


def test_classifier_held_out(spark):
    rows = rated(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, _, g in rows[:600]], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.graded(docs, labels).collect()}
    test = rows[600:]
    assert sum(got[i].keep == (g == 2) for i, _, g in test) > 0.95 * len(test)
    assert sum(round(got[i].expected_grade) == g for i, _, g in test) > 0.9 * len(test)
    assert all(0 <= r.p_best <= r.p_fair <= 1 and r.expected_grade == pytest.approx(r.p_best + r.p_fair) for r in got.values())
    again = {r.doc_id: r.p_best for r in quality_classifier.graded(docs.repartition(2), labels).collect()}
    assert all(again[i] == pytest.approx(got[i].p_best) for i in again)
    bound = quality_classifier.train(docs, labels, sample=50)
    assert len(bound.weights) < len(quality_classifier.train(docs, labels).weights) + 50 and bound.thresholds[0] < bound.thresholds[1]


def test_fit_recovers_a_model():
    """The fit recovers a one-feature model: grades follow the thresholds."""
    r = np.random.default_rng(0)
    f = r.integers(0, 2, 3000)
    latent = 3.0 * f + r.logistic(size=3000)
    grades = (latent > 0).astype(int) + (latent > 2)
    m = quality_classifier.fit([np.array([1] if x else [], np.int64) for x in f], grades, steps=600, penalty=0)
    assert m.weights[0] == pytest.approx(3, abs=0.3) and m.thresholds == pytest.approx([0, 2], abs=0.25)


def slow_loss(rows, grades, weight, cut, penalty):
    """Mean negative log likelihood of the cumulative-link model, row by row, and the lasso penalty."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    total = 0.0
    for f, g in zip(rows, grades):
        score = sum(weight.get(int(k), 0.0) for k in f)
        above = [1.0, *(sig(score - c) for c in cut), 0.0]
        total -= math.log(max(above[g] - above[g + 1], 1e-300))
    return total / len(rows) + penalty * sum(map(abs, weight.values()))


def test_fit_is_a_minimum_of_the_loss():
    """No small change of a weight or threshold, one at a time, makes the loss of a plain computation noticeably less."""
    r = np.random.default_rng(5)
    true = {k: float(v) for k, v in enumerate(r.normal(size=8) * 2)}
    rows, grades = [], []
    for _ in range(400):
        f = np.flatnonzero(r.random(8) < 0.4)
        latent = sum(true[k] for k in f) + r.logistic()
        rows.append(f.astype(np.int64))
        grades.append(int(latent > -1) + int(latent > 1))
    penalty = 1e-3
    m = quality_classifier.fit(rows, np.array(grades), steps=2000, penalty=penalty)
    weight, cut = dict(zip(map(int, m.features), map(float, m.weights))), list(m.thresholds)
    best = slow_loss(rows, grades, weight, cut, penalty)
    for step in (-0.05, 0.05):
        for k in range(8):
            assert slow_loss(rows, grades, {**weight, k: weight.get(k, 0.0) + step}, cut, penalty) > best - 2e-5
        for k in range(2):
            assert slow_loss(rows, grades, weight, [c + step * (i == k) for i, c in enumerate(cut)], penalty) > best - 2e-5
    assert max(abs(weight.get(k, 0.0) - v) for k, v in true.items()) < 1.0


def test_scores_equal_plain_sums():
    """Scores of texts, one at a time and together, are the sums of the weights of their distinct features; models don't mix."""
    texts = ["The nasty cat, the cat!", "", "ÉTÉ été\nplain words here", "a" * 3000, "x y " * 500]
    known = sorted({int(k) for _, f, _ in quality_classifier.features(pa.array(texts)) for k in f})
    models = [quality_classifier.Model(np.array(known[i::2]), np.arange(1.0, len(known[i::2]) + 1), np.array([0.0, 1.0])) for i in (0, 1)]
    for _ in range(2):
        for m in models:
            w = dict(zip(m.features.tolist(), m.weights.tolist()))
            want = [sum(w.get(int(k), 0.0) for k in {*next(quality_classifier.features(pa.array([t])))[1].tolist()}) for t in texts]
            assert quality_classifier.score(m, pa.array(texts)).tolist() == pytest.approx(want)


def test_classifier_on_odd_rows(spark, odd, none):  # noqa: F811
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, 0), (4, 7, 7), (999, 1, 0)], "doc_id bigint, quality int, toxic int"
    )
    rows = quality_classifier.graded(odd, labels).collect()
    assert len(rows) == len(ODD) and not any(r.keep for r in rows if r.doc_id in (2, 3, 7))
    assert quality_classifier.graded(none, labels).count() == 0
    assert quality_classifier.graded(odd, labels.where("false")).count() == len(ODD)


# secret scan


def slow_cost(value):
    """All segmentations: each gap is a boundary or not, each part is brute force or its cheapest pattern."""
    part = defaultdict(lambda: math.inf)
    for i, j, c in secrets.segments(value):
        part[i, j] = min(part[i, j], c)
    per, n, best = math.log10(secrets.alphabet(value)), len(value), math.inf
    for cuts in itertools.product([0, 1], repeat=n - 1):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), n]
        cost = sum(min(per * (b - a), part[a, b]) for a, b in zip(at, at[1:])) + secrets.BOUNDARY * (len(at) - 2)
        best = min(best, cost)
    return best


@pytest.mark.parametrize("value", ["password1", "Tr0ub4dor", "aaaaaa", "abcabcabc", "1999zz", "qwerty12", "P4ss!x9", "zxcvb2001", "é€x9"])
def test_guess_cost_equals_all_segmentations(value):
    assert secrets.guess_cost(value) == pytest.approx(slow_cost(value))


def test_guess_cost_order():
    cost = [
        secrets.guess_cost(v) for v in ("password", "Password1", "qwertyuiop", "tg8QzX2vLk", "9c8b45435718dcc700c184a7e303cdc64c6a8f7f")
    ]
    assert cost == sorted(cost) and cost[0] < 2 and cost[-1] > 40
    assert secrets.guess_cost("abcdefghij") < 5 and secrets.guess_cost("19991231") < 6 and secrets.guess_cost("x" * 500) < 6
    assert secrets.guess_cost("ab1!" * 3) < secrets.guess_cost("ab1!") + 2


def test_contexts():
    text = (
        'a token = "3fdf5a35c7b8" b DB_PASSWORD: changeme. pwd=>Zz9$kQ1w, tokens = many, notasecret=abcdefg; password is x; api-key := '
        '\'a b c d e\''
    )
    assert [(n, text[a:b]) for n, a, b in secrets.values(text)] == [
        ("token", "3fdf5a35c7b8"), ("DB_PASSWORD", "changeme"), ("pwd", "Zz9$kQ1w"), ("api-key", "a b c d e")
    ]


@pytest.mark.parametrize(
    "text, want",
    [
        (
            "dbPassword=Zq8w#1 accessToken: abcd1234, userToken='ab cd'",
            [("dbPassword", "Zq8w#1"), ("accessToken", "abcd1234"), ("userToken", "ab cd")]
        ),
        (
            "PASSWORD_PROD=hunter22 TOKEN_1=abcd9 token2: wxyz7 passwordHash=abcd8",
            [("PASSWORD_PROD", "hunter22"), ("TOKEN_1", "abcd9"), ("token2", "wxyz7"), ("passwordHash", "abcd8")]
        ),
        ("Authorization: Bearer abcdefgh", [("Bearer", "abcdefgh")]),
        ('{"Authorization": "Bearer ab.c1-d=="}', [("Bearer", "ab.c1-d==")]),
        ("curl -H bearer abcd.1234 then", [("bearer", "abcd.1234")]),
        ('token = "Bearer abc12345"', [("Bearer", "abc12345")]),
        ("the bearer shares of bearer bonds, tokens: many, notasecret=abcdefg, userTokens=abcde", []),
        ("https://x.org/?token=AAAA1111&secret=BBBB2222&x=1", [("token", "AAAA1111"), ("secret", "BBBB2222")]),
        (
            "a_b_access_token=abcd1 AWSSecretKey=abcd2 x.apiKey.prod: abcd3",
            [("a_b_access_token", "abcd1"), ("AWSSecretKey", "abcd2"), ("x.apiKey.prod", "abcd3")]
        ),
    ],
)
def test_credential_names_and_ends(text, want):
    assert [(n, text[a:b]) for n, a, b in secrets.values(text)] == want
    assert not want or prefiltered(text)


def prefiltered(text):
    return pa.compute.match_substring_regex(pa.array([text]), secrets.PREFILTER)[0].as_py()


def test_a_long_name_is_searched_once():
    began = time.monotonic()
    assert [*secrets.values("token_" * 20_000)] == [] and time.monotonic() - began < 10


@pytest.mark.parametrize("seed", range(40))
def test_guess_cost_equals_the_list_of_segments(seed):
    r = random.Random(seed)
    parts = ["a", "aaaaaaa", "xxx", "abcdef", "fedcba", "qwsdfre", "sdsdsdsd", "password", "2001", "Zq9", "ab1!" * 4, "qwertyuiop"]
    value = "".join(r.choice(parts) * r.randint(1, 3) for _ in range(r.randint(1, 9)))
    into = defaultdict(list)
    for i, j, c in secrets.segments(value):
        into[j].append((i, c))
    per, best, brute = math.log10(secrets.alphabet(value)), [0.0], math.inf
    for j in range(1, len(value) + 1):
        brute = min(brute, best[j - 1] + secrets.BOUNDARY * (j > 1)) + per
        best.append(min([brute, *(best[i] + c + secrets.BOUNDARY * (i > 0) for i, c in into[j])]))
    assert secrets.guess_cost(value) == pytest.approx(best[-1])


@pytest.mark.parametrize("size", [513, 5000])
def test_long_values_are_whole(spark, size):
    r = random.Random(size)
    value = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(size))
    texts = [f'x private_key: "{value}" y', f"x token={value} y", f"x token={value}, y"]
    rows = secrets.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert sorted(
        (x.doc_id, texts[x.doc_id][x.start : x.end] == value, x.live) for x in rows
    ) == [(0, True, True), (1, True, True), (2, True, True)]
    assert {x.guesses_log10 > 1.5 * size for x in rows} == {True}


@pytest.mark.parametrize("part", ["x", "-=", "sd", "abcdefgh", "password1", "qwertyuiop"])
def test_long_regular_values_are_searched_fast(part):
    began = time.monotonic()
    assert secrets.guess_cost(part * (5000 // len(part))) < 20 and time.monotonic() - began < 10


def test_secret_scan_rows(spark, odd, none):  # noqa: F811
    docs = [
        (1, 'x token = "3fdf5a35c7b8d733c0b5c7d364eda8ac" y token: example'), (None, "password=hunter2"), (2, None), (3, "no tokens: here"),
        (4, "")
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = secrets.secrets(df.union(df)).collect()
    text = dict(docs)
    assert Counter((r.doc_id, text[r.doc_id][r.start : r.end], r.live) for r in rows) == {
        (1, "3fdf5a35c7b8d733c0b5c7d364eda8ac", True): 2, (1, "example", False): 2, (None, "hunter2", False): 2
    }
    assert secrets.secrets(odd).count() == 0 and secrets.secrets(none).count() == 0
    assert all(prefiltered(t) for i, t in docs if i in (1, None))


@pytest.fixture(scope="module")
def words(spark):
    from draftlake.llm.store import vocabulary_files

    return secrets.dictionary(vocabulary_files(spark))


def test_ordinary_words_are_no_secrets(words):
    assert len(words.rank) > 10_000
    for w in ("elephant", "required", "Passwort", "Beispiel", "bonjour", "contraseña", "Sunshine", "maison", "casa", "p4ssw0rd"):
        assert secrets.guess_cost(w, words) < secrets.LIVE, w
    assert secrets.guess_cost("elephantgiraffe", words) < 10 < secrets.guess_cost("tg8QzX2vLk", words)


def test_repeats_of_long_blocks(words):
    r = random.Random(4)
    block = "".join(r.choice("abcdefghijkmnopqrstuvwxyzABCDEF23456789") for _ in range(40))
    once = secrets.guess_cost(block, words)
    assert once > 40 and secrets.guess_cost(block * 5, words) < once + 5


@pytest.mark.parametrize("seed", range(60))
def test_long_runs_equal_brute_force(seed):
    r = random.Random(seed)
    parts = ["".join(r.choice("ab") for _ in range(r.randint(5, 50))) for _ in range(3)]
    v = "".join(r.choice(parts) for _ in range(r.randint(2, 14)))
    want, n = set(), len(v)
    for p in range(secrets.BLOCK + 1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and v[j] == v[j + p]:
                j += 1
            w = v[i : j + p]
            if j - i >= p and not any(all(w[k] == w[k + q] for k in range(len(w) - q)) for q in range(1, p)):
                want.add((p, i, j + p))
            i = max(j, i + 1)
    assert {*secrets._long_runs(np.frombuffer(v.encode("utf-32-le"), np.uint32))} == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("token    =      abcd1234 x", ["abcd1234"]), ("password:\n  hunter22", ["hunter22"]), ("password:\n\n  hunter22", []),
        ("token\u00a0=\u00a0abcd1234", ["abcd1234"]),
        ('secret = "it\'s a \\"long\\" one" x', ['it\'s a \\"long\\" one']), ('token="abc12345', ["abc12345"]),
        ("api key: abcd1234, monkey: banana, key: value1", ["abcd1234"]), ("token==abcd1234", ["abcd1234"]),
    ],
)
def test_white_space_and_quotes(text, want):
    assert [text[a:b] for _, a, b in secrets.values(text)] == want
    assert not want or prefiltered(text)


def slow_contexts(text):
    """Every name before every sign, by one expression for each form: quadratic, but plain. Values in the order they come."""
    name = r"(?:(?:[A-Za-z0-9]*[_\-.])*)"
    word = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|secret|private|auth)key|clientsecret|credentials?)"
    camel = r"[A-Za-z0-9]+(?:Pass(?:word)?|Token|Secret|(?:Api|Access|Secret|Private|Auth)Key)"
    key = rf"(?<![A-Za-z0-9_\-.]){name}(?:{word}|{camel}|(?i:(?:api|access|secret|private|auth)[_\-.]key))[0-9]*(?:(?<=[a-z0-9])[A-Z][A-Za-z0-9]*)?(?:[_\-.][A-Za-z0-9]*)*"
    space = r"[^\S\n]*\n?[^\S\n]*"
    out, end = [], 0
    for m in re.finditer(r":=|=>|={1,3}|:", text):
        if m.start() < end:
            continue
        n = next((x for x in (re.search(rf"{key}[\"'`]?{space}\Z", text[: m.start()]),) if x), None)
        if not n:
            continue
        v = re.compile(rf"{space}(?:([\"'`])((?:(?!\1)[^\\\n]|\\.)*)\1|[\"'`]?([^\s\"'`,;<>&]+))").match(text, m.end())
        if v:
            a, b = v.span(2) if v.group(1) else v.span(3)
            while not v.group(1) and b > a and text[b - 1] in ".)]}!?:":
                b -= 1
            if b - a >= 4 and not text[a:b].lower().startswith("bearer"):
                end = b
                out.append((a, b))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_contexts_equal_brute_force(seed):
    r = random.Random(seed)
    parts = [
        "token", "Token", "api", "Key", "key", "_", "-", ".", "password", "Pass", "9", " ", "  ", "\n", "=", ":", ":=", "=>", "==", '"',
        "'", "`", "abcd1", "x", ",", "&", ";", "secret", "\\"
    ]
    for _ in range(60):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        if re.search(r"(?i)(api|access|secret|private|auth) key", text):
            continue  # the form with a blank has its own test
        assert [(a, b) for _, a, b in secrets.values(text)] == slow_contexts(text), text


LONG = 1 << 20


@pytest.mark.parametrize(
    "text",
    [
        "a-" * (LONG // 2), "token_" * (LONG // 6), "token:" * (LONG // 6), "token" + " " * LONG + "=x", '"token: ""' * (LONG // 10),
        ":" * LONG, "bearer " * (LONG // 7), "漢" * LONG + " 5"
    ]
)
def test_long_texts_are_scanned_in_linear_time(text):
    began = time.monotonic()
    for _ in secrets.values(text):
        pass
    assert time.monotonic() - began < 5


def test_long_texts_reach_the_search(spark):
    r = random.Random(1)
    value = "".join(r.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(5000))
    texts = ["a-" * (LONG // 2) + f' token = "{value}"', "q" * LONG + f" mail jo.do@ex.com token: {value}", "漢" * LONG + " 10.20.30.40"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(
        (x.doc_id, texts[x.doc_id][x.start : x.end] == value, x.live) for x in secrets.secrets(df).collect()
    ) == [(0, True, True), (1, True, True)]
    assert sorted(
        (x.doc_id, texts[x.doc_id][x.start : x.end]) for x in pii.personal_data(df).where("label IN ('EMAIL', 'IP')").collect()
    ) == [(1, "jo.do@ex.com"), (2, "10.20.30.40")]


# suffix-array dedup


@pytest.mark.parametrize("seed", range(20))
def test_interval_expansion_equals_brute_force(seed):
    r = random.Random(seed)
    least = r.choice([2, 3, 5])
    parts = [np.array([r.randint(0, r.choice([1, 3, 9])) for _ in range(r.randint(least, 25))], np.uint32) for _ in range(r.randint(1, 6))]
    count = Counter(tuple(p[i : i + least]) for p in parts for i in range(len(p) - least + 1))
    seen = set()
    for p, (again, first) in zip(parts, suffix_dedup.repeated_windows(parts, least)):
        for i in range(len(p) - least + 1):
            k = tuple(p[i : i + least])
            assert (again[i], first[i]) == (count[k] > 1, k not in seen)
            seen.add(k)


def test_long_prefix_equals_direct_comparison():
    r = np.random.default_rng(3)
    s = np.append(r.integers(1, 4, 200), 0)
    sa, isa = suffix_dedup.suffix_array(s)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist()) and (isa[sa] == np.arange(len(s))).all()
    for least in (1, 2, 4, 7):
        want = [False] + [
            s[a : a + least].tolist() == s[b : b + least].tolist() and max(a, b) + least <= len(s) for a, b in zip(sa, sa[1:])
        ]
        assert suffix_dedup.long_prefix(sa, isa, s, least).tolist() == want


def slow_repeats(docs, length):
    words = {i: t.split() for i, t in docs}
    count = Counter(tuple(w[k : k + length]) for w in words.values() for k in range(len(w) - length + 1))
    seen, out = set(), set()
    for i, w in sorted(words.items()):
        covered = {False: set(), True: set()}
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            if count[g] > 1:
                covered[g in seen] |= set(range(k, k + length))
            seen.add(g)
        for dup, c in covered.items():
            for k in sorted(c):
                if k - 1 not in c:
                    e = k
                    while e in c:
                        e += 1
                    out.add((i, k, e, dup))
    return out


@pytest.mark.parametrize(
    "pool, hot, batch", [(200_000, 20_000, 10_000), (60, 20_000, 10_000), (200_000, 0, 10_000), (60, 0, 3), (60, 2, 7)]
)
def test_repeats_equal_brute_force(spark, monkeypatch, pool, hot, batch):
    monkeypatch.setattr(suffix_dedup, "_POOL", pool)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    r = random.Random(6)
    passages = [t for t in some_texts(30, 2) if len(t.split()) > 25][:6]
    docs = [
        (i, " ".join([t, *(r.choice(passages) for _ in range(r.randint(0, 2))), *some_texts(1, 100 + i)]))
        for i, t in enumerate(some_texts(40, 7))
    ]
    docs += [(100 + i, docs[i][1]) for i in range(4)]
    want = slow_repeats(docs, 20)
    got = suffix_dedup.repeats(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), length=20, k=4).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 20


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_the_stream_of_shared_rows(size):
    r = random.Random(size)
    rows = sorted(r.randint(0, 40) for _ in range(50))
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + size], pa.int64())], ["a"]) for i in range(0, 50, size)]
    assert [x for b in textops.shared_rows(iter(batches)) for x in b.column(0).to_pylist()] == [x for x in rows if rows.count(x) > 1]


def test_repeats_on_odd_rows(spark, odd, none):  # noqa: F811
    got = sorted(tuple(r) for r in suffix_dedup.repeats(odd).collect())
    assert got == [(4, 0, 50, False), (4, 1, 60_000, True)]
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, long), (None, long), (3, "x " + long)], "doc_id bigint, text string")
    assert sorted((tuple(r) for r in suffix_dedup.repeats(df).collect()), key=str) == [(3, 1, 61, False), (None, 0, 60, True)]
    assert suffix_dedup.repeats(none).count() == 0


# PII


@pytest.fixture(scope="module")
def field():
    return pii.trained()


def test_pii_held_out(field):
    made = pii._synthetic(300, 12345)
    found = pii.entities(field, [t for t, _ in made])
    hit = want = got = 0
    for (_, spans), f in zip(made, found):
        w, g = {x for x in spans if x[2] != "O"}, {x[:3] for x in f}
        hit, want, got = hit + len(w & g), want + len(w), got + len(g)
    assert hit > 0.97 * want and hit > 0.97 * got


@pytest.mark.parametrize(
    "text, want",
    [
        ("see (4111111111111111) and (10.0.0.1).", [("4111111111111111", "CARD"), ("10.0.0.1", "IP")]),
        ("tel:555-123-4567 IP:10.0.0.1", [("555-123-4567", "PHONE"), ("10.0.0.1", "IP")]),
        ('{"card":"4111111111111111","ip":"1.2.3.4"}', [("4111111111111111", "CARD"), ("1.2.3.4", "IP")]),
        (
            "anna,jo.do@ex.com,4111-1111-1111-1111,10.20.30.40",
            [("jo.do@ex.com", "EMAIL"), ("4111-1111-1111-1111", "CARD"), ("10.20.30.40", "IP")]
        ),
        ("http://10.20.30.40:8080/x?mail=jo@ex.com&b", [("10.20.30.40", "IP"), ("jo@ex.com", "EMAIL")]),
        ("SSN-123-45-6789", [("123-45-6789", "SSN")]),
        ("IBAN DE89 3704 0044 0532 0130 00 IS MINE", [("DE89 3704 0044 0532 0130 00", "IBAN")]),
        ("ssn=123-45-6789;iban=DE89370400440532013000", [("123-45-6789", "SSN"), ("DE89370400440532013000", "IBAN")]),
        ("call (+1 (504) 555-2652) at 12:30 on 3/14/2024, 1,234 times", [("+1 (504) 555-2652", "PHONE")]),
    ],
)
def test_pii_glued_bracketed_json_csv_and_grouped(field, text, want):
    assert [(text[a:b], label) for a, b, label, _ in pii.entities(field, [text])[0]] == want


def naive_marginals(field, g):
    own = g.x @ field.unary
    n, k = own.shape
    z, want = 0.0, np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        p = math.exp(
            sum(own[i, y[i]] for i in range(n)) + sum(
                pot[y[a], y[b]] for e, pot in ((g.chain, field.chain), (g.skip, field.skip), (g.near, field.near)) for a, b in e
            )
        )
        z += p
        for i in range(n):
            want[i, y[i]] += p
    return want / z


def some_graph(r, n, chain, skip, near):
    edges = lambda e: np.array(e, np.int64).reshape(-1, 2)
    return pii.Graph((r.random((n, 3)) < 0.5).astype(np.uint8), edges(chain), edges(skip), edges(near), np.zeros(n, np.int64))


def some_field(r, scale):
    k = len(pii.LABELS)
    return pii.Field(r.normal(size=(3, k)), *(scale * r.normal(size=(k, k)) for _ in range(3)))


def test_messages_are_exact_on_a_tree():
    r = np.random.default_rng(1)
    f, g = some_field(r, 1), some_graph(r, 4, [[0, 1], [1, 2]], [[0, 3]], [])
    node, (both, *_) = pii.messages(f, g)
    assert np.allclose(node, naive_marginals(f, g), atol=1e-3) and np.allclose(both[0].sum(axis=1), node[0], atol=1e-3)


def test_messages_with_loops_are_close_to_the_exact_marginals():
    for seed in range(5):
        r = np.random.default_rng(seed)
        f, g = some_field(r, 0.4), some_graph(r, 4, [[0, 1], [1, 2], [2, 3]], [[0, 2]], [[0, 3]])
        assert np.abs(pii.messages(f, g)[0] - naive_marginals(f, g)).max() < 0.05


def test_graph_equals_brute_force():
    text = "jo@ex.com, jo@ex.com then an@ex.com and 10.1.2.3 10.1.2.4 x 10.1.2.3; 555-123-4567 y JO@EX.COM"
    found = pii.candidates(text)
    g = pii.graph([("", []), (text, found), (text, found)])
    chain, skip, near = set(), set(), set()
    for k, (a, b, token, _) in enumerate(found):
        if k and not re.search(r"\w", text[found[k - 1][1] : a]):
            chain.add((k - 1, k))
        equal = [i for i in range(k) if pii.link(found[i][2]) == pii.link(token)]
        kin = [i for i in range(k) if pii.stem(token) is not None and pii.stem(found[i][2]) == pii.stem(token)]
        if equal and (equal[0], k) not in chain:
            skip.add((equal[0], k))
        if kin and pii.link(found[kin[0]][2]) != pii.link(token) and (kin[0], k) not in chain:
            near.add((kin[0], k))
    n = len(found)
    for got, want in ((g.chain, chain), (g.skip, skip), (g.near, near)):
        assert {*map(tuple, got.tolist())} == want | {(a + n, b + n) for a, b in want} and want
    assert g.of.tolist() == [1] * n + [2] * n


def test_a_repeat_after_words_is_linked():
    for text in ("write a@b.com today then a@b.com", "write a@b.com today 7 then a@b.com"):
        found = pii.candidates(text)
        assert pii.graph([(text, found)]).skip.tolist() == [[0, len(found) - 1]]


def test_evidence_reaches_all_repeats():
    """One mention with a sure form among 200 without any: its label gains at each of them, the furthest as much as the nearest."""
    text = " and then ".join(["x 7 y"] * 201)
    g = pii.graph([(text, pii.candidates(text))])
    assert g.skip.tolist() == [[0, k] for k in range(1, 201)]
    n, k = len(pii.LABELS), pii.LABELS.index("SSN")
    unary = np.zeros((len(pii.FEATURES), n))
    unary[pii._AT["ssn"], k] = 6
    field = pii.Field(unary, np.zeros((n, n)), 2 * np.eye(n), np.zeros((n, n)))
    x = np.zeros_like(g.x)
    before, _ = pii.messages(field, g._replace(x=x))
    x[150, pii._AT["ssn"]] = 1
    after, _ = pii.messages(field, g._replace(x=x))
    gain = (after - before)[:, k]
    assert before == pytest.approx(1 / n) and gain.min() > 0.1 and gain[1] == pytest.approx(gain[200], abs=1e-3)


def test_skip_links_carry_a_label(field):
    """A number that only one mention gives away is labelled at the others too, as trained links favour equal labels."""
    assert np.trace(field.skip) > 0 and all(field.skip[i, i] == field.skip[i].max() for i in range(len(pii.LABELS)))
    x = np.zeros((2, len(pii.FEATURES)), np.uint8)
    no = np.zeros((0, 2), np.int64)
    alone, _ = pii.messages(field, pii.Graph(x, no, no, no, np.zeros(2, np.int64)))
    x[0, pii._AT["ssn"]] = 1
    linked, _ = pii.messages(field, pii.Graph(x, no, np.array([[0, 1]]), no, np.zeros(2, np.int64)))
    assert linked[1, pii.LABELS.index("SSN")] > alone[1, pii.LABELS.index("SSN")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Rufen Sie +34 612 345 678 an, 2024 nur mittags.", [("+34 612 345 678", "PHONE")]),
        ("Call me at 555-123-4567 or +44 20 7946 0958.", [("555-123-4567", "PHONE"), ("+44 20 7946 0958", "PHONE")]),
        ("Contact: maria.garcia@empresa.es; tel. +34 612 345 678", [("maria.garcia@empresa.es", "EMAIL"), ("+34 612 345 678", "PHONE")]),
        ("card 4111-1111-1111-1111, 5500 0000 0000 0004", [("4111-1111-1111-1111", "CARD"), ("5500 0000 0000 0004", "CARD")]),
        ("server 192.168.0.1:8080 up 24/7, 99.9% of 365 days", [("192.168.0.1", "IP")]),
        ("IBAN: FR1420041010050500013M02606", [("FR1420041010050500013M02606", "IBAN")]),
        ("in 1990, 1991, 1992, 1993 and 1994; years 1990 1991 1992 1993 1994 1995", []),
        ("Rechnung 2023-11-05 Nr. 4711 vom 12.11.2023 über 1.234,56 EUR, ISBN 978-3-16-148410-0", []),
        ("1999-2000-2001-2002, pages 1990 1991 1992 1993", []),
        (
            "Frau Müller-Lüdenscheidt rief an. Müller-Lüdenscheidt zahlt, ein anderer Müller nicht.",
            [("Müller-Lüdenscheidt", "PERSON"), ("Müller-Lüdenscheidt", "PERSON")]
        ),
        (
            "Mr. John Smith came in 2024. Then Smith left; SMITH paid 5.",
            [("John Smith", "PERSON"), ("Smith", "PERSON"), ("SMITH", "PERSON")]
        ),
        ("The name is unknown. Name: Peter O'Neil, tel 555-123-4567", [("Peter O'Neil", "PERSON"), ("555-123-4567", "PHONE")]),
        ("Dear Mr. President, the president is in, says the President. Dr. Who is who.", []),
        ("lat 48.8566, lon 2.3522, SHA 3fdf5a35c7b8d733, 0x7fff5fbff8c0, my id is 123456789", []),
    ],
)
def test_pii_in_text_of_another_hand(field, text, want):
    assert [(text[a:b], label) for a, b, label, _ in pii.entities(field, [text])[0]] == want


def test_pii_rows(spark, odd, none):  # noqa: F811
    text = (
        "Mail jo.do@ex.example.com, call +1 (504) 555-2652!! or 4225039295678253 4422503929567825 from 10.2.3.4; in 2024 v1.2.3 token "
        "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    )
    df = spark.createDataFrame([(1, text), (1, text), (None, "x 192.168.0.1"), (2, None), (3, "no one")], "doc_id bigint, text string")
    rows = pii.personal_data(df).collect()
    want = {
        "jo.do@ex.example.com": "EMAIL", "+1 (504) 555-2652": "PHONE", "4225039295678253": "CARD", "4422503929567825": "CARD",
        "10.2.3.4": "IP"
    }
    assert Counter((text[r.start : r.end], r.label) for r in rows if r.doc_id == 1) == {k: 2 for k in want.items()}
    assert [(r.start, r.end, r.label) for r in rows if r.doc_id is None] == [(2, 13, "IP")]
    assert pii.personal_data(odd).count() == 0 and pii.personal_data(none).count() == 0


# sharding


def test_sharding_keeps_sizes_and_cuts_less(spark):
    r = random.Random(4)
    families = [[f"a line of family {g} with number {k}" for k in range(6)] for g in range(25)]
    docs = []
    for i in range(200):
        docs.append((i, "\n".join([*r.sample(families[i % 25], 4), f"a line of document {i} alone", "the line of all documents"])))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    start, end = sharding.sharded(df, shards=4, rounds=0), sharding.sharded(df, shards=4)
    size = Counter(x.shard for x in end.collect())
    assert sum(size.values()) == 200 and set(size) == set(range(4)) and max(size.values()) <= math.ceil(50 * 1.05)
    assert max(Counter(x.shard for x in start.collect()).values()) == 50
    a, b = sharding.cut(df, start).first(), sharding.cut(df, end).first()
    assert b["cut"] < 0.6 * a["cut"] and a["weight"] == b["weight"]
    assert sorted(map(tuple, end.collect())) == sorted(map(tuple, sharding.sharded(df.repartition(2), shards=4).collect()))
    label = {x.doc_id: x.shard for x in end.collect()}
    lines = defaultdict(set)
    for i, t in docs:
        for x in t.split("\n"):
            lines[x].add(i)
    slow = sum(1 / (len(d) - 1) for d in lines.values() if len(d) > 1 for p, q in itertools.combinations(d, 2) if label[p] != label[q])
    assert b["cut"] == pytest.approx(slow)


def test_near_copies_and_passages_without_a_common_line_are_drawn_together(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(6))
    docs, families = [], []
    for g in range(40):
        base, own = [word() for _ in range(60)], []
        for k in range(4):
            if g % 2:  # near copies: one word of each line is another
                lines = [base[i : i + 15] for i in range(0, 60, 15)]
                for x in lines:
                    x[r.randrange(15)] = word()
                text = "\n".join(map(" ".join, lines))
            else:  # a passage of 20 words in a longer line
                text = " ".join([word() for _ in range(30 + k)] + base[:20] + [word() for _ in range(30)])
            own.append(len(docs))
            docs.append((len(docs), text))
        families.append(own)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert sharding.links(df, content=False).count() == 0
    label = {x.doc_id: x.shard for x in sharding.sharded(df, shards=4).collect()}
    assert max(Counter(label.values()).values()) <= math.ceil(40 * 1.05)
    for kind in (0, 1):
        pairs = [(a, b) for own in families[kind::2] for a, b in itertools.combinations(own, 2)]
        assert sum(label[a] == label[b] for a, b in pairs) > 0.6 * len(pairs)


def test_bundled_links_stand_for_all(spark):
    edges = [(1, 0, 2), (1, 1, 2), (2, 0, 2), (2, 1, 2), (3, 0, 3), (3, 1, 3), (3, 2, 3)]
    sums = [(1, None, 2, 7, 8), (2, None, 2, 7, 8), (3, None, 3, 7, 9)]
    rows = sharding.bundled(
        spark.createDataFrame(
            [(h, d, None, None, None) for h, d, _ in edges] + sums, "h bigint, doc_id bigint, n bigint, x bigint, y bigint"
        )
    ).collect()
    assert sorted((x.doc_id, x.n, x.m) for x in rows) == [
        (0, 2, 2), (0, 3, 1), (1, 2, 2), (1, 3, 1), (2, 3, 1)
    ] and len({x.h for x in rows}) == 2


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_the_stream_of_links_equals_counting(size):
    r = random.Random(size)
    rows = sorted((r.randint(0, 25), r.randint(0, 9)) for _ in range(60))
    batches = [
        pa.RecordBatch.from_arrays(
            [
                pa.array([h for h, _ in rows[i : i + size]], pa.int64()), pa.array([d for _, d in rows[i : i + size]], pa.int64()),
                pa.array([d for _, d in rows[i : i + size]], pa.int64())
            ],
            ["h", "doc_id", "d"]
        )
        for i in range(0, 60, size)
    ]
    got = [tuple(x.values()) for b in sharding._shared(iter(batches)) for x in b.to_pylist()]
    count = Counter(h for h, _ in rows)
    assert sorted(x[:2] for x in got if x[2] is None) == [x for x in rows if count[x[0]] > 1]
    assert {x[0]: x[2] for x in got if x[2] is not None} == {h: n for h, n in count.items() if n > 1}
    sets = defaultdict(set)
    for h, _, _, x, y in (x for x in got if x[2] is not None):
        sets[x, y].add(tuple(sorted(Counter(d for g, d in rows if g == h).items())))
    assert len(sets) <= sum(n > 1 for n in count.values())


def slow_links(texts, least=sharding.LINE_BYTES):
    """The sets of documents that share a line, or all words of some window's least gram (by the operator's hash of it)."""
    lines = defaultdict(set)
    for i, t in texts:
        for x in t.split("\n"):
            if len(x.encode()) >= least:
                lines[x].add(i)
    return {frozenset(v) for v in lines.values() if len(v) > 1}


def test_links_equal_brute_force(spark):
    r = random.Random(2)
    lines = [" ".join(r.choice(["alpha", "beta", "gamma", "x"]) for _ in range(r.randint(1, 9))) for _ in range(12)]
    texts = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 5)))) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    for repeated in (True, False):
        rows = sharding.links(df, content=False, repeated=repeated).collect()
        sets, sums = defaultdict(set), {}
        for x in rows:
            if x.n is None:
                sets[x.h].add(x.doc_id)
            else:
                sums[x.h] = x.n
        assert {frozenset(v) for v in sets.values()} == slow_links(texts) and {h: len(v) for h, v in sets.items()} == sums
    # a document whose rows repeat a line has it once
    twice = df.union(df)
    assert {x.h: x.n for x in sharding.links(twice, content=False).collect() if x.n} == sums


def spark_hash(*values):
    """Spark's xxhash64 of integers: (value, bytes)."""
    import xxhash

    h = 42
    for v, size in values:
        h = xxhash.xxh64(v.to_bytes(size, "little", signed=True), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def slow_propagate(edges, label, shards, capacity, rounds):
    label = dict(label)
    members = defaultdict(list)
    for h, d, n, m in edges:
        members[h].append((d, n, m))
    for k in range(rounds):
        weight = defaultdict(lambda: [0.0] * shards)
        for group in members.values():
            for d, n, m in group:
                for e, _, _ in group:
                    if e != d:
                        weight[d][label[e]] += m / (n - 1)
        wishes = defaultdict(list)
        for d, w in weight.items():
            w = [round(v, 9) for v in w]
            own = label[d]
            to = min((s for s in range(shards) if s != own), key=lambda s: (-w[s], s))
            gain = round(w[to] - w[own], 9)
            if gain > 0 and spark_hash((d, 8), (k, 4)) % 2 == 0:
                x = spark_hash((d, 8))
                step = math.floor(math.log2(gain) * sharding._STEPS)
                wishes[own, to].append((-step, (x % (1 << 64) >> 40) % sharding._TURNS, x, d))
        sizes = [sum(v == s for v in label.values()) for s in range(shards)]
        for (own, to), n in sharding.quotas({p: len(v) for p, v in wishes.items()}, sizes, capacity).items():
            for *_, d in sorted(wishes[own, to])[:n]:
                label[d] = to
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_propagation_equals_the_rounds_in_a_loop(spark, seed):
    r = random.Random(seed)
    edges = []
    for h in range(120):
        family = r.randrange(6)
        group = sorted({family + 6 * r.randrange(15) if r.random() < 0.9 else r.randrange(90) for _ in range(r.randint(2, 8))})
        if len(group) > 1:
            edges += [(h, d, len(group), 1 + h % 3) for d in group]
    label = [(d, d * 4 // 90) for d in range(90)]
    scratch = Scratch(spark, "t")
    start = scratch.write(spark.createDataFrame(label, "doc_id bigint, shard int"))
    got = {
        x.doc_id: x.shard
        for x in sharding.propagate(
            spark.createDataFrame(edges, "h bigint, doc_id bigint, n bigint, m int"), start, 4, 25, 5, scratch
        ).collect()
    }
    assert got == slow_propagate(edges, label, 4, 25, 5) and got != dict(label)


def test_one_round_moves_to_the_heaviest_neighbour(spark):
    edges = spark.createDataFrame([(1, 0, 3), (1, 1, 3), (1, 2, 3), (2, 3, 2), (2, 4, 2)], "h bigint, doc_id bigint, n bigint")
    label = Scratch(spark, "t").write(spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 0), (4, 0)], "doc_id bigint, shard int"))
    got = {r.doc_id: r.shard for r in sharding.propagate(edges, label, 2, 5, 4, Scratch(spark, "t")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0}


def test_quotas():
    sizes, capacity = [10, 10, 8], 10
    q = sharding.quotas({(0, 1): 5, (1, 0): 3, (0, 2): 4, (1, 2): 1}, sizes, capacity)
    assert all(0 <= q[k] for k in q) and q[1, 0] == 3
    for k in range(3):
        after = sizes[k] - sum(n for (a, _), n in q.items() if a == k) + sum(n for (_, b), n in q.items() if b == k)
        assert after <= capacity


def test_sharding_on_odd_rows(spark, odd, none):  # noqa: F811
    rows = sharding.sharded(odd, shards=3).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 5, 6, 7, 8] and max(Counter(r.shard for r in rows).values()) <= 3
    assert sharding.sharded(none).count() == 0


