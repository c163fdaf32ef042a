"""Secret scans: guess-cost dynamic programming on the values of credential contexts."""

from __future__ import annotations

import base64
import itertools
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from . import textops as T
from .store import read, vocabulary_files
from .suffix_dedup import suffix_array

#: Decimal logarithm of the guesses from which on a value counts as a live secret and not as a placeholder.
LIVE = 8.0
#: What a boundary between two segments adds: a guesser must also try where it lies.
BOUNDARY = math.log10(2)
#: What a part of a name must be: a key word, alone or at the end of camelCase, then digits and a capitalised suffix.
_PART = re.compile(
    r"(?:(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|secret|private|auth)key|clientsecret|credentials?|bearer)"
    r"|[A-Za-z0-9]+(?:Pass(?:word|wd|phrase|code)?|Pwd|Secret|Token|(?:Api|API|Access|Secret|Private|Auth)Key|Credentials?))[0-9]*(?:(?<=[a-z0-9])[A-Z][A-Za-z0-9]*)?"
)
#: ``key`` alone is one of a credential only after one of these.
_OWNERS = {"api", "access", "secret", "private", "auth"}
_KEY = re.compile(r"(?i:key)[0-9]*(?:(?<=[a-z0-9])[A-Z][A-Za-z0-9]*)?")
_SIGN = re.compile(r":=|=>|={1,3}|:")
#: Before a value: white space, with one line break at most.
_LEAD = re.compile(r"[^\S\n]*+\n?[^\S\n]*+")
_OPEN = re.compile(r"[^\s\"'`,;<>&]++")
#: A quoted value ends at the same quote; a backslash takes the sign after it along.
_QUOTED = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+(?={q})") for q in "\"'`"}
_NAME_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-.")
#: What follows Bearer: any value in an Authorization header, elsewhere one with a digit, as the word is one of prose too.
_BEARER = re.compile(r"(?i)(?<![a-z0-9])bearer(?![a-z0-9])")
_TOKEN = re.compile(r"(?i)\s++([a-z0-9\-._~+/]{4,}+=*+)")
_WHITE = r"[\s\v\p{Z}\x{85}\x{1c}-\x{1f}]"
#: For RE2, whose time is linear, and wider than the search itself: only texts that it finds are searched.
PREFILTER = rf"(?i)(?:pass|pwd|secret|token|key|credential|bearer)[a-z0-9_\-.]*[\"'`]?{_WHITE}*[:=]|bearer{_WHITE}+[a-z0-9\-._~+/]{{4}}"
#: Common passwords and words, the commonest first.
WORDS = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login abc football shadow sunshine princess iloveyou secret "
    "test guest root user pass love"
    " changeme default example placeholder sample dummy demo token key value none null true false your my the this that here "
    "insert replace enter todo xxx foo bar baz temp"
    " summer winter spring autumn monday friday january march april june july august october november december baseball soccer "
    "hockey batman superman michael jennifer jordan"
    " charlie andrew daniel thomas george harley ranger buster hunter trustno robert matthew ashley jessica amanda nicole cookie "
    "pepper ginger killer hello freedom whatever"
    " computer internet server database mysql postgres oracle system service public private production staging development company "
    "account access api client hidden redacted"
    " blue red green black white silver gold orange purple yellow dog cat fish bird horse tiger lion eagle star moon sun fire "
    "water earth wind house home work school life"
    " passwort kennwort contraseña clave motdepasse geheim secreto beispiel exemple ejemplo usuario benutzer utilisateur ändern "
    "cambiar changer bitte hier aquí"
    " time year day night world money power magic angel devil heaven correct battery staple apple google amazon microsoft windows "
    "linux android mobile phone email mail"
).split()
LEET = str.maketrans("4@310!5$7+8", "aaeloissttb"[:11])
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFT = dict(zip("~!@#$%^&*()_+{}|:\"<>?", "`1234567890-=[]\\;',./"))
KEYS = {c: (x + 0.5 * y, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
YEARS = range(1900, 2051)
#: Signs of the blocks whose repeats may start anywhere; longer ones start where the repetition does.
BLOCK = 32
_DATES = [
    re.compile(r"(?P<y>\d{4})(?P<s>[-/._]?)(?P<m>\d{2})(?P=s)(?P<d>\d{2})"),
    re.compile(r"(?P<d>\d{2})(?P<s>[-/._]?)(?P<m>\d{2})(?P=s)(?P<y>\d{4})"),
    re.compile(r"(?P<m>\d{2})(?P<s>[-/._]?)(?P<d>\d{2})(?P=s)(?P<y>\d{4})"),
    re.compile(r"(?P<d>\d{2})(?P<s>[-/._]?)(?P<m>\d{2})(?P=s)(?P<y>\d{2})"),
    re.compile(r"(?P<y>\d{4})"),
]


def alphabet(value: str) -> int:
    """Signs that a brute-force guesser of this value tries at each place."""
    n = 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 10 * any("0" <= c <= "9" for c in value)
    return n + 33 * any(c.isascii() and not c.isalnum() for c in value) + 100 * any(not c.isascii() for c in value) or 1


class Dictionary:
    """Words by rank, the commonest first."""

    def __init__(self, words: Iterable[str]):
        self.rank = {w: k + 1 for k, w in enumerate(dict.fromkeys(words))}
        self.longest = max(map(len, self.rank), default=0)
        self.heads = {w[:3] for w in self.rank}

    def cost(self, span: str) -> float | None:
        """log10 of the guesses of a word, its capitals and its digits for letters."""
        low = _lower(span)
        plain = low.translate(LEET)
        rank = min(self.rank.get(low, 1 << 60), self.rank.get(plain, 1 << 60))
        if rank == 1 << 60:
            return None
        upper = sum(c.isupper() for c in span)
        case = 1 if not upper else 2 if upper == len(span) or (
            upper == 1 and (span[0].isupper() or span[-1].isupper())
        ) else 2 * math.comb(len(span), upper)
        swapped = 0 if low in self.rank else sum(a != b for a, b in zip(low, plain))
        return math.log10(rank * case * (2**swapped) + 1)

    def spans(self, value: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, cost) of each word of 3 signs or more in the value."""
        low = _lower(value)
        plain = low.translate(LEET)
        for i in range(len(value) - 2):
            if low[i : i + 3] in self.heads or plain[i : i + 3] in self.heads:
                for j in range(i + 3, min(len(value), i + self.longest) + 1):
                    if low[i:j] in self.rank or plain[i:j] in self.rank:
                        yield i, j, self.cost(value[i:j])


def _lower(value: str) -> str:
    """Lower case of the same length."""
    low = value.lower()
    return low if len(low) == len(value) else "".join(x if len(x := c.lower()) == 1 else c for c in value)


#: The common passwords alone.
COMMON = Dictionary(WORDS)


def dictionary(files: Iterable[str]) -> Dictionary:
    """The common passwords, then the words of files of ranks (base64 of the bytes, blank, rank), by their ranks in turn.

    A word is what such a file has with a blank before it and 3 letters or more.
    """
    ranked = []
    for path in files:
        with open(path, "rb") as f:
            pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        names = [p[1:].decode("utf-8", "replace").lower() for p in pieces if p[:1] == b" "]
        ranked.append([w for w in names if len(w) >= 3 and w.isalpha()])
    return Dictionary([*WORDS, *(w for row in itertools.zip_longest(*ranked) for w in row if w)])


def date_cost(span: str) -> float | None:
    for p in _DATES:
        m = p.fullmatch(span)
        if m:
            g = m.groupdict()
            y = int(g["y"]) if len(g["y"]) == 4 else 2000
            if y in YEARS and (g.get("m") is None or (1 <= int(g["m"]) <= 12 and 1 <= int(g["d"]) <= 31)):
                return math.log10(len(YEARS) * (365 if g.get("m") else 1) * (4 if g.get("s") else 1))
    return None


def _walks(value: str) -> tuple[tuple[list[int], list[int]], list[int]]:
    """For each place the ends of the longest runs of codes that go up (abcd) and down (4321), and of the longest keyboard walk, from it."""
    low = [_SHIFT.get(c, c.lower()) for c in value]
    n = len(low)

    def reach(linked) -> list[int]:
        out = [n] * n
        for i in range(n - 2, -1, -1):
            out[i] = out[i + 1] if linked(i) else i + 1
        return out

    def near(i: int) -> bool:
        a, b = KEYS.get(low[i]), KEYS.get(low[i + 1])
        return a is not None and b is not None and a != b and abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1

    up = reach(lambda i: low[i].isalnum() and ord(low[i + 1]) - ord(low[i]) == 1)
    down = reach(lambda i: low[i].isalnum() and ord(low[i + 1]) - ord(low[i]) == -1)
    return (up, down), reach(near)


def _bends(value: str) -> list[int]:
    """At k the changes of direction of the keyboard walk through the whole value up to step k; a sign off the keyboard is none."""
    pos = [KEYS.get(_SHIFT.get(c, c.lower())) for c in value]
    steps = [None if a is None or b is None else (round(2 * (b[0] - a[0])), b[1] - a[1]) for a, b in zip(pos, pos[1:])]
    out = [0] * max(1, len(steps))
    for k in range(1, len(steps)):
        out[k] = out[k - 1] + (steps[k] != steps[k - 1])
    return out


@lru_cache(maxsize=100_000)
def walk_cost(length: int, parts: int) -> float:
    """log10 of: starting keys, lengths, directions for each straight part, places of the turns."""
    places = math.lgamma(length) - math.lgamma(parts) - math.lgamma(length - parts + 1)
    return math.log10(47 * length) + parts * math.log10(6) + places / math.log(10)


def _short(value: str, words: Dictionary) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of each word and date in the value."""
    n = len(value)
    yield from words.spans(value)
    for i in range(n):
        if value[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                c = date_cost(value[i:j])
                if c is not None:
                    yield i, j, c


def _repeats(value: str) -> Iterator[tuple[int, int, int]]:
    """(size, start, end) of the longest runs of 3 signs or more in which each sign equals the one ``size`` before, twice at least.

    All sizes up to ``BLOCK``; of longer ones those that aren't repeats themselves.
    """
    n, code = len(value), np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    for size in range(1, min(BLOCK, n // 2) + 1):
        cut = np.concatenate([[-1], np.flatnonzero(code[size:] != code[:-size]), [n - size]])
        for k in np.flatnonzero(np.diff(cut) > max(size, 2)):
            yield size, int(cut[k]) + 1, int(cut[k + 1]) + size
    if n > 2 * BLOCK:
        yield from _long_runs(code)


def _long_runs(code: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(size, start, end) of the maximal repetitions whose least period is over ``BLOCK``.

    Such a repetition contains its period once as the longest Lyndon word from some place on, in the order of the signs or in
    its reverse; so there are two candidates a place, each of which is extended to both sides.
    """
    n, found = len(code), set()
    if len(np.unique(T.ngrams(T.mix(code.astype(np.uint64)), BLOCK + 1))) == n - BLOCK:
        return
    rank = np.unique(code, return_inverse=True)[1].astype(np.int64)
    pw, inv = T.powers(n + 1)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(T.mix(code.astype(np.uint64)) * pw[:n], out=pre[1:])

    def same(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (pre[a + size] - pre[a]) * inv[a] == (pre[b + size] - pre[b]) * inv[b]

    def reach(most: np.ndarray, ok) -> np.ndarray:
        """The largest size up to ``most`` for which ``ok`` holds, as it does for all smaller ones."""
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            good = ok(mid)
            lo, hi = np.where(good, mid, lo), np.where(good, hi, mid - 1)
        return lo

    for order in (rank + 1, int(rank.max()) + 1 - rank):
        place = suffix_array(np.append(order, 0))[1][:n]
        ends, stack = np.full(n, n), []
        for i, x in enumerate(place.tolist()):
            while stack and stack[-1][0] > x:
                ends[stack.pop()[1]] = i
            stack.append((x, i))
        i = np.flatnonzero((ends - np.arange(n) > BLOCK) & (ends < n))
        j = ends[i]
        right = reach(n - j, lambda m: same(i, j, m))  # noqa: B023
        left = reach(i, lambda m: same(i - m, j - m, m))  # noqa: B023
        long = left + right >= j - i
        found |= {*zip((j - i)[long].tolist(), (i - left)[long].tolist(), (j + right)[long].tolist())}
    for size, a, e in sorted(found):
        if (code[a : e - size] == code[a + size : e]).all():
            yield size, a, e


def segments(value: str, words: Dictionary = COMMON) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of each word, date, keyboard walk and repeat in the value; brute force is left to the search.

    A run of n equal signs has n * n of them: ``guess_cost`` searches the same ones without listing them.
    """
    series, walk = _walks(value)
    bends, signs = _bends(value), alphabet(value)
    yield from _short(value, words)
    for i in range(len(value)):
        for j in range(i + 3, max(k[i] for k in series) + 1):
            yield i, j, math.log10(2 * 62 * (j - i))
        for j in range(i + 3, walk[i] + 1):
            yield i, j, walk_cost(j - i, 1 + bends[j - 2] - bends[i])
    for size, a, e in _repeats(value):
        for i in range(a, e - 2 * size + 1) if size <= BLOCK else (a,):
            for j in range(i + 2 * size, e + 1, size):
                if j - i >= 3:
                    yield i, j, _block_cost(value[i : i + size], signs, words) + math.log10((j - i) // size)


class _Cheapest:
    """The least of cost + log10(j - start) over the starts so far, for growing j.

    A start that is dearer than a later one, or has once lost to an earlier one, never wins again, so that each comes and
    goes once. ``stack`` has (start, cost, place from which the start below is cheaper).
    """

    def __init__(self) -> None:
        self.stack: list[tuple[int, float, float]] = []

    def add(self, start: int, cost: float) -> None:
        stack = self.stack
        while stack and stack[-1][1] >= cost:
            stack.pop()
        while stack:
            q = 10 ** min(300.0, cost - stack[-1][1])
            until = start + (start - stack[-1][0]) / (q - 1) if q > 1 else math.inf
            if until < stack[-1][2]:
                break
            stack.pop()
        stack.append((start, cost, until if stack else math.inf))

    def least(self, j: int) -> float:
        while self.stack[-1][2] <= j:
            self.stack.pop()
        start, cost, _ = self.stack[-1]
        return cost + math.log10(j - start)


def guess_cost(value: str, words: Dictionary = COMMON, signs: int | None = None, inner: bool = True) -> float:
    """log10 of the guesses of the cheapest segmentation of the value, of any length.

    best[j] = min over segments (i, j) of best[i] + cost + BOUNDARY; a brute-force span costs log10(alphabet) a sign, and
    one that follows another is part of it. Blocks of repeats are segmented in the same way, without repeats in them.
    Series and repeats take the least over their starts from ``_Cheapest``; walks, which get dearer with their length, are
    followed back until none can be cheaper.
    """
    n, signs = len(value), signs or alphabet(value)
    per = math.log10(signs)
    into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, c in _short(value, words):
        into[j].append((i, c))
    series, walk = _walks(value)
    bends = _bends(value)
    # (first end, last end, size, least length, log10 of what is not the number of blocks by phase, searches by phase)
    spans = [(a + 3, e, 1, 3, [math.log10(2 * 62)], [_Cheapest()]) for reach in series for a, e in _stretches(reach)]
    if inner:
        for size, a, e in _repeats(value):
            least = max(3, 2 * size)
            phases = min(size, e - a - least + 1) if size <= BLOCK else 1
            # by phase of the start; a later start of the same phase has the same block
            base = [_block_cost(value[a + k : a + k + size], signs, words) - math.log10(size) for k in range(phases)]
            spans.append((a + least, e, size, least, base, [_Cheapest() for _ in range(phases)]))
    spans.sort(key=lambda x: x[0], reverse=True)
    stretch, starts = [n] * n, set()  # the start of the walk that a place is in
    for a, e in _stretches(walk):
        starts.add(a)
        stretch[a + 2 : e] = [a] * (e - a - 2)
    live: list[tuple] = []
    best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)  # brute: with a brute-force span at the end
    low = [0.0] * (n + 1)  # the least of best up to here within a walk
    for j in range(1, n + 1):
        brute[j] = min(brute[j - 1], best[j - 1] + (BOUNDARY if j > 1 else 0)) + per
        now = min([brute[j], *(best[i] + c + (BOUNDARY if i else 0) for i, c in into[j])])
        while spans and spans[-1][0] <= j:
            live.append(spans.pop())
        if live:
            live = [x for x in live if x[1] >= j]
        for first, _, size, least, base, found in live:
            i = j - least
            phase = (j - first) % size
            if phase < len(base) and (size <= BLOCK or j == first):
                found[phase].add(i, best[i] + (BOUNDARY if i else 0))
            if phase < len(base):
                now = min(now, base[phase] + found[phase].least(j))
        a = stretch[j - 1]
        for i in range(j - 3, a - 1, -1):
            c = walk_cost(j - i, 1 + bends[j - 2] - bends[i])
            now = min(now, best[i] + c + (BOUNDARY if i else 0))
            if c + low[i] >= now:
                break
        best[j] = now
        low[j] = now if j in starts else min(now, low[j - 1])
    return best[n]


def _stretches(reach: list[int]) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of 3 signs or more of which ``reach`` has the ends."""
    i = 0
    while i < len(reach):
        if reach[i] - i >= 3:
            yield i, reach[i]
        i = reach[i]


@lru_cache(maxsize=100_000)
def _block_cost(block: str, signs: int, words: Dictionary) -> float:
    return guess_cost(block, words, signs, False)


def _before(text: str, k: int) -> int:
    """The place up to which there is only white space before ``k``, with one line break at most."""
    lines = 0
    while k and text[k - 1].isspace():
        lines += text[k - 1] == "\n"
        if lines > 1:
            break
        k -= 1
    return k


def _run(text: str, k: int) -> int:
    """The start of the letters, digits, dots, hyphens and underscores before ``k``."""
    while k and text[k - 1] in _NAME_SIGNS:
        k -= 1
    return k


def _name(text: str, k: int) -> str | None:
    """The name of a credential that ends at ``k``, if there is one."""
    a = _run(text, k)
    parts = re.split(r"[_\-.]", text[a:k])
    for i, part in enumerate(parts):
        if _PART.fullmatch(part) or (i and _KEY.fullmatch(part) and parts[i - 1].lower() in _OWNERS):
            return text[a:k]
    if _KEY.fullmatch(parts[0]) and text[a - 1 : a] == " ":  # api key
        b = _run(text, a - 1)
        if re.split(r"[_\-.]", text[b : a - 1])[-1].lower() in _OWNERS:
            return text[b:k]
    return None


def values(text: str) -> Iterator[tuple[str, int, int]]:
    """(name, start, end) of the values of credential contexts. Time is linear in the text."""
    found, done = [], 0
    for m in _SIGN.finditer(text):
        k = _before(text, m.start())
        k -= text[k - 1 : k] in ("'", '"', "`")
        if m.start() < done or not k or text[k - 1] not in _NAME_SIGNS or (name := _name(text, k)) is None:
            continue
        a = b = _LEAD.match(text, m.end()).end()
        if text[a : a + 1] in _QUOTED and (q := _QUOTED[text[a]].match(text, a + 1)):
            a, b = q.span()
        elif q := _OPEN.match(text, a + (text[a : a + 1] in _QUOTED)):
            a, b = q.span()
            while b > a and text[b - 1] in ".)]}!?:":
                b -= 1
        if b - a >= 4:
            done = b
            if text[a : a + 6].lower() != "bearer" or text[a + 6 : a + 7].strip():  # else Bearer's own rule has what follows
                found.append((name, a, b))
    for m in _BEARER.finditer(text):
        t = _TOKEN.match(text, m.end())
        if t and (any(c.isdigit() for c in t.group(1)) or _header(text, m.start())):
            a, b = t.span(1)
            found.append((m.group(), a, a + len(text[a:b].rstrip("."))))
    end = 0
    for name, a, b in sorted(found, key=lambda x: x[1:]):
        if b - a >= 4 and a >= end:
            end = b
            yield name, a, b


def _header(text: str, k: int) -> bool:
    """Whether Bearer at ``k`` is the value of an Authorization header."""
    k = _before(text, k - (text[k - 1 : k] in ("'", '"', "`")))
    if text[k - 1 : k] not in (":", "="):
        return False
    k = _before(text, k - 1)
    k -= text[k - 1 : k] in ("'", '"', "`")
    return text[max(0, k - 13) : k].lower() == "authorization"


def secrets(docs: DataFrame, live: float = LIVE, vocabularies: Iterable[str] | None = None) -> DataFrame:
    """(doc_id, name, start, end, guesses_log10, live) of each value in a credential context, in characters of the text.

    A context is Bearer and a token, or a name such as password, dbPassword, TOKEN_1 or api_key, then ``:``, ``=``, ``:=`` or ``=>``, then a value of 4
    characters or more: up to the closing quote of its line, or the white space, quote, ampersand or sign that ends it; white
    space around the sign may hold one line break. The cost is that of the cheapest segmentation of the value into dictionary
    words, dates, repeats, keyboard walks and brute-force spans; from ``live`` on it counts as a live secret. The value itself
    is not returned. Words are ``WORDS`` and those of the ``vocabularies``: files of ranks, read on the driver and sent as
    one list of some tens of thousands of words, whatever the corpus is.

    Defined cases: null and empty texts have none; a null doc_id is returned as null; repeated rows each get their rows;
    a value that is met again is reported at each place, and of equally cheap segmentations only the cost counts; values and
    texts of any length are searched whole, in time linear in the text and nearly so in the value; other columns are
    ignored; an empty table gives an empty result. One narrow pass without a shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(dictionary(vocabulary_files(spark) if vocabularies is None else vocabularies))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, names, starts, ends, costs = [], [], [], [], []
            for row in np.flatnonzero(
                np.asarray(pa.compute.fill_null(pa.compute.match_substring_regex(b.column(1), PREFILTER), False))
            ).tolist():
                text = b.column(1)[row].as_py()
                for name, a, z in values(text):
                    rows.append(row)
                    names.append(name.lower())
                    starts.append(a)
                    ends.append(z)
                    costs.append(round(guess_cost(text[a:z], sent.value), 4))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(starts, pa.int64()),
                    pa.array(ends, pa.int64()), pa.array(costs, pa.float64()), pa.array([c >= live for c in costs], pa.bool_())
                ],
                ["doc_id", "name", "start", "end", "guesses_log10", "live"],
            )

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).where("text IS NOT NULL").transform(
        T.batched, run, f"doc_id {kind}, name string, start bigint, end bigint, guesses_log10 double, live boolean"
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read(spark, sf_dir, "documents"))
