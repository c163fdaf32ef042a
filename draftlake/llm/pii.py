"""PII: a skip-chain conditional random field over the tokens of a document that may be personal data."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from . import textops as T
from .store import read

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN", "PERSON")
#: Message passing ends when no log message changes by more than this; ``ROUNDS`` only ends one that would never settle.
SETTLED, ROUNDS = 1e-4, 1000
#: Edges and tokens that are worked on at once.
_SLICE = 1 << 16
#: Synthetic documents that the field is trained on.
TRAIN_DOCS = 600
#: A token that has none of these signs can be a name only.
CANDIDATE = r"[0-9@]"
_TITLES = (
    r"(?:Mr|Mrs|Ms|Dr|Prof|Herrn?|Frau|Señora?|Sra|Monsieur|Madame|Mme|Mlle)\.?|[Nn]ame|[Nn]ombre|[Nn]om|[Nn]ame is|me "
    r"llamo|m'appelle|heiße"
)
#: What names follow; by itself it tells little, as a name it must be that of a person by all its mentions.
_TITLE = re.compile(rf"(?<![^\W_])(?:{_TITLES})(?: ?[:=])?\s+(?=[^\W\d_a-zß-ÿ])")
_NAME = re.compile(r"([^\W\d_a-zß-ÿ][^\W\d_]*(?:['’\-][^\W\d_]+)*)(?:[ \t]+(?=[^\W\d_a-zß-ÿ]))?")
_LETTERS = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
#: For RE2, and wider: only texts in which it finds something are labelled.
PREFILTER = rf"[0-9@]|(?:{_TITLES})(?: ?[:=])?\s"
#: Pieces of a text between white space and punctuation; dates, times, numbers with commas and area codes keep theirs.
_PIECE = re.compile(
    r"(?<![\w:/,.])(?:\d{1,2}/\d{1,2}/\d{2,4}(?![\w/])|\d{1,2}:\d{2}(?::\d{2})?(?![\w:])|\d{1,3}(?:,\d{3})+(?:\.\d+)?(?![\w,\-]))"
    r"|(?:\+?\d{1,3}[-.])?\(\d{3}\)[-.]?\d{3}[-.]\d{4}(?!\w)|\(\d{2,5}\)|[^\s\"'`|*#<>\[\]{}^=;,&?!~:/\\()$…«»“”‘’]+"
)
#: What is an item of its own within a piece: no letter, digit or further group of digits touches it.
_ITEM = re.compile(
    r"(?<![\w.%+\-])[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,}"
    r"|(?<![^\W_])(?<!\d[-.])(?:\d{4}(?:-\d{4}){3}|\d{3}-\d{2}-\d{4}|\+?(?:\d{1,3}[-.])?\d{3}[-.]?\d{3}[-.]\d{4}|\d{1,3}(?:\.\d{1,3}){3}|\+?\d{10,19})(?![^\W_])(?![-.]\d)"
)
_GROUPED_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ \-][A-Z0-9]{4}){2,7}(?:[ \-][A-Z0-9]{1,3})?(?!\w)")
_GROUPED_CARD = re.compile(r"(?<![\w\-])(?<!\d[ .,])\d{4}([ \-])\d{4}\1\d{4}\1\d{4}(?!\w)(?![ \-.,]\d)")
_GROUPED_PHONE = re.compile(r"(?<!\w)\+\d{1,3}[ .\-]?(?:\(\d{2,5}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\d{1,8}(?:[ .\-]\d{2,8}){1,5})(?!\w)")
_EDGE = "!?.,;:\"'`|*#$%&<>[]{}~^=…«»“”‘’"
_CUES = {
    "tel": "phone", "telephone": "phone", "phone": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "cell": "phone",
    "telefon": "phone", "teléfono": "phone", "téléphone": "phone",
    "email": "mail", "e-mail": "mail", "mail": "mail", "contact": "mail", "card": "card", "visa": "card", "mastercard": "card",
    "credit": "card", "kreditkarte": "card", "carte": "card", "tarjeta": "card",
    "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "ssn": "ssn", "social": "ssn", "iban": "iban", "account": "iban",
    "konto": "iban",
    "version": "version", "v": "version", "release": "version", "section": "version", "page": "number", "room": "number", "order": "number",
    "invoice": "number", "item": "number", "id": "number", "isbn": "number", "usd": "number", "eur": "number", "about": "number",
    "than": "number",
}
_SHAPES = {
    "mail": r"[a-z0-9._%+\-]+@[a-z0-9\-]+(\.[a-z0-9\-]+)*\.[a-z]{2,}", "at": r".*@.*", "handle": r"@\w+",
    "ip": r"(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}", "dotted4": r"\d+(\.\d+){3}", "dotted": r"v?\d+(\.\d+)+",
    "digits16": r"\d{16}", "digits1519": r"\d{15}|\d{17,19}", "card_groups": r"\d{4}([- ]\d{4}){3}", "four": r"\d{4}",
    "digits10": r"\d{10}|\d{11}", "short": r"\d{1,3}", "digits59": r"\d{5,9}", "digits1214": r"\d{12,14}", "long": r"\d{20,}",
    "intl": r"\+\d{1,3}", "area": r"\(\d{2,5}\)", "local": r"\d{3}-\d{4}", "phone": r"(\+?\d{1,3}[-.])?\(?\d{3}\)?[-.]?\d{3}[-.]\d{4}",
    "intl_full": r"\+\d{7,15}", "ssn": r"\d{3}-\d{2}-\d{4}", "iban": r"[a-z]{2}\d{2}[a-z0-9]{11,30}",
    "date": r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}\.\d{1,2}\.\d{4}", "time": r"\d{1,2}:\d{2}(:\d{2})?",
    "money": r"[$€£]\d.*|\d+(,\d{3})+(\.\d+)?", "decimal": r"\d+[.,]\d+", "hex": r"(?=.*[a-f])(?=.*\d)[0-9a-f]{12,}",
    "mixed": r"(?=.*[a-z])(?=.*\d)[a-z0-9_\-]+", "ratio": r"\d+[-/]\d+",
}
_TESTS = [(k, re.compile(v)) for k, v in _SHAPES.items()]
FEATURES = (
    "bias", *_SHAPES, "luhn", "mod97", "capital", "common", "title", *(f"cue_{c}" for c in sorted({*_CUES.values()})),
    *(f"{side}_{k}" for side in ("before", "after") for k in ("intl", "area", "local", "four"))
)
_AT = {k: i for i, k in enumerate(FEATURES)}


class Field(NamedTuple):
    """Log potentials: of a feature with a label, of neighbours, of equal tokens and of similar ones."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    near: np.ndarray


class Graph(NamedTuple):
    """Features (0 or 1) of the candidates, edges of the three kinds, and the document of each candidate."""

    x: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    near: np.ndarray
    of: np.ndarray


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2]) % 10 == sum(sum(divmod(2 * x, 10)) for x in d[1::2]) * 9 % 10


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


@lru_cache(maxsize=50_000)
def shapes(token: str) -> tuple[str, ...]:
    low = token.lower()
    if _GROUPED_IBAN.fullmatch(token):
        low = re.sub(r"[ -]", "", low)
    elif token[0] == "+" and _GROUPED_PHONE.fullmatch(token):
        low = "+" + re.sub(r"\D", "", token)
    out = [k for k, p in _TESTS if p.fullmatch(low)]
    if "card_groups" in out and _years(token):
        out.remove("card_groups")
    if token[0].isupper() and _LETTERS.fullmatch(token):
        out.append("capital")
    digits = re.sub(r"[- ]", "", token)
    if digits.isascii() and digits.isdigit() and 13 <= len(digits) <= 19 and luhn(digits):
        out.append("luhn")
    if "iban" in out and low.isascii() and mod97(low):
        out.append("mod97")
    return tuple(out)


def _cue(text: str, a: int) -> str:
    """The word before a place, however far; of one with underscores the last part that is a cue."""
    letter = lambda c: c.isalnum() or c in "_-"
    while a and not letter(text[a - 1]):
        a -= 1
    z = a
    while a and letter(text[a - 1]):
        a -= 1
    word = text[a:z].strip("-_").lower()
    return next((w for w in reversed(word.split("_")) if w in _CUES), word)


def _years(token: str) -> bool:
    """Whether four groups of four digits are rather years than a card."""
    return all(1900 <= int(x) < 2100 for x in re.split("[- ]", token)) and not luhn(re.sub(r"\D", "", token))


def _grouped(text: str) -> list[tuple[int, int]]:
    """(start, end) of the numbers that are written in groups: IBANs, as many groups as agree with the check digits, cards, and phone
    numbers with a country, of up to 12 digits. None overlaps another.
    """
    out = [m.span() for m in _GROUPED_CARD.finditer(text) if not _years(m.group())]
    for m in _GROUPED_IBAN.finditer(text):
        ends = [k for k in range(m.start() + 15, m.end() + 1) if k == m.end() or text[k] in " -"]
        for z in reversed(ends):
            plain = re.sub(r"[ -]", "", text[m.start() : z])
            if 15 <= len(plain) <= 34 and mod97(plain):
                out.append((m.start(), z))
                break
    for m in _GROUPED_PHONE.finditer(text):
        ends = [k for k in range(m.start() + 1, m.end() + 1) if text[k - 1].isdigit() and (k == m.end() or text[k] in " .-")]
        fit = [z for z in ends if 8 <= sum(c.isdigit() for c in text[m.start() : z]) <= 12]
        if fit:
            out.append((m.start(), fit[-1]))
    out.sort()
    return [x for i, x in enumerate(out) if not i or x[0] >= max(y[1] for y in out[max(0, i - 3) : i])]


def _parts(piece: str) -> list[tuple[int, int]]:
    """(start, end) of the items in a piece and of what is left between them."""
    out, at = [], 0
    for m in _ITEM.finditer(piece):
        out += [(at, m.start()), m.span()]
        at = m.end()
    return [(a, b) for a, b in [*out, (at, len(piece))] if a < b]


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, token, what it follows) of the words that follow a title, four at most, and of all mentions of the same words."""
    after: dict[int, str] = {}
    for m in _TITLE.finditer(text):
        at = m.end()
        for k in range(4):
            n = _NAME.match(text, at)
            if not n:
                break
            after.setdefault(n.start(1), "" if k else "title")
            if n.end() == n.end(1):
                break
            at = n.end()
    if not after:
        return []
    known = {link(_LETTERS.match(text, a).group()) for a in after}
    return [
        (m.start(), m.end(), m.group(), after.get(m.start(), ""))
        for m in _LETTERS.finditer(text) if m.start() in after or link(m.group()) in known
    ]


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, token, word before) of the tokens that may be personal data, without the signs around them.

    Brackets, quotes and separators end a token, so that what is glued to a name, or stands in JSON, CSV or a URL, is one.
    Names of persons are looked for after titles and the like; then each mention of such a word is one.
    """
    spans, taken, at = [], _grouped(text), 0
    for m in _PIECE.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and m.end() > taken[at][0]:
            if not spans or spans[-1] != taken[at]:
                spans.append(taken[at])
            continue
        if re.search(CANDIDATE, m.group()):
            spans += [(m.start() + a, m.start() + b) for a, b in (_parts(m.group()) if m.group()[0] != "(" else [(0, len(m.group()))])]
    out = []
    for a, b in spans:
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if re.search(CANDIDATE, text[a:b]):
            out.append((a, b, text[a:b], _cue(text, a)))
    names = _names(text)
    if not names:
        return out
    free = [x for x in names if (k := bisect.bisect_right(out, (x[1],))) == 0 or out[k - 1][1] <= x[0]]
    return sorted(out + free)


def link(token: str) -> str:
    """Tokens that agree in this are linked across the document: equal but for case and signs."""
    return re.sub(r"[\W_]+", "", token.lower())


def stem(token: str) -> str | None:
    """Tokens that agree in this are similar: mail of one domain, addresses of one net, numbers of one form and beginning."""
    if "@" in token[1:]:
        return token[token.rindex("@") :].lower()
    if token.count(".") == 3 and token.replace(".", "").isdigit():
        return token[: token.rindex(".") + 1]
    digits = re.sub(r"\D", "", token)
    return re.sub(r"\d", "0", token.lower()) + digits[:6] if len(digits) >= 7 else None


def graph(docs: list[tuple[str, list[tuple[int, int, str, str]]]]) -> Graph:
    """The field's graph over the candidates of some documents.

    Chain edges are between candidates with only white space and signs between them. Each token is linked to the first one of
    the document that is equal, by a skip edge, and to the first similar one that isn't, by another: whatever one mention
    tells reaches all others in two steps. A pair has one edge at most, a chain edge before a skip edge.
    """
    total = sum(len(c) for _, c in docs)
    x = np.zeros((total, len(FEATURES)), np.uint8)
    x[:, 0] = 1
    chain, skip, near, of = [], [], [], np.zeros(total, np.int64)
    k = 0
    for d, (text, found) in enumerate(docs):
        # words that the document has in lower case too
        lower = {w for w in {t for *_, t, _ in found} if w[0].isupper() and _LETTERS.fullmatch(w)}
        small = {t for *_, t, _ in found if t.islower()}
        lower = {w for w in lower if w.lower() in small}
        first: dict[str, int] = {}
        alike: dict[str, tuple[int, str]] = {}
        for i, (a, b, token, before) in enumerate(found):
            for s in shapes(token):
                x[k, _AT[s]] = 1
            if before in _CUES:
                x[k, _AT[f"cue_{_CUES[before]}"]] = 1
            if before == "title" and token[0].isupper():
                x[k, _AT["title"]] = 1
            if token in lower:
                x[k, _AT["common"]] = 1
            of[k] = d
            joined = bool(i) and not any(c.isalnum() for c in text[found[i - 1][1] : a])
            if joined:
                chain.append((k - 1, k))
                for s in ("intl", "area", "local", "four"):
                    if s in shapes(found[i - 1][2]):
                        x[k, _AT[f"before_{s}"]] = 1
                    if s in shapes(token):
                        x[k - 1, _AT[f"after_{s}"]] = 1
            same, kin = link(token), stem(token)
            at = first.setdefault(same, k)
            if at != k and not (joined and at == k - 1):
                skip.append((at, k))
            if kin is not None:
                at, other = alike.setdefault(kin, (k, same))
                if other != same and not (joined and at == k - 1):
                    near.append((at, k))
            k += 1
    return Graph(x, *(np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip, near)), of)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def messages(field: Field, g: Graph, rounds: int = ROUNDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """(marginals of the tokens, of the edges of each kind) by loopy sum-product message passing.

    All messages of a round are sent at once, half of the old message is kept, until none changes any more. On trees that is
    exact; with loops it is the usual approximation.
    """
    own = np.concatenate(
        [g.x[i : i + _SLICE].astype(float) @ field.unary for i in range(0, len(g.x), _SLICE)]
    ) if len(g.x) else np.zeros((0, len(LABELS)))
    kinds = [(e, pot) for e, pot in ((g.chain, field.chain), (g.skip, field.skip), (g.near, field.near))]
    sent = [(np.zeros((len(e), len(LABELS))), np.zeros((len(e), len(LABELS)))) for e, _ in kinds]

    def belief() -> np.ndarray:
        b = own.copy()
        for (e, _), (fwd, bwd) in zip(kinds, sent):
            np.add.at(b, e[:, 1], fwd)
            np.add.at(b, e[:, 0], bwd)
        return b

    for _ in range(rounds if any(len(e) for e, _ in kinds) else 0):
        b, moved = belief(), 0.0
        for (e, pot), (fwd, bwd) in zip(kinds, sent):
            for i in range(0, len(e), _SLICE):
                u, v, f, w = e[i : i + _SLICE, 0], e[i : i + _SLICE, 1], fwd[i : i + _SLICE], bwd[i : i + _SLICE]
                to = _lse((b[u] - w)[:, :, None] + pot, 1)
                back = _lse((b[v] - f)[:, None, :] + pot, 2)
                for old, new in ((f, to), (w, back)):
                    new -= _lse(new, 1)[:, None]
                    new -= old
                    moved = max(moved, float(np.abs(new).max()))
                    old += 0.5 * new
        if moved < SETTLED:
            break
    b = belief()
    node = np.exp(b - _lse(b, 1)[:, None])
    pairs = []
    for (e, pot), (fwd, bwd) in zip(kinds, sent):
        both = (b[e[:, 0]] - bwd)[:, :, None] + (b[e[:, 1]] - fwd)[:, None, :] + pot
        pairs.append(np.exp(both - _lse(both.reshape(len(e), -1), 1)[:, None, None]) if len(e) else both)
    return node, pairs


def _synthetic(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans with labels): invented sentences with personal data and with other numbers, some of them repeated."""
    r = np.random.default_rng(seed)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(r.choice(letters, r.integers(2, 9)))
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda *a: a[r.integers(len(a))]

    def card() -> str:
        s = str(r.integers(2, 7)) + num(14)  # some are mistyped: the last digit isn't the check digit
        s = next(s + c for c in "0123456789" if luhn(s + c)) if r.random() < 0.6 else s + num(1)
        return pick(s, s, f"{s[:4]} {s[4:8]} {s[8:12]} {s[12:]}", "-".join((s[:4], s[4:8], s[8:12], s[12:])))

    def iban() -> str:
        body = num(18)
        s = f"DE{98 - int(body + '131400') % 97:02d}{body}"
        return pick(s, s, " ".join(s[i : i + 4] for i in range(0, len(s), 4)))

    cap = lambda: word().capitalize()
    title = lambda: pick(
        "Mr.", "Mrs", "Dr.", "Prof.", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "Name:", "name is", "nombre:", "nom:"
    )

    ip = lambda: ".".join(str(x) for x in r.integers(1, 255, 4))
    makers = {
        "EMAIL": (
            lambda: f"{word()}{pick('', '.', '_')}{pick('', num(2))}@{word()}{pick('', num(1))}.{pick('com', 'org', 'example.com', 'de')}",
            ("email", "mail", "contact", "")
        ),
        "PHONE": (
            lambda: pick(
                f"+{r.integers(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}",
                f"+{r.integers(1, 9)}{num(10)}", f"{num(3)}.{num(3)}.{num(4)}", f"+{r.integers(20, 99)} {num(3)} {num(3)} {num(3)}",
                f"+{r.integers(20, 99)} {num(2)} {num(4)} {num(4)}"
            ),
            ("tel", "phone", "call", "mobile", "")
        ),
        "IP": (ip, ("ip", "server", "host", "")),
        "CARD": (card, ("card", "visa", "credit", "")),
        "SSN": (lambda: f"{num(3)}-{num(2)}-{num(4)}", ("ssn", "social", "")),
        "IBAN": (iban, ("iban", "account", "")),
        "O": (
            lambda: pick(
                num(1), num(2), num(3), num(4), num(4), f"{r.integers(1990, 2030)}-{r.integers(10, 13)}-{r.integers(10, 29)}",
                f"{r.integers(1, 12)}/{r.integers(1, 29)}/{r.integers(1990, 2030)}", f"{r.integers(0, 24)}:{r.integers(10, 60)}",
                f"${num(3)}.{num(2)}", f"{num(2)},{num(3)}", f"{num(1)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(1)}",
                f"{num(1)}.{num(1)}.{num(1)}.{num(1)}{num(3)}", f"{word()}{num(2)}", "".join(r.choice(list("0123456789abcdef"), 40)),
                num(int(r.integers(5, 10))), num(int(r.integers(12, 15))), num(int(r.integers(20, 30))), f"@{word()}", f"{num(2)}%",
                f"{num(2)}-{num(2)}", " ".join(str(r.integers(1900, 2030)) for _ in range(r.integers(2, 7))),
                ", ".join(str(r.integers(1900, 2030)) for _ in range(r.integers(2, 7)))
            ),
            ("version", "page", "order", "invoice", "about", "room", "", ""),
        ),
    }

    def similar(s: str) -> str:
        """Another of the same kind: of one mail domain, one net, one beginning."""
        if "@" in s[1:]:
            return f"{word()}{s[s.rindex('@') :]}"
        if s.count(".") == 3 and s.replace(".", "").isdigit():
            return f"{s[: s.rindex('.') + 1]}{r.integers(1, 255)}"
        return "".join(str(r.integers(0, 10)) if c.isdigit() and k >= len(s) - 2 else c for k, c in enumerate(s))

    out = []
    for _ in range(n):
        parts, spans, made, at = [], [], [], 0

        def put(s: str) -> int:
            nonlocal at
            parts.append(s)
            start, at = at, at + len(s) + 1
            return start

        people, plain = [], []
        for _ in range(r.integers(2, 9)):
            for _ in range(r.integers(1, 6)):
                put(word())
            form = r.random()
            if form < 0.12:  # a person, by full name after a title
                put(title())
                name = [cap() for _ in range(r.integers(1, 4))]
                start = put(" ".join(name) + pick("", ".", ","))
                spans.append((start, start + len(" ".join(name)), "PERSON"))
                people += name
            elif form < 0.3 and people:  # one of them again
                name = pick(*people)
                start = put(name + pick("", ".", ","))
                spans.append((start, start + len(name), "PERSON"))
            elif form < 0.38:  # a common word after a title, which the text has in lower case too
                name = word()
                put(title())
                put(name.capitalize())
                put(word())
                put(name)
                plain.append(name)
            elif form < 0.45 and plain:
                put(pick(*plain))
            if made and r.random() < 0.45:
                label, s, cue = *made[r.integers(len(made))], ""
                if r.random() < 0.3:
                    s = similar(s)
                    if label in ("CARD", "IBAN") or (label == "O" and s.count(".") == 3):
                        continue
            else:
                label = pick("EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN", "O", "O", "O", "O", "O")
                make, cues = makers[label]
                s, cue = make(), pick(*cues)
                made.append((label, s))
            form = r.random()
            if form < 0.35:  # glued, bracketed, JSON, CSV and URL
                name = cue or word()
                before, after = pick(
                    (f"{name}:", ""), (f"{name}=", ";"), ("(", ")"), ("[", "],"), (f'{{"{name}":"', '"}'), (f"{word()},", f",{word()}"),
                    (f"{word()}://{word()}/{word()}?{name}=", f"&{word()}")
                )
                start = put(before + s + after) + len(before)
            else:
                if cue:
                    put(cue + pick("", ":"))
                start = put(s + pick("", "", ".", ",", "!!"))
            spans.append((start, start + len(s), label))
        out.append((" ".join(parts), spans))
    return out


def fit(n_docs: int = TRAIN_DOCS, seed: int = 7, steps: int = 120, penalty: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps; the expected counts are those of loopy message passing."""
    made = _synthetic(n_docs, seed)
    docs = [(t, candidates(t)) for t, _ in made]
    g = graph(docs)
    x = g.x.astype(float)
    y = np.concatenate(
        [[next((LABELS.index(lb) for a, b, lb in spans if a <= s < b), 0) for s, *_ in found] for (_, found), (_, spans) in zip(docs, made)]
    ).astype(np.int64)
    hot = np.eye(len(LABELS))[y]
    theta = [np.zeros((len(FEATURES), len(LABELS))), *(np.zeros((len(LABELS),) * 2) for _ in range(3))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    seen = [x.T @ hot, *(hot[e[:, 0]].T @ hot[e[:, 1]] for e in (g.chain, g.skip, g.near))]
    for t in range(1, steps + 1):
        node, pairs = messages(Field(*theta), g, 12)  # the gradient need not be as exact as the labels
        want = [x.T @ node, *(p.sum(axis=0) for p in pairs)]
        for k in range(4):
            d = (want[k] - seen[k]) / len(x) + penalty * theta[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.99 * second[k] + 0.01 * d * d
            theta[k] = theta[k] - 0.15 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return Field(*theta)


@lru_cache(maxsize=1)
def trained() -> Field:
    return fit()


def entities(field: Field, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, label, probability) of the entities of each text; the parts of a number are one."""
    docs = [(t, candidates(t)) for t in texts]
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in docs]
    if not any(c for _, c in docs):
        return out
    g = graph(docs)
    of = g.of
    node, _ = messages(field, g)
    best = node.argmax(axis=1)
    joined = {int(b): int(a) for a, b in g.chain}
    flat = [c for _, found in docs for c in found]
    for k in np.flatnonzero(best):
        a, b, *_ = flat[k]
        got, label = out[of[k]], LABELS[best[k]]
        text = docs[of[k]][0]
        if k in joined and got and best[joined[k]] == best[k] and got[-1][1] == flat[k - 1][1] and text[got[-1][1] : a].isspace() and _continues(
            label, flat[k - 1][2], flat[k][2]
        ):
            got[-1] = (got[-1][0], b, label, min(got[-1][3], float(node[k, best[k]])))
        else:
            got.append((a, b, label, float(node[k, best[k]])))
    return out


def _continues(label: str, before: str, token: str) -> bool:
    """Whether two tokens next to each other are parts of one number."""
    x, y = shapes(before), shapes(token)
    if label == "PERSON":
        return True
    if label == "CARD":
        return "four" in x and "four" in y
    return label == "PHONE" and not {"local", "phone", "intl_full"} & {*x} and "intl" not in y


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, label, probability) of each piece of personal data, in characters of the text.

    Labels: EMAIL, PHONE, IP, CARD, SSN, IBAN, PERSON. A conditional random field labels the tokens with a digit or an at sign, and
    words that follow a title (Mr, Frau, Señora, name: and the like) somewhere in the document, at each of their mentions (all
    others have none of these labels for sure, so that the chain falls apart at them and inference need not visit them).
    Neighbours share a chain potential; equal tokens of a document (but for case and signs), however far apart, share a skip
    potential, and so do similar ones (``stem``); loopy message passing over the whole document, until it settles, gives the
    marginals, and the likeliest label is taken. The field is trained on ``TRAIN_DOCS`` synthetic documents.

    Defined cases: null and empty texts have none; a null doc_id is returned as null; repeated rows each get their rows;
    of equally likely labels the first of ``LABELS`` is taken; texts of any length are labelled whole, in time linear in them;
    other columns are ignored; an empty table gives an empty result. One narrow pass.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            at = np.flatnonzero(np.asarray(pa.compute.fill_null(pa.compute.match_substring_regex(b.column(1), PREFILTER), False)))
            for lo in range(0, len(at), 256):
                part = at[lo : lo + 256]
                for k, got in zip(part.tolist(), entities(sent.value, b.column(1).take(pa.array(part)).to_pylist())):
                    rows += [k] * len(got)
                    found += got
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), *cols], ["doc_id", "start", "end", "label", "probability"]
            )

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).where("text IS NOT NULL").transform(
        T.batched, run, f"doc_id {kind}, start bigint, end bigint, label string, probability double"
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))
