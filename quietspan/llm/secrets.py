"""Secret scans: fixed patterns, and guess-cost dynamic programming over credential values.

Base spans (kinds ``assign``, ``access``, ``hex``) come from three patterns, leftmost and not
overlapping per kind; matches that are too short are dropped. The method adds ``guess`` spans: every
value in a credential context (a key word, then ``:``, ``=``, ``is`` or ``Bearer``, then the scheme word
of a header if there is one: Bearer, Basic, Token, Digest) is segmented at least total guess cost into
words, dates, repeats, keyboard walks, sequences and brute-force spans (the usual separators are four
guesses), and values that cost at least ``MIN_LOG10_GUESSES`` are secrets. Words are ranked: some common
ones of passwords and placeholders, then the words of a vocabulary file in its order, which is read on the
driver (a fixed size) and broadcast.

Offsets are code points, end exclusive. Null text is empty. The scan is one pass per row, no
shuffle; the segmentation is linear in the value's length.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietspan.llm.rows import append_columns

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A credential's key word, a separator, the scheme of a header if there is one, its value.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|access_?key|private_?key|credentials?|authorization|bearer)["']?\x20*(?:[:=]|\x20is\x20|\x20bearer\x20|(?<=bearer)\x20)\x20*["']?(?:(?:bearer|basic|token|digest)\x20+["']?)?([^\s"'<>]{6,})""", re.I | re.A)
KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10_GUESSES = 10.0
#: Any context holds one of these, in lower case.
_KEYS = (b"pass", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"accesskey", b"access_key", b"privatekey", b"private_key", b"credential", b"authorization", b"bearer")
_HEX_TABLE = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))

# Common words of passwords and placeholders, most common first (the place in the list is the guess count).
COMMON = (
    "password 123456 qwerty admin welcome login abc123 letmein monkey dragon master hello freedom whatever secret "
    "shadow sunshine princess football baseball superman batman trustno access root user test guest default change "
    "changeme please none null true false example sample token your here value string insert placeholder dummy demo "
    "love summer winter spring autumn soccer hockey killer pepper ginger jordan michael daniel thomas charlie jessica "
    "computer internet server database system service client private public key api my the and for pass word"
).split()
_WORD_END = "</w>"
_KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, k) for r, row in enumerate(_KEYBOARD) for k, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.A)
_DATE_SIZES = (4, 8, 10)


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _charset(c: str) -> float:
    return math.log10(4 if c in "_-. /" else 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000)


def load_words(path: str) -> list[str]:
    """Whole words of three ASCII letters or more of a word-level vocabulary, most common first (its order)."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    whole = (t[: -len(_WORD_END)] for t in sorted(vocabulary, key=vocabulary.get) if t.endswith(_WORD_END))
    return [w for w in whole if len(w) > 2 and w.isascii() and w.isalpha()]


class Words:
    """Guess ranks of words: the common ones of passwords and placeholders, then those of a vocabulary."""

    def __init__(self, more: list[str] = ()):
        self.rank: dict[str, int] = {}
        for w in (*COMMON, *more):
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))


_COMMON_ONLY = Words()


def guess_cost(value: str, words: Words = _COMMON_ONLY) -> float:
    """log10 of the guesses of the cheapest segmentation.

    A segment that is not brute force costs a factor 2 more, for its bounds. Repeats, walks and sequences
    have three places or more; inside a run of one of them a segment may start anywhere, but a place that is
    reached cheapest by the run itself need not be tried, as one segment from the run's start is cheaper.
    """
    low, n, link = value.lower(), len(value), math.log10(2)
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if low[i] in "0123":
            for end in (i + size for size in _DATE_SIZES):
                if end <= n and _DATE.fullmatch(low, i, end):
                    dates.setdefault(end, []).append(i)
    best, by = [0.0] * (n + 1), [""] * (n + 1)
    starts: dict[str, list[int]] = {"repeat": [], "walk": [], "sequence": []}
    step = 0
    for i, c in enumerate(low):
        end, before = i + 1, low[i - 1] if i else ""
        last, step = step, ord(c) - ord(before) if i else 0
        going = {"repeat": c == before, "walk": bool(i) and _near(before, c), "sequence": abs(step) == 1 and step == last}
        for kind, some in starts.items():
            if not going[kind]:
                some[:] = [i - 1] if kind == "sequence" and abs(step) == 1 else []
            if by[i] != kind or not going[kind]:
                some.append(i)
        cost, how = best[i] + _charset(value[i]), "brute"
        for start in range(max(0, end - words.longest), end - 1):
            if rank := words.rank.get(low[start:end]):
                shift = 0.0 if value[start:end] == low[start:end] else math.log10(2 * (end - start))
                if (new := best[start] + math.log10(rank + 1) + shift + link) < cost:
                    cost, how = new, "word"
        for kind, one in (("repeat", _charset(value[i])), ("walk", math.log10(47 * 4)), ("sequence", math.log10(26 * 2))):
            for start in starts[kind]:
                if end - start >= 3 and (new := best[start] + one + math.log10(end - start) + link) < cost:
                    cost, how = new, kind
        for start in dates.get(end, ()):
            if (new := best[start] + math.log10(365 * 120 if end - start > 4 else 120) + link) < cost:
                cost, how = new, "date"
        best[end], by[end] = cost, how
    return best[n]


def find_spans(text: str, threshold: float = MIN_LOG10_GUESSES, words: Words = _COMMON_ONLY) -> list[tuple[int, int, int]]:
    """(start, kind index, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    values = {m.span(1) for m in CONTEXT.finditer(text)} | {m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6}
    found += [(a, 3, b) for a, b in values if guess_cost(text[a:b], words) >= threshold]
    return sorted(found)


def suspicious(raw: bytes) -> bool:
    """Whether any span is possible; cheap byte searches that settle most texts."""
    low = raw.lower()
    return b"AKIA" in raw or b"x" * 24 in raw.translate(_HEX_TABLE) or any(k in low for k in _KEYS)


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_FIELDS = T.StructType(
    [
        *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("secret_start", T.ArrayType(T.IntegerType())),
        T.StructField("secret_end", T.ArrayType(T.IntegerType())),
    ]
)
_CLEAN = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", [], [])


def _make(shared):
    words = shared.value

    def one(raw):
        if not raw or not suspicious(raw):
            return _CLEAN
        spans = find_spans(raw.decode("utf-8", "replace"), words=words)
        base = [s for s in spans if s[1] < 3]
        return (*(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(render(base).encode()).hexdigest(), render(spans), [s[0] for s in spans], [s[2] for s in spans])

    return lambda texts, _: [list(x) for x in zip(*map(one, texts))] or [[] for _ in _FIELDS]


def _make_redacted(shared, mask):
    words = shared.value

    def one(raw):
        if not raw or not suspicious(raw):
            return raw.decode("utf-8", "replace") if raw is not None else None
        text, out, at = raw.decode("utf-8", "replace"), [], 0
        for a, _, b in find_spans(text, words=words):
            if b > at:
                out += [text[at:a], mask] if a >= at else []
                at = b
        return "".join(out) + text[at:]

    return lambda texts, _: [[one(t) for t in texts]]


def _shared_words(df: DataFrame, vocabulary_path: str | None):
    return df.sparkSession.sparkContext.broadcast(Words(load_words(vocabulary_path)) if vocabulary_path else _COMMON_ONLY)


def scan_secrets(docs: DataFrame, text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """``docs`` plus n_assign, n_access, n_hex, n_guess, base_sha256, spans, secret_start, secret_end."""
    return append_columns(docs, text_col, _FIELDS, partial(_make, _shared_words(docs, vocabulary_path)))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", vocabulary_path: str | None = None) -> DataFrame:
    """``docs`` with every secret span (overlapping ones merged) replaced by ``mask``; other rows and columns stay. Null stays null."""
    made = append_columns(docs, text_col, T.StructType([T.StructField(text_col, T.StringType())]), partial(_make_redacted, _shared_words(docs, vocabulary_path), mask))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])
