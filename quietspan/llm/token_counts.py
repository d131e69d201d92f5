"""Word-piece token counts by a linear longest-match automaton.

A trie over the vocabulary gets failure links, each with the number of pieces that greedy longest
match has settled by the time the link is taken. A word is then one walk: no piece is built, no
symbol is looked at twice.

A symbol is a byte, or a word's last byte marked as such, so that a vocabulary entry with a word end
matches at the end of a word only. Text is put in NFC, lower-cased and cut by the vocabulary's own pattern;
white space separates words and counts nothing. Every single symbol must be an entry, so no word
fails.

Scale: row-wise, no shuffle; the vocabulary (a fixed file, read on the driver) is broadcast; a task
keeps the counts of at most ``CACHE_WORDS`` distinct chunks.

Defined results: null and blank texts have no words and no tokens; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache, partial

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quietspan.llm.bpe import _Shared
from quietspan.llm.rows import append_columns

CACHE_WORDS = 300_000
END = "</w>"
_CONTROL = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_vocabulary(path: str, end: str = END) -> tuple[list[tuple[int, ...]], str]:
    """Entries as symbol tuples (a last byte of a word is 256 + byte) and the word pattern. Special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec["added_tokens"]}
    letters, entries = byte_alphabet(), []
    for token in spec["model"]["vocab"]:
        if token not in special:
            final = token.endswith(end)
            body = [letters[c] for c in (token[: -len(end)] if final else token)]
            entries.append((*body[:-1], body[-1] + 256 * final))
    parts = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
    return entries, next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split")


class Automaton:
    """``step``: child of (node, symbol); ``fail`` and ``popped``: where a node without that child goes on, and how many pieces are settled there."""

    def __init__(self, entries: list[tuple[int, ...]]):
        step: dict[int, int] = {}
        depth_order, entry = [(0, 0, 0)], [False]
        for e in entries:
            node = 0
            for s in e:
                key = node << 9 | s
                if key not in step:
                    step[key] = len(entry)
                    entry.append(False)
                    depth_order.append((node, s, len(entry) - 1))
                node = step[key]
            entry[node] = True
        level = [0] * len(entry)
        for parent, _, node in depth_order[1:]:
            level[node] = level[parent] + 1
        fail, popped = [-1] * len(entry), [0] * len(entry)
        for parent, s, node in sorted(depth_order[1:], key=lambda x: level[x[2]]):
            if entry[node]:
                fail[node], popped[node] = 0, 1
                continue
            to, count = fail[parent], popped[parent]
            while to != -1 and (to << 9 | s) not in step:
                count += popped[to]
                to = fail[to]
            if to != -1:
                fail[node], popped[node] = step[to << 9 | s], count
        self.step, self.fail, self.popped = step, fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match segmentation of a word."""
        step, fail, popped = self.step, self.fail, self.popped
        node = total = 0
        last = len(word) - 1
        for i, b in enumerate(word):
            s = b if i < last else b + 256
            while (to := step.get(node << 9 | s)) is None:
                if node == 0:
                    raise ValueError("a symbol is not in the vocabulary")
                total += popped[node]
                node = fail[node]
            node = to
        while node:
            total += popped[node]
            node = fail[node]
        return total


class Counter:
    def __init__(self, entries, pattern: str):
        import regex

        self.automaton = Automaton(entries)
        self.pattern = regex.compile(pattern)
        self.chunks: dict[str, tuple[int, int]] = {}

    def chunk(self, chunk: str) -> tuple[int, int]:
        found = self.pattern.findall(chunk)
        return len(found), sum(self.automaton.count(w.encode()) for w in found)

    def count(self, text: str) -> tuple[int, int]:
        """(words, tokens). Words never cross white space, so chunks between it are counted once each."""
        if len(self.chunks) > CACHE_WORDS:
            self.chunks.clear()
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        text = text.lower()
        if _CONTROL.search(text):  # marks for the pattern, white space for split()
            return self.chunk(text)
        known, chunks = self.chunks, text.split()
        for c in set(chunks):
            if c not in known:
                known[c] = self.chunk(c)
        counts = [known[c] for c in chunks]
        return sum(a for a, _ in counts), sum(b for _, b in counts)


@lru_cache(maxsize=1)
def _counter(key: str, shared) -> Counter:
    return Counter(*shared())


_FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])


def _make(shared):
    counter = _counter(shared.key, shared)
    return lambda texts, _: [list(x) for x in zip(*[counter.count(t or "") for t in texts])] or [[], []]


def count_tokens(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` plus n_words and n_tokens."""
    entries, pattern = load_vocabulary(vocabulary_path)
    key = hashlib.sha256(repr((entries, pattern)).encode()).hexdigest()
    shared = _Shared(docs.sparkSession.sparkContext.broadcast((entries, pattern)), key)
    return append_columns(docs, text_col, _FIELDS, partial(_make, shared), binary=False)
