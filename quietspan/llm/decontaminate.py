"""Benchmark decontamination by one Aho-Corasick automaton.

The normalised windows of all benchmark items (10 consecutive words; a shorter item is one window) form
one automaton over words, each written as its number in the benchmark, and each document is scanned
once. Matches are mapped back to word indices and to code-point spans of the original text.

Scale: documents are never shuffled; each task holds the automaton. Distinct
windows are counted first: up to ``block_windows`` they are one automaton and one pass. A larger benchmark
is dealt into blocks of that many windows; each block is a job of its own that writes the hits it finds
to the shared folder, so that a Python worker holds one automaton at a time and the driver one block of
windows, and the hits of all blocks are joined to the documents at the end. No hit is lost.

Defined results: null or wordless documents have no words and no hits; null or wordless items have
no windows; equal items each count; a null item_id counts as the empty string; an empty benchmark
leaves all documents clean; repeated documents give repeated rows.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietspan.llm import textnorm
from quietspan.llm.rows import append_columns, discard, materialise

WINDOW = 10
#: Windows of one automaton; it takes about 1 kB for each.
BLOCK_WINDOWS = 300_000
#: Kinds of symbols that words are written in: a node has few children, so a step is short.
_SYMBOLS = 64

_HITS = T.StructType(
    [
        T.StructField("hit_lo", T.ArrayType(T.IntegerType())),
        T.StructField("hit_hi", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_STATE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        *_HITS.fields[:2],
        T.StructField("hit_start", T.ArrayType(T.LongType())),
        T.StructField("hit_end", T.ArrayType(T.LongType())),
        _HITS["items"],
    ]
)
_WINDOWS = T.StructType([T.StructField("item", T.StringType()), T.StructField("window", T.BinaryType())])


def windows(text: bytes | None, size: int = WINDOW) -> list[bytes]:
    """The windows of an item, words with one space between."""
    w = textnorm.words(text)
    return [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def _item_windows(batches, size):
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            some = sorted(set(windows((text or "").encode(), size)))
            yield pa.RecordBatch.from_arrays([pa.array([item or ""] * len(some), pa.string()), pa.array(some, pa.binary())], names=_WINDOWS.names)


class Automaton:
    """Over (window, item ids) pairs. A word is its number, written in as many symbols as all numbers need."""

    def __init__(self, owners: list[tuple[bytes, list[str]]]):
        import ahocorasick

        words = sorted({w for window, _ in owners for w in window.split(b" ")})
        self.width = 1
        while _SYMBOLS**self.width <= len(words):
            self.width += 1
        self.code = {w: "".join(chr(n // _SYMBOLS**k % _SYMBOLS) for k in range(self.width)) for n, w in enumerate(words, 1)}
        self.auto = ahocorasick.Automaton()
        for window, ids in owners:
            parts = window.split(b" ")
            self.auto.add_word("".join([self.code[w] for w in parts]), (len(parts), tuple(ids)))
        if owners:
            self.auto.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """First word and end of each occurrence, and the items that occur. A word that no window has is number 0."""
        lo, hi, items = [], [], set()
        if self.code and words:
            get, none, width = self.code.get, "\0" * self.width, self.width
            for last, (n, ids) in self.auto.iter("".join([get(w, none) for w in words])):
                end, off = divmod(last + 1, width)
                if not off:  # else symbols of two words look like a word
                    lo.append(end - n)
                    hi.append(end)
                    items.update(ids)
        return lo, hi, items


def merged(text: bytes | None, words: list[bytes], lo: list[int], hi: list[int], items: set[str]) -> tuple[int, list, list, list, list, list]:
    """n_words, then the word intervals that occurrences cover, the same as code points, and the items."""
    if not lo:
        return len(words), [], [], [], [], []
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    hit = np.concatenate(([0], np.cumsum(edge)[:-1] > 0, [0])).astype(np.int8)
    first, end = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    starts, ends = textnorm.word_byte_offsets(text)
    points = textnorm.code_points_before(text)
    return len(words), first.tolist(), end.tolist(), points[starts[first]].tolist(), points[ends[end - 1]].tolist(), sorted(items)


def _make_state(shared):
    auto = Automaton(shared.value)

    def one(text):
        words = textnorm.words(text)
        return merged(text, words, *auto.hits(words))

    return lambda texts, _: [list(x) for x in zip(*map(one, texts))] or [[] for _ in _STATE]


def _make_hits(shared):
    auto = Automaton(shared.value)

    def one(text):
        lo, hi, items = auto.hits(textnorm.words(text))
        return lo, hi, sorted(items)

    return lambda texts, _: [list(x) for x in zip(*map(one, texts))] or [[] for _ in _HITS]


def _make_joined():
    def one(text, lo, hi, items):
        return merged(text, textnorm.words(text), lo or [], hi or [], set(items or ()))

    return lambda texts, batch: [list(x) for x in zip(*map(one, texts, *(batch.column(f"__{c}").to_pylist() for c in _HITS.names)))] or [[] for _ in _STATE]


def _block(owners: DataFrame) -> list[tuple[bytes, list[str]]]:
    return [(bytes(r.window), r.ids) for r in owners.toLocalIterator()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` plus n_words, hit_lo/hit_hi (merged word intervals), hit_start/hit_end (the same as code points), items, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    pairs = items.mapInArrow(partial(_item_windows, size=window), _WINDOWS)
    owners = materialise(pairs.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("ids")), "benchmark-windows")
    blocks = max(1, -(-owners.count() // block_windows))
    if blocks == 1:
        out = append_columns(docs, text_col, _STATE, partial(_make_state, spark.sparkContext.broadcast(_block(owners))))
    else:
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        keys = F.xxhash64(text), F.xxhash64(F.lit(1), text)
        texts = docs.select(text.alias("text"), keys[0].alias("__k1"), keys[1].alias("__k2"))
        found = []
        for b in range(blocks):
            shared = spark.sparkContext.broadcast(_block(owners.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)))
            hits = append_columns(texts, "text", _HITS, partial(_make_hits, shared)).where("size(hit_lo) > 0")
            found.append(materialise(hits.select("__k1", "__k2", *_HITS.names).dropDuplicates(["__k1", "__k2"]), "benchmark-hits"))
            shared.destroy()
        hits = found[0]
        for more in found[1:]:
            hits = hits.unionByName(more)
        hits = hits.groupBy("__k1", "__k2").agg(*(F.flatten(F.collect_list(c)).alias(f"__{c}") for c in _HITS.names))
        placed = docs.withColumns({"__k1": keys[0], "__k2": keys[1]}).join(hits, ["__k1", "__k2"], "left")
        out = append_columns(placed, text_col, _STATE, _make_joined).drop("__k1", "__k2", *(f"__{c}" for c in _HITS.names))
    discard(owners)
    hit = F.aggregate(F.zip_with("hit_hi", "hit_lo", lambda a, c: (a - c).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.withColumns(
        {
            "n_hit": hit,
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join(F.array_sort("items"), ","), 256),
            "contaminated": F.size("hit_lo") > 0,
        }
    )
