"""Exact removal of long repeated byte strings, by truncated suffix arrays.

A byte is repeated when a string of ``length`` bytes that covers it also starts elsewhere, in the same
document or another. ``keep="none"`` removes all copies; ``keep="first"`` keeps the first one, in the
order of document id and place.

How the work is dealt out. Each window of ``length`` bytes has an anchor, the least hash of its
``GRAM``-byte strings, which depends on its content only; neighbouring windows with one anchor form a
run (about one per 170 bytes). Equal windows have equal anchors, so all comparing happens among runs
of one anchor:

1. Runs are grouped by anchor and content hash, counts only, combined before the shuffle. Equal runs
   (copies of whole passages, however many) are settled here: no text moves.
2. Of the rest, one run per distinct content whose anchor occurs with other contents is cut out of its
   text, and the runs of an anchor meet in one task, which builds a suffix array over them, truncated
   at ``length``. Within equal prefixes positions ascend, so the previous (next) smaller position in
   suffix order is the neighbouring entry: it is there exactly where the longest previous (next)
   factor reaches ``length``.
3. Anchors with over ``HOT`` distinct contents (a passage that a large part of all documents quote, each
   with other text around it) would meet in one task without bound. Their windows are hashed instead:
   chunks of ``CHUNK`` runs list their distinct window hashes by bucket, buckets find the ones that
   occur twice, and report them to the chunks that have them.

Texts are shuffled twice (to cut runs out, and to apply the spans), the rest is a few numbers per run.
Every intermediate that is read again is written to the shared folder.

Window and run hashes have 64 bits next to the 64-bit anchor. Defined results: null is the empty text;
texts shorter than ``length`` lose nothing; repeated rows are copies of each other; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietspan.llm import rolling
from quietspan.llm.rows import append_columns, materialise

LENGTH = 400
GRAM = 64
HOT = 64
CHUNK = 1024
BATCH_BYTES = 1 << 21


def _sliding(x: np.ndarray, width: int, pick, fill) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, in two passes over blocks."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, fill, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    behind = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(text: bytes, length: int = LENGTH, gram: int = GRAM):
    """anchor, content hash, first and last window start, whether the anchor occurs again in the text; arrays by run."""
    doublings = min(gram, length).bit_length() - 1
    n, width = len(text) - length + 1, length - (1 << doublings) + 1
    if n <= 0:
        return None
    grams = rolling.grams(np.frombuffer(text, np.uint8), doublings)
    least = _sliding(grams, width, np.minimum, np.iinfo(np.uint64).max)
    # A gram is some window's least exactly when the greatest least of the windows around it is itself.
    around = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    chosen = grams[_sliding(around, width, np.maximum, np.uint64(0)) == grams]
    values, counts = np.unique(chosen, return_counts=True)
    lo = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    hi = np.concatenate((lo[1:] - 1, [n - 1]))
    again = counts[np.searchsorted(values, least[lo])] > 1
    return least[lo].view(np.int64), rolling.parts(text, lo, hi + length).view(np.int64), lo, hi, again


def window_classes(segments: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Truncated suffix order of all window starts: (position, whether an earlier equal window exists, whether a later one does).

    Positions are places in the segments joined together; only windows inside one segment count.
    """
    text = np.frombuffer(b"".join(segments), np.uint8)
    size = np.array([len(s) for s in segments], np.int64)
    ends = np.repeat(np.cumsum(size), size)
    starts = np.flatnonzero(ends - np.arange(len(text)) >= length)
    if not len(starts):
        return starts, np.empty(0, bool), np.empty(0, bool)
    rank, have = text.astype(np.int64), 1
    while have < length:  # prefix doubling; the last step overlaps so that exactly ``length`` bytes count
        step = min(have, length - have)
        shifted = np.concatenate((rank[step:], np.full(step, -1, np.int64)))
        rank = np.unique(rank * (rank.max() + 2) + shifted + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    rank = rank[starts]
    order = np.argsort(rank, kind="stable")  # suffix order; positions ascend among equal prefixes
    same = rank[order][1:] == rank[order][:-1]
    return starts[order], np.concatenate(([False], same)), np.concatenate((same, [False]))


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


_RUNS = T.StructType(
    [
        T.StructField("k1", T.LongType()),
        T.StructField("k2", T.LongType()),
        T.StructField("doc", T.LongType()),
        T.StructField("anchor", T.LongType()),
        T.StructField("content", T.LongType()),
        T.StructField("lo", T.LongType()),
        T.StructField("hi", T.LongType()),
        T.StructField("again", T.BooleanType()),
    ]
)
_SEGMENTS = T.StructType([*_RUNS.fields[:4], T.StructField("lo", T.LongType()), T.StructField("segment", T.BinaryType()), T.StructField("hot", T.BooleanType())])
_FLAGS = T.StructType([_RUNS["k1"], _RUNS["k2"], _RUNS["lo"], _RUNS["hi"]])


def _arrow(schema: T.StructType, cols: list) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(cols, schema.fields, strict=True)], names=schema.names)


def _emit_runs(batches, length):
    for batch in batches:
        k1, k2, doc = (batch.column(i).to_pylist() for i in range(3))
        texts = batch.column(3).to_pylist()
        for i in range(0, len(texts), 256):
            parts = [(j, r) for j in range(i, min(i + 256, len(texts))) if (r := runs(texts[j], length)) is not None]
            if parts:
                n = [len(r[0]) for _, r in parts]
                owner = [np.repeat(np.array([x[j] for j, _ in parts], np.int64), n) for x in (k1, k2, doc)]
                yield _arrow(_RUNS, owner + [np.concatenate([r[c] for _, r in parts]) for c in range(5)])


def _cut(batches, length):
    for batch in batches:
        k1, k2, doc, texts, wanted = (c.to_pylist() for c in batch.columns)
        rows = [(a, b, d, w["anchor"], w["lo"], t[w["lo"] : w["hi"] + length], w["hot"]) for a, b, d, t, some in zip(k1, k2, doc, texts, wanted, strict=True) for w in some]
        for i in range(0, len(rows), 2048):
            yield _arrow(_SEGMENTS, list(zip(*rows[i : i + 2048])))


def _suffix_flags(batches, length, keep):
    """Rows arrive with those of an anchor together. Batches end between anchors."""

    def settle(rows):
        rows = sorted({(r[2], r[0], r[1], r[4], r[5]) for r in rows})  # order of document and place; repeated rows once
        segments = [r[4] for r in rows]
        position, earlier, later = window_classes(segments, length)
        flags = np.zeros(sum(map(len, segments)), bool)
        flags[position] = earlier if keep == "first" else earlier | later
        out, at = [], 0
        for _, a, b, lo, s in rows:
            for x, y in zip(*_intervals(flags[at : at + len(s)])):
                out.append((a, b, lo + int(x), lo + int(y)))
            at += len(s)
        return _arrow(_FLAGS, list(zip(*out)) or [[] for _ in _FLAGS])

    held, size, anchor = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True):
            if row[3] != anchor and size >= BATCH_BYTES:
                yield settle(held)
                held, size = [], 0
            anchor = row[3]
            held.append(row)
            size += len(row[5])
    if held:
        yield settle(held)


def _window_hashes(segment: bytes, length: int) -> np.ndarray:
    sums = rolling.prefix(np.frombuffer(segment, np.uint8))
    at = np.arange(len(segment) - length + 1)
    return rolling.mix(rolling.spans(sums, at, at + length), 7).view(np.int64)


def _bucket_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.IntegerType()) for c in ("bucket", "chunk")] + [T.StructField(c, T.BinaryType()) for c in ("hashes", "several", "doc", "k1", "place")])


def _chunk_hashes(pdf: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    """Distinct window hashes of a chunk by bucket, whether each occurs several times, and its first occurrence."""
    pdf = pdf.drop_duplicates(["k1", "k2", "lo"]).sort_values(["doc", "k1", "lo"])
    made = [_window_hashes(s, length) for s in pdf["segment"]]
    n = [len(m) for m in made]
    hashes = np.concatenate(made)
    owner = np.repeat(np.arange(len(n)), n)
    place = pdf["lo"].to_numpy()[owner] + np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
    values, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    bucket = (values.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
    doc, k1 = pdf["doc"].to_numpy()[owner[first]], pdf["k1"].to_numpy()[owner[first]]
    chunk, rows = int(pdf["chunk"].iloc[0]), []
    for b in np.unique(bucket):
        s = bucket == b
        rows.append((int(b), chunk, values[s].tobytes(), (counts[s] > 1).tobytes(), doc[s].tobytes(), k1[s].tobytes(), place[first][s].tobytes()))
    return pd.DataFrame(rows, columns=_bucket_schema().names)


def _bucket_repeats(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, its hashes that occur twice anywhere, with the first occurrence of each."""
    read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in pdf[c]])
    hashes, several = read("hashes", np.int64), read("several", bool)
    doc, k1, place = (read(c, np.int64) for c in ("doc", "k1", "place"))
    chunk = np.repeat(pdf["chunk"].to_numpy(), [len(x) // 8 for x in pdf["hashes"]])
    order = np.lexsort((place, k1, doc, hashes))
    h = hashes[order]
    start = np.concatenate(([True], h[1:] != h[:-1]))
    group = np.cumsum(start) - 1
    first = order[np.flatnonzero(start)][group]
    repeated = (np.bincount(group)[group] > 1) | (np.bincount(group, weights=several[order])[group] > 0)
    rows = []
    for c in np.unique(chunk[order][repeated]):
        s = repeated & (chunk[order] == c)
        rows.append((0, int(c), h[s].tobytes(), b"", doc[first[s]].tobytes(), k1[first[s]].tobytes(), place[first[s]].tobytes()))
    return pd.DataFrame(rows, columns=_bucket_schema().names)


def _chunk_flags(segments: pd.DataFrame, found: pd.DataFrame, length: int, keep: str) -> pd.DataFrame:
    read = lambda c: np.concatenate([np.frombuffer(x, np.int64) for x in found[c]]) if len(found) else np.empty(0, np.int64)
    hashes = read("hashes")
    order = np.argsort(hashes)
    hashes, doc, k1, place = hashes[order], *(read(c)[order] for c in ("doc", "k1", "place"))
    rows = []
    for s in segments.drop_duplicates(["k1", "k2", "lo"]).itertuples() if len(hashes) else ():
        own = _window_hashes(s.segment, length)
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        hit = hashes[at] == own
        if keep == "first":
            hit &= ~((doc[at] == s.doc) & (k1[at] == s.k1) & (place[at] == s.lo + np.arange(len(own))))
        rows += [(s.k1, s.k2, s.lo + int(x), s.lo + int(y)) for x, y in zip(*_intervals(hit))]
    return pd.DataFrame(rows, columns=_FLAGS.names)


_RESULT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("removed_start", T.ArrayType(T.LongType())),
        T.StructField("removed_end", T.ArrayType(T.LongType())),
    ]
)


def merge(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Removed byte intervals of windows lo..hi, merged where they touch."""
    if not len(lo):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(lo, kind="stable")
    start, end = lo[order], np.maximum.accumulate(hi[order] + length)
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(end) - 1]))]


def _make_result(length):
    def run(texts, batch):
        out = []
        for text, spans in zip(texts, batch.column("__spans").to_pylist(), strict=True):
            text = text or b""
            lo, hi = (np.array([s[c] for s in spans or ()], np.int64) for c in ("lo", "hi"))
            start, end = merge(lo, hi, length)
            kept = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)]))
            out.append((len(text), len(text) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), start.tolist(), end.tolist()))
        return [list(x) for x in zip(*out)] or [[] for _ in _RESULT]

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: str = "none", hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """``docs`` plus n_bytes, n_removed, n_spans, kept_sha256, removed_start, removed_end (byte intervals)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key1, key2 = F.xxhash64(F.col(f"`{id_col}`"), text), F.xxhash64(F.lit(1), text, F.col(f"`{id_col}`"))
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))
    keyed = docs.select("*", key1.alias("__k1"), key2.alias("__k2"))
    long = docs.where(F.octet_length(text) >= length).select(key1.alias("k1"), key2.alias("k2"), doc.alias("doc"), F.encode(text, "utf-8").alias("bytes"))

    found = materialise(long.mapInArrow(partial(_emit_runs, length=length), _RUNS), "repeat-runs")
    groups = found.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.min(F.struct("doc", "k1", "k2", "lo", "hi")).alias("first"))
    contents = groups.groupBy("anchor").agg(F.count("*").alias("contents"))
    equal = found.join(groups.where("n > 1").select("anchor", "content", "first"), ["anchor", "content"])
    if keep == "first":
        equal = equal.where(~((F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2")) & (F.col("first.lo") == F.col("lo"))))
    flags = equal.select("k1", "k2", "lo", "hi")

    # A content that occurs once and is its anchor's only one has equals nowhere but in itself.
    open_ = groups.join(contents, "anchor").where((F.col("contents") > 1) | F.col("again"))
    wanted = open_.groupBy("first.k1", "first.k2").agg(F.collect_list(F.struct("anchor", F.col("first.lo").alias("lo"), F.col("first.hi").alias("hi"), (F.col("contents") > hot).alias("hot"))).alias("wanted"))
    cut = long.join(wanted, ["k1", "k2"]).select("k1", "k2", "doc", "bytes", "wanted").mapInArrow(partial(_cut, length=length), _SEGMENTS)
    segments = materialise(cut, "repeat-segments")
    cold = segments.where("not hot").repartition("anchor").sortWithinPartitions("anchor", "k1", "lo")
    flags = flags.unionByName(cold.mapInArrow(partial(_suffix_flags, length=length, keep=keep), _FLAGS))
    if n_hot := segments.where("hot").count():
        chunks = -(-n_hot // chunk)
        dealt = segments.where("hot").withColumn("chunk", F.pmod(F.xxhash64("k1", "lo"), F.lit(chunks)).cast("int"))
        listed = dealt.groupBy("chunk").applyInPandas(lambda pdf: _chunk_hashes(pdf, length, chunks), _bucket_schema())
        repeated = listed.groupBy("bucket").applyInPandas(_bucket_repeats, _bucket_schema())
        hot_flags = dealt.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInPandas(lambda a, b: _chunk_flags(a, b, length, keep), _FLAGS)
        flags = flags.unionByName(hot_flags)

    spans = flags.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("__spans"))
    placed = keyed.join(spans.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), ["__k1", "__k2"], "left")
    return append_columns(placed, text_col, _RESULT, partial(_make_result, length)).drop("__k1", "__k2", "__spans")
