"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Words are those of ``textnorm``; shingles are 5 consecutive words (a shorter text is one shingle). The
k-th occurrence of a shingle in a text is a shingle of its own (occurrence label), so a text is a
sequence of distinct labelled shingles. A sketch takes the ``ORDER`` labelled shingles of least hash and
keeps them in text order, so it agrees only where contents and order do. Texts that share one of
``SKETCHES`` sketches are candidates.

Two texts link when the alignment of their labelled shingle sequences, inside a band as wide as the
threshold allows, matches m of n1 and n2 with m / (n1 + n2 - m) >= 0.8. Classes are the connected
components; the least document id stands for a class.

How the work is dealt out. Equal word sequences are one node, counted before any shuffle. In each bucket
of a sketch every node is compared with the bucket's least node, so there are as many pairs as rows,
however large the bucket. Where some comparison in a bucket fails, the pairs among its other members are
still open, and all of them that lie in two components so far are searched: up to 2 * ``BLOCK`` members of a
bucket meet in one task, each dealt once; of more, the members of the bucket's
largest component are dealt in chunks of ``BLOCK``, the others in blocks of as many, and each block meets each
chunk and each other block. A pair is dropped only where it cannot link, by the
sizes or by the counts of its shingles in 256 bins (the L1 distance of the counts is at most the number of
shingles that do not match), or where it is taken in an earlier bucket: a pair in two components that is not
yet compared is open in every bucket that it shares, so the first of them takes it. Of the pairs left each node first verifies its nearest few, components are
joined, and a round with more of them follows, in each bucket of those members only that have a pair not yet taken there, until none is left between two components. So every pair
that shares a sketch is verified, is in one component already, or cannot link; only where very many texts
are close to each other and do not link does the number of verified pairs grow with the square. At
similarity 0.8 a pair shares 12 of 24 sketches on average; one that shares none has a probability of 6e-8.

Texts move once, and only those in some pair. All that is read again is written to the shared folder.

Defined results: null and wordless texts are alone in their class; repeated rows and equal word
sequences are one class; a null id sorts first and stands for its class as null; an empty table gives an
empty table; ties go to the least id, then the least text hash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quietspan.llm import rolling, textnorm
from quietspan.llm.components import components
from quietspan.llm.rows import append_columns, discard, materialise

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 24
ORDER = 3
BLOCK = 1024
#: Nearest open pairs that each member of a block verifies, round by round; at last all of them.
NEAREST = (2, 16, 512, None)
_ODD = np.random.default_rng(20260102).integers(0, 2**63, (2, SKETCHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled_shingles(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the labelled shingles, in text order."""
    if not text:
        return np.empty(0, np.uint64)
    start, end = textnorm.word_byte_offsets(text)
    if not len(start):
        return np.empty(0, np.uint64)
    words = rolling.parts(text.translate(textnorm.TABLE), start, end)
    n = min(SHINGLE, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = rolling.mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i], n)
    order = np.argsort(out, kind="stable")
    s = out[order]
    first = np.concatenate(([True], s[1:] != s[:-1]))
    if not first.all():
        at = np.arange(len(s))
        label = np.empty(len(s), np.uint64)
        label[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
        out = np.where(label > 0, rolling.mix(out + label * np.uint64(0xD6E8FEB86659FD93), 11), out)
    return out


def sketches(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit number for each sketch: the least ``ORDER`` shingles under its own hash, hashed in text order."""
    n = min(ORDER, len(shingles))
    chosen = np.empty((SKETCHES, n), np.uint64)
    for i in range(SKETCHES):
        rank = (shingles ^ _ODD[1, i]) * _ODD[0, i]
        rank ^= rank >> np.uint64(32)
        rank *= _ODD[0, i]
        chosen[i] = shingles[np.sort(np.argpartition(rank, n - 1)[:n])] if len(shingles) > n else shingles
    out = np.arange(SKETCHES, dtype=np.uint64)
    for column in chosen.T:
        out = rolling.mix(out ^ column, 3)
    return out


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> float:
    """m / (n1 + n2 - m) of the banded alignment of two sequences of distinct shingles; 0 as soon as it cannot reach the threshold."""
    n1, n2 = len(a), len(b)
    if not n1 or not n2 or min(n1, n2) < threshold * max(n1, n2):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    needed = threshold / (1 + threshold) * (n1 + n2)
    band = n1 + n2 - 2 * needed  # more insertions and deletions than this cannot reach the threshold
    near = np.abs(i - j) <= band + 1e-9
    i, j = i[near], j[near]
    if len(i) < needed - 1e-9:
        return 0.0
    path = j[np.argsort(i)]
    if (np.diff(path) > 0).all():
        m = len(path)
    else:  # the longest common subsequence of distinct items is the longest rising run of places
        tails: list[int] = []
        for x in path.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        m = len(tails)
    return m / (n1 + n2 - m)


def profile(shingles: np.ndarray) -> bytes:
    """Counts of the shingles by their first byte, up to 255: two sequences differ in at least as many shingles as the L1 distance."""
    return np.minimum(np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


_SKETCHED = T.StructType(
    [
        T.StructField("node", T.BinaryType()),
        T.StructField("sketches", T.ArrayType(T.LongType())),
        T.StructField("size", T.IntegerType()),
    ]
)


def _make_sketched():
    def one(text):
        words = textnorm.words(text)
        if not words:
            return None, None, None
        shingles = labelled_shingles(text)
        return hashlib.blake2b(textnorm.joined(words), digest_size=16).digest(), sketches(shingles).view(np.int64).tolist(), len(shingles)

    return lambda texts, _: [list(x) for x in zip(*map(one, texts))] or [[] for _ in _SKETCHED]


_PROFILE = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("profile", T.BinaryType()), T.StructField("buckets", T.BinaryType())])


def _make_profile():
    def one(text, buckets):
        shingles = labelled_shingles(text)
        return len(shingles), profile(shingles), np.array(buckets, np.int64).tobytes()

    return lambda texts, batch: [list(x) for x in zip(*map(one, texts, batch.column(batch.schema.get_field_index("sketched")).to_pylist()))] or [[] for _ in _PROFILE]


_VERDICT = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("linked", T.BooleanType())])


def _verify(batches, threshold):
    """Columns a, text_a, b, text_b; rows of one b come together, so its shingles are made once."""
    last, right = None, None
    for batch in batches:
        a, ta, b, tb = (c.to_pylist() for c in batch.columns)
        linked = []
        for x, y, z in zip(ta, b, tb, strict=True):
            if y != last:
                last, right = y, labelled_shingles(z)
            linked.append(aligned(labelled_shingles(x), right, threshold) >= threshold)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(linked)], names=_VERDICT.names)


_NEAR = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("left", T.LongType())])


def _nearest(batches, threshold, most):
    """Of each block pair, the ``most`` nearest pairs of each node (all if None) that may link and are in two components.

    A pair that shares several buckets is taken in the first of them only. Both ends of each pair that was not among
    the nearest follow as rows of their own: a, no b, and in left the bucket.
    """

    def made(a, b, left):
        columns = pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(left, pa.int64())
        return pa.RecordBatch.from_arrays(list(columns), names=_NEAR.names)

    for batch in batches:
        for bucket, same, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            members.sort(key=lambda m: (m["size"], m["node"]))
            size = np.array([m["size"] for m in members])
            side = np.array([m["side"] for m in members])
            count = np.frombuffer(b"".join(m["profile"] for m in members), np.uint8).reshape(-1, 256).astype(np.int16)
            buckets = np.frombuffer(b"".join(m["buckets"] for m in members), np.int64).reshape(-1, SKETCHES)
            number: dict[bytes, int] = {}
            group = np.array([number.setdefault(m["component"], len(number)) for m in members])
            x, y, far = [], [], []
            for i in range(len(members) - 1):
                end = int(np.searchsorted(size, size[i] / threshold + 1e-6, "right"))
                j = i + 1 + np.nonzero((group[i + 1 : end] != group[i]) & (same | (side[i + 1 : end] != side[i])))[0]
                if len(j):
                    apart = np.abs(count[j] - count[i]).sum(1, dtype=np.int64) / (size[j] + size[i])
                    fits = apart <= (1 - threshold) / (1 + threshold) + 1e-9  # what differs where the threshold is just reached
                    fits[fits] = buckets[i][(buckets[j[fits]] == buckets[i]).argmax(1)] == bucket
                    j = j[fits]
                    x.append(np.full(len(j), i))
                    y.append(j)
                    far.append(apart[fits])
            if not x:
                continue
            x, y, far = map(np.concatenate, (x, y, far))
            nodes = [m["node"] for m in members]
            if most is not None:
                ends, pair = np.concatenate((x, y)), np.tile(np.arange(len(x)), 2)
                order = np.lexsort((pair, far[pair], ends))
                first = np.searchsorted(ends[order], np.arange(len(members)))
                within = np.arange(len(order)) - first[ends[order]] < most
                chosen = np.zeros(len(x), bool)
                chosen[pair[order[within]]] = True
                if not chosen.all():
                    left = [nodes[i] for i in np.unique(np.concatenate((x[~chosen], y[~chosen]))).tolist()]
                    yield made(left, [None] * len(left), [bucket] * len(left))
                x, y = x[chosen], y[chosen]
            for k in range(0, len(x), 50_000):
                a, b = x[k : k + 50_000].tolist(), y[k : k + 50_000].tolist()
                both = [(max(nodes[p], nodes[q]), min(nodes[p], nodes[q])) for p, q in zip(a, b, strict=True)]
                yield made([p for p, _ in both], [q for _, q in both], [None] * len(both))


def _dealt(members: DataFrame, links: DataFrame) -> DataFrame:
    """(bucket, node, component, home, p, q, side) of ``members`` (bucket, node): those of one (bucket, home, p, q) meet, and each pair in two components of ``links`` does so once."""
    reach = components(links, "a", "b")
    named = members.join(reach, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("home"), F.sum("n").alias("n"), F.count("*").alias("components")).where("components > 1")
    mixed = mixed.select("bucket", F.col("home.component").alias("home"), F.ceil(F.col("home.n") / BLOCK).alias("chunks"), F.ceil((F.col("n") - F.col("home.n")) / BLOCK).alias("blocks"), (F.col("n") <= 2 * BLOCK).alias("whole"))
    dealt = named.join(mixed, "bucket").withColumn("at_home", F.col("component") == F.col("home"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("at_home"), F.col("chunks")).otherwise(F.col("blocks"))))
    # A bucket of few members is one block. Else the largest component's members are dealt into chunks and the others into blocks: each block meets each chunk and each block.
    zero = F.lit(0).cast("long")
    once = F.array(F.struct(F.lit(False).alias("home"), zero.alias("p"), zero.alias("q"), zero.alias("side")))
    meets = lambda n, place: F.transform(F.sequence(zero, n - 1), place)
    at_home = meets(F.col("blocks"), lambda b: F.struct(F.lit(True).alias("home"), F.col("own").alias("p"), b.alias("q"), zero.alias("side")))
    met = F.when(F.col("whole"), once).when(F.col("at_home"), at_home).otherwise(
        F.concat(
            meets(F.col("chunks"), lambda c: F.struct(F.lit(True).alias("home"), c.alias("p"), F.col("own").alias("q"), F.lit(1).cast("long").alias("side"))),
            meets(F.col("blocks"), lambda b: F.struct(F.lit(False).alias("home"), F.least("own", b).alias("p"), F.greatest("own", b).alias("q"), F.col("own").alias("side"))),
        )
    )
    return dealt.select("bucket", "node", "component", F.explode(met).alias("met")).select("bucket", "node", "component", "met.*")


def _open_pairs(members: DataFrame, profiles: DataFrame, links: DataFrame, threshold: float, most: int | None) -> DataFrame:
    """(a, b, left) of the pairs of each bucket of ``members`` (bucket, node) that are in two components of ``links`` and may link.

    Rows without b: a has pairs in the bucket ``left`` that are not among them.
    """
    dealt = _dealt(members, links).join(profiles, "node")
    blocks = dealt.groupBy("bucket", "home", "p", "q").agg(F.collect_list(F.struct("node", "component", "side", "size", "profile", "buckets")).alias("members"))
    return blocks.select("bucket", (~F.col("home") & (F.col("p") == F.col("q"))).alias("same"), "members").mapInArrow(partial(_nearest, threshold=threshold, most=most), _NEAR)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` plus class_id (least id of its class) and stays (true for one row of each class)."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    found = materialise(append_columns(rows, "text", _SKETCHED, _make_sketched, text_too=False), "neardup-sketches")
    wordy = found.where(F.col("node").isNotNull())
    nodes = wordy.groupBy("node").agg(F.min(F.struct("id", "th")).alias("row"), *(F.first(c).alias(c) for c in ("sketches", "size")))
    nodes = materialise(nodes, "neardup-nodes")

    of_sketches = F.transform("sketches", lambda sketch, i: F.xxhash64(i, sketch))
    bucket = nodes.select(F.explode(of_sketches).alias("bucket"), "node")
    least = bucket.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("bucket", "least")
    met = materialise(bucket.join(least, "bucket").where("node <> least"), "neardup-met")
    pairs = materialise(met.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "neardup-pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = asked.join(nodes.select("node", F.col("row.id").alias("nid"), F.col("row.th").alias("th")), "node")
    texts = rows.join(asked, "th").where(F.col("id").eqNullSafe(F.col("nid")))
    texts = materialise(texts.groupBy("node").agg(F.first(F.encode("text", "utf-8")).alias("text")), "neardup-texts")

    def verified(pairs):
        both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b")
        new = both.sortWithinPartitions("b").select("a", "ta", "b", "tb").mapInArrow(partial(_verify, threshold=threshold), _VERDICT)
        return materialise(new, "neardup-verdicts")

    judged = verified(pairs)
    # Where a comparison with the least node failed, the others of the bucket are still to be compared with each other.
    against = met.join(judged.withColumnsRenamed({"a": "node", "b": "least"}), ["node", "least"])
    failed = against.groupBy("bucket").agg(F.min("linked").alias("all"), F.count("*").alias("n")).where("not all and n > 1").select("bucket")
    members = materialise(met.join(failed, "bucket").select("bucket", "node"), "neardup-open")
    discard(pairs, met)
    if not members.isEmpty():
        open_texts = texts.join(members.select("node").distinct(), "node").join(nodes.select("node", of_sketches.alias("sketched")), "node")
        profiles = materialise(append_columns(open_texts, "text", _PROFILE, _make_profile, text_too=False).select("node", *_PROFILE.names), "neardup-profiles")
        for most in NEAREST:
            near = materialise(_open_pairs(members, profiles, judged.where("linked"), threshold, most), "neardup-near")
            new = verified(near.where("b is not null").select("a", "b").distinct().join(judged, ["a", "b"], "left_anti"))
            judged = judged.unionByName(new)
            # Whoever has no pair left in a bucket is done there.
            left = materialise(near.where("b is null").select(F.col("left").alias("bucket"), F.col("a").alias("node")).distinct(), "neardup-open")
            discard(near, members)
            members = left
            if members.isEmpty():
                break
        discard(profiles)
    discard(texts, members)

    reach = components(judged.where("linked"), "a", "b")
    discard(judged)
    grouped = nodes.select("node", "row").join(reach, "node", "left").select("node", "row", F.coalesce("component", "node").alias("component"))
    stand = grouped.groupBy("component").agg(F.min("row").alias("stand"))
    by_node = grouped.join(stand, "component").select(F.col("node"), "stand")
    # Rows are told apart by id and text hash; only where rows repeat wholly does one of them have to be picked.
    verdict = found.select("id", "th", "node").groupBy("id", "th").agg(F.first("node").alias("node"), F.count("*").alias("__copies")).join(by_node, "node", "left")
    stands = F.col("stand.id").eqNullSafe(F.col("id")) & (F.col("stand.th") == F.col("th"))
    verdict = verdict.select(
        F.col("id").alias("__id"),
        F.col("th").alias("__th"),
        F.when(F.col("stand").isNull(), F.col("id")).otherwise(F.col("stand.id")).alias("class_id"),
        (F.col("stand").isNull() | stands).alias("stays"),
        (F.col("stand").isNotNull() & stands & (F.col("__copies") > 1)).alias("__pick"),
    )
    verdict = materialise(verdict, "neardup-verdict")
    discard(found, nodes)
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("class_id", "stays")])
    keyed = base.withColumns({"__row": F.col(f"`{id_col}`"), "__hash": F.xxhash64(text)})
    out = keyed.join(verdict, (F.col("__hash") == F.col("__th")) & F.col("__row").eqNullSafe(F.col("__id")))
    result = [*base.columns, "class_id", "stays"]
    if not verdict.where("__pick").isEmpty():
        number = F.row_number().over(Window.partitionBy("__row", "__hash").orderBy(F.lit(1)))
        picked = out.where("__pick").withColumn("__n", number).withColumn("stays", F.col("__n") == 1).drop("__n")
        out = out.where("not __pick").unionByName(picked)
    return out.select(*[F.col(f"`{c}`") for c in result])
