"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to ``BLOCKS`` times 8 random orthonormal directions, in ``TABLES``
independent tables, scaled by ``WIDTH`` and shifted; each 8 numbers are decoded to the nearest point of
the E8 lattice, and a table's cell is its blocks' points. A vector is stored in its own cell and looks
into the ``PROBES`` neighbouring cells that it is nearest to. Vectors that meet are compared by cosine
in double precision, so no link below the threshold is ever given. With the settings below two vectors
of cosine 0.95 miss each other with a probability under 0.001 (nearer ones less).

Scale: equal vectors are one class with a count, combined before the shuffle. What is shuffled by cell is
an id, ``CODE`` further orthonormal coordinates in a byte each, and hashes of the own cells, not the
vector. The distance of two codes bounds that of the vectors from below, so a pair is dropped there only
if it cannot link; and a pair that shares an own cell of an earlier table is not given again. Vectors are
joined to the distinct pairs that are left. Cells with over ``CELL_ROWS`` stored vectors are split: those
are dealt into parts, and the visitors of the cell go to each part, so every pair still meets.

Defined results: vectors that are null, empty, zero or have null or non-finite components link with
nothing and are their own component; vectors of other lengths than their partner's do not link;
repeated rows are copies (of one id: no link with itself); rows with a null id link with nothing, have a
null component and are kept; an empty
table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietspan.llm import rolling
from quietspan.llm.components import components
from quietspan.llm.rows import discard, materialise

THRESHOLD = 0.95
TABLES = 6
BLOCKS = 2
WIDTH = 0.3
PROBES = 8
CELL_ROWS = 2048
CODE = 16
SEED = 20260101
_BLOCK = 512
#: Pairs looked at together.
_PAIRS_AT_ONCE = 1 << 20


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    odd = near.sum(1) % 2 != 0
    worst = np.abs(off).argmax(1)
    rows = np.flatnonzero(odd)
    near[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1, -1)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: E8 is D8 and D8 shifted by one half in every coordinate."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=1)
def neighbours() -> np.ndarray:
    """The 240 shortest E8 vectors."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for s in (1, -1):
                for t in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = s, t
                    out.append(v)
    half = np.array(np.meshgrid(*[[0.5, -0.5]] * 8)).reshape(8, -1).T
    return np.array(out + [v for v in half if (v < 0).sum() % 2 == 0])


@lru_cache(maxsize=16)
def _projection(dim: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, table])
    rows = min(8 * BLOCKS, dim)
    basis = np.linalg.qr(rng.normal(size=(dim, rows)))[0]
    return np.pad(basis, ((0, 0), (0, 8 * BLOCKS - rows))), rng.uniform(size=8 * BLOCKS)


def codes(unit: np.ndarray) -> np.ndarray:
    """``CODE`` orthonormal coordinates of each unit vector, in steps of 1/127."""
    dim = unit.shape[1]
    rows = min(CODE, dim)
    basis = np.linalg.qr(np.random.default_rng([SEED, dim, TABLES]).normal(size=(dim, rows)))[0]
    return np.rint(unit @ np.pad(basis, ((0, 0), (0, CODE - rows))) * 127).astype(np.int8)


def code_bound(threshold: float) -> float:
    """Greatest squared distance of the codes of two vectors that link: each coordinate is off by half a step at most."""
    return (np.sqrt(2 - 2 * threshold) * 127 + np.sqrt(CODE) + 1e-3) ** 2


def _cell_ids(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """A 64-bit id of each row of doubled (whole) coordinates, of a table and a number of dimensions."""
    x = np.full(len(points), (table + 1 + (dim << 8)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for column in np.rint(points * 2).astype(np.int64).T:
        x = (x ^ column.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return x.view(np.int64)


def cells(unit: np.ndarray, table: int, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Own cell and (n, probes) neighbouring cells of each unit vector. The scale keeps the spread of a projection whatever the dimension."""
    dim = unit.shape[1]
    basis, shift = _projection(dim, table)
    y = unit @ basis * (np.sqrt(dim / 64) / WIDTH) + shift
    own = np.concatenate([decode_e8(y[:, 8 * i : 8 * i + 8]) for i in range(BLOCKS)], 1)
    rest = y - own
    step = neighbours()
    # |rest - step|^2 - |rest|^2 = |step|^2 - 2 rest.step, and all steps are equally long
    gain = np.concatenate([rest[:, 8 * i : 8 * i + 8] @ step.T for i in range(BLOCKS)], 1)
    best = np.argpartition(-gain, probes, axis=1)[:, :probes]
    out = np.empty((len(unit), probes), np.int64)
    for k in range(probes):
        moved = own.copy().reshape(len(unit), BLOCKS, 8)
        moved[np.arange(len(unit)), best[:, k] // len(step)] += step[best[:, k] % len(step)]
        out[:, k] = _cell_ids(moved.reshape(len(unit), -1), table, dim)
    return _cell_ids(own, table, dim), out


_PREPARED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("cells", T.ArrayType(T.LongType())),
        T.StructField("code", T.BinaryType()),
    ]
)
_PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_WIDE = CODE + 4 * TABLES


def _prepare(batches):
    """Of each vector its own cells, then the neighbouring ones, table by table; its code, and a hash of each own cell."""
    for batch in batches:
        ids, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by_dim: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_dim.setdefault(len(v), []).append(i)
        for rows in by_dim.values():
            for i in range(0, len(rows), _BLOCK):
                some = rows[i : i + _BLOCK]
                unit = _unit(np.array([vectors[j] for j in some], np.float64))
                made = [cells(unit, t) for t in range(TABLES)]
                own = np.stack([home for home, _ in made], 1)
                every = np.concatenate([own] + [near for _, near in made], 1)
                homes = (rolling.mix(own.view(np.uint64)) >> np.uint64(32)).astype("<u4")
                code = np.concatenate((codes(unit).view(np.uint8), homes.view(np.uint8).reshape(len(some), -1)), 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * every.shape[1], pa.int32()), pa.array(every.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in some], pa.int64()), lists, pa.array([c.tobytes() for c in code], pa.binary())], names=_PREPARED.names)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _candidates(batches, threshold):
    """Rows (cell, part, stored, table, id, code) arrive sorted by (cell, part), the stored ones first. Pairs of a stored row with another one of its part that may link."""
    bound = code_bound(threshold)

    def pairs_of(cell, part, stored, table, ids, code):
        new = np.concatenate(([True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])))
        first = np.flatnonzero(new)
        n_stored = np.add.reduceat(stored.astype(np.int64), first)
        group = np.cumsum(new) - 1
        rows = np.flatnonzero(n_stored[group] > 0)
        times = n_stored[group[rows]]
        ends = np.cumsum(times)
        for a, b in _slices(ends):
            some, many = rows[a:b], times[a:b]
            guest = np.repeat(some, many)
            host = np.arange(len(guest)) - np.repeat(np.cumsum(many) - many, many) + first[group[guest]]
            use = (ids[host] != ids[guest]) & (~stored[guest] | (host < guest))
            host, guest = host[use], guest[use]
            x, y = code[host], code[guest]
            apart = x[:, :CODE].view(np.int8).astype(np.int32) - y[:, :CODE].view(np.int8)
            near = (apart * apart).sum(1) <= bound
            same = x[near][:, CODE:].copy().view("<u4") == y[near][:, CODE:].copy().view("<u4")
            earlier = (same & (np.arange(TABLES)[None, :] < table[guest[near]][:, None])).any(1)
            host, guest = ids[host[near][~earlier]], ids[guest[near][~earlier]]
            if len(host):
                both = np.unique(np.stack((np.minimum(host, guest), np.maximum(host, guest)), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=_PAIRS.names)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        columns.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, _WIDE))
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        cell, part, stored = columns[:3]
        last = int(np.flatnonzero((cell == cell[-1]) & (part == part[-1]))[0])
        yield from pairs_of(*[c[:last] for c in columns]) if last else ()
        held = [c[last:] for c in columns]
        kept = int(held[2].sum())
        if len(held[0]) - kept > 4 * _BLOCK * 8:  # a cell with many visitors: those so far meet the stored ones, all of which are here
            yield from pairs_of(*held)
            held = [c[:kept] for c in held]
            # Pairs among the stored ones are given again; they are made distinct later.
    if held is not None:
        yield from pairs_of(*held)


def _slices(ends: np.ndarray):
    """Ranges of rows that have about ``_PAIRS_AT_ONCE`` pairs together."""
    at = 0
    while at < len(ends):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + _PAIRS_AT_ONCE, "right")))
        yield at, to
        at = to


def _verified(batches, threshold):
    """Pairs (a, vector of a, b, vector of b) that link by cosine in double precision."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        x, y = batch.column(1), batch.column(3)
        for i in range(0, batch.num_rows, _BLOCK):
            left, right = x.slice(i, _BLOCK).to_pylist(), y.slice(i, _BLOCK).to_pylist()
            fits = np.flatnonzero([len(p) == len(q) for p, q in zip(left, right, strict=True)])
            by_dim: dict[int, list[int]] = {}
            for k in fits.tolist():
                by_dim.setdefault(len(left[k]), []).append(k)
            for some in by_dim.values():
                p, q = _unit(np.array([left[k] for k in some], np.float64)), _unit(np.array([right[k] for k in some], np.float64))
                good = np.array(some)[(p * q).sum(1) >= threshold] + i
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=_PAIRS.names)


def link_pairs(classes: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b), a < b, of classes (id, vector) with cosine of at least ``threshold``; each pair once."""
    prepared = materialise(classes.select("id", "vector").mapInArrow(_prepare, _PREPARED), "vector-cells")
    visits = prepared.select("id", "code", F.posexplode("cells").alias("pos", "cell"))
    stored = F.col("pos") < TABLES
    table = F.when(stored, F.col("pos")).otherwise(F.floor((F.col("pos") - TABLES) / PROBES).cast("int"))
    full = visits.where(stored).groupBy("cell").agg(F.count("*").alias("stored")).where(F.col("stored") > cell_rows)
    full = materialise(full.select("cell", F.ceil(F.col("stored") / F.lit(cell_rows)).cast("int").alias("parts")), "vector-full-cells")
    if full.isEmpty():
        dealt = visits.select("cell", F.lit(0).alias("part"), stored.alias("stored"), table.alias("table"), "id", "code").repartition("cell")
    else:
        spread = visits.join(full, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        home = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))) == F.col("part")
        dealt = spread.select("cell", "part", (stored & home).alias("stored"), table.alias("table"), "id", "code").repartition("cell", "part")
    ordered = dealt.sortWithinPartitions("cell", "part", F.col("stored").desc())
    pairs = materialise(ordered.mapInArrow(partial(_candidates, threshold=threshold), _PAIRS).distinct(), "vector-pairs")
    left, right = classes.select(F.col("id").alias("a"), F.col("vector").alias("va")), classes.select(F.col("id").alias("b"), F.col("vector").alias("vb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "va", "b", "vb")
    links = materialise(both.mapInArrow(partial(_verified, threshold=threshold), _PAIRS), "vector-links")
    discard(prepared, full, pairs)
    return links


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """A row per vector: id, n_links (other vectors linked directly), component_id, kept."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec"), F.when(fine & F.col(f"`{id_col}`").isNotNull(), F.transform(v, lambda x: x + F.lit(0.0))).alias("vector"))
    digest = F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")
    good = rows.where(F.col("vector").isNotNull()).select("vec", "vector", digest[0].alias("h1"), digest[1].alias("h2"))
    classes = good.groupBy("h1", "h2").agg(F.min("vec").alias("id"), F.countDistinct("vec").alias("n"), F.first("vector").alias("vector"))
    classes = materialise(classes, "vector-classes")
    pairs = link_pairs(classes, threshold)

    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = both.join(classes.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("beyond"))
    reach = components(pairs, "a", "b").select(F.col("node").alias("id"), "component")
    found = classes.drop("vector").join(beyond, "id", "left").join(reach, "id", "left")
    found = found.select("h1", "h2", (F.col("n") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    keyed = rows.select("vec", F.when(F.col("vector").isNotNull(), digest[0]).alias("h1"), F.when(F.col("vector").isNotNull(), digest[1]).alias("h2"))
    out = keyed.join(found, ["h1", "h2"], "left").select(
        F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
