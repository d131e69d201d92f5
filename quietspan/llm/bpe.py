"""Byte-level BPE encoding and decoding by recursive DuckDB queries per partition.

Each text is cut by the tokenizer's pattern. The distinct pieces a task has not met yet become rows
(piece, ids, ranks of neighbours); a step of a recursive query contracts each piece's leftmost pair of
least rank and joins the new token's two neighbours with the merge table, until no piece has a pair left.
Decoding joins ids, ``ABREAST`` neighbours to a row, with the vocabulary and aggregates their bytes in order.

Words of over ``WINDOW`` bytes (unspaced scripts, runs) are encoded in overlapping windows. Where the tokens of two neighbours share one in the overlap, left tokens up to it
and right tokens after it join: ids are the encoding of their bytes exactly when each two neighbours
are the encoding of theirs, and in both windows they are. Windows that share no token (periodic text) are
encoded again as one, up to ``JOINED`` bytes; beyond that the right one starts anew at a token of the left
one. Windows are token-position rows, and a step contracts all places of the least rank, left to right without overlap: the leftmost
one, then the next, as no merge makes a pair of its own rank or a lower one; so a run of n equal bytes
takes log n steps.

Scale: row-wise, no shuffle; the vocabulary (a fixed file, read on the driver) is broadcast. A task
keeps at most ``CACHE_ENTRIES`` encoded chunks; pieces go to DuckDB in blocks of ``BLOCK_BYTES``,
tokens to the decoder in blocks of ``BLOCK_TOKENS``, so memory is bounded whatever the texts are.

Defined results: null is the empty text (no ids, no bytes); repeated rows give repeated rows; an
empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quietspan.llm import rolling
from quietspan.llm.rows import append_columns

CACHE_ENTRIES = 300_000
#: Token places of all steps of one recursion.
BLOCK_ROWS = 1 << 21
BLOCK_TOKENS = 1 << 18
#: Neighbouring tokens that are decoded in one row.
ABREAST = 4
BLOCK_CHARS = 1 << 21
BLOCK_TEXTS = 1024
WINDOW, OVERLAP, JOINED = 256, 64, 1 << 16
#: Unicode White_Space, which the pattern's \s stands for.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: State: a word's ids with -1 at both ends, the rank of each pair of neighbours (null: none) and the least one; a word without any is done.
_ENCODE = """
WITH RECURSIVE state(piece, ids, ranks, least) AS (
  SELECT piece, ids, ranks, list_min(ranks) FROM words
  UNION ALL
  SELECT piece, ids, ranks, list_min(ranks)
  FROM (
    SELECT s.piece, list_concat(s.ids[1:s.p - 1], [s.least], s.ids[s.p + 2:]) AS ids,
      list_concat(s.ranks[1:s.p - 2], [l.rank, r.rank], s.ranks[s.p + 2:]) AS ranks
    FROM (SELECT *, list_position(ranks, least) AS p FROM state WHERE least IS NOT NULL) s
    LEFT JOIN merges l ON l.l = s.ids[s.p - 1] AND l.r = s.least
    LEFT JOIN merges r ON r.l = s.least AND r.r = s.ids[s.p + 2]
  )
)
SELECT piece, ids FROM state WHERE least IS NULL ORDER BY piece
"""
_EVERY = """SELECT step, piece, pos, k, id, same AND (rn - coalesce(max(CASE WHEN NOT same THEN rn END) OVER (ORDER BY pos), 0)) % 2 = 1 AS take
    FROM (SELECT s.*, coalesce(s.k >> 32 = g.least >> 32, false) AS same, row_number() OVER (ORDER BY pos) AS rn
      FROM state s JOIN least g USING (piece))"""
#: State: k is the rank of the pair that starts at a row, then its place; a word without any k is done. Ends after {steps} steps.
_ENCODE_WINDOWS = """
WITH RECURSIVE state(step, piece, pos, id, k) AS (
  SELECT 0, t.piece, t.pos, t.id, (m.rank::BIGINT << 32) | t.pos
  FROM (SELECT piece, pos, id, CASE WHEN lead(piece) OVER w = piece THEN lead(id) OVER w END AS nxt
        FROM tokens WINDOW w AS (ORDER BY pos)) t
  LEFT JOIN merges m ON m.l = t.id AND m.r = t.nxt
  UNION ALL
  SELECT c.step, c.piece, c.pos, c.id, (m.rank::BIGINT << 32) | c.pos
  FROM (
    SELECT step + 1 AS step, piece, pos, merged AS id, CASE WHEN beyond = piece THEN nxt END AS nxt
    FROM (
      SELECT step, piece, pos, merged, coalesce(lag(take) OVER w, false) AS gone,
        CASE WHEN take THEN lead(merged, 2) OVER w ELSE lead(merged) OVER w END AS nxt,
        CASE WHEN take THEN lead(piece, 2) OVER w ELSE lead(piece) OVER w END AS beyond
      FROM (
        WITH least AS (SELECT piece, min(k) AS least FROM state WHERE step < {steps} GROUP BY piece HAVING min(k) IS NOT NULL)
        SELECT step, piece, pos, take, CASE WHEN take THEN k >> 32 ELSE id END AS merged FROM ({every}))
      WINDOW w AS (ORDER BY pos)
    )
    WHERE NOT gone
  ) c
  LEFT JOIN merges m ON m.l = c.id AND m.r = c.nxt
)
SELECT piece, id, max(k) OVER () IS NULL AS done FROM state
JOIN (SELECT piece, max(step) AS step FROM state GROUP BY piece) USING (piece, step)
ORDER BY pos
"""
#: Bytes are characters of their numbers here.
_DECODE = f"""
SELECT t.doc, string_agg(concat({", ".join(f"v{i}.bytes" for i in range(ABREAST))}), '' ORDER BY t.pos) AS bytes
FROM ids t {" ".join(f"LEFT JOIN vocabulary v{i} ON v{i}.id = t.id{i}" for i in range(ABREAST))}
GROUP BY t.doc ORDER BY t.doc
"""


def load_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f) if a]


#: Byte classes of plain texts: gaps (the space, and the zero byte between texts), letters, digits, other marks, line feeds; 4 is not plain.
_CLASS = bytes(0 if b in b" \0" else 5 if b == 10 else 4 if b < 32 or b == 127 or b == 0xC2 or b > 0xC3 else 1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256))
_NOT_PLAIN = re.compile(rb"\xc3[\x97\xb7]|'[stmdrlv]|\0")


class Recent:
    """A bounded table: when ``limit`` new entries are in, those not used since the last time are dropped."""

    def __init__(self, limit: int = CACHE_ENTRIES):
        self.now: dict = {}
        self.past: dict = {}
        self.limit = limit

    def turn(self) -> None:
        if len(self.now) > self.limit:
            self.now, self.past = {}, self.now

    def unknown(self, keys) -> set:
        """Of distinct keys those it does not have; all others are in ``now`` then."""
        now, past = self.now, self.past
        keys = {k for k in keys if k not in now}
        now.update((k, past[k]) for k in keys if k in past)
        return {k for k in keys if k not in past}


def single_spaced(text: str) -> bool:
    """Whether single spaces and line feeds are the only white space, none at the ends: every space then starts a piece."""
    return not (text[0].isspace() or text[-1].isspace() or "  " in text or "\n " in text or " \n" in text or "\n\n" in text) and len(text.split()) == text.count(" ") + text.count("\n") + 1


class Coder:
    """A vocabulary and its merge table in DuckDB, with the chunks encoded so far."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        import duckdb
        import regex

        self.ranks = dict(ranks)
        spaced = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.pattern = regex.compile(spaced)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        #: Ranks of two neighbouring bytes, -1 where they do not merge.
        self.two = np.full(1 << 16, -1, np.int32)
        for t, r in ranks:
            if len(t) == 2:
                self.two[t[0] << 8 | t[1]] = r
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in ranks for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = np.array(pairs, np.int32).reshape(-1, 3).T
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self._table("merges", pa.table({"l": left, "r": right, "rank": rank}))
        self._table("vocabulary", pa.table({"id": pa.array([r for _, r in ranks], pa.int32()), "bytes": [t.decode("latin-1") for t, _ in ranks]}))
        self.plain, self.spaced, self.pieces, self.raw = Recent(), Recent(), Recent(), Recent()
        self.size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.size[list(self.ranks.values())] = list(map(len, self.ranks))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, name: str, rows: pa.Table, query: str) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _contract(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each word, a row each."""
        raw, n = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))
        end, word, place = np.cumsum(n), np.repeat(np.arange(len(n)), n), np.arange(len(raw))
        ids, ranks = np.full(len(raw) + 2 * len(n), -1, np.int32), np.full(len(raw) + len(n), -1, np.int32)
        ids[place + 2 * word + 1] = self.bytes[raw]
        pair = self.two[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        pair[end[:-1] - 1] = -1
        ranks[(place + word + 1)[:-1]] = pair
        lists = lambda end, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], end)), pa.int32()), values)
        count = np.arange(1, len(n) + 1)
        words = {"piece": count.astype(np.int32), "ids": lists(end + 2 * count, pa.array(ids)), "ranks": lists(end + count, pa.array(ranks, mask=ranks < 0))}
        out = self._query("words", pa.table(words), _ENCODE)["ids"].combine_chunks()
        size = np.diff(out.offsets.to_numpy()) - 2
        found = out.flatten().to_numpy()
        codes, cut = found[found >= 0].astype("<u4").tobytes(), (4 * np.concatenate(([0], np.cumsum(size)))).tolist()
        return [codes[a:b] for a, b in zip(cut, cut[1:])]

    def _contract_windows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, all places of the least rank in a step. Where its rows would be too many, its last state feeds the next query."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        piece, ids = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(p) for p in pieces]), self.bytes[raw]
        while True:
            tokens = pa.table({"piece": piece, "pos": np.arange(len(ids)), "id": ids})
            out = self._query("tokens", tokens, _ENCODE_WINDOWS.format(every=_EVERY, steps=max(2, 2 * BLOCK_ROWS // max(len(ids), 1))))
            piece, ids = out["piece"].to_numpy(), out["id"].to_numpy().astype(np.int32)
            if not len(ids) or out["done"][0].as_py():
                cut = np.searchsorted(piece, np.arange(len(pieces) + 1))
                return [ids[a:b] for a, b in zip(cut, cut[1:])]

    def _blocks(self, pieces: list[bytes], contract) -> list:
        """As ``contract``, in blocks of so many words that all steps of one have about ``BLOCK_ROWS`` places at most."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        held = np.cumsum(n * np.minimum(n, 128) // 2)
        out, a = [], 0
        while a < len(pieces):
            b = max(a + 1, int(np.searchsorted(held, (held[a - 1] if a else 0) + BLOCK_ROWS, "right")))
            out += contract(pieces[a:b])
            a = b
        return out

    def _starts(self, at: int, ids: np.ndarray) -> np.ndarray:
        """Where each token starts, and the end."""
        return at + np.concatenate(([0], np.cumsum(self.size[ids])))

    def _shared(self, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[int, int] | None:
        """Indices of a token that is in both (ids, starts), the middle one of them."""
        _, i, j = np.intersect1d(left[1][:-1], right[1][:-1], assume_unique=True, return_indices=True)
        equal = np.flatnonzero(left[0][i] == right[0][j])
        return (int(i[equal[len(equal) // 2]]), int(j[equal[len(equal) // 2]])) if len(equal) else None

    def _windows(self, word: bytes) -> np.ndarray:
        """Ids of one long word."""
        bounds = [(a, min(a + WINDOW + OVERLAP, len(word))) for a in range(0, len(word) - OVERLAP, WINDOW)]
        found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        while True:
            new = [b for b in bounds if b not in found]
            found |= {b: (ids, self._starts(b[0], ids)) for b, ids in zip(new, self._blocks([word[a:b] for a, b in new], self._contract_windows), strict=True)}
            merged = bounds[:1]
            fresh = True  # a window takes in one neighbour a round
            for b in bounds[1:]:
                if fresh and b[1] - merged[-1][0] <= JOINED and self._shared(found[merged[-1]], found[b]) is None:
                    merged[-1], fresh = (merged[-1][0], b[1]), False
                else:
                    merged.append(b)
                    fresh = True
            if merged == bounds:
                break
            bounds = merged
        done, last = [], found[bounds[0]]
        for left, right in zip(bounds, bounds[1:]):
            here = found[right]
            if (cut := self._shared(last, here)) is None:
                k = int(np.searchsorted(last[1], left[1] - max((left[1] - left[0]) // 4, OVERLAP), "right")) - 1
                ids = self._contract_windows([word[last[1][max(k, 0)] : right[1]]])[0]
                here = ids, self._starts(int(last[1][max(k, 0)]), ids)
                cut = max(k, 0), 0
                if ids[0] != last[0][cut[0]]:
                    return self._contract_windows([word])[0]
            done.append(last[0][: cut[0]])
            last = here[0][cut[1] :], here[1][cut[1] :]
        return np.concatenate([*done, last[0]])

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian unsigned 32-bit) of each distinct word."""
        done = {p: r.to_bytes(4, "little") for p in pieces if (r := self.ranks.get(p)) is not None}
        todo = [p for p in pieces if p not in done]
        short = [p for p in todo if len(p) <= WINDOW]
        done.update(zip(short, self._blocks(short, self._contract), strict=True))
        done.update((p, self._windows(p).astype("<u4").tobytes()) for p in todo if len(p) > WINDOW)
        return done

    def _cut(self, chunk: str) -> list[str]:
        """Pieces of a chunk. Letters after at most one space, with one point or comma, are the common case."""
        body = chunk[1:] if chunk[:1] == " " else chunk
        if body.isalpha():
            return [chunk]
        if body[-1:] in (",", ".") and body[:-1].isalpha():
            return [chunk[:-1], body[-1]]
        return self.pattern.findall(chunk)

    def _learn(self, plain: set[str], spaced: set[str]) -> None:
        cut = [(self.plain.now, c, self._cut(c)) for c in plain] + [(self.spaced.now, c, self._cut(" " + c)) for c in spaced]
        wanted: set[str] = set()
        for _, _, some in cut:
            wanted.update(some)
        new = self.pieces.unknown(wanted)
        ids = self.encode_pieces([p.encode() for p in new])
        known = self.pieces.now
        known.update((p, ids[p.encode()]) for p in new)
        for table, chunk, some in cut:
            table[chunk] = known[some[0]] if len(some) == 1 else b"".join([known[p] for p in some])

    def _vector_block(self, raw: list[bytes]) -> list[bytes]:
        """Plain, single-spaced texts (ASCII and the letters of U+00C0 to U+00FF, no contractions), all at once.

        There, a piece is a run of one byte class with the space before it, or a line feed.
        """
        if not raw:
            return []
        joined = b"\0".join(raw)
        data, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_CLASS), np.uint8)
        change = np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == 5), [True]))
        start = np.flatnonzero((kind != 0) & change[:-1])
        stop = np.flatnonzero((kind != 0) & change[1:]) + 1
        if not len(start):
            return [b""] * len(raw)
        start = start - ((data[np.maximum(start - 1, 0)] == 0x20) & (start > 0))
        first, which = rolling.distinct(joined, start, stop)
        pieces = [joined[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist())]
        new = list(self.raw.unknown(pieces))
        now, ids = self.raw.now, self.encode_pieces(new)
        now.update((p, ids[p]) for p in new)
        codes = [now[p] for p in pieces]
        size = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        pool, base = np.frombuffer(b"".join(codes), "<u4"), np.cumsum(size) - size
        n = size[which]
        ends = np.cumsum(n)
        out = pool[np.repeat(base[which] - (ends - n), n) + np.arange(ends[-1])]
        bounds = np.cumsum([0, *(len(t) + 1 for t in raw)])
        cut = np.concatenate(([0], ends))[np.searchsorted(start, bounds)]
        return [out[a:b].tobytes() for a, b in zip(cut, cut[1:])]

    def encode_block(self, texts: list[str]) -> list[bytes]:
        for cache in (self.plain, self.spaced, self.pieces, self.raw):
            cache.turn()
        raw = [t.encode() for t in texts]
        plain = [bool(r) and b"\x04" not in r.translate(_CLASS) and not _NOT_PLAIN.search(r) and single_spaced(t) for r, t in zip(raw, texts, strict=True)]
        fast = iter(self._vector_block([r for r, p in zip(raw, plain) if p]))
        slow = iter(self._chunk_block([t for t, p in zip(texts, plain) if not p]))
        return [next(fast if p else slow) for p in plain]

    def _chunk_block(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        cut, plain, spaced = [], {"\n"}, set()
        for t in texts:
            if not t or not single_spaced(t):
                lines, parts = None, self.pattern.findall(t)
                plain.update(parts)
            else:
                lines, parts = [line.split(" ") for line in t.split("\n")], None
                plain.update([line[0] for line in lines])
                for line in lines:
                    spaced.update(line[1:])
            cut.append((lines, parts))
        self._learn(self.plain.unknown(plain), self.spaced.unknown(spaced))
        p, s = self.plain.now, self.spaced.now
        feed = p["\n"]
        return [b"".join([p[x] for x in parts]) if lines is None else feed.join([p[line[0]] + b"".join([s[x] for x in line[1:]]) for line in lines]) for lines, parts in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        out, block, held = [], [], 0
        for t in [*texts, None]:
            if block and (t is None or held + len(t) > BLOCK_CHARS):
                out += self.encode_block(block)
                block, held = [], 0
            if t is not None:
                block.append(t)
                held += len(t)
        return out

    def decode(self, ids: list[bytes]):
        """(index, bytes) parts of the decoded texts, in order; empty ones give none."""
        size = np.array([len(x) // 4 for x in ids], np.int64)
        rows = -(-size // ABREAST)
        if not rows.sum():
            return
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), rows)
        flat = np.full(ABREAST * len(owner), -1, np.int32)
        flat[np.arange(size.sum()) + np.repeat(ABREAST * (np.cumsum(rows) - rows) - (np.cumsum(size) - size), size)] = np.frombuffer(b"".join(ids), "<u4")
        flat = flat.reshape(-1, ABREAST)
        for i in range(0, len(flat), BLOCK_TOKENS // ABREAST):
            part = slice(i, i + BLOCK_TOKENS // ABREAST)
            given = {"doc": owner[part], "pos": np.arange(len(flat[part]), dtype=np.int32)} | {f"id{k}": np.ascontiguousarray(flat[part, k]) for k in range(ABREAST)}
            got = self._query("ids", pa.table(given), _DECODE)
            for doc, text in zip(got["doc"].to_pylist(), got["bytes"].to_pylist(), strict=True):
                yield doc, text.encode("latin-1")


class _Shared:
    """A broadcast value that compares by its digest, so a reused Python worker keeps its coder."""

    def __init__(self, broadcast, key: str):
        self.broadcast, self.key = broadcast, key

    def __call__(self):
        return self.broadcast.value

    def __eq__(self, other):
        return self.key == other.key

    def __hash__(self):
        return hash(self.key)


_IDS = T.StructField("ids", T.BinaryType())
_DIGESTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def _make_encode(shared, pattern, keep_ids, digests):
    coder = Coder(shared(), pattern)  # of this task only: a reused Python worker holds no tables between stages

    def some(texts):
        ids = coder.encode([t or "" for t in texts])
        out = [ids] if keep_ids else []
        if digests:
            sums = [hashlib.sha256() for _ in ids]
            for i, part in coder.decode(ids):
                sums[i].update(part)
            out += [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [x.hexdigest() for x in sums]]
        return out

    def run(texts, _):
        blocks = [some(texts[i : i + BLOCK_TEXTS]) for i in range(0, len(texts), BLOCK_TEXTS)] or [some([])]
        return [[x for b in blocks for x in b[c]] for c in range(len(blocks[0]))]

    return run


def _make_decode(shared, pattern):
    coder = Coder(shared(), pattern)  # of this task only: a reused Python worker holds no tables between stages

    def run(_, batch):
        ids = [x or b"" for x in batch.column("ids").to_pylist()]
        out = [[] for _ in ids]
        for i, part in coder.decode(ids):
            out[i].append(part)
        return [[b"".join(x) for x in out]]

    return run


def _share(df: DataFrame, ranks_path: str) -> _Shared:
    ranks = load_ranks(ranks_path)
    key = hashlib.sha256(repr(ranks).encode()).hexdigest()
    return _Shared(df.sparkSession.sparkContext.broadcast(ranks), key)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep_ids: bool = True, digests: bool = False, text_too: bool = True) -> DataFrame:
    """``docs`` (without its texts unless ``text_too``) plus ids (little-endian unsigned 32-bit) and, as ``digests``, n_tokens, ids_sha256 and decoded_sha256 (of the bytes decoded from the ids)."""
    fields = T.StructType([_IDS] * keep_ids + _DIGESTS * digests)
    return append_columns(docs, text_col, fields, partial(_make_encode, _share(docs, ranks_path), pattern, keep_ids, digests), binary=False, text_too=text_too)


def decode(coded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``coded`` plus decoded (bytes) from its ids column; null ids give no bytes."""
    any_col = coded.columns[0]
    return append_columns(coded, any_col, T.StructType([T.StructField("decoded", T.BinaryType())]), partial(_make_decode, _share(coded, ranks_path), pattern), binary=False)
