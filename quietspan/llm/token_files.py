"""Token-id files: word-level BPE ids in Re-Pair grammar-compressed shards with random access.

Documents are dealt by range of id, each task encodes its documents in order and writes shards of
about ``SHARD_IDS`` ids. A shard's image holds the ids as a sequence over a grammar: in rounds, the
most frequent neighbouring id pairs become nonterminals (pairs that overlap more frequent ones wait
for the next round), until no pair occurs twice. Rules and the expansion length of every symbol are stored, so any document is
decoded alone: its place is found in the running lengths, and only its symbols are expanded.

Scale: one shuffle of the texts (by range of id, ties by text hash). A shard notes how many ids of its
range come before it, and totals are added up over the ranges, so no task sees more than a row per
range, and images are never shuffled. Shards are written by Spark's committed writer to the shared folder, so a lost executor
only repeats its own ranges. Memory: one shard and the chunks encoded so far (at most
``CACHE_CHUNKS``).

Defined results: null is the empty text (only the end id); a null id sorts first; equal ids are in
the order of their text's hash, then text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quietspan.llm import rolling
from quietspan.llm.bpe import Recent, _Shared
from quietspan.llm.rows import give_back, shared_dir, write_shared
from quietspan.llm.token_counts import byte_alphabet

END_ID = 2
SHARD_IDS = 1 << 20
BLOCK_DOCS = 512
CACHE_CHUNKS = 250_000
MAGIC = b"QSRP2\0\0\0"
#: Rules of up to so many ids are expanded once for a whole shard.
_FEW = 32
#: Re-Pair goes on until no pair of a shard occurs so often.
MIN_COUNT = 2
#: Byte classes of plain texts: white space, letters, digits, other marks; 4 is anything that is not plain.
_CLASS = bytes(0 if b in b" \n\t\r" else 4 if b < 32 or b == 127 or b == 0xC2 or b > 0xC3 else 1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CONTRACTION = re.compile(rb"'[stmdrlvSTMDRLV]")
#: The first n of eight bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Texts with other white space than this, with control characters that some take for it, or with "<|" go to the library whole.
_ODD = re.compile(r"[^\S \n\t\r]|<\|")


def _not_plain(text: bytes, kinds: bytes) -> bool:
    """Beside its bytes the two marks among the letters, special tokens and contractions make a text not plain."""
    return b"\x04" in kinds or b"\xc3\x97" in text or b"\xc3\xb7" in text or b"<|" in text or b"'" in text and _CONTRACTION.search(text) is not None


class WordTable:
    """A bounded table of plain words' ids that a block's words are looked up in all at once.

    A word of up to 24 bytes is its own key: three numbers of eight bytes, filled up with zeros, which no plain
    word holds. Longer ones are told apart in each block and kept by their bytes. A slot is found by a hash
    and, where others lie there, the ones after it. When over ``limit`` words are in, the half that was used
    longest ago is dropped.
    """

    def __init__(self, limit: int):
        self.limit, self.mask = limit, (1 << max(2 * limit, 1024).bit_length()) - 1
        self.long = Recent(limit // 8)
        self._reset()

    def _reset(self) -> None:
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.keys, self.base, self.size, self.used = np.empty((3, 0), np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.clock = np.empty(0, np.uint32), 0

    def turn(self) -> None:
        self.long.turn()
        self.clock += 1
        if len(self.base) <= self.limit:
            return
        keep = np.flatnonzero(self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2])
        keys, base, size, used, pool, clock = self.keys[:, keep], self.base[keep], self.size[keep], self.used[keep], self.pool, self.clock
        self._reset()
        self.clock, self.used = clock, used
        self._add(keys, pool[_ranges(base, size)], size)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = rolling.mix(keys[0] + rolling.mix(keys[1] ^ (keys[2] * np.uint64(0x9E3779B97F4A7C15))))
        return (x & np.uint64(self.mask)).astype(np.int64)

    def _at(self, keys: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is not in."""
        slot = self._slot(keys)
        out = self.slots.take(slot).astype(np.int64)
        here = np.flatnonzero(out >= 0)
        while len(here):
            found = out[here]
            wrong = self.keys[0].take(found) != keys[0].take(here)
            more = np.flatnonzero(left.take(here) >= 8)  # fewer bytes are told apart by the first number
            wrong[more] |= (self.keys[1].take(found[more]) != keys[1].take(here[more])) | (self.keys[2].take(found[more]) != keys[2].take(here[more]))
            here = here[wrong]
            slot[here] = (slot[here] + 1) & self.mask
            out[here] = self.slots[slot[here]]
            here = here[out[here] >= 0]
        return out

    def _add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Puts distinct keys in that are not there yet; each pass gives every free slot to one of those that ask for it."""
        number, slot = len(self.base) + np.arange(keys.shape[1]), self._slot(keys)
        self.base = np.concatenate((self.base, len(self.pool) + np.cumsum(size) - size))
        self.keys, self.size, self.pool = np.concatenate((self.keys, keys), 1), np.concatenate((self.size, size)), np.concatenate((self.pool, ids))
        self.used = np.concatenate((self.used, np.full(len(self.base) - len(self.used), self.clock)))
        if 2 * len(self.base) > self.mask:  # a block of very many words
            self.mask = (1 << (4 * len(self.base)).bit_length()) - 1
            self.slots, number = np.full(self.mask + 1, -1, np.int32), np.arange(len(self.base))
            slot = self._slot(self.keys)
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]
            rest = self.slots[slot] != number
            number, slot = number[rest], (slot[rest] + 1) & self.mask

    def find(self, text: bytes, start: np.ndarray, stop: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base, size, pool): the ids of text[start:stop] are pool[base:base + size]. ``encode`` gives the ids of words that are not in."""
        eights, left = rolling.eights(text), stop - start
        keys = np.zeros((3, len(start)), np.uint64)
        keys[0] = eights[start] & _FIRST.take(left, mode="clip")
        more = np.flatnonzero(left > 8)
        keys[1, more] = eights[start[more] + 8] & _FIRST.take(left[more] - 8, mode="clip")
        more = more[left[more] > 16]
        keys[2, more] = eights[start[more] + 16] & _FIRST.take(left[more] - 16, mode="clip")
        at = self._at(keys, left)
        long = more[left[more] > 24]
        at[long] = 0
        new = np.flatnonzero(at < 0)
        if len(new):
            first, which = rolling.distinct(text, start[new], stop[new])
            first, at[new] = new[first], len(self.base) + which
            self._add(keys[:, first], *encode(text, start[first], stop[first]))
        if not len(long):
            self.used[at] = self.clock
            return self.base.take(at), self.size.take(at), self.pool
        short = np.delete(np.arange(len(at)), long)
        self.used[at[short]] = self.clock
        first, which = rolling.distinct(text, start[long], stop[long])
        words = [text[a:b] for a, b in zip(start[long[first]].tolist(), stop[long[first]].tolist())]
        known, unknown = self.long.now, self.long.unknown(words)
        for w in unknown:
            known[w] = encode(w, np.zeros(1, np.int64), np.full(1, len(w)))[0]
        ids = [known[w] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        base, n = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        base[short], n[short] = self.base[at[short]], self.size[at[short]]
        base[long], n[long] = (len(self.pool) + np.cumsum(size) - size)[which], size[which]
        return base, n, np.concatenate((self.pool, *ids))


def _ranges(base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """base[0], base[0] + 1, ... of ``size[0]`` numbers, then those of the next."""
    ends = np.cumsum(size)
    at = np.repeat(base - (ends - size), size)
    at += np.arange(len(at))
    return at


class Encoder:
    """The tokenizers library behind tables of the chunks and words it has encoded lately.

    Plain texts (ASCII and the letters of U+00C0 to U+00FF, without contractions) are cut into words for
    a whole block at once, by byte class, and only words not met lately go to the library's model. In
    other texts pieces never cross white space, so each chunk between it is encoded by itself. Chunks of characters
    below U+0250 (which NFC leaves as they are) are lower-cased and cut here by the vocabulary's own
    pattern, and each new word goes to the library's model; all others go through the whole library.
    """

    def __init__(self, spec: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenize = self.tokenizer.model.tokenize
        parts = json.loads(spec)["pre_tokenizer"]
        pattern = next(p["pattern"]["Regex"] for p in parts.get("pretokenizers", [parts]) if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.chunks, self.words, self.raw = Recent(CACHE_CHUNKS // 2), Recent(CACHE_CHUNKS // 2), WordTable(2 * CACHE_CHUNKS)

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def _words(self, text: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of plain words text[start:stop]."""
        shown, tokenize, letters = text.decode("latin-1"), self.tokenize, self.letters
        ids, size = [], []
        for a, b in zip(start.tolist(), stop.tolist()):
            word = shown[a:b]
            tokens = tokenize(word if word.isascii() else word.translate(letters))
            ids += [t.id for t in tokens]
            size.append(len(tokens))
        return np.array(ids, np.uint32), np.array(size, np.int64)

    def _cut(self, chunk: str) -> list[str]:
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in ",." and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def _learn(self, new: set[str]) -> None:
        plain = [c for c in new if c.isascii() or max(c) < "\u0250"]
        cut = [self._cut(c.lower()) for c in plain]
        wanted: set[str] = set()
        for words in cut:
            wanted.update(words)
        for w in self.words.unknown(wanted):
            self.words.now[w] = self._word(w)
        known, chunks = self.words.now, self.chunks.now
        for c, words in zip(plain, cut, strict=True):
            chunks[c] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])
        rest = sorted(new - set(plain))
        for i in range(0, len(rest), 8192):
            for c, code in zip(rest[i : i + 8192], self.tokenizer.encode_batch(rest[i : i + 8192], add_special_tokens=False), strict=True):
                chunks[c] = np.array(code.ids, "<u4").tobytes()

    def encode(self, raw: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts, little-endian unsigned 32-bit."""
        for cache in (self.chunks, self.words, self.raw):
            cache.turn()
        whole = b"\n".join(raw)
        if not _not_plain(whole, kinds := whole.translate(_CLASS)):
            return self._plain(raw, whole, kinds)
        plain = [not _not_plain(t, t.translate(_CLASS)) for t in raw]
        some = [t for t, p in zip(raw, plain) if p]
        whole = b"\n".join(some)
        fast = iter(self._plain(some, whole, whole.translate(_CLASS)))
        slow = iter(self._others([t.decode("utf-8", "replace") for t, p in zip(raw, plain) if not p]))
        return [next(fast if p else slow) for p in plain]

    def _plain(self, raw: list[bytes], whole: bytes, kinds: bytes) -> list[bytes]:
        """``whole`` is the texts joined by line feeds, ``kinds`` its byte classes; lower-casing changes no class."""
        if not raw:
            return []
        text = whole.translate(_LOWER)
        if b"\xc3" in text:
            data = np.frombuffer(text, np.uint8).copy()
            data[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 0x20
            text = data.tobytes()
        kind = np.frombuffer(kinds, np.uint8)
        word = kind != 0
        edge = np.ones(len(kind) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[:-1] |= kind == 2
        start, stop = np.flatnonzero(edge[:-1] & word), np.flatnonzero(edge[1:] & word) + 1
        if not len(start):
            return [b""] * len(raw)
        base, n, pool = self.raw.find(text, start, stop, self._words)
        ids, ends = pool.take(_ranges(base, n)).tobytes(), np.cumsum(n)
        texts = np.cumsum([len(t) + 1 for t in raw])
        cut = (4 * np.concatenate(([0], ends))[np.searchsorted(start, np.concatenate(([0], texts)))]).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]

    def _others(self, texts: list[str]) -> list[bytes]:
        cut = [None if _ODD.search(t) else t.split() for t in texts]
        new: set[str] = set()
        for parts in cut:
            new.update(parts or ())
        self._learn(self.chunks.unknown(new))
        get = self.chunks.now.__getitem__
        return [b"".join(map(get, parts)) if parts is not None else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, parts in zip(texts, cut, strict=True)]


@lru_cache(maxsize=1)
def _encoder(key: str, shared) -> Encoder:
    return Encoder(shared())


# --- the grammar


_NONE = np.iinfo(np.int32).max


def _grouped(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their keys, keys in order). Keys of ``bits`` bits are sorted with their place beside them where both fit."""
    room = len(key).bit_length()
    if bits + room > 63:
        order = np.argsort(key)
        return order, key[order]
    both = key << room
    both |= np.arange(len(key))
    both.sort()
    return both & ((1 << room) - 1), both >> room


def compress(ids: np.ndarray, base: int, least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the rules as (n, 2). Symbols below ``base`` are ids; rules number on from it, each after its parts.

    A round replaces pairs, most frequent first: a place whose neighbours' pairs are more frequent waits.
    Only pairs that a replacement has made, and repeated ones that wait, can still repeat, so a round looks
    at those alone. Ends when no pair occurs ``least`` times without overlap.
    """
    x, look, top, rules = ids.astype(np.int64), None, base, []
    while (step := _round(x, look, top, least)) is not None:
        x, look, pairs = step
        rules.append(pairs)
        top += len(pairs)
        if len(look) < len(x) // 8:
            x, more = _compress_sparse(x, look, top, least)
            rules += more
            break
    return x.astype(np.uint32), np.concatenate([*rules, np.empty((0, 2), np.int64)]).astype(np.uint32)


def _ranked(key: np.ndarray, bits: int, count: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(rank of each place's pair, pairs by rank), most frequent first; ``_NONE`` for pairs of fewer counted places than ``least``. None if all are."""
    order, ordered = _grouped(key if count is None else key[count], bits)
    new = np.empty(len(ordered), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    first = np.flatnonzero(new)
    counts = np.diff(first, append=len(ordered))
    some = np.flatnonzero(counts >= least)
    if not len(some):
        return None
    some = some[np.argsort(-counts[some], kind="stable")]
    number = np.full(len(first), _NONE, np.int32)
    number[some] = np.arange(len(some), dtype=np.int32)
    rank = np.empty(len(ordered), np.int32)
    rank[order] = np.repeat(number, counts)
    if count is not None:
        rank_all = np.full(len(key), _NONE, np.int32)
        rank_all[count] = rank
        rank = rank_all
    return rank, ordered[first[some]]


def _counted(a: np.ndarray, equal: np.ndarray, joined: np.ndarray) -> np.ndarray | None:
    """Of pairs of equal symbols next to one another (``equal`` has their rows, ``joined`` whether the row before is such a neighbour) every second counts. None: all count."""
    equal = equal[joined & (equal > 0)]
    equal = equal[a[equal - 1] == a[equal]]
    if not len(equal):
        return None
    run, at = np.zeros(len(a), bool), np.arange(len(a))
    run[equal] = True
    return (at - np.maximum.accumulate(np.where(run, 0, at))) % 2 == 0


def _round(x: np.ndarray, look: np.ndarray | None, top: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """A round over a whole sequence: (new sequence, its places where a pair may repeat, pairs). ``look`` has the places to look at, None is all."""
    n, bits = len(x), top.bit_length()
    if n < 2:
        return None
    if look is None:
        a, b, joined = x[:-1], x[1:], True
    else:
        a, b = x.take(look), x.take(look + 1)
    equal = np.flatnonzero(a == b)
    if look is not None:
        joined = look[equal - 1] == look[equal] - 1
    count = _counted(a, equal, joined)
    key = a << bits
    key |= b
    if (ranked := _ranked(key, 2 * bits, count, least)) is None:
        return None
    mine, pairs = ranked
    odd = np.zeros(0, np.int64)
    if count is not None:
        odd = np.flatnonzero(~count)
        odd = odd[mine[odd - 1] < _NONE]
        odd = odd if look is None else look[odd]
    rank = np.full(n + 1, _NONE, np.int32)  # at place + 1, so that the first has one before it
    if look is None:
        rank[1:-1] = mine
    else:
        rank[look + 1] = mine
    here = rank[1:]
    take = here < rank[:-1]
    take[:-1] &= here[:-1] <= here[1:]
    chosen = np.flatnonzero(take)
    got = np.bincount(here[chosen], minlength=len(pairs))
    enough = got >= least  # the most frequent pair gets all its places, others may have to wait
    chosen = chosen[enough[here[chosen]]]
    new = top + np.cumsum(enough) - 1
    again = here < _NONE
    again[odd] = True
    again[np.maximum(chosen - 1, 0)] = True  # one that is not left goes; the new one before it has its place already
    x = x.copy()
    x[chosen] = new[here[chosen]]
    left = np.ones(n, bool)
    left[chosen + 1] = False
    again = again[left]
    again[-1] = False  # the last has none after it
    pairs = pairs[enough]
    return x[left], np.flatnonzero(again), np.stack((pairs >> bits, pairs & ((1 << bits) - 1)), 1)


def _compress_sparse(ids: np.ndarray, place: np.ndarray, top: int, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rounds that look at few places: what is replaced is unlinked from its neighbours, and nothing else moves."""
    n = len(ids)
    x = np.append(ids, 0)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)  # neighbours among the symbols that are left; n is the end
    left = np.ones(n + 1, bool)
    rank_at = np.full(n + 2, _NONE, np.int32)  # the last one is for what is before the first
    rules = []
    while len(place):
        a, b = x[place], x[after[place]]
        bits = top.bit_length()
        key = a << bits | b
        equal = np.flatnonzero(a == b)
        count = _counted(a, equal, place[equal - 1] == before[place[equal]])
        if (ranked := _ranked(key, 2 * bits, count, least)) is None:
            break
        rank_all, pairs = ranked
        odd = place[:0]
        if count is not None:
            uncounted = np.flatnonzero(~count)
            odd = place[uncounted[rank_all[uncounted - 1] < _NONE]]
        waits = rank_all < _NONE
        mine, here = rank_all[waits], place[waits]
        rank_at[here] = mine
        take = (mine < rank_at[before[here]]) & (mine <= rank_at[after[here]])
        rank_at[here] = _NONE
        got = np.bincount(mine[take], minlength=len(pairs))
        enough = got >= least
        take &= enough[mine]
        new = top + np.cumsum(enough) - 1
        chosen = here[take]
        second = after[chosen]
        x[chosen] = new[mine[take]]
        left[second] = False
        after[chosen] = after[second]
        before[after[second]] = chosen
        pairs = pairs[enough]
        rules.append(np.stack((pairs >> bits, pairs & ((1 << bits) - 1)), 1))
        top += len(pairs)
        changed = np.concatenate((here[~take], odd, chosen, before[chosen]))
        changed = changed[changed >= 0]
        place = np.unique(changed[left[changed] & (after[changed] < n)])
    return x[:n][left[:n]], rules


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of each rule's symbol."""
    out = np.zeros(len(rules), np.int64)
    parts = rules.astype(np.int64) - base
    todo = np.arange(len(rules))
    while len(todo):
        size = np.where(parts[todo] < 0, 1, out[np.maximum(parts[todo], 0)])
        known = (size > 0).all(1)
        out[todo[known]] = size[known].sum(1)
        todo = todo[~known]
    return out


def expand(x: np.ndarray, rules: np.ndarray, size: np.ndarray, base: int) -> np.ndarray:
    """The ids of a sequence: every symbol goes to its place, rules as their two parts, until only ids are left."""
    symbol = x.astype(np.int64)
    n = np.where(symbol < base, 1, size[np.maximum(symbol - base, 0)] if len(size) else 1)
    out, at = np.empty(int(n.sum()), np.uint32), np.cumsum(n) - n
    while len(symbol):
        leaf = symbol < base
        out[at[leaf]] = symbol[leaf]
        rule, at = symbol[~leaf] - base, at[~leaf]
        left, right = rules[rule, 0].astype(np.int64), rules[rule, 1].astype(np.int64)
        step = np.where(left < base, 1, size[np.maximum(left - base, 0)]) if len(rule) else at
        symbol, at = np.concatenate((left, right)), np.concatenate((at, at + step))
    return out


def write_shard(doc_ids: list[int | None], ids: list[bytes], min_count: int = MIN_COUNT) -> bytes:
    """File image: magic, counts, document ids and whether they are null, token counts, rules, expansion lengths, sequence."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    base = int(flat.max()) + 1 if len(flat) else 1
    x, rules = compress(flat, base, min_count)
    parts = [
        np.array([d or 0 for d in doc_ids], "<i8"),
        np.array([d is None for d in doc_ids], np.uint8),
        np.array([len(i) // 4 for i in ids], "<u8"),
        rules.astype("<u4"),
        lengths(rules, base).astype("<u4"),
        (x & np.uint32(0xFFFF)).astype("<u2"),
        (x >> np.uint32(16)).astype("<u2"),
    ]
    head = struct.pack("<8sQQQQ", MAGIC, base, len(doc_ids), len(rules), len(x))
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard read back: ``doc_ids``, ``counts``, and ``tokens(i)`` of one document without the others."""

    def __init__(self, image: bytes):
        magic, self.base, docs, rules, length = struct.unpack_from("<8sQQQQ", image)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<8sQQQQ")

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(image, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take(np.uint8, docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.counts = take("<u8", docs).astype(np.int64)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.sizes = take("<u4", rules).astype(np.int64)
        low, high = take("<u2", length), take("<u2", length)
        self.sequence = low.astype(np.uint32) | high.astype(np.uint32) << np.uint32(16)
        size = np.ones(length, np.int64)
        rule = self.sequence >= self.base
        size[rule] = self.sizes[self.sequence[rule] - np.uint32(self.base)]
        self.ends = np.cumsum(size)
        self.starts = np.cumsum(self.counts) - self.counts

    def all_tokens(self) -> np.ndarray:
        """Rules of few ids are expanded once and copied to their places, longer ones by themselves."""
        few = self.sizes <= _FEW
        size = np.concatenate((np.ones(self.base, np.int64), np.where(few, self.sizes, 0)))
        pool = np.concatenate((np.arange(self.base, dtype=np.uint32), expand(np.flatnonzero(few) + self.base, self.rules, self.sizes, self.base)))
        n = size.take(self.sequence)
        own = pool.take(_ranges((np.cumsum(size) - size).take(self.sequence), n))
        many = np.flatnonzero(n == 0)
        if not len(many):
            return own
        full = np.diff(self.ends, prepend=0)
        out, here = np.empty(int(self.ends[-1]), np.uint32), _ranges((self.ends - full)[many], full[many])
        out[here] = expand(self.sequence[many], self.rules, self.sizes, self.base)
        rest = np.ones(len(out), bool)
        rest[here] = False
        out[rest] = own
        return out

    def tokens(self, i: int) -> np.ndarray:
        a, n = int(self.starts[i]), int(self.counts[i])
        if not n:
            return np.empty(0, np.uint32)
        first, last = np.searchsorted(self.ends, a, side="right"), np.searchsorted(self.ends, a + n - 1, side="right")
        out = expand(self.sequence[first : last + 1], self.rules, self.sizes, self.base)
        skip = a - (int(self.ends[first - 1]) if first else 0)
        return out[skip : skip + n]


# --- the tables

_SHARDS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("before", T.LongType()),
        T.StructField("image", T.BinaryType()),
    ]
)


def _pack(batches, shared, shard_ids, end_id):
    from pyspark import TaskContext

    encoder = _encoder(shared.key, shared)
    part, seq, before, held, docs, ids = TaskContext.get().partitionId(), 0, 0, 0, [], []
    end = int(end_id).to_bytes(4, "little")

    def shard():
        row = [[part], [seq], [len(docs)], [held], [before], [write_shard(docs, ids)]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=_SHARDS.names)

    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(0, len(texts), BLOCK_DOCS):
            for key, code in zip(keys[i : i + BLOCK_DOCS], encoder.encode([t or b"" for t in texts[i : i + BLOCK_DOCS]]), strict=True):
                docs.append(key)
                ids.append(code + end)
                held += len(code) // 4 + 1
                if held >= shard_ids:
                    yield shard()
                    seq, before, held, docs, ids = seq + 1, before + held, 0, [], []
    if docs:
        yield shard()
    del docs, ids
    give_back()


def write(docs: DataFrame, vocabulary_path: str, out: str, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, end_id: int = END_ID) -> None:
    """Encode, append ``end_id``, and write shards in ascending id order to the folder ``out``."""
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = f.read()
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(spec), hashlib.sha256(spec.encode()).hexdigest())
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie, "text").select("id", F.encode("text", "utf-8").alias("text"))
    write_shared(dealt.mapInArrow(partial(_pack, shared=shared, shard_ids=shard_ids, end_id=end_id), _SHARDS), out)


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """A row per document: its id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.schema(_SHARDS).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("part_start"))
    # A row of two numbers per range of ids: there are as many as the writing job had partitions.
    placed = shards.join(F.broadcast(starts), "part").withColumn("shard_start", F.col("part_start") + F.col("before"))
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        for batch in batches:
            for first, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(image)
                flat = shard.all_tokens().astype("<u4")
                crc = [zlib.crc32(flat[a : a + n].tobytes()) for a, n in zip(shard.starts, shard.counts)]
                cols = [pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts + first), pa.array(shard.counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return placed.select("shard_start", "image").mapInArrow(run, schema)


def roundtrip(docs: DataFrame, vocabulary_path: str, **options) -> DataFrame:
    """Write to a fresh folder of the shared directory and read back."""
    out = shared_dir(docs.sparkSession, "token-shards")
    write(docs, vocabulary_path, out, **options)
    return read(docs.sparkSession, out, options.get("id_col", "doc_id"))
