"""Byte-level BPE on padded numpy matrices, with exact encoding and decoding.

Distinct pieces (matches of the split pattern) are sorted into buckets by length. A bucket is a
matrix of token ids, one row a piece. Each round looks up the rank of every adjacent pair in a
hash table, merges each row's leftmost pair of minimum rank, and closes the gap; rows without a
mergeable pair leave. Pieces over LONG bytes, of which a matrix would be quadratic, are merged
with a heap in the same order.

A text is cut at single spaces first: a chunk between two spaces, with its leading space, splits
into the same pieces wherever it stands, provided that no other white space touches the space.
Chunks are therefore encoded once each per worker (a bounded cache), found by whole-array hashing
of the texts' bytes, and texts that break the rule are split whole.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from colloquy.llm.common import RollingHash, cache, ragged

#: Piece length in bytes from which the heap takes over.
LONG = 512
#: Distinct chunks and pieces that a worker keeps.
CACHE, PIECES = 700_000, 400_000
#: A space beside other white space, or white space at the end.
UNEVEN = re.compile(r"\s | \s|\s\Z")
#: ASCII white space; first bytes of other white space in UTF-8.
_SPACE, _LEAD = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_NONE = np.int32(2**31 - 1)


class HashTable:
    """Open addressing from 64-bit keys to numbers; inserts and lookups of whole arrays."""

    EMPTY = np.uint64(2**64 - 1)

    def __init__(self, most: int):
        bits = max(4, int(most * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, self.EMPTY, np.uint64)
        self.values = np.full(1 << bits, _NONE, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys must be distinct and absent."""
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slots[todo]
            free = self.keys[at] == self.EMPTY
            taken, first = np.unique(at[free], return_index=True)
            who = todo[free][first]
            self.keys[taken], self.values[taken] = keys[who], values[who]
            todo = np.setdiff1d(todo, who, assume_unique=True)
            full = self.keys[slots[todo]] != self.EMPTY
            slots[todo[full]] = (slots[todo[full]] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; those of absent keys are above every number."""
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _NONE)
        flat_out, flat_at, flat_keys = out.reshape(-1), at.reshape(-1), keys.reshape(-1)
        todo = np.flatnonzero((found != keys).reshape(-1) & (found != self.EMPTY).reshape(-1))
        while len(todo):
            flat_at[todo] = (flat_at[todo] + 1) & self.mask
            found = self.keys[flat_at[todo]]
            hit = found == flat_keys[todo]
            flat_out[todo[hit]] = self.values[flat_at[todo[hit]]]
            todo = todo[~hit & (found != self.EMPTY)]
        return out


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.uint64) << np.uint64(20) | right.astype(np.uint64)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[p[:i]], ranks[p[i:]], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
        left, right, merged = np.array(pairs, np.int32).reshape(-1, 3).T
        self.table = HashTable(len(pairs))
        self.table.insert(pair_keys(left, right), merged)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and the number of ids of each piece."""
        counts, rows, spans = np.ones(len(pieces), np.int64), [None] * len(pieces), []
        direct = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        by: dict[int, list[int]] = {}
        for i in np.flatnonzero(direct < 0).tolist():
            n = len(pieces[i])
            by.setdefault(-1 if n > LONG else max(4, 1 << (n - 1).bit_length()) if n else 0, []).append(i)
        for width, who in by.items():
            if width <= 0:
                for i in who:
                    rows[i] = self._heap(pieces[i]) if width else []
                    counts[i] = len(rows[i])
                spans += [(i, rows[i]) for i in who]
                continue
            step = max(1, (1 << 20) // width)
            for a in range(0, len(who), step):
                part = who[a : a + step]
                for i, ids in self._matrix(part, [pieces[i] for i in part], width):
                    counts[i] = len(ids)
                    spans.append((i, ids))
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        single = direct >= 0
        out[starts[single]] = direct[single]
        for i, ids in spans:
            out[starts[i] : starts[i] + len(ids)] = ids
        return out, counts

    def _matrix(self, who: list[int], pieces: list[bytes], width: int):
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, who = self.byte_ids[raw], np.array(who)
        while len(who):
            w = ids.shape[1]
            ranks = self.table.get(pair_keys(ids[:, :-1], ids[:, 1:])) if w > 1 else np.full((len(who), 1), _NONE)
            ranks[np.arange(ranks.shape[1]) >= (length - 1)[:, None]] = _NONE
            at = ranks.argmin(1)
            best = ranks[np.arange(len(who)), at]
            done = best == _NONE
            for i, row, n in zip(who[done].tolist(), ids[done], length[done].tolist()):
                yield i, row[:n]
            live = ~done
            who, ids, at, best, length = who[live], ids[live], at[live], best[live], length[live] - 1
            if len(who):
                ids[np.arange(len(who)), at] = best
                places = np.arange(w - 1)
                ids = np.take_along_axis(ids, places + (places > at[:, None]), 1)

    def _heap(self, piece: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        first = self.table.get(pair_keys(np.array(ids[:-1]), np.array(ids[1:])))
        heap = [(int(r), i) for i, r in enumerate(first.tolist()) if r != _NONE]
        heapq.heapify(heap)
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]

        def rank(i: int, j: int) -> int:
            return self.ranks.get(self.bytes_of[ids[i]] + self.bytes_of[ids[j]], -1)

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or after[i] < 0 or rank(i, after[i]) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (s := rank(a, b)) >= 0:
                    heapq.heappush(heap, (s, a))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Store(dict):
    """Numbers keys as they come and holds their ids. Once it has `most` keys it only lends numbers
    to further ones until `trim`, so that the frequent keys, which come early, stay."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.new, self.fixed = most, [], (0, 0)
        self.flat, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def __missing__(self, key: str) -> int:
        at = self[key] = len(self)
        self.new.append(key)
        return at

    def fill(self, encode) -> None:
        """encode(keys) gives ids and counts of the keys that have none yet."""
        at = len(self.counts)
        if at < len(self):
            ids, own = encode(self.new[at - self.fixed[0] :])
            self.flat, self.counts = np.concatenate((self.flat, ids)), np.concatenate((self.counts, own))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.counts[numbers]
        return self.flat[ragged((np.cumsum(self.counts) - self.counts)[numbers], lengths)], lengths

    def trim(self) -> None:
        if len(self) <= self.most:
            self.fixed = len(self), len(self.flat)
        else:
            for key in self.new:
                del self[key]
            self.counts, self.flat = self.counts[: self.fixed[0]], self.flat[: self.fixed[1]]
        self.new = []


class PieceCache:
    """Encodes chunks through a store of pieces, each of which goes to `encode_new` once."""

    def __init__(self, pattern, encode_new, most: int = PIECES):
        self.pattern, self.encode_new, self.store = pattern, encode_new, _Store(most)

    def __call__(self, chunks: list[str], lead: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, each with a space before it if `lead`, and each chunk's number of ids."""
        if lead:
            found = self.pattern.findall(" " + " ".join(chunks)) if chunks else []
            owner = np.cumsum(np.fromiter((p[0] == " " for p in found), np.int64, len(found))) - 1
        else:
            parts = [self.pattern.findall(c) for c in chunks]
            found = [p for part in parts for p in part]
            owner = np.repeat(np.arange(len(parts)), np.array([len(p) for p in parts], np.int64))
        which = np.fromiter(map(self.store.__getitem__, found), np.int64, len(found))
        self.store.fill(self.encode_new)
        ids, lengths = self.store.take(which)
        self.store.trim()
        return ids, np.bincount(owner, weights=lengths, minlength=len(chunks)).astype(np.int64)


class ChunkCache:
    """Encodes texts by chunks. `encode(chunks, lead)` is as PieceCache's call.

    Chunks are found by a 64-bit rolling hash, and their bytes are compared on every hit; a text with a
    chunk that only shares another's hash is encoded whole. The first `most` distinct chunks of a worker
    are kept. Texts that hold one of `special` go to `encode_whole`.
    """

    def __init__(self, encode, most: int = CACHE, special: tuple[str, ...] = (), encode_whole=None):
        self.encode, self.most, self.table = encode, most, HashTable(most)
        self.special, self.encode_whole = special, encode_whole
        self.flat, self.counts, self.starts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.names, self.at, self.sizes = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_array(pa.array(texts, pa.string()))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's number of ids. Null: none."""
        edges = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32, len(texts) + 1, texts.offset * (8 if pa.types.is_large_string(texts.type) else 4)).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        lengths = np.diff(edges)
        special = np.zeros(len(texts), bool)
        for said in self.special:
            special |= pc.fill_null(pc.match_substring(texts, said), False).to_numpy(zero_copy_only=False)
        whole = self._uneven(body, edges, texts) | special
        counts, made = np.zeros(len(texts), np.int64), []
        while len(plain := np.flatnonzero(~whole & (lengths > 0))):
            ids, own, strange = self._by_chunks(body, edges, whole, plain)
            if not len(strange):
                counts += own
                made.append((plain, ids))
                break
            whole[strange] = True
        for which, encode in ((whole & ~special, lambda t: self.encode(t, False)), (special, self.encode_whole)):
            rest = np.flatnonzero(which)
            if len(rest):
                ids, own = encode(texts.take(pa.array(rest)).to_pylist())
                counts[rest] = own
                made.append((rest, ids))
        if len(made) == 1:
            return made[0][1], counts
        starts, out = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.int32)
        for who, ids in made:
            out[ragged(starts[who], counts[who])] = ids
        return out, counts

    def _by_chunks(self, body: np.ndarray, edges: np.ndarray, whole: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the plain texts, each text's number of them, and the texts with a chunk of another's hash."""
        space = np.flatnonzero(body == 32)
        owner = np.searchsorted(edges, space, "right") - 1
        space = space[~whole[owner]]
        at, end = np.sort(np.concatenate((edges[plain], space + 1))), np.sort(np.concatenate((space, edges[plain + 1])))
        of = np.searchsorted(edges, at, "right") - 1
        lead = np.ones(len(at), bool)
        lead[np.searchsorted(at, edges[plain])] = False
        keys = np.minimum(RollingHash(body).spans(at, end - at) ^ np.where(lead, np.uint64(0), np.uint64(0xA5A5A5A5A5A5A5A5)), np.uint64(2**64 - 2))
        number = self.table.get(keys).astype(np.int64)
        fixed = len(self.counts)
        new = np.flatnonzero(number == _NONE)
        fresh, first, place = np.unique(keys[new], return_index=True, return_inverse=True)
        first = new[first]
        order = np.argsort(~lead[first], kind="stable")  # those with a space come first
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number[new] = fixed + rank[place]
        # a chunk's name: its bytes, and one byte for the space before it
        here = first[order]
        sizes, starts = np.concatenate((self.sizes, end[here] - at[here] + 1)), np.concatenate((self.at, len(self.names) + np.cumsum(end[here] - at[here] + 1) - (end[here] - at[here] + 1)))
        names = np.empty(len(self.names) + int((end[here] - at[here] + 1).sum()), np.uint8)
        names[: len(self.names)] = self.names
        names[starts[fixed:]] = lead[here]
        names[ragged(starts[fixed:] + 1, end[here] - at[here])] = body[ragged(at[here], end[here] - at[here])]
        differs = (sizes[number] != end - at + 1) | (names[starts[number]] != lead)
        same = np.flatnonzero(~differs)
        span = end[same] - at[same]
        unequal = np.concatenate(([0], np.cumsum(names[ragged(starts[number[same]] + 1, span)] != body[ragged(at[same], span)])))
        differs[same] = unequal[np.cumsum(span)] != unequal[np.cumsum(span) - span]
        if differs.any():
            return np.empty(0, np.int32), np.empty(0, np.int64), np.unique(of[differs])
        if len(here):
            raw = body.tobytes()
            chunks = [raw[a:z].decode() for a, z in zip(at[here].tolist(), end[here].tolist())]
            n = int(lead[here].sum())
            parts = [self.encode(chunks[:n], True), self.encode(chunks[n:], False)]
            self._extend(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            if fixed + len(fresh) <= self.most:
                self.table.insert(fresh, (fixed + rank).astype(np.int32))
                self.names, self.at, self.sizes = names, starts, sizes
                fixed += len(fresh)
        own = self.counts[number]
        ids = self.flat[ragged(self.starts[number], own)]
        counts = np.bincount(of, weights=own, minlength=len(edges) - 1).astype(np.int64)
        if fixed < len(self.counts):
            self.flat, self.counts, self.starts = self.flat[: self.starts[fixed]], self.counts[:fixed], self.starts[:fixed]
        return ids, counts, np.empty(0, np.int64)

    def _extend(self, ids: np.ndarray, own: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(own) - own))
        self.flat, self.counts = np.concatenate((self.flat, ids)), np.concatenate((self.counts, own))

    @staticmethod
    def _uneven(body: np.ndarray, edges: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Which texts UNEVEN finds something in."""
        out = np.zeros(len(texts), bool)
        if not len(body):
            return out
        blank = _SPACE[body]
        touching = np.flatnonzero(blank[:-1] & blank[1:] & ((body[:-1] == 32) | (body[1:] == 32)))
        owner = np.searchsorted(edges, touching, "right") - 1
        out[owner[touching + 1 < edges[owner + 1]]] = True
        full = np.diff(edges) > 0
        out[full] |= blank[edges[1:][full] - 1]
        lead = np.flatnonzero(_LEAD[body])
        if len(lead):
            for i in np.unique(np.searchsorted(edges, lead, "right") - 1).tolist():
                out[i] = out[i] or bool(UNEVEN.search(texts[i].as_py()))
        return out


@lru_cache(maxsize=4)
def load_ranks(path: str, pattern: str) -> ByteBPE:
    """One encoder per worker and vocabulary file."""
    with open(path, "rb") as lines:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


@lru_cache(maxsize=4)
def cached(path: str, pattern: str) -> ChunkCache:
    coder = load_ranks(path, pattern)
    return ChunkCache(PieceCache(coder.pattern, lambda new: coder.encode_pieces([p.encode() for p in new]), PIECES // 2), CACHE // 2)


cache("bpe", cached.cache_clear)
