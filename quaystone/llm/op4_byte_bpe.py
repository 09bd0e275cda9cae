"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash, displace, verify) resolves a pre-token that is a
vocabulary entry as a whole.  Tier two, for misses: merges by a heap of (rank, place) over the pre-token's
linked bytes.  A task resolves each distinct space-separated chunk of its slice once.

Defined cases: null text counts as empty (no ids); any Unicode text is encoded, also one with special-token
strings, which are plain text; repeated rows give equal results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Remembered, texts_of, with_text_columns

#: Distinct chunks whose ids a task remembers, in each of two generations.
CACHE = 300_000
#: Characters of a chunk that may be remembered beyond its slice.
LONG = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash: key -> slot in 0..n-1, by a displacement per bucket; slots keep the keys."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = n = max(1, len(ranks))
        self.m = m = max(1, n // 2)
        keys = list(ranks)
        h = np.array([xxhash.xxh3_128_intdigest(k) >> 64 for k in keys], dtype=np.uint64)
        g = np.array([xxhash.xxh3_64_intdigest(k, 7) for k in keys], dtype=np.uint64)
        bucket = (h % np.uint64(m)).astype(np.int64)
        size = np.bincount(bucket, minlength=m)
        free = np.ones(n, dtype=bool)
        self.shift = np.zeros(m, dtype=np.uint64)
        slot = np.zeros(len(keys), dtype=np.int64)
        for k in range(size.max(initial=0), 1, -1):  # the fullest buckets first, all of a size together
            own = np.flatnonzero(size[bucket] == k)
            own = own[np.argsort(bucket[own], kind="stable")].reshape(-1, k)
            d = 0
            while len(own):
                at = self.slots(h[own], g[own], np.uint64(d))
                good = free[at].all(axis=1)
                ordered = np.sort(at, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                _, first = np.unique(at[good], return_index=True)  # of two buckets at a slot the first stays
                lone = np.zeros(at[good].shape, dtype=bool).ravel()
                lone[first] = True
                good[good] = lone.reshape(-1, k).all(axis=1)
                free[at[good]] = False
                self.shift[bucket[own[good, 0]]] = d
                slot[own[good]] = at[good]
                own = own[~good]
                d += 1
        own = np.flatnonzero(size[bucket] == 1)  # lone keys take what is free; their shift is the slot itself
        slot[own] = np.flatnonzero(free)[: len(own)]
        self.lone = size == 1
        self.shift[bucket[own]] = slot[own]
        self.keys: list[bytes] = [b""] * n
        self.ids = np.full(n, -1, dtype=np.int64)
        for k, s in zip(keys, slot.tolist(), strict=True):
            self.keys[s], self.ids[s] = k, ranks[k]

    def slots(self, h: np.ndarray, g: np.ndarray, d) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (g ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            return ((x + h) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        """The id of each key, -1 where it is no vocabulary entry."""
        if not keys:
            return []
        h = np.array([xxhash.xxh3_128_intdigest(k) >> 64 for k in keys], dtype=np.uint64)
        g = np.array([xxhash.xxh3_64_intdigest(k, 7) for k in keys], dtype=np.uint64)
        own_bucket = (h % np.uint64(self.m)).astype(np.int64)
        shift = self.shift[own_bucket]
        at = np.where(self.lone[own_bucket], shift.astype(np.int64), self.slots(h, g, shift))
        ids, own = self.ids[at].tolist(), self.keys
        return [i if own[s] == k else -1 for k, s, i in zip(keys, at.tolist(), ids, strict=True)]


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the lowest-ranked neighbours merge first, the leftmost of equals."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0: merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:  # a part has changed since
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class ByteBpe:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.hash = PerfectHash(self.ranks)
        self.words = regex.compile(pattern).findall
        self.tokens = {i: k for k, i in self.ranks.items()}
        self.seen = Remembered(CACHE)
        self.heads: dict[str, bytes | None] = {}

    def pretokens_to_ids(self, words: list[bytes]) -> list[bytes]:
        whole = self.hash.find(words)
        return [np.array([i] if i >= 0 else merge_bytes(w, self.ranks), dtype="<u4").tobytes() for w, i in zip(words, whole, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        A space between two visible characters always starts a match of the pattern, so texts are cut
        there; a chunk that starts or ends with white space is left to the pattern over the whole text.
        """
        seen, words = self.seen, self.words
        cut = [t.split(" ") for t in texts]
        heads = {p[0] for p in cut} - self.heads.keys()
        new = set().union(*(p[1:] for p in cut))
        new -= seen.young.keys()
        seen.promote(new)
        pieces, whole = {}, {}
        for c in new:
            pieces[c] = words(" " + c) if c and not c[0].isspace() and not c[-1].isspace() else None
        firsts = {c: words(c) if not c or not c[0].isspace() and not c[-1].isspace() else None for c in heads}
        distinct = list({w for d in (pieces, firsts) for ws in d.values() if ws for w in ws})
        ids = dict(zip(distinct, self.pretokens_to_ids([w.encode() for w in distinct]), strict=True)).__getitem__
        for c, ws in pieces.items():
            seen.young[c] = None if ws is None else b"".join(map(ids, ws))
        self.heads.update((c, None if ws is None else b"".join(map(ids, ws))) for c, ws in firsts.items())
        get, out = seen.young.__getitem__, []
        for t, parts in zip(texts, cut, strict=True):
            head = self.heads[parts[0]]
            found = [head, *map(get, parts[1:])] if parts[0] or len(parts) == 1 else [None]
            try:
                out.append(b"".join(found))
            except TypeError:  # a chunk that does not stand alone
                ws = words(t)
                for w in dict.fromkeys(ws):
                    if w not in whole:
                        whole[w] = self.pretokens_to_ids([w.encode()])[0]
                out.append(b"".join(map(whole.__getitem__, ws)))
        for c in new:
            if len(c) > LONG:
                del seen.young[c]
        for c in heads:
            if len(c) > LONG:
                del self.heads[c]
        if len(self.heads) > 50_000:
            self.heads.clear()
        seen.turn()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(1)
def encoder(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, *, keep: list[str] | None = None, with_ids: bool = True, digests: bool = False) -> DataFrame:
    """Documents with n_tokens, and ids (array<int>) or the digests of ids and of the decoded bytes."""
    fields = [T.StructField("n_tokens", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def factory():
        from quaystone.llm.op4_byte_bpe import encoder  # the worker's own, kept between its tasks

        bpe = encoder(path, pattern)

        def fn(batch):
            ids = bpe.encode([t.decode() for t in texts_of(batch.column("text"))])
            out = [pa.array([len(x) // 4 for x in ids], pa.int64())]
            if with_ids:
                out.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
            if digests:
                out.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids]))
                out.append(pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]))
            return out

        return fn

    return with_text_columns(docs, fields, factory, keep)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"], with_ids=False, digests=True)
