"""Byte-level BPE encoding and decoding.

A text is cut into pretokens by the vocabulary's pattern. Over the bytes of a pretoken lies a segment
tree whose leaves hold the rank of the pair that starts there; its root is the leftmost pair of least
rank. A merge joins that pair and updates three leaves (the pair, the swallowed right part, the live
left neighbour), each in logarithmic time. Short pretokens are merged many at a time, one numpy tree
each; long ones (over `LONG` bytes) by a plain tree of their own.

Defined results: a null text has null tokens and a null count and round trip; an empty text has no
tokens and round-trips. Repeated rows are encoded each on its own; other columns are left out.
Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from voltloom.llm._shared import WordIds, documents, only, pieces, ragged, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 512
NONE = np.int64(1) << 62


class Vocabulary:
    """Ranks of byte strings, and of pairs of ranks that some token joins."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, n in ranks.items():
            self.tokens[n] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {(ranks[t[:i]], ranks[t[i:]]): n for t, n in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys = np.array([a << 32 | b for a, b in self.pairs], np.uint64)
        bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.found = np.full(1 << bits, 1 << 63, np.uint64), np.full(1 << bits, NONE, np.int64)
        values, at, self.probes = np.array(list(self.pairs.values()), np.int64), self._slot(keys), 0
        while len(keys):  # open addressing, all keys at once: the first that asks for a free slot gets it
            self.probes += 1
            free = self.keys[at] == np.uint64(1 << 63)
            _, first = np.unique(at, return_index=True)
            won = np.zeros(len(keys), bool)
            won[first] = True
            won &= free
            self.keys[at[won]], self.found[at[won]] = keys[won], values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & self.mask
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ranks; NONE where no token joins it."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at, out, todo = self._slot(key), np.full(len(key), NONE, np.int64), np.arange(len(key))
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == key
            out[todo[hit]] = self.found[at[hit]]
            go = ~hit & (held != np.uint64(1 << 63))
            if not go.any():
                break
            key, at, todo = key[go], (at[go] + 1) & self.mask, todo[go]
        return out

    def one(self, data: bytes) -> list[int]:
        """Tokens of one pretoken, by a segment tree in plain lists."""
        tok, n = self.byte[np.frombuffer(data, np.uint8)].tolist(), len(data)
        size = 1 << max(0, n - 1).bit_length()
        pairs, none = self.pairs, (1 << 62, 0)
        tree = [none] * (2 * size)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            r = pairs.get((tok[i], tok[i + 1]))
            if r is not None:
                tree[size + i] = (r, i)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: tuple[int, int]) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                best = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == best:
                    break
                tree[k] = best

        while tree[1] != none:
            r, i = tree[1]
            j = nxt[i]
            tok[i], tok[j] = r, -1
            after = nxt[i] = nxt[j]
            put(j, none)
            if after < n:
                prv[after] = i
                x = pairs.get((r, tok[after]))
                put(i, none if x is None else (x, i))
            else:
                put(i, none)
            before = prv[i]
            if before >= 0:
                x = pairs.get((tok[before], r))
                put(before, none if x is None else (x, before))
        return [t for t in tok if t >= 0]

    def many(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pretokens of at most LONG bytes, as (all tokens, number for each)."""
        lens = np.fromiter(map(len, data), np.int64, len(data))
        flat = self.byte[np.frombuffer(b"".join(data), np.uint8)]
        starts = np.cumsum(lens) - lens
        out: list[tuple[np.ndarray, np.ndarray]] = []
        width = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(lens, 1))).astype(np.int64))
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            for part in np.array_split(rows, -(-len(rows) * int(w) // 400_000)):
                out.append((part, self._trees(flat, starts[part], lens[part], int(w))))
        counts = np.zeros(len(data), np.int64)
        for part, tok in out:
            counts[part] = (tok >= 0).sum(1)
        result, begin = np.empty(int(counts.sum()), np.int64), np.cumsum(counts) - counts
        for part, tok in out:
            result[ragged(begin[part], counts[part])] = tok[tok >= 0]
        return result, counts

    def _trees(self, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, w: int) -> np.ndarray:
        b, steps = len(starts), np.arange(w)
        there = steps < lens[:, None]
        final = np.full((b, w), -1, np.int64)
        final[there] = flat[ragged(starts, lens)]
        tok, rows = np.concatenate([final, np.full((b, 1), -1)], 1), np.arange(b)
        nxt = np.broadcast_to(np.minimum(steps + 1, w), (b, w)).copy()
        nxt[steps + 1 >= lens[:, None]] = w
        prv = np.broadcast_to(np.append(steps, w) - 1, (b, w + 1)).copy()
        tree = np.full((b, 2 * w), NONE, np.int64)
        r, c = np.nonzero(there[:, 1:])
        x = self.rank(tok[r, c], tok[r, c + 1])
        tree[r, w + c] = np.where(x == NONE, NONE, x << 20 | c)
        level = w >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1
        while True:
            best = tree[:, 1]
            live = best != NONE
            if not live.any():
                break
            if live.sum() < 0.7 * len(live):  # done trees leave the batch
                final[rows[~live]] = tok[~live, :w]
                tok, nxt, prv, tree, rows, best = tok[live], nxt[live], prv[live], tree[live], rows[live], best[live]
                live = np.ones(len(rows), bool)
            k = np.flatnonzero(live)
            i, new = best[k] & ((1 << 20) - 1), best[k] >> 20
            j = nxt[k, i]
            after, before = nxt[k, j], prv[k, i]
            tok[k, i], tok[k, j], nxt[k, i], prv[k, after] = new, -1, after, i
            has_after, has_before = after < w, before >= 0
            ranks = self.rank(np.concatenate([new[has_after], tok[k[has_before], before[has_before]]]), np.concatenate([tok[k[has_after], after[has_after]], new[has_before]]))
            right, left = np.full(len(k), NONE), np.full(len(k), NONE)
            right[has_after], left[has_before] = ranks[: has_after.sum()], ranks[has_after.sum() :]
            tree[k, w + j] = NONE
            tree[k, w + i] = np.where(right == NONE, NONE, right << 20 | i)
            kb, lb = k[has_before], left[has_before]
            tree[kb, w + before[has_before]] = np.where(lb == NONE, NONE, lb << 20 | before[has_before])
            row, node = np.concatenate([k, k, kb]), np.concatenate([j, i, before[has_before]]) + w
            while len(node) and node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        final[rows] = tok[:, :w]
        return final


class Encoder:
    """Encodes batches; remembers what the first CACHE_WORDS different pretokens become."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN) -> None:
        self.v, self.find, self.words = Vocabulary(path), regex.compile(pattern).findall, WordIds()
        self.pool, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(All tokens of all texts, number for each text)."""
        ids, per = [], np.zeros(len(texts), np.int64)
        known = self.words.__getitem__
        for k, text in enumerate(texts):
            for piece in pieces(text):
                found = self.find(piece)
                ids.append(np.fromiter(map(known, found), np.int32, len(found)))
                per[k] += len(found)
        self._learn()
        at = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        lens = self.count[at]
        tokens = self.pool[ragged(self.start[at], lens)]
        ends = np.append(0, np.cumsum(lens))
        bounds = np.append(0, np.cumsum(per))
        if (stay := self.words.settle()) < len(self.count):
            self.start, self.count = self.start[:stay], self.count[:stay]
            self.pool = self.pool[: int(self.count.sum())]
        return tokens, np.diff(ends[bounds])

    def _learn(self) -> None:
        data = [w.encode("utf-8", "surrogatepass") for w in self.words.fresh]
        if not data:
            return
        size = np.fromiter(map(len, data), np.int64, len(data))
        short = np.flatnonzero(size <= LONG)
        flat, some = self.v.many([data[k] for k in short])
        counts = np.zeros(len(data), np.int64)
        counts[short] = some
        far = {int(k): self.v.one(data[k]) for k in np.flatnonzero(size > LONG)}
        for k, tokens in far.items():
            counts[k] = len(tokens)
        begin, pool = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.int32)
        pool[ragged(begin[short], some)] = flat
        for k, tokens in far.items():
            pool[begin[k] : begin[k] + counts[k]] = tokens
        self.start = np.concatenate([self.start, begin + len(self.pool)])
        self.count = np.concatenate([self.count, counts])
        self.pool = np.concatenate([self.pool, pool])
        self.words.fresh = []

    def decode(self, tokens: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(All bytes of all texts, number for each text)."""
        size = self.v.size[tokens]
        ends, bounds = np.append(0, np.cumsum(size)), np.append(0, np.cumsum(per))
        return self.v.pool[ragged(self.v.start[tokens], size)], np.diff(ends[bounds])


_made: dict[tuple[str, str], Encoder] = {}


def encoder(path: str = VOCABULARY, pattern: str = PATTERN) -> Encoder:
    if (path, pattern) not in _made:
        _made[path, pattern] = Encoder(path, pattern)
    return _made[path, pattern]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every text: (id, n_tokens, tokens, round_trip); round_trip says that decoding gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        for whole in batches:
            for part in slices(whole):
                texts = part.column("text").to_pylist()
                null = np.array([t is None for t in texts], bool)
                tokens, per = enc.batch([t or "" for t in texts])
                back, size = enc.decode(tokens, per)
                raw = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
                lens = np.fromiter((0 if t is None else len(t.encode()) for t in texts), np.int64, len(texts))
                ok = size == lens
                if len(back) == len(raw):
                    wrong = np.append(0, np.cumsum(back != raw))
                    at = np.append(0, np.cumsum(size))
                    ok &= np.diff(wrong[at]) == 0
                offsets = pa.array(np.append(0, np.cumsum(per)).astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(np.append(0, np.cumsum(per)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(per, mask=null), pa.ListArray.from_arrays(offsets, pa.array(tokens.astype(np.int32))), pa.array(ok, mask=null)],
                    names=["doc_id", "n_tokens", "tokens", "round_trip"],
                )

    source = only(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, tokens array<int>, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens). Null tokens give a null text; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary, pattern).v.tokens
        for part in batches:
            texts = [None if t is None else b"".join(map(tokens.__getitem__, t)).decode("utf-8", "replace") for t in part.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    source = encoded.select("doc_id", "tokens")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))
