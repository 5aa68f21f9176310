"""Near-duplicate groups by SimHash with deletion-variant signatures.

A text's features are its distinct lower-cased words; a text without words is its own single feature. Each feature
votes on each of the signature's 128 bits with a sign and a weight u ** -2, u uniform, both hashed from feature and
bit; a bit is the sign of its sum. Such heavy-tailed votes make the bits that change grow in proportion to the words
that change, not with their square root as equal votes do: texts that share nine words of ten differ by about 6 bits of
128 (equal votes: 13), unrelated ones by about 60.

Two texts are linked if their signatures differ in at most MOST = 13 bits. The signature is cut into SEGMENTS = 7
segments, half as many as "one more than the allowed distance": 13 bits over 7 segments leave one that differs by at most
one bit. Every segment is indexed under each of its variants with one bit struck out, so linked signatures agree on a
variant, an equality join finds them, and the whole signature verifies them. So no link is lost: groups and numbers
of links equal those of comparing all pairs (tests compare them).

Equal signatures are one node, so thousands of exact copies cost one row. Signatures that share a variant meet in one
run of sorted rows. A run counts each node's links (a pair counts only in the first variant that it shares) and gives
the edges of a spanning forest, never all its pairs. A run of over HOT rows is split into blocks, and every two blocks meet
in a task, so no task holds a hot run. Groups are connected components, found by alternating large and
small stars.

Defined results: null and empty (or blank) texts are in no group. Copies may repeat a doc_id or lack one.
The document that stays is the one of least doc_id (nulls last), then of least text hash; of rows repeated with id and
text the one whose columns have the least hash stays. Other columns, whatever their names, pass through `deduplicate`
untouched. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltloom.llm._shared import WordIds, cut, documents, slices, spare

#: Bits, segments that they are cut into, and bits in which linked signatures differ at most.
BITS, SEGMENTS = 128, 7
MOST = 2 * SEGMENTS - 1
#: First bit of each segment, and the end.
EDGES = [s * BITS // SEGMENTS for s in range(SEGMENTS + 1)]
WORD = re.compile(r"\w+")
#: Votes of 512 bytes that a worker remembers; words at a time that vote, and bytes of text; up to so many words 32 bits hold any sum.
CACHE, CHUNK, TEXT, NARROW = 60_000, 20_000, 1 << 20, 20_000
#: Texts of more characters vote by themselves, in parts, from the hashes of their words: 8 bytes a word, not 512.
LONG = 1 << 18
#: Rows of one variant that a task holds at most.
HOT = 20_000
#: Rows that drop out of a table are broadcast up to this number (of about 170 bytes each there).
BROADCAST_ROWS = 500_000


def features(text: str) -> set[str]:
    return set(WORD.findall(text.lower())) or ({text.strip()} if text.strip() else set())


#: u ** -2 of 65,536 values of u, of 2 ** -13 at least.
_WEIGHT = np.maximum((np.arange(65_536) + 0.5) / 65_536, 2.0**-13) ** -2.0


def hashes(words: Collection[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def votes(hashed: np.ndarray) -> np.ndarray:
    """(word, bit): the whole-number vote on each bit of each word, of which the hash is given."""
    out, weights = np.empty((len(hashed), BITS), np.int32), _WEIGHT.astype(np.int32)
    step = np.arange(1, BITS // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashed), 4096):
        x = hashed[at : at + 4096, None] + step
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))).view(np.uint32)  # two bits' 32 random bits
        weight = weights[x >> np.uint32(16)]
        out[at : at + 4096] = np.where(x & np.uint32(1), weight, -weight)
    return out


def long_signs(text: str) -> np.ndarray | None:
    """The signs of a long text's votes, None for a blank one. Words are told apart by their 64-bit hashes."""
    seen, fresh, n = np.zeros(0, np.uint64), [], 0
    found = WORD.finditer(text.lower())
    while block := {m[0] for m in islice(found, CHUNK)}:
        fresh.append(hashes(block))
        n += len(block)
        if n > max(len(seen), 1_000_000):
            seen, fresh, n = np.unique(np.concatenate([seen, *fresh])), [], 0
    seen = np.unique(np.concatenate([seen, *fresh]))
    if not len(seen):
        own = features(text)
        if not own:
            return None
        seen = hashes(own)
    return sum(votes(seen[at : at + CHUNK]).sum(axis=0, dtype=np.int64) for at in range(0, len(seen), CHUNK)) > 0


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, a, b): hash of the text and the two halves of its signature, null for null and blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, table = WordIds(CACHE), np.zeros((0, BITS), np.int32)
        for whole in batches:
            for part in slices(whole, most=TEXT):
                found, lens, alone = [], np.zeros(part.num_rows, np.int64), {}
                for j, text in enumerate(part.column("text").to_pylist()):
                    if text and len(text) > LONG:
                        alone[j] = long_signs(text)
                        continue
                    own = features(text) if text else ()
                    lens[j] = len(own)
                    found.append(np.fromiter(map(ids.__getitem__, own), np.int32, len(own)))
                if ids.fresh:
                    table = np.concatenate([table, votes(hashes(ids.fresh))])
                x = np.concatenate(found) if found else np.zeros(0, np.int32)
                some = np.flatnonzero(lens)
                sig = np.zeros((len(lens), 2), np.int64)
                if len(some):
                    starts = (np.cumsum(lens) - lens)[some]
                    ends, at = starts + lens[some], 0
                    up = np.empty((len(some), BITS), bool)
                    while at < len(some):
                        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
                        kind = np.int32 if lens[some[at:to]].max() <= NARROW else np.int64
                        up[at:to] = np.add.reduceat(table[x[starts[at] : ends[to - 1]]], starts[at:to] - starts[at], axis=0, dtype=kind) > 0
                        at = to
                    sig[some] = np.packbits(up, axis=1, bitorder="little").view(np.int64)
                table = table[: ids.settle()]
                none = lens == 0
                for j, up in alone.items():
                    if up is not None:
                        sig[j], none[j] = np.packbits(up, bitorder="little").view(np.int64), False
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(sig[:, 0], mask=none), pa.array(sig[:, 1], mask=none)], names=["doc_id", "h", "a", "b"])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, h long, a long, b long")


def masks() -> np.ndarray:
    """(segment, half): the bits of each segment in either half of a signature."""
    out = np.zeros((SEGMENTS, 2), np.uint64)
    for s in range(SEGMENTS):
        for bit in range(EDGES[s], EDGES[s + 1]):
            out[s, bit // 64] |= np.uint64(1 << bit % 64)
    return out


def variants(nodes: DataFrame) -> DataFrame:
    """(key, a, b): each signature under every one-wildcard variant of every segment; the key is (struck bit, other bits)."""
    parts = []
    for lo, hi in zip(EDGES, EDGES[1:]):
        low = F.expr(f"shiftrightunsigned(a, {lo}) & {(1 << (min(hi, 64) - lo)) - 1}L") if lo < 64 else F.lit(0).cast("long")
        high = F.expr(f"shiftleft(shiftrightunsigned(b, {max(lo, 64) - 64}) & {(1 << (hi - max(lo, 64))) - 1}L, {max(lo, 64) - lo})") if hi > 64 else F.lit(0).cast("long")
        parts.append(low.bitwiseOR(high))
    segment = [s for s in range(SEGMENTS) for _ in range(EDGES[s], EDGES[s + 1])]
    keep = [~(1 << (bit - EDGES[s])) for bit, s in enumerate(segment)]
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("w") + 1)
    cutup = nodes.select("a", "b", F.array(*parts).alias("parts")).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))))
    value = F.element_at("parts", at(segment) + 1).bitwiseAND(at(keep).cast("long"))
    return cutup.select(value.bitwiseOR(F.shiftleft(F.col("w").cast("long"), 32)).alias("key"), "a", "b")


def linked(x: np.ndarray, y: np.ndarray, w: np.ndarray | int, most: int, own: np.ndarray) -> np.ndarray:
    """Whether pairs with differing bits x, y (of the two halves) are near, and w is the first variant that they share."""
    near = np.bitwise_count(x).astype(np.int64) + np.bitwise_count(y) <= most
    at = np.nonzero(near)
    if len(at[0]):
        x, y = x[at], y[at]
        w = np.broadcast_to(w, near.shape)[at]
        seg = np.searchsorted(EDGES, w, side="right") - 1
        ok = np.ones(len(x), bool)
        for s in range(SEGMENTS):
            n = np.bitwise_count(x & own[s, 0]).astype(np.int64) + np.bitwise_count(y & own[s, 1])
            ok &= np.where(seg > s, n > 1, (seg < s) | (n > 0) | (w == EDGES[s]))
        near[at] = ok
    return near


def forest(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which of the edges (one, two) between nodes 0..n-1 make a spanning forest."""
    root, use = list(range(n)), np.zeros(len(one), bool)
    for k, (i, j) in enumerate(zip(one.tolist(), two.tolist())):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        while root[j] != j:
            root[j] = root[root[j]]
            j = root[j]
        if i != j:
            root[j] = i
            use[k] = True
    return use


def product(w: int, left: np.ndarray, right: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each node of left, then right; edges of a spanning forest) of what is linked first by variant w: pairs within left, or between left and right.

    left, right: (node, half). Nodes that agree in the struck bit too share the segment's first variant, so in others only
    nodes that differ in it are compared. Nodes are taken in blocks; no list of all pairs is ever there.
    """
    own, s = masks(), int(np.searchsorted(EDGES, w, side="right")) - 1
    nodes = left if right is None else np.concatenate([left, right])
    x, y = np.ascontiguousarray(nodes[:, 0]).view(np.uint64), np.ascontiguousarray(nodes[:, 1]).view(np.uint64)
    links, edges = np.zeros(len(nodes), np.int64), np.zeros((0, 2), np.int64)
    side = np.arange(len(nodes)) >= len(left)
    struck = ((x if w < 64 else y) >> np.uint64(w % 64) & np.uint64(1)).astype(bool)
    if w == EDGES[s]:
        halves = [(np.flatnonzero(~side), np.flatnonzero(side) if right is not None else None)]
    elif right is None:
        halves = [(np.flatnonzero(~struck), np.flatnonzero(struck))]
    else:
        halves = [(np.flatnonzero(~side & (struck == k)), np.flatnonzero(side & (struck != k))) for k in (False, True)]
    for one, two in halves:
        step = max(1, 1_000_000 // max(1, len(one if two is None else two)))
        for k in range(0, len(one), step):
            i, j = one[k : k + step], one[k:] if two is None else two
            ok = linked(x[i][:, None] ^ x[j], y[i][:, None] ^ y[j], w, most, own)
            if two is None:
                ok &= np.arange(len(i))[:, None] < np.arange(len(j))
            u, v = np.nonzero(ok)
            links += np.bincount(i[u], minlength=len(links)) + np.bincount(j[v], minlength=len(links))
            more = np.concatenate([edges, np.stack([i[u], j[v]], 1)])
            edges = more[forest(len(nodes), more[:, 0], more[:, 1])]
    return links, edges, nodes


def table_of(nodes: np.ndarray, links: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows (a, b, c, d, links): edges with links 0, then nodes with theirs."""
    some = np.flatnonzero(links)
    none = np.zeros((len(edges), 1), np.int64)
    return np.concatenate([np.concatenate([nodes[edges[:, 0]], nodes[edges[:, 1]], none], 1), np.concatenate([nodes[some], nodes[some], links[some, None]], 1)])


def run_links(key: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Rows (a, b, c, d, links) of all runs of equal keys: edges that connect what is linked, links 0; and for each node (a, b) its links there."""
    nodes, own = np.stack([a, b], 1), masks()
    x, y = a.view(np.uint64), b.view(np.uint64)
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, len(key)))
    one, two, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for n in np.unique(size[size > 1]).tolist():
        starts = begin[size == n]
        if n <= 64:  # all runs of this size at once, in parts
            i, j = np.triu_indices(n, 1)
            for k in range(0, len(starts), max(1, 500_000 // len(i))):
                base = starts[k : k + max(1, 500_000 // len(i)), None]
                u, v = (base + i).ravel(), (base + j).ravel()
                ok = linked(x[u] ^ x[v], y[u] ^ y[v], key[u] >> 32, most, own)
                one.append(u[ok])
                two.append(v[ok])
            continue
        for k in starts.tolist():
            links, edges, some = product(int(key[k]) >> 32, nodes[k : k + n], None, most)
            out.append(table_of(some, links, edges))
    i, j = np.concatenate(one), np.concatenate(two)
    links = np.bincount(i, minlength=len(key)) + np.bincount(j, minlength=len(key))
    return np.concatenate([*out, table_of(nodes, links, np.stack([i, j], 1))])


def give(e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, i])) for i in range(5)], names=["a", "b", "c", "d", "links"])


def pairs(nodes: DataFrame, most: int = MOST, hot: int = HOT) -> DataFrame:
    """(a, b, c, d, links) as of `run_links`, over all variants of all nodes.

    A task holds no run of over `hot` rows: it passes the rows on, and they meet again in blocks of `hot` rows, every two
    blocks of a run in a group of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, at = [np.zeros(0, np.int64)] * 3, None, 0  # key: of the run that is passed on, of which `at` rows went by
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held)]
            while len(held[0]):
                if key is None:
                    last = int(np.searchsorted(held[0], held[0][-1]))  # the last run may go on in the next batch
                    begin = np.flatnonzero(np.append(True, held[0][1:] != held[0][:-1]))
                    big = begin[np.diff(np.append(begin, len(held[0]))) > hot]
                    stop = int(big[0]) if len(big) else last
                    if stop:
                        yield give(run_links(*(x[:stop] for x in held), most))
                        held = [x[stop:] for x in held]
                    if not len(big):
                        break
                    key, at = held[0][0], 0
                n = int(np.searchsorted(held[0], key, side="right"))
                if n:
                    yield give(np.stack([held[1][:n], held[2][:n], held[0][:n], np.arange(at, at + n), np.full(n, -1)], 1))
                    held, at = [x[n:] for x in held], at + n
                if len(held[0]):
                    key = None
        if len(held[0]):
            yield give(run_links(*held, most))

    index = variants(nodes).repartition(F.col("key")).sortWithinPartitions("key")
    found = cut(index.mapInArrow(run, "a long, b long, c long, d long, links long"))
    large = found.filter("links = -1")
    return found.filter("links >= 0") if large.isEmpty() else found.filter("links >= 0").unionByName(cut(crossed(large, most, hot)))


def crossed(large: DataFrame, most: int, hot: int) -> DataFrame:
    """Links of runs of many rows (a, b, key c, place d): every two blocks of a run are one group."""
    rows = large.select(F.col("c").alias("key"), F.expr(f"d div {hot}").alias("k"), "a", "b")
    size = rows.groupBy("key").agg((F.max("k") + 1).alias("n"))
    salted = rows.withColumn("salt", F.pmod(F.col("k"), F.lit(16))).join(size.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")))), ["key", "salt"])
    other = salted.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    met = other.select("key", F.least("k", "o").alias("low"), F.greatest("k", "o").alias("high"), (F.col("k") > F.col("o")).cast("long").alias("side"), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 6), np.int64)

        def answer(g: np.ndarray) -> pa.RecordBatch:
            left, right = g[g[:, 3] == 0][:, 4:], g[g[:, 3] == 1][:, 4:]
            links, edges, nodes = product(int(g[0, 0]) >> 32, left, right if g[0, 1] < g[0, 2] else None, most)
            return give(table_of(nodes, links, edges))

        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(6)], 1)])
            ends = np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(1)) + 1
            for k, to in zip([0, *ends[:-1]], ends):
                yield answer(held[k:to])
            if len(ends):
                held = held[ends[-1] :]
        if len(held):
            yield answer(held)

    by = met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return by.mapInArrow(run, "a long, b long, c long, d long, links long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for every node of (u, v); alternating stars.

    Every round is a checkpoint; the number of rounds grows with the logarithm of the largest diameter.
    """
    now, mark = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(now.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(small.filter("u > v").distinct())
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if new == mark:
            break
        mark = new
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def members(docs: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, root, n_links) of every document that has a near or exact copy; n_links counts different signatures linked to its own."""
    if not 0 <= most <= MOST:
        raise ValueError(f"segments find all links of 0 to {MOST} bits, not of {most}")
    sigs = cut(signatures(docs, id_col, text_col).filter("a is not null"))
    nodes = cut(sigs.groupBy("a", "b").agg(F.count("*").alias("copies")))
    found = pairs(nodes.select("a", "b"), most)
    links = found.filter("links > 0").groupBy("a", "b").agg(F.sum("links").alias("n_links"))
    roots = components(found.filter("links = 0").select(F.struct("a", "b").alias("u"), F.struct(F.col("c").alias("a"), F.col("d").alias("b")).alias("v")))
    linked = roots.join(links.select(F.struct("a", "b").alias("node"), "n_links"), "node")
    exact = nodes.filter("copies > 1").select(F.struct("a", "b").alias("node"))
    grouped = exact.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("n_links")).unionByName(linked)
    return sigs.select("doc_id", "h", F.struct("a", "b").alias("node")).join(grouped, "node").select("doc_id", "h", "root", "n_links")


def groups(docs: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, group_size, n_links, is_kept) of all documents in groups of two or more; group_id is the least doc_id."""
    own = cut(members(docs, most, id_col, text_col))
    whole = own.groupBy("root").agg(F.min(order()).alias("first"), F.count("*").alias("group_size"))
    return own.join(whole, "root").select("doc_id", F.col("first.doc_id").alias("group_id"), "group_size", "n_links", is_first().alias("is_kept"))


def order() -> F.Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))


def is_first() -> F.Column:
    return F.struct(F.col("doc_id"), F.col("h")).eqNullSafe(F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h")))


def deduplicate(docs: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: one row of each group stays; columns stay as they are.

    Only (doc_id, text hash) of the rows that go meet the documents. They are counted first: up to BROADCAST_ROWS they are
    broadcast, so texts don't move; beyond that Spark shuffles both sides once.
    """
    own = cut(members(docs, most, id_col, text_col))
    first = own.groupBy("root").agg(F.min(order()).alias("first"))
    i, h, n = (spare(docs, name) for name in ("voltloom_id", "voltloom_h", "voltloom_n"))
    verdict = own.groupBy("root", "doc_id", "h").agg(F.count("*").alias("rows")).join(first, "root").withColumn("stays", is_first())
    verdict = cut(verdict.filter("not stays or rows > 1").select(F.col("doc_id").alias(i), F.col("h").alias(h), F.col("stays").alias(n)))
    found = verdict.groupBy(n).count().collect()  # two rows at most
    small = F.broadcast if sum(r["count"] for r in found) <= BROADCAST_ROWS else lambda df: df
    key = F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(h))
    if not found:
        return docs
    out = docs.join(small(verdict), key, "left_anti")
    if not any(r[n] for r in found):
        return out
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = docs.join(small(verdict.filter(F.col(n)).select(i, h)), key)
    whole = F.xxhash64(*[c for c, f in zip(columns, docs.schema.fields) if "map<" not in f.dataType.simpleString()])
    once = again.withColumn(n, F.row_number().over(Window.partitionBy(i, h).orderBy(whole))).filter(F.col(n) == 1)
    return out.unionByName(once.select(*columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir))
