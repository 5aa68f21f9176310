"""Packing of documents into windows by non-negative least squares.

Lengths are counted in units of BIN tokens, rounded up. All combinations of at most DEPTH lengths that fill a
window exactly are enumerated; non-negative least squares finds how often to repeat each so that together they
use up the histogram of lengths, each length's error weighted by the length, as long pieces are the hardest to place. Repeats are rounded down (and never use more than there is); what remains is
packed greedily, longest first, each window filled with the longest lengths that still fit. All this works on the
histogram, whose size depends on the window only. Documents are then given their places by their rank among those
of equal length: ranks are counted in groups of (length, salt), with as many salts as the data need. Pieces of rows
without doc_id can't be told apart, so they are counted, not ranked.

A document of n words has n + 1 tokens (its words and an end mark); one longer than the window is cut into
full windows and a rest, nothing is dropped. Places of a window start at multiples of BIN. `token_lengths` counts the
tokens of a byte-level vocabulary instead, for windows that must hold those.

Defined results: null, empty and blank texts have no piece. Rows are packed each on its own, repeated ones and
those without doc_id too. Order within equal lengths follows doc_id (nulls first), then piece; rows equal in both
are interchangeable. An empty table gives an empty result. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltloom.llm import bpe
from voltloom.llm._shared import cut, documents

WINDOW, BIN, DEPTH = 2048, 16, 3
#: Rows of equal length that are ranked in one group, about.
GROUP_ROWS = 50_000


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All falling tuples of at most `depth` lengths that add up to `units`."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, own: tuple[int, ...]) -> None:
        if left == 0:
            out.append(own)
        elif len(own) + 1 == depth:
            if left <= most:
                out.append((*own, left))
        elif len(own) < depth:
            for x in range(min(left, most), 0, -1):
                if x * (depth - len(own)) < left:
                    break
                grow(left - x, x, (*own, x))

    grow(units, units, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lawson and Hanson's active set method: x >= 0 that makes |a x - b| least.

    It ends as each step lessens the error and no set of free columns comes twice; a column that rounding keeps from
    lessening it has to wait until another one did.
    """
    n = a.shape[1]
    ata, atb = a.T @ a, a.T @ b
    x, free = np.zeros(n), np.zeros(n, bool)
    slack = atb.copy()
    error, wait = np.inf, np.zeros(n, bool)
    while True:
        slack[free | wait] = -np.inf
        k = int(slack.argmax())
        if slack[k] <= 1e-9 * max(1.0, np.abs(atb).max()):
            break
        free[k] = True
        while True:
            own = np.flatnonzero(free)
            z = np.linalg.lstsq(ata[np.ix_(own, own)], atb[own], rcond=1e-12)[0]
            if (z > 0).all():
                x[:] = 0
                x[own] = z
                break
            down = z <= 0
            old = x[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.nanmin(np.where(down, old / (old - z), np.inf))
            x[own] = old + max(0.0, step) * (z - old)
            gone = own[down & (x[own] <= 1e-12)]
            if not len(gone):
                gone = own[down][:1]
            x[gone] = 0
            free[gone] = False
        slack = atb - ata @ x
        now = x @ (ata @ x) / 2 - atb @ x
        if now < error:
            error, wait = now, np.zeros(n, bool)
        else:
            wait[k] = True
    return x


def patterns(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a window, repeats); histogram[u] pieces of u units, u from 0 to the window's units. Uses up the histogram."""
    units, left = len(histogram) - 1, histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if left[units]:
        out.append(((units,), int(left[units])))
        left[units] = 0
    there = np.flatnonzero(left)
    made = [c for c in combinations(units, depth) if len(c) > 1 and all(left[list(c)] > 0)]
    if made and len(there):
        a = np.zeros((units + 1, len(made)))
        for k, c in enumerate(made):
            np.add.at(a[:, k], list(c), 1)
        scale = float(left.max())
        weight = np.arange(units + 1) / units
        x = nnls(a * weight[:, None], left / scale * weight) * scale
        for k in np.argsort(-x, kind="stable"):
            need = a[:, k].astype(np.int64)
            used = need > 0
            n = min(int(np.floor(x[k] + 1e-6)), int((left[used] // need[used]).min()))
            if n > 0:
                out.append((made[k], n))
                left -= n * need
    while left.any():  # the rest, longest first
        room, own, spare = units, [], left.copy()
        while True:
            fit = np.flatnonzero(spare[: room + 1])
            if not len(fit):
                break
            u = int(fit[-1])
            take = min(room // u, int(spare[u]))
            own += [u] * take
            spare[u] -= take
            room -= take * u
        need = np.bincount(own, minlength=units + 1)
        used = need > 0
        n = int((left[used] // need[used]).min())
        out.append((tuple(own), n))
        left -= n * need
    return out


def places(found: list[tuple[tuple[int, ...], int]], units: int) -> list[tuple[np.ndarray, ...]]:
    """For each length: first rank, first window, pieces a window, and first unit, of each pattern that has it."""
    rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(units + 1)]
    used, window = [0] * (units + 1), 0
    for own, n in found:
        at = 0
        for u in sorted(set(own), reverse=True):
            m = own.count(u)
            rows[u].append((used[u], window, m, at))
            used[u] += n * m
            at += m * u
        window += n
    return [tuple(np.array(r, np.int64).reshape(-1, 4).T) for r in rows]


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n): tokens of every text that has any."""
    n = F.size(F.filter(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), r"\s+"), lambda w: w != ""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), (n + 1).cast("long").alias("n")).filter("n > 1")


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, n): byte-level BPE tokens and an end mark, of every text that has any."""
    return bpe.encode(docs, vocabulary, id_col=id_col, text_col=text_col).select("doc_id", (F.col("n_tokens") + 1).alias("n")).filter("n > 1")


def pack(sizes: DataFrame, window: int = WINDOW, unit: int = BIN, depth: int = DEPTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, window_id, start) of every piece of (doc_id, n)."""
    units = window // unit
    one = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {window}")))
    cutup = sizes.filter("n > 0").select("doc_id", "n", one.alias("piece")).withColumn("size", F.least(F.lit(window).cast("long"), F.col("n") - F.col("piece") * window))
    cutup = cut(cutup.select("doc_id", "piece", "size", F.expr(f"cast((size + {unit - 1}) div {unit} as int)").alias("u")))
    counted = {r.u: r.c for r in cutup.groupBy("u").agg(F.count("*").alias("c")).collect()}  # at most `units` rows
    histogram = np.array([counted.get(u, 0) for u in range(units + 1)], np.int64)
    plan = places(patterns(histogram, depth), units)
    salts = int(max(1, histogram.max() // group_rows))
    alike = cutup.filter("doc_id is null").groupBy("u", "piece", "size").agg(F.count("*").alias("c"))
    skip = alike.groupBy("u").agg(F.sum("c").alias("skip"))
    alike = alike.withColumn("first", F.sum("c").over(Window.partitionBy("u").orderBy("piece", "size")) - F.col("c"))
    for step in (group_rows, 1):  # ranks of a group from runs of them, so that no row holds all
        last = F.least(F.col("c"), F.lit(group_rows)) if step == 1 else F.col("c")
        alike = alike.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), last - 1, F.lit(step).cast("long")))).withColumns({"first": F.col("first") + F.col("at"), "c": F.col("c") - F.col("at")})
    alike = alike.select(F.lit(None).cast(sizes.schema["doc_id"].dataType).alias("doc_id"), "piece", "size", "u", F.col("first").alias("rank"))
    salted = cutup.filter("doc_id is not null").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "size"), F.lit(salts)))
    group = salted.groupBy("u", "salt").agg(F.count("*").alias("c"))
    before = group.withColumn("before", F.sum("c").over(Window.partitionBy("u").orderBy("salt")) - F.col("c"))
    before = before.join(skip, "u", "left").select("u", "salt", (F.col("before") + F.coalesce("skip", F.lit(0))).alias("before"))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("u", "salt").orderBy("doc_id", "piece", "size"))).join(before, ["u", "salt"])
    ranked = ranked.select("doc_id", "piece", "size", "u", (F.col("before") + F.col("r") - 1).alias("rank")).unionByName(alike)
    memo = sizes.sparkSession.sparkContext.broadcast(plan)  # of the size of the histogram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            u, rank = (part.column(c).to_numpy() for c in ("u", "rank"))
            where, start = np.empty(len(u), np.int64), np.empty(len(u), np.int64)
            for x in np.unique(u):
                own = u == x
                first, base, m, at = memo.value[x]
                k = np.searchsorted(first, rank[own], side="right") - 1
                r = rank[own] - first[k]
                where[own], start[own] = base[k] + r // m[k], (at[k] + r % m[k] * x) * unit
            piece = part.column("piece").to_numpy()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("piece"), pa.array(piece * window), part.column("size"), pa.array(where), pa.array(start)], names=["doc_id", "piece", "first_token", "n_tokens", "window_id", "start"])

    return ranked.mapInArrow(run, f"doc_id {sizes.schema['doc_id'].dataType.simpleString()}, piece long, first_token long, n_tokens long, window_id long, start long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(lengths(documents(spark, sf_dir)))
