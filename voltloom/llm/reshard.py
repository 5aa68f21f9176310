"""Resharding by minimum-cost flow.

The old shards are the files of a table, their sizes the bytes of their rows; new shards have capacities. Bytes
that stay in the shard of the same number cost nothing, all others cost one each. Minimum-cost flow (shortest
augmenting levels with potentials, a blocking flow on each) says how many bytes go from every old to every new
shard, moving the fewest. Each flow is a block: a run of consecutive rows of the old file, cut at whole rows.
Shards that neither lose nor receive a block are not touched; the files of the others are written again.

The flow has a node for each file and each new shard and a hub between them, so it grows with the number of
files, not of their pairs. Row sizes are summed and cut on (file, row number, bytes) only, in chunks of CHUNK rows, so
a large file is no single task. Blocks are counted; up to BROADCAST_BLOCKS they are broadcast to the files' rows, beyond
that both meet by (file, chunk). So text crosses one exchange: that which brings each affected shard's rows to the
task that writes it, in order of old shard and row.

Defined results: rows with null columns, repeated rows and empty texts are rows like all others (a null text has
0 bytes, every row ROW_BYTES more). A shard may exceed its capacity by less than one row for each block it receives.
Capacities below the total size raise ValueError. An empty table has no shards and an empty plan. Columns, whatever
their names, are written as they are.
"""

from __future__ import annotations

import uuid
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltloom.llm._shared import cut, shared_dir, spare

TARGET_BYTES = 128 << 20
ROW_BYTES = 16
#: Rows of a file whose sizes are summed in one group; blocks (of about 150 bytes) that are broadcast.
CHUNK, BROADCAST_BLOCKS = 1 << 16, 200_000


class Flow:
    """Minimum-cost flow with integer capacities and costs."""

    def __init__(self, nodes: int) -> None:
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.edges[a].append(len(self.to))
        self.edges[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [capacity, 0]
        self.cost += [cost, -cost]
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> tuple[int, int]:
        """(flow, cost). Each round finds least costs from the source, then a blocking flow along them."""
        flow = total = 0
        while True:
            inf = 1 << 60
            dist, queued = [inf] * len(self.edges), [False] * len(self.edges)
            dist[source], queue = 0, deque([source])
            while queue:
                a = queue.popleft()
                queued[a] = False
                for e in self.edges[a]:
                    if self.left[e] and dist[a] + self.cost[e] < dist[b := self.to[e]]:
                        dist[b] = dist[a] + self.cost[e]
                        if not queued[b]:
                            queued[b] = True
                            queue.append(b)
            if dist[sink] == inf:
                return flow, total
            at, on = [0] * len(self.edges), [False] * len(self.edges)
            path: list[int] = []
            node = source
            on[source] = True
            while True:  # a path is kept up to where it was cut
                if node == sink:
                    push = min(self.left[e] for e in path)
                    flow += push
                    total += push * dist[sink]
                    keep = len(path)
                    for k, e in reversed(list(enumerate(path))):
                        self.left[e] -= push
                        self.left[e ^ 1] += push
                        if not self.left[e]:
                            keep = k
                    for e in path[keep:]:
                        on[self.to[e]] = False
                    node = self.to[path[keep] ^ 1]
                    path = path[:keep]
                elif at[node] < len(self.edges[node]):
                    e = self.edges[node][at[node]]
                    b = self.to[e]
                    if self.left[e] and not on[b] and dist[b] == dist[node] + self.cost[e]:
                        path.append(e)
                        on[b] = True
                        node = b
                    else:
                        at[node] += 1
                elif path:
                    on[node] = False
                    node = self.to[path.pop() ^ 1]
                    at[node] += 1
                else:
                    break


def transfers(old: list[int], new: list[int]) -> list[tuple[int, int, int]]:
    """(old shard, new shard, bytes) of a plan that moves the fewest bytes; what stays comes first for each old shard."""
    if sum(old) > sum(new):
        raise ValueError(f"the new shards hold {sum(new)} bytes, {sum(old)} are there")
    n, m = len(old), len(new)
    f, source, hub, sink = Flow(n + m + 3), n + m, n + m + 1, n + m + 2
    for i, size in enumerate(old):
        f.add(source, i, size, 0)
    stay = [f.add(i, n + i, old[i], 0) for i in range(min(n, m))]
    out = [f.add(i, hub, size, 1) for i, size in enumerate(old)]
    into = [f.add(hub, n + j, size, 0) for j, size in enumerate(new)]
    for j, size in enumerate(new):
        f.add(n + j, sink, size, 0)
    f.run(source, sink)
    plan = [(i, i, f.left[e ^ 1]) for i, e in enumerate(stay) if f.left[e ^ 1]]
    gets = deque([j, f.left[e ^ 1]] for j, e in enumerate(into) if f.left[e ^ 1])
    for i, e in enumerate(out):
        give = f.left[e ^ 1]
        while give:
            j, room = gets[0]
            some = min(give, room)
            plan.append((i, j, some))
            give -= some
            gets[0][1] -= some
            if not gets[0][1]:
                gets.popleft()
    return sorted(plan, key=lambda p: (p[0], p[1] != p[0], p[1]))


def rows(spark: SparkSession, paths: list[str], text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """The table with three more columns (file, row number, bytes), and their names."""
    df = spark.read.parquet(*paths)
    names = [spare(df, n) for n in ("voltloom_file", "voltloom_row", "voltloom_bytes")]
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long") + ROW_BYTES
    return df.select("*", F.col("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1]), size.alias(names[2])), names


class Plan:
    """files: those of the old shards in order; blocks: (file, old shard, first row, last row, new shard, bytes, rows)."""

    def __init__(self, files: list[str], capacities: list[int], blocks: DataFrame | None, moved: int) -> None:
        self.files, self.capacities, self.blocks, self.moved = files, capacities, blocks, moved


def plan(spark: SparkSession, path: str, capacities: list[int] | None = None, target_bytes: int = TARGET_BYTES, text_col: str = "text") -> Plan:
    """Equal capacities of at most target_bytes where none are given."""
    table, (file, row, size) = rows(spark, [path], text_col)
    slim = cut(table.select(F.col(file).alias("file"), F.col(row).alias("row"), F.col(size).alias("size")))
    shards = sorted((r.file, r.total) for r in slim.groupBy("file").agg(F.sum("size").alias("total")).collect())  # a row for each file
    if not shards:
        return Plan([], capacities or [], None, 0)
    old = [t for _, t in shards]
    if capacities is None:
        n = max(1, -(-sum(old) // target_bytes))
        capacities = [-(-sum(old) // n)] * n
    found = transfers(old, capacities)
    cuts, at = [], {}
    for i, j, b in found:
        start = at.get(i, 0)
        cuts.append((shards[i][0], i, j, start, start + b))
        at[i] = start + b
    table_of = spark.createDataFrame(cuts, "file string, old int, new int, low long, high long")
    slim = slim.withColumn("chunk", F.expr(f"row div {CHUNK}"))
    whole = slim.groupBy("file", "chunk").agg(F.sum("size").alias("total"))
    before = whole.select("file", "chunk", (F.sum("total").over(Window.partitionBy("file").orderBy("chunk")) - F.col("total")).alias("before"), "total")
    # of each chunk the blocks that it touches; a row belongs to the block in which its first byte lies
    near = before.join(F.broadcast(table_of) if len(cuts) <= BROADCAST_BLOCKS else table_of, "file").filter("before < high and before + total > low")
    own = slim.withColumn("begin", F.sum("size").over(Window.partitionBy("file", "chunk").orderBy("row")) - F.col("size"))
    own = own.join(near.drop("total"), ["file", "chunk"]).filter("before + begin >= low and before + begin < high")
    blocks = own.groupBy("file", "old", "new").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return Plan([f for f, _ in shards], capacities, cut(blocks), sum(b for i, j, b in found if i != j))


def assigned(spark: SparkSession, paths: list[str], blocks: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows of the blocks with (old shard, new shard, bytes, row number in the old shard), and these columns' names."""
    table, (file, row, size) = rows(spark, paths, text_col)
    old, new, first, last, chunk = (spare(table, f"voltloom_{n}") for n in ("old", "new", "first", "last", "chunk"))
    blocks = blocks.select(F.col("file").alias(file), F.col("old").alias(old), F.col("new").alias(new), F.col("first_row").alias(first), F.col("last_row").alias(last))
    inside = F.col(row).between(F.col(first), F.col(last))
    if blocks.count() <= BROADCAST_BLOCKS:
        out = table.join(F.broadcast(blocks), (table[file] == blocks[file]) & inside)
        return out.drop(blocks[file]).drop(file, first, last), [old, new, size, row]
    blocks = blocks.withColumn(chunk, F.explode(F.sequence(F.expr(f"{first} div {CHUNK}"), F.expr(f"{last} div {CHUNK}"))))
    out = table.withColumn(chunk, F.expr(f"{row} div {CHUNK}")).join(blocks, [file, chunk]).filter(inside)
    return out.drop(file, chunk, first, last), [old, new, size, row]


def rewrite(spark: SparkSession, path: str, made: Plan, to: str, text_col: str = "text") -> list[int]:
    """Write the affected new shards below `to`, as folders shard=N of one file each; returns their numbers. Others stay where they are."""
    blocks = made.blocks.select("old", "new").distinct().collect() if made.blocks is not None else []  # of the number of files
    affected = sorted({r.new for r in blocks if r.old != r.new} | {r.old for r in blocks if r.old != r.new and r.old < len(made.capacities)})
    if not affected:
        return []
    sources = [made.files[i] for i in sorted({r.old for r in blocks if r.new in affected})]
    numbers = spark.createDataFrame(list(enumerate(affected)), "task int, new int")
    place = made.blocks.join(numbers, "new").withColumn("new", F.col("new") * F.lit(1 << 32) + F.col("task"))
    table, (old, new, size, row) = assigned(spark, sources, place, text_col)
    shard = spare(table, "shard")
    table = table.repartitionById(len(affected), F.col(new).bitwiseAND((1 << 32) - 1).cast("int"))  # a task for each shard
    table = table.withColumn(shard, F.shiftright(new, 32).cast("int")).sortWithinPartitions(shard, old, row)
    table.drop(old, new, size, row).write.partitionBy(shard).parquet(to)
    return affected


def op6_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, old_shard, new_shard, n_bytes, moved) of every document; the affected shards are written to the shared folder."""
    path = f"{sf_dir}/documents.parquet"
    made = plan(spark, path)
    if made.blocks is None:
        return spark.read.parquet(path).selectExpr("doc_id", "0 old_shard", "0 new_shard", "0L n_bytes", "false moved")
    rewrite(spark, path, made, f"{shared_dir(spark)}/reshard-{uuid.uuid4().hex}")
    table, (old, new, size, _) = assigned(spark, [path], made.blocks)
    return table.select("doc_id", F.col(old).alias("old_shard"), F.col(new).alias("new_shard"), F.col(size).alias("n_bytes"), (F.col(old) != F.col(new)).alias("moved"))
