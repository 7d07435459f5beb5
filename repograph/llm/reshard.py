"""Resharding by minimum-cost flow (operator 7).

Rows lie in old shards; new shards get capacities, here row counts at most one apart. A block is the rows of one old
shard in one size class (a power of two). The flow runs from blocks, as many units as rows, into new shards: free into
the shard of the block's own number, and at the block's mean bytes a row into any other. The cheapest flow moves the fewest
bytes that blocks allow. Blocks are then cut by it, and each piece is a stretch of the block's rows in their order.

The network has (old shards x size classes) blocks whatever the data, so the driver solves it. Rows are numbered
without a window over a shard: each block is dealt into units by a hash of the text (and, in units that a group of copies
makes large, of the id or, without one, of a row number), rows are numbered within units by falling size, so the largest stay, and what units hold is added up. There are at most about UNITS
units for each old shard's class. Equal texts lie in one old shard, one block and one unit, next to each other, and are
parted only where a shard is full or their unit is a large one.

Defined cases: a null text has no bytes, and a size of 16; null ids are rows like others; rows that are equal in id and
text are interchangeable; an empty table gives an empty one; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograph.llm.storage import Workspace
from repograph.llm.textmap import free_names

SHARDS = 40
OLD_SHARDS = 64
OVERHEAD = 16
#: A unit holds about so many rows, or more where there would be over UNITS units.
UNIT_ROWS = 500
UNITS = 4096


class Network:
    """Minimum-cost flow by shortest augmenting paths with potentials; costs are not negative."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [capacity, 0]
        self.cost += [cost, -cost]
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.left[arc + 1]

    def solve(self, source: int, sink: int) -> tuple[int, int]:
        """Sends all it can; the amount and the cost."""
        n = len(self.out)
        potential = [0] * n
        sent = spent = 0
        while True:
            distance: list[int | None] = [None] * n
            distance[source] = 0
            heap = [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > distance[a]:
                    continue
                for e in self.out[a]:
                    if self.left[e]:
                        b = self.to[e]
                        new = d + self.cost[e] + potential[a] - potential[b]
                        if distance[b] is None or new < distance[b]:
                            distance[b] = new
                            heapq.heappush(heap, (new, b))
            if distance[sink] is None:
                return sent, spent
            far = max(d for d in distance if d is not None)
            for a in range(n):
                potential[a] += far if distance[a] is None else distance[a]
            more = self._augment(source, sink, potential)
            sent += more
            spent += more * (potential[sink] - potential[source])

    def _augment(self, source: int, sink: int, potential: list[int]) -> int:
        """All paths of arcs whose reduced cost is zero, depth first, each arc given up once it leads nowhere."""
        at = [0] * len(self.out)
        total = 0
        while True:
            path: list[int] = []
            on = {source}
            a = source
            while a != sink:
                while at[a] < len(self.out[a]):
                    e = self.out[a][at[a]]
                    b = self.to[e]
                    if self.left[e] and b not in on and self.cost[e] + potential[a] - potential[b] == 0:
                        break
                    at[a] += 1
                else:
                    if not path:
                        return total
                    on.discard(a)
                    a = self.to[path.pop() ^ 1]
                    at[a] += 1
                    continue
                path.append(e)
                a = b
                on.add(a)
            step = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= step
                self.left[e ^ 1] += step
            total += step


def transfers(blocks: dict[tuple[int, int], tuple[int, int]], capacities: list[int]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Of each block (old shard, class) with (rows, bytes): (new shard, rows) in order, those that stay first.

    Raises ValueError if the capacities are too small.
    """
    keys = sorted(blocks)
    shards = len(capacities)
    source, sink, pool = 0, 1, 2
    shard = [3 + j for j in range(shards)]
    block = {k: 3 + shards + i for i, k in enumerate(keys)}
    net = Network(3 + shards + len(keys))
    moved = {}
    stays = {}
    for k in keys:
        rows, size = blocks[k]
        net.arc(source, block[k], rows)
        if k[0] < shards:
            stays[k] = net.arc(block[k], shard[k[0]], rows)
        moved[k] = net.arc(block[k], pool, rows, max(1, round(size / rows)))
    total = sum(rows for rows, _ in blocks.values())
    received = [net.arc(pool, s, total) for s in shard]
    for s, capacity in zip(shard, capacities):
        net.arc(s, sink, capacity)
    sent, _ = net.solve(source, sink)
    if sent < total:
        raise ValueError(f"{total} rows don't fit into {sum(capacities)}")
    free = [[j, net.flow(a)] for j, a in enumerate(received)]
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k in keys:
        own = [(k[0], net.flow(stays[k]))] if k in stays and net.flow(stays[k]) else []
        left = net.flow(moved[k])
        while left:
            j, room = free[0]
            some = min(left, room)
            if some:
                own.append((j, some))
            left -= some
            free[0][1] -= some
            if not free[0][1]:
                free.pop(0)
        out[k] = own
    return out


def even_capacities(rows: int, old_rows: dict[int, int], shards: int) -> list[int]:
    """At most one apart; the larger ones go to the shards that held most."""
    least, extra = divmod(rows, shards)
    larger = set(sorted(range(shards), key=lambda j: (-old_rows.get(j, 0), j))[:extra])
    return [least + (j in larger) for j in range(shards)]


def pieces(units: dict[tuple[int, int, int, int], int], plan: dict[tuple[int, int], list[tuple[int, int]]]) -> list[tuple]:
    """(unit's four numbers, shard, first rank, past the last rank, slot of rank 0): the plan cut at the units' ends."""
    slots: dict[int, int] = {}
    out = []
    waiting: dict[tuple[int, int], list[list[int]]] = {k: [list(x) for x in v] for k, v in plan.items()}
    for unit in sorted(units):
        rank, queue = 0, waiting[unit[:2]]
        while rank < units[unit]:
            shard, room = queue[0]
            some = min(room, units[unit] - rank)
            slot = slots.get(shard, 0)
            out.append((*unit, shard, rank, rank + some, slot - rank))
            slots[shard] = slot + some
            rank += some
            queue[0][1] -= some
            if not queue[0][1]:
                queue.pop(0)
    return out


def reshard(
    documents: DataFrame, *, id_col: str = "doc_id", text: str = "text", old: Column | None = None, old_shards: int = OLD_SHARDS, shards: int = SHARDS, carry: bool = False
) -> DataFrame:
    """(id, size, text_crc32, old_shard, shard, slot) of every row; ``old`` is the present shard, from 0 to old_shards - 1.
    With ``carry`` also ``row``, a struct of all columns, for ``rewrite_affected``."""
    spark = documents.sparkSession
    work = Workspace(spark, "reshard")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    group = F.xxhash64(body)
    size = (F.octet_length(body) + OVERHEAD).cast("long")
    rows = documents.select(
        F.col(f"`{id_col}`").alias("id"),
        size.alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        group.alias("group"),
        (F.pmod(group, F.lit(old_shards)) if old is None else old).cast("int").alias("old"),
        F.floor(F.log2(size)).cast("int").alias("class"),
        # fixed once the table is stored; tells rows without an id apart
        F.monotonically_increasing_id().alias("number"),
        *([F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")] if carry else []),
    )
    rows = work.keep(rows, "rows")
    total = rows.count()
    target = max(UNIT_ROWS, -(-total // UNITS))
    parts = max(1, -(-total // (old_shards * target)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("group", F.lit(1)), F.lit(parts)).cast("int"))
    # at most old shards x classes x parts rows
    held = rows.groupBy("old", "class", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    large = [(r["old"], r["class"], r["part"], -(-r["n"] // target)) for r in held if r["n"] > 2 * target]
    salts = spark.createDataFrame(large, "old int, class int, part int, salts int")
    rows = rows.join(F.broadcast(salts), ["old", "class", "part"], "left")  # at most total / (2 * target) rows, so UNITS
    spread = F.when(F.col("id").isNull(), F.col("number")).otherwise(F.xxhash64("id"))
    rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(spread, "group"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    rows = work.keep(rows, "units")
    units = {(r["old"], r["class"], r["part"], 0): r["n"] for r in held if r["n"] <= 2 * target}
    for r in rows.join(F.broadcast(salts), ["old", "class", "part"], "left_semi").groupBy("old", "class", "part", "salt").count().collect():
        units[(r["old"], r["class"], r["part"], r["salt"])] = r["count"]
    blocks: dict[tuple[int, int], list[int]] = {}
    old_rows: dict[int, int] = {}
    for r in held:
        own = blocks.setdefault((r["old"], r["class"]), [0, 0])
        own[0] += r["n"]
        own[1] += r["bytes"]
        old_rows[r["old"]] = old_rows.get(r["old"], 0) + r["n"]
    plan = transfers({k: tuple(v) for k, v in blocks.items()}, even_capacities(total, old_rows, shards))
    cut = spark.createDataFrame(pieces(units, plan), "old int, class int, part int, salt int, shard int, first long, past long, base long")
    unit = ["old", "class", "part", "salt"]
    # the first ranks stay, so the largest rows do
    order = Window.partitionBy(*unit).orderBy(F.desc("size"), "group", "text_crc32", "id", "number")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    found = ranked.join(cut, unit).where("rank >= first AND rank < past")
    made = ["id", "size", "text_crc32", F.col("old").alias("old_shard"), "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot")]
    return found.select(*made, *(["row"] if carry else []))


def rewrite_affected(placed: DataFrame, path: str) -> list[int]:
    """Writes the files of the new shards that differ from the old shard of their number, as ``path``/shard=N, by slot.

    ``placed`` comes from ``reshard`` with ``carry``: each row brings its own columns, so null and repeated ids are rows like
    others. A column of the rows named ``shard`` is written as ``input_shard``. Returns the shards that were written; those
    left out need no rewriting.
    """
    work = Workspace(placed.sparkSession, "rewrite")
    placed = work.keep(placed, "placed")
    moved = placed.where("shard <> old_shard")
    changed = moved.select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    rows = placed.join(F.broadcast(changed), "shard", "left_semi")  # as many rows as there are shards
    inside = placed.schema["row"].dataType.names
    columns = [F.col("row").getField(c).alias(n) for c, n in zip(inside, free_names(inside, ["shard"]))]
    near = F.col("shard"), F.floor(F.col("slot") / 100_000)
    rows.repartition(*near).sortWithinPartitions("shard", "slot").select(*columns, "shard").write.partitionBy("shard").parquet(path)
    return sorted(r["shard"] for r in rows.select("shard").distinct().collect())


def op7_reshard_flow(spark, sf_dir: str) -> DataFrame:
    placed = reshard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )
