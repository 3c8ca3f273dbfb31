"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks, racks have shards. A row descends from
the root: at each level every child draws ``-ln(u) / weight`` with ``u`` from a
hash of the row's key and the child's name, and the smallest draw wins. A draw
depends on its own child alone, so that raising a child's weight only moves
rows into it, and rows move only below subtrees whose weights have changed.

Every expression is a built-in function; rows are placed without a shuffle, and
slots (places within a shard) come from counts by shard and scan partition.

Defined cases: a null key is hashed as a fixed text, so that all such rows share
a shard; repeated rows each get a slot of their own; a null text has size
``overhead`` and the CRC of the empty text; a text of any length is measured whole; an empty table gives no rows; only
the named key and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_id, written


@dataclass(frozen=True)
class Node:
    """A subtree: a leaf holds a shard number, any other node its children."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple[Node, ...] = ()

    def __post_init__(self) -> None:
        if (self.shard is None) == (not self.children):
            raise ValueError(f"{self.name}: a node has either a shard or children")
        if not self.weight > 0:
            raise ValueError(f"{self.name}: the weight must be positive")


def tree(shards: int, regions: int = 2, racks: int = 3, per_rack: int = 4, weights: dict[int, float] | None = None) -> Node:
    """The tree of a shard count: full regions first, then a region for each further shard.

    A subtree weighs what its shards weigh. Shards beyond the full regions each
    open a region, so one more shard changes no weight of the subtrees there
    are, and takes rows only into itself.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    weigh = lambda s: (weights or {}).get(s, 1.0)
    in_region, out, s = racks * per_rack, [], 0

    def inner(name: str, children: list[Node]) -> Node:
        return Node(name, sum(c.weight for c in children), None, tuple(children))

    while s < shards:
        full = len(out) < regions and shards - s >= in_region
        size = in_region if full else 1
        here = list(range(s, s + size))
        groups = [here[i : i + per_rack] for i in range(0, size, per_rack)]
        name = f"region{len(out)}"
        out.append(inner(name, [inner(f"{name}/rack{r}", [Node(f"{name}/rack{r}/shard{x}", weigh(x), x) for x in g]) for r, g in enumerate(groups)]))
        s += size
    return inner("root", out)


def draw(key: Column, node: Node) -> Column:
    """An exponential draw of rate ``node.weight``, from 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(node.weight))


def place(df: DataFrame, key: Column, node: Node, out: str) -> DataFrame:
    """``df`` with the shard of each key as column ``out``, a level of the tree at a time."""
    level, at, step = {"": node}, F.lit(""), 0
    while any(n.children for n in level.values()):
        chosen, below = None, {}
        for path, n in level.items():
            if n.children:
                # The index breaks ties, so that the first of equal draws wins.
                draws = [F.struct(draw(key, c).alias("d"), F.lit(f"{path}/{i}").alias("i")) for i, c in enumerate(n.children)]
                pick = (F.least(*draws) if len(draws) > 1 else draws[0])["i"]
                below |= {f"{path}/{i}": c for i, c in enumerate(n.children)}
            else:
                pick, below[path] = F.lit(path), n
            chosen = F.when(at == path, pick) if chosen is None else chosen.when(at == path, pick)
        df = df.withColumn(f"{out}_level{step}", chosen)
        at, level, step = F.col(f"{out}_level{step}"), below, step + 1
    shards = F.create_map(*[F.lit(x) for path, n in level.items() for x in (path, n.shard)])
    return df.withColumn(out, F.element_at(shards, at)).drop(*[f"{out}_level{i}" for i in range(step)])


def shard(docs: DataFrame, node: Node, grown: Node | None = None, key: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """``key, size, text_crc32, shard, grown_shard, slot`` for every row."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("null key"))
    content = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key).alias("key"),
        k.alias("hashed"),
        (F.octet_length(content).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"),
        F.spark_partition_id().alias("block"),
        row_id().alias("rid"),
    )
    placed = place(placed, F.col("hashed"), node, "shard")
    placed = place(placed, F.col("hashed"), grown, "grown_shard") if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    placed = written(placed.drop("hashed"), "shards")
    # Two levels of counts: no task ever orders a whole shard.
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    local = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "block").orderBy("rid")) - 1)
    return local.join(before, ["shard", "block"]).select("key", "size", "text_crc32", "shard", "grown_shard", (F.col("before") + F.col("at")).alias("slot"))
