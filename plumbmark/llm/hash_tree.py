"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child of the node reached so far draws a
straw ln(u) / weight, u being a hash of the row's key, the level and the child's name, and the longest
straw (the largest value) wins. A child's share is its share of the weights, and a draw depends on nothing
but the key and that child, so a changed weight moves rows only into or out of the subtree that holds it.

Law: `key`. A row's shard depends on its doc_id and on the number of shards. The first `BASE` shards fill
regular regions; every later shard is a region of its own, so that its straw is the only one that is new
and one more shard takes rows into itself only.

Defined results: a null text is empty; a null doc_id draws by its text's checksum, which spreads such rows; rows that
repeat a doc_id share a shard and get slots of their own, in the order of doc_id, checksum and size; an
empty table gives no rows; columns of the input besides doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbmark.session import table

SHARDS, BASE, RACKS, PER_RACK = 40, 40, 4, 5
#: Rows of a shard are numbered in so many chunks, each of them sorted alone.
CHUNKS = 256
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class Tree:
    """weights[region][rack][shard]; shards are numbered from 0 in that order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def of(shards: int, base: int = BASE, racks: int = RACKS, per_rack: int = PER_RACK) -> Tree:
        """So many shards of weight 1: full regions up to base, then one region for each further shard."""
        if shards < 1:
            raise ValueError("a tree has one shard at least")
        regular, regions, room = min(shards, base), [], racks * per_rack
        for at in range(0, regular, room):
            here = min(room, regular - at)
            regions.append(tuple((1.0,) * min(per_rack, here - r) for r in range(0, here, per_rack)))
        return Tree(tuple(regions) + (((1.0,),),) * (shards - regular))

    def with_weight(self, region: int, rack: int, shard: int, weight: float) -> Tree:
        """The same tree with one shard's weight changed."""
        w = [[list(r) for r in g] for g in self.weights]
        w[region][rack][shard] = float(weight)
        return Tree(tuple(tuple(tuple(r) for r in g) for g in w))

    @property
    def count(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)


def _straw(key: list[Column], child: Column, weight: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(*key, child), 12).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return F.when(weight > 0, F.log(u) / weight).otherwise(F.lit(float("-inf")))


def _longest(key: list[Column], weights: Column, tag: Column) -> Column:
    """Index of the child with the longest straw; equal straws go to the first."""
    straws = F.transform(weights, lambda w, i: F.struct(_straw([*key, tag], i, w).alias("straw"), (-i).alias("at")))
    return -F.array_max(straws)["at"]


def place(key: list[Column], tree: Tree) -> Column:
    """The shard's number in the tree, as an int column."""
    number, racks, shards, first = 0, [], [], []
    for region in tree.weights:
        racks.append([float(sum(rack)) for rack in region])
        shards.append([[float(w) for w in rack] for rack in region])
        first.append([])
        for rack in region:
            first[-1].append(number)
            number += len(rack)
    doubles = T.ArrayType(T.DoubleType())
    at = lambda values, i: F.element_at(F.lit(values) if not isinstance(values, Column) else values, (i + 1).cast("int"))
    nested = lambda rows, kind: F.from_json(F.lit(str(rows)), kind)  # noqa: E731  a constant; the optimizer folds it
    region = _longest(key, F.array(*[F.lit(sum(r)) for r in racks]), F.lit("region"))
    # each level names the node it descends from, so that draws of different subtrees are independent
    return F.transform(
        F.array(region),
        lambda g: F.transform(
            F.array(_longest(key, at(nested(racks, T.ArrayType(doubles)), g), F.concat(F.lit("rack/"), g.cast("string")))),
            lambda r: at(at(nested(first, T.ArrayType(T.ArrayType(T.IntegerType()))), g), r)
            + _longest(key, at(at(nested(shards, T.ArrayType(T.ArrayType(doubles))), g), r), F.concat(F.lit("shard/"), g.cast("string"), F.lit("/"), r.cast("string"))),
        )[0],
    )[0].cast("int")


def assign(docs: DataFrame, tree: Tree, grown: Tree | None = None, chunks: int = CHUNKS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row; slots of a shard count from 0 without gaps."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = [F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null/"), F.col("text_crc32").cast("string")))]
    rows = rows.withColumn("shard", place(key, tree)).withColumn("grown_shard", place(key, grown) if grown else F.lit(None).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "doc_id", "text_crc32", "size"), F.lit(chunks)).cast("int"))
    # at most shards x chunks counts, whatever the number of rows
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"), "grown_shard"
    )


def op6_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), Tree.of(SHARDS), Tree.of(SHARDS + 1))


QUERIES = {"op6_hash_tree_sharding": op6_hash_tree_sharding}
ORACLES: dict[str, str] = {}
