"""Written intermediate tables and size-bounded ordered blocks.

Two things recur in the operators:

* a result that is read more than once is written as a Parquet table in the
  folder all executors share, so that losing an executor costs a re-read and
  not a recomputation with other partition bounds;
* an ordered pass over groups of which one may hold a third of all rows. The
  rows are range-partitioned by (key, order), so a large key spans several
  blocks, and what crosses a block's edge is carried in a table that has one
  row per block.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "_blk"
#: A side of at most this many rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of input files that one ordered block stands for, about.
BLOCK_BYTES = 128 << 20
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where it is unset (single machine only)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="aforetime-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back; the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Delete the tables that `written` made in this session; results that still read them can't be computed afterwards."""
    for path in _written:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.clear()


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if its rows (counted, unless an upper bound is given) are few."""
    if rows is None:
        rows = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, as the optimizer knows them; inputs of unknown size count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 2**62)


def block_count(df: DataFrame) -> int:
    """How many ordered blocks df is cut into: one per BLOCK_BYTES read, and no fewer than shuffle partitions."""
    return max(shuffle_parts(df.sparkSession), -(-input_bytes(df) // BLOCK_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files would occupy less than half of them (few files, costly rows)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def ordered_blocks(df: DataFrame, order: Sequence[str | Column], label: str, parts: int | None = None) -> DataFrame:
    """Range-partition df by `order` and write it with its block number in `_blk`.

    Block numbers ascend with the order. Rows equal in all of `order` share a
    block, so `order` must reach down to a nearly unique column, or equal rows
    must have been aggregated before.
    """
    parts = parts or block_count(df)
    return written(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(BLOCK, F.spark_partition_id()), label
    )


def neighbour(
    blocks: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], *, after: bool, name: str,
    among: Column | None = None,
) -> DataFrame:
    """Add struct column `name`: `columns` of the row before (or after) in the same key, null at the key's ends.

    With `among` it is the nearest row for which that holds. `blocks` comes
    from ordered_blocks(keys + order). Within a block this is a window; across
    an edge the value comes from the nearest block that has such a row, of
    which there is one per block.
    """
    keys, order = list(keys), list(order)
    at = F.struct(*[F.col(c) for c in [*keys, *order]])
    payload = F.struct(*[F.col(c) for c in columns])
    near = F.struct(F.struct(*[F.col(c) for c in keys]).alias("k"), payload.alias("p"))
    # the walk goes away from the side on which the neighbour is looked for
    way = F.desc if after else F.asc
    walk = Window.partitionBy(BLOCK).orderBy(*[way(c) for c in [*keys, *order]])
    pick = F.min_by if after else F.max_by
    if among is None:
        inside, last = F.lag(near).over(walk), pick(near, at)
    else:
        passed = walk.rowsBetween(Window.unboundedPreceding, -1)
        inside = F.last(F.when(among, near), ignorenulls=True).over(passed)
        last = pick(near, F.when(among, at))
    edges = blocks.groupBy(BLOCK).agg(last.alias("_edge"))
    # one row per block: as many rows as the range partitioning has partitions
    beside = Window.partitionBy(F.lit(0)).orderBy(way(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(BLOCK, F.last("_edge", ignorenulls=True).over(beside).alias("_edge"))
    seen = blocks.withColumn("_near", inside).join(F.broadcast(edges), BLOCK, "left")
    seen = seen.withColumn("_near", F.coalesce("_near", "_edge"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"_near.k.{c}").eqNullSafe(F.col(c))
    return seen.withColumn(name, F.when(same, F.col("_near.p"))).drop("_near", "_edge")


def running_sums(
    df: DataFrame, group: Sequence[str], order: Sequence[str], columns: dict[str, str], label: str
) -> DataFrame:
    """df with running sums (new name → column) by `order` within each group, however large a group is.

    Rows are sorted in blocks; a block's sums start from the totals of the
    group's earlier blocks. Rows equal in group and order must be aggregated
    before.
    """
    group, order = list(group), list(order)
    blocks = ordered_blocks(df, [*group, *order], label)
    totals = blocks.groupBy(BLOCK, *group).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in columns.items()])
    earlier = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        F.col(BLOCK).alias("_of_blk"), *[F.col(g).alias(f"_g_{g}") for g in group],
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_t_{n}") for n in columns],
    )
    same = F.col("_of_blk") == F.col(BLOCK)
    for g in group:
        same = same & F.col(f"_g_{g}").eqNullSafe(F.col(g))
    inside = Window.partitionBy(BLOCK, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocks.withColumns(
        {f"_s_{n}": F.sum(c).over(inside) for n, c in columns.items()}
    ).join(small_side(before), same)
    return summed.select(*df.columns, *[(F.col(f"_s_{n}") + F.col(f"_t_{n}")).alias(n) for n in columns])
