"""Helpers for jobs that need several dependent rounds.

Every round ends in a table written to the shared folder named by
``spark.checkpoint.dir`` and read back, so that a lost executor costs one
round at most and the plan of a round never contains the rounds before it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from threading import get_ident

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where the session names none and is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shapelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Beyond so many bytes a table that was written is never broadcast: Spark's own threshold.
SMALL = 10 << 20


def sorted_join(df: DataFrame) -> DataFrame:
    """Marks a table whose joins sort both sides, however small Spark takes it to be.

    Spark sees the size of compressed files, or that of the rows before an
    explode. Of pixels, that is a hundredth of what a broadcast would put into
    the driver.
    """
    return df.hint("merge")


def _width(kind: DataType) -> int:
    """About the bytes of a value in one of Spark's rows; what has no fixed length counts as a short text."""
    if isinstance(kind, StructType):
        return 16 + sum(_width(f.dataType) for f in kind)
    return 40 if isinstance(kind, (StringType, BinaryType, ArrayType, MapType)) else 8


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes a table to the shared folder and returns it as read from there, its joins sorted if its rows are many."""
    return counted(df, *partition_by)[0]


def counted(df: DataFrame, *partition_by: str) -> tuple[DataFrame, int]:
    """A table as ``written`` returns it, and its rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    for paths in _open.get(get_ident(), ()):
        paths.append(path)
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.partitionBy(*partition_by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    n = rows.get["n"]
    # A broadcast holds a row, its key, which may be as long, and places of both.
    return (sorted_join(table) if n * (2 * _width(df.schema) + 16) > SMALL else table), n


def discard(table: DataFrame) -> None:
    """Removes the files of a table that ``written`` returned and that nothing reads any more."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("round-"):
            _remove(spark, folder)


def _remove(spark: SparkSession, folder) -> None:
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: The paths written since each ``result_only`` that is under way, by thread: a plain value, as functions travel with their modules.
_open: dict[int, tuple[list[str], ...]] = {}


def result_only(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` describes, written; all others that were written on the way to it go.

    What ``make`` writes must not be read by anything but its result.
    """
    paths: list[str] = []
    me = get_ident()
    outer = _open.get(me, ())
    _open[me] = (*outer, paths)
    try:
        table = written(make())
    finally:
        if outer:
            _open[me] = outer
        else:
            del _open[me]
    for path in paths[:-1]:  # the last is the table's own
        _remove(table.sparkSession, table.sparkSession._jvm.org.apache.hadoop.fs.Path(path))
    return table


def until_stable(
    state: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Callable[[DataFrame], object]
) -> DataFrame:
    """Applies ``step`` until ``measure`` (a small aggregate) stops changing; a round's table goes when the next is there.

    There is no limit on the rounds: a step has to make progress that ends.
    """
    before, last = measure(state), None
    while True:
        state = written(step(state))
        if last is not None:
            discard(last)
        now = measure(state)
        if now == before:
            return state
        before, last = now, state


def _star_measure(stars: DataFrame) -> tuple:
    """Size and checksum of an edge table: equal for equal tables."""
    return tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first())


#: Up to so many edges, some 20 MB with their ends, a round is one task: to deal them out takes longer than to join them.
FEW_EDGES = 1 << 18


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Labels every node that has an edge with the smallest node of its component.

    Alternates large-star and small-star: each points nodes at the smallest
    neighbour known, which takes a number of rounds that grows with the
    logarithm of the longest path. Smallest neighbours are aggregates, combined
    before they are shuffled, and reach the edges by joins, whose large
    partitions are split: a node with very many edges holds up no task. A
    graph of ``FEW_EDGES`` at most takes the same steps without a shuffle.
    Edges may be repeated, reversed or loops; null ends are ignored. Returns
    (node, component).
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    pairs, n = counted(pairs.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct())
    together = (lambda t: sorted_join(t.coalesce(1))) if n <= FEW_EDGES else (lambda t: t)

    def step(e: DataFrame) -> DataFrame:
        e = together(e)
        # Every edge points down. Large-star: what points at a node points at that node's lowest neighbour instead.
        low = e.groupBy("src").agg(F.min("dst").alias("m")).withColumnRenamed("src", "dst")
        large = e.join(low, "dst", "left").select("src", F.coalesce("m", "dst").alias("dst")).distinct()
        # Small-star: a node's lowest neighbour becomes its own, and that of its other neighbours.
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(sorted_join(low) if n <= FEW_EDGES else low, "src").select(F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("m").alias("dst"))
        return small.distinct()

    stars = until_stable(pairs.where("src != dst"), step, _star_measure)
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), "dst"), F.struct(F.col("dst").alias("node"), "dst")))
    nodes = stars.select(ends.alias("e")).select("e.node", "e.dst")
    nodes = together(nodes.unionAll(pairs.where("src = dst").select(F.col("src").alias("node"), "dst")))
    return nodes.groupBy("node").agg(F.min("dst").alias("component"))
