"""Connected components of an edge list, on DataFrames."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_home(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Unset, one of our own, on one machine (tests) only."""
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not home:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        home = tempfile.mkdtemp(prefix="colophon-")
        atexit.register(shutil.rmtree, home, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{home}")
    return home.rstrip("/")


def stage(frame: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it: lineage ends here."""
    spark: SparkSession = frame.sparkSession
    path = f"{shared_home(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._staged_at = path
    return out


def by_shuffle(frame: DataFrame) -> DataFrame:
    """The frame as a side of a join that sorts and merges, for tables that grow with the input.

    Left to itself Spark broadcasts a side whose files are small. What compressed texts take in the driver's memory is many times that.
    """
    return frame.hint("merge")


def discard(frame: DataFrame) -> None:
    """Deletes a table that `stage` returned and nothing reads any more."""
    spark = frame.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(frame._staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: So many rounds go by the ids themselves, all others by a random order of them, each by its own.
BY_ID = 2


def _hops(edges: DataFrame, turn: int) -> DataFrame:
    """id and to of every end of edges(a, b): the first of the id and its neighbours in the order of this round."""
    rank = F.col if turn < BY_ID else lambda c: F.xxhash64(c, F.lit(turn))
    place = lambda c: F.struct(rank(c).alias("place"), F.col(c).alias("at"))
    both = edges.union(edges.select("b", "a"))
    return both.groupBy("a").agg(F.min(place("b")).alias("near")).select(F.col("a").alias("id"), F.least("near", place("a"))["at"].alias("to"))


def connected_components(pairs: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """id and component (the smallest id reachable) of every id in pairs(a, b); `rounds` takes the edges left after each round.

    Contraction: in a round every id hops to the first of itself and its neighbours, edges move to where their ends have
    hopped, and loops and repeats go. Only what is left goes on, so rounds shrink. By the ids themselves a star is gone in
    two rounds, but a chain in order loses one id a round; a round by a random order keeps three in four ids at most on
    average, whatever the graph (Boegeholz, Brand and Todor, 2020). So rounds are logarithmic in the ids. At the
    end the hops are followed back, and each component takes its smallest id. A round's edges are deleted once they have
    moved, the hops once the result is written.

    An id with very many neighbours is a skewed key of a plain join: its result is dealt anew by another key, so nothing asks for
    the rows of one key together and adaptive execution splits them over tasks; minima are summed where edges are read.
    """
    edges = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    hops: list[DataFrame] = []
    while True:
        hop = stage(_hops(edges, len(hops)), "hops")
        hops.append(hop)
        moved = edges.join(by_shuffle(hop.toDF("a", "ta")), "a").join(by_shuffle(hop.toDF("b", "tb")), "b").filter("ta <> tb")
        left = stage(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        discard(edges)
        edges, count = left, left.count()
        if rounds is not None:
            rounds.append(count)
        if not count:
            break
    discard(edges)
    roots = hops[-1]
    for hop in reversed(hops[:-1]):
        roots = hop.join(by_shuffle(roots.toDF("to", "root")), "to", "left").select("id", F.coalesce("root", "to").alias("to"))
    roots = stage(roots, "roots")
    least = roots.groupBy("to").agg(F.min("id").alias("component"))
    found = stage(roots.join(by_shuffle(least), "to").select("id", "component"), "components")
    for table in (*hops, roots):
        discard(table)
    return found
