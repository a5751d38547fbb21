"""Helpers that several operators of this folder use."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
#: Tables that written() made and nobody dropped yet, in order.
_made: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where that is unset and
    all runs in one process (tests), a fresh temporary folder. On a cluster a local folder
    would keep each executor's rows from the others, so there the setting is required."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives
    lost executors, is computed once, and has a true size for the planner."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_path = path
    _made.append(back)
    return back


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    _made[:] = [x for x in _made if x is not df]


def made() -> int:
    """A mark for clear(): how many tables there are so far."""
    return len(_made)


def clear(since: int = 0, but: DataFrame | None = None) -> None:
    """Delete the tables made after a mark, all by default, except one. Call it when the
    results that read them are saved: the operators can't know when that is."""
    for df in _made[since:]:
        if df is not but:
            dropped(df)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); root is the least node
    reachable, and roots are listed too. Alternating large-star and small-star
    rounds, each a min per node and a join; hot nodes are split by AQE, for each
    side of the join is a plain exchange of a written table. No edges: no rows."""
    star = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star = written(star, "edges")
    seen = None
    while True:
        state = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.hint("merge").join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = (
            large.hint("merge").join(least.hint("merge"), "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        new = written(small, "edges")
        for old in (star, low, large, least):
            dropped(old)
        star = new
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
