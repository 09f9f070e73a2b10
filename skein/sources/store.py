"""Tables on disk: index bundles, manifests, caches, and graph files."""

from __future__ import annotations

import re
import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else the context's checkpoint folder.

    Where neither is set, a temporary folder serves a master of one machine (as in tests); on a cluster that raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Shuffle files of a statement go when it ends, not when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def put(df: DataFrame, path: str) -> DataFrame:
    """Write a table and go on from there; its lineage ends, and the shuffle files behind it go."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from there."""
    return put(df, f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}")


def discard(*tables: DataFrame) -> None:
    """Delete tables of `cut` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._stored)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well, since one row can hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def save_bundle(frames: dict[str, DataFrame], path: str) -> None:
    """Write every table of an index under one folder."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """Read tables of an index; a missing or broken one raises."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def try_load_bundle(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame] | None:
    """As load_bundle, but None if the index isn't there."""
    from pyspark.errors import AnalysisException

    try:
        return load_bundle(spark, path, *names)
    except AnalysisException:
        return None


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML file: `part` and `line`, to be written in order of part."""
    xml = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    head = '<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="content" for="node" attr.name="content" attr.type="string"/><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">'
    spark = nodes.sparkSession
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), xml("id"), F.lit('"><data key="content">'), xml("content"), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), xml("src"), F.lit('" target="'), xml("dst"), F.lit('"><data key="weight">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("line"))
    ends = spark.createDataFrame([(0, head), (3, "</graph></graphml>")], "part int, line string")
    return ends.unionByName(n).unionByName(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Text parts in order: header, nodes, edges, footer."""
    graphml(nodes, edges).repartitionByRange("part").sortWithinPartitions("part").select("line").write.mode("overwrite").text(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(id, content) and edges(src, dst, weight) of a file written by write_graphml."""
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))
    t = spark.read.text(path)
    n = t.where(F.col("value").startswith("<node ")).select(plain(F.regexp_extract("value", 'id="([^"]*)"', 1)).alias("id"), plain(F.regexp_extract("value", '<data key="content">(.*)</data>', 1)).alias("content"))
    e = t.where(F.col("value").startswith("<edge ")).select(plain(F.regexp_extract("value", 'source="([^"]*)"', 1)).alias("src"), plain(F.regexp_extract("value", 'target="([^"]*)"', 1)).alias("dst"), F.regexp_extract("value", '<data key="weight">([^<]*)<', 1).cast("double").alias("weight"))
    return n, e


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_run(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Results and their summary of one run, as JSON under its folder."""
    results.write.mode("overwrite").json(f"{path}/results")
    summary.write.mode("overwrite").json(f"{path}/summary")


def run_name(dataset: str, sets: tuple = (), mixed: bool = False, now: datetime | None = None) -> str:
    """Name of a run's folder: data set, the question sets of a mixed run, and the time."""
    at = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    return f"{dataset}_mirage_{'_'.join(sets) or 'unknown'}_{at}" if mixed else f"{dataset}_{at}"


def namespace(dataset: str, known: list[str], run: str = "default") -> str:
    """Index of a data set: yes/no sets reuse an existing multiple-choice index."""
    for base in ("medqa",):
        if dataset in ("bioasq", "pubmedqa") and f"{run}-{base}" in known:
            return f"{run}-{base}"
    return f"{run}-{dataset}"
