"""What several operators share: tables in the shared folder, components, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a single machine that names none, a new one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        root = context.getCheckpointDir()
        if not root:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
            root = context.getCheckpointDir()
    return root.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read again.

    Later jobs start from the files: nothing is computed twice, also when executors are lost.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_of(schema: pa.Schema, columns: list, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of bounded length."""
    batch = pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column with null read as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def slices_of(batch: pa.RecordBatch, name: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many bytes of text, so that memory follows the text and not the number of rows."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
    cuts = np.flatnonzero(np.diff(size)).tolist()
    for a, b in zip([0, *(c + 1 for c in cuts)], [*(c + 1 for c in cuts), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node of the undirected links ``(a, b)``: the smallest reachable node.

    Alternating star contractions (Kiveris et al., 2014): each round is two aggregates and two
    joins on nodes, no neighbourhood is gathered. Rounds grow with the logarithm of the longest
    path. Each round is written to the shared folder, which cuts the lineage. Links that are
    null, repeated or from a node to itself change nothing; no links give no rows.
    """
    links = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    seen = None
    for _ in range(most_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            links.select(F.col("v").alias("u"), F.col("u").alias("w"))
            .join(low, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            )).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        links = stored(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
