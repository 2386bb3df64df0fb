"""What the operators of this subpackage have in common: the shared folder, materialisation, tables."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_dir, shared_path  # noqa: F401


def written(df: DataFrame, name: str) -> DataFrame:
    """Computes df once into a Parquet table in the shared folder: smaller than a checkpoint, and columns can be pruned."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Written:
    """A table that `written` made and that can be deleted again once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, shared_path(df.sparkSession, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through Hadoop's file system."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more.

    The cleaner follows the driver's garbage collection, by default only every half hour. The JVM holds on to its
    latest query, so an empty one takes that place first.
    """
    spark.range(1).write.format("noop").mode("append").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(df: DataFrame) -> int:
    """Parallelism to deal work out with."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def outputs(keep, added: list[str]) -> list[str]:
    """The names under which kept columns come out: one that an added column takes gets `_input` after it."""
    taken, out = {a.lower() for a in added}, []
    for name in keep:
        while name.lower() in taken:
            name += "_input"
        taken.add(name.lower())
        out.append(name)
    return out


def kept_fields(docs: DataFrame, keep, names: list[str]) -> str:
    """The schema text of kept columns under their new names."""
    return ", ".join(f"`{n}` {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names))


def beside(docs: DataFrame, keep, **more: str) -> DataFrame:
    """Columns `keep` by position (`_k0`, ...) and columns of docs under other names: nothing can clash."""
    return docs.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)), *(F.col(f"`{c}`").alias(n) for n, c in more.items()))


def held_out(doc_id: str = "doc_id"):
    """The fold that no classifier learns from: crc32 of the id as text leaves 1 when divided by 3. A null id is in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def squeezed(df: DataFrame) -> DataFrame:
    """df with its column `text` as zstd-compressed UTF-8 in `z` (null: an empty text), for whole texts that must move."""
    keep = [c for c in df.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "z binary"])

    def run(batches):
        import pyarrow as pa
        import zstandard

        from .words import texts_of

        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([z.compress(t or b"") for t in texts_of(b.column("text"))], pa.binary())], [*keep, "z"])

    return df.select(*keep, "text").mapInArrow(run, schema)


def expanded(column) -> list[bytes]:
    """The texts of a column that `squeezed` made."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    return [z.decompress(x) for x in column.to_pylist()]
