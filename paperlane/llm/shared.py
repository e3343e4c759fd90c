"""Tables in the folder that driver and executors share, joins that hot keys don't hurt, and a few column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than one in so many of the rows is hot, so there are fewer hot keys than this.
HOT_SHARE = 512
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local session that has none gets a temporary folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="paperlane-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def _made(path: str) -> str:
    if _scopes:
        _scopes[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read from there: cuts lineage and survives lost executors."""
    path = _made(f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, dealt: bool = False) -> tuple[DataFrame, str]:
    """As ``written``, in buckets of ``key``, so that later joins on it needn't shuffle these rows again; and the table's name.

    ``dealt``: the rows are already in partitions by ``key``, as many as there are shuffle partitions.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    table_name = f"{name}_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(n, key)).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", _made(f"{shared_folder(spark)}/{table_name}")).saveAsTable(table_name)
    return spark.table(table_name), table_name


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the paths of the tables written inside."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        inner = _scopes.pop()
        if _scopes:
            _scopes[-1].extend(inner)


def deleted(spark: SparkSession, paths: list[str]) -> None:
    """Deletes such tables, once nothing lazy reads them any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables made by ``written``, once nothing lazy reads them any more."""
    for df in tables:
        root = shared_folder(df.sparkSession).split(":", 1)[-1].replace("///", "/").rstrip("/")
        deleted(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles() if root in f}))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, which higher-order functions otherwise do for every element."""
    return F.transform(F.array(value), body)[0]


def hot_keys(rows: DataFrame, keys: list[str], total: int | None = None) -> list[Row]:
    """The keys of more than a ``HOT_SHARE``-th of all rows of a written table: fewer than ``HOT_SHARE`` of them, whatever the data."""
    total = rows.count() if total is None else total
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HOT_SHARE > total).select(*keys).collect()


def left_join(rows: DataFrame, one: DataFrame, keys: list[str], hot: list[Row] | None = None) -> DataFrame:
    """Left join with a table that has one row a key (null keys match nothing), with no task for a hot key alone.

    The rows of hot keys meet a broadcast of those keys' rows (fewer than ``HOT_SHARE``) where they
    are, all others are shuffled. Both inputs are read twice: they should be written tables. ``hot``: the hot keys, if known.
    """
    hot = hot_keys(rows, keys) if hot is None else hot
    if not hot:
        return rows.join(one, keys, "left")
    kinds = {k: rows.schema[k].dataType for k in keys}
    mark = rows.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(r[k]).cast(kinds[k]).alias(f"_{k}") for k in keys]) for r in hot])))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    few = one.join(F.broadcast(mark), [F.col(k) == F.col(f"_{k}") for k in keys], "left_semi")
    return rows.join(F.broadcast(mark), same, "left_semi").join(F.broadcast(few), keys, "left").unionByName(rows.join(F.broadcast(mark), same, "left_anti").join(one, keys, "left"))


def hub_join(rows: DataFrame, one: DataFrame, key: str, value: str, total: int) -> DataFrame:
    """The rows with the ``value`` (never null) of a table with one row a key, in one plan: rows of hot keys meet a broadcast of those keys' values.

    ``n`` in ``one`` is how many rows have that key, ``total`` the number of rows, or more; so fewer than ``HOT_SHARE``
    keys are hot. Both halves of the plan read the same columns of ``one``, so one aggregate and one broadcast serve them.
    """
    hot = F.broadcast(one.filter(F.col("n") * HOT_SHARE > total).select(key, value))
    cold = one.filter(F.col("n") * HOT_SHARE <= total).select(key, value)
    others = rows.join(hot, key, "left").filter(F.col(value).isNull()).select(*rows.columns)
    return rows.join(hot, key).unionByName(others.join(cold, key))


def chunked(items: Column) -> Column:
    """An array in pieces of about the root of its size, at least 64."""
    each = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(items))).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / each).cast("int")), lambda k: F.slice(items, k * each + 1, each))


def running(items: Column, kind: str, step) -> Column:
    """``step(at, item)``, a struct (at, one), along an array, starting at 0: the array of all ``one`` (of type ``kind``).

    Arrays can only be copied, not appended to, so the items are taken in chunks: n items cost n to the power 1.5.
    """

    def state(at: Column, out: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), out.alias("out"))

    def one(acc: Column, x: Column) -> Column:
        return let(step(acc["at"], x), lambda y: state(y["at"], F.concat(acc["out"], F.array(y["one"]))))

    def piece(acc: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, state(acc["at"], F.array().cast(f"array<{kind}>")), one)
        return let(inner, lambda y: state(y["at"], F.concat(acc["out"], F.array(y["out"]))))

    return F.aggregate(chunked(items), state(F.lit(0), F.array().cast(f"array<array<{kind}>>")), piece, lambda acc: F.flatten(acc["out"]))
