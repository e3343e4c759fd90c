"""Keyed tables: rows in fixed buckets by a hash of their key, of which a step changes only some.

A table is a folder of writes (Parquet files by bucket) and of manifests. A manifest is one version of the
table: for each bucket the writes that make it up, the first with whole rows, the others with what changed
since. A step writes rows, changed or removed, into the buckets of their keys and then the next manifest;
nothing that stands is touched, so a step that fails in between leaves the old version. Readers let the last
change of a key win. Buckets with many changes are put together again; what no kept version names is removed.

One writer a table at a time: a second one finds its version taken and fails. Keys may hold nulls, which equal each other.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


class Conflict(Exception):
    """Another writer has written this version of the table."""


@dataclass(frozen=True)
class Table:
    """Columns of a table, its key, and the part of the key that decides the bucket (all of it, if not given).

    ``blooms``: columns whose files carry Bloom filters, so that a search for values passes over files without them.
    """

    columns: str
    keys: tuple[str, ...]
    by: tuple[str, ...] = ()
    buckets: int = 64
    blooms: tuple[str, ...] = ()


@dataclass
class Version:
    """A version of a table: its number, and of each bucket its writes, oldest first; the first is ``whole`` or not."""

    number: int = 0
    writes: dict[int, list[str]] = field(default_factory=dict)
    whole: dict[int, bool] = field(default_factory=dict)


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share; only a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="paperlane-")
    return f"{root}/{uuid.uuid4().hex}"


@contextmanager
def whole_plans(spark: SparkSession) -> Iterator[None]:
    """Inside, a stage that ends in no rows stays part of its plan, and so do the counts that are observed in it."""
    key, rule = "spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ",".join(filter(None, [before, rule])))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def counts(watch: Observation, *names: str) -> dict[str, int]:
    """What was observed; zeros where the planner saw that there are no rows, and left the observed part out."""
    try:
        return dict(watch.get)
    except Py4JJavaError:
        return dict.fromkeys(names, 0)


class KeyedStore:
    """Tables below one folder. Nothing but manifests and names of files comes to the driver."""

    #: Versions that stay readable, and changes of a bucket after which it is written anew.
    keep, most_changes = 2, 8

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root, tables

    # files

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path(folder))) if fs.exists(self._path(folder)) else []

    def _delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    # versions

    def _manifests(self, name: str) -> list[int]:
        return [int(n[:-5]) for n in self._names(f"{self.root}/{name}/manifest") if n.endswith(".json")]

    def version(self, name: str) -> int:
        return max(self._manifests(name), default=0)

    def state(self, name: str, number: int | None = None) -> Version:
        number = self.version(name) if number is None else number
        if not number:
            return Version()
        path = f"{self.root}/{name}/manifest/{number:08d}.json"
        stream = self._fs(path).open(self._path(path))
        try:
            saved = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, {int(b): w for b, w in saved["writes"].items()}, {int(b): w for b, w in saved["whole"].items()})

    def _commit(self, name: str, new: Version) -> None:
        folder = f"{self.root}/{name}/manifest"
        target, made = f"{folder}/{new.number:08d}.json", f"{folder}/.{uuid.uuid4().hex}"
        fs = self._fs(folder)
        out = fs.create(self._path(made), False)
        out.write(json.dumps({"writes": new.writes, "whole": new.whole}).encode())
        out.close()
        if fs.exists(self._path(target)) or not fs.rename(self._path(made), self._path(target)):
            fs.delete(self._path(made), False)
            raise Conflict(f"{name}: version {new.number} is there already")
        self._clear(name)

    def _clear(self, name: str) -> None:
        """Removes manifests before the last ones, and the files that none of these names."""
        numbers = sorted(self._manifests(name))
        kept = [self.state(name, n) for n in numbers[-self.keep :]]
        needed = {(w, b) for v in kept for b, writes in v.writes.items() for w in writes}
        writes = {w for w, _ in needed}
        for n in numbers[: -self.keep]:
            for b, old in self.state(name, n).writes.items():
                for w in old:
                    if w in writes and (w, b) not in needed:
                        self._delete(f"{self.root}/{name}/data/write={w}/bucket={b}")
            self._delete(f"{self.root}/{name}/manifest/{n:08d}.json")
        for folder in self._names(f"{self.root}/{name}/data"):
            w = folder.removeprefix("write=")
            if w not in writes and int(w[:8]) <= numbers[-1]:  # of an older version, or of a step that failed
                self._delete(f"{self.root}/{name}/data/{folder}")

    # reading

    def _schema(self, name: str) -> str:
        return f"{self.tables[name].columns}, _gone boolean, write string, bucket int"

    def _files(self, name: str, places: list[tuple[str, int]]) -> DataFrame:
        data = f"{self.root}/{name}/data"
        return self.spark.read.schema(self._schema(name)).option("basePath", data).parquet(*[f"{data}/write={w}/bucket={b}" for w, b in places])

    def _columns(self, name: str) -> list[str]:
        return self.spark.createDataFrame([], self.tables[name].columns).columns

    def read(self, name: str, buckets: Iterable[int] | None = None, number: int | None = None) -> DataFrame:
        """The rows of a version (the last, if not given) in all or some buckets.

        A bucket without changes is just scanned. Elsewhere the changes are reduced to the last of each
        key; they replace or remove rows that stand, which are not shuffled while changes are few.
        """
        table, state, columns = self.tables[name], self.state(name, number), self._columns(name)
        wanted = sorted(state.writes) if buckets is None else sorted(set(buckets) & set(state.writes))
        still = [(state.writes[b][0], b) for b in wanted if state.whole[b]]
        plain = [(w, b) for w, b in still if len(state.writes[b]) == 1]
        changed = [(w, b) for b in wanted for w in state.writes[b][state.whole[b] :]]
        parts = [self._files(name, plain).select(*columns)] if plain else []
        if changed:
            rest = [c for c in [*columns, "_gone"] if c not in table.keys]
            last = self._files(name, changed)
            if max(len(state.writes[b]) - state.whole[b] for b in wanted) > 1:
                last = last.groupBy(*table.keys).agg(F.max_by(F.struct(*rest), "write").alias("x")).select(*table.keys, "x.*")
            below = [(w, b) for w, b in still if len(state.writes[b]) > 1]
            if below:
                parts.append(self._without(self._files(name, below).select(*columns), last.select(*table.keys), table.keys))
            parts.append(last.filter("not _gone").select(*columns))
        if not parts:  # a plan that ends in no rows, not a constant: counts that are observed beside it must not be optimised away
            schema = self.spark.createDataFrame([], table.columns).schema
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @staticmethod
    def _without(rows: DataFrame, keys: DataFrame, names: tuple[str, ...]) -> DataFrame:
        other = keys.select(*[F.col(k).alias(f"_{k}") for k in names])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names]
        return rows.join(other, same, "left_anti")

    def bucket(self, name: str) -> Column:
        """The bucket of a row of the table, or of its keys."""
        table = self.tables[name]
        return F.pmod(F.xxhash64(*(table.by or table.keys)), F.lit(table.buckets)).cast("int")

    def buckets_of(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets that rows fall in: no more numbers than the table has buckets."""
        return sorted(r["bucket"] for r in rows.select(self.bucket(name).alias("bucket")).distinct().collect())

    # writing

    def _written(self, name: str, rows: DataFrame, number: int) -> tuple[str, list[int], int]:
        """Writes rows (with ``_gone``) into their buckets: the write's name, its buckets, and the number of rows."""
        table, write, watch = self.tables[name], f"{number:08d}-{uuid.uuid4().hex[:8]}", Observation()
        path = f"{self.root}/{name}/data/write={write}"
        kinds = self.spark.createDataFrame([], self._schema(name)).drop("write", "bucket").schema
        dealt = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds]).observe(watch, F.count(F.lit(1)).alias("n")).withColumn("bucket", self.bucket(name)).repartition("bucket")
        out = dealt.write.partitionBy("bucket")
        for c in table.blooms:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        with whole_plans(self.spark):
            out.parquet(path)
        return write, [int(n.removeprefix("bucket=")) for n in self._names(path) if n.startswith("bucket=")], counts(watch, "n")["n"]

    def _changed(self, name: str, rows: DataFrame) -> int:
        state = self.state(name)
        write, touched, n = self._written(name, rows, state.number + 1)
        if not touched:
            self._delete(f"{self.root}/{name}/data/write={write}")
            return 0
        new = Version(state.number + 1, {b: list(w) for b, w in state.writes.items()}, dict(state.whole))
        for b in touched:
            new.whole.setdefault(b, False)
            new.writes.setdefault(b, []).append(write)
        self._commit(name, new)
        if max(len(new.writes[b]) for b in touched) > self.most_changes:
            self.compact(name)
        return n

    def upsert(self, name: str, rows: DataFrame, order: str | None = None) -> int:
        """Rows take the place of those with their keys, or are added: how many. Of several with one key the last by ``order`` counts."""
        table, columns = self.tables[name], self._columns(name)
        rest = [c for c in columns if c not in table.keys]
        if rest:
            by = F.struct(F.col(order), F.xxhash64(*rest)) if order else F.xxhash64(*rest)
            one = rows.groupBy(*table.keys).agg(F.max_by(F.struct(*rest), by).alias("x")).select(*table.keys, "x.*")
        else:
            one = rows.select(*columns).distinct()
        return self._changed(name, one.select(*columns, F.lit(False).alias("_gone")))

    def insert(self, name: str, rows: DataFrame) -> int:
        """Adds the rows whose keys aren't there: how many. Only the buckets of the rows are read."""
        known = self.read(name, self.buckets_of(name, rows)).select(*self.tables[name].keys)
        return self.upsert(name, self._without(rows.select(*self._columns(name)), known, self.tables[name].keys))

    def erase(self, name: str, keys: DataFrame) -> int:
        """Removes the rows with these keys (there or not): how many keys."""
        table, schema = self.tables[name], self.spark.createDataFrame([], self.tables[name].columns).schema
        rows = keys.select(*table.keys).distinct()
        return self._changed(name, rows.select(*[F.col(f.name) if f.name in table.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in schema], F.lit(True).alias("_gone")))

    def exchange(self, name: str, old: DataFrame, new: DataFrame) -> int:
        """Rows ``new`` stand in place of rows ``old``, in one change: how many rows are removed or put."""
        table, columns = self.tables[name], self._columns(name)
        put = new.select(*columns).distinct()
        gone = self._without(old.select(*columns), put.select(*table.keys), table.keys)
        return self._changed(name, put.withColumn("_gone", F.lit(False)).unionByName(gone.distinct().withColumn("_gone", F.lit(True))))

    def write(self, name: str, rows: DataFrame) -> int:
        """The table holds these rows and no others: how many. Their keys need not differ."""
        state = self.state(name)
        write, touched, n = self._written(name, rows.select(*self._columns(name), F.lit(False).alias("_gone")), state.number + 1)
        self._commit(name, Version(state.number + 1, {b: [write] for b in touched}, {b: True for b in touched}))
        return n

    def compact(self, name: str, most_changes: int = 0) -> int:
        """Buckets with more changes than that are written anew as whole rows: how many buckets."""
        state = self.state(name)
        many = [b for b, w in state.writes.items() if len(w) - state.whole[b] > most_changes]
        if not many:
            return 0
        write, left, _ = self._written(name, self.read(name, many).withColumn("_gone", F.lit(False)), state.number + 1)
        new = Version(state.number + 1, {b: w for b, w in state.writes.items() if b not in many}, {b: w for b, w in state.whole.items() if b not in many})
        for b in left:
            new.writes[b], new.whole[b] = [write], True
        self._commit(name, new)
        return len(many)
