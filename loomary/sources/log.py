"""A keyed store with a commit log: ordered appends, deletes, atomic rewrites and compaction on a shared file system.

A commit writes its rows to a folder of its own and then puts a manifest under the next number, which only one writer can
do: whoever finds the number taken tries the one after. So appends of many writers all stay, and a reader sees the commits
below a number whole or not at all. Every row has an ordinal (commit, position): the number of its commit and its place
in it, so "the last one wins" means the last one written, however many files there are and whatever their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stores import last_per_key

COMMIT, POSITION = "commit", "position"
_ENTRY = T.StructType([T.StructField("number", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("folder", T.StringType()), T.StructField("upto", T.LongType())])
DIGITS = 20


class Conflict(RuntimeError):
    """Another writer has committed in between, again and again."""


def put_if_absent(spark: SparkSession, path: str, text: str, link: bool = True) -> bool:
    """Write a small file unless there is one: whole or not at all, and for one of several writers only.

    The text goes to a hidden file first. A local file system links it under its name, which fails if the name is taken
    (unless `link` is false); others rename it without overwriting, which is one step of the name node.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    at = fs.makeQualified(at)
    fs.mkdirs(at.getParent())
    hidden = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if link and fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(at), local(hidden))
        else:
            options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
            options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(hidden, at, options)
        return True
    except Py4JJavaError:
        if fs.exists(at):
            return False
        raise
    finally:
        fs.delete(hidden, False)


@dataclass(frozen=True)
class Entry:
    """A live part of the store. kind: append (its rows are of commit `number`), keep (rows with ordinals of their own) or
    delete (keys that go from earlier commits)."""

    number: int
    kind: str
    folder: str


def live(entries: list) -> list[Entry]:
    """The entries that count: none before the last rewrite, and none that the furthest compaction after it has taken in."""
    first = max((e["number"] for e in entries if e["kind"] == "rewrite"), default=0)
    packed = max((e for e in entries if e["kind"] == "compact" and e["upto"] >= first), key=lambda e: (e["upto"], e["number"]), default=None)
    least = packed["upto"] + 1 if packed else first
    out = [Entry(e["number"], "delete" if e["kind"] == "delete" else "append", e["folder"]) for e in entries if e["kind"] in ("append", "rewrite", "delete") and e["number"] >= least]
    return ([Entry(packed["number"], "keep", packed["folder"])] if packed else []) + out


@dataclass(frozen=True)
class Store:
    """A table of `schema` in a folder. `form` is the files' format (parquet or json); `key` is its key column.

    Two columns, commit and position, are added to the rows; the schema must not have them.
    """

    spark: SparkSession
    root: str
    schema: T.StructType
    key: str = "path"
    form: str = "parquet"

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit; 0 before the first one."""
        at, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n[:DIGITS]) for n in names if n[:DIGITS].isdigit()), default=0)

    def entries(self, version: int | None = None) -> list:
        """Manifests by number: a small row a commit since the last vacuum."""
        version = self.version() if version is None else version
        if not version:
            return []
        return self.spark.read.schema(_ENTRY).json(f"{self.root}/log").filter(F.col("number") <= version).orderBy("number").collect()

    def _write(self, df: DataFrame) -> str:
        folder = uuid.uuid4().hex
        df.write.format(self.form).save(f"{self.root}/data/{folder}")
        return folder

    def _commit(self, kind: str, folder: str, upto: int | None = None, number: int | None = None) -> int:
        """Put the manifest under `number`, which must be free, or under the next free number."""
        at = number or self.version() + 1
        while not put_if_absent(self.spark, f"{self.root}/log/{at:0{DIGITS}d}.json", json.dumps({"number": at, "kind": kind, "folder": folder, "upto": upto})):
            if number:
                raise Conflict(f"commit {number} is taken")
            at += 1
        return at

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields], F.monotonically_increasing_id().alias(POSITION))

    def append(self, df: DataFrame, dry_run: bool = False) -> int | None:
        """Add rows in the order of `df`; gives the commit's number, or None where there is nothing to write."""
        if dry_run or df.isEmpty():
            return None
        return self._commit("append", self._write(self._placed(df)))

    def delete(self, keys: DataFrame) -> int:
        """Rows of these keys go, as far as they were committed before; later ones stay."""
        return self._commit("delete", self._write(keys.select(F.col(self.key)).distinct()))

    def rewrite(self, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
        """Replace all rows by change(rows), in its order, in one step. If another writer commits in between, `change` is called
        anew with what there is by then."""
        for _ in range(tries):
            seen = self.version()
            try:
                return self._commit("rewrite", self._write(self._placed(change(self.rows(seen)))), number=seen + 1)
            except Conflict:
                continue
        raise Conflict(f"{tries} tries to rewrite {self.root} met other commits")

    def compact(self, files: int | None = None) -> int | None:
        """Put the rows of all commits so far into one folder (of about so many files), ordinals and all. Readers and writers go
        on meanwhile: commits after those that it has read count beside it."""
        upto = self.version()
        if not upto:
            return None
        rows = self.rows(upto)
        return self._commit("compact", self._write(rows.repartitionByRange(files, COMMIT, POSITION) if files else rows), upto)

    def vacuum(self) -> int:
        """Delete manifests and folders that no reader who begins now needs; gives the number of folders. Not while older readers run."""
        entries = self.entries()
        kept = {e.folder for e in live(entries)}
        gone = [e for e in entries if e["folder"] not in kept]
        _, fs = self._fs()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for e in gone:
            fs.delete(path(f"{self.root}/data/{e['folder']}"), True)
            if e["number"] < entries[-1]["number"]:  # the last number stays taken
                fs.delete(path(f"{self.root}/log/{e['number']:0{DIGITS}d}.json"), False)
        return len(gone)

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows as of a version (now, if none is given) with their ordinals, in no order; lines that don't parse are left out."""
        parts = live(self.entries(version))
        marked = T.StructType([*self.schema.fields, T.StructField(COMMIT, T.LongType()), T.StructField(POSITION, T.LongType())])
        own = [e for e in parts if e.kind != "delete"]
        if not own:
            return self.spark.createDataFrame([], marked)
        folders = [f"{self.root}/data/{e.folder}" for e in own]
        if self.form == "json":
            bad = T.StructType([*marked.fields, T.StructField("_bad", T.StringType())])
            found = self.spark.read.schema(bad).option("columnNameOfCorruptRecord", "_bad").json(folders).filter("_bad is null")
        else:
            found = self.spark.read.schema(marked).format(self.form).load(folders)
        of = self.spark.createDataFrame([(e.folder, e.number) for e in own], "__folder string, __number long")
        at = F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32})/", 1)
        found = found.withColumn("__folder", at).join(of, "__folder").withColumn(COMMIT, F.coalesce(COMMIT, "__number"))
        gone = [(f"{self.root}/data/{e.folder}", e.number) for e in parts if e.kind == "delete"]
        if gone:
            kind = T.StructType([f for f in self.schema.fields if f.name == self.key])
            keys = self.spark.read.schema(kind).format(self.form).load([p for p, _ in gone]).withColumn("__folder", at)
            when = self.spark.createDataFrame([(p.rsplit("/", 1)[1], n) for p, n in gone], "__folder string, __number long")
            last = keys.join(when, "__folder").groupBy(F.col(self.key).alias("__key")).agg(F.max("__number").alias("__gone"))
            found = found.join(last, F.col(self.key).eqNullSafe(F.col("__key")), "left").filter(F.col("__gone").isNull() | (F.col(COMMIT) > F.col("__gone")))
        return found.select(*[f.name for f in marked.fields])

    def last(self, version: int | None = None, where=None) -> DataFrame:
        """The last row of each key, with its ordinal; `where` chooses rows beforehand, so that others can't hide them."""
        rows = self.rows(version)
        return last_per_key(rows if where is None else rows.filter(where), self.key, COMMIT, POSITION)


def is_store(spark: SparkSession, root: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/log")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
