"""Many files made visible at once: a folder of data and a manifest that names it.

Spark writes data to a folder of its own, which nothing reads until a manifest
with the next number names it. A manifest is put in place by a rename that never
replaces one, as the log of a streaming query is: atomic wherever the file
system's rename is. Whatever fails before leaves the old state; whoever comes
second with one number is told so and starts again from the new state.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_MANIFEST = re.compile(r"(\d{12})\.json")


class StaleVersion(RuntimeError):
    """Another writer published the version first."""


def _files(spark: SparkSession, path: str):
    java = spark.sparkContext._jvm
    place = java.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


@dataclass(frozen=True)
class State:
    """What readers of a root see: its version and the folders that belong to it, by table."""

    version: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)

    def read(self, spark: SparkSession, table: str, schema: StructType) -> DataFrame:
        """Rows of all the table's folders; none where there are no folders."""
        paths = self.folders.get(table, [])
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def state(spark: SparkSession, root: str) -> State:
    """The newest version. A manifest repeats the folders of the one before, so one is read, however many there are."""
    files, place = _files(spark, f"{root}/_versions")
    if not files.exists(place):
        return State()
    numbers = [int(m.group(1)) for f in files.listStatus(place) if (m := _MANIFEST.fullmatch(f.getPath().getName()))]
    if not numbers:
        return State()
    newest = max(numbers)
    (row,) = spark.read.text(f"{root}/_versions/{newest:012d}.json", wholetext=True).collect()
    return State(newest, json.loads(row.value))


def stage(df: DataFrame, root: str, table: str) -> str:
    """Writes ``df`` where no reader looks yet."""
    folder = f"{root}/{table}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(folder)
    return folder


def publish(spark: SparkSession, root: str, seen: State, added: dict[str, str], *, replaced: tuple[str, ...] = ()) -> State:
    """Makes staged folders (by table) part of the version after ``seen``; tables in ``replaced`` lose their earlier folders.

    Raises ``StaleVersion`` where another writer was faster; the staged folders then
    belong to no version.
    """
    folders = {table: paths for table, paths in seen.folders.items() if table not in replaced}
    after = State(seen.version + 1, folders | {table: [*folders.get(table, []), path] for table, path in added.items()})
    java = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    draft, place = (java.org.apache.hadoop.fs.Path(f"{root}/_versions/{name}") for name in (f".{uuid.uuid4().hex}", f"{after.version:012d}.json"))
    files, _ = _files(spark, root)
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(after.folders, sort_keys=True).encode()))
    out.close()
    context = java.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
    rename = getattr(java.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        context.rename(draft, place, how)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise StaleVersion(f"version {after.version} of {root} is there already") from error
        raise
    return after


def discard(spark: SparkSession, root: str, keep: State) -> int:
    """Removes folders that no reader of ``keep`` needs, and manifests before it; gives their number.

    For use when no writer is at work and no reader holds an older state.
    """
    wanted, gone = {path for paths in keep.folders.values() for path in paths}, 0
    files, place = _files(spark, root)
    if not files.exists(place):
        return 0
    for table in files.listStatus(place):
        name = table.getPath().getName()
        for item in files.listStatus(table.getPath()):
            inner = item.getPath().getName()
            old = int(m.group(1)) < keep.version if name == "_versions" and (m := _MANIFEST.fullmatch(inner)) else name != "_versions" and f"{root}/{name}/{inner}" not in wanted
            if old:
                files.delete(item.getPath(), True)
                gone += 1
    return gone
