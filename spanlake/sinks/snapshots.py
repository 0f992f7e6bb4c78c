"""Tables whose live files are named by a manifest: exactly-once appends, keyed upserts, and compaction under readers.

``path/data/part=<name>/`` holds the folders that writers add; ``path/manifests/<version>.json`` names those that are live. A writer puts its
folder down first and then creates the next manifest; creating fails if another writer was faster, who is then taken into account. A
reader takes the newest manifest and sees all of one version and nothing else: unfinished folders are not named, and compacted ones stay until
:func:`vacuum`. The file system must create a file without overwriting in one step, as HDFS and local disks do.

Manifests are small (one entry per live folder). Folders have levels: :func:`compact` joins ``fan_in`` folders of a level into one of the next,
so that a table of n appends has at most ``fan_in * log(n)`` folders and a row is rewritten at most log(n) times.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..sources import few_listing_tasks

VERSION = "_version"


@dataclass(frozen=True)
class Folder:
    name: str
    rows: int
    level: int = 0
    #: Whether its files lie in it without folders of their own; manifests of earlier releases do not tell.
    flat: bool = False


@dataclass(frozen=True)
class Snapshot:
    """One version: its folders, and for each stream its last micro-batch and the counters of its life."""

    version: int = -1
    folders: tuple[Folder, ...] = ()
    streams: dict[str, dict[str, int]] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"folders": [vars(f) for f in self.folders], "streams": self.streams})


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    files, target = _at(spark, path)
    files.delete(target, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    files, target = _at(spark, f"{path}/manifests")
    if not files.exists(target):
        return []
    names = [s.getPath().getName() for s in files.listStatus(target)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest version, or the given one; an empty one where nothing was committed."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return Snapshot()
        version = known[-1]
    files, target = _at(spark, f"{path}/manifests/{version}.json")
    stream = files.open(target)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Snapshot(version, tuple(Folder(**f) for f in found["folders"]), found["streams"])


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Put a whole file down under its name in one step; false if the name is taken."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    draft, target = hadoop.Path(f"{path}.{uuid.uuid4().hex}.draft"), hadoop.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    local = files.getUri().getScheme() == "file"
    try:
        if local:
            # There a rename looks first and moves then, so that two writers may both win; a link is made in one step.
            nio = spark._jvm.java.nio.file
            nio.Files.createLink(*[nio.Paths.get(files.makeQualified(p).toUri()) for p in (target, draft)])
        else:
            context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
            # Without options, a rename onto a file that is there fails.
            options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
            context.rename(files.makeQualified(draft), files.makeQualified(target), options)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    if local:
        files.delete(draft, False)
    return True


def commit(spark: SparkSession, path: str, change: Callable[[Snapshot], Snapshot | None]) -> Snapshot:
    """Apply ``change`` to the newest version, again if another writer came first. A change to nothing commits nothing."""
    while True:
        now = snapshot(spark, path)
        new = change(now)
        if new is None:
            return now
        if _create(spark, f"{path}/manifests/{now.version + 1}.json", new.text()):
            return Snapshot(now.version + 1, new.folders, new.streams)


def _write(rows: DataFrame, path: str, partition: Sequence[str]) -> Folder:
    """Write a folder of its own, and count its rows on the way."""
    from . import lake_writer

    name, count = uuid.uuid4().hex, Observation()
    observed = rows.observe(count, F.count(F.lit(1)).alias("rows"))
    writer = lake_writer(observed) if {"span_id", "rollout_id"} <= set(rows.columns) else observed.write
    (writer.partitionBy(*partition) if partition else writer).parquet(f"{path}/data/part={name}")
    return Folder(name, count.get["rows"], flat=not partition)


def append(rows: DataFrame, path: str, stream: str | None = None, epoch: int = 0, partition: Sequence[str] = (), failing: Callable[[int], None] | None = None) -> Snapshot:
    """Add rows as one version. A micro-batch of a stream that is committed already is not written again.

    ``failing`` is called between the write and the commit, for tests of what a crash leaves behind.
    """
    spark = rows.sparkSession

    def done(now: Snapshot) -> bool:
        return stream is not None and now.streams.get(stream, {}).get("epoch", -1) >= epoch

    if done(snapshot(spark, path)):
        return snapshot(spark, path)
    folder = _write(rows, path, partition)
    if failing is not None:
        failing(epoch)

    def change(now: Snapshot) -> Snapshot | None:
        if done(now):
            return None
        streams = dict(now.streams)
        if stream is not None:
            told = streams.get(stream, {"rows": 0, "micro_batches": 0})
            streams[stream] = {"epoch": epoch, "rows": told["rows"] + folder.rows, "micro_batches": told["micro_batches"] + (folder.rows > 0)}
        return Snapshot(folders=now.folders + ((folder,) if folder.rows else ()), streams=streams)

    return commit(spark, path, change)


def read(spark: SparkSession, path: str, version: int | None = None, schema: str | None = None) -> DataFrame:
    """The rows of one version, the newest by default, which later commits do not change."""
    return read_folders(spark, path, snapshot(spark, path, version).folders, schema)


def read_folders(spark: SparkSession, path: str, folders: Sequence[Folder], schema: str | None = None) -> DataFrame:
    if not folders:
        if schema is None:
            raise ValueError(f"nothing was committed to {path}, and no schema is given")
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", f"{path}/data")
    reader = reader.schema(schema) if schema else reader
    # Spark refuses to read folders with and without partitions together.
    kinds = [[f for f in folders if f.flat == flat] for flat in (True, False)]
    with few_listing_tasks(spark):
        read = [reader.parquet(*[f"{path}/data/part={f.name}" for f in kind]).drop("part") for kind in kinds if kind]
    return read[0] if len(read) == 1 else read[0].unionByName(read[1])


def compact(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], partition: Sequence[str] = (), fan_in: int = 8) -> Snapshot:
    """Join folders level by level while one has ``fan_in`` of them. ``merge`` lays out (and may reduce) their rows.

    Writers may go on meanwhile: only the joined folders are exchanged. If another compaction took one of them, this one's work is dropped.
    """
    while True:
        now = snapshot(spark, path)
        full = [lv for lv in sorted({f.level for f in now.folders}) if sum(f.level == lv for f in now.folders) >= fan_in]
        if not full:
            return now
        taken = tuple(f for f in now.folders if f.level == full[0])
        made = _write(merge(read_folders(spark, path, taken)), path, partition)
        made = Folder(made.name, made.rows, full[0] + 1, made.flat)

        def change(then: Snapshot) -> Snapshot | None:
            if not set(taken) <= set(then.folders):
                return None
            return Snapshot(folders=(made, *[f for f in then.folders if f not in taken]), streams=then.streams)

        if commit(spark, path, change).version == now.version:
            return now


def vacuum(spark: SparkSession, path: str, keep_versions: int) -> list[str]:
    """Delete folders that none of the newest ``keep_versions`` versions names, and older manifests; returns the folders.

    Only folders that some old manifest names go, so a folder that a writer has put down but not committed yet stays.
    """
    known = versions(spark, path)
    old, kept = known[:-keep_versions], known[-keep_versions:]
    live = {f.name for v in kept for f in snapshot(spark, path, v).folders}
    gone = sorted({f.name for v in old for f in snapshot(spark, path, v).folders} - live)
    for name in gone:
        delete(spark, f"{path}/data/part={name}")
    for v in old:
        delete(spark, f"{path}/manifests/{v}.json")
    return gone


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the largest ``_version`` of each key."""
    rest = [c for c in rows.columns if c not in keys and c != VERSION]
    last = F.max_by(F.struct(*rest, VERSION), VERSION).alias("_row") if rest else F.max(VERSION).alias(VERSION)
    found = rows.groupBy(*keys).agg(last)
    return found.select(*keys, "_row.*") if rest else found


def upsert(rows: DataFrame, path: str, keys: Sequence[str], stream: str, epoch: int, fan_in: int = 8, keep_versions: int = 16) -> Snapshot:
    """Replace the rows of the given keys, as one micro-batch of a stream."""
    append(rows.withColumn(VERSION, F.lit(epoch).cast("bigint")), path, stream, epoch)
    done = compact(rows.sparkSession, path, lambda df: newest(df, keys), fan_in=fan_in)
    vacuum(rows.sparkSession, path, keep_versions)
    return done


def read_upserts(spark: SparkSession, path: str, keys: Sequence[str], version: int | None = None) -> DataFrame:
    return newest(read(spark, path, version), keys).drop(VERSION)
