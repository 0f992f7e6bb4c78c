"""Readers. Every reader has a fixed schema, so nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas

_KINDS = {"sft": schemas.SFT, "rl": schemas.RL, "reward": schemas.REWARD}


def _reader(spark: SparkSession, streaming: bool):
    return spark.readStream if streaming else spark.read


#: Tasks per core of a listing.
_LISTING = 4


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """A lake has a folder per shard, and Spark lists each in a task of its own up to a fixed number of them; here the number follows the cores."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), _LISTING * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_spans(
    spark: SparkSession, path: str, streaming: bool = False, promoted: bool = False, skip_unreadable: bool = False, variant: bool = False
) -> DataFrame:
    """The span lake, with its partition columns (``shard``, ``batch_idx``) when it has them.

    Sub-folders are partitions here, so numbered batches are never invisible. ``promoted`` adds the
    attribute columns that every writer of the package stores; operators use them instead of the JSON. A lake without
    them is refused (the footers tell), because they would read as null.
    ``skip_unreadable`` leaves out broken files, which ``file_stats`` lists. ``variant`` adds the attributes as ``attrs``, where they
    were written so; operators then read single keys of it instead of the text.
    """
    schema = f"{schemas.SPAN}, {schemas.PROMOTED}" if promoted else schemas.SPAN
    schema = f"{schema}, attrs VARIANT" if variant else schema
    reader = _reader(spark, streaming).option("ignoreCorruptFiles", str(skip_unreadable).lower())
    if streaming:
        return reader.schema(schema).parquet(path)
    with few_listing_tasks(spark):
        if promoted:
            found = reader.parquet(path)
            absent = [c for c in schemas.PROMOTED_NAMES if c not in found.columns]
            if absent:
                raise ValueError(f"the lake at {path} has no columns {absent}; write it with spanlake.sinks")
            wanted = spark.createDataFrame([], schema).dtypes
            # The files are listed once where they have the schema already. All other columns must be folders, or the fixed schema leaves them out.
            names = [c for c, _ in wanted]
            folders = [c for c in found.columns if c not in (*names, "attrs")]
            first = found.select(F.col("_metadata.file_path")).first() if set(wanted) <= set(found.dtypes) else None
            if first is not None and all(f"/{c}=" in first[0] for c in folders):
                return found.select(*names, *folders)
        return reader.schema(schema).parquet(path)


def in_file_order(df: DataFrame) -> DataFrame:
    """Add ``file_name`` and ``row_index``, the order in which shards were written."""
    return df.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))


def head(df: DataFrame, n: int) -> DataFrame:
    """First rows of the combined shards in file order."""
    return in_file_order(df).orderBy("file_name", "row_index").limit(n).drop("file_name", "row_index")


def import_foreign(
    spark: SparkSession, source: str, target: str, skip_unreadable: bool = True, batches: bool = False
) -> DataFrame:
    """Rewrite span files of other writers as typed files, and return the result.

    Such files may hold an untyped all-null column, which the vectorized reader rejects; the
    non-vectorized reader fills it as null. That reader is a session setting, so the import runs in a
    session of its own and the lake keeps vectorized reads. Broken files are skipped or fail the
    import; ``file_stats`` of the source lists them. With ``batches`` the number of the folder a file
    lies in becomes ``batch_idx``, as :func:`read_batches` expects it. The target must not exist yet, so that a second run
    does not double the rows.
    """
    # The sinks import readers of this module for their exports.
    from ..sinks import with_promoted

    session = spark.newSession()
    session.conf.set("spark.sql.parquet.enableVectorizedReader", "false")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    reader = session.read.schema(schemas.SPAN).option("recursiveFileLookup", "true")
    files = reader.option("ignoreCorruptFiles", str(skip_unreadable).lower()).parquet(source)
    if batches:
        number = F.regexp_extract(F.col("_metadata.file_path"), "/([0-9]+)/[^/]+$", 1).try_cast("bigint")
        writer = with_promoted(files.withColumn("batch_idx", number)).write.partitionBy("batch_idx")
    else:
        writer = with_promoted(files).write
    writer.mode("errorifexists").parquet(target)
    return read_spans(spark, target)


def read_batches(spark: SparkSession, path: str, batches: Sequence[int] | None = None) -> DataFrame:
    """Spans of numbered batches (``batch_idx=<n>`` folders); a list of batches prunes the folders."""
    df = read_spans(spark, path)
    return df if batches is None else df.where(F.col("batch_idx").isin([int(b) for b in batches]))


def file_path(path: Column) -> Column:
    """A file path with one slash after its scheme, as readers differ there."""
    return F.regexp_replace(path, "^([a-zA-Z0-9]+):/+", "$1:/")


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and change time of the Parquet files below ``path``; contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return listing.load(path).select(
        file_path(F.col("path")).alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")
    )


def latest_shard(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the shard that was written last: all files of its partition folder, or that file of a lake without folders.

    Of several files of the same time the one with the largest path tells.
    """
    newest = listed_files(spark, path).agg(F.max(F.struct("modified", "path")).alias("top")).first()["top"]
    spans = read_spans(spark, path)
    if newest is None:
        return spans
    at = file_path(F.col("_metadata.file_path"))
    folder, _, name = newest["path"].rpartition("/")
    if "=" in folder.rpartition("/")[2]:
        return spans.where(F.regexp_replace(at, "/[^/]*$", "") == folder)
    return spans.where(at == newest["path"])


def _json_lines(spark: SparkSession, path: str, schema: str, streaming: bool) -> DataFrame:
    """JSON lines; blank ones are dropped, broken ones keep their text in ``_corrupt_record``.

    The lines are read as text and parsed by an expression, because the JSON source refuses queries
    that need the broken lines only.
    """
    lines = _reader(spark, streaming).text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return lines.select(F.from_json("value", schema, options).alias("entry")).select("entry.*")


def read_access_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Access log lines; broken lines keep their text in ``_corrupt_record``."""
    return _json_lines(spark, path, schemas.LOG, streaming)


def split_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable entries and the quarantine of broken lines."""
    good = log.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    bad = log.where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")
    return good, bad


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """SFT, RL or reward records. A column the files lack is null; JSON columns get their defaults."""
    df = spark.read.schema(_KINDS[kind]).parquet(path)
    defaults = {"metadata": "{}", "trajectory": "[]"}
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items() if c in df.columns})


def read_raw_calls(spark: SparkSession, path: str, streaming: bool = False, keep_broken: bool = False) -> DataFrame:
    """Raw calls; request and response stay JSON text. ``keep_broken`` adds ``_corrupt_record`` with the text of broken lines, for :func:`split_log`."""
    if keep_broken:
        return _json_lines(spark, path, f"{schemas.RAW_CALL}, _corrupt_record STRING", streaming)
    return _reader(spark, streaming).schema(schemas.RAW_CALL).json(path)


def read_model_config(spark: SparkSession, path: str) -> DataFrame:
    """One row per configured model, from ``model_list`` or else ``models``."""
    entries = f"ARRAY<{schemas.MODEL}>"
    config = spark.read.schema(f"model_list {entries}, models {entries}").option("multiLine", "true").json(path)
    return config.select(F.explode(F.coalesce("model_list", "models")).alias("m")).select("m.*")
