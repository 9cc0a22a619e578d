"""Inputs: adapters to ``source_files(root, file_id, path, content)``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcmetrics.functions.paths import base_name, root_label
from srcmetrics.functions.text import decode_text
from srcmetrics.operators.skew import checkpointed


def spread(table: DataFrame) -> DataFrame:
    """Spreads a table stored in few pieces, so that its texts are cut up by all
    cores (a piece may also hold no row group at all). A large table has many
    pieces per core and is returned as it is, with no shuffle."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores * 2) if table.rdd.getNumPartitions() < cores * 4 else table


def from_documents(documents: DataFrame, path) -> DataFrame:
    """Document rows as files; ``path`` is the column expression to use as path."""
    return documents.select(
        F.col("source").alias("root"), F.col("doc_id").alias("file_id"), path.alias("path"), F.col("text").alias("content")
    )


def from_pages(pages: DataFrame) -> DataFrame:
    """Page rows as files of their host."""
    return pages.select(
        F.parse_url("url", F.lit("HOST")).alias("root"),
        F.col("page_id").alias("file_id"),
        F.ltrim(F.parse_url("url", F.lit("PATH")), F.lit("/")).alias("path"),
        F.col("html").alias("content"),
    )


def as_file_root(files: DataFrame) -> DataFrame:
    """Each row as a root of its own: path and label are the base name."""
    name = base_name(F.col("path"))
    return files.withColumns({"path": name, "label": name, "root_kind": F.lit("file")})


def with_root_label(roots: DataFrame, uri: str = "uri") -> DataFrame:
    return roots.withColumn("label", root_label(F.col(uri)))


# Python runs only where Spark has no reader: its file source skips names that
# begin with "." or "_", and hidden files are part of a corpus.
def _entries(uri: str) -> Iterator[tuple[str, bool, int]]:
    """(name, whether a directory, bytes) of what a directory holds; linked directories are
    not followed. A local directory is streamed."""
    import os

    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(where) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, True, 0
                elif entry.is_file():
                    yield entry.name, False, entry.stat().st_size
        return
    for info in system.get_file_info(fs.FileSelector(where, recursive=False)):
        yield info.base_name, info.type == fs.FileType.Directory, info.size or 0


def _list_directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def listed() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LISTING, strict=True)], schema=_LISTING)

    for batch in batches:
        for top, uri in zip(batch.column("top").to_pylist(), batch.column("uri").to_pylist(), strict=True):
            base = uri.rstrip("/")
            for name, is_dir, size in _entries(uri):
                rows.append((top, f"{base}/{name}", is_dir, size))
                if len(rows) >= LISTED_ROWS:
                    yield listed()
    yield listed()


_LISTING = pa.schema([("top", pa.string()), ("uri", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64())])
_READ = pa.schema([("root", pa.string()), ("path", pa.string()), ("bytes", pa.binary())])
#: Entries handed on at once, bytes read at once (a longer file alone), and bytes of a task.
LISTED_ROWS, READ_BYTES, TASK_BYTES = 4096, 16 << 20, 128 << 20


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    rows: list[tuple] = []
    held = 0

    def read() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 3
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ, strict=True)], schema=_READ)

    for batch in batches:
        for root, path, uri in zip(*(batch.column(c).to_pylist() for c in ("root", "path", "uri")), strict=True):
            system, where = fs.FileSystem.from_uri(uri)
            with system.open_input_stream(where, compression=None) as stream:
                data = stream.read()
            if rows and held + len(data) > READ_BYTES:
                yield read()
                held = 0
            rows.append((root, path, data))
            held += len(data)
    yield read()


def list_tree(spark: SparkSession, uris: list[str], tasks: int | None = None) -> DataFrame:
    """``(top, uri, size)`` of every file below the given directories, hidden ones too.
    One job per directory level; each lists its directories on the executors."""
    tasks = tasks or spark.sparkContext.defaultParallelism * 4
    open_dirs = spark.createDataFrame([(u, u) for u in uris], "top string, uri string")
    found = None
    while True:
        listing = checkpointed(
            open_dirs.repartition(tasks, "uri").mapInArrow(_list_directories, "top string, uri string, is_dir boolean, size bigint")
        )
        files = listing.filter(~F.col("is_dir")).select("top", "uri", "size")
        found = files if found is None else found.unionByName(files)
        open_dirs = listing.filter("is_dir").select("top", "uri")
        if open_dirs.isEmpty():
            return found


def read_listed(listing: DataFrame, tasks: int | None = None) -> DataFrame:
    """Reads the files of ``(root, path, uri, size)`` rows on the executors, in as many tasks as
    their bytes ask for (or ``tasks``)."""
    spark = listing.sparkSession
    if tasks is None:
        size = listing.agg(F.sum("size")).first()[0] or 0
        tasks = max(spark.sparkContext.defaultParallelism * 2, -(-size // TASK_BYTES))
    read = listing.repartition(tasks, "uri").mapInArrow(_read_files, "root string, path string, bytes binary")
    return read.select(
        "root",
        # stable across runs and retries; distinct paths of a root get distinct ids
        F.xxhash64("root", "path").alias("file_id"),
        "path",
        decode_text(F.col("bytes")).alias("content"),
    )


def read_corpus(spark: SparkSession, uris: list[str], tasks: int | None = None) -> DataFrame:
    """Directory trees on storage that all executors reach as ``source_files``;
    the URI of a tree is its ``root``."""
    listing = list_tree(spark, [u.rstrip("/") for u in uris], tasks).select(
        F.col("top").alias("root"), F.expr("substring(uri, length(top) + 2)").alias("path"), "uri", "size"
    )
    return read_listed(listing, tasks)


def _write_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for uri, data in zip(batch.column("uri").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            system, where = fs.FileSystem.from_uri(uri)
            system.create_dir(where.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(where, compression=None) as stream:
                stream.write(data or b"")
        yield batch.select(["uri"])


def write_tree(files: DataFrame, uri: str) -> int:
    """Writes ``files(path, content)`` below a folder that all executors reach, on the
    executors; a task that is run again writes the same files anew. Returns their number."""
    named = files.select(F.concat(F.lit(f"{uri.rstrip('/')}/"), "path").alias("uri"), F.col("content").cast("binary").alias("bytes"))
    return named.mapInArrow(_write_files, "uri string").count()
