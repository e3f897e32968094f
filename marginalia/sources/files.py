"""Reading source trees and stored responses, and writing results back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.langs import EXTENSIONS
from .ignore import accepted_files, drop_empty, drop_ignored, ignore_patterns
from .shared import exists, file_system, shared_folder

SUGGESTIONS_SCHEMA = "path string, idx bigint, line bigint, comment string"
RESPONSES_SCHEMA = "path string, provider string, body string"
REVISIONS_SCHEMA = (
    "path string, ext string, commit_id bigint, commit_ts timestamp, message string, content string"
)


def _any_case(ext: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


# One glob for all accepted extensions, whatever their case.
ACCEPTED_GLOB = "*{" + ",".join(_any_case(ext) for ext in EXTENSIONS) + "}"


_LISTED_SCHEMA = "path string, is_folder boolean, length bigint"
#: Entries of a folder that a listing task passes on at once.
_ENTRIES = 10_000
#: So many files, or so many bytes of them, are for one task to read.
_FILES_A_TASK, _BYTES_A_TASK = 20_000, 64 << 20


def _hidden(name: str, is_folder: bool) -> bool:
    """What Spark's readers pass over."""
    if is_folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _entries(folders: DataFrame) -> DataFrame:
    """What is directly in each folder, hidden entries left out. Each task lists its own folders."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column("path").to_pylist():
                system, name = file_system(folder)
                there = [(i, i.type == fs.FileType.Directory) for i in system.get_file_info(fs.FileSelector(name))]
                found = [(i, d) for i, d in there if (d or i.type == fs.FileType.File) and not _hidden(i.base_name, d)]
                for at in range(0, len(found), _ENTRIES):
                    some = found[at : at + _ENTRIES]
                    path = pa.array([f"{folder.rstrip('/')}/{i.base_name}" for i, _ in some], pa.string())
                    is_folder = pa.array([d for _, d in some], pa.bool_())
                    length = pa.array([i.size for i, _ in some], pa.int64())
                    yield pa.RecordBatch.from_arrays([path, is_folder, length], names=["path", "is_folder", "length"])

    return folders.select("path").mapInArrow(read, _LISTED_SCHEMA)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, ext, length): all accepted files below ``root``. No file is opened.

    Folders are listed by tasks, a level of the tree at a time, and what they hold is put down in a table: a tree may
    have more files than the driver can hold. Their files are then dealt over tasks by number and bytes.
    """
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    roots = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    if not roots:
        raise FileNotFoundError(root)
    at = shared_folder(spark, "listing")
    level = spark.createDataFrame([(s.getPath().toString(), s.isDirectory(), s.getLen()) for s in roots], _LISTED_SCHEMA)
    levels: list[str] = []
    while True:
        levels.append(f"{at}/level-{len(levels)}")
        level.write.parquet(levels[-1])
        folders = spark.read.schema(_LISTED_SCHEMA).parquet(levels[-1]).where("is_folder")
        n_folders = folders.count()
        if not n_folders:
            break
        level = _entries(folders.repartition(min(n_folders, 4 * spark.sparkContext.defaultParallelism)))
    listed = spark.read.schema(_LISTED_SCHEMA).parquet(*levels).where("NOT is_folder").select("path", "length")
    listed = accepted_files(listed).select("path", "ext", "length")
    whole = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size")).first()
    tasks = max(1, -(-whole["n"] // _FILES_A_TASK), -(-whole["size"] // _BYTES_A_TASK))
    return listed.repartition(tasks)


#: Bytes of contents that a task holds before it passes them on.
_READ_BYTES = 4 << 20


def with_contents(listed: DataFrame) -> DataFrame:
    """files(path, ext, content) of listed files: each task reads the files of its own rows, whole.

    The listing has dealt files over tasks, so no content has to move. Broken UTF-8
    becomes U+FFFD instead of an error. A file that cannot be read fails the job, as a scan does.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(rows: list[tuple]) -> pa.RecordBatch:
            path, ext, content = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(path, pa.string()), pa.array(ext, pa.string()), pa.array(content, pa.binary())],
                names=["path", "ext", "content"],
            )

        for batch in batches:
            rows, held = [], 0
            for path, ext in zip(batch.column("path").to_pylist(), batch.column("ext").to_pylist()):
                system, name = file_system(path)
                with system.open_input_stream(name) as source:
                    rows.append((path, ext, source.read()))
                held += len(rows[-1][2])
                if held > _READ_BYTES:
                    yield some(rows)
                    rows, held = [], 0
            if rows:
                yield some(rows)

    files = listed.select("path", "ext").mapInArrow(read, "path string, ext string, content binary")
    return files.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """files(path, ext, content): all accepted files below ``root``, as whole texts."""
    return with_contents(list_files(spark, root))


def scan_source_tree(
    spark: SparkSession, root: str, ignore_file: str | None = None
) -> DataFrame:
    """What a run over ``root`` looks at: accepted, not ignored, not empty files.

    ``ignore_file`` is a text file with one pattern per line, added to the defaults. Paths are
    listed and filtered first; only what is left is opened, and no content is shuffled.
    """
    user = None if ignore_file is None else spark.read.text(ignore_file)
    wanted = drop_ignored(list_files(spark, root), ignore_patterns(spark, user), qualified(spark, root))
    return drop_empty(with_contents(wanted))


def qualified(spark: SparkSession, path: str) -> str:
    """A path as the files below it are listed: with the scheme of its file system."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(hadoop_path).toString()


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Suggestions, responses or revisions stored as parquet, orc or json."""
    return spark.read.format(fmt).schema(schema).load(path)


def read_suggestions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, SUGGESTIONS_SCHEMA, fmt)


def read_responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_table(spark, path, RESPONSES_SCHEMA, fmt)


def write_files(files: DataFrame, path: str, previous: str | None = None, fmt: str = "parquet") -> None:
    """Writes a whole new version of a table of files (path, ext, content) to ``path``, which must
    be free: the ``files``, and those of the version in ``previous`` that are not among them.

    Readers go over to the new folder when they are told; a job that fails has touched neither
    version.
    """
    files = files.select("path", "ext", "content")
    if previous is not None:
        old = files.sparkSession.read.format(fmt).load(previous).select("path", "ext", "content")
        files = old.join(files.select("path"), "path", "left_anti").unionByName(files)
    files.write.format(fmt).partitionBy("ext").mode("error").save(path)


def write_version(files: DataFrame, table: str, fmt: str = "parquet") -> int:
    """Makes the next version of the table of files in folder ``table`` current, and returns its number: ``files``, and the
    files of the current version that are not among them.

    The version is written to a folder of its own. Then its number is taken by creating a file of that name, which
    holds the folder's; that is one step in any file system, so readers see a whole version, the old or
    the new one, and a job that fails or is beaten to the number by another leaves the table as it was.
    """
    spark = files.sparkSession
    number, current = _current(spark, table) or (0, None)
    folder = f"data-{uuid.uuid4().hex}"
    write_files(files, f"{table}/{folder}", current, fmt)
    _create(spark, f"{table}/_versions/{number + 1:012d}", folder)
    return number + 1


def read_version(spark: SparkSession, table: str, number: int | None = None, fmt: str = "parquet") -> DataFrame:
    """files(path, ext, content) of a version of the table, by default the current one. A reader keeps its version while
    others are written."""
    found = _current(spark, table, number)
    if found is None:
        raise FileNotFoundError(f"no version{'' if number is None else f' {number}'} in {table}")
    return spark.read.format(fmt).load(found[1]).select("path", "ext", "content")


def _versions(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def _current(spark: SparkSession, table: str, number: int | None = None) -> tuple[int, str] | None:
    """(number, folder) of the newest version, or of the one asked for."""
    if not exists(spark, f"{table}/_versions"):
        return None
    path, system = _versions(spark, f"{table}/_versions")
    numbers = [int(name) for name in (s.getPath().getName() for s in system.listStatus(path)) if name.isdigit()]
    if number is None:
        number = max(numbers, default=None)
    if number not in numbers:
        return None
    stream = system.open(spark._jvm.org.apache.hadoop.fs.Path(path, f"{number:012d}"))
    try:
        return number, f"{table}/{stream.readUTF()}"
    finally:
        stream.close()


def _create(spark: SparkSession, name: str, text: str) -> None:
    path, system = _versions(spark, name)
    stream = system.create(path, False)  # fails if it is there
    stream.writeUTF(text)
    stream.close()


RUN_LOG_SCHEMA = "path string, status string, error string"


def write_tree(files: DataFrame) -> DataFrame:
    """Writes every ``content`` back to its ``path`` and returns run_log(path, status, error).

    Paths are URIs, or absolute, of a file system that all executors reach. Each task writes a
    file of its own next to the target and moves it there, so a retried or speculative task is
    harmless and readers see the old text or the new one. A file that fails is logged, not
    fatal, whatever is wrong with it: a NULL content or path, a path in no known store, a folder in its
    place. Nothing is written before an action runs on the log.
    """

    def put(path: str | None, content: str | None) -> None:
        if path is None or content is None:
            raise ValueError("no path" if path is None else "no content")
        system, target = file_system(path)
        draft = f"{target}.{uuid.uuid4().hex}.tmp"
        system.create_dir(target.rpartition("/")[0], recursive=True)
        try:
            with system.open_output_stream(draft) as out:
                out.write(content.encode())
            system.move(draft, target)
        except BaseException:
            with suppress(Exception):
                system.delete_file(draft)
            raise

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            log = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    put(path, content)
                    log.append((path, "ok", None))
                except Exception as error:
                    log.append((path, "error", str(error) or type(error).__name__))
            columns = zip(*log) if log else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "status", "error"])

    return files.select("path", "content").mapInArrow(write, RUN_LOG_SCHEMA)
