"""Files below a folder of any file system the session reads and writes."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Files that are renamed at once.
_MOVES = 16
# Files of one folder, and files whose listing the driver holds at once.
FILES_A_FOLDER, FILES_AT_ONCE = 1 << 12, 1 << 14
# What Spark's writers call a file or folder without a name.
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


class Files:
    """Hadoop's file system below one path, so that any URI the session reads can be written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path, spark.sparkContext._jvm
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name))) if self.exists(name) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def bytes(self, name: str) -> int:
        return self.fs.getContentSummary(self.at(name)).getLength() if self.exists(name) else 0

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def rename(self, name: str, to: str) -> None:
        self.fs.mkdirs(self.at(to).getParent())
        if not self.fs.rename(self.at(name), self.at(to)):
            raise OSError(f"could not rename {name} to {to} below {self.path}")

    def publish(self, name: str, text: str) -> None:
        """Write the whole file beside its place, then rename it: readers see all of it or none."""
        staged = f"_{name.replace('/', '_')}.tmp"
        out = self.fs.create(self.at(staged), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.fs.delete(self.at(name), False)
        self.rename(staged, name)


def write_files(blobs: DataFrame, path: str, overwrite: bool = False) -> list[str]:
    """One file below ``path`` for each row of ``blobs(name, content)``; ``name`` may have folders. Returns the names.

    Executors write the bytes through Spark's own file writers to a staging
    folder; the driver then only renames. Every file ends with a line feed that
    the writer adds. A name that exists is an error, before anything is published,
    unless ``overwrite`` replaces it; names must not repeat.
    """
    spark = blobs.sparkSession
    files, staged = Files(spark, path), f"_staging/{uuid.uuid4().hex}"
    tasks, rows = 4 * spark.sparkContext.defaultParallelism, Observation()
    # Many small files are written by many tasks, each of which moves its own files to the staging folder.
    (blobs.select("name", F.col("content").cast("string").alias("value")).repartition(tasks, "name").observe(rows, F.count(F.lit(1)).alias("n"))
     .write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("name").text(f"{path}/{staged}"))
    # Spark's own listing asks for many folders at once.
    found = [unquote(f).rsplit("/", 2)[1:] for f in spark.read.schema("value string").option("recursiveFileLookup", True).text(f"{path}/{staged}").inputFiles()]
    parts = {unquote(folder.split("=", 1)[1]): f"{staged}/{folder}/{part}" for folder, part in found}
    there = set()
    if not overwrite:
        folders = {n.rpartition("/")[0] for n in parts}
        there = parts.keys() & {f"{f}/{n}" if f else n for f in folders for n in files.names(f)}
    if there or not rows.get["n"] == len(found) == len(parts):
        files.delete(staged)
        raise FileExistsError(f"{len(there)} files exist below {path}, among them {min(there)}" if there else f"names of files repeat below {path}")
    for folder in {n.rpartition("/")[0] for n in parts}:
        files.fs.mkdirs(files.at(folder))

    def publish(name: str) -> None:
        if overwrite:
            files.delete(name)
        if not files.fs.rename(files.at(parts[name]), files.at(name)):
            raise OSError(f"could not rename {parts[name]} to {name} below {path}")

    with ThreadPoolExecutor(_MOVES) as pool:
        list(pool.map(publish, parts))
    files.delete(staged)
    return sorted(parts)


def write_many(blobs: DataFrame, path: str) -> None:
    """``write_files`` for very many small files, whose names the driver never holds.

    Below a folder that all machines see as ``file:``, tasks write the bytes to a staging folder, look for names that
    exist or repeat before anything is published, and rename. Files of other file systems are written by ``write_files``,
    whose list of names grows with their number.
    """
    spark = blobs.sparkSession
    files, staged = Files(spark, path), f"_staging/{uuid.uuid4().hex}"
    if files.fs.getScheme() != "file":
        write_files(blobs, path)
        return
    root = files.fs.makeQualified(files.at("")).toUri().getPath()
    files.fs.mkdirs(files.at(staged))
    names = f"{path}/{staged}/names"

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        folder, n = f"{staged}/{context.partitionId()}-{context.taskAttemptId()}", 0
        os.makedirs(f"{root}/{folder}")
        for b in batches:
            for raw in b.column("content"):
                with open(f"{root}/{folder}/{n}", "wb") as out:
                    if raw.is_valid:
                        out.write(raw.as_buffer())
                    out.write(b"\n")
                n += 1
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array([f"{folder}/{i}" for i in range(n - b.num_rows, n)])], ["name", "part"])

    def existing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n for n in b.column("name").to_pylist() if os.path.lexists(f"{root}/{n}")], pa.string())], ["name"])

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for b in batches:
            for name, part in zip(b.column("name").to_pylist(), b.column("part").to_pylist()):
                folder, _, last = f"{root}/{name}".rpartition("/")
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                # A task that runs again finds some of its files published.
                if os.path.lexists(f"{root}/{part}") or not os.path.lexists(f"{root}/{name}"):
                    os.rename(f"{root}/{part}", f"{root}/{name}")
                    with contextlib.suppress(FileNotFoundError):  # the checksum of a file that had this name
                        os.remove(f"{folder}/.{last}.crc")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    try:
        named = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit(_NO_NAME)).alias("name")
        blobs.select(named, F.col("content").cast("binary").alias("content")).mapInArrow(stage, "name string, part string").write.parquet(names)
        made = spark.read.schema("name string, part string").parquet(names)
        there, first = made.select("name").mapInArrow(existing, "name string").agg(F.count("name"), F.min("name")).first()
        if there or not made.groupBy("name").count().where("count > 1").isEmpty():
            raise FileExistsError(f"{there} files exist below {path}, among them {first}" if there else f"names of files repeat below {path}")
        made.mapInArrow(publish, "n long").agg(F.sum("n")).collect()
    finally:
        files.delete(staged)


def lots(spark: SparkSession, path: str) -> list[list[str]]:
    """The folders and files that match ``path``, so many together that they hold about ``FILES_AT_ONCE`` files; a folder is not divided."""
    files, found, total = Files(spark, path), [[]], 0
    for status in files.fs.globStatus(files.at("")) or []:
        at = status.getPath()
        if at.getName().startswith(("_", ".")):
            continue
        n = files.fs.getContentSummary(at).getFileCount() if status.isDirectory() else 1
        if total + n > FILES_AT_ONCE and found[-1]:
            found.append([])
            total = 0
        found[-1].append(at.toString())
        total += n
    return found
