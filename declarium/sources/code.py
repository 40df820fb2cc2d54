"""Where source files come from: a folder tree, or a table of file contents.

A source has ``listing()`` -> ``path, mtime, size`` without any content, and
``contents(queue, everything)`` -> ``path, mtime, size, content`` of the queued files.
"""

from __future__ import annotations

import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declarium.functions.language import SOURCE_SUFFIXES, is_source
from declarium.plans.shared import written

# Rows and bytes of a path list that may be broadcast.
BROADCAST_PATHS = 1_000_000
BROADCAST_BYTES = 128 * 1024 * 1024


# Fixed value: the columns of Spark's binary file source, which a stream must be told.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def _any_case(suffix: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)


# Spark's file name filter is case-sensitive; it keeps other files from being opened at all.
SOURCE_GLOB = "*{" + ",".join(_any_case(s) for s in SOURCE_SUFFIXES) + "}"


def _without_scheme(path: str) -> str:
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/")


class FolderSource:
    """All C/C++ sources and headers under a folder.

    Spark hides names that start with ``_`` or ``.``: hidden folders are read if named in
    ``hidden_folders``, hidden files only through :class:`TableSource`.
    """

    # Paths go through the driver when only some files are read, so they go in batches.
    batch_files = 100_000
    # A batch opens its own files only.
    one_pass = False

    def __init__(self, spark: SparkSession, root: str, hidden_folders: list[str] | None = None):
        self.spark = spark
        self.root = root if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", root) else os.path.abspath(root)
        self.hidden_folders = list(hidden_folders or [])

    def _reader(self, stream: bool = False):
        reader = self.spark.readStream if stream else self.spark.read
        return (
            reader.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", SOURCE_GLOB)
        )

    @staticmethod
    def _described(files: DataFrame, *columns: str) -> DataFrame:
        return files.where(is_source(F.col("path"))).select(
            "path",
            (F.unix_micros("modificationTime") / F.lit(1e6)).alias("mtime"),
            F.col("length").alias("size"),
            *columns,
        )

    def listing(self) -> DataFrame:
        try:
            files = self._reader().load([self.root, *self.hidden_folders])
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                raise FileNotFoundError(f"Root path does not exist: {self.root}") from error
            raise
        # A folder lists files below it; a file lists itself.
        first = files.select("path").head()
        if first is not None and _without_scheme(first["path"]) == _without_scheme(self.root):
            raise NotADirectoryError(f"Root path is not a directory: {self.root}")
        return self._described(files)

    def contents(self, queue: DataFrame, everything: bool) -> DataFrame:
        if everything:
            return self._described(self._reader().load([self.root, *self.hidden_folders]), "content")
        # A filter on the path would still read every file; at most one batch of names.
        paths = [_escape_glob(row["path"]) for row in queue.select("path").toLocalIterator()]
        return self._described(self._reader().load(paths), "content")

    def stream(self, max_files_per_trigger: int = 10_000) -> DataFrame:
        """New files as they appear. Edits of a file already seen need :func:`refresh` or :func:`watch`."""
        reader = self._reader(stream=True).schema(BINARY_FILE).option("maxFilesPerTrigger", max_files_per_trigger)
        files = reader.load(self.root)
        return self._described(files, "content")


def _escape_glob(path: str) -> str:
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


class TableSource:
    """A table with ``path, mtime, size, content``. Of several rows of one path the newest counts: the
    latest time, then the greatest size, then any one content, always the same."""

    batch_files = None
    one_pass = True

    def __init__(self, files: DataFrame):
        self.files = files.where(is_source(F.col("path"))).select(
            "path",
            F.col("mtime").cast("double").alias("mtime"),
            F.col("size").cast("bigint").alias("size"),
            F.col("content").cast("binary").alias("content"),
        )

    def listing(self) -> DataFrame:
        newest = F.max(F.struct("mtime", "size"))
        return self.files.groupBy("path").agg(newest.alias("f")).select("path", "f.*")

    def _single(self, files: DataFrame) -> DataFrame:
        """One row per path. Repeats are found without the contents, which are hashed and moved only for
        paths that really repeat."""
        version = F.struct("mtime", "size")
        several = files.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max(version).alias("newest")).where("n > 1")
        several = written(several.select("path", "newest"))
        if several.isEmpty():
            return files
        repeated = files.join(several, "path").where(version.eqNullSafe(F.col("newest"))).drop("newest")
        mark = F.xxhash64("content")
        marks = repeated.groupBy("path").agg(F.max(mark).alias("mark"))
        repeated = repeated.join(marks, "path").where(mark == F.col("mark")).drop("mark")
        return files.join(several, "path", "left_anti").unionByName(repeated.dropDuplicates(["path"]))

    def contents(self, queue: DataFrame, everything: bool) -> DataFrame:
        if everything:
            return self._single(self.files)
        paths = queue.select("path")
        extent = paths.agg(F.count("*").alias("n"), F.sum(F.octet_length("path")).alias("bytes")).first()
        if extent["n"] <= BROADCAST_PATHS and (extent["bytes"] or 0) <= BROADCAST_BYTES:
            # The content stays where it is.
            paths = F.broadcast(paths)
        return self._single(self.files.join(paths, "path", "left_semi"))
