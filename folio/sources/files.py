"""Listing of input files on the driver and their bytes as a DataFrame."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.config import EXTENSIONS, MAX_FILES

log = logging.getLogger(__name__)


def supported(name: str) -> bool:
    return os.path.splitext(name)[1].lower() in EXTENSIONS


def inside(path: str, root: str) -> bool:
    """Whether a resolved path stays under the resolved root."""
    return path == root or path.startswith(root.rstrip(os.sep) + os.sep)


def walk(folder: str) -> Iterator[str]:
    """Files of a tree, each folder's before its subfolders', in order of name; linked folders aren't followed."""
    for place, folders, names in os.walk(folder, followlinks=False):
        folders.sort()
        yield from (os.path.join(place, n) for n in sorted(names))


def collect(path: str, *, recursive: bool = False, limit: int | None = MAX_FILES) -> tuple[list[str], bool]:
    """Real paths of supported files at ``path`` and whether a tree had more than ``limit`` (None: no limit).

    A single file counts by its resolved name, files of a folder by the name
    listed; links that lead out of the folder are left out. Nothing there: an
    empty list.
    """
    if os.path.isfile(path):
        own = os.path.realpath(path)
        return ([own] if supported(own) else []), False
    if not os.path.isdir(path):
        log.error("no such input: %s", path)
        return [], False
    root, found = os.path.realpath(path), []
    listed = walk(path) if recursive else (os.path.join(path, n) for n in sorted(os.listdir(path)))
    for name in listed:
        real = os.path.realpath(name)
        if not inside(real, root):
            log.warning("a link leads out of the folder: %s", name)
        elif os.path.isfile(real) and supported(name):
            if recursive and limit is not None and len(found) == limit:
                log.warning("more than %d files; the rest isn't collected", limit)
                return found, True
            found.append(real)
    return found, False


def distinct_paths(paths: Iterable[str]) -> list[str]:
    """Each path once, in order of first occurrence."""
    return list(dict.fromkeys(paths))


def file_rows(files: DataFrame) -> DataFrame:
    """Adds filename, stem and ext (lower case, with its dot) to rows with a path."""
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    ext = F.lower(F.regexp_extract("filename", r"(?s).(\.[^.]*)\z", 1))
    return files.withColumn("filename", name).withColumn("ext", ext).withColumn("stem", F.expr("left(filename, length(filename) - length(ext))"))


def read_files(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Bytes of the files, in parallel: path, pos (order of input), filename, stem, ext, length, content."""
    listed = distinct_paths(paths)
    if not listed:
        return spark.createDataFrame([], "path string, pos int, filename string, stem string, ext string, length long, content binary")
    order = spark.createDataFrame([(p if "://" in p else "file:" + p, i) for i, p in enumerate(listed)], "wanted string, pos int")
    content = spark.read.format("binaryFile").load(listed).select("path", "length", "content")
    plain = F.regexp_replace("path", r"\Afile:/+", "file:/")
    joined = content.withColumn("wanted", plain).join(order, "wanted").drop("wanted")
    return file_rows(joined).select("path", "pos", "filename", "stem", "ext", "length", "content")


def read_folder(spark: SparkSession, folder: str, *, recursive: bool = False) -> DataFrame:
    """All supported files of a folder on any file system, listed by Spark; for inputs too many to list on the driver."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    files = file_rows(reader.load(folder).select("path", "length", "content"))
    return files.where(F.col("ext").isin(*EXTENSIONS)).select("path", "filename", "stem", "ext", "length", "content")
