"""Whole files and folders of whatever file system a path names: listed, moved, written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path = _path(spark, name)
    return _system(spark, path).exists(path)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; a folder that is not there is empty."""
    path = _path(spark, folder)
    system = _system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def delete(spark: SparkSession, name: str) -> None:
    path = _path(spark, name)
    _system(spark, path).delete(path, True)


def make_folder(spark: SparkSession, name: str) -> None:
    path = _path(spark, name)
    _system(spark, path).mkdirs(path)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file or folder; False, and nothing is moved, where the target is there already."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new = _path(spark, source), _path(spark, target)
    never = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    never[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()).rename(old, new, never)
    except Exception:
        if exists(spark, target):
            return False
        raise
    return True


def write_text(spark: SparkSession, name: str, text: str) -> None:
    path = _path(spark, name)
    out = _system(spark, path).create(path, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_once(rows: DataFrame, folder: str, name: str, form: str = "json", **options: str) -> bool:
    """Write rows as ``folder/name``, which readers see whole or not at all; once, however often it is asked for.

    What is written twice, say by a batch that a stream repeats after a failure, is the first that was
    finished.  Readers of the folder look into its folders (``recursiveFileLookup``).
    """
    spark = rows.sparkSession
    target, stage = f"{folder}/{name}", f"{folder}/_staged/{uuid.uuid4().hex}"
    if exists(spark, target):
        return False
    rows.write.options(**options).format(form).save(stage)
    moved = move(spark, stage, target)
    if not moved:
        delete(spark, stage)
    return moved
