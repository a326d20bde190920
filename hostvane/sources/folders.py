"""Folders of stored tables, through Hadoop's file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds; one that is gone already is fine, one that stays is not."""
    _files(spark, path).delete(_path(spark, path), True)
    if exists(spark, path):
        raise OSError(f"could not delete {path}")


def rename(spark: SparkSession, path: str, to: str) -> None:
    if not _files(spark, path).rename(_path(spark, path), _path(spark, to)):
        raise OSError(f"could not rename {path} to {to}")


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a glob pattern."""
    found = _files(spark, pattern).globStatus(_path(spark, pattern))
    return sorted(s.getPath().toString() for s in found or () if s.isDirectory())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: readers see all of it or none."""
    draft = f"{path}.draft"
    out = _files(spark, draft).create(_path(spark, draft), True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if exists(spark, path):
        remove(spark, path)
    rename(spark, draft, path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def partition_folder(spark: SparkSession, table: str, **values: str) -> str:
    """The folder of a partition, with names escaped as Spark writes them."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return "/".join([table, *(f"{column}={escape(value)}" for column, value in values.items())])


def partition_values(spark: SparkSession, table: str, column: str) -> list[str]:
    """Values of a table's first partition column, as its folders name them."""
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return [unescape(f.rsplit("/", 1)[1].split("=", 1)[1]) for f in folders(spark, f"{table}/{column}=*")]
