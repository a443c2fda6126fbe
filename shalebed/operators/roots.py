"""File system roots of unpacked images and the files below them.

An inventory has a row for each entry: a key, its path relative to where the
image was unpacked, and its kind (file, dir or link).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elf import ROOT


def _folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def ancestors(path: Column) -> Column:
    """The paths of all folders above an entry, outermost first."""
    folders = _folders(path)
    places = F.when(F.size(folders) > 0, F.sequence(F.lit(1), F.size(folders))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(folders, F.lit(1), i), "/"))


def root_of(path: Column) -> Column:
    """The outermost root above an entry, null without one; roots in it are parts of it."""
    folders = _folders(path)
    at = F.array_position(F.transform(folders, lambda x: x.rlike(ROOT)), F.lit(True)).cast("int")
    return F.when(at > 0, F.array_join(F.slice(folders, F.lit(1), at), "/"))


def reached(inventory: DataFrame, key: str = "firmware_id") -> DataFrame:
    """The files and folders that are reached without following a link.

    An entry goes if a link is among its ancestors, and links themselves go. The
    ancestors are joined to the links as rows, so an image of any size and a link
    above any share of it take one equi-join. Entries without path or kind go;
    those without key are never below a link. Repeated entries are one.
    """
    entries = inventory.select(key, "path", "kind").where(F.col("path").isNotNull() & F.col("kind").isin("file", "dir", "link")).distinct()
    links = entries.where(F.col("kind") == "link").select(key, F.col("path").alias("above"))
    below = entries.select(key, "path", F.explode(ancestors(F.col("path"))).alias("above")).join(links, [key, "above"], "left_semi")
    return entries.where(F.col("kind") != "link").join(below.select(key, "path").distinct(), [key, "path"], "left_anti")


def root_files(inventory: DataFrame, key: str = "firmware_id") -> DataFrame:
    """(key, root, path): the files below each root, by their paths relative to it."""
    found = reached(inventory, key).where(F.col("kind") == "file").withColumn("root", root_of(F.col("path")))
    return found.where(F.col("root").isNotNull()).select(key, "root", F.expr("substring(path, length(root) + 2)").alias("path"))


def find_roots(inventory: DataFrame, key: str = "firmware_id") -> DataFrame:
    """(key, root, n_files, first_path, last_path): one row for each root, those
    without files included, and the first and last of its files in order.
    """
    entries = reached(inventory, key)
    # A folder is below itself, if it is a root.
    root = root_of(F.when(F.col("kind") == "dir", F.concat("path", F.lit("/"))).otherwise(F.col("path")))
    found = entries.withColumn("root", root).where(F.col("root").isNotNull())
    own = F.when(F.col("kind") == "file", F.expr("substring(path, length(root) + 2)"))
    return found.groupBy(key, "root").agg(F.count(own).alias("n_files"), F.min(own).alias("first_path"), F.max(own).alias("last_path"))
