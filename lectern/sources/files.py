"""Folders of Markdown and text files, rule tables, unit files and incremental indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = "target string, context string, reference string"
SKIPPED = ("node_modules", ".git")


def slashed(path):
    return F.translate(path, "\\", "/")


def documents(spark: SparkSession, folder: str, endings: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """(file, mtime, size, text) of every text file below folder, outside skipped folders."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(endings) + "}").text(folder, wholetext=True)
    meta = files.select(slashed(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
    return meta.filter(~F.col("file").rlike("/(" + "|".join(map(_escaped, SKIPPED)) + ")/"))


def _escaped(name: str) -> str:
    return name.replace(".", r"\.")


def catalog(files: DataFrame) -> DataFrame:
    """(dir, n_files, n_headings) of documents()."""
    heads = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^#{1,6}\s+")))
    return files.groupBy(F.regexp_extract("file", "^(.*)/", 1).alias("dir")).agg(F.count("*").alias("n_files"), F.sum(heads).alias("n_headings"))


def rules(spark: SparkSession, path: str) -> DataFrame:
    """(find, replace, comment) of lines find=replace#comment, where \\#, \\= and \\\\ stand for themselves."""
    hide = {r"\\\\": "\u0002", r"\\#": "\u0003", r"\\=": "\u0004"}
    line = F.col("value")
    for pattern, mark in hide.items():
        line = F.regexp_replace(line, pattern, mark)

    def shown(column):
        for mark, char in (("\u0003", "#"), ("\u0004", "="), ("\u0002", r"\\")):
            column = F.regexp_replace(column, mark, char)
        return F.trim(column)

    body = F.regexp_extract(line, "^([^#]*)", 1)
    rows = spark.read.text(path).select(
        shown(F.regexp_extract(body, "^([^=]*)=", 1)).alias("find"), shown(F.regexp_extract(body, "^[^=]*=(.*)$", 1)).alias("replace"), shown(F.regexp_extract(line, "#(.*)$", 1)).alias("comment")
    )
    return rows.filter("find <> ''")


def units(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(UNIT).json(path, multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"', mode="overwrite")


def changes(index: DataFrame, listing: DataFrame) -> DataFrame:
    """(file, action): delete what vanished, replace what changed in time or size, add what is new."""
    both = index.select("file", F.struct("mtime", "size").alias("old")).join(listing.select("file", F.struct("mtime", "size").alias("new")), "file", "full")
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "add").when(F.col("old") != F.col("new"), "replace")
    return both.select("file", action.alias("action")).filter("action IS NOT NULL")


def vanished_and_new(index: DataFrame, listing: DataFrame) -> DataFrame:
    """(file, what): deleted files of the index, and added files of the listing."""
    one = lambda a, b, what: a.select("file").distinct().join(b, "file", "left_anti").withColumn("what", F.lit(what))
    return one(index, listing, "deleted").unionAll(one(listing, index, "added"))


def in_scope(path, prefixes: list[str], excluded: list[str] = ()):
    """Whether a path lies in one of the folders and in no excluded one."""
    under = lambda p: (path == p) | path.startswith(p.rstrip("/") + "/")
    any_of = lambda ps: F.lit(False) if not ps else reduce(lambda a, b: a | b, map(under, ps))
    return any_of(prefixes) & ~any_of(list(excluded))


#: What stands between units in one text.
UNIT_BREAK = "\n---\n"


def write_units(units: DataFrame, folder: str, *, key: str = "doc_id", target: str = "target") -> None:
    """Units (key, idx, target, ...) as JSON lines in ``units``, as text in ``joined``, a break after each unit, and the sizes of each key's units in ``stats``.

    Both copies are in the order of key and idx over all part files, which a range partition and a sort within each partition give; null targets are empty text.
    """
    ordered = units.repartitionByRange(key, "idx").sortWithinPartitions(key, "idx")
    ordered.write.json(f"{folder}/units")
    ordered.select(F.coalesce(F.col(target), F.lit("")).alias("value")).write.option("lineSep", UNIT_BREAK).text(f"{folder}/joined")
    size = F.length(F.trim(F.coalesce(F.col(target), F.lit(""))))
    units.groupBy(key).agg(F.count("*").alias("units"), F.max(size).alias("longest"), F.min(size).alias("shortest"), F.sum(size).alias("chars")).write.json(f"{folder}/stats")
