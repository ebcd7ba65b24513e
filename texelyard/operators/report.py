"""Summaries: batch outcome, archive contents, directory tree, recent items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texelyard.functions import rules
from texelyard.operators.assets import search as search_paths


def batch_summary(results: DataFrame) -> DataFrame:
    """Totals of a batch; ``success`` is null for files not processed yet."""
    counted = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("success").alias("processed"),
        F.count_if(F.col("success")).alias("success"),
        F.count_if(~F.col("success")).alias("fail"),
    )
    fraction = F.when(F.col("total") > 0, F.col("processed") / F.col("total")).otherwise(0.0)
    message = F.format_string(
        "%d converted, %d failed, %d in all", "success", "fail", "total"
    )
    return counted.withColumns(
        {
            "done": F.col("processed") >= F.col("total"),
            "fraction": fraction,
            "message": F.when(F.col("processed") >= F.col("total"), message),
        }
    )


def archive_summary(listing: DataFrame, toc: DataFrame, supported: Column, is_split: bool = True) -> DataFrame:
    """Supported textures of an archive, in one aggregate and one pass over both sources.

    ``listing`` is whole and ``supported`` tells its textures; ``toc`` is already
    filtered. ``is_split`` says that the archive is of the kind with a table of
    contents, whose summary names both parts even if one is empty.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tagged = listing.select(none.alias("d4"), F.coalesce(supported, F.lit(False)).cast("long").alias("other"), one.alias("all")).unionAll(
        toc.select(one.alias("d4"), none.alias("other"), none.alias("all"))
    )
    sums = tagged.agg(*[F.coalesce(F.sum(p), none).alias(p) for p in ("d4", "other", "all")])
    split = F.format_string(": %d split, %d other", "d4", "other")
    status = F.concat(
        F.format_string("%d textures", F.col("d4") + F.col("other")),
        split if is_split else F.lit(""),
        F.format_string("; %d files in all", "all"),
    )
    return sums.select(
        (F.col("d4") + F.col("other")).alias("supported"),
        F.col("d4").alias("d4_textures"),
        F.col("other").alias("other_textures"),
        F.col("all").alias("total_files"),
        status.alias("status"),
    )


def issue_report(df: DataFrame) -> DataFrame:
    """Append each issue to the message on its own indented line, in order."""
    lines = F.array_join(F.transform("issues", lambda issue: F.concat(F.lit("\n  "), issue)), "")
    return df.withColumn("message", F.concat(F.col("message"), lines))


def tree_nodes(listing: DataFrame, toc: DataFrame | None = None, text: str = "") -> DataFrame:
    r"""Nodes of the directory tree: node_path, parent_path, name, depth, is_file, sno.

    Paths split on ``/`` and ``\``; a name first met as a file stays a file.
    Folders are reduced to distinct ones before their ancestors are exploded,
    so rows grow with files plus folders, not with files times depth. Entries of
    ``toc`` hang below one virtual folder, which may also exist in the listing.
    """
    files = search_paths(listing, text).select("path", F.translate("path", "\\", "/").alias("norm"))
    files = files.filter(F.col("norm") != "")
    # A trailing separator ends the last folder, it does not open an empty file.
    leaf = ~F.col("norm").endswith("/")
    folder = F.left("norm", F.char_length("norm") - F.char_length(F.substring_index("norm", "/", -1)) - 1)
    folders = (
        files.filter(F.instr("norm", "/") > 0)
        .groupBy(folder.alias("folder"))
        .agg(F.min("path").alias("path"))
        .withColumn("depth", F.explode(F.sequence(F.lit(1), _depth("folder"))))
        .select(F.call_function("substring_index", "folder", F.lit("/"), "depth").alias("node_path"), "path",
                F.lit(False).alias("leaf"))
    )
    nodes = folders.unionAll(files.filter(leaf).select("norm", "path", F.lit(True)))
    if toc is not None:
        # The virtual folder comes after every listed path that shares its name.
        virtual = toc.limit(1).select(F.lit(rules.VIRTUAL_FOLDER), F.lit("\uffff"), F.lit(False))
        nodes = nodes.unionAll(virtual)
    first = nodes.groupBy("node_path").agg(F.min(F.struct("path", "leaf")).alias("first"))
    name = F.substring_index("node_path", "/", -1)
    parent = F.left("node_path", F.greatest(F.char_length("node_path") - F.char_length(name) - 1, F.lit(0)))
    tree = first.select(
        "node_path",
        parent.alias("parent_path"),
        name.alias("name"),
        _depth("node_path").alias("depth"),
        F.col("first.leaf").alias("is_file"),
        F.lit(None).cast("int").alias("sno"),
    )
    if toc is None:
        return tree
    shown = search_paths(toc.withColumn("name", F.concat("name", F.lit(".tex"))), text, "name")
    return tree.unionAll(
        shown.select(
            F.concat(F.lit(f"{rules.VIRTUAL_FOLDER}/"), F.col("name")),
            F.lit(rules.VIRTUAL_FOLDER),
            "name",
            F.lit(2),
            F.lit(True),
            F.col("sno").cast("int"),
        )
    )


def _depth(path: str):
    """Number of segments of a normalised path."""
    return F.char_length(path) - F.char_length(F.replace(F.col(path), F.lit("/"), F.lit(""))) + 1


def recent_items(events: DataFrame, n: int = rules.MAX_RECENT) -> DataFrame:
    """The ``n`` most recent distinct items of each user, newest first."""
    latest = events.groupBy("user_id", "item").agg(F.max("ts").alias("ts"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.asc("item"))
    return latest.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= n)


def union_catalog(listing: DataFrame, toc: DataFrame) -> DataFrame:
    """Archive files and table-of-contents entries in one catalog."""
    files = listing.select("path", F.lit("file").alias("origin"))
    entries = toc.select(F.concat("name", F.lit(".tex")).alias("path"), F.lit("toc").alias("origin"), "sno")
    return files.unionByName(entries, allowMissingColumns=True)
