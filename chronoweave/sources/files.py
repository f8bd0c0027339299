"""Source trees, listings and git state."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.idents import ignore_names, in_folder, is_test_file, relative, should_ingest


def source_tree(spark: SparkSession, root: str, ignored: tuple[str, ...] = (), tests: bool = True, glob: str = "*.{py,ts,tsx,js,jsx}") -> DataFrame:
    """(path, rel_path, text, mtime) of source files below the root, without excluded or ignored folders and
    without nested repositories."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = read.option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace("path", r"^file:/+", "/")
    rows = rows.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), F.unix_micros("modificationTime").alias("mtime"))
    rows = rows.withColumn("rel_path", relative(F.col("path"), F.lit(root))).where(should_ingest(F.col("rel_path"), ignored))
    if not tests:
        rows = rows.where(~is_test_file(F.col("rel_path")))
    return without_nested(rows, nested_repositories(rows, root))


def nested_repositories(files: DataFrame, root: str) -> DataFrame:
    """(folder) of repositories below the root, no deeper than files (rel_path) lie. Spark's readers skip hidden folders, so
    the file system is asked by one pattern for each depth; only the greatest depth and repositories reach the driver."""
    spark = files.sparkSession
    depth = files.agg(F.max(F.size(F.split("rel_path", "/")) - 1)).first()[0] or 0
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsparkSession.sessionState().newHadoopConf()
    plain = re.sub(r"([\\\[\]{}*?])", r"\\\1", root.rstrip("/"))
    system, found = path(root).getFileSystem(conf), []
    for n in range(1, depth + 1):
        for status in system.globStatus(path(f"{plain}{'/*' * n}/.git")) or []:
            found.append(("/".join(status.getPath().getParent().toString().split("/")[-n:]),))
    return spark.createDataFrame(sorted(found), "folder string")


def without_nested(files: DataFrame, nested: DataFrame) -> DataFrame:
    """Files (rel_path) outside nested repositories (folder): an anti join on their folders."""
    nested = nested.select(F.col("folder").alias("_up")).distinct()
    parts = F.split("rel_path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = files.select("rel_path", F.explode(ups).alias("_up")).join(nested, "_up", "left_semi").select("rel_path").distinct()
    return files.join(inside, "rel_path", "left_anti")


def ignored_folders(lines: DataFrame, line: str = "line") -> DataFrame:
    """The folder names that the lines of ignore files exclude."""
    return lines.select(ignore_names(F.col(line)).alias("name")).where("name is not null").distinct()


def disk_changes(listing: DataFrame, recorded: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(path, change) of a listing (path, mtime) against recorded files (path, mtime): missing, touched (newer, or
    never stamped), and new ones, in changed folders (a column dir) if they are given. One full outer join."""
    both = listing.withColumnRenamed("mtime", "now").join(recorded.withColumnRenamed("mtime", "was").withColumn("known", F.lit(True)), "path", "full_outer")
    change = F.when(F.col("now").isNull(), "missing").when(F.col("known").isNull(), "new").when(F.col("was").isNull() | (F.col("now") > F.col("was")), "touched")
    out = both.select("path", change.alias("change")).where("change is not null")
    if folders is not None:
        there = out.where("change = 'new'").withColumn("dir", F.regexp_replace("path", "/[^/]*$", "")).join(folders, "dir", "left_semi").select("path", "change")
        out = out.where("change <> 'new'").unionByName(there)
    return out


def outside(paths: DataFrame, roots: list[str], path: str = "path") -> DataFrame:
    """Paths outside all roots."""
    inside = F.lit(False)
    for root in roots:
        inside = inside | in_folder(F.col(path), F.lit(root))
    return paths.where(~inside)


def git_state(spark: SparkSession, root: str, timeout: float = 2.0) -> DataFrame:
    """One row (head, branch, parent) of the repository at a driver-side path; nulls outside one or on timeout."""

    def run(*args: str) -> str | None:
        try:
            out = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return out.stdout.strip() or None if out.returncode == 0 else None

    head, branch = run("rev-parse", "HEAD"), run("rev-parse", "--abbrev-ref", "HEAD")
    if branch == "HEAD":
        branch = f"detached@{head[:7]}" if head else None
    return spark.createDataFrame([(head, branch, run("rev-parse", "--verify", "-q", "HEAD^"))], "head string, branch string, parent string")
