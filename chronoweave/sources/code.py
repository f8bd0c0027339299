"""Defines, imports and re-exports of source trees, by language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.idents import language, module_name

from . import js_source, python_source

SCRIPTS = r"\.(tsx?|jsx?)$"


def defines(files: DataFrame) -> DataFrame:
    """Defines of files (path relative to the root, text), with lang and module. Other languages have none."""
    python, script = files.where(F.col("path").endswith(".py")), files.where(F.col("path").rlike(SCRIPTS))
    rows = python_source.defines(python).unionByName(js_source.defines(script))
    return rows.withColumn("lang", language(F.col("path"))).withColumn("module", module_name(F.concat(F.lit("/"), "path"), F.lit("")))


def parse_states(files: DataFrame) -> DataFrame:
    """(path, ok) of Python and script files (path, text)."""
    python, script = files.where(F.col("path").endswith(".py")), files.where(F.col("path").rlike(SCRIPTS))
    return python_source.parse_state(python).unionByName(js_source.parse_state(script))


def unresolved_calls(defines: DataFrame, edges: DataFrame, import_map: DataFrame) -> DataFrame:
    """P10: (caller, raw) of calls that name something of the project but lead to no define: undotted names that no import
    binds, or names whose head an import binds to a project module. Built-in and library names cannot be told from typos
    without their libraries, so names that nothing in the project resembles are left to similar_names()."""
    me = F.concat("lang", F.lit("::"), "module", F.lit("."), "qualified_name")
    own = F.transform("imports", lambda x: F.substring_index(x, ".", 1))  # what a body imports is bound there
    raw = defines.select("path", me.alias("caller"), own.alias("own"), F.explode(F.array_distinct("calls")).alias("raw"))
    raw = raw.withColumn("last", F.substring_index("raw", ".", -1)).withColumn("head", F.substring_index("raw", ".", 1))
    raw = raw.where(~F.array_contains("own", F.col("head"))).drop("own")
    done = edges.where("edge_kind = 'call'").select("caller", F.regexp_extract("callee", r"([^.]+)$", 1).alias("last")).distinct()
    bound = import_map.select("path", F.col("name").alias("head"), "target").distinct()
    modules = defines.select(F.col("module").alias("m")).distinct()
    ours = bound.withColumn("m", F.explode(F.array_distinct(F.array("target", F.expr("substring(target, 1, greatest(length(target) - length(substring_index(target, '.', -1)) - 1, 0))"))))).join(modules, "m", "left_semi").select("path", "head", F.lit(True).alias("ours")).distinct()
    left = raw.join(done, ["caller", "last"], "left_anti").join(ours, ["path", "head"], "left").join(bound.select("path", "head", F.lit(True).alias("bound")).distinct(), ["path", "head"], "left")
    return left.where("ours or (bound is null and instr(raw, '.') = 0)").select("caller", "raw")
