"""Which tests belong to which defines, and which names are alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.console import likely_defines, stem_matches

from .ranks import top_rows


def associated_cases(defines: DataFrame, coverage: DataFrame, cases: DataFrame) -> DataFrame:
    """C20: (define_key, classname, name, tier) with the first tier that has any case: covered, named alike, same file stem.

    defines: (define_key, file_path, define_name). The name tiers are equi joins on exploded names and stems.
    """
    all_cases = cases.select("classname", "name").distinct()
    precise = defines.join(coverage.select("define_name", "classname", "name"), "define_name").join(all_cases, ["classname", "name"], "left_semi").select("define_key", "classname", "name", F.lit(1).alias("tier"))
    named = all_cases.select("classname", "name", F.explode(likely_defines(F.col("classname"), F.col("name"))).alias("define_name"))
    bare = defines.withColumn("define_name", F.explode(F.array_distinct(F.array("define_name", F.substring_index("define_name", ".", -1)))))
    alike = bare.join(named, "define_name").select("define_key", "classname", "name", F.lit(2).alias("tier"))
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    parts = F.flatten(F.array(F.split("classname", r"[./]")))
    bare_part = lambda p: F.regexp_replace(F.regexp_replace(p, "(?i)^test_", ""), "(?i)(_test|_spec)$", "")
    stems = all_cases.withColumn("_stem", F.explode(F.array_distinct(F.transform(parts, bare_part))))
    same = defines.withColumn("_stem", stem).join(stems, "_stem").where(stem_matches(F.col("classname"), F.col("file_path"))).select("define_key", "classname", "name", F.lit(3).alias("tier"))
    every = precise.unionByName(alike).unionByName(same).distinct()
    best = every.groupBy("define_key").agg(F.min("tier").alias("tier"))
    return every.join(best, ["define_key", "tier"])


def similar_names(asked: DataFrame, names: DataFrame, most: int = 2, k: int = 3) -> DataFrame:
    """(text, name, distance): for each asked text the k names nearest by edit distance, at most `most`, or else
    containing it or contained in it (distance 3); equal names are left out. Ties by name.

    Candidates meet on deletion neighbourhoods: two texts within two edits share a variant with at most two characters
    removed, so there is no comparison of all with all. Containment meets on the shorter text's rarest three characters,
    which the longer one must hold, too, so both sides are linear in the names' length.
    """
    def variants(c):
        cut = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        one = cut(F.lower(c))
        return F.array_distinct(F.concat(F.array(F.lower(c)), one, F.flatten(F.transform(one, cut))))

    def grams(rows, name):
        n = F.length(name)
        return rows.where(n >= 3).select(name, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(F.lower(name), i, F.lit(3))))).alias("g"))

    def holding(outer, inner, long, short):
        """Pairs whose long text contains the short one."""
        held = grams(outer, long)
        often = held.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        rarest = grams(inner, short).join(often, "g", "left").fillna(0, ["n"]).groupBy(short).agg(F.min_by("g", F.struct("n", "g")).alias("g"))
        return held.join(rarest, "g").where(F.contains(F.lower(long), F.lower(short))).select("text", "name")

    a = asked.select("text").distinct().where("length(text) > 0")
    b = names.select("name").distinct().where("length(name) > 0")
    near = a.select("text", F.explode(variants(F.col("text"))).alias("v")).join(b.select("name", F.explode(variants(F.col("name"))).alias("v")), "v").select("text", "name").distinct()
    near = near.withColumn("distance", F.levenshtein(F.lower("text"), F.lower("name"))).where(F.col("distance") <= most)
    held = holding(b, a, "name", "text").unionByName(holding(a, b, "text", "name")).distinct().withColumn("distance", F.lit(3))
    every = near.unionByName(held).where("text <> name").groupBy("text", "name").agg(F.min("distance").cast("long").alias("distance"))
    return top_rows(every, ["text"], [F.col("distance"), F.col("name")], k)


def edited_cases(cases: DataFrame, edited: DataFrame) -> DataFrame:
    """Cases (classname, name) whose test define (define_name) was edited: the function itself, Class.method with both
    parts equal, or the class. Equi joins on the names a case can be edited by."""
    cls = F.element_at(F.split("classname", r"\."), -1)
    bare = F.regexp_replace("name", r"\[.*\]$", "")
    by = cases.select("classname", "name", F.explode(F.array_distinct(F.array(bare, F.concat_ws(".", cls, bare), cls))).alias("define_name"))
    return by.join(edited.select("define_name").distinct(), "define_name", "left_semi").select("classname", "name").distinct()
