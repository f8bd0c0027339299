"""From raw calls to edges between defines: a cascade of joins, in which some steps end the search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.scratch import stored

from .graph import chase


def symbols(defines: DataFrame) -> DataFrame:
    """(fqn, lang, module, name, simple, return_type) of defines (lang, module, qualified_name, return_type)."""
    return defines.select(
        F.concat("lang", F.lit("::"), "module", F.lit("."), "qualified_name").alias("fqn"), "lang", "module",
        F.col("qualified_name").alias("name"), F.substring_index("qualified_name", ".", -1).alias("simple"), "return_type",
    ).distinct()


def stored_symbols(det: DataFrame, root: Column) -> DataFrame:
    """(project_id, fqn, lang, module, name, simple) of the defines that the log says live now: the index without
    reading any source."""
    from chronoweave.functions.idents import language, module_name

    from .chains import CHAIN, current_version

    live = current_version(det).where("edit_type <> 'delete' and define_name is not null").select(*CHAIN)
    rows = live.select("project_id", language(F.col("file_path")).alias("lang"), module_name(F.col("file_path"), root).alias("module"), F.col("define_name").alias("name"))
    return rows.select("project_id", F.concat("lang", F.lit("::"), "module", F.lit("."), "name").alias("fqn"), "lang", "module", "name", F.substring_index("name", ".", -1).alias("simple"))


def resolve_calls(defines: DataFrame, import_map: DataFrame, redirects: DataFrame) -> DataFrame:
    """2.N, C13: (caller, callee, edge_kind) edges of all defines.

    defines: (path, lang, module, qualified_name, calls, imports, bindings, call_assigns, return_type); import_map: (path,
    name, target); redirects: re-exports. Without a dot: a symbol of the module; else what the import map says, re-exports
    followed, or nothing; else the only symbol of that simple name, if it is of the caller's language. With a dot: a
    method of the caller's class for self, cls and this, or nothing; else a method of the receiver's known type; else the
    head through the import map, or nothing; else the module's own dotted name. Calls without a symbol are dropped. Every
    step is an equi join on the candidate's name; known symbols are one column, so a step costs one exchange. Defines and
    imports, which come from parsers, are stored first, so that no step parses again.
    """
    defines, import_map = stored(defines), stored(import_map)
    sym = symbols(defines)
    known = stored(sym.select(F.col("fqn").alias("hit")).distinct())
    unique = sym.groupBy("simple").agg(F.count_distinct("fqn").alias("n"), F.min("fqn").alias("fqn"), F.min("lang").alias("slang")).where("n = 1").drop("n")
    me = F.concat("lang", F.lit("::"), "module", F.lit("."), "qualified_name").alias("caller")
    owner = F.when(F.instr("qualified_name", ".") > 0, F.expr("substring(qualified_name, 1, length(qualified_name) - length(substring_index(qualified_name, '.', -1)) - 1)"))
    raw = defines.select("path", "lang", "module", me, owner.alias("owner"), F.explode(F.array_distinct("calls")).alias("raw"), "bindings")
    receiver = F.expr("CASE WHEN instr(raw, '.') > 0 THEN substring(raw, 1, length(raw) - length(substring_index(raw, '.', -1)) - 1) END")
    raw = raw.withColumns({"head": F.substring_index("raw", ".", 1), "last": F.substring_index("raw", ".", -1), "receiver": receiver, "dot": F.instr("raw", ".") > 0})
    raw = raw.withColumn("rest", F.expr("substring(raw, length(head) + 2)")).withColumn("type", F.col("bindings")[F.col("receiver")]).drop("bindings")
    raw = raw.withColumn("type", F.coalesce("type", F.lit("")))
    maps = import_map.groupBy("path", "name").agg(F.max("target").alias("target"))
    raw = raw.join(maps.select("path", F.col("name").alias("head"), F.col("target").alias("head_to")), ["path", "head"], "left")
    raw = raw.withColumn("type_head", F.substring_index("type", ".", 1)).join(maps.select("path", F.col("name").alias("type_head"), F.col("target").alias("type_to")), ["path", "type_head"], "left")
    lang = lambda c: F.concat("lang", F.lit("::"), c)
    in_module = lambda c: lang(F.concat("module", F.lit("."), c))
    chosen = F.when(F.col("dot"), F.concat("head_to", F.lit("."), "rest")).otherwise(F.col("head_to"))
    candidates = {
        "same": in_module(F.col("raw")),
        "method": F.when(F.col("head").isin("self", "cls", "this") & F.col("owner").isNotNull() & (F.instr("rest", ".") == 0), in_module(F.concat("owner", F.lit("."), "last"))),
        "typed_import": F.when(F.col("type") != "", lang(F.concat_ws(".", "type_to", F.expr("nullif(substring(type, length(type_head) + 2), '')"), "last"))),
        "typed_here": F.when(F.col("type") != "", in_module(F.concat("type", F.lit("."), "last"))),
        "imported": lang(chosen),
    }
    for name, candidate in candidates.items():
        raw = raw.withColumn("_c", candidate).join(known.select(F.col("hit").alias("_c"), F.col("hit").alias(name)), "_c", "left").drop("_c")
    raw = stored(raw)
    # names that an import does not lead to directly may be re-exported; a name is a define of the target module
    targets = raw.where(F.col("head_to").isNotNull() & F.col("imported").isNull()).select("lang", chosen.alias("target")).distinct()
    targets = targets.select("lang", "target", F.expr("substring(target, 1, length(target) - length(substring_index(target, '.', -1)) - 1)").alias("module"), F.substring_index("target", ".", -1).alias("name"))
    followed = chase(redirects, targets, sym.select("module", "name").distinct())
    followed = targets.join(followed, ["module", "name"]).where("to_module is not null").select("lang", "target", F.concat("lang", F.lit("::"), "to_module", F.lit("."), "to_name").alias("through"))
    raw = raw.withColumn("target", chosen).join(followed.join(known.withColumnRenamed("hit", "through"), "through", "left_semi"), ["lang", "target"], "left")
    raw = raw.join(unique.select(F.col("simple").alias("raw"), F.col("fqn").alias("only"), "slang"), "raw", "left")
    by_import = F.coalesce("imported", "through")
    plain = F.when(F.col("same").isNotNull(), F.col("same")).when(F.col("head_to").isNotNull(), by_import).when(F.col("slang") == F.col("lang"), F.col("only"))
    is_method = F.col("head").isin("self", "cls", "this") & F.col("owner").isNotNull() & (F.instr("rest", ".") == 0)
    typed = F.coalesce("typed_import", "typed_here")
    with_dot = F.when(is_method, F.col("method")).when(typed.isNotNull(), typed).when(F.col("head_to").isNotNull(), by_import).otherwise(F.col("same"))
    edges = raw.select("caller", F.when(F.col("dot"), with_dot).otherwise(plain).alias("callee"), F.lit("call").alias("edge_kind")).where("callee is not null")
    modules = sym.select(F.col("module").alias("_m")).distinct()
    local = defines.select(me, F.explode(F.array_distinct("imports")).alias("callee")).withColumn("_m", F.explode(F.array_distinct(F.array("callee", F.substring_index("callee", ".", 1)))))
    local = local.join(modules, "_m", "left_semi").select("caller", "callee", F.lit("import").alias("edge_kind"))
    return edges.unionByName(local).distinct()


def with_return_types(defines: DataFrame, import_map: DataFrame) -> DataFrame:
    """2.N: defines whose bindings also hold variables assigned from functions of known return type: of the module, else
    imported, else the only function of that name. Existing bindings stay. What parsers give is stored first."""
    defines, import_map = stored(defines), stored(import_map)
    sym = symbols(defines).where("return_type <> ''")
    asked = defines.select("path", "lang", "module", "qualified_name", F.explode("call_assigns").alias("var", "fn"))
    here = sym.select("lang", "module", F.col("name").alias("fn"), F.col("return_type").alias("here"))
    maps = import_map.groupBy("path", F.col("name").alias("fn")).agg(F.max("target").alias("target"))
    there = sym.select("lang", F.concat_ws(".", "module", "name").alias("target"), F.col("return_type").alias("there"))
    every = symbols(defines).groupBy(F.col("simple").alias("fn")).agg(F.count_distinct("fqn").alias("n"), F.min("return_type").alias("only")).where("n = 1")
    rows = asked.join(here, ["lang", "module", "fn"], "left").join(maps, ["path", "fn"], "left").join(there, ["lang", "target"], "left").join(every, "fn", "left")
    kind = F.coalesce("here", F.when(F.col("target").isNotNull(), F.col("there")).otherwise(F.nullif(F.col("only"), F.lit(""))))
    found = rows.withColumn("kind", kind).where("kind is not null").groupBy("path", "qualified_name").agg(F.map_from_entries(F.collect_set(F.struct("var", "kind"))).alias("more"))
    out = defines.join(found, ["path", "qualified_name"], "left")
    fresh: Column = F.map_filter("more", lambda k, _: ~F.map_contains_key("bindings", k))
    return out.withColumn("bindings", F.when(F.col("more").isNotNull(), F.map_concat("bindings", fresh)).otherwise(F.col("bindings"))).drop("more")
