"""Functions and methods of Python sources, with what identifies and connects them.

Parsing needs Python's own parser, so files go through Arrow batches to Python workers, one file at a time.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFINES = (
    "path string, qualified_name string, start_line long, end_line long, params struct<required:int,defaults:int,has_args:boolean,has_kwargs:boolean,keyword_only:int>, "
    "returns_kind string, calls array<string>, numerics array<string>, operators array<string>, imports array<string>, effects array<string>, statements int, "
    "bindings map<string,string>, call_assigns map<string,string>, return_type string, content_hash string, asserts boolean"
)
#: Types that stand for what they hold.
WRAPPERS = ("Optional", "Awaitable", "Coroutine", "Final", "ClassVar")
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
BLOCKS = (ast.If, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.For, ast.AsyncFor, ast.While)


def dotted(node: ast.AST) -> str | None:
    """a.b.c of names and attributes; None for anything else."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (owner := dotted(node.value)):
        return f"{owner}.{node.attr}"
    return None


def type_name(node: ast.AST | None) -> str:
    """The class that an annotation names: the first of a union, what a wrapper holds, "" for containers."""
    if node is None or isinstance(node, ast.Constant) and not isinstance(node.value, str):
        return ""
    if isinstance(node, ast.Constant):
        try:
            return type_name(ast.parse(node.value, mode="eval").body)
        except SyntaxError:
            return ""
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return type_name(node.left) or type_name(node.right)
    if isinstance(node, ast.Subscript):
        outer = (dotted(node.value) or "").rpartition(".")[2]
        inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        if outer == "Union":
            return next((n for x in inner if (n := type_name(x))), "")
        if outer in WRAPPERS:
            return type_name(inner[-1])
        return ""
    return dotted(node) or ""


def own_nodes(node: ast.AST) -> Iterator[ast.AST]:
    """What a function's body holds, in source order, without nested functions and classes."""
    for child in ast.iter_child_nodes(node):
        if not isinstance(child, (*FUNCTIONS, ast.ClassDef)):
            yield child
            yield from own_nodes(child)


def has_decorator(node: ast.AST, name: str) -> bool:
    return any((dotted(d) or "").rpartition(".")[2] == name for d in getattr(node, "decorator_list", []))


def operator_names(node: ast.AST) -> list[str]:
    kind = lambda op: type(op).__name__
    if isinstance(node, ast.BinOp | ast.UnaryOp):
        return [kind(node.op)]
    if isinstance(node, ast.BoolOp):
        return [kind(node.op)] * (len(node.values) - 1)
    if isinstance(node, ast.Compare):
        return [kind(op) for op in node.ops]
    if isinstance(node, ast.AugAssign):
        return ["Aug" + kind(node.op)]
    return []


def bound_types(nodes: list[ast.AST], returns: dict[str, str]) -> dict[str, str]:
    """Receivers of known type among annotated and constructor assignments; the last one counts."""
    out: dict[str, str] = {}
    for n in nodes:
        if isinstance(n, ast.AnnAssign) and (name := dotted(n.target)) and (kind := type_name(n.annotation)):
            out[name] = kind
        elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and len(n.targets) == 1 and (name := dotted(n.targets[0])) and (called := dotted(n.value.func)):
            last = called.rpartition(".")[2]
            if last[:1].isupper():
                out[name] = called
            elif returns.get(called):
                out[name] = returns[called]
    return out


def field_types(cls: ast.ClassDef, returns: dict[str, str]) -> dict[str, str]:
    """Types of self.x over all methods and of annotated class fields; a field with two types has none."""
    found: dict[str, set[str]] = {}
    for item in cls.body:
        if isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name) and (kind := type_name(item.annotation)):
            found.setdefault(f"self.{item.target.id}", set()).add(kind)
        if isinstance(item, FUNCTIONS):
            params = {a.arg: type_name(a.annotation) for a in [*item.args.posonlyargs, *item.args.args, *item.args.kwonlyargs]}
            nodes = list(own_nodes(item))
            for name, kind in bound_types(nodes, returns).items():
                if name.startswith("self."):
                    found.setdefault(name, set()).add(kind)
            for n in nodes:
                if isinstance(n, ast.Assign) and isinstance(n.value, ast.Name) and params.get(n.value.id):
                    for target in n.targets:
                        if (name := dotted(target)) and name.startswith("self."):
                            found.setdefault(name, set()).add(params[n.value.id])
    return {name: kinds.pop() for name, kinds in found.items() if len(kinds) == 1}


def function_row(path: str, source: str, fn: ast.AST, prefix: str, method: bool, fields: dict[str, str], returns: dict[str, str]) -> dict:
    a = fn.args
    positional = [*a.posonlyargs, *a.args][1 if method and not has_decorator(fn, "staticmethod") else 0 :]
    defaults = min(len(a.defaults), len(positional))
    nodes = list(own_nodes(ast.Module(fn.body, [])))
    effects = {"async"} if isinstance(fn, ast.AsyncFunctionDef) else set()
    calls, numerics, operators, imports, assigned = [], [], [], [], {}
    kinds = set()
    for n in nodes:
        operators += operator_names(n)
        if isinstance(n, ast.Call) and (name := dotted(n.func)):
            calls.append(name)
        elif isinstance(n, ast.Constant) and type(n.value) in (int, float):
            numerics.append(ast.get_source_segment(source, n) or repr(n.value))
        elif isinstance(n, ast.Return):
            kinds.add("value" if n.value is not None else "bare")
        elif isinstance(n, ast.Import):
            imports += [x.name for x in n.names if not x.asname]
        elif isinstance(n, ast.ImportFrom):
            imports += [n.module] * bool(n.module) + [x.name for x in n.names if not x.asname and x.name != "*"]
        elif isinstance(n, ast.Global | ast.Nonlocal):
            effects.add("global_write" if isinstance(n, ast.Global) else "nonlocal_write")
        elif isinstance(n, ast.Raise):
            effects.add("raises")
        elif isinstance(n, ast.Await):
            effects.add("async")
        elif isinstance(n, ast.Yield | ast.YieldFrom):
            effects.add("generator")
        if isinstance(n, ast.Assign | ast.AugAssign | ast.AnnAssign):
            target = n.targets[0] if isinstance(n, ast.Assign) else n.target
            effects |= {"attr_write"} if isinstance(target, ast.Attribute) else {"subscript_write"} if isinstance(target, ast.Subscript) else set()
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and (x := dotted(target)) and isinstance(n.value.func, ast.Name):
                assigned[x] = n.value.func.id
    typed = {x.arg: t for x in [*positional, *a.kwonlyargs] if (t := type_name(x.annotation))}
    asserting = any(isinstance(n, ast.Assert) or isinstance(n, ast.Call) and ("assert" in (dotted(n.func) or "").lower() or (dotted(n.func) or "").endswith("raises")) for n in nodes)
    return {
        "path": path, "qualified_name": prefix + fn.name, "start_line": fn.lineno, "end_line": fn.end_lineno,
        "params": {"required": len(positional) - defaults, "defaults": defaults, "has_args": a.vararg is not None, "has_kwargs": a.kwarg is not None, "keyword_only": len(a.kwonlyargs)},
        "returns_kind": "value" if "value" in kinds else "bare" if kinds else "none", "calls": calls, "numerics": numerics, "operators": sorted(operators), "imports": imports,
        "effects": sorted(effects), "statements": len(fn.body), "bindings": {**fields, **typed, **bound_types(nodes, returns)}, "call_assigns": assigned, "return_type": type_name(fn.returns),
        "content_hash": hashlib.sha256("\n".join(map(ast.dump, fn.body)).encode()).hexdigest()[:16], "asserts": asserting,
    }


def file_defines(path: str, source: str) -> list[dict]:
    """Functions and methods, also inside control flow, but not inside functions; overload stubs are left out."""
    tree = ast.parse(source)
    returns = {f.name: t for f in ast.walk(tree) if isinstance(f, FUNCTIONS) and (t := type_name(f.returns))}
    out: list[dict] = []

    def collect(body: list[ast.stmt], prefix: str, method: bool, fields: dict[str, str]) -> None:
        for node in body:
            if isinstance(node, FUNCTIONS):
                if not has_decorator(node, "overload"):
                    out.append(function_row(path, source, node, prefix, method, fields, returns))
            elif isinstance(node, ast.ClassDef):
                collect(node.body, f"{prefix}{node.name}.", True, field_types(node, returns))
            elif isinstance(node, BLOCKS):
                for part in ("body", "orelse", "finalbody"):
                    collect(getattr(node, part, []), prefix, method, fields)
                for handler in getattr(node, "handlers", []):
                    collect(handler.body, prefix, method, fields)

    collect(tree.body, "", False, {})
    return out


def module_of(rel: str) -> tuple[str, bool]:
    """(dotted module, whether it is a package's own file)."""
    parts = rel.removesuffix(".py").split("/")
    return (".".join(parts[:-1]), True) if parts[-1] == "__init__" else (".".join(parts), False)


def from_module(node: ast.ImportFrom, module: str, package: bool) -> str:
    """The absolute module of a from-import, relative ones resolved."""
    if not node.level:
        return node.module or ""
    parts = module.split(".") if module else []
    up = parts[: len(parts) - node.level + package]
    return ".".join([*up, *([node.module] if node.module else [])])


def file_imports(rel: str, source: str) -> list[tuple[str, str]]:
    """(name, target) of what a module's top-level imports bind, as module or module.name."""
    module, package = module_of(rel)
    out = []
    for node in ast.parse(source).body:
        if isinstance(node, ast.Import):
            out += [(x.asname, x.name) if x.asname else (x.name.partition(".")[0], x.name.partition(".")[0]) for x in node.names]
        elif isinstance(node, ast.ImportFrom):
            base = from_module(node, module, package)
            out += [(x.asname or x.name, f"{base}.{x.name}".strip(".")) for x in node.names if x.name != "*"]
    return out


def file_reexports(rel: str, source: str) -> list[tuple[str, str, str, str]]:
    """(barrel, exported, target module, target name) of a package file's from-imports; * for all names."""
    module, package = module_of(rel)
    if not package:
        return []
    out = []
    for node in ast.parse(source).body:
        if isinstance(node, ast.ImportFrom) and (base := from_module(node, module, package)) != module:
            out += [(module, "*" if x.name == "*" else x.asname or x.name, base, x.name) for x in node.names]
    return out


def _mapped(files: DataFrame, rows_of, schema: str, columns: list[str]) -> DataFrame:
    """rows_of(path, text) for every file; those that cannot be parsed give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    rows += rows_of(path, text or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "text").mapInPandas(run, schema)


def defines(files: DataFrame) -> DataFrame:
    """A row for each function or method of files (path, text)."""
    return _mapped(files, file_defines, DEFINES, [c.split(" ")[0] for c in ("path qualified_name start_line end_line params returns_kind calls numerics operators imports effects statements bindings call_assigns return_type content_hash asserts").split()])


def imports(files: DataFrame) -> DataFrame:
    return _mapped(files, lambda p, t: [(p, *x) for x in file_imports(p, t)], "path string, name string, target string", ["path", "name", "target"])


def reexports(files: DataFrame) -> DataFrame:
    columns = ["barrel_module", "exported_name", "target_module", "target_name"]
    return _mapped(files, file_reexports, ", ".join(f"{c} string" for c in columns), columns)


def parse_state(files: DataFrame) -> DataFrame:
    """(path, ok) of files, for the parse_skipped rule."""

    def state(path: str, text: str) -> list[tuple[str, bool]]:
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return [(path, False)]
        return [(path, True)]

    return _mapped(files, state, "path string, ok boolean", ["path", "ok"])


def fingerprints(rows: DataFrame) -> DataFrame:
    """Coarse and fine fingerprints of defines. Coarse: shape of parameters, kind of returns, last parts of calls,
    effects, size, numbers. Fine: calls with their receiver (without self, cls, this), and operators."""
    size: Column = F.when(F.col("statements") <= 3, "xs").when(F.col("statements") <= 10, "s").when(F.col("statements") <= 30, "m").when(F.col("statements") <= 100, "l").otherwise("xl")
    last = F.array_sort(F.array_distinct(F.transform("calls", lambda c: F.substring_index(c, ".", -1))))
    receiver = F.array_sort(F.array_distinct(F.transform("calls", lambda c: F.regexp_replace(c, r"^(self|cls|this)\.", ""))))
    shared = [F.col("params"), F.col("returns_kind"), F.col("effects"), size.alias("size"), F.col("numerics")]
    digest = lambda *c: F.substring(F.sha2(F.to_json(F.struct(*c)), 256), 1, 16)
    return rows.withColumn("node_fingerprint", digest(*shared, last.alias("calls"))).withColumn("fine_fingerprint", digest(*shared, receiver.alias("calls"), F.col("operators")))


def assertion_free(rows: DataFrame) -> DataFrame:
    """Test functions without any assertion."""
    return rows.where(F.substring_index("qualified_name", ".", -1).startswith("test") & ~F.col("asserts")).select("path", "qualified_name")
