"""Paths, modules and qualified names; which paths are test code, generated, or outside a project."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The conventions that mark test code, generated code and foreign folders.
TEST_DIRS = ("tests", "__tests__", "e2e", "cypress")
JS_TEST_SUFFIXES = (".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", ".e2e.ts", ".e2e.tsx")
JS_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs")
EXCLUDED_DIRS = ("node_modules", "__pycache__", ".venv", "venv", ".git", ".hg", ".svn", "dist", "build", ".next", ".nuxt", "target", ".pytest_cache", ".mypy_cache")
DETECTOR_GLOBS = ("*/tests/*", "*_test.py", "*/migrations/*", "*_pb2.py", "*/generated/*", "*/legal/*.tsx", "legal/*.tsx")
FRAMEWORK_FILES = ("loading.tsx", "loading.jsx", "error.tsx", "error.jsx", "not-found.tsx", "not-found.jsx", "global-error.tsx", "template.tsx", "default.tsx", "page.tsx", "page.jsx", "layout.tsx", "layout.jsx")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ends_with_any(text: Column, ends: tuple[str, ...]) -> Column:
    return text.rlike("(" + "|".join(map(re.escape, ends)) + ")$")


def language(path: Column) -> Column:
    """Py, js_ts or other, by extension."""
    return F.when(path.endswith(".py"), "py").when(ends_with_any(path, JS_EXTENSIONS), "js_ts").otherwise("other")


def relative(path: Column, root: Column) -> Column:
    """The path below the root; other paths stay."""
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def module_name(path: Column, root: Column) -> Column:
    """1.4: relative path without extension; for Python with dots, and without a last __init__."""
    bare = F.regexp_replace(relative(path, root), r"\.(py|tsx?|jsx?|mjs)$", "")
    dotted = F.regexp_replace(bare, "/", ".")
    python = F.when(dotted == "__init__", "").otherwise(F.regexp_replace(dotted, r"\.__init__$", ""))
    return F.when(path.endswith(".py"), python).otherwise(bare)


def qualified(path: Column, root: Column, define: Column) -> Column:
    """1.4: language::module.define, the key of call edges."""
    return F.concat(language(path), F.lit("::"), module_name(path, root), F.lit("."), define)


def is_test_file(path: Column) -> Column:
    """Test code by folder or file name."""
    name = basename(path)
    python = name.endswith(".py") & (name.startswith("test_") | name.endswith("_test.py"))
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEST_DIRS))) | ends_with_any(name, JS_TEST_SUFFIXES) | (name == "conftest.py") | python


def glob_regex(glob: str) -> str:
    """A shell pattern whose * also crosses slashes, as a regular expression for whole paths."""
    out = []
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches_any(path: Column, globs: tuple[str, ...] | list[str]) -> Column:
    if not globs:
        return F.lit(False)
    return path.rlike("|".join(glob_regex(g) for g in globs))


def out_of_detection(path: Column) -> Column:
    """Paths that detectors leave alone. Not the same as test files."""
    name = basename(path)
    return name.isin(*FRAMEWORK_FILES) | name.startswith("test_") | matches_any(path, DETECTOR_GLOBS)


def in_folder(path: Column, root: Column) -> Column:
    """The root itself or below it."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def should_ingest(rel: Column, ignored: tuple[str, ...] = ()) -> Column:
    """B10 without nested repositories (see sources.files): no folder of the relative path is excluded or ignored."""
    return ~F.arrays_overlap(F.split(rel, "/"), F.array(*map(F.lit, (*EXCLUDED_DIRS, *ignored))))


def folded(path: Column) -> Column:
    """The path without empty steps, single dots, and folders that are left again, however many; a path that leaves its
    start keeps its leading double dots, an absolute one has none."""
    absolute = path.startswith("/")

    def walk(done: Column, step: Column) -> Column:
        back = step == ".."
        inside = (F.size(done) > 0) & ~F.coalesce(F.try_element_at(done, F.lit(-1)) == "..", F.lit(False))
        return F.when(back & inside, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(back & absolute, done).otherwise(F.concat(done, F.array(step)))

    steps = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/"))


def comparable(path: Column, root: Column) -> Column:
    """Root-relative path; the file name for absolute paths outside the root and for relative ones that leave it."""
    norm = folded(path)
    outside = F.when(path.startswith("/"), ~in_folder(norm, root)).otherwise(norm.startswith("../") | (norm == ".."))
    return F.when(outside, basename(norm)).otherwise(F.when(path.startswith("/"), relative(norm, root)).otherwise(norm))


def in_module(module: Column, of: Column) -> Column:
    """Whether a module is another or lies below it; a prefix of text, so no sign is a wildcard."""
    return (module == of) | module.startswith(F.concat(of, F.lit(".")))


def glob_matches(path: Column, glob: Column) -> Column:
    """B13 for patterns in a column: * also crosses slashes."""
    safe = F.regexp_replace(glob, r"([\\.^$|(){}+])", r"\\$1")
    return F.regexp_like(path, F.concat(F.lit("(?s)^"), F.replace(F.replace(F.replace(safe, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("[!"), F.lit("[^")), F.lit("$")))


def ignore_names(line: Column) -> Column:
    """The folder name that a line of an ignore file excludes, null for comments, negations, globs and nested paths."""
    text = F.btrim(line)
    name = F.regexp_replace(text, "^/+|/+$", "")
    bad = (text == "") | text.startswith("#") | text.startswith("!") | name.rlike(r"[*?\[]|/") | (name == "")
    return F.when(~bad, name)
