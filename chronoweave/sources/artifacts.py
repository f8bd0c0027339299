"""Test reports and coverage as DataFrames: JUnit, Cobertura, lcov, coverage contexts, metrics in OTLP/JSON."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from contextlib import suppress
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.console import error_signature, stack_names
from chronoweave.functions.idents import basename
from chronoweave.operators.intervals import within


def xml_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, xml) of report files, read by Spark, so any store that Spark knows will do."""
    rows = spark.read.format("binaryFile").load(paths)
    return rows.select("path", F.decode("content", "UTF-8").alias("xml"))


def _blocks(xml: Column, tag: str) -> Column:
    """The elements of this name as texts; they must not nest in themselves."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?:/>|>.*?</{tag}\s*>)"), F.lit(0))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S = T.StringType()
_NOTE = T.ArrayType(_struct(_message=_S, _VALUE=_S, __here=_S))
_CASE = _struct(_classname=_S, _name=_S, _file=_S, failure=_NOTE, error=_NOTE, skipped=_NOTE)


def junit_cases(reports: DataFrame, xml: str = "xml") -> DataFrame:
    """One row for each test case, however suites nest: classname, name, file, status, failure_text.

    failed before error before skipped before passed; the failure's text, or else its message. Texts that hold no test
    case give no row. Each case is parsed once. Other columns stay.
    """
    keep = [x for x in reports.columns if x != xml]
    rows = reports.withColumn("_text", F.explode(_blocks(F.col(xml), "testcase"))).drop(xml)
    # an empty element has neither value nor attribute: a mark makes it one
    marked = F.regexp_replace("_text", r"<(failure|error|skipped)(?=[\s/>])", '<$1 _here="1"')
    rows = rows.withColumn("_c", F.from_xml(marked, _CASE, {"ignoreSurroundingSpaces": "true"}))
    has = lambda tag: F.size(F.coalesce(F.col(f"_c.{tag}"), F.array())) > 0
    status = F.when(has("failure"), "failed").when(has("error"), "error").when(has("skipped"), "skipped").otherwise("passed")
    body = lambda tag: F.coalesce(F.nullif(F.btrim(F.get(F.col(f"_c.{tag}"), F.lit(0))["_VALUE"]), F.lit("")), F.nullif(F.get(F.col(f"_c.{tag}"), F.lit(0))["_message"], F.lit("")))
    text = F.when(has("failure"), body("failure")).when(has("error"), body("error"))
    return rows.select(*keep, *[F.coalesce(f"_c._{x}", F.lit("")).alias(x) for x in ("classname", "name")], F.nullif(F.col("_c._file"), F.lit("")).alias("file"), status.alias("status"), text.alias("failure_text"))


def case_files(cases: DataFrame, files: DataFrame) -> DataFrame:
    """file_path of each case: its own, or the Python file of that module if the listing (rel_path) has it."""
    guess = F.concat(F.regexp_replace("classname", r"\.", "/"), F.lit(".py"))
    known = files.select(F.col("rel_path").alias("_guess")).distinct().withColumn("_known", F.col("_guess"))
    return cases.withColumn("_guess", guess).join(known, "_guess", "left").withColumn("file_path", F.coalesce("file", "_known")).drop("_guess", "_known")


_BLOCK = r"(?s)<{0}(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?:/>|>.*?</{0}\s*>)"
_TESTCASE, _PACKAGE = (re.compile(_BLOCK.format(tag)) for tag in ("testcase", "package"))


def _covers(roots: list[ElementTree.Element]) -> list[tuple[str, str]]:
    """What the elements of one report say is covered, each pair once."""
    cases = [case for root in roots for case in root.iter("testcase")]
    out = []
    for case in cases:
        name = f"{case.get('classname', '')}::{case.get('name', '')}"
        for cls in case.findall("covered_class"):
            if of := cls.get("name"):
                methods = cls.findall("method")
                out += [(name, f"{of}.{m}") for x in methods if (m := x.get("name"))] if methods else [(name, of)]
    for package in () if cases else (p for root in roots for p in root.iter("package")):
        for cls in package.iter("class"):
            full = f"{package.get('name', '')}.{cls.get('name', '')}".strip(".")
            out.append((f"coverage::{full}", full))
            out += [(f"coverage::{full}", f"{full}.{m}") for x in cls.iter("method") if (m := x.get("name"))]
    return list(dict.fromkeys(out))


def _cobertura(xml: str | None) -> list[tuple[str, str]]:
    """A report is parsed once; of one that is broken the whole elements count."""
    try:
        return _covers([ElementTree.fromstring(xml)]) if xml else []
    except (ElementTree.ParseError, UnicodeEncodeError):
        roots = []
        for block in _TESTCASE.findall(xml) or _PACKAGE.findall(xml):
            with suppress(ElementTree.ParseError, UnicodeEncodeError):
                roots.append(ElementTree.fromstring(block))
        return _covers(roots)


def _all_covers(texts: pa.Array) -> pa.Array:
    ends, cases, defines = [0], [], []
    for text in texts:
        for case, define in _cobertura(text.as_py()):
            cases.append(case)
            defines.append(define)
        ends.append(len(cases))
    pairs = pa.StructArray.from_arrays([pa.array(cases, pa.string()), pa.array(defines, pa.string())], names=["test_case", "define_name"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def cobertura_entries(reports: DataFrame, xml: str = "xml") -> DataFrame:
    """(test_case, define_name). Embedded test cases name what they cover; else each class and method of a package is
    covered by the case coverage::package.class. Hits are not looked at. Each report gives a pair once. Other columns stay."""
    keep = [c for c in reports.columns if c != xml]
    read = F.arrow_udf(_all_covers, "array<struct<test_case: string, define_name: string>>")
    return reports.select(*keep, F.explode(read(F.col(xml))).alias("_e")).select(*keep, "_e.test_case", "_e.define_name")


def lcov_lines(reports: DataFrame, text: str = "text", by: str = "path") -> DataFrame:
    """(by, test_name, source_file, line) of covered lines; a test name holds until the next, lcov if it is empty."""
    rows = reports.select(by, F.posexplode(F.split(text, r"\r?\n")).alias("_i", "_l")).withColumn("_l", F.btrim("_l"))
    order = Window.partitionBy(by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda tag: F.col("_l").startswith(tag)
    name = F.when(is_("TN:"), F.coalesce(F.nullif(F.btrim(F.substring("_l", 4, 10_000)), F.lit("")), F.lit("lcov")))
    rows = rows.withColumn("test_name", F.coalesce(F.last(name, True).over(order), F.lit("")))
    rows = rows.withColumn("_file", F.last(F.when(is_("SF:"), F.btrim(F.substring("_l", 4, 10_000))).when(F.col("_l") == "end_of_record", ""), True).over(order))
    # a record counts only if it ends
    ahead = Window.partitionBy(by).orderBy("_i").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_next", F.first(F.when((F.col("_l") == "end_of_record") | is_("SF:"), F.col("_l")), True).over(ahead))
    parts = F.split(F.substring("_l", 4, 10_000), ",")
    hit = rows.where(is_("DA:") & (F.size(parts) >= 2) & (F.get(parts, F.lit(1)) != "0") & F.get(parts, F.lit(0)).rlike(r"^\d+$") & (F.col("_file") != "") & (F.col("_next") == "end_of_record"))
    return hit.select(by, "test_name", F.col("_file").alias("source_file"), F.get(parts, F.lit(0)).cast("long").alias("line")).distinct()


def headers(sources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, define) of lines that begin a function or class, from 1."""
    rows = sources.select(path, F.posexplode(F.split(text, "\n")).alias("_i", "_l"))
    define = F.regexp_extract("_l", r"^\s*(?:def|class|async def)\s+(\w+)", 1)
    return rows.where(define != "").select(path, (F.col("_i") + 1).cast("long").alias("line"), define.alias("define"))


def lcov_entries(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """(test_case, define_name): each covered line belongs to the nearest header at or above it."""
    h = heads.select(F.col("path").alias("source_file"), "line", "define")
    both = h.unionByName(lines.select("source_file", "line", "test_name"), allowMissingColumns=True)
    order = Window.partitionBy("source_file").orderBy("line", F.col("define").isNull())
    found = both.withColumn("define_name", F.last("define", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    case = F.concat_ws("::", "test_name", basename(F.col("source_file")))
    return found.where("define is null and define_name is not null").select(case.alias("test_case"), "define_name").distinct()


def coverage_contexts(files: DataFrame) -> DataFrame:
    """A10: (path, file, line, context) of coverage databases given as (path, content), one row for each context of a line.

    The line numbers are bits of a blob. Python reads each database in memory through SQLite.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(content))
                sql = "SELECT f.path, c.context, l.numbits FROM line_bits l JOIN file f ON f.id = l.file_id JOIN context c ON c.id = l.context_id"
                for file, context, bits in con.execute(sql):
                    if context:
                        rows += [(path, file, 8 * i + b, context) for i, byte in enumerate(bits) for b in range(8) if byte >> b & 1]
                con.close()
            yield pd.DataFrame(rows, columns=["path", "file", "line", "context"])

    return files.select("path", "content").mapInPandas(run, "path string, file string, line long, context string")


def context_case(context: Column) -> Column:
    """2.O: classname::name of a dynamic context such as tests/test_a.py::TestB::test_c|run."""
    plain = F.regexp_replace(context, r"\|(run|setup|teardown)$", "")
    parts = F.split(plain, "::")
    module = F.regexp_replace(F.regexp_replace(F.element_at(parts, 1), r"\.py$", ""), "/", ".")
    owner = F.array_join(F.concat(F.array(module), F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))), ".")
    return F.when(F.size(parts) >= 2, F.concat_ws("::", owner, F.element_at(parts, -1)))


def context_entries(contexts: DataFrame, defines: DataFrame, cases: DataFrame) -> DataFrame:
    """(test_case, define_name) of known cases whose covered lines lie in a define (file, define_name,
    start_line, end_line): an interval join by file."""
    lines = contexts.select("file", "line", context_case(F.col("context")).alias("test_case")).where("test_case is not null").distinct()
    lines = lines.join(cases.select("test_case").distinct(), "test_case", "left_semi")
    return within(lines, defines, ["file"], "line", "start_line", "end_line", width=64, open_low=False).select("test_case", "define_name").distinct()


def coverage_entries(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """(test_case, define_name) of coverage reports (path, text) of either format, told apart by their names.

    sources: (path, text) of the files that lcov reports name.
    """
    is_lcov = F.col("path").endswith(".info") | F.lower(basename(F.col("path"))).contains("lcov")
    lines = lcov_lines(reports.where(is_lcov).select("path", "text"))
    xml = cobertura_entries(reports.where(~is_lcov).select("path", F.col("text").alias("xml")))
    return lcov_entries(lines, headers(sources)).unionByName(xml.select("test_case", "define_name")).distinct()


def crash_stacks(logs: DataFrame, root: str) -> DataFrame:
    """(path, mtime, stack_fqns, error_signature) of crash logs (path, mtime, text), without those that hold
    neither a frame of the project nor an error."""
    rows = logs.select("path", "mtime", stack_names(F.col("text"), F.lit(root)).alias("stack_fqns"), error_signature(F.col("text")).alias("error_signature"))
    return rows.where("size(stack_fqns) > 0 or error_signature is not null")


_VALUE = T.StructType([T.StructField("stringValue", T.StringType()), T.StructField("intValue", T.StringType()), T.StructField("doubleValue", T.DoubleType())])
_ATTRIBUTES = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", _VALUE)]))
_POINTS = T.StructType([T.StructField("dataPoints", T.ArrayType(T.StructType([T.StructField("attributes", _ATTRIBUTES), T.StructField("asDouble", T.DoubleType()), T.StructField("asInt", T.StringType())])))])
_METRIC = T.StructType([T.StructField("name", T.StringType()), T.StructField("sum", _POINTS), T.StructField("gauge", _POINTS)])
_RESOURCE = T.StructType([
    T.StructField("resource", T.StructType([T.StructField("attributes", _ATTRIBUTES)])),
    T.StructField("scopeMetrics", T.ArrayType(T.StructType([T.StructField("metrics", T.ArrayType(_METRIC))]))),
])
OTLP = T.StructType([T.StructField("resourceMetrics", T.ArrayType(_RESOURCE))])


def _attribute(list_: Column, key: str) -> Column:
    hit = F.filter(F.coalesce(list_, F.array()), lambda a: a["key"] == key)
    value = F.element_at(hit, -1)["value"]
    return F.when(F.size(hit) > 0, F.coalesce(value["stringValue"], value["intValue"], value["doubleValue"].cast("string")))


def otlp_samples(bodies: DataFrame, body: str = "body", id: str = "id") -> DataFrame:
    """A row for each message, session and model: cost and tokens by type, where any of them is positive.

    The session is the data point's or the resource's; points without one are left out, as are other metrics than
    `….cost.usage` and `….token.usage`. Malformed messages give no row.
    """
    rows = bodies.select(id, F.from_json(body, OTLP).alias("b")).select(id, F.explode("b.resourceMetrics").alias("r"))
    rows = rows.select(id, "r.resource.attributes", F.explode("r.scopeMetrics").alias("s")).select(id, F.col("attributes").alias("ra"), F.explode("s.metrics").alias("m"))
    points = F.when(F.size(F.coalesce("m.sum.dataPoints", F.array())) > 0, F.col("m.sum.dataPoints")).otherwise(F.col("m.gauge.dataPoints"))
    rows = rows.select(id, "ra", F.col("m.name").alias("metric"), F.explode(points).alias("p")).where(F.col("metric").rlike(r"\.(cost|token)\.usage$"))
    session = F.coalesce(F.nullif(_attribute(F.col("p.attributes"), "session.id"), F.lit("")), F.nullif(_attribute(F.col("ra"), "session.id"), F.lit("")))
    value = F.coalesce(F.nullif(F.col("p.asDouble"), F.lit(0.0)), F.col("p.asInt").try_cast("double"), F.lit(0.0))
    rows = rows.select(id, session.alias("session_id"), F.coalesce(_attribute(F.col("p.attributes"), "model"), F.lit("")).alias("model"), "metric", _attribute(F.col("p.attributes"), "type").alias("type"), value.alias("value")).where("session_id is not null")
    is_token = F.col("metric").endswith(".token.usage")
    tokens = lambda t: F.sum(F.when(is_token & (F.col("type") == t), F.col("value").cast("long")).otherwise(0)).alias({"input": "input_tokens", "output": "output_tokens", "cacheRead": "cache_read_tokens", "cacheCreation": "cache_creation_tokens"}[t])
    out = rows.groupBy(id, "session_id", "model").agg(F.sum(F.when(~is_token, F.col("value")).otherwise(0.0)).alias("cost_usd"), *[tokens(t) for t in ("input", "output", "cacheRead", "cacheCreation")])
    return out.where("cost_usd > 0 or input_tokens > 0 or output_tokens > 0")
