"""Parsers, path rules and code extraction on small inputs."""

import sqlite3
import subprocess

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import console as X
from chronoweave.functions import idents as N
from chronoweave.operators.call_resolution import resolve_calls, with_return_types
from chronoweave.sources import artifacts as A
from chronoweave.sources import code as K
from chronoweave.sources import files as S
from chronoweave.sources import js_source as J
from chronoweave.sources import python_source as P


def each(spark, values, column):
    """The column's value for each text."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_path_rules(spark):
    paths = ["src/a.py", "tests/a.py", "a/test_b.py", "a/b_test.py", "conftest.py", "a/b.spec.tsx", "vitest.config.ts", "scripts/test-x.ts", "a/e2e/x.js", "testing/a.py"]
    assert each(spark, paths, N.is_test_file) == [False, True, True, True, True, True, False, False, True, False]
    assert each(spark, ["a.py", "x/page.tsx", "test_a/b.py", "d/test_a.js", "x/migrations/1.py", "legal/en.tsx", "a.spec.ts", "a_pb2.py"], N.out_of_detection) == [False, True, False, True, True, True, False, True]
    assert each(spark, ["a/node_modules/b.js", "src/build/x.py", "src/builder/x.py"], N.should_ingest) == [False, False, True]
    mods = ["/r/pkg/a.py", "/r/pkg/__init__.py", "/r/__init__.py", "/r/src/x.tsx", "/r/a.b.js"]
    assert each(spark, mods, lambda c: N.module_name(c, F.lit("/r"))) == ["pkg.a", "pkg", "", "src/x", "a.b"]
    assert each(spark, ["/r/a.py"], lambda c: N.qualified(c, F.lit("/r"), F.lit("K.m"))) == ["py::a.K.m"]
    assert each(spark, ["build/", "/dist", "# x", "!keep", "*.log", "a/b", "", " logs "], N.ignore_names) == ["build", "dist", None, None, None, None, None, "logs"]
    assert each(spark, ["/r/a/b.py", "/x/y.py", "./a//b.py", "a/../b.py", "../z.py"], lambda c: N.comparable(c, F.lit("/r"))) == ["a/b.py", "y.py", "a/b.py", "b.py", "z.py"]
    assert each(spark, ["src/x/y.py", "a1", "ab", "a-"], lambda c: N.matches_any(c, ["src/*.py", "a[0-9]", "a[!0-9b]"])) == [True, True, False, True]


def test_commands(spark):
    commands = ["git commit", "git -C /p commit -m x", "git log commit", "git reset --soft", "git reset --hard", "git checkout -- f", "git checkout -b n", "git checkout", "git switch -c n", "git stash", "git stash pop", "git", "gitk commit", "git pull"]
    assert each(spark, commands, X.git_kind) == ["commit", "commit", None, None, "rollback", "rollback", "branch_switch", None, "branch_switch", None, "rollback", None, None, "rollback"]
    assert each(spark, ["pytest -q", "npm  run test", "ls", "go test ./...", "contest"], X.is_test_command) == [True, True, False, True, False]
    assert len(set(each(spark, ["a  B", " A b "], X.command_fingerprint))) == 1


SUMMARIES = [
    ("pytest", "=== 3 passed, 1 failed, 2 skipped in 1s ===", ("pytest", 3, 1, 2)),
    ("pytest", "=== 1 error in 1s ===", ("pytest", 0, 1, 0)),
    ("pytest", "=== no tests ran ===", None),
    ("npx jest", "Tests: 1 failed, 2 passed, 3 total", ("jest", 2, 1, 0)),
    ("go test ./...", "ok  a 1s\nok  b 1s\nFAIL c", ("go_test", 2, 1, 0)),
    ("cargo test", "test result: ok. 2 passed; 0 failed; 1 ignored;\ntest result: ok. 1 passed; 1 failed; 0 ignored;", ("cargo", 3, 1, 1)),
    ("npm test", "  4 passing (1s)\n  1 failing\n  2 pending", ("mocha", 4, 1, 2)),
    ("make", "=== 5 passed ===", ("pytest", 5, 0, 0)),
    ("make", "nothing", None),
]


def test_summaries(spark):
    df = spark.createDataFrame([(i, c, o) for i, (c, o, _) in enumerate(SUMMARIES)], "i int, c string, o string")
    rows = df.select("i", X.test_summary(F.col("c"), F.col("o")).alias("r")).orderBy("i").collect()
    assert [r.r and tuple(r.r) for r in rows] == [want for *_, want in SUMMARIES]


def test_case_lines(spark):
    out = "tests/test_a.py::test_x[p-1] PASSED [ 10%]\n./tests/b.py::TestC::test_y FAILED\nnoise\ntests/c.py::t XFAIL"
    assert [tuple(c) for c in each(spark, [out], X.test_cases)[0]] == [("tests.test_a", "test_x[p-1]", "tests/test_a.py", "passed"), ("tests.b.TestC", "test_y", "./tests/b.py", "failed"), ("tests.c", "t", "tests/c.py", "skipped")]


def test_frames(spark):
    out = (
        '  File "/r/src/a.py", line 3, in load\n  File "/usr/lib/python3.11/json.py", line 1, in loads\n  File "/r/src/a.py", line 9, in load\n  File "/r/src/a.py", line 2, in <module>\n'
        "    at getPool (/r/lib/db.ts:34:7)\n    at Object.<anonymous> (/r/lib/db.ts:1:1)\n    at x (/r/node_modules/y.js:1:1)\n    at q (/r/scripts/z.ts:1:1)\n ❯ run lib/w.ts:3:4\n"
    )
    frames = each(spark, [out], lambda c: X.stack_frames(c, F.lit("/r")))[0]
    assert [tuple(f) for f in frames] == [("getPool", "lib/db.ts", 34), ("run", "lib/w.ts", 3), ("load", "src/a.py", 3)]
    assert each(spark, [out], lambda c: X.stack_names(c, F.lit("/r")))[0] == ["js_ts::lib/db.getPool", "js_ts::lib/w.run", "py::src.a.load"]


def test_signatures(spark):
    texts = ["AssertionError: expected 2 to equal 1", "x\n  TypeError: Cannot read property 'a' of null", "Error: gone \"x\" 17", "SyntaxError", "MyError: to equal", "AssertionError: expected [] to deeply equal {}"]
    assert each(spark, texts, X.error_signature) == ["AssertionError|to_equal", "TypeError|cannot_read_property", "Error|gone", "SyntaxError|unknown", None, "AssertionError|to_deeply_equal"]


def test_names_from_cases(spark):
    df = spark.createDataFrame([(0, "tests.TestToken", "test_expiry"), (1, "a/b.test.ts", "clamp > keeps"), (2, "", "testFoo")], "i int, c string, n string")
    got = [r.x for r in df.select("i", X.likely_defines(F.col("c"), F.col("n")).alias("x")).orderBy("i").collect()]
    assert got == [["expiry", "Token", "Token.expiry"], ["clamp", "b"], ["Foo", "foo"]]


def test_junit(spark):
    xml = """<?xml version="1.0"?><testsuites><testsuite><testcase classname="a.B" name="x" file="f.py"/><testsuite><testcase name='y > "q"'><failure message="m"/></testcase></testsuite>
    <testcase classname="c" name="z"><error>boom</error></testcase><testcase classname="c" name="s"><skipped/></testcase></testsuite></testsuites>"""
    df = spark.createDataFrame([(1, xml), (2, "<broken"), (3, "<testsuite/>")], "i int, xml string")
    got = {r.name: (r.classname, r.file, r.status, r.failure_text) for r in A.junit_cases(df).collect()}
    assert got == {"x": ("a.B", "f.py", "passed", None), 'y > "q"': ("", None, "failed", "m"), "z": ("c", None, "error", "boom"), "s": ("c", None, "skipped", None)}
    files = spark.createDataFrame([("c.py",)], "rel_path string")
    assert {r.name: r.file_path for r in A.case_files(A.junit_cases(df), files).collect()}["z"] == "c.py"


def test_cobertura(spark):
    plain = '<coverage><packages><package name="p"><classes><class name="K"><methods><method name="m"/></methods></class></classes></package></packages></coverage>'
    inner = '<coverage><testcase classname="c" name="n"><covered_class name="K"><method name="m"/></covered_class><covered_class name="L"/></testcase></coverage>'
    df = spark.createDataFrame([(1, plain), (2, inner)], "i int, xml string")
    assert sorted(tuple(r) for r in A.cobertura_entries(df).collect()) == [(1, "coverage::p.K", "p.K"), (1, "coverage::p.K", "p.K.m"), (2, "c::n", "K.m"), (2, "c::n", "L")]


def test_cobertura_parses_once(spark):
    """One parse for each report: comments say nothing, repeated pairs come once, and of a broken report whole elements count."""
    case = '<testcase classname="c" name="a&amp;b"><covered_class name="K"/><covered_class name="K"/><covered_class/></testcase>'
    hidden = f'<coverage><!-- {case} --><package name="p"><class name="K"><method name="m"/></class><class/></package></coverage>'
    texts = [f"<coverage>{case}{case}</coverage>", hidden, f"<coverage>{case}<testcase", '<coverage><package name="q"><class name="L"/></package><package', "", None]
    got = A.cobertura_entries(spark.createDataFrame(list(enumerate(texts)), "i int, xml string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "xpath" not in plan and "regexp_extract" not in plan
    want = [(0, "c::a&b", "K"), (1, "coverage::p", "p"), (1, "coverage::p.K", "p.K"), (1, "coverage::p.K", "p.K.m"), (2, "c::a&b", "K"), (3, "coverage::q.L", "q.L")]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_lcov(spark):
    text = "TN:t\nSF:a.py\nDA:2,1\nDA:3,0\nDA:6,4\nDA:x,1\nend_of_record\nSF:b.py\nDA:1,1\nTN:\nSF:a.py\nDA:5,1\nend_of_record"
    lines = A.lcov_lines(spark.createDataFrame([("r", text)], "path string, text string"))
    assert sorted((r.test_name, r.source_file, r.line) for r in lines.collect()) == [("lcov", "a.py", 5), ("t", "a.py", 2), ("t", "a.py", 6)]
    heads = A.headers(spark.createDataFrame([("a.py", "def f():\n  x\n\n  y\nclass K:\n  z")], "path string, text string"))
    assert sorted(tuple(r) for r in A.lcov_entries(lines, heads).collect()) == [("lcov::a.py", "K"), ("t::a.py", "K"), ("t::a.py", "f")]


def test_coverage_contexts(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "cov")
    con.executescript("CREATE TABLE file (id INTEGER, path TEXT); CREATE TABLE context (id INTEGER, context TEXT); CREATE TABLE line_bits (file_id INTEGER, context_id INTEGER, numbits BLOB)")
    con.execute("INSERT INTO file VALUES (1, 'src/a.py')")
    con.executemany("INSERT INTO context VALUES (?, ?)", [(1, ""), (2, "tests/test_a.py::TestB::test_c|run"), (3, "tests/test_a.py::other|run")])
    con.executemany("INSERT INTO line_bits VALUES (1, ?, ?)", [(1, bytes([255])), (2, bytes([0b100, 0b10])), (3, bytes([0b1000]))])
    con.commit()
    con.close()
    files = spark.read.format("binaryFile").load(str(tmp_path / "cov"))
    contexts = A.coverage_contexts(files)
    assert sorted((r.line, r.context.split("::")[-1]) for r in contexts.collect()) == [(2, "test_c|run"), (3, "other|run"), (9, "test_c|run")]
    defines = spark.createDataFrame([("src/a.py", "f", 1, 4), ("src/a.py", "g", 8, 9)], "file string, define_name string, start_line long, end_line long")
    cases = spark.createDataFrame([("tests.test_a.TestB::test_c",)], "test_case string")
    assert sorted(r.define_name for r in A.context_entries(contexts, defines, cases).collect()) == ["f", "g"]


def test_otlp(spark):
    body = """{"resourceMetrics": [{"resource": {"attributes": [{"key": "session.id", "value": {"stringValue": "s"}}]}, "scopeMetrics": [{"metrics": [
      {"name": "x.cost.usage", "sum": {"dataPoints": [{"attributes": [{"key": "model", "value": {"stringValue": "m"}}], "asDouble": 0.5}]}},
      {"name": "x.token.usage", "sum": {"dataPoints": [{"attributes": [{"key": "model", "value": {"stringValue": "m"}}, {"key": "type", "value": {"stringValue": "input"}}], "asInt": "7"},
        {"attributes": [{"key": "type", "value": {"stringValue": "cacheRead"}}], "asInt": "9"}]}}, {"name": "other", "sum": {"dataPoints": [{"asInt": "1"}]}}]}]}]}"""
    rows = A.otlp_samples(spark.createDataFrame([(1, body), (2, "broken"), (3, "{}")], "id long, body string")).collect()
    assert [tuple(r) for r in rows] == [(1, "s", "m", 0.5, 7, 0, 0, 0)]  # the sample of no model has cache reads alone


def test_listings(spark, tmp_path):
    listing = spark.createDataFrame([("a/same", 1.0), ("a/newer", 5.0), ("a/null", 1.0), ("b/fresh", 1.0), ("a/fresh", 1.0)], "path string, mtime double")
    known = spark.createDataFrame([("a/same", 1.0), ("a/newer", 2.0), ("a/null", None), ("a/gone", 1.0)], "path string, mtime double")
    got = {r.path: r.change for r in S.disk_changes(listing, known).collect()}
    assert got == {"a/newer": "touched", "a/null": "touched", "a/gone": "missing", "b/fresh": "new", "a/fresh": "new"}
    folders = spark.createDataFrame([("a",)], "dir string")
    assert "b/fresh" not in {r.path for r in S.disk_changes(listing, known, folders).collect()}


def test_source_tree_and_git(spark, tmp_path):
    root = tmp_path / "r"
    for rel in ("a.py", "src/b.ts", "node_modules/c.js", "logs/d.py", "sub/e.py", "tests/f.py", "g.txt"):
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text("x = 1\n")
    for repo in (root, root / "sub"):
        subprocess.run(["git", "init", "-q", "-b", "main", str(repo)], check=True)
    rows = S.source_tree(spark, str(root), ignored=("logs",), tests=False).collect()
    assert sorted(r.rel_path for r in rows) == ["a.py", "src/b.ts"]
    subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x.y", "commit", "-q", "--allow-empty", "-m", "m"], check=True)
    state = S.git_state(spark, str(root)).first()
    assert state.branch == "main" and len(state.head) == 40 and state.parent is None
    assert tuple(S.git_state(spark, str(tmp_path)).first()) == (None, None, None)


CODE = '''
import os, json as js
from .util import helper as h, Pool
from typing import overload, Optional

def top(a, b=1, *args, c, d=2, **kw) -> Optional[Pool]:
    # a comment
    x = Pool(3)
    x.get(); h(a); js.dumps(b)
    self_like = a[0] = 1.5
    return None if not a else -b

if os.name:
    def top2():
        yield 1
        def hidden():
            return other()

class K:
    pool: Pool

    def __init__(self, n: "int"):
        self.other = Pool()
        self.n = n

    @overload
    def get(self, a: int): ...

    async def get(self, a):
        import sys
        await self.pool.get()
        self.run()
        return

    @staticmethod
    def run(z):
        global G
        raise ValueError
'''


def test_python_defines(spark):
    files = spark.createDataFrame([("pkg/a.py", CODE), ("pkg/bad.py", "def (:"), ("pkg/none.py", None)], "path string, text string")
    rows = {r.qualified_name: r for r in P.defines(files).collect()}
    assert set(rows) == {"top", "top2", "K.__init__", "K.get", "K.run"}
    top = rows["top"]
    assert tuple(top.params) == (1, 1, True, True, 2) and top.returns_kind == "value" and top.return_type == "Pool"
    assert top.calls == ["Pool", "x.get", "h", "js.dumps"] and top.numerics == ["3", "0", "1.5"] and top.operators == ["Not", "USub"]
    assert top.bindings == {"x": "Pool"} and top.effects == []
    assert rows["top2"].effects == ["generator"] and rows["top2"].calls == []
    assert rows["K.get"].effects == ["async"] and rows["K.get"].imports == ["sys"] and rows["K.get"].returns_kind == "bare"
    assert rows["K.get"].bindings == {"self.pool": "Pool", "self.other": "Pool", "self.n": "int"}
    assert tuple(rows["K.run"].params) == (1, 0, False, False, 0) and rows["K.run"].effects == ["global_write", "raises"]
    found = {(r.name, r.target) for r in P.imports(files).collect()}
    assert found == {("os", "os"), ("js", "json"), ("h", "pkg.util.helper"), ("Pool", "pkg.util.Pool"), ("overload", "typing.overload"), ("Optional", "typing.Optional")}
    assert {r.path: r.ok for r in P.parse_state(files).collect()} == {"pkg/a.py": True, "pkg/bad.py": False, "pkg/none.py": True}


@pytest.mark.parametrize("change, same_hash, same_coarse, same_fine", [("return a + 1", True, True, True), ("return a + 1  # why", True, True, True), ("return a - 1", False, True, False), ("return a + 2", False, False, False), ("return self.p.f(a) + 1", False, False, False)])
def test_fingerprints(spark, change, same_hash, same_coarse, same_fine):
    text = "def f(a):\n    {}\n"
    files = spark.createDataFrame([("x.py", text.format("return a + 1")), ("y.py", text.format(change))], "path string, text string")
    a, b = P.fingerprints(P.defines(files)).orderBy("path").collect()
    assert (a.content_hash == b.content_hash, a.node_fingerprint == b.node_fingerprint, a.fine_fingerprint == b.fine_fingerprint) == (same_hash, same_coarse, same_fine)


def test_reexports_and_assertions(spark):
    files = spark.createDataFrame([("p/__init__.py", "from .m import f, g as k\nfrom .n import *\n"), ("t.py", "def test_a():\n    run()\ndef test_b():\n    assert 1\ndef test_c():\n    with pytest.raises(E): x()\n")], "path string, text string")
    assert sorted(tuple(r) for r in P.reexports(files).collect()) == [("p", "*", "p.n", "*"), ("p", "f", "p.m", "f"), ("p", "k", "p.m", "g")]
    assert [r.qualified_name for r in P.assertion_free(P.defines(files)).collect()] == ["test_a"]


def test_call_resolution(spark):
    sources = {
        "app/main.py": "from lib import Store, make, gone\nimport lib.core as core\nfrom other import thing\n\nclass A:\n    def go(self):\n        self.stay()\n        self.missing()\n        self.store.put()\n    def stay(self):\n        s = Store()\n        s.put()\n        t = make()\n        t.put()\n        core.low()\n        gone()\n        thing()\n        unique_name()\n        twice()\n    store: Store\n",
        "lib/__init__.py": "from .core import Store, make\nfrom .more import *\n",
        "lib/core.py": "class Store:\n    def put(self): pass\ndef make() -> Store: return Store()\ndef low(): low()\ndef twice(): pass\n",
        "lib/more.py": "def unique_name(): pass\ndef twice(): pass\n",
    }
    files = spark.createDataFrame(list(sources.items()), "path string, text string")
    rows = P.defines(files).withColumn("lang", F.lit("py")).withColumn("module", N.module_name(F.concat(F.lit("/"), "path"), F.lit("")))
    found = P.imports(files)
    edges = {(r.caller, r.callee) for r in resolve_calls(with_return_types(rows, found), found, P.reexports(files)).collect()}
    me = "py::app.main.A."
    assert (me + "go", me + "stay") in edges
    assert not any("missing" in c or "gone" in c or "thing" in c or "twice" in c for _, c in edges)
    assert {(me + "stay", "py::lib.core.low"), (me + "stay", "py::lib.more.unique_name"), ("py::lib.core.low", "py::lib.core.low")} <= edges


SCRIPT = """
import def, { a as b, type T, c } from './util';
import * as ns from '../lib/db.ts';
import type { X } from './types';
const fs = require("./fs");
// a comment with { brace
export function plain(x, y = 2, ...rest): Promise<Map<string, {a: number}>> {
  if (x > 1 && y) { return ns.run(x); }
  const f = () => { hidden(); };
  throw new Error(`bad ${x} }`);
}
export function typed(): { a: number } { return load(); }
export const arrow = async (a: Store, { b, c }) => a.get(b) + 3;
export const hook = useCallback(debounce((e) => { send(e); }), []);
const one = x => x * 2
let value = /re{g/.test(s) ? 1 : 2;
export const api = { get(a) { return 1; }, post: async (b) => { save(b) }, n: 3, 'put': function () { } };
export const CONFIG = wrap({ handler: () => {} });
export default class { run() { this.go(); } }
class K extends Base<T> {
  static count = 0;
  #p = new Pool();
  get size() { return this.#p.size; }
  set size(v) { this._s = v; }
  handler = (e) => { this.run(e); };
  constructor(private readonly store: Store) { super(); this.cache = new Cache(); }
  async load<T>(id: string): Promise<T> { const r = await this.store.get(id); return r; }
  abstract nope(): void;
}
namespace N.M { export function inner() { return; } }
module.exports = { one2: () => 1, two2() {} };
exports.three = function () {};
K.prototype.four = function (a) { a[0] = 1; };
(function () { function iife() { x(); } })();
if (cond) { function inIf() {} } else { const inElse = () => {}; }
"""


def test_scripts(spark):
    files = spark.createDataFrame([("src/a/x.ts", SCRIPT), ("bad.ts", "function f() {"), ("none.js", None)], "path string, text string")
    rows = {r.qualified_name: r for r in J.defines(files).collect()}
    assert set(rows) == {"plain", "typed", "arrow", "hook", "one", "api.get", "api.post", "api.put", "<default>.run", "K.get size", "K.set size", "K.handler", "K.constructor", "K.load", "N.M.inner", "one2", "two2", "three", "K.four", "iife", "inIf", "inElse"}
    plain = rows["plain"]
    assert tuple(plain.params) == (1, 1, True, False, 0) and plain.calls == ["ns.run", "Error"] and plain.operators == ["&&", ">"] and plain.effects == ["raises"]
    assert (plain.start_line, plain.end_line, plain.returns_kind) == (7, 11, "value")
    assert rows["arrow"].bindings == {"a": "Store"} and rows["arrow"].effects == ["async"] and rows["arrow"].calls == ["a.get"]
    assert rows["K.constructor"].bindings == {"store": "Store", "this.cache": "Cache"} and rows["K.load"].calls == ["this.store.get"]
    assert rows["N.M.inner"].returns_kind == "bare" and rows["K.four"].effects == ["subscript_write"]


def test_script_imports():
    assert J.file_imports("src/a/x.ts", SCRIPT) == [("b", "src/a/util.a"), ("c", "src/a/util.c"), ("def", "src/a/util"), ("ns", "src/lib/db"), ("fs", "src/a/fs")]
    out = J.file_reexports("src/index.ts", "export { a, b as c, default as D } from './x';\nexport * from './y'\nexport * as ns from './z'; export type { T } from './t'")
    assert out == [("src/index", "a", "src/x", "a"), ("src/index", "c", "src/x", "b"), ("src/index", "D", "src/x", "<default>"), ("src/index", "*", "src/y", "*"), ("src/index", "ns", "src/z", "")]
    aliases = J.aliases_of('{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"], "~/*": ["*"],}} }')
    assert aliases == {"@/": "src", "~/": ""} and J.aliases_of("broken") == {}
    assert J.resolved("@/lib/utils", "a/b.ts", aliases) == "src/lib/utils" and J.resolved("react", "a/b.ts", aliases) is None


def test_coverage_by_format_and_crash_logs(spark):
    reports = spark.createDataFrame([("cov/lcov.info", "TN:t\nSF:a.py\nDA:2,1\nend_of_record"), ("coverage.xml", '<coverage><package name="p"><class name="K"></class></package></coverage>')], "path string, text string")
    sources = spark.createDataFrame([("a.py", "def f():\n  x")], "path string, text string")
    assert sorted(tuple(r) for r in A.coverage_entries(reports, sources).collect()) == [("coverage::p.K", "p.K"), ("t::a.py", "f")]
    logs = spark.createDataFrame([("c.log", 1, '  File "/r/a.py", line 3, in f\nTypeError: x is not a function'), ("d.log", 1, "fine")], "path string, mtime long, text string")
    assert [tuple(r) for r in A.crash_stacks(logs, "/r").collect()] == [("c.log", 1, ["py::a.f"], "TypeError|is_not_a_function")]


def test_defines_by_language_and_unresolved_calls(spark):
    files = spark.createDataFrame([("a.py", "import b\ndef f():\n    b.g()\n    b.gone()\n    helper()\n    print(1)\n"), ("b.py", "def g(): pass\n"), ("c.ts", "export function h() { return 1; }"), ("d.txt", "x")], "path string, text string")
    rows = K.defines(files)
    assert sorted((r.lang, r.module, r.qualified_name) for r in rows.collect()) == [("js_ts", "c", "h"), ("py", "a", "f"), ("py", "b", "g")]
    found = P.imports(files.where("path like '%.py'"))
    edges = resolve_calls(rows, found, P.reexports(files.where("path like '%.py'")))
    assert sorted(r.raw for r in K.unresolved_calls(rows, edges, found).collect()) == ["b.gone", "helper", "print"]


def test_states_of_both_languages(spark):
    """A file that cannot be read has a state, whatever its language; others have none."""
    from chronoweave.sources import code

    files = spark.createDataFrame([("a.py", "x = 1"), ("b.py", "def f(:"), ("c.ts", "const f = () => 1;"), ("d.js", "function f() {"), ("e.ts", "("), ("f.md", "#"), ("g.py", None)], "path string, text string")
    assert {r.path: r.ok for r in code.parse_states(files).collect()} == {"a.py": True, "b.py": False, "c.ts": True, "d.js": False, "e.ts": False, "g.py": True}
    assert {r.path for r in code.defines(files).collect()} == {"c.ts"}


def test_report_files_are_read_by_spark(spark, tmp_path):
    (tmp_path / "junit.xml").write_text('<testsuite><testcase classname="c" name="é &amp; n"><failure>why</failure></testcase></testsuite>', encoding="utf-8")
    rows = A.junit_cases(A.xml_files(spark, str(tmp_path))).collect()
    assert [(r.classname, r.name, r.status, r.failure_text) for r in rows] == [("c", "é & n", "failed", "why")] and rows[0].path.endswith("junit.xml")
