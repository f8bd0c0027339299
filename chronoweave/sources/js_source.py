"""Functions, methods and imports of JavaScript and TypeScript sources, by tokens and matched brackets.

There is no compiler here: a scanner gives tokens, brackets are matched, and declarations are recognised by their first
tokens. Found: function declarations, arrows and function expressions in variables (also inside a call's arguments),
methods, fields and accessors of classes, functions in object literals of constants, namespaces, default exports,
CommonJS exports and prototypes, and what stands in control flow or functions that are called at once. Not found:
computed names, decorators' effects, functions inside functions, types beyond plain annotations.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .python_source import DEFINES

TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<number>(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d+)n?)"
    r"|(?P<name>#?[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)|(?P<op>=>|\.\.\.|\?\.(?!\d)|[*]{2}=|>>>=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|[*]{2}|<<|[-+*/%&|^]=|.)",
    re.S,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
PAIRS = {"(": ")", "[": "]", "{": "}"}
OPERATORS = frozenset("+ - * / % ** < > <= >= == === != !== && || ?? ! & | ^ << += -= *= /=".split())
#: Those that say the same.
SAME = {"===": "==", "!==": "!=", "??": "||"}
#: Names before a bracket that are no calls.
NOT_CALLED = frozenset("if for while switch catch function return typeof await new delete void in of do else super import async with yield throw case".split())
MODIFIERS = frozenset("static async public private protected readonly abstract override declare accessor get set".split())
EXTENSIONS = re.compile(r"\.(tsx?|jsx?|mjs)$")


@dataclass
class Token:
    kind: str
    text: str
    line: int
    pair: int = -1


def tokens(source: str) -> list[Token]:
    """Tokens without comments and blanks, brackets with the place of their partner. Template strings are one token."""
    out: list[Token] = []
    at, line, open_ = 0, 1, []
    while at < len(source):
        last = out[-1] if out else None
        if source[at] == "`":
            end, depth = at + 1, 0
            while end < len(source) and (source[end] != "`" or depth):
                depth += source.startswith("${", end) - (source[end] == "}" and depth > 0)
                end += 2 if source[end] == "\\" else 1
            text, kind = source[at : end + 1], "string"
        elif source[at] == "/" and (last is None or last.kind == "op" and last.text not in ")]}" or last.text in NOT_CALLED) and (m := REGEX.match(source, at)):
            text, kind = m[0], "string"
        else:
            m = TOKEN.match(source, at)
            text, kind = m[0], m.lastgroup
        if kind != "skip":
            token = Token(kind, text, line)
            if kind == "op" and text in PAIRS:
                open_.append(len(out))
            elif kind == "op" and text in ")]}":
                if not open_ or PAIRS[out[open_[-1]].text] != text:
                    raise SyntaxError(f"unmatched {text} in line {line}")
                token.pair = open_.pop()
                out[token.pair].pair = len(out)
            out.append(token)
        line += text.count("\n")
        at += len(text)
    if open_:
        raise SyntaxError(f"{out[open_[-1]].text} is never closed")
    return out


class File:
    def __init__(self, path: str, source: str):
        self.path, self.t = path, tokens(source)
        self.rows: list[dict] = []
        self.aliases: dict[str, str] | None = None

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def close(self, i: int) -> int:
        return self.t[i].pair

    def after_type(self, i: int, stops: str) -> int:
        """Past a type annotation: to the first of the stops outside brackets."""
        ends = stops.split()
        if self.text(i) == "{" and "{" in ends and self.text(self.close(i) + 1) in ("{", "|", "&", "["):
            i = self.close(i) + 1  # an object type
        while i < len(self.t) and self.text(i) not in ends:
            i = self.generics(i) if self.text(i) == "<" else self.close(i) + 1 if self.text(i) in PAIRS else i + 1
        return i

    def callable_at(self, i: int) -> tuple[int, int, int, int] | None:
        """(start, parameters, body, end) of the arrow or function expression that begins here."""
        start = i
        i += self.text(i) == "async"
        if self.text(i) == "function":
            i += 1 + (self.text(i + 1) == "*")
            i += self.t[i].kind == "name" if i < len(self.t) else 0
            return self.function(start, i)
        if self.text(i) == "<":
            i = self.generics(i)
        if i >= len(self.t):
            return None
        if self.t[i].kind == "name" and self.text(i + 1) == "=>":
            params, arrow = i, i + 1
        elif self.text(i) == "(":
            arrow = self.close(i) + 1
            if self.text(arrow) == ":":
                arrow = self.after_type(arrow + 1, "=> ; ,")
            params = i
        else:
            return None
        if self.text(arrow) != "=>":
            return None
        body = arrow + 1
        return start, params, body, self.close(body) if self.text(body) == "{" else self.expression_end(body)

    def generics(self, i: int) -> int:
        """Past a list of type parameters."""
        depth = 0
        while i < len(self.t):
            depth += {"<": 1, ">": -1}.get(self.text(i), 0)
            i += 1
            if not depth:
                break
        return i

    def function(self, start: int, i: int) -> tuple[int, int, int, int] | None:
        """The same for what begins with its parameters, or their types, here; None without a body."""
        if self.text(i) == "<":
            i = self.generics(i)
        if self.text(i) != "(":
            return None
        body = self.close(i) + 1
        if self.text(body) == ":":
            body = self.after_type(body + 1, "{ ;")
        return (start, i, body, self.close(body)) if self.text(body) == "{" else None

    def expression_end(self, i: int) -> int:
        """The last token of an expression that begins here."""
        last = i
        while i < len(self.t) and self.text(i) not in (",", ";", ")", "]", "}"):
            if i > last + 1 or i > last and self.t[i].line > self.t[last].line and self.t[i].kind == "name" and self.t[last].text not in OPERATORS and self.t[last].text not in ("=>", ".", "?", ":", "="):
                break
            last = self.close(i) if self.text(i) in PAIRS else i
            i = last + 1
        return last

    def put(self, name: str, found: tuple[int, int, int, int], accessor: str = "") -> None:
        start, params, body, end = found
        block = self.text(body) == "{"
        inner = range(body + 1, end) if block else range(body, end + 1)
        own, skip = [], -1
        for i in inner:  # without nested functions and classes
            if i <= skip:
                continue
            if i > body and (nested := self.nested_end(i)):
                skip = nested
                continue
            own.append(i)
        text = [self.text(i) for i in own]
        used: list[str] = []
        calls, numbers, operators, effects = [], [], [], {"async"} if self.text(start) == "async" or self.text(start - 1) == "async" else set()
        for k, i in enumerate(own):
            x, after = self.t[i], self.text(i + 1)
            if x.kind == "name" and x.text not in NOT_CALLED and (after == "(" or after == "<" and self.text(self.generics(i + 1)) == "(" and self.text(i + 2)[:1].isupper()) and self.text(i - 1) not in ("function", "new"):
                chain = self.chain(i)
                if self.text(i - 2 * chain.count(".") - 1) not in (".", "?."):  # of names all the way
                    calls.append(chain)
                    if self.consumed(i - 2 * chain.count("."), self.close(i + 1 if after == "(" else self.generics(i + 1))):
                        used.append(self.meant(chain))
            elif x.kind == "name" and self.text(i - 1) == "new":
                calls.append(x.text)
            elif x.kind == "number":
                numbers.append(x.text)
            elif x.kind == "op" and x.text in OPERATORS:
                before = self.t[i - 1]
                unary = x.text in "+-" and before.kind == "op" and before.text not in ")]}" or before.text == "return"
                operators.append(f"unary {x.text}" if unary else SAME.get(x.text, x.text))
            if x.text in ("await", "yield", "throw") and x.kind == "name":
                effects.add({"await": "async", "yield": "generator", "throw": "raises"}[x.text])
            if x.text.endswith("=") and x.text not in ("==", "===", "!=", "!==", "<=", ">=") and k:
                effects |= {"attr_write"} if self.text(i - 2) in (".", "?.") else {"subscript_write"} if self.text(i - 1) == "]" and self.t[self.close(i - 1) - 1].kind == "name" else set()
        returns = [i for i in own if self.text(i) == "return"]
        value = any(self.text(i + 1) not in (";", "}") and (i + 1 < len(self.t) and self.t[i + 1].line == self.t[i].line) for i in returns)
        self.rows.append(
            {
                "path": self.path, "qualified_name": name, "start_line": self.t[start].line, "end_line": self.t[end].line, "params": self.shape(params),
                "returns_kind": "value" if value or not block else "bare" if returns else "none", "calls": calls, "numerics": numbers, "operators": sorted(operators), "imports": [],
                "effects": sorted(effects), "statements": self.statements(body, end) if block else 1, "bindings": self.bindings(params, own), "call_assigns": {}, "return_type": "",
                "content_hash": hashlib.sha256(" ".join(text).encode()).hexdigest()[:16], "asserts": any(c.split(".")[0] in ("expect", "assert") for c in calls), "consumed": list(dict.fromkeys(used)),
            }
        )

    def consumed(self, first: int, last: int) -> bool:
        """Whether the value of the call from first to last is used: it is no statement of its own, awaited or not."""
        before = first - 1
        while self.text(before) == "await":
            before -= 1
        goes_on = (*OPERATORS, ",", "=", "=>", ".", "?.", "?", ":", "(", "[", "return", "yield", "throw", "case", "in", "of", "typeof", "new")
        begins = before < 0 or self.text(before) in (";", "{", "}", ")", "else", "do", "void") or self.t[before].line < self.t[before + 1].line and self.text(before) not in goes_on
        after = last + 1
        ends = after >= len(self.t) or self.text(after) in (";", "}") or self.t[after].line > self.t[last].line and self.text(after) not in goes_on
        return not (begins and ends)

    def meant(self, name: str, hops: int = 8) -> str:
        """What a name stands for through `const a = b;` and `readonly a = b;`, a few steps far."""
        if self.aliases is None:
            self.aliases = {}
            for i in range(len(self.t) - 3):
                if self.text(i) in ("const", "readonly") and self.t[i + 1].kind == "name" and self.text(i + 2) == "=" and self.t[i + 3].kind == "name":
                    j = i + 3
                    while self.text(j + 1) == "." and j + 2 < len(self.t) and self.t[j + 2].kind == "name":
                        j += 2
                    if self.text(j + 1) in (";", "}", "") or self.t[j + 1].line > self.t[j].line and self.text(j + 1) not in OPERATORS:
                        self.aliases[self.text(i + 1)] = "".join(self.text(k) for k in range(i + 3, j + 1))
        for _ in range(hops):
            if name not in self.aliases:
                break
            name = self.aliases[name]
        return name

    def nested_end(self, i: int) -> int | None:
        """The end of a function or class that begins here."""
        if self.text(i) == "class" and self.text(i - 1) != ".":
            return self.close(self.after_type(i + 1, "{")) if self.after_type(i + 1, "{") < len(self.t) else None
        if self.text(i) in ("function", "async") or self.text(i) in ("(", "<") or self.t[i].kind == "name" and self.text(i + 1) == "=>":
            found = self.callable_at(i)
            return found[3] if found else None
        return None

    def chain(self, i: int) -> str:
        parts = [self.text(i)]
        while self.text(i - 1) in (".", "?.") and self.t[i - 2].kind == "name":
            i -= 2
            parts.append(self.text(i))
        return ".".join(reversed(parts)).replace("#", "")

    def shape(self, i: int) -> dict:
        out = {"required": 0, "defaults": 0, "has_args": False, "has_kwargs": False, "keyword_only": 0}
        if self.text(i) != "(":
            return out | {"required": 1}
        at, end = i + 1, self.close(i)
        while at < end:
            stop, default = at, False
            while stop < end and self.text(stop) != ",":
                default |= self.text(stop) in ("=", "?") and self.text(stop + 1) != ":" or self.text(stop) == "?"
                stop = self.close(stop) + 1 if self.text(stop) in PAIRS else stop + 1
            if self.text(at) == "...":
                out["has_args"] = True
            elif stop > at and self.text(at) != "this":
                out["defaults" if default else "required"] += 1
            at = stop + 1
        return out

    def statements(self, body: int, end: int) -> int:
        """Statements of a block: ends by semicolon, closing brace, or a new line after a finished expression."""
        n, i, fresh = 0, body + 1, True
        while i < end:
            x = self.t[i]
            if x.text == ";":
                fresh = True
                i += 1
                continue
            if fresh or x.line > self.t[i - 1].line and x.kind == "name" and self.t[i - 1].text not in OPERATORS and self.t[i - 1].text not in (",", "=", "=>", ".", "?", ":", "(", "else", "return") and x.text not in ("else", "catch", "finally", "of", "in", "instanceof"):
                n += 1
            fresh = False
            if x.text in PAIRS:
                i = self.close(i)
                fresh = x.text == "{" and self.text(i + 1) not in ("else", "catch", "finally", ")", ",", ";", ".", "while")
            i += 1
        return n

    def bindings(self, params: int, own: list[int]) -> dict[str, str]:
        """Receivers of known class: annotated parameters, and variables and fields made by new."""
        out: dict[str, str] = {}
        if self.text(params) == "(":
            for i in range(params + 1, self.close(params)):
                if self.t[i].kind == "name" and self.text(i + 1) == ":" and self.text(i + 2)[:1].isupper():
                    out[self.text(i)] = self.text(i + 2)
        for i in own:
            if self.text(i) == "=" and self.text(i + 1) == "new" and self.t[i - 1].kind == "name":
                out[self.chain(i - 1)] = self.chain(i + 2) if self.text(i + 3) != "." else f"{self.text(i + 2)}.{self.text(i + 4)}"
        return out

    def members(self, body: int, prefix: str) -> None:
        """Methods, accessors and fields of a class."""
        i, end = body + 1, self.close(body)
        while i < end:
            start, kinds = i, []
            while self.text(i) in MODIFIERS and self.text(i + 1) not in ("(", "=", ";", ":"):
                kinds.append(self.text(i))
                i += 1
            i += self.text(i) == "*"
            if self.text(i) == "@":  # a decorator
                i += 2
                while self.text(i) == ".":
                    i += 2
                i = self.close(i) + 1 if self.text(i) == "(" else i
                continue
            name = self.text(i).strip("\"'").lstrip("#")
            accessor = next((f"{k} " for k in kinds if k in ("get", "set")), "")
            if self.t[i].kind in ("name", "string") and self.text(i + 1) in ("(", "<"):
                if found := self.function(start, i + 1):
                    self.put(f"{prefix}{accessor}{name}", found)
                    i = found[3] + 1
                    continue
            elif self.t[i].kind == "name":
                j = i + 1
                if self.text(j) in (":", "?", "!"):
                    j = self.after_type(j, "= ; }")
                if self.text(j) == "=":
                    if found := self.callable_at(j + 1):
                        self.put(f"{prefix}{name}", found)
                        i = found[3] + 1
                        continue
            i = self.member_end(i, end)

    def member_end(self, i: int, end: int) -> int:
        line = self.t[i].line if i < len(self.t) else 0
        while i < end and self.text(i) != ";" and (self.t[i].line == line or self.text(i) in PAIRS.values()):
            i = self.close(i) if self.text(i) in PAIRS else i
            line = self.t[i].line
            i += 1
        return i + (self.text(i) == ";")

    def members_of_object(self, body: int, prefix: str) -> None:
        """Functions of an object literal."""
        i, end = body + 1, self.close(body)
        while i < end:
            start = i
            while self.text(i) in ("async", "get", "set", "*") and self.text(i + 1) not in ("(", ":", ",", "}"):
                i += 1
            name = self.text(i).strip("\"'")
            found = self.function(start, i + 1) if self.text(i + 1) in ("(", "<") else self.callable_at(i + 2) if self.text(i + 1) == ":" else None
            if found and self.t[i].kind in ("name", "string"):
                accessor = self.text(start) + " " if self.text(start) in ("get", "set") and start < i else ""
                self.put(f"{prefix}{accessor}{name}", found)
                i = found[3]
            while i < end and self.text(i) != ",":
                i = self.close(i) + 1 if self.text(i) in PAIRS else i + 1
            i += 1

    def deep_callable(self, i: int) -> tuple[int, int, int, int] | None:
        """The function that a value is, or the first among the arguments of the calls that make it."""
        if found := self.callable_at(i):
            return found
        i += self.text(i) == "await"
        while i < len(self.t) and (self.t[i].kind == "name" or self.text(i) in (".", "?.")):
            i += 1
        if self.text(i) == "<":
            i = self.generics(i)
        if self.text(i) != "(":
            return None
        at, end = i + 1, self.close(i)
        while at < end:
            if found := self.deep_callable(at):
                return found
            while at < end and self.text(at) != ",":
                at = self.close(at) + 1 if self.text(at) in PAIRS else at + 1
            at += 1
        return None

    def scan(self, i: int, end: int, prefix: str = "") -> None:
        """Declarations among the statements from i to end."""
        while i < end:
            x = self.text(i)
            if x == "export":
                default = self.text(i + 1) == "default"
                i += 1 + default
                if default and self.text(i) == "class" and self.text(i + 1) in ("{", "extends"):
                    body = self.after_type(i + 1, "{")
                    self.members(body, f"{prefix}<default>.")
                    i = self.close(body) + 1
                elif default and "function" not in (self.text(i), self.text(i + 1)) and (found := self.callable_at(i)):
                    self.put(f"{prefix}<default>", found)
                    i = found[3] + 1
                continue
            if x in ("declare", "abstract") and self.t[i + 1].kind == "name":
                i += 1
                continue
            if x == "class" and i + 1 < end and self.t[i + 1].kind == "name":
                body = self.after_type(i + 2, "{")
                if body >= end:
                    return
                self.members(body, f"{prefix}{self.text(i + 1)}.")
                i = self.close(body) + 1
                continue
            if x in ("namespace", "module") and self.t[i + 1].kind in ("name", "string") and self.text(i + 2) in ("{", "."):
                body = self.after_type(i + 2, "{")
                name = "".join(self.text(k) for k in range(i + 1, body)).strip("\"'")
                self.scan(body + 1, self.close(body), f"{prefix}{name}.")
                i = self.close(body) + 1
                continue
            if x == "function" or x == "async" and self.text(i + 1) == "function":
                at = i + 1 + (x == "async") + (self.text(i + 1 + (x == "async")) == "*")
                found = self.function(i, at + 1) if at < end and self.t[at].kind == "name" else self.function(i, at)
                if found:
                    self.put(f"{prefix}{self.text(at)}" if self.t[at].kind == "name" else f"{prefix}<default>", found)
                    i = found[3] + 1
                    continue
            if x in ("const", "let", "var") and self.t[i + 1].kind == "name":
                name, j = self.text(i + 1), i + 2
                if self.text(j) == ":":
                    j = self.after_type(j + 1, "= ; ,")
                if self.text(j) == "=":
                    if found := self.deep_callable(j + 1):
                        self.put(f"{prefix}{name}", found)
                        i = self.expression_end(j + 1) + 1
                        continue
                    if self.text(j + 1) == "{" and x == "const":
                        self.members_of_object(j + 1, f"{prefix}{name}.")
                        i = self.close(j + 1) + 1
                        continue
                    if self.text(j + 1) == "class":
                        body = self.after_type(j + 2, "{")
                        self.members(body, f"{prefix}{name}.")
                        i = self.close(body) + 1
                        continue
            if step := self.commonjs(i, prefix):
                i = step
                continue
            if x == "(" and (found := self.callable_at(i + 1)) and self.text(found[2]) == "{" and (self.text(self.close(i) + 1) == "(" or self.text(found[3] + 1) == "("):
                self.scan(found[2] + 1, found[3], prefix)  # called at once
                i = self.close(i) + 1
                continue
            if x == "{" and (self.text(i - 1) in (")", "else", "try", "finally", "do", ";", "}", "") or i == 0):
                self.scan(i + 1, self.close(i), prefix)
            i = self.close(i) + 1 if x in PAIRS else i + 1

    def commonjs(self, i: int, prefix: str) -> int | None:
        """module.exports = {…}, exports.f = …, module.exports.f = …, X.prototype.m = …; the place after it."""
        j, names = i, []
        while j < len(self.t) and self.t[j].kind == "name":
            names.append(self.text(j))
            j += 1
            if self.text(j) != ".":
                break
            j += 1
        if self.text(j) != "=" or len(names) < 2 or self.text(i - 1) == ".":
            return None
        if names == ["module", "exports"]:
            if self.text(j + 1) == "{":
                self.members_of_object(j + 1, prefix)
                return self.close(j + 1) + 1
            name = "<default>"
        elif names[:-1] in (["exports"], ["module", "exports"]):
            name = names[-1]
        elif len(names) == 3 and names[1] == "prototype":
            name = f"{names[0]}.{names[2]}"
        else:
            return None
        if found := self.callable_at(j + 1):
            self.put(f"{prefix}{name}", found)
            return found[3] + 1
        return None


def consumed(files: DataFrame) -> DataFrame:
    """(path, qualified_name, consumed) for each callable: the callees whose values it uses. With these as `calls`,
    resolve_calls() gives the data-flow edges between defines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    rows += [(path, r["qualified_name"], r["consumed"]) for r in file_defines(path, text or "")]
                except UNREADABLE:
                    continue
            yield pd.DataFrame(rows, columns=["path", "qualified_name", "consumed"])

    return files.select("path", "text").mapInPandas(run, "path string, qualified_name string, consumed array<string>")


def file_defines(path: str, source: str) -> list[dict]:
    """The callables of a file, by the rules above."""
    file = File(path, source)
    file.scan(0, len(file.t))
    return file.rows


def resolved(path: str, rel: str, aliases: dict[str, str]) -> str | None:
    """The module that an import path names: relative ones and aliases; None for packages."""
    bare = EXTENSIONS.sub("", path)
    if bare.startswith(("./", "../")) or bare in (".", ".."):
        return posixpath.normpath(posixpath.join(posixpath.dirname(rel), bare))
    for prefix, base in aliases.items():
        if bare.startswith(prefix):
            return f"{base}/{bare[len(prefix):]}" if base else bare[len(prefix) :]
    return None


IMPORT = re.compile(r"(?m)^\s*import\s+(?!type\s)(?P<what>[^'\"]+?)\s+from\s+(['\"])(?P<path>[^'\"]+)\2")
REQUIRE = re.compile(r"(?m)^\s*(?:const|let|var)\s+(?P<what>[\w$]+)\s*=\s*require\(\s*(['\"])(?P<path>[^'\"]+)\2\s*\)")
EXPORT = re.compile(r"(?m)^\s*export\s+(?!type\s)(?P<what>\{[^}]*\}|\*(?:\s+as\s+[\w$]+)?)\s+from\s+(['\"])(?P<path>[^'\"]+)\2")


def named(inner: str) -> Iterator[tuple[str, str]]:
    """(original, bound) of a list in braces, without types."""
    for item in inner.strip("{} \n").split(","):
        words = item.split()
        if words and words[0] != "type":
            yield words[0], words[-1]


def file_imports(rel: str, source: str, aliases: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(name, target) of imports and requires of the project's own modules."""
    out = []
    for m in [*IMPORT.finditer(source), *REQUIRE.finditer(source)]:
        if not (module := resolved(m["path"], rel, aliases or {})):
            continue
        what = m["what"].strip()
        for braces in re.findall(r"\{[^}]*\}", what):
            out += [(bound, f"{module}.{name}") for name, bound in named(braces)]
        for plain in re.sub(r"\{[^}]*\}", "", what).split(","):
            words = plain.split()
            if words:
                out.append((words[-1], module))
    return out


def file_reexports(rel: str, source: str, aliases: dict[str, str] | None = None) -> list[tuple[str, str, str, str]]:
    """(barrel, exported, target module, target name) of exports from other modules; a namespace's exported name
    leads to the module itself, with an empty name."""
    barrel, out = EXTENSIONS.sub("", rel), []
    for m in EXPORT.finditer(source):
        if not (module := resolved(m["path"], rel, aliases or {})):
            continue
        what = m["what"]
        if what.startswith("{"):
            out += [(barrel, "<default>" if b == "default" else b, module, "<default>" if n == "default" else n) for n, b in named(what)]
        else:
            words = what.split()
            out.append((barrel, "*", module, "*") if len(words) == 1 else (barrel, words[-1], module, ""))
    return out


def aliases_of(config: str) -> dict[str, str]:
    """Prefix -> folder of the paths of a tsconfig or jsconfig, comments allowed; {} if it cannot be read."""
    import json

    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", config, flags=re.S)
    try:
        options = json.loads(re.sub(r",\s*([}\]])", r"\1", text)).get("compilerOptions", {})
    except (ValueError, AttributeError):
        return {}
    base = options.get("baseUrl", ".").strip("./")
    out = {}
    for key, targets in (options.get("paths") or {}).items():
        if key.endswith("*") and targets and targets[0].endswith("*"):
            out[key[:-1]] = "/".join(p for p in (base, targets[0][:-1].removeprefix("./").rstrip("/")) if p)
    return dict(sorted(out.items(), key=lambda x: -len(x[0])))


def aliases(configs: DataFrame) -> DataFrame:
    """(project_id, prefix, folder) of configuration files (project_id, path, text); of a project with both a tsconfig
    and a jsconfig the first counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, k, v) for p, text in zip(batch["project_id"], batch["text"], strict=True) for k, v in aliases_of(text or "").items()]
            yield pd.DataFrame(rows, columns=["project_id", "prefix", "folder"])

    first = configs.groupBy("project_id").agg(F.max_by("text", F.col("path").endswith("tsconfig.json").cast("int")).alias("text"))
    return first.mapInPandas(run, "project_id long, prefix string, folder string")


#: What reading a file raises: unmatched brackets, an end within a construct, too deep nesting.
UNREADABLE = (SyntaxError, IndexError, RecursionError)


def parse_state(files: DataFrame) -> DataFrame:
    """(path, ok) of files (path, text), for the parse_skipped rule."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    file_defines(path, text or "")
                    ok.append(True)
                except UNREADABLE:
                    ok.append(False)
            yield pd.DataFrame({"path": batch["path"], "ok": ok})

    return files.select("path", "text").mapInPandas(run, "path string, ok boolean")


def defines(files: DataFrame) -> DataFrame:
    """A row for each callable of files (path, text); files that cannot be read give none, see parse_state()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    rows += file_defines(path, text or "")
                except UNREADABLE:
                    continue
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in DEFINES.replace("struct<required:int,defaults:int,has_args:boolean,has_kwargs:boolean,keyword_only:int>", "struct").replace("map<string,string>", "map").split(", ")])

    return files.select("path", "text").mapInPandas(run, DEFINES)
