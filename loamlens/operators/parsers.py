"""Declarations and imports out of source text, by a table function per language."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# What declares and imports in each language; groups: name, or owner and name.
_JS = (
    ("function", re.compile(r"^(?P<x>export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)\s*[(<]")),
    ("function", re.compile(r"^(?P<x>export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)")),
    ("class", re.compile(r"^(?P<x>export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>[\w$]+)")),
    ("interface", re.compile(r"^(?P<x>export\s+)?interface\s+(?P<n>[\w$]+)")),
    ("type", re.compile(r"^(?P<x>export\s+)?type\s+(?P<n>[\w$]+)\s*(?:<[^=]*>)?\s*=")),
    ("enum", re.compile(r"^(?P<x>export\s+)?(?:const\s+)?enum\s+(?P<n>[\w$]+)")),
    ("const", re.compile(r"^(?P<x>export\s+)(?:const|let|var)\s+(?P<n>[\w$]+)")),
)
_JS_IMPORT = re.compile(r"^(?:import|export)\s+(?:type\s+)?(?P<names>[^'\"]*?)\s*(?:from\s+)?['\"](?P<m>[^'\"]+)['\"]|^(?:const|let|var)\s+(?P<req>[^=]+?)\s*=\s*require\(\s*['\"](?P<m2>[^'\"]+)['\"]")
_GO = (
    ("method", re.compile(r"^func\s+\(\s*\w*\s*\*?(?P<o>\w+)[^)]*\)\s*(?P<n>\w+)\s*\(")),
    ("function", re.compile(r"^func\s+(?P<n>\w+)\s*[(\[]")),
    ("struct", re.compile(r"^type\s+(?P<n>\w+)\s+struct\b")),
    ("interface", re.compile(r"^type\s+(?P<n>\w+)\s+interface\b")),
    ("type", re.compile(r"^type\s+(?P<n>\w+)\s+\S")),
    ("const", re.compile(r"^(?:const|var)\s+(?P<n>\w+)")),
)
_RUST = (
    ("function", re.compile(r"^\s*(?P<x>pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(?P<n>\w+)")),
    ("struct", re.compile(r"^(?P<x>pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)")),
    ("enum", re.compile(r"^(?P<x>pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)")),
    ("trait", re.compile(r"^(?P<x>pub(?:\([^)]*\))?\s+)?trait\s+(?P<n>\w+)")),
    ("const", re.compile(r"^(?P<x>pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?P<n>\w+)")),
)
_RUST_IMPL = re.compile(r"^impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<o>\w+)")


def _javascript(text: str) -> Iterator[tuple]:
    for at, line in enumerate(text.split("\n"), 1):
        m = _JS_IMPORT.match(line)
        if m:
            names = [n.split(" as ")[0].strip() for n in re.sub(r"[{}]", ",", m["names"] or m["req"] or "").split(",") if n.strip()]
            yield at, "import", m["m"] or m["m2"], names, False
            if not m["m2"]:
                continue
        for kind, pattern in _JS:
            d = pattern.match(line)
            if d:
                yield at, kind, d["n"], None, bool(d["x"])
                break


def _python(text: str) -> Iterator[tuple]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    for node in tree.body:
        if isinstance(node, ast.Import):
            for name in node.names:
                yield node.lineno, "import", name.name, [], False
        elif isinstance(node, ast.ImportFrom):
            yield node.lineno, "import", "." * node.level + (node.module or ""), [n.name for n in node.names], False
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield node.lineno, "function", node.name, None, not node.name.startswith("_")
        elif isinstance(node, ast.ClassDef):
            yield node.lineno, "class", node.name, None, not node.name.startswith("_")
            for part in node.body:
                if isinstance(part, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield part.lineno, "method", part.name, None, not part.name.startswith("_")


def _go(text: str) -> Iterator[tuple]:
    inside = False
    for at, line in enumerate(text.split("\n"), 1):
        if re.match(r"^import\s*\(", line):
            inside = True
        elif inside and line.startswith(")"):
            inside = False
        elif inside or re.match(r"^import\s", line):
            m = re.search(r"(?:(\w+|\.)\s+)?\"([^\"]+)\"", line)
            if m:
                yield at, "import", m[2], ["*"], False
        else:
            for kind, pattern in _GO:
                d = pattern.match(line)
                if d:
                    owner = d.groupdict().get("o")
                    yield at, kind, f"{owner}.{d['n']}" if owner else d["n"], None, d["n"][:1].isupper()
                    break


def _rust(text: str) -> Iterator[tuple]:
    owner = None
    for at, line in enumerate(text.split("\n"), 1):
        impl = _RUST_IMPL.match(line)
        if impl:
            owner = impl["o"]
        elif line.startswith("}"):
            owner = None
        m = re.match(r"^\s*(?:pub\s+)?use\s+([\w:]+?)(?:::\{([^}]*)\}|::(\w+|\*))?;", line)
        if m:
            yield at, "import", m[1], [n.strip() for n in (m[2] or m[3] or "").split(",") if n.strip()], False
            continue
        for kind, pattern in _RUST:
            d = pattern.match(line)
            if d:
                method = kind == "function" and owner and line[:1].isspace()
                yield at, "method" if method else kind, f"{owner}::{d['n']}" if method else d["n"], None, bool(d["x"])
                break


_PARSERS = {"js": _javascript, "ts": _javascript, "py": _python, "go": _go, "rs": _rust}


@udtf(returnType="line bigint, kind string, name string, names array<string>, exported boolean")
class ParseSource:
    """The declarations and imports of one text; a Python file that doesn't parse and an unknown language give no rows."""

    def eval(self, lang: str, content: str):  # noqa: ANN201
        if content is None or lang not in _PARSERS:
            return
        try:
            rows = list(_PARSERS[lang](content.replace("\r\n", "\n").replace("\r", "\n")))
        except (SyntaxError, ValueError):
            return
        yield from rows


def parsed(files: DataFrame) -> DataFrame:
    """file_id, line, kind, name, names, exported of what files declare and import; repeated rows of a file count once.

    Python is parsed to its full grammar, other languages by their declaration lines.
    """
    from loamlens.functions.paths import detected_language

    given = files.where("content IS NOT NULL").select("file_id", detected_language(F.col("path")).alias("lang"), "content")
    rows = given.lateralJoin(ParseSource(F.col("lang").outer(), F.col("content").outer()))
    return rows.select("file_id", "line", "kind", "name", "names", "exported").distinct()
