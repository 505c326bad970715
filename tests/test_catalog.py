import pytest
from pyspark.sql import functions as F

from loamlens.functions import paths, text
from loamlens.operators import catalog, texts

SYMBOLS = "symbol_id long, file_id long, repo string, file_path string, name string, kind string, line long, end_line long, signature string, doc string, exported boolean"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("path", "want"),
    [("a/b/../c", "a/c"), ("../a", "a"), ("./a//b/.", "a/b"), ("..", ""), ("", ""), ("a.b/c..d", "a.b/c..d"), ("a/./b", "a/b")],
)
def test_resolved_paths(spark, path, want):
    assert value(spark, paths.resolved(F.lit(path))) == want


def test_text_functions(spark):
    assert value(spark, text.truncated(F.lit("abcdef"), 4)) == "abc…"
    assert value(spark, text.truncated(F.lit("abc"), 4)) == "abc"
    assert value(spark, text.first_sentence(F.lit("/** Does it. And more. */"))) == "Does it."
    assert value(spark, text.estimated_tokens(F.lit("12345678"))) == 3
    assert [value(spark, text.size_text(F.lit(n))) for n in (0, 1023, 1536, 3 * 1048576)] == ["0B", "1023B", "1.5KB", "3.0MB"]
    assert [value(spark, text.line_count(F.lit(t))) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 2, 2]


def test_packages_globs_languages_and_tests(spark):
    assert [value(spark, paths.package_name(F.lit(m))) for m in ("@a/b/c", "a/b", "a")] == ["@a/b", "a", "a"]
    match = lambda glob, path: value(spark, F.lit(path).rlike(paths.glob_pattern(glob)))
    assert match("src/*.ts", "src/a.ts") and not match("src/*.ts", "src/b/a.ts") and match("src/**", "src/b/a.ts") and not match("a.ts", "abts")
    assert [value(spark, paths.detected_language(F.lit(p))) for p in ("a.d.ts", "b.PY", "c", "d.xyz")] == ["ts", "py", None, None]
    tests = ["tests/a.py", "a/__tests__/b.ts", "a.spec.ts", "x/test_a.py", "a_test.go", "utils_test.go"]
    assert all(value(spark, paths.is_test_path(F.lit(p))) for p in tests)
    assert not value(spark, paths.is_test_path(F.lit("src/latest.ts")))


def symbol(i, name, kind="function", line=1, path="a.ts", exported=True):
    return (i, 1, "r", path, name, kind, line, None, "", "", exported)


def test_search_is_literal_and_ranked(spark):
    s = spark.createDataFrame([symbol(1, "test%func_1"), symbol(2, "test_func_2"), symbol(3, "Test"), symbol(4, "aTest"), symbol(4, "aTest"), symbol(5, None)], SYMBOLS)
    names = lambda q, **k: [r.name for r in catalog.search_symbols(s, q, **k).orderBy("rank", "symbol_id").collect()]
    assert names("test%func") == ["test%func_1"]
    assert names("test_func") == ["test_func_2"]
    assert names("test")[0] == "Test" and len(names("test")) == 4
    assert catalog.search_symbols(s, "test", limit=1).first().total == 4
    assert names("zzz") == []


def test_incremental_changes_and_upsert(spark):
    a = spark.createDataFrame([("r", "a", 1, 1), ("r", "b", 1, 1), ("r", "c", None, 1)], "repo string, path string, mtime long, size long")
    b = spark.createDataFrame([("r", "a", 1, 2), ("r", "c", None, 1), ("r", "d", 1, 1)], "repo string, path string, mtime long, size long")
    assert {r.path: r.status for r in catalog.incremental_changes(a, b).collect()} == {"a": "changed", "b": "stale", "c": "unchanged", "d": "new"}
    assert sorted((r.path, r.size) for r in catalog.upserted(a, b).collect()) == [("a", 2), ("b", 1), ("c", 1), ("d", 1)]


def test_empty_tables(spark):
    files = spark.createDataFrame([], "file_id long, repo string, path string, indexed_at timestamp, content string")
    assert catalog.index_stats(files).first().n_files == 0
    assert catalog.folder_rollup(files).count() == 0


def body_end(code, line, py):
    """Brute force of the end of a body."""
    rows = code.split("\n")
    if py:
        own, end = len(rows[line - 1]) - len(rows[line - 1].lstrip()), line
        for i in range(line, len(rows)):
            if rows[i].strip() and not rows[i].lstrip().startswith(")"):
                if len(rows[i]) - len(rows[i].lstrip()) <= own:
                    break
            if rows[i].strip():
                end = i + 1
        return end
    depth, opened = 0, False
    if "{" in rows[line - 1] and "}" in rows[line - 1]:
        return line
    for i in range(line - 1, len(rows)):
        plain = rows[i].split("//")[0]
        depth += plain.count("{") - plain.count("}")
        opened = opened or depth > 0
        if opened and depth <= 0:
            return i + 1
    return len(rows) if opened else line


def test_symbol_bodies_against_brute_force(spark, sf):
    s, f = spark.read.parquet(f"{sf}/symbols.parquet"), spark.read.parquet(f"{sf}/files.parquet")
    code = {r.file_id: (r.path, r.content) for r in f.where("content <> ''").collect()}
    n = 0
    for r in texts.symbol_bodies(s, f).collect():
        path, content = code[r.file_id]
        text = content.replace("\r\n", "\n").replace("\r", "\n")
        if path.endswith((".py", ".pyi")):
            want = body_end(text, r.line, True)
            assert abs(r.body_end - want) <= 0, (path, r.line, r.body_end, want)
        else:
            assert r.body_end == body_end(text, r.line, False), (path, r.line)
        n += 1
    assert n > 50


def test_folded_files_hide_bodies(spark):
    code = "function f() {\n  a;\n  b;\n  c;\n}\nlet x = 1;"
    f = spark.createDataFrame([(1, "a.js", code)], "file_id long, path string, content string")
    s = spark.createDataFrame([symbol(1, "f", path="a.js")], SYMBOLS)
    assert texts.folded_files(s, f).first().folded == "function f() {\n  … folded\n}\nlet x = 1;"
    none = spark.createDataFrame([], SYMBOLS)
    assert texts.folded_files(none, f).first().folded == code


def test_bodies_of_odd_rows(spark):
    code = "func a() {\r\n  if x {\r\n  }\r\n}\r\nfunc b() {"
    f = spark.createDataFrame([(1, "a.go", code, "x"), (1, "a.go", code, "y"), (2, "b.py", "def f():\n\n  x\n\n", "x"), (3, "c.go", None, "x"), (4, "d.go", "", "x")], "file_id long, path string, content string, level string")
    rows = [(1, 1, 1), (1, 1, 1), (2, 1, 5), (3, 2, 1), (4, 1, None), (5, 1, 99), (6, 3, 1), (7, 4, 1), (None, 1, 1), (8, 2, 2), (9, 1, 1)]
    s = spark.createDataFrame([(i, at, "function", line, "z") for i, at, line in rows], "symbol_id long, file_id long, kind string, line long, before string")
    got = {r.symbol_id: (r.line, r.body_end, r.n_lines) for r in texts.symbol_bodies(s, f).collect()}
    assert got == {1: (1, 4, 4), 9: (1, 4, 4), 2: (5, 5, 1), 3: (1, 3, 3), 8: (2, 2, 1)}
    cut = {r.symbol_id: r.body for r in texts.symbol_bodies(s, f, max_lines=2).collect()}
    assert cut[1] == "func a() {\n  if x {\n… 2 more lines" and cut[3] == "def f():\n\n… 1 more lines"
    assert {r.file_id: r.folded for r in texts.folded_files(s, f).collect()} == {1: "func a() {\n… folded\n}\nfunc b() {".replace("\n…", "\n  …"), 2: "def f():\n\n  x\n\n"}
    assert texts.symbol_bodies(s.limit(0), f).count() == 0 and texts.folded_files(s, f.limit(0)).count() == 0
