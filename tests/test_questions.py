from loamlens.operators import catalog, graph, texts

EDGES = "repo string, src string, dst string"
SYMBOLS = "symbol_id long, repo string, file_path string, name string, kind string, line long, signature string, doc string, exported boolean, lang string"
FILES = "file_id long, repo string, path string, content string, indexed_at timestamp, lang string"
IMPORTS = "import_id long, repo string, file_path string, from_module string, names array<string>, is_external boolean, is_default boolean"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_module_graph_by_direction_and_cut(spark):
    edges = spark.createDataFrame([("r", "a/1", "b/2"), ("r", "b/2", "c/3"), ("r", "c/3", "d/4"), ("r", "x/0", "a/1"), ("r", "x/0", "c/3"), ("q", "a/1", "z/9"), ("q", "y/8", "y/9")], EDGES)
    near = lambda **k: rows(graph.module_graph(edges, prefix="a/", **k), "repo", "src", "dst")
    assert near() == [("q", "a/1", "z/9"), ("r", "a/1", "b/2"), ("r", "b/2", "c/3")]
    assert near(direction="in") == [("r", "x/0", "a/1")]
    assert near(direction="both", max_depth=1) == [("q", "a/1", "z/9"), ("r", "a/1", "b/2"), ("r", "x/0", "a/1")]
    assert rows(graph.module_graph(edges, prefix="a/", max_edges=2), "src", "truncated") == [("a/1", True), ("a/1", True)]
    assert graph.module_graph(edges.where("false"), prefix="a/").count() == 0


def test_unused_report_and_summary(spark):
    files = spark.createDataFrame([(i, "r", p, "x", None, "l") for i, p in enumerate(["src/a.ts", "src/b.ts", "gen/c.ts", "test/d.ts"])], FILES)
    symbols = spark.createDataFrame([(1, "r", "src/a.ts", "used", "function", 1, None, None, True, ""), (2, "r", "src/a.ts", "dead", "function", None, None, None, True, ""), (3, "r", "gen/c.ts", "made", "function", 1, None, None, True, ""), (4, "r", "test/d.ts", "t", "function", 1, None, None, True, ""), (5, "r", "src/b.ts", "own", "function", 1, None, None, None, "")], SYMBOLS)
    imports = spark.createDataFrame([(1, "r", "src/b.ts", "./a", ["used"], False, False), (2, "r", "gen/c.ts", None, None, None, None)], IMPORTS)
    assert rows(graph.unused_report(imports, files, symbols), "position", "name", "confidence") == [(1, "made", "high"), (2, "dead", "high")]
    assert rows(graph.unused_report(imports, files, symbols, ignore=["gen/**"]), "name") == [("dead",)]
    assert rows(graph.unused_summary(imports, files, symbols)) == [("r", 3, 3, 2, 1)]
    assert graph.unused_summary(imports.where("false"), files.where("false"), symbols.where("false")).count() == 0


def test_changes_with_impact(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "e", "c")], EDGES)
    changes = spark.createDataFrame([(2, "r", "c", "x"), (2, "r", "c", "y"), (2, "r", "z", "x"), (3, "r", "b", "x")], "snap_id long, repo string, file_path string, name string")
    got = graph.changed_with_impact(changes, edges, limit=1)
    assert rows(got, "snap_id", "file_path", "n_changes", "n_dependents", "text") == [(2, "c", 2, 3, "c: 2 changes, 3 dependents"), (3, "b", 1, 1, "b: 1 changes, 1 dependents")]
    assert graph.changed_with_impact(changes.where("false"), edges).count() == 0


def test_outlines_search_and_budget(spark):
    data = [(1, "r", "f", "go", "function", 5, "go()", "d", True, ""), (1, "r", "f", "go", "function", 5, "go()", "d", True, ""), (2, "r", "f", "go", "function", 2, None, None, None, ""), (3, None, None, None, None, None, None, None, None, ""), (4, "r", "g", "GoOn", "method", 1, "s" * 10_000, "", False, "")]
    symbols = spark.createDataFrame(data, SYMBOLS)
    assert rows(catalog.file_outline(symbols).where("repo = 'r'"), "path", "position", "name", "line", "signature") == [("f", 1, "go", 2, ""), ("g", 1, "GoOn", 1, "s" * 10_000)]
    assert {r.signature for r in catalog.file_outline(symbols, detail="names").collect()} == {""}
    assert rows(catalog.outline_within_budget(catalog.file_outline(symbols).where("repo = 'r'")), "path", "n_symbols", "n_kept") == [("f", 1, 1), ("g", 1, 0)]
    assert [r.symbol_id for r in catalog.find_symbols(symbols, "GO", match="exact").collect()] == [1, 2]
    assert [r.symbol_id for r in catalog.find_symbols(symbols, "go", match="prefix").collect()] == [1, 2, 4]
    assert catalog.find_symbols(symbols.where("false"), "go").count() == catalog.types_per_kind(symbols.where("false")).count() == 0


def test_merged_imports(spark):
    data = [(2, "r", "f", "./m", ["b", "a", None], False, None), (1, "r", "f", "./m", ["a"], False, True), (1, "r", "f", "./m", ["a"], False, True), (3, None, None, "./m", None, None, None), (4, "r", "f", "", ["x"], None, None), (5, "r", "f", None, ["x"], None, None)]
    got = catalog.merged_imports(spark.createDataFrame(data, IMPORTS))
    assert sorted((r.repo or "", r["names"], r.is_default) for r in got.collect()) == [("", "", False), ("r", "a,b", True)]


def test_folders_languages_headings_and_routes(spark):
    files = spark.createDataFrame([(1, "r", "src/test/a.go", 'http.HandleFunc("/x", f)\n', None, ""), (1, "r", "src/test/a.go", 'http.HandleFunc("/x", f)\n', None, ""), (2, "r", "spec/b.js", "app.get('/y', f); router.post(\"/z\", g)", None, ""), (3, "r", "c.md", None, None, ""), (4, None, None, "", None, "")], FILES)
    assert rows(texts.routes_in_code(files)) == [(1, "/x"), (2, "/y"), (2, "/z")]
    assert rows(catalog.test_folders(files)) == [("r", "test", 1)]
    assert rows(catalog.top_folders(files, limit=1), "folder") == [("spec",)]
    assert rows(catalog.languages_by_files(files).where("repo = 'r'"), "position", "lang") == [(1, "go"), (2, "js"), (3, "markdown")]
    documents = spark.createDataFrame([(2, "# B\n# A\n", "s"), (1, "# A\n", "s"), (3, None, "s"), (4, "# C", None)], "doc_id long, text string, source string")
    assert rows(texts.first_headings(documents)) == [("s", 1, "A"), ("s", 2, "B")]
    assert graph.group_sums(files.where("false"), spark.createDataFrame([], SYMBOLS)).count() == 0
