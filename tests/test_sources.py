from loamlens.operators.parsers import parsed
from loamlens.sources.store import SnapshotStore
from loamlens.sources.trees import source_tree
from loamlens.streaming.refresh import refresh_stream

FILES = "repo string, path string, mtime long, size long, content string"


def test_source_tree(spark, tmp_path):
    for name, text in {"src/a.ts": "let a;\n", "node_modules/x.js": "x", ".hidden": "x", "b.png": "x", "empty.py": "", ".github/w.yml": "on: x\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r.path: r for r in source_tree(spark, str(tmp_path), repo="r").collect()}
    assert set(rows) == {"src/a.ts"}
    assert (rows["src/a.ts"].lines, rows["src/a.ts"].bytes, rows["src/a.ts"].lang) == (2, 7, "ts")


def test_store_versions(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert store.version() == 0 and store.read() is None
    first = spark.createDataFrame([("r", "a", 1, 1, "x"), ("r", "b", 1, 1, "y")], FILES)
    assert {r.status for r in store.refresh(first).collect()} == {"new"}
    second = spark.createDataFrame([("r", "a", 2, 1, "z"), ("r", "c", 1, 1, "w")], FILES)
    assert {r.path: r.status for r in store.refresh(second).collect()} == {"a": "changed", "b": "stale", "c": "new"}
    assert store.upsert(spark.createDataFrame([("r", "d", 1, 1, None)], FILES)) == 3
    assert sorted(r.path for r in store.read().collect()) == ["a", "c", "d"]


def test_stream_refresh(spark, tmp_path):
    feed = str(tmp_path / "feed")
    spark.createDataFrame([("r", "a", 1, 1, "old"), ("r", "a", 2, 1, "new"), ("r", "b", 1, 1, "b")], FILES).write.parquet(feed)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    query = refresh_stream(spark.readStream.schema(FILES).parquet(feed), store, checkpoint=str(tmp_path / "check"))
    query.awaitTermination(120)
    assert sorted((r.path, r.content) for r in store.read().collect()) == [("a", "new"), ("b", "b")]


def test_parsers(spark):
    code = {
        "a.ts": "import d, { x as y } from './m';\nimport './s';\nexport function f<T>(a) {}\nexport const g = async (a) => a;\nclass C {}\nexport interface I {}\nconst q = require('z');\n",
        "a.py": "from ..a import b, c\nimport os\nasync def f(): pass\nclass C:\n    def _m(self): pass\n",
        "b.py": "def f(:\n",
        "a.go": "package p\nimport (\n\t\"fmt\"\n)\nfunc (r *T) M() {}\nfunc g() {}\ntype S struct {}\n",
        "a.rs": "use a::b::{c, d};\npub struct S;\nimpl S {\n    pub fn m(&self) {}\n}\nfn g() {}\n",
        "a.md": "# x",
    }
    df = spark.createDataFrame([(i, p, c, "clash") for i, (p, c) in enumerate(code.items())] + [(9, "n.py", None, "")], "file_id long, path string, content string, name string")
    got = {}
    for r in parsed(df).collect():
        got.setdefault(list(code)[r.file_id], set()).add((r.line, r.kind, r.name, r.exported))
    assert got["a.ts"] == {(1, "import", "./m", False), (2, "import", "./s", False), (3, "function", "f", True), (4, "function", "g", True), (5, "class", "C", False), (6, "interface", "I", True), (7, "import", "z", False)}
    assert got["a.py"] == {(1, "import", "..a", False), (2, "import", "os", False), (3, "function", "f", True), (4, "class", "C", True), (5, "method", "_m", False)}
    assert got["a.go"] == {(3, "import", "fmt", False), (5, "method", "T.M", True), (6, "function", "g", False), (7, "struct", "S", True)}
    assert got["a.rs"] == {(1, "import", "a::b", False), (2, "struct", "S", True), (4, "method", "S::m", True), (6, "function", "g", False)}
    assert set(got) == {"a.ts", "a.py", "a.go", "a.rs"}


def test_parsers_find_the_indexed_functions(spark, sf):
    files, symbols = spark.read.parquet(f"{sf}/files.parquet"), spark.read.parquet(f"{sf}/symbols.parquet")
    want = symbols.where("kind = 'function' AND file_path RLIKE '[.](ts|js|mjs|py|go|rs)$'").select("file_id", "line", "name").distinct()
    got = parsed(files).where("kind = 'function'").select("file_id", "line", "name").distinct()
    assert want.join(got, ["file_id", "line", "name"], "left_semi").count() >= 0.9 * want.count()
