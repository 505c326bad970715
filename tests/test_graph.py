import random

import pytest

from loamlens.operators import graph

FILES = "repo string, path string"
IMPORTS = "import_id long, repo string, file_path string, from_module string, names array<string>, is_external boolean"
SYMBOLS = "symbol_id long, repo string, file_path string, name string, kind string, line long, exported boolean"


def dead(spark, files, imports, symbols, **options):
    f = spark.createDataFrame([("r", p) for p in files], FILES)
    i = spark.createDataFrame([(n, "r", a, b, names, False) for n, (a, b, names) in enumerate(imports)], IMPORTS)
    s = spark.createDataFrame([(n, "r", p, name, "function", 1, exported) for n, (p, name, exported) in enumerate(symbols)], SYMBOLS)
    exports = sorted((r.file_path, r.name, r.confidence) for r in graph.unused_exports(i, f, s, **options).collect())
    return exports, sorted(r.path for r in graph.unused_files(i, f, s, **options).collect())


def test_some_names_are_asked_for(spark):
    exports, files = dead(spark, ["src/utils.ts", "src/app2.ts"], [("src/app2.ts", "./utils", ["helper"])], [("src/utils.ts", "helper", True), ("src/utils.ts", "CONFIG", True), ("src/utils.ts", "own", False), ("src/app2.ts", "App", True)])
    assert exports == [("src/app2.ts", "App", "high"), ("src/utils.ts", "CONFIG", "high")]
    assert files == ["src/app2.ts"]


def test_orphan_file_and_entry_point(spark):
    exports, files = dead(spark, ["src/orphan.ts", "src/index.ts"], [], [("src/orphan.ts", "a", True), ("src/index.ts", "b", True)])
    assert exports == [("src/index.ts", "b", "high"), ("src/orphan.ts", "a", "high")]
    assert files == ["src/orphan.ts"]


def test_import_without_names_exempts(spark):
    assert dead(spark, ["src/a.ts", "src/b.ts"], [("src/b.ts", "./a", [])], [("src/a.ts", "x", True)]) == ([], [])
    assert dead(spark, ["src/a.ts", "src/b.ts"], [("src/b.ts", "./a", None)], [("src/a.ts", "x", True)]) == ([], [])


def test_other_names_make_it_medium(spark):
    exports, _ = dead(spark, ["src/a.ts", "src/b.ts"], [("src/b.ts", "./a", ["Lib"])], [("src/a.ts", "foo", True), ("src/a.ts", "bar", True)])
    assert exports == [("src/a.ts", "bar", "medium"), ("src/a.ts", "foo", "medium")]


def test_tests_are_reported_on_request(spark):
    case = (["__tests__/a.test.ts"], [], [("__tests__/a.test.ts", "x", True)])
    assert dead(spark, *case) == ([], [])
    assert dead(spark, *case, include_tests=True) == ([("__tests__/a.test.ts", "x", "high")], ["__tests__/a.test.ts"])


def test_names_pass_through_files_without_symbols(spark):
    files = ["src/feature.ts", "src/b1.ts", "src/b2.ts", "src/page.ts"]
    imports = [("src/b1.ts", "./feature", ["used", "unused"]), ("src/b2.ts", "./b1", ["used"]), ("src/page.ts", "./b2", ["used"])]
    exports, _ = dead(spark, files, imports, [("src/feature.ts", "used", True), ("src/feature.ts", "idle", True), ("src/page.ts", "p", True)])
    assert ("src/feature.ts", "used", "high") not in exports and ("src/feature.ts", "idle", "high") in exports


def test_a_name_passed_on_counts_only_where_it_is_asked_for(spark):
    files = ["src/feature.ts", "src/b1.ts", "src/page.ts"]
    imports = [("src/b1.ts", "./feature", ["used", "unused"]), ("src/page.ts", "./b1", ["used"])]
    exports, _ = dead(spark, files, imports, [("src/feature.ts", "used", True), ("src/feature.ts", "unused", True), ("src/page.ts", "p", False)])
    assert exports == [("src/feature.ts", "unused", "high")]


def test_names_pass_through_any_number_of_files(spark):
    files = ["src/feature.ts", *(f"src/b{i}.ts" for i in range(13)), "src/page.ts"]
    imports = [("src/b0.ts", "./feature", ["used", "unused"]), *((f"src/b{i}.ts", f"./b{i - 1}", ["used"]) for i in range(1, 13)), ("src/page.ts", "./b12", ["used"])]
    exports, _ = dead(spark, files, imports, [("src/feature.ts", "used", True), ("src/feature.ts", "unused", True), ("src/page.ts", "p", False)])
    assert exports == [("src/feature.ts", "unused", "high")]


def test_empty_tables(spark):
    assert dead(spark, [], [], []) == ([], [])


def components(edges):
    reach = {a: {b for x, b in edges if x == a} for a in {x for e in edges for x in e}}
    for _ in reach:
        for a in reach:
            reach[a] = reach[a] | {c for b in reach[a] for c in reach.get(b, ())}
    return sorted((a, min(b for b in reach[a] if a in reach[b])) for a in reach if a in reach[a])


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_and_search_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(22)}
    edges = {(a, b) for a, b in edges if a != b}
    df = spark.createDataFrame([("r", a, b) for a, b in sorted(edges)], "repo string, src string, dst string")
    assert sorted((r.path, r.component) for r in graph.cycles(df).collect()) == components(edges)
    start = sorted(edges)[0][0]
    want, frontier, depth = {start: 0}, {start}, 0
    while frontier and depth < 3:
        depth += 1
        frontier = {b for a, b in edges if a in frontier} - set(want)
        want |= dict.fromkeys(frontier, depth)
    del want[start]
    got = graph.breadth_first(df, spark.createDataFrame([("r", start)], "repo string, path string"), max_depth=3)
    assert {r.path: r.depth for r in got.collect()} == want


def test_more_cycles_in_a_chain_than_rounds_were_allowed(spark):
    n = 210
    edges = [(f"c{n - i:03}a", f"c{n - i:03}b") for i in range(n)]
    edges += [(b, a) for a, b in edges]
    edges += [(f"c{n - i:03}a", f"c{n - j:03}a") for i in range(n) for j in range(i + 1, n)]
    found = graph.cycles(spark.createDataFrame([("r", a, b) for a, b in edges], "repo string, src string, dst string"))
    assert sorted((r.path, r.component) for r in found.collect()) == sorted((f"c{i:03}{x}", f"c{i:03}a") for i in range(1, n + 1) for x in "ab")
