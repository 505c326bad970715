import random

import pytest

from loamlens.llm.provenance import copied_between_repos, handwritten, not_handwritten

SCHEMA = "file_id long, repo string, path string, content string, reason string, hash long, l string"


def body(n, seed):
    """Code of many shapes, as people write it."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["cache", "row", "item", "tree", "node", "key", "path", "size"]) + rng.choice(["", "_a", "_b", str(rng.randrange(99))])
    forms = [
        lambda: f"    {word()} = {word()}.{word()}({word()})", lambda: f"    if {word()} > {rng.randrange(99)}: raise E('{word()}')", lambda: f"    for {word()}, x in {word()}.items(): {word()}[{word()}] = x",
        lambda: f"    return [{word()}, {word()} + {rng.randrange(9)}]", lambda: f"    {word()} += len({word()}) * {word()}", lambda: f"    assert {word()} and not {word()}, '{word()} {word()}'", lambda: f"    with open({word()}) as {word()}: pass",
        lambda: f"    # {word()} {word()} {word()} before {word()}", lambda: f"    yield from ({word()} for {word()} in {word()} if {word()})", lambda: f"    del {word()}[:{rng.randrange(9)}]", lambda: f"    {word()}, *rest = sorted({word()}, key=lambda q: -q.{word()})",
    ]
    return "\n".join(f"def step_{seed}_{i}({', '.join(word() for _ in range(rng.randrange(1, 5)))}):\n" + "\n".join(rng.choice(forms)() for _ in range(rng.randrange(2, 7))) for i in range(n))


def rows(*files):
    return [(i, repo, path, content, None, 1, "x") for i, (repo, path, content) in enumerate(files)]


def reasons(spark, data):
    return {r.file_id: r.reason for r in not_handwritten(spark.createDataFrame(data, SCHEMA)).collect()}


GENERATED_BODY = "\n".join(f"    def get_field_{i}(self):\n        return self._fields[{i}]" for i in range(30))


@pytest.mark.parametrize(
    ("path", "content", "want"),
    [
        ("src/a.py", "class A:\n" + GENERATED_BODY, "generated"),
        ("src/a.py", "# Replaces the old auto-generated client, written by hand.\nx = f(1)\n", None),
        ("src/a.py", "# Builds reports that are generated each night; edit freely.\nx = f(1)\n", None),
        ("src/gen_report.py", "import os\nprint(os.getcwd())\n", None),
        ("src/a.js", "var a=1;" * 3 + "function b(c,d){return c?c.e(d):2}var f={g:!0,h:void 0};" * 40, "minified"),
        ("src/a.js", "(function (mods) {\n  load(0);\n})([\n/* 0 */\n(function (module, exports, load) {\nconst x = 1;\n}),\n/* 1 */\n(function (module, exports, load) {\nlet y = 2;\n})\n]);\n", "minified"),
        ("src/vendors/a.js", "let alpha = beta(gamma);\n", None),
        ("src/a.py", "# Vendor here means a seller, see the glossary.\nx = f(1)\n", None),
        ("src/a.py", "T = [\n" + "\n".join("    " + ", ".join(str(i * j * 37 % 999) for j in range(1, 9)) + "," for i in range(20)) + "\n]\n", "data"),
        ("src/a.ts", 'export const B: string = "' + "aB3/" * 200 + '";\n', "data"),
        ("src/a.js", "[\n" + "\n".join(f'  {{"id": {i}, "name": "n{i}", "w": {i * 31 % 7919}}},' for i in range(40)) + "\n]\n", "data"),
        ("src/a.py", body(12, 3), None),
        ("src/a.py", "K = [\n" + "\n".join(f'    "{i:040x}",' for i in range(1, 9)) + "\n]\n", "data"),
        ("src/a.py", "# Code generated by tool. DO NOT EDIT.\nx = 1\n", None),
        ("src/a.py", "", None),
        ("src/a.py", None, None),
        (None, "x = f(1)\n", None),
    ],
)
def test_one_file(spark, path, content, want):
    assert reasons(spark, rows(("r", path, content))) == ({0: want} if want else {})


LICENCE = ["Licensed under some licence, version 2;", *(f"clause {i} of the licence." for i in range(12)), "limitations under the licence."]


def test_marks_of_copies_tell_a_copy_that_stands_alone(spark):
    head = "\n".join(f"# {x}" for x in LICENCE)
    note = "# Taken from some-lib 1.2.3, fix it there."
    pairs = [(f"r{k}", f"src/foreign/f{i}.py", f"{head}\n{note}\n\n" + body(8, i)) for i in range(3) for k in (i, i + 5)]
    data = rows(
        *pairs,
        ("r9", "src/g.py", f"{head}\n{note.replace('1.2.3', '1.3.0')}\n" + body(8, 60)),
        ("r9", "src/foreign/h.py", body(14, 61)),
        ("r9", "src/h.py", f"{head}\n" + body(8, 62)),
        *((f"r{i}", f"src/own{i}.py", f"{head}\n" + body(8, 70 + i)) for i in range(9)),
        ("r9", "src/i.py", body(8, 63) + f"\n{note}\n"),
    )
    assert reasons(spark, data) == dict.fromkeys(range(8), "vendored")


def test_copies_are_found_changed_or_not_and_only_across_repos(spark):
    copy = body(12, 1)
    changed = copy.replace("step_1_3", "renamed").replace("step_1_7(", "other(self, ")
    data = rows(("a", "src/x.py", copy), ("b", "lib/y.py", changed), ("c", "src/z.py", body(12, 50)), ("c", "src/z2.py", body(12, 50)), ("d", "src/w.py", body(12, 80) + "\n" + "\n".join(copy.split("\n")[:4])))
    assert reasons(spark, data) == {0: "vendored", 1: "vendored"}


def test_a_copy_whose_pairs_others_hold_the_ends_of(spark):
    from pyspark.sql import functions as F

    names = [r.repo for r in spark.createDataFrame([(f"r{i}",) for i in range(8)], "repo string").orderBy(F.xxhash64("repo")).collect()]
    copy = body(12, 1).split("\n")
    halves = ["\n".join(copy[: len(copy) // 2]), "\n".join(copy[len(copy) // 2 :])]
    data = rows((names[3], "f.py", "\n".join(copy)), (names[4], "g.py", "\n".join(copy)), *((names[i], f"h{i}.py", halves[i % 2]) for i in (0, 1, 6, 7)))
    got = {(r.file_id, r.partner): r.containment for r in copied_between_repos(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[0, 1] == got[1, 0] == 1.0
    assert reasons(spark, data) == dict.fromkeys(range(6), "vendored")


def test_containment_against_brute_force(spark, sf):
    files = spark.read.parquet(f"{sf}/files.parquet").where("content IS NOT NULL").dropDuplicates(["file_id"])
    pairs, repo = {}, {}
    for r in files.select("file_id", "repo", "content").collect():
        lines = [" ".join(x.split(" ")) for x in (" ".join(y.replace("\t", " ").replace("\f", " ").split()) for y in r.content.replace("\r", "\n").split("\n")) if len(x) >= 8]
        pairs[r.file_id], repo[r.file_id] = set(zip(lines, lines[1:])), r.repo
    got = {}
    for r in copied_between_repos(files).collect():
        mine, theirs = pairs[r.file_id], pairs[r.partner]
        assert repo[r.file_id] != repo[r.partner]
        assert abs(r.containment - len(mine & theirs) / len(mine)) < 0.02
        got[r.file_id] = max(got.get(r.file_id, 0), r.containment)
    for f, mine in pairs.items():
        best = max((len(mine & pairs[g]) / len(mine) for g in pairs if repo[g] != repo[f]), default=0) if mine else 0
        if best >= 0.6 and len(mine) >= 8:
            assert got.get(f, 0) >= 0.6, f


def test_a_line_in_a_third_of_all_files_and_repeats(spark):
    licence = "# one licence line that everybody has\n# and a second line of the same licence\n"
    data = rows(*[(f"r{i}", f"src/f{i}.py", licence + body(10, 100 + i)) for i in range(30)])
    assert reasons(spark, data + data) == {}


def test_empty_table_and_the_rest(spark):
    df = spark.createDataFrame(rows(("r", "a.py", GENERATED_BODY), ("r", "b.py", body(3, 2)), ("r", "c.py", None)), SCHEMA)
    assert not_handwritten(df.where("false")).count() == 0
    assert [r.path for r in handwritten(df).collect()] == ["b.py"]
