import posixpath
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loamlens.operators.references import APPENDED, SWAPPED, SWAPPED_FOR, met_bases, module_bases, orphan_imports, orphan_report, orphans

T = [datetime(2024, m, 1) for m in range(1, 13)]
IMPORTS = "import_id long, repo string, file_path string, from_module string, is_external boolean, seen_at timestamp, path string, born string"
FILES = "repo string, path string, indexed_at timestamp, deleted_at timestamp, seen_at string, import_id string"


def found(spark, imports, files):
    i = spark.createDataFrame([(*x, "clash", "clash") for x in imports], IMPORTS)
    f = spark.createDataFrame([(*x, "clash", "clash") for x in files], FILES)
    return sorted((r.import_id, r.ref_field) for r in orphan_imports(i, f).collect())


LIVE = [("r", "a/x.ts", T[0], None), ("r", "a/y.ts", T[0], T[5]), ("r", "p/m.py", T[0], None), ("r", "p/q/__init__.py", T[0], None), ("r", "src/z.ts", T[0], None), ("r", "a/d/index.ts", T[0], None)]


@pytest.mark.parametrize(
    ("file", "module", "external", "at", "want"),
    [
        ("a/x.ts", "./y", False, T[2], []),
        ("a/x.ts", "./y", False, T[5], ["from_module"]),
        ("a/x.ts", "./y.js", None, T[2], []),
        ("a/x.ts", "../../../a/y", True, T[2], []),
        ("a/x.ts", "./d", False, T[2], []),
        ("a/x.ts", "./d.js", False, T[2], []),
        ("a/x.ts", "./Y", False, T[2], ["from_module"]),
        ("a/x.ts", "/a/y", True, T[2], []),
        ("a/x.ts", "@/z", True, T[2], []),
        ("a/x.ts", "~/a/y", True, T[2], []),
        ("a/x.ts", "z", False, T[2], []),
        ("a/x.ts", "z", True, T[2], []),
        ("a/x.ts", "nothing", None, T[2], []),
        ("a/x.ts", "nothing", False, T[2], ["from_module"]),
        ("a/x.ts", "", False, T[2], []),
        ("a/x.ts", None, False, T[2], []),
        ("p/m.py", ".q", False, T[2], []),
        ("p/q/__init__.py", "..m", False, T[2], []),
        ("p/q/__init__.py", ".m", False, T[2], ["from_module"]),
        ("p/q/__init__.py", "..q", False, T[2], []),
        ("a/gone.ts", "./y", False, T[2], ["file_path"]),
        ("a/y.ts", "./x", False, T[5], ["file_path"]),
        (None, "./x", False, T[2], ["file_path", "from_module"]),
        ("a/x.ts", "./y", False, None, ["file_path", "from_module"]),
    ],
)
def test_one_reference(spark, file, module, external, at, want):
    assert found(spark, [(1, "r", file, module, external, at)], LIVE) == [(1, w) for w in want]


def test_other_repo_null_repo_repeats_and_empty_tables(spark):
    one = (1, "s", "a/x.ts", "./y", False, T[2])
    assert found(spark, [one, one], LIVE) == [(1, "file_path"), (1, "from_module")]
    assert found(spark, [(1, None, "a/x.ts", "./y", False, T[2])], LIVE) == [(1, "file_path"), (1, "from_module")]
    assert found(spark, [], LIVE) == []
    assert found(spark, [one], []) == [(1, "file_path"), (1, "from_module")]


def test_repeated_file_lives_from_its_earliest_row(spark):
    files = [("r", "a/x.ts", T[4], None), ("r", "a/x.ts", T[1], None), ("r", "a/y.ts", None, None)]
    assert found(spark, [(1, "r", "a/x.ts", None, None, T[1]), (2, "r", "a/x.ts", None, None, T[0]), (3, "r", "a/y.ts", None, None, T[3])], files) == [(2, "file_path"), (3, "file_path")]


def test_report_counts_each_import_once(spark):
    f = spark.createDataFrame([(1, "file_path", T[0]), (1, "file_path", T[0]), (2, "file_path", T[1])], "import_id long, ref_field string, seen_at timestamp")
    assert sorted(r.n_orphans for r in orphan_report(f).collect()) == [1, 1]


def test_match_semantics_of_partly_null_keys(spark):
    refs = spark.createDataFrame([(1, "a", "b"), (2, "a", None), (3, "x", None), (4, None, None), (5, "a", "c")], "id long, k1 string, k2 string")
    keys = spark.createDataFrame([("a", "b", 0), (None, "c", 0)], "k1 string, k2 string, id int")
    on = [("k1", "k1"), ("k2", "k2")]
    ids = lambda m: sorted(r.id for r in orphans(refs, keys, on, match=m).collect())
    assert ids("simple") == [5]
    assert ids("partial") == [3, 5]
    assert ids("full") == [2, 3, 5]
    with pytest.raises(ValueError):
        orphans(refs, keys, on, match="other")


def candidates(module, file):
    """Brute force: all candidates of a specifier."""
    folder = posixpath.dirname(file)
    if module.startswith(".") and file.endswith((".py", ".pyi")):
        n = len(module) - len(module.lstrip("."))
        bases = [folder + "/.." * (n - 1) + "/" + module.lstrip(".").replace(".", "/")]
    elif module.startswith("."):
        bases = [folder + "/" + module]
    elif module.startswith("/"):
        bases = [module[1:]]
    elif module[:2] in ("@/", "~/"):
        bases = [module[2:], "src/" + module[2:]]
    else:
        bases = [module, "src/" + module]
    out = []
    for b in bases:
        done = []
        for part in b.split("/"):
            if part == "..":
                done = done[:-1]
            elif part not in ("", "."):
                done.append(part)
        b = "/".join(done)
        out.append(b)
        for s in SWAPPED:
            if b.endswith(s):
                out += [b[: -len(s)] + e for e in SWAPPED_FOR]
        out += [b + e for e in APPENDED]
    return out


def test_bases_from_both_sides_meet_as_candidates_do(spark):
    rng = random.Random(3)
    names = ["a", "b.js", "c.ts", "index", "x.mjs", "d"]
    cases = []
    for _ in range(300):
        file = "/".join(rng.choices(["p", "q", "src"], k=rng.randrange(1, 4))) + "/" + rng.choice(["m.py", "m.ts"])
        module = rng.choice([".", "..", "./", "../", "../../", "/", "@/", "~/", ""]) + "/".join(rng.choices(names, k=rng.randrange(1, 3)))
        pool = candidates(module, file)
        target = rng.choice(pool) if rng.random() < 0.7 else "p/" + rng.choice(names) + rng.choice([".ts", "/index.ts", ""])
        cases.append((file, module, target, target in pool))
    df = spark.createDataFrame(cases, "file string, module string, target string, want boolean")
    met = F.size(F.array_intersect(module_bases(F.col("module"), F.col("file")), met_bases(F.col("target")))) > 0
    bad = df.withColumn("got", met).where("got <> want").collect()
    assert bad == []
