from pyspark.sql import functions as F

from loamlens.functions.paths import slashed
from loamlens.operators.snapshots import snapshot_changes

ROWS = "row_id long, snap_id long, repo string, pkg string, file_path string, name string, signature string, line long, loaded_at long, status string"
DELIVERIES = "snap_id long, repo string, pkg string, status string"


def changes(spark, rows, deliveries):
    r = spark.createDataFrame(rows, ROWS).withColumn("file_path", slashed(F.col("file_path")))
    d = spark.createDataFrame(deliveries, DELIVERIES)
    out = snapshot_changes(r, d, unit=["repo", "pkg"], key=["repo", "file_path", "name"], compare=[F.regexp_replace("signature", r"(?U)\s+", ""), F.col("line")], newest=["loaded_at", "row_id"])
    return sorted((x.snap_id, x.repo, x.file_path, x.name, x.change_kind) for x in out.collect())


def row(i, snap, name, sig="f()", line=1, loaded=0, path="a/x.py", repo="r", pkg="a"):
    return (i, snap, repo, pkg, path, name, sig, line, loaded, "clash")


FULL = [(s, "r", "a", "full") for s in (1, 2, 3)]


def test_added_removed_changed_and_back(spark):
    rows = [row(1, 1, "f"), row(2, 2, "f", line=2), row(3, 3, "f", line=2), row(4, 1, "g"), row(5, 3, "g"), row(6, 2, "h"), row(7, 3, "h")]
    assert changes(spark, rows, FULL) == [(2, "r", "a/x.py", "f", "changed"), (2, "r", "a/x.py", "g", "removed"), (2, "r", "a/x.py", "h", "added"), (3, "r", "a/x.py", "g", "added")]


def test_white_space_and_null_signatures(spark):
    rows = [row(1, 1, "f", "f( a )"), row(2, 2, "f", "f(a)"), row(3, 3, "f", None), row(4, 1, "g", None), row(5, 2, "g", None), row(6, 3, "g", None), row(7, 1, "h", ""), row(8, 2, "h", None), row(9, 3, "h", None)]
    assert changes(spark, rows, FULL) == [(2, "r", "a/x.py", "h", "changed"), (3, "r", "a/x.py", "f", "changed")]


def test_newest_row_counts_and_repeats_do_not(spark):
    rows = [row(1, 1, "f"), row(1, 1, "f"), row(2, 2, "f", line=9, loaded=1), row(3, 2, "f", line=1, loaded=2), row(4, 2, "f", line=7, loaded=2), row(5, 3, "f", line=7)]
    assert changes(spark, rows, FULL) == [(2, "r", "a/x.py", "f", "changed")]


def test_paths_in_two_ways_are_one_key(spark):
    rows = [row(1, 1, "f", path="a\\x.py"), row(2, 2, "f", path="./a/x.py"), row(3, 3, "f", path=".\\a/x.py")]
    assert changes(spark, rows, FULL) == []


def test_partial_and_missing_deliveries_are_passed_over(spark):
    rows = [row(1, 1, "f"), row(2, 2, "g"), row(3, 3, "f")]
    assert changes(spark, rows, [(1, "r", "a", "full"), (2, "r", "a", "partial"), (3, "r", "a", "full"), (3, "r", "a", "full")]) == []


def test_full_delivery_without_rows_removes_all(spark):
    assert changes(spark, [row(1, 1, "f"), row(2, 3, "f")], FULL) == [(2, "r", "a/x.py", "f", "removed"), (3, "r", "a/x.py", "f", "added")]


def test_first_delivery_has_nothing_before_it(spark):
    assert changes(spark, [row(1, 1, "f")], FULL[:1]) == []


def test_null_keys_are_values(spark):
    rows = [row(1, 1, None, repo=None, pkg=None), row(2, 2, None, repo=None, pkg=None, line=5)]
    assert changes(spark, rows, [(1, None, None, "full"), (2, None, None, "full"), (None, None, None, "full")]) == [(2, None, "a/x.py", None, "changed")]


def test_empty_tables(spark):
    assert changes(spark, [], []) == []
    assert changes(spark, [], FULL) == []
    assert changes(spark, [row(1, 1, "f")], []) == []
