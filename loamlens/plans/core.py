"""Queries of the general problems, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlens.functions.paths import slashed
from loamlens.operators.references import APPENDED, SWAPPED, SWAPPED_FOR, orphan_imports, orphan_report
from loamlens.operators.snapshots import snapshot_changes
from loamlens.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that were added, removed or changed since the full delivery before."""
    rows = table(spark, sf_dir, "symbol_snapshots").select("row_id", "snap_id", "repo", "pkg", slashed(F.col("file_path")).alias("file_path"), "name", "signature", "line", "loaded_at")
    changes = snapshot_changes(
        rows,
        table(spark, sf_dir, "deliveries"),
        unit=["repo", "pkg"],
        key=["repo", "file_path", "name"],
        compare=[F.regexp_replace("signature", r"(?U)\s+", ""), F.col("line")],
        newest=["loaded_at", "row_id"],
    )
    return changes.select("snap_id", "repo", "file_path", "name", "change_kind")


def p1_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes per snapshot and repo."""
    return p1_found(spark, sf_dir).groupBy("snap_id", "repo", "change_kind").agg(F.count(F.lit(1)).alias("n_changes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of imports that lead to no living file."""
    return orphan_imports(table(spark, sf_dir, "imports"), table(spark, sf_dir, "files")).select("import_id", "ref_field").distinct()


def p5_orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table and month."""
    found = orphan_imports(table(spark, sf_dir, "imports"), table(spark, sf_dir, "files"))
    return orphan_report(found).select(F.lit("imports").alias("table_name"), "ref_field", F.date_format("period", "yyyy-MM").alias("month"), "n_orphans")


_P1 = r"""
WITH f AS (
  SELECT DISTINCT repo, pkg, snap_id FROM deliveries WHERE status = 'full' AND snap_id IS NOT NULL
), seq AS (
  SELECT *, lag(snap_id) OVER (PARTITION BY repo, pkg ORDER BY snap_id) AS before FROM f
), r AS (
  SELECT repo, pkg, snap_id, regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') AS file_path, name,
         regexp_replace(signature, '\s+', '', 'g') AS sig, line, loaded_at, row_id
  FROM symbol_snapshots
), one AS (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY repo, pkg, snap_id, file_path, name
    ORDER BY loaded_at DESC NULLS LAST, row_id DESC NULLS LAST) = 1
), now AS (
  SELECT s.snap_id AS at, o.* FROM seq s JOIN one o USING (repo, pkg, snap_id) WHERE s.before IS NOT NULL
), old AS (
  SELECT s.snap_id AS at, o.* FROM seq s JOIN one o ON o.repo = s.repo AND o.pkg = s.pkg AND o.snap_id = s.before
), found AS (
  SELECT coalesce(n.at, o.at) AS snap_id, coalesce(n.repo, o.repo) AS repo, coalesce(n.file_path, o.file_path) AS file_path,
         coalesce(n.name, o.name) AS name,
         CASE WHEN o.at IS NULL THEN 'added' WHEN n.at IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM now n FULL JOIN old o ON n.at = o.at AND n.repo = o.repo AND n.pkg = o.pkg AND n.file_path = o.file_path AND n.name = o.name
  WHERE n.at IS NULL OR o.at IS NULL OR n.sig IS DISTINCT FROM o.sig OR n.line IS DISTINCT FROM o.line
)
"""

_IN = lambda xs: ", ".join(f"('{x}')" for x in xs)

_P5 = rf"""
WITH RECURSIVE life AS (
  SELECT repo, path, min(indexed_at) AS born, max(deleted_at) AS gone FROM files GROUP BY ALL
), i AS (
  SELECT DISTINCT import_id, repo, file_path, from_module, is_external, seen_at,
    CASE WHEN file_path LIKE '%/%' THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '' END AS dir,
    regexp_matches(file_path, '\.pyi?$') AS py
  FROM imports
), internal AS (
  SELECT * FROM i WHERE from_module <> '' AND (from_module LIKE '.%' OR from_module LIKE '/%' OR from_module LIKE '@/%'
    OR from_module LIKE '~/%' OR is_external = false)
), raw AS (
  SELECT import_id, repo, seen_at, CASE
    WHEN from_module LIKE '.%' AND py THEN [concat(dir, repeat('/..', len(regexp_extract(from_module, '^\.*')) - 1), '/',
      replace(regexp_replace(from_module, '^\.+', ''), '.', '/'))]
    WHEN from_module LIKE '.%' THEN [concat(dir, '/', from_module)]
    WHEN from_module LIKE '/%' THEN [from_module[2:]]
    WHEN from_module LIKE '@/%' OR from_module LIKE '~/%' THEN [from_module[3:], 'src/' || from_module[3:]]
    ELSE [from_module, 'src/' || from_module] END AS bases
  FROM internal
), flat AS (
  SELECT import_id, repo, seen_at, unnest(bases) AS base FROM raw
), walk AS (
  SELECT DISTINCT base, list_filter(string_split(base, '/'), lambda x: x NOT IN ('', '.')) AS todo, []::VARCHAR[] AS done FROM flat
  UNION ALL
  SELECT base, todo[2:], CASE WHEN todo[1] = '..' THEN done[:len(done) - 1] ELSE list_append(done, todo[1]) END FROM walk WHERE len(todo) > 0
), clean AS (
  SELECT base, array_to_string(done, '/') AS path FROM walk WHERE len(todo) = 0
), candidate AS (
  SELECT import_id, repo, seen_at, path FROM flat JOIN clean USING (base)
  UNION ALL SELECT import_id, repo, seen_at, regexp_replace(path, '\.[a-z]+$', '') || s.col0 FROM flat JOIN clean USING (base),
    (VALUES {_IN(SWAPPED_FOR)}) s WHERE {" OR ".join(f"suffix(path, '{x}')" for x in SWAPPED)}
  UNION ALL SELECT import_id, repo, seen_at, path || s.col0 FROM flat JOIN clean USING (base), (VALUES {_IN(APPENDED)}) s
), met AS (
  SELECT c.import_id, c.seen_at FROM candidate c JOIN life l ON l.repo = c.repo AND l.path = c.path
  WHERE l.born <= c.seen_at AND (l.gone IS NULL OR c.seen_at < l.gone)
), found AS (
  SELECT DISTINCT import_id, 'file_path' AS ref_field, seen_at FROM i WHERE NOT EXISTS (
    SELECT 1 FROM life l WHERE l.repo = i.repo AND l.path = i.file_path AND l.born <= i.seen_at AND (l.gone IS NULL OR i.seen_at < l.gone))
  UNION ALL
  SELECT DISTINCT import_id, 'from_module', seen_at FROM internal WHERE (import_id, seen_at) NOT IN (SELECT import_id, seen_at FROM met)
)
"""

QUERIES = {"p1_found": p1_found, "p1_change_counts": p1_change_counts, "p5_found": p5_found, "p5_orphan_report": p5_orphan_report}
SQL = {
    "p1_found": _P1 + "SELECT DISTINCT * FROM found",
    "p1_change_counts": _P1 + "SELECT snap_id, repo, change_kind, count(*)::BIGINT AS n_changes FROM (SELECT DISTINCT * FROM found) GROUP BY ALL",
    "p5_found": _P5 + "SELECT DISTINCT import_id, ref_field FROM found",
    "p5_orphan_report": _P5
    + "SELECT 'imports' AS table_name, ref_field, strftime(seen_at, '%Y-%m') AS month, count(DISTINCT import_id)::BIGINT AS n_orphans FROM found GROUP BY ALL",
}
