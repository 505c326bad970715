"""Queries to the index of files, symbols, imports and texts, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlens.functions import paths, text
from loamlens.operators import catalog, graph, texts
from loamlens.operators.references import APPENDED, SWAPPED, SWAPPED_FOR, module_bases
from loamlens.plans import core
from loamlens.sources.tables import table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its name, with its SQL where there is one."""

    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _list(xs) -> str:  # noqa: ANN001
    return ", ".join("'" + x + "'" for x in xs)


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in paths.LANGUAGE_OF.items()) + "}"
_LANG = lambda c: rf"coalesce({_MAP}[regexp_extract(lower({c}), '\.([^./]+\.[^./]+)$', 1)], {_MAP}[regexp_extract(lower({c}), '\.([^./]+)$', 1)])"
_LINES = "CASE WHEN content IS NULL THEN 0 WHEN content = '' THEN 0 ELSE len(content) - len(replace(content, chr(10), '')) + 1 END"
_CUR = f"""
cur AS (
  SELECT repo, path, file_id, {_LANG("path")} AS lang, {_LINES} AS n_lines, coalesce(strlen(content), 0) AS n_bytes, content IS NOT NULL AS has_content
  FROM files QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY indexed_at DESC NULLS LAST, file_id DESC) = 1
)"""
_SYM = "sym AS (SELECT DISTINCT ON (symbol_id) * FROM symbols ORDER BY symbol_id)"
_TEST = r"regexp_matches({0}, '(^|/)(tests?|__tests__)/|/spec/|\.(test|spec)\.(ts|tsx|js|jsx|mjs|py|go|rs|cs|rb)$|(^|/)test_[^/]*\.pyi?$|_test\.go$')"


@query(f"WITH {_CUR} SELECT lang, count(*)::BIGINT AS n_files, sum(n_lines)::BIGINT AS n_lines, sum(n_bytes)::BIGINT AS n_bytes FROM cur GROUP BY lang")
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.language_stats(table(spark, sf_dir, "files"))


@query(f"WITH {_CUR} SELECT count(*)::BIGINT AS n_files, sum(n_lines)::BIGINT AS n_lines, sum(n_bytes)::BIGINT AS n_bytes, count(*) FILTER (NOT has_content)::BIGINT AS n_skipped FROM cur")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.index_stats(table(spark, sf_dir, "files"))


@query(f"WITH {_CUR} SELECT repo, path, lang, n_lines::BIGINT AS n_lines, n_bytes::BIGINT AS n_bytes FROM cur")
def file_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.measured_files(table(spark, sf_dir, "files")).select("repo", "path", "lang", "n_lines", "n_bytes")


_ROLL = f"""
WITH {_CUR}, parts AS (SELECT repo, string_split(path, '/') AS p, n_lines FROM cur), ups AS (
  SELECT repo, unnest(list_concat(['.'], list_transform(range(1, len(p)), lambda i: array_to_string(p[:i], '/')))) AS folder, n_lines FROM parts
), rolled AS (SELECT repo, folder, count(*)::BIGINT AS n_files, sum(n_lines)::BIGINT AS n_lines FROM ups GROUP BY ALL)
"""


@query(_ROLL + "SELECT * FROM rolled")
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.folder_rollup(table(spark, sf_dir, "files"))


@query(
    _ROLL
    + """SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY folder || '/')::BIGINT AS position, folder || '/' AS entry,
    len(string_split(folder, '/'))::BIGINT AS depth, n_files FROM rolled WHERE folder <> '.' AND len(string_split(folder, '/')) <= 3 QUALIFY position <= 200"""
)
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.folder_tree(table(spark, sf_dir, "files"))


@query("SELECT DISTINCT repo, path FROM files f WHERE EXISTS (SELECT 1 FROM symbols s WHERE s.repo = f.repo AND s.file_path = f.path)")
def files_with_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.files_with_symbols(table(spark, sf_dir, "files"), table(spark, sf_dir, "symbols"))


@query(
    f"""WITH {_CUR}, {_SYM}, s AS (
      SELECT repo, file_path AS path, count(*) AS n_symbols, count(*) FILTER (exported) AS n_exported,
             array_to_string(list(name ORDER BY line NULLS LAST, name, symbol_id)[:100], ',') AS names FROM sym GROUP BY ALL
    ), i AS (SELECT repo, file_path AS path, count(DISTINCT import_id) AS n_imports FROM imports GROUP BY ALL)
    SELECT repo, path, lang, n_lines::BIGINT AS n_lines, coalesce(n_symbols, 0)::BIGINT AS n_symbols, coalesce(n_exported, 0)::BIGINT AS n_exported,
           coalesce(n_imports, 0)::BIGINT AS n_imports, coalesce(names, '') AS names FROM cur LEFT JOIN s USING (repo, path) LEFT JOIN i USING (repo, path)"""
)
def file_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.file_overview(*(table(spark, sf_dir, t) for t in ("files", "symbols", "imports")))


@query(
    f"""WITH {_SYM}, hits AS (
      SELECT symbol_id, repo, file_path, name, kind, line, CASE WHEN lower(name) = 'ledger' THEN 0 WHEN lower(name) LIKE 'ledger%' THEN 1 ELSE 2 END AS rank FROM sym WHERE lower(name) LIKE '%ledger%'
    ) SELECT *, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY rank, repo, file_path, line NULLS LAST, name, symbol_id LIMIT 30"""
)
def search_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_symbols(table(spark, sf_dir, "symbols"), "Ledger")


@query(
    f"""WITH {_SYM} SELECT symbol_id, repo, file_path, name, kind, line, rank, total FROM (
      SELECT *, CASE WHEN lower(name) = 'parcel' THEN 0 WHEN lower(name) LIKE 'parcel%' THEN 1 ELSE 2 END AS rank, count(*) OVER () AS total
      FROM sym WHERE contains(lower(name), 'parcel') AND kind = 'method' AND {_LANG("file_path")} = 'ts' AND regexp_matches(file_path, '(?i)^.*/src/[^/]*/[^/]*\\.ts$')
    ) ORDER BY rank, repo, file_path, line NULLS LAST, name, symbol_id LIMIT 30"""
)
def search_symbols_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_symbols(table(spark, sf_dir, "symbols"), "parcel", kind="method", language="ts", file_pattern="**/src/*/*.ts")


@query(
    f"""WITH {_SYM} SELECT symbol_id, repo, file_path, name, kind, line, signature FROM sym WHERE kind IN ('interface', 'type', 'enum', 'struct', 'trait')
    QUALIFY row_number() OVER (PARTITION BY repo, file_path, name, kind ORDER BY line NULLS LAST, symbol_id) = 1
    ORDER BY repo, file_path, line NULLS LAST, name, kind LIMIT 50"""
)
def type_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.type_definitions(table(spark, sf_dir, "symbols"))


@query("SELECT doc_id, CASE WHEN len(text) > 40 THEN text[:39] || '…' ELSE text END AS cut, ceil(len(text) / 3.5)::BIGINT AS n_tokens, substring(sha256(text), 1, 16) AS short_hash FROM documents WHERE text IS NOT NULL")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", text.truncated(F.col("text"), 40).alias("cut"), text.estimated_tokens(F.col("text")).alias("n_tokens"), text.short_hash(F.col("text")).alias("short_hash"))


@query(
    r"""WITH {sym}, flat AS (
      SELECT symbol_id, trim(regexp_replace(replace(regexp_replace(doc, '(?m)^[ \t]*(/\*+|\*+/|\*|///?|#)[ \t]?', '', 'g'), '*/', ''), '[ \t\r\n]+', ' ', 'g'), ' ') AS d FROM sym WHERE doc IS NOT NULL
    ) SELECT symbol_id, substring(CASE WHEN regexp_extract(d, '^[^.!?]*[.!?]') <> '' THEN regexp_extract(d, '^[^.!?]*[.!?]') ELSE d END, 1, 200) AS sentence FROM flat""".replace("{sym}", _SYM)
)
def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = catalog.distinct_symbols(table(spark, sf_dir, "symbols")).where("doc IS NOT NULL")
    return s.select("symbol_id", text.first_sentence(F.col("doc")).alias("sentence"))


@query(
    f"""WITH {_CUR} SELECT repo, path, CASE WHEN n_bytes < 1024 THEN n_bytes || 'B' WHEN n_bytes < 1048576 THEN printf('%.1fKB', floor(n_bytes / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1fMB', floor(n_bytes / 1048576.0 * 10 + 0.5) / 10) END AS size FROM cur"""
)
def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.measured_files(table(spark, sf_dir, "files")).select("repo", "path", text.size_text(F.col("n_bytes")).alias("size"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\r\\n]+'))::BIGINT AS n_words, CASE WHEN text = '' THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + 1 END::BIGINT AS n_lines FROM documents WHERE text IS NOT NULL")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", text.word_count(F.col("text")).alias("n_words"), text.line_count(F.col("text")).alias("n_lines"))


_ROLES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in paths.FOLDER_ROLES.items()) + "}"


@query(
    rf"""WITH p AS (SELECT DISTINCT repo, path, lower(string_split(path, '/')[-1]) AS name FROM files)
    SELECT repo, path, {_LANG("path")} AS lang, {_TEST.format("path")} AS is_test, coalesce({_ROLES}[lower(string_split(path, '/')[1])], 'source') AS folder_role,
      CASE WHEN {_TEST.format("path")} THEN 'test' WHEN regexp_matches(name, '^(index|main|app|server|cli|__main__)\.') THEN 'entry' WHEN regexp_matches(name, '(config|settings|options)') THEN 'config'
        WHEN regexp_matches(name, '(route|router|controller|handler|endpoint)') THEN 'routing' WHEN regexp_matches(name, '(model|schema|entity|types?)[._-]') THEN 'model'
        WHEN regexp_matches(name, '(util|helper|common|shared)') THEN 'utility' WHEN regexp_matches(name, '(service|client|api)') THEN 'service'
        WHEN regexp_matches(name, '(store|reducer|cache|repository)') THEN 'state' WHEN regexp_matches(name, '(middleware|plugin|hook)') THEN 'middleware'
        WHEN regexp_matches(name, '\.(md|txt|rst)$') THEN 'documentation' ELSE 'source' END AS file_role,
      len(list_filter(string_split(path, '/'), lambda x: x IN ({_list(paths.SKIPPED_FOLDERS)}) OR (x LIKE '.%' AND x NOT IN ('.', '..', {_list(paths.SHOWN_HIDDEN)})))) > 0
        OR regexp_matches(lower(path), '({"|".join(e.replace(".", chr(92) + ".") for e in paths.SKIPPED_ENDINGS)})$') AS skipped,
      CASE WHEN len(string_split(path, '/')) <= 1 THEN path WHEN len(string_split(path, '/')) = 2 THEN string_split(path, '/')[1] || '/*' ELSE string_split(path, '/')[1] || '/' || string_split(path, '/')[2] || '/*' END AS folder_group
    FROM p"""
)
def path_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return (
        table(spark, sf_dir, "files").select("repo", "path").distinct().select(
            "repo", "path", paths.detected_language(p).alias("lang"), paths.is_test_path(p).alias("is_test"), paths.folder_role(p).alias("folder_role"), paths.file_role(p).alias("file_role"),
            paths.is_skipped_path(p).alias("skipped"), paths.quotient_id(p).alias("folder_group"),
        )
    )


@query("SELECT DISTINCT repo, path FROM files WHERE regexp_matches(path, '^packages/.*/src/[^/]*\\.ts$')")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where(F.col("path").rlike(paths.glob_pattern("packages/**/src/*.ts"))).select("repo", "path").distinct()


_RESOLVE = rf"""
WITH RECURSIVE asked AS (
  SELECT DISTINCT repo, file_path, from_module, CASE WHEN file_path LIKE '%/%' THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '' END AS dir, regexp_matches(file_path, '\.pyi?$') AS py
  FROM imports WHERE file_path IS NOT NULL AND from_module <> '' AND (from_module LIKE '.%' OR from_module LIKE '/%' OR from_module LIKE '@/%' OR from_module LIKE '~/%' OR is_external = false)
), raw AS (
  SELECT repo, file_path, from_module, CASE
    WHEN from_module LIKE '.%' AND py THEN [concat(dir, repeat('/..', len(regexp_extract(from_module, '^\.*')) - 1), '/', replace(regexp_replace(from_module, '^\.+', ''), '.', '/'))]
    WHEN from_module LIKE '.%' THEN [concat(dir, '/', from_module)]
    WHEN from_module LIKE '/%' THEN [from_module[2:]]
    WHEN from_module LIKE '@/%' OR from_module LIKE '~/%' THEN [from_module[3:], 'src/' || from_module[3:]]
    ELSE [from_module, 'src/' || from_module] END AS bases FROM asked
), flat AS (SELECT repo, file_path, from_module, unnest(bases) AS base, generate_subscripts(bases, 1) AS turn FROM raw
), walk AS (
  SELECT DISTINCT base, list_filter(string_split(base, '/'), lambda x: x NOT IN ('', '.')) AS todo, []::VARCHAR[] AS done FROM flat
  UNION ALL SELECT base, todo[2:], CASE WHEN todo[1] = '..' THEN done[:len(done) - 1] ELSE list_append(done, todo[1]) END FROM walk WHERE len(todo) > 0
), clean AS (SELECT base, array_to_string(done, '/') AS b FROM walk WHERE len(todo) = 0
), ends AS (
  SELECT * FROM (VALUES {", ".join(f"('{s}', {i + 1}, true)" for i, s in enumerate(SWAPPED_FOR))}, {", ".join(f"('{s}', {i + 1 + len(SWAPPED_FOR)}, false)" for i, s in enumerate(APPENDED))}) t(e, rank, swap)
), candidate AS (
  SELECT repo, file_path, from_module, turn, 0 AS rank, b AS path FROM flat JOIN clean USING (base)
  UNION ALL SELECT repo, file_path, from_module, turn, rank, CASE WHEN swap THEN regexp_replace(b, '\.[a-z]+$', '') || e ELSE b || e END FROM flat JOIN clean USING (base), ends
  WHERE NOT swap OR {" OR ".join(f"suffix(b, '{x}')" for x in SWAPPED)}
), resolved AS (
  SELECT c.repo, file_path, from_module, arg_min(c.path, turn * 1000 + rank) AS target FROM candidate c JOIN (SELECT DISTINCT repo, path FROM files) f ON f.repo = c.repo AND f.path = c.path GROUP BY ALL
), edges AS (
  SELECT DISTINCT r.repo, file_path AS src, target AS dst FROM resolved r JOIN (SELECT DISTINCT repo, path FROM files) f ON f.repo = r.repo AND f.path = r.file_path WHERE file_path <> target
)
"""


@query(_RESOLVE + "SELECT repo, file_path, from_module, target FROM resolved")
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolved_imports(table(spark, sf_dir, "imports"), table(spark, sf_dir, "files"))


@query(_RESOLVE.split("), ends AS")[0] + ") SELECT DISTINCT a.repo, a.file_path, a.from_module, array_to_string(list(b ORDER BY turn), ' ') AS bases FROM flat a JOIN clean USING (base) GROUP BY a.repo, a.file_path, a.from_module")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamlens.operators.references import is_internal

    i = table(spark, sf_dir, "imports").where(is_internal(F.col("from_module"), F.col("is_external")) & F.col("file_path").isNotNull()).select("repo", "file_path", "from_module").distinct()
    return i.select("*", F.concat_ws(" ", module_bases(F.col("from_module"), F.col("file_path"))).alias("bases"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.import_edges(table(spark, sf_dir, "imports"), table(spark, sf_dir, "files"))


@query(_RESOLVE + "SELECT * FROM edges")
def module_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


_GROUP = lambda c: f"CASE WHEN len(string_split({c}, '/')) <= 1 THEN {c} WHEN len(string_split({c}, '/')) = 2 THEN string_split({c}, '/')[1] || '/*' ELSE string_split({c}, '/')[1] || '/' || string_split({c}, '/')[2] || '/*' END"


@query(_RESOLVE + f"SELECT repo, {_GROUP('src')} AS src, {_GROUP('dst')} AS dst, count(*)::BIGINT AS n_edges FROM edges WHERE {_GROUP('src')} <> {_GROUP('dst')} GROUP BY ALL")
def module_graph_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.folder_edges(_edges(spark, sf_dir))


_HUBS = "hubs AS (SELECT repo, dst AS path, count(*)::BIGINT AS n_importers FROM edges GROUP BY ALL ORDER BY n_importers DESC, repo, path LIMIT 10)"


@query(_RESOLVE + f", {_HUBS} SELECT * FROM hubs")
def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(_edges(spark, sf_dir))


@query(
    """SELECT CASE WHEN from_module LIKE '@%' AND from_module LIKE '%/%' THEN array_to_string(string_split(from_module, '/')[:2], '/') WHEN from_module LIKE '@%' THEN from_module ELSE string_split(from_module, '/')[1] END AS package, count(DISTINCT import_id)::BIGINT AS n_imports
    FROM imports WHERE from_module <> '' AND is_external AND NOT (from_module LIKE '.%' OR from_module LIKE '/%' OR from_module LIKE '@/%' OR from_module LIKE '~/%')
    GROUP BY ALL ORDER BY n_imports DESC, package LIMIT 20"""
)
def external_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.external_packages(table(spark, sf_dir, "imports"))


_REACH = _RESOLVE + f""", {_HUBS}, reach AS (
  SELECT repo, path AS source, path, 0 AS depth FROM hubs
  UNION SELECT r.repo, r.source, e.src, r.depth + 1 FROM reach r JOIN edges e ON e.repo = r.repo AND e.dst = r.path WHERE r.depth < 5
), least AS (SELECT repo, source, path, min(depth)::BIGINT AS depth FROM reach GROUP BY ALL HAVING min(depth) > 0)
"""


@query(_REACH + "SELECT * FROM least")
def dependents_of_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamlens.session import checkpointed

    edges = checkpointed(_edges(spark, sf_dir))
    return graph.breadth_first(edges, graph.hubs(edges), backward=True)


@query(
    _REACH
    + f"""SELECT repo, source, count(*) FILTER (depth = 1)::BIGINT AS n_direct, count(*) FILTER (depth > 1)::BIGINT AS n_indirect, count(*) FILTER ({_TEST.format("path")})::BIGINT AS n_tests,
    CASE WHEN count(*) > 25 THEN 'critical' WHEN count(*) > 10 THEN 'high' WHEN count(*) > 3 THEN 'medium' ELSE 'low' END AS blast_radius FROM least GROUP BY repo, source"""
)
def impact_of_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamlens.session import checkpointed

    edges = checkpointed(_edges(spark, sf_dir))
    return graph.impact(edges, graph.hubs(edges))


@query(
    _RESOLVE
    + """, down AS (
      SELECT repo, src AS a, dst AS b FROM edges UNION SELECT d.repo, d.a, e.dst FROM down d JOIN edges e ON e.repo = d.repo AND e.src = d.b
    ) SELECT x.repo, x.a AS path, min(x.b) AS component FROM down x JOIN down y ON x.repo = y.repo AND x.a = y.b AND x.b = y.a GROUP BY ALL"""
)
def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(_edges(spark, sf_dir))


@query(
    _RESOLVE
    + f""", imp AS (SELECT DISTINCT ON (import_id) repo, file_path, from_module, coalesce(names, []) AS names FROM imports ORDER BY import_id
    ), tgt AS (SELECT DISTINCT repo, file_path, target, names FROM imp JOIN resolved USING (repo, file_path, from_module)
    ), whole AS (SELECT DISTINCT repo, target AS path FROM tgt WHERE len(names) = 0
    ), barrel AS (SELECT DISTINCT repo, path FROM files f WHERE NOT regexp_matches(path, '{paths.ENTRY_FILES}') AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.repo = f.repo AND s.file_path = f.path)
    ), demand AS (
      SELECT DISTINCT repo, target AS path, unnest(names) AS name FROM tgt
      UNION SELECT t.repo, t.target, d.name FROM demand d JOIN barrel b ON b.repo = d.repo AND b.path = d.path JOIN tgt t ON t.repo = d.repo AND t.file_path = d.path AND (len(t.names) = 0 OR list_contains(t.names, d.name))
    ), {_SYM}, exp AS (
      SELECT DISTINCT symbol_id, repo, file_path, name FROM sym s WHERE exported AND NOT {_TEST.format("file_path")} AND EXISTS (SELECT 1 FROM files f WHERE f.repo = s.repo AND f.path = s.file_path)
        AND NOT EXISTS (SELECT 1 FROM whole w WHERE w.repo = s.repo AND w.path = s.file_path)
    ), judged AS (
      SELECT e.*, d.name IS NOT NULL AS asked, bool_or(d.name IS NOT NULL) OVER (PARTITION BY e.repo, e.file_path) AS any_asked,
        EXISTS (SELECT 1 FROM edges g WHERE g.repo = e.repo AND g.dst = e.file_path) AS imported
      FROM exp e LEFT JOIN demand d ON d.repo = e.repo AND d.path = e.file_path AND d.name = e.name
    ) SELECT symbol_id, repo, file_path, name, CASE WHEN any_asked OR NOT imported THEN 'high' ELSE 'medium' END AS confidence FROM judged WHERE NOT asked"""
)
def dead_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unused_exports(*(table(spark, sf_dir, t) for t in ("imports", "files", "symbols")))


@query(
    _RESOLVE
    + f"""SELECT DISTINCT f.repo, f.path FROM files f WHERE NOT regexp_matches(path, '{paths.ENTRY_FILES}') AND NOT {_TEST.format("path")}
    AND EXISTS (SELECT 1 FROM symbols s WHERE s.exported AND s.repo = f.repo AND s.file_path = f.path) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo = f.repo AND e.dst = f.path)"""
)
def dead_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unused_files(*(table(spark, sf_dir, t) for t in ("imports", "files", "symbols")))


_CHANGED = f"WITH d AS (SELECT snap_id, repo, file_path, name, CASE change_kind WHEN 'changed' THEN 'modified' ELSE change_kind END AS status FROM ({core.SQL['p1_found']}))"


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.p1_found(spark, sf_dir).select("snap_id", "repo", "file_path", "name", F.when(F.col("change_kind") == "changed", "modified").otherwise(F.col("change_kind")).alias("status"))


@query(_CHANGED + " SELECT * FROM d")
def changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir)


@query(
    _CHANGED
    + """ SELECT snap_id, repo, file_path, count(*) FILTER (status = 'added')::BIGINT AS n_added, count(*) FILTER (status = 'modified')::BIGINT AS n_modified, count(*) FILTER (status = 'removed')::BIGINT AS n_removed FROM d GROUP BY ALL"""
)
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("added", "modified", "removed")]
    return _changed(spark, sf_dir).groupBy("snap_id", "repo", "file_path").agg(*each)


@query(
    """WITH old AS (SELECT repo, path, arg_min({mtime: mtime, size: size}, (indexed_at, file_id)) AS v FROM files GROUP BY ALL),
    new AS (SELECT repo, path, arg_max({mtime: mtime, size: size}, (indexed_at, file_id)) AS v FROM files WHERE deleted_at IS NULL GROUP BY ALL)
    SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.path, n.path) AS path, CASE WHEN o.v IS NULL THEN 'new' WHEN n.v IS NULL THEN 'stale' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'unchanged' ELSE 'changed' END AS status
    FROM old o FULL JOIN new n ON o.repo = n.repo AND o.path = n.path"""
)
def incremental_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select("repo", "path", "mtime", "size", "indexed_at", "file_id", "deleted_at")
    at = F.struct("indexed_at", "file_id")
    before = f.groupBy("repo", "path").agg(F.min_by("mtime", at).alias("mtime"), F.min_by("size", at).alias("size"))
    now = f.where("deleted_at IS NULL").groupBy("repo", "path").agg(F.max_by("mtime", at).alias("mtime"), F.max_by("size", at).alias("size"))
    return catalog.incremental_changes(before, now)


_TL = r"""tl AS (
  SELECT DISTINCT file_id, unnest(t) AS text, generate_subscripts(t, 1) AS line FROM (SELECT file_id, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) AS t FROM files WHERE content <> '')
)"""


@query(
    rf"WITH {_TL} SELECT file_id, line::BIGINT AS line, regexp_matches(ltrim(text), '^(import|from|use|require|export .* from)\b') AS is_import, substring(trim(text, ' '), 1, 90) AS preview FROM tl WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])ledger([^A-Za-z0-9_]|$)')"
)
def symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.references(texts.text_lines(table(spark, sf_dir, "files")), "ledger")


def _first(what: str) -> str:
    arms = " ".join(f"WHEN regexp_extract(text, '{p}', 1) <> '' THEN " + (f"'{k}'" if what == "kind" else f"regexp_extract(text, '{p}', 1)") for k, p in texts.DECLARATIONS)
    return f"CASE {arms} END"


@query(rf"WITH {_TL} SELECT file_id, line::BIGINT AS line, {_first('kind')} AS kind, {_first('name')} AS name, regexp_matches(text, '(^|\s)(export|pub|public)\s') AS exported FROM tl WHERE {_first('kind')} IS NOT NULL")
def declared_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.declarations(texts.text_lines(table(spark, sf_dir, "files")))


@query(
    r"""WITH h AS (SELECT doc_id, regexp_extract_all(text, '(?m)^(#{1,3} [^\r\n]+)', 1) AS m FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(m) AS mark, generate_subscripts(m, 1) - 1 AS position FROM h)
    SELECT doc_id, position::BIGINT AS position, len(regexp_extract(mark, '^#+'))::BIGINT AS level, trim(regexp_replace(mark, '^#+ ', ''), ' ') AS heading FROM e"""
)
def doc_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.headings(table(spark, sf_dir, "documents"))


@query(
    r"""WITH p AS (SELECT doc_id, unnest(q) AS body, generate_subscripts(q, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\n\n+') AS q FROM documents WHERE text IS NOT NULL)), n AS (
      SELECT doc_id, pos, len(regexp_extract_all(body, '[^ \t\r\n]+')) AS n FROM p
    ), r AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM n WHERE n > 0)
    SELECT doc_id, sum(n)::BIGINT AS n_words, count(*)::BIGINT AS n_paragraphs, count(*) FILTER (upto <= 100)::BIGINT AS kept_paragraphs FROM r GROUP BY doc_id"""
)
def doc_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.document_digest(table(spark, sf_dir, "documents"))


_SPANS = r"""src AS (SELECT file_id, arg_max(content, (path, content)) AS content, regexp_matches(max(path), '\.pyi?$') AS py FROM files WHERE content <> '' GROUP BY file_id),
l AS (SELECT file_id, py, unnest(t) AS x, generate_subscripts(t, 1)::BIGINT AS line, len(t)::BIGINT AS n FROM (SELECT file_id, py, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) AS t FROM src)),
d AS (SELECT *, sum(len(regexp_replace(code, '[^{]', '', 'g')) - len(regexp_replace(code, '[^}]', '', 'g'))) OVER (PARTITION BY file_id ORDER BY line) AS depth,
  CASE WHEN trim(x, ' ') <> '' AND NOT starts_with(ltrim(x, ' '), ')') THEN len(x) - len(ltrim(x, ' ')) END AS ind FROM (SELECT *, regexp_replace(x, '//.*$', '') AS code FROM l)),
s AS (SELECT symbol_id, arg_min(kind, (file_id, line)) AS kind, arg_min(file_id, (file_id, line)) AS file_id, arg_min(line, (file_id, line)) AS line FROM symbols WHERE kind IN ({kinds}) AND line IS NOT NULL GROUP BY symbol_id),
heads AS (SELECT s.symbol_id, d.*, coalesce(p.depth, 0) AS before FROM s JOIN d USING (file_id, line) LEFT JOIN d AS p ON p.file_id = d.file_id AND p.line = d.line - 1),
opened AS (SELECT heads.symbol_id, min(m.line) AS a FROM heads JOIN d AS m ON m.file_id = heads.file_id AND m.line >= heads.line AND m.depth > heads.before WHERE NOT heads.py GROUP BY ALL),
closed AS (SELECT heads.symbol_id, min(m.line) AS b FROM heads JOIN opened USING (symbol_id) JOIN d AS m ON m.file_id = heads.file_id AND m.line > a AND m.depth <= heads.before GROUP BY ALL),
fell AS (SELECT heads.symbol_id, min(m.line) AS b FROM heads JOIN d AS m ON m.file_id = heads.file_id AND m.line > heads.line AND m.ind <= heads.ind WHERE heads.py GROUP BY ALL),
inside AS (SELECT heads.symbol_id, max(m.line) AS b FROM heads LEFT JOIN fell USING (symbol_id) JOIN d AS m ON m.file_id = heads.file_id AND m.line > heads.line AND m.ind IS NOT NULL AND (fell.b IS NULL OR m.line < fell.b) WHERE heads.py AND heads.ind IS NOT NULL GROUP BY ALL),
spans AS (SELECT heads.symbol_id, heads.file_id, heads.line, CASE WHEN heads.py THEN coalesce(inside.b, heads.line) WHEN contains(x, '{{') AND contains(x, '}}') OR a IS NULL THEN heads.line ELSE coalesce(closed.b, heads.n) END AS body_end
  FROM heads LEFT JOIN opened USING (symbol_id) LEFT JOIN closed USING (symbol_id) LEFT JOIN inside USING (symbol_id))"""


def _spans(*kinds: str) -> str:
    return _SPANS.replace("{kinds}", _list(kinds)).replace("{{", "{").replace("}}", "}")


@query(
    f"""WITH {_spans("function", "method", "class")}
    SELECT symbol_id, p.file_id, p.line, p.body_end, p.body_end - p.line + 1 AS n_lines,
      string_agg(x, chr(10) ORDER BY d.line) || CASE WHEN p.body_end - p.line + 1 > 150 THEN chr(10) || '… ' || (p.body_end - p.line - 149) || ' more lines' ELSE '' END AS body
    FROM spans p JOIN d ON d.file_id = p.file_id AND d.line BETWEEN p.line AND least(p.body_end, p.line + 149) GROUP BY symbol_id, p.file_id, p.line, p.body_end"""
)
def symbol_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.symbol_bodies(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "files"))


@query(
    f"""WITH RECURSIVE {_spans("function", "method")}, r AS (SELECT file_id, line + 1 AS a, max(body_end) - 1 AS b FROM spans WHERE body_end - line > 2 GROUP BY ALL), hops AS (
      SELECT p.file_id, p.a, p.b, min(q.a) AS later FROM r p LEFT JOIN r q ON q.file_id = p.file_id AND q.a > p.b GROUP BY ALL
    ), kept AS (SELECT * FROM hops WHERE a = (SELECT min(a) FROM r WHERE r.file_id = hops.file_id) UNION ALL SELECT h.* FROM kept k JOIN hops h ON h.file_id = k.file_id AND h.a = k.later)
    SELECT d.file_id, string_agg(CASE WHEN k.a = d.line THEN regexp_extract(x, '^\\s*') || '… folded' ELSE x END, chr(10) ORDER BY d.line) AS folded
    FROM d LEFT JOIN kept k ON k.file_id = d.file_id AND d.line BETWEEN k.a AND k.b WHERE k.a IS NULL OR k.a = d.line GROUP BY d.file_id"""
)
def folded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.folded_files(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "files"))


@query(rf"WITH p AS (SELECT DISTINCT repo, path FROM files) SELECT repo, path, CASE WHEN regexp_matches(path, '(^|/)(cli|bin)\b') THEN 'cli' ELSE 'main' END AS kind FROM p WHERE regexp_matches(path, '{paths.ENTRY_FILES}') UNION ALL SELECT repo, path, 'test' FROM p WHERE {_TEST.format('path')} UNION ALL SELECT repo, path, 'route' FROM p WHERE regexp_matches(path, '(^|/)(routes|pages|controllers)/[^/]+$')")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "files").select("repo", "path").distinct()
    path = F.col("path")
    main = p.where(path.rlike(paths.ENTRY_FILES)).withColumn("kind", F.when(path.rlike(r"(^|/)(cli|bin)\b"), "cli").otherwise("main"))
    return main.unionByName(p.where(paths.is_test_path(path)).withColumn("kind", F.lit("test"))).unionByName(p.where(path.rlike(r"(^|/)(routes|pages|controllers)/[^/]+$")).withColumn("kind", F.lit("route")))


@query(f"WITH {_CUR} SELECT repo, regexp_extract(path, '^(apps|packages|libs|services)/[^/]+') AS member, count(*)::BIGINT AS n_files, sum(n_lines)::BIGINT AS n_lines, count(DISTINCT lang)::BIGINT AS n_langs FROM cur WHERE regexp_matches(path, '^(apps|packages|libs|services)/[^/]+/') GROUP BY ALL")
def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = catalog.measured_files(table(spark, sf_dir, "files")).where(F.col("path").rlike(r"^(apps|packages|libs|services)/[^/]+/"))
    return m.groupBy("repo", F.regexp_extract("path", r"^(apps|packages|libs|services)/[^/]+", 0).alias("member")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_lines").alias("n_lines"), F.countDistinct("lang").alias("n_langs"))


@query(
    f"""WITH {_CUR}, l AS (SELECT repo, arg_min(lang, (-n, lang)) AS lang FROM (SELECT repo, lang, count(*) AS n FROM cur WHERE lang IS NOT NULL GROUP BY repo, lang) GROUP BY repo),
    t AS (SELECT repo, count(*)::BIGINT AS n_files, sum(n_lines)::BIGINT AS n_lines, sum(n_bytes)::BIGINT AS n_bytes, count(*) FILTER ({_TEST.format("path")})::BIGINT AS n_tests,
      count(DISTINCT CASE WHEN regexp_matches(path, '^(apps|packages|libs|services)/[^/]+/') THEN regexp_extract(path, '^[^/]+/[^/]+') END) AS members, bool_or(regexp_matches(path, '{paths.ENTRY_FILES}')) AS entered FROM cur GROUP BY repo)
    SELECT repo, n_files, n_lines, n_bytes, n_tests, lang AS main_lang, CASE WHEN members > 1 THEN 'monorepo' WHEN entered THEN 'app' ELSE 'library' END AS kind FROM t LEFT JOIN l USING (repo)"""
)
def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = catalog.measured_files(table(spark, sf_dir, "files"))
    path = F.col("path")
    langs = m.where("lang IS NOT NULL").groupBy("repo", "lang").agg(F.count(F.lit(1)).alias("n")).groupBy("repo").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("main_lang"))
    member = F.when(path.rlike(r"^(apps|packages|libs|services)/[^/]+/"), F.regexp_extract("path", r"^[^/]+/[^/]+", 0))
    totals = m.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_lines").alias("n_lines"), F.sum("n_bytes").alias("n_bytes"), F.count_if(paths.is_test_path(path)).alias("n_tests"), F.countDistinct(member).alias("members"),
        F.bool_or(path.rlike(paths.ENTRY_FILES)).alias("entered"),
    )
    kind = F.when(F.col("members") > 1, "monorepo").when(F.col("entered"), "app").otherwise("library")
    return totals.join(langs, "repo", "left").select("repo", "n_files", "n_lines", "n_bytes", "n_tests", "main_lang", kind.alias("kind"))


@query("SELECT event_id, array_to_string(json_keys(props), ',') AS keys, len(json_keys(props))::BIGINT AS n_keys FROM events WHERE props IS NOT NULL")
def json_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("props IS NOT NULL")
    keys = F.json_object_keys("props")
    return e.select("event_id", F.array_join(keys, ",").alias("keys"), F.size(keys).cast("bigint").alias("n_keys"))


@query()
def parsed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamlens.operators.parsers import parsed

    return parsed(table(spark, sf_dir, "files"))
