"""More queries to the index, each with its SQL: parts of the graph, dead code by filters, changes with impact, outlines, headings, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamlens.operators import catalog, graph, texts
from loamlens.plans import core
from loamlens.plans.index import _CUR, _GROUP, _RESOLVE, _SYM, _TEST, SQL as INDEX_SQL
from loamlens.session import checkpointed
from loamlens.sources.tables import table

QUERIES = {}
SQL = {}


def query(sql: str):  # noqa: ANN201
    """Register a query under its name with its SQL."""

    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(graph.import_edges(*_tables(spark, sf_dir, "imports", "files")))


def _near(step: str) -> str:
    return (
        _RESOLVE
        + f""", near AS (
      SELECT repo, path, 0 AS depth FROM (SELECT repo, src AS path FROM edges UNION SELECT repo, dst FROM edges) WHERE path LIKE 'packages/%'
      UNION SELECT n.repo, {step}, n.depth + 1 FROM near n JOIN edges e ON e.repo = n.repo AND {"n.path IN (e.src, e.dst)" if "CASE" in step else "e.src = n.path" if "dst" in step else "e.dst = n.path"} WHERE n.depth < 2
    ), active AS (SELECT DISTINCT repo, path FROM near), inner_edges AS (
      SELECT e.* FROM edges e JOIN active a ON a.repo = e.repo AND a.path = e.src JOIN active b ON b.repo = e.repo AND b.path = e.dst
    ) SELECT repo, src, dst, (SELECT count(*) > 200 FROM inner_edges) AS truncated FROM inner_edges ORDER BY repo, src, dst LIMIT 200"""
    )


@query(_near("e.dst"))
def module_graph_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.module_graph(_edges(spark, sf_dir), prefix="packages/")


@query(_near("e.src"))
def module_graph_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.module_graph(_edges(spark, sf_dir), prefix="packages/", direction="in")


@query(_near("CASE WHEN n.path = e.src THEN e.dst ELSE e.src END"))
def module_graph_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.module_graph(_edges(spark, sf_dir), prefix="packages/", direction="both")


@query(
    f"""WITH {_CUR}, {_SYM}, x AS (SELECT repo, file_path AS path, count(*) AS n FROM sym WHERE exported GROUP BY ALL)
    SELECT repo, {_GROUP("path")} AS folder_group, count(*)::BIGINT AS n_files, coalesce(sum(n), 0)::BIGINT AS n_exports, sum(n_bytes)::BIGINT AS n_bytes, arg_min(lang, path) FILTER (lang IS NOT NULL) AS lang
    FROM cur LEFT JOIN x USING (repo, path) GROUP BY ALL"""
)
def module_graph_group_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.group_sums(*_tables(spark, sf_dir, "files", "symbols"))


_DEAD = INDEX_SQL["dead_exports"].rsplit(") SELECT symbol_id", 1)[0] + "), dead AS (SELECT symbol_id" + INDEX_SQL["dead_exports"].rsplit(") SELECT symbol_id", 1)[1] + ")"


@query(
    _DEAD
    + """ SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY confidence, d.file_path, line NULLS LAST, symbol_id)::BIGINT AS position, symbol_id, d.file_path, d.name, confidence
    FROM dead d JOIN (SELECT symbol_id, line FROM sym) s USING (symbol_id) WHERE confidence = 'high' AND NOT regexp_matches(d.file_path, '^.*/src/tools/.*$') AND NOT regexp_matches(d.file_path, '^services/.*$')"""
)
def dead_code_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unused_report(*_tables(spark, sf_dir, "imports", "files", "symbols"), ignore=["**/src/tools/**", "services/**"], min_confidence="high")


@query(
    _DEAD
    + f""", deadf AS ({INDEX_SQL["dead_files"].split("SELECT DISTINCT f.repo, f.path FROM files f", 1)[1].join(["SELECT DISTINCT f.repo, f.path FROM files f", ""])}),
    here AS (SELECT DISTINCT repo, path FROM files WHERE NOT {_TEST.format("path")})
    SELECT repo, count(*)::BIGINT AS n_files,
      coalesce((SELECT count(*) FROM sym s JOIN here h ON h.repo = s.repo AND h.path = s.file_path WHERE s.exported AND s.repo = o.repo), 0)::BIGINT AS n_exports,
      coalesce((SELECT count(*) FROM dead d WHERE d.repo = o.repo), 0)::BIGINT AS n_unused_exports, coalesce((SELECT count(*) FROM deadf d WHERE d.repo = o.repo), 0)::BIGINT AS n_unused_files
    FROM here o GROUP BY repo"""
)
def dead_code_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unused_summary(*_tables(spark, sf_dir, "imports", "files", "symbols"))


@query(
    _RESOLVE
    + f""", chg AS ({core.SQL["p1_found"]}), per AS (SELECT snap_id, repo, file_path, count(*)::BIGINT AS n_changes FROM chg GROUP BY ALL
    ), reach AS (
      SELECT DISTINCT repo, file_path AS source, file_path AS path, 0 AS depth FROM per
      UNION SELECT r.repo, r.source, e.src, r.depth + 1 FROM reach r JOIN edges e ON e.repo = r.repo AND e.dst = r.path WHERE r.depth < 3
    ), dep AS (SELECT repo, source AS file_path, count(DISTINCT path)::BIGINT AS n_dependents FROM reach WHERE path <> source GROUP BY ALL
    ) SELECT snap_id, p.repo, p.file_path, n_changes, coalesce(n_dependents, 0) AS n_dependents, p.file_path || ': ' || n_changes || ' changes, ' || coalesce(n_dependents, 0) || ' dependents' AS text
    FROM per p LEFT JOIN dep d ON d.repo = p.repo AND d.file_path = p.file_path
    QUALIFY row_number() OVER (PARTITION BY snap_id, p.repo ORDER BY coalesce(n_dependents, 0) DESC, n_changes DESC, p.file_path) <= 5"""
)
def diff_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.changed_with_impact(checkpointed(core.p1_found(spark, sf_dir)), _edges(spark, sf_dir))


def _find(where: str) -> str:
    return f"""WITH {_SYM} SELECT symbol_id, repo, file_path, name, kind, (CASE WHEN lower(name) = 'fetch' THEN 0 WHEN starts_with(lower(name), 'fetch') THEN 1 ELSE 2 END)::BIGINT AS rank, coalesce(exported, false) AS exported
    FROM sym WHERE {where} ORDER BY rank, exported DESC, repo, file_path, line NULLS LAST, name, symbol_id LIMIT 30"""


@query(_find("starts_with(lower(name), 'fetch')"))
def search_symbols_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.find_symbols(table(spark, sf_dir, "symbols"), "fetch", match="prefix")


@query(_find("contains(lower(name), 'fetch')"))
def search_symbols_exported_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.find_symbols(table(spark, sf_dir, "symbols"), "fetch")


_OUTLINE = f"""WITH {_SYM}, once AS (SELECT * FROM sym QUALIFY row_number() OVER (PARTITION BY repo, file_path, kind, name ORDER BY line NULLS LAST, symbol_id) = 1
), outline AS (SELECT repo, file_path AS path, row_number() OVER (PARTITION BY repo, file_path ORDER BY line NULLS LAST, symbol_id)::BIGINT AS position, name, kind, line, coalesce(signature, '') AS signature, coalesce(doc, '') AS doc FROM once)"""


@query(_OUTLINE + " SELECT * FROM outline")
def file_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.file_outline(table(spark, sf_dir, "symbols"))


@query(_OUTLINE + " SELECT * REPLACE ('' AS signature, '' AS doc) FROM outline")
def file_outline_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.file_outline(table(spark, sf_dir, "symbols"), detail="names")


@query(
    _OUTLINE
    + """, t AS (SELECT repo, path, position, ceil(len(concat_ws(' ', kind, name, signature)) / 3.5)::BIGINT AS t FROM outline
    ), u AS (SELECT *, sum(t) OVER (PARTITION BY repo, path ORDER BY position) AS upto FROM t)
    SELECT repo, path, count(*)::BIGINT AS n_symbols, count(*) FILTER (upto <= 500)::BIGINT AS n_kept, sum(t)::BIGINT AS n_tokens FROM u GROUP BY ALL"""
)
def outline_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.outline_within_budget(catalog.file_outline(table(spark, sf_dir, "symbols")))


@query(
    """WITH once AS (SELECT DISTINCT ON (import_id) import_id, repo, file_path, from_module, names, coalesce(is_default, false) AS is_default FROM imports WHERE from_module <> '' ORDER BY import_id
    ), heads AS (SELECT repo, file_path, from_module, arg_min(is_default, import_id) AS is_default FROM once GROUP BY ALL
    ), n AS (SELECT repo, file_path, from_module, import_id, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM once
    ), firsts AS (SELECT repo, file_path, from_module, name, min(import_id * 1000 + pos) AS o FROM n GROUP BY ALL
    ), listed AS (SELECT repo, file_path, from_module, string_agg(name, ',' ORDER BY o) AS names FROM firsts GROUP BY ALL)
    SELECT h.repo, h.file_path, h.from_module, coalesce(l.names, '') AS names, h.is_default FROM heads h
    LEFT JOIN listed l ON l.repo IS NOT DISTINCT FROM h.repo AND l.file_path IS NOT DISTINCT FROM h.file_path AND l.from_module = h.from_module"""
)
def merged_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.merged_imports(table(spark, sf_dir, "imports"))


@query(f"WITH {_SYM} SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY repo, file_path, line NULLS LAST, symbol_id)::BIGINT AS position, symbol_id, name FROM sym WHERE kind IN ('interface', 'type', 'enum', 'struct', 'trait') QUALIFY position <= 50")
def types_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.types_per_kind(table(spark, sf_dir, "symbols"))


@query(f"WITH {_CUR}, c AS (SELECT repo, lang, count(*)::BIGINT AS n_files FROM cur WHERE lang IS NOT NULL GROUP BY ALL) SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY n_files DESC, lang)::BIGINT AS position, lang, n_files FROM c")
def languages_by_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.languages_by_files(table(spark, sf_dir, "files"))


@query(
    f"""WITH {_CUR}, c AS (SELECT repo, string_split(path, '/')[1] AS folder, count(*)::BIGINT AS n_files, sum(n_lines)::BIGINT AS n_lines FROM cur WHERE contains(path, '/') GROUP BY ALL)
    SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n_files DESC, folder) <= 10"""
)
def top_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.top_folders(table(spark, sf_dir, "files"))


@query(
    """WITH p AS (SELECT DISTINCT repo, path FROM files), f AS (
      SELECT repo, folder, rank, count(*)::BIGINT AS n_files FROM p, (VALUES ('tests', 1), ('test', 2), ('__tests__', 3), ('spec', 4)) t(folder, rank) WHERE contains('/' || path, '/' || folder || '/') GROUP BY ALL
    ) SELECT repo, folder, n_files FROM f QUALIFY row_number() OVER (PARTITION BY repo ORDER BY rank) = 1"""
)
def test_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.test_folders(table(spark, sf_dir, "files"))


@query(
    INDEX_SQL["doc_headings"].rsplit("SELECT doc_id", 1)[0].rstrip()
    + r""", h2 AS (SELECT d.source, doc_id, e.position, trim(regexp_replace(mark, '^#+ ', ''), ' ') AS heading FROM e JOIN documents d USING (doc_id) WHERE d.source IS NOT NULL
    ), s AS (SELECT source, heading, min((doc_id, position)) AS o FROM h2 WHERE heading <> '' GROUP BY ALL)
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY o, heading)::BIGINT AS position, heading FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY o, heading) <= 50"""
)
def first_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.first_headings(table(spark, sf_dir, "documents"))


@query(
    "WITH r AS (SELECT file_id, unnest(list_concat("
    + ", ".join("regexp_extract_all(content, '" + p.replace("'", "''") + "', 1)" for p in texts.ROUTES)
    + ")) AS route FROM files WHERE content IS NOT NULL) SELECT DISTINCT file_id, route FROM r"
)
def routes_in_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.routes_in_code(table(spark, sf_dir, "files"))


@query("SELECT DISTINCT repo, file_path, from_module FROM imports WHERE starts_with(file_path, 'packages/') AND regexp_matches(file_path, '\\.(ts|go)$')")
def imports_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "imports")
    return i.where(i.file_path.startswith("packages/") & (i.file_path.endswith(".ts") | i.file_path.endswith(".go"))).select("repo", "file_path", "from_module").distinct()
