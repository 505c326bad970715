"""Questions to the index of files, symbols and imports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamlens.functions.paths import ancestors, detected_language, glob_pattern
from loamlens.functions.text import estimated_tokens, line_count


def current_files(files: DataFrame) -> DataFrame:
    """One row per (repo, path): the row with the latest indexed_at, then the greatest file_id. Content is carried along."""
    others = [c for c in files.columns if c not in ("repo", "path", "indexed_at", "file_id")]
    return files.groupBy("repo", "path").agg(F.max(F.struct("indexed_at", "file_id", *others)).alias("_f")).select("repo", "path", "_f.*")


def measured_files(files: DataFrame) -> DataFrame:
    """repo, path, file_id, lang, n_lines, n_bytes of each file, measured on the content; the content itself stays behind.

    Figures are taken before repeated rows are merged, so that no text is shuffled.
    """
    figures = files.select(
        "repo", "path", "indexed_at", "file_id", detected_language(F.col("path")).alias("lang"), F.coalesce(line_count(F.col("content")), F.lit(0).cast("bigint")).alias("n_lines"),
        F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("n_bytes"), F.col("content").isNotNull().alias("has_content"),
    )
    return current_files(figures).select("repo", "path", "file_id", "lang", "n_lines", "n_bytes", "has_content")


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    """Each symbol once; of rows that share an id and differ the least counts."""
    others = [c for c in symbols.columns if c != "symbol_id"]
    return symbols.groupBy("symbol_id").agg(F.min(F.struct(*others)).alias("_s")).select("symbol_id", "_s.*")


def language_stats(files: DataFrame) -> DataFrame:
    """lang, n_files, n_lines, n_bytes; a null language is a language."""
    return measured_files(files).groupBy("lang").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_lines").alias("n_lines"), F.sum("n_bytes").alias("n_bytes"))


def index_stats(files: DataFrame) -> DataFrame:
    """One row: files, lines and bytes, 0 for an empty table, and the files without content."""
    return measured_files(files).agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), F.count_if(~F.col("has_content")).alias("n_skipped")
    )


def folder_rollup(files: DataFrame) -> DataFrame:
    """repo, folder, n_files, n_lines of every folder with all that lies below it; the root is ``.``."""
    each = measured_files(files).select("repo", F.explode(ancestors(F.col("path"))).alias("folder"), "n_lines")
    return each.groupBy("repo", "folder").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_lines").alias("n_lines"))


def folder_tree(files: DataFrame, *, depth: int = 3, max_entries: int = 200) -> DataFrame:
    """The first ``max_entries`` rows of each repo's tree down to ``depth``: repo, position, entry, depth, n_files.

    Folders come with their numbers of files; an entry stands behind its parent, in the order of the paths.
    """
    rolled = folder_rollup(files).where("folder <> '.'").withColumn("depth", F.size(F.split("folder", "/")))
    entry = rolled.where(F.col("depth") <= depth).select("repo", F.concat("folder", F.lit("/")).alias("entry"), "depth", "n_files")
    order = Window.partitionBy("repo").orderBy("entry")
    return entry.withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= max_entries).select("repo", "position", "entry", F.col("depth").cast("bigint").alias("depth"), "n_files")


def files_with_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo, path of the files that have a symbol."""
    return files.select("repo", "path").distinct().join(symbols.select("repo", F.col("file_path").alias("path")), ["repo", "path"], "left_semi")


def file_overview(files: DataFrame, symbols: DataFrame, imports: DataFrame, *, max_symbols: int = 100) -> DataFrame:
    """repo, path, lang, n_lines, n_symbols, n_exported, n_imports and the first names by line."""
    syms = distinct_symbols(symbols)
    per = Window.partitionBy("repo", "file_path").orderBy(F.asc_nulls_last("line"), "name", "symbol_id")
    numbered = syms.withColumn("_n", F.row_number().over(per))
    of_symbols = numbered.groupBy("repo", F.col("file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n_symbols"),
        F.count_if("exported").alias("n_exported"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") <= max_symbols, F.struct("_n", "name")))), lambda s: s["name"]), ",").alias("names"),
    )
    of_imports = imports.groupBy("repo", F.col("file_path").alias("path")).agg(F.countDistinct("import_id").alias("n_imports"))
    zero = F.lit(0).cast("bigint")
    return (
        measured_files(files)
        .join(of_symbols, ["repo", "path"], "left")
        .join(of_imports, ["repo", "path"], "left")
        .select("repo", "path", "lang", "n_lines", *[F.coalesce(c, zero).alias(c) for c in ("n_symbols", "n_exported", "n_imports")], F.coalesce("names", F.lit("")).alias("names"))
    )


def search_symbols(symbols: DataFrame, query: str, *, kind: str = "all", language: str | None = None, file_pattern: str | None = None, limit: int = 30) -> DataFrame:
    """The ``limit`` best symbols whose name contains ``query`` in any case: exact names first, then beginnings, then by path and line.

    ``query`` is taken literally. ``total`` is the number of all matches, so what was cut off is known.
    """
    hits = distinct_symbols(symbols).where(F.contains(F.lower("name"), F.lit(query.lower())))
    if kind != "all":
        hits = hits.where(F.col("kind") == kind)
    if language:
        hits = hits.where(detected_language(F.col("file_path")) == language)
    if file_pattern:
        hits = hits.where(F.col("file_path").rlike(glob_pattern(file_pattern, any_case=True)))
    rank = F.when(F.lower("name") == query.lower(), 0).when(F.lower("name").startswith(query.lower()), 1).otherwise(2)
    ranked = hits.withColumn("rank", rank)
    total = ranked.agg(F.count(F.lit(1)).alias("total"))
    best = ranked.orderBy("rank", "repo", "file_path", F.asc_nulls_last("line"), "name", "symbol_id").limit(limit)
    return best.join(F.broadcast(total)).select("symbol_id", "repo", "file_path", "name", "kind", "line", F.col("rank").cast("bigint").alias("rank"), "total")


def find_symbols(symbols: DataFrame, query: str, *, match: str = "contains", limit: int = 30) -> DataFrame:
    """The ``limit`` best symbols whose name ``contains``, begins with (``prefix``) or is (``exact``) ``query`` in any case.

    Exact names come first, then beginnings, then the rest; of each exported ones first, then by repo, path and line.
    """
    name, text = F.lower("name"), query.lower()
    hit = {"contains": F.contains(name, F.lit(text)), "prefix": name.startswith(text), "exact": name == text}[match]
    rank = F.when(name == text, 0).when(name.startswith(text), 1).otherwise(2).cast("bigint")
    found = distinct_symbols(symbols).where(hit).withColumn("rank", rank).withColumn("exported", F.coalesce("exported", F.lit(False)))
    return found.orderBy("rank", F.desc("exported"), "repo", "file_path", F.asc_nulls_last("line"), "name", "symbol_id").limit(limit).select("symbol_id", "repo", "file_path", "name", "kind", "rank", "exported")


def file_outline(symbols: DataFrame, *, detail: str = "signatures") -> DataFrame:
    """repo, path, position, name, kind, line, signature, doc: the symbols of each file by line, each kind and name once, the first wins.

    With ``detail`` ``names`` signature and doc are empty texts; nulls are empty texts as well.
    """
    first = Window.partitionBy("repo", "file_path", "kind", "name").orderBy(F.asc_nulls_last("line"), "symbol_id")
    once = distinct_symbols(symbols).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    order = Window.partitionBy("repo", "file_path").orderBy(F.asc_nulls_last("line"), "symbol_id")
    shown = lambda c: (F.lit("") if detail == "names" else F.coalesce(c, F.lit(""))).alias(c)
    return once.select("repo", F.col("file_path").alias("path"), F.row_number().over(order).cast("bigint").alias("position"), "name", "kind", "line", shown("signature"), shown("doc"))


def outline_within_budget(outline: DataFrame, *, max_tokens: int = 500) -> DataFrame:
    """repo, path, n_symbols, n_kept, n_tokens: how many entries of an outline fit, from the first on, into an estimate of ``max_tokens``."""
    size = estimated_tokens(F.concat_ws(" ", "kind", "name", "signature"))
    upto = F.sum("t").over(Window.partitionBy("repo", "path").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    running = outline.withColumn("t", size).withColumn("upto", upto)
    return running.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n_symbols"), F.count_if(F.col("upto") <= max_tokens).alias("n_kept"), F.sum("t").alias("n_tokens"))


def merged_imports(imports: DataFrame) -> DataFrame:
    """repo, file_path, from_module, names, is_default: the imports of a file from one module as one, names (text, in the order in which they came) once.

    ``is_default`` is that of the first row. Rows come in the order of import_id; repeated rows count once, null names are none.
    """
    once = imports.where("from_module <> ''").groupBy("import_id").agg(F.min(F.struct("repo", "file_path", "from_module", "names", F.coalesce("is_default", F.lit(False)).alias("is_default"))).alias("i")).select("import_id", "i.*")
    module = ["repo", "file_path", "from_module"]
    names = once.select(*module, "import_id", F.posexplode("names").alias("at", "name")).groupBy(*module, "name").agg(F.min(F.struct("import_id", "at")).alias("first"))
    listed = names.groupBy(*module).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]), ",").alias("names"))
    heads = once.groupBy(*module).agg(F.min_by("is_default", "import_id").alias("is_default"))
    same = [heads[c].eqNullSafe(listed[c]) for c in module]
    return heads.join(listed, same[0] & same[1] & same[2], "left").select(*[heads[c] for c in module], F.coalesce("names", F.lit("")).alias("names"), "is_default")


def types_per_kind(symbols: DataFrame, *, limit: int = 10, kinds: Sequence[str] = ("interface", "type", "enum", "struct", "trait")) -> DataFrame:
    """The first five times ``limit`` types of each kind by repo, path and line: kind, position, symbol_id, name."""
    order = Window.partitionBy("kind").orderBy("repo", "file_path", F.asc_nulls_last("line"), "symbol_id")
    return distinct_symbols(symbols).where(F.col("kind").isin(*kinds)).withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= 5 * limit).select("kind", "position", "symbol_id", "name")


def languages_by_files(files: DataFrame) -> DataFrame:
    """repo, position, lang, n_files: the languages of each repo, those with most files first."""
    counts = measured_files(files).where("lang IS NOT NULL").groupBy("repo", "lang").agg(F.count(F.lit(1)).alias("n_files"))
    return counts.select("repo", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n_files"), "lang")).cast("bigint").alias("position"), "lang", "n_files")


def top_folders(files: DataFrame, *, limit: int = 10) -> DataFrame:
    """repo, folder, n_files, n_lines: the ``limit`` folders at the root of each repo with most files."""
    order = Window.partitionBy("repo").orderBy(F.desc("n_files"), "folder")
    return folder_rollup(files).where("folder <> '.' AND NOT contains(folder, '/')").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def test_folders(files: DataFrame, *, names: Sequence[str] = ("tests", "test", "__tests__", "spec")) -> DataFrame:
    """repo, folder, n_files: of each repo the first of ``names`` that any file lies below, and the number of files below such a folder."""
    parts = F.split("path", "/", -1)
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    each = files.select("repo", "path").distinct().select("repo", F.explode(F.array_intersect(above, F.array(*map(F.lit, names)))).alias("folder"))
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("folder"))
    counts = each.groupBy("repo", "folder").agg(F.count(F.lit(1)).alias("n_files"))
    return counts.withColumn("_n", F.row_number().over(Window.partitionBy("repo").orderBy(rank))).where("_n = 1").drop("_n")


def type_definitions(symbols: DataFrame, *, prefix: str = "", limit: int = 50, kinds: Sequence[str] = ("interface", "type", "enum", "struct", "trait")) -> DataFrame:
    """The first ``limit`` types by repo, path and line, each file, name and kind once (its first line)."""
    types = distinct_symbols(symbols).where(F.col("kind").isin(*kinds) & F.col("file_path").startswith(prefix))
    first = Window.partitionBy("repo", "file_path", "name", "kind").orderBy(F.asc_nulls_last("line"), "symbol_id")
    once = types.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return once.orderBy("repo", "file_path", F.asc_nulls_last("line"), "name", "kind").limit(limit).select("symbol_id", "repo", "file_path", "name", "kind", "line", "signature")


def incremental_changes(before: DataFrame, now: DataFrame, *, key: Sequence[str] = ("repo", "path"), stamp: str = "mtime", size: str = "size") -> DataFrame:
    """key, status of every record in either version: ``new``, ``changed`` (stamp or size differ), ``unchanged`` or ``stale``."""
    old = before.select(*key, F.struct(stamp, size).alias("_old"), F.lit(True).alias("_o"))
    new = now.select(*key, F.struct(stamp, size).alias("_new"), F.lit(True).alias("_n"))
    both = old.join(new, list(key), "full_outer")
    status = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "stale").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return both.select(*key, status.alias("status"))


def upserted(before: DataFrame, now: DataFrame, *, key: Sequence[str] = ("repo", "path")) -> DataFrame:
    """The next version of a table: rows of ``now``, and rows of ``before`` whose key does not come again."""
    return before.join(now.select(*key).distinct(), list(key), "left_anti").unionByName(now, allowMissingColumns=True)
