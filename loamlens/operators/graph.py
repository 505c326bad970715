"""The graph of imports between files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlens.functions.paths import ENTRY_FILES, glob_pattern, is_test_path, package_name, quotient_id
from loamlens.operators.catalog import distinct_symbols, measured_files
from loamlens.operators.references import APPENDED, SWAPPED, SWAPPED_FOR, is_internal, module_bases
from loamlens.session import checkpointed

NODE = ("repo", "path")


def _ranked_bases(path: Column) -> Column:
    """The bases that lead to a file, each with the place of the file in the order of candidates."""

    def less(suffix: str) -> Column:
        return F.when(path.endswith(suffix), F.substring(path, F.lit(1), F.length(path) - len(suffix)))

    ways = [(path, 0)]
    ways += [(F.concat(less(s), F.lit(e)), 1 + i) for i, s in enumerate(SWAPPED_FOR) for e in SWAPPED]
    ways += [(less(s), 1 + len(SWAPPED_FOR) + i) for i, s in enumerate(APPENDED)]
    return F.filter(F.array(*[F.struct(b.alias("base"), F.lit(r).alias("rank")) for b, r in ways]), lambda w: w["base"].isNotNull())


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """repo, file_path, from_module, target: of each internal specifier the first of its candidates that is a file.

    Files are turned into the bases that lead to them, so a specifier is joined by its one or two bases instead of by some
    seventy candidates. Specifiers without a file are left out.
    """
    asked = imports.where(is_internal(F.col("from_module"), F.col("is_external")) & F.col("file_path").isNotNull()).select("repo", "file_path", "from_module").distinct()
    bases = asked.select("*", F.posexplode(module_bases(F.col("from_module"), F.col("file_path"))).alias("turn", "base"))
    there = files.select("repo", "path").distinct().select("repo", "path", F.explode(_ranked_bases(F.col("path"))).alias("w")).select("repo", "path", "w.*")
    return bases.join(there, ["repo", "base"]).groupBy("repo", "file_path", "from_module").agg(F.min_by("path", F.struct("turn", "rank", "path")).alias("target"))


def import_edges(imports: DataFrame, files: DataFrame, *, resolved: DataFrame | None = None) -> DataFrame:
    """repo, src, dst: each pair of files of which the first imports the second, itself left out.

    ``resolved`` is what :func:`resolved_imports` gives, if it is there already.
    """
    found = (resolved_imports(imports, files) if resolved is None else resolved).where(F.col("file_path") != F.col("target"))
    return found.join(files.select("repo", F.col("path").alias("file_path")).distinct(), ["repo", "file_path"], "left_semi").select("repo", F.col("file_path").alias("src"), F.col("target").alias("dst")).distinct()


def folder_edges(edges: DataFrame) -> DataFrame:
    """repo, src, dst, n_edges between groups of two folders, loops left out."""
    grouped = edges.select("repo", quotient_id(F.col("src")).alias("src"), quotient_id(F.col("dst")).alias("dst")).where("src <> dst")
    return grouped.groupBy("repo", "src", "dst").agg(F.count(F.lit(1)).alias("n_edges"))


def hubs(edges: DataFrame, *, limit: int = 10) -> DataFrame:
    """The ``limit`` files with most importers: repo, path, n_importers."""
    return edges.groupBy("repo", F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("n_importers")).orderBy(F.desc("n_importers"), "repo", "path").limit(limit)


def external_packages(imports: DataFrame, *, limit: int = 20) -> DataFrame:
    """The ``limit`` packages that most rows import: package, n_imports. Repeated rows count once."""
    outside = imports.where((F.col("from_module") != "") & ~is_internal(F.col("from_module"), F.col("is_external")) & F.col("is_external"))
    return outside.select("import_id", package_name(F.col("from_module")).alias("package")).distinct().groupBy("package").agg(F.count(F.lit(1)).alias("n_imports")).orderBy(F.desc("n_imports"), "package").limit(limit)


def breadth_first(edges: DataFrame, sources: DataFrame, *, max_depth: int = 5, backward: bool = False) -> DataFrame:
    """repo, source, path, depth of the files reached from each source (repo, path) in at most ``max_depth`` steps.

    The source itself is left out. Each round joins the frontier with the edges and writes what is new to the checkpoint
    folder; it ends when nothing is.
    """
    a, b = ("dst", "src") if backward else ("src", "dst")
    steps = edges.select("repo", F.col(a).alias("path"), F.col(b).alias("_next")).distinct()
    frontier = sources.select("repo", F.col("path").alias("source"), "path").distinct().withColumn("depth", F.lit(0).cast("bigint"))
    seen = frontier
    for depth in range(1, max_depth + 1):
        ahead = frontier.join(steps, ["repo", "path"]).select("repo", "source", F.col("_next").alias("path")).distinct()
        frontier = checkpointed(ahead.join(seen, ["repo", "source", "path"], "left_anti").withColumn("depth", F.lit(depth).cast("bigint")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def reached(edges: DataFrame, starts: DataFrame, *, direction: str = "out", max_depth: int = 2) -> DataFrame:
    """repo, path, depth of all files at most ``max_depth`` steps from any of ``starts`` (repo, path), these included.

    ``direction`` is ``out`` (along imports), ``in`` (against them) or ``both``. A file has the least depth; work grows with
    files, not with pairs of start and file.
    """
    along = edges.select("repo", F.col("src").alias("path"), F.col("dst").alias("_next"))
    against = edges.select("repo", F.col("dst").alias("path"), F.col("src").alias("_next"))
    steps = {"out": along, "in": against, "both": along.unionByName(against)}[direction].distinct()
    frontier = starts.select("repo", "path").distinct().withColumn("depth", F.lit(0).cast("bigint"))
    seen = frontier
    for depth in range(1, max_depth + 1):
        ahead = frontier.join(steps, ["repo", "path"]).select("repo", F.col("_next").alias("path")).distinct()
        frontier = checkpointed(ahead.join(seen, ["repo", "path"], "left_anti").withColumn("depth", F.lit(depth).cast("bigint")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def module_graph(edges: DataFrame, *, prefix: str, direction: str = "out", max_depth: int = 2, max_edges: int = 200) -> DataFrame:
    """repo, src, dst, truncated: the edges between files near those whose path begins with ``prefix``.

    Both ends of an edge must be reached (see :func:`reached`). The first ``max_edges`` by repo and path are given;
    ``truncated`` says whether there are more.
    """
    ends = edges.select("repo", F.col("src").alias("path")).union(edges.select("repo", "dst")).where(F.col("path").startswith(prefix))
    active = checkpointed(reached(edges, ends, direction=direction, max_depth=max_depth).select("repo", "path"))
    inner = edges.join(active.withColumnRenamed("path", "src"), ["repo", "src"], "left_semi").join(active.withColumnRenamed("path", "dst"), ["repo", "dst"], "left_semi")
    inner = checkpointed(inner.select("repo", "src", "dst"))
    total = inner.agg((F.count(F.lit(1)) > max_edges).alias("truncated"))
    return inner.orderBy("repo", "src", "dst").limit(max_edges).join(F.broadcast(total))


def group_sums(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo, folder_group, n_files, n_exports, n_bytes, lang of each group of two folders; lang is that of its first file that has one."""
    exports = distinct_symbols(symbols).where("exported").groupBy("repo", F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    each = measured_files(files).join(exports, ["repo", "path"], "left")
    return each.groupBy("repo", quotient_id(F.col("path")).alias("folder_group")).agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n_exports"), F.sum("n_bytes").alias("n_bytes"), F.min_by("lang", F.when(F.col("lang").isNotNull(), F.col("path"))).alias("lang")
    )


def impact(edges: DataFrame, sources: DataFrame, *, max_depth: int = 5) -> DataFrame:
    """repo, source, n_direct, n_indirect, n_tests, blast_radius: what depends on each source, over at most ``max_depth`` steps."""
    reached = breadth_first(edges, sources, max_depth=max_depth, backward=True)
    total = F.count(F.lit(1))
    return reached.groupBy("repo", "source").agg(
        F.count_if(F.col("depth") == 1).alias("n_direct"),
        F.count_if(F.col("depth") > 1).alias("n_indirect"),
        F.count_if(is_test_path(F.col("path"))).alias("n_tests"),
        F.when(total > 25, "critical").when(total > 10, "high").when(total > 3, "medium").otherwise("low").alias("blast_radius"),
    )


def cycles(edges: DataFrame) -> DataFrame:
    """repo, path, component: the files on import cycles, and the least path of their strongly connected component.

    Files without an importer or an import within what is left are cut away first. Then, in rounds, every file takes the
    greatest label that reaches it; a file that kept its own is the root of the files that reach it back within its label.
    Those are a component and leave the graph. The file with the greatest label always keeps its own, so every round removes
    a component, and rounds go on until nothing is left. Labels begin with a hash of the path, so that cycles that import one
    another in the order of their paths don't take a round each.
    """
    own = F.concat(F.lpad(F.hex(F.xxhash64("n")), 16, "0"), F.lit(" "), "n")
    left = checkpointed(edges.select("repo", "src", "dst").where("src <> dst").distinct())
    found = None
    while True:
        while True:
            ends = left.select("repo", F.col("src").alias("n")).intersect(left.select("repo", F.col("dst").alias("n")))
            kept = left.join(ends.withColumnRenamed("n", "src"), ["repo", "src"], "left_semi").join(ends.withColumnRenamed("n", "dst"), ["repo", "dst"], "left_semi")
            kept = checkpointed(kept.select("repo", "src", "dst"))
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        if left.isEmpty():
            break
        labels = checkpointed(left.select("repo", F.col("src").alias("n")).distinct().withColumn("label", own))
        while True:
            sent = left.join(labels.select("repo", F.col("n").alias("src"), "label"), ["repo", "src"]).groupBy("repo", F.col("dst").alias("n")).agg(F.max("label").alias("sent"))
            after = checkpointed(labels.join(sent, ["repo", "n"], "left").select("repo", "n", F.greatest("label", F.coalesce("sent", "label")).alias("label"), (F.col("sent") > F.col("label")).alias("moved")))
            labels = after.select("repo", "n", "label")
            if after.where("moved").isEmpty():
                break
        inside = checkpointed(
            left.join(labels.select("repo", F.col("n").alias("src"), "label"), ["repo", "src"]).join(labels.select("repo", F.col("n").alias("dst"), "label"), ["repo", "dst", "label"]).select("repo", "src", "dst", "label")
        )
        members = checkpointed(labels.where(F.col("label") == own))
        frontier = members
        while True:
            back = inside.join(frontier.select("repo", F.col("n").alias("dst"), "label"), ["repo", "dst", "label"]).select("repo", F.col("src").alias("n"), "label").distinct()
            frontier = checkpointed(back.join(members, ["repo", "n"], "left_anti"))
            if frontier.isEmpty():
                break
            members = checkpointed(members.unionByName(frontier.select("repo", "n", "label")))
        found = members if found is None else found.unionByName(members)
        gone = members.select("repo", "n")
        left = checkpointed(left.join(gone.withColumnRenamed("n", "src"), ["repo", "src"], "left_anti").join(gone.withColumnRenamed("n", "dst"), ["repo", "dst"], "left_anti").select("repo", "src", "dst"))
    if found is None:
        return edges.where("false").select("repo", F.col("src").alias("path"), F.col("dst").alias("component"))
    sized = found.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("repo", "label"))).where("size > 1")
    return sized.select("repo", F.col("n").alias("path"), F.min("n").over(Window.partitionBy("repo", "label")).alias("component"))


def demanded_names(imports: DataFrame, files: DataFrame, symbols: DataFrame, *, resolved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(repo, path, name) of the names that some file asks of another, and (repo, path) of the files imported without names.

    Files without symbols that are no entry points only pass on: they ask nothing for themselves, but a name asked of them is
    asked of the files they import it from, round by round until nothing is added.
    """
    asked = imports.groupBy("import_id").agg(F.min(F.struct("repo", "file_path", "from_module", F.coalesce("names", F.array().cast("array<string>")).alias("names"))).alias("i")).select("i.*")
    found = resolved_imports(imports, files) if resolved is None else resolved
    target = checkpointed(asked.join(found, ["repo", "file_path", "from_module"]).select("repo", "file_path", "target", "names").distinct())
    whole = target.where(F.size("names") == 0).select("repo", F.col("target").alias("path")).distinct()
    passing = checkpointed(
        files.select("repo", "path").distinct().where(~F.col("path").rlike(ENTRY_FILES)).join(symbols.select("repo", F.col("file_path").alias("path")), ["repo", "path"], "left_anti").withColumnRenamed("path", "file_path")
    )
    routes = checkpointed(target.join(passing, ["repo", "file_path"], "left_semi"))
    asking = target.join(passing, ["repo", "file_path"], "left_anti")
    known = checkpointed(asking.select("repo", F.col("target").alias("path"), F.explode("names").alias("name")).distinct())
    fresh = known
    while True:
        sent = routes.join(fresh.select("repo", F.col("path").alias("file_path"), "name"), ["repo", "file_path"]).where((F.size("names") == 0) | F.array_contains("names", F.col("name")))
        fresh = checkpointed(sent.select("repo", F.col("target").alias("path"), "name").distinct().join(known, ["repo", "path", "name"], "left_anti"))
        if fresh.isEmpty():
            break
        known = checkpointed(known.unionByName(fresh))
    return known, whole


def unused_exports(imports: DataFrame, files: DataFrame, symbols: DataFrame, *, include_tests: bool = False) -> DataFrame:
    """symbol_id, repo, file_path, name, confidence of exported symbols that no file asks for.

    Files that are imported without names are left out. ``high``: nothing is asked of the file and nobody imports it, or other
    exports of it are asked for; ``medium``: it is imported, but no name asked for is one of its exports.
    """
    resolved = checkpointed(resolved_imports(imports, files))
    known, whole = demanded_names(imports, files, symbols, resolved=resolved)
    exports = distinct_symbols(symbols).where("exported").select("symbol_id", "repo", F.col("file_path").alias("path"), "name")
    exports = exports.join(files.select("repo", "path").distinct(), ["repo", "path"], "left_semi").join(whole, ["repo", "path"], "left_anti")
    if not include_tests:
        exports = exports.where(~is_test_path(F.col("path")))
    marked = exports.join(known.withColumn("asked", F.lit(True)), ["repo", "path", "name"], "left")
    imported = import_edges(imports, files, resolved=resolved).select("repo", F.col("dst").alias("path")).distinct().withColumn("imported", F.lit(True))
    of_file = Window.partitionBy("repo", "path")
    judged = marked.withColumn("some", F.max(F.coalesce("asked", F.lit(False))).over(of_file)).join(imported, ["repo", "path"], "left")
    confidence = F.when(F.col("some") | F.col("imported").isNull(), "high").otherwise("medium")
    return judged.where("asked IS NULL").select("symbol_id", "repo", F.col("path").alias("file_path"), "name", confidence.alias("confidence"))


def unused_files(imports: DataFrame, files: DataFrame, symbols: DataFrame, *, include_tests: bool = False) -> DataFrame:
    """repo, path of files with exports that no file imports and that are no entry points."""
    exporting = symbols.where("exported").select("repo", F.col("file_path").alias("path"))
    out = files.select("repo", "path").distinct().where(~F.col("path").rlike(ENTRY_FILES)).join(exporting, ["repo", "path"], "left_semi")
    if not include_tests:
        out = out.where(~is_test_path(F.col("path")))
    return out.join(import_edges(imports, files).select("repo", F.col("dst").alias("path")), ["repo", "path"], "left_anti")


def unused_report(imports: DataFrame, files: DataFrame, symbols: DataFrame, *, ignore: Sequence[str] = (), min_confidence: str = "medium", include_tests: bool = False) -> DataFrame:
    """repo, position, symbol_id, file_path, name, confidence of unused exports: in each repo ``high`` first, then by path and line.

    Files that match a glob in ``ignore`` are left out after demand is known, so that what they import stays in use.
    ``min_confidence`` ``high`` leaves the others out.
    """
    found = unused_exports(imports, files, symbols, include_tests=include_tests)
    for glob in ignore:
        found = found.where(~F.col("file_path").rlike(glob_pattern(glob)))
    if min_confidence == "high":
        found = found.where("confidence = 'high'")
    lines = distinct_symbols(symbols).select("symbol_id", "line")
    order = Window.partitionBy("repo").orderBy("confidence", "file_path", F.asc_nulls_last("line"), "symbol_id")
    return found.join(lines, "symbol_id").withColumn("position", F.row_number().over(order).cast("bigint")).select("repo", "position", "symbol_id", "file_path", "name", "confidence")


def unused_summary(imports: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo, n_files, n_exports, n_unused_exports, n_unused_files: files that hold no tests, their exports, and what of both nobody uses."""
    here = files.select("repo", "path").distinct().where(~is_test_path(F.col("path")))
    exports = distinct_symbols(symbols).where("exported").select("repo", F.col("file_path").alias("path")).join(here, ["repo", "path"], "left_semi")
    count = lambda df, name: df.groupBy("repo").agg(F.count(F.lit(1)).alias(name))
    out = count(here, "n_files")
    for part in (count(exports, "n_exports"), count(unused_exports(imports, files, symbols), "n_unused_exports"), count(unused_files(imports, files, symbols), "n_unused_files")):
        out = out.join(part, "repo", "left")
    return out.na.fill(0)


def changed_with_impact(changes: DataFrame, edges: DataFrame, *, max_depth: int = 3, limit: int = 5) -> DataFrame:
    """snap_id, repo, file_path, n_changes, n_dependents, text: of each snapshot and repo the ``limit`` changed files that most files depend on.

    ``changes`` has a row per changed symbol. Dependents are counted over at most ``max_depth`` steps against the imports,
    once per file, however many snapshots changed it. Files nobody depends on count 0.
    """
    per_file = changes.groupBy("snap_id", "repo", "file_path").agg(F.count(F.lit(1)).alias("n_changes"))
    hit = breadth_first(edges, per_file.select("repo", F.col("file_path").alias("path")).distinct(), max_depth=max_depth, backward=True)
    counts = hit.groupBy("repo", F.col("source").alias("file_path")).agg(F.count(F.lit(1)).alias("n_dependents"))
    joined = per_file.join(counts, ["repo", "file_path"], "left").na.fill(0, ["n_dependents"])
    order = Window.partitionBy("snap_id", "repo").orderBy(F.desc("n_dependents"), F.desc("n_changes"), "file_path")
    best = joined.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    text = F.concat("file_path", F.lit(": "), F.col("n_changes").cast("string"), F.lit(" changes, "), F.col("n_dependents").cast("string"), F.lit(" dependents"))
    return best.select("snap_id", "repo", "file_path", "n_changes", "n_dependents", text.alias("text"))
