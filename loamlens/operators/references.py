"""References to records that do not exist."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlens.functions.paths import extension, parent, resolved

MATCHES = ("simple", "partial", "full")


def orphans(
    references: DataFrame,
    targets: DataFrame,
    on: Sequence[tuple[str, str]],
    *,
    match: str = "simple",
    at: str | None = None,
    born: str | None = None,
    gone: str | None = None,
) -> DataFrame:
    """The rows of ``references`` whose composite key is not met by any row of ``targets``.

    ``on`` pairs a column of the references with one of the targets. Keys may be null in part; ``match`` says what that
    means, as in the SQL standard: ``simple``: a key with a null refers to nothing and is no orphan; ``partial``: only the
    columns that are not null must be met (a key that is null throughout is no orphan); ``full``: a key that is null in part
    is an orphan, one that is null throughout is not. The references are grouped by their null mask and each mask is
    anti-joined on its own columns only.

    With ``at`` (a column of the references), ``born`` and ``gone`` (columns of the targets), a target counts while
    ``born <= at < gone``; a null ``gone`` is open. A null ``at`` is met by no target.

    Rows and columns of the references are returned as they are, repeated rows too. Empty targets make every checkable
    reference an orphan; empty references give an empty result. Clashing column names do no harm: the targets are renamed.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    there = targets.select(*[F.col(t).alias(f"__t{i}") for i, (_, t) in enumerate(on)], *[F.col(c).alias(f"__{n}") for c, n in ((born, "born"), (gone, "gone")) if c])
    found = []
    for mask in product((False, True), repeat=len(on)):
        if all(mask) and on:
            continue
        given = [i for i, null in enumerate(mask) if not null]
        part = references.where(reduce(Column.__and__, [F.col(r).isNull() if null else F.col(r).isNotNull() for (r, _), null in zip(on, mask)]))
        if any(mask):
            if match == "simple":
                continue
            if match == "full":
                found.append(part)
                continue
        keys = there.select(*[f"__t{i}" for i in given], *[f"__{n}" for c, n in ((born, "born"), (gone, "gone")) if c]).distinct()
        meets = [F.col(on[i][0]) == F.col(f"__t{i}") for i in given]
        if at and born:
            meets.append(F.col("__born") <= F.col(at))
        if at and gone:
            meets.append(F.col("__gone").isNull() | (F.col(at) < F.col("__gone")))
        found.append(part.join(keys, reduce(Column.__and__, meets), "left_anti"))
    return reduce(DataFrame.unionByName, found) if found else references.where(F.lit(False))


# The order in which a module specifier is tried against files.
SWAPPED = (".js", ".jsx", ".mjs", ".cjs")
SWAPPED_FOR = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", "/index.ts", "/index.js", "/index.tsx")
APPENDED = (
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".py", ".go", ".rs", ".java", ".rb", ".cs", ".php",
    "/index.ts", "/index.js", "/index.tsx", "/index.py", "/index.go", "/index.rs", "/__init__.py",
)


def module_bases(from_module: Column, file_path: Column) -> Column:
    """The one or two paths (array) a specifier stands for before any ending is tried; null for a null or empty specifier."""
    python = extension(file_path).isin("py", "pyi")
    dots = F.length(F.regexp_extract(from_module, r"^\.*", 0))
    climbed = F.concat(parent(file_path), F.repeat(F.lit("/.."), dots - 1), F.lit("/"), F.translate(F.regexp_replace(from_module, r"^\.+", ""), ".", "/"))
    joined = F.concat(parent(file_path), F.lit("/"), from_module)
    cut = F.substring(from_module, 3, 2147483647)
    bases = (
        F.when(from_module.startswith(".") & python, F.array(climbed))
        .when(from_module.startswith("."), F.array(joined))
        .when(from_module.startswith("/"), F.array(F.substring(from_module, 2, 2147483647)))
        .when(from_module.startswith("@/") | from_module.startswith("~/"), F.array(cut, F.concat(F.lit("src/"), cut)))
        .otherwise(F.array(from_module, F.concat(F.lit("src/"), from_module)))
    )
    return F.when(from_module != "", F.array_distinct(F.transform(bases, resolved)))


def met_bases(path: Column) -> Column:
    """The bases (array) for which a file at ``path`` is a candidate.

    This turns the candidate list around: instead of some seventy candidates for each reference, each file gets the handful
    of bases that lead to it, so that references are joined by their one or two bases.
    """

    def less(suffixes: Sequence[str]) -> list[Column]:
        return [F.when(path.endswith(s), F.substring(path, F.lit(1), F.length(path) - len(s))) for s in suffixes]

    swapped = [F.concat(x, F.lit(s)) for x in less(SWAPPED_FOR) for s in SWAPPED]
    return F.array_distinct(F.array_compact(F.array(path, *less(APPENDED), *swapped)))


def is_internal(from_module: Column, is_external: Column) -> Column:
    """Whether a specifier, neither null nor empty, leads to a file of its own repo."""
    marked = from_module.startswith(".") | from_module.startswith("/") | from_module.startswith("@/") | from_module.startswith("~/")
    return (from_module.isNotNull() & (from_module != "")) & (marked | F.coalesce(~is_external, F.lit(False)))


def lifetimes(files: DataFrame) -> DataFrame:
    """repo, path, born, gone: each file from its earliest indexed_at to its deleted_at, repeated rows merged.

    Where the rows of a file disagree on deleted_at the latest counts; a row without one doesn't take it back.
    """
    return files.groupBy("repo", "path").agg(F.min("indexed_at").alias("born"), F.max("deleted_at").alias("gone")).where(F.col("born").isNotNull())


def orphan_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """import_id, ref_field, seen_at of import rows that lead to no file living at ``seen_at``, each case once.

    ``file_path`` and ``from_module`` are two composite references (repo with a path) to the lifetimes of files. A null
    repo or file_path can't be met, so it is an orphan by ``file_path`` (match ``full``, where a key that is null throughout
    counts too); a null or empty from_module refers to nothing. An internal specifier in a row without file_path or repo is
    an orphan as well. A null seen_at meets nothing. Other columns are ignored.
    """
    lives = lifetimes(files)
    seen = imports.groupBy("import_id", "repo", "file_path", "from_module", "seen_at").agg(F.min("is_external").alias("is_external"))
    unmet = F.col("repo").isNull() | F.col("file_path").isNull()
    clock = {"at": "seen_at", "born": "born", "gone": "gone"}
    by_file = seen.select("import_id", "seen_at", "repo", "file_path")
    no_file = orphans(by_file, lives, [("repo", "repo"), ("file_path", "path")], match="full", **clock).select("import_id", "seen_at")
    no_file = no_file.unionByName(by_file.where(F.col("repo").isNull() & F.col("file_path").isNull()).select("import_id", "seen_at"))

    internal = seen.where(is_internal(F.col("from_module"), F.col("is_external")))
    bases = internal.withColumn("_bases", module_bases(F.col("from_module"), F.coalesce("file_path", F.lit(""))))
    ways = lives.select("repo", F.explode(met_bases(F.col("path"))).alias("base"), "born", "gone")
    each = bases.where(~unmet).select("import_id", "seen_at", "repo", F.size("_bases").alias("_n"), F.explode("_bases").alias("base"))
    missing = orphans(each, ways, [("repo", "repo"), ("base", "base")], **clock)
    no_module = (
        missing.groupBy("import_id", "seen_at", "repo")
        .agg(F.count(F.lit(1)).alias("_m"), F.max("_n").alias("_n"))
        .where("_m >= _n")
        .select("import_id", "seen_at")
        .unionByName(bases.where(unmet).select("import_id", "seen_at"))
    )
    return (
        no_file.withColumn("ref_field", F.lit("file_path"))
        .unionByName(no_module.withColumn("ref_field", F.lit("from_module")))
        .select("import_id", "ref_field", "seen_at")
        .distinct()
    )


def orphan_report(found: DataFrame, *, period: str = "month") -> DataFrame:
    """Orphans per referencing field and period of seen_at: ref_field, period, n_orphans. A null seen_at is a period."""
    return (
        found.groupBy("ref_field", F.date_trunc(period, "seen_at").alias("period"))
        .agg(F.countDistinct("import_id").alias("n_orphans"))
        .select("ref_field", "period", "n_orphans")
    )
