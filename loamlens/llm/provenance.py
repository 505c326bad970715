"""Generated, minified, vendored and data files among source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlens.session import checkpointed

# Fixed value: what may stand before the first code of a file: white space, comments, a string that documents the module.
LEADING = r"(?s)^\x{FEFF}?(?:\s++|//[^\r\n]*+|#(?!\[)[^\r\n]*+|/\*.*?\*/|<!--.*?-->|\"{3}.*?\"{3}|'{3}.*?'{3}|[\"']use strict[\"'];?)*+"

MIN_CONTAINMENT = 0.6
MIN_SHINGLES = 8
#: A mark tells a file if it stands in this many copies already found, in two repos at least, and these are this share of its files.
MARK_FILES = 3
MARK_SHARE = 0.6


def clean_lines(content: Column) -> Column:
    """The lines (array) of a text, trimmed, white space folded, blank ones left out; any kind of line end."""
    return F.filter(F.split(F.regexp_replace(content, r"[\t\x0b\f][ \t\x0b\f]*+| [ \t\x0b\f]++", " "), " ?[\r\n]++ ?", -1), lambda x: F.trim(x) != "")


def _share(content: Column, pattern: str) -> Column:
    """The share of the characters of ``content`` in matches of ``pattern``."""
    return 1 - F.try_divide(F.length(F.regexp_replace(content, pattern, "")), F.length(content))


def line_pairs(lines: Column) -> Column:
    """The hashes (array) of each line together with the line behind it, each once; lines of less than eight characters are passed over.

    A line alone recurs in hand-written source; with its neighbour it is rare at any size of the corpus unless it was copied.
    """
    long = F.filter(lines, lambda x: F.length(x) >= 8)
    return F.array_distinct(F.zip_with(long, F.slice(long, 2, F.greatest(F.size(long), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))))


def marks(path: Column, leading: Column) -> Column:
    """What a file is marked by (array of texts): the folders above it, the ending of its name, and the lines before its first code, numbers left out."""
    folders = F.transform(F.slice(F.split(path, "/", -1), 1, F.greatest(F.size(F.split(path, "/", -1)) - 1, F.lit(0))), lambda x: F.concat(x, F.lit("/")))
    ending = F.regexp_extract(path, r"[._-][A-Za-z0-9]+\.\w+$", 0)
    head = F.transform(clean_lines(leading), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\W+|\W+$", ""), r"\d+", "0"))
    return F.array_distinct(F.filter(F.concat(F.coalesce(folders, F.array().cast("array<string>")), F.array(F.coalesce(ending, F.lit(""))), head), lambda x: F.length(x) > 2))


def described(files: DataFrame) -> DataFrame:
    """One row per row of ``files`` with content: what the index and the rules need, in one pass over the text, which stays behind.

    node (a hash of file_id and content), file_id, repo (hashed), pairs (see :func:`line_pairs`), marks (see :func:`marks`),
    n_lines (not blank), width (characters per such line), shapes (distinct lines over lines after names and numbers have
    become one letter and strings another), digits (share of numbers), blob (share of unbroken string literals of 40 characters and
    more), listed (whether the first code opens a list or an object), modules (functions that wrap a module of a bundle),
    wrapped (whether the first code does so), and of files with more than 90 characters per line: space (share of white space)
    and short (share of names of at most three characters).
    """
    content, n = F.col("content"), F.greatest(F.size("lines"), F.lit(1))
    literal = r"\"[^\"\n]*+(\")|'[^'\n]*+(')|`[^`\n]*+(`)|[\p{L}_$][\p{L}\p{N}_$]*+|\d++"
    text = files.where("content IS NOT NULL AND content <> ''").select("file_id", "repo", "path", content, clean_lines(content).alias("lines"), F.regexp_extract(content, LEADING, 0).alias("leading"))
    shape = F.split(F.regexp_replace(F.array_join("lines", "\n"), literal, "$1$2$3a"), "\n", -1)
    wide = F.length(content) / n > 90
    start = F.substring(content, F.length("leading") + 1, F.lit(60))
    long = r"[\"'`][^\"'`\s]{40}"
    return text.select(
        F.xxhash64("file_id", content).alias("node"),
        "file_id",
        F.xxhash64("repo").alias("repo"),
        F.filter(line_pairs(F.col("lines")), lambda x: x.isNotNull()).alias("pairs"),
        marks(F.col("path"), F.col("leading")).alias("marks"),
        F.size("lines").alias("n_lines"),
        (F.length(content) / n).alias("width"),
        (F.size(F.array_distinct(shape)) / n).alias("shapes"),
        _share(content, r"(?<![\p{L}\p{N}_$])(?:0x[0-9a-fA-F]++|\d[\d.]*+)").alias("digits"),
        F.when(content.rlike(long), _share(content, r"\"[^\"\s]{40,}+\"|'[^'\s]{40,}+'|`[^`\s]{40,}+`")).otherwise(0.0).alias("blob"),
        start.rlike(r"^\W*[\[{]").alias("listed"),
        F.when(F.contains(content, F.lit("exports")), F.regexp_count(content, F.lit(r"(?m)^\W{0,4}function ?\( ?module ?, ?exports\b"))).otherwise(0).alias("modules"),
        start.rlike(r"^\W{0,3}function ?\( ?mod").alias("wrapped"),
        F.when(wide, _share(content, r"\s++")).alias("space"),
        F.when(wide, F.regexp_count(content, F.lit(r"(?<![\p{L}\p{N}_$])[\p{L}_$][\p{L}\p{N}_$]{0,2}+(?![\p{L}\p{N}_$])")) / (F.regexp_count(content, F.lit(r"[\p{L}_$][\p{L}\p{N}_$]*+")) + 1)).alias("short"),
    )


def copied_between_repos(files: DataFrame, *, containment: float = MIN_CONTAINMENT, min_pairs: int = MIN_SHINGLES) -> DataFrame:
    """file_id, partner (a file_id), shared, n_pairs, containment: of the files that share line pairs with a file of another repo.

    See :func:`_copies`, which does the work on :func:`described` rows. Files that come in several versions give a row for each.
    """
    known = checkpointed(described(files))
    names = known.select("node", "file_id").distinct()
    found = _copies(known, containment, min_pairs).join(names, "node").join(names.select(F.col("node").alias("partner"), F.col("file_id").alias("_p")), "partner")
    return found.select("file_id", F.col("_p").alias("partner"), "shared", "n_pairs", "containment")


def _copies(known: DataFrame, containment: float, min_pairs: int) -> DataFrame:
    """node, partner, shared, n_pairs, containment.

    The inverted index has a row for each node and line pair. A line pair is rare if hand-written source holds it in one repo
    only: such rows lead nowhere and are left out by the least and greatest repo of each hash, by partial aggregation. A
    posting list is never crossed with itself: each node votes for the least node of its least repo and the greatest of its
    greatest, where these lie in another repo. As the copies of one origin share most pairs, their votes meet on few partners;
    for the two that got most votes (more for ties) the containment, shared pairs over own pairs, is then counted exactly. A
    node that could still reach ``containment`` is held against all that may be its partner, see :func:`_undecided`.
    """
    index = known.select("node", "repo", F.explode("pairs").alias("hash"))
    across = index.groupBy("hash").agg(F.min("repo").alias("lo_repo"), F.max("repo").alias("hi_repo")).where("lo_repo <> hi_repo")
    posted = checkpointed(index.join(across, "hash").distinct())
    ends = posted.groupBy("hash").agg(F.min(F.when(F.col("repo") == F.col("lo_repo"), F.col("node"))).alias("lo"), F.max(F.when(F.col("repo") == F.col("hi_repo"), F.col("node"))).alias("hi"))
    others = F.array_compact(F.array(F.when(F.col("repo") != F.col("lo_repo"), F.col("lo")), F.when(F.col("repo") != F.col("hi_repo"), F.col("hi"))))
    votes = posted.join(ends, "hash").select("node", F.explode(others).alias("partner")).groupBy("node", "partner").agg(F.count(F.lit(1)).alias("votes"))
    sizes = checkpointed(known.where(F.size("pairs") > 0).select("node", F.size("pairs").cast("bigint").alias("n_pairs")).distinct())
    best = Window.partitionBy("node").orderBy(F.desc("votes"))
    chosen = votes.withColumn("rank", F.rank().over(best)).where("rank <= 2").join(sizes, "node").where(F.col("votes") >= 0.2 * F.col("n_pairs"))
    posted = posted.select("node", "repo", "hash")
    mine = posted.select("node", "hash")
    exact = chosen.select("node", "partner", "n_pairs").join(mine, "node").join(mine.withColumnRenamed("node", "partner"), ["partner", "hash"])
    found = checkpointed(_contained(exact))
    decided = found.where((F.col("containment") >= containment) & (F.col("n_pairs") >= min_pairs)).select("node")
    rest = _undecided(posted, sizes.where(F.col("n_pairs") >= min_pairs).join(decided, "node", "left_anti"), containment)
    return found if rest is None else found.unionByName(rest.join(found, ["node", "partner"], "left_anti"))


def _contained(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("node", "partner", "n_pairs").agg(F.count(F.lit(1)).alias("shared")).withColumn("containment", F.col("shared") / F.col("n_pairs"))


def _undecided(posted: DataFrame, sizes: DataFrame, containment: float) -> DataFrame | None:
    """What :func:`_copies` gives, of the nodes in ``sizes`` whose pairs known in other repos reach ``containment``.

    A partner with that share lacks so few of the known pairs that it holds one of the rarest, one more than it may lack;
    all files of their posting lists are counted. Files that hold the same pairs count as two, the least and the greatest (repo, node),
    of which one lies in another repo if any of them does. Null if there is no such file.
    """
    known = posted.select("node", "hash")
    needed = F.ceil(containment * F.col("n_pairs") - 1e-9)
    open_ = checkpointed(known.groupBy("node").agg(F.count(F.lit(1)).alias("n_known")).join(sizes, "node").where(F.col("n_known") >= needed).withColumn("n_rare", F.col("n_known") - needed + 1))
    if open_.isEmpty():
        return None
    own = posted.join(open_, "node").select("node", "repo", "n_pairs", "n_rare", "hash")
    lengths = posted.join(own.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.count(F.lit(1)).alias("length"))
    rarest = Window.partitionBy("node", "repo").orderBy("length", "hash")
    rare = checkpointed(own.join(lengths, "hash").withColumn("rank", F.row_number().over(rarest)).where("rank <= n_rare").select("node", "repo", "n_pairs", "hash"))
    near = posted.join(rare.select("hash").distinct(), "hash", "left_semi").select("hash", F.col("node").alias("partner"), F.col("repo").alias("there"))
    texts = known.join(near.select(F.col("partner").alias("node")).distinct(), "node", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("hash").alias("x"), F.bit_xor(F.xxhash64("hash", F.lit(1))).alias("y"))
    at = F.struct(F.col("there").alias("there"), F.col("partner").alias("partner"))
    same = near.select("partner", "there").distinct().join(texts.withColumnRenamed("node", "partner"), "partner").groupBy("n", "x", "y").agg(F.array(F.min(at), F.max(at)).alias("ends"))
    ends = same.select(F.explode("ends").alias("e")).select("e.partner", "e.there").distinct()
    tried = rare.join(near.join(ends, ["partner", "there"], "left_semi"), "hash").where("repo <> there AND node <> partner").select("node", "partner", "n_pairs").distinct()
    return _contained(tried.join(known, "node").join(known.withColumnRenamed("node", "partner"), ["partner", "hash"]))


def _marked(known: DataFrame, copied: DataFrame, told: DataFrame) -> DataFrame:
    """file_id of files, not in ``told``, with a mark that stands nearly only in files already found to be ``copied`` (file_id).

    The index can't see a copy whose origin and other copies are not in the corpus, but what is copied by the same means is
    marked alike. Marks are counted over all files by partial aggregation; no list of notes or folders is given.
    """
    each = known.select("file_id", "repo", F.explode("marks").alias("mark")).join(copied.withColumn("copied", F.lit(True)), "file_id", "left").distinct()
    here = F.when(F.col("copied"), F.col("repo"))
    counts = each.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.count("copied").alias("n_copied"), F.min(here).alias("lo"), F.max(here).alias("hi"))
    telling = counts.where((F.col("n_copied") >= MARK_FILES) & (F.col("n_copied") >= MARK_SHARE * F.col("n")) & (F.col("lo") != F.col("hi")))
    return each.where("copied IS NULL").join(telling.select("mark"), "mark").select("file_id").distinct().join(told.select("file_id"), "file_id", "left_anti")


def not_handwritten(files: DataFrame, *, containment: float = MIN_CONTAINMENT, min_pairs: int = MIN_SHINGLES) -> DataFrame:
    """file_id and reason (``generated``, ``minified``, ``vendored`` or ``data``) of the files that nobody wrote for the repo.

    Files are first held against each other by the inverted index of rare lines: one of whose at least ``min_pairs`` pairs
    the share ``containment`` stands in one file of another repo is vendored, changed or not. The remaining files are judged
    by the composition of their tokens. The copies found teach which folders, endings of names and lines before the first code
    mark copies, and remaining files with such a mark are vendored too, see :func:`_marked`. What a file says of itself plays no
    part otherwise.

    A row without content is no case. Repeated rows of a file count once; the first reason in the order above that holds for
    any of them is given. Null paths and repos are taken as texts without a match. An empty table gives an empty result.
    """
    known = checkpointed(described(files))
    copies = _copies(known, containment, min_pairs).where((F.col("containment") >= containment) & (F.col("n_pairs") >= min_pairs)).select("node").distinct()
    few_shapes = F.col("shapes") * F.col("n_lines") < 12.5
    generated = (F.col("shapes") < 0.3) & few_shapes & (F.col("n_lines") >= 12)
    minified = ((F.col("space") < 0.08) & (F.col("short") > 0.25)) | (F.col("modules") >= 2) | ((F.col("modules") >= 1) & F.col("wrapped"))
    data = (F.col("digits") > 0.3) | (F.col("blob") > 0.5) | ((F.col("shapes") < 0.2) & few_shapes & (F.col("digits") > 0.05) & F.col("listed"))
    by_rule = known.select("file_id", F.when(data, "data").when(minified, "minified").when(generated, "generated").alias("reason")).where("reason IS NOT NULL")
    copied = checkpointed(known.select("node", "file_id").join(copies, "node").select("file_id").distinct())
    vendored = F.lit("vendored").alias("reason")
    told = checkpointed(_first_reason(by_rule.unionByName(copied.select("file_id", vendored))))
    return told.unionByName(_marked(known, copied, told).select("file_id", vendored))


def _first_reason(found: DataFrame) -> DataFrame:
    order = {"generated": 0, "minified": 1, "vendored": 2, "data": 3}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return found.groupBy("file_id").agg(F.min_by("reason", rank[F.col("reason")]).alias("reason"))


def handwritten(files: DataFrame) -> DataFrame:
    """The rows of ``files`` with content that are no case of :func:`not_handwritten`."""
    return files.where("content IS NOT NULL").join(not_handwritten(files).select("file_id"), "file_id", "left_anti")
