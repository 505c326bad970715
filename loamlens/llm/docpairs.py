"""Functions paired with their documentation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlens.llm.syntax import folded, tokens, unparsable_texts
from loamlens.operators.texts import symbol_bodies
from loamlens.session import checkpointed

# Units of a comment that are no description. All are matched in lower case against a whole unit.
PLACEHOLDERS = (
    r"(?:todo|fixme|xxx|tbd|tba|wip|hack)\b.*", r"(?:n/?a|none|nothing|null|foo|bar|test|text)\W*",
    r"(?:(?:no|missing|add|insert|write|put|a|the|some|undocumented|empty|dummy|sample|default|generated) )*(?:docs?|docstring|documentation|description|desc|comment|summary|helper|function|method|stub|placeholder|utility|util|doc ?string)(?: (?:here|missing|needed|function|method|goes|of|for|the|this|to|follow|follows|pending))*\W*",
    r".*\b(?:to be|will be|has to be|should be|must be) (?:documented|described|written|filled in)\b.*", r"(?:method|function) stub\b.*",
)
POINTERS = (
    r"\{?@(?:inheritdoc|override|private|protected|public|internal|hidden|ignore|api|deprecated|see|link)\b\}?[^.]{0,60}\W*",
    r"(?:see|cf\.?|compare|refer to|same as|as|ditto)(?: (?:the|also|in|its|my))*(?: (?:above|below|base|super|parent|class|superclass|method|function|interface|implementation|there|previous|next|overload|docs?|documentation|header|spec))+\W*", r"(?:dito|siehe oben|voir ci-dessus|véase arriba)\W*",
)
TOOL_NOTES = (
    r"(?:eslint|tslint|jshint|jslint|stylelint|prettier|istanbul|c8|v8|pylint|flake8|ruff|mypy|pyright|isort|bandit|rustfmt|clippy|cspell|clang-format|checkstyle|phpcs|rubocop|sonar|webpack|biome)[-: ].*",
    r"(?:noqa|nosonar|nolint|nosec|noinspection)\b.*", r"@?ts-(?:ignore|nocheck|expect-error|check)\b.*", r"pragma:? .*", r"type: ?ignore.*", r"fmt: ?(?:on|off|skip)\W*", r"go:[a-z]+\b.*", r"-\*-.*-\*-", r"@(?:ts-|suppress|jsx|flow|format|preserve|noformat)\S*.*",
)
STAMPS = (
    r"@(?:author|authors|since|version|date|created|copyright|license|category|package)\b.*",
    r"(?:authors?|created|written|added|modified|changed|updated|last (?:modified|updated|changed)|since|version|date|maintainer|owner|reviewed)\b(?: (?:by|on|at|in|since))?\W+(?:\S+ ?){0,3}", r"v?\d+(?:\.\d+)+\W*", r"\d{1,4}[-./]\d{1,2}[-./]\d{1,4}\W*",
    r"(?:copyright|\(c\)|©|spdx-license-identifier|licensed under|all rights reserved|use is subject to)\b.*",
)
DISUSED_CODE = (
    r"[\w$.\[\]]+ ?(?:[-+*/|&%]|:)?= ?[^=].*", r"(?:return|throw|await|yield|const|let|var|print|del|assert)\b[^.,]*[()\[\]=;][^.,]*", r"(?:if|for|while|switch) ?\(.*\).*", r"(?:if|for|while) .*:", r"[\w$.]+ ?\([^ ]*(?:, ?[\w$.\"']+)*\);?", r"[^.]*;", r"[{}()\[\];]+",
)
BARE_TAGS = (r"[@:\\](?:param|arg|argument|parameter|returns?|throws|raises|exception|type|rtype|yields?|tparam|typeparam)\b:?\s*(?:\{[^}]*\})?\s*[\w$\[\].=*]*\s*(?:\{[^}]*\})?\W*", r"(?:args|arguments|parameters|params|returns?|raises|yields|example|examples|note|notes)\W*")
#: Words that say nothing about a function.
FILLERS = (
    "a an the this that these it its is are be was will does do did done of for to in on by with from as at and or which who used use uses using order own name names says say said simply just "
    "function functions method methods procedure routine helper constructor getter setter called here given some param params parameter parameters arg args argument arguments return returns "
    "value class object implementation implements performs"
).split()

def candidate_comments(lexed: DataFrame) -> DataFrame:
    """file_id, source, first, line, blanks, text, units of the comments of texts lexed with ``comments``."""
    return lexed.select("file_id", F.explode("comments").alias("c")).select("file_id", "c.*")


#: Fixed value: endings that are left off words of at least four letters.
_ENDING = r"(?:ies|y(?:s|ed|ing)?|ing|es|ed|e|(?<=[^s])s)"


def words_of(text: Column) -> Column:
    """The words (array) of a text or a name in lower case, without endings; names are cut at capitals and underscores."""
    cut = F.regexp_replace(text, r"(?<=[\p{Ll}\d])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|_", " ")
    stems = F.regexp_replace(F.lower(cut), r"(?<=\p{L}\p{L}\p{L})" + _ENDING + r"(?![\p{L}\p{M}\p{N}])", "")
    return F.regexp_extract_all(stems, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def _stemmed(word: str) -> str:
    """A word as :func:`words_of` gives it."""
    return re.sub(r"(?<=[^\W\d_]{3})" + _ENDING + r"$", "", word)


def informative(units: Column, name: Column, signature: Column) -> Column:
    """Whether a unit of a description tells more than name and signature: words remain when these and fillers are left out."""
    dull = "|".join(f"(?:{p})" for p in (*PLACEHOLDERS, *POINTERS, *TOOL_NOTES, *STAMPS, *DISUSED_CODE, *BARE_TAGS))
    told = F.filter(units, lambda u: ~F.lower(F.trim(u)).rlike(rf"^[\s*#/!-]*(?:{dull})$") & u.rlike(r"[\p{L}\p{N}]"))
    plain = F.transform(told, lambda u: F.regexp_replace(u, r"^\W*[@:\\]\w+\s*(?:\{[^}]*\})?", " "))
    fillers = sorted({_stemmed(w) for w in FILLERS})
    words = F.filter(words_of(F.array_join(plain, " ")), lambda w: ~w.isin(fillers))
    return F.size(F.array_except(words, F.concat(words_of(name), words_of(F.coalesce(signature, F.lit("")))))) > 0


#: A comment is a candidate for this many functions from the line on that stands below it.
NEIGHBOURS = 2


def candidate_links(functions: DataFrame, comments: DataFrame) -> DataFrame:
    """Each comment with the next :data:`NEIGHBOURS` functions of its file: file_id, comment (a hash), source, blanks, text, units, distance (in lines), f (a function).

    Comments and functions are laid in one order of lines per file, so that a comment finds its neighbours by row, without a
    join and without pairs beyond them. In this order repeated ones follow each other: a comment counts once, and a function
    of a line once, with the least of its rows.
    """
    f = F.struct("symbol_id", "name", "line", "end_line", "signature")
    ours = functions.where("file_id IS NOT NULL").select("file_id", F.col("line").alias("at"), f.alias("f"))
    theirs = comments.where("file_id IS NOT NULL").select("file_id", F.col("line").alias("at"), F.struct("source", "first", "blanks", "text", "units").alias("c"))
    both = ours.unionByName(theirs, allowMissingColumns=True)
    order = "OVER (PARTITION BY file_id ORDER BY at, f IS NOT NULL, f.symbol_id, c.first, c.source, c.text, f)"
    this = F.struct("at", "f.symbol_id", "c.first", "c.source", "c.text")
    once = both.withColumn("this", this).withColumn("last", F.expr(f"lag(this) {order}")).where("NOT (this <=> last)")
    near = once.select("file_id", "at", "c", F.array(*[F.expr(f"lead(f, {i + 1}) IGNORE NULLS {order}") for i in range(NEIGHBOURS)]).alias("near")).where("c IS NOT NULL")
    each = near.select("file_id", "at", "c.*", F.explode(F.array_compact("near")).alias("f"))
    return each.withColumn("comment", F.xxhash64("source", "first", "text")).withColumn("distance", F.col("f.line") - F.col("at"))


def plausibility(source: Column, blanks: Column, distance: Column, text: Column, units: Column, name: Column, signature: Column) -> Column:
    """The weight of a link: a docstring in the function first, then the share of parameter tags that name parameters, nearness, and the name in the text.

    A signature that is missing or was cut (90 characters) can't speak against the tags.
    """
    own_name = F.regexp_extract(F.coalesce(name, F.lit("")), r"(\w+)\W*$", 1)
    tags = F.array_distinct(F.regexp_extract_all(F.array_join(units, "\n"), F.lit(r"[@:\\](?:param|arg)\w*\s+(?:\{[^}]*\}\s*)?([\w$]+)"), F.lit(1)))
    open_end = F.coalesce(F.length(signature), F.lit(0)).isin(0, 90)
    fits = F.when(open_end, 1.0).otherwise(F.size(F.array_intersect(tags, F.regexp_extract_all(signature, F.lit(r"[\w$]+"), F.lit(0)))) / F.greatest(F.size(tags), F.lit(1)))
    return (
        F.when((source == "docstring") & (distance == 0), 1000.0).otherwise(0.0)
        + F.when(F.size(tags) > 0, 20.0 * fits).otherwise(0.0)
        + F.when((distance == 0) & (blanks == 0), 15.0).otherwise(-1.0 * F.least(distance, F.lit(30)) - 5.0 * blanks)
        + F.when((own_name != "") & F.contains(text, own_name), 5.0).otherwise(0.0)
    )


def _matched(links: pa.Table) -> pa.Table:
    """The links of one or more files that the assignment takes: the best first, as long as both its ends are free."""
    files, comments, functions = (links.column(c).to_pylist() for c in ("file_id", "comment", "symbol_id"))
    score = links.column("score").to_numpy()
    kept, busy = np.zeros(len(score), dtype=bool), set()
    for i in sorted(range(len(score)), key=lambda i: (-score[i], comments[i], functions[i])):
        ends = ((files[i], 0, comments[i]), (files[i], 1, functions[i]))
        if busy.isdisjoint(ends):
            busy.update(ends)
            kept[i] = True
    return links.filter(pa.array(kept))


def assigned(links: DataFrame) -> DataFrame:
    """The rows of ``links`` (file_id, comment, symbol_id, score and more) of a bipartite assignment: each comment and each function at most once.

    The best link (ties by ids) is taken and what else hangs on its ends is left, until no link is free: no two ends remain
    that would both rather have each other. Links must come file by file, as :func:`candidate_links` leaves them; a task holds
    those of one file and of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                ids = batch.column("file_id").to_pylist()
                last = next((i + 1 for i in range(len(ids) - 2, -1, -1) if ids[i] != ids[-1]), 0)
                if last or held[0].column("file_id")[0].as_py() != ids[-1]:
                    yield from _matched(pa.Table.from_batches([*held[:-1], batch.slice(0, last)])).to_batches()
                    held = [batch.slice(last)]
        if held:
            yield from _matched(pa.Table.from_batches(held)).to_batches()

    return links.mapInArrow(run, links.schema)


def documented_functions(symbols: DataFrame, files: DataFrame, *, described: bool = True) -> DataFrame:
    """symbol_id, file_id, name, line, end_line, source, description of the functions and methods with a telling description; symbol_id and file_id only unless ``described``.

    Files are lexed once, for their comments and for their validity. Each comment is a candidate for the next functions below
    it (see :func:`candidate_links`), weighed by :func:`plausibility` and matched by :func:`assigned`. Links that are
    implausible, because the comment doesn't stand directly at the function, are then rejected, and descriptions that tell
    nothing (see :func:`informative`) are dropped.

    Files that are no valid text of their language are left out, so are rows without content, kinds other than function and
    method, and symbols whose line is null. Repeated symbols count once, with the least of their rows; a null name or
    signature has no words. Empty tables give an empty result.
    """
    wanted = symbols.where("kind IN ('function', 'method') AND line IS NOT NULL AND symbol_id IS NOT NULL")
    functions = wanted.select("symbol_id", "file_id", "name", "line", "end_line", "signature")
    lexed = checkpointed(folded(tokens(files, comments=True)))
    links = candidate_links(functions, candidate_comments(lexed))
    score = plausibility(*(F.col(c) for c in ("source", "blanks", "distance", "text", "units", "f.name", "f.signature")))
    telling = F.when((F.col("distance") == 0) & (F.col("blanks") == 0), informative(F.col("units"), F.coalesce("f.name", F.lit("")), F.col("f.signature"))).otherwise(False)
    shown = ["f.name", "f.line", "f.end_line", "source", F.col("text").alias("description")] if described else []
    matched = assigned(links.select("f.symbol_id", "file_id", *shown, "comment", score.alias("score"), telling.alias("telling")))
    bad = unparsable_texts(lexed.drop("comments"))
    return matched.where("telling").join(bad, "file_id", "left_anti").select("symbol_id", "file_id", *(c for c in ("name", "line", "end_line", "source", "description") if described))


def code_and_description(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbol_id, code, description of :func:`documented_functions`, the code from the declaration's line to its end.

    Where the index doesn't know the end, or gives one before the line, it is looked for in the content, by braces or indents.
    """
    pairs = checkpointed(documented_functions(symbols, files))
    unknown = pairs.where("end_line IS NULL OR end_line < line").select("symbol_id").distinct()
    found = symbol_bodies(symbols.join(unknown, "symbol_id", "left_semi"), files).select("symbol_id", "body_end")
    texts = files.where("content IS NOT NULL").groupBy("file_id").agg(F.max("content").alias("content"))
    lines = F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n", -1)
    end = F.when(F.col("end_line") >= F.col("line"), F.col("end_line")).otherwise(F.coalesce("body_end", "line"))
    span = (end - F.col("line") + 1).cast("int")
    joined = pairs.join(found, "symbol_id", "left").join(texts, "file_id").where(F.col("line") > 0)
    return joined.select("symbol_id", F.array_join(F.slice(lines, F.col("line").cast("int"), span), "\n").alias("code"), "description")
