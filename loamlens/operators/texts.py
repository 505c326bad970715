"""Questions to the text of files and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamlens.functions.paths import detected_language
from loamlens.functions.text import word_count

# What declares something, in the order in which a line is tried. The first group is the name.
DECLARATIONS = (
    ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("class", r"^\s*(?:export\s+)?(?:public\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("interface", r"^\s*(?:export\s+)?(?:public\s+)?interface\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("enum", r"^\s*(?:export\s+)?(?:public\s+)?enum\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("const", r"^(?:export\s+)?(?:pub\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
    ("function", r"^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("function", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)"),
    ("function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("struct", r"^\s*(?:pub\s+)?struct\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("type", r"^\s*(?:export\s+)?type\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
)


def text_lines(files: DataFrame) -> DataFrame:
    """file_id, line (from 1), text of the lines of each row of files, any line end; null and empty texts have none.

    Repeated rows give their lines again: whoever reads the lines drops repeats behind its filter, so that texts aren't shuffled.
    """
    split = F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n", -1)
    each = files.where("content IS NOT NULL AND content <> ''").select("file_id", F.posexplode(split).alias("at", "text"))
    return each.select("file_id", (F.col("at") + 1).cast("bigint").alias("line"), "text")


def declarations(lines: DataFrame) -> DataFrame:
    """file_id, line, kind, name, exported: what a line declares by the first pattern that it meets; repeated rows once."""
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for kind, pattern in reversed(DECLARATIONS):
        name = F.regexp_extract("text", pattern, 1)
        found = F.when(name != "", F.struct(F.lit(kind).alias("kind"), name.alias("name"))).otherwise(found)
    exported = F.col("text").rlike(r"(^|\s)(export|pub|public)\s")
    return lines.select("file_id", "line", found.alias("d"), exported.alias("exported")).where("d IS NOT NULL").select("file_id", "line", "d.kind", "d.name", "exported").distinct()


def references(lines: DataFrame, symbol: str) -> DataFrame:
    """file_id, line, is_import, preview of the lines that hold ``symbol`` as a word.

    A plain search for the text goes before the regular expression. Words are made of letters of ASCII, digits and underscores.
    """
    word = r"(?<![A-Za-z0-9_])\Q" + symbol + r"\E(?![A-Za-z0-9_])"
    hits = lines.where(F.contains(F.col("text"), F.lit(symbol)) & F.col("text").rlike(word))
    imports = F.ltrim("text").rlike(r"^(import|from|use|require|export .* from)\b")
    return hits.select("file_id", "line", imports.alias("is_import"), F.substring(F.trim("text"), 1, 90).alias("preview")).distinct()


def headings(documents: DataFrame) -> DataFrame:
    """doc_id, position, level, heading of the headings of up to three signs."""
    marks = F.regexp_extract_all("text", F.lit(r"(?m)^(#{1,3} [^\r\n]+)"), F.lit(1))
    each = documents.where("text IS NOT NULL").select("doc_id", F.posexplode(marks).alias("position", "mark"))
    return each.select("doc_id", F.col("position").cast("bigint").alias("position"), F.length(F.regexp_extract("mark", "^#+", 0)).cast("bigint").alias("level"), F.trim(F.regexp_replace("mark", "^#+ ", "")).alias("heading"))


def first_headings(documents: DataFrame, *, limit: int = 50) -> DataFrame:
    """source, position, heading: the distinct headings of the documents of each source in the order in which they first come; at most ``limit``."""
    marks = headings(documents.where("source IS NOT NULL")).join(documents.select("doc_id", "source"), "doc_id")
    seen = marks.where("heading <> ''").groupBy("source", "heading").agg(F.min(F.struct("doc_id", "position")).alias("first"))
    order = Window.partitionBy("source").orderBy("first", "heading")
    return seen.withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= limit).select("source", "position", "heading")


# How common libraries bind a path to code; the first group is the path.
ROUTES = (
    r"\b(?:app|router|server|api|fastify)\.(?:get|post|put|patch|delete|head|options|all|use)\(\s*[\"']([^\"'\n]+)[\"']",
    r"@(?:app|router|bp|blueprint|api)\.(?:route|get|post|put|patch|delete)\(\s*[\"']([^\"'\n]+)[\"']",
    r"@(?:Get|Post|Put|Patch|Delete|Controller|RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|Path)\(\s*[\"']([^\"'\n]+)[\"']",
    r"\b(?:Handle|HandleFunc|GET|POST|PUT|DELETE)\(\s*\"([^\"\n]+)\"",
    r"#\[(?:get|post|put|patch|delete)\(\s*\"([^\"\n]+)\"",
)


def routes_in_code(files: DataFrame) -> DataFrame:
    """file_id, route: the paths that code binds to handlers, each once per file."""
    found = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in ROUTES])
    return files.where("content IS NOT NULL").select("file_id", F.explode(F.array_distinct(found)).alias("route")).distinct()


def document_digest(documents: DataFrame, *, max_words: int = 100) -> DataFrame:
    """doc_id, n_words, n_paragraphs, kept_paragraphs: how many paragraphs fit from the beginning into ``max_words`` words."""
    paragraphs = documents.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split(F.col("text"), r"\n\n+", -1)).alias("at", "p"))
    counted = paragraphs.withColumn("n", word_count(F.col("p"))).where("n > 0")
    running = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    return running.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_paragraphs"), F.count_if(F.col("upto") <= max_words).alias("kept_paragraphs"))


def numbered_lines(files: DataFrame) -> DataFrame:
    """file_id, path, n (the file's number of lines), line (from 1), text: the lines of each file once, any line end.

    Of rows with one file_id the greatest path and content count; null and empty texts have no lines.
    """
    one = files.where("content IS NOT NULL AND content <> ''").groupBy("file_id").agg(F.max(F.struct("path", "content")).alias("f"))
    split = one.select("file_id", "f.path", F.split(F.regexp_replace("f.content", r"\r\n?", "\n"), "\n", -1).alias("lines"))
    return split.select("file_id", "path", F.size("lines").cast("bigint").alias("n"), F.posexplode("lines").alias("at", "text")).select("file_id", "path", "n", (F.col("at") + 1).cast("bigint").alias("line"), "text")


def with_depths(lines: DataFrame) -> DataFrame:
    """Lines with ``before`` and ``depth``, the open braces in front of a line and behind it; what follows ``//`` doesn't count."""
    plain = F.regexp_replace("text", r"//.*$", "")
    step = F.length(F.regexp_replace(plain, r"[^{]", "")) - F.length(F.regexp_replace(plain, r"[^}]", ""))
    upto = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("step", step).withColumn("depth", F.sum("step").over(upto)).withColumn("before", F.col("depth") - F.col("step")).drop("step")


def with_indents(lines: DataFrame) -> DataFrame:
    """Lines with ``indent``, null for blank lines and such as begin with a closing bracket, the indent and number of the last
    such line before (``last_indent``, ``last_line``) and the number of the file's last (``final``)."""
    indent = F.when((F.trim("text") != "") & ~F.ltrim("text").startswith(")"), F.length("text") - F.length(F.ltrim("text")))
    file = Window.partitionBy("file_id").orderBy("line")
    above = file.rowsBetween(Window.unboundedPreceding, -1)
    filled = lines.withColumn("indent", indent).withColumn("at", F.when(F.col("indent").isNotNull(), F.col("line")))
    return filled.select(
        *lines.columns, "indent", F.last("indent", ignorenulls=True).over(above).alias("last_indent"), F.last("at", ignorenulls=True).over(above).alias("last_line"),
        F.max("at").over(Window.partitionBy("file_id")).alias("final"),
    )


def body_spans(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """symbol_id, file_id, line, body_end of functions, methods and classes in numbered lines; see :func:`symbol_bodies`.

    A line that opens or closes braces is an event of each depth that it crosses, one that is not deeper than the line before
    an event of each indent in between. A body ends at the next event of its own depth or indent, found by one running window
    from the last line to the first, so the work grows with lines and symbols, not with their product.
    """
    wanted = symbols.where("kind IN ('function', 'method', 'class') AND line IS NOT NULL AND symbol_id IS NOT NULL").groupBy("symbol_id").agg(F.min(F.struct("file_id", F.col("line").cast("bigint").alias("line"))).alias("s")).select("symbol_id", "s.*")
    near = lines.join(wanted.select("file_id").distinct(), "file_id", "left_semi")
    indented = detected_language(F.col("path")) == "py"
    braces, indents = with_depths(near.where(~F.coalesce(indented, F.lit(False)))), with_indents(near.where(indented))
    none = F.lit(None).cast("bigint")
    closing = F.col("depth") < F.col("before")
    crossed = F.explode(F.sequence(F.least("before", "depth"), F.greatest("before", "depth") - 1))
    left = F.explode(F.sequence(F.col("indent").cast("bigint"), F.col("last_indent").cast("bigint")))
    one_line = F.col("text").contains("{") & F.col("text").contains("}")
    parts = (
        braces.where("depth <> before").select("file_id", "line", crossed.alias("level"), F.lit(1).alias("turn"), none.alias("symbol_id"), F.when(~closing, F.col("line")).alias("opens"), F.when(closing, F.col("line")).alias("closes"), none.alias("otherwise")),
        braces.join(wanted, ["file_id", "line"]).select("file_id", "line", F.col("before").alias("level"), F.lit(2).alias("turn"), "symbol_id", none.alias("opens"), none.alias("closes"), F.when(one_line, F.lit(None)).otherwise(F.col("n")).alias("otherwise")),
        indents.where("indent <= last_indent").select("file_id", "line", left.alias("level"), F.lit(4).alias("turn"), none.alias("symbol_id"), none.alias("opens"), F.col("last_line").alias("closes"), none.alias("otherwise")),
        indents.join(wanted, ["file_id", "line"]).select("file_id", "line", F.col("indent").cast("bigint").alias("level"), F.lit(3).alias("turn"), "symbol_id", none.alias("opens"), none.alias("closes"), F.when(F.col("indent").isNotNull(), F.col("final")).alias("otherwise")),
    )
    events = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    below = Window.partitionBy("file_id", "level").orderBy(F.col("line").desc(), "turn").rowsBetween(Window.unboundedPreceding, -1)
    ended = events.withColumn("closed", F.last("closes", ignorenulls=True).over(below))
    block = F.last(F.when(F.col("opens").isNotNull(), F.struct("opens", "closed")), ignorenulls=True).over(below)
    found = ended.withColumn("block", block).where("symbol_id IS NOT NULL")
    by_braces = F.when(F.col("otherwise").isNull() | F.col("block").isNull(), F.col("line")).otherwise(F.coalesce("block.closed", "otherwise"))
    by_indents = F.when(F.col("otherwise").isNull(), F.col("line")).otherwise(F.coalesce("closed", "otherwise"))
    return found.select("symbol_id", "file_id", "line", F.when(F.col("turn") == 2, by_braces).otherwise(by_indents).alias("body_end"))


def symbol_bodies(symbols: DataFrame, files: DataFrame, *, max_lines: int = 150) -> DataFrame:
    """symbol_id, file_id, line, body_end, n_lines, body of functions, methods and classes, found in the text.

    By braces: to the line in which the depth falls back to that before the declaration; by indentation (Python): to the last
    line before one that is not deeper. ``body`` is cut to ``max_lines`` lines with a note. A declaration that never opens a
    block is one line long. Symbols without a line, or with one that the file doesn't have, give no row; repeated symbols
    count once, with the least file and line.
    """
    lines = numbered_lines(files)
    spans = body_spans(symbols, lines).withColumn("n_lines", F.col("body_end") - F.col("line") + 1)
    shown = spans.withColumn("line_at", F.explode(F.sequence(F.col("line"), F.least(F.col("body_end"), F.col("line") + max_lines - 1))))
    text = lines.select("file_id", F.col("line").alias("line_at"), "text")
    whole = shown.join(text, ["file_id", "line_at"]).groupBy("symbol_id", "file_id", "line", "body_end", "n_lines").agg(F.array_sort(F.collect_list(F.struct("line_at", "text"))).alias("t"))
    body = F.array_join("t.text", "\n")
    noted = F.when(F.col("n_lines") > max_lines, F.concat(body, F.lit("\n… "), (F.col("n_lines") - max_lines).cast("string"), F.lit(" more lines"))).otherwise(body)
    return whole.select("symbol_id", "file_id", "line", "body_end", "n_lines", noted.alias("body"))


def folded_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, folded: each file with the bodies of its outermost functions and methods of more than three lines replaced by a note.

    A body that begins within one that begins earlier is passed over. Files without content give no row.
    """
    lines = numbered_lines(files)
    spans = body_spans(symbols.where("kind IN ('function', 'method')"), lines).where("body_end - line > 2")
    ranges = spans.groupBy("file_id", (F.col("line") + 1).alias("line")).agg((F.max("body_end") - 1).alias("b"))
    earlier = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    outer = ranges.withColumn("covered", F.max("b").over(earlier)).where("covered IS NULL OR line > covered").select("file_id", "line", "b")
    upto = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.join(outer, ["file_id", "line"], "left").withColumn("hidden_to", F.last("b", ignorenulls=True).over(upto))
    note = F.concat(F.regexp_extract("text", r"^\s*", 0), F.lit("… folded"))
    kept = marked.where("b IS NOT NULL OR hidden_to IS NULL OR line > hidden_to").select("file_id", "line", F.when(F.col("b").isNotNull(), note).otherwise(F.col("text")).alias("text"))
    return kept.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("t")).select("file_id", F.array_join("t.text", "\n").alias("folded"))
