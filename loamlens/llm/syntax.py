"""Source files that do not parse."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamlens.functions.paths import extension
from loamlens.llm.comments import comment_blocks
from loamlens.llm.grammar import GRAMMARS, alphabet, permissible
from loamlens.llm.lexer import lex
from loamlens.session import checkpointed

# Extensions of the languages.
LANGUAGES = {"py": "py", "pyi": "py", "js": "js", "mjs": "js", "ts": "ts", "go": "go", "rs": "rs", "java": "java"}


def language(path: Column) -> Column:
    """The language a path claims by its extension, or null."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(path)]


_COMMENT = pa.struct([("source", pa.string()), ("first", pa.int64()), ("line", pa.int64()), ("blanks", pa.int32()), ("text", pa.string()), ("units", pa.list_(pa.string()))])
_COMMENTS_SQL = "comments array<struct<source: string, first: bigint, line: bigint, blanks: int, text: string, units: array<string>>>"


def tokens(files: DataFrame, *, comments: bool = False) -> DataFrame:
    """unit, file_id, lang, codes: each row's content as one character per token, and on demand its comments from the same pass.

    Rows without content or with another extension are left out. ``unit`` numbers the rows, so that a file that comes twice
    is not mixed with itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, file_id, lang, content = (batch.column(i) for i in range(4))
            codes, found, ends = [], [], [0]
            for la, text in zip(lang.to_pylist(), content.to_pylist(), strict=True):
                text = text.replace("\r\n", "\n").replace("\r", "\n")
                spans: list[tuple[int, int, str]] | None = [] if comments else None
                codes.append(lex(la, text, spans))
                if comments:
                    found += comment_blocks(la, text, spans)
                    ends.append(len(found))
            extra = {}
            if comments:
                columns = [pa.array([c[i] for c in found], f.type) for i, f in enumerate(_COMMENT)]
                extra["comments"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_COMMENT)))
            yield pa.RecordBatch.from_pydict({"unit": unit, "file_id": file_id, "lang": lang, "codes": pa.array(codes, pa.string()), **extra})

    claimed = files.select("file_id", language(F.col("path")).alias("lang"), "content").where("lang IS NOT NULL AND content IS NOT NULL")
    kind = claimed.schema["file_id"].dataType.simpleString()
    schema = f"unit bigint, file_id {kind}, lang string, codes string" + (", " + _COMMENTS_SQL if comments else "")
    return claimed.select(F.monotonically_increasing_id().alias("unit"), "file_id", "lang", "content").mapInArrow(run, schema)


def permissible_pairs(spark: SparkSession) -> DataFrame:
    """lang, pair: what the grammars permit, some thousand rows for each language."""
    rows = [(lang, pair) for lang in GRAMMARS for pair in sorted(permissible(lang))]
    return spark.createDataFrame(rows, "lang string, pair string")


def broken_pairs(lexed: DataFrame) -> DataFrame:
    """file_id of files with two tokens side by side that no text of the language has so.

    Each file's distinct pairs are exploded and anti-joined with the permissible ones, a table whose size the grammars bound,
    so it is broadcast.
    """
    pairs = F.array_distinct(F.regexp_extract_all("codes", F.lit("(?s)(?=(..))"), F.lit(1)))
    each = lexed.select("file_id", "lang", F.explode(pairs).alias("pair"))
    return each.join(F.broadcast(permissible_pairs(lexed.sparkSession)), ["lang", "pair"], "left_anti").select("file_id")


def folded(lexed: DataFrame) -> DataFrame:
    """``lexed`` with ``flat`` and ``alone``.

    ``flat`` are the codes with letters for the words of clauses and without the brackets, but for the head of a ``for``, that
    meet between two braces or semicolons. In the languages with braces plain statements in a row are one there, and a block
    of nothing else is the letter B. ``alone`` names what is wrong with a single piece, see :func:`bad_clauses`.
    """
    flat = F.col("flat")
    plain = r"(?<![^{};])(?:[^{};A-Z()\[\],.:?+\-*/%&|=<>][^{};A-Z()\[\]]*+;)+"
    blocks = F.regexp_replace(F.regexp_replace("flat", plain, "n;"), r"(?<!S)\{(?:n;)?\}", "B")
    short = F.when(F.col("lang") == "py", flat).when(F.col("lang") == "rs", F.regexp_replace("flat", plain, "n;")).otherwise(blocks)
    groups = lexed.withColumn("flat", _without_groups(_lettered(F.col("codes")), r"(?<!O)\([^()\[\]{};]*+\)|\[[^()\[\]{};]*+\]"))
    return groups.withColumn("alone", wrong_alone()).withColumn("flat", short)


def python_lines(lexed: DataFrame) -> DataFrame:
    """unit, file_id, lang, seq, codes: one row per line, indent or dedent of a Python file."""
    lines = F.regexp_extract_all("codes", F.lit(r"(?s)[^;⇥⇤]*[;⇥⇤]|[^;⇥⇤]+$"), F.lit(0))
    return lexed.where("lang = 'py'").select("unit", "file_id", "lang", F.posexplode(lines).alias("seq", "codes"))


def pieces(lexed: DataFrame) -> DataFrame:
    """unit, file_id, lang, seq, flat: one row per piece of a statement, up to a brace, a semicolon or a plain block."""
    cut = F.regexp_extract_all("flat", F.lit(r"(?s)[^{};B]*[{};B]|[^{};B]+$"), F.lit(0))
    return lexed.where("lang <> 'py'").select("unit", "file_id", "lang", F.posexplode(cut).alias("seq", "flat"))


def bad_production() -> str:
    """A pattern for lines of Python that none of its productions gives; the other languages have windows, see :func:`bad_clauses`."""
    codes = alphabet("py")
    one = lambda *words: "[" + "".join(codes[w] for w in words if w in codes) + "]"
    cut = f"{one('from')}[^{codes['import']}]*;$|{one('import')}[^()]*,;$|{one('from')}[^()]*,;$|{one('assert')}[^,]*,;$|{one('global', 'nonlocal')}.*,;$"
    unfinished = f"(?!{one('if', 'elif', 'case')})[^{codes['for']}{codes['if']}{codes['else']}]*{codes['if']}[^{codes['for']}{codes['else']}]*;$"
    return rf"^\x02?+(?:{cut}|{unfinished})|^\x02?[^{{}}()\[\]]*[n0s)\]](?:=[^=]*)?[+\-*/%]?=;$"


def _without_groups(codes: Column, group: str) -> Column:
    for _ in range(4):
        codes = F.regexp_replace(codes, group, "")
    return codes


def unnested(lexed: DataFrame) -> DataFrame:
    """file_id of files whose brackets don't nest.

    Brackets that are left where others were folded become rows. Running sums over a file give each its depth, and within a
    depth a closing bracket must follow an opening one of its kind.
    """
    left = lexed.select("unit", "file_id", F.posexplode(F.regexp_extract_all("flat", F.lit(r"[()\[\]{}]"), F.lit(0))).alias("at", "sign"))
    step = F.when(F.col("sign").isin("(", "[", "{"), 1).otherwise(-1)
    running = Window.partitionBy("unit").orderBy("at")
    deep = left.withColumn("step", step).withColumn("depth", F.sum("step").over(running)).withColumn("level", F.col("depth") + F.when(F.col("step") < 0, 1).otherwise(0))
    kind = F.translate("sign", ")]}", "([{")
    before = F.lag("sign").over(Window.partitionBy("unit", "level").orderBy("at"))
    crossed = deep.withColumn("crossed", (F.col("step") < 0) & ~F.coalesce(before == kind, F.lit(False)))
    sums = crossed.groupBy("unit", "file_id").agg(F.sum("step").alias("open"), F.min("depth").alias("least"), F.max("crossed").alias("crossed"))
    return sums.where("open <> 0 OR least < 0 OR crossed").select("file_id")


def bad_lines(lexed: DataFrame) -> DataFrame:
    """file_id of Python files with a line that no production gives, or one that may not follow the one before.

     A line that ends in a colon must be followed by a deeper one and no other may be; a ``try`` must be followed by
    an ``except`` or ``finally``, and these, ``elif`` and ``else`` by turns belong to what stands before at the same depth.
    """
    codes = alphabet("py")
    is_one = lambda k, *words: F.coalesce(k, F.lit("")).isin(*[codes[w] for w in words])
    line = F.col("codes")
    heads = is_one(F.col("kind"), "if", "elif", "else", "while", "for", "try", "except", "finally", "with", "def", "class", "async")
    group = r"\([^()\[\]{}]*+\)|\[[^()\[\]{}]*+\]|\{[^()\[\]{}]*+\}"
    python = (
        python_lines(lexed)
        .withColumn("kind", F.substring(line, F.when(line.startswith("\x02"), 2).otherwise(1), F.lit(1)))
        .withColumn("is_line", line.endswith(";") & (line != ";"))
        .select("unit", "file_id", "seq", "kind", "is_line", line.endswith(":;").alias("opens"), (F.col("is_line") & heads & ~_without_groups(line, group).rlike(r"[:(\[{]")).alias("no_colon"), line.rlike(bad_production()).alias("wrong"))
    )
    in_file = Window.partitionBy("unit").orderBy("seq")
    step = F.when(F.col("kind") == "⇥", 1).when(F.col("kind") == "⇤", -1).otherwise(0)
    placed = python.withColumn("step", step).withColumn("shape", F.struct("kind", "is_line", "opens")).select(
        "file_id", "unit", "seq", "kind", "is_line", "opens", "no_colon", "wrong", F.sum("step").over(in_file).alias("level"), F.lead("kind").over(in_file).alias("after"), F.lag("shape").over(in_file).alias("before")
    )
    headed = placed.where("kind <> '⇥'").withColumn("head", F.lag("kind").over(Window.partitionBy("unit", "level").orderBy("seq")))
    after, head, closes = F.col("after"), F.col("head"), F.col("kind") == "⇤"
    depth = F.col("is_line") & (F.col("opens") != (F.coalesce(after, F.lit("")) == "⇥"))
    left_open = is_one(head, "try") & ~is_one(after, "except", "finally")
    strange = (
        (is_one(after, "except") & ~is_one(head, "try", "except"))
        | (is_one(after, "finally") & ~is_one(head, "try", "except", "else"))
        | (is_one(after, "elif") & ~is_one(head, "if", "elif"))
        | (is_one(after, "else") & ~is_one(head, "if", "elif", "for", "while", "except", "async"))
    )
    short = F.coalesce(F.col("before.is_line") & ~F.col("before.opens") & is_one(F.col("before.kind"), "if", "elif", "for", "while", "try", "except", "else", "async"), F.lit(False))
    loose = F.col("is_line") & is_one(F.col("kind"), "except", "finally", "elif", "else") & ~is_one(F.col("before.kind"), "DEDENT") & ~short
    bare = F.col("is_line") & is_one(F.col("kind"), "@") & ~is_one(after, "def", "class", "async", "@")
    order = headed.where(F.col("wrong") | F.col("no_colon") | depth | bare | (closes & (left_open | strange)) | loose)
    return order.select("file_id")


# The words that begin or link the parts of a statement, and the letters that stand for them below.
_CLAUSES = {"if": "I", "else": "E", "try": "T", "catch": "C", "finally": "F", "switch": "S", "select": "S", "case": "K", "default": "D", "for": "O", "while": "W", "do": "W", "loop": "W", "match": "M", "function": "U", "class": "Z", "import": "Y", "export": "Y", "from": "X", "let": "L", "of": "P", "in": "P", "range": "P", ":=": "A"}


def _lettered(codes: Column) -> Column:
    """``codes`` without the sign of the file's begin and with the words of :data:`_CLAUSES` as their letters, but in Python; a ``try`` with resources is R."""
    out = codes
    for lang in sorted(set(GRAMMARS) - {"py"}):
        held = {alphabet(lang)[w]: c for w, c in _CLAUSES.items() if w in alphabet(lang)}
        out = F.when(F.col("lang") == lang, F.translate(codes, "".join(held) + "\x02", "".join(held.values()))).otherwise(out)
    return F.when(F.col("lang") == "java", F.replace(out, F.lit("T("), F.lit("R("))).otherwise(out)


def bad_clauses(lexed: DataFrame) -> DataFrame:
    """file_id, rule of files, in the languages with braces, with a clause that doesn't belong to the one before it at its depth.

    Pieces are placed by a running sum over braces. Within a depth windows reduce them: an ``else`` takes up an ``if`` of its
    chain, a ``try`` is followed by a ``catch`` or ``finally`` and these follow one, the head of a ``for`` has two semicolons,
    a ``case`` stands in a ``switch`` (the piece that opened the block) and nothing stands there before the first one, a name
    follows the ``from`` of an import, statements of Java end in semicolons; in Rust the arms of a ``match`` don't end in semicolons. What holds for a piece alone is looked for in the folded text: a ``for``
    without semicolons names what it runs over; in Java no more than a type stands before a name; in Go a statement assigns once; in JavaScript no
    colon stands among or behind the parameters of a function; in Rust no colon stands behind the equals sign
    of a ``let``. Where brackets are left, because they hold braces or lie too deep, what depends on them isn't judged.
    """
    lang, flat = F.col("lang"), F.col("flat")
    is_one = lambda *names: lang.isin(*names)
    in_file, in_depth = Window.partitionBy("unit").orderBy("seq"), Window.partitionBy("unit", "level").orderBy("seq")
    upto_here = in_depth.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(flat.endswith("{"), 1).when(flat.endswith("}"), -1).otherwise(0)
    placed = pieces(lexed).withColumn("flat", F.coalesce("flat", F.lit(""))).withColumn("level", F.sum(step).over(in_file) - step).withColumn("above", F.lag("flat", 1, "").over(in_file))
    joined = F.substring(flat, 1, 1).isin(*"E)],.;:?+-*/%&|=<>([") | (is_one("go") & F.col("before").endswith(";") & flat.rlike(r"^[^IOSE].*[{B]$"))
    is_else = flat.startswith("E") & (~is_one("rs") | flat.rlike("^E[{IB]"))
    gain = F.when(flat.contains("I"), F.length(flat) - F.length(F.replace(flat, F.lit("I"), F.lit("")))).otherwise(0) - F.when(is_else, 1).otherwise(0)
    linked = placed.withColumn("gain", gain).withColumn("opens", F.when(F.col("above").endswith("{"), F.col("above"))).select(
        "file_id", "unit", "level", "seq", "lang", "flat", "above", F.lag("flat", 1, "").over(in_depth).alias("before"), F.lead("flat", 1, "").over(in_depth).alias("next"), F.lead("flat", 2, "").over(in_depth).alias("next2"),
        F.last("opens", ignorenulls=True).over(upto_here).alias("opener"), (F.sum("gain").over(upto_here) - F.col("gain")).alias("upto"),
    )
    before, after, after2, above, opener = (F.col("before"), F.col("next"), F.col("next2"), F.col("above"), F.coalesce("opener", F.lit("")))
    c_like, scripts = is_one("js", "ts", "java"), is_one("js", "ts")
    in_block = ~opener.rlike(r"Z|[=(,:?\[]\{$")  # not among the members of a class or an object, which may have such names
    rules = {
        "try": c_like & (flat.endswith("T{") | flat.endswith("TB")) & ~after.rlike("^[CF]"),
        "catch": c_like & (flat.startswith("C") | flat.startswith("F")) & flat.rlike(r"^[CF](?:[{B]|$)") & in_block & ~before.rlike(r"[TR][{B]$|^C") & ~(is_one("java") & before.contains(")")),
        "head": c_like & flat.contains("O(") & flat.rlike(r"O\([^()\[\]{}]*;$") & (after.rlike(r"^[^()\[\]{}]*\)") | (after.endswith(";") & after2.rlike(r"^[^()\[\]{}]*;$"))),
        "go head": is_one("go") & flat.startswith("O") & flat.endswith(";") & after.rlike(r"^[^(){}\[\]]*[{B]$"),
        "case": is_one("js", "ts", "java", "go") & flat.startswith("K") & flat.rlike("^K[^,=({]") & ~opener.contains("S") & (~is_one("go") | opener.rlike("^[IEO]")),
        "first": c_like & above.endswith("S{") & ~flat.rlike("^[KD}]"),
        "from": scripts & (flat.startswith("X;") | flat.startswith("X\x03")) & before.startswith("Y"),
        "unfinished": is_one("java") & flat.endswith("}") & flat.rlike(r"[^{};]\}$") & opener.rlike(r"Z|^[IEOWTCF]"),
        "arm": is_one("rs") & flat.endswith(";") & opener.contains("M") & opener.rlike(r"M[^IOWEM{]*\{$") & flat.rlike(r"^[^()\[\]]+;$"),
    }
    # What needs no more than its neighbours is judged before the last window: the code generated for all rules at once was too long for the JVM to compile.
    judged = linked.select("file_id", "unit", "level", "seq", "upto", joined.alias("joined"), (is_else & in_block).alias("is_else"), _named(rules))
    chained = judged.withColumn("since", F.last(F.when(~F.col("joined"), F.col("upto")), ignorenulls=True).over(upto_here))
    rule = F.when(F.col("is_else") & (F.col("upto") - F.coalesce("since", F.lit(0)) < 1), F.lit("else")).otherwise(F.col("rule"))
    return chained.select("file_id", rule.alias("rule")).unionByName(lexed.select("file_id", F.col("alone").alias("rule"))).where("rule IS NOT NULL")


def _named(rules: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]).alias("rule")


def wrong_alone() -> Column:
    """The name of what is wrong with a single piece of the folded text ``flat``, or null."""
    lang, flat = F.col("lang"), F.col("flat")
    is_one = lambda *names: lang.isin(*names)
    c_like, scripts = is_one("js", "ts", "java"), is_one("js", "ts")
    arrow = alphabet("java")["->"]
    rules = {
        "long head": c_like & flat.rlike(r"O\((?:[^(){}\[\];]*;){3}"),
        "names": is_one("java") & flat.rlike(rf"(?<![@.n])nnn|^[^K]*(?<![^{{}};])nn{arrow}"),
        "over": (scripts & flat.rlike(r"O\([^()\[\]{}P;]*\)")) | (is_one("java") & flat.rlike(r"O\([^()\[\]{}:;]*\)")),
        "assigned": is_one("go") & flat.rlike(r"[A=][^:{}();]*[A=]"),
        "typed": is_one("js") & (flat.rlike(r"U\*?n?:") | F.col("codes").rlike(alphabet("js")["function"] + r"\*?n?\([^?(){}]*:")),
        "let": is_one("rs") & flat.rlike(r"L[^={}();]*=[^{}()\[\]|l?;]*:"),
    }
    return _named(rules)


def unparsable(files: DataFrame) -> DataFrame:
    """file_id of the files whose content is no valid text of the language that the extension claims, each once.

    Content is lexed into rows; a file is a case if two adjacent tokens are no permissible pair of the grammar (an open string
    or comment and a stray sign have no permissible neighbours), if its brackets don't nest, or if a piece of a statement is
    no production. What the code means plays no part.

    A null content and an unknown extension are no cases; an empty content is valid in every language but Go. Repeated rows of
    a file count once, and a file is a case if any of its rows is. An empty table gives an empty result.
    """
    return unparsable_texts(checkpointed(folded(tokens(files))))


def unparsable_texts(lexed: DataFrame) -> DataFrame:
    """:func:`unparsable` of texts that are lexed and folded already; ``lexed`` is read four times."""
    clauses = bad_clauses(lexed).select("file_id")
    return broken_pairs(lexed).unionByName(unnested(lexed)).unionByName(bad_lines(lexed)).unionByName(clauses).distinct()


def parse_rates(files: DataFrame) -> DataFrame:
    """repo, lang, n_files, n_unparsable, share: of the files with content and a known extension."""
    known = files.where(F.col("content").isNotNull()).select("file_id", "repo", language(F.col("path")).alias("lang")).where("lang IS NOT NULL").distinct()
    flagged = unparsable(files).withColumn("bad", F.lit(1))
    return (
        known.join(flagged, "file_id", "left")
        .groupBy("repo", "lang")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_unparsable"))
        .withColumn("share", F.round(F.col("n_unparsable") / F.col("n_files"), 6))
    )
