"""Expressions on texts and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(text: Column, size: int, mark: str = "…") -> Column:
    """``text`` cut to ``size`` characters, the last of them ``mark`` where something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 1), F.lit(mark))).otherwise(text)


def first_sentence(doc: Column, size: int = 200) -> Column:
    """The first sentence of a comment without its marks, at most ``size`` characters."""
    plain = F.regexp_replace(doc, r"(?m)^[ \t]*(/\*+|\*+/|\*|///?|#)[ \t]?", "")
    flat = F.trim(F.regexp_replace(F.regexp_replace(plain, r"\*/", ""), r"[ \t\r\n]+", " "))
    sentence = F.regexp_extract(flat, r"^[^.!?]*[.!?]", 0)
    return F.substring(F.when(sentence != "", sentence).otherwise(flat), 1, size)


def estimated_tokens(text: Column) -> Column:
    """A rough number of tokens: a token for each three and a half characters."""
    return F.ceil(F.length(text) / 3.5).cast("bigint")


def size_text(size: Column) -> Column:
    """A number of bytes as text in B, KB or MB, the latter with one decimal."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit("B")))
        .when(size < 1048576, F.format_string("%.1fKB", size / 1024.0))
        .otherwise(F.format_string("%.1fMB", size / 1048576.0))
    )


def line_count(text: Column) -> Column:
    """The number of lines: line ends plus one, 0 for an empty text."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(ends + 1).cast("bigint")


def word_count(text: Column) -> Column:
    """The number of runs without white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\r\n]+"), F.lit(0))).cast("bigint")


def short_hash(text: Column) -> Column:
    """The first sixteen hexadecimal digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, 16)
