"""Comments in source texts and the declarations they may belong to."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

_TAG = re.compile(r"\s*(?:[@:\\](?=[A-Za-z])|[-*]\s+[@:\\](?=[A-Za-z])|(?:Args|Arguments|Parameters|Returns|Raises|Yields|Examples?|Notes?)\s*:)")
_DOC_ATTRIBUTE = re.compile(r"\s*#!?\[doc\s*=\s*\"((?:[^\"\\]|\\.)*)\"\s*\]\s*")
_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*+(?!/)|//[/!]*|#+!?)?[ \t]?")
_DEF = re.compile(r"def[ \t]+\w+[ \t]*(?:\[[^\]]*\])?[ \t]*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)[^:\n]*:")
_INTO_BODY = re.compile(r"[ \t]*(?:\n[ \t]*)*")
_WORD, _END_MARK, _BRACKET = re.compile(r"\w"), re.compile(r"\*+/\s*$"), re.compile(r"[()\[\]{}]")
_BLANKS, _OPENING = re.compile(r"[ \t\f]*"), re.compile(r"[ \t]*\(")
_INTERFACE, _INTERFACE_LINE = re.compile(r"@interface\b"), re.compile(r"\s*@interface\b")
_ANNOTATION = re.compile(r"[\w$.:]+|<[^<>()\n;{}]*(?:<[^<>()\n;{}]*>[^<>()\n;{}]*)*>(?=\()")
_QUOTED = re.compile(r"^(\"\"\"|'''|\"|')((?s:.*))\1$")


def _plain(block: list[str]) -> str:
    """The text of a comment without its marks."""
    lines = []
    for line in block:
        attribute = _DOC_ATTRIBUTE.fullmatch(line) if "[doc" in line else None
        if attribute:
            lines.append(attribute[1].replace("\\n", "\n").replace('\\"', '"'))
            continue
        line = line[_MARKS.match(line).end() :]
        lines.append((_END_MARK.sub("", line) if "*/" in line else line).rstrip())
    return "\n".join(lines).strip()


def _units(text: str) -> list[str]:
    """The paragraphs and tags of a description, each on one line."""
    units: list[str] = []
    fresh = True
    for line in text.split("\n"):
        if not line.strip():
            fresh = True
        elif fresh or _TAG.match(line) or not _WORD.search(line):
            units.append(line.strip())
            fresh = not _WORD.search(line)
        else:
            units[-1] += " " + line.strip()
    return units


_CLOSING = {"(": ")", "[": "]", "{": "}"}


def _behind_group(text: str, at: int) -> int:
    """The place behind the bracket that closes the one at ``at``, or the end of the text."""
    awaited = []
    for m in _BRACKET.finditer(text, at):
        if m[0] in _CLOSING:
            awaited.append(_CLOSING[m[0]])
        elif awaited and m[0] == awaited[-1]:
            awaited.pop()
            if not awaited:
                return m.end()
    return len(text)


def _behind_annotations(text: str, at: int) -> int:
    """The place behind the annotations, decorators or attributes that begin in the line at ``at``; a following one on another line is left."""
    at, n = _BLANKS.match(text, at).end(), len(text)
    while at < n and not _INTERFACE.match(text, at):
        if text.startswith(("#[", "#!["), at):
            at = _behind_group(text, text.index("[", at))
        elif text[at] == "@":
            at += 1
            if text[at : at + 1] == "(":
                at = _behind_group(text, at)
            while True:
                m = _ANNOTATION.match(text, at)
                if m:
                    at = m.end()
                opened = _OPENING.match(text, at)
                if opened:
                    at = _behind_group(text, opened.end() - 1)
                elif not m:
                    break
        else:
            break
        at = _BLANKS.match(text, at).end()
    return at


def _commented_lines(lang: str, text: str, lines: list[str], code: list[str], spans: list[tuple[int, int, str]]) -> set[int]:
    """The lines that hold nothing but comment, found from the comments; ``code`` are the lines without them."""
    held, line, at = set(), 0, 0
    for a, b, kind in spans:
        if kind == "c":
            line += text.count("\n", at, a)
            at = a
            blank = text.find("\n\n", a, b) >= 0  # blank lines within one comment belong to it
            for i in range(line, line + text.count("\n", a, b) + 1):
                if (blank or lines[i].strip()) and not code[i].strip():
                    held.add(i)
    if lang == "rs" and "[doc" in text:
        held.update(i for i, x in enumerate(lines) if "[doc" in x and _DOC_ATTRIBUTE.fullmatch(x))
    return held


def _definitions(shown: str) -> Iterator[tuple[int, int]]:
    """Begin of the line and end of the heads of functions in Python, up to the colon."""
    at = end = 0
    while m := _DEF.search(shown, at):
        begin = shown.rfind("\n", 0, m.start()) + 1
        before = shown[begin : m.start()]
        blank = before.strip(" \t")
        if begin >= end and (not blank or (blank == "async" and before[-1] in " \t")):
            yield begin, m.end()
            at = end = m.end()
        else:
            at = m.start() + 3


def comment_blocks(lang: str, text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[str, int, int, int, str, list[str]]]:
    """kind, first line, line of the declaration the block may belong to, blank lines between, text and its units.

    ``spans`` are the begins, ends and kinds of the comments and plain strings, as the lexer finds them.

    A block is made of adjacent lines that hold nothing but comment (in Rust also doc attributes). It may belong to the first
    line behind it that is neither blank nor wholly part of decorators, annotations or attributes. In Python a string that begins the
    body of a function belongs to the line of its ``def``.
    """
    if lang == "py":
        spans = [x for x in spans if text[x[0]] != "\\"]
    elif "@" not in text and "#[" not in text:  # only the brackets of annotations could be taken for those of a string in a line
        spans = [x for x in spans if x[2] == "c" or text.find("\n", x[0], x[1]) >= 0]
    if lang != "py" and not any(kind == "c" for _, _, kind in spans) and not (lang == "rs" and "[doc" in text):
        return
    lines = text.split("\n")
    masked, last = [], 0
    for a, b, kind in spans:
        sign = " " if kind == "c" else "s"
        masked += [text[last:a], sign * (b - a) if text.find("\n", a, b) < 0 else "\n".join([sign * len(part) for part in text[a:b].split("\n")])]
        last = b
    shown = "".join([*masked, text[last:]])
    code = shown.split("\n")
    commented, j, n = _commented_lines(lang, text, lines, code, spans), 0, len(lines)
    starts: list[int] = []
    for i in sorted(commented):
        if i < j:
            continue
        j = i + 1
        while j in commented:
            j += 1
        k, blanks = j, 0
        while k < n:
            bare = code[k].lstrip()
            if not bare:
                blanks += 1
                k += 1
                continue
            if not bare.startswith(("@", "#[")) or _INTERFACE_LINE.match(code[k]):
                break
            if lang != "py":
                starts = starts or list(accumulate(map(len, code), lambda at, size: at + size + 1, initial=0))
                at = _behind_annotations(shown, starts[k])
                k += shown.count("\n", starts[k], at)
                if code[k][at - starts[k] :].strip():
                    break
                k += 1
                continue
            depth = 0
            while k < n:
                depth += sum(code[k].count(c) for c in "([{") - sum(code[k].count(c) for c in ")]}")
                k += 1
                if depth <= 0:
                    break
        if k < n and blanks <= 1:
            plain = _plain(lines[i:j])
            yield "comment", i + 1, k + 1, blanks, plain, _units(plain)
    if lang == "py":
        strings = {a: b for a, b, kind in spans if kind == "s"}
        line, at = 1, 0
        for begin, end in _definitions(shown):
            start = _INTO_BODY.match(shown, end).end()
            start += shown[start : start + 1] in tuple("rRuU")
            if start in strings:
                to = shown.find("\n", strings[start])
                after = shown[strings[start] : to if to >= 0 else None].strip()
                if not after or after.startswith(";"):
                    raw = _QUOTED.sub(r"\2", text[start : strings[start]])
                    plain = "\n".join([x.strip() for x in raw.split("\n")]).strip()
                    line += shown.count("\n", at, begin)
                    at = begin
                    yield "docstring", line, line, 0, plain, _units(plain)
