"""Lexing source text into one character per token, by the alphabets of the grammars."""

from __future__ import annotations

import re
from functools import cache

from loamlens.llm.grammar import PRIMITIVES, alphabet

#: Stands for what no token of the language can be: an open string or comment, a stray sign, an inconsistent dedent.
ERROR = "\x05"

_TEXT, _GAP = "\x06", "\x07"

# Words that are reserved without a use, and signs of more than one character that the grammars leave out.
RESERVED = {"js": ("enum",), "java": ("const", "goto")}

# What hides tokens, by language: the signs it can begin with, and what stands behind the first one. Groups: c comment, s string, o something that was opened and doesn't end.
_LINE, _BLOCK = r"(?<=/)/[^\n]*", r"(?<=/)\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"


def _string(sign: str, escape: str = r"\\(?s:.)", also: str = r"\n") -> str:
    """The rest of a string in ``sign``."""
    return rf"[^{sign}\\{also}]*+(?:{escape}[^{sign}\\{also}]*+)*+{sign}"


def _long_string(sign: str) -> str:
    """The rest of a string in three of ``sign``, behind these."""
    return rf"[^{sign}\\]*+(?:(?:\\(?s:.)|{sign}(?!{sign}{sign}))[^{sign}\\]*+)*+{sign}{sign}{sign}"


_HIDING = {
    "py": (r"\#\\\"'", rf"(?P<c>(?<=\#)[^\n]*|(?<=\\)\r?\n)|(?P<s>(?<=\")(?:\"\"{_long_string('"')}|(?!\"\"){_string('"')})|(?<=')(?:''{_long_string("'")}|(?!''){_string("'")}))|(?P<o>(?<=[\"']))"),
    "js": (r"/\"'`", rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>(?<=\"){_string('"')}|(?<='){_string("'")})|(?P<t>(?<=`))|(?P<r>(?<=/)(?![/*]))|(?P<o>(?<=/)\*|(?<=[\"']))"),
    "go": (r"/\"'`", rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>(?<=\"){_string('"', r"\\.")}|(?<=`)[^`]*`|(?<=')(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{{3}}|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}))')|(?P<o>(?<=/)\*|(?<=[\"'`]))"),
    "java": (r"/\"'", rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>(?<=\")\"\"[ \t\f]*\r?\n{_long_string('"')}|(?<=\"){_string('"', r"\\.")}|(?<=')(?:[^'\\\n]|\\(?:[btnfrs\"'\\]|[0-7]{{1,3}}|u+[0-9a-fA-F]{{4}}))')|(?P<o>(?<=/)\*|(?<=[\"']))"),
    "rs": (r"/bcr\"'", rf"(?P<c>(?<=/)/[^\n]*)|(?P<n>(?<=/)\*)|(?P<s>(?<!\w[bcr\"'])(?:(?:(?<=r)|(?<=[bc])r)(?P<h>\#*)\"(?s:.*?)\"(?P=h)|(?:(?<=\")|(?<=[bc])\"){_string('"', also="")}|(?:(?<=')|(?<=b)')(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{{2}}|u\{{[0-9a-fA-F_]+\}}|[nrt0\\'\"]))'))|(?P<l>(?<=')[^\W\d]\w*)|(?P<o>(?<=[\"']))"),
}
_HIDING["ts"] = _HIDING["js"]
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
_TEMPLATE = re.compile(r"(?s)[^`\\$]*+(?:(?:\\.|\$(?!\{))[^`\\$]*+)*+(`|\$\{)")
_NESTED = re.compile(r"/\*|\*/")
_NUMBER = {
    "py": r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:[1-9](?:_?\d)*|0(?:_?0)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*|\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?(?=[^\w]|[eEjJ])|(?=[eEjJ])))(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?",
    "js": r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?",
    "go": r"0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?i?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?",
    "java": r"0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?",
    "rs": r"0x[0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0b[01_]+(?:[iu]\w+)?|0o[0-7_]+(?:[iu]\w+)?|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d+)?(?:[iuf](?:8|16|32|64|128|size))?",
}
_NUMBER["ts"] = _NUMBER["js"]
#: Words behind which a slash begins a regular expression.
_BEFORE_REGEX = re.compile(r"(?:^|[^\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|do|else|instanceof|yield|await)$")


_SIGN = r"-+*/%&|\^!~<>=?:.@"


@cache
def _signs(lang: str) -> re.Pattern[str]:
    """Words, numbers and signs of several characters, also runs of seven that no language has; single signs stand for themselves."""
    signs = sorted((t for t in alphabet(lang) if len(t) > 1 and not t[0].isalpha() and t != "^^"), key=len, reverse=True)
    words = r"[^\W\d](?:[\w]|\$)*" if lang not in ("js", "ts") else r"(?:[^\W\d]|\$)[\w$]*"
    private = r"|\#[^\W\d]\w*" if lang in ("js", "ts") else ""
    raw = r"r\#[^\W\d]\w*|" if lang == "rs" else ""
    return re.compile(rf"({raw}{words}|(?=[\d.])(?:{_NUMBER[lang]}){private}|(?=[{_SIGN}]{{2}})(?:<{{7}}|>{{7}}|={{7}}|\|{{7}}|" + "|".join(map(re.escape, signs)) + "))")


class _Codes(dict):
    """The codes of tokens; words and numbers that are not known are kept as they come, up to a bound."""

    def __missing__(self, token: str) -> str:
        c = token[0]
        code = "0" if c.isdigit() or c == "." else "h" if c == "#" else ERROR if c in "<>=|" else "n"
        if len(self) < 50_000 and len(token) < 40:
            self[token] = code
        return code


@cache
def _table(lang: str) -> _Codes:
    table = {t: c for t, c in alphabet(lang).items() if not (t.isupper() and len(t) > 1) and t not in ("^", "$", "^^")}
    if "^^" in alphabet(lang):
        table["^"] = "^"
    table |= {w: ERROR for w in RESERVED.get(lang, ())}
    if lang == "java":
        table |= {t: "t" for t in PRIMITIVES if t != "var"}
    if lang == "rs":
        table["_"] = alphabet(lang).get("_", "n")
    return _Codes(table)


def _uncover(lang: str, text: str, spans: list[tuple[int, int, str]] | None = None) -> str:
    """``text`` with comments as gaps (or line ends) and strings as one sign each; an open one ends the text with an error.

    ``spans`` gets begin, end and kind (``c`` or ``s``) of each comment and plain string.
    """
    out: list[str] = []
    at, templates = 0, []
    scan = _hiding(lang, False)
    while True:
        m = scan.search(text, at)
        if not m:
            out.append(text[at:])
            break
        kind = m.lastgroup if m.lastgroup != "h" else "s"
        out.append(text[at : m.start()])
        at = m.end()
        if spans is not None and kind in "cs":
            spans.append((m.start(), at, kind))
        if kind == "c":
            out.append("\n" if "\n" in m[0] and m[0][0] != "\\" else " ")
        elif kind == "s":
            out.append(_TEXT)
        elif kind == "l":
            out.append("\x0e")
        elif kind == "n":
            level = 1
            while level:
                n = _NESTED.search(text, at)
                if not n:
                    return "".join(out) + ERROR
                level += 1 if n[0] == "/*" else -1
                at = n.end()
            if spans is not None:
                spans.append((m.start(), at, "c"))
            out.append(" ")
        elif kind == "r":
            before = "".join(out[-3:]).rstrip()
            last = before[-1:]
            divides = last in (")", "]", "}", _TEXT, "\x0f", "\x11") or ((last.isalnum() or last in "_$") and last and not _BEFORE_REGEX.search(before[-12:]))
            literal = None if divides else _REGEX.match(text, m.start())
            if literal:
                at = literal.end()
                out.append("\x0f")
            else:
                out.append("/")
        else:
            if kind == "b" and not (m[0] == "}" and templates[-1] == 0):
                templates[-1] += 1 if m[0] == "{" else -1
                out.append(m[0])
                continue
            if kind == "b":
                templates.pop()
                out.append(")+")
            elif kind != "t":
                return "".join(out) + ERROR
            piece = _TEMPLATE.match(text, at)
            if not piece:
                return "".join(out) + ERROR
            at = piece.end()
            out.append("\x11")
            if piece[1] == "${":
                templates.append(0)
                out.append("+(")
            scan = _hiding(lang, bool(templates))
    return "".join(out) + (ERROR if templates else "")


@cache
def _hiding(lang: str, in_template: bool) -> re.Pattern[str]:
    """What hides tokens. It begins with a set of signs, so that the search runs from one of them to the next."""
    first, rest = _HIDING[lang]
    return re.compile(rf"[{first}{{}}](?:{rest}|(?P<b>(?<=[{{}}])))" if in_template else rf"[{first}](?:{rest})")


class _Gaps(dict):
    """What becomes of the signs and the white space between words: most stretches are met again and again."""

    def __init__(self, lang: str):
        super().__init__()
        self.plain = {ord(_TEXT): "s", ord("\x0e"): "l", ord("\x0f"): "x", ord("\x11"): "q"} | dict(zip((1, 4, 16), "⇥⇤;", strict=True)) | {ord(c): None for c in " \t\r\f\x0b\xa0\ufeff"}
        self.stray = re.compile("[^" + "".join(re.escape(c) for c in {*alphabet(lang).values(), *"n0shxltq⇥⇤\n"}) + "]")

    def __missing__(self, gap: str) -> str:
        code = self.stray.sub(ERROR, gap.translate(self.plain))
        if len(self) < 50_000 and len(gap) < 40:
            self[gap] = code
        return code


@cache
def _gaps(lang: str) -> _Gaps:
    return _Gaps(lang)


def _coded(lang: str, text: str) -> str:
    if lang == "py" and _TEXT in text:
        text = _PREFIX.sub(_TEXT, text)
    parts = _signs(lang).split(text)
    parts[1::2] = map(_table(lang).__getitem__, parts[1::2])
    parts[0::2] = map(_gaps(lang).__getitem__, parts[0::2])
    return "".join(parts)


_PREFIX = re.compile(rf"(?<!\w)[rRbBuUfFtT]{{1,2}}{_TEXT}")
_BRACKET = re.compile(r"[()\[\]{}]")


def _python_lines(text: str) -> str:
    """Logical lines: ``text`` with a sign for each line end outside brackets, and signs around deeper lines."""
    out, stack, level = [], [0], 0
    tabs = "\t" in text or "\f" in text
    for line in text.split("\n"):
        if not level:
            body = line.lstrip(" \t\f")
            if not body or (body[0] == "\r" and not body.strip(" \t\f\r")):
                continue
            width = len(line) - len(body)
            if tabs:
                width = len(line[:width].replace("\f", "").expandtabs(8))
            if width > stack[-1]:
                stack.append(width)
                out.append("\x01")
            else:
                while width < stack[-1]:
                    stack.pop()
                    out.append("\x04")
                if width != stack[-1]:
                    out.append(ERROR)
        else:
            body = line
        if _BRACKET.search(body):
            n = body.count
            level = max(0, level + n("(") + n("[") + n("{") - n(")") - n("]") - n("}"))
        out.append(body if level else body + "\x10")
    out += ["\x04"] * (len(stack) - 1)
    return "".join(out)


@cache
def _line_ends(lang: str) -> re.Pattern[str]:
    """The line ends that stand for a semicolon."""
    codes = alphabet(lang)
    cls = lambda tokens: "".join(re.escape(codes[t]) for t in tokens if t in codes)
    if lang == "go":
        ends = "n0s)\\]}" + cls(("break", "continue", "fallthrough", "return", "++", "--", "type"))
        return re.compile(rf"\n(?<=[{ends}]\n)")
    ends = "n0sxhwq)\\]}" + cls(("++", "--", "this", "super", "null", "true", "false", "return", "break", "continue", "debugger", "from", "as", "of", "get", "set", "async", "static", "type", "let", "yield", "void", "any", "is"))
    if lang == "ts":
        ends += ">!"
    goes_on = ".,;)\\]}:?=+\\-*/%<>&|\\^(\\[" + cls(("?.", "=>", "**", "==", "!=", "===", "!==", "<=", ">=", "<<", ">>", ">>>", "&&", "||", "??", "in", "instanceof", "+=", "-=", "*=", "/=", "%=", "&&=", "||=", "??=", "&=", "|=", "^=", "as", "from", "catch", "finally", "of"))
    return re.compile(rf"\n(?:(?<=[{ends}]\n)\n*(?![{goes_on}\n]|$)|\n*(?=[{cls(('++', '--'))}]))")


@cache
def _names(lang: str) -> tuple[re.Pattern[str], re.Pattern[str]]:
    """Keywords that are names: behind a dot, and as keys of an object (``default`` may be a label there)."""
    codes = alphabet(lang)
    words = [c for t, c in codes.items() if t.isalpha() and t.islower() and len(t) > 1]
    keys = "".join(c for c in words if c != codes["default"])
    return re.compile(rf"([{re.escape(codes['.'])}{codes['?.']}])[{''.join(words)}]"), re.compile(rf"([{{,]\n*)[{keys}](?=:)")


def lex(lang: str, text: str, spans: list[tuple[int, int, str]] | None = None) -> str:
    """The tokens of ``text`` as one character each, between the signs for its begin and end.

    Words after a dot and keys of objects are names even if they are keywords elsewhere. Missing semicolons are put in.
    ``spans`` gets begin, end and kind (``c`` or ``s``) of the comments and plain strings of ``text``, whose lines must then
    end in LF only, as far as it can be read.
    """
    whole = len(text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("﻿"):
        text = text[1:]
    if lang in ("js", "ts", "rs") and text.startswith("#!") and not text.startswith("#!["):
        text = text.partition("\n")[2] if lang == "rs" or "node" in text.partition("\n")[0] else text
    open_text = _uncover(lang, text, spans)
    if spans and len(text) < whole:
        spans[:] = [(a + whole - len(text), b + whole - len(text), kind) for a, b, kind in spans]
    if lang == "py":
        return "\x02" + _coded(lang, _python_lines(open_text)).replace("\n", "") + "\x03"
    line = _coded(lang, open_text)
    if lang in ("js", "ts"):
        after_dot, key = _names(lang)
        line = key.sub(r"\1n", after_dot.sub(r"\1n", line))
    if lang in ("js", "ts", "go"):
        line = _line_ends(lang).sub(";", line)
    line = line.replace("\n", "")
    return "\x02" + line + "\x03"
