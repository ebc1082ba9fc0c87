"""Tokens of source files, for all parsers of code.

Every lexer goes through the whole file whatever it meets: what can't be a token becomes one of kind
"err", whose text says why, and the next token starts behind it. Comments are tokens too.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id, num, str, op, com, err, end; python also nl, indent, dedent; javascript regex, tpl
    text: str
    at: int
    nl: bool = False  # a line ends between the token before and this one
    extra: tuple = ()  # of python's f-strings: the texts of their expressions


def line_of(text: str, at: int) -> int:
    """Number of the line of a place, from 1; a lone carriage return ends a line too."""
    return bisect_right(_line_starts(text), at) + 1


@lru_cache(maxsize=4)
def _line_starts(text: str) -> list[int]:
    return [m.end() for m in re.finditer(r"\r\n|\r|\n", text)]


_NUM = r"0[xX][0-9a-fA-F_]+[lLn]?|0[bB][01_]+[lLn]?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[fFdDlLnjJ]?"
_JAVA = re.compile(
    r"(?P<ws>[ \t\f\r\n\x1a]+)|(?P<com>//[^\r\n]*|/\*.*?\*/)|(?P<e1>/\*)"
    r'|(?P<str>"""[ \t\f]*\r?\n(?:\\.|(?!""").)*"""|"(?:\\[^\r\n]|[^"\\\r\n])*"|\'(?:\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[^\r\nu])|[^\'\\\r\n])\')'
    rf"|(?P<id>[^\W\d]\w*|\$[\w$]*)|(?P<num>{_NUM})|(?P<op>->|::|\.\.\.|\+\+|--|&&|\|\||==|!=|<=|<<=|<<|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|[-+*/%&|^!~<>=?:;,.()\[\]{{}}@])"
    r"|(?P<e2>[\"'][^\r\n]*)|(?P<e3>.)",
    re.S,
)


def java(text: str) -> list[Token]:
    text = re.sub(r"([A-Za-z0-9_])\$", r"\1_", text)  # dollar signs within names, one for one
    return _scan(_JAVA, text, {"e1": "unterminated comment", "e2": "unterminated literal", "e3": "unexpected character"})


def _scan(pattern: re.Pattern, text: str, errors: dict[str, str]) -> list[Token]:
    out, nl = [], False
    for m in pattern.finditer(text):
        kind, piece = m.lastgroup, m.group()
        if kind == "ws":
            nl = nl or "\n" in piece or "\r" in piece
            continue
        if kind == "com":
            out.append(Token("com", piece, m.start(), nl))
            nl = nl or "\n" in piece
            continue
        if kind in errors:
            out.append(Token("err", f"{errors[kind]}: {piece[:20]!r}", m.start(), nl))
        else:
            out.append(Token(kind, piece, m.start(), nl))
        nl = False
    out.append(Token("end", "", len(text), True))
    return out


_JS = re.compile(
    r"(?P<ws>[\s\ufeff]+)|(?P<com>//[^\r\n  ]*|/\*.*?\*/|\A#![^\r\n]*)|(?P<e1>/\*)"
    r"|(?P<str>\"(?:\\(?:\r\n|.)|[^\"\\\r\n])*\"|'(?:\\(?:\r\n|.)|[^'\\\r\n])*')"
    rf"|(?P<id>#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{{4}})(?:[\w$]|\\u[0-9a-fA-F]{{4}})*)|(?P<num>{_NUM})"
    r"|(?P<op>=>|\.\.\.|\?\?=|\?\?|\?\.(?!\d)|\*\*=|\*\*|===|!==|==|!=|<<=|>>>=|>>>|>>=|<<|>>|<=|>=|&&=|\|\|=|&&|\|\||\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|/=|[-+*/%&|^!~<>=?:;,.()\[\]{}@])"
    r"|(?P<tick>`)|(?P<e2>[\"'][^\r\n]*)|(?P<e3>.)",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\[^\r\n]|\[(?:\\[^\r\n]|[^\]\\\r\n])*\]|[^/\\\[\r\n])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
# Words after which a slash opens a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new do else instanceof yield await default".split())


def javascript(text: str) -> list[Token]:
    """A template is a "tpl" token for its start, for each stretch between two values and for its end;
    the tokens of its values stand between."""
    out: list[Token] = []
    at, nl, n = 0, False, len(text)
    braces: list[bool] = []  # of open braces: whether a template's value ends with it
    last: Token | None = None

    def template(start: int, opening: bool) -> int:
        m = _TEMPLATE.match(text, start)
        end = m.end()
        if text.startswith("${", end):
            out.append(Token("tpl", "open" if opening else "mid", start, nl))
            braces.append(True)
            return end + 2
        if text.startswith("`", end):
            out.append(Token("tpl", "whole" if opening else "close", start, nl))
            return end + 1
        out.append(Token("err", "unterminated template", start, nl))
        return n

    while at < n:
        if text[at] == "/" and not text.startswith(("//", "/*"), at):
            ends = last is not None and (last.kind in ("num", "str", "regex") or (last.kind == "tpl" and last.text in ("whole", "close")) or (last.kind == "id" and last.text not in _BEFORE_REGEX) or last.text in (")", "]"))
            m = None if ends else _REGEX.match(text, at)
            if m:
                last = Token("regex", m.group(), at, nl)
                out.append(last)
                at, nl = m.end(), False
                continue
        m = _JS.match(text, at)
        kind, piece = m.lastgroup, m.group()
        if kind == "ws":
            nl = nl or any(c in piece for c in "\n\r\u2028\u2029")
            at = m.end()
            continue
        if kind == "com":
            out.append(Token("com", piece, at, nl))
            nl = nl or "\n" in piece
            at = m.end()
            continue
        if kind == "tick":
            at = template(at + 1, True)
        elif piece == "}" and braces and braces.pop():
            at = template(at + 1, False)
        else:
            if piece == "{":
                braces.append(False)
            why = {"e1": "unterminated comment", "e2": "unterminated string", "e3": "unexpected character"}.get(kind)
            out.append(Token("err", f"{why}: {piece[:20]!r}", at, nl) if why else Token(kind, piece, at, nl))
            at = m.end()
        last, nl = out[-1], False
    out.append(Token("end", "", n, True))
    return out


_SQL = re.compile(
    r"(?P<ws>\s+)|(?P<com>--[^\r\n]*)|(?P<open>/\*)"
    r"|(?P<str>[eE]'(?:\\.|''|[^'\\])*'|(?:[bBxXnN]|[uU]&)?'(?:''|[^'])*')|(?P<dollar>\$(?P<tag>(?:[^\W\d]\w*)?)\$.*?\$(?P=tag)\$)"
    r'|(?P<id>(?:[uU]&)?"(?:""|[^"])+"|[^\W\d][\w$]*)|(?P<num>0[xX][0-9a-fA-F]+|(?:\d[\d_]*(?:\.(?!\.)\d*)?|\.\d+)(?:[eE][+-]?\d+)?|\$\d+)'
    r"|(?P<op>::|:=|\.\.|=>|<=|>=|<>|!=|[-+*/<>=~!@#%^&|`?]+(?<!--)|[()\[\],;:.])|(?P<e1>')|(?P<e2>\$(?:[^\W\d]\w*)?\$)|(?P<e3>.)",
    re.S,
)
_NESTED = re.compile(r"/\*|\*/")


def sql(text: str) -> list[Token]:
    """PostgreSQL: comments nest, and a body between dollar quotes is one token of kind "dollar"."""
    out: list[Token] = []
    at, nl, n = 0, False, len(text)
    while at < n:
        m = _SQL.match(text, at)
        kind, piece = m.lastgroup, m.group()
        kind = "dollar" if kind == "tag" else kind
        if kind == "op" and len(piece) > 1:  # an operator ends where a comment starts
            for mark in ("--", "/*"):
                if mark in piece:
                    piece = piece[: piece.index(mark)] or piece[0]
        end = at + len(piece)
        if kind == "open":
            depth, end = 1, at + 2
            while depth and (c := _NESTED.search(text, end)):
                depth += 1 if c.group() == "/*" else -1
                end = c.end()
            if depth:
                out.append(Token("err", "unterminated comment", at, nl))
                end = n
            else:
                out.append(Token("com", text[at:end], at, nl))
        elif kind == "ws":
            nl = nl or "\n" in piece or "\r" in piece
        elif kind in ("e1", "e2"):
            out.append(Token("err", "unterminated literal", at, nl))
            end = n
        elif kind == "e3":
            out.append(Token("err", f"unexpected character: {piece!r}", at, nl))
        else:
            out.append(Token(kind, piece, at, nl))
        if kind not in ("ws", "com", "open"):
            nl = False
        at = end
    out.append(Token("end", "", n, True))
    return out


_PY = re.compile(
    r"(?P<ws>[ \t\f]+|\\\r?\n|\\\r)|(?P<nl>\r\n|\n|\r)|(?P<com>#[^\r\n]*)"
    r"|(?P<f>(?:[fF][rR]?|[rR][fF])(?P<fq>'''|\"\"\"|'|\"))"
    r"|(?P<str>(?:[rR][bB]?|[bB][rR]?|[uU])?(?:'''(?:\\.|(?!''').)*'''|\"\"\"(?:\\.|(?!\"\"\").)*\"\"\"|''(?!')|'(?!')(?:\\(?:\r\n|.)|[^'\\\r\n])+'|\"\"(?!\")|\"(?!\")(?:\\(?:\r\n|.)|[^\"\\\r\n])+\"))"
    r"|(?P<e0>(?:[rR][bB]?|[bB][rR]?|[uU])?(?:'''|\"\"\"))|(?P<e1>(?:[rR][bB]?|[bB][rR]?|[uU])?['\"][^\r\n]*)"
    rf"|(?P<num>0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)|(?P<id>[^\W\d]\w*)"
    r"|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>=:;,.()\[\]{}])|(?P<e3>.)",
    re.S,
)
_CLOSING = {")": "(", "]": "[", "}": "{"}


def _f_string(text: str, at: int, quote: str, raw: bool) -> tuple[int, list[tuple[str, int]], str]:
    """End of an f-string whose quote starts at `at`, its expressions with their places, and what's wrong."""
    exprs: list[tuple[str, int]] = []
    n, i = len(text), at + len(quote)
    levels: list[str] = ["text"]  # text, or spec within a value
    while i < n:
        if levels[-1] == "text" and text.startswith(quote, i):
            return i + len(quote), exprs, ""
        c = text[i]
        if levels[-1] == "spec" and text.startswith(quote, i):
            return i + len(quote), exprs, "f-string: expecting '}'"
        if c in "\r\n" and len(quote) == 1:
            return i, exprs, "unterminated f-string"
        if c == "\\" and not raw and i + 1 < n:
            i += 3 if text.startswith("\\\r\n", i) else 2
        elif c == "\\" and raw and i + 1 < n and text[i + 1] not in "{}":
            i += 2
        elif levels[-1] == "text" and c in "{}" and text.startswith(c * 2, i):
            i += 2
        elif c == "}":
            if len(levels) == 1:
                return _f_rest(text, i + 1, quote), exprs, "f-string: single '}'"
            levels.pop()
            i += 1
        elif c == "{":
            start, depth, i = i + 1, 0, i + 1
            while i < n:
                m = _PY.match(text, i)
                kind, piece = m.lastgroup, m.group()
                kind = "f" if kind == "fq" else kind
                if depth == 0 and (piece[0] in "}:!" and piece != "!=" or text[i] in ":}"):
                    break
                if len(quote) == 1 and kind in ("e1",) and piece.startswith(quote) or kind == "nl" and len(quote) == 1 and text[i - 1 : i] != "\\" and False:
                    return i + 1, exprs, "f-string: expecting '}'"
                if kind == "f":
                    end, _, why = _f_string(text, m.end() - len(m.group("fq")), m.group("fq"), "r" in piece.lower())
                    if why:
                        return _f_rest(text, start, quote), exprs, why
                    i = end
                    continue
                if kind == "com":
                    i = m.end()
                    continue
                if piece in "([{":
                    depth += 1
                elif piece in ")]}":
                    depth -= 1
                    if depth < 0:
                        return _f_rest(text, i, quote), exprs, "f-string: unmatched bracket"
                elif kind in ("e0", "e1", "e3"):
                    return _f_rest(text, start, quote), exprs, "f-string: expecting '}'"
                i = m.end()
            else:
                return n, exprs, "unterminated f-string"
            body = text[start:i]
            if re.search(r"(?<![=!<>:])=\s*$", body):
                body = re.sub(r"=(\s*)$", r" \1", body)
            exprs.append((body, start))
            if text[i] == "!":
                m = re.compile(r"![ \t]*[sra]\s*(?=[:}])").match(text, i)
                if not m:
                    return _f_rest(text, i, quote), exprs, "f-string: invalid conversion"
                i = m.end()
            if text[i] == ":":
                levels.append("spec")
                i += 1
            else:
                i += 1
        else:
            i += 1
    return n, exprs, "unterminated f-string"


def _f_rest(text: str, at: int, quote: str) -> int:
    """Where lexing goes on behind a broken f-string."""
    if len(quote) == 3:
        end = text.find(quote, at)
        return len(text) if end < 0 else end + 3
    m = re.compile(r"[^\r\n]*").match(text, at)
    return m.end()


_INDENT, _LETTER, _AFTER_NUMBER = re.compile(r"[ \t\f]*"), re.compile(r"[^\W\d]"), re.compile(r"(?:and|else|for|if|in|is|not|or)\b")


def python(text: str) -> list[Token]:
    """Tokens with nl, indent and dedent. Comments are kept; blank lines give no nl."""
    out: list[Token] = []
    at, n = 1 if text.startswith("\ufeff") else 0, len(text)
    indents, brackets, fresh, word = [0], [], True, False
    alt = [0]  # indents with tabs as one
    while at < n:
        if fresh and not brackets:
            m = _INDENT.match(text, at)
            head = m.group().rpartition("\f")[2]
            rest = text[m.end() : m.end() + 1]
            at, fresh = m.end(), False
            if rest and rest not in "#\r\n" and not text.startswith(("\\\n", "\\\r"), at):
                width, plain = len(head.expandtabs(8)), len(head.expandtabs(1))
                if width == indents[-1]:
                    if plain != alt[-1]:
                        out.append(Token("err", "inconsistent use of tabs", at))
                elif width > indents[-1]:
                    if plain <= alt[-1]:
                        out.append(Token("err", "inconsistent use of tabs", at))
                    indents.append(width)
                    alt.append(plain)
                    out.append(Token("indent", "", at))
                else:
                    while indents[-1] > width:
                        indents.pop()
                        alt.pop()
                        out.append(Token("dedent", "", at))
                    if indents[-1] != width:
                        out.append(Token("err", "unindent does not match any outer level", at))
                    elif plain != alt[-1]:
                        out.append(Token("err", "inconsistent use of tabs", at))
            if at >= n:
                break
        m = _PY.match(text, at)
        kind, piece = m.lastgroup, m.group()
        kind = "f" if kind == "fq" else kind
        end = m.end()
        if kind == "nl":
            if not brackets:
                if word:
                    out.append(Token("nl", "", at))
                fresh, word = True, False
        elif kind == "com":
            out.append(Token("com", piece, at))
        elif kind == "f":
            quote = m.group("fq")
            end, exprs, why = _f_string(text, end - len(quote), quote, "r" in piece.lower())
            if why:
                out.append(Token("err", why, at))
            out.append(Token("str", text[at:end], at, False, tuple(exprs)))
            word = True
        elif kind != "ws":
            word = True
            if kind == "e0":
                out.append(Token("err", "unterminated triple-quoted string", at))
                end = n
            elif kind == "e1":
                out.append(Token("err", "unterminated string", at))
            elif kind == "e3":
                out.append(Token("err", f"invalid character: {piece!r}", at))
            else:
                if piece in ("(", "[", "{"):
                    if len(brackets) == 200:  # as many as the language's own parser follows
                        out.append(Token("err", "too many nested brackets", at))
                    brackets.append((piece, at))
                elif piece in _CLOSING:
                    if brackets and brackets[-1][0] == _CLOSING[piece]:
                        brackets.pop()
                    else:
                        out.append(Token("err", f"unmatched {piece!r}", at))
                        brackets.clear()
                if kind == "num" and _LETTER.match(text, end) and not _AFTER_NUMBER.match(text, end):
                    out.append(Token("err", "invalid number", at))
                elif kind == "num" and re.fullmatch(r"0[\d_]*[1-9][\d_]*", piece):
                    out.append(Token("err", "leading zeros in a number", at))
                out.append(Token(kind, piece, at))
        at = end
    if brackets:
        out.append(Token("err", f"{brackets[-1][0]!r} was never closed", brackets[-1][1]))
    if word:
        out.append(Token("nl", "", n))
    out += [Token("dedent", "", n)] * (len(indents) - 1)
    out.append(Token("end", "", n))
    return out
