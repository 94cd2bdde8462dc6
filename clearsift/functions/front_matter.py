"""The head of a markdown file: keys with plain, quoted, folded and nested values.

It reads block mappings and lists by their indentation, lists and mappings in
brackets, quoted texts over several lines, and literal and folded blocks.  What
it cannot read is an error and never a default.
"""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("clearance", T.StringType()),
        T.StructField("departments", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)
# What a backslash stands for before a letter, and the words for null.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " ", "a": "\a",
           "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", "N": "\x85", "_": "\xa0"}
CODES = {"x": 2, "u": 4, "U": 8}
NULLS = ("", "~", "null", "Null", "NULL")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[\]{},#&*!|>%@`-][^#]*?|-[^\s#][^#]*?)[ \t]*:(?=[ \t]|$)""")
_COMMENT = re.compile(r"(?:^|[ \t])#.*$")


class Unreadable(ValueError):
    """The head is not of the kinds of values read here."""


def read(head: str) -> dict:
    """The values of a head; all scalars are texts, null is None."""
    lines = [line.rstrip("\r") for line in head.split("\n")]
    value, at = _block(lines, _next(lines, 0), 0)
    if _next(lines, at) < len(lines):
        raise Unreadable("a line outside any value")
    if not isinstance(value, dict):
        raise Unreadable("no mapping")
    return value


def _next(lines, at):
    """The next line that is neither blank nor a comment."""
    while at < len(lines) and not lines[at].split("#")[0].strip() and lines[at].lstrip()[:1] in ("", "#"):
        at += 1
    return at


def _depth(line):
    text = line.lstrip(" ")
    if text.startswith("\t"):
        raise Unreadable("a tab before a value")
    return len(line) - len(text)


def _block(lines, at, least):
    """A mapping or list that begins at a line, at least so deep."""
    if at >= len(lines) or _depth(lines[at]) < least:
        return None, at
    depth = _depth(lines[at])
    entry = lambda text: text == "-" or text.startswith("- ")
    if entry(lines[at][depth:]):
        items = []
        while at < len(lines) and _depth(lines[at]) == depth and entry(lines[at][depth:]):
            rest = lines[at][depth + 1 :]
            inner = depth + 1 + len(rest) - len(rest.lstrip(" "))
            if _KEY.match(rest.strip()) or entry(rest.strip()):  # a mapping or list that starts here
                lines[at] = " " * inner + rest.strip()
                value, at = _block(lines, at, inner)
            else:
                value, at = _value(lines, at, rest, depth)
            items.append(value)
            at = _next(lines, at)
        return items, at
    found = {}
    while at < len(lines) and _depth(lines[at]) == depth:
        key = _KEY.match(lines[at][depth:])
        if not key:
            raise Unreadable("a line without a key")
        name = key[1]
        name = _quoted(name)[0] if name[0] in "\"'" else name
        if name in found:
            raise Unreadable("a key twice")
        found[name], at = _value(lines, at, lines[at][depth + key.end() :], depth)
        at = _next(lines, at)
    return found, at


def _value(lines, at, rest, depth):
    """The value that begins behind a key or dash, and the line after it."""
    rest = rest.strip()
    if rest[:1] in ("|", ">"):
        return _text(lines, at + 1, rest, depth)
    if not _COMMENT.sub("", rest).strip():
        below = _next(lines, at + 1)
        if below < len(lines) and (_depth(lines[below]) > depth or lines[below][depth:].startswith("- ") and _depth(lines[below]) == depth):
            if _depth(lines[below]) > depth and not _KEY.match(lines[below].strip()) and lines[below].strip()[:1] not in ("-",):
                return _value(lines, below, lines[below], depth)
            return _block(lines, below, depth)
        return None, at + 1
    if rest[0] in "\"'":
        while True:
            try:
                text, end = _quoted(rest)
                break
            except EOFError:
                at += 1
                if at >= len(lines):
                    raise Unreadable("an open quote") from None
                rest = _folded(rest, lines[at])
        if _COMMENT.sub("", rest[end:]).strip():
            raise Unreadable("text behind a quote")
        return text, at + 1
    if rest[0] in "[{":
        while True:
            try:
                value, end = _flow(rest, 0)
                break
            except EOFError:
                at += 1
                if at >= len(lines):
                    raise Unreadable("an open bracket") from None
                rest += " " + _COMMENT.sub("", lines[at]).strip()
        if _COMMENT.sub("", rest[end:]).strip():
            raise Unreadable("text behind a bracket")
        return value, at + 1
    if rest[0] in "&*!%@`":
        raise Unreadable("a kind of value that is not read")
    text, commented = _COMMENT.sub("", rest).strip(), bool(_COMMENT.search(rest))
    at += 1
    while not commented and at < len(lines) and (not lines[at].strip() or _depth(lines[at]) > depth):
        if lines[at].lstrip().startswith("#"):
            break
        text = _folded(text, lines[at])
        at += 1
    text = text.rstrip()
    if re.search(r":(?=\s|$)", text):
        raise Unreadable("a key inside a text")
    return (None if text in NULLS else text), at


def _folded(text, line):
    """One more line of a text: a break is a blank, an empty line a break."""
    line = line.strip()
    if not line:
        return text.rstrip(" ") + "\n"
    if text.endswith("\\") and not text.endswith("\\\\"):
        return text[:-1] + line
    return text + ("" if text.endswith("\n") else " ") + line


def _text(lines, at, header, depth):
    """A literal or folded block."""
    style = re.fullmatch(r"([|>])([+-]?)([1-9]?)([+-]?)(?:\s+#.*)?", header)
    if not style:
        raise Unreadable("a block header")
    keep, held = style[2] or style[4], []
    inner = depth + int(style[3]) if style[3] else None
    while at < len(lines):
        line = lines[at]
        if line.strip(" "):
            if _depth(line) <= depth or inner is not None and _depth(line) < inner:
                break
            inner = _depth(line) if inner is None else inner
        held.append(line)
        at += 1
    held = [line[inner or 0 :] if line.strip(" ") else "" for line in held]
    tail = 0
    while held and not held[-1]:
        held.pop()
        tail += 1
    if style[1] == "|":
        text = "\n".join(held)
    else:
        text, broken = "", True
        for line in held:
            more = line.startswith(" ")
            if not line:
                text, broken = text + "\n", True
            elif more:
                text, broken = text + ("" if not text or text.endswith("\n") else "\n") + line + "\n", True
            else:
                text, broken = text + ("" if broken else " ") + line, False
        text = text.rstrip("\n")
    if held and keep != "-":
        text += "\n" * (1 + tail if keep == "+" else 1)
    return text, at


def _quoted(text):
    """A quoted text and where it ends; EOFError if it goes on."""
    if text[0] == "'":
        end = 1
        while True:
            end = text.find("'", end)
            if end < 0:
                raise EOFError
            if text[end + 1 : end + 2] != "'":
                return text[1:end].replace("''", "'"), end + 1
            end += 2
    out, at = [], 1
    while at < len(text):
        char = text[at]
        if char == '"':
            return "".join(out), at + 1
        if char == "\\":
            at += 1
            if at >= len(text):
                raise EOFError
            many = CODES.get(text[at])
            if many:
                out.append(chr(int(text[at + 1 : at + 1 + many], 16)))
                at += many
            elif text[at] in ESCAPES:
                out.append(ESCAPES[text[at]])
            else:
                raise Unreadable("an unknown escape")
        else:
            out.append(char)
        at += 1
    raise EOFError


def _flow(text, at):
    """A list or mapping in brackets, and where it ends."""
    closing, items, found = {"[": "]", "{": "}"}[text[at]], [], {}
    at += 1
    while True:
        while text[at : at + 1] in (" ", "\t"):
            at += 1
        if at >= len(text):
            raise EOFError
        if text[at] == closing:
            return (items if closing == "]" else found), at + 1
        value, at = _flow_value(text, at, ",]}:" if closing == "}" else ",]}")
        if closing == "}":
            if text[at : at + 1] != ":":
                raise Unreadable("a mapping without a colon")
            found[value], at = _flow_value(text, at + 1, ",]}")
        else:
            items.append(value)
        if at >= len(text):
            raise EOFError
        if text[at] == ",":
            at += 1
        elif text[at] != closing:
            raise Unreadable("brackets that do not match")


def _flow_value(text, at, stops):
    while text[at : at + 1] in (" ", "\t"):
        at += 1
    if at >= len(text):
        raise EOFError
    if text[at] in "[{":
        value, at = _flow(text, at)
    elif text[at] in "\"'":
        value, end = _quoted(text[at:])
        at += end
    else:
        end = at
        while end < len(text) and text[end] not in stops:
            end += 1
        if end >= len(text):
            raise EOFError
        value, at = text[at:end].strip(), end
        value = None if value in NULLS else value
    while text[at : at + 1] in (" ", "\t"):
        at += 1
    return value, at


def fields_of(head: str | None) -> tuple:
    """Title, clearance and departments of a head, or what is wrong with it."""
    try:
        found = read(head or "")
        title, clearance = found.get("title"), found.get("clearance")
        departments = found.get("departments") or []
        if isinstance(title, (list, dict)) or isinstance(clearance, (list, dict)):
            raise Unreadable("a list for a text")
        if not isinstance(departments, list) or not all(isinstance(d, str) for d in departments):
            raise Unreadable("departments are no list of names")
    except (Unreadable, EOFError, ValueError, RecursionError) as wrong:
        return None, None, None, str(wrong) or "cut off"
    return title, clearance, departments or None, None


@F.pandas_udf(FIELDS)
def _fields(heads: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fields_of(h) for h in heads], columns=FIELDS.names)


def header_fields(head: Column) -> Column:
    """Title, clearance and departments of a head as a struct; ``error`` instead
    of a value where it cannot be read."""
    return _fields(head)
