"""The YAML of page headers: indented maps and lists, block and quoted texts over several lines, lists and maps in brackets."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that stand for booleans and for nothing.
TRUE, FALSE, NULL = {"true", "yes", "on"}, {"false", "no", "off"}, {"", "~", "null"}
_INT, _FLOAT = re.compile(r"[-+]?(0|[1-9][0-9_]*)\Z"), re.compile(r"[-+]?([0-9][0-9_]*\.[0-9_]*([eE][-+][0-9]+)?|\.[0-9]+)\Z")
_COMMENT = re.compile(r"(^|\s)#.*\Z")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", " ": " ", '"': '"', "/": "/", "\\": "\\", "\t": "\t", "_": "\xa0", "N": "\x85"}


class BadYaml(ValueError):
    pass


def _plain(text: str):
    low = text.lower()
    if low in NULL:
        return None
    if low in TRUE | FALSE and text in (low, low.title(), low.upper()):
        return low in TRUE
    if _INT.match(text):
        return int(text.replace("_", ""))
    if _FLOAT.match(text):
        return float(text.replace("_", ""))
    if text[0] in "&*!%@`|>,]}" or text[0] in "?-:" and text[1:2] in ("", " "):
        raise BadYaml(text)
    return text


def _fold(lines: list[str]) -> str:
    """Lines of one text: a break is a blank, empty lines are breaks."""
    out, gap = lines[0], 0
    for line in lines[1:]:
        if not line:
            gap += 1
        else:
            out += "\n" * gap + line if gap else (" " if out else "") + line
            gap = 0
    return out + "\n" * gap


def _quoted_end(text: str, at: int) -> int:
    """Where the quoted text that begins at `at` ends, or -1."""
    quote, i = text[at], at + 1
    while i < len(text):
        if quote == '"' and text[i] == "\\":
            i += 2
        elif text[i] == quote:
            if quote == "'" and text[i + 1 : i + 2] == "'":
                i += 2
            else:
                return i
        else:
            i += 1
    return -1


def _unquote(text: str) -> str:
    # a backslash before a break joins the lines
    inner = re.sub(r"\\(\n[ \t]*|.)", lambda m: "" if m[1][0] == "\n" else m[0], text[1:-1], flags=re.S) if text[0] == '"' else text[1:-1]
    if "\n" in inner:
        first, *rest = inner.split("\n")
        inner, gap = first.rstrip(" \t"), 0
        for line in [*[x.strip(" \t") for x in rest[:-1]], rest[-1].lstrip(" \t") + "\0"]:  # the last line ends the text, even an empty one
            gap += 1
            if line:
                inner, gap = inner + ("\n" * (gap - 1) or " ") + line, 0
        inner = inner[:-1]
    if text[0] == "'":
        return inner.replace("''", "'")

    def escaped(m: re.Match) -> str:
        if m[1] in "xuU":
            return chr(int(m[2], 16))
        if m[1] not in _ESCAPES:
            raise BadYaml(m[0])
        return _ESCAPES[m[1]]

    return re.sub(r"\\(?:(x)(?=([0-9a-fA-F]{2}))..|(u)(?=([0-9a-fA-F]{4}))....|(U)(?=([0-9a-fA-F]{8}))........|(.))", lambda m: chr(int(m[2] or m[4] or m[6], 16)) if m[7] is None else escaped(re.match(r"\\(.)()", m[0], re.S)), inner, flags=re.S)


class _Flow:
    """A value in brackets."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def blank(self) -> str:
        self.at = re.compile(r"(\s|(?<=\s)#[^\n]*)*").match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def value(self, stops: str):
        c = self.blank()
        if c in ("[", "{"):
            return self.items(c)
        if c in ("'", '"') and c:
            end = _quoted_end(self.text, self.at)
            if end < 0:
                raise BadYaml(self.text)
            found, self.at = self.text[self.at : end + 1], end + 1
            return _unquote(found)
        end = re.compile(rf"[^{re.escape(stops)}:]*(:(?=[^\s{re.escape(stops)}])[^{re.escape(stops)}:]*)*").match(self.text, self.at).end()
        found, self.at = " ".join(self.text[self.at : end].split()), end
        return _plain(found) if found else None

    def items(self, opening: str):
        closing, out = ("]", []) if opening == "[" else ("}", {})
        self.at += 1
        while self.blank() != closing:
            start = self.at
            key = self.value(",[]{}")
            if self.blank() == ":":
                self.at += 1
                entry = {_key(key): self.value(",[]{}")}
            elif start == self.at:
                raise BadYaml(self.text)
            else:
                entry = {_key(key): None} if opening == "{" else None
            out.append(key if entry is None else entry) if opening == "[" else out.update(entry)
            if self.blank() == ",":
                self.at += 1
            elif self.blank() != closing:
                raise BadYaml(self.text)
        self.at += 1
        return out


def _key(value) -> str:
    if isinstance(value, (list, dict)):
        raise BadYaml("a key in brackets")
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


class _Lines:
    def __init__(self, text: str):
        self.lines, self.i = text.split("\n"), 0

    def next(self) -> tuple[int, str] | None:
        """Indent and content of the next line that isn't blank or a comment."""
        while self.i < len(self.lines):
            line = self.lines[self.i]
            bare = line.lstrip(" ")
            if bare.startswith("\t") and bare.strip():
                raise BadYaml("a tab")
            if line.rstrip() == "...":  # the document's end
                self.i = len(self.lines)
                break
            if bare.strip() and not bare.startswith("#"):
                return len(line) - len(bare), bare.rstrip()
            self.i += 1
        return None

    def block(self, indent: int):
        found = self.next()
        if found[1] == "-" or found[1].startswith("- "):
            return self.sequence(found[0])
        if self.split(found[1]):
            return self.mapping(found[0])
        self.i += 1
        return self.scalar(found[1], indent - 1)

    @staticmethod
    def split(content: str) -> tuple[str, str] | None:
        """Key and rest of a `key: value` line."""
        if content[0] in "\"'":
            end = _quoted_end(content, 0)
            rest = content[end + 1 :].lstrip() if end > 0 else ""
            return (_unquote(content[: end + 1]), rest[1:].strip()) if rest.startswith(":") and rest[1:2] in ("", " ") else None
        if content[0] in "[{":
            return None
        m = re.match(r"([^#]*?(?:\S#[^#]*?)*?)\s*:(?:\s+(.*)|\Z)", content)
        return (_key(_plain(m[1])), (m[2] or "").strip()) if m else None

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while (found := self.next()) and found[0] == indent:
            pair = self.split(found[1])
            if not pair:
                raise BadYaml(found[1])
            self.i += 1
            out[pair[0]] = self.value(pair[1], indent, True)
        if found and found[0] > indent:
            raise BadYaml(found[1])
        return out

    def sequence(self, indent: int) -> list:
        out = []
        while (found := self.next()) and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")):
            rest = found[1][1:].lstrip(" ")
            if rest and (rest.startswith("- ") or rest == "-" or self.split(rest)) and rest[0] not in "|>":
                inner = indent + len(found[1]) - len(rest)
                self.lines[self.i] = " " * inner + rest
                out.append(self.block(inner))
            else:
                self.i += 1
                out.append(self.value(rest, indent, False))
        if found and found[0] > indent:
            raise BadYaml(found[1])
        return out

    def value(self, rest: str, indent: int, of_key: bool):
        bare = _COMMENT.sub("", rest).strip() if rest[:1] not in ("'", '"') else rest
        if not bare:
            found = self.next()
            if found and (found[0] > indent or of_key and found[0] == indent and (found[1] == "-" or found[1].startswith("- "))):
                return self.block(found[0])
            return None
        if bare[0] in "|>":
            return self.literal(bare, indent)
        return self.scalar(rest, indent)

    def literal(self, head: str, indent: int) -> str:
        m = re.match(r"([|>])([-+]?)([1-9]?)([-+]?)\Z", head)
        if not m:
            raise BadYaml(head)
        taken: list[str] = []
        depth = indent + int(m[3]) if m[3] else None
        while self.i < len(self.lines):
            line = self.lines[self.i].rstrip("\r")
            lead = len(line) - len(line.lstrip(" "))
            if line.strip():
                depth = lead if depth is None else depth
                if lead < depth or lead <= indent:
                    break
            taken.append(line)
            self.i += 1
        taken = [x[depth or 0 :] for x in taken]
        kept = len(taken)
        while kept and not taken[kept - 1].strip():
            kept -= 1
        body, tail, chomp = taken[:kept], len(taken) - kept, m[2] or m[4]
        if m[1] == ">":
            text = ""
            for a, b in zip(body, [*body[1:], None]):
                text += a
                if b is None:
                    break
                # a break between two lines of plain text is a blank; empty and indented lines keep theirs
                joined = a and b and a[0] not in " \t" and b[0] not in " \t"
                text += " " if joined else "\n" if not a or not b or a[0] in " \t" or b[0] in " \t" else ""
            text = re.sub(r"(?<=[^\n])\n(\n+)(?=[^ \t\n])", r"\1", text)
        else:
            text = "\n".join(body)
        if chomp == "+":
            return text + "\n" * (tail + bool(body))
        return text + ("\n" if body and not chomp else "")

    def scalar(self, rest: str, indent: int):
        if rest[0] in "'\"":
            while (end := _quoted_end(rest, 0)) < 0:
                if self.i == len(self.lines):
                    raise BadYaml("an open quote")
                rest += "\n" + self.lines[self.i]
                self.i += 1
            if _COMMENT.sub("", rest[end + 1 :]).strip():
                raise BadYaml(rest)
            return _unquote(rest[: end + 1])
        if rest[0] in "[{":
            while True:
                flow = _Flow(rest)
                try:
                    value = flow.items(rest[0])
                    break
                except BadYaml:
                    if self.i == len(self.lines):
                        raise
                    rest += "\n" + self.lines[self.i]
                    self.i += 1
            if _COMMENT.sub("", rest[flow.at :]).strip():
                raise BadYaml(rest)
            return value
        lines = [_COMMENT.sub("", rest).strip()]
        while self.i < len(self.lines) and lines[-1] == (rest.strip() if len(lines) == 1 else lines[-1]):
            line = self.lines[self.i]
            if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
                break
            bare = line.strip()
            if bare.startswith("#"):
                break
            if re.search(r":(\s|\Z)", bare):
                raise BadYaml(bare)
            lines.append(_COMMENT.sub("", bare).strip())
            self.i += 1
        while lines and not lines[-1]:
            lines.pop()
        if re.search(r":(\s|\Z)", lines[0]):
            raise BadYaml(lines[0])
        return _plain(_fold(lines))


def parse(text: str) -> dict:
    """The map that a header holds; an empty one if it holds anything else or can't be read.

    Anchors, tags, several documents and keys in brackets can't be read. Of keys that are repeated the last
    one counts. Dates stay texts.
    """
    lines = _Lines(text.replace("\r\n", "\n"))
    try:
        if lines.next() is None:
            return {}
        value = lines.block(0)
        if lines.next() is not None:
            raise BadYaml("more after the end")
    except (BadYaml, IndexError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


_HEAD = re.compile(r"\s*(?:```[^\n]*\n\s*)?---(.*?)---", re.S)


def header(text: str | None) -> dict:
    """The map of a page's leading block; empty if there is none. A code fence around the page is tolerated."""
    found = _HEAD.match(text or "")
    return parse(found[1]) if found else {}


@F.pandas_udf(T.StringType())
def header_json(texts: pd.Series) -> pd.Series:
    """header() of each text as JSON, keys in their order."""
    return texts.map(lambda t: json.dumps(header(t), ensure_ascii=False))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def header_paths(texts: pd.Series) -> pd.Series:
    """Every plain value of header() under its path, such as `author.name` or `tags[0]`; empty lists and maps, and nothing, have no path."""

    def paths(value, at=""):
        if isinstance(value, dict):
            return [p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)]
        if isinstance(value, list):
            return [p for i, v in enumerate(value) for p in paths(v, f"{at}[{i}]")]
        return [] if value is None else [(at, str(value).lower() if isinstance(value, bool) else str(value))]

    return texts.map(lambda t: dict(paths(header(t))))


def with_header(pages, content: str = "content", to: str = "header"):
    """pages with header_paths() of the content."""
    return pages.withColumn(to, header_paths(F.col(content)))


def at(column: str | Column, path: str) -> Column:
    return F.try_element_at(column, F.lit(path))
