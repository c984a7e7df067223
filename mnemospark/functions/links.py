"""Links of Markdown texts: inline, by reference, and in angle brackets.

Brackets are kept on a stack and closed from the inside, so nested ones belong to their own link and a link holds no other; code, escaped
brackets and images are no links. A text's blocks are told apart as far as links need it: fenced and indented code, definitions of references,
and lines that begin a new block. HTML blocks are read like text, without what stands in their tags.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINKS = T.ArrayType(T.StructType([T.StructField("target", T.StringType()), T.StructField("label", T.StringType()), T.StructField("ordinal", T.IntegerType())]))

ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
ADDRESS = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>\x00-\x1f]*)>")
MAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*)>")
TAG = re.compile(r"""</?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*\s*/?>|<!--.*?-->""", re.S)
TITLE = r"""(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\))"""
DEFINITION = re.compile(r" {0,3}\[((?:\\.|[^\[\]\\]){1,999})\]:[ \t]*\n?[ \t]*(<(?:\\.|[^<>\\\n])*>|[^\s<]\S*)(?:[ \t]*\n[ \t]*" + TITLE + r"[ \t]*(?:\n|$)|[ \t]+" + TITLE + r"[ \t]*(?:\n|$)|[ \t]*(?:\n|$))")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^\n]*)$")
NEW_BLOCK = re.compile(r" {0,3}(?:#{1,6}(?:\s|$)|[-+*]\s|\d{1,9}[.)]\s|>)")


def plain(text: str) -> str:
    """A text without escapes and references to characters."""
    return html.unescape(ESCAPED.sub(lambda m: m[1] if m[1] != "&" else "&amp;", text))


def normal_label(label: str) -> str:
    return " ".join(label.split()).casefold()


def blocks(body: str) -> tuple[list[str], dict[str, str]]:
    """(the texts that may hold links, the definitions by label)."""
    texts: list[list[str]] = [[]]
    fence = ""
    for line in body.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        m = FENCE.match(line)
        if fence:
            if m and m[1].startswith(fence) and not m[2].strip():
                fence = ""
            continue
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
            texts.append([])
        elif not line.strip():
            texts.append([])
        elif not texts[-1] and re.match(r"(?: {4}| {0,3}\t)", line):
            continue  # indented code, as it goes on no paragraph
        else:
            while NEW_BLOCK.match(line):
                if not line.lstrip().startswith(">") or not texts[-1]:
                    texts.append([])
                line = NEW_BLOCK.sub("", line, count=1)
            texts[-1].append(line.strip())
    found, defined = [], {}
    for lines in texts:
        text = "\n".join(lines)
        while m := DEFINITION.match(text):
            if m[1].strip():
                target = m[2][1:-1] if m[2].startswith("<") else m[2]
                defined.setdefault(normal_label(m[1]), plain(target))
            text = text[m.end() :]
        if text:
            found.append(text)
    return found, defined


def destination(text: str, at: int) -> tuple[str, int] | None:
    """(target, behind the closing parenthesis) of an inline link's ``(...)`` at a place."""
    m = re.compile(r"\(\s*").match(text, at)
    if m is None:
        return None
    k = m.end()
    if text[k : k + 1] == "<":
        found = re.compile(r"<((?:\\.|[^<>\\\n])*)>").match(text, k)
        if found is None:
            return None
        target, k = found[1], found.end()
    else:
        start, depth = k, 0
        while k < len(text) and not text[k].isspace() and ord(text[k]) >= 32:
            if text[k] == "\\" and ESCAPED.match(text, k):
                k += 2
                continue
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            if depth < 0:
                break
            k += 1
        if depth > 0:
            return None
        target = text[start:k]
    end = re.compile(r"(?:\s+" + TITLE + r")?\s*\)").match(text, k)
    return (plain(target), end.end()) if end else None


def label_of(inner: str) -> str:
    """The words of a link's text: code without its marks, no emphasis, no line ends; an image's words, a tag's none."""
    codes: list[str] = []

    def keep(m: re.Match) -> str:
        code = m[2].replace("\n", " ")
        codes.append(code[1:-1] if code.strip() and code[0] == code[-1] == " " else code)
        return f"\ue000{len(codes) - 1}\ue001"

    out = re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", keep, inner, flags=re.S)
    out = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", TAG.sub("", out))
    for mark in (r"\*\*", r"__", r"\*", r"_"):
        out = re.sub(rf"(?<!\\){mark}(?=\S)(.+?)(?<=[^\s\\]){mark}", r"\1", out, flags=re.S)
    return re.sub("\ue000(\\d+)\ue001", lambda m: codes[int(m[1])], plain(out.replace("\n", "")))


def markdown_links(body: str | None) -> list[tuple[str, str]]:
    """(target, label) of the links of a text, in their order."""
    texts, defined = blocks(body or "")
    out: list[tuple[str, str]] = []
    for text in texts:
        found: list[tuple[int, str, str]] = []
        stack: list[list] = []  # [place behind the bracket, is an image, may be a link]
        k = 0
        while k < len(text):
            c = text[k]
            if c == "\\" and ESCAPED.match(text, k):
                k += 2
            elif c == "`":
                run = re.compile(r"`+").match(text, k)
                close = re.compile(r"(?<!`)" + run[0] + r"(?!`)").search(text, run.end())
                k = close.end() if close else run.end()
            elif c == "<" and (m := ADDRESS.match(text, k) or MAIL.match(text, k)):
                found.append((k, m[1] if m.re is ADDRESS else "mailto:" + m[1], m[1]))
                k = m.end()
            elif c == "<" and (m := TAG.match(text, k)):
                k = m.end()
            elif c == "!" and text[k + 1 : k + 2] == "[":
                stack.append([k + 2, True, True])
                k += 2
            elif c == "[":
                stack.append([k + 1, False, True])
                k += 1
            elif c == "]" and stack:
                start, image, active = stack.pop()
                inner, k = text[start:k], k + 1
                if not active:
                    continue
                met = destination(text, k) if text[k : k + 1] == "(" else None
                if met is None:
                    full = re.compile(r"\[((?:\\.|[^\[\]\\])*)\]").match(text, k)
                    name = full[1] if full and full[1].strip() else inner
                    if (full is None or not full[1]) and re.search(r"(?<!\\)[\[\]]", inner):
                        continue
                    target = defined.get(normal_label(name))
                    met = (target, full.end() if full else k) if target is not None else None
                if met is None:
                    continue
                if not image:
                    found.append((start, met[0], label_of(inner)))
                    for opener in stack:
                        opener[2] = opener[2] and opener[1]
                k = met[1]
            else:
                k += 1
        out += [(target, label) for _, target, label in sorted(found, key=lambda x: x[0])]
    return out


@F.pandas_udf(LINKS)
def links(bodies: pd.Series) -> pd.Series:
    """array<struct<target, label, ordinal>> of each text's links."""
    return bodies.map(lambda b: [{"target": t, "label": x, "ordinal": k} for k, (t, x) in enumerate(markdown_links(b))])
