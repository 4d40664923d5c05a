"""Prose from wiki text and web pages, as column expressions.

Each step is a pattern over the whole string, but for templates, tags and embedded media, which nest to any depth: their
brackets are counted row by row. What an unclosed construct opens is dropped to the end.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .parsing import decoded


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", "")


def strip_refs(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?i)<ref(?:\s[^<>]*)?/>", "")
    return F.regexp_replace(text, r"(?is)<ref(?:\s[^<>]*)?>.*?(?:</ref>|\z)", "")


_TOKEN = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
_DASHES = {"spaced ndash": " – ", "snd": " – ", "ndash": "–", "mdash": "—"}


def _words(name: str, arguments: list[str]) -> str:
    """What a template gives to the sentence."""
    name = name.strip().lower()
    given = [x for a in arguments if "=" not in a and (x := a.strip())]
    if name in _DASHES:
        return _DASHES[name]
    if name in ("circa", "c."):
        return f"c. {given[0]}" if given else ""
    if name in ("convert", "cvt"):
        return " ".join(given[:2])
    if name in ("lang", "langx", "transliteration", "transl"):
        return given[-1] if given else ""
    if name in ("nowrap", "nobr", "small", "big", "em", "strong"):
        return given[0] if given else ""
    return ""


def without_templates(text: str) -> str:
    """Pairs of braces are counted at any depth; an unclosed template takes all that follows. Lone braces are text."""
    out: list[str] = []
    open_: list[list[list[str]]] = []  # of each open template its parts, each in pieces
    links: list[int] = []  # and how many links are open in it, whose bars part nothing
    at = 0
    for m in _TOKEN.finditer(text):
        here, token = open_[-1][-1] if open_ else out, m[0]
        here.append(text[at : m.start()])
        at = m.end()
        if token == "{{":
            open_.append([[]])
            links.append(0)
        elif not open_:
            here.append(token)
        elif token == "}}":
            name, *arguments = ("".join(part) for part in open_.pop())
            links.pop()
            (open_[-1][-1] if open_ else out).append(_words(name, arguments))
        elif token == "|" and not links[-1]:
            open_[-1].append([])
        else:
            links[-1] = max(0, links[-1] + {"[[": 1, "]]": -1, "|": 0}[token])
            here.append(token)
    return "".join(out) if open_ else "".join(out) + text[at:]


@F.pandas_udf(StringType())
def _without_templates(text: pd.Series) -> pd.Series:
    return text.map(without_templates, na_action="ignore")


def resolve_templates(text: Column) -> Column:
    """Dashes, circa, conversions, foreign words and layout wrappers give words; all other templates nothing."""
    return _without_templates(text)


_BRACKET = re.compile("[<>]")


def without_tags(text: str) -> str:
    """What stands outside of < and >, which are counted at any depth; one that stays open takes the rest. A > that
    closes nothing is text."""
    out, depth, at = [], 0, 0
    for m in _BRACKET.finditer(text):
        if not depth:
            out.append(text[at : m.start()] + (">" if m[0] == ">" else ""))
        depth = depth + 1 if m[0] == "<" else max(0, depth - 1)
        at = m.end()
    return "".join(out) if depth else "".join(out) + text[at:]


@F.pandas_udf(StringType())
def _without_tags(text: pd.Series) -> pd.Series:
    return text.map(without_tags, na_action="ignore")


def strip_tags(text: Column) -> Column:
    return _without_tags(text)


_LINK = re.compile(r"(\[\[)(?:\s*(?:file|image|media):)?|\]\]", re.I)


def without_files(text: str) -> str:
    """Embedded media go with captions that hold links at any depth; one that stays open takes the rest."""
    out, depth, at = [], 0, 0
    for m in _LINK.finditer(text):
        if depth:
            depth += 1 if m[1] else -1
            at = m.end()
        elif m[0].endswith(":"):
            out.append(text[at : m.start()])
            depth, at = 1, m.end()
    return "".join(out) if depth else "".join(out) + text[at:]


@F.pandas_udf(StringType())
def _without_files(text: pd.Series) -> pd.Series:
    return text.map(without_files, na_action="ignore")


def strip_files(text: Column) -> Column:
    """Embedded media with captions that may hold links."""
    return _without_files(text)


def flatten_links(text: Column) -> Column:
    """Of each link, from its first brackets to the first closing pair, the part after the last bar stays; single
    brackets are text of it. One that stays open takes the rest."""
    closed = F.regexp_replace(text, r"(?s)\[\[(?:(?:(?!\]\]).)*\|)?((?:(?!\]\])[^|])*)\]\]", "$1")
    return F.regexp_replace(closed, r"(?s)\[\[.*", "")


_NAMED = {"nbsp": " ", "ndash": "–", "mdash": "—", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
def decode_entities(text: Column) -> Column:
    """Eight names and all numeric references to characters become what they stand for, in one pass; others stay."""
    return decoded(text, _NAMED)


def tidy(text: Column) -> Column:
    """Runs of blanks become one; parentheses lose edge punctuation and go if empty; marks follow their word."""
    text = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")
    text = F.regexp_replace(text, r"\([\s;,/–-]*([^()]*?)[\s;,/–-]*\)", "($1)")
    text = F.regexp_replace(text, r" *\(\)", "")
    text = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")
    return F.regexp_replace(text, r" ([,;.])", "$1")


def paragraphs(text: Column, least_bytes: int = 40) -> Column:
    """array<string>: lines joined up to a blank one, without lists, tables and headings; of more than `least_bytes`
    bytes and two words at least."""
    blocks = F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n[ \t]*(?:\n[ \t]*)+")
    lines = lambda b: F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^[*#:;|!=]"))
    return F.filter(F.transform(blocks, lambda b: F.array_join(lines(b), " ")), lambda p: (F.octet_length(p) > least_bytes) & F.contains(p, F.lit(" ")))


def lead(text: Column) -> Column:
    """The prose before the first heading of a wiki text; null for redirects and where nothing remains."""
    head = lambda x: F.when(F.contains(x, F.lit("==")), F.regexp_extract(x, r"(?sm)\A(.*?)(?:^[ ]*==|\z)", 1)).otherwise(x)
    # Where none of these stands in a text, no step finds anything; the steps then get null, and Python no text
    marked = F.contains(text, F.lit("{{")) | F.contains(text, F.lit("<")) | F.contains(text, F.lit("[["))
    body = head(F.when(marked, text))
    for step in (strip_comments, strip_refs, resolve_templates, strip_tags, strip_files, flatten_links):
        body = step(body)
    body = F.coalesce(body, head(F.when(~marked, text)))
    once = lambda value, f: F.transform(F.array(value), f)[0]
    decoded_ = once(F.regexp_replace(body, r"''+", ""), decode_entities)
    prose = F.array_join(once(decoded_, lambda x: paragraphs(tidy(x))), "\n\n")
    return F.when(text.rlike(r"(?i)\A\s*#redirect"), None).otherwise(F.nullif(prose, F.lit("")))


def page_text(html: Column) -> Column:
    """A web page's text: comments, scripts, styles and tags go, entities are decoded, blanks collapse."""
    text = strip_comments(html)
    text = F.regexp_replace(text, r"(?is)<script\b.*?(?:</script>|\z)", " ")
    text = F.regexp_replace(text, r"(?is)<style\b.*?(?:</style>|\z)", " ")
    text = decode_entities(F.regexp_replace(text, r"<[^>]*>", " "))
    return F.trim(F.regexp_replace(text, r"\s+", " "))
