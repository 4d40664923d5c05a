"""Column functions that parse dump fields; malformed values become null, nothing raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_number(field: Column, kind: str = "int") -> Column:
    """A field as a whole number, null when malformed or out of range; white space isn't trimmed."""
    return F.when(field.rlike(r"\A[+-]?[0-9]+\z"), field.try_cast(kind))


def copy_fields(line: Column) -> Column:
    """array<string> of a COPY TEXT line: TABs separate, a whole \\N is null, backslash escapes are decoded.

    Splitting at the double backslash first keeps an escaped backslash before a letter from being read as an escape.
    """
    line = F.regexp_replace(line, r"\r\z", "")

    def unescaped(piece: Column) -> Column:
        for letter, char in (("n", "\n"), ("t", "\t"), ("r", "\r"), ("b", "\b"), ("f", "\f"), ("v", "\v")):
            piece = F.replace(piece, F.lit("\\" + letter), F.lit(char))
        return F.regexp_replace(piece, r"\\(?!\z)", "")

    def decoded(field: Column) -> Column:
        return F.when(field != r"\N", F.array_join(F.transform(F.split(field, r"\\\\", -1), unescaped), "\\"))

    return F.transform(F.split(line, "\t", -1), decoded)


def id_after(url: Column, marker: str) -> Column:
    """The number that directly follows the first `marker` in a url, null if there is none."""
    at = F.locate(marker, url)
    rest = F.substring(url, at + len(marker), F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, "^[0-9]+", 0).try_cast("int"))


def file_version(name: Column, prefix: str) -> Column:
    """Eight digits that follow `prefix` at a file name's start; null if there are none or more."""
    return F.nullif(F.regexp_extract(name, f"^{prefix}([0-9]{{8}})(?![0-9])", 1), F.lit(""))


def page_url(title: Column, base: str) -> Column:
    return F.concat(F.lit(base), F.replace(title, F.lit(" "), F.lit("_")))


def xml_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def xml_unescape(text: Column) -> Column:
    """The ampersand comes last, so that a doubly escaped entity loses one layer."""
    for name, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(raw))
    return text


def item_number(name: Column) -> Column:
    """Q-number of an entity name."""
    return F.when(name.rlike(r"\AQ[+-]?[0-9]+\z"), F.substring(name, F.lit(2), F.length(name)).try_cast("int"))


def signed_year(time: Column) -> Column:
    """Year of a signed time such as +1987-01-01T00:00:00Z; null outside a smallint."""
    return F.nullif(F.regexp_extract(time, r"\A([+-][0-9]+)", 1), F.lit("")).try_cast("smallint")


def brightness(weight: Column, most: Column) -> Column:
    """sqrt(weight / most) in single precision."""
    return F.sqrt((weight / most).cast("float")).cast("float")


#: The names that XML itself knows (fixed values).
XML_NAMES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
#: What stands between & and ; of a reference: a name, or up to nine decimal or eight hexadecimal digits.
_REFERENCE = r"\A(#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|[a-z]{2,8});"


def decoded(text: Column, names: dict[str, str]) -> Column:
    """The text with the given names' and all numeric references to characters replaced, in one pass; others stay. It is
    cut at each ampersand, and only what stands behind one is looked at."""
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, _REFERENCE, 1)
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).when(F.startswith(name, F.lit("#")), F.substring(name, 2, 9)).try_cast("bigint")
        valid = (digits < 0xD800) | digits.between(0xE000, 0x10FFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32")).otherwise(F.try_element_at(known, name))
        return F.when(char.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(char, part.substr(F.length(name) + 2, F.length(part))))

    parts = F.split(text, "&")
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), one), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)
