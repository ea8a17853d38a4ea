"""Strings as the rules see them: white space is Unicode's, a blank string is null or empty once stripped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, written so that Java and RE2 read it alike.
WS = r"[ \t\n\r\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def stripped(c: Column) -> Column:
    """Never null."""
    return strip(F.coalesce(c, F.lit("")))


def blank(c: Column) -> Column:
    return stripped(c) == ""


def word_count(c: Column) -> Column:
    """The number of words, by the white space between them: a class of it is much faster to look for than its complement."""
    text = F.coalesce(c, F.lit(""))
    at_end = lambda x: x.rlike(WS).cast("int")
    return F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit(f"{WS}+")) + 1 - at_end(F.left(text, F.lit(1))) - at_end(F.right(text, F.lit(1))))


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{WS}+"), lambda w: w != "")


def split_list(c: Column, by: str = r"[,\n]") -> Column:
    """Parts of a comma or newline list, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), by), strip), lambda w: w != "")


def unless_empty(c: Column) -> Column:
    return F.when(c != "", c)


def to_int(c: Column) -> Column:
    """int(float(x)): truncated, or null where x is no number."""
    number = strip(c).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 9e18), number).cast("long")


# URLs and domains. The variants differ on purpose.


def normalize_domain(c: Column) -> Column:
    """example.com: no scheme, path, query or fragment, no leading www., no dots at the end."""
    bare = F.regexp_replace(F.lower(stripped(c)), "https?://", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^[^/?#]*", 0), r"^www\.", "")
    return F.regexp_replace(strip(host), r"\.+$", "")


def url_domain(c: Column) -> Column:
    """The host of a URL with or without scheme, lower case, without www."""
    rest = F.when(F.contains(c, F.lit("://")), F.regexp_extract(c, r"^[^:/?#]*://([^/?#]*)", 1)).otherwise(F.regexp_extract(c, r"^(?://)?([^/?#]*)", 1))
    return bare_domain(rest)


def bare_domain(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^www\.", "")


def rtrim_slash(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def normalize_content(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", " "))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where f has c in several places and c is costly: an expression that stands in several branches is evaluated in each."""
    return F.element_at(F.transform(F.array(c), f), 1)


#: What Unicode's case folding changes, by Python's own rule; most characters become one, and some (ß, ŉ, ﬃ) several.
FOLDED = {c: c.casefold() for c in map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)) if c.casefold() != c}
LONGER = {c: f for c, f in FOLDED.items() if len(f) > 1}


def casefold(c: Column) -> Column:
    """Text with Unicode's case folding, which has no built-in: lower() keeps ß, and depends on what stands around a sigma."""
    one = {k: f for k, f in FOLDED.items() if k not in LONGER}

    def longer(text: Column) -> Column:
        out = text
        for k, f in LONGER.items():
            out = F.replace(out, F.lit(k), F.lit(f))
        return F.when(text.rlike(f"[{''.join(LONGER)}]"), out).otherwise(text)

    return once(c, lambda x: F.when(x.rlike(r"^[\x00-\x7F]*$"), F.lower(x)).otherwise(once(F.translate(x, "".join(one), "".join(one.values())), longer)))


def content_hash(c: Column) -> Column:
    """sha-256 of stripped, single-spaced, case-folded text."""
    return F.sha2(casefold(normalize_content(c)), 256)
