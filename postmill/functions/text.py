"""Text expressions, all of them built-in Spark expressions.

Java's ``\\s``, ``\\w`` and ``\\d`` are ASCII, so the Unicode classes are spelled out here once.
"""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions import fixed
from postmill.functions.bind import bind

SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
REPLACEMENT = "\ufffd"
#: What stands for the codes 0x80 to 0x9F: the character of Windows-1252, or the code itself where that has none.
C1_CHARS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0))


@lru_cache(maxsize=1)
def _entity_tables() -> tuple[str, str]:
    """Entities by initial and name, as JSON, and a pattern for the names that need no semicolon, longest first."""
    by_initial: dict[str, dict[str, str]] = {}
    for name, chars in html5.items():
        by_initial.setdefault(name[0], {})[name] = chars
    bare = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    return json.dumps(by_initial, ensure_ascii=False), rf"\A(?:{'|'.join(bare)})"


def _numbered(name: Column) -> Column:
    """The character of a numeric reference ``#...``; none for codes that stand for no character."""
    digits = F.regexp_extract(name, r"\A#0*([0-9]*)", 1)
    hex_digits = F.regexp_extract(name, r"\A#[xX]0*([0-9a-fA-F]*)", 1)
    beyond = F.lit(0x110000)
    decimal = F.when(F.length(digits) > 7, beyond).otherwise(F.concat(F.lit("0"), digits).cast("int"))
    hexadecimal = F.when(F.length(hex_digits) > 6, beyond).otherwise(F.conv(F.concat(F.lit("0"), hex_digits), 16, 10).cast("int"))

    def char(code: Column) -> Column:
        control = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
        no_character = control | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
        return (
            F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), REPLACEMENT)
            .when(code.between(0x80, 0x9F), F.substr(F.lit(C1_CHARS), code - 0x7F, F.lit(1)))
            .when(no_character, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        )

    return bind(F.when(name.rlike(r"\A#[xX]"), hexadecimal).otherwise(decimal), char)


def _resolved(reference: Column) -> Column:
    """The characters of one reference, or the reference itself where it is none.

    A name is looked up whole first; failing that, its longest beginning that is a name without a semicolon counts.
    """
    entities, bare = _entity_tables()
    name = F.substr(reference, F.lit(2))

    def chars(key: Column) -> Column:
        table = F.from_json(F.lit(entities), "map<string,map<string,string>>")  # folded into the plan
        return F.try_element_at(F.try_element_at(table, F.substr(key, F.lit(1), F.lit(1))), key)

    begun = F.regexp_extract(name, bare, 0)
    rest = F.substr(name, F.length(begun) + 1)
    return (
        F.when(name.startswith("#"), _numbered(name))
        .otherwise(F.coalesce(chars(name), F.concat(chars(begun), rest), reference))
    )


def unescape_html(text: Column | str) -> Column:
    """Decode HTML character references as a browser does, in the JVM; texts without ``&`` are passed on."""

    def decoded(t: Column) -> Column:
        chars = F.transform(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)), _resolved)
        pieces = F.zip_with(F.split(t, REFERENCE, -1), chars, lambda piece, c: F.concat(piece, F.coalesce(c, F.lit(""))))
        return F.when(t.contains("&"), F.array_join(pieces, "")).otherwise(t)

    return bind(_col(text), decoded)


def mask_urls(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"http[^{SPACE}]+", fixed.URL_TOKEN)


def mask_mentions(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"@[^{SPACE}]+", fixed.USER_TOKEN)


def mask_cashtags(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"\$[A-Z]{{1,5}}(?![{WORD}])", fixed.TICKER_TOKEN)


def preprocess_text(text: Column | str, cashtags: bool = False, unescape: bool = True) -> Column:
    """Unescape, then mask links, then mentions, so a link inside brackets is masked before the handle."""
    masked = mask_mentions(mask_urls(unescape_html(text) if unescape else text))
    return mask_cashtags(masked) if cashtags else masked


def space_tokens(text: Column | str) -> Column:
    """Split at every single space; runs of spaces give empty tokens."""
    return F.split(_col(text), " ", -1)


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"\A[{SPACE}]++|[{SPACE}]++\z", "")


def words(text: Column | str) -> Column:
    """Split at runs of any white space; no empty words."""
    parts = F.split(strip(text), f"[{SPACE}]++", -1)
    return F.filter(parts, lambda w: w != "")


def has_words(text: Column | str, n: int) -> Column:
    """At least ``n`` words. The match is anchored and possessive, so it reads no further than word ``n``."""
    return _col(text).rlike(rf"\A[{SPACE}]*+(?:[^{SPACE}]++[{SPACE}]++){{{n - 1}}}[^{SPACE}]")


def strip_list_marker(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"\A(?:\p{{Nd}}+[./):]?|-)[{SPACE}]*", "")


def collapse_repeated_emoji(text: Column | str, strict: bool = False) -> Column:
    """Drop a symbol that repeats its predecessor. The default class also spans CJK; ``strict`` leaves it out."""
    ranges = [r for r in fixed.EMOJI_RANGES if not (strict and r[0] == 0x24C2)]
    symbols = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges)
    return F.regexp_replace(_col(text), rf"([{symbols}])\1+", "$1")


def drop_chars(text: Column | str) -> Column:
    """Remove key-cap marks and double quotes."""
    return F.translate(_col(text), '\u20e3"', "")


def dedupe_tags(text: Column | str) -> Column:
    """Keep only the last occurrence of each cash or hash tag, comparing whole tags.

    Tags are sorted by name and place, so that each sees whether it is the last of its name, and put back between the
    pieces they stood in: the time grows with n log n in the number of tags.
    """
    text, tag = _col(text), rf"[$#][{WORD}]++"
    tags = F.regexp_extract_all(text, F.lit(f"({tag})"), 1)
    placed = F.array_sort(F.transform(tags, lambda t, i: F.struct(t.alias("tag"), i.alias("at"))))

    def kept(by_name: Column) -> Column:
        """Every tag in place, empty unless it is the last of its name."""
        last = lambda x, i: ~x["tag"].eqNullSafe(F.get(by_name, i + 1)["tag"])
        out = F.transform(by_name, lambda x, i: F.struct(x["at"].alias("at"), F.when(last(x, i), x["tag"]).otherwise("").alias("tag")))
        return F.transform(F.array_sort(out), lambda x: x["tag"])

    pieces = F.zip_with(F.split(text, tag, -1), bind(placed, kept), lambda piece, t: F.concat(piece, F.coalesce(t, F.lit(""))))
    return F.when(F.size(tags) > F.size(F.array_distinct(tags)), F.array_join(pieces, "")).otherwise(text)


def has_meta_words(text: Column | str) -> Column:
    return _col(text).rlike("(?iu)" + "|".join(fixed.META_WORDS))


def has_label_leak(text: Column | str) -> Column:
    """A class name and the word "tweet" on the last line."""
    names = "|".join(fixed.LEAKED_LABELS)
    return _col(text).rlike(
        rf"(?iu)(?<![{WORD}])(?:{names})[{SPACE}]+tweet(?![{WORD}])[^\n]*\n?\z"
    )


def is_emoji_only(text: Column | str) -> Column:
    return _col(text).rlike(r"\A[\x{10000}-\x{10FFFF}]++\z")


def is_tags_only(text: Column | str) -> Column:
    return _col(text).rlike(rf"\A[{SPACE}]*+(?:[@$#][{WORD}]++[{SPACE}]*+)++\z")


def reject_reason(tidied: Column | str) -> Column:
    """Why a tidied text is not usable, or NULL when it is."""
    tidied = _col(tidied)
    return (
        F.when(tidied.isNull(), "not_text")
        .when(has_meta_words(tidied), "meta_words")
        .when(has_label_leak(tidied), "label_leak")
        .when(is_emoji_only(tidied), "emoji_only")
        .when(is_tags_only(tidied), "tags_only")
        .when(~has_words(tidied, 3), "too_short")
    )


def verdict(text: Column | str, strict_emoji: bool = False) -> Column:
    """``(cleaned, reject_reason)`` of a generated post; exactly one of the two is NULL."""
    unmarked = collapse_repeated_emoji(strip_list_marker(text), strict_emoji)
    return bind(
        strip_list_marker(drop_chars(unmarked)),
        lambda base: bind(
            dedupe_tags(base),
            lambda tidied: bind(
                reject_reason(tidied),
                lambda reason: F.struct(
                    F.when(reason.isNull(), strip(tidied)).alias("cleaned"), reason.alias("reject_reason")
                ),
            ),
        ),
    )
