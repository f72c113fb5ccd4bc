"""Expressions that dig posts out of generator responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.bind import bind

# A JSON string body: plain characters with escapes in between. Possessive, so it never backtracks. The object
# ends at its first closing brace, so no body holds one.
_BODY = r'[^"\\}]*+(?:\\[^}][^"\\}]*+)*+'
# Between single quotes an apostrophe may stand, unless the value could end there.
_SINGLE = r"(?:[^'\\}]|\\[^}]|'(?!\s*[,}]))*+"
# A key in quotes of either kind, or a bare one behind a brace, a comma or a space.
_KEY = rf"""(?:"{_BODY}"|'[^'\\}}]*+'|(?<=[{{,\s])\w++)"""
_PAIR = rf"""{_KEY}\s*:\s*(?:"({_BODY})(?:"|\}}\z)|'({_SINGLE})'(?=\s*[,}}]))"""


def extract_response_text(body: Column | str) -> Column:
    """The generated text inside a response; NULL when the body is not such a response."""
    return F.get_json_object(body, "$.output.choices[0].text")


def first_json_object(text: Column | str) -> Column:
    """From the first brace that opens to the next one that closes; NULL without one."""
    text = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.regexp_extract(text, r"\{[^}]*+\}", 0), F.lit(""))


def _parsed_values(parsed: Column) -> Column:
    entries = F.arrays_zip(F.map_keys(parsed).alias("k"), F.map_values(parsed).alias("v"))
    return bind(
        F.map_keys(parsed),
        lambda keys: F.transform(
            entries,
            lambda e, i: F.when(
                (F.schema_of_variant(e["v"]) == "STRING")
                & ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["k"]),
                F.try_variant_get(e["v"], "$", "string"),
            ),
        ),
    )


def _recovered_values(candidate: Column) -> Column:
    def unescaped(s: Column) -> Column:
        return F.coalesce(F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>")[0], s)

    def single(s: Column) -> Column:
        plain = F.replace(F.replace(s, F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))
        return unescaped(plain)

    double_quoted = F.regexp_extract_all(candidate, F.lit(_PAIR), 1)
    single_quoted = F.regexp_extract_all(candidate, F.lit(_PAIR), 2)
    return F.zip_with(double_quoted, single_quoted, lambda d, s: F.when(s != "", single(s)).otherwise(unescaped(d)))


def response_values(text: Column | str) -> Column:
    """String values of the first JSON object in ``text``, in order; empty when there are none.

    Well-formed objects are parsed; values that are not strings are left out and a repeated key keeps its
    last value. In a broken object every complete ``"key": "value"`` pair is recovered, in quotes of either kind and with
    bare keys too, and a last value that misses its closing double quote ends at the brace.
    """
    values = bind(
        first_json_object(text),
        lambda candidate: bind(
            F.from_json(candidate, "map<string,variant>"),
            lambda parsed: F.when(parsed.isNotNull(), _parsed_values(parsed)).otherwise(_recovered_values(candidate)),
        ),
    )
    return F.coalesce(F.filter(values, lambda v: v.isNotNull()), F.array().cast("array<string>"))
