"""Repair of JSON text written by a model, as expressions (K5, F1, F2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.values import BLANKS, let

# What the cleanups look for, and what they put in its place.
QUOTES = (("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"))
NUMERALS = (("十六", "16"), ("二十", "20"))
COMMA_BEFORE_END = f",([{BLANKS}]*[}}\\]])"
REPEATED_COLONS = ":{2,}"
FENCE = "```"
OPENING_FENCE = "```json"
TO_END = 2**31 - 1
# What becomes of a text.
OK, BALANCED, PARSE_FAILED = "ok", "balanced", "JSON_PARSE_FAILED"

#: Signs that one of Spark's readers takes where they must not stand.
LENIENT = "['\\x00-\\x1f]"
#: Longer runs of digits are cut before a text is judged. A number has three runs at most.
LONG_DIGITS = 300


def tidied_text(text: Column) -> Column:
    """The cleanups up to the numerals, in their order."""
    text = F.btrim(text, F.lit(BLANKS))
    for found, wanted in QUOTES:
        text = F.replace(text, F.lit(found), F.lit(wanted))
    text = F.regexp_replace(text, COMMA_BEFORE_END, "$1")
    for found, wanted in NUMERALS:
        text = F.replace(text, F.lit(found), F.lit(wanted))
    return text


def unwrapped_text(tidied: Column) -> Column:
    """The other cleanups: repeated colons, then fences.

    A repair of times with doubled colons is not among them: it would come after
    the one for all repeated colons, and never find any. Few texts need these,
    and plain tests are much cheaper than patterns.
    """
    second = "\n" + FENCE

    def opened(t: Column) -> Column:
        inside = F.ltrim(F.substring(t, len(OPENING_FENCE) + 1, TO_END), F.lit(BLANKS))
        return F.when(F.startswith(t, F.lit(OPENING_FENCE)), inside).otherwise(t)

    def closed(t: Column) -> Column:
        inside = F.rtrim(F.left(t, F.length(t) - len(FENCE)), F.lit(BLANKS))
        return F.when(F.endswith(t, F.lit(FENCE)), inside).otherwise(t)

    def closed_again(t: Column) -> Column:
        # A fence on a line of its own may have stood before the one just removed.
        inside = F.left(t, F.length(t) - len(second))
        return F.when(F.endswith(t, F.lit(second)), inside).otherwise(t)

    def unwrapped(t: Column) -> Column:
        needed = F.contains(t, F.lit("::")) | F.contains(t, F.lit(FENCE))
        rest = F.regexp_replace(t, REPEATED_COLONS, ":")
        return F.when(needed, let(let(let(rest, opened), closed), closed_again)).otherwise(t)

    return let(tidied, unwrapped)


def cleaned_text(text: Column) -> Column:
    """Text after all cleanups."""
    return unwrapped_text(tidied_text(text))


def balanced_text(text: Column) -> Column:
    """Text with the braces added that it lacks, at the end or at the start."""

    def many(t: Column, sign: str) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit(sign), F.lit("")))

    def balanced(t: Column, surplus: Column) -> Column:
        return (
            F.when(surplus > 0, F.concat(t, F.repeat(F.lit("}"), surplus)))
            .when(surplus < 0, F.concat(F.repeat(F.lit("{"), -surplus), t))
            .otherwise(t)
        )

    return let(text, lambda t: let(many(t, "{") - many(t, "}"), lambda n: balanced(t, n)))


def strict_json(text: Column) -> Column:
    """True if text is JSON by the standard (F1); null counts as not.

    Spark's parsers take text behind a document, and other forms, as long as what they look for is found. So the text
    is made the first value of an object, and the names of the object are asked for: they are the two
    written here only if the text is one whole value. No text can bring the second name along, as that
    holds the digest of the text. That reader lets strings stand in single quotes and hold control characters; a text
    that has any of these is also read by one that does not. Both take numbers of up to 1,000 digits; longer runs of digits are
    cut for it, which changes no form. Values nested more than 1,000 deep, and names of more than 50,000
    characters, count as not JSON.
    """
    options = {"columnNameOfCorruptRecord": "bad", "allowSingleQuotes": "false"}

    def judged(t: Column, last: Column) -> Column:
        # Most texts are shorter than any run that would have to be cut.
        cut = F.regexp_replace(t, f"([0-9]{{{LONG_DIGITS}}})[0-9]+", "$1")
        short = F.when(F.length(t) > LONG_DIGITS, cut).otherwise(t)
        wrapped = F.concat(F.lit('{"v":'), short, F.lit(',"'), last, F.lit('":0}'))

        def whole(w: Column) -> Column:
            named = F.json_object_keys(w) == F.array(F.lit("v"), last)
            bad = F.from_json(w, "v string, bad string", options)["bad"]
            return named & (~F.rlike(t, F.lit(LENIENT)) | bad.isNull())

        return F.coalesce(let(wrapped, whole), F.lit(False))

    return let(
        text, lambda t: let(F.concat(F.lit("e"), F.md5(t.cast("binary"))), lambda e: judged(t, e))
    )


def repaired(text: Column) -> Column:
    """A struct of the `cleaned` text, its `status`, and the `parsed` text, null if it is not valid."""

    def result(cleaned: Column, status: str, parsed: Column) -> Column:
        return F.struct(
            cleaned.alias("cleaned"), F.lit(status).alias("status"), parsed.alias("parsed")
        )

    def balanced(c: Column) -> Column:
        # Where braces balance there is no second text to judge.
        return let(
            F.nullif(balanced_text(c), c),
            lambda b: F.when(strict_json(b), result(c, BALANCED, b)).otherwise(
                result(c, PARSE_FAILED, F.lit(None).cast("string"))
            ),
        )

    return let(
        cleaned_text(text),
        lambda c: F.when(strict_json(c), result(c, OK, c)).otherwise(balanced(c)),
    )
