"""Text and number functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: N-gram lengths of the match index.
GRAM_SIZES = (2, 3, 4)


def normalise(c: Column) -> Column:
    """Lower case; anything but a-z, 0-9 and white space becomes a space; runs of space are one; trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))  # white space is among what becomes one space


def grams(normalised: Column) -> Column:
    """Character n-grams within words, each word with a space on both sides: an array with repeats."""
    words = F.filter(F.split(normalised, " "), lambda w: w != "")
    of_size = lambda w, n: F.transform(F.sequence(F.lit(1), F.length(w) + 3 - n), lambda k: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), k, n))
    of_word = lambda w: F.flatten(F.transform(F.filter(F.array(*map(F.lit, GRAM_SIZES)), lambda n: n <= F.length(w) + 2), lambda n: of_size(w, n)))
    return F.flatten(F.transform(words, of_word))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def clean_ocr(c: Column) -> Column:
    """OCR text without stray single characters and frame marks.

    A lone character between word boundaries goes unless it is a or i; a single space between two
    words is such a character, so words are glued. That is the defined behaviour, kept on purpose.
    Letters and white space are those of Unicode, so an accented letter is part of its word.
    """
    squeezed = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^ | $", "")
    # The lone characters that stay, and the frame marks.
    lone = F.regexp_replace(squeezed(c), r"(?U)\b[^aAiI]\b", "")
    return F.coalesce(squeezed(F.regexp_replace(lone, r"[|}{~`]", "")), F.lit(""))


def chunks(c: Column, width: int = 450) -> Column:
    """Pieces of ``width`` characters in order; none for an empty text."""
    starts = F.when(F.length(c) > 0, F.sequence(F.lit(0), F.length(c) - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda o: F.substring(c, o + 1, F.lit(width)))


def round3(c: Column) -> Column:
    """Half-even rounding to three decimals of the scaled double."""
    return F.rint(c * 1000) / 1000


def or_default(c: Column, default) -> Column:
    """``c`` unless it is null or blank."""
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def leading_int(c: Column, default: int) -> Column:
    """The integer that a text begins with; ``default`` where there is none or it is zero."""
    number = F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")
    return F.coalesce(F.nullif(number, F.lit(0)), F.lit(default))


def extension(c: Column) -> Column:
    """The last dot and what follows, in lower case; '' without a dot."""
    return F.lower(F.regexp_extract(c, r"(\.[^./]*)$", 1))


def percent(c: Column) -> Column:
    """A share as a whole percentage; null where it is not above zero."""
    return F.when(c > 0, F.format_string("%.0f%%", F.rint(c * 100)))


def nth_part(c: Column, n: int, mark: str = " ") -> Column:
    """The ``n``-th part (from 0) of a text split at ``mark``; null where there are fewer."""
    return F.get(F.split(c, f"\\Q{mark}\\E"), F.lit(n))


def bearer_token(header: Column) -> Column:
    """The token of an authorisation header; null for one of another kind."""
    return F.when(F.startswith(header, F.lit("Bearer ")), nth_part(header, 1))


def last_items(c: Column, n: int) -> Column:
    """The last ``n`` items of an array, in order."""
    return F.slice(c, F.greatest(F.size(c) - (n - 1), F.lit(1)), n)
