"""Text expressions. All are built-in column functions and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgap.functions import fixed_values as fixed

# The characters of words: letters, digits and underscores.
WORD_CHARACTERS = r"\p{L}\p{N}_"
# The white space that counts at the ends of a text and between words.
BLANKS = " \t\n\r\f\x0b"


def tokens(text: Column, letters: str = WORD_CHARACTERS) -> Column:
    """Lower-case tokens of a text, in order, as array<string>: runs of word characters, and single
    marks. A null text has none.

    Marks are set apart by blanks and the text is split at white space, which takes time in
    proportion to the text. (Extracting all matches copies the text at each match.)
    """
    apart = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"([^\s{letters}])", " $1 ")
    return F.array_remove(F.split(apart, r"\s+"), "")


def long_words(text: Column, letters: str = WORD_CHARACTERS) -> Column:
    """Lower-case runs of at least two word characters, in order. A null text has none."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), rf"[^{letters}]+")
    return F.filter(runs, lambda word: F.length(word) > 1)


def is_term(token: Column, stop_words=fixed.ENGLISH_STOP_WORDS, marks=fixed.SPECIAL_TOKENS):
    """True for a token that is neither a stop word nor one of the listed marks."""
    return ~token.isin(*stop_words, *marks)


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda word: word != ""))


def strip(text: Column) -> Column:
    """Remove the characters of BLANKS at both ends (Spark's trim alone removes blanks only)."""
    return F.btrim(text, F.lit(BLANKS))


def embedding_input(text: Column) -> Column:
    """The text an embedding model is given: very wordy texts keep their first characters."""
    too_long = word_count(text) > fixed.EMBED_MAX_WORDS
    return F.when(too_long, F.substring(text, 1, fixed.EMBED_KEEP_CHARS)).otherwise(text)


def pieces(text: Column, length: int = fixed.PARSE_CHUNK_CHARS) -> Column:
    """The text cut into consecutive pieces of `length` characters; the last may be shorter."""
    count = F.ceil(F.length(text) / F.lit(length)).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        starts, lambda i: F.substring(text, i * F.lit(length) + F.lit(1), F.lit(length))
    )
