"""Text expressions. All are JVM expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters and digits, or one other visible character: the token estimate of chunking (fixed value).
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
LEXEME = r"[\p{L}\p{N}]+"
SNIPPET = 240


def approx_tokens(text: Column) -> Column:
    """Estimated tokens of a text; null for a null."""
    return F.regexp_count(text, F.lit(TOKEN))


def collapse_ws(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, length: int = SNIPPET) -> Column:
    """At most ``length`` code points of the collapsed text, and an ellipsis if that cuts it."""
    one = collapse_ws(text)
    return F.when(F.char_length(one) <= length, one).otherwise(F.concat(F.left(one, F.lit(length)), F.lit("…")))


def budget_tokens(text: Column) -> Column:
    """Tokens that a text is charged in a prompt: a quarter of its UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(4)).cast("long")


def lexemes(text: Column) -> Column:
    """Lower-case words in order: the text-search vector without stemming or stop words."""
    return F.regexp_extract_all(F.lower(text), F.lit(LEXEME), F.lit(0))


def spaced(text: Column) -> Column:
    """The lexemes between single spaces, for word and phrase tests by ``contains``."""
    return F.concat(F.lit(" "), F.array_join(lexemes(text), " "), F.lit(" "))


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, white space collapsed, empty ones dropped."""
    unix = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")
    return F.filter(F.transform(F.split(unix, "\n\n"), collapse_ws), lambda p: p != "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the canonical text, in hex."""
    return F.sha2(text, 256)


def citations(answer: Column, sources: Column | int) -> Column:
    """Distinct numbers cited as [n] with 1 <= n <= ``sources``, ascending."""
    n = F.lit(sources) if isinstance(sources, int) else sources
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,9})\]"), F.lit(1)), lambda s: s.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda k: (k >= 1) & (k <= n))))


def unwrapped(text: Column) -> Column:
    """A model's one-line answer without a code fence or quotes around it."""
    fenced = F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*|\s*```$", "")
    return F.trim(F.regexp_replace(F.trim(fenced), "^[\"'“”`]+|[\"'“”`]+$", ""))
