"""Text functions over columns. Everything here stays in generated JVM code.

The two ways to normalise differ in what becomes of ``|``: for linkage it is
deleted, for rule matching it becomes a space. They are kept apart on purpose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = r"^\$*-*[0-9,]+$"


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\p{Punct}", " "), " {2,}", " "))


def normalize(c: Column) -> Column:
    """Linkage: drop ``|``, other punctuation to spaces, runs of spaces to one, lower case."""
    return F.lower(normalize_no_lower(c))


def normalize_no_lower(c: Column) -> Column:
    return _spaced(F.replace(c, F.lit("|"), F.lit("")))


def normalize_rule(c: Column) -> Column:
    """Rule matching: as :func:`normalize`, with ``|`` as a space."""
    return F.lower(_spaced(c))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value bound to a variable, so that it is worked out once and not for each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tokens(c: Column) -> Column:
    """Tokens between white space; none of them empty."""
    return F.array_remove(F.split(c, r"\s+"), "")


def kept_tokens(c: Column) -> Column:
    """Tokens of the normalised text in their case."""
    return tokens(normalize_no_lower(c))


def shingles(words: Column, n: int = 2) -> Column:
    """Distinct n-grams joined with ``_``; none where there are fewer than n words.

    Shifted copies of the words are zipped, so that no lambda holds the whole
    array: an expression inside a lambda would be worked out for each element.
    """
    m = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, F.lit(1), m)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(k + 1), m), lambda a, b: F.concat_ws("_", a, b))
    return F.array_distinct(out)


def shinglize(c: Column, n: int = 2, tokenizer: Callable[[Column], Column] = tokens) -> Column:
    """Shingles of a text; the words are bound to a variable, so that they are made once and not for each use."""
    return bound(tokenizer(c), lambda words: shingles(words, n))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def is_prefix(pattern: Column, text: Column) -> Column:
    return F.startswith(text, pattern)


def is_postfix(pattern: Column, text: Column) -> Column:
    return F.endswith(text, pattern)


def is_infix(pattern: Column, text: Column) -> Column:
    return F.contains(text, pattern)


def fuzzy_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


# Counts of characters and tokens.


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _part(n: Column, of: Column) -> Column:
    return F.when(of == 0, F.lit(0.0)).otherwise(n / of)


def num_caps(c: Column) -> Column:
    """Upper-case characters."""
    return F.length(F.regexp_replace(c, r"\P{Lu}+", ""))


def num_dots(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))


def percent_dots(c: Column) -> Column:
    return _part(num_dots(c), F.length(c))


def num_digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]+", ""))


def percent_digits(c: Column) -> Column:
    return _part(num_digits(c), F.length(c))


def starts_with_for(words: Column) -> Column:
    return F.coalesce(F.get(words, F.lit(0)).isin("for", "For"), F.lit(False))


def alpha_tokens(words: Column) -> Column:
    return F.filter(words, lambda t: t.rlike(r"^\p{L}+$"))


def percent_alpha(words: Column) -> Column:
    return _part(F.size(alpha_tokens(words)), F.size(words))


def percent_capitalized(words: Column) -> Column:
    """Share of tokens with an upper-case first letter; on tokens that kept their case."""
    return _part(F.size(F.filter(words, lambda t: t.rlike(r"^\p{Lu}"))), F.size(words))


def unigrams(c: Column, forbidden: Column | None = None, kept: Column | None = None) -> Column:
    """Distinct lower-case tokens of the text (``kept``, if they are there already) without those in ``forbidden``, whose case counts."""
    words = kept_tokens(c) if kept is None else kept
    if forbidden is not None:
        words = F.array_except(words, forbidden)
    return F.array_distinct(F.transform(words, F.lower))


def bigrams(c: Column) -> Column:
    return shinglize(normalize(c), 2)


# Cells and lines of tables.


def has_dots(c: Column) -> Column:
    return c.rlike(r"\.{2,}")


def is_money(c: Column) -> Column:
    """Digits and commas after dollar signs and hyphens; the text is stripped first."""
    return F.regexp_replace(c, r"^\s+|\s+$", "").rlike(MONEY)


def indentation(c: Column) -> Column:
    return F.length(F.regexp_extract(c, "^( *)", 1))


def ends_with_colon(c: Column) -> Column:
    return F.endswith(F.rtrim(F.trim(c), F.lit(".")), F.lit(":"))


def clean_cell(c: Column) -> Column:
    """Strip white space, then dots on the right, then hyphens; not stripped again."""
    return F.trim(F.rtrim(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(".")), F.lit("-"))


def cells(c: Column) -> Column:
    return F.split(c, r" \| ")


# Documents.


def strip_html(c: Column) -> Column:
    """Without line breaks and without scripts, their alternatives and styles."""
    flat = F.regexp_replace(c, r"[\r\n]", "")
    return F.regexp_replace(flat, r"(?i)<script.*?</script>|<noscript.*?</noscript>|<style.*?</style>", "")


def content_id(c: Column) -> Column:
    return F.sha1(c)


def random_id(length: int = 10) -> Column:
    """Letters and digits by chance: an id for what has no content to derive one from."""
    return F.randstr(F.lit(length))


def recoded(c: Column) -> Column:
    """Text whose UTF-8 bytes were read as Latin-1, read again as what they are."""
    return F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")


def year_of(c: Column) -> Column:
    """The first four characters of a date written as text."""
    return F.substring(c, 1, 4)


def last_segment(c: Column) -> Column:
    return F.element_at(F.split(F.try_url_decode(F.try_url_decode(c)), "/"), -1)


def after_preamble(c: Column, mark: str = "<body><pre>") -> Column:
    """The text behind ``mark``, if that does not open the text; else the text."""
    at = F.locate(mark, c)
    return F.when(at > 1, F.substr(c, at + len(mark), F.length(c))).otherwise(c)


def window(c: Column, start: Column, end: Column, around: int = 60, left: str = "<<", right: str = ">>") -> Column:
    """Text around the span ``[start, end)`` with the span in marks."""
    a = F.greatest(start - around, F.lit(0))
    return F.concat(F.substr(c, a + 1, start - a), F.lit(left), F.substr(c, start + 1, end - start), F.lit(right), F.substr(c, end + 1, F.lit(around)))
