"""Text expressions from built-in functions: words, character pairs, token sets, sentences, hashes.

Character pairs come from one pass of a look-ahead pattern, so no lambda evaluates its text again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is two or more of these characters.
TOKEN = "[0-9A-Za-z가-힣]{2,}"
PAIR = r"(?s)(?=(..))"
#: A pair that isn't all white space.
SOLID_PAIR = r"(?s)(?=(\S.|\s\S))"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """The runs of characters other than white space; none for an empty or blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def pairs(text: Column) -> Column:
    """All pairs of neighbouring characters, in order, with repeats; none for fewer than two characters."""
    return F.regexp_extract_all(text, F.lit(PAIR), F.lit(1))


def token_set(text: Column) -> Column:
    """The distinct lower-cased tokens and pairs of the text without white space, upper case kept in pairs."""
    t = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(0)), pairs(F.regexp_replace(t, r"\s+", ""))))


def search_terms(text: Column) -> Column:
    """Lower-cased words, then pairs of the text as it is (pairs of white space left out); repeats stay."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(words(F.lower(t)), F.regexp_extract_all(t, F.lit(SOLID_PAIR), F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """The share of set ``a`` that is in ``b``; 0 if ``a`` is empty."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def sentences(text: Column, longer_than: int = 3) -> Column:
    """Stripped sentences of more than ``longer_than`` characters."""
    return F.filter(F.transform(F.split(text, "[.!?。\n]"), lambda s: strip(s)), lambda s: F.length(s) > longer_than)


def evidence_sentences(text: Column) -> Column:
    """Sentences cut behind their closing mark or at line breaks, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?。])\s+|\n+"), lambda s: strip(s)), lambda s: s != "")


def plain_tokens(text: Column, marks: str) -> Column:
    """The distinct lower-cased words of two characters or more, with ``marks`` taken as spaces."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), marks, " "), r"\s+"), lambda w: F.length(w) >= 2))


# The marks that end words, and the share of a sentence's words that grounds it.
MARKS, POOLED_MARKS, GROUNDED_FROM = "[.,!?·…\"'()\\[\\]]", "[.,!?·…]", 0.3


def grounding(answer: Column, contexts: Column) -> Column:
    """Structs ``sentence, grounded`` of an answer: whether any one context holds enough of a sentence's words; without words: no."""
    held = F.transform(contexts, lambda c: plain_tokens(c, MARKS))
    best = lambda s: F.coalesce(F.array_max(F.transform(held, lambda h: overlap(plain_tokens(s, MARKS), h))), F.lit(0.0))
    return F.transform(evidence_sentences(answer), lambda s: F.struct(s.alias("sentence"), (best(s) >= GROUNDED_FROM).alias("grounded")))


def pooled_grounding(answer: Column, contexts: Column) -> Column:
    """The same against all contexts together, sentences cut behind closing marks only; without words: grounded.

    Repeated words of a sentence count each.
    """
    pool = plain_tokens(F.array_join(contexts, " "), POOLED_MARKS)
    words_of = lambda s: F.filter(F.split(F.regexp_replace(F.lower(s), POOLED_MARKS, " "), r"\s+"), lambda w: F.length(w) >= 2)
    share = lambda s: F.try_divide(F.size(F.filter(words_of(s), lambda w: F.array_contains(pool, w))), F.size(words_of(s)))
    cut = F.filter(F.split(answer, r"(?<=[.!?。])\s+"), lambda s: s != "")
    return F.transform(cut, lambda s: F.struct(s.alias("sentence"), (F.coalesce(share(s), F.lit(1.0)) >= GROUNDED_FROM).alias("grounded")))


def without_numbering(line: Column) -> Column:
    """Without the digits, dots, dashes and brackets that number a list's line."""
    return F.regexp_replace(strip(line), r"^[0-9.\-) ]+", "")


def numbered(items: Column) -> Column:
    """``1. a`` and so on, a line each."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def context_block(chunks: Column, with_ids: bool = True, none: str = "(none)") -> Column:
    """``[1] (chunk_id=x)`` and the content of each struct ``chunk_id, content``, blank lines between them."""

    def one(c: Column, i: Column) -> Column:
        head = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"))
        return F.concat(head, F.lit(" (chunk_id="), c["chunk_id"], F.lit(")\n"), c["content"]) if with_ids else F.concat(head, F.lit(" "), c["content"])

    return F.when(F.size(chunks) > 0, F.array_join(F.transform(chunks, one), "\n\n")).otherwise(none)


def hex_number(digest: Column, start: int, length: int) -> Column:
    """Hexadecimal digits of a digest as a number (15 at most, so that it fits a long)."""
    return F.conv(F.substring(digest, start, length), 16, 10).cast("long")


def md5_mod_64(text: Column) -> Column:
    """md5 as one number, modulo 64: its last two digits decide."""
    return hex_number(F.md5(text.cast("binary")), 31, 2) % 64


def md5_mod_100(text: Column) -> Column:
    """md5 as one number, modulo 100, from four 32-bit parts (2 ** 32 modulo 100 is 96)."""
    digest, rest = F.md5(text.cast("binary")), F.lit(0).cast("long")
    for start in (1, 9, 17, 25):
        rest = (rest * 96 + hex_number(digest, start, 8)) % 100
    return rest


def stem(path: Column) -> Column:
    """A file's name without folders and suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
