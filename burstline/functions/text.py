"""Column functions for post text. All are built-in expressions: no Python runs per row."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstline.functions.words import STOP_WORDS

# What counts as a link, and the characters that turn into blanks.
LINK_PATTERN = r"(www\.\S+)|(https?://\S+)|(pic\.twitter\.com/\S+)"
# a link, a mention or a hashtag, each up to the next white space
MARKED_PATTERN = r"(www\.|https?://|pic\.twitter\.com/|@|#)\S+"
MARKS = ["@", "#", "http", "www.", "pic.twitter.com/"]
BLANKED_CHARS = ":;>?<=*+()/,-#!$%{}[]^_@|1234567890˜’‘'\"\u00a0—“”€£«❤"
DELETED_CHARS = "."
EMOJI_PATTERN = r"[\x{10000}-\x{10FFFF}]"
SPACE_PATTERN = r"[ \t\n\r\f\x0B]+"


def with_columns_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions read many times.

    A plain projection may be copied into each place that reads it, even into the body of a lambda,
    and then be worked out again per array element. A generator keeps it in one place.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def strip_links(text: Column) -> Column:
    return F.regexp_replace(text, LINK_PATTERN, "")


def display_text(text: Column) -> Column:
    """Text as shown in a topic row: links out, line breaks and tabs to blanks."""
    return F.translate(strip_links(text), "\n\t", "  ")


def normalized_text(text: Column) -> Column:
    """Drop links, mentions and hashtags; blank punctuation, digits, quotes and emoji; delete periods."""
    # most posts hold no mark and only ASCII: look before running the patterns
    marked = reduce(or_, [text.contains(m) for m in MARKS])
    wide = F.octet_length(text) > F.length(text)
    bare = F.when(marked, F.regexp_replace(text, MARKED_PATTERN, "")).otherwise(text)
    bare = F.when(wide, F.regexp_replace(bare, EMOJI_PATTERN, " ")).otherwise(bare)
    return F.translate(bare, BLANKED_CHARS + DELETED_CHARS, " " * len(BLANKED_CHARS))


def content_words(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Words of already normalized text, without stop words and one-letter words."""
    stop = list(stop_words)
    return F.filter(
        F.split(text, SPACE_PATTERN),
        lambda w: (F.length(w) > 1) & ~F.lower(w).isin(stop),
    )


def token_bag(users: Column, hashtags: Column, words: Column,
              stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct @mentions, distinct #tags that are no stop words, then the words in order."""
    stop = list(stop_words)
    tags = F.filter(F.array_distinct(hashtags), lambda t: ~F.lower(t).isin(stop))
    return F.concat(
        F.transform(F.array_distinct(users), lambda u: F.concat(F.lit("@"), F.lower(u))),
        F.transform(tags, lambda t: F.concat(F.lit("#"), F.lower(t))),
        words,
    )


def feature_tokens(bag: Column) -> Column:
    """Tokens used for vectors: no mentions, trimmed, lower case."""
    return F.transform(
        F.filter(bag, lambda t: ~t.contains("@")), lambda t: F.lower(F.trim(t))
    )


def headline_tokens(bag: Column) -> Column:
    """Tokens used for headlines: neither mentions nor hashtags."""
    return F.filter(bag, lambda t: ~t.contains("@") & ~t.contains("#"))


def ngrams(tokens: Column, shortest: int = 2, longest: int = 3) -> Column:
    """Distinct word n-grams of a token array, joined by one blank."""

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
        # sequence(1, 0) would count down, so short arrays need the guard
        return F.when(F.size(tokens) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[grams(n) for n in range(shortest, longest + 1)]))
