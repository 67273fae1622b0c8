"""Column expressions over command text: shell words, search terms, character n-grams."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode white space, spelled out so that every engine means the same set.
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"

# A shell word: runs without white space or quotes, glued to quoted runs. A
# quote only closes itself; an open one runs to the end. Every quantifier is
# possessive, which keeps the matcher iterative on words of any length.
SHELL_WORD = rf"""(?:[^{SPACE}"']++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))++"""

# Search terms: runs of letters, marks, digits and underscore.
NOT_TERM = r"[^\p{L}\p{M}\p{N}_]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"\A[{SPACE}]++", ""), rf"(?<![{SPACE}])[{SPACE}]++\z", "")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def shell_words(command: Column) -> Column:
    return F.regexp_extract_all(strip(command), F.lit(SHELL_WORD), 0)


def command_name(command: Column) -> Column:
    """The first shell word, or the empty string; needs no list of all the words."""
    return F.regexp_extract(strip(command), rf"\A{SHELL_WORD}", 0)


def search_terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_TERM), lambda term: term != "")


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), rf"[{SPACE}]+"), lambda word: word != "")


def word_ngrams(word: Column, shortest: int = 2, longest: int = 5) -> Column:
    """Character n-grams of one word padded with a blank on both sides.

    Sizes above the padded length give nothing, so the whole word is counted
    once and short words are not repeated for every larger size.
    """
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    size = F.length(padded)

    def of_size(n: Column) -> Column:
        starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda start: padded.substr(start, n))

    return F.flatten(F.transform(F.sequence(F.lit(shortest), F.lit(longest)), of_size))


def char_ngrams(text: Column, shortest: int = 2, longest: int = 5) -> Column:
    return F.flatten(F.transform(words(text), lambda word: word_ngrams(word, shortest, longest)))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def shorten(text: Column, longest: int, kept: int) -> Column:
    """Texts over ``longest`` characters keep the first ``kept`` and an ellipsis."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, kept), F.lit("..."))).otherwise(text)


def shorten_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(
        (F.length(path) > 20) & (F.size(parts) > 2),
        F.concat(F.lit(".../"), F.concat_ws("/", F.slice(parts, -2, 2))),
    ).otherwise(path)


def path_label(path: Column) -> Column:
    """``leaf (full path)``; the leaf of a path that ends in a slash is shown as ``/``."""
    leaf = basename(path)
    shown = F.when(leaf == "", F.lit("/")).otherwise(leaf)
    return F.when(F.instr(path, "/") > 0, F.concat(shown, F.lit(" ("), path, F.lit(")"))).otherwise(path)
