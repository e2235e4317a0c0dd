"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def contains(text: Column, pattern: str) -> Column:
    """Regex test that is false, never NULL, on a NULL text."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def title_case(text: Column) -> Column:
    """Upper-case every word start, also after a hyphen (``initcap`` only knows spaces)."""
    return F.array_join(F.transform(F.split(text, "-"), F.initcap), "-")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_folder(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def drop_extension(name: Column) -> Column:
    """Cut the last four characters (``.jpg``, ``.CR2``)."""
    return F.left(name, F.length(name) - 4)


def replace_first(text: Column, pattern: str, to: str) -> Column:
    """Replace only the first match (``regexp_replace`` replaces all of them)."""
    return F.regexp_replace(text, f"(?s)^(.*?){pattern}", f"$1{to}")


def replace_first_text(text: Column, find: str, to: str) -> Column:
    """Replace the first occurrence of a fixed text, without a regex."""
    at = F.instr(text, find)
    return F.when(at > 0, F.overlay(text, F.lit(to), at, F.lit(len(find)))).otherwise(text)


def word(text: Column, n: int) -> Column:
    return F.get(F.split(text, " "), F.lit(n - 1))


def folder_date(path: Column) -> Column:
    """Date from the first free-standing run of eight digits in a path."""
    return F.try_to_date(F.regexp_extract(path, r"\b\d{8}\b", 0), "yyyyMMdd")


def join_words(words: Column, sep: str = ", ", last: str = " and ") -> Column:
    """Array of words to ``a, b and c``."""
    n = F.size(words)
    head = F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), sep)
    return F.when(n > 1, F.concat(head, F.lit(last), F.element_at(words, -1))).otherwise(
        F.array_join(words, sep)
    )
