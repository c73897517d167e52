"""Dictionaries and decision lists as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(c: Column, words: Iterable[str]) -> Column:
    return F.exists(F.lit(list(words)), lambda w: F.contains(c, w))


def contained(c: Column, words: Iterable[str]) -> Column:
    """The words that c contains, in the order given."""
    return F.filter(F.lit(list(words)), lambda w: F.contains(c, w))


def has_label(host: Column, labels: Iterable[str]) -> Column:
    """Whether a whole label of the host is in the list."""
    return F.arrays_overlap(F.split(host, r"\."), F.lit(list(labels)))


def first_of(rules: Iterable[tuple[Column, str]], default: str | None = None) -> Column:
    """The outcome of the first condition that holds: a decision list, or the first reason to reject."""
    out = None
    for when, outcome in rules:
        out = F.when(F.coalesce(when, F.lit(False)), outcome) if out is None else out.when(F.coalesce(when, F.lit(False)), outcome)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def points(rules: Iterable[tuple[Column, int]]) -> Column:
    """The sum of the points of all conditions that hold."""
    out = F.lit(0)
    for when, n in rules:
        out = out + F.when(F.coalesce(when, F.lit(False)), n).otherwise(0)
    return out


def best_of(scores: Iterable[tuple[str, Column]], default: str) -> tuple[Column, Column]:
    """The name with the highest positive score, the earlier of equals, and that score; the default with 0."""
    entries = [F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, s) in enumerate(scores)]
    top = F.array_max(F.array(*entries))
    return F.when(top["score"] > 0, top["name"]).otherwise(default), F.greatest(top["score"], F.lit(0))


def weighted_category(categories: list[tuple[str, list[str], list[str]]], url: Column, title: Column, text: Column, default: str) -> tuple[Column, Column]:
    """Category by a dictionary: 3 for each token in the URL; for each keyword 4 in the title, else 2 in the text."""
    scores = []
    for name, tokens, keywords in categories:
        in_title, in_text = F.size(contained(title, keywords)), F.size(F.filter(F.lit(keywords), lambda w: F.contains(text, w) & ~F.contains(title, w)))
        scores.append((name, 3 * F.size(contained(url, tokens)) + 4 * in_title + 2 * in_text))
    return best_of(scores, default)
