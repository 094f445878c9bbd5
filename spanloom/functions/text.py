"""Column functions on words of a transcript."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Lower case, without anything but letters, digits, marks' underscore and apostrophe."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_']+", "")


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ends_sentence(text: Column) -> Column:
    """Whether . ? ! or an ellipsis stands at the end, before any closing quotes or brackets."""
    return F.coalesce(text.rlike("[.?!…][\"')\\]}»”’]*\\s*$"), F.lit(False))


def content_words(tokens: Column, stop_words: Iterable[str]) -> Column:
    stops = F.array(*map(F.lit, stop_words))
    return F.filter(tokens, lambda t: (t != "") & ~F.array_contains(stops, t))


def grouped(parts: Column, sep: str = " ") -> Column:
    """(order, text) structs of a group as one text in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["text"]), sep)


def format_bytes(n: Column) -> Column:
    """B, KB, MB or GB in steps of 1024; one decimal from KB on."""
    kb, mb, gb = n / 1024, n / 1024**2, n / 1024**3
    out = F.when(n < 1024, F.format_string("%d B", n.cast("long")))
    return out.when(kb < 1024, F.format_string("%.1f KB", kb)).when(mb < 1024, F.format_string("%.1f MB", mb)).otherwise(F.format_string("%.1f GB", gb))


def safe_next(path: Column) -> Column:
    """Whether a redirect stays on this host."""
    return F.coalesce(path.startswith("/") & ~path.startswith("//"), F.lit(False))
