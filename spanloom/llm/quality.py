"""Quality rules: a threshold table compiled into projections, without user functions.

Null and empty texts have no words; texts of any length are taken whole. Counts are per row, so
ties and repeated rows play no part; an empty table gives an empty table. Columns of the table
stay; one that is named like a result (`_q`, `kept`) is kept under that name and "_".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import make_room, spare

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
# Frequent function words of the four languages of the corpus.
STOP_WORDS = """
the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were
der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
le la les de des et un une du en est que qui dans pour par sur pas plus avec au il elle sont ce aux se ne
el los las del que y en un una es con por para se no al lo como más su o
""".split()
#: (measure, least or most, value): a text is kept if every line holds.
RULES = (
    ("words", "least", 50),
    ("mean_word_chars", "least", 1.5),
    ("mean_word_chars", "most", 14.0),
    ("symbols_per_word", "most", 0.2),
    ("stop_word_ratio", "least", 0.03),
    ("duplicate_line_ratio", "most", 0.5),
    ("repeated_word_ratio", "most", 0.5),
)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df's columns and `_q`, a struct of counts for every row.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop, n_lines (all long).
    Repeated 3-word windows are found by sorting a text's 64-bit window hashes with their
    places: n log n in its length, never all pairs.
    """
    df = make_room(df, ["_q"], keep=text)
    kt, kw, ks, kl = (spare(df, c) for c in ("_t", "_w", "_s", "_l"))
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(F.col(kt), F.lit(WHITE))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))
    lines = F.filter(F.split(F.col(kt), "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    window = lambda i: F.struct(F.xxhash64(F.get(kw, i), F.get(kw, i + 1), F.get(kw, i + 2)).alias("h"), i.alias("i"))
    h = lambda j: F.get(ks, j)["h"]
    same = lambda j: (h(j) == h(j - 1)) | (h(j) == h(j + 1))
    n = F.size(kw)
    places = F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size(ks) - 1), lambda j: F.when(same(j), F.get(ks, j)["i"])), lambda x: x.isNotNull()))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct((p + 2).alias("last"), (acc["n"] + p + 2 - F.greatest(p - 1, acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    long = lambda c: c.cast("long")
    return (
        df.withColumn(kt, t)
        .withColumn(kw, words)
        .withColumn(ks, F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))))
        .withColumn(kl, lines)
        .withColumn(
            "_q",
            F.struct(
                long(n).alias("n_words"),
                long(F.length(F.translate(kt, WHITE, ""))).alias("word_chars"),
                long(F.length(kt) - F.length(F.translate(kt, SYMBOLS, ""))).alias("n_symbols"),
                long(F.size(kl) - F.size(F.array_distinct(kl))).alias("n_dup_lines"),
                long(F.coalesce(F.when(F.size(ks) >= 2, covered), F.lit(0))).alias("n_repeat_words"),
                long(F.size(F.filter(kw, lambda w: F.lower(w).isin(STOP_WORDS)))).alias("n_stop"),
                long(F.size(kl)).alias("n_lines"),
            ),
        )
        .drop(kt, kw, ks, kl)
    )


def verdict(rules=RULES) -> Column:
    """One Boolean expression of the whole threshold table over `_q`."""
    q = F.col("_q")
    per = lambda a, b: F.coalesce(F.try_divide(q[a].cast("double"), q[b].cast("double")), F.lit(0.0))
    known = {
        "words": q["n_words"].cast("double"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_ratio": per("n_stop", "n_words"),
        "duplicate_line_ratio": per("n_dup_lines", "n_lines"),
        "repeated_word_ratio": per("n_repeat_words", "n_words"),
    }
    out = F.lit(True)
    for measure, kind, value in rules:
        x = known[measure]
        out = out & ((x >= F.lit(float(value))) if kind == "least" else (x <= F.lit(float(value))))
    return out


def quality_rules(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """df with `_q` and `kept`: the counts of each text and whether it passes every rule."""
    return measures(make_room(df, ["_q", "kept"], keep=text), text).withColumn("kept", verdict(rules))
