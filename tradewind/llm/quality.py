"""Quality rules over documents with cross-document line frequency, in DataFrame functions only.

One pass over the texts computes the per-document figures and a compact list of hashed, normalised lines, which is written
once; everything that looks across documents works on that list and never touches the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fenced, materialize, unfenced, words

WINDOW = 8


def _window_hashes(hashes: Column, n: Column) -> Column:
    parts = lambda i: [F.get(hashes, i + k) for k in range(WINDOW)]
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*parts(i)))).otherwise(F.array().cast("array<bigint>"))


def text_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text.

    Null counts as the empty text: all figures 0. n_repeat_words counts the words that lie in an 8-word window found twice or
    more in the same text. Windows are compared by a 64-bit hash. Columns named like a result are replaced, all others carried
    along, whatever their names.
    """
    rows, inner, outer = fenced(docs, {text: "text"}, FIGURES)
    return unfenced(_figures(rows), inner, outer, FIGURES)


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _figures(rows: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    out = rows.withColumns({"ws": words(F.col("text")), "ls": lines})
    out = out.withColumns(
        {
            "n_words": F.size("ws").cast("long"),
            "word_chars": F.length(F.array_join("ws", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long"),
            "hs": F.transform("ws", lambda w: F.xxhash64(w)),
        }
    ).drop("ws", "ls")
    out = out.withColumn("vs", _window_hashes(F.col("hs"), F.col("n_words").cast("int"))).drop("hs")
    # Most texts repeat no window; only the others sort theirs.
    order = F.sort_array(F.transform("vs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("ss", F.when(F.size(F.array_distinct("vs")) < F.size("vs"), order)).drop("vs")
    same = lambda x, k: F.coalesce(x["h"] == F.get("ss", k)["h"], F.lit(False))
    out = out.withColumn("rs", F.filter("ss", lambda x, k: same(x, k - 1) | same(x, k + 1))).drop("ss")
    out = out.withColumn("ps", F.sort_array(F.transform("rs", lambda x: x["i"]))).drop("rs")
    steps = F.transform("ps", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("ps", k + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("ps")


def hashed_lines(text: Column) -> Column:
    """Array of (hash of the normalised line, words of the line) over all lines of a text that hold a letter."""
    norm = lambda x: F.trim(F.lower(F.regexp_replace(x, r"[^\p{L}]+", " ")))
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(norm(x).alias("x"), F.regexp_count(x, F.lit(r"[^ \t-\r]+")).alias("n")))
    return F.transform(F.filter(lines, lambda x: x["x"] != ""), lambda x: F.struct(F.xxhash64(x["x"]).alias("h"), x["n"].alias("n")))


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    line_words: int = 3,
    line_docs: int = 20,
    small_docs: int = 4,
    small_share: float = 0.1,
    keep_share: float = 0.3,
) -> DataFrame:
    """Judges every row: its columns but the text, the figures of text_figures, base_failed, words_left and kept.

    Base rules: fewer than min_words words, or more than max_repeat_percent percent of the words in repeated windows.
    Method: lines of at least line_words words are normalised (letters only, lower case) and hashed; lines without a letter
    stay out of it. Per host, the distinct documents that hold a line are counted, exact copies of a text as one (copies are
    near-dedup's matter; counted, they would take the one that should stay). A line is removed if more than line_docs documents
    hold it, whatever the size of the host, or on a small host at least small_docs and more than small_share of its documents.
    A document is rejected if that leaves fewer than min_words words or less than keep_share of them.

    Null and empty texts fail the base rule. A null host is a host of its own. Each row of repeated rows is judged; an empty
    table gives an empty result. Columns named like a result are replaced, all others carried along, whatever their names.
    """
    added = (*FIGURES, "base_failed", "words_left", "kept")
    rows, inner, outer = fenced(docs, {text: "text", host: "host"}, (text, *added))
    t = F.coalesce(F.col("text"), F.lit(""))
    site = F.xxhash64(F.coalesce(F.col("host").cast("string"), F.lit("\0")))
    figures = _figures(rows.withColumns({"site": site, "copy": F.xxhash64(t, F.hash(t)), "lines": hashed_lines(F.col("text"))})).drop("text", "host")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    known = materialize(figures.withColumns({"base_failed": base, "row": F.monotonically_increasing_id()}))

    sizes = known.groupBy("site").agg(F.countDistinct("copy").alias("docs"))
    long_lines = known.select("row", "site", "copy", F.inline(F.filter("lines", lambda x: x["n"] >= line_words)))
    held = long_lines.groupBy("site", "h").agg(F.countDistinct("copy").alias("held")).filter(F.col("held") >= small_docs)
    often = (F.col("held") > line_docs) | (F.col("held") > small_share * F.col("docs"))
    # Written first, so that the join below is planned by their true size: broadcast if small, shuffled otherwise.
    frequent = materialize(held.join(sizes, "site").filter(often).select("site", "h"))
    removed = long_lines.join(frequent, ["site", "h"]).groupBy("row").agg(F.sum("n").alias("gone"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    out = known.join(removed, "row", "left").withColumn("words_left", left)
    depleted = (F.col("words_left") < min_words) | (F.col("words_left") < keep_share * F.col("n_words"))
    return unfenced(out.withColumn("kept", ~F.col("base_failed") & ~depleted), inner, outer, added)
