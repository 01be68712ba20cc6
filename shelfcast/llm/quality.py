"""Quality rules, line first (DataFrame functions only; no shuffle, every document is settled in its row).

Each line with a word is judged by punctuation, navigation, symbol, shouting and boilerplate rules;
failing lines and lines equal to an earlier one are removed, and a document that loses more than
``max_lost`` of its line text is rejected. Base rules reject very short and very repetitive texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

#: Fixed value of the query contract.
SYMBOL = r"[#*$%&|<>]"
SPLIT = r"[\x20\x09-\x0D]+"
ENDS = [*".!?:;…。！？\"'”’»)]"]
#: Phrases of lines that belong to a page, not to its text (lower case).
BOILERPLATE = ["javascript", "cookies", "lorem ipsum", "all rights reserved", "terms of use", "terms of service",
               "privacy policy", "click here", "read more", "sign up", "log in", "subscribe now", "©"]


def line_passes(line: Column, low: Column) -> Column:
    """Keep a line that ends a sentence, is no menu, no symbol noise, no shouting and no boilerplate (``low``:
    the line in lower case); cheap rules come first, the rest are not evaluated for a line that has failed."""
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    menu = F.length(line) - F.length(F.replace(line, F.lit(" | "), F.lit("")))
    head = F.substring(line, 1, 4)
    shouts = (F.upper(head) == head) & (low != line) & (F.upper(line) == line) & (spaces >= 4)
    passes = F.substring(line, -1, 1).isin(ENDS) & (menu < 9) & ~shouts
    for phrase in BOILERPLATE:
        passes = passes & ~low.contains(phrase)
    return passes & (F.regexp_count(line, F.lit(SYMBOL)) * 2 <= spaces + 1)


def windows(words: Column) -> Column:
    """The hash of each window of three words."""
    n = F.greatest(F.size(words), F.lit(1))
    two = F.zip_with(words, F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(two, F.slice(words, 3, n), lambda a, b: F.xxhash64(a, b))
    return F.slice(three, 1, F.greatest(F.size(words) - 2, F.lit(0)))


def next_to(col: str) -> tuple[Column, Column]:
    """(the array, the array from its second element on), to be zipped."""
    return F.col(col), F.slice(col, 2, F.greatest(F.size(col), F.lit(1)))


def quality_rules(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat: int = 50,
                  max_lost: float = 0.5) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost_chars,
    n_line_chars, kept, clean_text (the lines that pass, in order); same-named columns are replaced.

    A null or empty text has no words, so it fails the base rules; clean_text is then empty. Ties cannot
    occur; repeated rows are judged alike; no rows give no rows. 3-word windows are compared by xxhash64."""
    nothing = F.lit(0).cast("long")
    d = docs.withColumns({"__t": F.coalesce(F.col(text_col), F.lit(""))})
    d = d.withColumns({"__w": F.array_remove(F.split("__t", SPLIT), ""),
                       "__l": F.filter(F.split("__t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)})
    d = d.withColumns({"__h": windows(F.col("__w")), "__u": F.array_distinct("__l")})
    # most texts repeat no window: only those that do are sorted
    d = d.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(
        F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.zip_with(*next_to("__s"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    d = d.withColumn("__p", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    # each repeated window covers three words, less what the next one covers
    cover = F.zip_with(*next_to("__p"), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    stop = F.lit(SPACES)
    d = d.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count("__t", F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size("__u")).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(cover, nothing, lambda a, x: a + x), nothing),
        "__good": F.filter(F.transform("__u", lambda x: F.struct(F.rtrim(x, stop).alias("t"), F.lower(x).alias("low"))),
                           lambda x: line_passes(x["t"], x["low"]))["t"],
        "n_line_chars": F.aggregate("__l", nothing, lambda a, x: a + F.length(F.rtrim(x, stop)))})
    d = d.withColumns({
        "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")),
        "n_lost_chars": F.col("n_line_chars") - F.aggregate("__good", nothing, lambda a, x: a + F.length(x)),
        "clean_text": F.array_join("__good", "\n"),
        # a filter on the verdict stays above this point, else the optimizer would copy all of the above into it
        "__n": F.monotonically_increasing_id()})
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_chars") <= max_lost * F.col("n_line_chars")) & (F.col("__n") >= 0))
    return d.drop("__t", "__w", "__l", "__h", "__s", "__u", "__p", "__good", "__n")
