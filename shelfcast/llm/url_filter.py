"""URL filter: allow/block rules by host and path, then a weighted vocabulary.

Strict and soft terms are counted in one pass of an Aho-Corasick automaton over the whole
lower-cased url. A hit counts when neither neighbour is a letter or digit. One strict term, or
``soft_limit`` distinct soft terms, block the page; rules come first, the longest that fits wins."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Fixed values of the query contract: (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/")]
STRICT = ["casino", "porn", "xxx", "viagra", "cialis", "escort", "malware", "phishing", "warez"]
SOFT = ["bet", "bets", "betting", "free", "win", "bonus", "jackpot", "poker", "slots", "cheap", "pill", "pills",
        "pharmacy", "spam", "farm", "ads", "ad", "track", "tracker", "popup", "adult", "sex", "cam", "dating",
        "loan", "loans", "payday", "crack", "torrent", "replica"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` (A-Z lower-cased); path: then up to ``? #``.
    Both empty for a null url and for one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return lower_ascii(host), F.substring(rest, F.length(host) + 1, F.length(rest))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as its text; else null. The rules are a parameter, so the CASE is bounded."""
    out = None
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def term_hits(strict: list[str], soft: list[str]):
    """pandas UDF: (number of strict hits, number of distinct soft terms) of a lower-cased url."""
    soft = [t for t in soft if t not in set(strict)]

    @F.pandas_udf("n_strict long, n_soft long")
    def count(urls: pd.Series) -> pd.DataFrame:
        terms = ahocorasick.Automaton()
        for t in strict:
            terms.add_word(t, (t, True))
        for t in soft:
            terms.add_word(t, (t, False))
        terms.make_automaton()
        part = set("abcdefghijklmnopqrstuvwxyz0123456789")
        rows = []
        for url in urls:
            hard, seen = 0, set()
            for end, (term, is_strict) in terms.iter(url or "") if len(terms) else ():
                start = end - len(term) + 1
                if (start and url[start - 1] in part) or (end + 1 < len(url) and url[end + 1] in part):
                    continue
                if is_strict:
                    hard += 1
                else:
                    seen.add(term)
            rows.append((hard, len(seen)))
        return pd.DataFrame(rows, columns=["n_strict", "n_soft"])
    return count


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT,
               soft_limit: int = 2) -> DataFrame:
    """``pages`` with host, path, rule, verdict, n_strict, n_soft (same-named columns are replaced).

    A null or empty url, or one without ``://``, fits no rule; a null or empty one hits no term, so it is
    allowed. Repeated rows are judged alike; no rows give no rows."""
    host, path = host_and_path(F.col(url_col))
    out = pages.withColumns({"host": host, "path": path,
                             "__hits": term_hits(list(strict), list(soft))(lower_ascii(F.coalesce(F.col(url_col), F.lit(""))))})
    out = out.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules))
    verdict = F.when((F.col("__hits.n_strict") > 0) | (F.col("__hits.n_soft") >= soft_limit), "block").otherwise("allow")
    for v, rule in rules:
        verdict = F.when(F.col("rule") == rule, v).otherwise(verdict)
    return out.withColumns({"verdict": verdict, "n_strict": F.col("__hits.n_strict"),
                            "n_soft": F.col("__hits.n_soft")}).drop("__hits")
