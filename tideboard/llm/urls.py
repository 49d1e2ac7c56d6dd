"""URL filter: rules first, then naive Bayes over words that a unigram model finds in host names and paths.

Host names run words together. Word counts come from the corpus; every substring of a host label that is a counted word
is looked up by a join, and the Viterbi path through them is the segmentation. A multinomial naive Bayes model over the
segmented tokens of hosts and paths, hashed to a fixed number of buckets, gives the verdict where no rule fits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideboard.llm.common import staged, table

LABEL_CHARS, WORD_CHARS = 63, 24  # the longest host label that may exist; the longest word that is looked up
BUCKETS, SMOOTHING = 1 << 16, 0.001
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rules:
    """``host/path`` prefixes; the longest that fits decides."""

    block: tuple[str, ...] = ("net/", "example.com/de/")
    allow: tuple[str, ...] = ("example.net/en/", "org/fr/")

    def ordered(self) -> list[tuple[str, str]]:
        both = [(r, "block") for r in self.block] + [(r, "allow") for r in self.allow]
        return sorted(both, key=lambda x: (-len(x[0]), x[0]))


@dataclass(frozen=True)
class Seeds:
    """Words that mark an unwanted host for the fit. The model generalises from the tokens they occur with."""

    words: tuple[str, ...] = field(
        default=("ads", "adult", "bet", "bets", "casino", "cheap", "click", "free", "loan", "pills", "porn", "spam", "track", "viagra", "win", "xxx")
    )


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
    ``#`` or the end. A null url, or one without ``://``, has neither: both are empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    text = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumn("host", lower_ascii(F.regexp_extract(text, pattern, 1))).withColumn("path", F.regexp_extract(text, pattern, 2))


def rule_of(rules: Rules) -> Column:
    """The longest rule that fits a row's host, or a parent domain of it, and the start of its path; else null."""
    out = None
    for rule, _ in rules.ordered():
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def host_labels(host: Column) -> Column:
    return F.filter(F.split(host, r"[.\-_:@]+"), lambda x: x != "")


def path_tokens(path: Column) -> Column:
    """Lower-cased path words; runs of digits are one token."""
    words = F.split(F.regexp_replace(F.lower(path), r"\p{N}+", "0"), r"[^\p{L}0]+")
    return F.transform(F.filter(words, lambda x: x != ""), lambda x: F.concat(F.lit("/"), x))


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n: lower-cased words of a-z, two letters or more, of a column ``text``. All of them, however rare."""
    words = texts.select(F.explode(F.split(F.lower(F.regexp_replace("text", r"<[^>]*>", " ")), r"[^a-z]+")).alias("word"))
    return words.filter((F.length("word") >= 2) & (F.length("word") <= WORD_CHARS)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(label: str, words: list[str], counts: list[int], total: int) -> list[str]:
    """The likeliest cut of a label into counted words and, at the price of one rare word for each letter, unknown
    letters; those that stand together are one token. Of equal paths the one with the longer last word."""
    cost = {w: float(np.log(total + 1) - np.log(n)) for w, n in zip(words, counts, strict=True)}
    unknown = float(np.log(total + 1) + np.log(10.0))
    best, back = [0.0] + [np.inf] * len(label), [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for start in range(max(0, end - WORD_CHARS), end):
            price = cost.get(label[start:end], unknown if end - start == 1 else np.inf)
            if best[start] + price < best[end]:
                best[end], back[end] = best[start] + price, start
    out, known, end = [], [], len(label)
    while end:
        start = back[end]
        piece, is_known = label[start:end], label[start:end] in cost
        if out and not is_known and not known[-1]:
            out[-1] = piece + out[-1]
        else:
            out.append(piece)
            known.append(is_known)
        end = start
    return out[::-1]


def segment_labels(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """label, words: every different label cut by the word counts. A label has at most 63 * 24 substrings, so what
    meets for one label is bounded; longer labels, which no host has, stay whole."""
    total = int(counts.agg(F.sum("n")).first()[0] or 0)
    fit = labels.filter(F.length("label") <= LABEL_CHARS)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.length("label")), lambda i: F.transform(F.sequence(F.lit(2), F.lit(WORD_CHARS)), lambda n: F.substring(F.col("label"), i, n))))
    subs = fit.select("label", F.explode(F.array_distinct(spans)).alias("word")).filter(F.length("word") >= 2)
    found = subs.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("found"))

    @F.pandas_udf("array<string>")
    def cut(label: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([viterbi(x, [f["word"] for f in fs], [f["n"] for f in fs], total) for x, fs in zip(label, found, strict=True)])

    known = found.select("label", cut("label", "found").alias("words"))
    return labels.join(known, "label", "left").withColumn("words", F.coalesce("words", F.array("label")))


@dataclass
class Bayes:
    """Log odds of block against allow by token bucket, and of the classes."""

    odds: np.ndarray
    prior: float


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def fit_bayes(tokens: DataFrame, prior: DataFrame) -> Bayes:
    """From rows (token, block, n) and (block, n); at most two rows a bucket come to the driver."""
    counts = np.full((2, BUCKETS), SMOOTHING)
    for r in tokens.groupBy(bucket(F.col("token")).alias("at"), "block").agg(F.sum("n").alias("n")).collect():
        counts[int(r["block"]), r["at"]] += r["n"]
    classes = {bool(r["block"]): r["n"] for r in prior.collect()}
    odds = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    return Bayes(odds, float(np.log((classes.get(True, 0) + 1) / (classes.get(False, 0) + 1))))


def judge_urls(pages: DataFrame, corpus: DataFrame, rules: Rules = Rules(), seeds: Seeds = Seeds()) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score of every page; ``corpus`` has the column text.

    ``words`` are the host's segmented words; ``score`` the method's log odds for block, verdict the rule's where one
    fits and else block if the score is over 0. A page without host has no words and is allowed unless its path says
    otherwise. For the fit a page is unwanted if a seed is among its host's words. Repeated rows have a row each; an
    empty table gives none. Hosts are judged once each, so one that holds most pages costs no more than another."""
    spark = pages.sparkSession
    rows = staged(with_host_and_path(pages.select("page_id", "url")).drop("url"), "url-rows")
    hosts = staged(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "url-hosts")
    labels = hosts.select("host", F.posexplode(host_labels(F.col("host"))).alias("at", "label"))
    cut = segment_labels(labels.select("label").distinct(), staged(word_counts(corpus), "url-word-counts"))
    # Ordered by place; a host has at most a few dozen labels.
    ordered = labels.join(cut, "label").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    hosts = hosts.join(ordered, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    hosts = staged(hosts.withColumn("block", F.arrays_overlap("words", F.array(*map(F.lit, seeds.words)))), "url-host-words")
    paths = staged(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).join(hosts.select("host", "block"), "host"), "url-paths")
    host_tokens = hosts.select(F.explode("words").alias("token"), "block", "n")
    tokens = host_tokens.unionByName(paths.select(F.explode(path_tokens(F.col("path"))).alias("token"), "block", "n"))
    model = fit_bayes(tokens, hosts.groupBy("block").agg(F.sum("n").alias("n")))
    odds = F.broadcast(spark.createDataFrame(pd.DataFrame({"at": np.arange(BUCKETS, dtype=np.int32), "odds": model.odds})))  # BUCKETS rows

    def summed(df: DataFrame, keys: list[str], words: Column, name: str) -> DataFrame:
        each = df.select(*keys, F.explode(words).alias("token")).withColumn("at", bucket(F.col("token"))).join(odds, "at")
        return each.groupBy(*keys).agg(F.sum("odds").alias(name))

    host_score = summed(hosts, ["host"], F.col("words"), "host_odds")
    scored = hosts.select("host", "words").join(host_score, "host", "left")
    path_odds = summed(rows.select("path").distinct(), ["path"], path_tokens(F.col("path")), "path_odds")
    score = F.lit(model.prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
    judged = rows.join(scored, "host").join(path_odds, "path", "left").withColumn("rule", rule_of(rules)).withColumn("score", F.round(score, 6))
    of_rule = F.when(F.col("rule").isin(list(rules.block)), "block").when(F.col("rule").isNotNull(), "allow")
    verdict = F.coalesce(of_rule, F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "words", "score")


def op2_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; the word counts are those of all page sources."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, pages.select(F.col("html").alias("text")))


QUERIES = {"op2_url_words": op2_url_words}
