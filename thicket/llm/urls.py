"""URL filters: host word segmentation and naive Bayes, behind longest-match rules.

A unigram model with a Viterbi search splits the letter runs of hosts into
words; multinomial naive Bayes scores those and the words of the path. Unigram
counts come from where urls set words apart (paths, and host labels with
hyphens) and from a list of common words. Which of a run's substrings are words
is a join with the table of counts, and all counts and scores are tables too, so
nothing grows on the driver; words of any length count. Hosts that hold a seed
word teach the class of blocked urls, all others the class of allowed ones;
scores then come from the counts of all words alone, seeds or not.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no rule and verdict allow; repeated rows are judged alike; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: What a word that was never seen costs for each letter, in nats.
UNSEEN = 2.5
#: Letters of a run that are cut into substrings at once.
PIECE = 256
#: Added to the count of each word in each class.
SMOOTHING = 0.5
#: Words that mark a host as unwanted, and common words of host names; both give the segmenter its first counts.
BLOCK_SEEDS = ("adult", "ads", "bet", "bets", "casino", "cheap", "click", "escort", "farm", "free", "gamble", "jackpot", "lottery", "loan", "loans", "malware", "nude", "phish", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "torrent", "track", "tracker", "viagra", "warez", "win", "winner", "xxx")
COMMON_WORDS = ("about", "academy", "and", "app", "art", "best", "big", "blog", "book", "books", "box", "car", "city", "club", "code", "com", "craft", "data", "day", "design", "dev", "docs", "edu", "en", "example", "fast", "food", "for", "forum", "game", "games", "garden", "gov", "green", "group", "health", "help", "home", "house", "info", "lab", "labs", "law", "learn", "life", "list", "live", "m", "mail", "map", "market", "media", "museum", "music", "my", "net", "new", "news", "now", "of", "on", "online", "open", "org", "page", "photo", "play", "post", "press", "quick", "read", "review", "river", "road", "school", "science", "shop", "site", "smart", "space", "sport", "star", "store", "story", "study", "sun", "team", "tech", "the", "time", "to", "top", "town", "travel", "tree", "university", "video", "water", "weather", "web", "wiki", "work", "world", "www", "your")
#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together), as text, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def words_of(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}]+)"), F.lit(1))


def segment(run: str, spans: list[tuple[int, int, float]], log_n: float) -> list[str]:
    """The likeliest words of a letter run; spans: (start, length, count) of its substrings that are words.

    A word never seen costs log_n and UNSEEN a letter, whatever its length: the
    best start of one is carried along.
    """
    n = len(run)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for start, length, count in spans:
        ending[start + length].append((start, log_n - math.log(count)))
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    open_at, open_cost = 0, 0.0  # the start of an unseen word that would be cheapest here
    for end in range(1, n + 1):
        if best[end - 1] - UNSEEN * (end - 1) < open_cost:
            open_at, open_cost = end - 1, best[end - 1] - UNSEEN * (end - 1)
        best[end], back[end] = open_cost + UNSEEN * end + log_n, open_at
        for start, cost in sorted(ending[end]):
            if best[start] + cost < best[end]:
                best[end], back[end] = best[start] + cost, start
    words, end = [], n
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def unigrams(urls: DataFrame, lexicon: tuple[str, ...] = (*BLOCK_SEEDS, *COMMON_WORDS)) -> tuple[DataFrame, float, list[int]]:
    """The table of words and counts (w, n), the log of their sum, and the lengths that words have (one number each). urls: host, path, n."""
    apart = F.array_join(F.filter(F.split("host", r"\."), lambda x: x.contains("-")), " ")
    words = urls.select(F.explode(F.concat(words_of(apart), words_of(F.col("path")))).alias("w"), "n")
    counted = stored(words.groupBy("w").agg(F.sum("n").cast("double").alias("n")), "words")
    total, lengths = counted.groupBy(F.length("w").alias("m")).agg(F.sum("n").alias("n")).agg(F.sum("n"), F.collect_list("m")).first()
    first = max(50.0, (total or 0) / 2000)  # what each word of the lexicon counts besides
    known = urls.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in lexicon])).alias("w"), F.lit(first).alias("n"))
    both = counted.unionByName(known).groupBy("w").agg(F.sum("n").alias("n"))
    return both, math.log((total or 0) + first * len(lexicon) + 1), sorted({*lengths, *map(len, lexicon)})


def segmented(runs: DataFrame, counts: DataFrame, log_n: float, lengths: list[int]) -> DataFrame:
    """run, words for each row of runs (run: distinct letter runs); stored.

    Substrings bear the run's number, and are taken from pieces of PIECE letters
    (and as many more as the longest word), so a run of n letters costs about n
    times the number of lengths, however long it is.
    """
    runs = stored(runs.select("run", F.monotonically_increasing_id().alias("no")), "runs")
    size, most = F.length("run"), max(lengths)
    pieces = F.transform(F.sequence(F.lit(0), size - 1, F.lit(PIECE)), lambda at: F.struct(at.alias("at"), F.substring(F.col("run"), at + 1, F.lit(PIECE + most)).alias("text")))
    cut = runs.select("no", F.explode(pieces).alias("p")).select("no", "p.at", "p.text")

    def words(start: Column) -> Column:
        fitting = F.filter(F.lit(lengths), lambda m: m <= F.length("text") - start)
        return F.transform(fitting, lambda m: F.struct((F.col("at") + start).alias("start"), m.alias("length"), F.substring(F.col("text"), start + 1, m).alias("w")))

    starts = F.sequence(F.lit(0), F.least(F.lit(PIECE), F.length("text")) - 1)
    spans = cut.select("no", F.explode(F.flatten(F.transform(starts, words))).alias("s")).select("no", "s.start", "s.length", "s.w")
    seen = spans.join(counts, "w")
    by = seen.groupBy("no").agg(F.collect_list(F.struct("start", "length", "n")).alias("spans"))  # as many as a run has substrings

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, found: pd.Series) -> pd.Series:
        rows = zip(run, found, strict=True)
        return pd.Series([segment(r, [(s["start"], s["length"], s["n"]) for s in x] if x is not None else [], log_n) for r, x in rows], dtype=object)

    return stored(runs.join(by, "no", "left").select("run", split("run", "spans").alias("words")), "segments")


class Model:
    """Naive Bayes over the words of urls, as tables: host_words (host, w), labels (host, bad, n), odds (w, odds)."""

    def __init__(self, urls: DataFrame, train: Callable[[Column], Column] | None = None, known: DataFrame | None = None):
        """urls: host, path, n, each distinct; train: which hosts teach (all if None); known: hosts whose class is known (host, bad), in place of the seed words."""
        counts, log_n, lengths = unigrams(urls)
        hosts = urls.groupBy("host").agg(F.sum("n").alias("n"))
        runs = hosts.select("host", F.explode(words_of(F.col("host"))).alias("run"))
        split = segmented(runs.select("run").distinct(), counts, log_n, lengths)
        self.host_words = stored(runs.join(split, "run").select("host", F.explode("words").alias("w")), "host-words")
        bad = self.host_words.groupBy("host").agg(F.bool_or(F.col("w").isin(*BLOCK_SEEDS)).alias("bad"))
        labels = hosts.join(bad, "host", "left").select("host", "n", F.coalesce("bad", F.lit(False)).alias("bad")) if known is None else hosts.join(known.groupBy("host").agg(F.bool_or("bad").alias("bad")), "host")
        self.labels = stored(labels, "host-labels")
        teach = self.labels if train is None else self.labels.where(train(F.col("host")))
        of_hosts = self.host_words.join(teach, "host").select("w", "n", "bad")
        of_paths = urls.select("host", "path", "n").join(teach.select("host", "bad"), "host").select(F.explode(words_of(F.col("path"))).alias("w"), "n", "bad")
        by = of_hosts.unionByName(of_paths).groupBy("w").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("g"))
        by = stored(by, "class-words")
        b, g, words = by.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("g"), F.lit(0)), F.count(F.lit(1))).first()
        nb, ng = teach.agg(F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("bad"), F.col("n"))), F.lit(0))).first()
        self.prior = math.log((nb + 1) / (ng + 1))
        share = lambda n, total: F.log((n + SMOOTHING) / (total + SMOOTHING * (words + 1)))
        #: A word of neither class.
        self.unseen = math.log((g + SMOOTHING * (words + 1)) / (b + SMOOTHING * (words + 1)))
        self.odds = by.select("w", (share(F.col("b"), b) - share(F.col("g"), g)).alias("odds"))

    def sums(self, words: DataFrame, key: str) -> DataFrame:
        """key and the sum of the odds of its words."""
        odds = F.coalesce("odds", F.lit(self.unseen))
        return words.join(self.odds, "w", "left").groupBy(key).agg(F.sum(odds).alias(f"{key}_odds"))

    def scored(self, urls: DataFrame) -> DataFrame:
        """urls (any rows with host and path) with log_odds."""
        hosts = stored(self.sums(self.host_words, "host"), "host-odds")
        paths = urls.select("path").distinct().select("path", F.explode(words_of(F.col("path"))).alias("w"))
        paths = stored(self.sums(paths, "path"), "path-odds")
        found = urls.join(hosts, "host", "left").join(paths, "path", "left")
        total = F.lit(self.prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
        return found.withColumn("log_odds", F.round(total, 9)).drop("host_odds", "path_odds")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", train: Callable[[Column], Column] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Per page: host, path, the rule that fits or null, verdict (the rule's, else the classifier's) and the classifier's log-odds.

    Hosts of known class (host, bad), where there are such, teach in place of the seed words.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    urls = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    distinct = stored(urls.where("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "urls")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = Model(distinct, train, known).scored(urls).withColumn("rule", rule)
    by_method = F.when((F.col("host") != "") & (F.col("log_odds") > 0), "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce(verdict, by_method)).select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict", "log_odds")
