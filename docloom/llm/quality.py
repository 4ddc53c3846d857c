"""Quality classifier: document evidence with host and path posteriors, by empirical Bayes.

1. Evidence.  A text has a few measures, each cut into bins.  The labelled documents give, by one
   grouped count over all of them, the log likelihood ratio of good to bad for each bin; a text's
   evidence is the sum over its measures.  The table has a fixed number of entries.
2. Sites.  The expected share of good documents is summed per path (source and language) and per
   host (the source up to the first slash), by grouped aggregation over all documents.  A host's
   share is shrunk toward the global one and a path's toward its host's; how far follows from how
   much the shares vary beyond chance (method of moments), so sparse sites move most.
3. Score.  The posterior of a document joins the log odds of its path with its own evidence.

A document is rejected below ``LEAST_SCORE``.

Defined cases: a null text is measured as an empty one; null source and null language are a site
like any other; labels without an id or a quality are left out and several labels of one id are
averaged; without labels of both kinds there is no evidence and nothing is rejected; equal rows
get equal scores.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import materialise

LEAST_SCORE = 0.5
#: Added to each count of a bin.
SMOOTHING = 0.5
#: Most rows of the path table that are handed to all tasks.
SHARED_PATHS = 100_000
#: Sites count as much as this many documents at least and at most before their own rows do.
LEAST_STRENGTH, MOST_STRENGTH = 5.0, 1e5

BINS = 12

Table = dict[tuple[str, int], float]


def _share(n: Column, of: Column) -> Column:
    return n / F.greatest(of, F.lit(1))


def _log_bin(value: Column, scale: float) -> Column:
    """Bins that grow by factors, 0 for nothing."""
    return F.least(F.ceil(F.log2(value * scale + 1)), F.lit(BINS - 1)).cast("int")


def measures(text: Column) -> dict[str, Column]:
    """Bin numbers of a text, by measure."""
    chars, trimmed = F.length(text), F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    lines = F.split(trimmed, "\n")
    count = F.size(words)
    return {
        "words": _log_bin(F.when(trimmed == "", 0).otherwise(count), 1.0),
        "upper": _log_bin(_share(F.regexp_count(text, F.lit("[A-Z]")), chars), 200.0),
        "marks": _log_bin(_share(F.regexp_count(text, F.lit("[!?]")), chars), 1000.0),
        "symbols": _log_bin(_share(F.regexp_count(text, F.lit(r"[#*$%&<>|{}\[\]=_~^\\]")), chars), 1000.0),
        "digits": _log_bin(_share(F.regexp_count(text, F.lit("[0-9]")), chars), 200.0),
        "word_length": F.least(F.round(_share(chars, count)), F.lit(BINS - 1)).cast("int"),
        # Words come again in any long text: what counts is the share that never does, against the root of the count.
        "variety": F.least(F.floor(_share(F.size(F.array_distinct(words)), count) * BINS), F.lit(BINS - 1)).cast("int"),
        "lines_again": F.floor((1 - _share(F.size(F.array_distinct(lines)), F.size(lines))) * (BINS - 1)).cast("int"),
    }


def sites(documents: DataFrame) -> list[Column]:
    """Host, path and language a document belongs to."""
    source = F.col("source").cast("string")
    return [
        F.substring_index(source, "/", 1).alias("host"),
        source.alias("path"),
        F.col("lang").cast("string").alias("language"),
    ]


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, sites and bins of all documents: narrow rows, written once."""
    bins = [c.alias(name) for name, c in measures(F.coalesce("text", F.lit(""))).items()]
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), *sites(documents), *bins)


def learn(facts: DataFrame, labels: DataFrame) -> tuple[Table, float]:
    """Log likelihood ratio of each bin, and the share of good among the labelled."""
    known = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).alias("good"))
    )
    names = list(measures(F.lit("")))
    bins = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in names]))
    # bins are short in a file: Spark would take the facts of all documents for a small table and broadcast them
    counts = (
        facts.join(known.hint("merge"), "doc_id")
        .select("good", bins.alias("m"))
        .groupBy("m.name", "m.bin")
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
        .collect()
    )
    good = sum(r.good for r in counts if r.name == names[0])
    bad = sum(r.bad for r in counts if r.name == names[0])
    if not good or not bad:
        return {}, 0.5
    table = {
        (r.name, r.bin): math.log((r.good + SMOOTHING) / (good + BINS * SMOOTHING))
        - math.log((r.bad + SMOOTHING) / (bad + BINS * SMOOTHING))
        for r in counts
    }
    return table, good / (good + bad)


def evidence(table: Table, bins: dict[str, Column]) -> Column:
    """Sum of the ratios of a row's bins; unseen bins tell nothing."""
    total = F.lit(0.0)
    for name, column in bins.items():
        own = [table.get((name, i), 0.0) for i in range(BINS)]
        total = total + F.coalesce(F.get(F.array(*map(F.lit, own)), column), F.lit(0.0))
    return total


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _strength(groups: DataFrame, mean: float) -> float:
    """How many documents the prior of a group is worth, from the spread of the groups' shares."""
    row = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mean, 2)).alias("spread"),
        F.sum("n").alias("n"),
        F.count("*").alias("groups"),
    ).first()
    within = mean * (1 - mean)
    if not row["n"] or row["groups"] < 2:
        return LEAST_STRENGTH
    between = row["spread"] / row["n"] - within * row["groups"] / row["n"]
    if between <= 0:
        return MOST_STRENGTH
    return min(max(within / between - 1, LEAST_STRENGTH), MOST_STRENGTH)


def path_posteriors(facts: DataFrame, table: Table, prior: float) -> tuple[DataFrame, int]:
    """(host, path, language, share) of all paths, and how many they are."""
    names = list(measures(F.lit("")))
    own = _chance(evidence(table, {n: F.col(n) for n in names}) + math.log(prior / (1 - prior)))
    paths = materialise(
        facts.groupBy("host", "path", "language").agg(F.count("*").alias("n"), F.sum(own).alias("good")), "paths"
    )
    whole = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    mean = min(max(whole["good"] / whole["n"], 1e-6), 1 - 1e-6) if whole["n"] else prior
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    of_host, of_path = _strength(hosts, mean), _strength(paths, mean)
    hosts = hosts.select(
        F.col("host").alias("h"), ((F.col("good") + of_host * mean) / (F.col("n") + of_host)).alias("host_share")
    )
    shares = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select(
        F.col("host").alias("site_host"),
        F.col("path").alias("site_path"),
        F.col("language").alias("site_language"),
        ((F.col("good") + of_path * F.col("host_share")) / (F.col("n") + of_path)).alias("path_share"),
    )
    return materialise(shares, "shares"), whole["rows"]


def _at_site(columns: list[Column], shares: DataFrame, rows: int) -> tuple[DataFrame, Column]:
    keys = ("site_host", "site_path", "site_language")
    same = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(k)) for c, k in zip(columns, keys, strict=True)])
    return (F.broadcast(shares) if rows <= SHARED_PATHS else shares), same


class Classifier:
    """Learned ratios and the posteriors of all paths of the documents."""

    def __init__(self, documents: DataFrame, labels: DataFrame):
        self.facts = materialise(measured(documents), "measures")
        self.table, self.prior = learn(self.facts, labels)
        self.shares, self.rows = path_posteriors(self.facts, self.table, self.prior)

    def _score(self, bins: dict[str, Column]) -> Column:
        return _chance(evidence(self.table, bins) + _logit(F.col("path_share")))

    def scores(self) -> DataFrame:
        """doc_id, evidence, path_share, score and kept of every document."""
        bins = {n: F.col(n) for n in measures(F.lit(""))}
        shares, same = _at_site([F.col("host"), F.col("path"), F.col("language")], self.shares, self.rows)
        score = self._score(bins)
        kept = (score >= LEAST_SCORE) if self.table else F.lit(True)
        return self.facts.join(shares, same, "left").select(
            "doc_id",
            evidence(self.table, bins).alias("evidence"),
            "path_share",
            score.alias("score"),
            kept.alias("kept"),
        )

    def keep_good(self, documents: DataFrame) -> DataFrame:
        """The documents, with all their columns, that are not rejected."""
        if not self.table:
            return documents
        names = documents.columns
        inner = documents.select(*[F.col(n).alias(f"own_{n}") for n in names], *sites(documents))
        shares, same = _at_site([F.col("host"), F.col("path"), F.col("language")], self.shares, self.rows)
        score = self._score(measures(F.coalesce("own_text", F.lit(""))))
        return inner.join(shares, same, "left").where(score >= LEAST_SCORE).select(
            *[F.col(f"own_{n}").alias(n) for n in names]
        )
