"""URL filtering: allow and block rules, and boosted trees for the URLs that no rule fits.

The URLs that a rule fits are the labelled ones. The trees are gradient-boosted on lexical features,
binned to small integers, with DataFrame aggregations only: each level of a tree takes one histogram
of gradients by (node, feature, bin), which is all that reaches the driver. The fitted trees are one
column expression over the features; nothing but the page's own row is needed to judge it.

Defined results
    null url, or one without ``://``   empty host and path; no rule fits, the trees judge
    null page_id                       kept
    no labelled url                    every url without a rule is allowed
    repeated rows                      each is returned
    empty table                        empty result
    extra columns                      ignored
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.storage import Workspace

#: (pattern, verdict); a pattern is a host, with all its subdomains, and the start of a path.
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
#: Labelled rows that are learned from (about; chosen by hash). Also bounds the table of suffixes.
SAMPLE = 20_000
ROUNDS, RATE, RIDGE = 8, 0.4, 1.0
FEATURES = ["length", "depth", "digits", "entropy", "parameters", "labels", "hyphens", "suffix", "ending"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/?#``, A-Z lower-cased; and from there up to ``?#``."""
    whole, pattern = F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, pattern, 1), _UPPER, _LOWER), F.regexp_extract(whole, pattern, 2)


def matched(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, pattern).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _entropy(text: Column) -> Column:
    def share(c: Column) -> Column:
        return (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)

    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(chars, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def _bin(value: Column, most: int) -> Column:
    return F.least(F.greatest(F.coalesce(F.floor(value).cast("int"), F.lit(0)), F.lit(0)), F.lit(most))


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` (url, host, path) with binned features and the two suffixes that statistics are kept of."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return pages.withColumns(
        {
            "length": _bin(F.length(url) / 6, 20),
            "depth": _bin(_count(path, "/"), 10),
            "digits": _bin(F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)) * 20, 20),
            "entropy": _bin(_entropy(url) * 4, 24),
            "parameters": _bin(F.when(query != "", _count(query, "&") + 1).otherwise(0), 10),
            "labels": _bin(_count(host, "."), 8),
            "hyphens": _bin(_count(host, "-"), 6),
            "host_suffix": F.regexp_extract(host, r"([^.]*)$", 1),
            "path_suffix": F.regexp_extract(path, r"(\.[^./]*|/?)$", 1),
        }
    )


@dataclass
class Split:
    """A tree of depth two: the side is left if the feature's bin is at most ``cut``; leaves are numbers."""

    feature: str
    cut: int
    left: Split | float
    right: Split | float

    def column(self) -> Column:
        sides = [s.column() if isinstance(s, Split) else F.lit(float(s)) for s in (self.left, self.right)]
        return F.when(F.col(self.feature) <= self.cut, sides[0]).otherwise(sides[1])


@dataclass
class Model:
    """Log-odds of ``block`` as a sum of trees, and the suffix statistics, (kind, suffix, rate)."""

    base: float
    trees: list[Split]
    suffixes: DataFrame | None

    def margin(self) -> Column:
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + tree.column()
        return total


def _with_statistics(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``rows`` with the binned rates of their suffixes; ``suffixes`` has at most two rows per sampled row."""
    for kind in ("host_suffix", "path_suffix"):
        name = "suffix" if kind == "host_suffix" else "ending"
        rates = suffixes.where(F.col("kind") == kind).select(F.col("value").alias(kind), F.col("rate").alias(name))
        rows = rows.join(F.broadcast(rates), kind, "left").withColumn(name, F.coalesce(name, F.lit(10)))
    return rows


def _best(rows: list, features: list[str]) -> tuple[float, str, int] | None:
    """The split of most gain among histogram rows (feature, bin, g, h)."""
    found = None
    for number, name in enumerate(features):
        bins = sorted((r.bin, r.g, r.h) for r in rows if r.feature == number)
        g_all, h_all = sum(b[1] for b in bins), sum(b[2] for b in bins)
        g = h = 0.0
        for bin_, dg, dh in bins[:-1]:
            g, h = g + dg, h + dh
            gain = g * g / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all * g_all / (h_all + RIDGE)
            if gain > 1e-6 and (found is None or gain > found[0]):
                found = (gain, name, bin_)
    return found


def train(labelled: DataFrame, work: Workspace, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """Fit on about ``sample`` rows of ``labelled``: lexical features, suffixes and y (1 is block)."""
    count = labelled.count()
    if not count:
        return Model(-1.0, [], None)
    chance = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) / float(1 << 30)
    rows = work.put(labelled.where(chance < sample / count), "labelled")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("host_suffix", "path_suffix")])
    rates = rows.select("y", F.explode(kinds).alias("s")).groupBy("s.kind", "s.value").agg(((F.sum("y") + 1) / (F.count("*") + 2)).alias("rate"))
    suffixes = work.put(rates.select("kind", "value", _bin(F.col("rate") * 20, 20).alias("rate")), "suffixes")
    table = work.put(_with_statistics(rows, suffixes).groupBy("y", *FEATURES).agg(F.count("*").alias("n")).coalesce(1), "table")
    blocked, total = table.agg(F.coalesce(F.sum(F.col("y") * F.col("n")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    model = Model(math.log((blocked + 1) / (total - blocked + 1)), [], suffixes)
    cells = F.posexplode(F.array(*FEATURES)).alias("feature", "bin")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-model.margin()))
        slopes = table.withColumns({"g": (F.col("y") - p) * F.col("n"), "h": p * (1 - p) * F.col("n")})

        def histogram(node: Column, slopes: DataFrame = slopes) -> list:
            return slopes.select(node.alias("node"), "g", "h", cells).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()

        root = _best(histogram(F.lit(0)), FEATURES)
        if root is None:
            break
        _, name, cut = root
        below = histogram(F.when(F.col(name) <= cut, 0).otherwise(1))
        sides: list[Split | float] = []
        for node in (0, 1):
            mine = [r for r in below if r.node == node]
            split = _best(mine, FEATURES)
            parts = [lambda r: True] if split is None else [lambda r, s=split: r.bin <= s[2], lambda r, s=split: r.bin > s[2]]
            number = 0 if split is None else FEATURES.index(split[1])
            leaves = []
            for part in parts:
                g = sum(r.g for r in mine if r.feature == number and part(r))
                h = sum(r.h for r in mine if r.feature == number and part(r))
                leaves.append(RATE * g / (h + RIDGE))
            sides.append(leaves[0] if split is None else Split(split[1], split[2], *leaves))
        model.trees.append(Split(name, cut, *sides))
    return model


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the trees' probability of ``block``)."""
    work = Workspace(pages.sparkSession, "urls")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, says = matched(F.col("host"), F.col("path"), rules)
    rows = lexical(rows.withColumns({"rule": rule, "says": says}))
    labelled = rows.where("rule is not null").withColumn("y", (F.col("says") == "block").cast("int"))
    model = train(labelled.drop("page_id"), work)
    if model.suffixes is not None:
        rows = _with_statistics(rows, model.suffixes)
    score = 1 / (1 + F.exp(-model.margin()))
    guess = F.when(model.margin() >= 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("says", guess).alias("verdict"), F.round(score, 6).alias("score"))
