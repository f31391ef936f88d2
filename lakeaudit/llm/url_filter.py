"""URL filter: rules where they fit, else a ratio of character language models.

The models are variable-order Markov models of the URLs that the rules accept and of those that they
reject: trigrams that fall back to bigrams and single symbols by Witten-Bell weights. A URL that no
rule fits is judged by its log-likelihood difference per symbol against a threshold between the two
training classes' means, weighted by their spreads.

Symbols come from an alphabet of fixed size (other characters share one symbol), so the model has at
most len(ALPHABET)**3 rows however many pages there are; that bound is why it may be broadcast.

Null URLs, and URLs without ``://``, have empty host and path and fit no rule. A URL without symbols
(null or empty), and every URL if one class has no training URL, is allowed. Repeated pages count as
often as they occur. Only page_id and url are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols of the models; "0" stands for every digit, "~" for every other character, "^" for the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#%:+^~"
MODEL_ROWS = len(ALPHABET) ** 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return host & F.col("path").startswith(self.path)


def with_host_and_path(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    return pages.withColumns(
        {
            "host": F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER),
            "path": F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1),
        }
    )


def with_rule(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Columns rule and rule_verdict of the longest rule that fits; of equally long ones the first by name."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        rule, verdict = F.when(r.fits(), r.name).otherwise(rule), F.when(r.fits(), r.verdict).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def grams(urls: DataFrame) -> DataFrame:
    """One row for each symbol of each row's url: the symbol with the two before it."""
    plain = F.translate(F.regexp_replace("url", "[0-9]", "0"), UPPER, LOWER)
    symbols = F.concat(F.lit("^^"), F.regexp_replace(plain, r"[^a-z0/.\-_?=&#%:+]", "~"))
    # The symbols are made below the explode, once a URL.
    mapped = urls.where(F.length("url") > 0).withColumn("symbols", symbols)
    each = mapped.select("*", F.explode(F.sequence(F.lit(1), F.length("url"))).alias("at"))
    return each.withColumn("gram", F.col("symbols").substr(F.col("at"), F.lit(3))).drop("symbols", "at")


def model(training: DataFrame) -> DataFrame:
    """gram, llr: log-likelihood under the accepted URLs minus that under the rejected, for each known gram.

    training: grams of pages with rule_verdict (null: the gram is listed, but not counted).
    Sums, not windows, so only per-gram rows (MODEL_ROWS at most) leave the first aggregation.
    """
    counted = training.groupBy("gram").agg(*[F.count(F.when(F.col("rule_verdict") == v, 1)).alias(v) for v in ("allow", "block")])
    counted = counted.withColumns({"c": F.substring("gram", 3, 1), "bc": F.substring("gram", 2, 2), "b": F.substring("gram", 2, 1), "ab": F.substring("gram", 1, 2)})

    def by(frame: DataFrame, *keys: str) -> DataFrame:
        return frame.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in ("allow", "block")])

    def contexts(frame: DataFrame, key: str, n: str, kinds: str) -> DataFrame:
        sums = [x for v in ("allow", "block") for x in (F.sum(v).alias(f"{n}_{v}"), F.count(F.when(F.col(v) > 0, 1)).alias(f"{kinds}_{v}"))]
        return frame.groupBy(key).agg(*sums)

    bigrams = by(counted, "bc", "b", "c")
    singles = by(bigrams, "c")
    total = singles.agg(*[F.sum(v).alias(f"all_{v}") for v in ("allow", "block")])
    joined = (
        counted.join(contexts(counted, "ab", "n2", "t2"), "ab")
        .join(bigrams.select("bc", *[F.col(v).alias(f"bc_{v}") for v in ("allow", "block")]), "bc")
        .join(contexts(bigrams, "b", "n1", "t1"), "b")
        .join(singles.select("c", *[F.col(v).alias(f"c_{v}") for v in ("allow", "block")]), "c")
        .crossJoin(F.broadcast(total))
    )

    def log_likelihood(v: str) -> Column:
        p0 = (F.col(f"c_{v}") + 1.0) / (F.col(f"all_{v}") + float(len(ALPHABET)))
        p1 = F.when(F.col(f"n1_{v}") > 0, (F.col(f"bc_{v}") + F.col(f"t1_{v}") * p0) / (F.col(f"n1_{v}") + F.col(f"t1_{v}"))).otherwise(p0)
        p2 = F.when(F.col(f"n2_{v}") > 0, (F.col(v) + F.col(f"t2_{v}") * p1) / (F.col(f"n2_{v}") + F.col(f"t2_{v}"))).otherwise(p1)
        return F.log(p2)

    return joined.select("gram", (log_likelihood("allow") - log_likelihood("block")).alias("llr"))


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, url, host, path, rule, llr (per symbol; null without symbols), verdict."""
    pages = with_rule(with_host_and_path(pages.select("page_id", "url")), rules)
    each = grams(pages.select("url", "rule_verdict"))
    # Each page of a URL has as many grams as the URL has characters.
    pages_of = (F.count(F.lit(1)) / F.length("url")).alias("n")
    scored = each.join(F.broadcast(model(each)), "gram").groupBy("url").agg(F.avg("llr").alias("llr"), pages_of, F.first("rule_verdict").alias("v"))

    def moment(v: str) -> tuple[Column, Column]:
        mine = F.col("v") == v
        mean = F.sum(F.when(mine, F.col("n") * F.col("llr"))) / F.sum(F.when(mine, F.col("n")))
        square = F.sum(F.when(mine, F.col("n") * F.col("llr") * F.col("llr"))) / F.sum(F.when(mine, F.col("n")))
        return mean, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) + 1e-6

    (good, good_spread), (bad, bad_spread) = moment("allow"), moment("block")
    threshold = scored.agg(((good * bad_spread + bad * good_spread) / (good_spread + bad_spread)).alias("threshold"))
    judged = pages.join(scored.select("url", "llr"), "url", "left").crossJoin(F.broadcast(threshold))
    rejected = F.coalesce(F.col("llr") < F.col("threshold"), F.lit(False))
    verdict = F.coalesce("rule_verdict", F.when(rejected, "block").otherwise("allow"))
    return judged.select("page_id", "url", "host", "path", "rule", "llr", verdict.alias("verdict"))
