"""URL rules, and a character language-model ratio for URLs no rule decides.

Two variable-order Markov models over characters are counted from all URLs that a
rule accepts and all that a rule rejects: how often each character follows each
context of 0 to ``order - 1`` characters. A character's probability in a context is
smoothed with that in the next shorter one (Witten-Bell: the shorter context weighs
as much as the number of different characters seen after the longer one). A
character is judged in the longest context in which either model has seen it.

The score of a URL is the sum over its characters of the log-likelihood under the
accepted model minus that under the rejected one, divided by their number. The
threshold is calibrated on all decided URLs: the score at which the shares of
accepted URLs below and of rejected URLs above it are least in sum, over a
histogram of fixed width. A URL is allowed if its score reaches the threshold.

Everything is DataFrame expressions. Characters are reduced to distinct windows
(a character with its context), the models are joined to the distinct windows of all
URLs, and URLs go by number, so that only numbers and windows are sent around. Every
join is told to sort and merge (:func:`_shuffled`), so that none gathers on the driver.

A null URL, or one without ``://``, has an empty host and path and is scored like
others (null as an empty text). Without accepted or rejected URLs all scores are 0
and the threshold is 0, so that URLs no rule decides are allowed. Repeated rows get
equal results. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from basketry.llm.common import keep

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands before a URL and after it; control characters do not occur in valid URLs.
_START, _END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, with paths that start with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct<text, allow>; null if none fits."""
    found = F.lit(None).cast("struct<text: string, allow: boolean>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = F.concat(F.lit("."), host).endswith("." + rule.host) & path.startswith(rule.path)
        chosen = F.struct(F.lit(rule.text).alias("text"), F.lit(rule.allow).alias("allow"))
        found = F.when(fits, chosen).otherwise(found)
    return found


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is not to be broadcast, nor the other side.

    Spark goes by the bytes of a compressed file, even for all windows taken from the
    URLs in it, and would build tables on the driver that do not fit there.
    """
    return df.hint("merge")


def _counts(windows: DataFrame, order: int) -> DataFrame:
    """A row for each gram either model saw: its counts and those of its context.

    ``windows`` has the distinct windows of decided URLs with how often each occurs in
    accepted (``yes``) and rejected (``no``) ones. A gram is a character behind a context.
    """
    sizes = F.sequence(F.lit(1), F.lit(order))
    grams = (
        windows.select(F.explode(sizes).alias("size"), "window", "yes", "no")
        .groupBy("size", F.expr("right(window, size)").alias("gram"))
        .agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    )
    grams = keep(grams.withColumn("context", F.expr("left(gram, size - 1)")), "grams")
    contexts = grams.groupBy("size", "context").agg(
        F.sum("yes").alias("all_yes"),
        F.sum("no").alias("all_no"),
        F.count_if(F.col("yes") > 0).alias("kinds_yes"),
        F.count_if(F.col("no") > 0).alias("kinds_no"),
    )
    return grams.join(_shuffled(contexts), ["size", "context"]).drop("context")


def _ratios(windows: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(window, ratio): log ratio of the smoothed probabilities of a window's character.

    A window's grams of all sizes either model saw are gathered (``order`` at most) and
    folded from the shortest to the longest, each smoothed with the one before.
    """
    # Below the shortest context every known character is equally likely.
    base = counts.where("size = 1").agg((F.lit(1.0) / F.greatest(F.count("*"), F.lit(1))).alias("p")).scalar()
    sizes = F.sequence(F.lit(1), F.lit(order))
    gram = F.struct("size", "yes", "no", "all_yes", "all_no", "kinds_yes", "kinds_no")
    gathered = (
        windows.select("window", F.explode(sizes).alias("at"))
        .select("window", F.expr("right(window, at)").alias("gram"))
        .join(_shuffled(counts), "gram")
        .groupBy("window")
        .agg(F.array_sort(F.collect_list(gram)).alias("grams"))
    )

    def probability(kind: str) -> Column:
        def smoothed(low: Column, g: Column) -> Column:
            count, total, kinds = g[kind], g[f"all_{kind}"], g[f"kinds_{kind}"]
            return F.when(total > 0, (count + kinds * low) / (total + kinds)).otherwise(low)

        return F.aggregate("grams", F.col("base"), smoothed)

    gathered = gathered.withColumn("base", base)
    return gathered.select("window", F.ln(probability("yes") / probability("no")).alias("ratio"))


def judge(
    df: DataFrame, id_column: str, url_column: str, rules: list[Rule], order: int = 5, bins: float = 0.01
) -> DataFrame:
    """(row, host, path, rule, score, allowed): the input row as a struct and the verdict.

    ``order`` is the length of a window (a character and its context), ``bins`` the
    width of the histogram that calibrates the threshold. URLs are joined by their
    text, so ``id_column`` may repeat or be null; it is only handed through.
    """
    url = F.coalesce(F.col(url_column), F.lit(""))
    rows = df.select(F.struct("*").alias("row"), F.col(url_column).alias("given"), url.alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("given")), "path": path_of(F.col("given"))})
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    # Equal URLs have equal scores; a common one is taken apart once.
    urls = rows.groupBy("url").agg(F.first("found.allow").alias("allow"), F.count("*").alias("rows"))
    urls = keep(urls.withColumn("number", F.monotonically_increasing_id()), "urls")
    padded = F.concat(F.lit(_START * (order - 1)), "url", F.lit(_END))
    starts = F.sequence(F.lit(1), F.length("url") + 1)
    windows = urls.select(
        "number",
        "allow",
        "rows",
        F.explode(F.transform(starts, lambda i: F.substring(padded, i, order))).alias("window"),
    )
    counted = windows.groupBy("window").agg(
        F.coalesce(F.sum(F.when(F.col("allow"), F.col("rows"))), F.lit(0)).alias("yes"),
        F.coalesce(F.sum(F.when(~F.col("allow"), F.col("rows"))), F.lit(0)).alias("no"),
    )
    counted = keep(counted, "counted")
    counts = keep(_counts(counted.where("yes + no > 0"), order), "gram-counts")
    judged = _ratios(counted, counts, order)
    ratios = windows.select("number", "window").join(_shuffled(judged), "window")
    scores = ratios.groupBy("number").agg(F.sum("ratio").alias("sum"))
    score = F.coalesce("sum", F.lit(0.0)) / (F.length("url") + 1)
    scored = urls.join(_shuffled(scores), "number", "left").select("url", "allow", "rows", score.alias("score"))
    scored = keep(scored, "scores")
    limit = threshold(scored, bins)
    done = rows.join(_shuffled(scored.select("url", "score")), "url")
    allowed = F.coalesce(F.col("found.allow"), F.col("score") >= F.lit(limit))
    return done.select("row", "host", "path", F.col("found.text").alias("rule"), "score", allowed.alias("allowed"))


def threshold(scored: DataFrame, bins: float) -> float:
    """Where the error shares of decided URLs are least in sum; 0 if one kind is missing.

    The histogram has as many bins as scores differ by whole bins; log ratios per
    character stay within a few tens, so it is a few thousand rows at most.
    """
    histogram = (
        scored.where("allow is not null")
        .groupBy(F.floor(F.col("score") / bins).alias("bin"))
        .agg(
            F.sum(F.when(F.col("allow"), F.col("rows")).otherwise(0)).alias("yes"),
            F.sum(F.when(~F.col("allow"), F.col("rows")).otherwise(0)).alias("no"),
        )
        .orderBy("bin")
        .collect()
    )
    all_yes, all_no = sum(h.yes for h in histogram), sum(h.no for h in histogram)
    if not all_yes or not all_no:
        return 0.0
    below_yes = below_no = 0
    errors = []
    for h in histogram:
        errors.append((below_yes / all_yes + 1 - below_no / all_no, h.bin))
        below_yes, below_no = below_yes + h.yes, below_no + h.no
    errors.append((1.0, histogram[-1].bin + 1))
    least = min(error for error, _ in errors)
    best = [at for error, at in errors if error - least < 1e-12]
    # With a gap between the kinds, the middle of the gap.
    above = next((h.bin for h in histogram if h.bin >= best[-1]), best[-1])
    before = max((h.bin + 1 for h in histogram if h.bin < best[0]), default=best[0])
    return (before + above) / 2 * bins
