"""Rules on documents, and verdicts on the hosts they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.functions.skew import spread_join
from gridpulse.llm.texts import let, space_words
from gridpulse.session import cut_lineage

SYMBOLS = "#*$%&|<>"


def _count_chars(text: Column, characters: str) -> Column:
    total = F.lit(0).cast("long")
    for c in characters:
        total = total + F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return total


def duplicate_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda v: v.rlike(r"[^\x20\x09-\x0D]")),
               lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows found more than once in the text, the first one included.

    Windows are sorted by their hash (64 bits) and place, so each repeat stands next to its like; the places of
    repeated windows are then sorted and their union measured. No step compares all windows with all.
    """
    none = F.lit(0).cast("long")

    def covered(placed: Column) -> Column:
        def like(a: Column, n: Column) -> Column:
            return F.coalesce(F.get(placed, n)["k"] == a["k"], F.lit(False))

        twice = F.filter(placed, lambda a, n: like(a, n - 1) | like(a, n + 1))
        return let(F.sort_array(F.transform(twice, lambda a: a["i"])), lambda at: F.aggregate(
            F.transform(at, lambda i, n: F.least(F.lit(3), F.coalesce(F.get(at, n + 1), i + 3) - i)),
            none, lambda total, s: total + s))

    def measured(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), none).otherwise(let(placed, covered))

    keys = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, none).otherwise(let(keys, measured))


def document_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                   least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """One row per row: id, host, the counts, and ``base_failed``. Null texts have no words and fail."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{host}`").alias("host"), body.alias("text")) \
        .withColumn("words", space_words(F.col("text")))
    found = found.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count_chars(F.col("text"), SYMBOLS).alias("n_symbols"), duplicate_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"))
    return found.withColumn("base_failed", (F.col("n_words") < least_words) | (
        100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))


def host_verdicts(rules: DataFrame, host: str = "host", failed: str = "base_failed",
                  most: float = 0.5) -> DataFrame:
    """One row per host: documents, failures, the shrunken failure rate, and whether the host is rejected.

    The beta prior comes from all hosts: its mean is the overall rate, its weight follows from how much more
    the host rates differ than counting alone explains (method of moments, at least 1 and at most 1,000,000
    documents). A host of few documents is thus judged mostly by the prior. Null hosts form no host.
    """
    # Counted per host before anything else: a host with a third of all rows sends one row per task.
    hosts = rules.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("f"))
    sums = hosts.agg(F.sum("n").alias("all_n"), F.sum("f").alias("all_f"), F.count(F.lit(1)).alias("hosts"),
                     F.sum(F.col("f") * F.col("f") / F.col("n")).alias("squares"))
    mean = F.col("all_f") / F.col("all_n")
    sums = sums.select("*", mean.alias("mean"), (mean * (1 - mean)).alias("spread"))
    between = F.col("squares") / F.col("all_n") - F.col("mean") * F.col("mean") - (
        F.col("spread") * F.col("hosts") / F.col("all_n"))
    weight = F.when(between * 1e6 <= F.col("spread"), F.lit(1e6)).otherwise(
        F.greatest(F.col("spread") / between - 1, F.lit(1.0)))
    prior = sums.select(F.struct("mean", weight.alias("weight")).alias("prior")).scalar()
    rate = (F.col("f") + F.col("prior.mean") * F.col("prior.weight")) / (F.col("n") + F.col("prior.weight"))
    return hosts.withColumn("prior", prior).select(
        host, "n", "f", rate.alias("rate"), (rate > most).alias("rejected"))


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                most: float = 0.5) -> DataFrame:
    """Document rules plus ``host_rate`` and ``kept``: neither the document nor its host is rejected.

    Documents without a host are judged by their own rules; repeated rows count as often as they stand there;
    an empty table gives an empty one.
    """
    # Texts are read once: the counts are stored for the two passes over them.
    rules = cut_lineage(document_rules(docs, doc_id, text, host), "quality-rules")
    verdicts = host_verdicts(rules, most=most).select("host", F.col("rate").alias("host_rate"), "rejected")
    joined = spread_join(rules, verdicts, ["host"])
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("rejected"), F.lit(False))).drop("rejected")
