"""Benchmark passages in training documents: windows of test words looked up in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.texts import in_set, plain_words, set_values, text_key

WINDOW = 13
ANCHOR = 4              # words of a window that the hash set looks at
BROADCAST_BYTES = 64 << 20      # windows of the benchmark are broadcast up to this measured size


def windows(words: Column, length: Column | int) -> Column:
    """Texts of all runs of ``length`` words, by place; none if there are fewer words."""
    length = F.lit(length) if isinstance(length, int) else length
    places = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - length + 1))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, length), " "))


def first_words(words: Column, at: Column, length: int) -> Column:
    """64-bit hash of the first words (``ANCHOR`` at most) of the window of ``length`` words at a 0-based place."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(min(length, ANCHOR))])


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """``gram``, ``length`` and ``items``: each different window once, with the items it stands in.

    An item with fewer words than ``window`` is one window; one without words has none.
    """
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"),
                             plain_words(F.col(f"`{text}`")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("length", F.least(F.lit(window), F.size("words")))
    grams = items.select("item", "length", F.explode(windows(F.col("words"), F.col("length"))).alias("gram"))
    # No word holds a space, so a window's text and its list of words are one and the same.
    return grams.groupBy("gram", "length").agg(F.collect_set("item").alias("items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       least_share: int = 20) -> DataFrame:
    """One row per row of ``docs``: key of the row, words, words hit, hit stretches, items, verdict.

    Every window of every document is looked up in a hash set of the benchmark's windows, by its first words; what is
    found there is verified by an equi join on the windows' texts. Only hits, and one row per document, are shuffled. The windows
    are broadcast where their measured size allows and joined by shuffle where not, with the same rows; so is the
    hash set left out, and every window verified, where the benchmark has more than ``SET_VALUES`` windows.
    Contaminated: a word is hit, and ``least_share`` times the words hit reach the words of the document.
    Null texts have no words; repeated rows give repeated rows; null item ids are no items.
    """
    grams = benchmark_windows(benchmark, item_id, item_text, window)
    size = grams.groupBy("length").agg(F.sum(F.octet_length("gram") + 64 + 16 * F.size("items")).alias("bytes")).collect()
    lengths = sorted(r["length"] for r in size)              # at most ``window`` numbers
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    base = base.select(text_key(F.col("doc_id"), F.col("text")).alias("key"), plain_words(F.col("text")).alias("words"))
    places = []
    for n in lengths:
        starts = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n))
        known = set_values(grams.where(F.col("length") == n).select(first_words(F.split("gram", " "), F.lit(0), n).alias("hash")), "hash")
        seen = starts if known is None else F.filter(starts, lambda i: in_set(first_words(F.col("words"), i, n), known))
        places.append(F.coalesce(F.transform(seen, lambda i: F.struct((i + 1).alias("at"), F.lit(n).alias("length"))),
                                 F.array().cast("array<struct<at:int,length:int>>")))
    found = base.select("key", "words", F.concat(F.array().cast("array<struct<at:int,length:int>>"), *places).alias("places"))
    texts = F.transform("places", lambda p: F.struct(p["at"].alias("at"), F.array_join(F.slice(
        "words", p["at"], p["length"]), " ").alias("gram")))
    row = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("gram")))
    probes = found.select("key", F.size("words").cast("long").alias("n_words"),
                          F.explode_outer(F.concat(row, texts)).alias("p")).select("key", "n_words", "p.at", "p.gram")
    # The empty window stands for the document itself, so that documents without a hit come through the join.
    known = grams.unionByName(benchmark.sparkSession.sql(
        "SELECT '' AS gram, 0 AS length, cast(array() AS array<string>) AS items"))
    if sum(r["bytes"] for r in size) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    hits = probes.join(known, "gram")
    found = hits.groupBy("key", "n_words").agg(
        F.count_if(F.col("at") == 0).alias("rows"),
        F.array_sort(F.collect_set(F.when(F.col("at") > 0, F.struct(
            F.col("at").alias("start"), (F.col("at") + F.col("length")).alias("end"))))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    measured = F.aggregate("runs", start, lambda s, r: F.struct(
        (s["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], s["reach"]))).alias("n"),
        F.greatest(s["reach"], r["end"]).alias("reach")))
    found = found.withColumn("n_hit", measured["n"])
    contaminated = (F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words"))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))
    return found.select("key", "n_words", "n_hit", "runs", "items", contaminated.alias("contaminated"), "rows") \
        .withColumn("_copy", copies).drop("_copy", "rows")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      **settings) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged; columns may have any names."""
    found = find_contamination(docs, benchmark, doc_id, text, **settings)
    bad = found.where("contaminated").select(F.col("key").alias("bad")).distinct()
    key = text_key(F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("own"))
    return held.join(bad, F.col("own").eqNullSafe(F.col("bad")), "left_anti").select("row.*")
