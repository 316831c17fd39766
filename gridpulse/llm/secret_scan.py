"""Secrets in texts: known forms, and strings whose characters are too evenly spread for words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.texts import let, running, stretches

ENTROPY_WINDOW = 20
# Bits per character that a window must reach, by the candidate's character class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "mixed": 3.9}

# The known forms (Java patterns). Group 2 is the match, group 3 of "assign" its value.
ASSIGN = (r"((?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))")
ACCESS = r"(AKIA[A-Z0-9]{16,})"          # a run of A-Z0-9 from its first AKIA on, 20 and more characters
HEX = r"([0-9a-f]{24,})"
CANDIDATE = r"([A-Za-z0-9+/_=-]{20,})"
# Allowed whatever their entropy: well-known placeholders, UUIDs, numbers, and words or short numbers joined by
# separators, the first one a word (``plain_words_only``).
ALLOWED = (r"(?i:example|placeholder|changeme|your[_-]|dummy|sample|redacted|xxxx)"
           r"|^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$|^[0-9]+$")
SEPARATORS, FIRST_WORD, LATER_WORD = "[-_/+=]", "^(?:[A-Za-z]?[a-z]+|[A-Z]+)$", "^(?:[A-Za-z]?[a-z]*|[A-Z]*|[0-9]{1,4})$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"       # characters of candidates
BITS, FIELDS = 5, 12     # of a count of at most 31, and counts in a 64-bit number
KINDS = ("assign", "access", "hex", "entropy")


def places(text: Column, pattern: str) -> Column:
    r"""Array of (start, end, match) of all leftmost matches, in code points.

    ``\G`` ties each search to the end of the last match, so what stands between two matches is their
    distance; a text without a match is scanned once.
    """
    whole = r"\G([\s\S]*?)" + pattern
    gaps = F.regexp_extract_all(text, F.lit(whole), F.lit(1))
    found = F.regexp_extract_all(text, F.lit(whole), F.lit(2))

    def placed(matches: Column) -> Column:
        ends = running(F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m)))
        return F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def window_entropy(candidate: Column, threshold: Column, window: int = ENTROPY_WINDOW) -> Column:
    """(low, high): from the first to the last window whose Shannon entropy reaches ``threshold``; -1 if none.

    The counts of all characters in the window go along, packed into whole numbers of ``FIELDS`` counts each. A
    character that enters or leaves changes one count, and with it one term of the sum of c * log2(c).
    """
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    numbers = -(-len(ALPHABET) // FIELDS)

    def located(ch: Column) -> Column:
        return let(F.position(ch, F.lit(ALPHABET)) - 1, lambda p: let(p % FIELDS * BITS, lambda shift: F.struct(
            F.floor(p / FIELDS).cast("int").alias("number"), shift.alias("shift"),
            F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("one"))))

    def changed(s: Column, place: Column, by: int) -> Column:
        """Counts and total after a character has come (1) or gone (-1)."""
        had = F.call_function("shiftright", F.get(s["counts"], place["number"]), place["shift"]).bitwiseAND((1 << BITS) - 1)
        return F.struct(
            F.transform(s["counts"], lambda v, k: F.when(k == place["number"], v + by * place["one"]).otherwise(v)).alias("counts"),
            let(had.cast("int"), lambda n: s["total"] + F.get(terms, n + by) - F.get(terms, n)).alias("total"))

    def measured(chars: Column, least: Column) -> Column:
        def step(s: Column, i: Column) -> Column:        # i is the 1-based place of the character that enters
            left = F.when(i > window, changed(s, F.get(chars, i - window - 1), -1)).otherwise(F.struct(s["counts"], s["total"]))
            return let(left, lambda now: let(changed(now, F.get(chars, i - 1), 1), lambda then: settled(s, i, then)))

        def settled(s: Column, i: Column, now: Column) -> Column:
            hit = (i >= window) & (F.lit(math.log2(window)) - now["total"] / window >= least - 1e-9)
            return F.struct(now["counts"].alias("counts"), now["total"].alias("total"),
                            F.when(hit & (s["low"] < 0), i - window).otherwise(s["low"]).alias("low"),
                            F.when(hit, i).otherwise(s["high"]).alias("high"))

        begin = F.struct(F.array_repeat(F.lit(0).cast("long"), numbers).cast("array<bigint>").alias("counts"), F.lit(0.0).alias("total"),
                         F.lit(-1).alias("low"), F.lit(-1).alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), begin, step, lambda s: F.struct(s["low"].alias("low"), s["high"].alias("high")))

    # As an array, so that a place is reached at once however long the candidate is.
    return let(threshold, lambda t: let(F.transform(F.split(candidate, ""), located), lambda c: measured(c, t)))


def uncovered(spans: Column, by: Column) -> Column:
    """What is left of ``spans`` (in order, apart from each other) outside all of ``by``, as (start, end) in order."""
    def event(at: str, inside: int, covered: int):
        return lambda s: F.struct(s[at].alias("at"), F.lit(inside).alias("inside"), F.lit(covered).alias("covered"))

    events = F.array_sort(F.concat(F.transform(spans, event("start", 1, 0)), F.transform(spans, event("end", -1, 0)),
                                   F.transform(by, event("start", 0, 1)), F.transform(by, event("end", 0, -1))))

    def left(e: Column, inside: Column, covered: Column) -> Column:
        parts = F.transform(e, lambda v, i: F.struct(v["at"].alias("start"), F.get(e, i + 1)["at"].alias("end"),
                                                     ((F.get(inside, i) > 0) & (F.get(covered, i) == 0)).alias("free")))
        return F.transform(F.filter(parts, lambda p: p["free"] & (p["end"] > p["start"])),
                           lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))

    return let(events, lambda e: let(running(F.transform(e, lambda v: v["inside"])), lambda inside: let(
        running(F.transform(e, lambda v: v["covered"])), lambda covered: left(e, inside, covered))))


def plain_words_only(candidate: Column) -> Column:
    """Whether the candidate is a word, or words and short numbers joined by separators."""
    return let(F.split(candidate, SEPARATORS), lambda p: F.get(p, F.lit(0)).rlike(FIRST_WORD) & F.forall(
        p, lambda w: w.rlike(LATER_WORD)))


def threshold_of(candidate: Column) -> Column:
    """The threshold of the candidate's character class; null for words and digits, which are never secrets."""
    digit, lower, upper = candidate.rlike("[0-9]"), candidate.rlike("[a-z]"), candidate.rlike("[A-Z]")
    return F.when(candidate.rlike("^[0-9a-fA-F]+$") & digit & (lower | upper), THRESHOLDS["hex"]) \
        .when(digit & (lower | upper), THRESHOLDS["alnum"]).when(lower & upper, THRESHOLDS["mixed"])


def base_spans(text: Column) -> Column:
    """(start, kind, end, match) of the known forms by start and kind."""
    def spans(kind: int, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"),
                                                     m["end"].alias("end"), m["match"].alias("match")))

    assign = F.filter(places(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 6)
    return F.array_sort(F.concat(spans(0, assign), spans(1, places(text, ACCESS)), spans(2, places(text, HEX))))


def added_spans(text: Column, base: Column, allowed: str = ALLOWED) -> Column:
    """(start, kind, end, match) of strings of high entropy outside the known forms.

    Of a candidate that is not allowed, what the known forms leave is looked at part by part: a part of a window's
    length or more, not allowed itself and not plain words, is added from its first to its last high window.
    """
    part = "array<struct<start:int,end:int,match:string>>"

    def parts(found: Column) -> Column:
        free = F.filter(uncovered(found, base), lambda s: s["end"] - s["start"] >= ENTROPY_WINDOW)
        cut = let(free, lambda spans: F.zip_with(spans, stretches(text, spans), lambda s, m: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), m.alias("match"))))
        return F.when(F.size(base) > 0, cut.cast(part)).otherwise(found.cast(part))

    candidates = F.filter(places(text, CANDIDATE), lambda m: ~m["match"].rlike(allowed))
    likely = F.filter(let(candidates, parts), lambda m: threshold_of(m["match"]).isNotNull() & ~m["match"].rlike(allowed)
                      & ~plain_words_only(m["match"]))
    measured = F.transform(likely, lambda m: F.struct(m["start"].alias("start"), m["match"].alias("match"),
                                                      window_entropy(m["match"], threshold_of(m["match"])).alias("w")))
    high = F.transform(F.filter(measured, lambda m: m["w"]["low"] >= 0), lambda m: F.struct(
        (m["start"] + m["w"]["low"]).alias("start"), F.lit(3).alias("kind"), (m["start"] + m["w"]["high"]).alias("end"),
        F.substring(m["match"], m["w"]["low"] + 1, m["w"]["high"] - m["w"]["low"]).alias("match")))
    return F.when(text.rlike(CANDIDATE), high).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>"))


def _counter(kind: int):
    return lambda n, k: n + (k == kind).cast("long")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", allowed: str = ALLOWED) -> DataFrame:
    """One row per row: doc_id, counts of the known forms, ``base`` and ``added``: arrays of (start, kind, end, match)
    in code points, end exclusive, by start and kind; and the text. Null texts count as empty; other columns are not read.
    Work follows the length of a text and its matches, also where there are many.
    """
    found = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    found = found.withColumn("base", base_spans(F.col("text")))
    found = found.withColumn("added", added_spans(F.col("text"), F.col("base"), allowed))
    kinds = F.transform("base", lambda m: m["kind"])
    counts = [F.aggregate(kinds, F.lit(0).cast("long"), _counter(k)).alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, "base", "added", "text")


def redact_secrets(docs: DataFrame, text: str = "text", size: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``, secrets in ``text`` replaced by ``mark``; ``size`` names a column that follows the text's
    length where the text changes. Columns may have any names.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    held = held.withColumn("base", base_spans(F.col("body")))
    held = held.withColumn("spans", F.concat("base", added_spans(F.col("body"), F.col("base"))))
    held = held.withColumn("clean", redact(F.col("body"), F.col("spans"), mark))
    changed, out = F.size("spans") > 0, []
    for field in docs.schema:
        value = F.col("row")[field.name]
        if field.name == text:
            value = F.when(changed, F.col("clean").cast(field.dataType)).otherwise(value)
        elif field.name == size:
            value = F.when(changed, F.length("clean").cast(field.dataType)).otherwise(value)
        out.append(value.alias(field.name))
    return held.select(*out)


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by one ``mark``."""
    def kept(s: Column, reach: Column) -> Column:
        """What lies before each span that begins a stretch, and behind the last one."""
        gaps = F.transform(s, lambda m, i: F.struct(F.coalesce(F.get(reach, i - 1), F.lit(0)).alias("start"), m["start"].alias("end")))
        tail = F.struct(F.element_at(reach, -1).alias("start"), F.length(text).alias("end"))
        return F.concat(F.filter(gaps, lambda g: g["end"] >= g["start"]), F.array(tail))

    clean = let(F.array_sort(spans), lambda s: let(running(F.transform(s, lambda m: m["end"]), F.greatest),
                                                   lambda reach: F.array_join(stretches(text, kept(s, reach)), mark)))
    return F.when(F.size(spans) > 0, clean).otherwise(text)
