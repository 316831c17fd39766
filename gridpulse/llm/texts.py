"""Words, shingles and row keys as columns, and whole texts through Python in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SET_VALUES = 100_000                           # numbers in a hash set that travels with the plan, at most
CHUNK_ROWS, CHUNK_CHARS = 2048, 4_000_000      # what one call of a text function gets at most (or one text)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only: ``lower`` does just that to a text of ASCII characters, several times faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def pieces(text: Column, separators: str) -> Column:
    """What stands between runs of separator characters (a Java character class); null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), lambda w: w != "")


def space_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return pieces(text, r"\x20\x09-\x0D")


def plain_words(text: Column) -> Column:
    """Words of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return pieces(ascii_lower(text), r"\x00-\x2F\x3A-\x60\x7B-\x7F")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often (and inside whatever lambda) it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, fold: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running folds (sums if not said) of an array of integers, as an array.

    A list grows by copying, so it grows only within stretches of about the square root of the array's size; the
    stretches' last values are folded in the same way and added on. Empty for an empty or null array.
    """
    def grown(a: Column) -> Column:
        return F.aggregate(F.slice(a, 2, F.size(a)), F.slice(a, 1, 1).cast("array<int>"), lambda done, v: F.concat(
            done, F.array(fold(F.element_at(done, -1), v))))

    def joined(a: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(a))).cast("int")
        starts = F.sequence(F.lit(1), F.size(a), step)
        return let(F.transform(starts, lambda at: grown(F.slice(a, at, step))), lambda parts: let(
            grown(F.transform(parts, lambda p: F.element_at(p, -1))), lambda ends: F.flatten(F.transform(
                parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda v: fold(F.get(ends, i - 1), v)))))))

    return F.when(F.size(values) > 0, let(values, joined)).otherwise(F.array().cast("array<int>"))


SLICE = 4096             # characters of a text that are reached at once


def stretches(text: Column, spans: Column) -> Column:
    """The texts of many (start, end) of one text, in code points: each costs its length, not the way to it."""
    def one(slices: Column, span: Column) -> Column:
        first, last = (F.call_function("div", span[c], F.lit(SLICE)).cast("int") for c in ("start", "end"))
        from_, to = span["start"] % SLICE, span["end"] % SLICE
        inside = F.substring(F.get(slices, first), from_ + 1, span["end"] - span["start"])
        over = F.concat(F.substring(F.get(slices, first), from_ + 1, F.lit(SLICE)),
                        F.array_join(F.slice(slices, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                        F.substring(F.coalesce(F.get(slices, last), F.lit("")), F.lit(1), to))
        return F.when(first == last, inside).otherwise(over)

    cut = F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{SLICE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(cut, lambda slices: F.transform(spans, lambda s: one(slices, s)))).otherwise(
        F.array().cast("array<string>"))


def set_values(table: DataFrame, column: str, most: int = SET_VALUES) -> list[int] | None:
    """The different numbers in ``column`` if there are at most ``most`` (counted as they come), else None."""
    rows = table.select(column).distinct().limit(most + 1).collect()
    return [r[0] for r in rows] if len(rows) <= most else None


def in_set(number: Column, values: list[int]) -> Column:
    """Whether ``number`` is one of ``values``: a hash set that travels with the plan."""
    return number.isin(values) if values else F.lit(False)


HOT = 1000               # a key that more than a thousandth of the rows ask for is hot: there are less than a thousand


def lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], value: str, asked: str) -> DataFrame:
    """``rows`` with ``value`` of the row of ``table`` that has their key, null where there is none.

    ``table`` has a key once, and in ``asked`` the number of ``rows`` that have it. The hot keys, less than ``HOT``
    by that count, are broadcast; rows with one of them stay where they are or are spread over all tasks.
    """
    least = table.agg(F.sum(asked).alias("all")).scalar() / HOT
    sized = table.select(*on, value, (F.col(asked) > least).alias("_hot"))
    hot = sized.where("_hot").select(*on, F.col(value).alias("_known"), F.lit(True).alias("_met"))
    marked = rows.join(F.broadcast(hot), list(on), "left")
    spread = F.when(F.col("_met"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(HOT)) + 1).otherwise(0)
    cold = sized.where("NOT _hot").select(*on, value, F.lit(0).cast("long").alias("_salt"))
    return marked.withColumn("_salt", spread.cast("long")).join(cold, [*on, "_salt"], "left").withColumn(
        value, F.coalesce("_known", value)).drop("_known", "_met", "_salt")


def text_key(doc_id: Column, text: Column) -> Column:
    """What tells rows apart: rows with equal keys have the same id and text, and so the same result."""
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(text).alias("hash"), F.length(text).alias("size"))


def map_texts(docs: DataFrame, keep: Sequence[str], text: str, fields: str,
              make: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """``keep`` columns plus ``fields`` (a DDL list) computed from each whole text; null counts as empty.

    ``make()`` runs once in each task and returns a function from a list of texts to one list (or array)
    per field. It is handed slices of an Arrow batch, so Python holds a few megabytes of text at once.
    """
    kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    source = docs.select(*kept, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"),
                         F.length(F.col(f"`{text}`")).alias("_size"))
    spark = docs.sparkSession
    added = spark.createDataFrame([], fields).schema
    shape = source.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]).schema
    for field in added:
        shape = shape.add(field)
    wire, last = to_arrow_schema(shape), len(keep)

    def run(batches):
        work = make()
        for batch in batches:
            sizes, at = batch.column(last + 1).to_pylist(), 0
            while at < batch.num_rows:
                end, total = at + 1, sizes[at] or 0
                while end < batch.num_rows and end - at < CHUNK_ROWS and total + (sizes[end] or 0) <= CHUNK_CHARS:
                    total += sizes[end] or 0
                    end += 1
                part = batch.slice(at, end - at)
                made = work(part.column(last).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i).cast(wire[i].type) for i in range(last)),
                     *(pa.array(v, wire[last + i].type) for i, v in enumerate(made))], schema=wire)
                at = end

    return source.mapInArrow(run, shape)
