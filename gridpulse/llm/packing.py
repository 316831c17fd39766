"""Documents packed into sequences of fixed length by the sum-of-squares rule.

An open bin is a sequence with room left; N(g) counts open bins with gap g. A piece goes where the sum of N(g)^2
over all gaps becomes smallest: into a bin of some gap, or into a new one. Only lengths decide, so pieces are
tokenised where they lie, and only their lengths, checksums and (if wanted) ids travel.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array         # 4-byte native order, little-endian on all platforms Spark runs on
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.texts import map_texts
from gridpulse.llm.token_count import PRETOKEN, byte_symbols, merge_table
from gridpulse.session import cut_lineage

CAPACITY = 2048
GROUP = 65_536           # pieces that one task packs
SEPARATOR = 0
LONG_SPACE = re.compile(r"\s{512}")     # tiktoken's pattern engine runs out of stack on very long white space


class Ids:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizers library gives them.

    Where every id of the file's vocabulary is the rank of the merge that makes it (so the lowest id is the first
    merge), tiktoken computes the same ids on that vocabulary several times faster; otherwise, and for texts that hold
    an added token's string or very long white space, tokenizers does it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.fast = self._ranked(path)
        self.special = merge_table(path).special

    @staticmethod
    def _ranked(path: str):
        table = merge_table(path)
        if not np.array_equal(table.made, 256 + np.arange(len(table.made))) or sorted(table.byte_ids) != list(range(256)):
            return None
        byte = {c: bytes([i]) for i, c in enumerate(byte_symbols())}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {b"".join(byte[c] for c in token): i for token, i in vocab.items()
                 if i < 256 + len(table.made) and all(c in byte for c in token)}
        return tiktoken.Encoding("byte-level", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or LONG_SPACE.search(text) or self.special is not None and self.special.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole sequences, only the first may be shorter."""
    first = length - (length - 1) // capacity * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                 capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ``ids`` if wanted.

    A document is its token ids and a separator; a null or empty text is the separator alone.
    """
    end = np.array([SEPARATOR], "<u4").tobytes()
    ids = ",ids:array<int>" if with_ids else ""

    def make():
        use = ids_of(path)

        def work(texts):
            out = []
            for raw in map(use.encode, texts):
                raw += end
                row = []
                for i, (start, length) in enumerate(cuts(len(raw) // 4, capacity)):
                    part = raw[4 * start:4 * (start + length)]
                    piece = {"piece": i, "start": start, "length": length, "ids_crc32": zlib.crc32(part)}
                    if with_ids:
                        piece["ids"] = np.frombuffer(part, "<u4").astype(np.int32)
                    row.append(piece)
                out.append(row)
            return [out]
        return work

    made = map_texts(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), ["doc_id"],
                     "text", f"p array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint{ids}>>", make)
    return made.select("doc_id", F.inline("p"))


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Long pieces first; each goes where the sum of squared counts grows least.

    Moving a bin from gap g to g-s changes the sum by 2 (N(g-s) - N(g)) + 2, closing one by 1 - 2 N(s), opening one
    by 2 N(B-s) + 1; of equal changes the smallest gap wins.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        best, gap = (2 * int(n[capacity - s]) + 1 if s < capacity else 0), capacity
        if s < capacity:
            if n[s] and 1 - 2 * int(n[s]) <= best:
                best, gap = 1 - 2 * int(n[s]), s
            change = 2 * (n[1:capacity - s] - n[s + 1:capacity]) + 2
            change[n[s + 1:capacity] == 0] = np.iinfo(np.int64).max
            if len(change):
                at = int(change.argmin())
                if change[at] < best or (gap == capacity and change[at] == best):
                    best, gap = int(change[at]), s + 1 + at
        if gap == capacity:
            number, made = made, made + 1
        else:
            number = open_bins[gap].pop()
            n[gap] -= 1
        bins[i], offsets[i] = number, capacity - gap
        if gap > s:
            open_bins[gap - s].append(number)
            n[gap - s] += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset.

    Whole-sequence pieces need no partner. The others are dealt evenly, whatever their ids, into groups of about
    ``group``, and each task packs one; a group leaves about one sequence partly filled.
    """
    pieces = cut_lineage(pieces, "packing-pieces")
    total = pieces.count()
    groups = max(1, round(total / group))
    shape = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def run(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        bins, offsets = pack_lengths(table.column("length").to_numpy(), capacity)
        base = TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))
        yield from table.to_batches(max_chunksize=10_000)

    return pieces.repartition(groups).mapInArrow(run, shape)


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``).

    Repeated rows are packed as often as they stand there; an empty table gives an empty one.
    """
    return pack_pieces(token_pieces(docs, path, doc_id, text, capacity, with_ids), capacity, group)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence, from pieces with ids: sequence_id and its ids in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
