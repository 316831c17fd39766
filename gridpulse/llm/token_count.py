"""Token counts by rank-synchronous merging on ragged numpy arrays.

All different pre-tokens of a batch that were not met before are merged together: their symbols lie in one array
with row offsets, and each round merges, in every row at once, all places of the row's lowest-ranked pair. Rows
without a mergeable pair drop out; what is left of a row is its number of tokens.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.texts import map_texts

CACHE_ENTRIES = 500_000      # pre-tokens remembered per worker
CACHE_CHARS = 64             # longer ones are not remembered
# Fixed value: the pattern of byte-level pre-tokens.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class MergeTable:
    """Vocabulary and merges of a byte-level BPE file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.byte_ids = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pretoken = regex.compile(PRETOKEN)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where a pair does not merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.made))

    def counts(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(b) for b in raw], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        row = np.repeat(np.arange(len(raw)), sizes)
        final, nothing = sizes.copy(), len(self.made)
        pair_rank = None
        while len(symbols) > 1:
            if pair_rank is None:
                pair_rank = np.full(len(symbols), nothing)
                same = row[1:] == row[:-1]
                pair_rank[:-1][same] = self.rank(symbols[:-1][same], symbols[1:][same])
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            lengths = np.diff(np.r_[starts, len(row)])
            lowest = np.minimum.reduceat(pair_rank, starts)
            done = lowest == nothing
            if done.any():
                final[row[starts[done]]] = lengths[done]
                if done.all():
                    return final
                stay = np.repeat(~done, lengths)
                symbols, row, pair_rank = symbols[stay], row[stay], pair_rank[stay]
                lowest, lengths = lowest[~done], lengths[~done]
            wanted = np.repeat(lowest, lengths)
            hit = pair_rank == wanted
            # Of overlapping places (a run of one symbol) every second one merges, from the left.
            place = np.flatnonzero(hit)
            run = np.r_[True, np.diff(place) != 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - first) % 2 == 0]
            symbols[place] = self.made[pair_rank[place]]
            stay = np.ones(len(symbols), bool)
            stay[place + 1] = False
            # Ranks change at the merged symbols and at their left neighbours only.
            touched = np.zeros(len(symbols), bool)
            touched[place] = True
            symbols, row, pair_rank, touched = symbols[stay], row[stay], pair_rank[stay], touched[stay]
            touched[:-1] |= touched[1:]
            again = np.flatnonzero(touched)
            pair_rank[again] = nothing
            again = again[again < len(symbols) - 1]
            again = again[row[again] == row[again + 1]]
            pair_rank[again] = self.rank(symbols[again], symbols[again + 1])
        final[row] = 1
        return final


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class Counter:
    """Token counts of whole texts; the counts of pre-tokens seen before are looked up."""

    def __init__(self, path: str):
        self.table, self.known = merge_table(path), {}

    def counts(self, texts: list[str]) -> list[int]:
        split, specials = [], []
        for text in texts:
            found = self.table.special.findall(text) if self.table.special else []
            parts = self.table.special.split(text) if found else [text]
            words = self.table.pretoken.findall(parts[0])
            for part in parts[1:]:
                words += self.table.pretoken.findall(part)
            split.append(words)
            specials.append(len(found))
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        new = list(set().union(*split).difference(known))
        known.update(zip(new, self.table.counts(new).tolist()))
        out = [sum(map(known.__getitem__, words)) + n for words, n in zip(split, specials)]
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                 limit: int = 1024) -> DataFrame:
    """One row per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    ``path`` is a byte-level BPE file in the JSON format, readable at that path on every executor. Its added
    tokens count as one wherever their strings stand. Null counts as empty: no bytes, no tokens.
    """
    def make():
        use = counter(path)
        return lambda texts: [[len(t.encode()) for t in texts], use.counts(texts)]

    counted = map_texts(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")),
                        ["doc_id"], "text", "n_bytes long, n_tokens long", make)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
