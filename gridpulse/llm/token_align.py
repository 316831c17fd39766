"""Two tokenizers' tokens of the same text, aligned by merging all documents of a batch in lockstep.

Tokens are byte ranges. One vector holds, for every document of a batch, where it stands in A's and in B's tokens.
Each step advances in all documents at once whichever side ends first, or both; where both end at one offset the
tokens since the last such cut are a group, and the step emits it. Finished documents leave the vector. Links are all
A-B pairs inside a group.

What a pair of ids is worth is known only corpus-wide. Documents are therefore settled in blocks: a block hands over
each of its pairs once, with the number of its documents that hold it; totals per pair come back to the blocks that
asked. A pair stands in a block once, however common it is.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gridpulse.llm.packing import LONG_SPACE, ids_of
from gridpulse.llm.token_count import byte_symbols
from gridpulse.session import cut_lineage

PART = re.compile(r"(?<=[^\s▁])(?= )")     # where texts are parted: before a space that follows something else
PARTS, HELD = 200_000, 2_000_000        # parts remembered per worker, and their tokens, about
BATCH_CHARS = 1_000_000      # characters merged together (or one text)
BLOCK_CHARS = 8_000_000      # characters whose pairs are handed over together (or one text)
LANE = 2048                  # tokens after which a long document goes on as a further entry of the vector
WIDE = 4096                  # links of a group beyond which its ids are paired by their counts
LINKS = 2_000_000            # links held at a time


class ByteTokens:
    """A byte-level BPE vocabulary (JSON file): ids of texts, strings of special tokens being plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.fast = ids_of(path).fast
        symbol = {c: i for i, c in enumerate(byte_symbols())}
        vocab = self.slow.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(symbol[c] for c in token) if all(c in symbol for c in token) else token.encode()

    def encode(self, parts: list[str]) -> list[list[int]]:
        return [self.slow.encode(t, add_special_tokens=False).ids if self.fast is None or LONG_SPACE.search(t)
                else self.fast.encode_ordinary(t) for t in parts]

    splits = True      # its pre-tokens end where a space follows other than white space


class PieceTokens:
    """A sentencepiece vocabulary; it puts a space before a text by itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(pieces)]
        self.space = self.model.piece_to_id("▁")
        # No piece goes on behind a space that follows something else, and texts are taken as they are.
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("▁") == self.model.encode(" ") \
            and all(self.model.normalize(t) == "▁" + t.replace(" ", "▁") for t in (" a  b ", "ﬁ\u3000é\u00a0x", "\t\n \r\n"))

    def encode(self, parts: list[str]) -> list[list[int]]:
        # Each part begins with the space that the model adds by itself; to an empty text it adds none.
        return [ids if part != " " else [self.space] for part, ids in zip(parts, self.model.encode([t[1:] for t in parts], num_threads=1))]


class Side:
    """A vocabulary and its tokens' bytes."""

    def __init__(self, tokens):
        self.tokens, self.size = tokens, len(tokens.bytes)
        self.lengths = np.array([len(b) for b in tokens.bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.joined = np.frombuffer(b"".join(tokens.bytes), np.uint8)
        self.shown = [f"{i}{after}" for i in range(self.size) for after in (",", "|", ";", "")]

    def spell(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The bytes of tokens, one after another; ``sizes`` are their lengths."""
        first = np.cumsum(sizes) - sizes
        return self.joined[np.arange(sizes.sum()) + np.repeat(self.starts[ids] - first, sizes)]


class Sides(tuple):
    """A and B, and the ids of parts of texts that were met before: one number per part, behind which both lie."""

    known: dict[str, int]

    def forget(self) -> None:
        none = np.empty(0, np.int64)
        self.known, self.held = {}, [[none, none, none] for _ in self]        # ids; where a part's begin; their number

    def encode(self, spaced: list[str]) -> list[list[np.ndarray]]:
        """Per side the ids of each text (after a space). Texts go by their parts where both vocabularies allow it."""
        split = [PART.split(t) for t in spaced] if all(s.tokens.splits for s in self) else [[t] for t in spaced]
        if len(self.known) > PARTS or any(len(ids) > HELD for ids, _, _ in self.held):
            self.forget()
        new = list(set().union(*split).difference(self.known))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        parts = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        ends = np.cumsum([len(p) for p in split])
        out = []
        for side, held in zip(self, self.held):
            made = side.tokens.encode(new)
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            held[1] = np.concatenate([held[1], len(held[0]) + np.cumsum(sizes) - sizes])
            held[0] = np.concatenate([held[0], np.fromiter(chain.from_iterable(made), np.int64, sizes.sum())])
            held[2] = np.concatenate([held[2], sizes])
            many = held[2][parts]
            upto = np.cumsum(many)
            ids = held[0][np.arange(many.sum()) + np.repeat(held[1][parts] - upto + many, many)]
            out.append(np.split(ids, upto[ends[:-1] - 1]) if len(ends) else [])
        return out


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> Sides:
    made = Sides((Side(ByteTokens(path_a)), Side(PieceTokens(path_b))))
    made.forget()
    return made


def lanes(end_a: np.ndarray, end_b: np.ndarray, size: int = LANE) -> list[tuple[int, int]]:
    """Where the stretches of one document begin: (0, 0) and, about every ``size`` tokens, behind a common end."""
    out, at = [(0, 0)], size
    while at < len(end_a) - 1:
        near = end_a[at:at + 256]
        place = np.searchsorted(end_b, near)
        hit = np.flatnonzero((place < len(end_b) - 1) & (end_b[np.minimum(place, len(end_b) - 1)] == near))
        if len(hit) and at + hit[0] < len(end_a) - 1:
            out.append((at + int(hit[0]) + 1, int(place[hit[0]]) + 1))
            at += int(hit[0]) + size
        else:
            at += 256
    return out


def merge(end_a: np.ndarray, end_b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Groups as rows (first A token, A end, first B token, B end), in order.

    ``end_a`` and ``end_b`` are byte offsets where tokens end, all documents one after another; ``pa_`` and ``pb`` are
    the first tokens of each entry of the vector, ``stop`` the A end of each. Both sides of an entry end at one offset.
    """
    pa_, pb, out = pa_.copy(), pb.copy(), ([], [], [], [])
    ga, gb = pa_.copy(), pb.copy()
    while len(pa_):
        ea, eb = end_a[pa_], end_b[pb]
        on_a, on_b = ea <= eb, eb <= ea
        pa_ += on_a
        pb += on_b
        cut = np.flatnonzero(on_a & on_b)
        if len(cut):
            at, bt = pa_[cut], pb[cut]
            for column, emitted in zip(out, (ga[cut], at, gb[cut], bt)):
                column.append(emitted)
            ga[cut], gb[cut] = at, bt
            over = at == stop[cut]
            if over.any():
                stay = np.ones(len(pa_), bool)
                stay[cut[over]] = False
                pa_, pb, ga, gb, stop = pa_[stay], pb[stay], ga[stay], gb[stay], stop[stay]
    if not out[0]:
        return np.empty((0, 4), np.int64)
    columns = [np.concatenate(c) for c in out]
    order = np.argsort(columns[0], kind="stable")
    return np.stack([c[order] for c in columns], axis=1)


def tally(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(weights, first)


def linked(groups: np.ndarray, owner: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different (document, A id, B id) as ``(owner << 40) + a * width + b``, with the number of their links."""
    na, nb = groups[:, 1] - groups[:, 0], groups[:, 3] - groups[:, 2]
    links, parts = na * nb, []
    for g in np.flatnonzero(links > WIDE):
        ua, ca = np.unique(a[groups[g, 0]:groups[g, 1]], return_counts=True)
        ub, cb = np.unique(b[groups[g, 2]:groups[g, 3]], return_counts=True)
        parts.append(((owner[g] << 40) + (ua[:, None] * width + ub).ravel(), (ca[:, None] * cb).ravel()))
    narrow = np.flatnonzero(links <= WIDE)
    step = np.cumsum(links[narrow]) // LINKS
    for some in np.split(narrow, np.flatnonzero(np.diff(step)) + 1):
        many = links[some]
        g = np.repeat(some, many)
        place = np.arange(len(g)) - np.repeat(np.cumsum(many) - many, many)
        row, column = np.divmod(place, nb[g])
        keys = (owner[g] << 40) + a[groups[g, 0] + row] * width + b[groups[g, 2] + column]
        parts.append(tally(keys, np.ones(len(keys), np.int64)))
    if len(parts) == 1:
        return parts[0]
    return tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def written(groups: np.ndarray, last: np.ndarray, a: np.ndarray, b: np.ndarray, sides_: Sides) -> list[str]:
    """The tokens in the order of groups, A before B, each id with what follows it: `,` `|` `;` or, ``last``, nothing."""
    na, nb = groups[:, 1] - groups[:, 0], groups[:, 3] - groups[:, 2]
    sep_a, sep_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    sep_a[groups[:, 1] - 1] = 1
    sep_b[groups[:, 3] - 1] = np.where(last, 3, 2)
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.repeat(groups[:, 2], na)] = a * 4 + sep_a
    out[np.arange(len(b)) + np.repeat(groups[:, 1], nb)] = b * 4 + sep_b
    return list(map(max((s.shown for s in sides_), key=len).__getitem__, out.tolist()))


def spelled(side: Side, ids: list[np.ndarray], raw: list[bytes]) -> np.ndarray:
    """Whether each text's tokens give back its bytes."""
    sizes = [side.lengths[t] for t in ids]
    ok = np.array([int(n.sum()) == len(r) for n, r in zip(sizes, raw)], bool)
    some = np.flatnonzero(ok)
    if len(some):
        made = side.spell(np.concatenate([ids[k] for k in some]), np.concatenate([sizes[k] for k in some]))
        want = np.frombuffer(b"".join(raw[k] for k in some), np.uint8)
        begin = np.cumsum([0] + [len(raw[k]) for k in some[:-1]])
        ok[some] = ~np.logical_or.reduceat(made != want, begin)
    return ok


def align_batch(texts: list[str], sides_: Sides, with_tokens: bool = False) -> dict[str, list | np.ndarray]:
    """Per text n_a, n_b, n_groups, n_links, groups_sha256, and all its pairs with their numbers of links.

    Texts whose tokens do not give back a space and the text have no tokens. ``with_tokens`` adds ids and cuts.
    """
    rows, side_a, side_b = len(texts), *sides_
    out = {name: np.zeros(rows, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    out["groups_sha256"], out["tokens"] = [""] * rows, [([], [], [], [])] * rows
    full = [i for i, t in enumerate(texts) if t]
    spaced = [" " + texts[i] for i in full]
    raw = [t.encode() for t in spaced]
    encoded, same = sides_.encode(spaced), np.ones(len(full), bool)
    for side, ids in zip(sides_, encoded):
        same &= spelled(side, ids, raw)
    good = [full[k] for k in np.flatnonzero(same)]
    ids_a, ids_b = ([ids[k] for k in np.flatnonzero(same)] for ids in encoded)
    if not good:
        out["keys"], out["links"] = np.empty(0, np.int64), np.empty(0, np.int64)
        return out
    good = np.array(good)
    size_a, size_b = (np.array([len(t) for t in ids], np.int64) for ids in (ids_a, ids_b))
    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    ends_a, ends_b = ([np.cumsum(s.lengths[t]) for t in ids] for s, ids in ((side_a, ids_a), (side_b, ids_b)))
    starts = [(fa + x, fb + y) for fa, fb, ea, eb in zip(first_a.tolist(), first_b.tolist(), ends_a, ends_b)
              for x, y in (lanes(ea, eb) if len(ea) > 2 * LANE else [(0, 0)])]
    at_a, at_b = np.array(starts, np.int64).T
    a, b = np.concatenate(ids_a), np.concatenate(ids_b)
    groups = merge(np.concatenate(ends_a), np.concatenate(ends_b), at_a, at_b, np.r_[at_a[1:], len(a)])
    where = np.searchsorted(first_a, groups[:, 0], side="right") - 1          # a good text has tokens on both sides
    n_groups = np.bincount(where, minlength=len(good))
    links = (groups[:, 1] - groups[:, 0]) * (groups[:, 3] - groups[:, 2])
    group_ends = np.cumsum(n_groups)
    out["n_a"][good], out["n_b"][good], out["n_groups"][good] = size_a, size_b, n_groups
    out["n_links"][good] = np.add.reduceat(links, group_ends - n_groups)
    last = np.zeros(len(groups), bool)
    last[group_ends - 1] = True
    text = written(groups, last, a, b, sides_)
    place = first_a + first_b
    for i, s, e in zip(good.tolist(), place.tolist(), (place + size_a + size_b).tolist()):
        out["groups_sha256"][i] = hashlib.sha256("".join(text[s:e]).encode()).hexdigest()
    out["keys"], out["links"] = linked(groups, good[where], a, b, side_b.size)
    if with_tokens:
        for k, i in enumerate(good.tolist()):
            own = groups[group_ends[k] - n_groups[k]:group_ends[k]]
            out["tokens"][i] = (ids_a[k], ids_b[k], own[:, 1] - first_a[k], own[:, 3] - first_b[k])
    return out


STATS = ["n_a", "n_b", "n_groups", "n_links"]
TOKENS = "a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"


def _blocks(docs: DataFrame, path_a: str, path_b: str, with_tokens: bool) -> DataFrame:
    """Rows of documents (pair null), whose ``at`` and ``links`` name the block's pairs by rank, and rows of pairs."""
    source = docs.sparkSession
    fields = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " \
             "at array<int>, links array<long>, pair long, docs long" + (", " + TOKENS if with_tokens else "")
    shape = source.createDataFrame([], fields).schema
    wire = to_arrow_schema(shape)

    def flush(block, ids, made):
        keys = np.concatenate([m["keys"] for m in made])
        starts = np.cumsum([0] + [len(m["n_a"]) for m in made[:-1]])
        owner = np.concatenate([(m["keys"] >> 40) + s for m, s in zip(made, starts)])
        pairs, rank = np.unique(keys & ((1 << 40) - 1), return_inverse=True)
        ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(ids)))].astype(np.int32)
        columns = {"block": pa.array(np.full(len(ids), block)), "doc_id": pa.array(ids, pa.int64()),
                   **{c: pa.array(np.concatenate([m[c] for m in made])) for c in STATS},
                   "groups_sha256": pa.array([h for m in made for h in m["groups_sha256"]]),
                   "at": pa.ListArray.from_arrays(ends, rank.astype(np.int32)),
                   "links": pa.ListArray.from_arrays(ends, np.concatenate([m["links"] for m in made]))}
        if with_tokens:
            for k, name in enumerate(("a_ids", "b_ids", "a_cuts", "b_cuts")):
                columns[name] = [t[k] for m in made for t in m["tokens"]]
        held = {"block": pa.array(np.full(len(pairs), block)), "pair": pa.array(pairs),
                "docs": pa.array(np.bincount(rank, minlength=len(pairs)))}
        for part, size in ((columns, len(ids)), (held, len(pairs))):
            table = pa.Table.from_arrays([pa.nulls(size, f.type) if f.name not in part else pa.array(part[f.name], f.type)
                                          if isinstance(part[f.name], list) else part[f.name].cast(f.type) for f in wire], schema=wire)
            yield from table.to_batches(max_chunksize=20_000)

    def run(batches):
        use = sides(path_a, path_b)
        block, ids, made, chars = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            numbers, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
            sizes = batch.column(2).to_pylist()
            while at < batch.num_rows:
                end, total = at + 1, sizes[at]
                while end < batch.num_rows and total + sizes[end] <= BATCH_CHARS:
                    total += sizes[end]
                    end += 1
                made.append(align_batch(texts.slice(at, end - at).to_pylist(), use, with_tokens))
                ids += numbers[at:end]
                chars, at = chars + total, end
                if chars >= BLOCK_CHARS:
                    yield from flush(block, ids, made)
                    block, ids, made, chars = block + 1, [], [], 0
        if made:
            yield from flush(block, ids, made)

    return docs.mapInArrow(run, shape)


def _settle(docs: pa.Table, known: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents from the counts of its pairs, which stand in the order of ids."""
    order = np.argsort(known.column("pair").to_numpy(), kind="stable")
    count, best = known.column("count").to_numpy()[order], known.column("best").to_numpy()[order]
    at, links = (docs.column(c).combine_chunks() for c in ("at", "links"))
    ends = at.offsets.to_numpy()
    at, links = at.values.to_numpy()[ends[0]:ends[-1]], links.flatten().to_numpy()
    ends = ends - ends[0]
    table = docs.drop_columns(["block", "at", "links"])
    for name, worth in (("n_best", best), ("count_sum", count)):
        sums = np.r_[0, np.cumsum(links * worth[at])]
        table = table.append_column(name, pa.array(sums[ends[1:]] - sums[ends[:-1]]))
    return table


def align_tokens(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
                 with_tokens: bool = False) -> DataFrame:
    """One row per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    A is a byte-level BPE file (JSON) over a space and the text, B a sentencepiece file over the text; both must lie at
    these paths on every executor. A group is what lies between two byte offsets where tokens of both end; a link is a
    pair of its tokens. The count of a pair of ids is the number of rows of ``docs`` with such a link; ``n_best`` links
    have the highest count of their A id, ``count_sum`` adds up the counts of all links. ``with_tokens`` adds the ids
    and, per group, the tokens up to its end: a_ids, b_ids, a_cuts, b_cuts. Texts that are null, empty or that the
    tokens do not give back have zeros and ''. Repeated rows count and are returned each; an empty table gives none.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"), F.length(body).alias("size"))
    rows = cut_lineage(_blocks(source, path_a, path_b, with_tokens), "token-blocks")
    asked = rows.where("pair IS NOT NULL").select(F.col("block").alias("asker"), "pair", "docs")
    width = sides(path_a, path_b)[1].size
    counts = asked.groupBy("pair").agg(F.sum("docs").alias("count"))
    # At most one row per id of B's vocabulary in a window.
    own = Window.partitionBy(F.expr(f"pair div {width}"))
    counts = counts.select("pair", "count", (F.col("count") == F.max("count").over(own)).cast("long").alias("best"))
    known = asked.drop("docs").join(counts, "pair")
    parts = rows.where("pair IS NULL").drop("pair", "docs")
    shape = parts.drop("block", "at", "links").withColumns(
        {c: F.lit(0).cast("long") for c in ("n_best", "count_sum")}).schema
    settled = parts.groupBy("block").cogroup(known.groupBy("asker")).applyInArrow(_settle, shape)
    return settled.select("doc_id", *STATS, "n_best", "count_sum", "groups_sha256",
                          *(["a_ids", "b_ids", "a_cuts", "b_cuts"] if with_tokens else []))
