"""Token alignment against a plain version on the libraries themselves."""

import hashlib
import random

import numpy as np
import pytest
from frames import EDGES, documents
from gridpulse.llm import queries, token_align

A, B = queries.tokenizer_path(), queries.tokenizer_path(queries.PIECE_FILE)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_groups(text, tokenizers):
    """[(A ids, B ids), ...], None without tokens."""
    if not text:
        return None
    a, b = tokenizers
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(i): i for i in shown} | {chr(256 + k): i for k, i in enumerate(i for i in range(256) if i not in shown)}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    def ends(raw):
        out, n = [], 0
        for r in raw:
            n += len(r)
            out.append(n)
        return out
    ends_a, ends_b = ends(raw_a), ends(raw_b)
    both = sorted(set(ends_a) & set(ends_b))
    groups = {e: ([], []) for e in both}
    for side, (tokens, stops) in enumerate(((ids_a, ends_a), (ids_b, ends_b))):
        for i, e in zip(tokens, stops):
            groups[min(x for x in both if x >= e) if e not in groups else e][side].append(i)
    return [groups[e] for e in both]


def plain_rows(texts, tokenizers):
    docs = [plain_groups(t, tokenizers) for t in texts]
    counts = {}
    for g in docs:
        for pair in {(x, y) for a, b in g or () for x in a for y in b}:
            counts[pair] = counts.get(pair, 0) + 1
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, g in enumerate(docs):
        links = [(x, y) for a, b in g or () for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or ())
        out.append((i, sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), len(links),
                    sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


AWKWARD = [*EDGES, "<|endoftext|> and <s> </s> <unk> <0x41> ▁ space", " " * 700 + "x" + " " * 3, "ﬁ ＡＢ é", "\n\n\tx\r\n", "日本語" * 200,
           "😀👩‍👩‍👧" * 50, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 40, "0123456789" * 90, "\x00\x01 \x7f", "word", "word"]


def test_awkward_texts(spark, tokenizers):
    df = documents(spark, AWKWARD)
    for name in ("block", "at", "links", "pair", "docs", "n_a", "count", "best", "size"):
        df = df.selectExpr("*", f"'x' AS `_{name}`" if name in df.columns else f"'x' AS {name}")
    assert found(token_align.align_tokens(df, A, B)) == plain_rows(AWKWARD, tokenizers)


def test_the_whole_table(spark, tokenizers):
    texts = {r.doc_id: r.text for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    want = plain_rows([texts[i] for i in sorted(texts)], tokenizers)
    got = found(queries.op12_token_alignment(spark, "/root/testdata/sf0.001"))
    assert [r[1:] for r in got] == [r[1:] for r in want] and [r[0] for r in got] == sorted(texts)


def test_many_blocks_and_lanes(spark, tokenizers, monkeypatch):
    rng = random.Random(5)
    words = ["alpha", "Über", "the", "of", "x1", "naïve", "日", "  ", "\n", "running", "12345"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 400))) for _ in range(60)]
    whole = plain_rows(texts, tokenizers)
    side = token_align.sides(A, B)
    for lane, wide, links in ((16, 4096, 2_000_000), (2048, 1, 10), (7, 3, 5)):
        monkeypatch.setattr(token_align, "LANE", lane)
        monkeypatch.setattr(token_align, "WIDE", wide)
        monkeypatch.setattr(token_align, "LINKS", links)
        made = token_align.align_batch(texts, side, True)
        assert [made[c].tolist() for c in token_align.STATS] == [[r[k] for r in whole] for k in (1, 2, 3, 4)]
        assert made["groups_sha256"] == [r[7] for r in whole]
        assert made["links"].sum() == sum(r[4] for r in whole)
    made = token_align.align_tokens(documents(spark, texts).repartition(7), A, B, with_tokens=True).collect()
    for r in made:
        assert (r.n_best, r.count_sum) == whole[r.doc_id][5:7]
        cuts = list(zip(np.r_[0, r.a_cuts].astype(int), np.r_[0, r.b_cuts].astype(int)))
        groups = [(r.a_ids[p:q], r.b_ids[s:t]) for (p, s), (q, t) in zip(cuts, cuts[1:])] if r.a_cuts else None
        want = plain_groups(texts[r.doc_id], tokenizers)
        assert (groups or None) == (want or None)


def test_blocks_within_a_task(tokenizers, spark):
    from pyspark.sql import functions as F
    texts = ["one text and another", "one text", "another one", ""] * 5
    before = token_align.BLOCK_CHARS
    try:
        token_align.BLOCK_CHARS, token_align.BATCH_CHARS = 30, 10
        df = documents(spark, texts).coalesce(1).where(F.col("doc_id") >= 0)
        assert found(token_align.align_tokens(df, A, B)) == plain_rows(texts, tokenizers)
    finally:
        token_align.BLOCK_CHARS, token_align.BATCH_CHARS = before, 1_000_000


def test_edges(spark, tokenizers):
    assert found(token_align.align_tokens(documents(spark, ["x"]).limit(0), A, B)) == []
    twice = documents(spark, ["same text", None]).unionByName(documents(spark, ["same text", None]))
    got = found(token_align.align_tokens(twice, A, B))
    assert len(got) == 4 and got[0] == got[1] and got[0][6] == 2 * got[0][4] and got[2] == (1, 0, 0, 0, 0, 0, 0, "")
    assert found(token_align.align_tokens(documents(spark, [None, "", None]), A, B)) == plain_rows([None, "", None], tokenizers)
    nameless = documents(spark, ["a b", "c"]).selectExpr("cast(NULL AS long) AS doc_id", "text")
    assert {r[0] for r in token_align.align_tokens(nameless, A, B).collect()} == {None}
    # One stretch without a common end inside: links are counted by ids.
    long = "a" * 30_000
    made = token_align.align_batch([long], token_align.sides(A, B))
    assert made["n_links"][0] == made["links"].sum()
