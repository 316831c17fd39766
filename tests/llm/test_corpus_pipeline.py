"""The pipeline's stages against plain versions of each on what the stage before it kept, and the registry."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from gridpulse.llm import classifier, queries, secret_scan, simhash
from test_native import plain_hits, plain_secrets
from test_python_side import PATH, plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = queries.table(spark, SF, "documents")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    model = classifier.fit_quality(docs, queries.table(spark, SF, "labels"))
    want = {i: r.text for i, r in rows.items() if classifier.score(model, [r.text])[0] >= 0.5}
    out = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert out.columns == columns and {r.doc_id: r.text for r in out.collect()} == want

    ids = sorted(want)
    label = plain_components([plain_fingerprint(want[i]) for i in ids])
    want = {i: want[i] for k, i in enumerate(ids) if label[k] == k}
    out = corpus_pipeline.STAGES[1][1](spark, out, SF)
    assert out.columns == columns and {r.doc_id: r.text for r in out.collect()} == want

    bench = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    want = {i: t for i, t in want.items() if not ((h := plain_hits(t, bench))[1] and 20 * h[1] >= h[0])}
    out = corpus_pipeline.STAGES[2][1](spark, out, SF)
    assert out.columns == columns and {r.doc_id: r.text for r in out.collect()} == want

    out = corpus_pipeline.STAGES[3][1](spark, out, SF)
    assert out.columns == columns
    got = {r.doc_id: r for r in out.collect()}
    assert got.keys() == want.keys()
    for i, t in want.items():
        assert plain_secrets(got[i].text) == [] and got[i].n_chars == (len(got[i].text) if got[i].text != t else rows[i].n_chars)
        cut = list(t)
        for s, _, e in reversed(plain_secrets(t)):
            cut[s:e] = "\0"
        assert re.sub(r"\[SECRET\]", "\0", got[i].text).replace("\0\0", "\0") == "".join(cut).replace("\0\0", "\0")

    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(PATH)
    packed = corpus_pipeline.STAGES[4][1](spark, out, SF).collect()
    for r in packed:
        ids = tokenizer.encode(got[r.doc_id].text, add_special_tokens=False).ids + [0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    assert {r.doc_id for r in packed} == got.keys()
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_an_empty_corpus(spark):
    docs = queries.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == 0


CLASHES = ["score", "predicted", "buckets", "row", "text_", "_id", "_key", "key", "root", "first", "again", "own", "own_id", "own_key", "bad", "base",
           "added", "spans", "clean", "body", "n_hex", "_spans", "_text", "_row", "words", "places", "fp", "none", "size", "_k0", "label"]


def test_stages_keep_columns_of_any_name(spark):
    docs = queries.table(spark, SF, "documents")
    plain = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        plain[name] = sorted(stage(spark, docs, SF).collect())
    wide = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in CLASHES], "named_struct('doc_id', doc_id) AS `a.b`")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert sorted(tuple(r)[:len(docs.columns)] for r in rows) == [tuple(r) for r in plain[name]], name
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES), name
    packed = corpus_pipeline.STAGES[4][1](spark, wide, SF)
    assert packed.count() == corpus_pipeline.STAGES[4][1](spark, docs, SF).count()


def test_stages_on_awkward_rows(spark):
    shape = queries.table(spark, SF, "documents").schema
    body = " ".join(f"w{i}" for i in range(300))
    rows = [(i, t, "en", None, None) for i, t in enumerate([None, "", "a b", body, body, body + " token=abcdef1", "x " * 60_000])]
    rows += [(None, body, "en", None, None), (None, None, "en", None, None), (3, body, "en", None, None), (3, "another text", "en", None, None)]
    docs = spark.createDataFrame(rows, shape)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in kept) == sorted([(0, ""), (2, "a b"), (3, "w0 "), (6, "x x"), (3, "ano")])
    for stage in (corpus_pipeline.decontamination, corpus_pipeline.secrets):
        assert stage(spark, docs, SF).count() == len(rows)
    assert corpus_pipeline.secrets(spark, docs, SF).where("text LIKE '%[SECRET]'").count() == 1
    corpus_pipeline.quality(spark, docs, SF).collect()
    assert corpus_pipeline.best_fit_packing(spark, docs, SF).where("piece = 0").count() == len(rows)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_queries_run(spark, name):
    source = queries.table(spark, SF, "pages" if name.startswith("op4") else "documents")
    assert queries.QUERIES[name](spark, SF).count() >= source.count()


def test_query_columns(spark):
    assert queries.op5_simhash(spark, SF).columns == ["doc_id", "fingerprint", "component_id"]
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in queries.op5_simhash(spark, SF).collect())
    assert simhash.RADIUS == 2 and secret_scan.KINDS[:3] == ("assign", "access", "hex")
