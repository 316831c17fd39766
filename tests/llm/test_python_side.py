"""HTML extraction, SimHash groups, token counts, classifier, packing: against brute force and the libraries."""

import zlib
from html import unescape

import numpy as np
import pytest
import xxhash

from gridpulse.llm import classifier, html_content, packing, queries, simhash, token_count
from frames import EDGES, PROSE, documents

PATH = queries.tokenizer_path()
HARD = [*EDGES, "   three   spaces", "a  b\n \n bar\n\n  x", "<|endoftext|> hi<|endoftext|>there", "a" * 900, "\t\t tab é日本語 😀😀",
        "x\x1c y\x85 z", " lead", "trail ", "it's we'll I'd", "　 wide   nb", " " * 700 + "x", "1234567 12 3"]


# ---- html ----

PAGE = ("<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a=\"</p><p>no\";</script></head><body>"
        "<header><h2>Site name</h2></header><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- ad <p>x</p> -->"
        "<div class='ad'>Buy this now please</div>%s<footer>&copy; someone</footer></body></html>")
INSIDE = ("<h1>A  title\n here</h1><p><b>First &amp; <a href='a>b'>linked</a> words of the\tpiece<br>go on<p>Second block &lt;ok&gt;"
          "</p><div class=\"advert\">Cheap cheap things</div><ul><li>item one</li><li>item two</li></ul>"
          "<form><label>Mail</label><button>Send</button></form><p>Last words of a long enough piece of text.</p>")
WANT = "A title here\nFirst & linked words of the piece go on\nSecond block <ok>\nitem one\nitem two\nLast words of a long enough piece of text."
COMMENTS = "<section id='comments'><h3>Comments</h3><div class='comment'><p>I like this very much indeed, thanks</p></div></section>"


@pytest.mark.parametrize("body", ["<article>%s</article>", "<main>%s</main>", "<div class='post-content'>%s</div>"])
def test_article_without_furniture(body):
    assert html_content.extract(PAGE % (body % INSIDE + COMMENTS), html_content.DEFAULT_WEIGHTS) == WANT
    fitted = html_content.weights_of({k: v for k, v in html_content.label_counts(PAGE % f"<article>{INSIDE}</article>").items()})
    assert html_content.extract(PAGE % (body % INSIDE + COMMENTS), fitted) == WANT
    assert fitted["word"] > 0 and all(v < 0 for k, v in fitted.items() if k != "word" and ":" not in k)


def test_best_run_is_the_greatest_sum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        w = rng.integers(-5, 5, rng.integers(1, 15)).tolist()
        best = max([0, *(sum(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1))])
        a, b = html_content.best_run(w)
        assert sum(w[a:b]) == best
    assert html_content.best_run([-1.0, -2.0]) == (0, 0)


def test_pages(spark):
    html = [None, "", "no tags at all", "<p>unclosed <b>bold", "<script>only", PAGE % "<article><p>x</p></article>", "<" * 50, "&amp &a"]
    rows = [(i, None if i == 2 else f"u{i}", h, "t") for i, h in enumerate(html * 2)]
    found = html_content.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    got = {r.page_id: r for r in found.collect()}
    assert len(got) == 16 and got[0].text == "" and got[1].n_chars == 0 and got[2].text == "no tags at all"
    assert got[3].text == "unclosed bold" and got[4].text == "" and got[5].text == "x" and got[7].text == unescape("&amp &a")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_content.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- simhash ----

def plain_fingerprint(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x1c", "\x1c")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def test_fingerprint():
    for t in HARD:
        assert simhash.fingerprint(t or "") == plain_fingerprint(t)


def _near(seed=0, count=260):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2 ** 63, 60, dtype=np.uint64)
    out = []
    for i in range(count):
        x = int(base[i % 60 if i < 120 else 0])
        for _ in range(int(rng.integers(0, 5))):
            x ^= 1 << int(rng.integers(64))
        out.append(x)
    return out


@pytest.mark.parametrize("shard, heavy, leaf", [(4096, 10 ** 6, 512), (8, 10 ** 6, 16), (16, 20, 8)])
def test_groups_of_fingerprints(spark, monkeypatch, shard, heavy, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    fps = sorted(set(_near()))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, rep long")
    roots = {r.node: r.root for r in simhash.components(simhash.link_fingerprints(rows, shard, heavy)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == plain_components(fps)


def test_local_links_in_a_dense_ball(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    fps = np.array(sorted(set(_near(3, 300))), np.uint64)
    assert simhash.smallest_reachable(len(fps), *simhash.shard_links(fps)).tolist() == plain_components(list(map(int, fps)))


def test_chain_of_components(spark):
    links = [(i + 1, i) for i in range(300)] + [(1000, 999), (999, 998), (5000, 5000)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1000: 998, 999: 998}


def test_near_duplicates_and_first(spark):
    long = " ".join(f"w{i}" for i in range(400))
    texts = [*EDGES, long, long + " end", long, PROSE + " changed a lot of words here and there and more"]
    docs = documents(spark, texts)
    docs = docs.union(docs.where("doc_id = 10")).union(docs.where("doc_id = 5").selectExpr(
        "cast(null as long) AS doc_id", *[c for c in docs.columns if c != "doc_id"]))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts) + 2
    fps = [plain_fingerprint(t) for t in texts]
    label = plain_components(fps)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == label[r.doc_id] and r.fp % 2 ** 64 == fps[r.doc_id]
        else:
            assert r.component_id == label[5]
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert sorted(kept) == sorted(set(label))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# ---- tokens ----

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_counts_are_the_librarys(spark, tokenizer):
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in HARD]
    got = sorted(token_count.count_tokens(documents(spark, HARD), PATH).collect(), key=lambda r: r.doc_id)
    assert [r.n_tokens for r in got] == want and [r.over_limit for r in got] == [n > 1024 for n in want]
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in HARD]
    assert token_count.count_tokens(documents(spark, HARD).limit(0), PATH).count() == 0


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 200_000, "x" + "\n " * 100_000 + "y", "1234567890" * 20_000, "!?" * 50_000,
                                  "日本" * 20_000])
def test_very_long_runs(tokenizer, text):
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.ids_of(PATH).encode(text), "<u4").tolist() == want
    assert token_count.counter(PATH).counts([text]) == [len(want)]


def test_one_very_long_word(tokenizer):
    text = "".join(np.random.default_rng(0).choice(list("abcdefgh"), 50_000))
    assert token_count.Counter(PATH).counts([text]) == [len(tokenizer.encode(text, add_special_tokens=False).ids)]


# ---- packing ----

def test_packed_sequences_hold_every_document(spark, tokenizer):
    texts = [*HARD, (PROSE + ". ") * 400, "x y " * 1024]
    packed = packing.pack_documents(documents(spark, texts), PATH, group=10, with_ids=True)
    rows = packed.collect()
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    pieces, places = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and list(r.ids) == part
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, want in enumerate(ids):
        got = sorted(pieces[i])
        assert [p for p, _, _ in got] == list(range(len(got))) and sum(n for _, _, n in got) == len(want)
        assert [s for _, s, _ in got] == np.cumsum([0, *(n for _, _, n in got)])[:-1].tolist()
        assert all(n == 2048 for _, _, n in got[1:]) and (len(got) == 1) == (len(want) <= 2048)
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048
    joined = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert all(len(joined[k]) == sum(n for _, n in v) for k, v in places.items())
    assert packing.pack_documents(documents(spark, texts).limit(0), PATH).count() == 0


def test_sum_of_squares_rule():
    lengths = np.random.default_rng(2).integers(1, 65, 400)
    bins, offsets = packing.pack_lengths(lengths, 64)
    fill = {}
    for i in np.argsort(-lengths, kind="stable"):            # the rule, stated plainly
        counts = np.bincount([64 - f for f in fill.values()], minlength=65)
        counts[0] = counts[64] = 0

        def after(gap):
            c = counts.copy()
            if gap < 64:
                c[gap] -= 1
            c[gap - lengths[i]] += 1
            c[0] = 0
            return int((c.astype(int) ** 2)[:64].sum())

        options = {g: after(g) for g in {64, *(64 - f for f in fill.values() if 64 - f >= lengths[i])}}
        assert after(64 - fill.get(bins[i], 0)) == min(options.values())
        assert offsets[i] == fill.get(bins[i], 0)
        fill[bins[i]] = fill.get(bins[i], 0) + int(lengths[i])
    assert max(fill.values()) <= 64 and len(fill) <= 1.1 * lengths.sum() / 64


# ---- classifier ----

def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op9_quality_classifier(spark, sf)
    labels = queries.table(spark, sf, "labels").groupBy("doc_id").agg({"quality": "max"}).toDF("doc_id", "quality")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in found.collect())


def test_classifier_rows(spark):
    docs = documents(spark, EDGES)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, None), (5, 1, 0), (6, None, 0), (8, 0, 0), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        model = classifier.fit_quality(docs, given)
        rows = classifier.score_documents(docs, model, ["doc_id"]).collect()
        assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
        by = {r.doc_id: r.score for r in rows}
        assert by[0] == by[1] == by[2] and by[5] == by[6]
    assert by[0] == 0.5
    again = classifier.fit_quality(docs, labels)
    assert np.array_equal(again.vectors, classifier.fit_quality(docs.repartition(3), labels).vectors)


def test_gradient_step_lowers_the_loss():
    feats = [classifier.text_features(t) for t in ["good words here", "bad bad bad bad", "more good words", "bad thing bad"]]
    model = classifier.train(feats, np.array([1, 0, 1, 0]))
    scores = classifier.score(model, ["good words here", "bad bad bad bad"])
    assert scores[0] > 0.5 > scores[1]
    for text in ("good words here", "a a b é 日本", ""):
        bucket, weight = classifier.text_features(text)
        vector = (model.vectors[bucket] * weight[:, None]).sum(0)
        assert classifier.score(model, [text])[0] == pytest.approx(classifier.softmax((vector @ model.layer + model.bias)[None])[0, 1])
