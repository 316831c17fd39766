import re
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridpulse.llm import pii
from frames import EDGES, documents

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, pattern in RAW.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(
                    int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(RAW).index(kind), m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab1234 .@-+()_%é\n", max_size=60) | st.lists(st.sampled_from(
    ["a@b.co", "x.y@m-1.org", "@", ".", " ", "1.2.3.4", "4111 1111 1111 1111", "5500005555555559", "+1 (578) 555-6437",
     "256.1.1.1", "é", "-", "7", "300", "a@b", "+49"]), max_size=12).map("".join))
def test_base_is_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


@pytest.mark.parametrize("text, kind, hidden", [
    ("mail john.smith [at] example [dot] com now", "email", "john.smith [at] example [dot] com"),
    ("john dot smith at example dot com", "email", "john dot smith at example dot com"),
    ("see jоhn@exаmple.cоm.", "email", "jоhn@exаmple.cоm"),
    ("j​ohn@example.com", "email", "j​ohn@example.com"),
    ("kfs.71(at)mail0.example.com", "email", "kfs.71(at)mail0.example.com"),
    ("kfs.71&#64;mail0.example.com", "email", "kfs.71&#64;mail0.example.com"),
    ("call plus one five five five, one two three four five six seven now", "phone",
     "plus one five five five, one two three four five six seven"),
    ("four one one one one one one one one one one one one one one one", "card",
     "four one one one one one one one one one one one one one one one"),
    ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ("4O12 8888 8888 l88l", "card", "4O12 8888 8888 l88l"),
    ("at 192[.]168[.]1[.]1 or", "ip", "192[.]168[.]1[.]1"),
    ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
])
def test_disguises_map_back_to_the_source(text, kind, hidden):
    _, added = pii.find_pii(text)
    assert (kind, hidden) in [(pii.KINDS[k], text[s:e]) for s, k, e in added]


@pytest.mark.parametrize("text", [
    "look at end. The of at on. one two at dot", "meet at noon.Then go", "they were one of three at two",
    "a@b.co and +1 (578) 555-6437 one thing", "4111 1111 1111 1111 two of them", "Preis (at) 5", ""])
def test_clean_texts_gain_nothing(text):
    assert pii.find_pii(text)[1] == []


def test_long_runs_are_linear():
    for run in ("1" * 300_000, "a" * 300_000, "a." * 150_000, "1." * 150_000, "@" * 100_000, "+1" * 100_000):
        pii.find_pii(run)


def test_rows(spark):
    texts = [*EDGES, "x a@b.co y", "x john [at] ex [dot] org y"]
    rows = sorted(pii.scan_pii(documents(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    assert rows[0].n_email == 0 and rows[0].base_sha256 == sha256(b"").hexdigest() and rows[0].spans == ""
    assert rows[-2].n_email == 1 and rows[-2].spans == "email:2:8"
    assert rows[-1].n_email == 0 and rows[-1].spans == "email:2:24" and len(rows[-1].added) == 1
    assert pii.scan_pii(documents(spark, texts).limit(0)).count() == 0
