"""The prefix trie against a plain one built in memory."""

import hashlib
import random
import zlib

from gridpulse.llm import prefix_trie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_rebuilt(rows):
    """{conv_id: [(role, text), ...]} rebuilt; rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members, ends = {}, {}
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, who in members.items():
        for d in range(len(node) + 1):
            if node not in children:
                leaves[node[:d]] = leaves.get(node[:d], 0) + 1
            if node:
                saved[node[:d]] = saved.get(node[:d], 0) + (len(who) - 1) * len(node[-1][1].encode())
    return sorted((who[0], len(node), members[node[:-1]][0] if node else None, len(who), children.get(node, 0), leaves[node],
                   saved.get(node, 0), hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest())
                  for node, who in members.items())


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def trie(spark, rows, shared=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("pos", "tid", "block", "run", "at", "depth", "n", "base"):
        df = df.selectExpr("*", f"'x' AS {name}")
    turns = prefix_trie.ordered_turns(df)
    if shared:
        return prefix_trie.prefix_trie(*prefix_trie.share_heads(turns))
    return prefix_trie.prefix_trie(turns, turns.select("conv_id").distinct())


def test_the_whole_table(spark):
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.001", "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_prefix_trie(spark, "/root/testdata/sf0.001")
    assert found(got) == plain_trie(plain_rebuilt(rows))


def test_long_and_shared_conversations(spark):
    rng, rows = random.Random(3), []
    for c in rng.sample(range(200), 60):
        if rng.random() < 0.3:          # copies, and long runs of copies that part late
            n = rng.choice([8, 16, 17, 30])
            rows += [(c, t, "user", f"same {t}" + ("!" if t == n - 1 and c % 3 else "")) for t in range(n)]
        else:
            rows += [(c, rng.choice([t, 100 + t]), rng.choice(["user", None]), rng.choice(["a", "ä", "", None])) for t in range(rng.randrange(1, 40))]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rng.shuffle(rows)
    assert found(trie(spark, rows)) == plain_trie(plain_rebuilt(rows))
    plain = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        plain.setdefault(c, []).append((role or "", text or ""))
    assert found(trie(spark, rows, shared=False)) == plain_trie(plain)


def test_stretches_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    rows = [(c, t, "u", f"{t % 7}" if t < 90 else f"{c}{t}") for c in range(1, 9) for t in range(100 + c % 3)]
    rows += [(c, 0, "u", "only") for c in range(20, 31)]
    assert found(trie(spark, rows)) == plain_trie(plain_rebuilt(rows))


def test_edges(spark):
    assert found(trie(spark, [])) == []
    rows = [(None, 1, "user", "lost"), (1, None, "user", "first"), (1, 5, None, None), (6, 1, "user", ""), (5, 2, "user", "x" * 200_000),
            (7, 3, "a", "b"), (7, 3, "a", "b"), (8, 1, "a", "bc"), (9, 1, "ab", "c"), (-3, 1, "u", "minus")]
    got = found(trie(spark, rows, shared=False))
    plain = {1: [("user", "first"), ("", "")], 6: [("user", "")], 5: [("user", "x" * 200_000)], 7: [("a", "b"), ("a", "b")],
             8: [("a", "bc")], 9: [("ab", "c")], -3: [("u", "minus")]}
    assert got == plain_trie(plain)
    # Turns of equal number stand in the order of their ids, whatever the order of the rows.
    tied = [(c, 1, "u", text) for c, texts in ((10, "abc"), (15, "cab")) for text in texts]
    assert {r[3] for r in found(trie(spark, tied, shared=False))} == {2}
