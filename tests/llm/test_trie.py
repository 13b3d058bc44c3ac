import hashlib
import random
import zlib

import pytest

from demandlens.llm import trie

COLUMNS = "conv_id long, turn int, role string, text string, k1 string, place string, up string"


@pytest.fixture(autouse=True)
def apart(spark):
    """Small partitions stay apart, as large ones do, so that conversations and lists of ends span several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def slow_nodes(sequences):
    """Nodes of the trie of {conv_id: [(role, text), ...]} by walking every prefix."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    out = []

    def sums(key):
        leaves, saved, stack = 0, 0, [key]
        while stack:
            k = stack.pop()
            leaves += k not in children
            saved += (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
            stack += children.get(k, [])
        return leaves, saved

    for key, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(sequences[c]) == len(key)))
        out.append((min(who), len(key), min(members[key[:-1]]) if key else None, len(who), len(children.get(key, [])), *sums(key), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def slow_rebuilt(sequences, family=5, cycle=9):
    out = {}
    for c, turns in sequences.items():
        h = zlib.crc32(str(c).encode()) % cycle
        out[c] = sequences.get(c - c % family, [])[:h] + turns[h:]
    return out


def ordered(rows):
    sequences = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        sequences.setdefault(c, []).append((role or "", text or ""))
    return sequences


def found(turns, conversations, **kw):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in trie.trie(turns, conversations, **kw).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], COLUMNS).repartition(3)


@pytest.mark.parametrize("band", [2, 4])
def test_nodes_match_a_walk_of_all_prefixes(spark, band):
    random.seed(band)
    rows = [(c, None if t == 0 and c % 4 == 0 else t, random.choice(["user", None]), random.choice(["a", "é", "", None, "long " * 5])) for c in range(40) if c % 10 for t in range(random.randint(1, 12))]
    turns, conversations = trie.rebuilt(trie.placed(frame(spark, rows)))
    assert found(turns, conversations, band=band) == slow_nodes(slow_rebuilt(ordered(rows)))
    assert min(r.turns for r in conversations.collect()) == 0  # some have no turn of their own after their first h, and no first of the family


def test_long_conversations_need_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 16)
    random.seed(7)
    path = [("user", random.choice("ab")) for _ in range(300)]
    sequences = {c: path[: 300 - 20 * c] + [("user", random.choice("ab")) for _ in range(10)] for c in range(1, 8)} | {8: path, 9: path}
    rows = [(c, t, *turn) for c, turns in sequences.items() for t, turn in enumerate(turns)]
    placed = trie.placed(frame(spark, rows))
    calls = []
    plain = trie.subtree_sums
    monkeypatch.setattr(trie, "subtree_sums", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert found(placed, placed.groupBy("conv_id").agg({"*": "count"}).toDF("conv_id", "turns")) == slow_nodes(sequences)
    assert len(calls) == 5  # 300 turns: bands of 4, 16, 64, 256


def test_one_node_with_most_ends(spark):
    rows = [(c, 0, "user", "hello") for c in range(3000)] + [(3000 + c, 0, "user", str(c % 7)) for c in range(70)]
    placed = trie.placed(frame(spark, rows))
    assert found(placed, placed.groupBy("conv_id").agg({"*": "count"}).toDF("conv_id", "turns")) == slow_nodes(ordered(rows))


def test_odd_rows(spark):
    rows = [(1, 1, "user", "twice"), (1, 1, "user", "twice"), (1, None, None, None), (2, None, None, ""), (2, 5, "user", "x" * 100_000), (None, 1, "user", "of no conversation")]
    placed = trie.placed(frame(spark, rows))
    assert sorted((r.conv_id, r.place, r.bytes) for r in placed.collect()) == [(1, 1, 0), (1, 2, 5), (1, 3, 5), (2, 1, 0), (2, 2, 100_000)]
    turns, conversations = trie.rebuilt(placed)
    assert found(turns, conversations) == slow_nodes(slow_rebuilt(ordered(r for r in rows if r[0])))
    turns, conversations = trie.rebuilt(trie.placed(frame(spark, rows).limit(0)))
    assert found(turns, conversations) == []
    with pytest.raises(ValueError, match="band"):
        trie.trie(turns, conversations, band=3)


def test_a_conversation_over_several_partitions(spark):
    rows = [(1, t, "user", str(t % 5)) for t in range(2000)] + [(c, t, "user", "x") for c in (0, 2) for t in range(3)]
    placed = trie.placed(frame(spark, rows))
    assert sorted((r.conv_id, r.place) for r in placed.collect()) == sorted((c, t + 1) for c, t, *_ in rows)
    digests = {r.place: (r.a, r.b) for r in placed.where("conv_id = 1").collect()}
    assert len(set(digests.values())) == 5 and all(digests[t + 1] == digests[t % 5 + 1] for t in range(2000))


def test_role_and_text_do_not_run_together(spark):
    placed = trie.placed(frame(spark, [(1, 0, "user", "ab"), (2, 0, "usera", "b"), (3, 0, "", "userab")]))
    assert placed.select("a", "b").distinct().count() == 3
