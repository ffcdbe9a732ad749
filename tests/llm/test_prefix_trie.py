"""The conversation trie: the structure against sets of prefixes, and the operator against a plain walk."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from inkveil.llm import prefix_trie as pt

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows, rebuild=True):
    """Nodes by a walk over (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        whole[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(cs) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted((min(cs), len(k), min(members[k[:-1]]) if k else -1, len(cs), children[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, cs in members.items())


def result(frame):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"],
                   r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in frame.collect())


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            assert pt.two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: (x & -x, x))


def test_structure_against_sets_of_prefixes():
    rng = random.Random(4)
    for _ in range(200):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 40))]
        name = lambda s: hashlib.md5(s.encode()).digest()
        trie, count = pt.ZFastTrie(), defaultdict(int)
        for i, s in enumerate(strings):
            names = b"".join(name(s[:d]) for d in range(len(s) + 1))
            trie.insert(pt._Path(0, names, np.ones(len(s), np.int64)), np.array([1]), i)
            for d in range(1, len(s) + 1):
                count[name(s[:d])] += 1
        got = {}
        for node in trie.expand():
            for d in range(node.top + 1, node.depth + 1):
                assert node.path.name(d) not in got
                got[node.path.name(d)] = int(node.weights[0])
        assert got == count
        ways = len({s[:d] for s in strings for d in range(len(s) + 1) if len({t[d:d + 1] for t in strings if t[:d] == s[:d]}) > 1})
        assert len(trie.nodes) <= ways + len(set(strings))  # compacted: only ends and branches


def conversations(rng):
    say = lambda: (rng.choice(["user", "assistant", None, "é"]), rng.choice(["", "x", "yy", None, "é ü", "z" * 50]))
    rows, start = [], [say() for _ in range(6)]
    for c in [*range(60), *range(200, 230, 3), 1_000_003]:
        turns = (start if c % 3 == 0 else []) + [say() for _ in range(rng.randrange(1, 9))]
        if c == 14:
            turns += [say() for _ in range(40)]
        rows += [(c, None if i == 0 and c % 4 == 0 else i, *t) for i, t in enumerate(turns)]
    rows += [(300 + i, 0, "user", "copy") for i in range(30)] + [(None, 1, "user", "lost"), (7, 3, "user", "twice"), (7, 3, "user", "twice")]
    rng.shuffle(rows)
    return rows


def test_rebuilt_conversations(spark, monkeypatch):
    rows = conversations(random.Random(6))
    frame = spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", depth string")
    expected = plain(rows)
    assert any(d == 0 for _, d, *_ in expected) and result(pt.trie(*pt.rebuilt(frame))) == expected
    monkeypatch.setattr(pt, "BATCH", 20)  # several tries a task
    monkeypatch.setattr(pt, "SECTION", 4)  # several strings a conversation
    assert result(pt.trie(*pt.rebuilt(frame))) == expected


def test_conversations_as_they_are(spark):
    rows = conversations(random.Random(8))
    frame = spark.createDataFrame(rows, TURNS)
    ids = frame.select("conv_id").where("conv_id IS NOT NULL").distinct()
    assert result(pt.trie(pt.prefixes_of(frame), ids)) == plain(rows, rebuild=False)


def test_no_turns(spark):
    assert pt.trie(*pt.rebuilt(spark.createDataFrame([], TURNS))).count() == 0
    turnless = [(1, 0, "user", "a")]  # the conversation that it begins with is not there
    assert result(pt.trie(*pt.rebuilt(spark.createDataFrame(turnless, TURNS)))) == plain(turnless)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(pt.op13_conversation_trie(spark, folder)) == plain(rows)
