"""The conversation trie against plain Python, and its radix tree."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lodestone.llm import conversations, radix

SCHEMA = "conv_id long, turn long, role string, text string, node string, key string, words int, depth int, ends string"


def plain(rows):
    """The contract, conversation by conversation and node by node."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        all_turns = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(all_turns) + 1):
            members[all_turns[:d]].append((c, d == len(all_turns)))
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[:-1] == n for m in members if m)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        ends = ",".join(str(c) for c in sorted(c for c, e in who if e))
        out.append((min(c for c, _ in who), len(node), parent, len(who), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def got(spark, rows, **how):
    df = spark.createDataFrame([(*r, "n", "k", 1, 2, "e") for r in rows], SCHEMA)
    return sorted(map(repr, map(tuple, conversations.trie(df, **how).collect())))


@pytest.fixture(scope="module")
def odd():
    r = random.Random(3)
    first = ("user", "the very common first turn")
    rows = []
    for c in [*range(-25, 120), 5000, 8191, 8192, 1 << 40]:
        turns = [first] if r.random() < 0.5 else []
        turns += [(r.choice(("user", "assistant", None)), r.choice(("yes", "no  no\tno", "", None, "a b c ü\x0bd\x85e"))) for _ in range(r.randrange(0, 5))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(3, None, "user", "a turn without a number"), (3, 0, "user", "a second turn 0"), (3, 0, "user", "a second turn 0"), (None, 1, "user", "of no conversation"), (None, None, None, None)]
    rows += [(77, i, "user", f"long {i % 7}") for i in range(60)] + [(97, i, "user", f"long {i % 7}") for i in range(55)]
    return rows


@pytest.mark.parametrize("tree_keys", [1, 7, 1 << 15])
def test_trie_equals_plain_python(spark, odd, tree_keys):
    assert got(spark, odd, tree_keys=tree_keys) == plain(odd)


def test_trie_of_copies_and_of_nothing(spark):
    copies = [(20 * c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    assert got(spark, copies, tree_keys=2) == plain(copies)
    assert got(spark, []) == [] == got(spark, [(None, 0, "user", "x")])


def test_trie_of_the_table(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(repr, map(tuple, conversations.query(spark, "/root/testdata/sf0.001").collect()))) == plain(rows)


def test_radix_layouts_grow_and_paths_split():
    r = random.Random(1)
    for width, symbols in ((1, 256), (2, 60), (4, 3), (16, 256)):
        keys = list({bytes(r.randrange(symbols) for _ in range(width * r.randrange(0, 6))) for _ in range(700)})
        root = radix.tree(keys)
        assert [radix.find(root, k) for k in keys] == list(range(len(keys)))
        assert radix.find(root, b"\xff" * 99) == -1
        found = radix.nodes(root)
        assert sorted(n.end for n, *_ in found if n.end >= 0) == list(range(len(keys)))
        for node, before, depth, parent in found[1:]:
            kids = len(list(node.children()))
            assert before == found[parent][2] and depth == before + len(node.path) and len(node.path) > 0
            assert kids <= node.layout and node.layout == min(x for x in radix.LAYOUTS if x >= max(kids, 4))
            assert kids != 1 or node.end >= 0  # paths are compressed
    assert {n.layout for n, *_ in radix.nodes(radix.tree(bytes([a, b]) for a in range(256) for b in range(a % 50 + 1)))} == set(radix.LAYOUTS)
