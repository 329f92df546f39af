"""The prefix trie against sets of prefixes kept in memory."""

import hashlib
import math
import random
import zlib

import pytest

from candlewick.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn int, role string, text string, node string, path string, depth int"


def conversations(rows):
    own = {}
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}


def spliced(own):
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:]  # the remainder has the sign of the id
    return out


def brute(convs):
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {n: 0 for n in members}
    for n in members:
        if n:
            kids[n[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for n, cs in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(cs) - 1) * (len(n[-1][1]) if n else 0)
    ends = lambda n: ",".join(map(str, sorted(c for c in members[n] if len(convs[c]) == len(n))))
    return sorted(
        (min(cs), len(n), min(members[n[:-1]]) if n else -1, len(cs), kids[n], leaves[n], saved[n], hashlib.sha256(ends(n).encode()).hexdigest()) for n, cs in members.items()
    )


def check(spark, rows, slices, splice):
    df = spark.createDataFrame([(*r, "n", "p", 7) for r in rows], SCHEMA)
    found = ct.trie(*(ct.spliced if splice else ct.plain)(ct.turns(df, slices)), slices).collect()
    own = conversations(rows)
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found)
    assert got == brute(spliced(own) if splice else own)
    assert sorted(r.preorder for r in found) == list(range(len(found)))
    return found


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = []
    for c in [*range(230), -7, 305, 412, 10**12]:
        for t in range(r.randrange(0, 9)):
            out.append((c, r.choice([t, t, None, 3]), r.choice(["user", "assistant", None]), r.choice(["hi", "hi", "Été?", None, "a", "hi there"])))
    out += [(50, i, "user", "same") for i in range(300)] + [(51, i, "user", "same") for i in range(290)] + [(None, 1, "user", "x")]
    return out + out[:40]


@pytest.mark.parametrize(("slices", "splice"), [(3, True), (1, False)])
def test_nodes(spark, rows, slices, splice):
    found = check(spark, rows, slices, splice)
    assert max(r.depth for r in found) > 200 and max(r.n_children for r in found) > 3


def test_subtrees_are_intervals(spark):
    rows = [(c, t, "u", x) for c, word in enumerate(["abc", "abd", "ab", "xyz", "x", "abcde"]) for t, x in enumerate(word)]
    found = check(spark, rows, 2, False)
    for r in found:
        inside = [x for x in found if r.preorder <= x.preorder <= r.subtree_end]
        assert sum(x.n_children == 0 for x in inside) == r.n_leaves and min(x.depth for x in inside) == r.depth


def test_one_turn_and_no_row(spark):
    check(spark, [(7, None, None, None)], 2, True)
    assert ct.trie(*ct.spliced(ct.turns(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_conversations_without_turns_left(spark):
    check(spark, [(c, 0, "user", "only") for c in range(1, 40)], 2, True)
