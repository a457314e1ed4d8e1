"""The trie of conversations, held against one built turn by turn."""

import hashlib
import random
import zlib

import pytest

from seclake.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos string, digest string, key string, size string, b string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    """Turns of each conversation; equal turns in the order of their digests."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    return {c: [t[3:] for t in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    """Nodes of the trie as rows."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), set()).add(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    done = {}
    for node in sorted(members, key=len, reverse=True):
        below = [done[x] for x in children.get(node, [])]
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        done[node] = (own + sum(b[0] for b in below), sum(b[1] for b in below) or 1)
    rows = []
    for node, convs_here in members.items():
        ends = ",".join(str(c) for c in sorted(convs_here) if len(convs[c]) == len(node))
        rows.append((min(convs_here), len(node), min(members[node[:-1]]) if node else None, len(convs_here),
                     len(children.get(node, [])), done[node][1], done[node][0], sha(ends)))
    return sorted(rows, key=repr)


def shown(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", "d", "k", "s", "b") for r in rows], SCHEMA)


def odd_rows(seed):
    """Few different turns, so that most prefixes are shared."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 40), 10 ** 12, 10 ** 12 + 1, 2 ** 62]:
        if rng.random() < 0.1:
            continue
        for turn in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, turn, rng.choice(["user", "user", None, ""]), rng.choice(["a", "a", "a", "é", None, "", "1:a"])))
    rows += [(None, 0, "user", "nobody's"), (7, None, "user", "first"), (7, None, "user", "first"), (8, 0, "user", "x"), (8, 0, "a", "y"),
             (3, 99, "user", "long " * 30000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, span", [(4, 1024), (1, 2), (3, 1), (16, 4)])
def test_nodes(spark, block, span):
    rows = odd_rows(block)
    turns = prefix_trie.numbered_turns(table(spark, rows))
    got = prefix_trie.trie(*prefix_trie.rebuilt(turns), block=block, span=span)
    assert shown(got) == brute(rebuilt(ordered(rows)))


def test_plain_trie_and_long_copies(spark):
    """Conversations as they are, one of them long and there three times, and ids without turns."""
    rows = [(c, t, "user", f"turn {t}") for c in (5, 6, 7) for t in range(150)] + [(6, 150, "user", "more"), (8, 0, "user", "turn 0")]
    turns = prefix_trie.numbered_turns(table(spark, rows))
    ids = spark.createDataFrame([(c,) for c in (5, 6, 7, 8, 9, 10)], "conv_id bigint")
    convs = {**ordered(rows), 9: [], 10: []}
    assert shown(prefix_trie.trie(turns, ids, span=8)) == brute(convs)


def test_positions_over_many_tasks(spark):
    """One conversation holds most rows and lies in several tasks."""
    rows = [(1, t, "user", str(t)) for t in range(3000)] + [(c, t, "user", "x") for c in (0, 2, 3) for t in range(5)]
    turns = prefix_trie.numbered_turns(table(spark, rows).repartition(8))
    got = {(r.conv_id, r.pos): r.size for r in turns.collect()}
    assert got == {(c, t + 1): len(x) for c, t, _, x in rows}
    assert turns.where("conv_id = 1").selectExpr("count(distinct digest)").first()[0] == 3000


def test_ids_of_a_hot_node(spark):
    ends = spark.range(200_000).selectExpr("'k' as key", "(id * 7919) % 200000 - 5 as conv_id")
    some = spark.createDataFrame([("j", 10), ("j", 9), ("l", 3)], "key string, conv_id bigint")
    got = {r.key: r.ends_sha256 for r in prefix_trie.hashed_ids(ends.unionByName(some)).collect()}
    assert got == {"k": sha(",".join(map(str, range(-5, 199_995)))), "j": sha("9,10"), "l": sha("3")}


def test_without_conversations(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        turns = prefix_trie.numbered_turns(table(spark, rows))
        assert prefix_trie.trie(*prefix_trie.rebuilt(turns)).count() == 0
    one = prefix_trie.numbered_turns(table(spark, [(4, 1, None, None)]))  # h of 4 takes its only turn, and 0 is absent
    convs = rebuilt({4: [("", "")]})
    assert shown(prefix_trie.trie(*prefix_trie.rebuilt(one))) == brute(convs)
