"""The prefix trie against a plain trie in Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from millrace.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, x string, conv string"


def plain_trie(rows):
    """Rows of the contract, from (conv_id, turn, role, text); turns don't tie."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0))] for c, ts in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in convs if len(paths[c]) == len(node))
        out.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, rows):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)).collect()), key=str)


def hard_rows():
    rnd = random.Random(3)
    texts = ["a b c", "d\te", "", None, "é f", "g " * 40]
    rows = [(None, 0, "user", "lost"), (7_000_000_000, 1, None, None), (41, None, "user", "first"), (41, 0, "user", "second")]
    for c in range(70):
        if c in (20, 41):
            continue  # a family without its base
        rows += [(c, 10 * t, rnd.choice(["user", "assistant", None]), rnd.choice(texts)) for t in range(rnd.choice([1, 1, 2, 3, 5, 7]))]
    rows += [(c, t, "user", "same") for c in (100, 101, 102, 103, 200, 201) for t in range(4)]
    return rows


def test_trie_equals_a_plain_one(spark):
    rows = hard_rows()
    assert trie_of(spark, rows) == plain_trie(rows)


def test_long_conversations_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    rows = hard_rows() + [(c, t, "user", f"w {t}" if t < 20 + c % 3 else f"{c}") for c in (300, 301, 305, 306, 400, 401) for t in range(31)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_repeated_rows_are_turns_and_empty_tables_have_no_nodes(spark):
    rows = [(0, 0, "user", "x")] * 5 + [(1, 0, "user", "x"), (1, 1, "user", "x")]
    got = trie_of(spark, rows)
    assert max(r[1] for r in got) == 5 and got == plain_trie(rows)
    assert trie_of(spark, []) == []
