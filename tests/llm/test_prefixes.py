"""Operator 11 against a plain trie."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import prefixes

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    full = {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}
    members = defaultdict(set)
    for c, t in full.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].add(c)
    words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    out = []
    for node, who in members.items():
        inside = [n for n in members if n[: len(node)] == node]
        kids = lambda n: sum(len(x) == len(n) + 1 and x[: len(n)] == n for x in members)
        ends = ",".join(map(str, sorted(c for c in who if len(full[c]) == len(node))))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids(node), sum(kids(n) == 0 for n in inside), sum((len(members[n]) - 1) * words(n) for n in inside), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows():
    rows = []
    for c in range(60):
        if c in (20, 7):
            continue  # a donor that is absent, and a gap
        for k in range(c % 7 + 1):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", f"turn {k} of {c % 4} words" if k else "hello there"))
    rows += [(40, None, "system", "first"), (40, None, None, "second"), (41, 3, "user", None), (41, 3, "user", None), (42, 0, "a", ""), (42, 0, "b", "tie"), (42, 0, "b", "tie")]
    rows += [(100, k, "user", f"long {k // 3}") for k in range(40)] + [(101, k, "user", f"long {k // 3}") for k in range(40)] + [(102, k, "user", f"long {k // 3}") for k in range(25)]
    rows += [(200, 0, "user", "only")] + [(c, 0, "user", "x") for c in range(201, 219)]  # some are left without turns
    rows += [(None, 0, "user", "nobody's"), (5_000_000_000, 1, "user", "far away"), (140, 1, "ab", "c"), (160, 1, "a", "bc")]
    return rows


@pytest.mark.parametrize("segment", [1024, 4, 1])
def test_trie_equals_a_plain_one(spark, segment, monkeypatch):
    monkeypatch.setattr(prefixes, "IDS", 8)
    df = spark.createDataFrame([(*r, "x", "y") for r in odd_rows()], "conv_id long, turn long, role string, text string, digest string, depth string")
    rows, convs = prefixes.paths(prefixes.numbered(df))
    conv = F.col("conv_id")
    rows, convs = prefixes.rebuilt(rows, convs, conv - conv % 20, F.crc32(conv.cast("string")) % 4, most=3)
    got = prefixes.trie(rows, convs, segment=segment).select(COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(odd_rows())


def test_plain_paths_share_a_prefix(spark):
    df = spark.createDataFrame([(1, 0, "u", "a b"), (1, 1, "u", "c"), (2, 0, "u", "a b"), (2, 1, "u", "d")], "conv_id long, turn long, role string, text string")
    got = {(r.depth, r.conv_id): r for r in prefixes.trie(*prefixes.paths(prefixes.numbered(df))).collect()}
    assert len(got) == 4
    assert (got[1, 1].n_convs, got[1, 1].n_children, got[1, 1].n_leaves, got[1, 1].saved_tokens, got[1, 1].parent_conv_id) == (2, 2, 2, 2, 1)
    assert (got[0, 1].n_convs, got[0, 1].n_leaves, got[0, 1].saved_tokens, got[0, 1].parent_conv_id) == (2, 2, 2, None)


def test_an_empty_table_has_no_node(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixes.trie(*prefixes.paths(prefixes.numbered(df))).count() == 0
