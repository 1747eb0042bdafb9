"""The prefix trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, len(whole) == d))
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[c] for c in children[p])
    least = {p: min(c for c, _ in m) for p, m in members.items()}
    return sorted(
        (least[p], len(p), least[p[:-1]] if p else -1, len(m), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in m if e)).encode()).hexdigest())
        for p, m in members.items()
    )


def found(nodes):
    return sorted(
        (r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
         r.saved_tokens, r.ends_sha256) for r in nodes.collect()
    )


def talks(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 37 == 20:
            continue  # some first ones of a family are absent
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["hi", "hi there", "a  b\tc", ""])))
    return rows


@pytest.mark.parametrize("shards", [1, 7, None])
def test_trie(spark, shards):
    rows = talks(300)
    assert found(prefixes.prefix_trie(spark.createDataFrame(rows, SCHEMA), shards=shards)) == plain(rows)


def test_one_conversation_everywhere(spark, monkeypatch):
    """Copies fill several shards; their ends go on from one to the next."""
    rows = [(c, t, "user", f"same turn {t}") for c in range(900) for t in range(4)]
    rows += [(c, t, "user", f"own {c} {t}") for c in range(1000, 1080) for t in range(3)]
    nodes = prefixes.prefix_trie(spark.createDataFrame(rows, SCHEMA), shards=9)
    assert found(nodes) == plain(rows)


def test_long_and_odd(spark):
    rows = [(5, t, "user", f"t {t // 3}") for t in range(300)] + [(6, t, "user", f"t {t // 3}") for t in range(200)]
    rows += [(20, t, "user", f"t {t // 3}") for t in range(130)]
    rows += [(7, None, None, None), (7, None, "b", "x"), (7, 1, "a", "y"), (7, 1, "a", "y"), (7, 0, "z", "w"), (None, 1, "a", "b")]
    rows += [(-3, 0, "user", "below"), (2**62, 1, "user", "above"), (41, 0, "", ""), (42, 0, None, "")]
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("ids", F.lit(1))
    assert found(prefixes.prefix_trie(docs, shards=5)) == plain(rows)


def test_empty(spark):
    assert prefixes.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
