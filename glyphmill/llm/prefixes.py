"""The prefix trie of conversations, from padded matrices of turn ids in sorted shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

# Conversations are dealt in groups of so many, whose first turns all come from the first of them.
FAMILY, TURNS = 20, 4
# Columns of a matrix; longer conversations go on in further matrices, of those rows alone.
WIDTH = 64
# Turns of a shard, at least; a task holds some sixty bytes for each.
SHARD_TURNS = 500_000
# Members that end at a node of several shards are handed on so many at a time.
ENDS_AT_ONCE = 8192

_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as 128 bits for role and text and the
    number of words in the text. Null turns come first; equal turns stand in the order of role
    and the text's MD5; null roles and texts are empty. Rows without a conv_id are no conversation's.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    cell = F.struct(
        F.col("turn").cast("bigint").alias("turn"), role.alias("role"), F.md5(F.encode(text, "UTF-8")).alias("order"),
        F.xxhash64(F.lit(1), role, text).alias("hi"), F.xxhash64(F.lit(2), role, text).alias("lo"),
        F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"),
    )
    cells = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), cell.alias("c"))
    return cells.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("c")).select(
        "conv_id", F.transform("c", lambda c: F.struct(c["hi"], c["lo"], c["words"])).alias("turns")
    )


def rebuilt(conversations: DataFrame, family: int = FAMILY, turns: int = TURNS) -> DataFrame:
    """(conv_id, ids, words) of every conversation, its first h turns taken from another one.

    h is crc32 of the decimal conv_id, modulo `turns`; the other one is the first of its family (conv_id
    less its remainder), and where it is absent it gives no turns. `ids` has two numbers for each turn.
    """
    own = C.staged(turn_lists(conversations), "turns")
    heads = own.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("head"), F.slice("turns", 1, turns - 1).alias("first")
    )
    rows = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % turns).cast("int"))
    rows = rows.join(heads, F.col("conv_id") - F.col("conv_id") % family == F.col("head"), "left")
    none = F.array().cast(dict(own.dtypes)["turns"])
    first = F.slice(F.coalesce("first", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    whole = rows.select("conv_id", F.concat(first, rest).alias("turns"))
    return whole.select(
        "conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["hi"], t["lo"]))).alias("ids"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    )


# Inside tasks: one shard of the sorted conversations.


class _Rows:
    """The conversations of a shard: `head` is the place of a row's first turn, `size` their number."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, words = (table.column(c).combine_chunks() for c in ("ids", "words"))
        flat = ids.flatten().to_numpy()
        self.hi, self.lo = flat[0::2], flat[1::2]
        self.words = words.flatten().to_numpy().astype(np.int64)
        self.size = ids.value_lengths().to_numpy().astype(np.int64) // 2
        self.head = np.cumsum(self.size) - self.size
        self.conv = table.column("conv_id").to_numpy()

    def matrix(self, rows: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(there, hi, lo) of the rows' turns from `depth` on, padded with zeros."""
        columns = np.arange(depth, depth + width)[None, :]
        there = columns < self.size[rows][:, None]
        at = (self.head[rows][:, None] + columns)[there]
        hi, lo = np.zeros((2, len(rows), width), np.int64)
        hi[there], lo[there] = self.hi[at], self.lo[at]
        return there, hi, lo

    def sort(self) -> None:
        """Put the rows in the order of their turns, then of conv_id.

        Matrix after matrix parts the rows into finer classes. A row that has ended comes before those
        of its class that go on, as a padded cell comes before any turn.
        """
        n = len(self.conv)
        klass, depth, longest = np.zeros(n, np.int64), 0, int(self.size.max(initial=0))
        while depth < longest:
            on = np.flatnonzero(self.size > depth)
            width = min(WIDTH, longest - depth)
            there, hi, lo = self.matrix(on, depth, width)
            keys = [k[:, j] for j in reversed(range(width)) for k in (lo, hi, there)]
            order = np.lexsort([*keys, klass[on]])
            cells = [k[order] for k in (there, hi, lo)]
            new = np.zeros(len(on), bool)
            new[1:] = np.diff(klass[on][order]) != 0
            for k in cells:
                new[1:] |= (k[1:] != k[:-1]).any(axis=1)
            within = np.full(n, -1, np.int64)
            within[on[order]] = np.cumsum(new)
            order = np.lexsort([within, klass])
            new = np.zeros(n, bool)
            new[1:] = (np.diff(klass[order]) != 0) | (np.diff(within[order]) != 0)
            klass[order] = np.cumsum(new)
            depth += width
        order = np.lexsort([self.conv, klass])
        self.size, self.head, self.conv = self.size[order], self.head[order], self.conv[order]

    def shared(self) -> np.ndarray:
        """How many first turns each row has in common with the row before it; -1 for the first."""
        n = len(self.conv)
        common = np.zeros(n, np.int64)
        depth, on = 0, np.arange(1, n)
        while len(on):
            on = on[np.minimum(self.size[on], self.size[on - 1]) > depth]
            if not len(on):
                break
            width = int(min(WIDTH, self.size[on].max() - depth))
            changed = np.zeros((len(on), width + 1), bool)
            changed[:, width] = True
            for mine, other in zip(self.matrix(on, depth, width), self.matrix(on - 1, depth, width)):
                changed[:, :width] |= mine != other
            # A change holds for all columns to its right; the rest is common.
            np.logical_or.accumulate(changed, axis=1, out=changed)
            same = (~changed).sum(axis=1)
            same = np.minimum(same, np.minimum(self.size[on], self.size[on - 1]) - depth)
            common[on] += same
            on = on[same == width]
            depth += width
        if n:
            common[0] = -1
        return common

    def path(self, row: int) -> list[bytes]:
        """A key for each node on a row's path, from the root on."""
        so_far = hashlib.md5()
        keys = [so_far.digest()]
        turns = slice(self.head[row], self.head[row] + self.size[row])
        for hi, lo in zip(self.hi[turns].tolist(), self.lo[turns].tolist()):
            so_far.update(hi.to_bytes(8, "big", signed=True) + lo.to_bytes(8, "big", signed=True))
            keys.append(so_far.digest())
        return keys


# What a shard gives: whole nodes, parts of nodes that other shards may share, and members that end at those.
WHOLE, PART, ENDS = 0, 1, 2
_OUT = pa.schema([
    ("kind", pa.int32()), ("key", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("parent", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()), ("ends", pa.string()),
    ("above", pa.list_(pa.binary())),
])
_SCHEMA = """kind int, key binary, depth bigint, conv_id bigint, parent_conv_id bigint, parent binary, n_convs bigint,
    n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, ends string, above array<binary>"""


def _levels(rows: _Rows) -> list[dict[str, np.ndarray]]:
    """The nodes of each depth, in order: first row, members, smallest member, parent, words of the last
    text, members that end there, and whether the shard's first or last row is a member."""
    common, levels = rows.shared(), []
    on, node = np.arange(len(rows.conv)), np.zeros(len(rows.conv), np.int64)
    depth, last = 0, len(rows.conv) - 1
    while len(on):
        begins = common[on] < depth
        begins[0] = True
        starts = np.flatnonzero(begins)
        first = on[starts]
        level = {
            "first": first, "parent": node[first], "n": np.diff(np.append(starts, len(on))),
            "least": np.minimum.reduceat(rows.conv[on], starts),
            "words": rows.words[rows.head[first] + depth - 1] if depth else np.zeros(1, np.int64),
            "ended": np.add.reduceat((rows.size[on] == depth).astype(np.int64), starts),
            "open": np.zeros(len(starts), bool),
        }
        level["open"][0] |= on[0] == 0
        level["open"][-1] |= on[-1] == last
        node[on] = np.cumsum(begins) - 1
        levels.append(level)
        depth += 1
        on = on[rows.size[on] >= depth]
    # Sums go up from the deepest nodes. A node that other shards may share counts nothing itself.
    for depth in reversed(range(len(levels))):
        level, below = levels[depth], levels[depth + 1] if depth + 1 < len(levels) else None
        count = len(level["n"])
        level["children"] = np.zeros(count, np.int64) if below is None else np.bincount(below["parent"][~below["open"]], minlength=count)
        leaf = ~level["open"] & (level["children"] == 0)
        level["leaves"] = leaf + _summed(below, "leaves", count)
        level["saved"] = np.where(level["open"], 0, (level["n"] - 1) * level["words"]) + _summed(below, "saved", count)
    return levels


def _summed(below: dict[str, np.ndarray] | None, name: str, count: int) -> np.ndarray:
    """Whole-number sums of a level's values by parent. Children stand in their parents' order."""
    out = np.zeros(count, np.int64)
    if below is not None:
        np.add.at(out, below["parent"], below[name])
    return out


def _decimal(numbers: np.ndarray) -> str:
    return ",".join(map(str, numbers.tolist()))


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = _Rows(held)
    del held
    rows.sort()
    levels = _levels(rows)
    last = len(rows.conv) - 1
    paths = {0: rows.path(0), last: rows.path(last)}
    above = None
    for depth, level in enumerate(levels):
        keys: list[bytes | None] = [None] * len(level["n"])
        for j in np.flatnonzero(level["open"]).tolist():
            row = 0 if level["first"][j] == 0 else last
            keys[j] = paths[row][depth]
            lists = paths[row][:depth]
            yield _one(PART, keys[j], depth, level, j, lists)
            ends = rows.conv[level["first"][j]:level["first"][j] + level["ended"][j]]
            for k in range(0, len(ends), ENDS_AT_ONCE):
                yield pa.RecordBatch.from_pylist(
                    [{"kind": ENDS, "key": keys[j], "conv_id": int(ends[k]), "ends": _decimal(ends[k:k + ENDS_AT_ONCE])}], _OUT)
        whole = np.flatnonzero(~level["open"])
        if len(whole):
            digests = [
                hashlib.sha256(_decimal(rows.conv[a:a + k]).encode()).hexdigest() if k else _EMPTY
                for a, k in zip(level["first"][whole].tolist(), level["ended"][whole].tolist())
            ]
            parents = level["parent"][whole]
            least, keyed = levels[depth - 1]["least"][parents], levels[depth - 1]["open"][parents]
            columns = {
                "kind": np.full(len(whole), WHOLE, np.int32), "depth": np.full(len(whole), depth), "conv_id": level["least"][whole],
                "parent_conv_id": pa.array(least, mask=keyed), "parent": pa.array([above[p] for p in parents.tolist()], pa.binary()),
                "n_convs": level["n"][whole], "n_children": level["children"][whole], "n_leaves": level["leaves"][whole],
                "saved_tokens": level["saved"][whole], "ends": digests,
            }
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(whole), f.type) for f in _OUT], schema=_OUT)
        above = keys


def _one(kind: int, key: bytes, depth: int, level: dict[str, np.ndarray], j: int, above: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{
        "kind": kind, "key": key, "depth": depth, "conv_id": int(level["least"][j]), "parent": above[-1] if above else None,
        "n_convs": int(level["n"][j]), "n_children": int(level["children"][j]), "n_leaves": int(level["leaves"][j]),
        "saved_tokens": int(level["saved"][j]), "words": int(level["words"][j]), "above": above,
    }], _OUT)


def _ends_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) of rows that stand in order: texts of one key are digested one after another."""
    key, digest = None, None
    for batch in batches:
        for found, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if found != key:
                if key is not None:
                    yield pa.RecordBatch.from_pylist([{"key": key, "ends": digest.hexdigest()}], _ENDS)
                key, digest = found, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends": digest.hexdigest()}], _ENDS)


_ENDS = pa.schema([("key", pa.binary()), ("ends", pa.string())])


def _recombined(parts: DataFrame) -> DataFrame:
    """The nodes that shards share, from their parts: at most two paths for each shard."""
    total = lambda c: F.sum(c).alias(c)  # noqa: E731
    nodes = C.staged(parts.where(F.col("kind") == PART).groupBy("key").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.any_value("parent").alias("parent"),
        total("n_convs"), total("n_children"), total("n_leaves"), total("saved_tokens"),
        F.max("words").alias("words"), F.any_value("above").alias("above"),
    ), "shared")
    shared = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    nodes = nodes.join(shared, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = nodes.select(
        F.explode(F.concat("above", F.array("key"))).alias("key"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    ).groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    blocks = parts.where(F.col("kind") == ENDS).select("key", "conv_id", "ends")
    ends = blocks.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(
        _ends_digests, "key binary, ends string")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(own, "key").join(ends, "key", "left").join(parents, "parent", "left").select(
        "key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def trie(sequences: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the prefix trie of (conv_id, ids, words), a written table with unique conv_ids.

    Rows are sorted by their turns, then conv_id, into shards of equal size, so one first turn, or one
    conversation that a third of all rows repeat, spreads over many. A shard gives its nodes whole
    but for those on the paths of its first and last row: these may go on in other shards, and their
    parts are added up afterwards. A conversation's ids (20 bytes a turn) are held by one task.
    """
    if shards is None:
        size = sequences.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
        shards = max(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_TURNS))
    parts = C.staged(sequences.repartitionByRange(shards, "ids", "conv_id").mapInArrow(_shard, _SCHEMA), "nodes")
    shared = C.staged(_recombined(parts), "paths")
    out = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = parts.where(F.col("kind") == WHOLE).withColumnRenamed("ends", "ends_sha256")
    # The root is the parent of many: such parents are met by broadcast.
    tops = shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("met"))
    met = C.spread_join(whole.where(F.col("parent").isNotNull()).drop("parent_conv_id"), tops, ["parent"], "met")
    return shared.select(*out).unionByName(whole.where(F.col("parent").isNull()).select(*out)).unionByName(met.select(*out))


def prefix_trie(conversations: DataFrame, family: int = FAMILY, turns: int = TURNS, shards: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    A node is a distinct sequence of first turns (role and text) of the rebuilt conversations, from the
    textless root at depth 0. `conv_id` is its smallest member, `n_convs` the number of members; `n_leaves`
    counts the childless nodes of its subtree, itself included; `saved_tokens` adds up (n_convs - 1)
    times the words of the last text over its subtree. `ends_sha256` digests the conv_ids, ascending, of
    members that have no further turn. Turns and texts count as told in `turn_lists` and `rebuilt`;
    repeated rows are further turns. A table without conversations gives no nodes; only the four
    columns conv_id, turn, role and text are read.
    """
    return trie(C.staged(rebuilt(conversations, family, turns), "rebuilt"), shards)


# The same in SQL. Prefixes are told apart by a hash of their turns; crc32 is spelled out.
ORACLE = rf"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE c & 1 WHEN 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT conv_id, turns, xor(list_reduce(
      list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {TURNS} AS h
  FROM own, crc_table
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1 : a.h], a.turns[a.h + 1 :]) AS turns
  FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % {FAMILY}
), prefixes AS (
  SELECT conv_id, d, md5(to_json(turns[1 : d])::VARCHAR) AS key,
         CASE WHEN d > 0 THEN md5(to_json(turns[1 : d - 1])::VARCHAR) END AS parent, len(turns) = d AS ends,
         CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].t, '[^ 	-]+')) ELSE 0 END AS words
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY key, d
), kids AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above AS (
  SELECT DISTINCT u.key, v.key AS top FROM prefixes u JOIN prefixes v ON u.conv_id = v.conv_id AND v.d <= u.d
), sums AS (
  SELECT top AS key, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
  FROM above JOIN nodes USING (key) LEFT JOIN kids k USING (key) GROUP BY top
)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved_tokens,
       v.ends_sha256
FROM nodes v JOIN sums USING (key) LEFT JOIN kids k USING (key) LEFT JOIN nodes p ON p.key = v.parent
"""
