"""Near-duplicate texts: shingle sets whose parity sketches agree in a part, then verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C

SHINGLE = 5
# Two sets are linked from this per cent of their union on.
PERCENT = 80
# Parts of a sketch per element of the largest set of a band, and bits per part: so many that two
# elements of a part hardly ever share a bit. Only set bits are ever held.
PARTS, PART_BITS = 0.6, 40
# Sets below this size have a part for every element.
SMALL = 32
# Least 64-bit words of the sketch that candidates are held against; it grows with the set.
SKETCH = 16
# Pivots at a key in the first round; each later round has the square of the one before.
PIVOTS = 8
# So many rows are sent to all tasks to pick texts; more meet the texts by a shuffle.
PICKED = 500_000
# Pairs of sets that a task holds against each other.
PAIRS = 2_000
# A shingle in this share of a task's documents is common: parts without one are taken first.
COMMON = 0.004


class Sets:
    """Distinct shingles of a column of texts as sorted 64-bit hashes, row by row."""

    def __init__(self, texts: pa.Array, shingle: int):
        words = C.Words(texts, lower=True)
        n = len(texts)
        short = (words.sizes > 0) & (words.sizes < shingle)
        starts = np.flatnonzero(
            (words.places + shingle <= words.sizes[words.rows]) | (short[words.rows] & (words.places == 0))
        )
        rows = words.rows[starts]
        hashes = C.Windows(words.hashes()).at(starts, np.minimum(words.sizes[rows], shingle))
        # A short text's one shingle is no longer text's.
        hashes = np.where(short[rows], C.mix(hashes ^ words.sizes[rows].astype(np.uint64)), hashes)
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        self.rows, self.items = rows[first], hashes[first]
        self.sizes = np.bincount(self.rows, minlength=n)
        self.first = np.cumsum(self.sizes) - self.sizes

    def sums(self, salt: int) -> np.ndarray:
        """Per row, the sum of its items' hashes: equal sets have equal sums."""
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(self.items ^ np.uint64(salt)))])
        return total[self.first + self.sizes] - total[self.first]


def _allowed(a, b, percent: int):
    """The most elements by which linked sets of these sizes can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def keys_of(sets: Sets, chosen: np.ndarray, common: np.ndarray, percent: int, parts: float):
    """(rows, keys, thin): sketch parts to join on, of the rows in `chosen`.

    Every element sets one bit of a long sketch, by exclusive or, so the sketches of two sets differ in no
    more bits than the sets do in elements. The sketch is cut into parts, more than linked sets of the band
    can differ in, so some part agrees. Of a set's parts that are not empty only the first d + 1 are given,
    d being the most that a linked set can differ: before the first agreeing part, each one that is
    empty in one set only, or differs, is one of the d. Any order of parts will do if all sets
    use it; parts with a common element come last, as they agree for no good reason. A
    set with fewer than d + 1 such parts is `thin`: then there must be more parts.
    """
    out_rows, out_keys, thin = [], [], 0
    sizes = sets.sizes
    band = np.frexp(np.maximum(sizes, 1).astype(float))[1]  # sizes from 2^(band-1) up to 2^band - 1
    # A larger linked set may be in the next band.
    above = np.frexp(np.maximum(sizes * 100 // percent, 1).astype(float))[1]
    limit = _allowed(sizes, sizes * 100 // percent, percent)
    for step in (0, 1):
        use = chosen & (sizes > 0) & ((band + step) <= above)
        member = use[sets.rows]
        rows, items = sets.rows[member], sets.items[member]
        if not len(rows):
            continue
        level = (band + step)[rows].astype(np.uint64)
        top = np.left_shift(np.uint64(1), level)
        count = np.maximum((top * parts).astype(np.uint64), np.uint64(1))
        whole = top <= np.uint64(SMALL)
        part = np.where(whole, items, (C.mix(items) >> np.uint64(20)) % count)
        bit = np.where(whole, np.uint64(0), C.mix(items ^ np.uint64(77)) & np.uint64((1 << PART_BITS) - 1))
        value = C.mix(C.mix(part) ^ bit ^ (level << np.uint64(PART_BITS)))
        if len(common):
            place = np.minimum(np.searchsorted(common, items), len(common) - 1)
            often = common[place] == items
        else:
            often = np.zeros(len(items), bool)
        order = np.lexsort((part, rows))
        rows, part, value, often, level = rows[order], part[order], value[order], often[order], level[order]
        starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (part[1:] != part[:-1])]))
        value = np.bitwise_xor.reduceat(value, starts)
        often = np.logical_or.reduceat(often, starts)
        rows, part, level = rows[starts], part[starts], level[starts]
        full = value != 0
        rows, part, level, value, often = rows[full], part[full], level[full], value[full], often[full]
        # The order of keys is that of the parts, and has to follow from place and bits of a part alone.
        key = C.mix(value ^ C.mix(part + (level << np.uint64(56)))) >> np.uint64(2)
        key |= often.astype(np.uint64) << np.uint64(62)
        order = np.lexsort((key, rows))
        rows, key = rows[order], key[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        given = np.bincount(rows, minlength=len(sizes))
        thin += int((use & (given <= limit)).sum())
        take = rank <= limit[rows]
        out_rows.append(rows[take])
        out_keys.append(key[take])
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), thin
    return np.concatenate(out_rows), np.concatenate(out_keys), thin


def sketches(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """(words, sizes): per row a sketch of two to four bits per element, a power of two of words. Each
    element flips one bit, so sketches differ in no more bits than sets in elements. A sketch whose
    halves are joined by exclusive or is the sketch of half the size."""
    sizes = np.left_shift(1, np.frexp(np.maximum(sets.sizes, 1).astype(float))[1]) * 2 // 64
    sizes = np.maximum(sizes, SKETCH)
    first = np.cumsum(sizes) - sizes
    bits = C.mix(sets.items ^ np.uint64(5)) & (64 * sizes[sets.rows] - 1).astype(np.uint64)
    words = np.zeros(int(sizes.sum()), np.uint64)
    np.bitwise_xor.at(
        words, first[sets.rows] + (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63)))
    return words, sizes


def _mapped(texts: DataFrame, work, schema: str, shingle: int) -> DataFrame:
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches, "text"):
            yield from work(batch, Sets(batch.column("text"), shingle))

    return texts.mapInArrow(mapped, schema)


def _class(sets: Sets) -> np.ndarray:
    return C.mix(sets.sums(1) ^ C.mix(sets.sums(2) + sets.sizes.astype(np.uint64)))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), C.signed(values))


def _summaries(texts: DataFrame, shingle: int) -> DataFrame:
    """Per row its set's size, class and sketch; and, with a null row, the common shingles of each chunk."""
    def work(batch, sets):
        classes = _class(sets)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), pa.array(sets.sizes, pa.int64()), C.signed(classes), _lists(*sketches(sets))],
            names=["_row", "n", "class", "sketch"],
        )
        _, alone = np.unique(classes, return_index=True)
        items = sets.items[np.isin(sets.rows, alone)]
        items, counts = np.unique(items, return_counts=True)
        often = counts >= max(4, COMMON * len(alone))
        size = int(often.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(size, pa.int64()), pa.array(counts[often], pa.int64()), C.signed(items[often]),
             pa.nulls(size, pa.list_(pa.int64()))], names=["_row", "n", "class", "sketch"],
        )

    return _mapped(texts, work, "_row bigint, n bigint, class bigint, sketch array<bigint>", shingle)


def _memberships(texts: DataFrame, shingle: int, common: np.ndarray, percent: int, parts: float) -> DataFrame:
    """(key, class, n): the sketch parts of every set; a null key tells of n thin sets."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task, to pass over copies; emptied before it gets large
        for batch in C.chunks(batches, "text"):
            sets = Sets(batch.column("text"), shingle)
            classes = _class(sets)
            _, alone = np.unique(classes, return_index=True)
            chosen = np.zeros(batch.num_rows, bool)
            chosen[[i for i in alone if int(classes[i]) not in seen]] = True
            if len(seen) > 500_000:
                seen.clear()
            seen.update(map(int, classes[alone]))
            rows, keys, thin = keys_of(sets, chosen, common, percent, parts)
            arrays = [C.signed(keys), C.signed(classes[rows]), pa.array(sets.sizes[rows], pa.int32())]
            if thin:
                tail = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([thin], pa.int32())]
                arrays = [pa.concat_arrays(x) for x in zip(arrays, tail)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "class", "n"])

    return texts.mapInArrow(mapped, "key bigint, class bigint, n int")


def _set_table(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(class, items) of the classes in `wanted` (_row, class)."""
    def work(batch, sets):
        yield pa.RecordBatch.from_arrays(
            [batch.column("class"), _lists(sets.items, sets.sizes)], names=["class", "items"])

    chosen = texts.join(F.broadcast(wanted) if wanted.count() <= PICKED else wanted, "_row")
    return C.staged(_mapped(chosen, work, "class bigint, items array<bigint>", shingle), "items")


def _half(sketch: Column) -> Column:
    """The sketch at half its size."""
    half = (F.size(sketch) / 2).cast("int")
    return F.zip_with(
        F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _folded(sketch: Column, to: Column) -> Column:
    """The sketch at half its size, if it is larger than `to`."""
    return F.when(F.size(sketch) > F.size(to), _half(sketch)).otherwise(sketch)


def _close(a: Column, b: Column, na: Column, nb: Column, percent: int) -> Column:
    """Whether sketches and sizes leave room for a link. Sizes that do differ by less than half, so
    their sketches by one fold at most."""
    apart = F.aggregate(
        F.zip_with(_folded(a, b), _folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0),
        lambda s, x: s + x)
    return F.when(100 * F.least(na, nb) >= percent * F.greatest(na, nb),
                  apart * (100 + percent) <= (na + nb) * (100 - percent)).otherwise(False)


def _near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of the class pairs (a, b), those whose sketches leave room for a link."""
    left, right = (
        reps.select(*[F.col(c).alias(f"{c}_{side}") for c in ("n", "sketch")], F.col("class").alias(side))
        for side in ("a", "b")
    )
    return C.staged(C.few(pairs.join(left, "a").join(right, "b").where(_close(
        F.col("sketch_a"), F.col("sketch_b"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b"),
        pairs.count(), PAIRS), "near")


def _verified(near: DataFrame, texts: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of the class pairs (a, b), those whose sets are linked. Only their sets are made again."""
    n = near.count()
    wanted = near.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = C.staged(C.few(wanted.join(reps, "class").select("_row", "class"), 2 * n), "wanted")
    sets = _set_table(texts, wanted, shingle)
    left = sets.select(F.col("class").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("class").alias("b"), F.col("items").alias("ib"))
    shared = F.size(F.array_intersect("ia", "ib"))
    return C.staged(C.few(near.join(left, "a").join(right, "b").select(
        "a", "b", shared.alias("s"), (F.size("ia") + F.size("ib")).alias("t")
    ).where(100 * F.col("s") >= percent * (F.col("t") - F.col("s"))).select("a", "b"), n, PAIRS), "links")


def _grown(met: DataFrame, star: DataFrame, roots: DataFrame, texts: DataFrame, reps: DataFrame,
           shingle: int, percent: int) -> DataFrame:
    """(node, root) after all pairs of classes that meet at a key are linked, told apart, or in one group.

    `met` (key, class, least) has the keys, where each class was held against the least, pairs `star`. Each
    round takes pivots at every key whose classes left are in several groups, holds the classes of other
    groups against them, and lets go the pivots. A group's classes are never held against each other, so
    a group that grows together soon needs few pairs, however large. Rounds square their pivots, so even
    a key with all classes is done after a handful.
    """
    left, rows = met.where("class <> least").select("key", "class"), met.count()
    short, pivots_a_key = None, PIVOTS
    while True:
        now = left.join(roots, left["class"] == roots["node"], "left").select(
            "key", "class", F.coalesce("root", "class").alias("root"))
        several = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        now = C.staged(C.few(now.join(several.select("key"), "key", "left_semi"), rows), "open")
        rows = now.count()
        if not rows:
            return roots
        if short is None:
            # Keys that close later have no pair left, so these are all the classes of later rounds.
            short = C.staged(C.few(now.select("class").distinct().join(reps, "class").select(
                "class", "_row", "n", "sketch", _half(_half(F.col("sketch"))).alias("short")), rows), "short")
        # The least class of each turn; a class has its turn at all its keys.
        turn = F.pmod(F.xxhash64("class", F.lit(pivots_a_key)), F.lit(pivots_a_key))
        chosen = C.staged(C.few(now.groupBy("key", turn.alias("turn")).agg(
            F.min(F.struct("class", "root")).alias("p")).select("key", "p.class", "p.root"), rows), "pivots")
        a, b = (
            side.join(short, "class").select(*[
                F.col(c).alias(f"{c}_{name}") for c in ("key", "class", "n", "root", "short")])
            for side, name in ((chosen, "a"), (now, "b"))
        )
        # A quarter of a sketch moves with every key, the whole one only for pairs that it leaves.
        across = a.join(b, (F.col("key_a") == F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & _close(
            F.col("short_a"), F.col("short_b"), F.col("n_a"), F.col("n_b"), percent))
        pairs = across.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"))
        pairs = C.staged(pairs.distinct().join(star, ["a", "b"], "left_anti"), "pairs")
        left = now.join(chosen.select("key", "class"), ["key", "class"], "left_anti").select("key", "class")
        pivots_a_key **= 2
        near = _near(pairs, short, percent)
        if not near.isEmpty():
            more = _verified(near, texts, short, shingle, percent)
            if not more.isEmpty():
                roots = C.components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
           percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row.

    Words are runs without ASCII white space, A-Z in lower case; a set is the distinct runs of `shingle`
    words, or all words of a shorter text. Sets are linked when 100 * shared >= `percent` * union;
    `component_id` is the smallest key that links reach, the row's own included. Texts without a
    word, null ones too, have an empty set and no links. Rows with equal sets, repeated rows too,
    are linked as equals. A null key is larger than all others and never a component's, unless alone.

    Equal sets become one class first. Classes meet where a part of their sketches agrees. Of all that meet at
    a key, each is held against the smallest; where that leaves several groups at a key, rounds of pivots
    follow (`_grown`) until no two classes of different groups are left unseen. Pairs within a group
    need no look.
    """
    kind = dict(docs.dtypes)[key]
    rows = C.identified(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text")), "_key", "_row", "text")
    texts = rows.select("_row", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    summaries = C.staged(_summaries(texts, shingle), "sets")
    # At most the mean set size / COMMON shingles can be in so large a share of the documents.
    often = summaries.where("_row is null").groupBy("class").agg(F.sum("n").alias("n"))
    documents = summaries.where("_row is not null").count()
    often = often.where(F.col("n") >= max(4, COMMON * documents)).select("class").toPandas()["class"]
    common = np.sort(often.to_numpy(np.int64).view(np.uint64))
    members = summaries.where("_row is not null").select("_row", "n", "class")
    reps = summaries.where("n > 0 and _row is not null").groupBy("class").agg(
        F.min_by(F.struct("_row", "n", "sketch"), "_row").alias("r")).select("class", "r.*")
    reps = C.staged(reps, "classes")

    parts = PARTS
    while True:
        found = _memberships(texts, shingle, common, percent, parts)
        at_key = Window.partitionBy("key")
        met = found.select(
            "*", F.min("class").over(at_key).alias("least"), F.max("class").over(at_key).alias("most")
        ).where("key is null or least <> most").drop("most")
        met = C.staged(met, "met")
        if not met.where("key is null").limit(1).count():
            break
        parts *= 2
    met = met.where("key is not null")
    star = met.where("class <> least").select(F.col("least").alias("a"), F.col("class").alias("b")).distinct()
    star = C.staged(C.few(star, met.count()), "star")
    links = _verified(_near(star, reps, percent), texts, reps, shingle, percent)
    roots = _grown(met, star, C.components(links), texts, reps, shingle, percent)

    # The smallest key of a class, then of its group, then back to every row.
    keyed = members.join(rows.select("_row", "_key"), "_row")
    of_class = keyed.where("n > 0").groupBy("class").agg(F.min("_key").alias("least"))
    rooted = of_class.join(roots, of_class["class"] == roots["node"], "left").select(
        "class", "least", F.coalesce("root", "class").alias("root"))
    of_group = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("class", "root").join(of_group, "root").select("class", "component_id")
    return keyed.join(named, "class", "left").select(
        F.col("_key").cast(kind).alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_key")).alias("component_id"),
    )


def first_of_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that have the smallest key of their group, all columns as they are. Where keys
    repeat or are null, rows are numbered as they are stored and the first of a group stays."""
    row = C.free_name(docs, "_row")
    rows = C.identified(docs, key, row, *[c for c in docs.columns if c != key])
    stay = groups(rows, row, text).where(F.col("component_id") == F.col(row)).select(row)
    return rows.join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


# The same rows in SQL, from the pairs that share a shingle.
ORACLE = rf"""
WITH RECURSIVE dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'),
         '{C.SPACE}'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[s + 1 : s + {SHINGLE}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {SHINGLE}, 0) + 1)) AS s FROM dw WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS s FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * s >= {PERCENT} * (p.n + q.n - s)
), reach AS (
  SELECT doc_id, doc_id AS other FROM dw
  UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT dw.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM dw LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
