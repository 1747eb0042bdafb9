"""Operators that hold texts against each other, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from glyphmill.llm import common as C, fertility, parity_join, queries, repeats, suffix_tree, winnowing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def table(spark, texts, schema="doc_id bigint, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def contamination(texts, items, window):
    found = []
    grams = {}
    for item, text in items:
        w = bench_words(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1) if w else ():
            grams.setdefault(tuple(w[i:i + size]), set()).add("" if item is None else str(item))
    spans = {len(g) for g in grams}
    for text in texts:
        w = bench_words(text)
        hit, ids = set(), set()
        for size in spans:
            for i in range(len(w) - size + 1):
                g = tuple(w[i:i + size])
                if g in grams:
                    hit.update(range(i, i + size))
                    ids |= grams[g]
        found.append((len(w), len(hit), sorted(ids)))
    return found


@pytest.mark.parametrize("window", [3, 5, 13])
def test_contamination_equals_all_windows(spark, window):
    rng = random.Random(window)
    vocab = ["a", "B", "c", "é", "d1"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 30)))) for i in range(12)]
    items += [(None, "only Here-this"), (3, "x y"), (20, None), (21, "!!"), (22, "q")]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choices(vocab + ["zz", "q"], k=rng.randint(0, 12)))]
        if rng.random() < 0.7:
            words = rng.choice(items)[1] or ""
            parts += [words[rng.randint(0, 5):].upper(), "tail"]
        texts.append(", ".join(parts))
    texts += ["", None, "x Y", "only here; THIS!", "a " * 3000]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = table(spark, texts)
    done = {r.doc_id: r for r in winnowing.contamination(rows, bench, window=window).collect()}
    for i, (n, hit, ids) in enumerate(contamination(texts, items, window)):
        r = done[i]
        assert (r.n_words, r.n_hit, r.item_ids) == (n, hit, ids), texts[i]
        assert sum(s.stop - s.start for s in r.spans) == hit
    joined = winnowing.contamination(rows, bench.limit(0), window=window).collect()
    assert all(r.n_hit == 0 for r in joined) and len(joined) == len(texts)


def test_contamination_by_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", 0)
    items = [(1, " ".join(f"w{i}" for i in range(40)))]
    texts = [" ".join(f"w{i}" for i in range(a, a + 14)) + " other" for a in range(20)]
    done = winnowing.contamination(table(spark, texts), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.n_hit for r in done.collect()} == {14}


def test_contamination_of_awkward_rows(spark, awkward):
    bench = spark.createDataFrame([(1, "Short text"), (2, awkward.first().text)], "item_id bigint, text string")
    done = winnowing.contamination(awkward, bench)
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit) for r in done.collect())
    texts = [r.text for r in awkward.collect()]
    want = contamination(texts, [(1, "Short text"), (2, texts[0])], 13)
    assert rows == sorted((str(r.doc_id), n, hit) for r, (n, hit, _) in zip(awkward.collect(), want))
    kept = winnowing.without_contaminated(awkward, bench)
    assert kept.columns == awkward.columns
    assert kept.count() == sum(not (hit and 20 * hit >= n) for n, hit, _ in want)
    assert winnowing.contamination(awkward.limit(0), bench).collect() == []


def repeated(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    counts = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("window,period", [(1, None), (4, 2), (6, 3), (9, 7), (35, None)])
def test_repeats_equal_all_windows(spark, window, period, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 700)
    rng = random.Random(window)
    vocab = [f"w{i}" for i in range(4 if window < 9 else 30)]
    base = rng.choices(vocab, k=300)
    texts = []
    for _ in range(40):
        start, size = rng.randint(0, 250), rng.randint(0, 2 * window + 3)
        own = rng.choices(vocab + ["A", "a"], k=rng.randint(0, 30))
        texts.append(" ".join(own + base[start:start + size] + own[:3]))
    texts += ["", None, " ", "w1 " * (3 * window), " ".join(base)]
    done = repeats.without_repeats(table(spark, texts), window=window, period=period).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in done}
    for i, want in enumerate(repeated(texts, window)):
        assert got[i] == want, texts[i]
    for r in done:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed


def test_repeats_of_awkward_rows(spark, awkward):
    done = repeats.without_repeats(awkward, window=6).collect()
    want = repeated([r.text for r in awkward.collect()], 6)
    assert sorted((r.n_words, r.n_removed, r.kept) for r in done) == sorted(want)
    assert sorted(str(r.doc_id) for r in done) == sorted(str(r.doc_id) for r in awkward.collect())
    assert repeats.without_repeats(awkward.limit(0)).collect() == []


def test_difference_cover():
    for period in range(1, 24):
        cover = repeats.difference_cover(period)
        for i in range(period):
            for j in range(period):
                assert any((i + s) % period in cover and (j + s) % period in cover for s in range(period))


def near_groups(texts, shingle=5, percent=80):
    sets = []
    for t in texts:
        w = WORD.findall(lowered(t))
        sets.append({tuple(w[i:i + shingle]) for i in range(max(len(w) - shingle, 0) + 1)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed,chunk", [(1, 6_000_000), (2, 500), (3, 3000)])
def test_groups_equal_all_pairs(spark, seed, chunk, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", chunk)
    rng = random.Random(seed)
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for _ in range(25):
        base = [f"v{rng.randint(0, 400)}" for _ in range(rng.choice([2, 4, 6, 12, 40, 90, 200]))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(base))
            base = base[:at] + passage + base[at:]
        for _ in range(rng.choice([1, 2, 6])):
            copy = [*base]
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 99)}"
            if rng.random() < 0.3:
                copy = copy[:int(len(copy) * rng.uniform(0.78, 1))] or copy
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    texts += ["", None, "a", "A", "a b", " "]
    rng.shuffle(texts)
    done = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.groups(table(spark, texts)).collect()}
    assert [done[i] for i in range(len(texts))] == near_groups(texts)


def test_chained_copies(spark):
    # Each is near the next, first and last are far apart; and many near copies of one text.
    rng = random.Random(8)
    words = [f"c{i}" for i in range(300)]
    texts = []
    for i in range(25):
        texts.append(" ".join(words))
        words = words[6:] + [f"d{i}x{j}" for j in range(6)]
    base = [f"h{i}" for i in range(80)]
    for _ in range(120):
        copy = [*base]
        for _ in range(2):
            copy[rng.randrange(80)] = f"z{rng.randint(0, 10**6)}"
        texts.append(" ".join(copy))
    done = {r.doc_id: r.component_id for r in parity_join.groups(table(spark, texts)).collect()}
    assert [done[i] for i in range(len(texts))] == [g for _, g in near_groups(texts)]


def test_more_parts_for_thin_sets(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "PARTS", 0.05)
    monkeypatch.setattr(parity_join, "SMALL", 2)
    base = [f"t{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:30] + ["x"] + base[31:]), " ".join(base[::-1])]
    done = {r.doc_id: r.component_id for r in parity_join.groups(table(spark, texts)).collect()}
    assert done == {0: 0, 1: 0, 2: 2}


def test_groups_of_awkward_rows(spark, awkward):
    rows = awkward.collect()
    done = parity_join.groups(awkward).collect()
    assert len(done) == len(rows)
    groups = near_groups([r.text for r in rows])
    members = {}
    for r, (n, g) in zip(rows, groups):
        members.setdefault(g, []).append(r.doc_id)
    least = {g: min((k for k in ids if k is not None), default=None) for g, ids in members.items()}
    want = sorted(str((r.doc_id, n, least[g] if n else r.doc_id)) for r, (n, g) in zip(rows, groups))
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in done) == want
    kept = parity_join.first_of_groups(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(members)
    assert parity_join.groups(awkward.limit(0)).collect() == []


def test_small_tables_have_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, the rounds of a small group do not write a file for each."""
    written, write = [], C.materialize

    def counted(df, label):
        done = write(df, label)
        written.append((label, len(done.inputFiles())))
        return done

    monkeypatch.setattr(C, "materialize", counted)
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
        roots = C.components(edges)
        assert {(r.node, r.root) for r in roots.collect()} == {(i, 0) for i in range(41)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(written) > 1 and max(n for _, n in written[1:]) == 1
    stars = spark.createDataFrame([(9, 1), (8, 1), (7, 2)], "a bigint, b bigint")
    written.clear()
    assert {(r.node, r.root) for r in C.components(stars).collect()} == {(9, 1), (8, 1), (1, 1), (7, 2), (2, 2)}
    assert len(written) == 1


def test_sketches_never_differ_more_than_sets():
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(5, 400))) for _ in range(30)]
    sets = parity_join.Sets(pa.array(texts), 5)
    words, sizes = parity_join.sketches(sets)
    assert set(sizes) == {parity_join.SKETCH}
    bits = words.reshape(-1, parity_join.SKETCH)
    items = [set(sets.items[sets.rows == i].tolist()) for i in range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            assert int(np.bitwise_count(bits[i] ^ bits[j]).sum()) <= len(items[i] ^ items[j])


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)]
    edges += [(200, 201 + i) for i in range(50)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = C.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    got = {r.node: r.root for r in found}
    assert len(found) == len(got)
    assert all(got.get(n, n) == find(n) for n in root)


def training(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(150):
        words, state = [], "the"
        for _ in range(rng.randint(0, 60)):
            state = {"the": ["cat", "dog"], "cat": ["sat"], "dog": ["ran"], "sat": ["on"], "ran": ["on"]}.get(state, ["the", "so"])
            state = rng.choice(state)
            words.append(state if rng.random() < 0.9 else f"r{rng.randint(0, 200)}")
        texts.append(" ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
    return texts + ["", None, "the cat", "unseen words only"]


def base_scores(texts):
    def toks(t):
        return [*WORD.findall(lowered(t)), None]

    train = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in toks(t))
    total, distinct = sum(train.values()), len(train)
    out = []
    for i, t in enumerate(texts):
        w = toks(t)
        score = sum(math.log10((train[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        out.append((zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(train[x] > 0 for x in w), total, score))
    return out


def test_base_scores(spark):
    texts = training(spark)
    done = {r.doc_id: r for r in suffix_tree.scores(table(spark, texts), follow=0.004, context=0.01).collect()}
    for i, (out, n, known, total, score) in enumerate(base_scores(texts)):
        r = done[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)
    unseen = [r for r in done.values() if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) * 0.8


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_states_are_distributions(spark, depth):
    """After every context the probabilities of all words and one unknown sum to 1."""
    texts = training(spark)
    tree, counts = suffix_tree.fit(table(spark, texts).select("text"), depth, context=0.01, follow=0.004)
    assert any(k.any() for k in tree.kept)
    all_ = counts.toPandas()
    codes, n = all_["code"].to_numpy(np.int64).view(np.uint64), all_["n"].to_numpy()
    base = np.append(n, 0) + suffix_tree.SMOOTH
    base = base / base.sum()
    numbers = np.append(tree.numbers(codes), -1)

    def after(level, context):
        if level < 0:
            return base
        parent = after(level - 1, context if level == 0 else tree.contexts[level - 1][context] // tree.span)
        if not tree.kept[level][context]:
            return parent
        place = suffix_tree._places(tree.next_[level], np.where(numbers >= 0, context * tree.span + numbers, -1))
        return np.where(place >= 0, 10 ** tree.logs[level][place], 10 ** tree.rest[level][context] * parent)

    for level in range(depth):
        for context in np.flatnonzero(tree.kept[level]):
            assert after(level, context).sum() == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("hot", [1e-5, 0.02, 2.0])
def test_scores_equal_the_tree_held_whole(spark, hot, monkeypatch):
    """Weights sent, joined or both: each document's score is that of the tree of all its words."""
    monkeypatch.setattr(suffix_tree, "HOT", hot)
    texts = training(spark)
    rows = table(spark, texts)
    train = rows.where(~suffix_tree.held_out(rows.doc_id)).select("text")
    for depth in (1, 3):
        done = {r.doc_id: r for r in suffix_tree.scores(rows, depth=depth, context=12, follow=3).collect()}
        total = done[0].train_tokens
        tree, counts = suffix_tree.fit(train, depth, context=11.5 / total, follow=2.5 / total)
        assert sum(map(len, tree.next_)) > 10
        n_of = {r.code: r.n for r in counts.collect()}
        parts = rows.select(rows.doc_id.alias("_row"), "text").mapInArrow(
            suffix_tree._scored(tree, depth), "_row bigint, code bigint, n bigint, n_known bigint, base double, score double"
        ).collect()
        want = dict.fromkeys(done, 0.0)
        for r in parts:
            rare = 0 if r.code is None else r.n * math.log10(
                (n_of.get(r.code, 0) + suffix_tree.SMOOTH) / (total + suffix_tree.SMOOTH * (tree.distinct + 1))
            )
            want[r._row] += r.score + rare
        assert {i: r.score for i, r in done.items()} == pytest.approx(want, rel=1e-9)


def test_rare_contexts_are_learned(spark):
    """A context far below any share of the corpus, and one of three words, still tell what follows."""
    texts = [" ".join(f"w{i}x{j}" for j in range(300)) for i in range(400)]
    texts += ["odd pair here leads on", "even pair here turns back"] * 60 + ["solo start then every word follows"] * 11
    done = {r.doc_id: r for r in suffix_tree.scores(table(spark, texts)).collect()}
    assert 11 < 1e-4 * done[0].train_tokens
    assert all(done[i].score > done[i].base_score + 10 for i in range(400, 531))
    # "pair here" alone leaves two ways; three words leave one.
    two = {r.doc_id: r for r in suffix_tree.scores(table(spark, texts), depth=2).collect()}
    assert all(done[i].score > two[i].score + 0.2 for i in range(400, 520))


def test_only_runs_that_can_be_in_the_tree_move(spark, monkeypatch):
    """Runs whose end is not in the tree stay where they are, and runs are not written before they are joined."""
    rows = spark.createDataFrame([("a b c a b d",)], "text string")
    every = np.full(1 << 4, ~np.uint64(0))
    assert suffix_tree._followers(rows, 2, every, every).count() == 6
    assert suffix_tree._followers(rows, 2, every, np.zeros(1 << 4, np.uint64)).count() == 0
    labels, write = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, label: (labels.append(label), write(df, label))[1])
    assert suffix_tree.scores(table(spark, ["a b c a b d"] * 12), depth=1).count() == 12
    assert "weights" in labels and not {"parts", "followers"} & set(labels)


def test_scores_of_awkward_rows(spark, awkward):
    done = suffix_tree.scores(awkward).collect()
    assert len(done) == awkward.count()
    assert all(r.score <= 0 and math.isfinite(r.score) for r in done)
    null = [r for r in done if r.doc_id == 4]
    assert null[0].n_tokens == 1
    assert suffix_tree.scores(awkward.limit(0)).collect() == []
    alone = suffix_tree.scores(awkward.where("doc_id = 5")).collect()
    assert len(alone) == 1


def test_digests(spark):
    """The registered queries' digests, from the operators' own results in plain Python."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = dict(zip((r.doc_id for r in docs), repeated([r.text for r in docs], 35)))
    for r in queries.QUERIES["op5_repeats"](spark, SMALL).collect():
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    docs = C.table(spark, SMALL, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, C.staged(stage(spark, docs, SMALL), "stage")
        counts.append(docs.count())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == before.columns
    assert sorted(counts, reverse=True) == counts
    # The same job in plain Python, on the stages' contracts.
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from test_texts import base_spans

    texts = {r.doc_id: r.text for r in C.table(spark, SMALL, "documents").collect()}
    kept = {r.doc_id for r in fertility.judged(fertility.measure(C.table(spark, SMALL, "documents"))).where("kept").collect()}
    ids = sorted(kept)
    ids = [i for i, (_, g) in zip(ids, near_groups([texts[i] for i in ids])) if ids[g] == i]
    bench = [(r.item_id, r.text) for r in C.table(spark, SMALL, "benchmark").collect()]
    judged = contamination([texts[i] for i in ids], bench, 13)
    ids = [i for i, (n, hit, _) in zip(ids, judged) if not (hit and 20 * hit >= n)]
    known = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    done = {r.doc_id: r.ids for r in docs.collect()}
    assert sorted(done) == ids
    for i in ids:
        out, place = [], 0
        for a, b, kind in sorted((a, b, kind) for kind, a, b in base_spans(texts[i])):
            if a >= place:
                out += [texts[i][place:a], f"[{kind}]"]
                place = b
        text = "".join(out) + texts[i][place:]
        assert done[i] == known.encode(text, add_special_tokens=False).ids


def test_tree_in_parts_leaves_only_its_result(spark, monkeypatch):
    """Runs counted and texts scored in parts, by many buckets, give the same scores; tables that are not read
    any more are gone."""
    rows = table(spark, training(spark))
    want = {r.doc_id: r for r in suffix_tree.scores(rows, context=12, follow=3).collect()}
    for name, value in (("BUCKET", 100), ("FULL", 0.0), ("HELD", 50)):
        monkeypatch.setattr(suffix_tree, name, value)
    made, write = [], C.materialize

    def noted(df, label):
        out = write(df, label)
        made.append((label, out.inputFiles()))
        return out

    monkeypatch.setattr(C, "materialize", noted)
    done = {r.doc_id: r for r in suffix_tree.scores(rows, context=12, follow=3).collect()}
    assert done.keys() == want.keys()
    for i, r in done.items():
        assert r[:5] == want[i][:5]
        assert r[5:] == pytest.approx(want[i][5:], rel=1e-9)
    left = [label for label, files in made if any(Path(re.sub("^file:/*", "/", f)).exists() for f in files)]
    assert len(left) > 1 and set(left) == {"sums"}
