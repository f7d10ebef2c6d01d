import itertools
import random
from collections import defaultdict

import pyarrow as pa

from graintide.llm import order_minhash
from graintide.llm.order_minhash import _marked, banded_distance, classes, components, near_duplicate_stage, sketcher

from .helpers import ROWS, frame, texts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        r, at = rng.random(), rng.randrange(len(out) or 1)
        if r < 0.6 and out:
            out[at] = f"new{rng.random()}"
        elif r < 0.8 and out:
            del out[at]
        else:
            out.insert(at, f"in{rng.random()}")
    return out


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 14))]
        b = [x if rng.random() < 0.8 else rng.randint(0, 4) for x in a if rng.random() < 0.9]
        k = rng.randint(0, 6)
        assert banded_distance(a, b, k) == min(distance(a, b), k + 1)


def groups(spark, rows, **more):
    kept, found, number = classes(spark.createDataFrame(rows, "doc_id long, text string"), **more)
    by = defaultdict(list)
    for r in kept.join(found, kept[number] == found.rid).collect():
        by[r.root].append(r.doc_id)
    return by


def values(text):
    ids = sketcher().ids(text.split())
    return {*sketcher().sketch(ids).tolist(), *sketcher().near(ids).tolist()}


def test_planted_copies_and_clean_documents(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(3000)]
    rows, want = [], {}
    shared = [rng.choice(vocab) for _ in range(60)]
    for g in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(40, 400))]
        if g % 3 == 0:
            words[10:10] = shared
        for c in range(1 + (g % 4)):
            copy = words if c == 1 else edited(rng, words, c * len(words) // 40)
            want[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    got = groups(spark, rows)
    assert sorted(sorted(v) for v in got.values()) == sorted(sorted(k for k in want if want[k] == g) for g in set(want.values()))


def test_large_group_of_near_copies_stays_one_class(spark):
    rng = random.Random(3)
    words = [f"v{rng.randint(0, 5000)}" for _ in range(120)]
    rows = [(i, " ".join(edited(rng, words, 4))) for i in range(600)]
    assert [len(v) for v in groups(spark, rows).values()] == [600]


def test_same_classes_as_brute_force(spark):
    rows = [(k, t) for k, t in texts("sf0.01") if len(t) < 6000][:500]
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = {k: t.split() for k, t in rows}
    bags = {k: set(w) for k, w in words.items()}
    for i, (a, ta) in enumerate(rows):
        for b, tb in rows[:i]:
            n = max(len(words[a]), len(words[b]))
            if ta == tb or (abs(len(words[a]) - len(words[b])) <= n / 5 and len(bags[a] & bags[b]) > 0.3 * min(len(bags[a]), len(bags[b])) and 5 * distance(words[a], words[b]) <= n):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    want = defaultdict(list)
    for k, _ in rows:
        want[root(k)].append(k)
    assert sorted(sorted(v) for v in groups(spark, rows).values()) == sorted(sorted(v) for v in want.values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(i, i) == 0 for i in range(41))
    assert (got[101], got[102], got[300]) == (100, 100, 200)


def test_odd_rows(spark):
    df = frame(spark)
    got = near_duplicate_stage(spark, df, "")
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(ROWS) - 2
    assert {t for _, t in kept} == {t for _, t, *_ in ROWS}
    assert near_duplicate_stage(spark, frame(spark, []), "").collect() == []


def test_occurrences_are_labelled():
    grams = sketcher().kmers(sketcher().ids(("a b c d e " * 20).split()))
    assert len(set(grams.tolist())) == len(grams)


def test_marked_rows_by_mask_and_by_shuffle(spark):
    ids = [0, 1, 63, 64, 130, (5 << 33) + 7, (5 << 33) + 63]
    rows = spark.createDataFrame([(i, str(i)) for i in [*ids, 2, 65, 129, 5 << 33]], "rid long, text string")
    want = {i: i in ids for i in [*ids, 2, 65, 129, 5 << 33]}
    for most in (0, 100):
        found = _marked(rows, spark.createDataFrame([(i,) for i in ids], "rid long"), most).collect()
        assert {r.rid: r.marked for r in found} == want and len(found) == len(want)


def test_star_of_copies_that_link_through_one_text_only(spark):
    rng = random.Random(11)
    words = [f"s{i}" for i in range(300)]
    rows = [(0, " ".join(words))]
    for i in range(1, 400):
        copy = list(words)
        for at in rng.sample(range(300), 300 * rng.randint(12, 18) // 100):
            copy[at] = f"n{i}x{at}"
        rows.append((i, " ".join(copy)))
    rng.shuffle(rows)
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    split = {k: t.split() for k, t in rows}
    sketches = {k: values(t) for k, t in rows}
    for a, b in itertools.combinations(split, 2):
        if not sketches[a].isdisjoint(sketches[b]) and 5 * sum(x != y for x, y in zip(split[a], split[b], strict=True)) <= 300:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = defaultdict(list)
    for k, _ in rows:
        want[root(k)].append(k)
    assert len(want[0]) > 350
    for block in (2000, 30):  # values in one block, and dealt by pairs of blocks
        assert sorted(sorted(v) for v in groups(spark, rows, block=block).values()) == sorted(sorted(v) for v in want.values())


def substituted(rng, words, n, spread):
    out = list(words)
    step = len(words) // n
    for i in range(n):
        out[i * step + (rng.randrange(step) if not spread else step // 2)] = f"new{rng.random()}"
    return out


def test_short_texts_with_edits_are_met(spark):
    rng = random.Random(12)
    rows = []
    for g in range(120):
        n = 4 + g % 16
        words = [f"g{g}w{i}" for i in range(n)]
        rows += [" ".join(words), " ".join(edited(rng, words, n // 5)), " ".join(edited(rng, words, n // 5))]
        rows.append(" ".join([*words[: n // 2], *(["more"] * ((n + n // 4) // 5 if n % 4 == 0 else 0)), *words[n // 2 :]]))
    rows = list(enumerate(rows))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    split = [t.split() for _, t in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        if a // 4 == b // 4 and 5 * distance(split[a], split[b]) <= max(len(split[a]), len(split[b])):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = defaultdict(list)
    for k, _ in rows:
        want[root(k)].append(k)
    assert max(map(len, want.values())) > 2
    assert sorted(sorted(v) for v in groups(spark, rows).values()) == sorted(sorted(v) for v in want.values())


def test_recall_at_the_threshold():
    rng = random.Random(13)
    for n in (5, 10, 16, 19, 20, 25, 40, 99, 100, 300):
        for spread in (False, True):
            met = 0
            for t in range(400):
                words = [f"t{t}w{i}" for i in range(n)]
                other = substituted(rng, words, n // 5, spread)
                met += not values(" ".join(words)).isdisjoint(values(" ".join(other)))
            assert met == 400 if n < 20 else met >= 392, (n, spread, met)


def test_pairs_that_share_a_passage_are_left_apart(spark):
    rng = random.Random(14)
    passage = [f"p{i}" for i in range(300)]
    rows = [(i, " ".join([*passage, *[f"o{i}x{k}" for k in range(100 + rng.randrange(20))]])) for i in range(200)]
    assert all(len(v) == 1 for v in groups(spark, rows, block=40).values())


def test_column_named_like_the_row_number(spark):
    rows = [(1, "a b c d e f g", 777), (2, "a b c d e f g", 888), (3, "other words", None)]
    got = near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, _rid long"), "")
    assert got.columns == ["doc_id", "text", "_rid"]
    assert sorted(r._rid or 0 for r in got.collect()) in ([0, 777], [0, 888])


def test_rows_of_a_value_carry_no_sketches_and_a_pair_leaves_once(spark, monkeypatch):
    rng = random.Random(15)
    ids = [sketcher().ids([*[f"w{i}" for i in range(100)], f"x{k}", f"y{rng.random()}"]) for k in range(3)]
    bags = [sketcher().bag(x) for x in ids]
    rows = [{"value": v, "turn_a": 0, "turn_b": 0, "block": 0, "rid": k, "root": k, "n": 102, "bag": bags[k], "wide": None} for v in (5, 6, 7) for k in range(3)]
    kinds = pa.schema([("value", pa.int64()), ("turn_a", pa.int32()), ("turn_b", pa.int32()), ("block", pa.int32()), ("rid", pa.int64()), ("root", pa.int64()), ("n", pa.int32()), ("bag", pa.binary()), ("wide", pa.binary())])
    got = [p for b in order_minhash._met(iter([pa.RecordBatch.from_pylist(rows, kinds)])) for p in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)]
    assert sorted(got) == [(0, 1), (0, 2), (1, 2)]
    # of the texts only those of a pair are shuffled
    given = []
    own = order_minhash._ends
    monkeypatch.setattr(order_minhash, "_ends", lambda pairs, side, *more: given.append(side) or own(pairs, side, *more))
    texts = spark.createDataFrame([(k, "a b c d e f") for k in range(50)], "rid long, text string")
    links = order_minhash._links(spark.createDataFrame([(3, 7), (7, 40)], "u long, v long"), texts)
    assert sorted(map(tuple, links.collect())) == [(3, 7), (7, 40)] and {x.rid for x in given[0].collect()} == {3, 7, 40}


def test_pair_of_several_values_leaves_at_the_least_one():
    ids = [sketcher().ids([*[f"w{i}" for i in range(100)], f"x{k}"]) for k in range(3)]
    low = [[-8, 5, 6, 7], [-9, 5, 6, 7], [6, 7]]
    kinds = pa.schema([("value", pa.int64()), ("turn_a", pa.int32()), ("turn_b", pa.int32()), ("block", pa.int32()), ("rid", pa.int64()), ("root", pa.int64()), ("n", pa.int32()), ("bag", pa.binary()), ("wide", pa.binary()), ("low", pa.list_(pa.int64()))])
    got = []
    for v in (5, 6, 7):  # a task each
        rows = [{"value": v, "turn_a": 0, "turn_b": 0, "block": 0, "rid": k, "root": k, "n": 101, "bag": sketcher().bag(ids[k]), "wide": None, "low": low[k]} for k in range(3) if v in low[k]]
        got += [(v, *p) for b in order_minhash._met(iter([pa.RecordBatch.from_pylist(rows, kinds)])) for p in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)]
    assert sorted(got) == [(5, 0, 1), (6, 0, 2), (6, 1, 2)]


def test_turns_end_when_they_find_no_links(spark, monkeypatch):
    rng = random.Random(16)
    passage = [f"p{i}" for i in range(300)]
    rows = [(i, " ".join([*passage, *[f"o{i}x{k}" for k in range(100 + rng.randrange(20))]])) for i in range(60)]
    names = []
    own = order_minhash.keep
    monkeypatch.setattr(order_minhash, "keep", lambda df, name: names.append(name) or own(df, name))
    assert all(len(v) == 1 for v in groups(spark, rows).values())
    assert names.count("near") == 3  # the best centre, a centre of another class, pairs of classes


def test_rows_of_the_stage_are_not_shuffled(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(k, words if k % 2 else f"{words} {k} {k}x") for k in range(40)], "doc_id long, text string")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = near_duplicate_stage(spark, docs, "")
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_pairs_of_joined_classes_are_not_aligned(spark, monkeypatch):
    base, far = [f"w{i}" for i in range(60)], [f"z{i}" for i in range(60)]
    words = {k: [*base[:k], f"x{k}", *base[k + 1 :]] for k in range(6)} | {k: [*base[:k], f"x{k}", *base[k + 1 :]] for k in range(10, 16)} | {20: far}
    texts = spark.createDataFrame([(k, " ".join(x)) for k, x in words.items()], "rid long, text string")
    roots = spark.createDataFrame([(k, 0) for k in range(1, 6)] + [(k, 10) for k in range(11, 16)], "node long, root long")
    rows = [(u, v, 0, 10, 10 * (u + v)) for u in range(6) for v in range(10, 16)] + [(u, 20, 0, 20, 5) for u in range(6)]
    asked = []
    own = order_minhash._links
    monkeypatch.setattr(order_minhash, "_links", lambda pairs, texts: asked.extend((x.u, x.v) for x in pairs.collect()) or own(pairs, texts))
    got = order_minhash._joined(spark.createDataFrame(rows, "u long, v long, a long, b long, off long"), roots, texts)
    found = {x.node: x.root for x in got.collect()}
    assert {found.get(k, k) for k in words if k < 20} == {0} and found.get(20, 20) == 20
    # one pair of the two classes that it joins; all pairs of the others
    assert [p for p in asked if p[1] < 20] == [(0, 10)] and sorted(p for p in asked if p[1] == 20) == [(u, 20) for u in range(6)]
