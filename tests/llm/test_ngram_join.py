import random
import re
from collections import Counter

import numpy as np

from tracklake.llm import ngram_join, queries, shingles
from tracklake.llm import components as connected
from tracklake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_force(rows, size, percent):
    """Size and component of each key, by comparing all pairs of documents that share a shingle."""
    sets = {k: shingle_set(t, size) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = {}
    for k, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(k)
    for pair in {(a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :]}:
        a, b = sets[pair[0]], sets[pair[1]]
        if 100 * len(a & b) >= percent * len(a | b):
            low, high = sorted(map(find, pair))
            root[high] = low
    return {k: (len(sets[k]), find(k)) for k in sets}


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = result(queries.QUERIES["op9_ngram_join"](spark, sf_dir))
    assert got == brute_force(rows, 4, 85)
    assert len({c for _, c in got.values()}) < len(got)


def test_groups_chains_and_common_passages(spark):
    """Chains whose ends do not link, passages shared by all, sizes at the bound."""
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = draw.choices(vocabulary, k=60)
    rows = []
    for group in range(12):
        words = draw.choices(vocabulary, k=draw.choice([5, 20, 60, 200]))
        for _ in range(draw.randint(1, 25)):
            for _ in range(draw.choice([0, 1, 1, 2, 4])):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    for _ in range(60):
        rows.append((len(rows), " ".join(passage + draw.choices(vocabulary, k=draw.choice([3, 8, 30, 90])))))
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size, percent in ((4, 85), (5, 80), (2, 60)):
        assert result(ngram_join.near_duplicates(frame, size, percent)) == brute_force(rows, size, percent)


def test_edge_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t", 0), (4, "One two", 0), (5, "one  TWO", 0), (6, "one", 0), (7, "x " * 50_000, 0), (8, "x " * 40_000, 0), (None, "one two", 0)]
    frame = spark.createDataFrame(rows + [(9, "a b c d e", 0)] * 3, "doc_id long, text string, n int")
    got = sorted(map(tuple, ngram_join.near_duplicates(frame, 4, 85).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 7), (None, 1, None)] + [(9, 2, 9)] * 3, key=str)
    apart = [(1, "a b c d e f g h"), (2, "a b c d e f x y")] * 3
    once = result(ngram_join.near_duplicates(spark.createDataFrame(apart, "doc_id long, text string"), 1, 70))
    assert once == {1: (8, 1), 2: (8, 2)}
    assert ngram_join.near_duplicates(frame.limit(0)).count() == 0


def test_different_texts_of_one_id(spark):
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base), " ".join(base[:39] + ["x"]), " ".join(f"v{i}" for i in range(40)), " ".join(["y"] + [f"v{i}" for i in range(1, 40)])]
    rows = [(1, texts[0]), (1, texts[2]), (2, texts[1]), (3, texts[3]), (3, texts[3]), (4, "alone"), (4, None), (4, ""), (None, "alone")]
    frame = spark.createDataFrame([(*r, 0, "a") for r in rows], "doc_id long, text string, n int, name string")
    got = sorted(map(tuple, ngram_join.near_duplicates(frame, 2, 80).collect()), key=str)
    assert got == sorted([(1, 39, 1), (1, 39, 1), (2, 39, 1), (3, 39, 1), (3, 39, 1), (4, 1, 4), (4, 0, 4), (4, 0, 4), (None, 1, None)], key=str)
    kept = sorted(map(tuple, ngram_join.first_of_groups(frame, 2, 80).collect()), key=str)
    # All rows of ids 1 to 3 but one are copies, as (1, texts[2]) links with 3; an empty text and a null one are the same.
    assert sorted((k[0], k[1] or "") for k in kept if k[0]) in [sorted([(1, t), (1, texts[2]), (4, "alone"), (4, "")]) for t in texts[:1]]
    assert (None, "alone", 0, "a") in kept and len(kept) == 5


def test_large_group_of_near_copies_is_not_paired(spark, monkeypatch):
    """A group of near copies with a common line is joined by tries, not by all of its pairs."""
    draw = random.Random(11)
    line, base = [f"l{i}" for i in range(12)], [f"w{i}" for i in range(150)]
    rows = []
    for k in range(700):
        words = line + base
        for _ in range(draw.choice([0, 1, 1, 2])):
            words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(line + [f"u{k}_{i}" for i in range(60)])) for k in range(300)]
    pairs = []
    run = ngram_join.Tries.run
    monkeypatch.setattr(ngram_join.Tries, "run", lambda self, frame: pairs.append(frame.count()) or run(self, frame))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(ngram_join.near_duplicates(frame, 4, 85)) == brute_force(rows, 4, 85)
    assert sum(pairs) < 20 * len(rows)


def test_shingles_are_told_apart_as_words_are():
    draw = random.Random(1)
    texts = ["".join(draw.choices("ab AB\n\x0b\x1cé ", k=draw.randint(0, 14))) for _ in range(3000)] + ["", " a", "a "]
    data = "".join(texts).encode()
    ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for size in (1, 2, 3):
        made = shingles.shingle_sets(np.frombuffer(data, np.uint8), ends, size)
        names = {}
        for text, grams in zip(texts, made):
            own = frozenset(shingle_set(text, size))
            assert len(own) == len(grams)
            assert names.setdefault(own, grams.tolist()) == grams.tolist()
        assert len({tuple(v) for v in names.values()}) == len(names)


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(500, 560)] + [(700, k) for k in range(701, 760)]
    root = {k: k for e in edges for k in e}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: find(k) for a, b in edges if a != b for k in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_parities_keep_every_linked_pair(spark):
    """Sets at the bound and around it, small and larger than the number of bits; far ones are told apart."""
    draw = random.Random(5)
    rows, links = [], []
    for n in (1, 2, 12, 100, 400, 3000):
        for _ in range(40):
            a = {draw.getrandbits(64) for _ in range(n)}
            change = draw.randint(0, max(1, n // 8))
            b = set(list(a)[change:]) | {draw.getrandbits(64) for _ in range(draw.randint(0, max(1, n // 8)))}
            sets = [np.array(sorted(s), np.uint64) for s in (a, b)]
            links.append(100 * len(a & b) >= 85 * len(a | b))
            rows.append((*[ngram_join.parities(s).tolist() for s in sets], len(a), len(b), links[-1]))
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>, na int, nb int, linked boolean")
    frame = frame.withColumn("alike", ngram_join.alike("a", "b", "na", "nb", 85))
    assert frame.filter("linked and not alike").count() == 0
    assert 0 < sum(links) < len(links)
    far = [ngram_join.parities(np.array([draw.getrandbits(64) for _ in range(150)], np.uint64)).tolist() for _ in range(40)]
    pairs = spark.createDataFrame([(x, y, 150, 150) for x, y in zip(far, far[1:])], "a array<long>, b array<long>, na int, nb int")
    assert pairs.filter(ngram_join.alike("a", "b", "na", "nb", 85)).count() == 0


def test_sets_with_grams_of_their_own_meet_no_others(spark):
    """Passages that two documents share don't lead in documents with enough other grams."""
    own = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(k, f"{own(k, 200)} {own(1000 + k, 40)} {own(1000 + (k + 1) % 60, 40)}") for k in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    found = ngram_join.leading_grams(docs, "id", "text", 4, 85).selectExpr("id", "explode(prefix) as gram").collect()
    leads = Counter(r.gram for r in found)
    assert len({r.id for r in found}) == 60
    assert sum(n > 1 for n in leads.values()) < 0.1 * len(leads)


def test_rarest_of_common_grams_lead(spark):
    """Texts of common words alone lead with those that fewest have."""
    rows = [(k, " ".join([f"own{k}"] + [f"all{i}" for i in range(10)] + [f"some{k % 10}x{i}" for i in range(10)])) for k in range(200)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    found = ngram_join.leading_grams(docs, "id", "text", 1, 85).selectExpr("id", "explode(prefix) as gram").collect()
    assert len({r.id for r in found}) == 200
    assert max(Counter(r.gram for r in found).values()) == 20


def test_grams_that_lead_alone_are_left_out(spark):
    own = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(k, f"{own(k, 50)} {own(1000 + k // 2, 30 * (k % 3))}") for k in range(60)] + [(100, ""), (101, None), (102, own(1, 50))]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    whole = ngram_join.materialize(ngram_join.prefixes(docs, "id", "text", 2, 60, (np.zeros(0, np.uint64), np.zeros(0, np.int8))))
    prefix = {r.id: r.prefix for r in whole.collect() if r.n}
    times = Counter(g for grams in prefix.values() for g in grams)
    some = ngram_join.shared_leading(whole.filter("n > 0")).collect()
    assert {r.id for r in some} == set(prefix)
    for r in some:
        assert [prefix[r.id][k] for k in r.places] == r.prefix
        assert set(r.prefix) >= {g for g in prefix[r.id] if times[g] > 1}
    assert sum(times[g] == 1 for r in some for g in r.prefix) < 0.1 * sum(n == 1 for n in times.values())


def test_group_near_the_bound_is_not_paired(spark, monkeypatch):
    """Of a group of which many pairs almost link, few are multiplied."""
    draw = random.Random(2)
    rows = []
    for k in range(400):
        words = [f"w{i}" for i in range(100)]
        for i in draw.sample(range(100), draw.choice([5, 6, 6])):
            words[i] = f"e{k}x{i}"
        rows.append((k, " ".join(words)))
    pairs = []
    multiply = ngram_join.multiply
    monkeypatch.setattr(ngram_join, "multiply", lambda frame, *more: pairs.append(frame.count()) or multiply(frame, *more))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(ngram_join.near_duplicates(frame, 1, 85)) == brute_force(rows, 1, 85)
    assert sum(pairs) < 20 * len(rows), pairs


def test_few_links_take_no_rounds(spark, monkeypatch):
    """A small graph is stored once, however long its chains are; a large one takes rounds and gives the same."""
    edges = [(k, k + 1) for k in range(60)] + [(200 - k, 199 - k) for k in range(70)] + [(300, k) for k in range(301, 360)] + [(5, 5), (None, 7)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    stored = []
    materialize = connected.materialize
    monkeypatch.setattr(connected, "materialize", lambda frame: stored.append(1) or materialize(frame))
    few = {r.node: r.component for r in components(frame, "a", "b").collect()}
    assert len(stored) == 1
    assert few == {k: 0 for k in range(61)} | {k: 130 for k in range(130, 201)} | {k: 300 for k in range(300, 360)}
    monkeypatch.setattr(connected, "FEW_EDGES", -1)
    monkeypatch.setattr(connected, "FOREST_ROWS", 3)
    rounds = components(frame, "a", "b").collect()
    assert {r.node: r.component for r in rounds} == few and len(rounds) == len(few) and len(stored) > 4
    texts = components(frame.selectExpr("string(a + 1000) as a", "string(b + 1000) as b"), "a", "b").collect()
    assert {int(r.node) - 1000: int(r.component) - 1000 for r in texts} == few


def test_links_are_joined_once(spark, monkeypatch):
    """Clusters are computed again for new links only, and no pairs take no multiplication."""
    rows = [(k, " ".join(f"w{i}" for i in range(30)) + f" {'ab'[k % 2]}{k // 2}") for k in range(40)] + [(100 + k, f"x{k}") for k in range(9)]
    calls, sizes = [], []
    whole, multiply = ngram_join.components, ngram_join.multiply
    monkeypatch.setattr(ngram_join, "components", lambda *a: calls.append(1) or whole(*a))
    monkeypatch.setattr(ngram_join, "multiply", lambda pairs, *a: sizes.append(pairs.count()) or multiply(pairs, *a))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(ngram_join.near_duplicates(frame, 2, 80)) == brute_force(rows, 2, 80)
    assert len(calls) == 1
    assert len(sizes) == 1 and sizes[0]
