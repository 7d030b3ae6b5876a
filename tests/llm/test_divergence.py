import random
import re
from collections import Counter

import compare
import numpy as np

from tracklake.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_force(rows, least, top):
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        held = Counter(t for r in own for t in set(r[2]))
        kept = [t for t, n in held.items() if n >= least]
        sums = {s: Counter(t for r in own if r[1] == s for t in r[2]) for s in {r[1] for r in own}}
        whole = sum(sums.values(), Counter())

        def costs(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        price = {s: costs(c) for s, c in sums.items()}
        middle = costs(whole)
        away = lambda p, q: (p - q) ** 2 // q
        for s, p in price.items():
            pairs = [(-sum(away(p[t], q[t]) for t in kept), o) for o, q in price.items() if o != s]
            terms = [(-away(p[t], middle[t]), t) for t in kept if sums[s][t] and p[t] > middle[t]]
            by = lambda x: (x[0], x[1].encode())
            for part, found in (("pair", sorted(pairs, key=by)), ("term", sorted(terms, key=by)[:top])):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def test_query_against_sql(spark, sf_dir):
    name = "op11_divergence"
    assert compare.spark_rows(queries.QUERIES[name](spark, sf_dir)) == compare.duck_rows(compare.connect(sf_dir), queries.ORACLE[name])


def test_blocks_tiles_and_odd_rows(spark):
    draw = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "xyzÉé"] + ["日本", "😀", "Ab"]
    rows = [(draw.choice(["en", "de", None]), draw.choice(["s", "S", "t1", "t2", "ü", None]), " 1".join(draw.choices(vocabulary, k=draw.choice([0, 1, 5, 40])))) for _ in range(120)]
    rows += [("fr", "only", "rare words"), ("it", "one", "rare"), ("it", "two", None), ("en", "none", "..."), ("en", "s", "ax " * 30_000), rows[0], rows[0], (None, None, None)]
    frame = spark.createDataFrame([(*r, 0, "") for r in rows], "lang string, source string, text string, n int, term string").repartition(4)
    for block, tile, least, top in ((1 << 15, 4, 3, 200), (7, 1, 2, 5), (3, 2, 3, 200)):
        result = divergence.audit(frame, least, top, block_terms=block, tile_sources=tile)
        assert sorted(map(tuple, result.collect())) == brute_force(rows, least, top)
    assert divergence.audit(frame.limit(0)).count() == 0


def test_prices_of_large_counts_are_exact():
    draw = random.Random(4)
    for total in (10, 10**9, 10**12, 9 * 10**15 - 10**6):
        counts = np.array([0, 1, total // 3, total, *(draw.randrange(total + 1) for _ in range(50))], np.int64)
        exact = [1 + 10**9 * (int(c) + 1) // (total + 10**5) for c in counts]
        assert divergence.prices(counts, total, 10**5).tolist() == exact


def test_gallop():
    draw = random.Random(6)
    for sizes in ((0, 0), (0, 9), (5, 400), (300, 20), (60, 60)):
        one, other = (np.array(sorted(draw.sample(range(500), n)), np.int64) for n in sizes)
        here, there = divergence.gallop(one, other)
        assert one[here].tolist() == other[there].tolist() == sorted(set(one.tolist()) & set(other.tolist()))
