import hashlib
import random
import re

import compare

from tracklake.llm import decontamination, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_force(docs, items, size):
    windows = {}
    for item, text in items:
        own = words(text)
        for s in range(max(len(own) - size, 0) + 1 if own else 0):
            windows.setdefault(tuple(own[s : s + size]), set()).add(item)
    out = []
    for key, text in docs:
        own, hit, found = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(own) - n + 1):
                if (window := tuple(own[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[window] - {None}
        ids = ",".join(sorted(map(str, found)))
        out.append((key, len(own), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_query_against_sql(spark, sf_dir):
    name = "op12_decontamination"
    columns, rows = compare.spark_rows(queries.QUERIES[name](spark, sf_dir))
    assert (columns, rows) == compare.duck_rows(compare.connect(sf_dir), queries.ORACLE[name])
    hit = columns.index("n_hit")
    assert any(r[hit] for r in rows) and not all(r[hit] for r in rows)


def test_no_python_on_the_executors(spark, sf_dir):
    plan = queries.QUERIES["op12_decontamination"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_short_items_shared_windows_and_odd_rows(spark):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "日本"]
    run = lambda n: draw.choices(vocabulary, k=n)
    items = [(k, " ".join(run(n))) for k, n in enumerate([1, 2, 3, 4, 5, 9, 10, 11, 14, 30, 60, 60])]
    items += [(3, "W1-w2_W3"), (None, " ".join(run(12))), (77, None), (78, " .. "), (79, items[9][1]), (9, items[9][1])]
    docs = [(k, " ".join(run(draw.choice([0, 3, 9, 10, 40])))) for k in range(60)]
    for k, (_, text) in enumerate(items):
        docs.append((100 + k, "; ".join([" ".join(run(15)), (text or "").upper(), " ".join(run(3))])))
    docs += [(200, None), (201, ""), (202, " \n--"), (None, items[9][1]), (100, "another text w1"), docs[70], docs[70]]
    docs += [(203, " ".join([items[10][1]] * 40 + run(20_000))), (204, "x" * 100_000), (205, " " * 100_000 + "w1 w2 w3")]
    frame = spark.createDataFrame([(k, t, 0, "") for k, t in docs], "doc_id long, text string, n int, item string").repartition(3)
    item_frame = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, window int")
    for size, shingle, limit in ((10, 4, 1 << 24), (3, 2, 8000), (12, 1, 1 << 24)):
        result = decontamination.contamination(frame, item_frame, size, shingle, broadcast_bytes=limit)
        assert got(result) == brute_force(docs, items, size)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert got(decontamination.contamination(docs, items.limit(0))) == brute_force([(1, "a b c")], [], 10)
    assert got(decontamination.contamination(docs, items)) == brute_force([(1, "a b c")], [(1, "a b c")], 10)
