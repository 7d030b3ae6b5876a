"""Stored area results and the exports that are made only if asked for with an old hash."""

import threading


from tracklake import schemas
from tracklake.plans import workflows
from tracklake.sources import areas

BOX = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
FAR = [(50.0, 50.0), (60.0, 50.0), (60.0, 60.0), (50.0, 60.0)]
WAYS = "way_id long, pos long, ref long, lat double, lon double"


def found(spark, *way_ids):
    return spark.createDataFrame([(w, p, w * 10 + p, 1.0, 2.0) for w in way_ids for p in (0, 1)], WAYS)


def stored(spark, path):
    return sorted((r.area_id, r.way_id) for r in areas.area_ways(spark, path).select("area_id", "way_id").distinct().collect())


def track(spark, shift=0.0):
    rows = [(1, i, 1.0 + i + shift, 5.0, i) for i in range(6)]
    return spark.createDataFrame(rows, schemas.POSITIONS)


def ask(spark, path, positions, *requests):
    answers, exports = workflows.answer_requests(spark.createDataFrame(list(requests), schemas.AREA_REQUESTS), positions, path)
    replies = sorted((r.area_id, r.order_no, r.up_to_date) for r in answers.collect())
    return replies, {} if exports is None else {r.area_id: r.hash for r in exports.select("area_id", "hash").distinct().collect()}


def test_nothing_stored(spark, tmp_path):
    path = str(tmp_path)
    assert areas.load_area(spark, path, "a") is None
    assert areas.area_ways(spark, path).schema == schemas.AREA_WAYS
    assert ask(spark, path, track(spark), ("a", 1, None)) == ([], {})


def test_the_last_result_of_an_area_counts(spark, tmp_path):
    path = str(tmp_path)
    areas.save_area(found(spark, 1, 2), path, "a", BOX)
    areas.save_area(found(spark, 3), path, "b", BOX)
    areas.save_area(found(spark, 4), path, "a", FAR)
    assert stored(spark, path) == [("a", 4), ("b", 3)]
    assert areas.load_area(spark, path, "a").ring == FAR
    areas.save_area(found(spark), path, "a", FAR)  # nothing found
    assert stored(spark, path) == [("b", 3)]


def test_ways_of_a_writer_that_died_are_not_seen(spark, tmp_path):
    path = str(tmp_path)
    areas.save_area(found(spark, 1), path, "a", BOX)
    found(spark, 9).write.parquet(f"{path}/found/rows=lost")
    assert stored(spark, path) == [("a", 1)]


def test_concurrent_savers_keep_each_others_areas(spark, tmp_path):
    path, names = str(tmp_path), ["a", "b", "c"]
    threads = [threading.Thread(target=areas.save_area, args=(found(spark, i), path, n, BOX)) for i, n in enumerate(names)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert stored(spark, path) == [("a", 0), ("b", 1), ("c", 2)]


def test_a_hash_is_noted_for_the_result_it_was_made_from(spark, tmp_path):
    path = str(tmp_path)
    old = areas.save_area(found(spark, 1), path, "a", BOX)
    assert areas.cache_hash(spark, path, old, "x")
    assert areas.load_area(spark, path, "a").hash == "x"
    areas.save_area(found(spark, 1), path, "a", BOX)
    assert areas.load_area(spark, path, "a").hash is None
    assert not areas.cache_hash(spark, path, old, "x")
    assert areas.load_area(spark, path, "a").hash is None


def test_exports_are_made_for_old_hashes_only(spark, tmp_path):
    path = str(tmp_path)
    areas.save_area(found(spark, 1), path, "a", BOX)
    areas.save_area(found(spark, 2), path, "empty", FAR)
    replies, made = ask(spark, path, track(spark), ("a", 1, None), ("a", 2, "old"), ("empty", 3, None), ("unknown", 4, None))
    assert replies == [("a", 1, False), ("a", 2, False), ("empty", 3, False)]
    assert set(made) == {"a"} and areas.load_area(spark, path, "a").hash == made["a"]
    assert areas.load_area(spark, path, "empty").hash is None
    assert ask(spark, path, track(spark), ("a", 5, made["a"])) == ([("a", 5, True)], {})
    # Asked with nothing, the export is made again although the hash is known; the same content has the same one.
    assert ask(spark, path, track(spark), ("a", 6, None)) == ([("a", 6, False)], made)
    assert ask(spark, path, track(spark, 0.5), ("a", 7, "old"))[1]["a"] != made["a"]
