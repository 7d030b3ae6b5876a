import pytest
from pyspark.sql import functions as F

from tracklake import schemas
from tracklake.functions.tags import highway_class
from tracklake.operators import ways
from tracklake.plans import workflows

NODES = [(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 20.0, 20.0), (4, 5.0, 5.0)]
REFS = [(7, 0, 1), (7, 1, 2), (7, 2, 1), (8, 0, 2), (8, 1, 3), (9, 0, 3)]
TAGS = [
    (7, 0, "name", "cycleway"),
    (7, 1, "highway", "cycleway"),
    (7, 2, "highway", "track"),
    (8, 0, "highway", "track"),
    (8, 1, "highway", "cycleway"),
    (9, 0, "highway", "cycleway"),
]
SQUARE = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]


@pytest.fixture(scope="module")
def tables(spark):
    return ways.MapTables(
        nodes=spark.createDataFrame(NODES, schemas.NODES),
        ways=spark.createDataFrame([(7,), (8,), (9,)], "way_id long"),
        way_nodes=spark.createDataFrame(REFS, schemas.WAY_NODES),
        way_tags=spark.createDataFrame(TAGS, schemas.WAY_TAGS),
        relations=spark.createDataFrame([(1,)], "id long"),
    )


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_closed_way_keeps_its_repeated_node(tables):
    way = ways.resolve_ways(tables.way_nodes, tables.nodes).where("way_id = 7").orderBy("pos")
    assert [(r.pos, r.ref, r.lat) for r in way.collect()] == [(0, 1, 1.0), (1, 2, 2.0), (2, 1, 1.0)]


def test_last_of_equal_node_ids_counts(spark, tables):
    nodes = spark.createDataFrame(
        [(1, 1.0, 1.0, 0), (2, 2.0, 2.0, 1), (3, 3.0, 3.0, 2), (1, 9.0, 9.0, 3)],
        "id long, lat double, lon double, place long",
    )
    got = ways.resolve_ways(tables.way_nodes, nodes, node_order="place").where("ref = 1")
    assert {r.lat for r in got.collect()} == {9.0}


def test_dangling_reference(spark, tables):
    refs = tables.way_nodes.unionByName(spark.createDataFrame([(8, 2, 77)], schemas.WAY_NODES))
    with pytest.raises(Exception, match="no node for reference 77"):
        ways.resolve_ways(refs, tables.nodes).count()
    with pytest.raises(Exception, match="no node for reference 77"):
        ways.resolve_ways(refs, tables.nodes).select("way_id").collect()
    assert ways.resolve_ways(refs, tables.nodes, on_missing="drop").count() == len(REFS)
    with pytest.raises(ValueError):
        ways.resolve_ways(refs, tables.nodes, on_missing="ignore")


def test_hooks(tables):
    got = ways.resolve_ways(
        tables.way_nodes, tables.nodes, node_fn=lambda n: n.lat + n.lon, way_fn=lambda w: -w
    )
    assert (got.where("ref = 3").first().node, got.where("way_id = 9").first().way) == (40.0, -9)


def test_first_highway_tag_decides(tables):
    assert ids(ways.is_cycleway(tables.way_tags)) == [7, 9]
    assert ids(ways.tag_values(tables.way_tags)) == ["cycleway", "track"]


def test_subset(tables):
    subset = ways.way_subset(tables)
    assert ids(subset.nodes) == [1, 2, 3]
    assert ids(subset.ways) == [7, 9]
    assert subset.way_nodes.count() == 4 and subset.way_tags.count() == 4
    assert subset.relations is None


def test_area_query_looks_at_any_tag_and_takes_all_nodes(tables):
    touching = ways.ways_touching(tables.way_nodes, tables.nodes, tables.way_tags, SQUARE)
    assert ids(touching) == [7, 8]
    elements = ways.ways_with_nodes(tables.way_nodes, tables.nodes, touching)
    nodes, found = ways.split_elements(elements)
    assert sorted(r.id for r in nodes.collect()) == [1, 2, 3]
    assert sorted((r.id, r.pos, r.ref) for r in found.collect()) == sorted(r for r in REFS if r[0] != 9)
    whole = workflows.ways_in_polygon(tables.way_nodes, tables.nodes, tables.way_tags, SQUARE)
    assert whole.where("way_id = 8 and lat = 20").count() == 1


def test_paths(tables):
    paths = ways.collect_path(ways.resolve_ways(tables.way_nodes, tables.nodes), bits=1)
    got = {(r.way_id, r.piece): [tuple(p) for p in r.points] for r in paths.collect()}
    assert got[7, 0] == [(1.0, 1.0), (2.0, 2.0)] and got[7, 1] == [(1.0, 1.0)]


def test_highway_class(spark):
    df = spark.createDataFrame([("steps",), ("path",), ("cycleway",), ("moon",)], "v string")
    got = [r[0] for r in df.select(highway_class(F.col("v"))).collect()]
    assert got == ["never", "link", "must", None]


def test_last_node_decides_whether_a_way_touches(spark):
    """A stale place inside the polygon selects nothing, and no reference is doubled."""
    nodes = spark.createDataFrame([(1, 5.0, 5.0, 0), (1, 50.0, 50.0, 1), (2, 60.0, 60.0, 0), (3, 70.0, 7.0, 0), (3, 5.0, 6.0, 1)], "id long, lat double, lon double, doc_order int")
    way_nodes = spark.createDataFrame([(7, 0, 1), (7, 1, 2), (8, 0, 3), (8, 1, 1)], "way_id long, pos long, ref long")
    way_tags = spark.createDataFrame([(7, 0, "highway", "cycleway"), (8, 0, "highway", "cycleway")], "way_id long, pos long, k string, v string")
    found = workflows.ways_in_polygon(way_nodes, nodes, way_tags, SQUARE, node_order="doc_order")
    assert sorted(map(tuple, found.collect())) == [(8, 0, 3, 5.0, 6.0), (8, 1, 1, 50.0, 50.0)]
    touching = ways.ways_touching(way_nodes, nodes, way_tags, SQUARE, node_order="doc_order")
    elements = ways.ways_with_nodes(way_nodes, nodes, touching, node_order="doc_order")
    assert sorted((r.id, r.lat) for r in elements.where("type = 'node'").collect()) == [(1, 50.0), (3, 5.0)]
    for call in (
        lambda: workflows.ways_in_polygon(way_nodes, nodes, way_tags, SQUARE),
        lambda: ways.resolve_ways(way_nodes, nodes),
        lambda: ways.ways_touching(way_nodes, nodes, way_tags, SQUARE),
        lambda: ways.ways_with_nodes(way_nodes, nodes, touching),
    ):
        with pytest.raises(ValueError, match="several nodes"):
            call()


def test_references_of_an_area_are_searched_once(spark):
    """They are stored, so the table of references isn't read again to resolve them."""
    from tracklake.plans import workflows

    nodes = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.0, 5.0)], "id long, lat double, lon double")
    refs = spark.createDataFrame([(7, 0, 1), (7, 1, 2), (8, 0, 2)], "way_id long, pos long, ref long")
    tags = spark.createDataFrame([(7, 0, "highway", "cycleway")], "way_id long, pos long, k string, v string")
    found = workflows.ways_in_polygon(refs, nodes, tags, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("LeftSemi" in line and "way_id" in line for line in plan.splitlines())
    assert sorted(tuple(r) for r in found.collect()) == [(7, 0, 1, 0.5, 0.5), (7, 1, 2, 5.0, 5.0)]
