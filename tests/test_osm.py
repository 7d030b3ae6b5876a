import os
import random
import re

import pytest

from tracklake import schemas
from tracklake.operators import ways
from tracklake.operators.runs import clip_tracks
from tracklake.plans import workflows
from tracklake.session import materialize
from tracklake.sources import osm

XML = """<osm><bounds minlon="1" maxlon="2" minlat="1" maxlat="2"/>
<node id="1" lat="1.0" lon="2.0"/><node id="2" lat="1.5" lon="2.5"><tag k="a" v="b"/></node>
<way id="7"><nd ref="1"/><nd ref="2"/><tag k="name" v="z"/><tag k="highway" v="cycleway"/></way>
<way id="8"><nd ref="2"/><tag k="highway" v="primary"/></way>
<node id="1" lat="9.0" lon="9.0"/>
<relation id="9"/></osm>
"""
JSON = """{"version":0.6,"elements":[{"type":"node","id":1,"lat":1.0,"lon":2.0},
 {"type":"node","id":2,"lat":1.5,"lon":2.5},{"type":"way","id":7,"nodes":[1,2,1]},
 {"type":"node","id":1,"lat":9.0,"lon":9.0}]}"""
SQUARE = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("splittable", [False, True])
def test_xml(spark, tmp_path, splittable):
    (tmp_path / "map.osm").write_text(XML)
    read = osm.read_osm_xml(spark, str(tmp_path), splittable)
    assert rows(read.nodes, "id", "lat", "lon") == [(1, 1.0, 2.0), (1, 9.0, 9.0), (2, 1.5, 2.5)]
    assert rows(read.ways, "way_id") == [(7,), (8,)]
    assert rows(read.way_nodes, "way_id", "pos", "ref") == [(7, 0, 1), (7, 1, 2), (8, 0, 2)]
    assert rows(read.way_tags, "way_id", "pos", "k", "v") == [
        (7, 0, "name", "z"),
        (7, 1, "highway", "cycleway"),
        (8, 0, "highway", "primary"),
    ]
    assert rows(read.relations, "id") == [(9,)]
    resolved = ways.resolve_ways(read.way_nodes, read.nodes, node_order="doc_order")
    assert rows(resolved, "way_id", "lat") == [(7, 1.5), (7, 9.0), (8, 1.5)]


def test_large_xml_is_split(spark, tmp_path):
    """Splits of any size give the same tables, also in the middle of a way."""
    lines = [f'<node id="{i}" lat="{i % 90}.5" lon="-1"/>' for i in range(2000)]
    lines += [
        '<node id="5000" lat="1" lon="2"><tag k="x" v="y"/></node>',
        "<way id='1'>" + "".join(f"<nd ref='{i}'/>" for i in range(1500)) + "<tag k='highway' v='path'/></way>",
        '<way id="2"/>',
        '<way\n  id="3"\tvisible="true" ><nd ref="7" /><nd ref="7"/>',
        '<tag k="name" v="a &gt; b &quot;c&quot; &#228; > / d=\'k\'"/><tag k="highway" v="cycleway"/></way>',
        '<relation id="9"><tag k="highway" v="cycleway"/></relation>',
    ]
    for n in range(2):
        (tmp_path / f"{n}.osm").write_text("<?xml version='1.0'?>\n<osm>\n" + "\n".join(lines) + "\n</osm>\n")
    whole = osm.read_osm_xml(spark, str(tmp_path))
    expected = {
        "nodes": rows(whole.nodes, "id", "lat", "lon"),
        "ways": rows(whole.ways, "way_id"),
        "way_nodes": rows(whole.way_nodes, "way_id", "pos", "ref"),
        "way_tags": rows(whole.way_tags, "way_id", "pos", "k", "v"),
        "relations": rows(whole.relations, "id"),
    }
    assert len(expected["nodes"]) == 4002 and len(expected["way_tags"]) == 6
    for size in (3001, 20000, 10**8):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            read = osm.read_osm_xml(spark, str(tmp_path), splittable=True)
            assert {
                "nodes": rows(read.nodes, "id", "lat", "lon"),
                "ways": rows(read.ways, "way_id"),
                "way_nodes": rows(read.way_nodes, "way_id", "pos", "ref"),
                "way_tags": rows(read.way_tags, "way_id", "pos", "k", "v"),
                "relations": rows(read.relations, "id"),
            } == expected
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json(spark, tmp_path):
    (tmp_path / "map.json").write_text(JSON)
    read = osm.read_osm_json(spark, str(tmp_path))
    assert rows(read.nodes, "id", "lat", "lon") == [(1, 1.0, 2.0), (1, 9.0, 9.0), (2, 1.5, 2.5)]
    assert rows(read.way_nodes, "way_id", "pos", "ref") == [(7, 0, 1), (7, 1, 2), (7, 2, 1)]
    resolved = ways.resolve_ways(read.way_nodes, read.nodes, node_order="doc_order")
    assert rows(resolved, "pos", "lat") == [(0, 9.0), (1, 1.5), (2, 9.0)]


def exported(spark):
    track = lambda t, pattern: [
        (t, i, 5.0 + i / 8 if c == "i" else 50.0, 5.0, 0) for i, c in enumerate(pattern)
    ]
    df = spark.createDataFrame(track(1, "iooooiio") + track(2, "oi"), schemas.POSITIONS)
    return osm.export_osm(materialize(clip_tracks(df, SQUARE)))


def same_tables(one, other):
    assert rows(one.nodes, "id", "lat", "lon") == rows(other.nodes, "id", "lat", "lon")
    assert rows(one.way_nodes, "way_id", "pos", "ref") == rows(other.way_nodes, "way_id", "pos", "ref")
    assert rows(one.way_tags, "way_id", "pos", "k", "v") == rows(other.way_tags, "way_id", "pos", "k", "v")


def test_export_as_xml_round_trip(spark, tmp_path):
    tables = osm.export_tables(exported(spark))
    osm.write_osm_xml(tables, str(tmp_path / "map"))
    same_tables(osm.read_osm_xml(spark, str(tmp_path / "map"), splittable=True), tables)


def test_document_of_odd_elements(spark, tmp_path):
    """Untagged and empty ways, line breaks in texts; a missing attribute fails instead of vanishing."""
    def of(rows, schema):
        return spark.createDataFrame(rows, schema)

    tables = ways.MapTables(
        nodes=of([(1, 1.5, 2.5)], "id long, lat double, lon double"),
        ways=of([(10,), (11,), (12,), (13,)], "way_id long"),
        way_nodes=of([(10, 0, 1), (11, 0, 1), (11, 1, 1), (12, 0, 1)], "way_id long, pos long, ref long"),
        way_tags=of([(10, 0, "a", "x\ny\tz\r\"<&'>"), (12, 0, "b", " ")], "way_id long, pos long, k string, v string"),
    )
    osm.write_osm_xml(tables, str(tmp_path / "parts"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "map.osm").write_text(text)
    for path, splittable in (("parts", True), ("whole", True), ("whole", False)):
        read = osm.read_osm_xml(spark, str(tmp_path / path), splittable)
        same_tables(read, tables)
        assert rows(read.ways, "way_id") == rows(tables.ways, "way_id")
    for lacking in ([(None, 1.0, 1.0)], [(1, None, 1.0)]):
        broken = ways.MapTables(of(lacking, "id long, lat double, lon double"), tables.ways, tables.way_nodes, tables.way_tags)
        with pytest.raises(Exception, match="lacks an attribute"):
            osm.write_osm_xml(broken, str(tmp_path / f"broken{lacking[0][0]}"))


SECTIONS = ["<!-- {} -->", "<![CDATA[{}]]>", "<?x {} ?>"]


def all_tables(read):
    columns = {"nodes": ["id", "lat", "lon"], "ways": ["way_id"], "way_nodes": ["way_id", "pos", "ref"], "way_tags": ["way_id", "pos", "k", "v"], "relations": ["id"]}
    return {name: rows(getattr(read, name), *of) for name, of in columns.items()}


@pytest.mark.parametrize("section", SECTIONS)
def test_sections_in_split_documents(spark, tmp_path, section):
    """What lies in a section is text, with tags in it or without."""
    (tmp_path / "map.osm").write_text(XML)
    expected = all_tables(osm.read_osm_xml(spark, str(tmp_path / "map.osm")))
    for n, inside in enumerate(("a > b - c", '<node id="9" lat="1" lon="1"/>', "<way id='5'><nd ref='1'/>", "<a <b <!- <![CDATA <? ")):
        path = tmp_path / f"{n}.osm"
        path.write_text(XML.replace("<relation", section.format(inside) + "<relation").replace('<nd ref="', section.format(inside) + '<nd ref="'))
        assert all_tables(osm.read_osm_xml(spark, str(path), splittable=True)) == expected


def test_sections_over_many_splits(spark, tmp_path):
    """Long sections, sections within sections and their ends outside of any, in splits of any size."""
    draw = random.Random(3)
    parts = []
    for i in range(900):
        parts.append(f'<node id="{i}" lat="{i % 90}.5" lon="-1"/>')
        kind = draw.randrange(4)
        if kind < 3:
            inside = [f'<node id="{10_000 + i}" lat="1" lon="1"/>', "<way id='1'><nd ref='3'/>", " <!- - x ", "<![CDATA[ " if kind != 1 else "<!-", "text > ", "<? y "]
            parts.append(SECTIONS[kind].format("".join(draw.choices(inside, k=draw.choice([1, 3, 40])))))
        elif i % 5 == 0:
            parts.append(f'<way id="{i}"><nd ref="{i}"/>]]> --&gt; ?&gt;<!-- <nd ref="77"/> --><nd ref="{i}"/><tag k="highway" v="path"/></way>'.replace("]]> ", "]]&gt; "))
    (tmp_path / "map.osm").write_text("<?xml version='1.0'?>\n<osm>\n" + "\n".join(parts) + "\n</osm>\n")
    expected = all_tables(osm.read_osm_xml(spark, str(tmp_path)))
    assert len(expected["nodes"]) == 900 and expected["way_nodes"]
    for size in (1500, 20_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            assert all_tables(osm.read_osm_xml(spark, str(tmp_path), splittable=True)) == expected
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_export_as_one_document(spark, tmp_path):
    elements = exported(spark)
    osm.write_osm_document(elements, str(tmp_path / "parts"), partitions=5)
    parts = sorted(p for p in os.listdir(tmp_path / "parts") if p.startswith("part-"))
    assert len(parts) > 1
    text = "".join((tmp_path / "parts" / p).read_text() for p in parts)
    lines = text.splitlines()
    assert lines[0] == '<osm><bounds minlon="5.0" maxlon="5.0" minlat="5.0" maxlat="50.0"/>'
    assert lines[1] == '<node id="0" lat="50.0" lon="5.0"/>' and lines[-1] == "</osm>"
    same_tables(
        osm.read_osm_xml(spark, str(tmp_path / "parts"), splittable=True), osm.export_tables(elements)
    )
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "map.osm").write_text(text)
    same_tables(osm.read_osm_xml(spark, str(tmp_path / "whole")), osm.export_tables(elements))


def test_export_only_if_changed(spark):
    rows_ = [(1, i, 5.0 + i / 8, 5.0, 0) for i in range(4)]
    first, known = workflows.export_if_changed(spark.createDataFrame(rows_, schemas.POSITIONS), SQUARE)
    assert first.where("kind = 'node'").count() == 4
    again = spark.createDataFrame(rows_[::-1], schemas.POSITIONS)
    assert workflows.export_if_changed(again, SQUARE, known) is None
    moved = spark.createDataFrame([*rows_[:3], (1, 3, 6.0, 5.0, 0)], schemas.POSITIONS)
    assert workflows.export_if_changed(moved, SQUARE, known)[1] != known
    assert workflows.export_if_changed(again.where("false"), SQUARE, known) is None


def test_sections_shuffle_the_pieces_once(spark, monkeypatch):
    """What is known of the pieces that open or close a section is not joined with all pieces."""
    from tracklake.sources import xml_sections

    rows = [("f", 0, 0, "a", 0, 0), ("f", 0, 1, "", 1, 0), ("f", 0, 2, "b", 0, 0), ("f", 0, 3, "c", 0, 2), ("f", 9, 1, "d", 0, 0)]
    pieces = spark.createDataFrame(rows, "file string, start long, row long, name string, opened int, closed int")
    monkeypatch.setattr(xml_sections, "materialize", lambda df: df)
    found = xml_sections.outside(pieces)
    assert not re.search(r"Join .*row#\d+L? = row#", found._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(r.name for r in found.collect()) == ["", "a", "d"]
