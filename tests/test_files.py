"""Reading and writing of files."""

import json

from pyspark.sql import functions as F

from draftloom import schemas
from draftloom.sinks import publish as p
from draftloom.sources import drawings as dw
from draftloom.sources import tables as tb


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def code_lines(*pairs):
    return "".join(f"  {c}\n{v}\n" for c, v in pairs)


def drawing(path):
    blocks = [(0, "SECTION"), (2, "BLOCKS"), (0, "BLOCK"), (2, "DOOR1"), (10, 100), (20, 0), (0, "LINE"), (8, "LEAF"), (10, 100), (20, 0), (11, 1000), (21, 0), (0, "ARC"), (8, "LEAF"), (10, 100), (20, 0), (40, 900), (50, 0), (51, 90), (0, "ENDBLK"), (0, "ENDSEC")]
    body = [
        (0, "SECTION"), (2, "ENTITIES"), (0, "LINE"), (8, "A-WALL"), (10, 5000), (20, 0), (11, 0), (21, 0), (0, "CIRCLE"), (8, "COL"), (10, 1), (20, 2), (40, 0), (0, "CIRCLE"), (8, "COL"), (10, 1), (20, 2), (40, 250),
        (0, "LWPOLYLINE"), (8, "FRAME"), (70, 1), (10, 0), (20, 0), (10, 10), (20, 0), (10, 10), (20, 10), (0, "POLYLINE"), (8, "OLD"), (70, 1), (0, "VERTEX"), (10, 1), (20, 1), (0, "VERTEX"), (10, 2), (20, 2), (0, "SEQEND"),
        (0, "MTEXT"), (3, "first "), (1, "second"), (10, 7), (20, 8), (40, 250), (0, "INSERT"), (8, "A-DOOR"), (2, "DOOR1"), (10, 2000), (20, 300), (41, -1), (0, "SPLINE"), (10, 3), (0, "ENDSEC"), (0, "EOF"),
    ]
    path.write_text(code_lines(*blocks, *body) + "odd", encoding="utf-8")


def test_drawing_file(spark, tmp_path):
    drawing(tmp_path / "a.dxf")
    tags = dw.read_tags(spark, str(tmp_path / "a.dxf"))
    found = sorted(rows(dw.read_entities(tags)), key=lambda r: r["ord"])
    assert [r["etype"] for r in found] == ["LINE", "CIRCLE", "LWPOLYLINE", "POLYLINE", "MTEXT", "INSERT"]
    assert found[2]["closed"] and len(found[2]["points"]) == 3 and len(found[3]["points"]) == 2 and found[4]["text"] == "firstsecond"
    assert (found[5]["sx"], found[5]["sy"]) == (-1, 1)
    boxes, children = dw.read_blocks(tags)
    placed, parts = dw.place_blocks(dw.read_entities(tags), boxes, children)
    r = rows(placed)[0]
    assert (r["bx0"], r["bx1"], r["by0"], r["by1"]) == (1100, 2900, -600, 1200) and (r["cx"], r["cy"]) == (2000, 300) and r["block_layers"] == ["LEAF"]
    arc = next(x for x in rows(parts) if x["etype"] == "ARC")
    assert (round(arc["a0"]), round(arc["a1"])) == (90, 180)
    seg = sorted(rows(dw.segments(dw.read_entities(tags))), key=lambda s: s["ord"])
    assert len(seg) == 5 and (seg[0]["x1"], seg[0]["x2"]) == (0, 5000)


def test_a_drawing_is_read_by_many_tasks(spark, tmp_path):
    """Byte ranges and small chunks give what one chunk gives, also where a pair, a section or a polyline is cut."""
    drawing(tmp_path / "a.dxf")
    body = (tmp_path / "a.dxf").read_text(encoding="utf-8").removesuffix("odd")
    (tmp_path / "b.dxf").write_text(code_lines((999, "note")) + body.replace("\n", "\r\n"), encoding="utf-8", newline="")
    files = spark.createDataFrame([(f"{n}.dxf", (tmp_path / f"{n}.dxf").read_bytes().decode()) for n in "ab"], "file string, value string")

    def everything(tags):
        name = F.element_at(F.split("file", "/"), -1)
        numbered = dw.number_tags(tags.withColumn("file", name))
        boxes, children = dw.read_blocks(numbered)
        return [sorted(map(str, df.drop("chunk").collect())) for df in (numbered, dw.read_entities(numbered), boxes, children)]

    whole = everything(dw.tags_of(files))
    assert len(whole[1]) == 12 and len(whole[2]) == 2
    for size in (1, 5):
        assert everything(dw.tags_of(files, size)) == whole
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (61,):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            tags = dw.read_tags(spark, [str(tmp_path / "a.dxf"), str(tmp_path / "b.dxf")])
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept["spark.sql.files.maxPartitionBytes"])
            assert tags.select("chunk").distinct().count() > 5
            assert everything(tags) == whole
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_element_tables(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "Doors.csv").write_text("Element_ID,Width, Center_X,Center_Y,Host-Wall ID,Needs_Review\nD1,900 mm,10,20, W1 ,false\nD2,,,,,true\n", encoding="utf-8")
    (tmp_path / "墙.csv").write_text("id,start,end\nW1,\"(0, 0)\",\"(10, 5)\"\n", encoding="utf-8")
    found = tb.read_element_tables(spark, str(tmp_path))
    assert {"doors", "walls"} <= set(found)
    doors = sorted(rows(tb.normalized_components(found["doors"], "doors")), key=lambda r: (r["id"], r["confidence"]))
    assert len(doors) == 4 and doors[0]["width_mm"] == 900 and doors[0]["host_wall_id"] == "W1" and doors[0]["review_status"] == "ready" and doors[3]["review_status"] == "needs_review"
    wall = rows(tb.normalized_components(found["walls"], "walls"))[0]
    assert (wall["x1"], wall["x2"], wall["y2"]) == (0, 10, 5)


def test_tables_with_other_column_orders(spark, tmp_path):
    for name, head, row in (("p1", "id,width,height", "D1,900,2100"), ("p 2", "id,height,width", "D2,2000,800"), ("p3", "id,width,height", "D3,700,1900")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "doors.csv").write_text(f"{head}\n{row}\n", encoding="utf-8")
    doors = tb.read_element_tables(spark, str(tmp_path))["doors"]
    assert {(r["id"], r["width"], r["height"]) for r in rows(doors)} == {("D1", "900", "2100"), ("D2", "800", "2000"), ("D3", "700", "1900")}


def test_model_and_library(spark, tmp_path):
    model = {"components": {"columns": [{"id": "C1", "center": {"x": 5, "y": "6"}, "base_z_mm": 0, "top_z_mm": 3000, "confidence": "high"}], "slabs": [{"id": "S1", "boundary": [{"x": 0, "y": 0, "z": 0}, {"x": 1, "y": 0, "z": 0}, {"x": 1, "y": 1, "z": 0}]}, {"id": "S2", "boundary": "[[0,0],[2,0],[2,2]]"}]}}
    (tmp_path / "m.json").write_text(json.dumps({"source_model": model, "human_approval": {"execution_allowed": True}}), encoding="utf-8")
    items = tb.read_model(spark, str(tmp_path / "m.json"))
    assert {r["execution_allowed"] for r in rows(items)} == {True}
    found = {r["id"]: r for r in rows(tb.model_fields(items))}
    assert (found["C1"]["x"], found["C1"]["y"], found["C1"]["height_mm"], found["C1"]["confidence"]) == (5, 6, 3000, 0.9)
    assert len(found["S1"]["boundary"]) == 3 and len(found["S2"]["boundary"]) == 3 and found["S2"]["boundary"][1]["x"] == 2
    lib = tmp_path / "lib" / "doors"
    lib.mkdir(parents=True)
    (lib / "category_index.json").write_text(json.dumps({"component_group": "doors", "semantic_descriptions": [{"family_file": "a/Single.rfa", "visual_summary": "flush door", "confidence": 0.8}, {"family_file": ""}]}), encoding="utf-8")
    r = rows(tb.read_type_library(spark, str(tmp_path / "lib")))
    assert len(r) == 1 and r[0]["file_path"].endswith("doors/a/Single.rfa") and r[0]["category"] == "doors" and r[0]["file_id"] == "Single.rfa"
    (tmp_path / "n.txt").write_text("设计使用年限 50 年", encoding="utf-8")
    assert rows(tb.read_notes(spark, str(tmp_path / "n.txt")))[0]["text"].startswith("设计")


def test_schemas_and_sinks(spark, tmp_path):
    assert len(schemas.TABLES) == 26
    assert schemas.columns("Walls")[:6] == ["Element_ID", "Element_Name", "Project_ID", "Drawing_ID", "Level_ID", "Wall_Type"] and len(schemas.columns("Doors")) == 47
    assert all(len(c) == len(set(c)) and not any(x.startswith("@") for x in c) for c in map(schemas.columns, schemas.TABLES))
    walls = spark.createDataFrame([("P", "D1", 1, "W0001", 1, 10.0, 0.0, 20.0, 0.0, 200.0, None, "paired_wall_lines", 0.95), ("P", "D1", 1, "W0002", 2, 0.0, 0.0, 5.0, 0.0, 100.0, 2800.0, "paired_wall_lines", 0.95)],
                                  "project_id string, drawing_id string, drawing_no int, id string, ord int, x1 double, y1 double, x2 double, y2 double, thickness_mm double, height_mm double, recognition_source string, confidence double")
    levels = spark.createDataFrame([("P", "D1", "LEVEL-001")], "project_id string, drawing_id string, level_id string")
    table = p.walls_table(walls, levels)
    found = {r["Element_ID"]: r for r in rows(table)}
    assert found["WALL-001"]["Start_X"] == "0.0" and found["WALL-002"]["Height"] == "3000.0" and found["WALL-002"]["Needs_Review"] == "true" and found["WALL-001"]["Grid_Start"] == ""
    p.write_tables({"Walls": table}, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out" / "Walls"), header=True)
    assert back.columns == schemas.columns("Walls") and back.count() == 2
    records = p.element_records({"Walls": table})
    p.write_records(records, str(tmp_path / "records"))
    lines = [json.loads(r["value"]) for r in rows(spark.read.text(str(tmp_path / "records")))]
    assert {x["record_id"] for x in lines} == {"WALL-001", "WALL-002"} and lines[0]["geometry"]["type"] == "line" and all("material" not in x for x in lines)
    p.write_drawing_extracts({"Walls": table}, str(tmp_path / "extracts"))
    assert spark.read.csv(str(tmp_path / "extracts" / "Walls"), header=True).where("Drawing_ID = 'D1'").count() == 2
    assert [r["Status"] for r in rows(p.manifest({"Walls": table, "Beams": table.where(F.lit(False))}))] == ["success", "empty"]
