"""Drawing tables derived from the star-schema test tables.

The test tables hold no drawings. Each recipe is a list of plain integer expressions that
Spark SQL and ANSI SQL engines evaluate alike, so one text serves the query and its check.
Every recipe keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRAWING_OF_LINE = "cast(floor(l_orderkey/8.0) as bigint)"
DRAWING_OF_ORDER = "cast(floor(o_orderkey/8.0) as bigint)"

_OFF = "cast((l_suppkey%6)*1500+(cast(l_quantity as bigint)%3)*200 as bigint)"
_LO = "cast((l_partkey%10)*500 as bigint)"
_HI = "cast((l_partkey%10)*500+800+(l_partkey%7)*700 as bigint)"

RECIPES: dict[str, tuple[str, dict[str, str]]] = {
    # Axis-parallel lines on a wall or a door layer.
    "segments": ("lineitem", {
        "project_id": "cast(floor(l_orderkey/4000.0) as bigint)",
        "drawing_id": DRAWING_OF_LINE,
        "seg_id": "l_orderkey*10000000000+cast(l_linenumber as bigint)*1000000000+l_partkey*10000+l_suppkey",
        "layer": "case when l_returnflag='R' then 'A-DOOR' else 'A-WALL' end",
        "ori": "case when l_linenumber%2=0 then 'H' else 'V' end",
        "off_mm": _OFF, "lo": _LO, "hi": _HI,
        "thickness_mm": "cast(100+(l_partkey%4)*50 as bigint)",
        "x1": f"case when l_linenumber%2=0 then {_LO} else {_OFF} end",
        "y1": f"case when l_linenumber%2=0 then {_OFF} else {_LO} end",
        "x2": f"case when l_linenumber%2=0 then {_HI} else {_OFF} end",
        "y2": f"case when l_linenumber%2=0 then {_OFF} else {_HI} end",
    }),
    # Doors and windows as points with a size, a mark text and a review state.
    "openings": ("orders", {
        "project_id": "cast(floor(o_orderkey/4000.0) as bigint)",
        "drawing_id": DRAWING_OF_ORDER,
        "opening_id": "o_orderkey",
        "kind": "case when o_orderkey%2=0 then 'door' else 'window' end",
        "x": "cast((o_custkey*37)%7000 as bigint)",
        "y": "cast((o_custkey*61+o_orderkey*13)%9000 as bigint)",
        "width_mm": "cast((8+o_orderkey%11)*100 as bigint)",
        "height_mm": "cast((15+o_orderkey%10)*100 as bigint)",
        "status": "o_orderstatus",
        "priority": "o_orderpriority",
    }),
    # Opening marks as texts near the openings, spread over 200 sheets.
    "marks": ("orders", {
        "drawing_id": "cast(o_custkey%200 as bigint)",
        "mark_id": "o_orderkey",
        "kind": "case when o_orderkey%2=0 then 'door' else 'window' end",
        "width_mm": "cast((8+o_orderkey%11)*100 as bigint)",
        "height_mm": "cast((15+o_orderkey%10)*100 as bigint)",
        "x": "cast((o_orderkey*7919)%60000 as bigint)",
        "y": "cast((o_orderkey*104729)%60000 as bigint)",
    }),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def derived(spark: SparkSession, sf_dir: str, recipe: str) -> DataFrame:
    table, columns = RECIPES[recipe]
    return read(spark, sf_dir, table).selectExpr(*[f"{text} as {name}" for name, text in columns.items()])


def derived_sql(recipe: str) -> str:
    table, columns = RECIPES[recipe]
    return "(select " + ", ".join(f"{text} as {name}" for name, text in columns.items()) + f" from {table})"


_N = "(o_custkey%12+1)"
_W = "lpad(cast(8+o_orderkey%11 as string),2,'0')"
_H = "lpad(cast(15+o_orderkey%10 as string),2,'0')"
_BS = "chr(92)"

RECIPES["texts"] = ("orders", {
    "drawing_id": "cast(o_custkey%200 as bigint)",
    "text_id": "o_orderkey",
    "layer": "case when o_orderkey%5=0 then 'A-TITLE' when o_orderkey%5=1 then 'A-WALL-DOOR' when o_orderkey%5=2 then '轴线' else 'S-COL' end",
    "height": "cast(100+(o_custkey%5)*100 as bigint)",
    "x": "cast((o_orderkey*7919)%60000 as bigint)",
    "y": "cast((o_orderkey*104729)%60000 as bigint)",
    "text": f"""case o_orderkey%18
 when 0 then concat('M',{_W},{_H})
 when 1 then concat('{{',{_BS},'fSimSun;TLC-',{_W},' ',{_H},'}}')
 when 2 then concat({_N},'层层高',3+{_N}%3,'.',{_N}%10,'m')
 when 3 then concat('Floor height: ',2800+{_N}*100,'mm')
 when 4 then concat('二层标高 +',{_N}*3,'.600')
 when 5 then concat('屋面 -',{_N},'.450')
 when 6 then concat('LEVEL ',{_N},' EL.',{_N}*3,'.600')
 when 7 then concat({_N},'层平面图')
 when 8 then case {_N}%4 when 0 then 'Ground Floor Plan' when 1 then 'Second  floor plan' when 2 then 'Roof plan' else 'Typical floor notes' end
 when 9 then case {_N}%4 when 0 then '南立面图' when 1 then 'East side elevation 1:100' when 2 then concat({_N},'-',{_N}+3,' 立面图') else 'A面' end
 when 10 then concat('踏步 ',260+{_N},'x',150+{_N}%3,' 共',8+{_N},'级 1层-',{_N},'层')
 when 11 then concat('栏杆高 ',900+{_N}*10,'mm')
 when 12 then concat('女儿墙 高度: 0.',5+{_N}%5,'m')
 when 13 then concat('设计使用年限 ',50+{_N},' 年; C',20+({_N}%5)*5,' 混凝土 抗震设防 ',6+{_N}%4,' 度 耐火等级: 二级 防水')
 when 14 then concat('图名: ',{_N},'-A 剖面图 1:100')
 when 15 then concat({_N}*100,'x',2000+{_N}*10)
 when 16 then concat('地下',{_N},'层 B',{_N},{_BS},'P平面')
 else concat('门表 C',{_W},{_H},' D-',{_W},'-',{_H},' notes') end""",
})

# Component names as a library of types would hold them, one per part and size.
RECIPES["library"] = ("part", {
    "file_id": "p_partkey",
    "file_path": "concat('lib/', case p_partkey%4 when 0 then 'doors' when 1 then 'windows' when 2 then 'columns' else 'misc' end, '/', replace(p_name,' ','_'), case p_partkey%3 when 0 then concat('_',(8+p_partkey%11)*100,'x',(15+p_partkey%10)*100) when 1 then '_double leaf' else '_flush panel' end, '.rfa')",
    "confidence": "cast(p_size%10 as double)/10",
    "summary": "case p_partkey%5 when 0 then 'single leaf glazed door' when 1 then 'sliding window' when 2 then 'double door' else '' end",
})

# Openings spread over 200 large sheets.
RECIPES["sheet_openings"] = ("orders", {
    "drawing_id": "cast(o_custkey%200 as bigint)",
    "opening_id": "o_orderkey",
    "kind": "case when o_orderkey%2=0 then 'door' else 'window' end",
    "x": "cast((o_orderkey*15485863)%60000 as bigint)",
    "y": "cast((o_orderkey*32452843)%60000 as bigint)",
    "width_mm": "cast((8+o_orderkey%11)*100 as bigint)",
    "height_mm": "cast((15+o_orderkey%10)*100 as bigint)",
})

# Plan and elevation openings of 200 projects.
RECIPES["views"] = ("orders", {
    "project_id": "cast(o_custkey%200 as bigint)",
    "id": "o_orderkey",
    "view": "case when o_orderkey%4<2 then 'plan' else 'elevation' end",
    "kind": "case when o_orderkey%2=0 then 'door' else 'window' end",
    "facade": "case o_custkey%3 when 0 then 'south' when 1 then 'north' else case when o_orderkey%3=0 then 'east' else 'west' end end",
    "mark": "case when o_orderkey%5=0 then '' else concat(case when o_orderkey%2=0 then 'M' else 'C' end, lpad(cast(8+o_orderkey%11 as string),2,'0'), lpad(cast(15+o_custkey%4 as string),2,'0')) end",
    "width_mm": "cast((8+o_orderkey%11)*100+o_custkey%3*50 as bigint)",
    "height_mm": "cast((15+o_custkey%4)*100 as bigint)",
    "sill_mm": "case when o_orderkey%4<2 and o_orderkey%3=0 then null else cast((o_orderkey%7)*150 as bigint) end",
    "category": "case when o_orderkey%4<2 then 'unknown' else 'casement_window' end",
    "position": "cast((o_orderkey*7919)%30000 as bigint)",
})

# Doors drawn on details and plans, with a mark, a type and a size.
RECIPES["parts"] = ("orders", {
    "project_id": "cast(floor(o_orderkey/40.0) as bigint)",
    "component_group": "case when o_orderkey%2=0 then 'doors' else 'windows' end",
    "view": "case when o_custkey%4=0 then 'detail' else 'floor_plan' end",
    "id": "o_orderkey",
    "mark": "case when o_custkey%3=0 then '' else concat('M',o_custkey%23) end",
    "type": "case when o_custkey%5=0 then 'unresolved' else concat('type ',o_custkey%13) end",
    "width_mm": "cast((8+o_custkey%9)*100+(o_orderkey%3)*4 as bigint)",
    "height_mm": "case when o_custkey%7=0 then null else cast((20+o_custkey%4)*100 as bigint) end",
    "thickness_mm": "cast(null as bigint)",
    "material": "case when o_custkey%2=0 then null else concat('mat',o_custkey%6) end",
})

# Levels and stairs of projects.
RECIPES["storeys"] = ("nation", {
    "project_id": "cast(n_nationkey%5 as bigint)",
    "level_id": "concat('LEVEL-',lpad(cast(n_nationkey as string),3,'0'))",
    "name": "concat('L',cast(floor(n_nationkey/5) as int))",
    "number": "cast(floor(n_nationkey/5) as int)",
    "elevation_mm": "cast(floor(n_nationkey/5)*3300+n_nationkey%5*100 as bigint)",
})
RECIPES["stairs"] = ("supplier", {
    "project_id": "cast(s_suppkey%5 as bigint)",
    "id": "s_suppkey",
    "span": "cast(s_suppkey%7 as int)",
    "total_rise_mm": "cast((s_suppkey%7+1)*3300 as bigint)",
    "risers": "cast((s_suppkey%7+1)*20+s_suppkey%3 as bigint)",
    "treads": "cast((s_suppkey%7+1)*18 as bigint)",
    "run_count": "cast(1+s_suppkey%2 as bigint)",
    "tread_mm": "cast(260+s_suppkey%4*10 as bigint)",
    "riser_mm": "cast(150+s_suppkey%9*5 as bigint)",
    "landing_mm": "cast(1200 as bigint)",
    "z0": "cast(s_suppkey%4*3300+s_suppkey%3*60 as bigint)",
})

# Components of all groups with faults, states and materials.
RECIPES["components"] = ("orders", {
    "project_id": "cast(o_custkey%50 as bigint)",
    "component_group": "case o_orderkey%6 when 0 then 'walls' when 1 then 'doors' when 2 then 'windows' when 3 then 'columns' when 4 then 'slabs' else 'railings' end",
    "id": "concat('C-',case when o_custkey%97=0 then '' else cast(o_orderkey as string) end)",
    "ord": "o_orderkey",
    "level": "case when o_custkey%13=0 then '' else concat('L',o_orderkey%4) end",
    "type": "case when o_orderkey%4=0 then 'short_paired_wall_lines' else 'generic' end",
    "width_mm": "case when o_orderkey%17=0 then null else cast((o_orderkey%11)*100 as bigint) end",
    "height_mm": "case when o_orderkey%19=0 then null else cast((15+o_orderkey%10)*100 as bigint) end",
    "depth_mm": "case when o_orderkey%5=0 then null else cast(300 as bigint) end",
    "diameter_mm": "case when o_orderkey%7=0 then cast(400 as bigint) end",
    "thickness_mm": "cast((o_custkey%5)*60 as bigint)",
    "x": "case when o_orderkey%23=0 then null else cast((o_custkey*37)%7000 as bigint) end",
    "y": "cast((o_custkey*61)%9000 as bigint)",
    "review_status": "case o_orderstatus when 'F' then 'ready' when 'O' then 'needs_review' else case when o_orderkey%3=0 then 'rejected' else 'odd' end end",
    "modeling_status": "case when o_orderkey%29=0 then 'Blocked' else 'ok' end",
    "execution_scope": "case when o_orderkey%31=0 then 'review_only' else '' end",
    "confidence": "cast(o_custkey%105 as double)/100",
    "source": "case when o_custkey%8=0 then 'default_floor' else 'wall_lines' end",
    "notes": "case when o_orderkey%10=0 then 'height inferred' else '' end",
    "material": "case o_orderkey%5 when 0 then '' when 1 then 'Brick' when 2 then 'C30混凝土' when 3 then 'solid wood' else 'steel' end",
    "material_source": "case when o_orderkey%4=0 then 'ai_suggested_default' when o_orderkey%4=1 then 'design_notes' else '' end",
    "material_confidence": "cast(o_orderkey%100 as double)/100",
    "material_needs_review": "o_orderkey%14=0",
    "drawing_type": "case o_custkey%5 when 0 then 'elevation' when 1 then 'detail' else 'floor_plan' end",
    "drawing_name": "case when o_orderkey%3=0 then 'Stair plan 2' else 'Plan' end",
})

# Design notes: one per customer, several per project.
RECIPES["notes"] = ("customer", {
    "project_id": "cast(c_custkey%50 as bigint)",
    "text": "concat('窗台高 ',850+c_custkey%3*50,'mm；外墙厚 ',180+c_custkey%4*20,'；门 ',800+c_custkey%5*100,'x',2+c_custkey%2,'100mm；层高 ',3+c_custkey%2,'.',c_custkey%3*3,'m；屋面坡度 ',2+c_custkey%3,'%；栏杆高 1.1米；墙采用', case c_custkey%50%3 when 0 then '砖' when 1 then '混凝土' else '玻璃' end, '砌筑')",
})
