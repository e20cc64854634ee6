"""Queries over texts: derived sheet texts and the whole documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftloom.functions import semantics as sem
from draftloom.functions import text as t
from draftloom.functions import values as v
from draftloom.plans.derived import derived, derived_sql, read
from draftloom.plans.registry import query

TEXTS = derived_sql("texts")


def texts(spark, sf_dir):
    return derived(spark, sf_dir, "texts")


CLEAN = f"""(select *, trim(regexp_replace(translate(regexp_replace(regexp_replace(replace(text, chr(92)||'P', chr(10)), '\\\\[A-Za-z]+[0-9.+-]*;?', '', 'g'), '\\|[^;\\n]{{1,120}};', '', 'g'), '{{}}', ''), '\\s+', ' ', 'g')) plain from {TEXTS})"""


@query("clean_texts", "T1", f"select text_id, plain from {CLEAN}")
def clean_texts(spark, sf_dir):
    return texts(spark, sf_dir).select("text_id", t.clean_cad_text("text").alias("plain"))


@query("layer_classes", "T2", f"""select layer, count(*) n, regexp_matches(layer,'(?i)(wall|墙|a[-_]?wall|buildwall)') is_wall, regexp_matches(layer,'(?i)(door|门|a[-_]?door)') is_door,
 regexp_matches(layer,'(?i)(axis|grid|轴|轴线|a[-_]?grid|center)') is_axis, regexp_matches(layer,'(?i)(column|col|pillar|柱|a[-_]?col|a[-_]?column)') is_column from {TEXTS} group by layer""")
def layer_classes(spark, sf_dir):
    kinds = ("wall", "door", "axis", "column")
    counted = texts(spark, sf_dir).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("layer", "n", *[F.array_contains(t.layer_classes("layer"), k).alias(f"is_{k}") for k in kinds])


MARKS = f"""m0 as (select text_id, regexp_replace(replace(replace(regexp_replace(upper(text), '\\{{[^;]*;', '', 'g'), '}}', ''), chr(92)||'P', ' '), '[^A-Z0-9]+', ' ', 'g') s from {TEXTS}),
 m1 as (select text_id, unnest(regexp_extract_all(' '||replace(s,' ','  ')||' ', '[^A-Z0-9]((?:WINDOW|DOOR|TLM|TLC|PKC|WIN|SD|DD|SW|CW|D|M|C|W) *[0-9]{{2}} *[0-9]{{2}})[^A-Z0-9]', 1)) f from m0),
 m2 as (select text_id, replace(f,' ','') mark, case when regexp_extract(f,'^[A-Z]+') in ('D','M','TLM','SD','DD','DOOR') then 'door' else 'window' end kind,
  cast(substr(regexp_replace(f,'[^0-9]','','g'),1,2) as int)*100 width_mm, cast(substr(regexp_replace(f,'[^0-9]','','g'),3,2) as int)*100 height_mm from m1),
 marks as (select * from m2 where width_mm between 300 and 6000 and height_mm between case kind when 'door' then 1500 else 300 end and 3600)"""


@query("marks_parsed", "T3", f"with {MARKS} select text_id, mark, kind, width_mm, height_mm from marks")
def marks_parsed(spark, sf_dir):
    found = texts(spark, sf_dir).select("text_id", F.explode(t.opening_marks("text")).alias("m"))
    return found.select("text_id", F.col("m.text").alias("mark"), "m.kind", "m.width_mm", "m.height_mm")


@query("model_marks", "T4", f"""with c as (select text_id, translate(upper(regexp_extract(trim(replace(regexp_replace(text,'\\\\[Pp]','','g'),chr(92),'')), '[A-Za-z一-鿿]+[-_]?\\d{{3,4}}(?:[-_]?\\d{{2,4}})?')),'-_','') mark from {TEXTS})
 select text_id, mark, case when regexp_matches(mark,'^[A-Z一-鿿]+\\d{{4}}$') or regexp_matches(mark,'^[A-Z一-鿿]+\\d{{6,8}}$') then regexp_extract(mark,'^([A-Z一-鿿]+)',1) else regexp_replace(mark,'\\d+','','g') end prefix,
 cast(case when regexp_matches(mark,'^[A-Z一-鿿]+\\d{{4}}$') then cast(regexp_extract(mark,'(\\d\\d)\\d\\d$',1) as int)*100 when regexp_matches(mark,'^[A-Z一-鿿]+\\d{{6,8}}$') then cast(regexp_extract(mark,'^[A-Z一-鿿]+(\\d{{3,4}})(\\d{{3,4}})$',1) as int) end as bigint) width_mm from c""")
def model_marks(spark, sf_dir):
    cleaned = texts(spark, sf_dir).select("text_id", sem.clean_mark("text").alias("mark")).withColumn("s", sem.mark_size("mark"))
    return cleaned.select("text_id", "mark", "s.prefix", F.col("s.width_mm").cast("bigint").alias("width_mm"))


TITLE = f"""t0 as (select *, trim(text) tx, trim(regexp_extract(trim(text),'^[^\\n。；;]*')) fc from {TEXTS}),
 t1 as (select *, coalesce(nullif(regexp_replace(regexp_extract(fc,'((?:东|西|南|北|正|背|左|右)\\s*(?:立面图|立面|面图|面))',1),'\\s+','','g'),''),
  nullif(regexp_replace(regexp_extract(fc,'([A-Za-z0-9]+[-~]?[A-Za-z0-9]*\\s*(?:立面图|立面|面图|面))',1),'\\s+','','g'),''),
  nullif(regexp_extract(fc,'(?i)((?:north|south|east|west)[^\\n;]{{0,24}}(?:elevation|facade))',1),''),
  nullif(trim(regexp_extract(tx,'(?i)(?:图名|图纸名称|drawing\\s*(?:title|name))\\s*[:：]\\s*(.+)',1)),''),
  nullif(regexp_replace(regexp_extract(fc,'(?i)\\b(?:(?:lower\\s+ground|ground|basement|mezzanine|roof|typical|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|\\d+(?:st|nd|rd|th)?)\\s+)?floor\\s+plan\\b'),'\\s+',' ','g'),''),
  case when contains(tx,'平面图') then '平面图' when contains(tx,'剖面图') then '剖面图' when contains(lower(tx),'elevation') then 'elevation' end, fc) title from t0)"""


@query("title_texts", "T5", f"with {TITLE} select text_id, title from t1")
def title_texts(spark, sf_dir):
    return texts(spark, sf_dir).select("text_id", t.title_text("text").alias("title"))


_WORDS = "+".join(f"case when contains(lower(title),'{k}') then {6 if len(k) >= 4 else 3} else 0 end" for k in t.TITLE_KEYWORDS)
SCORES = f"""{TITLE}, t2 as (select *, {_WORDS} + case when regexp_matches(lower(layer),'(title|name|图名|图签|标题)') then 4 else 0 end
  + case when regexp_matches(title,'(^|\\s)[A-Z]?\\d+[-~]?[A-Z]?\\d*\\s*(层|平面图)') then 4 else 0 end + case when regexp_matches(tx,'^\\s*(图名|图纸名称)\\s*[:：]') then 8 else 0 end sig from t1),
 t3 as (select *, case when length(title) between 2 and 80 and sig>0 then sig + case when height>=200 then least(4.0,height/150.0) else 0 end
  - case when regexp_matches(lower(title),'^\\s*(设计|校对|审核|审定|date|scale|project)\\s*[:：]?') then 6 else 0 end
  - case when regexp_matches(lower(title),'(slope|1[:/]\\d+|%|耐火等级|材料|标高)') then 8 else 0 end
  - case when length(title)<=4 and not regexp_matches(title,'[图说明]') then 3 else 0 end else 0 end score from t2)"""


def _scored(spark, sf_dir):
    return texts(spark, sf_dir).withColumn("title", t.title_text("text")).withColumn("score", t.title_score("text", "layer", "height", "title"))


@query("title_scores", "T6", f"with {SCORES} select text_id, round(score,3) score from t3")
def title_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("text_id", F.round("score", 3).alias("score"))


@query("drawing_titles", "W11 O3", f"""with {SCORES}, r as (select *, row_number() over (partition by drawing_id order by score desc, height desc, y desc, text_id) rn from t3 where score>0)
 select drawing_id, cast(rn as int) "rank", text_id, title, round(score,3) score, round(least(0.98, 0.45+score/20),3) confidence from r where rn<=5""")
def drawing_titles(spark, sf_dir):
    from draftloom.operators.ordered import top_k

    order = [F.col("score").desc(), F.col("height").desc(), F.col("y").desc(), F.col("text_id")]
    best = top_k(_scored(spark, sf_dir).where("score > 0"), ["drawing_id"], order, 5)
    return best.select("drawing_id", "rank", "text_id", "title", F.round("score", 3).alias("score"), F.round(F.least(F.lit(0.98), 0.45 + F.col("score") / 20), 3).alias("confidence"))


def _score_sql(words, column):
    return "+".join(f"(length({column})-length(replace({column},'{w.lower()}','')))//{len(w)}*{3 if len(w) >= 4 else 1}" for w in words)


_TYPE_SCORES = ",".join(f"{_score_sql(words, 's')} {kind}" for kind, words in t.DRAWING_KEYWORDS.items())


@query("keyword_scores", "T7", f"select text_id, {_TYPE_SCORES} from (select *, lower(text) s from {TEXTS})")
def keyword_scores(spark, sf_dir):
    return texts(spark, sf_dir).select("text_id", t.drawing_scores("text").alias("s")).select("text_id", "s.*")


_CLASSIFY = """case when general_notes>=6 and n>=40 and general_notes>=architectural_plan then 'general_notes' when n>=80 and general_notes>=3 then 'general_notes'
 when top='architectural_elevation' and best>=2 then top when best>=3 then top when geo>=6 and geo>=general_notes then 'architectural_plan'
 when architectural_plan>=2 and geo>=2 then 'architectural_plan' else 'mixed_or_unknown' end"""
_TOP = """greatest(architectural_plan,architectural_elevation,architectural_detail,architectural_section,general_assembly) best,
 case greatest(architectural_plan,architectural_elevation,architectural_detail,architectural_section,general_assembly) when architectural_plan then 'architectural_plan' when architectural_elevation then 'architectural_elevation'
 when architectural_detail then 'architectural_detail' when architectural_section then 'architectural_section' else 'general_assembly' end top"""


@query("drawing_type", "T7 R1", f"""with s as (select doc_id, length(replace(text, chr(10), '')) n, doc_id%10 geo, {_TYPE_SCORES} from (select *, lower(text) s from documents)), b as (select *, {_TOP} from s)
 select doc_id, n characters, {_CLASSIFY} drawing_type from b""")
def drawing_type(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = docs.select("doc_id", F.length(F.replace("text", F.lit("\n"), F.lit(""))).alias("characters"), t.drawing_scores("text").alias("s"))
    return scored.select("doc_id", F.col("characters").cast("bigint").alias("characters"), t.drawing_type(F.col("s"), F.col("doc_id") % 10, "characters").alias("drawing_type"))


@query("sheet_types", "T7 R1 A1", f"""with g as (select drawing_id, sum(length(text)) n, count(*) filter (where kind is not null)*2 geo, {",".join(f"sum({_score_sql(w, 's')}) {k}" for k, w in t.DRAWING_KEYWORDS.items())}
  from (select *, lower(text) s, case when regexp_matches(layer,'(?i)door|wall') then 1 end kind from {TEXTS}) group by drawing_id), b as (select *, {_TOP} from g)
 select drawing_id, cast(n as bigint) characters, {_CLASSIFY} drawing_type from b""")
def sheet_types(spark, sf_dir):
    # Scores add up over the texts of a sheet, so no text is gathered.
    scored = texts(spark, sf_dir).withColumn("s", t.drawing_scores("text"))
    sums = scored.groupBy("drawing_id").agg(
        F.sum(F.length("text")).alias("characters"), (F.count_if(F.col("layer").rlike("(?i)door|wall")) * 2).alias("geo"),
        F.struct(*[F.sum(f"s.{k}").alias(k) for k in t.DRAWING_KEYWORDS]).alias("s"),
    )
    return sums.select("drawing_id", "characters", t.drawing_type(F.col("s"), "geo", "characters").alias("drawing_type"))


@query("note_facts", "T8", f"""select text_id, nullif(regexp_extract(text,'设计使用年限[^\\d]*(\\d+)\\s*年',1),'') design_life, nullif(regexp_extract(text,'抗震[^\\d]*(\\d+)\\s*度',1),'') seismic_intensity,
 nullif(regexp_extract(text,'耐火等级[^一-龥A-Za-z0-9]*([一-龥A-Za-z0-9]+)',1),'') fire_rating, array_to_string(list_sort(list_distinct(regexp_extract_all(text,'(?i)C\\d{{2,3}}'))),',') grades,
 contains(text,'防水') waterproofing from {TEXTS}""")
def note_facts(spark, sf_dir):
    f = texts(spark, sf_dir).select("text_id", t.note_facts("text").alias("f"))
    return f.select("text_id", "f.design_life", "f.seismic_intensity", "f.fire_rating", F.concat_ws(",", "f.concrete_grades").alias("grades"), F.col("f.mentions_waterproofing").alias("waterproofing"))


@query("document_facts", "T8 S8", """select lang, count(*) docs, sum(len(regexp_extract_all(text,'(?i)C\\d{2,3}'))) grade_mentions, sum(case when regexp_matches(text,'(?i)C\\d{2,3}') then 1 else 0 end) docs_with_grades, sum(length(text)) characters from documents group by lang""")
def document_facts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("lang", "text")
    grades = F.regexp_extract_all("text", F.lit(r"(?i)C\d{2,3}"), F.lit(0))
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.size(grades)).alias("grade_mentions"), F.sum(F.when(F.size(grades) > 0, 1).otherwise(0)).alias("docs_with_grades"),
        F.sum(F.length("text")).alias("characters"),
    )


@query("floor_height_texts", "T9", f"""with p as (
 select text_id, unnest(regexp_extract_all(text,'([一-龥A-Za-z0-9#\\-~]+?层)?[^\\n。；;]{{0,8}}?层高\\s*[:：=]?\\s*(\\d+(?:\\.\\d+)?)\\s*(mm|m|米)?',1)) f, unnest(regexp_extract_all(text,'([一-龥A-Za-z0-9#\\-~]+?层)?[^\\n。；;]{{0,8}}?层高\\s*[:：=]?\\s*(\\d+(?:\\.\\d+)?)\\s*(mm|m|米)?',2)) v,
  unnest(regexp_extract_all(text,'([一-龥A-Za-z0-9#\\-~]+?层)?[^\\n。；;]{{0,8}}?层高\\s*[:：=]?\\s*(\\d+(?:\\.\\d+)?)\\s*(mm|m|米)?',3)) u, text from {TEXTS}
 union all select text_id, unnest(regexp_extract_all(text,'([一-龥A-Za-z0-9#\\-~]+?层)[^\\n。；;]{{0,8}}?(\\d+(?:\\.\\d+)?)\\s*(mm|m|米)',1)), unnest(regexp_extract_all(text,'([一-龥A-Za-z0-9#\\-~]+?层)[^\\n。；;]{{0,8}}?(\\d+(?:\\.\\d+)?)\\s*(mm|m|米)',2)),
  unnest(regexp_extract_all(text,'([一-龥A-Za-z0-9#\\-~]+?层)[^\\n。；;]{{0,8}}?(\\d+(?:\\.\\d+)?)\\s*(mm|m|米)',3)), text from {TEXTS}
 union all select text_id, '', unnest(regexp_extract_all(text,'(?i)(?:floor|storey)\\s*height\\s*[:=]?\\s*(\\d+(?:\\.\\d+)?)\\s*(mm|m)?',1)), unnest(regexp_extract_all(text,'(?i)(?:floor|storey)\\s*height\\s*[:=]?\\s*(\\d+(?:\\.\\d+)?)\\s*(mm|m)?',2)), text from {TEXTS})
 select text_id, nullif(f,'') floor, cast(round(case when u in ('m','米') then cast(v as double)*1000 when u='mm' then cast(v as double) when cast(v as double)<20 then cast(v as double)*1000 else cast(v as double) end) as bigint) height_mm,
 round(least(0.95, case when coalesce(f,'')='' then 0.62 else 0.82 end + case when regexp_matches(text,'(?i)层高|floor\\s*height|storey\\s*height') then 0.12 else 0 end),3)::double confidence from p""")
def floor_height_texts(spark, sf_dir):
    found = texts(spark, sf_dir).select("text_id", F.explode(t.floor_heights("text")).alias("h"))
    return found.select("text_id", "h.floor", F.round("h.height_mm").cast("bigint").alias("height_mm"), "h.confidence")


_EL = "(?i)([一-龥A-Za-z0-9#\\-~]{0,16}?(?:层|屋面|地坪|女儿墙|roof|level|floor|el)?)\\s*(?:标高|EL\\.?|LEVEL)?\\s*[:：=]?\\s*([+\\-±]?\\s*\\d{1,5}(?:\\.\\d{1,4})?)"
ELEV = f"""e0 as (select drawing_id, text_id, text, unnest(regexp_extract_all(text,'{_EL}',1)) l, unnest(regexp_extract_all(text,'{_EL}',2)) v from {TEXTS}),
 e1 as (select *, cast(replace(replace(v,' ',''),'±','') as double) n, regexp_matches(text,'(?i)标高|层|屋面|地坪|女儿墙|EL\\.?|LEVEL|ELEV') ctx from e0),
 elev as (select drawing_id, text_id, cast(round(case when abs(n)<100 then n*1000 else n end) as bigint) elevation_mm from e1
  where regexp_matches(replace(v,' ',''),'^[+\\-±]') or (ctx and regexp_matches(replace(v,' ',''),'\\d+\\.\\d{{2,4}}')))"""


def _elevations(spark, sf_dir):
    found = texts(spark, sf_dir).select("drawing_id", "text_id", F.explode(t.elevation_marks("text")).alias("m"))
    return found.select("drawing_id", "text_id", "m.label", F.round("m.elevation_mm").cast("bigint").alias("elevation_mm"), "m.confidence")


@query("elevation_texts", "T10", f"with {ELEV} select text_id, elevation_mm from elev")
def elevation_texts(spark, sf_dir):
    return _elevations(spark, sf_dir).select("text_id", "elevation_mm")


@query("floor_heights", "W3 W8", f"""with {ELEV}, d as (select distinct drawing_id, elevation_mm from elev), l as (select *, lag(elevation_mm) over (partition by drawing_id order by elevation_mm) low from d)
 select drawing_id, low low_mm, elevation_mm high_mm, elevation_mm-low height_mm from l where elevation_mm-low between 1500 and 8000""")
def floor_heights(spark, sf_dir):
    from draftloom.operators.levels import heights_between_marks

    found = heights_between_marks(_elevations(spark, sf_dir), ["drawing_id"])
    return found.select("drawing_id", "low_mm", "high_mm", "height_mm")


_FACE = "(?:^|[\\s\\-_:：])((?:[A-Za-z0-9]+|[一-龥]{1,4})\\s*(?:面|立面|facade|elevation))(?:$|[\\s\\-_:：])"


@query("face_labels", "T11", f"""select text_id, coalesce(nullif(regexp_extract(trim(text),'((?:东|西|南|北|正|背|左|右).{{0,4}}立面)',1),''), nullif(regexp_replace(regexp_extract(' '||trim(text)||' ','(?i){_FACE}',1),'\\s+','','g'),'')) face,
 case when regexp_matches(lower(text),'南|south') then 'south' when regexp_matches(lower(text),'北|north') then 'north' when regexp_matches(lower(text),'东|east') then 'east' when regexp_matches(lower(text),'西|west') then 'west' end side from {TEXTS}""")
def face_labels(spark, sf_dir):
    return texts(spark, sf_dir).select("text_id", t.face_label("text").alias("face"), t.facade_side("text").alias("side"))


_DIG = "(case when length({0})=1 then strpos('一二三四五六七八九',{0}) else 0 end)"


def _num(x):
    left, right = f"split_part({x},'十',1)", f"split_part({x},'十',2)"
    return (f"case when regexp_matches({x},'^\\d+$') then cast({x} as int) when {x}='十' then 10 when contains({x},'十') then case when {left}='' then 10 else {_DIG.format(left)}*10 end + {_DIG.format(right)}"
            f" when {_DIG.format(x)}>0 then {_DIG.format(x)} end")


LEVELS = f"""l0 as (select text_id, drawing_id, translate(text,'－_','- ') x, lower(regexp_extract(text,'(?i)\\b(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\\s+floor\\b',1)) w from {TEXTS}),
 l1 as (select *, coalesce(nullif(regexp_extract(x,'(?i)地下\\s*([一二三四五六七八九十\\d]+)\\s*层',1),''), nullif(regexp_extract(x,'(?i)B\\s*(\\d+)',1),'')) b,
  coalesce(nullif(regexp_extract(x,'(?i)([一二三四五六七八九十\\d]+)\\s*层|([2-9]\\d*)F|F([2-9]\\d*)',1),''), nullif(regexp_extract(x,'(?i)([一二三四五六七八九十\\d]+)\\s*层|([2-9]\\d*)F|F([2-9]\\d*)',2),''), nullif(regexp_extract(x,'(?i)([一二三四五六七八九十\\d]+)\\s*层|([2-9]\\d*)F|F([2-9]\\d*)',3),'')) f,
  list_position(['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth'], w) o from l0),
 l2 as (select *, {_num('b')} bn, {_num('f')} fn from l1),
 levels as (select text_id, drawing_id, case when regexp_matches(x,'(?i)\\bground\\s+floor\\b') then 'L1' when w<>'' then 'L'||o when regexp_matches(x,'(?i)屋顶|屋面|roof') then 'roof' when bn is not null then 'B'||bn
  when regexp_matches(x,'(?i)首层|一层|1\\s*层|1F|F1') then 'L1' when fn is not null then 'L'||fn when regexp_matches(x,'(?i)标准层|standard\\s*floor|typical\\s*floor') then 'typical' end key,
  cast(case when regexp_matches(x,'(?i)\\bground\\s+floor\\b') then 1 when w<>'' then o when regexp_matches(x,'(?i)屋顶|屋面|roof') then null when bn is not null then -bn
  when regexp_matches(x,'(?i)首层|一层|1\\s*层|1F|F1') then 1 else fn end as int) number,
  case when regexp_matches(x,'(?i)\\bground\\s+floor\\b') then 0.94 when w<>'' then 0.78 when regexp_matches(x,'(?i)屋顶|屋面|roof') then 0.86 when bn is not null then 0.88
  when regexp_matches(x,'(?i)首层|一层|1\\s*层|1F|F1') then 0.9 when fn is not null then 0.88 else 0.76 end conf from l2)"""


@query("title_levels", "T12", f"with {LEVELS} select text_id, key, number from levels where key is not null")
def title_levels(spark, sf_dir):
    found = texts(spark, sf_dir).select("text_id", t.level_from_title("text").alias("l")).where("l is not null")
    return found.select("text_id", "l.key", "l.number")


@query("level_table", "W12", f"""with {LEVELS}, k as (select drawing_id, key, max(number) number, max(conf) conf from levels where key is not null group by drawing_id, key),
 m as (select *, max(number) over (partition by drawing_id) top from k), n as (select drawing_id, key, conf, case when key='roof' then coalesce(top,1)+1 else number end number from m),
 r as (select *, row_number() over (partition by drawing_id order by case when number is not null then 0 when key='typical' then 1 else 2 end, coalesce(number,0), key) rn from n)
 select drawing_id, 'LEVEL-'||lpad(cast(rn as string),3,'0') level_id, key, cast(number as int) number, cast((number-1)*3600 as bigint) elevation_mm, round(conf,3)::double confidence from r""")
def level_table(spark, sf_dir):
    from draftloom.operators.levels import level_table as build

    found = texts(spark, sf_dir).select("drawing_id", F.col("text_id").alias("ord"), t.level_from_title("text").alias("l")).where("l is not null")
    levels = build(found.select("drawing_id", "ord", "l.*"), ["drawing_id"], 3600.0)
    return levels.select("drawing_id", "level_id", "key", "number", F.col("elevation_mm").cast("bigint").alias("elevation_mm"), "confidence")


@query("stair_texts", "T13", f"""select text_id, try_cast(nullif(regexp_extract(text,'(?i)(\\d+)\\s*(?:级|步|踏|steps?|risers?)',1),'') as int) step_count,
 cast(nullif(regexp_extract(text,'(?i)(?:踏步|踏面|踢面|tread|riser|step)\\s*[:：=]?\\s*(\\d+(?:\\.\\d+)?)\\s*[xX×*]\\s*(\\d+(?:\\.\\d+)?)',1),'') as int) tread_mm,
 cast(nullif(regexp_extract(text,'(?i)(?:踏步|踏面|踢面|tread|riser|step)\\s*[:：=]?\\s*(\\d+(?:\\.\\d+)?)\\s*[xX×*]\\s*(\\d+(?:\\.\\d+)?)',2),'') as int) riser_mm,
 nullif(regexp_extract(text,'([一二三四五六七八九十\\d]+层?)\\s*[-~至到]\\s*([一二三四五六七八九十\\d]+层?)',2),'') end_level from {TEXTS}""")
def stair_texts(spark, sf_dir):
    f = texts(spark, sf_dir).select("text_id", t.stair_facts("text").alias("f"))
    return f.select("text_id", "f.step_count", F.col("f.tread_mm").cast("int").alias("tread_mm"), F.col("f.riser_mm").cast("int").alias("riser_mm"), "f.end_level")


_RH = "(?i)(?:栏杆|扶手|护栏)?\\s*(?:高|高度|height|h)\\s*[:：]?\\s*(\\d+(?:\\.\\d+)?)\\s*(mm|m|米)?"
_PH = "(?i)(?:女儿墙|parapet)[^\\d+\\-]{0,12}(?:高度|高|H|h|height)\\s*[:=]?\\s*(\\d+(?:\\.\\d+)?)\\s*(mm|m|米)?"


@query("guard_heights", "T14", f"""with a as (select text_id, cast(nullif(regexp_extract(text,'{_RH}',1),'') as double) rv, regexp_extract(text,'{_RH}',2) ru, cast(nullif(regexp_extract(translate(text,'：＝，',':=,'),'{_PH}',1),'') as double) pv, regexp_extract(translate(text,'：＝，',':=,'),'{_PH}',2) pu from {TEXTS}),
 b as (select text_id, case when ru in ('m','米') or rv<20 then rv*1000 else rv end r, case when pu in ('m','米') or (pv between 0.2 and 3 and pu<>'mm') then pv*1000 else pv end p from a)
 select text_id, cast(round(case when r between 600 and 1600 then r end) as bigint) railing_mm, cast(round(case when p between 250 and 1800 then p end) as bigint) parapet_mm from b""")
def guard_heights(spark, sf_dir):
    return texts(spark, sf_dir).select("text_id", F.round(t.railing_height("text")).cast("bigint").alias("railing_mm"), F.round(t.parapet_height("text")).cast("bigint").alias("parapet_mm"))


@query("text_classes", "T15 R20", f"""select text_id, regexp_full_match(trim(text),'(?i)[0-9.,+\\-*/ xX×~～=()（）]+(?:mm|m|米)?') is_dimension, regexp_matches(lower(text),'{"|".join(t.MATERIAL_WORDS)}') is_material from {TEXTS}""")
def text_classes(spark, sf_dir):
    return texts(spark, sf_dir).select("text_id", t.is_dimension_text("text").alias("is_dimension"), t.is_material_text("text").alias("is_material"))


@query("coerced_values", "T16", f"""select text_id, cast(nullif(regexp_extract(replace(text,',',''),'[-+]?\\d+(?:\\.\\d+)?'),'') as double) number, len(list_filter(list_transform(string_split_regex(text,'[,;|]'), lambda s: trim(s)), lambda s: s<>'')) ids,
 case when len(regexp_extract_all(text,'[-+]?\\d+(?:\\.\\d+)?'))>=2 then cast(regexp_extract_all(text,'[-+]?\\d+(?:\\.\\d+)?')[2] as double) end point_y from {TEXTS}""")
def coerced_values(spark, sf_dir):
    return texts(spark, sf_dir).select("text_id", v.to_number("text").alias("number"), F.size(v.id_list("text")).cast("bigint").alias("ids"), v.parse_point("text")["y"].alias("point_y"))


_DIRS = "case lower(trim(w)) " + " ".join(f"when '{a}' then '{n}'" for n, al in sem.DIRECTIONS.items() for a in al) + " else 'unknown' end"


@query("directions", "T17", f"select o_orderkey, {_DIRS} direction from (select o_orderkey, (['E','向左',' North ','下','推拉','double','x','Right'])[1+o_orderkey%8] w from orders)")
def directions(spark, sf_dir):
    words = F.array(*map(F.lit, ["E", "向左", " North ", "下", "推拉", "double", "x", "Right"]))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.element_at(words, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("w"))
    return orders.select("o_orderkey", sem.open_direction("w").alias("direction"))


_CAND = "(['', 'single swing door','DM','TLM0921','推拉门','平开窗','TC1515','slide','quarter_arc','unknown'])"
_DOOR_T = "case when c in ('singleswingdoor','singleleafswingdoor','d','m') then 'single_swing_door' when c in ('doubleswingdoor','doubleleafswingdoor','dm','双开门','双扇平开门') then 'double_swing_door' when c='slidingdoor' or contains(c,'推拉') or starts_with(c,'tlm') then 'sliding_door' when contains(x,'quarter_arc') or contains(x,'swing') or contains(c,'平开') then 'single_swing_door' end"
_WIN_T = "case when c in ('casementwindow','pc') or contains(c,'平开') or starts_with(c,'pc') then 'casement_window' when c='slidewindow' or contains(c,'推拉') or contains(x,'sliding') or starts_with(c,'tc') or starts_with(c,'tlc') then 'sliding_window' end"


@query("opening_types", "T18", f"""with o as (select opening_id, kind, width_mm, unnest([{_CAND}[1+opening_id%10], {_CAND}[1+(opening_id*3)%10]]) w, unnest([1,2]) i from {derived_sql('openings')}),
 n as (select *, translate(lower(trim(w)),' -','__') x, regexp_replace(translate(lower(trim(w)),' -','__'),'[^0-9a-zA-Z一-鿿]','','g') c from o), s as (select *, case when kind='door' then {_DOOR_T} else {_WIN_T} end t from n)
 select opening_id, coalesce(arg_min(t,i) filter (where t is not null), case when any_value(kind)='door' then case when any_value(width_mm)>=1200 then 'double_swing_door' else 'single_swing_door' end else 'unresolved' end) semantic_type, count(t)=0 needs_review from s group by opening_id""")
def opening_types(spark, sf_dir):
    words = F.array(*map(F.lit, ["", "single swing door", "DM", "TLM0921", "推拉门", "平开窗", "TC1515", "slide", "quarter_arc", "unknown"]))
    o = derived(spark, sf_dir, "openings")
    picks = [F.element_at(words, (F.col("opening_id") * k % 10 + 1).cast("int")) for k in (1, 3)]
    s = sem.opening_type("kind", picks, "width_mm")
    return o.select("opening_id", s["semantic_type"].alias("semantic_type"), s["needs_review"].alias("needs_review"))


_SRC = "(['quarter_arc','double_swing_arc','sliding_door_double_rectangles','merged_adjacent_door_frames','five_parallel_lines','block','layer_line'])[1+opening_id%7]"


@query("source_categories", "T19", f"""with o as (select opening_id, kind, {_SRC} s, (opening_id%10)/10.0 c from {derived_sql('openings')}), k as (select *, case when kind='door' and s='quarter_arc' then 'single_swing_door' when kind='door' and s='double_swing_arc' then 'double_swing_door'
 when kind='door' and s in ('sliding_door_double_rectangles','merged_adjacent_door_frames') then 'sliding_door' when kind='window' and s='five_parallel_lines' then 'sliding_window' else 'unknown' end category from o)
 select opening_id, category, cast(case when category='unknown' then 0 else least(c, case when s in ('quarter_arc','double_swing_arc','sliding_door_double_rectangles','five_parallel_lines') then 0.72 when s='merged_adjacent_door_frames' then 0.62 when s='block' then 0.5 else 0.45 end) end as double) confidence from k""")
def source_categories(spark, sf_dir):
    names = ["quarter_arc", "double_swing_arc", "sliding_door_double_rectangles", "merged_adjacent_door_frames", "five_parallel_lines", "block", "layer_line"]
    o = derived(spark, sf_dir, "openings").withColumn("s", F.element_at(F.array(*map(F.lit, names)), (F.col("opening_id") % 7 + 1).cast("int")))
    category = sem.category_from_source("kind", "s")
    return o.select("opening_id", category.alias("category"), sem.category_confidence(category, "s", (F.col("opening_id") % 10) / 10.0).alias("confidence"))


_BLK = "(['TLM-1','PKC 3','DD2','W12','slidingDoor','chair','C1518','dbl-x','推拉窗','M0921'])[1+opening_id%10]"


@query("block_openings", "T20", f"""with o as (select opening_id, {_BLK} n, case when opening_id%3=0 then 'A-OPENING' else '0' end l, width_mm w from {derived_sql('openings')}), c as (select *, regexp_replace(lower(n),'[^a-z0-9]','','g') c, l||' '||n||' '||l h from o),
 k as (select *, case when regexp_matches(h,'(?i)(door|门)') then 'door' when regexp_matches(h,'(?i)(window|窗|win)') then 'window' when regexp_matches(c,'^(tlm|door|men|slidingdoor)') then 'door' when regexp_matches(c,'^(tlc|pkc|window|win)') then 'window'
  when c='m0921' then 'door' when c='c1518' then 'window' when l='A-OPENING' and regexp_matches(c,'^(m|d|dd|sd|sl|sliding)[0-9]*$') then 'door' when l='A-OPENING' and regexp_matches(c,'^(c|w|sw|cw|win|window)[0-9]*$') then 'window' end kind from c)
 select opening_id, kind, case when kind='door' and regexp_matches(c,'^(double|dbl|pair|shuang|dd)') then 'double_swing_door' when kind='door' and regexp_matches(c,'^(tlm|sliding|slide|sd|sl)') then 'sliding_door' when kind='window' and (contains(n,'推拉') or regexp_matches(c,'^(tlc|sliding|sw)')) then 'sliding_window'
 when kind='window' and regexp_matches(c,'^(pkc|casement|cw)') then 'casement_window' else 'unknown' end category, cast(case when greatest(w,150) between 300 and 6000 then greatest(w,150) end as bigint) width_mm from k""")
def block_openings(spark, sf_dir):
    names = F.array(*map(F.lit, ["TLM-1", "PKC 3", "DD2", "W12", "slidingDoor", "chair", "C1518", "dbl-x", "推拉窗", "M0921"]))
    o = derived(spark, sf_dir, "openings").select(
        "opening_id", "width_mm", F.element_at(names, (F.col("opening_id") % 10 + 1).cast("int")).alias("n"),
        F.when(F.col("opening_id") % 3 == 0, "A-OPENING").otherwise("0").alias("l"))
    kind = sem.block_kind("l", "n", F.array("l"))
    o = o.withColumn("kind", kind)
    return o.select("opening_id", "kind", sem.block_category("kind", "n").alias("category"), sem.block_width(F.lit(0), F.lit(0), F.col("width_mm"), F.lit(150)).cast("bigint").alias("width_mm"))


_VOID = "(['void','elevator shaft','stairs hole','loft shaft','slab gap','双层上空'])[1+opening_id%6]"


@query("void_semantics", "T21", f"""with o as (select opening_id, {_VOID} k, case when opening_id%5=0 then 'stair_block_bounds' else 'hand' end s from {derived_sql('openings')}), b as (select *, lower(k||' '||s) x from o),
 c as (select *, cast(regexp_matches(x,'loft|open to below|double height|void|挑空|上空|中空') as int) l, cast(regexp_matches(x,'shaft|井道|电梯井|管井') as int) h, cast(regexp_matches(x,'stairwell|stair_|stairs|楼梯') as int) st from b)
 select opening_id, case when l+h+st>1 then 'semantic_conflict' when l=1 then 'loft_opening' when h=1 then 'shaft_opening' when st=1 then 'stairwell_opening' else 'general_floor_opening' end semantic,
 case when s='stair_block_bounds' then 'stair_plan_block' else 'unclassified_floor_opening' end "domain" from c""")
def void_semantics(spark, sf_dir):
    names = F.array(*map(F.lit, ["void", "elevator shaft", "stairs hole", "loft shaft", "slab gap", "双层上空"]))
    o = derived(spark, sf_dir, "openings").select("opening_id", F.element_at(names, (F.col("opening_id") % 6 + 1).cast("int")).alias("k"), F.when(F.col("opening_id") % 5 == 0, "stair_block_bounds").otherwise("hand").alias("s"))
    return o.select("opening_id", sem.void_semantic("k", "s", F.lit(""), F.lit(""))["semantic"].alias("semantic"), sem.void_domain("s", "k").alias("domain"))


@query("view_roles", "T22", f"""with {TITLE}, d as (select *, case when contains(tx,'立面') then 'elevation' when contains(tx,'剖面') then 'section' when contains(lower(tx),'plan') or contains(tx,'平面') then 'floor_plan' else 'detail' end dt from t1)
 select text_id, dt drawing_type, case dt when 'floor_plan' then 'spatial_primary' when 'detail' then 'component_detail_evidence' else 'vertical_reference' end role, case dt when 'floor_plan' then 'project_xy_authority' else 'no_project_xy' end authority,
 case when dt<>'detail' then '' when regexp_matches(tx,'楼梯|stair') then 'stair' when regexp_matches(lower(tx),'门窗|door.*window|window.*door') then 'door_window' when regexp_matches(lower(tx),'门|door') then 'door' when regexp_matches(lower(tx),'窗|window') then 'window'
 when regexp_matches(lower(tx),'墙|wall') then 'wall' when regexp_matches(lower(tx),'屋面|屋顶|roof') then 'roof' when regexp_matches(lower(tx),'栏杆|扶手|railing|handrail') then 'railing' else '' end subject from d""")
def view_roles(spark, sf_dir):
    tx = F.trim("text")
    kind = F.when(tx.contains("立面"), "elevation").when(tx.contains("剖面"), "section").when(F.lower(tx).contains("plan") | tx.contains("平面"), "floor_plan").otherwise("detail")
    d = texts(spark, sf_dir).withColumn("drawing_type", kind)
    return d.select("text_id", "drawing_type", sem.view_role("drawing_type").alias("role"), sem.coordinate_authority("drawing_type").alias("authority"), sem.detail_subject(tx, "drawing_type").alias("subject"))


@query("safe_names", "T23", f"""with s as (select text_id, trim(regexp_replace(regexp_replace(regexp_replace(text,'\\\\[A-Za-z0-9]+','','g'),'[\\\\:{{}}\\[\\]|;<>?`~]','','g'),'\\s+',' ','g')) n from {TEXTS}) select text_id, case when n='' then 'G' else n end name from s""")
def safe_names(spark, sf_dir):
    return texts(spark, sf_dir).select("text_id", t.safe_name("text", F.lit("G")).alias("name"))


@query("door_leaves", "T24", f"""with l as (select file_id, lower(file_path||' '||summary) x, cast(file_id%40*100 as bigint) w from {derived_sql('library')}),
 m as (select *, case when regexp_matches(x,'four leaf|four panel') then 4 when regexp_matches(x,'double leaf|double-leaf|double door|double swing|double sliding|two leaf|dbl') then 2 when regexp_matches(x,'single leaf|single-leaf|single door|single swing|single sliding') then 1 else 0 end leaves from l)
 select file_id, leaves, case when regexp_matches(x,'roll-up|roll up|garage door') then 'rolling_shutter' when regexp_matches(x,'sliding|slider|pocket') then 'sliding' when regexp_matches(x,'swing|hinged') then 'swing' when leaves>0 and contains(x,'door') then 'swing' else '' end motion,
 case when leaves>0 then leaves when w>=3200 then 4 when w>=1200 then 2 when w>0 then 1 else 0 end requested from m""")
def door_leaves(spark, sf_dir):
    x = F.concat_ws(" ", "file_path", "summary")
    lib = derived(spark, sf_dir, "library")
    return lib.select("file_id", sem.door_leaves(x).alias("leaves"), sem.door_motion(x).alias("motion"), sem.requested_leaves(x, F.col("file_id") % 40 * 100).alias("requested"))


_MAT = "(['C30混凝土','Brick wall','solid wood','铝合金','steel plate','玻璃','plastic','砼'])[1+p_partkey%8]"


@query("material_classes", "T25", f"""select p_partkey, case when regexp_matches(lower(m),'砼|混凝土|concrete') then 'Concrete' when regexp_matches(lower(m),'砖|brick|masonry') then 'Brick/Masonry' when regexp_matches(lower(m),'木|wood') then 'Wood' when regexp_matches(lower(m),'铝') then 'Aluminum'
 when regexp_matches(lower(m),'钢|steel') then 'Steel' when regexp_matches(lower(m),'玻璃|glass') then 'Glass' else m end material, regexp_matches(lower(m),'砼|混凝土|concrete') is_concrete from (select p_partkey, {_MAT} m from part)""")
def material_classes(spark, sf_dir):
    names = F.array(*map(F.lit, ["C30混凝土", "Brick wall", "solid wood", "铝合金", "steel plate", "玻璃", "plastic", "砼"]))
    p = read(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")).alias("m"))
    return p.select("p_partkey", sem.material_class("m").alias("material"), sem.materials_match(F.lit("concrete"), "m").alias("is_concrete"))


@query("evidence_texts", "T26", f"""select opening_id, concat_ws('; ', 'id='||opening_id, 'size='||width_mm||'x'||height_mm, case when opening_id%4<>0 then 'type='||kind end, case when status<>'P' then 'level='||status end) evidence from {derived_sql('openings')}""")
def evidence_texts(spark, sf_dir):
    o = derived(spark, sf_dir, "openings")
    return o.select("opening_id", v.key_values({
        "id": "opening_id", "size": F.concat_ws("x", "width_mm", "height_mm"), "type": F.when(F.col("opening_id") % 4 != 0, F.col("kind")),
        "level": F.when(F.col("status") != "P", F.col("status")),
    }).alias("evidence"))


@query("json_objects", "T27", """select event_id, cast(json_extract(props,'$.k') as int) k from events""")
def json_objects(spark, sf_dir):
    wrapped = F.concat(
        F.lit("Result follows.\n"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
        .otherwise(F.concat(F.col("props"), F.lit(" as asked"))))
    found = v.json_object(wrapped)
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(found, "$.k").cast("int").alias("k"))


_WHY = "(['JSON parse error','level missing','Host wall lost','no family symbol','bad boundary','not approved','other'])[1+event_id%7]"


@query("correction_advice", "T28", f"""select event_id, case event_id%7 when 0 then 'repair_input_format' when 1 then 'bind_or_create_level' when 2 then 'reconnect_host' when 3 then 'load_type_or_placeholder' when 4 then 'rebuild_location' when 5 then 'regenerate_approval' else 'retry_or_placeholder' end advice from events""")
def correction_advice(spark, sf_dir):
    words = F.array(*map(F.lit, ["JSON parse error", "level missing", "Host wall lost", "no family symbol", "bad boundary", "not approved", "other"]))
    e = read(spark, sf_dir, "events").select("event_id", F.element_at(words, (F.col("event_id") % 7 + 1).cast("int")).alias("w"))
    return e.select("event_id", sem.correction_advice("w")["advice"].alias("advice"))


_CONF = "([ '0.8','85','high','45%','{\"value\": 0.3}','true','unknown','{\"score\": \"low\"}'])[1+event_id%8]"


@query("confidences", "S10", "select event_id, cast(case event_id%8 when 0 then 0.8 when 1 then 0.85 when 2 then 0.9 when 3 then 0.45 when 4 then 0.3 when 5 then 1.0 when 7 then 0.4 end as double) confidence from events")
def confidences(spark, sf_dir):
    words = F.array(*map(F.lit, ["0.8", "85", "high", "45%", '{"value": 0.3}', "true", "unknown", '{"score": "low"}']))
    e = read(spark, sf_dir, "events").select("event_id", F.element_at(words, (F.col("event_id") % 8 + 1).cast("int")).alias("w"))
    return e.select("event_id", v.confidence("w").alias("confidence"))


@query("material_lists", "S11", "select event_id, case event_id%4 when 0 then 'Brick' when 1 then 'Brick|Steel' when 2 then 'Glass' else '' end materials from events")
def material_lists(spark, sf_dir):
    words = F.array(*map(F.lit, ["Brick", '["Brick", {"name": "Steel"}, "BRICK"]', '{"material": {"label": "Glass"}}', "[]"]))
    e = read(spark, sf_dir, "events").select("event_id", F.element_at(words, (F.col("event_id") % 4 + 1).cast("int")).alias("w"))
    return e.select("event_id", F.concat_ws("|", v.material_names("w")).alias("materials"))
