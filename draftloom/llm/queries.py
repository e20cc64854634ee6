"""Queries over whole tables, one per operator, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftloom.llm import bins, chat, codes, collocations, language, mixing, packing, pages, perplexity, secrets, simhash, toxicity, vectors
from draftloom.llm.common import table, words
from draftloom.session import checkpoint

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return add


@query("op1_mix_sources", """
with quality as (select doc_id, max(quality) as quality from labels where doc_id is not null group by doc_id),
sized as (select d.doc_id, d.source, cast(coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
        case q.quality when 1 then 2.0 when 0 then 0.5 else 1.0 end as weight
    from documents d left join quality q on d.doc_id = q.doc_id),
keyed as (select *, -ln((cast('0x' || substr(md5('7|' || cast(doc_id as varchar)), 1, 13) as bigint) + 0.5::double) / 4503599627370496.0::double) / weight as key from sized),
sums as (select source, cast(sum(size) as bigint) as source_size from keyed group by source),
ranked as (select *, (row_number() over (order by source nulls last) - 1) % 3 as place from sums),
weighed as (select *, case place when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w, 2.0::double * source_size as cap from ranked),
levels as (select *, (1.5::double * sum(source_size) over ()
        - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as lev from weighed),
targets as (select source, source_size, least(cap, w * max(lev) over ()) as target from levels),
plans as (select *, cast(case when source_size > 0 then floor(target / source_size) else 0 end as bigint) as epochs from targets),
rests as (select *, cast(floor(target - epochs * source_size) as bigint) as rest from plans),
placed as (select k.doc_id, k.size, r.source_size, r.target, r.epochs, r.rest,
        sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and current row) - k.size as prior
    from keyed k join rests r on k.source is not distinct from r.source)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, rest - prior)) as bigint) as taken from placed
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix at 150 % of the corpus takes of every document; labelled quality weighs the draw."""
    quality = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words("text").alias("n"))
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    sized = checkpoint(docs.join(quality, "doc_id", "left").select("doc_id", "source", "n", weight.alias("weight")))
    mixed = mixing.mix_sources(sized, size=F.col("n"), weight=F.col("weight"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op6_chat_turns")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds the template's own control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = "\\### Assistant: </turn> ok"
    odd = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(odd)))


@query("op7_simhash_groups")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_packed_tokens")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as rows of a matrix of token ids."""
    return packing.pack_tokens(table(spark, sf_dir, "documents"))


@query("op3_nearest_vectors")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest other vectors of every hundredth vector."""
    return vectors.search(table(spark, sf_dir, "embeddings"))


@query("op4_page_texts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op5_secret_findings")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate credential of every document and whether it is a secret."""
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op8_languages")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query("op9_best_fit_bins")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in bins of the permitted lengths."""
    return bins.pack_documents(table(spark, sf_dir, "documents"), with_texts=False)


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and perplexity verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return perplexity.judge(docs, carry=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")


@query("op11_collocations", """
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
split as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from pieces),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from split),
runs as (select lang, w, i, unnest([1, 2, 3, 4]) as m from starts),
grams as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase from runs where i + m - 1 <= len(w)),
totals as (select lang, count(*) as n from grams where m = 1 group by lang),
counted as (select lang, m, phrase, count(*) as f from grams group by lang, m, phrase having count(*) >= 30),
candidates as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from counted where m >= 2),
cuts as (select *, unnest(range(1, m)) as k from candidates),
scored as (select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, (2000000::hugeint * c.a) // (x.f + y.f) as score
    from cuts c join counted x on x.lang = c.lang and x.m = c.k and x.phrase = array_to_string(c.w[1:c.k], ' ')
    join counted y on y.lang = c.lang and y.m = c.m - c.k and y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
worst as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
lengths as (select lang, a, w, m, unnest(range(2, m)) as len from candidates),
inside as (select lang, a, w, len, unnest(range(1, m - len + 2)) as i from lengths),
longer as (select lang, array_to_string(w[i:i + len - 1], ' ') as phrase, max(a) as most from inside group by all),
free as (select t.* from worst t left join longer x on x.lang = t.lang and x.phrase = t.phrase where x.most is null or 100 * x.most < 80 * t.a)
select f.lang, cast(row_number() over (partition by f.lang order by score desc, a desc, phrase) as integer) as rank, phrase, a, l, r, n, cast(score as bigint) as score
from free f join totals t on t.lang = f.lang qualify rank <= 2000
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def _lloyd_sql(rounds: int) -> str:
    """Lloyd's method over whole numbers with its rounds written out."""
    steps = ["""kept as materialized (select row_number() over () as id, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * x::double) as bigint)) as v from embeddings
    where len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
parts as materialized (select id, p, len(v) // 8 as w, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] as c from kept, range(8) as t(p)),
first as (select id, row_number() over (order by vec_id nulls last, v) - 1 as e from kept qualify e < 16),
book0 as materialized (select p, e, c from parts join first using (id))"""]
    for t in range(rounds + 1):
        steps.append(f"""near{t} as materialized (select x.id, x.p, b.e, x.c, list_sum(list_transform(range(1, x.w + 1), lambda i: (x.c[i] - b.c[i]) * (x.c[i] - b.c[i]))) as d
    from parts x join book{t} b on b.p = x.p qualify row_number() over (partition by x.id, x.p order by d, b.e) = 1)""")
        if t < rounds:
            steps.append(f"""sums{t} as (select p, e, i, sum(x)::hugeint as s, count(*) as n from (select p, e, unnest(c) as x, generate_subscripts(c, 1) as i from near{t}) group by all),
means{t} as (select p, e, list(cast(s // n - case when s % n < 0 then 1 else 0 end as bigint) order by i) as c from sums{t} group by p, e),
book{t + 1} as materialized (select b.p, b.e, coalesce(m.c, b.c) as c from book{t} b left join means{t} m on m.p = b.p and m.e = b.e)""")
    return "with " + ",\n".join(steps) + f""",
sha as (select sha256(string_agg(x::varchar, ',' order by p, e, i)) as codebooks_sha256 from (select p, e, unnest(c) as x, generate_subscripts(c, 1) as i from book{rounds})),
coded as (select id, string_agg(printf('%02x', e::integer), '' order by p) as code, cast(sum(d) as bigint) as error from near{rounds} group by id)
select k.vec_id, c.code, c.error, cast(sum(c.error) over (partition by k.label) as bigint) as label_error, s.codebooks_sha256 from coded c join kept k using (id), sha s"""


@query("op12_vector_codes", _lloyd_sql(6))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector after six rounds."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


@query("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from three quarters of the labels."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = toxicity.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), fit=~held_out, passages=False)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
