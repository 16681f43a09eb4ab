"""The study's tables, derived from the test tables: as DataFrames, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions.text import collapsed, composed

GRID = [1, 5, 10, 20, 30, 40, 50]
LAST = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    grid = F.array(*(F.lit(k) for k in GRID))
    return line.select(
        *LAST,
        F.col("l_returnflag").alias("dataset"),
        (F.col("l_suppkey") % 4).cast("int").alias("reader"),
        F.element_at(grid, (F.col("l_partkey") % 7).cast("int") + 1).alias("k"),
        F.when(F.col("l_linenumber") % 2 == 0, "soft").otherwise("hard").alias("negative"),
        F.when(F.col("l_orderkey") % 3 == 0, "start").when(F.col("l_orderkey") % 3 == 1, "middle").otherwise("end").alias("rotation"),
        ((F.col("l_suppkey") + F.col("l_partkey")) % 3 + 1).cast("int").alias("run"),
        (F.col("l_orderkey") % 500).alias("query_id"),
        F.when(F.col("l_discount") <= 0.05, 1).otherwise(0).alias("score"),
        F.floor(F.col("l_extendedprice") / 10).alias("request_tokens"),
        F.floor("l_quantity").alias("response_tokens"),
    )


TRIAL = """trial as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag as dataset,
  cast(l_suppkey % 4 as integer) as reader, list_extract([1, 5, 10, 20, 30, 40, 50], cast(l_partkey % 7 as integer) + 1) as k,
  case when l_linenumber % 2 = 0 then 'soft' else 'hard' end as negative,
  case l_orderkey % 3 when 0 then 'start' when 1 then 'middle' else 'end' end as rotation,
  cast((l_suppkey + l_partkey) % 3 + 1 as integer) as run, l_orderkey % 500 as query_id,
  case when l_discount <= 0.05 then 1 else 0 end as score,
  cast(floor(l_extendedprice / 10) as bigint) as request_tokens, cast(floor(l_quantity) as bigint) as response_tokens from lineitem)"""


def retrieval(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries (query_id, embedding, label), corpus (id, embedding, label) and gold pairs (query_id, id): equal labels within the same fifty vectors, so that a query has one to a few, whatever the size."""
    e = read(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    corpus = e.filter("vec_id % 5 <> 0").withColumnRenamed("vec_id", "id")
    near = lambda c: F.expr(f"{c} div 50").alias("near")
    gold = queries.select("query_id", "label", near("query_id")).join(corpus.select("id", "label", near("id")), ["label", "near"]).select("query_id", "id")
    return queries, corpus, gold


def gold_pair(gold: DataFrame) -> DataFrame:
    """(query_id, gold): a case with all its gold ids in order."""
    return gold.groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("gold"))


RETRIEVAL = """q as (select vec_id as query_id, embedding, label from embeddings where vec_id % 5 = 0),
  c as (select vec_id as id, embedding, label from embeddings where vec_id % 5 <> 0),
  gold as (select query_id, id from q join c using (label) where query_id // 50 = id // 50),
  sims as (select query_id, id, round(list_inner_product(q.embedding::double[], c.embedding::double[])
     / sqrt(list_inner_product(q.embedding::double[], q.embedding::double[])) / sqrt(list_inner_product(c.embedding::double[], c.embedding::double[])), 6) as score
     from q, c where list_inner_product(q.embedding::double[], q.embedding::double[]) > 0 and list_inner_product(c.embedding::double[], c.embedding::double[]) > 0),
  ranked as (select query_id, cast(rank as integer) as rank, id, score from (select *, row_number() over (partition by query_id order by score desc, id) as rank from sims) where rank <= 50)"""

#: RETRIEVAL with all vectors of a query's label as its gold.
WHOLE = RETRIEVAL.replace(" where query_id // 50 = id // 50", "")

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as vectors of their letter counts, with text ids: every hundredth asks (query_id, embedding), all answer (id, embedding)."""
    d = read(spark, sf_dir, "documents")
    count = F.array(*(F.char_length("text") - F.char_length(F.replace("text", F.lit(x))) for x in LETTERS))
    docs = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), count.cast("array<double>").alias("embedding"), "doc_id")
    return docs.filter("doc_id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"), docs.select("id", "embedding")


LETTER_VECTORS = f"""v as (select doc_id, 'd' || doc_id as id, [{", ".join(f"length(text) - length(replace(text, '{x}', ''))" for x in LETTERS)}]::double[] as e from documents),
  n as (select *, list_inner_product(e, e) as size from v),
  s as (select a.id as query_id, b.id, round(list_inner_product(a.e, b.e) / sqrt(a.size) / sqrt(b.size), 6) as score from n a join n b on a.doc_id % 100 = 0 and a.size > 0 and b.size > 0)"""


def metric_sql(gold: str) -> str:
    """CTEs ``m``: the five metrics of each query and depth, against a CTE of gold pairs."""
    return f"""ks as (select unnest([1, 5, 10, 20, 30, 40, 50]) as k),
  ng as (select query_id, count(*) as n_gold from {gold} group by query_id),
  h as (select r.query_id, r.id, r.rank, case when g.id is null then 0 else 1 end as hit from ranked r left join {gold} g on r.query_id = g.query_id and r.id = g.id),
  agg as (select query_id, k, count(*) as n_rows, sum(hit) as n_hit, count(distinct case when hit = 1 then id end) as n_distinct, sum(hit / log2(rank + 1)) as dcg
     from h, ks where rank <= k group by query_id, k),
  b as (select q.query_id, k, coalesce(n_gold, 0) as n_gold, coalesce(n_rows, 0) as n_rows, coalesce(n_hit, 0) as n_hit, coalesce(n_distinct, 0) as n_distinct, coalesce(dcg, 0) as dcg
     from q cross join ks left join ng using (query_id) left join agg using (query_id, k)),
  m as (select query_id, k,
     case when n_gold > 0 then case when n_hit > 0 then 1.0 else 0.0 end else case when n_rows = 0 then 1.0 else 0.0 end end::double as recall,
     cast(n_hit as double) / k as precision,
     case when n_gold > 0 then case when n_distinct = n_gold then 1.0 else 0.0 end else 1.0 end::double as recall_strict,
     case when n_gold > 0 then cast(n_distinct as double) / n_gold else 1.0 end as recall_soft,
     case when n_gold > 0 and n_rows > 0 then dcg / (select sum(1 / log2(i + 1)) from range(1, least(n_gold, k) + 1) r(i)) else 0.0 end as ndcg from b)"""


CONTEXT = """hn as (select query_id, rank, id from (select r.query_id, r.id, r.rank, row_number() over (partition by r.query_id order by r.rank) as place
     from ranked r left join gold g on r.query_id = g.query_id and r.id = g.id where g.id is null) where place <= 10),
  gp as (select query_id, list(id order by id) as gold from gold group by query_id),
  np as (select query_id, list(id order by rank) as negatives from hn group by query_id),
  cx as (select query_id, gold, list_slice(negatives, 1, 8 - len(gold)) as neg from gp join np using (query_id) where len(negatives) >= 8 - len(gold) and len(gold) <= 8),
  ctx as (select query_id, gold, list_concat(gold, neg) as start_, list_concat(neg, gold) as end_,
     list_concat(list_concat(list_slice(neg, 1, len(neg) // 2), gold), list_slice(neg, len(neg) // 2 + 1, len(neg))) as middle_ from cx)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers of failed cases; every seventh one opens with a refusal."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("query_id"),
        F.col("lang").alias("dataset"),
        F.when(F.col("doc_id") % 2 == 0, "hard").otherwise("soft").alias("negative"),
        F.when(F.col("doc_id") % 3 == 0, "Lookup").when(F.col("doc_id") % 3 == 1, "Comparison").otherwise("Aggregation").alias("question_type"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("We cannot determine this. "), "text")).otherwise(F.col("text")).alias("answer"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_id, position, cell, norm): sentences of the benchmark items as cells of tables."""
    item = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("table_id"), F.posexplode(F.split("text", r"[.\n]")).alias("position", "cell"))
    return composed(item.withColumn("norm", F.col("cell")), "norm").withColumn("norm", collapsed(F.col("norm")))


def case_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, table_id, is_gold): a case sees the items of its residue class, and every fourth item is gold."""
    item = read(spark, sf_dir, "benchmark").select("item_id").distinct()
    ids = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"))
    return ids.join(item, F.col("query_id") % 10 == F.col("item_id") % 10).select("query_id", F.col("item_id").alias("table_id"), (F.col("item_id") % 4 == 0).alias("is_gold"))


def norm_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


ANSWERS = """answers as (select doc_id as query_id, lang as dataset, case when doc_id % 2 = 0 then 'hard' else 'soft' end as negative,
  case doc_id % 3 when 0 then 'Lookup' when 1 then 'Comparison' else 'Aggregation' end as question_type,
  case when doc_id % 7 = 0 then concat('We cannot determine this. ', text) else text end as answer from documents)"""


def errors_sql(refusals: list[str]) -> str:
    listed = ", ".join("'" + r.replace("'", "''") + "'" for r in refusals)
    return f"""{ANSWERS},
  items as (select item_id, i - 1 as position, parts[i] as cell from (select item_id, regexp_split_to_array(text, '[.\\n]') as parts from benchmark), unnest(range(1, len(parts) + 1)) r(i)),
  cells as (select query_id, item_id as table_id, position, cell, item_id % 4 = 0 as is_gold, {norm_sql('cell')} as norm from (select doc_id as query_id from documents) join items on query_id % 10 = item_id % 10),
  norms as (select query_id, {norm_sql('answer')} as na from answers),
  held as (select c.* from cells c join norms n using (query_id) where not is_gold and length(norm) >= 2 and regexp_matches(norm, '[\\p{{L}}\\p{{N}}]')
     and not exists (select 1 from cells g where g.query_id = c.query_id and g.is_gold and g.norm = c.norm) and contains(n.na, c.norm)),
  best as (select query_id, table_id, cell from (select *, row_number() over (partition by query_id order by length(norm) desc, table_id, position, cell) as r from held) where r = 1),
  ref as (select query_id, (list_filter([{listed}], lambda p: contains(na, p)))[1] as phrase from norms),
  errors as (select a.query_id, dataset, negative, question_type,
     case when b.cell is not null then 'Distractor Extraction' when phrase is not null then 'Premature Refusal' else 'Reasoning Hallucination' end as final_error_type,
     case when b.cell is not null then 'distractor_specific_cell_rule' when phrase is not null then 'explicit_refusal_rule' else 'residual_reasoning_rule' end as label_source,
     cast(b.table_id as varchar) as matched_table, b.cell as matched_cell, case when b.cell is null then phrase end as matched_phrase
     from answers a left join best b using (query_id) left join ref using (query_id))"""


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as two raters, with the language of the document as stratum."""
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("stratum"), "n_chars", "source"), "doc_id").select("doc_id", "stratum", "source", "n_chars", F.col("quality").alias("a"), F.col("toxic").alias("b"))


RATERS = "raters as (select doc_id, lang as stratum, source, n_chars, quality as a, toxic as b from labels join documents using (doc_id))"


def dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the answer that follows, and token counts that are partly missing."""
    c = read(spark, sf_dir, "conversations")
    answer = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.filter("role = 'user'").join(answer, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("question"), "answer", (F.col("conv_id") % 3).alias("request_tokens"), (F.col("conv_id") % 2).alias("response_tokens"))


DIALOG = """dialog as (select u.conv_id, u.turn, u.text as question, a.text as answer, u.conv_id % 3 as request_tokens, u.conv_id % 2 as response_tokens
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant')"""
