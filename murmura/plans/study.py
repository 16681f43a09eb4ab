"""Queries of the study's files, names, record joins, reports and samples, with the SQL that checks them.

Readers and sinks run over files that the query first writes from the test tables, into
the folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from murmura.functions import names as N
from murmura.functions import text as T
from murmura.operators import agree, anatomy, audit, context, cost, records, relevance, retrieve, robustness, sampling
from murmura.plans import plugins
from murmura.plans import views as V
from murmura.plans.catalog import _ERRORS, _KEYS, _MOVES, _NRR, CELL, _errors, _moves, query, with_
from murmura.sources import readers, writers
from murmura.sources.shared import scratch
from murmura.streaming import totals
from murmura.streaming.runner import Runner, run_all

# Files


def _written(spark, lines, name="value"):
    """The path of text files with one column of lines."""
    path = scratch(spark)
    lines.select(F.col(name).alias("value")).write.text(path)
    return path


def _table_lines(spark, sf_dir):
    """Every region as a table line: its nations are rows, lists of cells in even regions and CSV lines in odd ones; an older line of each id comes first, a broken one last."""
    nation = V.read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit(", \"x\""))).alias("cells"))
    quoted = F.concat(F.get("cells", F.lit(0)), F.lit(',"'), F.replace(F.get("cells", F.lit(1)), F.lit('"'), F.lit('""')), F.lit('"'))
    rows = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "cells", quoted.alias("line")))).alias("r"))
    met = V.read(spark, sf_dir, "region").join(rows, F.col("r_regionkey") == F.col("n_regionkey"))
    lists, lines = F.to_json(F.transform("r", lambda x: x["cells"])), F.to_json(F.transform("r", lambda x: x["line"]))
    body = F.when(F.col("r_regionkey") % 2 == 0, lists).otherwise(lines)
    headers = [F.lit('"key,name"'), F.lit('["key, \\"na, me\\", \\\\\\"x"]'), F.lit('["Name, first", "Age"]'), F.lit('["k,\\"na, me\\""]')]
    header = F.element_at(F.array(*headers), (F.col("r_regionkey") % 4 + 1).cast("int"))
    entry = lambda file, rows: F.concat(F.lit('{"id":"t'), F.col("r_regionkey").cast("string"), F.lit('","file_name":"'), file, F.lit('","header":'), header, F.lit(',"instances":'), rows, F.lit("}"))
    texts = F.concat_ws("\n", entry(F.lit("old"), F.lit("[]")), entry(F.col("r_name"), body), F.lit('{"id": broken'))
    return _written(spark, met.select(texts.alias("value")).coalesce(1))


_REGIONS = "n as (select n_regionkey, n_nationkey, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as row, cast(n_nationkey as varchar) as a, n_name || ', \"x\"' as b from nation)"


@query(with_(_REGIONS) + "select 't' || r_regionkey as id, r_name as file_name, case r_regionkey % 4 when 0 then 'key|name' when 1 then 'key|\"na|me\"|\"x' when 2 then 'Name, first|Age' else 'k|na, me' end as header, string_agg(a || '|' || b, ';' order by n_nationkey) as rows from region join n on r_regionkey = n_regionkey group by all")
def read_tables(spark, sf_dir):
    found = readers.tables(spark, _table_lines(spark, sf_dir))
    joined = lambda rows: F.array_join(F.transform(rows, lambda r: F.array_join(r, "|")), ";")
    return found.select("id", "file_name", joined(F.col("header")).alias("header"), joined(F.col("instances")).alias("rows"))


@query(with_(_REGIONS, "c as (select 't' || n_regionkey as table_id, row, 0 as col, a as cell from n union all select 't' || n_regionkey, row, 1, b from n)") + "select table_id, cast(row as integer) as row, col, cast(row_number() over (partition by table_id order by row, col) - 1 as integer) as position, cell from c where trim(cell) <> ''")
def table_cells(spark, sf_dir):
    return readers.cell_map(readers.tables(spark, _table_lines(spark, sf_dir)))


def _lines(spark, sf_dir):
    """Parts as CSV lines: a quote after a blank, which is no quote; nothing; an escaped comma; plain cells; a quoted cell with doubled quotes, and with escaped ones."""
    key = F.col("p_partkey").cast("string")
    kinds = [F.concat(key, F.lit(', " a ""b"" ,c" ,')), F.lit(""), F.concat(F.lit("x\\,y,"), key), F.concat_ws(",", "p_name", "p_brand"), F.concat(key, F.lit(',"  ""b"" ,c",')), F.concat(key, F.lit(',"a \\"b\\" ,c",'))]
    line = F.element_at(F.array(*kinds), (F.col("p_partkey") % 6 + 1).cast("int"))
    return V.read(spark, sf_dir, "part").select("p_partkey", line.alias("line"))


@query("""select p_partkey, case p_partkey % 6 when 0 then p_partkey || '|" a ""b""|c"|' when 1 then '' when 2 then 'x,y|' || p_partkey when 3 then trim(p_name) || '|' || trim(p_brand)
  when 4 then p_partkey || '|"b" ,c|' else p_partkey || '|a "b" ,c|' end as cells from part""")
def csv_row_parse(spark, sf_dir):
    return _lines(spark, sf_dir).select("p_partkey", F.array_join(readers.csv_cells(F.col("line")), "|").alias("cells"))


@query("""select p_partkey, case p_partkey % 6 when 0 then p_partkey || '| " a ""b"" |c" |' when 1 then '' when 2 then 'x\\|y|' || p_partkey when 3 then p_name || '|' || p_brand
  when 4 then p_partkey || '|  "b" ,c|' else p_partkey || '|a \\b\\" |c"|' end as cells from part""")
def csv_row_parse_plain(spark, sf_dir):
    return _lines(spark, sf_dir).select("p_partkey", F.array_join(readers.csv_cells_plain(F.col("line")), "|").alias("cells"))


def _query_lines(spark, sf_dir):
    """Every benchmark item as a question line, under either name of its key and its answer, with gold tables t0 to t6 of which t5 and t6 do not exist; a broken line beside each, and an older line for every third."""
    item = V.read(spark, sf_dir, "benchmark")
    key = F.concat(F.lit("q"), F.col("item_id").cast("string"))
    gold = F.array(*(F.struct(F.concat(F.lit("t"), ((F.col("item_id") + i) % 7).cast("string")).alias("id")) for i in (0, 2)))
    new = F.when(F.col("item_id") % 2 == 0, F.to_json(F.struct(key.alias("query_id"), F.substring("text", 1, 40).alias("question"), gold.alias("ground_truth_list"), F.lit("yes").alias("answer"))))
    new = new.otherwise(F.to_json(F.struct(key.alias("id"), F.substring("text", 1, 40).alias("question"), gold.alias("ground_truth_list"), F.lit("select 1").alias("sql"))))
    old = F.when(F.col("item_id") % 3 == 0, F.to_json(F.struct(key.alias("query_id"), F.lit("old").alias("question"))))
    return _written(spark, item.select(F.concat_ws("\n", old, new, F.lit('{"question": ')).alias("value")).coalesce(1))


_ASKED = "a as (select 'q' || item_id as query_id, text[1:40] as question, 't' || (item_id % 7) as g0, 't' || ((item_id + 2) % 7) as g1, case when item_id % 2 = 0 then 'yes' else 'select 1' end as answer, item_id from benchmark)"


@query(with_(_ASKED) + "select query_id, question, g0 || ',' || g1 as gold, answer from a union all select 'q' || item_id, 'old', '', null from benchmark where item_id % 3 = 0")
def read_queries(spark, sf_dir):
    found = readers.queries(spark, _query_lines(spark, sf_dir))
    return found.select("query_id", "question", F.array_join("gold_ids", ",").alias("gold"), "answer")


@query(with_(_ASKED) + "select query_id, question, answer from a")
def keyed_load(spark, sf_dir):
    return readers.last_by_key(readers.queries(spark, _query_lines(spark, sf_dir))).select("query_id", "question", "answer")


@query(with_(_ASKED) + "select query_id, case when item_id % 3 = 0 then 'old' else question end as question from a")
def first_load(spark, sf_dir):
    return readers.first_by(readers.queries(spark, _query_lines(spark, sf_dir)), "query_id").select("query_id", "question")


@query(with_(_ASKED) + "select query_id, g0 || ',' || g1 as gold from a")
def gold_map(spark, sf_dir):
    return readers.gold_map(readers.queries(spark, _query_lines(spark, sf_dir))).select("query_id", F.array_join("gold_ids", ",").alias("gold"))


@query(with_(_ASKED, "g as (select query_id, 0 as p, g0 as id from a union all select query_id, 1, g1 from a)") + "select query_id, string_agg(r_name, ',' order by p) as tables from g join region on id = 't' || r_regionkey group by query_id")
def attach_tables(spark, sf_dir):
    asked = readers.last_by_key(readers.queries(spark, _query_lines(spark, sf_dir)))
    met = readers.attach_tables(asked, readers.tables(spark, _table_lines(spark, sf_dir)))
    return met.select("query_id", F.array_join(F.transform("tables", lambda t: t["file_name"]), ",").alias("tables"))


@query("select conv_id, turn, role from conversations")
def read_records(spark, sf_dir):
    """Lines with broken ones, a list, and documents that hold the list in records, results or data: four documents, each of a fifth of the table and without a line break between its records."""
    rows = V.read(spark, sf_dir, "conversations").withColumn("kind", F.col("conv_id") % 5)
    path, entry = scratch(spark), F.struct("conv_id", "turn", "role")
    rows.filter("kind = 0").select("kind", F.concat(F.to_json(entry), F.lit("\n{broken")).alias("value")).write.partitionBy("kind").mode("append").text(path)
    name = F.element_at(F.array(F.lit("records"), F.lit("results"), F.lit("data")), F.greatest(F.col("kind") - 1, F.lit(1)).cast("int"))
    ends = rows.select("kind").filter("kind > 0").distinct().withColumn("end", F.explode(F.array(F.lit(0), F.lit(2))))
    opened = F.when(F.col("kind") == 1, F.lit("[")).otherwise(F.concat(F.lit('{"'), name, F.lit('": [')))
    closed = F.when(F.col("kind") == 1, F.lit("{}]")).otherwise(F.lit('1], "other": [{"conv_id": 0}]}'))
    parts = ends.select("kind", F.col("end").alias("place"), F.when(F.col("end") == 0, opened).otherwise(closed).alias("value"))
    parts = parts.unionByName(rows.filter("kind > 0").select("kind", F.lit(1).alias("place"), F.concat(F.to_json(entry), F.lit(", ")).alias("value")))
    parts.repartition("kind").sortWithinPartitions("kind", "place").select("kind", "value").write.partitionBy("kind").option("lineSep", " ").mode("append").text(path)
    found = readers.records(spark, path, "conv_id bigint, turn bigint, role string").filter("conv_id is not null")
    return found.withColumn("turn", F.col("turn").cast(dict(rows.dtypes)["turn"]))


@query("select 'd' || doc_id as id, md5(text) as representation_md5, lang from documents")
def read_representations(spark, sf_dir):
    d = V.read(spark, sf_dir, "documents")
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    meta = F.create_map(F.lit("lang"), F.col("lang"))
    new = F.when(F.col("doc_id") % 4 == 0, F.to_json(F.struct(key.alias("id"), F.col("text").alias("representation"), meta.alias("metadata")))).otherwise(F.to_json(F.struct(key.alias("table_id"), F.col("text").alias("representation"), meta.alias("metadata"))))
    old = F.to_json(F.struct(key.alias("id"), F.lit("old").alias("representation")))
    found = readers.representations(spark, _written(spark, d.select(F.concat_ws("\n", old, new).alias("value"))))
    return found.select("id", F.md5("representation").alias("representation_md5"), F.col("metadata")["lang"].alias("lang"))


@query(with_(V.RETRIEVAL) + "select cast(query_id as varchar) as question, cast(rank as integer) as rank, cast(id as varchar) as id, score from ranked where rank <= 5")
def cached_retrieval(spark, sf_dir):
    queries, corpus, _ = V.retrieval(spark, sf_dir)
    path = scratch(spark)
    writers.retrieval_lines(retrieve.cosine_topk(queries, corpus, 10).withColumn("question", F.col("query_id").cast("string")), path)
    return readers.retrievals(spark, path, 5)


@query("select 'cosine_dims=8' as index_key, count(*) as n from embeddings where vec_id % 2 = 0 union all select 'cosine_dims=9', count(*) from embeddings where vec_id % 3 = 0")
def vector_index_keys(spark, sf_dir):
    """Three indexes are written, one of them twice, and one is deleted."""
    e, path = V.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), scratch(spark)
    key = lambda dims: N.index_key("cosine", N.typed_params([f"dims={dims}"]))
    for rows, dims in ((e, 8), (e, 7), (e.filter("id % 3 = 0"), 9), (e.filter("id % 2 = 0"), 8)):
        writers.vector_index(rows, path, key(dims))
    writers.delete_index(spark, path, key(7))
    return writers.index_keys(spark, path)


@query("select cast(o_orderkey as double) as \"key\", case when o_orderkey % 3 = 0 then null else cast(o_orderkey % 100 as double) / 4 end as value, o_orderpriority as name from orders where o_orderkey % 5 <> 0")
def results_table(spark, sf_dir):
    """A CSV with a byte-order mark, numbers as text, some of them none; rows without the needed number go."""
    o = V.read(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(((F.col("o_orderkey") % 100) / 4).cast("string"))
    key = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderkey").cast("string"))
    path = scratch(spark)
    writers.csv_report(o.select(key.alias("﻿key"), value.alias("value"), F.col("o_orderpriority").alias("name")), path)
    return records.numeric(readers.results_csv(spark, path), ["key", "value"], ["key"])


@query("select r_regionkey as part, sha256(string_agg(n_nationkey || ',' || n_name || chr(10), '' order by n_nationkey)) as sha256, count(*) as lines from nation join region on n_regionkey = r_regionkey group by r_regionkey")
def gzip_digest(spark, sf_dir):
    path = scratch(spark)
    nation = V.read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.concat_ws(",", "n_nationkey", "n_name").alias("value"))
    for i in range(5):
        nation.filter(F.col("n_regionkey") == i).repartition(1).sortWithinPartitions("n_nationkey").select("value").write.option("compression", "gzip").text(f"{path}/part={i}")
    found = [readers.gzip_contents(spark, f"{path}/part={i}").select(F.lit(i).alias("part"), "sha256", "lines") for i in range(5)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    kind = dict(V.read(spark, sf_dir, "region").dtypes)["r_regionkey"]
    return out.withColumn("part", F.col("part").cast(kind))


@query("select 'reader-' || s_suppkey as model, cast(s_suppkey as decimal(18,6)) / 100 as rate_in, cast(s_suppkey as decimal(18,6)) / 50 as rate_out from supplier")
def price_parse(spark, sf_dir):
    """A list of prices for every fifty suppliers."""
    s = V.read(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey").cast("decimal(18,6)")).withColumn("list", F.expr("s_suppkey div 50"))
    entry = F.concat(F.lit("  reader-"), F.col("s_suppkey").cast("string"), F.lit(":\n    input: "), (F.col("k") / 100).cast("decimal(18,6)").cast("string"), F.lit("\n    output: "), (F.col("k") / 50).cast("decimal(18,6)").cast("string"))
    text = s.groupBy("list").agg(F.concat(F.lit("# rates\nmodels:\n"), F.array_join(F.collect_list(entry), "\n")).alias("value"))
    path = scratch(spark)
    text.write.partitionBy("list").text(path)
    found = readers.prices(spark, path)
    return found.select("model", F.col("rate_in").cast("decimal(18,6)").cast("double").alias("rate_in"), F.col("rate_out").cast("decimal(18,6)").cast("double").alias("rate_out"))


@query("select n_name as name, cast(n_regionkey as varchar) as region from nation where n_nationkey % 2 = 1 union all select n_name, cast(n_regionkey as varchar) from nation")
def report_append(spark, sf_dir):
    nation, path = V.read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"), "n_nationkey"), scratch(spark)
    writers.csv_report(nation.filter("n_nationkey % 2 = 1").drop("n_nationkey"), path)
    writers.csv_report(nation.drop("n_nationkey"), path, append=True)
    return readers.results_csv(spark, path)


# Names


_KEY = ["l_orderkey", "l_linenumber"]
#: File names of the conditions in the trials: by line number plain ones, perfect ones, real results, and some that fit no form.
_FILE = """f as (select l_orderkey, l_linenumber, case l_linenumber when 5 then case when l_suppkey % 2 = 0 then '1' else '1_perfect' end when 6 then 'real_result_' || case when l_suppkey % 3 = 0 then negative else cast(l_partkey as varchar) end
    when 7 then rotation || '_' || l_suppkey || '_' || negative else k || '_' || case when l_suppkey % 5 = 0 then 'r' || l_suppkey else rotation end || '_' || negative end || '.jsonl' as name from trial),
  b as (select *, regexp_replace(name, '[.][^.]*$', '') as base, try_cast(regexp_extract(name, '^([0-9]+)_', 1) as int) as lead from f)"""


def _files(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    one = F.when(F.col("l_suppkey") % 2 == 0, "1").otherwise("1_perfect")
    real = F.concat(F.lit("real_result_"), F.when(F.col("l_suppkey") % 3 == 0, F.col("negative")).otherwise(text("l_partkey")))
    turn = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("r"), text("l_suppkey"))).otherwise(F.col("rotation"))
    name = F.when(F.col("l_linenumber") == 5, one).when(F.col("l_linenumber") == 6, real).when(F.col("l_linenumber") == 7, F.concat_ws("_", "rotation", text("l_suppkey"), "negative")).otherwise(F.concat_ws("_", text("k"), turn, "negative"))
    return V.trial(spark, sf_dir).select(*_KEY, F.concat(name, F.lit(".jsonl")).alias("name"))


@query(with_(V.TRIAL, _FILE) + """select l_orderkey, l_linenumber, name,
  cast(case when regexp_full_match(base, 'real_result_[0-9]+') then cast(substring(base, 13) as bigint) else coalesce(try_cast(regexp_extract(base, '^([0-9]+)(_|$)', 1) as bigint), 0) end as integer) as k,
  case when regexp_full_match(base, 'real_result_[0-9]+') then 'real_result' when base = '1' then '' else split_part(base, '_', 2) end as rotation,
  case when regexp_full_match(base, 'real_result_[0-9]+') then 'real_result' when base = '1_perfect' then 'perfect' else split_part(base, '_', 3) end as negative from b""")
def parse_condition_name(spark, sf_dir):
    return _files(spark, sf_dir).select(*_KEY, "name", T.condition_of(F.col("name")).alias("c")).select(*_KEY, "name", "c.*")


@query(with_(V.TRIAL, _FILE) + """select l_orderkey, l_linenumber, cast(case when base in ('1', '1_perfect') then 1 else coalesce(try_cast(split_part(base, '_', 1) as bigint), 0) end as integer) as k,
  case when base in ('1', '1_perfect') then '' else split_part(base, '_', 2) end as rotation, case when base in ('1', '1_perfect') then '' else split_part(base, '_', 3) end as negative from b""")
def parse_condition_plain(spark, sf_dir):
    return _files(spark, sf_dir).select(*_KEY, N.plain_condition(F.col("name")).alias("c")).select(*_KEY, "c.*")


@query(with_(V.TRIAL, _FILE) + """select l_orderkey, l_linenumber, cast(case when real is not null then real when perfect then 1 when lead is not null and split_part(base, '_', 3) <> '' then lead else 999 end as integer) as k,
  cast(case when real is not null then -1 when perfect then 0 when lead is null or split_part(base, '_', 3) = '' then 999 else case split_part(base, '_', 2) when 'start' then 1 when 'middle' then 2 when 'end' then 3 else 99 end end as integer) as rotation,
  cast(case when real is not null then -1 when perfect then 0 when lead is null or split_part(base, '_', 3) = '' then 999 else case split_part(base, '_', 3) when 'hard' then 0 when 'soft' then 1 else 99 end end as integer) as negative
  from (select *, try_cast(regexp_extract(base, '^real_result_([0-9]+)$', 1) as int) as real, base = '1_perfect' as perfect from b)""")
def processing_order(spark, sf_dir):
    return _files(spark, sf_dir).select(*_KEY, N.processing_order(F.col("name")).alias("c")).select(*_KEY, "c.*")


_REPORT = """f as (select l_orderkey, l_linenumber, 'm' || reader || case when l_suppkey % 4 = 0 then '_K' || l_suppkey || '-x' else '' end || case when l_linenumber = 7 then '_notes' else '_K' || k end ||
    case when l_linenumber % 2 = 1 then '_distribution' else '_' || negative || '_' || case l_partkey % 5 when 0 then 'both_success' when 1 then 'both_fail' when 2 then 'perfect_to_fail' when 3 then 'perfect_from_fail' else rotation end || '_errors' end || '.json' as name from trial),
  d as (select *, regexp_extract(name, '^(.+)_K([0-9]+)_distribution[.]json$', ['model', 'k']) as d,
    regexp_extract(name, '^(.+)_K([0-9]+)_(hard|soft)_(both_success|both_fail|perfect_to_fail|perfect_from_fail)_errors[.]json$', ['model', 'k', 'negative', 'category']) as e from f)"""


@query(with_(V.TRIAL, _REPORT) + "select l_orderkey, l_linenumber, nullif(d.model, '') as model, try_cast(d.k as integer) as k, nullif(e.model, '') as error_model, try_cast(e.k as integer) as error_k, nullif(e.negative, '') as negative, nullif(e.category, '') as category from d")
def report_names(spark, sf_dir):
    t, text = V.trial(spark, sf_dir), lambda c: F.col(c).cast("string")
    more = F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("_K"), text("l_suppkey"), F.lit("-x"))).otherwise("")
    depth = F.when(F.col("l_linenumber") == 7, "_notes").otherwise(F.concat(F.lit("_K"), text("k")))
    category = F.element_at(F.array(*(F.lit(c) for c in anatomy.CATEGORIES), F.col("rotation")), (F.col("l_partkey") % 5 + 1).cast("int"))
    end = F.when(F.col("l_linenumber") % 2 == 1, "_distribution").otherwise(F.concat(F.lit("_"), F.col("negative"), F.lit("_"), category, F.lit("_errors")))
    rows = t.select(*_KEY, F.concat(F.lit("m"), text("reader"), more, depth, end, F.lit(".json")).alias("name"))
    found = rows.select(*_KEY, N.distribution_file(F.col("name")).alias("d"), N.error_file(F.col("name")).alias("e"))
    return found.select(*_KEY, "d.model", "d.k", F.col("e.model").alias("error_model"), F.col("e.k").alias("error_k"), F.col("e.negative").alias("negative"), F.col("e.category").alias("category"))


@query("""with c as (select p_partkey, case when p_partkey % 3 = 0 then p_type else upper(substring(p_type, 1, 1)) || lower(substring(p_type, 2)) end || upper(substring(p_name, 1, 1)) || replace(substring(p_name, 2), ' ', 'X')
    || case when p_size % 4 = 0 then '' else 'Strategy' end as name from part),
  s as (select *, case when ends_with(name, 'Strategy') then substring(name, 1, length(name) - 8) else name end as base from c)
  select p_partkey, name, lower(regexp_replace(regexp_replace(base, '(.)([A-Z][a-z])', '\\1-\\2', 'g'), '([a-z])([A-Z])', '\\1-\\2', 'g')) as log_name from s""")
def strategy_names(spark, sf_dir):
    """Class names from a part's type, all capitals in every third, and its name."""
    first = lambda c: F.upper(F.substring(c, 1, 1))
    rest = lambda c: F.substring(F.col(c), F.lit(2), F.char_length(c))
    kind = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.concat(first("p_type"), F.lower(rest("p_type"))))
    name = F.concat(kind, first("p_name"), F.replace(rest("p_name"), F.lit(" "), F.lit("X")), F.when(F.col("p_size") % 4 == 0, "").otherwise("Strategy"))
    return V.read(spark, sf_dir, "part").select("p_partkey", name.alias("name"), N.strategy_name(name).alias("log_name"))


@query("""with m as (select p_partkey, case when p_size % 3 = 0 then '' else lower(p_type) || '/' end || replace(lower(p_brand), '#', '-') || case when p_size % 4 = 0 then '' else ':' || p_size end as model,
    case p_partkey % 5 when 0 then 'openrouter' when 1 then 'ollama' when 2 then 'fireworks' when 3 then 'groq' else 'own' end as provider,
    case p_size % 5 when 0 then ' E2E-WTQ ' when 1 then 'FeTa QA' when 2 then 'ott_qa' else ' ' || p_type || ' ' || p_name end as dataset, case p_size % 4 when 0 then 'bge-m3' when 1 then 'BGEM3' else p_type end || case when p_partkey % 2 = 0 then 'Retriever' else '' end as retriever from part),
  w as (select *, split_part(model, '/', -1) as last from m)
  select p_partkey, case when provider in ('fireworks', 'groq') then last when provider = 'openrouter' then case when contains(model, '/') then split_part(last, ':', 1) else model end
    when provider = 'ollama' and contains(model, ':') then split_part(model, ':', 1) || '-' || split_part(model, ':', 2) else model end as display, model || '_real_result' as other,
    case lower(replace(trim(dataset), ' ', '')) when 'e2e-wtq' then 'e2ewtq' when 'fetaqa' then 'feta' when 'ott_qa' then 'ottqa' else lower(replace(trim(dataset), ' ', '')) end as dataset,
    case when regexp_replace(retriever, 'Retriever$', '') in ('bge-m3', 'BGEM3') then 'BGEM3' else regexp_replace(retriever, 'Retriever$', '') end as retriever from w""")
def model_and_dataset_names(spark, sf_dir):
    """Models, providers, datasets and retrievers named after parts."""
    pick = lambda by, many, *texts: F.element_at(F.array(*(t if isinstance(t, Column) else F.lit(t) for t in texts)), (F.col(by) % many + 1).cast("int"))
    model = F.concat(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lower("p_type"), F.lit("/"))), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.concat(F.lit(":"), F.col("p_size").cast("string"))))
    own = F.concat(F.lit(" "), "p_type", F.lit(" "), "p_name")
    retriever = F.concat(pick("p_size", 4, "bge-m3", "BGEM3", F.col("p_type"), F.col("p_type")), F.when(F.col("p_partkey") % 2 == 0, "Retriever").otherwise(""))
    return V.read(spark, sf_dir, "part").select(
        "p_partkey", N.display_model(model, pick("p_partkey", 5, "openrouter", "ollama", "fireworks", "groq", "own")).alias("display"), F.element_at(N.model_names(model), 2).alias("other"),
        T.dataset_name(pick("p_size", 5, " E2E-WTQ ", "FeTa QA", "ott_qa", own, own)).alias("dataset"), N.retriever_name(retriever).alias("retriever"),
    )


_REPLY = """r as (select o_orderkey, case o_orderkey % 4 when 0 then 'ERROR_TYPE: ' || kind || chr(10) || 'CONFIDENCE: ' || o_orderkey % 100 || '.5' when 1 then 'error_type: first' || chr(10) || '  ERROR_TYPE :  ' || kind || '  ' || chr(10) || 'confidence: ' || o_orderstatus
    when 2 then 'QUESTION_TYPE: ' || o_orderstatus || chr(10) || 'the reason: ' || kind else 'said ERROR_TYPE: none' || chr(10) || 'Question_Type: ' || o_orderpriority end as reply
  from (select *, case o_custkey % 5 when 0 then 'a DISTRACTOR ' || o_orderpriority when 1 then 'Premature ' || o_orderstatus when 2 then o_orderpriority || ' truncation' else o_orderpriority end as kind from orders)),
  x as (select o_orderkey, regexp_extract_all(reply, '(?im)^\\s*ERROR_TYPE\\s*:\\s*(.*?)\\s*$', 1)[-1] as raw, regexp_extract_all(reply, '(?im)^\\s*QUESTION_TYPE\\s*:\\s*(.*?)\\s*$', 1)[-1] as question_type,
    regexp_extract_all(reply, '(?im)^\\s*CONFIDENCE\\s*:\\s*(.*?)\\s*$', 1)[-1] as c from r)"""


@query(with_(_REPLY) + "select o_orderkey, raw, case when contains(lower(raw), 'distractor') then 'Distractor Extraction' when regexp_matches(lower(raw), 'premature|refusal|truncation') then 'Premature Refusal' else 'Reasoning Hallucination' end as label, question_type, try_cast(c as double) as confidence from x")
def reader_replies(spark, sf_dir):
    """Replies of a reader made of an order's priority, status and keys: labels in either case, several of one kind, none, and numbers that are none."""
    o, text = V.read(spark, sf_dir, "orders"), lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    kind = F.element_at(F.array(text("a DISTRACTOR ", priority), text("Premature ", status), text(priority, " truncation"), priority, priority), (F.col("o_custkey") % 5 + 1).cast("int"))
    forms = [
        text("ERROR_TYPE: ", kind, "\nCONFIDENCE: ", (F.col("o_orderkey") % 100).cast("string"), ".5"), text("error_type: first\n  ERROR_TYPE :  ", kind, "  \nconfidence: ", status),
        text("QUESTION_TYPE: ", status, "\nthe reason: ", kind), text("said ERROR_TYPE: none\nQuestion_Type: ", priority),
    ]
    reply = F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int"))
    raw = T.labelled_line(reply, "ERROR_TYPE")
    return o.select("o_orderkey", raw.alias("raw"), T.error_label_of(raw).alias("label"), T.labelled_line(reply, "QUESTION_TYPE").alias("question_type"), T.labelled_line(reply, "CONFIDENCE").try_cast("double").alias("confidence"))


@query("with c as (select l_orderkey, l_linenumber, (cast(round(l_extendedprice * 100) as bigint) * 5 + 2) // 4 as x from lineitem) select l_orderkey, l_linenumber, (x // 1000) || '.' || lpad(cast(x % 1000 as varchar), 3, '0') as shown from c")
def half_up_rounding(spark, sf_dir):
    line = V.read(spark, sf_dir, "lineitem").withColumn("x", F.col("l_extendedprice").cast("decimal(18,4)") / 8)
    return line.select("l_orderkey", "l_linenumber", T.half_up(F.col("x"), 3).cast("decimal(18,3)").cast("string").alias("shown"))


@query("""select sha256('[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","empty":null}', ',' order by n_nationkey) || ']') as digest from nation""")
def columns_digest(spark, sf_dir):
    rows = V.read(spark, sf_dir, "nation").withColumn("empty", F.lit(None).cast("string"))
    return audit.column_digest(rows, ["n_nationkey", "n_name", "empty"], ["n_nationkey"])


# Joins of records

_DOCS = "docs as (select doc_id, text, lang, 'd' || (doc_id % 97) as id from documents)"


@query(with_(V.RETRIEVAL, "t as (select query_id, rank, md5(text[1:200]) as m from ranked join documents on doc_id = id and doc_id % 3 <> 0 where rank <= 8)") + "select q.query_id, count(m) as n_tables, md5(coalesce(string_agg(m, ',' order by rank), '')) as tables_md5 from (select distinct query_id from ranked) q left join t using (query_id) group by q.query_id")
def injected_tables(spark, sf_dir):
    queries, corpus, _ = V.retrieval(spark, sf_dir)
    contexts = context.real_result_context(retrieve.cosine_topk(queries, corpus, 20), 20)
    reps = V.read(spark, sf_dir, "documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.col("text").alias("representation"))
    found = records.injected_tables(contexts, reps, most_tokens=50, first=8)
    return found.select("query_id", F.size("tables").cast("long").alias("n_tables"), F.md5(F.array_join(F.transform("tables", lambda x: F.md5(x)), ",")).alias("tables_md5"))


@query(with_(V.RETRIEVAL, "t as (select query_id, string_agg(text, '' order by rank) as joined from ranked join documents on doc_id = id where rank <= 5 group by query_id)", "r as (select vec_id as query_id, vec_id % 3 as rq, vec_id % 2 as rs, 'answer of ' || vec_id as answer from embeddings where vec_id % 2 = 0)") + """
  select r.query_id, answer, cast(case when rq > 0 and rs > 0 then rq when k.query_id is null then 0 else greatest(1, (length('question ' || r.query_id) + coalesce(length(joined), 0)) // 4) end as bigint) as request_tokens,
  cast(case when rq > 0 and rs > 0 then rs else greatest(1, length(answer) // 4) end as bigint) as response_tokens, not (rq > 0 and rs > 0) as filled from r left join t using (query_id) left join (select distinct query_id from ranked) k using (query_id)""")
def filled_tokens(spark, sf_dir):
    queries, corpus, _ = V.retrieval(spark, sf_dir)
    contexts = context.ordered_ids(retrieve.cosine_topk(queries, corpus, 5), "injection")
    reps = V.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("representation"))
    key = F.col("vec_id")
    results = V.read(spark, sf_dir, "embeddings").filter("vec_id % 2 = 0").select(key.alias("query_id"), F.concat(F.lit("answer of "), key.cast("string")).alias("answer"), (key % 3).alias("request_tokens"), (key % 2).alias("response_tokens"))
    asked = queries.select("query_id", F.concat(F.lit("question "), F.col("query_id").cast("string")).alias("question"))
    return records.filled_tokens(results, asked, contexts, reps)


_BY_QUESTION = "a as (select source as question, doc_id from documents), r as (select distinct source as question, lang as id from documents)"


@query(with_(_BY_QUESTION) + "select r.question, id, f.query_id as first_query, l.query_id as last_query from r join (select question, min(doc_id) as query_id from a group by question) f using (question) join (select question, max(doc_id) as query_id from a group by question) l using (question)")
def retrieval_by_question(spark, sf_dir):
    d = V.read(spark, sf_dir, "documents").select(F.col("source").alias("question"), F.col("doc_id").alias("query_id"), F.col("lang").alias("id"))
    found, asked = d.select("question", "id").distinct(), d.select("question", "query_id")
    one = records.by_question(found, asked, ["query_id"]).withColumnRenamed("query_id", "first_query")
    return records.by_question(one, asked, ["query_id"], last=True).withColumnRenamed("query_id", "last_query")


@query("with a as (select *, row_number() over (order by o_orderkey) as i from orders), b as (select *, row_number() over (order by o_totalprice, o_orderkey) as i from orders) select a.i, a.o_orderkey, b.o_totalprice from a join b using (i)")
def strict_zip(spark, sf_dir):
    o = V.read(spark, sf_dir, "orders")
    left = records.numbered(o.select("o_orderkey"), ["o_orderkey"], "i")
    right = records.numbered(o.select("o_totalprice", F.col("o_orderkey").alias("k")), ["o_totalprice", "k"], "i").drop("k")
    return audit.zipped(left, right, "i").select("i", "o_orderkey", "o_totalprice")


_IDENTITY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount"]


@query(f"with i as (select {', '.join(_IDENTITY)}, l_quantity from lineitem where l_linenumber <= 2), s as (select {', '.join(_IDENTITY)}, max(l_extendedprice) as l_extendedprice from lineitem where l_partkey % 3 <> 0 group by all) select i.*, s.l_extendedprice from i left join s using ({', '.join(_IDENTITY)})")
def identity_join(spark, sf_dir):
    line = V.read(spark, sf_dir, "lineitem")
    wanted = line.filter("l_linenumber <= 2").select(*_IDENTITY, "l_quantity")
    return records.identity_join(wanted, line.filter("l_partkey % 3 <> 0"), _IDENTITY, ["l_extendedprice"])


@query("with f as (select source, lang, min(doc_id) as doc_id from documents group by source, lang) select source, lang, doc_id, row_number() over (order by doc_id) as place from f")
def first_sight(spark, sf_dir):
    d = V.read(spark, sf_dir, "documents").select("source", "lang", "doc_id").withColumn("key", F.concat_ws("|", "source", "lang"))
    return records.first_of(d, "key", ["doc_id"]).select("source", "lang", "doc_id", "place")


@query("with k as (select doc_id, case when doc_id % 3 = 0 then 'x' || doc_id else cast(doc_id as varchar) end as id from documents) select doc_id, row_number() over (order by try_cast(id as bigint) is null, try_cast(id as bigint), id) as place from k")
def mixed_order(spark, sf_dir):
    d = V.read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("id"))
    a, b, c = sampling.id_order("id")
    return records.numbered(d.withColumns({"text_id": a, "number": b, "as_text": c}).withColumn("lead", F.coalesce("number", F.lit((1 << 63) - 1))), ["lead", "text_id", "as_text"], "place").select("doc_id", "place")


@query("select o_orderkey, o_custkey from orders order by o_custkey, o_orderkey limit 100")
def first_queries(spark, sf_dir):
    return V.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy("o_custkey", "o_orderkey").limit(100)


# Contexts of all conditions


@query(with_(V.RETRIEVAL, V.CONTEXT, """neg as (select query_id, 'hard' as negative, negatives from np union all select query_id, 'soft', list_reverse(negatives) from np),
  cond as (select * from (values (1, 'perfect', 'perfect')) v(k, rotation, negative) union all select * from (select unnest([5, 10]) as k), (select unnest(['start', 'middle', 'end']) as rotation), (select unnest(['hard', 'soft']) as negative)),
  al as (select cond.*, gp.query_id, gold, list_slice(coalesce(n.negatives, []), 1, k - len(gold)) as neg, coalesce(len(n.negatives), 0) as many from cond cross join gp left join neg n on n.query_id = gp.query_id and n.negative = cond.negative)""")
    + "select query_id, cast(k as integer) as k, rotation, negative, array_to_string(case when k = 1 then gold when rotation = 'start' then list_concat(gold, neg) when rotation = 'end' then list_concat(neg, gold) else list_concat(list_concat(list_slice(neg, 1, len(neg) // 2), gold), list_slice(neg, len(neg) // 2 + 1, len(neg))) end, ',') as injection from al where k = 1 or (len(gold) <= k and many >= k - len(gold))")
def context_batches(spark, sf_dir):
    queries, corpus, gold = V.retrieval(spark, sf_dir)
    hard = context.ordered_ids(context.hard_negatives(retrieve.cosine_topk(queries, corpus, max(V.GRID)), gold, 10), "negatives")
    made = context.batches(V.gold_pair(gold), {"hard": hard, "soft": hard.withColumn("negatives", F.reverse("negatives"))}, [1, 5, 10], ["start", "middle", "end"])
    return made.select("query_id", "k", "rotation", "negative", F.array_join(F.transform("injection", lambda x: x.cast("string")), ",").alias("injection"))


# Reports

_COUNTS = "count(*) as total, " + ", ".join(f"count(*) filter (where final_error_type = '{x}') as {n}" for x, n in zip(anatomy.LABELS, ("de", "pr", "rh")))


@query(with_(_ERRORS) + f"""select 'by_negative' as section, cast(null as varchar) as dataset, negative, cast(null as varchar) as question_type, {_COUNTS} from errors group by negative
  union all select 'by_dataset', dataset, negative, null, {_COUNTS} from errors group by negative, dataset
  union all select 'by_question', null, null, question_type, {_COUNTS} from errors group by question_type""")
def error_sections(spark, sf_dir):
    errors = _errors(spark, sf_dir)
    shares = ["de_share", "pr_share", "rh_share"]
    sections = {"by_negative": ["negative"], "by_dataset": ["negative", "dataset"], "by_question": ["question_type"]}
    made = anatomy.wide_sections({name: anatomy.crosstab(errors, [keys]).drop(*shares) for name, keys in sections.items()})
    return made.select("section", "dataset", "negative", "question_type", "total", "de", "pr", "rh")


_OLD = "case when query_id % 5 = 0 then 'a distractor was taken' when query_id % 5 = 1 then null else final_error_type end"
_WAS = f"case when contains(lower(coalesce({_OLD}, '')), 'distractor') then 'Distractor Extraction' when contains(lower(coalesce({_OLD}, '')), 'refusal') then 'Premature Refusal' else 'Reasoning Hallucination' end"


@query(with_(_ERRORS, f"r as (select dataset, final_error_type as now, {_WAS} as was, case when query_id % 4 = 0 then 'Premature Refusal' else {_WAS} end as said, matched_cell from errors)") + """select dataset, count(*) as total_cases, count(*) filter (where was <> now) as changed_cases, count(*) filter (where said = now) as agreement_count,
  count(*) filter (where now = 'Distractor Extraction') as final_de, count(*) filter (where now = 'Premature Refusal') as final_pr, count(*) filter (where now = 'Reasoning Hallucination') as final_rh,
  count(*) filter (where now = 'Distractor Extraction' and matched_cell is not null) as distractor_with_audit_cell, round(cast(count(*) filter (where said = now) as double) / count(*), 6) as agreement_rate from r group by rollup (dataset)""")
def relabel_summary(spark, sf_dir):
    new = _errors(spark, sf_dir)
    old = new.select("query_id", F.expr(_OLD).alias("error_type"), F.when(F.col("query_id") % 4 == 0, "premature").alias("diagnostic_type"))
    return anatomy.relabel_summary(old, new, ["dataset"])


@query(with_(V.TRIAL, _MOVES) + "select dataset, reader, category, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (partition by dataset, reader), 4) as percent from moves where k = 50 and negative = 'hard' group by dataset, reader, category")
def quadrant_stack(spark, sf_dir):
    """The figures' slice, target k 50 under hard negatives, as stacks of 100 percent."""
    counts = records.slice_of(_moves(spark, sf_dir), k=50, negative="hard").groupBy("dataset", "reader", "category").agg(F.count("*").alias("n"))
    found = records.share_within(counts, F.col("n"), ["dataset", "reader"])
    return found.withColumn("percent", F.round("percent", 4))


@query(with_(_ERRORS) + "select dataset, final_error_type, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (partition by dataset), 4) as percent from errors where negative = 'hard' and question_type = 'Lookup' group by dataset, final_error_type")
def lookup_slice(spark, sf_dir):
    counts = records.slice_of(_errors(spark, sf_dir), negative="hard", question_type="Lookup").groupBy("dataset", "final_error_type").agg(F.count("*").alias("n"))
    return records.share_within(counts, F.col("n"), ["dataset"]).withColumn("percent", F.round("percent", 4))


@query(with_(V.TRIAL) + "select dataset, k, round(avg(score), 6) as score from trial where k in (1, 10, 50) group by all")
def k_slice(spark, sf_dir):
    return records.slice_of(V.trial(spark, sf_dir), k=[1, 10, 50]).groupBy("dataset", "k").agg(F.round(F.avg("score"), 6).alias("score"))


@query(with_(V.TRIAL, _NRR) + "select dataset, reader, negative, k, abs(nrr - round(nrr + case when k = 20 then 0.01 else 0 end, 3)) <= 0.0006 as matches from nr")
def frozen_nrr(spark, sf_dir):
    found = robustness.noise_retention(V.trial(spark, sf_dir), CELL)
    frozen = found.select(*CELL, "k", F.round(F.col("nrr") + F.when(F.col("k") == 20, 0.01).otherwise(0.0), 3).alias("nrr"))
    return robustness.frozen_check(found, frozen, [*CELL, "k"]).select(*CELL, "k", "matches")


@query(with_(V.RETRIEVAL, V.metric_sql("gold")) + "select query_id, k, round(recall, 6) as recall, round(ndcg, 6) as ndcg, n_queries, round(mean_ndcg, 6) as mean_ndcg from m join (select k, count(*) as n_queries, avg(ndcg) as mean_ndcg from m group by k) using (k) where k in (1, 10)")
def evaluation_report(spark, sf_dir):
    """The per-query list beside the means that it makes."""
    queries, corpus, gold = V.retrieval(spark, sf_dir)
    listed = relevance.metrics(queries, retrieve.cosine_topk(queries, corpus, 10), gold, [1, 10])
    means = listed.groupBy("k").agg(F.count("*").alias("n_queries"), F.round(F.avg("ndcg"), 6).alias("mean_ndcg"))
    return listed.join(means, "k").select("query_id", "k", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"), "n_queries", "mean_ndcg")


_GIVEN = "r as (select vec_id as query_id, i as rank, (vec_id * 7 + i * 13) % 50 as id from embeddings, unnest(range(1, 51)) t(i))"


@query(f"""with q as (select vec_id as query_id from embeddings), {_GIVEN},
  gold as (select vec_id as query_id, vec_id % 50 as id from embeddings union select vec_id, (vec_id + 5) % 50 from embeddings where vec_id % 2 = 0), ranked as (select * from r),
  {V.metric_sql("gold")} select k, count(*) as n_queries, round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, round(avg(recall_strict), 6) as recall_strict, round(avg(recall_soft), 6) as recall_soft, round(avg(ndcg), 6) as ndcg from m group by k""")
def metrics_only(spark, sf_dir):
    """Metrics over results that are already there, as the published evaluation times have it: a query for every vector, 50 results each."""
    e = V.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"))
    found = e.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("id", (F.col("query_id") * 7 + F.col("rank") * 13) % 50)
    gold = e.withColumn("id", F.explode(F.when(F.col("query_id") % 2 == 0, F.array(F.col("query_id") % 50, (F.col("query_id") + 5) % 50)).otherwise(F.array(F.col("query_id") % 50))))
    return relevance.averaged(relevance.metrics(e, found, gold, V.GRID))


# Samples


def _judged(spark, sf_dir):
    """Lines of orders as judged records: a record is a line, its question the order."""
    line = V.read(spark, sf_dir, "lineitem")
    record = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return line.select(F.col("l_returnflag").alias("dataset"), F.col("l_orderkey").alias("question"), record.alias("record"), "l_linenumber", F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.col("l_linestatus"), F.lit("_checked"))).alias("stratum"))


_JUDGED = "judged as (select l_returnflag as dataset, l_orderkey as question, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as record, l_linenumber, case when l_linenumber % 3 = 0 then l_linestatus || '_checked' end as stratum from lineitem)"
_PRIMARY = """asked as (select dataset, question from (select distinct dataset, question from judged) qualify row_number() over (partition by dataset order by md5('42|' || question), question) <= 40),
  offs as (select j.*, row_number() over (partition by question order by j.l_linenumber, record) - 1 as place, count(*) over (partition by question) as n from judged j semi join asked a on a.dataset = j.dataset and a.question = j.question),
  prim as (select dataset, question, record from offs where place = cast('0x' || substring(md5('42|' || question), 1, 8) as bigint) % n)"""


@query(with_(_JUDGED, _PRIMARY) + "select * from prim")
def primary_sample(spark, sf_dir):
    found = sampling.primary_sample(_judged(spark, sf_dir), ["dataset"], "question", ["l_linenumber", "record"], 40, 42)
    return records.blinded(found, ["dataset", "question", "record"])


_DIAGNOSTIC = """el as (select * from judged where stratum is not null and record not in (select record from prim)),
  dq as (select stratum, question from (select distinct stratum, question from el) qualify row_number() over (partition by stratum order by md5('7|' || question), question) <= 50),
  diag as (select stratum, question, record from el semi join dq on dq.stratum = el.stratum and dq.question = el.question qualify row_number() over (partition by el.stratum, el.question order by md5('7|' || record), record) = 1)"""


def _samples(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    primary = sampling.primary_sample(rows, ["dataset"], "question", ["l_linenumber", "record"], 40, 42)
    return primary, sampling.diagnostic_sample(rows, "stratum", "question", "record", 50, 7, primary)


@query(with_(_JUDGED, _PRIMARY, _DIAGNOSTIC) + "select * from diag")
def diagnostic_sample(spark, sf_dir):
    return _samples(spark, sf_dir)[1].select("stratum", "question", "record")


@query(with_(_JUDGED, _PRIMARY, _DIAGNOSTIC, "b as (select 'PRIMARY' as membership, record from prim union all select 'DIAGNOSTIC', record from diag)") + "select membership, record, 'HV' || lpad(cast(row_number() over (order by md5('314159|' || record), record) as varchar), 6, '0') as opaque_id from b")
def annotation_items(spark, sf_dir):
    primary, diagnostic = (s.select("record") for s in _samples(spark, sf_dir))
    return sampling.opaque_ids(records.united(primary, diagnostic, ["record"], ("PRIMARY", "DIAGNOSTIC")), "record", 314159).select("membership", "record", "opaque_id")


@query(with_(_JUDGED, _PRIMARY, _DIAGNOSTIC) + """select cast((select count(*) from (select record from prim intersect select record from diag)) as integer) as overlap_count,
  cast((select count(*) from (select question from prim intersect select question from diag)) as integer) as question_overlap""")
def sample_overlap(spark, sf_dir):
    primary, diagnostic = _samples(spark, sf_dir)
    both = records.overlap(primary, diagnostic, ["record"]).join(records.overlap(primary, diagnostic, ["question"]).withColumnRenamed("overlap_count", "question_overlap"))
    return both.select(F.col("overlap_count").cast("int").alias("overlap_count"), F.col("question_overlap").cast("int").alias("question_overlap"))


@query(with_(V.RATERS, "cl as (select distinct source from raters)", "dr as (select i as draw, 'src' || (i * 7 % 10) as source from range(12) r(i))", "rk as (select *, row_number() over (partition by source order by doc_id) as place from raters)") + "select draw, place, doc_id, a, b from dr join rk using (source)")
def cluster_expand(spark, sf_dir):
    draws = spark.range(12).select(F.col("id").alias("draw"), F.concat(F.lit("src"), (F.col("id") * 7 % 10).cast("string")).alias("source"))
    return records.expanded(V.raters(spark, sf_dir), draws, "source", ["doc_id"]).select("draw", "place", "doc_id", "a", "b")


@query("select doc_id, lang from documents where doc_id % 2 = 1 or lang = 'fr'")
def resume_todo(spark, sf_dir):
    d = V.read(spark, sf_dir, "documents").select("doc_id", "lang")
    return records.resumable(d, d.filter("doc_id % 2 = 0 and lang <> 'fr'"), ["doc_id", "lang"])


# Discovery, parameters, estimates


@query("""with n as (select distinct 'rep_' || p_type || '_size=' || p_size || case when p_partkey % 3 = 0 then '_' || p_brand else '' end || case when p_partkey % 7 = 0 then '.tmp' else '.jsonl' end as name from part),
  c as (select name, case when name = 'rep_size=7_ECONOMY.jsonl' then 0 when starts_with(name, 'rep') and ends_with(name, '.jsonl') and contains(name, 'size=7') and contains(name, 'ECONOMY') then 1 when name = 'rep.jsonl' then 2 end as class from n)
  select name from c where class is not null order by class, length(name), name limit 1""")
def representation_discovery(spark, sf_dir):
    """Files named after parts: the one of a representation of given parameters."""
    name = F.concat(F.lit("rep_"), "p_type", F.lit("_size="), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_"), "p_brand")).otherwise(""), F.when(F.col("p_partkey") % 7 == 0, ".tmp").otherwise(".jsonl"))
    return readers.representation_file(V.read(spark, sf_dir, "part").select(name.alias("name")).distinct(), "rep", ["size=7", "ECONOMY"]).select("name")


@query("""with t as (select p_partkey, case p_partkey % 5 when 0 then p_type || '=' || p_size when 1 then p_brand || '=' || p_retailprice when 2 then p_type when 3 then p_brand || '=' || case when p_size % 2 = 0 then 'True' else 'FALSE' end else p_type || '=' || p_name || '=' || p_size end as text from part),
  s as (select *, split_part(text, '=', 1) as key, case when contains(text, '=') then substring(text, strpos(text, '=') + 1) end as v from t)
  select p_partkey, key, case when v is null or lower(v) in ('true', 'false') then 'bool' when regexp_full_match(v, '[0-9]+') then 'int' when regexp_full_match(v, '[0-9]+[.][0-9]*|[.][0-9]+') then 'float' else 'str' end as kind,
    case when v is null then 'true' when lower(v) in ('true', 'false') then lower(v) else v end as value from s""")
def typed_parameters(spark, sf_dir):
    p = V.read(spark, sf_dir, "part")
    equal = lambda a, b: F.concat(F.col(a), F.lit("="), b)
    texts = [equal("p_type", F.col("p_size").cast("string")), equal("p_brand", F.col("p_retailprice").cast("string")), F.col("p_type"), equal("p_brand", F.when(F.col("p_size") % 2 == 0, "True").otherwise("FALSE")), F.concat_ws("=", "p_type", "p_name", F.col("p_size").cast("string"))]
    text = F.element_at(F.array(*texts), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", N.typed_param(text).alias("x")).select("p_partkey", "x.*")


@query("select doc_id, length(text) // 4 as plain, greatest(1, length(text) // 4) as floored from documents")
def quarter_estimates(spark, sf_dir):
    return V.read(spark, sf_dir, "documents").select("doc_id", cost.quarter_length(F.col("text"), 0).alias("plain"), cost.quarter_length(F.col("text")).alias("floored"))


@query(with_(V.TRIAL, "s as (select dataset, k, avg(score) as m, stddev_samp(score) / sqrt(count(*)) as e from trial group by all)") + "select dataset, k, round(m, 6) as metric, round(e, 6) as error, round(m, 6) as of_bare_name from s")
def column_resolution(spark, sf_dir):
    """Columns as a results table may have them: Soft Avg with Soft_SEM beside it, and NRR(hard), whose error column resolves to itself."""
    t = V.trial(spark, sf_dir).groupBy("dataset", "k").agg(F.avg("score").alias("Soft Avg"), (F.stddev_samp("score") / F.sqrt(F.count("*"))).alias("Soft SEM"), F.avg("score").alias("NRR(hard)"))
    metric = readers.resolve_column(t, ["Soft", "Soft Avg"])
    return t.select("dataset", "k", F.round(F.col(metric), 6).alias("metric"), F.round(F.col(readers.error_column(t, metric)), 6).alias("error"), F.round(F.col(readers.error_column(t, "NRR(hard)")), 6).alias("of_bare_name"))


# Streams


@query("""with a as (select c_custkey as query_id, c_custkey % 40 + 1 as n, c_custkey % 3 as busy, c_name from customer)
  select query_id, case when n > 20 then 20 else n end as n_tables, cast(case when n > 20 then greatest(1, busy) else busy end + 1 as integer) as attempts, 'to ' || c_name || '?' as answer from a""")
def resumed_runner(spark, sf_dir):
    """Every customer asks over 1 to 40 parts; a reader finds more than twenty too long, and is busy at first."""
    customer, path = V.read(spark, sf_dir, "customer"), scratch(spark)
    ids = F.transform(F.sequence(F.lit(0).cast("long"), F.col("c_custkey") % 40), lambda i: (F.col("c_custkey") + i).cast("string"))
    work = customer.select(F.col("c_custkey").alias("query_id"), F.concat("c_name", F.lit("?")).alias("question"), ids.alias("injection"))
    work.write.parquet(f"{path}/work")
    parts = V.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("representation"))

    def reader(rows):
        error = F.when(F.size("tables") > 20, "400: too long").when(F.col("attempt") < F.col("query_id") % 3, "busy").otherwise("")
        return rows.withColumn("error", error).withColumn("answer", F.when(F.col("error") == "", F.concat(F.lit("to "), F.col("question"))))

    found = run_all(Runner(spark, f"{path}/run", parts, reader), spark.readStream.schema(work.schema).parquet(f"{path}/work"))
    return found.select("query_id", F.col("n_tables").cast("long").alias("n_tables"), "attempts", "answer")


@query("""select c_mktsegment as segment, count(*) as calls, cast(sum(c_custkey % 1000) as bigint) as request_tokens, cast(sum(c_nationkey) as bigint) as response_tokens,
  round(sum(cast(c_custkey % 100 as double) / 4), 6) as cost, cast(sum(case when c_custkey % 3 = 0 then 1 else 0 end) as bigint) as failures from customer group by c_mktsegment""")
def running_usage(spark, sf_dir):
    """The log is a call of every customer, a third of them twice; its totals are kept in a state store as it streams in."""
    customer, path = V.read(spark, sf_dir, "customer"), scratch(spark)
    key = F.col("c_custkey")
    log = customer.select(key.cast("string").alias("id"), F.col("c_mktsegment").alias("stage"), F.timestamp_seconds(F.lit(1_700_000_000) + key % 400_000).alias("ts"), (key % 1000).cast("long").alias("request_tokens"), F.col("c_nationkey").cast("long").alias("response_tokens"), ((key % 100) / 4).alias("cost"), (key % 3).cast("int").alias("score"))
    log.write.parquet(f"{path}/log")
    log.filter("score = 1").write.mode("append").parquet(f"{path}/log")
    before = spark.conf.get(totals.STORE[0])
    spark.conf.set(*totals.STORE)
    try:
        running = totals.running_totals(spark.readStream.schema(log.schema).parquet(f"{path}/log"), "stage", "ts")
        step = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/totals/step={n}")
        running.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(totals.STORE[0], before)
    last = Window.partitionBy("key").orderBy(F.desc("batch"))
    now = spark.read.parquet(f"{path}/totals").withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    return now.select(F.col("key").alias("segment"), "calls", "request_tokens", "response_tokens", F.round("cost", 6).alias("cost"), "failures")


# Plug-ins


@query("select doc_id, cast(i as integer) as position, length(substring(text, 200 * i + 1, 200)) as size, md5(substring(text, 200 * i + 1, 200)) as piece_md5 from documents, unnest(range(0, (length(text) + 199) // 200)) t(i)")
def plugged_pieces(spark, sf_dir):
    """A table function, called from SQL with a lateral join, cuts each document."""
    name = plugins.register(spark, "murmura_pieces", plugins.pieces, "position int, piece string")
    V.read(spark, sf_dir, "documents").createOrReplaceTempView("murmura_documents")
    found = spark.sql(f"select d.doc_id, p.position, p.piece from murmura_documents d, lateral {name}(d.text, 200) p")
    return found.select("doc_id", "position", F.char_length("piece").cast("long").alias("size"), F.md5("piece").alias("piece_md5"))


@query("""with w as (select c_custkey, list_distinct(string_split(c_name || ' ' || c_mktsegment, ' ')) as asked from customer),
  t as (select p_partkey % 50 as slot, cast(p_partkey as varchar) as id, string_split(p_name || ' ' || c_mktsegment, ' ') as words from part join customer on c_custkey = p_partkey % 40),
  s as (select c_custkey as query_id, id, round(cast(len(list_intersect(asked, words)) as double) / len(asked), 6) as score from w join t on slot = c_custkey % 50)
  select query_id, cast(place as integer) as rank, id, score from (select *, row_number() over (partition by query_id order by score desc, id) as place from s) where place <= 3""")
def plugged_retriever(spark, sf_dir):
    """Every customer asks for the parts of its slot whose words it shares; the ranking is a plain Python function."""
    customer, part = V.read(spark, sf_dir, "customer"), V.read(spark, sf_dir, "part")
    near = customer.select((F.col("c_custkey") % 40).alias("near"), "c_custkey", "c_mktsegment").filter("c_custkey = near").drop("c_custkey")  # forty rows
    text = part.join(F.broadcast(near), F.col("p_partkey") % 40 == F.col("near")).select((F.col("p_partkey") % 50).alias("grp"), F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_name", "c_mktsegment").alias("text"))
    asked = customer.select(F.col("c_custkey").alias("query_id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("question"), (F.col("c_custkey") % 50).alias("grp"))
    found = plugins.shared_words_topk(asked, text, 3, plugins.retriever(spark, "murmura_shared_words", plugins.by_shared_words))
    return found.withColumn("score", F.round("score", 6))
