"""Failure anatomy: transitions, error labels by ordered rules, cross tables."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions import text as T

LABELS = ["Distractor Extraction", "Premature Refusal", "Reasoning Hallucination"]
CATEGORIES = ["both_success", "both_fail", "perfect_to_fail", "perfect_from_fail"]


def transitions(trials: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each row of k > 1 with the category of (success at k = 1, success here).

    The k = 1 record of a query is the last one by ``order``; without one it counts
    as failed. Target rows keep their repeats.
    """
    last = F.max_by("score", F.struct(*order))
    base = trials.filter("k = 1").groupBy(*keys, "query_id").agg(last.alias("base_score"))
    met = trials.filter("k > 1").join(base, [*keys, "query_id"], "left")
    one, here = F.coalesce("base_score", F.lit(0)) == 1, F.coalesce("score", F.lit(0)) == 1
    category = F.when(one & here, "both_success").when(~one & ~here, "both_fail").when(one, "perfect_to_fail").otherwise("perfect_from_fail")
    return met.withColumn("category", category)


def transition_table(moves: DataFrame, keys: list[str]) -> DataFrame:
    """total, counts and two-place percentages of the four categories."""
    wide = moves.groupBy(*keys).pivot("category", CATEGORIES).agg(F.count(F.lit(1))).fillna(0, CATEGORIES)
    total = sum((F.col(c) for c in CATEGORIES), F.lit(0))
    return wide.withColumn("total", total.cast("long")).select(*keys, "total", *CATEGORIES, *(F.round(100.0 * F.col(c) / F.col("total"), 2).alias(f"{c}_pct") for c in CATEGORIES))


def feature_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and shares of feature keys within each group."""
    counts = rows.groupBy(*keys, T.feature_key(F.col("k"), F.col("rotation")).alias("feature")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 6))


#: Cells of a block of tables, about; answers that one copy of a block's automaton reads at least, and more if it has more cells.
CELLS, ANSWERS = 1 << 17, 1000
#: Rows of a batch that are Python objects at once.
OPEN = 64


def _tuples(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, a few at a time: as Python objects long answers and lists of cells take several times what they take in Arrow."""
    for a in range(0, batch.num_rows, OPEN):
        yield from zip(*(c.slice(a, OPEN).to_pylist() for c in batch.columns))


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in which a block's tables come before the answers of its cases: for each answer the longest cell of its own tables that it holds and gold has not; the first table and position of equally long ones."""
    holders: dict[str, list[tuple]] = {}
    automaton, open_ = None, False
    for batch in batches:
        out = []
        for kind, table, entries, query, tables, answer, gold in _tuples(batch):
            if kind == 0:
                if not open_:
                    holders, open_ = {}, True
                for e in entries:
                    holders.setdefault(e["norm"], []).append((-len(e["norm"]), table, e["position"], e["cell"]))
                continue
            if open_:
                automaton, open_ = ahocorasick.Automaton(), False
                for norm, where in holders.items():
                    automaton.add_word(norm, (norm, where))
                automaton.make_automaton()
            mine, taken = set(tables), set(gold or ())
            found = {norm: where for _, (norm, where) in automaton.iter(answer) if norm not in taken} if len(automaton) else {}
            best = min((x for where in found.values() for x in where if x[1] in mine), default=None)
            if best is not None:
                out.append((query, *best))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["query_id", "size", "table_id", "position", "cell"])


def _said(answers: DataFrame, composed: bool = False) -> DataFrame:
    """answers with norm_answer, the collapsed answer, or that of its NFKC form. They are dealt out first: a few large files would otherwise mean a few tasks for all this work."""
    dealt = answers.repartition("query_id")
    return (T.composed(dealt, "answer") if composed else dealt).withColumn("norm_answer", T.collapsed(F.col("answer")))


def distractor_matches(answers: DataFrame, cells: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(query_id, table_id, cell) of the longest distractor cell that the answer holds.

    answers: query_id, answer, or norm_answer where it is collapsed already; cells:
    query_id, table_id, position, cell, is_gold, and norm where the collapsed cell is known already. With ``tables`` (query_id,
    table_id, is_gold), cells are those of tables and have no query_id: then many
    cases share one list of cells, which is collapsed, filtered and gathered once a
    table. Cells are compared collapsed and in lower case; values that a gold cell of
    the query has too are out, as are those of one character or without a letter or
    digit; the first of equally long ones wins.

    Tables are put in blocks of about CELLS cells; a block's cells make one Aho-Corasick
    automaton, and the answers of its cases stream past it. So an answer is read once a
    block, however many cells and tables that has. Where many answers meet a block,
    copies of it go to several tasks.
    """
    norm = cells if "norm" in cells.columns else cells.withColumn("norm", T.collapsed(F.col("cell")))
    shared = tables is not None
    if not shared:
        tables = norm.select("query_id", "table_id", "is_gold").distinct().withColumn("of_query", F.col("query_id"))
        norm = norm.withColumn("of_query", F.col("query_id"))
    else:
        tables, norm = tables.withColumn("of_query", F.lit(0)), norm.withColumn("of_query", F.lit(0)).withColumn("is_gold", F.lit(None).cast("boolean"))
    usable = norm.filter("length(norm) >= 2").filter(F.col("norm").rlike(r"[\p{L}\p{N}]"))
    first = usable.groupBy("of_query", "table_id", "is_gold", "norm").agg(F.min(F.struct("position", "cell")).alias("at"))
    entry = F.struct(F.col("at.position").cast("long").alias("position"), "norm", F.col("at.cell").alias("cell"))
    lists = first.groupBy("of_query", "table_id", "is_gold").agg(F.collect_list(entry).alias("entries"))
    lists = lists.withColumnRenamed("is_gold", "cells_gold")
    met = tables.filter("is_gold").join(lists.filter("cells_gold is null or cells_gold"), ["of_query", "table_id"])
    gold = met.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(F.col("entries.norm")))).alias("gold"))
    said = answers if "norm_answer" in answers.columns else _said(answers)
    said = said.select("query_id", "norm_answer").filter("norm_answer is not null").join(gold, "query_id", "left")
    held, lists = tables.filter("not is_gold"), lists.filter("cells_gold is null or not cells_gold")
    if shared:
        blocks = max(1, -(-(cells.count()) // CELLS))
        block = F.pmod(F.xxhash64("table_id"), F.lit(blocks))
        of_block = lists.groupBy(block.alias("block")).agg(F.sum(F.size("entries")).alias("cells"))
        asked = held.groupBy("query_id", block.alias("block")).agg(F.collect_set("table_id").alias("tables"))
        counts = asked.groupBy("block").agg(F.count("*").alias("answers")).join(of_block, "block")  # a row for each block
        parts = counts.select("block", F.ceil(F.col("answers") / F.greatest(F.lit(ANSWERS), F.col("cells") / 8)).alias("parts"))
        asked = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")))
        lists = lists.withColumn("block", block).join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    else:
        lists = lists.withColumn("block", F.xxhash64("of_query")).withColumn("part", F.col("of_query"))
        asked = held.groupBy("query_id").agg(F.collect_set("table_id").alias("tables")).withColumn("block", F.xxhash64("query_id")).withColumn("part", F.col("query_id"))
        asked = asked.join(lists.select("part").distinct(), "part", "left_semi")
    keys = ["block", "part"]
    asked = asked.join(said, "query_id")
    rows = lists.select(*keys, F.lit(0).alias("kind"), "table_id", "entries").unionByName(asked.select(*keys, F.lit(1).alias("kind"), "query_id", "tables", "norm_answer", "gold"), allowMissingColumns=True)
    kinds = dict(answers.dtypes)["query_id"], dict(tables.dtypes)["table_id"]
    found = rows.repartition(*keys).sortWithinPartitions(*keys, "kind").select("kind", "table_id", "entries", "query_id", "tables", "norm_answer", "gold")
    found = found.mapInArrow(_longest, f"query_id {kinds[0]}, size long, table_id {kinds[1]}, position long, cell string")
    best = found.groupBy("query_id").agg(F.min(F.struct("size", "table_id", "position", "cell")).alias("best"))
    return best.select("query_id", F.col("best.table_id").alias("table_id"), F.col("best.cell").alias("cell"))


def error_labels(answers: DataFrame, cells: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """query_id, final_error_type, label_source, matched table, cell and phrase: distractor first, then refusal, else the residual label.

    Answers are brought to their NFKC form first; cells and tables as in
    distractor_matches(), with norm from text of that form.
    """
    answers = _said(answers, composed=True)
    others = answers.withColumn("phrase", T.refusal_in(F.col("norm_answer"))).drop("answer", "norm_answer")
    met = others.join(distractor_matches(answers, cells, tables), "query_id", "left")
    hit = F.col("cell").isNotNull()
    label = F.when(hit, LABELS[0]).when(F.col("phrase").isNotNull(), LABELS[1]).otherwise(LABELS[2])
    source = F.when(hit, "distractor_specific_cell_rule").when(F.col("phrase").isNotNull(), "explicit_refusal_rule").otherwise("residual_reasoning_rule")
    return met.select(*[c for c in answers.columns if c not in ("answer", "norm_answer")], label.alias("final_error_type"), source.alias("label_source"), F.col("table_id").cast("string").alias("matched_table"), F.col("cell").alias("matched_cell"), F.when(~hit, F.col("phrase")).alias("matched_phrase"))


def resolvability(records: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """total, resolvable, percent, and how many records lack each named part (tables with the key)."""
    met = records.select(key)
    for name, part in parts.items():
        met = met.join(part.select(key).distinct().withColumn(f"has_{name}", F.lit(True)), key, "left")
    has = [F.coalesce(f"has_{n}", F.lit(False)) for n in parts]
    every = has[0]
    for h in has[1:]:
        every = every & h
    ok = F.sum(every.cast("int"))
    return met.agg(F.count("*").alias("total"), F.coalesce(ok, F.lit(0)).cast("long").alias("resolvable"), F.round(F.try_divide(100.0 * ok, F.count("*")), 2).alias("percent"), *(F.coalesce(F.sum((~h).cast("int")), F.lit(0)).cast("long").alias(f"missing_{n}") for n, h in zip(parts, has)))


def crosstab(errors: DataFrame, sets: list[list[str]]) -> DataFrame:
    """total, counts and six-place shares of the labels, over several grouping sets; columns that a set lacks are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    counts = [F.sum((F.col("final_error_type") == x).cast("int")).alias(f"n_{i}") for i, x in enumerate(LABELS)]
    found = errors.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.count("*").alias("total"), *counts)
    return found.select(*keys, "total", *(F.col(f"n_{i}").alias(n) for i, n in enumerate(("de", "pr", "rh"))), *(F.round(F.col(f"n_{i}") / F.col("total"), 6).alias(f"{n}_share") for i, n in enumerate(("de", "pr", "rh"))))


def composition(errors: DataFrame) -> DataFrame:
    """Within each label, overall and by kind of negatives, how the question types are shared."""
    found = errors.groupingSets([[F.col("final_error_type"), F.col("negative"), F.col("question_type")], [F.col("final_error_type"), F.col("question_type")]], F.col("final_error_type"), F.col("negative"), F.col("question_type")).agg(F.count("*").alias("n"))
    found = found.withColumn("scope", F.coalesce("negative", F.lit("all")))
    return found.select("scope", "final_error_type", "question_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("scope", "final_error_type")), 6).alias("share"))


def zero_filled_grid(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and percentages for every combination of the keys' values and labels; the denominator is that of all keys but the last."""
    grid = None
    for k in keys:
        values = errors.select(k).distinct()
        grid = values if grid is None else grid.crossJoin(values)
    labels = errors.sparkSession.range(1).select(F.explode(F.array(*(F.lit(x) for x in LABELS))).alias("final_error_type"))
    counts = errors.groupBy(*keys, "final_error_type").agg(F.count("*").alias("n"))
    met = grid.crossJoin(labels).join(counts, [*keys, "final_error_type"], "left").fillna(0, ["n"])
    whole = F.sum("n").over(Window.partitionBy(*keys[:-1]))
    return met.withColumn("percent", F.round(F.coalesce(F.try_divide(100.0 * F.col("n"), whole), F.lit(0.0)), 4))


def question_table(errors: DataFrame, questions: DataFrame) -> DataFrame:
    """Counts of the labels by question type (rows without one are left out), from (query_id, question_type)."""
    met = errors.drop("question_type").join(questions, "query_id", "left").filter("question_type is not null and question_type <> ''")
    wide = met.groupBy("question_type").pivot("final_error_type", LABELS).agg(F.count(F.lit(1))).fillna(0, LABELS)
    total = sum((F.col(x) for x in LABELS), F.lit(0))
    return wide.select("question_type", *(F.col(x).alias(n) for x, n in zip(LABELS, ("de", "pr", "rh"))), total.cast("long").alias("total"), *(F.round(F.col(x) / total, 4).alias(f"{n}_share") for x, n in zip(LABELS, ("de", "pr", "rh"))))


def relabel_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_label, new_label, n, share) of records labelled in both."""
    met = old.select("query_id", F.col("final_error_type").alias("old_label")).join(new.select("query_id", F.col("final_error_type").alias("new_label")), "query_id")
    counts = met.groupBy("old_label", "new_label").agg(F.count("*").alias("n"))
    return counts.join(met.agg(F.count("*").alias("whole"))).select("old_label", "new_label", "n", F.round(F.col("n") / F.col("whole"), 6).alias("share"))


def relabel_summary(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """total_cases, changed_cases, agreement_count and agreement_rate, final counts of the three labels, and distractor labels with a cell to show, by ``keys`` and over all (null keys).

    old: query_id, error_type and diagnostic_type as written then, normalised by
    keyword; new: query_id, keys, final_error_type, matched_cell. A record changed if
    its old label differs, and agrees if the diagnosis (the old label where there is
    none) has the new one.
    """
    before = old.select("query_id", T.error_label_of(F.col("error_type")).alias("was"), T.error_label_of(F.coalesce("diagnostic_type", "error_type", F.lit("Unknown"))).alias("said"))
    met = new.join(before, "query_id")
    count = lambda c: F.sum(c.cast("long"))
    now = F.col("final_error_type")
    found = met.rollup(*keys).agg(
        F.count("*").alias("total_cases"), count(F.col("was") != now).alias("changed_cases"), count(F.col("said") == now).alias("agreement_count"),
        *(count(now == x).alias(f"final_{n}") for x, n in zip(LABELS, ("de", "pr", "rh"))),
        count((now == LABELS[0]) & F.col("matched_cell").isNotNull()).alias("distractor_with_audit_cell"),
    )
    return found.withColumn("agreement_rate", F.round(F.coalesce(F.try_divide("agreement_count", "total_cases"), F.lit(0.0)), 6))


def wide_sections(sections: dict[str, DataFrame]) -> DataFrame:
    """All sections as one table with the column section first; columns that a section lacks are null."""
    found = None
    for name, rows in sections.items():
        one = rows.select(F.lit(name).alias("section"), "*")
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    return found


def usage_rollup(log: DataFrame, stage: str) -> DataFrame:
    """calls, tokens, failures, success rate and cost by stage and over all (null stage)."""
    failed = F.sum((F.col("score") == 0).cast("long"))
    return log.rollup(stage).agg(
        F.count("*").alias("calls"), F.sum("request_tokens").alias("request_tokens"), F.sum("response_tokens").alias("response_tokens"), failed.alias("failures"), F.round(F.sum("cost"), 6).alias("cost"),
        F.round(F.sum("cost") / F.count("*"), 9).alias("cost_per_call"), F.round(1 - failed / F.count("*"), 6).alias("success_rate"),
    )
