import corpus_pipeline
from test_dedup import brute_components, words
from test_filters import brute_contamination, brute_spans
from test_text_models import base_counts

from conftest import TEXTS

from murmura.llm import pii, quality

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_each_stage_equals_brute_force_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.write.parquet(str(tmp_path / "quality_rules_in"))
    before = rows(docs)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontamination", "personal_data", "mixture"]

    def step(name):
        nonlocal docs, before
        docs.write.parquet(str(tmp_path / name))
        made = stages[name](spark, spark.read.parquet(str(tmp_path / name)), SF)
        given, docs = before, made
        if name != "mixture":
            before = rows(made)
            assert made.columns == corpus_pipeline.COLUMNS
        return given, before

    given, kept = step("quality_rules")
    counts = {i: base_counts(r.text) for i, r in given.items()}
    failed = {i for i, c in counts.items() if c[0] < 50 or 100 * c[4] > 50 * c[0]}
    assert not failed & set(kept)
    judged = {r.doc_id: r.kept for r in quality.judged(spark.read.parquet(str(tmp_path / "quality_rules_in"))).collect()}
    assert set(kept) == {i for i, good in judged.items() if good} and len(kept) >= 0.85 * (len(given) - len(failed))
    assert all(kept[i] == given[i] for i in kept)

    given, kept = step("near_dedup")
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, words(r.text)) for i, r in given.items())}
    group = brute_components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert set(kept) == {i for i in given if group[i] == i}

    given, kept = step("decontamination")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_contamination([(i, r.text) for i, r in given.items()], items)
    assert set(kept) == {i for i, h in hits.items() if not h[1]} and len(kept) < len(given)

    given, masked = step("personal_data")
    assert set(masked) == set(given)
    for i, r in masked.items():
        assert r.n_chars == len(r.text)
        spans = brute_spans(given[i].text)
        assert (r.text == given[i].text) or any(f"[{k.upper()}]" in r.text for k in pii.KINDS)
        assert not spans or r.text != given[i].text
        for _, s, e in spans:
            assert given[i].text[s:e] not in r.text

    step("mixture")
    out = docs.collect()
    copies = {}
    for r in out:
        copies.setdefault(r.doc_id, []).append(r)
        assert r.text == before[r.doc_id].text
    assert all(int(x[0].rate) <= len(x) <= int(x[0].rate) + 1 and [c.copy for c in sorted(x, key=lambda c: c.copy)] == list(range(1, len(x) + 1)) for x in copies.values())


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*corpus_pipeline.COLUMNS, "rate", "copy"]
    copies = {}
    for r in out.collect():
        copies.setdefault(r.doc_id, []).append(r)
    docs = rows(spark.read.parquet(f"{SF}/documents.parquet"))
    assert 100 < len(copies) < len(docs) and set(copies) <= set(docs)
    for i, x in copies.items():
        assert sorted(r.copy for r in x) == list(range(1, len(x) + 1)) and int(x[0].rate) <= len(x) <= int(x[0].rate) + 1
        assert x[0].lang == docs[i].lang and x[0].n_chars == len(x[0].text)


def test_stages_take_odd_and_empty_documents(spark, odd, empty):
    """Rows with null and repeated ids, null and blank texts and a clashing column: each stage keeps, masks or copies rows, and never makes up any."""
    texts = {r.text for r in odd.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        made = stage(spark, odd, SF).collect()
        if name == "quality_rules":
            assert made == []  # none has 50 words beside repeats
        elif name == "near_dedup":
            assert {r.doc_id for r in made if r.text == TEXTS[0]} == {0, None} and 50 not in {r.doc_id for r in made}
            assert {r.doc_id for r in made} >= {3, 6, 7, 8, 9, 10, 11, 12, None}
        elif name == "decontamination":
            assert len(made) == odd.count()
        elif name == "personal_data":
            assert len(made) == odd.count() and {r.text for r in made} - texts == {"mail [EMAIL] and [PHONE] or [IP] then [CARD] end"}
        else:
            assert {r.text for r in made} <= texts and None in {r.text for r in made}
