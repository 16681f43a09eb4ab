"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.llm import backoff, decontaminate, divergence, jaccard, language, mixing, pii, quality, resample, simhash, suffix_dedup, toxicity, url_filter
from murmura.llm.common import doc_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("perplexity", 4).alias("perplexity"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), doc_hash() % 4 != 2)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "toxic")


#: Token shares of the mixture, by quality and toxicity as the labels have them.
TARGETS = {"good": 0.80, "poor": 0.15, "toxic": 0.05}


def domains_of(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain")).filter("domain is not null")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.fit(table(spark, sf_dir, "documents"), domains_of(table(spark, sf_dir, "labels")), TARGETS)
    return found.rates.select("doc_id", "n_tokens", *(F.round(f"p_{i}", 6).alias(f"p_{d}") for i, d in enumerate(found.domains)), F.round("rate", 6).alias("rate"), F.lit(found.converged).alias("converged"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.spans(docs, pii.train(docs))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long) as n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.digest("base"), 256).alias("base_sha256"), pii.digest("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.filter(doc_hash() % 3 != 1)
    models = language.train(known)
    found = language.predict(docs, models, language.calibrate(known, models))
    return found.select("doc_id", (doc_hash() % 3 == 1).alias("held_out"), "lang_pred", "score", "rejected")


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op10_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff.scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_trigrams", F.round("log_score", 4).alias("log_score"), F.round("score", 6).alias("score"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base rules of op3_quality alone, which SQL can express."""
    return quality.base(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(quality.BASE_FAILED).alias("base_failed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_pii": op7_pii,
    "op8_language": op8_language,
    "op9_url_filter": op9_url_filter,
    "op10_backoff": op10_backoff,
    "op11_resampling": op11_resampling,
    "op12_divergence": op12_divergence,
    "op13_jaccard": op13_jaccard,
    "quality_base": quality_base,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
URL_PATTERNS = " or ".join(f"regexp_matches(lower(url), '{r.pattern}')" for r in url_filter.DEFAULT_RULES if r.verdict == "block")

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
        w as (select doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) as k from d, unnest(range(0, n - 49)) t(i)),
        m as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by k) as least from w) where doc_id > least),
        g as (select doc_id, i, sum(case when i - prev <= 50 then 0 else 1 end) over (partition by doc_id order by i) as run from (select *, lag(i) over (partition by doc_id order by i) as prev from m)),
        r as (select doc_id, min(i) as a, max(i) + 50 as b from g group by doc_id, run),
        k as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from r),
        t as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as kept from k join d using (doc_id) group by doc_id)
        select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256 from d left join t using (doc_id)""",
    "op4_decontamination": rf"""
        with d as (select doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
        bw as (select distinct item_id, least(len(w), 10) as k, list_slice(w, i, i + least(len(w), 10) - 1) as win
               from b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(i) where len(w) > 0),
        dw as (select doc_id, i, k, list_slice(w, i, i + k - 1) as win from d, (select distinct k from bw) ks, unnest(range(1, len(w) - k + 2)) t(i)),
        m as (select doc_id, i, k, item_id from dw join bw using (k, win)),
        hit as (select doc_id, count(distinct p) as n_hit from m, unnest(range(i, i + k)) t(p) group by doc_id),
        it as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, cast(item_id as varchar) as s from m) group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (doc_id) left join it using (doc_id)""",
    "op9_url_filter": rf"""
        with u as (select page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
        r as (select *, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
                             when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
                             when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
                             when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from u)
        select page_id, host, path, rule,
               case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
                    when url like '%://%' and ({URL_PATTERNS}) then 'block' else 'allow' end as verdict from r""",
    "op10_backoff": rf"""
        with d as (select doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') as w from documents),
        t as (select doc_id, i, w[i] as c, case when i > 1 then w[i - 1] end as b, case when i > 2 then w[i - 2] end as a from d, unnest(range(1, len(w) + 1)) r(i)),
        c1 as (select c, count(*) as n from t group by c),
        c2 as (select b, c, count(*) as n from t where b is not null group by b, c),
        c3 as (select a, b, c, count(*) as n from t where a is not null group by a, b, c),
        s as (select doc_id, case when t.a is not null then ln(c3.n) - ln(h2.n) when t.b is not null then ln(0.4) + ln(c2.n) - ln(h1.n)
                                  else 2 * ln(0.4) + ln(c1.n) - ln((select count(*) from t)) end as v
              from t join c1 on t.c = c1.c left join c2 on t.b = c2.b and t.c = c2.c left join c1 h1 on t.b = h1.c
              left join c3 on t.a = c3.a and t.b = c3.b and t.c = c3.c left join c2 h2 on t.a = h2.b and t.b = h2.c),
        g as (select doc_id, count(*) as n_words, sum(v) as v from s group by doc_id)
        select d.doc_id, coalesce(n_words, 0) as n_words, greatest(coalesce(n_words, 0) - 2, 0) as n_trigrams,
               round(coalesce(v, 0), 4) as log_score, round(v / n_words, 6) as score from d left join g using (doc_id)""",
    "op11_resampling": rf"""
        with recursive step(i, k, v) as (select cast(i as bigint), 0, cast(i as bigint) from range(256) r(i)
            union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from step where k < 8),
        tab as (select list(v order by i) as crc from step where k = 8),
        c as (select 0 as corpus, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
              union all select 1, null, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
        n as (select *, row_number() over () as r from c),
        g as (select r, corpus, array_to_string(list_slice(w, i, i + k - 1), ' ') as f
              from n, unnest([1, 2, 3]) ks(k), unnest(range(1, len(w) - k + 2)) t(i)),
        e as (select f, hex(encode(f)) as x from (select distinct f from g)),
        b as (select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) // 2 + 1), lambda j: cast('0x' || substr(x, 2 * j - 1, 2) as bigint))),
                        lambda a, y: xor(a >> 8, crc[cast(xor(a, y) & 255 as int) + 1])), 4294967295) % 10000 as bucket from e, tab),
        p as (select r, corpus, bucket, count(*) as n from g join b using (f) group by all),
        s as (select bucket, coalesce(sum(n) filter (corpus = 0), 0) as s, coalesce(sum(n) filter (corpus = 1), 0) as t from p group by bucket),
        tot as (select sum(s) as s_all, sum(t) as t_all from s),
        gain as (select bucket, cast(floor(1000 * ln(((t + 1)::double * (s_all + 10000)::double) / ((s + 1)::double * (t_all + 10000)::double))) as bigint) as gain from s, tot),
        wt as (select r, sum(n * gain) as weight, sum(n) as n_features from p join gain using (bucket) where corpus = 0 group by r),
        h as (select r, doc_id, len(w) as n_words, cast('0x' || substr(sha256('42:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h from n where corpus = 0),
        sc as (select doc_id, n_words, cast(coalesce(n_features, 0) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
                      cast(coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as bigint) as score from h left join wt using (r)),
        k as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id, n_features desc) as place, 5 * count(*) filter (n_words >= 20) over () // 100 as many from sc)
        select doc_id, n_features, weight, score, case when n_words >= 20 and place <= many then place end as rank from k""",
    "op12_divergence": rf"""
        with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
        g as (select distinct lang, source from d),
        r as (select row_number() over () as r, * from d),
        o as (select lang, source, term, r from r, unnest(w) t(term)),
        k as (select lang, term from o group by lang, term having count(distinct r) >= 3),
        c as (select lang, source, term, count(*)::hugeint as n from o join k using (lang, term) group by all),
        v as (select lang, count(term) as v from (select distinct lang from g) left join k using (lang) group by lang),
        n as (select lang, source, coalesce(sum(n), 0)::hugeint as total from g left join c using (lang, source) group by all),
        f as (select n.lang, n.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (total + v) as p
              from n join v using (lang) join k using (lang) left join c on c.lang = n.lang and c.source = n.source and c.term = k.term),
        l as (select lang, term, 1 + 1000000000::hugeint * (coalesce(sum(n), 0) + 1) // (any_value(all_n) + any_value(v)) as q
              from f join v using (lang) join (select lang, sum(total) as all_n from n group by lang) using (lang) group by lang, term),
        pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
              left join (select x.lang, x.source as s1, y.source as s2, sum((x.p - y.p) * (x.p - y.p) // y.p) as value from f x join f y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
              on s.lang = a.lang and s.s1 = a.source and s.s2 = b.source),
        u as (select lang, source, 'pair' as part, item, value from pairs
              union all select lang, source, 'term', term, (p - q) * (p - q) // q from f join l using (lang, term) where n > 0 and p > q)
        select lang, source, part, item, cast(value as bigint) as value, cast(place as int) as rank
        from (select *, row_number() over (partition by lang, source, part order by value desc, item) as place from u) where part = 'pair' or place <= 200""",
    "op13_jaccard": rf"""
        with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') as w from documents),
        s as (select distinct r, list_slice(w, i, i + least(len(w), 5) - 1) as g from d, unnest(range(1, greatest(len(w) - 5, 0) + 2)) t(i) where len(w) > 0),
        n as (select r, count(*) as n from s group by r),
        p as (select a.r as u, b.r as v, count(*) as c from s a join s b on a.g = b.g and a.r < b.r group by all),
        e as (select u, v from p join n x on x.r = u join n y on y.r = v where 100 * c >= 80 * (x.n + y.n - c)),
        both_ways as (select u, v from e union all select v, u from e),
        reach(r, c) as (select r, r from d union select reach.r, v from reach join both_ways on c = u),
        least_id as (select reach.r, min(doc_id) as component_id from reach join d on d.r = c group by reach.r)
        select doc_id, coalesce(n, 0) as n_shingles, component_id from d left join n using (r) join least_id using (r)""",
    "quality_base": rf"""
        with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        l as (select r, count(*) - count(distinct line) as n_dup from d, unnest(string_split(text, chr(10))) t(line) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
        g as (select r, i, count(*) over (partition by r, md5_number(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as n from d, unnest(range(1, len(w) - 1)) t(i)),
        p as (select r, count(distinct i + j) as n_repeat from g, unnest([0, 1, 2]) s(j) where n > 1 group by r),
        c as (select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
              coalesce(n_dup, 0) as n_dup_lines, coalesce(n_repeat, 0) as n_repeat_words from d left join l using (r) left join p using (r))
        select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
               n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c""",
}
