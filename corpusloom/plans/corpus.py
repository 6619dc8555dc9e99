"""Queries of the corpus index, with their SQL (DuckDB). `source` stands for the corpus, the Latin script for the profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.functions import text as X
from corpusloom.operators import index as I
from corpusloom.operators import resample

ARTICLES = {"DEF": ["the"], "INDEF": ["a", "an"]}
RULES = [("tion", "NOUN"), ("ing", "PROG"), ("ed", "PAST"), ("er", "AGENT"), ("ly", "ADV")]
EXCEPTIONS = ["thing", "her", "other"]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("source").alias("corpus"), "doc_id", "text")


def _tokenised(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("corpus", "doc_id", X.tokens(F.col("text"), X.LATIN).alias("tokens"))


def _doc_forms(spark: SparkSession, d: str) -> DataFrame:
    return I.document_forms(_tokenised(spark, d))


def _types(spark: SparkSession, d: str) -> DataFrame:
    return I.counted_forms(documents(spark, d), X.LATIN)


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    s = documents(spark, d).select("corpus", "doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sent_no", "sentence"))
    return s.select("corpus", "doc_id", "sent_no", (F.col("doc_id") * 1_000_000 + F.col("sent_no")).alias("sid"), X.tokens(F.col("sentence"), X.LATIN).alias("tokens"))


TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}]+')"
TOK = "tok AS (SELECT source AS corpus, doc_id, unnest(" + TOKENS.format("text") + ") AS form FROM documents), dform AS (SELECT corpus, doc_id, form, count(*) AS n FROM tok GROUP BY ALL), typ AS (SELECT corpus, form, CAST(sum(n) AS BIGINT) AS n, count(*) AS df FROM dform GROUP BY ALL)"
SENT = r"""raw AS (SELECT source AS corpus, doc_id, list_filter([trim(x) FOR x IN string_split(regexp_replace(translate(text, '‌‍﻿­', ''), '([.!?।॥…])[ \t\r\f\v"''“”‘’)\]]*[ \t\r\f\v]+', '\1' || chr(10), 'g'), chr(10))], lambda x: x <> '') AS ss FROM documents), sent AS (SELECT corpus, doc_id, unnest(range(len(ss))) AS sent_no, unnest(ss) AS sentence FROM raw), st AS (SELECT corpus, doc_id, sent_no, doc_id * 1000000 + sent_no AS sid, regexp_extract_all(lower(sentence), '[\p{L}]+') AS tokens FROM sent)"""


def form_frequencies(spark, d):  # type: ignore[no-untyped-def]
    """T-06, A-01, M-02, O-01: the 200 most frequent forms of all corpora."""
    types = _types(spark, d).groupBy("form").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    part = Window.partitionBy(F.pmod(F.xxhash64("form"), F.lit(64)))  # the first of each part and its sum: texts are read once, not again for the total
    first = types.withColumns({"_r": F.row_number().over(part.orderBy(F.desc("n"), "form")), "_sum": F.sum("n").over(part)}).where("_r <= 200")
    total = F.sum(F.when(F.col("_r") == 1, F.col("_sum"))).over(Window.partitionBy(F.lit(1)))  # 64 x 200 rows
    out = first.withColumn("total", total).select("form", "n", "df", X.per_million(F.col("n"), F.col("total")).alias("per_million"))
    return out.orderBy(F.desc("n"), "form").limit(200)


FORM_FREQUENCIES = f"WITH {TOK}, t AS (SELECT form, CAST(sum(n) AS BIGINT) AS n, CAST(sum(df) AS BIGINT) AS df FROM typ GROUP BY form) SELECT form, n, df, n * 1e6 / (SELECT sum(n) FROM t) AS per_million FROM t ORDER BY n DESC, form LIMIT 200"


def form_types(spark, d):  # type: ignore[no-untyped-def]
    """A-01: n and df of every form in every corpus."""
    return _types(spark, d)


def doc_token_counts(spark, d):  # type: ignore[no-untyped-def]
    """A-02: tokens and distinct forms of each document."""
    return _tokenised(spark, d).select("corpus", "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_forms"))


def candidate_docforms(spark, d):  # type: ignore[no-untyped-def]
    """P-03, A-02: counts by document of forms that a slot may use."""
    c = F.col("form").isin("the", "a", "an") | F.col("form").rlike("(tion|ing)$")
    return I.document_forms(_tokenised(spark, d), c)


def line_dedup_stats(spark, d):  # type: ignore[no-untyped-def]
    """P-01, D-01, A-03."""
    docs = documents(spark, d)
    kept = I.lines(docs, X.LATIN, 0.6)
    return kept.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_lines")).join(I.first_lines(kept, X.LATIN).groupBy("corpus").agg(F.count(F.lit(1)).alias("n_first")), "corpus", "left").select("corpus", "n_lines", F.coalesce("n_first", F.lit(0)).alias("n_first"))


EDGE = X.EDGE_PUNCTUATION.replace("'", "''")
LINES = rf"""ln AS (SELECT source AS corpus, doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
bare AS (SELECT *, regexp_replace(line, '[\s\x{{200b}}-\x{{200d}}\x{{feff}}\x{{ad}}]', '', 'g') AS b FROM ln WHERE trim(line) <> ''),
good AS (SELECT corpus, doc_id, line_no, line FROM bare WHERE CASE WHEN length(b) = 0 THEN 0.0 ELSE length(regexp_replace(b, '[^\p{{L}}]', '', 'g')) / length(b) END >= 0.6),
keyed AS (SELECT *, lower(trim(trim(line, '{EDGE}'))) AS k FROM good),
firsts AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, line_no) AS r FROM keyed)"""


def corpus_build_report(spark, d):  # type: ignore[no-untyped-def]
    """P-02, A-03: why documents are dropped, by corpus."""
    return I.build_report(I.gated(documents(spark, d), X.LATIN, 20, 0.3, 0.6))


VOWELS, CONSONANTS = X.LATIN.vowel_signs, X.LATIN.consonants
GATED = LINES + rf""", body AS (SELECT corpus, doc_id, string_agg(line, chr(10) ORDER BY line_no) AS body FROM firsts WHERE r = 1 GROUP BY ALL),
g AS (SELECT d.source AS corpus, d.doc_id, body, len(regexp_extract_all(lower(coalesce(body, '')), '[\p{{L}}]+')) AS n_tok,
  length(regexp_replace(lower(body), '[^{VOWELS}]', '', 'g')) AS v, length(regexp_replace(lower(body), '[^{CONSONANTS}]', '', 'g')) AS c
  FROM documents d LEFT JOIN body b ON d.doc_id = b.doc_id AND d.source = b.corpus),
r AS (SELECT *, CASE WHEN body IS NULL THEN 'dropped_lang' WHEN n_tok < 20 THEN 'dropped_short' WHEN (CASE WHEN c = 0 THEN 0.0 ELSE v / c END) < 0.3 THEN 'dropped_quality' END AS reason FROM g)"""


def capped_token_budget(spark, d):  # type: ignore[no-untyped-def]
    """W-02: tokens of each document under a budget of 200."""
    return I.capped(documents(spark, d), X.LATIN, 200).groupBy("corpus", "doc_id").agg(F.sum(F.size("tokens")).cast("long").alias("n_tokens"), F.count(F.lit(1)).alias("n_sentences"))


def sentence_counts(spark, d):  # type: ignore[no-untyped-def]
    """T-08."""
    return documents(spark, d).select("corpus", "doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n_sentences"))


def script_ratio_filter(spark, d):  # type: ignore[no-untyped-def]
    """T-09, T-10, T-11."""
    return documents(spark, d).select("doc_id", *X.script_measures(F.col("text"), X.LATIN))


def vowel_quality_gate(spark, d):  # type: ignore[no-untyped-def]
    """T-12, P-02."""
    r = X.vowel_sign_ratio(F.lower("text"), X.LATIN)
    return documents(spark, d).select("doc_id", r.alias("ratio"), (r >= 0.2).alias("passes"))


def grapheme_profile(spark, d):  # type: ignore[no-untyped-def]
    """T-14."""
    return documents(spark, d).select("doc_id", F.size(X.graphemes(F.col("text"))).cast("long").alias("n_graphemes"), F.length("text").cast("long").alias("n_points"))


def prefix_forms(spark, d):  # type: ignore[no-untyped-def]
    """P-05, I-02."""
    return I.with_prefix(_types(spark, d), "th", 2)


def suffix_forms(spark, d):  # type: ignore[no-untyped-def]
    """P-04, I-02."""
    return I.with_suffix(_types(spark, d), "tion", 2)


def kwic_concordance(spark, d):  # type: ignore[no-untyped-def]
    """W-01, J-03: `this` and its neighbours."""
    return I.kwic(_sentences(spark, d), "this").select("corpus", "doc_id", F.col("sent_no").cast("long").alias("sent_no"), "left", "right")


def posting_lists_capped(spark, d):  # type: ignore[no-untyped-def]
    """W-03: sizes and ends of posting lists."""
    return I.postings(_sentences(spark, d), 20).select("corpus", "form", "n_post", "truncated", F.element_at("sids", 1).alias("first_sid"), F.element_at("sids", -1).alias("last_sid"))


ASKED = ["the", "of", "and", "zzzz", "der", "Les", "unheard"]


def attestation_check(spark, d):  # type: ignore[no-untyped-def]
    """I-01, I-03, J-14: asked forms, canonicalised, with their counts and a verdict."""
    asked = spark.createDataFrame([(x,) for x in ASKED], "asked string").select(X.canonical(F.col("asked"), X.LATIN).alias("form"))
    types = _types(spark, d).groupBy("form").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return I.frequency(types, asked).withColumn("verdict", F.when(F.col("n") == 0, "unattested").when(F.col("df") < 5, "rare").otherwise("attested"))


def form_corpus_pivot(spark, d):  # type: ignore[no-untyped-def]
    """I-03: counts of asked forms by language, one column each."""
    docs = read(spark, d, "documents").select("lang", F.explode(X.tokens(F.col("text"), X.LATIN)).alias("form"))
    return docs.where(F.col("form").isin("the", "la", "de", "der")).groupBy("form").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


def systematic_sample(spark, d):  # type: ignore[no-untyped-def]
    """W-04: every seventh document in order."""
    return I.systematic_sample(read(spark, d, "documents").select("doc_id", "lang"), "doc_id", 7)


def pseudo_documents(spark, d):  # type: ignore[no-untyped-def]
    """S-01: a document's lines in blocks of five, every second block kept."""
    ln = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("block", F.floor(F.col("line_no") / 5))
    return ln.where(F.col("block") % 2 == 0).groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n_lines"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").cast("binary")).alias("digest"))


def blank_line_islands(spark, d):  # type: ignore[no-untyped-def]
    """S-02, W-05: turns without text-final question end a stretch of a conversation; lengths of the stretches."""
    t = read(spark, d, "conversations").withColumn("blank", (F.col("role") == "user").cast("int"))
    t = t.withColumn("island", F.sum("blank").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("conv_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"))


def _values(spark, d):  # type: ignore[no-untyped-def]
    return I.slot_values(_doc_forms(spark, d), ARTICLES)


def _distribution(spark, d):  # type: ignore[no-untyped-def]
    return I.slot_distribution(_values(spark, d))


def slot_distribution_wilson(spark, d):  # type: ignore[no-untyped-def]
    """A-04, A-13."""
    r = lambda c: F.round(c, 6).alias(c)
    return _distribution(spark, d).select("corpus", "value", "n", "total", r("p"), r("low"), r("high"))


DIST = TOK + """, sv AS (SELECT corpus, doc_id, CASE WHEN form = 'the' THEN 'DEF' ELSE 'INDEF' END AS value, sum(n) AS n FROM dform WHERE form IN ('the', 'a', 'an') GROUP BY ALL),
sd AS (SELECT corpus, value, sum(n) AS n FROM sv GROUP BY ALL), tt AS (SELECT *, sum(n) OVER (PARTITION BY corpus) AS total FROM sd), pp AS (SELECT corpus, value, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, n / total AS p, 1.959963984540054 AS z FROM tt),
dist AS (SELECT corpus, value, n, total, p, greatest(0.0, (p + z*z/(2*total)) / (1 + z*z/total) - z * sqrt(p*(1-p)/total + z*z/(4*total*total)) / (1 + z*z/total)) AS low,
  least(1.0, (p + z*z/(2*total)) / (1 + z*z/total) + z * sqrt(p*(1-p)/total + z*z/(4*total*total)) / (1 + z*z/total)) AS high FROM pp)"""


def prior_pool_ranges(spark, d):  # type: ignore[no-untyped-def]
    """A-15, A-16: the pool with a verdict on how far corpora disagree."""
    p = I.pooled(_distribution(spark, d))
    ratio = F.try_divide(F.col("most_p"), F.col("least_p"))
    return p.select("value", "n", *(F.round(c, 6).alias(c) for c in ("p", "low", "high", "least_p", "most_p")), "n_usable", F.when(F.col("n_usable") <= 1, "SINGLE CORPUS").when(ratio > 2.0, "FRAGILE").otherwise("STABLE").alias("verdict"))


def pairwise_tvd_jsd(spark, d):  # type: ignore[no-untyped-def]
    """A-14, J-12: corpora two by two. The pairs are of corpora, whose number is small."""
    p = _distribution(spark, d).select("corpus", "value", "p")
    grid = p.select("corpus").distinct().crossJoin(F.broadcast(p.select("value").distinct()))
    full = grid.join(p, ["corpus", "value"], "left").fillna(0.0, ["p"])
    a, b = full.select(F.col("corpus").alias("a"), "value", F.col("p").alias("p")), full.select(F.col("corpus").alias("b"), "value", F.col("p").alias("q"))
    return a.join(b, "value").where("a < b").groupBy("a", "b").agg(F.round(S.total_variation(F.col("p"), F.col("q")), 6).alias("tvd"), F.round(S.jensen_shannon(F.col("p"), F.col("q")), 6).alias("jsd"))


def cluster_bootstrap_hash(spark, d):  # type: ignore[no-untyped-def]
    """U-01, A-35: intervals by a cluster bootstrap whose weights are hashes, alike in every engine."""
    return resample.hash_bootstrap(_values(spark, d).where("value = 'DEF'").select("corpus", "doc_id", F.col("n").alias("k")), _values(spark, d).groupBy("corpus", "doc_id").agg(F.sum("n").alias("n")), draws=50)


BOOT = f"""WITH {DIST}, c AS (SELECT corpus, doc_id, CAST(sum(n) FILTER (value = 'DEF') AS DOUBLE) AS k, CAST(sum(n) AS DOUBLE) AS n FROM sv GROUP BY ALL),
w AS (SELECT corpus, b, k, n, {S.poisson_weight_sql("(CAST('0x' || substr(md5(corpus || '|' || doc_id || '|' || b), 1, 8) AS BIGINT) / 4294967296.0)")} AS w FROM c, range(50) t(b)),
draws AS (SELECT corpus, b, sum(w * coalesce(k, 0)) / nullif(sum(w * n), 0) AS p FROM w GROUP BY ALL)
SELECT corpus, round(avg(p), 6) AS mean_p, round(quantile_cont(p, 0.025), 6) AS low, round(quantile_cont(p, 0.975), 6) AS high FROM draws GROUP BY corpus"""


def cluster_bootstrap_numpy(spark, d):  # type: ignore[no-untyped-def]
    """U-01: the same estimator with Poisson or multinomial weights from numpy."""
    return resample.numpy_bootstrap(_values(spark, d))


def suffix_rule_inventory(spark, d):  # type: ignore[no-untyped-def]
    """J-18, J-16, G-11, I-04."""
    types = _types(spark, d).groupBy("form").agg(F.sum("n").alias("n"))
    return I.suffix_inventory(types, RULES, EXCEPTIONS)


def second_form_density(spark, d):  # type: ignore[no-untyped-def]
    """G-13: sentences with a cue, by corpus, with density and Wilson's interval."""
    s = _sentences(spark, d).where(F.size("tokens") > 0)
    cue = F.exists("tokens", lambda t: t.isin("this", "that"))
    by = s.groupBy("corpus").agg(F.count_if(cue).alias("k"), F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("tokens"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return by.select("corpus", "k", "n", F.round(X.per_million(F.col("k"), F.col("tokens")), 4).alias("per_million"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def log_ratio_by_language(spark, d):  # type: ignore[no-untyped-def]
    """M-02: log2 of relative frequencies, English against all other languages."""
    t = read(spark, d, "documents").select("lang", F.explode(X.tokens(F.col("text"), X.LATIN)).alias("form"))
    n = t.groupBy("form").agg(F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(F.col("lang") != "en").alias("n_other")).where(F.col("n_en") + F.col("n_other") >= 20)
    return n.select("form", "n_en", "n_other", F.when((F.col("n_en") > 0) & (F.col("n_other") > 0), F.round(X.log_ratio(F.col("n_en"), F.col("n_other")), 6)).alias("log_ratio"))


def shared_forms(spark, d):  # type: ignore[no-untyped-def]
    """§2.10, D-02: forms of all four languages, by set operations."""
    t = read(spark, d, "documents").select("lang", F.explode(X.tokens(F.col("text"), X.LATIN)).alias("form"))
    of = lambda lang: t.where(F.col("lang") == lang).select("form")
    return of("en").intersect(of("de")).intersect(of("es")).intersect(of("fr"))


def top_forms_by_corpus(spark, d):  # type: ignore[no-untyped-def]
    """O-02: the twelve most frequent forms of each corpus."""
    w = Window.partitionBy("corpus").orderBy(F.desc("n"), "form")
    return _types(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 12").select("corpus", "form", "n", F.col("rank").cast("long").alias("rank"))


def seeded_sample(spark, d):  # type: ignore[no-untyped-def]
    """O-03, J-04: 300 documents in the order of a seeded hash."""
    return read(spark, d, "documents").select("doc_id", F.md5(F.concat(F.lit("20260807|"), F.col("doc_id").cast("string")).cast("binary")).alias("h")).orderBy("h", "doc_id").limit(300)


QUERIES = {f.__name__: f for f in (
    form_frequencies, form_types, doc_token_counts, candidate_docforms, line_dedup_stats, corpus_build_report, capped_token_budget, sentence_counts, script_ratio_filter, vowel_quality_gate, grapheme_profile,
    prefix_forms, suffix_forms, kwic_concordance, posting_lists_capped, attestation_check, form_corpus_pivot, systematic_sample, pseudo_documents, blank_line_islands, slot_distribution_wilson, prior_pool_ranges,
    pairwise_tvd_jsd, cluster_bootstrap_hash, cluster_bootstrap_numpy, suffix_rule_inventory, second_form_density, log_ratio_by_language, shared_forms, top_forms_by_corpus, seeded_sample,
)}

_RULE = " ".join(f"WHEN ends_with(form, '{s}') THEN '{s}'" for s, _ in RULES)
_VALUE = " ".join(f"WHEN ends_with(form, '{s}') THEN '{v}'" for s, v in RULES)
_WILSON = lambda k, n, sign: f"({k}/{n} + 3.8414588206941236/(2*{n}) {sign} 1.959963984540054 * sqrt(({k}/{n})*(1-{k}/{n})/{n} + 3.8414588206941236/(4*{n}*{n}))) / (1 + 3.8414588206941236/{n})"

ORACLES = {
    "form_frequencies": FORM_FREQUENCIES,
    "form_types": f"WITH {TOK} SELECT * FROM typ",
    "doc_token_counts": f"SELECT source AS corpus, doc_id, len({TOKENS.format('text')}) AS n_tokens, len(list_distinct({TOKENS.format('text')})) AS n_forms FROM documents",
    "candidate_docforms": f"WITH {TOK} SELECT * FROM dform WHERE form IN ('the', 'a', 'an') OR regexp_matches(form, '(tion|ing)$')",
    "line_dedup_stats": f"WITH {LINES} SELECT corpus, count(*) AS n_lines, count(*) FILTER (r = 1) AS n_first FROM firsts GROUP BY corpus",
    "corpus_build_report": f"WITH {GATED} SELECT corpus, count(*) AS n_seen, count(*) FILTER (reason IS NULL) AS n_docs, count(*) FILTER (reason = 'dropped_lang') AS dropped_lang, count(*) FILTER (reason = 'dropped_short') AS dropped_short, count(*) FILTER (reason = 'dropped_quality') AS dropped_quality, CAST(coalesce(sum(n_tok) FILTER (reason IS NULL), 0) AS BIGINT) AS n_tokens FROM r GROUP BY corpus",
    "capped_token_budget": f"WITH {SENT}, b AS (SELECT *, len(tokens) AS n, coalesce(sum(len(tokens)) OVER (PARTITION BY corpus, doc_id ORDER BY sent_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM st WHERE len(tokens) > 0) SELECT corpus, doc_id, CAST(sum(least(n, 200 - before)) AS BIGINT) AS n_tokens, count(*) AS n_sentences FROM b WHERE before < 200 GROUP BY ALL",
    "sentence_counts": f"WITH {SENT} SELECT corpus, doc_id, len(ss) AS n_sentences FROM raw",
    "script_ratio_filter": r"WITH b AS (SELECT doc_id, regexp_replace(text, '[\s\x{200b}-\x{200d}\x{feff}\x{ad}]', '', 'g') AS x, regexp_replace(text, '\s', '', 'g') AS y FROM documents), r AS (SELECT doc_id, CASE WHEN length(x) = 0 THEN 0.0 ELSE length(regexp_replace(x, '[^\p{L}]', '', 'g')) / length(x) END AS ratio, CASE WHEN length(y) = 0 THEN 0.0 ELSE length(regexp_replace(y, '[^\p{L}]', '', 'g')) / length(y) END AS share FROM b) SELECT *, ratio >= 0.8 AS in_script FROM r",
    "vowel_quality_gate": f"WITH r AS (SELECT doc_id, length(regexp_replace(lower(text), '[^{VOWELS}]', '', 'g')) AS v, length(regexp_replace(lower(text), '[^{CONSONANTS}]', '', 'g')) AS c FROM documents), q AS (SELECT doc_id, CASE WHEN c = 0 THEN 0.0 ELSE v / c END AS ratio FROM r) SELECT doc_id, ratio, ratio >= 0.2 AS passes FROM q",
    "grapheme_profile": "SELECT doc_id, length_grapheme(text) AS n_graphemes, length(text) AS n_points FROM documents",
    "prefix_forms": f"WITH {TOK} SELECT * FROM typ WHERE starts_with(form, 'th') AND n >= 2",
    "suffix_forms": f"WITH {TOK} SELECT * FROM typ WHERE ends_with(form, 'tion') AND n >= 2",
    "kwic_concordance": f"WITH {SENT}, h AS (SELECT *, list_position(tokens, 'this') AS p FROM st WHERE list_contains(tokens, 'this')) SELECT corpus, doc_id, sent_no, array_to_string(tokens[greatest(1, p - 8):p - 1], ' ') AS \"left\", array_to_string(tokens[p + 1:p + 8], ' ') AS \"right\" FROM h",
    "posting_lists_capped": f"WITH {SENT}, e AS (SELECT DISTINCT corpus, sid, unnest(tokens) AS form FROM st), k AS (SELECT *, row_number() OVER (PARTITION BY corpus, form ORDER BY sid) AS r FROM e) SELECT corpus, form, count(*) AS n_post, count(*) >= 20 AS truncated, min(sid) AS first_sid, max(sid) AS last_sid FROM k WHERE r <= 20 GROUP BY ALL",
    "attestation_check": f"WITH {TOK}, t AS (SELECT form, CAST(sum(n) AS BIGINT) AS n, CAST(sum(df) AS BIGINT) AS df FROM typ GROUP BY form), a AS (SELECT lower(x) AS form FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in ASKED)}) v(x)) SELECT a.form, coalesce(n, 0) AS n, coalesce(df, 0) AS df, coalesce(n, 0) > 0 AS attested, CASE WHEN coalesce(n, 0) = 0 THEN 'unattested' WHEN df < 5 THEN 'rare' ELSE 'attested' END AS verdict FROM a LEFT JOIN t USING (form)",
    "form_corpus_pivot": r"WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS form FROM documents) SELECT form, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM t WHERE form IN ('the', 'la', 'de', 'der') GROUP BY form",
    "systematic_sample": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE (r - 1) % 7 = 0",
    "pseudo_documents": "WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, line_no // 5 AS block, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM l WHERE (line_no // 5) % 2 = 0 GROUP BY ALL",
    "blank_line_islands": "WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM conversations) SELECT conv_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(turn) AS first_turn FROM t GROUP BY ALL",
    "slot_distribution_wilson": f"WITH {DIST} SELECT corpus, value, n, total, round(p, 6) AS p, round(low, 6) AS low, round(high, 6) AS high FROM dist",
    "prior_pool_ranges": f"WITH {DIST}, o AS (SELECT value, CAST(sum(n) AS BIGINT) AS n, coalesce(min(low) FILTER (total >= 200), 0.0) AS low, coalesce(max(high) FILTER (total >= 200), 1.0) AS high, min(p) FILTER (total >= 200) AS least_p, max(p) FILTER (total >= 200) AS most_p, count(*) FILTER (total >= 200) AS n_usable FROM dist GROUP BY value) SELECT value, n, round(n / (SELECT sum(n) FROM o), 6) AS p, round(low, 6) AS low, round(high, 6) AS high, round(least_p, 6) AS least_p, round(most_p, 6) AS most_p, n_usable, CASE WHEN n_usable <= 1 THEN 'SINGLE CORPUS' WHEN most_p / least_p > 2.0 THEN 'FRAGILE' ELSE 'STABLE' END AS verdict FROM o",
    "pairwise_tvd_jsd": f"WITH {DIST}, c AS (SELECT DISTINCT corpus FROM dist), v AS (SELECT DISTINCT value FROM dist), f AS (SELECT c.corpus, v.value, coalesce(p, 0.0) AS p FROM c CROSS JOIN v LEFT JOIN dist USING (corpus, value)) SELECT x.corpus AS a, y.corpus AS b, round(0.5 * sum(abs(x.p - y.p)), 6) AS tvd, round(sum(CASE WHEN x.p > 0 THEN 0.5 * x.p * log2(x.p / ((x.p + y.p) / 2)) ELSE 0 END + CASE WHEN y.p > 0 THEN 0.5 * y.p * log2(y.p / ((x.p + y.p) / 2)) ELSE 0 END), 6) AS jsd FROM f x JOIN f y USING (value) WHERE x.corpus < y.corpus GROUP BY ALL",
    "cluster_bootstrap_hash": BOOT,
    "suffix_rule_inventory": f"WITH {TOK}, t AS (SELECT form, CAST(sum(n) AS BIGINT) AS n FROM typ GROUP BY form), r AS (SELECT form, n, CASE {_RULE} END AS rule, CASE {_VALUE} END AS value FROM t) SELECT * FROM r WHERE rule IS NOT NULL AND form NOT IN ('thing', 'her', 'other')",
    "second_form_density": f"WITH {SENT}, c AS (SELECT corpus, count(*) FILTER (list_contains(tokens, 'this') OR list_contains(tokens, 'that')) AS k, count(*) AS n, sum(len(tokens)) AS t FROM st WHERE len(tokens) > 0 GROUP BY corpus) SELECT corpus, k, n, round(k * 1e6 / t, 4) AS per_million, round({_WILSON('k', 'n', '-')}, 6) AS low, round({_WILSON('k', 'n', '+')}, 6) AS high FROM c",
    "log_ratio_by_language": r"WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS form FROM documents), n AS (SELECT form, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang <> 'en') AS n_other FROM t GROUP BY form) SELECT form, n_en, n_other, CASE WHEN n_en > 0 AND n_other > 0 THEN round(log2(n_en / n_other), 6) END AS log_ratio FROM n WHERE n_en + n_other >= 20",
    "shared_forms": r"WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS form FROM documents) SELECT form FROM t GROUP BY form HAVING count(DISTINCT lang) FILTER (lang IN ('en', 'de', 'es', 'fr')) = 4",
    "top_forms_by_corpus": f"WITH {TOK}, k AS (SELECT corpus, form, n, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, form) AS rank FROM typ) SELECT * FROM k WHERE rank <= 12",
    "seeded_sample": "SELECT doc_id, md5('20260807|' || doc_id) AS h FROM documents ORDER BY h, doc_id LIMIT 300",
}
