"""Scans, projections, filters, profile tables, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasebench.functions.numeric import r6, round_half_even
from phrasebench.operators import bank as B
from phrasebench.operators import clean as C
from phrasebench.operators import diagnose as G
from phrasebench.operators import profile as P
from phrasebench.operators import split as S
from phrasebench.operators.ordering import hash_order, sample_rows, shuffle_rank
from phrasebench.queries.registry import EXAMPLES, SCORED, half_even, md5_of, query, tokens_of
from phrasebench.schemas import TABLES


@query("scan_project_filter", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en'")
def _(t):
    """Scan with a declared schema, column list, equality filter."""
    docs = t.spark.read.schema(TABLES["documents"]).parquet(f"{t.root}/documents.parquet")
    return docs.select("doc_id", "lang", "source", "n_chars").where(F.col("lang") == "en")


@query("p01_columns", "SELECT doc_id, text, lang FROM documents")
def _(t):
    """P01"""
    return t.documents.select("doc_id", "text", "lang")


@query("p02_rename", "SELECT doc_id AS example_id, source AS entity, lang AS language FROM documents")
def _(t):
    """P02"""
    return t.documents.select("doc_id", "source", "lang").toDF("example_id", "entity", "language")


@query("p03_equality_filter", f"WITH {EXAMPLES} SELECT doc_id, source FROM ex WHERE quality = 1")
def _(t):
    """P03"""
    return t.examples.where(F.col("quality") == 1).select("doc_id", "source")


@query("p04_membership", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def _(t):
    """P04"""
    return t.documents.where(F.col("lang").isin("en", "fr")).select("doc_id", "lang")


@query("p05_label_and_not_null", f"WITH {EXAMPLES} SELECT doc_id FROM ex WHERE quality = 1 AND toxic IS NOT NULL AND text IS NOT NULL")
def _(t):
    """P05"""
    keep = (F.col("quality") == 1) & F.col("toxic").isNotNull() & F.col("text").isNotNull()
    return t.examples.where(keep).select("doc_id")


@query("p06_not_empty", "SELECT conv_id, turn FROM conversations WHERE trim(text) <> ''")
def _(t):
    """P06"""
    return t.conversations.where(C.not_empty("text")).select("conv_id", "turn")


@query("p07_drop_nulls", f"WITH {EXAMPLES} SELECT doc_id, quality FROM ex WHERE quality IS NOT NULL AND text IS NOT NULL")
def _(t):
    """P07"""
    return t.examples.na.drop(subset=["quality", "text"]).select("doc_id", "quality")


@query("quality_funnel", f"""WITH {EXAMPLES}, c AS (SELECT count(*) a, count_if(text IS NOT NULL) b,
  count_if(text IS NOT NULL AND quality IS NOT NULL) c, count_if(text IS NOT NULL AND quality = 1) d,
  count_if(text IS NOT NULL AND quality = 1 AND toxic = 0 AND lang IN ('en', 'fr')) e FROM ex)
SELECT 0 AS position, 'all' AS stage, a AS n FROM c UNION ALL SELECT 1, 'has_text', b FROM c
UNION ALL SELECT 2, 'labelled', c FROM c UNION ALL SELECT 3, 'good', d FROM c UNION ALL SELECT 4, 'usable', e FROM c""")
def _(t):
    """Rows left after each filter, one pass."""
    q = F.col("quality")
    return C.quality_funnel(t.examples, [
        ("all", F.lit(True)), ("has_text", F.col("text").isNotNull()), ("labelled", q.isNotNull()),
        ("good", q == 1), ("usable", (F.col("toxic") == 0) & F.col("lang").isin("en", "fr"))])


@query("p09_contains_column", "SELECT page_id FROM pages WHERE contains(lower(html), lower(split_part(split_part(url, '//', 2), '/', 1)))")
def _(t):
    """Does a page's text name its own host?"""
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    pages = t.pages.withColumn("host", host)
    return pages.where(C.contains_column("html", "host")).select("page_id")


@query("p10_fallback_key", f"WITH {EXAMPLES} SELECT doc_id, coalesce(CASE WHEN quality IS NOT NULL THEN 'pair' || quality END, md5(text)) AS split_group FROM ex")
def _(t):
    """P10"""
    ex = t.examples.withColumns({"pair_id": F.concat(F.lit("pair"), F.col("quality").cast("string")), "h": F.md5("text")})
    return ex.select("doc_id", C.fallback_key("pair_id", "h").alias("split_group"))


@query("p11_label_number", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS y FROM conversations")
def _(t):
    """P11"""
    return t.conversations.select("conv_id", "turn", C.map_values("role", {"user": 0, "assistant": 1}).alias("y"))


@query("p12_display_label", "SELECT doc_id, CASE quality WHEN 0 THEN 'Literal' WHEN 1 THEN 'Idiomatic' ELSE quality::VARCHAR END AS label FROM labels")
def _(t):
    """P12"""
    shown = C.map_values("quality", {0: "Literal", 1: "Idiomatic"}, F.col("quality").cast("string"))
    return t.labels.select("doc_id", shown.alias("label"))


@query("p13_p14_tag_and_copy", "SELECT doc_id, text AS input_text, 'example' AS input_type FROM documents")
def _(t):
    """P13, P14"""
    return t.documents.withColumns({"input_text": F.col("text"), "input_type": F.lit("example")}).select(
        "doc_id", "input_text", "input_type")


@query("p15_try_number", "SELECT o_orderkey, try_cast(left(o_orderpriority, 1) AS DOUBLE) AS level, try_cast(o_orderstatus AS DOUBLE) AS bad FROM orders")
def _(t):
    """P15"""
    rows = t.orders.withColumn("p", F.left("o_orderpriority", F.lit(1)))
    return rows.select("o_orderkey", C.number_or_null("p").alias("level"), C.number_or_null("o_orderstatus").alias("bad"))


@query("p16_score_mask", f"WITH {SCORED} SELECT doc_id, score FROM scored WHERE score >= 0.7::DOUBLE")
def _(t):
    """P16"""
    return t.scored.where(F.col("score") >= 0.7).select("doc_id", "score")


@query("p17_outcome_split", f"WITH {SCORED} SELECT doc_id, 'correct' AS part FROM scored WHERE pred = gold UNION ALL SELECT doc_id, 'wrong' FROM scored WHERE NOT pred = gold")
def _(t):
    """Correct and incorrect rows as two tables, put under each other."""
    ok = F.col("pred") == F.col("gold")
    right, wrong = t.scored.where(ok), t.scored.where(~ok)
    return right.select("doc_id", F.lit("correct").alias("part")).unionByName(
        wrong.select("doc_id", F.lit("wrong").alias("part")))


@query("p18_preview", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 10")
def _(t):
    """First rows in a stated order."""
    return t.documents.select("doc_id", "lang", "n_chars").orderBy("doc_id").limit(10)


@query("p19_sample", f"SELECT doc_id FROM documents ORDER BY {md5_of('doc_id')} LIMIT 100")
def _(t):
    """Exactly 100 rows in hash order."""
    return sample_rows(t.documents.select("doc_id"), "doc_id", 100)


@query("p20_shuffle", f"SELECT o_orderkey, row_number() OVER (ORDER BY {md5_of('o_orderkey')}, o_orderkey) AS place FROM orders")
def _(t):
    """P20: place of every row in the full shuffle."""
    return shuffle_rank(t.orders.select("o_orderkey"), "o_orderkey", rank="place")


@query("p21_flags", f"""WITH {SCORED} SELECT doc_id, CASE WHEN pred = 0 THEN 'literal_note'
  WHEN score < 0.9::DOUBLE THEN 'low_confidence' ELSE 'none' END AS note, score < 0.9::DOUBLE AS ambiguous FROM scored""")
def _(t):
    """P21"""
    rows = t.scored.withColumn("label", C.map_values("pred", {0: "Literal", 1: "Idiomatic"}))
    return rows.select("doc_id", *C.weak_flags("label", "score"))


@query("p22_equal_flag", f"WITH {SCORED} SELECT doc_id, (pred = gold)::INT AS is_correct FROM scored")
def _(t):
    """P22"""
    return t.scored.select("doc_id", (F.col("pred") == F.col("gold")).cast("int").alias("is_correct"))


# ---- set operations ------------------------------------------------------------------------------

@query("u01_union_all", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def _(t):
    """Concatenation of splits."""
    return t.documents.select(F.col("doc_id").alias("id"), "text").unionByName(
        t.benchmark.select(F.col("item_id").alias("id"), "text"))


@query("u02_union_missing", "SELECT doc_id, lang, NULL::BIGINT AS item_id, text FROM documents UNION ALL SELECT NULL, NULL, item_id, text FROM benchmark")
def _(t):
    """U02"""
    return t.documents.select("doc_id", "lang", "text").unionByName(t.benchmark, allowMissingColumns=True)


@query("u03_union_distinct", "SELECT source AS id FROM documents UNION SELECT lang FROM documents")
def _(t):
    """U03"""
    d = t.documents
    return d.select(F.col("source").alias("id")).union(d.select("lang")).distinct()


@query("u04_intersect", "SELECT md5(text) AS k FROM documents INTERSECT SELECT md5(text) FROM documents WHERE lang <> 'en'")
def _(t):
    """U04"""
    keys = t.documents.select(F.md5("text").alias("k"), "lang")
    return keys.select("k").intersect(keys.where(F.col("lang") != "en").select("k"))


@query("u05_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t):
    """U05"""
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id"))


# ---- profile -------------------------------------------------------------------------------------

@query("a01_value_counts", f"WITH {EXAMPLES} SELECT quality AS value, count(*) AS n FROM ex WHERE quality IS NOT NULL GROUP BY 1")
def _(t):
    """A01"""
    return P.value_counts(t.examples, "quality")


@query("a02_top_values", f"""WITH {EXAMPLES}, l AS (SELECT 'lang' AS col, lang AS value FROM ex UNION ALL SELECT 'source', source FROM ex
  UNION ALL SELECT 'quality', quality::VARCHAR FROM ex UNION ALL SELECT 'toxic', toxic::VARCHAR FROM ex),
c AS (SELECT col, value, count(*) AS n FROM l GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value NULLS FIRST) AS rank FROM c QUALIFY rank <= 20""")
def _(t):
    """Most frequent values of several columns, nulls counted."""
    return P.top_values(t.examples, ["lang", "source", "quality", "toxic"])


@query("a03_percentages", f"SELECT source AS value, {half_even('count(*) / (SELECT count(*) FROM documents) * 100', 2)} AS pct FROM documents GROUP BY 1")
def _(t):
    """A03, X22"""
    return P.percentages(t.documents, "source")


@query("label_pct", f"""WITH {EXAMPLES} SELECT lang AS dataset, {half_even('count_if(quality = 0) / count(quality) * 100', 2)} AS pct_0,
 {half_even('count_if(quality = 1) / count(quality) * 100', 2)} AS pct_1 FROM ex GROUP BY lang""")
def _(t):
    """Label shares per dataset variant (here: language) as columns."""
    return P.label_table(t.examples.withColumnRenamed("lang", "dataset"), "dataset", "quality", [0, 1])


@query("a05_distinct", "SELECT count(DISTINCT source) AS sources, count(DISTINCT text) AS texts, count(DISTINCT lang) AS langs FROM documents")
def _(t):
    """A05"""
    return t.documents.agg(F.countDistinct("source").alias("sources"), F.countDistinct(F.md5("text")).alias("texts"),
                           F.countDistinct("lang").alias("langs"))


@query("profile_overview", " UNION ALL ".join(
    f"""SELECT '{n}' AS dataset, count(*) AS n_rows, 5 AS n_columns, count(DISTINCT source) AS n_entities,
    count(DISTINCT text) AS n_texts, {half_even('count(*) / count(DISTINCT source)', 2)} AS rows_per_entity
    FROM documents {w}""" for n, w in (("all", ""), ("en", "WHERE lang = 'en'"), ("fr", "WHERE lang = 'fr'"))))
def _(t):
    """A06, A07, Z01"""
    d = t.documents
    parts = {"all": d, "en": d.where(F.col("lang") == "en"), "fr": d.where(F.col("lang") == "fr")}
    return P.overview(parts, "source", "text")


@query("a08_group_mean", f"SELECT l_returnflag, {half_even('avg(l_discount)', 3)} AS mean_discount FROM lineitem GROUP BY 1")
def _(t):
    """A08, X22"""
    return t.lineitem.groupBy("l_returnflag").agg(round_half_even(F.avg("l_discount"), 3).alias("mean_discount"))


@query("missing_profile", f"""WITH {EXAMPLES}, c AS (SELECT count(*) a, count_if(text IS NULL) b, count_if(quality IS NULL) c,
 count_if(toxic IS NULL) d FROM ex) SELECT 'text' AS col, b AS n_missing, round(b / a, 6) AS ratio FROM c
 UNION ALL SELECT 'quality', c, round(c / a, 6) FROM c UNION ALL SELECT 'toxic', d, round(d / a, 6) FROM c""")
def _(t):
    """A09, K07"""
    return P.missing_profile(t.examples, ["text", "quality", "toxic"]).withColumn("ratio", r6("ratio"))


@query("a14_distinct_rows", "SELECT DISTINCT text, lang FROM documents")
def _(t):
    """A14"""
    return t.documents.select("text", "lang").distinct()


@query("type_token_ratio", f"""SELECT count(*) AS n_tokens, count(DISTINCT w) AS n_types,
 round(count(DISTINCT w) / count(*), 6) AS type_token_ratio FROM (SELECT unnest({tokens_of('text')}) AS w FROM documents)""")
def _(t):
    """A15, X05"""
    return P.token_totals(t.documents, "text").withColumn("type_token_ratio", r6("type_token_ratio"))


HIST = """r AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM v),
b AS (SELECT CASE WHEN hi > lo THEN least({bins} - 1, floor((x - lo) / ((hi - lo) / {bins}))) ELSE 0 END::INT AS bin, lo, (hi - lo) / {bins} AS w, r.n AS tot FROM v, r)"""


@query("histogram_len", f"""WITH v AS (SELECT len({tokens_of('text')})::DOUBLE AS x FROM documents), {HIST.format(bins=30)}
SELECT bin, count(*) AS n, round(max(lo) + bin * max(w), 6) AS lo, round(max(lo) + (bin + 1) * max(w), 6) AS hi FROM b GROUP BY bin""")
def _(t):
    """Histogram of text lengths in words, 30 bins."""
    from phrasebench.functions.text import tokenize_ws
    lengths = t.documents.select(F.size(tokenize_ws("text")).alias("words"))
    return G.histogram(lengths, "words", 30).withColumns({"lo": r6("lo"), "hi": r6("hi")})


@query("a16_histogram_events", f"""WITH v AS (SELECT value AS x FROM events), {HIST.format(bins=50)}
SELECT bin, count(*) AS n, round(max(lo) + bin * max(w), 6) AS lo, round(max(lo) + (bin + 1) * max(w), 6) AS hi FROM b GROUP BY bin""")
def _(t):
    """A16 on events, 50 bins."""
    return G.histogram(t.events, "value", 50).withColumns({"lo": r6("lo"), "hi": r6("hi")})


@query("a17_density_by_outcome", f"""WITH {SCORED}, r AS (SELECT correct, min(score) AS lo, (max(score) - min(score)) / 50 AS w, count(*) AS tot FROM scored GROUP BY 1),
b AS (SELECT correct, least(49, floor((score - lo) / w))::INT AS bin, lo, w, tot FROM scored JOIN r USING (correct))
SELECT correct, bin, count(*) AS n, round(max(lo) + bin * max(w), 6) AS lo, round(max(lo) + (bin + 1) * max(w), 6) AS hi,
 round(count(*) / (max(tot) * max(w)), 6) AS density FROM b GROUP BY correct, bin""")
def _(t):
    """Density histogram of scores for right and wrong rows."""
    out = G.histogram(t.scored, "score", 50, ["correct"], density=True)
    return out.withColumns({c: r6(c) for c in ("lo", "hi", "density")})


@query("kde_len", f"""WITH v AS (SELECT len({tokens_of('text')})::DOUBLE AS x FROM documents),
p AS (SELECT stddev_samp(x) * pow(count(*), -0.2::DOUBLE) AS h, min(x) AS a0, max(x) AS b0, count(*) AS n FROM v),
g AS (SELECT i::INT AS i, (a0 - 3.0::DOUBLE * h) + ((b0 + 3.0::DOUBLE * h) - (a0 - 3.0::DOUBLE * h)) * i / 99 AS gx, h, n FROM p, range(100) t(i)),
c AS (SELECT x, count(*) AS c FROM v GROUP BY x)
SELECT i, round(gx, 6) AS x, round(sum(c * exp(-0.5::DOUBLE * ((gx - c.x) / h) * ((gx - c.x) / h))) / (max(n) * max(h) * 2.5066282746310002::DOUBLE), 6) AS density
FROM g, c GROUP BY i, gx""")
def _(t):
    """Kernel density of text lengths."""
    from phrasebench.functions.text import tokenize_ws
    lengths = t.documents.select(F.size(tokenize_ws("text")).alias("words"))
    return G.kde(lengths, "words").withColumns({"x": r6("x"), "density": r6("density")})


@query("a46_shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def _(t):
    """A46"""
    return P.shape(t.lineitem)


@query("j14_display_order", """WITH o(position, lang) AS (VALUES (0, 'en'), (1, 'fr'), (2, 'de'), (3, 'es'), (4, 'ar'))
SELECT o.position, o.lang, c.n FROM o LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) c USING (lang)""")
def _(t):
    """Counts in a given category order; a category without rows stays."""
    counts = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    return P.in_order(counts, "lang", ["en", "fr", "de", "es", "ar"])


@query("k01_sort_models", "SELECT source, avg(quality::DOUBLE) AS acc FROM documents JOIN labels USING (doc_id) GROUP BY 1 ORDER BY acc DESC, source")
def _(t):
    """Best first."""
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id")
    return rows.groupBy("source").agg(F.avg(F.col("quality").cast("double")).alias("acc")).orderBy(F.desc("acc"), "source")


@query("s17_inline_queries", """WITH q(query_id, lang) AS (VALUES (1, 'en'), (2, 'fr'), (3, 'es'))
SELECT q.query_id, d.doc_id FROM q JOIN documents d USING (lang)""")
def _(t):
    """A query table typed in the job, joined to the given table."""
    from phrasebench.sources.tables import inline_table
    q = inline_table(t.spark, [(1, "en"), (2, "fr"), (3, "es")], "query_id int, lang string")
    return t.documents.join(F.broadcast(q), "lang").select("query_id", "doc_id")


@query("z01_corpus_profile", f"""WITH {EXAMPLES}
SELECT 'label_pct' AS report, quality::VARCHAR AS item, {half_even('count(*) / (SELECT count(quality) FROM ex) * 100', 2)} AS value FROM ex WHERE quality IS NOT NULL GROUP BY quality
UNION ALL SELECT 'missing', 'quality', round(count_if(quality IS NULL) / count(*), 6) FROM ex
UNION ALL SELECT 'missing', 'text', round(count_if(text IS NULL) / count(*), 6) FROM ex
UNION ALL SELECT 'tokens', 'type_token_ratio', round(count(DISTINCT w) / count(*), 6) FROM (SELECT unnest({tokens_of('text')}) AS w FROM ex)""")
def _(t):
    """The profile report's tables in one long table."""
    from phrasebench.plans.corpus import corpus_profile
    parts = corpus_profile(t.examples.select("doc_id", "text", "source", "quality", "n_chars"), "source", "text", "quality", "n_chars")
    pct = parts["label_pct"].select(F.lit("label_pct").alias("report"), F.col("value").cast("string").alias("item"), F.col("pct").alias("value"))
    miss = parts["missing"].where(F.col("col").isin("quality", "text")).select(F.lit("missing").alias("report"), F.col("col").alias("item"), r6("ratio").alias("value"))
    toks = parts["tokens"].select(F.lit("tokens").alias("report"), F.lit("type_token_ratio").alias("item"), r6("type_token_ratio").alias("value"))
    return pct.unionByName(miss).unionByName(toks)
