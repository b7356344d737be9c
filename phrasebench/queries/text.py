"""String and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasebench.functions import numeric as N
from phrasebench.functions import text as X
from phrasebench.operators.phrases import token_run_matches
from phrasebench.queries.registry import EXAMPLES, SCORED, norm_of, query, stem_of, tokens_of
from phrasebench.session import spread


@query("x01_x02_lower_trim", r"""WITH d AS (SELECT doc_id, chr(9) || text || chr(160) || chr(10) || ' ' AS text FROM documents)
SELECT doc_id, lower(text) AS low, regexp_replace(regexp_replace(text, '^[\s\x1c-\x1f\x{85}\p{Z}]+', ''), '[\s\x1c-\x1f\x{85}\p{Z}]+$', '') AS trimmed FROM d""")
def _(t):
    """Lower case, and white space of every kind cut off both ends."""
    rows = t.documents.select("doc_id", F.concat(F.lit("\t"), "text", F.lit(" \n ")).alias("text"))
    return rows.select("doc_id", F.lower("text").alias("low"), X.strip_all("text").alias("trimmed"))


@query("x03_remove_words", r"SELECT doc_id, regexp_replace(regexp_replace(text, '\b(the|and)\b', '', 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM documents")
def _(t):
    """Cut whole words (here two common ones), strip, keep inner double spaces."""
    return t.documents.select("doc_id", X.remove_label_words("text", ("the", "and")).alias("cleaned"))


@query("x04_collapse_space", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents")
def _(t):
    """X04"""
    return t.documents.select("doc_id", X.collapse_space("text").alias("flat"))


@query("x05_tokens", f"SELECT doc_id, len({tokens_of('text')}) AS n, array_to_string({tokens_of('text')}, ' ') AS joined FROM documents")
def _(t):
    """X05"""
    tok = X.tokenize_ws("text")
    return t.documents.select("doc_id", F.size(tok).cast("long").alias("n"), F.array_join(tok, " ").alias("joined"))


@query("bank_text", r"""SELECT doc_id, trim(regexp_replace('idiom: ' || trim(source) || '. idiom: ' || trim(source) || '. meaning: ' || trim(lang)
 || '. paraphrase: ' || coalesce(trim(quality::VARCHAR), '') || '. explanation: ' || coalesce(trim(toxic::VARCHAR), '')
 || '. usage: ' || trim(text), '\s+', ' ', 'g')) AS bank_text FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    """X06, X04, X30"""
    return t.examples.select("doc_id", X.bank_text("source", "lang", "quality", "toxic", "text").alias("bank_text"))


@query("x07_join_nonempty", f"WITH {EXAMPLES} SELECT doc_id, concat_ws(' | ', source, quality::VARCHAR, lang) AS joined FROM ex")
def _(t):
    """X07"""
    return t.examples.select("doc_id", X.join_nonempty("source", F.col("quality").cast("string"), "lang").alias("joined"))


@query("x08_role_prefix", "SELECT item_id AS id, 'query: ' || text AS text FROM benchmark UNION ALL SELECT doc_id, 'passage: ' || text FROM documents")
def _(t):
    """X08"""
    q = t.benchmark.select(F.col("item_id").alias("id"), X.role_prefix("text", "query").alias("text"))
    return q.unionByName(t.documents.select(F.col("doc_id").alias("id"), X.role_prefix("text", "passage").alias("text")))


@query("x09_candidate_text", f"WITH {EXAMPLES} SELECT doc_id, source || ' | ' || coalesce(quality::VARCHAR, '') AS candidate FROM ex")
def _(t):
    """A missing meaning is empty."""
    return t.examples.select("doc_id", X.candidate_text("source", F.col("quality").cast("string")).alias("candidate"))


@query("x10_letters", "SELECT doc_id, regexp_replace(text, '[^a-zA-Z]', '', 'g') AS letters FROM documents")
def _(t):
    """X10"""
    return t.documents.select("doc_id", X.letters_only("text").alias("letters"))


@query("light_stem", f"SELECT w AS word, {stem_of('w')} AS stem, count(*) AS n FROM (SELECT unnest({tokens_of('text')}) AS w FROM documents) GROUP BY 1, 2")
def _(t):
    """X11: stem of every word of the corpus."""
    words = t.documents.select(F.explode(X.tokenize_ws("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", X.light_stem("word").alias("stem"), "n")


@query("x12_normal_tokens", f"SELECT doc_id, array_to_string({norm_of('text')}, ' ') AS run FROM documents")
def _(t):
    """X12"""
    return t.documents.select("doc_id", F.array_join(X.normal_tokens("text"), " ").alias("run"))


@query("x13_phrase_score", f"""WITH c AS (SELECT conv_id, turn, {norm_of('text')} AS q, {norm_of("'la'")} AS p FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(' ' || array_to_string(q, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' ') THEN 1.0::DOUBLE ELSE 0 END AS score,
 CASE WHEN contains(' ' || array_to_string(q, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' ') THEN 0.2::DOUBLE ELSE 0 END AS boost FROM c""")
def _(t):
    """Adjacent phrase score of each turn and its boost."""
    score = X.phrase_score(X.normal_tokens(F.lit("la")), X.normal_tokens("text"))
    return t.conversations.select("conv_id", "turn", score.alias("score"), X.phrase_boost(score).alias("boost"))


@query("phrase_match", f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({norm_of('text')}, ' ') || ' ' AS q FROM documents),
p AS (SELECT item_id, ' ' || array_to_string({norm_of('text')}, ' ') || ' ' AS p FROM benchmark)
SELECT doc_id AS query_id, item_id AS phrase_id FROM d, p WHERE contains(q, p)""")
def _(t):
    """Which passages occur as a token run of which document; one pass over the documents."""
    docs = spread(t.documents.select("doc_id", "text")).select("doc_id", X.normal_tokens("text").alias("q"))
    items = t.benchmark.select("item_id", X.normal_tokens("text").alias("p"))
    return token_run_matches(docs, "doc_id", "q", items, "item_id", "p")


@query("x15_l2_norm", "SELECT vec_id, round(list_aggregate(list_transform(v, lambda x: x / n), 'sum'), 6) AS unit_sum, round(n, 6) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def _(t):
    """Unit vectors, shown by the sum of their parts, and norms."""
    unit = N.l2_normalize("embedding")
    total = F.aggregate(unit, F.lit(0.0), lambda s, x: s + x)
    return t.embeddings.select("vec_id", N.r6(total).alias("unit_sum"), N.r6(N.l2_norm("embedding")).alias("norm"))


@query("x16_dot", "WITH c AS (SELECT label, list(embedding ORDER BY vec_id)[1]::DOUBLE[] AS c FROM embeddings GROUP BY 1) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], c), 6) AS dot FROM embeddings JOIN c USING (label)")
def _(t):
    """Dot product of every vector with its label's first vector."""
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    return t.embeddings.join(first, "label").select("vec_id", N.r6(N.dot("embedding", "c")).alias("dot"))


@query("x17_x18_x19_fusion", f"""WITH {SCORED} SELECT doc_id, round(0.8::DOUBLE * score + (1 - 0.8::DOUBLE) * gold, 6) AS linear,
 round(0.65::DOUBLE * score + 0.35::DOUBLE * gold, 6) AS demo, round(score + 0.2::DOUBLE * gold, 6) AS boosted FROM scored""")
def _(t):
    """Fusion arithmetic."""
    return t.scored.select(
        "doc_id", N.r6(N.linear_fusion("score", "gold")).alias("linear"),
        N.r6(F.lit(0.65) * F.col("score") + F.lit(0.35) * F.col("gold")).alias("demo"),
        N.r6(F.col("score") + F.lit(0.2) * F.col("gold")).alias("boosted"))


@query("x21_softmax", f"""WITH {SCORED}, e AS (SELECT doc_id, exp(score - greatest(score, 1 - score)) AS a, exp((1 - score) - greatest(score, 1 - score)) AS b FROM scored)
SELECT doc_id, CASE WHEN a >= b THEN 0 ELSE 1 END AS class_id, round(greatest(a, b) / (a + b), 6) AS confidence FROM e""")
def _(t):
    """Class and confidence of two logits."""
    p = N.softmax(F.array(F.col("score"), F.lit(1.0) - F.col("score")))
    rows = t.scored.withColumn("p", p)
    return rows.select("doc_id", N.arg_max("p").alias("class_id"), N.r6(F.array_max("p")).alias("confidence"))


@query("x23_x24_lists", """WITH l AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1),
d AS (SELECT conv_id, list_reduce(list_transform(roles, lambda r: [r]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS u FROM l)
SELECT conv_id, array_to_string(u[1:2], ',') AS first_two, coalesce(1.0::DOUBLE / nullif(list_position(u, 'assistant'), 0), 0) AS rr,
 list_contains(u[1:1], 'assistant')::INT AS in_first FROM d""")
def _(t):
    """Order-preserving distinct, prefix, reciprocal rank, gold in first k.

    The first turn of each (conversation, role) is found first, so only distinct roles are collected.
    """
    firsts = t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))
    order = F.array_sort(F.collect_list(F.struct("turn", "role")))
    rows = firsts.groupBy("conv_id").agg(F.array_distinct(F.transform(order, lambda r: r["role"])).alias("u"))
    gold = F.lit("assistant")
    return rows.select("conv_id", F.array_join(F.slice("u", 1, 2), ",").alias("first_two"),
                       N.reciprocal_rank("u", gold).alias("rr"), N.gold_in_first("u", gold, 1).alias("in_first"))


@query("x25_parse_list", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS first FROM documents""")
def _(t):
    """Lists stored as text, plain text beside them."""
    stored = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("['"), "lang", F.lit("', '"), "source", F.lit("']"))).otherwise(F.col("source"))
    rows = t.documents.withColumn("l", X.parse_list(stored))
    return rows.select("doc_id", F.size("l").cast("long").alias("n"), F.col("l")[0].alias("first"))


@query("x26_failure_type", f"""WITH n AS (SELECT conv_id, turn, list_distinct({tokens_of('text')}) AS w, lead(list_distinct({tokens_of('text')})) OVER (PARTITION BY conv_id ORDER BY turn) AS nw FROM conversations)
SELECT conv_id, turn, CASE WHEN len(list_intersect(w, nw)) > 0 THEN 'Lexical Confusion' WHEN len(w) <= 3 AND len(nw) <= 3 THEN 'Short/Ambiguous Idioms' ELSE 'Semantic Confusion' END AS failure_type FROM n WHERE nw IS NOT NULL""")
def _(t):
    """Failure type of each turn against the next one."""
    nxt = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return t.conversations.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", X.failure_type("text", "next").alias("failure_type"))


@query("x28_templates", """SELECT item_id, text, 1 AS label FROM benchmark UNION ALL SELECT item_id, 'she ' || text, 1 FROM benchmark
UNION ALL SELECT item_id, text || ' on the floor', 0 FROM benchmark UNION ALL SELECT item_id, text || ' in the cup', 0 FROM benchmark""")
def _(t):
    """X28"""
    return t.benchmark.select("item_id", F.inline(X.weak_context_rows("text")))


@query("x29_thresholds", f"WITH {SCORED}, g AS (SELECT round_even((0.5::DOUBLE + 0.05::DOUBLE * i) * 1e2, 0) / 1e2 AS threshold FROM range(10) t(i)) SELECT threshold, count_if(score >= threshold) AS n FROM scored, g GROUP BY 1")
def _(t):
    """Evenly spaced thresholds; each row is counted at every threshold it reaches."""
    rows = t.scored.select("score", F.explode(N.thresholds()).alias("threshold"))
    return rows.groupBy("threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("n"))
