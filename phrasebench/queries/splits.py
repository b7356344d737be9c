"""Splits, hold-outs, banks, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasebench.functions import text as X
from phrasebench.functions.numeric import r6
from phrasebench.operators import bank as B
from phrasebench.operators import split as S
from phrasebench.operators.ordering import hash_order
from phrasebench.queries.registry import EXAMPLES, md5_of, query

GROUPS = f"""g0 AS (SELECT DISTINCT o_custkey FROM orders),
g AS (SELECT o_custkey, row_number() OVER (ORDER BY {md5_of('o_custkey')}, o_custkey) AS rn, count(*) OVER () AS n FROM g0),
os AS (SELECT o.*, CASE WHEN rn <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM orders o JOIN g USING (o_custkey))"""


def order_split(t):
    return S.group_split(t.orders, "o_custkey")


@query("group_split", f"WITH {GROUPS} SELECT o_orderkey, o_custkey, split FROM os")
def _(t):
    """A fifth of the customers, with all their orders, go to test; decided per row by its own key."""
    return order_split(t).select("o_orderkey", "o_custkey", "split")


@query("w01_text_groups", f"""WITH h AS (SELECT doc_id, md5(text) AS k FROM documents),
g AS (SELECT k, row_number() OVER (ORDER BY {md5_of('k')}, k) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT k FROM h))
SELECT doc_id, CASE WHEN rn <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM h JOIN g USING (k)""")
def _(t):
    """W01 on documents: equal texts stay on one side."""
    return S.group_split(t.documents.withColumn("k", F.md5("text")), "k").select("doc_id", "split")


@query("entity_split", f"""WITH g AS (SELECT l_suppkey, row_number() OVER (ORDER BY {md5_of('l_suppkey')}, l_suppkey) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem))
SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN rn <= floor(0.8::DOUBLE * n) THEN 'train' ELSE 'test' END AS split FROM lineitem JOIN g USING (l_suppkey)""")
def _(t):
    """W02"""
    return S.entity_split(t.lineitem, "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey", "split")


WITHIN = f"""w0 AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY {md5_of('doc_id')}, doc_id) AS rn,
 count(*) OVER (PARTITION BY source) AS n FROM documents),
ws AS (SELECT doc_id, source, text, CASE WHEN n > 1 AND rn <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM w0)"""


@query("within_entity_split", f"WITH {WITHIN} SELECT doc_id, source, split FROM ws")
def _(t):
    """W03"""
    return S.within_entity_split(t.documents.select("doc_id", "source"), "source", "doc_id")


HELD = f"held AS (SELECT doc_id, source, text FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {md5_of('doc_id')}, doc_id) = 1)"


@query("holdout_one", f"WITH {HELD} SELECT doc_id, source FROM held")
def _(t):
    """W04"""
    return S.holdout_one(t.documents.select("doc_id", "source"), "source", "doc_id")


@query("index_bank", f"WITH {HELD} SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.text = d.text)")
def _(t):
    """The bank without any row that carries a held-out text."""
    d = t.documents.select("doc_id", "source", "text")
    held = S.holdout_one(d, "source", "doc_id").select("text").distinct()
    return S.rows_not_in(d, held, "text").select("doc_id")


@query("leakage_zero", f"WITH {GROUPS} SELECT count(*) AS leaked_groups FROM (SELECT o_custkey FROM os GROUP BY 1 HAVING count(DISTINCT split) > 1)")
def _(t):
    """No customer on both sides."""
    return S.leakage(order_split(t), "o_custkey")


@query("j11_leakage_within", f"WITH {WITHIN} SELECT count(*) AS leaked_groups FROM (SELECT source FROM ws GROUP BY 1 HAVING count(DISTINCT split) > 1)")
def _(t):
    """A split inside entities shares them on purpose."""
    return S.leakage(S.within_entity_split(t.documents.select("doc_id", "source"), "source", "doc_id"), "source")


@query("j01_rows_in_split", f"WITH {GROUPS} SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM os WHERE split = 'test')")
def _(t):
    """Semi join with the groups of a split."""
    groups = order_split(t).where(F.col("split") == "test").select("o_custkey").distinct()
    return S.rows_in(t.orders, groups, "o_custkey").select("o_orderkey")


@query("a40_split_report", f"""WITH {GROUPS} SELECT split, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_entities,
 round(avg((o_orderstatus = 'F')::INT::DOUBLE), 6) AS label_mean FROM os GROUP BY 1""")
def _(t):
    """A40"""
    rows = order_split(t).withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return S.split_report(rows, "o_custkey", "y").withColumn("label_mean", r6("label_mean"))


DOC_TRAIN = f"""tr AS (SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {md5_of('doc_id')}, doc_id) AS rn,
 count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE NOT (n > 1 AND rn <= ceil(0.2::DOUBLE * n))),
pick AS (SELECT doc_id, source FROM tr ORDER BY {md5_of('doc_id')} LIMIT 2000)"""


@query("augment_rows", f"""WITH {DOC_TRAIN} SELECT doc_id, source AS text, 1 AS label FROM pick UNION ALL SELECT doc_id, 'she ' || source, 1 FROM pick
UNION ALL SELECT doc_id, source || ' on the floor', 0 FROM pick UNION ALL SELECT doc_id, source || ' in the cup', 0 FROM pick""")
def _(t):
    """Four short-context rows per sampled training row (2,000 sampled, as published)."""
    parts = S.within_entity_split(t.documents.select("doc_id", "source"), "source", "doc_id")
    return S.augment(parts.where(F.col("split") == "train"), "source", "doc_id")


@query("z02_detection_dataset", f"""WITH h AS (SELECT doc_id, source, text, quality AS y, md5(text) AS k FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
g AS (SELECT k, row_number() OVER (ORDER BY {md5_of('k')}, k) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT k FROM h)),
s AS (SELECT h.*, CASE WHEN rn <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM h JOIN g USING (k)),
pick AS (SELECT source FROM s WHERE split = 'train' ORDER BY {md5_of('doc_id')} LIMIT 2000),
aug AS (SELECT source AS text, 1 AS y FROM pick UNION ALL SELECT 'she ' || source, 1 FROM pick UNION ALL SELECT source || ' on the floor', 0 FROM pick UNION ALL SELECT source || ' in the cup', 0 FROM pick)
SELECT 'train' AS part, text, y FROM s WHERE split = 'train' UNION ALL SELECT 'train', text, y FROM aug UNION ALL SELECT 'test', text, y FROM s WHERE split = 'test'""")
def _(t):
    """Filter, label, group split by text, augmented train."""
    from phrasebench.plans.corpus import detection_dataset
    rows = t.documents.select("doc_id", "source", "text").join(t.labels.select("doc_id", "quality"), "doc_id")
    rows = rows.withColumn("pair_id", F.md5("text"))
    parts = detection_dataset(rows, "text", "quality", {0: 0, 1: 1}, "pair_id", "source", "doc_id")
    return parts["train"].select(F.lit("train").alias("part"), "text", "y").unionByName(
        parts["test"].select(F.lit("test").alias("part"), "text", "y"))


@query("multiview_bank", """SELECT DISTINCT trim(text) AS bank_text, role AS source_type, conv_id::VARCHAR AS entity FROM conversations WHERE role IN ('user', 'assistant', 'system') AND trim(text) <> ''""")
def _(t):
    """One bank row per non-empty view of a turn, distinct."""
    views = {r: r for r in ("user", "assistant", "system")}
    wide = t.conversations.select(F.col("conv_id").cast("string").alias("conv"), *[
        F.when(F.col("role") == r, F.col("text")).alias(r) for r in views])
    return B.multiview_bank(wide, "conv", views)


@query("positive_pairs", f"""WITH p AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY {md5_of("conv_id || '-' || turn")}, conv_id || '-' || turn) - 1 AS place,
 count(*) OVER (PARTITION BY conv_id) AS m FROM conversations WHERE role = 'assistant'),
q0 AS (SELECT c.conv_id, c.conv_id || '-' || c.turn AS query_id, c.text, m, ('0x' || left({md5_of("c.conv_id || '-' || c.turn || '|0'")}, 8))::BIGINT % m AS p0,
 CASE WHEN m > 1 THEN ('0x' || left({md5_of("c.conv_id || '-' || c.turn || '|1'")}, 8))::BIGINT % (m - 1) END AS r1
 FROM conversations c JOIN (SELECT conv_id, max(m) AS m FROM p GROUP BY 1) USING (conv_id) WHERE c.role = 'user'),
q AS (SELECT conv_id, query_id, text, 0 AS draw, p0 AS place FROM q0 UNION ALL SELECT conv_id, query_id, text, 1, CASE WHEN p0 <= r1 THEN r1 + 1 ELSE r1 END FROM q0 WHERE m > 1)
SELECT q.query_id, q.draw, p.conv_id || '-' || p.turn AS positive_id, 'query: ' || q.text AS query, 'passage: ' || p.text AS positive
FROM q JOIN p ON p.conv_id = q.conv_id AND p.place = q.place""")
def _(t):
    """Up to two positives of its conversation for every user turn, with role prefixes."""
    rows = t.conversations.withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    users, bank = rows.where(F.col("role") == "user"), rows.where(F.col("role") == "assistant")
    pairs = S.sampled_positives(users, "id", "conv_id", "text", bank, "id", "conv_id", "text", n=2)
    return pairs.select("query_id", F.col("draw").cast("int").alias("draw"), "positive_id", "query", "positive")


@query("m07_pair_split", f"""WITH p AS (SELECT conv_id || '-' || turn AS id, row_number() OVER (ORDER BY {md5_of("conv_id || '-' || turn")}) AS rn, count(*) OVER () AS n FROM conversations)
SELECT id, CASE WHEN rn <= ceil(0.1::DOUBLE * n) THEN 'val' ELSE 'train' END AS split FROM p""")
def _(t):
    """M07"""
    rows = t.conversations.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"))
    return S.pair_split(rows, "id")


# ---- banks ---------------------------------------------------------------------------------------

@query("a10_first_nonempty", """SELECT conv_id, coalesce((list(trim(text) ORDER BY turn) FILTER (role = 'system' AND trim(text) <> ''))[1], '') AS system_text FROM conversations GROUP BY 1""")
def _(t):
    """First non-empty system text of each conversation, '' without one."""
    rows = t.conversations.withColumn("s", F.when(F.col("role") == "system", F.col("text")))
    return rows.groupBy("conv_id").agg(B.first_nonempty("s", "turn").alias("system_text"))


@query("a11_first_three", "SELECT source, array_to_string((list(text ORDER BY doc_id))[1:3], ' ') AS usage FROM documents GROUP BY 1")
def _(t):
    """First three texts per entity joined."""
    return B.first_texts(t.documents, "source", "text", "doc_id")


@query("a12_texts_by_entity", f"SELECT source, row_number() OVER (PARTITION BY source ORDER BY {md5_of('doc_id')}, doc_id) AS place, count(*) OVER (PARTITION BY source) AS n_texts, doc_id FROM documents")
def _(t):
    """Entity → texts as long rows, places in hash order."""
    return B.texts_by_entity(t.documents, "source", "doc_id", "text").drop("text")


BANK = r"""heads AS (SELECT source, coalesce((list(trim(lang) ORDER BY doc_id) FILTER (trim(lang) <> ''))[1], '') AS lang,
 coalesce((list(quality::VARCHAR ORDER BY doc_id) FILTER (quality IS NOT NULL))[1], '') AS quality,
 array_to_string((list(text ORDER BY doc_id))[1:3], ' ') AS usage FROM ex GROUP BY 1)"""


@query("entity_bank", f"WITH {EXAMPLES}, {BANK} SELECT * FROM heads")
def _(t):
    """A13, A10, A11"""
    ex = t.examples.withColumn("quality", F.col("quality").cast("string"))
    return B.entity_bank(ex, "source", ["lang", "quality"], "text", "doc_id")


@query("z05_retrieval_bank", rf"""WITH g AS (SELECT source, row_number() OVER (ORDER BY {md5_of('source')}, source) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
ex AS (SELECT d.doc_id, d.source, d.lang, regexp_replace(regexp_replace(d.text, '\b(literal|idiomatic)\b', '', 'g'), '^\s+|\s+$', '', 'g') AS text, l.quality
 FROM documents d LEFT JOIN labels l USING (doc_id) JOIN g USING (source) WHERE rn <= floor(0.8::DOUBLE * n)), {BANK}
SELECT source, row_number() OVER (ORDER BY source) - 1 AS idx, trim(regexp_replace('idiom: ' || source || '. idiom: ' || source || '. meaning: ' || lang || '. paraphrase: ' || quality
 || '. explanation: . usage: ' || trim(usage), '\s+', ' ', 'g')) AS bank_text FROM heads""")
def _(t):
    """Training entities' bank with its index."""
    from phrasebench.plans.corpus import entity_retrieval_set
    ex = t.examples.withColumn("quality", F.col("quality").cast("string"))
    parts = entity_retrieval_set(ex, "source", "text", ["lang", "quality"], "doc_id")
    return parts["bank"].select("source", "idx", "bank_text")


@query("w14_entity_index", "SELECT source AS entity, row_number() OVER (ORDER BY source) - 1 AS idx FROM (SELECT DISTINCT source FROM documents)")
def _(t):
    """W14"""
    return B.entity_index(t.documents, "source").withColumnRenamed("source", "entity")


@query("j03_index_lookup", """WITH i AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS idx FROM (SELECT DISTINCT source FROM documents WHERE lang = 'en'))
SELECT d.doc_id, i.idx FROM documents d LEFT JOIN i USING (source)""")
def _(t):
    """Entity → number, null where the bank lacks the entity."""
    index = B.entity_index(t.documents.where(F.col("lang") == "en"), "source")
    return B.with_index(t.documents.select("doc_id", "source"), index, "source").select("doc_id", "idx")


@query("j03_null_targets", "SELECT count(*) AS n, count_if(source NOT IN (SELECT source FROM documents WHERE lang = 'fr')) AS null_targets FROM documents")
def _(t):
    """How many rows have no target."""
    index = B.entity_index(t.documents.where(F.col("lang") == "fr"), "source")
    rows = B.with_index(t.documents.select("source"), index, "source")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("idx").isNull()).alias("null_targets"))


@query("j04_index_names", """WITH i AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS idx FROM (SELECT DISTINCT source FROM documents))
SELECT e.vec_id, coalesce(i.source, 'UNKNOWN') AS name FROM embeddings e LEFT JOIN i ON i.idx = e.label * 3""")
def _(t):
    """Number → entity, UNKNOWN outside the index."""
    index = B.entity_index(t.documents, "source")
    rows = t.embeddings.select("vec_id", (F.col("label") * 3).cast("long").alias("idx"))
    return B.index_names(rows, index, "source").select("vec_id", F.col("source").alias("name"))


@query("w15_first_rows", "SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def _(t):
    """W15"""
    return B.first_rows(t.documents.select("doc_id", "source", "lang"), "source", "doc_id")


@query("typed_bank", """WITH e AS (SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS host, html FROM pages),
c AS (SELECT page_id, host FROM e QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) = 1)
SELECT page_id, host, host AS input_text, 'canonical' AS input_type FROM c
UNION ALL SELECT page_id, host, html, 'example' FROM e WHERE contains(lower(html), lower(host))""")
def _(t):
    """Canonical rows and example rows that name their entity."""
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    rows = t.pages.select("page_id", host.alias("host"), "html")
    return B.typed_bank(rows, "host", "html", "page_id", ["html"]).select("page_id", "host", "input_text", "input_type")


@query("z14_meaning_bank", f"""WITH {EXAMPLES}, u AS (SELECT doc_id, source, text FROM ex WHERE quality = 1 AND lang IN ('en', 'fr')),
c AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1)
SELECT doc_id, source, source AS input_text, 'canonical' AS input_type FROM c
UNION ALL SELECT doc_id, source, text, 'example' FROM u WHERE contains(lower(text), lower(source))""")
def _(t):
    """Rows that pass the funnel, as a two-type bank."""
    from phrasebench.plans.corpus import meaning_bank
    stages = [("good", F.col("quality") == 1), ("known_lang", F.col("lang").isin("en", "fr"))]
    bank = meaning_bank(t.examples, "source", "text", "doc_id", ["text"], stages)["bank"]
    return bank.select("doc_id", "source", "input_text", "input_type")


@query("z10_cross_lingual_set", f"""WITH c AS (SELECT conv_id::VARCHAR AS entity, conv_id || '-' || turn AS id, role, trim(text) AS text FROM conversations WHERE role <> 'system' AND trim(text) <> ''),
s AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {md5_of('id')}, id) AS rn, count(*) OVER (PARTITION BY entity) AS n FROM c)
SELECT DISTINCT text AS bank_text, role AS source_type, entity FROM s WHERE NOT (n > 1 AND rn <= ceil(0.2::DOUBLE * n))""")
def _(t):
    """Filter, split inside entities, multi-view bank of the training rows."""
    from phrasebench.plans.corpus import cross_lingual_set
    rows = t.conversations.select(
        F.col("conv_id").cast("string").alias("entity"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        (F.col("role") != "system").alias("keep"), "text",
        F.when(F.col("role") == "user", F.col("text")).alias("user"), F.when(F.col("role") == "assistant", F.col("text")).alias("assistant"))
    return cross_lingual_set(rows, "entity", "id", {"user": "user", "assistant": "assistant"}, "keep", ["text"])["bank"]


@query("bank_summary", "SELECT count(*) AS n_rows, count(DISTINCT source) AS n_entities FROM documents")
def _(t):
    """Bank sanity figures."""
    return B.bank_summary(t.documents, "source")
