"""One registered query per operator of this subpackage, and check SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasebench.llm import bpe, chat, mincut, mixing, ordermin, perplexity, pii, retpack, shallot, toxicity, turnrepair, vptree, warc
from phrasebench.session import cut_lineage, read_table, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# ---- 1: mixing sources to target weights ---------------------------------------------------------

ENTROPY_SHARE, MAX_REPETITION, BLOCK_TOKENS = 0.98, 4.0, 1 << 16

_MIX_SQL = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, coalesce('s' || source, 'n') AS sk,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM documents),
t AS (SELECT sk, sum(tokens)::BIGINT AS n FROM d GROUP BY sk HAVING sum(tokens) > 0),
a AS (SELECT sum(n)::BIGINT AS total, list(n / (SELECT sum(n) FROM t)::DOUBLE) AS ps FROM t),
eb(lo, hi) AS (SELECT -1::BIGINT, ((1 << 25) + 1)::BIGINT UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT lo, hi, mid, ln(list_sum(qs)) - list_sum(list_transform(qs, lambda q: q * ln(q))) / list_sum(qs)
      >= ln(len(ps)::DOUBLE) * {ENTROPY_SHARE}::DOUBLE AS ok FROM (
      SELECT lo, hi, (lo + hi) // 2 AS mid, ps, list_transform(ps, lambda p: pow(p, ((lo + hi) // 2) / (1 << 25)::DOUBLE)) AS qs
      FROM eb, a WHERE hi - lo > 1))),
rb(lo, hi) AS (SELECT -1::BIGINT, ((1 << 25) + 1)::BIGINT UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT lo, hi, mid, pow(list_min(ps), mid / (1 << 25)::DOUBLE - 1) / list_sum(qs) > {MAX_REPETITION}::DOUBLE AS ok FROM (
      SELECT lo, hi, (lo + hi) // 2 AS mid, ps, list_transform(ps, lambda p: pow(p, ((lo + hi) // 2) / (1 << 25)::DOUBLE)) AS qs
      FROM rb, a WHERE hi - lo > 1))),
e AS (SELECT greatest(CASE WHEN len(ps) > 1 THEN greatest((SELECT max(lo) FROM eb), 0) ELSE 1 << 25 END,
  least((SELECT max(lo) FROM rb) + 1, 1 << 25)) / (1 << 25)::DOUBLE AS x FROM a),
z AS (SELECT sum(pow(n / total::DOUBLE, x)) AS z FROM t, a, e),
w AS (SELECT sk, n, round(pow(n / total::DOUBLE, x) / z * total)::BIGINT AS target FROM t, a, e, z),
c AS (SELECT doc_id, source, sk, tokens, n, target, unnest(range(target // n + 1)) AS epoch FROM d JOIN w USING (sk)),
k AS (SELECT *, md5(concat_ws('|', '42', epoch::VARCHAR, coalesce(doc_id::VARCHAR, ''))) AS order_key FROM c),
o AS (SELECT *, sum(tokens) OVER (PARTITION BY sk, epoch ORDER BY order_key)::BIGINT AS e FROM k),
b AS (SELECT greatest(1, (sum(target)::BIGINT + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS}) AS blocks FROM w)
SELECT doc_id, source, tokens, epoch,
  least(floor((epoch * n + e - tokens)::DOUBLE / greatest(target, 1) * blocks)::BIGINT, blocks - 1) AS block, order_key
FROM o, b WHERE epoch < target // n OR e <= target % n"""


@_query("op1_temperature_mixing", _MIX_SQL)
def op1(spark: SparkSession, root: str) -> DataFrame:
    """The mixed order of all documents: one corpus's worth of tokens, at 98 % of the greatest source entropy."""
    docs, tokens = read_table(spark, root, "documents"), mixing.count_words(F.col("text"))
    sources = mixing.weights(docs, "source", tokens, ENTROPY_SHARE, MAX_REPETITION)
    return mixing.mix(docs, "doc_id", "source", tokens, sources, BLOCK_TOKENS)


# ---- 2: WARC -------------------------------------------------------------------------------------

_WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS h FROM p),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((('0x' || substr(hex || '00', 1 + (i * 5) // 4, 2))::INT >> (3 - (i * 5) % 4)) & 31), 1)), '') AS d FROM g)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = h THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> h THEN h END AS refers_to FROM b"""


@_query("op2_warc_chains", _WARC_SQL)
def op2(spark: SparkSession, root: str) -> DataFrame:
    """Every page written to archives, read back by boundary chains; sizes and digests of the full payloads."""
    path = scratch_path(spark, "warc")
    warc.write(read_table(spark, root, "pages"), path, "page_id", "url", "html", 0, compression="gzip")
    head = F.col("headers")
    records = cut_lineage(warc.read(spark, path).select(
        head[warc.KEY_HEADER].cast("long").alias("page_id"), head["WARC-Record-ID"].alias("id"), head["WARC-Refers-To"].alias("to"),
        head["WARC-Type"].alias("record_type"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        warc.payload_digest(F.col("payload")).alias("payload_digest")))
    held = records.where("record_type = 'response'").select(F.col("id").alias("to"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    again = records.where("record_type = 'revisit'").select("page_id", "record_type", "to").join(held, "to")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*names).union(again.select(*names))


# ---- 3: approximate nearest neighbours -----------------------------------------------------------

@_query("op3_vantage_points")
def op3(spark: SparkSession, root: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector, among all others."""
    rows = read_table(spark, root, "embeddings").select("vec_id", "embedding")
    trees = vptree.index(rows, "vec_id", "embedding")
    return vptree.nearest(trees, rows.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", 5)


# ---- 4: near-duplicates --------------------------------------------------------------------------

@_query("op4_order_minhash")
def op4(spark: SparkSession, root: str) -> DataFrame:
    """Near-duplicate class of every document, and whether it is the one that stays."""
    return ordermin.mark(read_table(spark, root, "documents"), "doc_id", "text")


# ---- 5: quality rules ----------------------------------------------------------------------------

@_query("op5_perplexity_bands")
def op5(spark: SparkSession, root: str) -> DataFrame:
    """Base rule and perplexity band of every document, under a model of all documents."""
    judged = perplexity.judge(read_table(spark, root, "documents"), "doc_id", "text", "lang")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "perplexity")


# ---- 6: HTML extraction --------------------------------------------------------------------------

@_query("op6_minimum_cut")
def op6(spark: SparkSession, root: str) -> DataFrame:
    """Main text of every page."""
    pages = mincut.extract(read_table(spark, root, "pages").select("page_id", "url", "html"), "html")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# ---- 7: byte-level BPE ---------------------------------------------------------------------------

def tokenizer() -> tuple[bytes, str]:
    """Ranks and pre-split pattern of the public vocabulary that the contract names."""
    import public_tokenizers
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


@_query("op7_byte_bpe")
def op7(spark: SparkSession, root: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded again."""
    ranks, pattern = tokenizer()
    ids = bpe.encode(read_table(spark, root, "documents").select("doc_id", "text"), "text", ranks, pattern)
    return bpe.digest(bpe.decode(ids.drop("text"), "ids", ranks, pattern), "doc_id")


# ---- 8: toxicity ---------------------------------------------------------------------------------

@_query("op8_compression_toxicity")
def op8(spark: SparkSession, root: str) -> DataFrame:
    """Toxicity score of every document; the fold with remainder 0 is never learned from."""
    docs = read_table(spark, root, "documents")
    model = toxicity.fit(toxicity.labelled_sample(docs, read_table(spark, root, "labels"), "doc_id", "text", "toxic"))
    return toxicity.score(docs, "doc_id", "text", model).select(
        "doc_id", (toxicity.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


# ---- 9: chat formatting --------------------------------------------------------------------------

_CHAT_SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, contains(text, '</s>') OR regexp_matches(text, '\\(?s:.)') OR regexp_matches(role, '\\(?s:.)')
  OR contains(role, '</s>') OR contains(role, '[/INST]') AS clash FROM c),
f AS (SELECT *, 20 + length(role) + length(text) + CASE WHEN clash THEN
  len(regexp_extract_all(role || chr(0) || text, '</?s>|\[/?INST\]|\\')) ELSE 0 END AS made FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(made)::BIGINT AS formatted_chars FROM f GROUP BY conv_id"""


@_query("op9_chat_round_trip", _CHAT_SQL)
def op9(spark: SparkSession, root: str) -> DataFrame:
    """All conversations, and one whose texts are made of control strings, formatted and read back."""
    rows = read_table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest(chat.format_conversations(rows.unionByName(odd)))


# ---- 10: PII -------------------------------------------------------------------------------------

#: Stands for the secret that a deployment passes in; surrogates cannot be traced back without it.
SURROGATE_KEY = "phrasebench"


@_query("op10_pii_surrogates")
def op10(spark: SparkSession, root: str) -> DataFrame:
    """Every document with its personal data replaced, and the kinds of what was replaced, in order."""
    safe = pii.protect(read_table(spark, root, "documents"), "doc_id", "text", SURROGATE_KEY)
    return safe.select("doc_id", "text", F.size("pii").cast("long").alias("n_entities"), F.col("pii")["kind"].alias("kinds"))


# ---- 11: centroid clustering ---------------------------------------------------------------------

CENTROIDS, ROUNDS = 40, 5

# a plain k-means: all distances in every round
_KMEANS_SQL = """WITH v AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), embedding) AS r, vec_id,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
x AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(e)::BIGINT AS x FROM v),
c0 AS MATERIALIZED (SELECT r - 1 AS c, i, x FROM x WHERE r <= {k}),
""".replace("{k}", str(CENTROIDS)) + "".join(f"""a{j} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT r, c, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{j} c USING (i) GROUP BY r, c) GROUP BY r),
c{j + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, p.x) AS x FROM c{j} p LEFT JOIN (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{j} USING (r) GROUP BY c, i) USING (c, i)),
""" for j in range(ROUNDS)) + f"""z AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT r, c, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{ROUNDS} c USING (i) GROUP BY r, c) GROUP BY r),
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM z JOIN v USING (r) JOIN h USING (c)"""


@_query("op11_shallot_kmeans", _KMEANS_SQL)
def op11(spark: SparkSession, root: str) -> DataFrame:
    """Clusters of all vectors after five rounds from 40 centroids, with exact distances and inertias."""
    made, _ = shallot.cluster(read_table(spark, root, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", CENTROIDS, ROUNDS)
    return made


# ---- 12: packing ---------------------------------------------------------------------------------

def word_vocabulary() -> str:
    """The public vocabulary that the contract names, as the library's JSON."""
    import public_tokenizers
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@_query("op12_retrieval_packing")
def op12(spark: SparkSession, root: str) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    pieces = retpack.pack(read_table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text", word_vocabulary())
    return pieces.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# ---- 13: conversation structure repair -----------------------------------------------------------

def _put(key: str, cost: str, letter: str) -> str:
    """SQL: a path's key (nine digits of cost, then its audit; '~' for none) with an edit added."""
    return f"CASE WHEN {key} = '~' THEN '~' ELSE lpad((substr({key}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({key}, 10) || '{letter}' END"


_OPEN_SQL = f"""SELECT *, least(a, {_put('u1', '2', 'I')}) AS a1 FROM (
  SELECT *, least(u, {_put('n', '2', 'I')}, {_put('s', '2', 'I')}, {_put('a', '2', 'I')}) AS u1 FROM"""

# a plain forward search over the rows: per state of the grammar the least (cost, audit) that leads there
_REPAIR_SQL = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(key)), lambda i: ascii(substr(key, i + 1, 1))::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS hit FROM k),
w AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
  CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
  regexp_extract(text, '(?s).*([^\x20\x09-\x0D])', 1) AS last, strpos('sua', substr(role, 1, 1)) AS place FROM w),
y AS (SELECT *, CASE WHEN role = '' OR place = 0 THEN 4 ELSE place END AS kind,
  CASE WHEN last = '' THEN 1 WHEN again > 1 THEN 2 WHEN last IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault FROM o),
p(conv_id, i, n, s, u, a) AS (SELECT conv_id, 0::BIGINT, '000000000', '~', '~', '~' FROM (SELECT DISTINCT conv_id FROM y)
  UNION ALL
  SELECT conv_id, i, {_put('n', '3', 'D')},
    least({_put('s', '3', 'D')}, CASE WHEN kind = 1 AND NOT gone THEN {_put('n', 'more', 'K')} ELSE '~' END),
    least({_put('u1', '3', 'D')}, CASE WHEN gone THEN '~' WHEN kind = 2 THEN {_put('f', 'more', 'K')} ELSE '~' END,
      CASE WHEN gone THEN '~' ELSE {_put('f', '2 + more', 'R')} END),
    least({_put('a1', '3', 'D')}, CASE WHEN gone THEN '~' WHEN kind = 3 THEN {_put('u1', 'more', 'K')} ELSE '~' END,
      CASE WHEN gone THEN '~' ELSE {_put('u1', '2 + more', 'R')} END)
  FROM (SELECT *, least(n, s, a1) AS f FROM ({_OPEN_SQL} (
    SELECT y.conv_id, y.i, p.n, p.s, p.u, p.a, kind, fault IN (1, 2) AS gone, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS more
    FROM p JOIN y ON y.conv_id IS NOT DISTINCT FROM p.conv_id AND y.i = p.i + 1))))),
e AS (SELECT conv_id, least(n, a1) AS path FROM ({_OPEN_SQL} (
  SELECT p.* FROM p JOIN (SELECT conv_id, max(i) AS m FROM y GROUP BY conv_id) x ON x.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = x.m)))),
l AS (SELECT conv_id, j, substr(path, 9 + j, 1) AS letter FROM (SELECT conv_id, path, unnest(range(1, length(path) - 8)) AS j FROM e)),
t AS (SELECT *, count(*) FILTER (letter <> 'I') OVER b AS i, count(*) FILTER (letter <> 'D') OVER b AS m FROM l
  WINDOW b AS (PARTITION BY conv_id ORDER BY j)),
g AS (SELECT t.*, y.role, y.text, max(CASE WHEN letter = 'K' AND m = 1 AND kind = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY t.conv_id) AS head
  FROM t LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM t.conv_id AND y.i = t.i AND t.letter <> 'I'),
z AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (m - head) % 2 = 1 THEN 'user' ELSE 'assistant' END
  || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha FROM g WHERE letter <> 'D' GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
  count(*) FILTER (fault = 1)::BIGINT AS blank, count(*) FILTER (fault = 2)::BIGINT AS duplicate, count(*) FILTER (fault = 3)::BIGINT AS truncated,
  count(*) FILTER (before IS NOT NULL AND (before, kind) NOT IN ((1, 2), (2, 3), (3, 2)))::BIGINT AS illegal
  FROM (SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM y) GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(substr(path, 1, 9)::BIGINT, 0) AS cost,
  coalesce(substr(path, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM d.conv_id"""


@_query("op13_run_length_repair", _REPAIR_SQL)
def op13(spark: SparkSession, root: str) -> DataFrame:
    """Every conversation with faults put in, the cheapest edits that repair it, and the digest of what they give."""
    rows = read_table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    return turnrepair.repair_all(rows, turnrepair.damage(rows))
