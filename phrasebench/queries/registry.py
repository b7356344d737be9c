"""Query registry, the given tables, and SQL pieces shared by the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasebench.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one scale folder, read on first use."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.root, name)

    @property
    def examples(self) -> DataFrame:
        """Documents with their labels, null where unlabelled."""
        return self.documents.join(self.labels, "doc_id", "left")

    @property
    def scored(self) -> DataFrame:
        """Labelled documents with a deterministic score, prediction and correctness."""
        score = (F.col("n_chars") % 1000) / F.lit(1000.0)
        rows = self.documents.select("doc_id", "source", score.alias("score")).join(self.labels, "doc_id")
        pred = (F.col("score") >= 0.5).cast("int")
        return rows.select("doc_id", "source", "score", pred.alias("pred"), F.col("quality").alias("gold"),
                           (pred == F.col("quality")).cast("int").alias("correct"))

    @property
    def scored_orders(self) -> DataFrame:
        """Orders as scored rows: many rows for threshold and calibration tables."""
        score = (F.col("o_totalprice") % 1000) / F.lit(1000.0)
        rows = self.orders.select("o_orderkey", score.alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("gold"))
        pred = (F.col("score") >= 0.5).cast("int")
        return rows.withColumns({"pred": pred, "correct": (pred == F.col("gold")).cast("int")})


def six_places(sql: str) -> str:
    """Write ``round(x, 6)`` in the check SQL as scale, round half to even, unscale, as the queries do.

    ``round`` takes halves away from zero; fused scores of six-place inputs do hit exact halves.
    """
    start = 0
    while (at := sql.find("round(", start)) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 6:end - 1]
        if inner.endswith(", 6"):
            made = f"(round_even(({inner[:-3]}) * 1e6, 0) / 1e6)"
            sql, start = sql[:at] + made + sql[end:], at + len("(round_even((")
        else:
            start = at + 6
    return sql


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = six_places(sql)
        return fn
    return register


# ---- SQL pieces for the checks -------------------------------------------------------------------

def md5_of(key: str, seed: int = 42) -> str:
    return f"md5('{seed}|' || ({key})::VARCHAR)"


def tokens_of(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> '')"


def stem_of(w: str) -> str:
    return (f"CASE WHEN length({w}) > 5 AND ends_with({w}, 'ing') THEN left({w}, length({w}) - 3) "
            f"WHEN length({w}) > 4 AND ends_with({w}, 'ed') THEN left({w}, length({w}) - 2) "
            f"WHEN length({w}) > 4 AND ends_with({w}, 's') THEN left({w}, length({w}) - 1) ELSE {w} END")


def norm_of(x: str) -> str:
    letters = f"list_transform({tokens_of(x)}, lambda w: regexp_replace(w, '[^a-zA-Z]', '', 'g'))"
    return f"list_filter(list_transform({letters}, lambda w: {stem_of('w')}), lambda w: w <> '')"


def half_even(x: str, places: int) -> str:
    return f"round_even(({x}) * 1e{places}, 0) / 1e{places}"


EXAMPLES = "ex AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"

SCORED = """sc0 AS (SELECT doc_id, source, (n_chars % 1000) / 1000.0::DOUBLE AS score, quality AS gold
  FROM documents JOIN labels USING (doc_id)),
scored AS (SELECT doc_id, source, score, (score >= 0.5)::INT AS pred, gold,
  ((score >= 0.5)::INT = gold)::INT AS correct FROM sc0)"""

SCORED_ORDERS = """so0 AS (SELECT o_orderkey, (o_totalprice % 1000) / 1000.0::DOUBLE AS score,
  (o_orderstatus = 'F')::INT AS gold FROM orders),
scored_orders AS (SELECT o_orderkey, score, gold, (score >= 0.5)::INT AS pred,
  ((score >= 0.5)::INT = gold)::INT AS correct FROM so0)"""

VECTORS = f"""vs0 AS (SELECT vec_id, label, embedding::DOUBLE[] AS v,
  row_number() OVER (PARTITION BY label ORDER BY {md5_of('vec_id')}, vec_id) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM embeddings),
vs AS (SELECT vec_id, label, v, CASE WHEN n > 1 AND rn <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split
  FROM vs0),
vpairs AS (SELECT q.vec_id AS query_id, b.vec_id AS bank_id, q.label AS gold, b.label AS entity,
  round(list_dot_product(q.v, b.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score
  FROM vs q, vs b WHERE q.split = 'test' AND b.split = 'train')"""


def ranked_vectors(k: int = 5, fetch: int = 25) -> str:
    return VECTORS + f""",
vtop AS (SELECT * FROM vpairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bank_id) <= {fetch}),
vbest AS (SELECT * FROM vtop QUALIFY row_number() OVER (PARTITION BY query_id, entity ORDER BY score DESC, bank_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bank_id) AS rank
  FROM vbest QUALIFY rank <= {k}),
granks AS (SELECT query_id, min(rank) FILTER (entity = gold) AS gold_rank FROM ranked GROUP BY query_id)"""


def lexical_sql(queries: str, qid: str, qtext: str, bank: str, did: str, dtext: str) -> str:
    return f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM
  (SELECT {did} AS doc_id, unnest({tokens_of(dtext)}) AS term FROM {bank}) GROUP BY ALL),
dl AS (SELECT {did} AS doc_id, len({tokens_of(dtext)}) AS dl FROM {bank}),
st AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term),
nn AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM dl),
idf0 AS (SELECT term, df, cf, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM st, nn),
idf AS (SELECT term, df, cf, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM idf0) ELSE raw END AS idf FROM idf0),
qt AS (SELECT query_id, term, count(*) AS qf FROM
  (SELECT {qid} AS query_id, unnest({tokens_of(qtext)}) AS term FROM {queries}) GROUP BY ALL),
bm0 AS (SELECT query_id, doc_id,
  round(sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS lexical
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), nn GROUP BY ALL),
bm AS (SELECT query_id, doc_id, coalesce(lexical, 0::DOUBLE) AS lexical FROM (
  SELECT a.query_id, b.doc_id FROM (SELECT {qid} AS query_id FROM {queries}) a CROSS JOIN (SELECT {did} AS doc_id FROM {bank}) b)
  LEFT JOIN bm0 USING (query_id, doc_id))"""


def hybrid_sql(*args: str) -> str:
    return lexical_sql(*args) + """,
vocab AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS vi FROM st, nn),
dn AS (SELECT doc_id, sqrt(sum((tf * vi) * (tf * vi))) AS dn FROM tf JOIN vocab USING (term) GROUP BY 1),
qn AS (SELECT query_id, sqrt(sum((qf * vi) * (qf * vi))) AS qn FROM qt JOIN vocab USING (term) GROUP BY 1),
cs AS (SELECT query_id, doc_id, sum(qf * vi * tf * vi) AS d FROM qt JOIN tf USING (term) JOIN vocab USING (term) GROUP BY ALL),
sp AS (SELECT bm.query_id, bm.doc_id, round(coalesce(d / (qn * dn), 0), 6) AS dense, lexical
  FROM bm LEFT JOIN cs USING (query_id, doc_id) LEFT JOIN dn USING (doc_id) LEFT JOIN qn USING (query_id))"""


BENCH_ON_DOCS = ("benchmark", "item_id", "text", "documents", "doc_id", "text")
DOCS_ON_BENCH = ("documents", "doc_id", "text", "benchmark", "item_id", "text")

POOL = f"""WITH {hybrid_sql(*DOCS_ON_BENCH)},
plist AS (SELECT query_id, doc_id, dense, lexical FROM sp
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) <= 50
  UNION ALL SELECT query_id, doc_id, 0, lexical FROM sp
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) <= 50),
pool AS (SELECT query_id, doc_id, max(dense) AS dense, max(lexical) AS lexical FROM plist GROUP BY ALL),
rng AS (SELECT query_id, min(dense) AS d0, max(dense) AS d1, min(lexical) AS l0, max(lexical) AS l1 FROM pool GROUP BY 1),
fused AS (SELECT query_id, doc_id, dense, lexical,
  0.8::DOUBLE * CASE WHEN d1 - d0 < 1e-12 THEN 0 ELSE (dense - d0) / (d1 - d0) END
  + (1 - 0.8::DOUBLE) * CASE WHEN l1 - l0 < 1e-12 THEN 0 ELSE (lexical - l0) / (l1 - l0) END AS hybrid
  FROM pool JOIN rng USING (query_id)),
qn2 AS (SELECT doc_id AS query_id, ' ' || array_to_string({norm_of('text')}, ' ') || ' ' AS qrun FROM documents),
pn2 AS (SELECT item_id AS doc_id, text AS entity, ' ' || array_to_string({norm_of('text')}, ' ') || ' ' AS prun FROM benchmark),
boosted AS (SELECT query_id, doc_id, entity, dense, lexical, hybrid,
  CASE WHEN contains(qrun, prun) THEN 0.20::DOUBLE ELSE 0 END AS phrase_boost
  FROM fused JOIN qn2 USING (query_id) JOIN pn2 USING (doc_id)),
final AS (SELECT *, round(hybrid + phrase_boost, 6) AS score FROM boosted),
fbest AS (SELECT * FROM final QUALIFY row_number() OVER (PARTITION BY query_id, entity ORDER BY score DESC, doc_id) = 1)"""
