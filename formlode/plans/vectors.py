"""Queries on vectors and their evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from formlode.operators import evaluation as ev
from formlode.operators import index as ix
from formlode.operators import retrieval as re
from formlode.shared import scratch, written

from .adapters import table
from .core import M, W, corrected, finals, A
from .registry import a4, query, r4, rat


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("vector_id"), F.concat(F.lit("label_"), F.col("label")).alias("field_name"), "embedding")


def corpus(spark, sf):
    return vectors(spark, sf)


def asked(spark, sf):
    return vectors(spark, sf).filter("vector_id % 100 = 0").withColumnRenamed("vector_id", "query_id")


_TOP = """WITH v AS (SELECT vec_id, 'label_' || label AS field_name, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, q.field_name AS truth, c.vec_id AS vector_id, c.field_name, floor(list_cosine_similarity(q.e, c.e) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE AS similarity
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
  t AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vector_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5) """


def candidates(spark, sf):
    return re.cosine_topk(asked(spark, sf), corpus(spark, sf), 5)


@query("cosine_topk", _TOP + "SELECT query_id, rank, vector_id, field_name, similarity FROM t")
def cosine_topk(spark, sf):
    return candidates(spark, sf)


_DEC = ", d AS (SELECT query_id, max(similarity) FILTER (rank = 1) AS s1, max(similarity) FILTER (rank = 2) AS s2, max(field_name) FILTER (rank = 1) AS n1 FROM t GROUP BY query_id) "


@query("match_decision", _TOP + _DEC + "SELECT query_id, s1 >= 0.38::DOUBLE AS matched, CASE WHEN s1 >= 0.38::DOUBLE THEN n1 END AS name, CASE WHEN s1 < 0.38::DOUBLE THEN n1 END AS best_candidate, s1 AS confidence, coalesce(round(s1 - s2, 6), 0) AS margin FROM d")
def match_decision(spark, sf):
    return re.match_decision(asked(spark, sf), candidates(spark, sf), 0.38)


@query("self_retrieval", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT q.vec_id, max(floor(list_cosine_similarity(q.e, c.e) * 1000000::DOUBLE + 0.5::DOUBLE)) FILTER (c.vec_id = q.vec_id) AS own, max(floor(list_cosine_similarity(q.e, c.e) * 1000000::DOUBLE + 0.5::DOUBLE)) FILTER (c.vec_id < q.vec_id) AS before, max(floor(list_cosine_similarity(q.e, c.e) * 1000000::DOUBLE + 0.5::DOUBLE)) FILTER (c.vec_id > q.vec_id) AS after FROM v q, v c WHERE q.vec_id % 100 = 0 GROUP BY ALL) SELECT vec_id AS vector_id, own >= 990000 AND own > coalesce(before, -1e9) AND own >= coalesce(after, -1e9) AS found FROM s")
def self_retrieval(spark, sf):
    return re.self_retrieval(vectors(spark, sf).filter("vector_id % 100 = 0"), vectors(spark, sf))


@query("normalise_vectors", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v) SELECT vec_id AS vector_id, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS place, round(unnest(e) / norm, 8) AS value FROM n")
def normalise_vectors(spark, sf):
    return vectors(spark, sf).select("vector_id", F.posexplode(re.normalise(F.col("embedding"))).alias("place", "value"))


@query("vec_source_check", "SELECT missing, count(*) AS n FROM (SELECT CASE WHEN vec_id % 11 = 0 THEN 'vector_id' WHEN vec_id % 13 = 0 THEN 'field_name' WHEN vec_id % 17 = 0 THEN 'context' END AS missing FROM embeddings) GROUP BY ALL")
def vec_source_check(spark, sf):
    fields = F.when(F.col("vector_id") % 11 != 0, F.col("vector_id")).alias("vector_id"), F.when(F.col("vector_id") % 13 != 0, F.col("field_name")).alias("field_name"), F.when(F.col("vector_id") % 17 == 0, " ").otherwise("ctx").alias("context")
    one = F.to_json(F.struct(*fields))
    text = F.when(F.col("vector_id") % 2 == 0, F.concat(F.lit('{"vectors":['), one, F.lit("]}"))).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    loaded = re.vector_source(vectors(spark, sf).select(text.alias("content")), "content", "vector_id long, field_name string, context string")
    return re.source_check(loaded, ("vector_id", "field_name", "context")).groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


@query("vector_upsert", """WITH r AS (SELECT vec_id, 'label_' || label AS f, vec_id % 5 AS u FROM embeddings WHERE vec_id % 3 <> 0), s AS (SELECT vec_id, 'new_' || label AS f FROM embeddings WHERE vec_id % 2 = 0)
    SELECT coalesce(r.vec_id, s.vec_id) AS vector_id, coalesce(s.f, r.f) AS field_name, coalesce(u, 0) AS usage_count, r.vec_id IS NULL AS added FROM r FULL JOIN s ON r.vec_id = s.vec_id""")
def vector_upsert(spark, sf):
    rows = vectors(spark, sf).drop("embedding")
    runtime = rows.filter("vector_id % 3 <> 0").withColumn("usage_count", F.col("vector_id") % 5)
    source = rows.filter("vector_id % 2 = 0").withColumn("field_name", F.regexp_replace("field_name", "label_", "new_"))
    return re.vector_upsert(runtime, source, ["field_name"], {"usage_count": 0})


@query("ann_topk")
def ann_topk(spark, sf):
    return re.ann_topk(asked(spark, sf), corpus(spark, sf))


def ivf_found(spark, sf):
    index = ix.build_index(corpus(spark, sf), scratch(spark, "index"))
    return ix.index_topk(index, asked(spark, sf), 5, ix.probes_for(index, 0.97))


@query("ivf_topk")
def ivf_topk(spark, sf):
    return ivf_found(spark, sf)


@query("ivf_recall", _TOP + "SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, TRUE AS enough FROM t")
def ivf_recall(spark, sf):
    exact = candidates(spark, sf).select("query_id", "vector_id")
    hits = exact.join(ivf_found(spark, sf).select("query_id", "vector_id", F.lit(1).alias("hit")), ["query_id", "vector_id"], "left")
    sums = hits.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found"))
    return sums.select("queries", "neighbours", (F.col("found") >= 0.9 * F.col("neighbours")).alias("enough"))


@query("embed_text")
def embed_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(None).cast("array<double>").alias("embedding"))
    return re.embed_missing(docs, "text").select("doc_id", "embedding")


@query("reembed")
def reembed(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("vector_id"), F.col("p_name").alias("text"), F.col("p_type").alias("corrected_to"))
    return re.reembed_corrected(rows.select("vector_id", "text"), rows.filter("vector_id % 3 = 0").select("vector_id", "corrected_to"))


@query("udf_embed")
def udf_embed(spark, sf):
    name = "embed_" + uuid.uuid4().hex[:8]  # sessions are shared
    spark.udf.register(name, re.embedder())
    return spark.sql(f"SELECT p_partkey, {name}(p_name) AS embedding FROM {{part}}", part=table(spark, sf, "part"))


def truth(spark, sf):
    return asked(spark, sf).select("query_id", "field_name")


@query("eval_exact", _TOP + f", n AS (SELECT count(*) AS total, count(*) FILTER (truth = field_name) AS correct FROM t WHERE rank = 1) SELECT *, {rat('correct', 'total')} AS accuracy FROM n")
def eval_exact(spark, sf):
    best = candidates(spark, sf).filter("rank = 1").select("query_id", F.col("field_name").alias("name"))
    return ev.accuracy(truth(spark, sf).join(best, "query_id"), F.col("name") == F.col("field_name"))


@query("eval_topk", _TOP + f", h AS (SELECT query_id, max(CASE WHEN rank <= 3 AND truth = field_name THEN 1 ELSE 0 END) AS hit FROM t GROUP BY ALL), n AS (SELECT count(*) AS total, CAST(sum(hit) AS BIGINT) AS correct FROM h) SELECT *, {rat('correct', 'total')} AS accuracy FROM n")
def eval_topk(spark, sf):
    return ev.top_k_accuracy(candidates(spark, sf), truth(spark, sf), 3)


@query("eval_mrr", _TOP + f", h AS (SELECT query_id, coalesce(1.0::DOUBLE / min(rank) FILTER (truth = field_name), 0.0::DOUBLE) AS r FROM t GROUP BY ALL) SELECT count(*) AS queries, {a4('r')} AS mrr FROM h")
def eval_mrr(spark, sf):
    return ev.mean_reciprocal_rank(candidates(spark, sf), truth(spark, sf))


def _prf(p: str, t: str) -> str:
    return f", n AS (SELECT (SELECT count(*) FROM {p}) AS predicted, (SELECT count(*) FROM {t}) AS relevant, (SELECT count(*) FROM (SELECT * FROM {p} INTERSECT SELECT * FROM {t})) AS hits) SELECT *, {rat('hits', 'predicted')} AS precision, {rat('hits', 'relevant')} AS recall, {rat('2 * hits', 'predicted + relevant')} AS f1 FROM n"


@query("eval_retrieval", _TOP + ", p AS (SELECT DISTINCT query_id, vector_id FROM t), r AS (SELECT q.vec_id AS query_id, c.vec_id AS vector_id FROM v q JOIN v c USING (field_name) WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)" + _prf("p", "r"))
def eval_retrieval(spark, sf):
    # The search is asked twice below: its rows, five a query, are stored once.
    found = written(candidates(spark, sf), "candidates")
    return ev.retrieval_prf(found, truth(spark, sf), corpus(spark, sf).select("vector_id", "field_name"))


@query("eval_prf", "WITH p AS (SELECT doc_id FROM documents WHERE n_chars > 500), t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)" + _prf("p", "t"))
def eval_prf(spark, sf):
    return ev.prf(table(spark, sf, "documents").filter("n_chars > 500"), table(spark, sf, "labels").filter("quality = 1"), "doc_id")


@query("eval_fuzzy", f"WITH x AS (SELECT list_distinct(string_split(replace(lower(p_name), ' ', '_'), '_')) AS a, list_distinct(string_split(replace(lower(p_type), ' ', '_'), '_')) AS b FROM part), n AS (SELECT count(*) AS total, count(*) FILTER (len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE >= 0.2::DOUBLE) AS correct FROM x) SELECT *, {rat('correct', 'total')} AS accuracy FROM n")
def eval_fuzzy(spark, sf):
    names = table(spark, sf, "part").select(F.translate(F.lower("p_name"), " ", "_").alias("a"), F.translate(F.lower("p_type"), " ", "_").alias("b"))
    return ev.fuzzy_accuracy(names, "a", "b", 0.2)


@query("eval_confidence", W + f"SELECT count(selected_conf) AS n, {a4('selected_conf')} AS avg_confidence FROM fin")
def eval_confidence(spark, sf):
    return ev.mean_confidence(finals(spark, sf), "selected_conf")


_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9_ \\t\\n\\r]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"


@query("eval_fill", f"WITH n AS (SELECT count(*) AS total, count(*) FILTER ({_NORM.format('p_name')} = {_NORM.format('''CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) || '  !' ELSE p_type END''')}) AS correct FROM part) SELECT *, {rat('correct', 'total')} AS accuracy FROM n")
def eval_fill(spark, sf):
    other = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_name"), F.lit("  !"))).otherwise(F.col("p_type"))
    return ev.fill_accuracy(table(spark, sf, "part").select("p_name", other.alias("filled")), "p_name", "filled")


@query("eval_improvement", A + f"SELECT count(*) AS submissions, {a4('1.0::DOUBLE - accuracy_ensemble')} AS avg_drop FROM acc WHERE errors_ensemble > 0")
def eval_improvement(spark, sf):
    from formlode.functions.rounding import mean

    after = corrected(spark, sf).filter("errors_ensemble > 0")
    return after.agg(F.count(F.lit(1)).alias("submissions"), mean(1.0 - F.col("accuracy_ensemble")).alias("avg_drop"))


@query("eval_by_format", f"WITH f AS (SELECT source AS format, count(*) AS total, count(*) FILTER (n_chars > 1000) AS correct FROM documents GROUP BY ALL) SELECT *, {rat('correct', 'total')} AS accuracy, {rat('(SELECT count(*) FROM f)', '10')} AS format_coverage FROM f")
def eval_by_format(spark, sf):
    return ev.by_format(table(spark, sf, "documents"), "source", F.col("n_chars") > 1000)


@query("eval_sessions", f"WITH s AS (SELECT conv_id, count(*) AS turns, bool_or(turn >= 3) AS done FROM conversations GROUP BY ALL), n AS (SELECT count(*) AS sessions, count(*) FILTER (done) AS completed, coalesce({r4('avg(turns) FILTER (done)')}, 0) AS avg_turns FROM s) SELECT *, {rat('completed', 'sessions')} AS completion_rate FROM n")
def eval_sessions(spark, sf):
    return ev.sessions(table(spark, sf, "conversations").withColumnRenamed("conv_id", "session_id"), F.col("turn") >= 3)


#: Price per million tokens, in and out.
PRICES = [("gpt-4o-mini", 0.15, 0.60), ("gpt-4o", 2.50, 10.00), ("claude-3-5-sonnet", 3.00, 15.00), ("claude-3-5-haiku", 0.80, 4.00)]


@query("eval_cost", f"WITH p(model, pi, po) AS (VALUES {', '.join(f'''('{m}', {i}::DOUBLE, {o}::DOUBLE)''' for m, i, o in PRICES)}), c AS (SELECT CASE event_id % 5 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'claude-3-5-sonnet' WHEN 3 THEN 'claude-3-5-haiku' ELSE 'local' END AS model, user_id * 10 AS ti, event_id % 700 AS o FROM events), s AS (SELECT model, count(*) AS calls, CAST(sum(ti) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out FROM c GROUP BY ALL) SELECT model, calls, tokens_in, tokens_out, {r4('(tokens_in * coalesce(pi, 0.0::DOUBLE) + tokens_out * coalesce(po, 0.0::DOUBLE)) / 1000000::DOUBLE', 6)} AS cost_usd FROM s LEFT JOIN p USING (model)")
def eval_cost(spark, sf):
    names = F.element_at(F.array(*[F.lit(m) for m, _, _ in PRICES], F.lit("local")), (F.col("event_id") % 5 + 1).cast("int"))
    calls = table(spark, sf, "events").select(names.alias("model"), (F.col("user_id") * 10).alias("tokens_in"), (F.col("event_id") % 700).alias("tokens_out"))
    return ev.cost(calls, spark.createDataFrame(PRICES, "model string, price_in double, price_out double"))
