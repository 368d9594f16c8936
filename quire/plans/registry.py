"""Registered queries and their DuckDB oracles.

Each query takes ``(spark, sf_dir)`` and reads the driver's tables (through
the fixtures in :mod:`quire.sources.fixtures`). Doubles are rounded to 6
places in both the query and its oracle; every computed column is aliased
to the same name on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as TX
from quire.functions.hashing import hash_int_sql, hash_key_sql
from quire.operators import authors, losses
from quire.operators.similarity import author_pairs
from quire.plans import diversity, scoring
from quire.plans import pairs as P
from quire.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn

    return deco


def r6(c: str):
    """Round to 6 places; a rounded zero is +0.0 (never -0.0) in both engines."""
    r = F.round(F.col(c), 6)
    return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(c)


def r6sql(expr: str) -> str:
    return f"(CASE WHEN round({expr}, 6) = 0 THEN CAST(0 AS DOUBLE) ELSE round({expr}, 6) END)"


# --------------------------------------------------------------------------
# Step 1: scoring and evaluation
# --------------------------------------------------------------------------

SQL_SCORES = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, label, v FROM v WHERE vec_id % 10 = 0),
c AS (SELECT vec_id AS candidate_id, label, v FROM v WHERE vec_id % 10 <> 0),
s AS (
  SELECT q.query_id, c.candidate_id,
         CASE WHEN list_dot_product(q.v, q.v) > 0 AND list_dot_product(c.v, c.v) > 0
              THEN list_dot_product(q.v, c.v)
                   / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v)))
              ELSE 0.0 END AS score,
         CAST(q.label = c.label AS INTEGER) AS label
  FROM q CROSS JOIN c)
"""


def sql_metrics(scores_cte: str, keys: str) -> str:
    """CTEs ``pq`` (per query: keys, n_pos, n_neg, eer, ap) over ``scores_cte``
    with columns keys, score, label."""
    return f"""
g AS (SELECT {keys}, score, SUM(label) AS tp, SUM(1 - label) AS fp
      FROM {scores_cte} GROUP BY {keys}, score),
r AS (
  SELECT {keys}, score, tp, fp,
         SUM(tp) OVER (PARTITION BY {keys} ORDER BY score DESC
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
         SUM(fp) OVER (PARTITION BY {keys} ORDER BY score DESC
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps,
         ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY score DESC) - 1 AS k,
         LEAD(tp) OVER (PARTITION BY {keys} ORDER BY score DESC) AS ntp,
         LEAD(fp) OVER (PARTITION BY {keys} ORDER BY score DESC) AS nfp,
         COUNT(*) OVER (PARTITION BY {keys}) - 1 AS last_k,
         SUM(tp) OVER (PARTITION BY {keys}) AS n_pos,
         SUM(fp) OVER (PARTITION BY {keys}) AS n_neg
  FROM g),
pts AS (
  SELECT {keys}, k AS rnk,
         CASE WHEN n_neg > 0 THEN CAST(fps AS DOUBLE) / n_neg END AS fpr,
         CASE WHEN n_pos > 0 THEN CAST(1 AS DOUBLE) - CAST(tps AS DOUBLE) / n_pos END AS fnr
  FROM r WHERE k = 0 OR k = last_k OR ntp <> tp OR nfp <> fp
  UNION ALL
  SELECT DISTINCT {keys}, -1 AS rnk, CAST(0 AS DOUBLE) AS fpr, CAST(1 AS DOUBLE) AS fnr FROM r),
best AS (
  SELECT {keys}, (fpr + fnr) / 2 AS eer,
         ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY abs(fnr - fpr), rnk) AS pick
  FROM pts),
ap AS (
  SELECT {keys}, CAST(MAX(n_pos) AS BIGINT) AS n_pos, CAST(MAX(n_neg) AS BIGINT) AS n_neg,
         CASE WHEN MAX(n_pos) > 0
              THEN SUM(CAST(tp AS DOUBLE) / n_pos * (CAST(tps AS DOUBLE) / (tps + fps)))
              ELSE CAST(0 AS DOUBLE) END AS ap
  FROM r GROUP BY {keys}),
pq AS (
  SELECT ap.*, CASE WHEN ap.n_pos > 0 AND ap.n_neg > 0 THEN best.eer END AS eer
  FROM ap JOIN best USING ({keys}) WHERE best.pick = 1)
"""


def _scored(spark, sf):
    return scoring.scored_with_truth(fx.fx_queries(spark, sf), fx.fx_candidates(spark, sf))


@register(
    "score_query_candidates",
    f"WITH {SQL_SCORES} SELECT query_id, candidate_id, {r6sql('score')} AS score, label FROM s",
)
def q_score_query_candidates(spark, sf):
    return _scored(spark, sf).select("query_id", "candidate_id", r6("score"), "label")


@register(
    "rank_top_k",
    f"""WITH {SQL_SCORES},
    t AS (SELECT query_id, candidate_id, score,
                 ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank
          FROM s)
    SELECT query_id, candidate_id, {r6sql('score')} AS score, CAST(rank AS BIGINT) AS rank
    FROM t WHERE rank <= 10""",
)
def q_rank_top_k(spark, sf):
    s = scoring.score_query_candidates(fx.fx_queries(spark, sf), fx.fx_candidates(spark, sf), top_k=10)
    return s.select("query_id", "candidate_id", r6("score"), "rank")


@register("rank_top_k_pruned", ORACLE["rank_top_k"])
def q_rank_top_k_pruned(spark, sf):
    """W6 through clustered blocks: cells that cannot hold a best ten are not scored."""
    from quire.operators.topk import nearest_candidates

    q, c = fx.fx_queries(spark, sf), fx.fx_candidates(spark, sf)
    return nearest_candidates(q, c, 10).rows.select("query_id", "candidate_id", r6("score"), "rank")


@register(
    "attribution_eer",
    f"WITH {SQL_SCORES}, {sql_metrics('s', 'query_id')} SELECT query_id, round(eer, 6) AS eer FROM pq",
)
def q_attribution_eer(spark, sf):
    pq, _ = scoring.evaluate_vectors(fx.fx_queries(spark, sf), fx.fx_candidates(spark, sf))
    return pq.select("query_id", r6("eer"))


@register(
    "attribution_ap",
    f"""WITH {SQL_SCORES}, {sql_metrics('s', 'query_id')}
    SELECT query_id, n_pos, n_neg, round(ap, 6) AS ap FROM pq""",
)
def q_attribution_ap(spark, sf):
    pq, _ = scoring.evaluate_vectors(fx.fx_queries(spark, sf), fx.fx_candidates(spark, sf))
    return pq.select("query_id", "n_pos", "n_neg", r6("ap"))


SQL_MACRO_SELECT = """
  COUNT(*) AS n_queries,
  CAST(COUNT(*) FILTER (WHERE eer IS NULL) AS BIGINT) AS n_undefined,
  round(AVG(eer), 6) AS mean_eer,
  round(AVG(ap), 6) AS mean_ap
"""


@register(
    "evaluate_macro",
    f"WITH {SQL_SCORES}, {sql_metrics('s', 'query_id')} SELECT {SQL_MACRO_SELECT} FROM pq",
)
def q_evaluate_macro(spark, sf):
    _, macro = scoring.evaluate_vectors(fx.fx_queries(spark, sf), fx.fx_candidates(spark, sf))
    return macro.select("n_queries", "n_undefined", r6("mean_eer"), r6("mean_ap"))


@register(
    "compare_runs",
    f"""WITH {SQL_SCORES},
    runs AS (SELECT 'exact' AS run_id, query_id, score, label FROM s
             UNION ALL
             SELECT 'rounded' AS run_id, query_id, round(score, 1) AS score, label FROM s),
    {sql_metrics('runs', 'run_id, query_id')}
    SELECT run_id, {SQL_MACRO_SELECT} FROM pq GROUP BY run_id""",
)
def q_compare_runs(spark, sf):
    runs = (("exact", None), ("rounded", 1))
    _, macro = scoring.evaluate_vectors(fx.fx_queries(spark, sf), fx.fx_candidates(spark, sf), runs=runs)
    return macro.select("run_id", "n_queries", "n_undefined", r6("mean_eer"), r6("mean_ap"))


# --------------------------------------------------------------------------
# Step 2: topic-diversity author filter (C1 on given vectors)
# --------------------------------------------------------------------------


SQL_VECTORS = """
v AS (SELECT CAST(FLOOR(vec_id / 4.0) AS BIGINT) AS author_id, vec_id AS doc_id, vec_id AS seq,
             label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
"""

SQL_PAIRS = """
p AS (
  SELECT a.author_id, a.doc_id AS doc_i, b.doc_id AS doc_j,
         CASE WHEN list_dot_product(a.v, a.v) > 0 AND list_dot_product(b.v, b.v) > 0
              THEN list_dot_product(a.v, b.v)
                   / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))
              ELSE 0.0 END AS sim
  FROM v a JOIN v b
    ON a.author_id = b.author_id
   AND (a.seq < b.seq OR (a.seq = b.seq AND a.doc_id < b.doc_id))),
m AS (SELECT author_id, MAX(sim) AS max_sim FROM p GROUP BY author_id),
keep AS (SELECT author_id, max_sim FROM m WHERE max_sim < 0.2)
"""


@register(
    "author_pair_similarity",
    f"WITH {SQL_VECTORS}, {SQL_PAIRS} SELECT author_id, doc_i, doc_j, {r6sql('sim')} AS sim FROM p",
)
def q_author_pair_similarity(spark, sf):
    return diversity.author_pair_similarity(fx.fx_vectors(spark, sf)).select(
        "author_id", "doc_i", "doc_j", r6("sim")
    )


@register(
    "author_max_similarity",
    f"WITH {SQL_VECTORS}, {SQL_PAIRS} SELECT author_id, {r6sql('max_sim')} AS max_sim FROM m",
)
def q_author_max_similarity(spark, sf):
    return diversity.author_max_similarity(fx.fx_vectors(spark, sf)).select("author_id", r6("max_sim"))


@register(
    "filter_diverse_authors",
    f"""WITH {SQL_VECTORS}, {SQL_PAIRS}
    SELECT v.author_id, v.doc_id, v.label FROM v WHERE v.author_id IN (SELECT author_id FROM keep)""",
)
def q_filter_diverse_authors(spark, sf):
    docs = fx.fx_vectors(spark, sf)
    _, keep = diversity.diverse_authors(docs, threshold=0.2)
    return diversity.filter_diverse_authors(docs, keep).select("author_id", "doc_id", "label")


@register(
    "author_cap_sample",
    f"""WITH {SQL_VECTORS}, {SQL_PAIRS},
    ranked AS (SELECT author_id, max_sim,
                      ROW_NUMBER() OVER (ORDER BY md5(concat_ws('|', '0', 'cap', CAST(author_id AS VARCHAR))),
                                         author_id) AS r
               FROM keep)
    SELECT author_id, {r6sql('max_sim')} AS max_sim FROM ranked WHERE r <= 50""",
)
def q_author_cap_sample(spark, sf):
    docs = fx.fx_vectors(spark, sf)
    info, keep = diversity.diverse_authors(docs, threshold=0.2, cap=50, seed=0)
    return info.join(keep, "author_id", "left_semi").select("author_id", r6("max_sim"))


@register(
    "retention_report",
    f"""WITH {SQL_VECTORS}, {SQL_PAIRS}
    SELECT label, COUNT(*) AS rows_before,
           COUNT(*) FILTER (WHERE author_id IN (SELECT author_id FROM keep)) AS rows_after
    FROM v GROUP BY label""",
)
def q_retention_report(spark, sf):
    docs = fx.fx_vectors(spark, sf)
    _, keep = diversity.diverse_authors(docs, threshold=0.2)
    return diversity.retention_report(docs, keep, by="label")


# --------------------------------------------------------------------------
# Step 3: author identity, role counts, labels, prefix split
# --------------------------------------------------------------------------


SQL_DOCS = """
d AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS cid, conv_id * 1000 + turn AS doc_id, turn AS seq,
             text AS full_text,
             CASE WHEN role = 'user' AND conv_id % 2 = 0 THEN 'query' ELSE 'candidate' END AS side
      FROM conversations),
rd AS (SELECT 'a' || cid AS author_id, doc_id, seq, full_text, side,
              CASE WHEN side = 'query' THEN 'a' || cid ELSE 's' || cid END AS alias, conv_id
       FROM d)
"""


def _id_map(spark, sf, drop_mod10=None, dialect="mixed"):
    return authors.build_id_map(fx.fx_id_map(spark, sf, drop_mod10), dialect)


def _resolved(spark, sf):
    return authors.resolve_authors(fx.fx_aliased_docs(spark, sf), _id_map(spark, sf))


@register(
    "resolve_authors",
    f"WITH {SQL_DOCS} SELECT doc_id, side, alias, author_id FROM rd",
)
def q_resolve_authors(spark, sf):
    return _resolved(spark, sf).select("doc_id", "side", "alias", "author_id")


@register(
    "unresolved_aliases",
    f"WITH {SQL_DOCS} SELECT doc_id, side, alias FROM rd WHERE conv_id % 10 = 7",
)
def q_unresolved_aliases(spark, sf):
    m = _id_map(spark, sf, drop_mod10=7)
    return authors.unresolved_aliases(fx.fx_aliased_docs(spark, sf), m).select("doc_id", "side", "alias")


@register(
    "author_role_counts",
    f"""WITH {SQL_DOCS}
    SELECT author_id,
           CAST(COUNT(*) FILTER (WHERE side = 'query') AS BIGINT) AS n_query,
           CAST(COUNT(*) FILTER (WHERE side = 'candidate') AS BIGINT) AS n_candidate,
           COUNT(*) AS n_docs
    FROM rd GROUP BY author_id""",
)
def q_author_role_counts(spark, sf):
    return authors.role_counts(_resolved(spark, sf))


@register(
    "dataset_stats",
    f"""WITH {SQL_DOCS},
    rc AS (SELECT author_id,
                  COUNT(*) FILTER (WHERE side = 'query') AS n_query,
                  COUNT(*) FILTER (WHERE side = 'candidate') AS n_candidate,
                  COUNT(*) AS n_docs
           FROM rd GROUP BY author_id)
    SELECT CAST(COUNT(*) FILTER (WHERE n_query > 0) AS BIGINT) AS n_query_authors,
           CAST(COUNT(*) FILTER (WHERE n_candidate > 0) AS BIGINT) AS n_candidate_authors,
           COUNT(*) AS n_authors,
           CAST(SUM(n_docs) AS BIGINT) AS n_docs,
           CAST(COUNT(*) FILTER (WHERE n_docs > 5) AS BIGINT) AS n_authors_labelled,
           CAST(COALESCE(SUM(n_docs) FILTER (WHERE n_docs > 5), 0) AS BIGINT) AS n_labelled_rows,
           CAST(COUNT(*) FILTER (WHERE n_query > 0 AND n_candidate = 0) AS BIGINT) AS n_query_only
    FROM rc""",
)
def q_dataset_stats(spark, sf):
    return authors.dataset_stats(_resolved(spark, sf))


SQL_LABELS = """
ids AS (SELECT DISTINCT 'a' || CAST(conv_id AS VARCHAR) AS id FROM conversations
        UNION SELECT DISTINCT 's' || CAST(conv_id AS VARCHAR) AS id FROM conversations),
lab AS (SELECT id, ROW_NUMBER() OVER (ORDER BY id) - 1 AS label FROM ids)
"""


@register("label_ids", f"WITH {SQL_LABELS} SELECT id, CAST(label AS BIGINT) AS label FROM lab")
def q_label_ids(spark, sf):
    expanded = authors.expand_id_map(fx.fx_id_map(spark, sf), "mixed")
    return authors.label_ids(expanded).select("id", "label")


@register(
    "prefix_split",
    f"""WITH {SQL_DOCS},
    ids AS (SELECT DISTINCT side, author_id FROM rd),
    r AS (SELECT side, author_id,
                 ROW_NUMBER() OVER (PARTITION BY side ORDER BY author_id) - 1 AS pos,
                 COUNT(*) OVER (PARTITION BY side) AS n
          FROM ids)
    SELECT side, author_id, CAST(pos AS BIGINT) AS pos,
           CASE WHEN pos < CAST(FLOOR(n * 0.8) AS BIGINT) THEN 'head' ELSE 'tail' END AS part,
           CAST(pos < CAST(FLOOR(n * 0.8) AS BIGINT) AS INTEGER) AS selected
    FROM r""",
)
def q_prefix_split(spark, sf):
    return authors.prefix_split(_resolved(spark, sf), 0.8)


# --------------------------------------------------------------------------
# Steps 4-5: training-set construction
# --------------------------------------------------------------------------


EPOCH_SPLIT, EPOCH = "train", 1  # train split, epoch 1 -> seed 1
SEED = 1


def _pairset(spark, sf):
    return P.build_cross_role_pairs(_resolved(spark, sf), EPOCH_SPLIT, EPOCH, strict=False)


def sql_pairs_qc(seed: int) -> str:
    """CTEs up to ``ep``, the epoch's rows, over the resolved documents ``rd``."""

    def h(tag: str, col: str) -> str:
        return hash_int_sql(seed, tag, col)

    return f"""
qa AS (SELECT DISTINCT author_id FROM rd WHERE side = 'query'),
qpick AS (SELECT author_id, arg_min(doc_id, {h('query', 'doc_id')}) AS anchor_doc_id
          FROM rd WHERE side = 'query' GROUP BY author_id),
cpick AS (SELECT author_id, arg_min(doc_id, {h('candidate', 'doc_id')}) AS positive_doc_id
          FROM rd WHERE side = 'candidate' AND author_id IN (SELECT author_id FROM qa) GROUP BY author_id),
qc AS (SELECT author_id, anchor_doc_id, positive_doc_id FROM qpick JOIN cpick USING (author_id)),
cnt AS (SELECT author_id, COUNT(*) AS n FROM rd WHERE side = 'candidate' GROUP BY author_id),
el AS (SELECT author_id, n AS n_candidate_docs, ROW_NUMBER() OVER (ORDER BY author_id) - 1 AS e_idx
       FROM cnt WHERE n >= 2 AND author_id NOT IN (SELECT author_id FROM qa)),
ne AS (SELECT COUNT(*) AS ne FROM el),
dr AS (SELECT ROW_NUMBER() OVER (ORDER BY author_id) - 1 AS draw FROM qa),
drawn AS (SELECT dr.draw, el.author_id, el.n_candidate_docs AS n
          FROM dr CROSS JOIN ne JOIN el ON el.e_idx = {h('draw', 'dr.draw')} % ne.ne),
ix AS (SELECT draw, author_id, {h('first', 'draw')} % n AS i1, {h('second', 'draw')} % (n - 1) AS r2
       FROM drawn),
ix2 AS (SELECT draw, author_id, i1, CASE WHEN r2 >= i1 THEN r2 + 1 ELSE r2 END AS i2 FROM ix),
cpos AS (SELECT author_id, doc_id,
                ROW_NUMBER() OVER (PARTITION BY author_id ORDER BY seq, doc_id) - 1 AS pos
         FROM rd WHERE side = 'candidate'),
cc AS (SELECT ix2.draw, ix2.author_id, a.doc_id AS anchor_doc_id, b.doc_id AS positive_doc_id
       FROM ix2 JOIN cpos a ON a.author_id = ix2.author_id AND a.pos = ix2.i1
                JOIN cpos b ON b.author_id = ix2.author_id AND b.pos = ix2.i2),
u AS (SELECT 'qc' AS pair_kind, 'qc|' || author_id AS row_id, author_id, anchor_doc_id, positive_doc_id FROM qc
      UNION ALL
      SELECT 'cc' AS pair_kind, 'cc|' || CAST(draw AS VARCHAR) AS row_id, author_id, anchor_doc_id,
             positive_doc_id FROM cc),
ep AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {hash_key_sql(seed, 'shuffle', 'row_id')}, row_id) - 1 AS row_pos
       FROM u)
"""


SQL_PAIRS_QC = sql_pairs_qc(SEED)


@register(
    "query_candidate_pairs",
    f"""WITH {SQL_DOCS}, {SQL_PAIRS_QC}
    SELECT qc.author_id, anchor_doc_id, positive_doc_id, a.full_text AS anchors, b.full_text AS positives
    FROM qc JOIN rd a ON a.doc_id = qc.anchor_doc_id JOIN rd b ON b.doc_id = qc.positive_doc_id""",
)
def q_query_candidate_pairs(spark, sf):
    ps = _pairset(spark, sf)
    return P.attach_texts(ps.qc, fx.fx_docs(spark, sf), ("author_id",)).select(
        "author_id", "anchor_doc_id", "positive_doc_id", "anchors", "positives"
    )


@register(
    "eligible_augment_authors",
    f"""WITH {SQL_DOCS}, {SQL_PAIRS_QC}
    SELECT author_id, n_candidate_docs, CAST(e_idx AS BIGINT) AS e_idx FROM el""",
)
def q_eligible_augment_authors(spark, sf):
    return _pairset(spark, sf).eligible.select("author_id", "n_candidate_docs", "e_idx")


@register(
    "candidate_candidate_pairs",
    f"""WITH {SQL_DOCS}, {SQL_PAIRS_QC}
    SELECT CAST(draw AS BIGINT) AS draw, cc.author_id, anchor_doc_id, positive_doc_id,
           a.full_text AS anchors, b.full_text AS positives
    FROM cc JOIN rd a ON a.doc_id = cc.anchor_doc_id JOIN rd b ON b.doc_id = cc.positive_doc_id""",
)
def q_candidate_candidate_pairs(spark, sf):
    ps = _pairset(spark, sf)
    return P.attach_texts(ps.cc, fx.fx_docs(spark, sf), ("draw",)).select(
        "draw", "author_id", "anchor_doc_id", "positive_doc_id", "anchors", "positives"
    )


@register(
    "epoch_pairs",
    f"""WITH {SQL_DOCS}, {SQL_PAIRS_QC}
    SELECT pair_kind, row_id, author_id, anchor_doc_id, positive_doc_id, CAST(row_pos AS BIGINT) AS row_pos,
           CAST(FLOOR(row_pos / 64) AS BIGINT) AS batch_id
    FROM ep""",
)
def q_epoch_pairs(spark, sf):
    return _pairset(spark, sf).rows.select(
        "pair_kind", "row_id", "author_id", "anchor_doc_id", "positive_doc_id", "row_pos", "batch_id"
    )


@register(
    "first_two_pairs",
    f"""WITH {SQL_DOCS},
    t AS (SELECT cid AS author_id, doc_id,
                 ROW_NUMBER() OVER (PARTITION BY cid
                                    ORDER BY CASE WHEN side = 'query' THEN 0 ELSE 1 END, seq, doc_id) AS rn
          FROM d),
    p AS (SELECT author_id, MAX(doc_id) FILTER (WHERE rn = 1) AS anchor_doc_id,
                 MAX(doc_id) FILTER (WHERE rn = 2) AS positive_doc_id
          FROM t GROUP BY author_id HAVING MAX(doc_id) FILTER (WHERE rn = 2) IS NOT NULL),
    r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {hash_key_sql(SEED, 'shuffle', 'author_id')}, author_id) - 1 AS row_pos
          FROM p)
    SELECT r.author_id, anchor_doc_id, positive_doc_id, CAST(row_pos AS BIGINT) AS row_pos,
           a.full_text AS anchors, b.full_text AS positives
    FROM r JOIN d a ON a.doc_id = r.anchor_doc_id JOIN d b ON b.doc_id = r.positive_doc_id""",
)
def q_first_two_pairs(spark, sf):
    out = P.build_first_two_pairs(fx.fx_docs(spark, sf), EPOCH_SPLIT, EPOCH)
    return out.select("author_id", "anchor_doc_id", "positive_doc_id", "row_pos", "anchors", "positives")


@register(
    "labelled_rows",
    f"""WITH {SQL_DOCS}, {SQL_LABELS},
    big AS (SELECT author_id FROM rd GROUP BY author_id HAVING COUNT(*) > 5)
    SELECT rd.author_id, doc_id, full_text AS anchors, '' AS others, CAST(lab.label AS BIGINT) AS labels
    FROM rd JOIN big USING (author_id) JOIN lab ON lab.id = rd.author_id""",
)
def q_labelled_rows(spark, sf):
    expanded = authors.expand_id_map(fx.fx_id_map(spark, sf), "mixed")
    out = P.build_labelled_rows(_resolved(spark, sf), expanded)
    return out.select("author_id", "doc_id", "anchors", "others", "labels")


# --------------------------------------------------------------------------
# Step 6: losses
# --------------------------------------------------------------------------


SQL_COS = """CASE WHEN list_dot_product({a}, {a}) > 0 AND list_dot_product({b}, {b}) > 0
     THEN list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))
     ELSE 0.0 END"""


@register(
    "symmetric_ranking_loss",
    f"""WITH {SQL_VECTORS},
    t AS (SELECT author_id, v, ROW_NUMBER() OVER (PARTITION BY author_id ORDER BY seq, doc_id) AS rn FROM v),
    lp AS (SELECT a.author_id, CAST(FLOOR(a.author_id / 16.0) AS BIGINT) AS batch_id, a.v AS av, b.v AS pv
           FROM t a JOIN t b ON a.author_id = b.author_id AND a.rn = 1 AND b.rn = 2),
    s AS (SELECT a.batch_id, a.author_id AS i, b.author_id AS j,
                 20.0 * ({SQL_COS.format(a='a.av', b='b.pv')}) AS s
          FROM lp a JOIN lp b ON a.batch_id = b.batch_id),
    fm AS (SELECT batch_id, i, MAX(s) AS m FROM s GROUP BY batch_id, i),
    fw AS (SELECT s.batch_id, s.i, fm.m + ln(SUM(exp(s.s - fm.m))) AS lse
           FROM s JOIN fm ON s.batch_id = fm.batch_id AND s.i = fm.i GROUP BY s.batch_id, s.i, fm.m),
    bm AS (SELECT batch_id, j, MAX(s) AS m FROM s GROUP BY batch_id, j),
    bw AS (SELECT s.batch_id, s.j, bm.m + ln(SUM(exp(s.s - bm.m))) AS lse
           FROM s JOIN bm ON s.batch_id = bm.batch_id AND s.j = bm.j GROUP BY s.batch_id, s.j, bm.m),
    dg AS (SELECT batch_id, i, s FROM s WHERE i = j),
    f AS (SELECT fw.batch_id, AVG(fw.lse - dg.s) AS fwd, COUNT(*) AS n
          FROM fw JOIN dg ON fw.batch_id = dg.batch_id AND fw.i = dg.i GROUP BY fw.batch_id),
    b AS (SELECT bw.batch_id, AVG(bw.lse - dg.s) AS bwd
          FROM bw JOIN dg ON bw.batch_id = dg.batch_id AND bw.j = dg.i GROUP BY bw.batch_id)
    SELECT f.batch_id, f.n, round((fwd + bwd) / 2, 6) AS loss FROM f JOIN b USING (batch_id)""",
)
def q_symmetric_ranking_loss(spark, sf):
    out = losses.symmetric_ranking_loss(fx.fx_loss_pairs(spark, sf))
    return out.select("batch_id", "n", r6("loss"))


@register(
    "multi_positive_loss",
    f"""WITH {SQL_VECTORS},
    b AS (SELECT doc_id, label, v, CAST(FLOOR(doc_id / 64.0) AS BIGINT) AS batch_id FROM v),
    s AS (SELECT x.batch_id, x.doc_id AS i, y.doc_id AS j, CAST(x.label = y.label AS INTEGER) AS pos,
                 list_dot_product(x.v, y.v)
                 / (greatest(sqrt(list_dot_product(x.v, x.v)), 1e-12)
                    * greatest(sqrt(list_dot_product(y.v, y.v)), 1e-12)) / 0.1 AS s
          FROM b x JOIN b y ON x.batch_id = y.batch_id AND x.doc_id <> y.doc_id),
    m AS (SELECT batch_id, i, MAX(s) AS m, SUM(pos) AS npos FROM s GROUP BY batch_id, i),
    r AS (SELECT s.batch_id, s.i,
                 -SUM(CASE WHEN pos = 1 THEN (s.s - m.m) - ln(z.z) ELSE 0 END) / greatest(m.npos, 1) AS li
          FROM s JOIN m ON s.batch_id = m.batch_id AND s.i = m.i
                 JOIN (SELECT s.batch_id, s.i, SUM(exp(s.s - m.m)) AS z
                       FROM s JOIN m ON s.batch_id = m.batch_id AND s.i = m.i GROUP BY s.batch_id, s.i) z
                   ON z.batch_id = s.batch_id AND z.i = s.i
          GROUP BY s.batch_id, s.i, m.npos),
    allrows AS (SELECT b.batch_id, b.doc_id, COALESCE(r.li, 0.0) AS li
                FROM b LEFT JOIN r ON r.batch_id = b.batch_id AND r.i = b.doc_id)
    SELECT batch_id, COUNT(*) AS n, round(AVG(li), 6) AS loss FROM allrows GROUP BY batch_id""",
)
def q_multi_positive_loss(spark, sf):
    v = fx.fx_vectors(spark, sf)
    rows = v.select((F.floor(F.col("doc_id") / 64.0)).cast("bigint").alias("batch_id"), "label", "vec")
    return losses.multi_positive_loss(rows).select("batch_id", "n", r6("loss"))


# the same losses over one batch of all rows, merged from tiles


@register("ranking_loss_one_batch", ORACLE["symmetric_ranking_loss"].replace("CAST(FLOOR(a.author_id / 16.0) AS BIGINT)", "CAST(0 AS BIGINT)"))
def q_ranking_loss_one_batch(spark, sf):
    pairs = fx.fx_loss_pairs(spark, sf).withColumn("batch_id", F.lit(0).cast("bigint"))
    return losses.tiled_ranking_loss(pairs).select("batch_id", "n", r6("loss"))


@register("multi_positive_loss_one_batch", ORACLE["multi_positive_loss"].replace("CAST(FLOOR(doc_id / 64.0) AS BIGINT)", "CAST(0 AS BIGINT)"))
def q_multi_positive_loss_one_batch(spark, sf):
    rows = fx.fx_vectors(spark, sf).select(F.lit(0).cast("bigint").alias("batch_id"), "label", "vec")
    return losses.tiled_multi_positive_loss(rows).select("batch_id", "n", r6("loss"))


# --------------------------------------------------------------------------
# Step 7: text encoder, diversity on raw text, JSONL round trip
# --------------------------------------------------------------------------


SQL_TEXT = f"""
tok AS (SELECT doc_id, source AS author_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS t
        FROM documents),
bk AS (SELECT doc_id, author_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {TX.DEFAULT_DIM} AS b, COUNT(*) AS c
       FROM tok WHERE t <> '' GROUP BY doc_id, author_id, b),
nrm AS (SELECT doc_id, SUM(c) AS n_tokens, COUNT(*) AS n_buckets, sqrt(SUM(c * c)) AS nrm
        FROM bk GROUP BY doc_id)
"""


@register(
    "embed_documents",
    f"""WITH {SQL_TEXT}
    SELECT d.doc_id, CAST(COALESCE(n_tokens, 0) AS BIGINT) AS n_tokens,
           CAST(COALESCE(n_buckets, 0) AS BIGINT) AS n_buckets, round(COALESCE(nrm, 0.0), 6) AS norm
    FROM documents d LEFT JOIN nrm USING (doc_id)""",
)
def q_embed_documents(spark, sf):
    e = TX.embed_documents(fx.fx_text_docs(spark, sf))
    return e.select("doc_id", *TX.bucket_stats()).select("doc_id", "n_tokens", "n_buckets", r6("norm"))


@register(
    "diverse_authors_from_text",
    f"""WITH {SQL_TEXT},
    dp AS (SELECT x.doc_id AS doc_i, y.doc_id AS doc_j, SUM(x.c * y.c) AS dot
           FROM bk x JOIN bk y ON x.author_id = y.author_id AND x.b = y.b AND x.doc_id < y.doc_id
           GROUP BY x.doc_id, y.doc_id),
    docs AS (SELECT doc_id, source AS author_id FROM documents),
    allp AS (SELECT a.author_id, a.doc_id AS doc_i, b.doc_id AS doc_j
             FROM docs a JOIN docs b ON a.author_id = b.author_id AND a.doc_id < b.doc_id),
    sims AS (SELECT allp.author_id,
                    CASE WHEN ni.nrm > 0 AND nj.nrm > 0 THEN COALESCE(dp.dot, 0) / (ni.nrm * nj.nrm)
                         ELSE 0.0 END AS sim
             FROM allp LEFT JOIN dp USING (doc_i, doc_j)
                       LEFT JOIN nrm ni ON ni.doc_id = allp.doc_i
                       LEFT JOIN nrm nj ON nj.doc_id = allp.doc_j),
    m AS (SELECT author_id, MAX(sim) AS max_sim FROM sims GROUP BY author_id),
    n AS (SELECT author_id, COUNT(*) AS n_docs FROM docs GROUP BY author_id)
    SELECT author_id, n_docs, {r6sql('max_sim')} AS max_sim, CAST(max_sim < 0.2 AS INTEGER) AS kept
    FROM m JOIN n USING (author_id)""",
)
def q_diverse_authors_from_text(spark, sf):
    docs = TX.embed_documents(fx.fx_text_docs(spark, sf), out="vec")
    mx = author_pairs(docs, emit="max", featurize=partial(TX.bucket_matrix, dim=TX.DEFAULT_DIM))
    n = docs.groupBy("author_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return mx.join(n, "author_id").select(
        "author_id", "n_docs", r6("max_sim"), (F.col("max_sim") < 0.2).cast("int").alias("kept")
    )


@register("jsonl_round_trip", f"WITH {SQL_DOCS} SELECT doc_id, side, alias, author_id FROM rd")
def q_jsonl_round_trip(spark, sf):
    """Write the aliased documents as JSON lines (K1 layout, one folder per
    role) and the id map as JSON lines, read both back with explicit schemas
    (S1/S6) and resolve authors (J1)."""
    from pyspark.sql import types as T

    from quire.session import scratch_path
    from quire.sources import idmap, writers

    base = scratch_path(spark, "jsonl_round_trip")
    d = fx.fx_aliased_docs(spark, sf).select(
        F.col("doc_id").cast("string").alias("documentID"),
        F.col("full_text").alias("fullText"),
        F.array("alias").alias("authorIDs"),
        "side",
    )
    writers.write_filtered_corpus(d, f"{base}/docs", by=("side",))
    fx.fx_id_map(spark, sf).orderBy("pos").select(
        F.col("map_key").alias("key"), F.col("map_value").alias("value")
    ).write.mode("overwrite").json(f"{base}/idmap")

    schema = T.StructType(
        [
            T.StructField("documentID", T.StringType()),
            T.StructField("fullText", T.StringType()),
            T.StructField("authorIDs", T.ArrayType(T.StringType())),
            T.StructField("side", T.StringType()),
        ]
    )
    back = spark.read.schema(schema).json(f"{base}/docs").select(
        F.col("documentID").cast("bigint").alias("doc_id"), "side", F.element_at("authorIDs", 1).alias("alias")
    )
    m = authors.build_id_map(idmap.read_id_map_lines(spark, f"{base}/idmap"), "mixed")
    return authors.resolve_authors(back, m).select("doc_id", "side", "alias", "author_id")


# --------------------------------------------------------------------------
# Step 8: the larger author table (orders) for scale checks
# --------------------------------------------------------------------------

SQL_ORDERS_DOCS = """
rd AS (SELECT CAST(o_custkey AS VARCHAR) AS author_id, o_orderkey AS doc_id, o_orderkey AS seq,
              CASE WHEN o_orderkey % 3 = 0 THEN 'query' ELSE 'candidate' END AS side
       FROM orders)
"""


def _orders_docs(spark, sf):
    return fx.fx_orders_docs(spark, sf)


@register(
    "orders_epoch_pairs",
    f"""WITH {SQL_ORDERS_DOCS}, {SQL_PAIRS_QC}
    SELECT pair_kind, row_id, author_id, anchor_doc_id, positive_doc_id, CAST(row_pos AS BIGINT) AS row_pos,
           CAST(FLOOR(row_pos / 64) AS BIGINT) AS batch_id
    FROM ep""",
)
def q_orders_epoch_pairs(spark, sf):
    ps = P.build_cross_role_pairs(_orders_docs(spark, sf), EPOCH_SPLIT, EPOCH, strict=False)
    return ps.rows.select("pair_kind", "row_id", "author_id", "anchor_doc_id", "positive_doc_id", "row_pos", "batch_id")


@register(
    "orders_first_two_pairs",
    f"""WITH {SQL_ORDERS_DOCS},
    t AS (SELECT author_id, doc_id,
                 ROW_NUMBER() OVER (PARTITION BY author_id
                                    ORDER BY CASE WHEN side = 'query' THEN 0 ELSE 1 END, seq, doc_id) AS rn
          FROM rd),
    p AS (SELECT author_id, MAX(doc_id) FILTER (WHERE rn = 1) AS anchor_doc_id,
                 MAX(doc_id) FILTER (WHERE rn = 2) AS positive_doc_id
          FROM t GROUP BY author_id HAVING MAX(doc_id) FILTER (WHERE rn = 2) IS NOT NULL)
    SELECT author_id, anchor_doc_id, positive_doc_id,
           CAST(ROW_NUMBER() OVER (ORDER BY {hash_key_sql(SEED, 'shuffle', 'author_id')}, author_id) - 1 AS BIGINT)
             AS row_pos
    FROM p""",
)
def q_orders_first_two_pairs(spark, sf):
    out = P.build_first_two_pairs(_orders_docs(spark, sf), EPOCH_SPLIT, EPOCH, with_text=False)
    return out.select("author_id", "anchor_doc_id", "positive_doc_id", "row_pos")


@register(
    "orders_role_counts",
    f"""WITH {SQL_ORDERS_DOCS}
    SELECT author_id,
           CAST(COUNT(*) FILTER (WHERE side = 'query') AS BIGINT) AS n_query,
           CAST(COUNT(*) FILTER (WHERE side = 'candidate') AS BIGINT) AS n_candidate,
           COUNT(*) AS n_docs
    FROM rd GROUP BY author_id""",
)
def q_orders_role_counts(spark, sf):
    return authors.role_counts(_orders_docs(spark, sf))


# --------------------------------------------------------------------------
# Alignment of a separate truth table (J7), id-map validation, epoch feed
# --------------------------------------------------------------------------


@register(
    "evaluate_aligned",
    f"WITH {SQL_SCORES}, {sql_metrics('s', 'query_id')} SELECT {SQL_MACRO_SELECT} FROM pq",
)
def q_evaluate_aligned(spark, sf):
    """Scores and ground truth arrive as two long tables (as the reference's
    two matrices); J7 aligns them on the pair key before evaluation, for a
    share of the queries at a time."""
    from quire.operators.metrics import attach_truth

    def aligned(q, c):
        scores = scoring.score_query_candidates(q, c)
        truth = scoring.scored_with_truth(q, c).select("query_id", "candidate_id", "label")
        return attach_truth(scores, truth)

    _, macro = scoring.evaluate_in_rounds(fx.fx_queries(spark, sf), fx.fx_candidates(spark, sf), aligned)
    return macro.select("n_queries", "n_undefined", r6("mean_eer"), r6("mean_ap"))


@register(
    "id_map_unparsed_nested",
    """SELECT '(''a' || CAST(conv_id AS VARCHAR) || ''', ''HRS2.0'')' AS map_key,
              's' || CAST(conv_id AS VARCHAR) AS map_value
       FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 <> 0""",
)
def q_id_map_unparsed_nested(spark, sf):
    """Entries that the nested dialect cannot read (the reference would fail
    on them); the mixed dialect reads all."""
    return authors.id_map_unparsed(fx.fx_id_map(spark, sf), "nested").select("map_key", "map_value")


def _sql_first_two(seed: int) -> str:
    return f"""
    SELECT {seed} AS epoch, author_id, anchor_doc_id, positive_doc_id,
           CAST(ROW_NUMBER() OVER (ORDER BY {hash_key_sql(seed, 'shuffle', 'author_id')}, author_id) - 1 AS BIGINT)
             AS row_pos
    FROM p"""


@register(
    "epoch_feed",
    f"""WITH {SQL_DOCS},
    t AS (SELECT cid AS author_id, doc_id,
                 ROW_NUMBER() OVER (PARTITION BY cid
                                    ORDER BY CASE WHEN side = 'query' THEN 0 ELSE 1 END, seq, doc_id) AS rn
          FROM d),
    p AS (SELECT author_id, MAX(doc_id) FILTER (WHERE rn = 1) AS anchor_doc_id,
                 MAX(doc_id) FILTER (WHERE rn = 2) AS positive_doc_id
          FROM t GROUP BY author_id HAVING MAX(doc_id) FILTER (WHERE rn = 2) IS NOT NULL)
    {_sql_first_two(0)}
    UNION ALL
    {_sql_first_two(1)}""",
)
def q_epoch_feed(spark, sf):
    """Two train epochs of first-two pairs written by the epoch feed (one
    folder per epoch) and read back."""
    from quire.session import scratch_path
    from quire.streaming.epochs import write_epochs

    docs = fx.fx_docs(spark, sf)
    base = scratch_path(spark, "epoch_feed")

    def build(e):
        return P.build_first_two_pairs(docs, "train", e, with_text=False)

    write_epochs(build, [0, 1], base)
    back = spark.read.parquet(base)
    return back.select(
        F.col("epoch").cast("int").alias("epoch"), "author_id", "anchor_doc_id", "positive_doc_id", "row_pos"
    )


# --------------------------------------------------------------------------
# Sinks read back: score tables (K5, S7), author info (K2), filtered
# corpora (K1, S5) feeding the first-two builder
# --------------------------------------------------------------------------


@register(
    "scores_sink_round_trip",
    f"""WITH {SQL_SCORES},
    runs AS (SELECT 'exact' AS run_id, query_id, score, label FROM s
             UNION ALL
             SELECT 'rounded' AS run_id, query_id, round(score, 1) AS score, label FROM s),
    {sql_metrics('runs', 'run_id, query_id')}
    SELECT run_id, {SQL_MACRO_SELECT} FROM pq GROUP BY run_id""",
)
def q_scores_sink_round_trip(spark, sf):
    """Scores of two runs written under ``run_id=<id>`` (K5), ground truth as
    its own long table, both read back (S7 long form), aligned (J7) and
    compared (C10), a share of the queries at a time."""
    from quire.session import scratch_path

    base = scratch_path(spark, "scores")
    _, macro = scoring.compare_stored_runs(fx.fx_queries(spark, sf), fx.fx_candidates(spark, sf), base)
    return macro.select("run_id", "n_queries", "n_undefined", r6("mean_eer"), r6("mean_ap"))


@register(
    "author_info_round_trip",
    f"""WITH {SQL_VECTORS}, {SQL_PAIRS}
    SELECT author_id, doc_i, doc_j, {r6sql('sim')} AS sim FROM p
    WHERE author_id IN (SELECT author_id FROM keep)""",
)
def q_author_info_round_trip(spark, sf):
    """The author info of the diversity filter (K2) written and read back:
    the pair similarities of every author under the threshold."""
    from quire.session import scratch_path
    from quire.sources import writers

    docs = fx.fx_vectors(spark, sf)
    info, _ = diversity.diverse_authors(docs, threshold=0.2)
    base = scratch_path(spark, "author_info")
    writers.write_author_info(info, diversity.author_pair_similarity(docs), base)
    return spark.read.parquet(f"{base}/pairs").select("author_id", "doc_i", "doc_j", r6("sim"))


@register(
    "filtered_corpora_first_two",
    f"""WITH {SQL_DOCS},
    t AS (SELECT cid AS author_id, doc_id,
                 ROW_NUMBER() OVER (PARTITION BY cid
                                    ORDER BY CASE WHEN side = 'query' THEN 0 ELSE 1 END, seq, doc_id) AS rn
          FROM d),
    p AS (SELECT author_id, MAX(doc_id) FILTER (WHERE rn = 1) AS anchor_doc_id,
                 MAX(doc_id) FILTER (WHERE rn = 2) AS positive_doc_id
          FROM t GROUP BY author_id HAVING MAX(doc_id) FILTER (WHERE rn = 2) IS NOT NULL),
    r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {hash_key_sql(SEED, 'shuffle', 'author_id')}, author_id) - 1 AS row_pos
          FROM p)
    SELECT r.author_id, CAST(row_pos AS BIGINT) AS row_pos, a.full_text AS anchors, b.full_text AS positives
    FROM r JOIN d a ON a.doc_id = r.anchor_doc_id JOIN d b ON b.doc_id = r.positive_doc_id""",
)
def q_filtered_corpora_first_two(spark, sf):
    """Documents written as two filtered corpora (K1 layout: one folder per
    ``<split>_<role>_filtered.jsonl``, rows in arrival order), read back with
    the multi-corpus scan (S5) and arrival order, then C5."""
    from quire.plans.files import first_two_from_filtered
    from quire.session import scratch_path

    base = scratch_path(spark, "filtered_corpora")
    d = fx.fx_docs(spark, sf)
    for parity in (0, 1):
        part = d.where(F.col("author_id").cast("bigint") % 2 == parity)
        for role, name in (("query", "queries"), ("candidate", "candidates")):
            (
                part.where(F.col("side") == role)
                .orderBy("seq", "doc_id")
                .select(
                    F.col("doc_id").cast("string").alias("documentID"),
                    F.col("full_text").alias("fullText"),
                    F.array("author_id").alias("authorIDs"),
                )
                .write.mode("overwrite")
                .json(f"{base}/corpus{parity}/{EPOCH_SPLIT}_{name}_filtered.jsonl")
            )
    out = first_two_from_filtered(spark, f"{base}/*/{{split}}", EPOCH_SPLIT, EPOCH)
    return out.select("author_id", "row_pos", "anchors", "positives")


@register(
    "labelled_rows_ordered",
    f"""WITH {SQL_DOCS}, {SQL_LABELS},
    rr AS (SELECT *, CASE WHEN side = 'query' THEN 0 ELSE 1 END AS r FROM rd),
    big AS (SELECT author_id, arg_min(r, (r, seq, doc_id)) AS f_r, arg_min(seq, (r, seq, doc_id)) AS f_seq,
                   arg_min(doc_id, (r, seq, doc_id)) AS f_doc
            FROM rr GROUP BY author_id HAVING COUNT(*) > 5)
    SELECT rr.author_id, doc_id, CAST(lab.label AS BIGINT) AS labels,
           CAST(ROW_NUMBER() OVER (ORDER BY f_r, f_seq, f_doc, rr.r, rr.seq, rr.doc_id) - 1 AS BIGINT) AS row_pos
    FROM rr JOIN big USING (author_id) JOIN lab ON lab.id = rr.author_id""",
)
def q_labelled_rows_ordered(spark, sf):
    """K4: labelled rows numbered in writer order — authors by first
    appearance, then each author's documents in arrival order."""
    from quire.operators.indexing import dense_index

    expanded = authors.expand_id_map(fx.fx_id_map(spark, sf), "mixed")
    out = P.build_labelled_rows(_resolved(spark, sf), expanded)
    flat = out.select(
        "author_id",
        "doc_id",
        "labels",
        F.col("order_key._first.r").alias("_k1"),
        F.col("order_key._first.seq").alias("_k2"),
        F.col("order_key._first.doc_id").alias("_k3"),
        F.col("order_key.r").alias("_k4"),
        F.col("order_key.seq").alias("_k5"),
        F.col("order_key.doc_id").alias("_k6"),
    )
    ranked = dense_index(flat, ["_k1", "_k2", "_k3", "_k4", "_k5", "_k6"], out="row_pos")
    return ranked.select("author_id", "doc_id", "labels", "row_pos")


@register(
    "split_stats",
    f"""WITH {SQL_DOCS},
    ids AS (SELECT DISTINCT side, author_id FROM rd),
    r AS (SELECT side, author_id,
                 ROW_NUMBER() OVER (PARTITION BY side ORDER BY author_id) - 1 AS pos,
                 COUNT(*) OVER (PARTITION BY side) AS n
          FROM ids),
    kept AS (SELECT side FROM r WHERE pos < CAST(FLOOR(n * 0.8) AS BIGINT))
    SELECT CAST(COUNT(*) FILTER (WHERE side = 'query') AS BIGINT) AS n_query_authors,
           CAST(COUNT(*) FILTER (WHERE side = 'candidate') AS BIGINT) AS n_candidate_authors,
           CAST(2 * COUNT(*) FILTER (WHERE side = 'query') AS BIGINT) AS rows_per_epoch
    FROM kept""",
)
def q_split_stats(spark, sf):
    """A6 / A8 after the split: authors per role in the kept part and the
    expected rows per epoch (two per query author)."""
    s = authors.prefix_split(_resolved(spark, sf), 0.8).where(F.col("selected") == 1)
    return s.agg(
        F.count_if(F.col("side") == "query").cast("bigint").alias("n_query_authors"),
        F.count_if(F.col("side") == "candidate").cast("bigint").alias("n_candidate_authors"),
        (F.count_if(F.col("side") == "query") * 2).cast("bigint").alias("rows_per_epoch"),
    )


@register(
    "id_map_conflicts",
    """WITH m AS (
      SELECT CASE WHEN conv_id % 3 = 0
                  THEN '("(''a' || CAST(conv_id AS VARCHAR) || ''',)", ''HRS1.1'')'
                  ELSE '(''a' || CAST(conv_id AS VARCHAR) || ''', ''HRS2.0'')' END AS map_key,
             's' || CAST(conv_id // 2 AS VARCHAR) AS map_value,
             conv_id AS pos
      FROM (SELECT DISTINCT conv_id FROM conversations)),
    e AS (SELECT 'a' || CAST(pos AS VARCHAR) AS alias, 'a' || CAST(pos AS VARCHAR) AS author_id, pos * 2 AS ord FROM m
          UNION ALL
          SELECT map_value AS alias, 'a' || CAST(pos AS VARCHAR) AS author_id, pos * 2 + 1 AS ord FROM m)
    SELECT alias, arg_max(author_id, ord) AS author_id, COUNT(DISTINCT author_id) AS n_targets
    FROM e GROUP BY alias HAVING COUNT(DISTINCT author_id) > 1""",
)
def q_id_map_conflicts(spark, sf):
    """S6 last-entry-wins on a map where two consecutive conversations share
    one candidate alias ('s' || conv_id / 2): each shared alias resolves to
    the later entry and is reported with its number of targets."""
    m = fx.fx_id_map(spark, sf).withColumn(
        "map_value", F.concat(F.lit("s"), F.floor(F.col("pos") / 2).cast("bigint").cast("string"))
    )
    resolved = authors.build_id_map(m, "mixed")
    return resolved.where(F.col("n_targets") > 1).select("alias", "author_id", "n_targets")


@register(
    "query_authors_without_candidates",
    f"""WITH {SQL_DOCS}
    SELECT author_id, COUNT(*) AS n_query_docs FROM rd
    WHERE side = 'query' AND author_id NOT IN (SELECT author_id FROM rd WHERE side = 'candidate')
    GROUP BY author_id""",
)
def q_query_authors_without_candidates(spark, sf):
    """D3: query authors that have no candidate document. The reference
    fails on them; the builder drops them (strict=False) and lists them."""
    return _pairset(spark, sf).unmatched.select("author_id", "n_query_docs")


@register(
    "text_pair_similarity",
    f"""WITH {SQL_TEXT},
    dp AS (SELECT x.doc_id AS doc_i, y.doc_id AS doc_j, SUM(x.c * y.c) AS dot
           FROM bk x JOIN bk y ON x.author_id = y.author_id AND x.b = y.b AND x.doc_id < y.doc_id
           GROUP BY x.doc_id, y.doc_id),
    docs AS (SELECT doc_id, source AS author_id FROM documents),
    allp AS (SELECT a.author_id, a.doc_id AS doc_i, b.doc_id AS doc_j
             FROM docs a JOIN docs b ON a.author_id = b.author_id AND a.doc_id < b.doc_id),
    sims AS (SELECT allp.author_id, allp.doc_i, allp.doc_j,
                    CASE WHEN ni.nrm > 0 AND nj.nrm > 0 THEN COALESCE(dp.dot, 0) / (ni.nrm * nj.nrm)
                         ELSE 0.0 END AS sim
             FROM allp LEFT JOIN dp USING (doc_i, doc_j)
                       LEFT JOIN nrm ni ON ni.doc_id = allp.doc_i
                       LEFT JOIN nrm nj ON nj.doc_id = allp.doc_j)
    SELECT author_id, doc_i, doc_j, {r6sql('sim')} AS sim FROM sims""",
)
def q_text_pair_similarity(spark, sf):
    """A3 on raw text: every document pair of every source with its cosine
    over hashed term counts (the long form of the pairwise-similarity map)."""
    docs = TX.embed_documents(fx.fx_text_docs(spark, sf), out="vec")
    pairs = author_pairs(docs, emit="pairs", featurize=partial(TX.bucket_matrix, dim=TX.DEFAULT_DIM))
    return pairs.select("author_id", "doc_i", "doc_j", r6("sim"))


# --------------------------------------------------------------------------
# Files through the library's own readers (S1-S4, U1, P1, P2) and the
# counted sinks
# --------------------------------------------------------------------------


def _write_json_lines(docs: DataFrame, path: str, ids: str, author) -> None:
    """Documents in (seq, doc_id) order as one ``*.jsonl`` folder of parts."""
    docs.orderBy("seq", "doc_id").select(
        F.col("doc_id").cast("string").alias("documentID"), F.col("full_text").alias("fullText"), author.alias(ids)
    ).write.mode("overwrite").json(path)


@register(
    "corpus_scan",
    f"""WITH {SQL_DOCS}
    SELECT doc_id, cid AS author_id, CASE WHEN side = 'query' THEN '{EPOCH_SPLIT}_queries.jsonl'
                                          ELSE '{EPOCH_SPLIT}_candidates.jsonl' END AS name,
           md5(full_text) AS text_md5,
           CAST(ROW_NUMBER() OVER (ORDER BY side, seq, doc_id) - 1 AS BIGINT) AS arrival
    FROM d""",
)
def q_corpus_scan(spark, sf):
    """The corpus written as ``train_*.jsonl`` next to another
    split and an earlier filtered output, read with the corpus scan and
    numbered in arrival order (file by file, line by line)."""
    from quire.session import scratch_path
    from quire.sources import jsonl

    base = scratch_path(spark, "corpus_scan")
    d = fx.fx_docs(spark, sf)
    ids = F.array(F.col("author_id"), F.lit("second author"))
    queries = d.where(F.col("side") == "query")
    _write_json_lines(queries, f"{base}/{EPOCH_SPLIT}_queries.jsonl", "authorIDs", ids)
    _write_json_lines(d.where(F.col("side") == "candidate"), f"{base}/{EPOCH_SPLIT}_candidates.jsonl", "authorIDs", ids)
    _write_json_lines(queries, f"{base}/dev_queries.jsonl", "authorIDs", ids)
    _write_json_lines(queries, f"{base}/{EPOCH_SPLIT}_queries_filtered.jsonl", "authorIDs", ids)
    back = jsonl.with_arrival_seq(jsonl.read_corpus(spark, base, EPOCH_SPLIT), out="arrival")
    return back.select(
        F.col("documentID").cast("bigint").alias("doc_id"),
        F.col("authorID").alias("author_id"),
        jsonl.source_name("file").alias("name"),
        F.md5("fullText").alias("text_md5"),
        "arrival",
    )


@register(
    "official_files_resolved",
    f"""WITH {SQL_DOCS}
    SELECT doc_id, side, alias, author_id, md5(full_text) AS text_md5,
           CAST(ROW_NUMBER() OVER (ORDER BY CASE WHEN side = 'query' THEN 0 ELSE 1 END, seq, doc_id) - 1 AS BIGINT)
             AS arrival
    FROM rd""",
)
def q_official_files_resolved(spark, sf):
    """The official layout written under
    ``<fold>/<split>/data``, queries with ``authorIDs`` and candidates with
    ``authorSetIDs``, read with the official readers, numbered queries first
    and resolved through the id map's JSON lines."""
    from quire.session import scratch_path
    from quire.sources import idmap, jsonl

    base = scratch_path(spark, "official")
    root = jsonl.expand_path(base + "/{fold}/{split}", "fold1", EPOCH_SPLIT)
    data = f"{root}/{jsonl.OFFICIAL_DATA_DIR['B']}"
    d = fx.fx_aliased_docs(spark, sf)
    for side, stem, ids in (("query", "queries", "authorIDs"), ("candidate", "candidates", "authorSetIDs")):
        _write_json_lines(d.where(F.col("side") == side), f"{data}/run_input_{stem}.jsonl", ids, F.array("alias"))
    fx.fx_id_map(spark, sf).orderBy("pos").select(
        F.col("map_key").alias("key"), F.col("map_value").alias("value")
    ).write.mode("overwrite").json(f"{root}/idmap")

    cols = ["documentID", "fullText", "alias", "side", "file", "_block", "_row"]
    q = jsonl.read_official_queries(spark, f"{data}/{jsonl.OFFICIAL_QUERIES}").select(*cols)
    c = jsonl.read_official_candidates(spark, f"{data}/{jsonl.OFFICIAL_CANDIDATES}").select(*cols)
    docs = jsonl.with_arrival_seq(q.unionByName(c), out="arrival").withColumn("doc_id", F.col("documentID").cast("bigint"))
    m = authors.build_id_map(idmap.read_id_map_lines(spark, f"{root}/idmap"), "mixed")
    return authors.resolve_authors(docs, m).select(
        "doc_id", "side", "alias", "author_id", F.md5("fullText").alias("text_md5"), "arrival"
    )


@register(
    "id_map_object_ranges",
    """SELECT CASE WHEN conv_id % 3 = 0
                THEN '("(''a' || CAST(conv_id AS VARCHAR) || ''',)", ''HRS1.1'')'
                ELSE '(''a' || CAST(conv_id AS VARCHAR) || ''', ''HRS2.0'')' END AS map_key,
           's' || CAST(conv_id AS VARCHAR) AS map_value,
           CAST(ROW_NUMBER() OVER (ORDER BY conv_id) - 1 AS BIGINT) AS pos
    FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)""",
)
def q_id_map_object_ranges(spark, sf):
    """The id map as JSON objects, read by byte ranges."""
    from quire.session import scratch_path
    from quire.sources import idmap

    base = scratch_path(spark, "idmap")
    idmap.write_id_map_object(fx.fx_id_map(spark, sf).where(F.col("pos").isNotNull()), base)
    return idmap.read_id_map_ranges(spark, base)


FILTER_THRESHOLD = 0.33  # 0.2 would leave almost no author of these tables


@register(
    "filter_then_first_two",
    f"""WITH {SQL_DOCS},
    tok AS (SELECT doc_id, cid, unnest(regexp_split_to_array(lower(full_text), '\\s+')) AS t FROM d),
    bk AS (SELECT doc_id, cid, ('0x' || substr(md5(t), 1, 8))::BIGINT % {TX.DEFAULT_DIM} AS b, COUNT(*) AS c
           FROM tok WHERE t <> '' GROUP BY doc_id, cid, b),
    nrm AS (SELECT doc_id, sqrt(SUM(c * c)) AS nrm FROM bk GROUP BY doc_id),
    dp AS (SELECT x.cid, x.doc_id AS i, y.doc_id AS j, SUM(x.c * y.c) AS dot
           FROM bk x JOIN bk y ON x.cid = y.cid AND x.b = y.b AND x.doc_id < y.doc_id
           GROUP BY x.cid, x.doc_id, y.doc_id),
    alike AS (SELECT DISTINCT dp.cid FROM dp JOIN nrm ni ON ni.doc_id = dp.i JOIN nrm nj ON nj.doc_id = dp.j
              WHERE dot / (ni.nrm * nj.nrm) >= {FILTER_THRESHOLD}),
    kept AS (SELECT cid FROM d GROUP BY cid HAVING COUNT(*) > 1 AND cid NOT IN (SELECT cid FROM alike)),
    t AS (SELECT cid AS author_id, doc_id,
                 ROW_NUMBER() OVER (PARTITION BY cid
                                    ORDER BY CASE WHEN side = 'query' THEN 0 ELSE 1 END, seq, doc_id) AS rn
          FROM d JOIN kept USING (cid)),
    p AS (SELECT author_id, MAX(doc_id) FILTER (WHERE rn = 1) AS anchor_doc_id,
                 MAX(doc_id) FILTER (WHERE rn = 2) AS positive_doc_id
          FROM t GROUP BY author_id),
    r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {hash_key_sql(SEED, 'shuffle', 'author_id')}, author_id) - 1 AS row_pos
          FROM p)
    SELECT r.author_id, CAST(row_pos AS BIGINT) AS row_pos, a.full_text AS anchors, b.full_text AS positives
    FROM r JOIN d a ON a.doc_id = r.anchor_doc_id JOIN d b ON b.doc_id = r.positive_doc_id""",
)
def q_filter_then_first_two(spark, sf):
    """C1 from files to C5: the corpus written as ``train_*.jsonl``, authors
    with too similar documents filtered out (S1, F1, C1), the filtered files
    written (K1), read back as a filtered corpus (S5) and paired (C5)."""
    from quire.plans import files
    from quire.session import scratch_path

    base = scratch_path(spark, "filter_first_two")
    d = fx.fx_docs(spark, sf)
    for side, stem in (("query", "queries"), ("candidate", "candidates")):
        _write_json_lines(
            d.where(F.col("side") == side), f"{base}/corpus/{EPOCH_SPLIT}_{stem}.jsonl", "authorIDs", F.array("author_id")
        )
    files.author_filter_from_jsonl(
        spark, f"{base}/corpus", EPOCH_SPLIT, out_dir=f"{base}/filtered", threshold=FILTER_THRESHOLD
    )
    out = files.first_two_from_filtered(spark, f"{base}/filtered/{{split}}", EPOCH_SPLIT, EPOCH)
    return out.select("author_id", "row_pos", "anchors", "positives")


def _in_file_order(written: DataFrame, out: str) -> DataFrame:
    """Rows of a committed write numbered as the files hold them."""
    from quire.operators.indexing import split_index

    placed = written.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return split_index(placed, ["_file"], "_row", out=out).drop("_file", "_row")


@register(
    "epoch_rows_with_texts",
    f"""WITH {SQL_DOCS}, {SQL_PAIRS_QC}
    SELECT {EPOCH} AS epoch, pair_kind, ep.author_id, CAST(row_pos AS BIGINT) AS row_pos,
           CAST(row_pos AS BIGINT) AS file_pos, a.full_text AS anchors, b.full_text AS positives
    FROM ep JOIN rd a ON a.doc_id = ep.anchor_doc_id JOIN rd b ON b.doc_id = ep.positive_doc_id""",
)
def q_epoch_rows_with_texts(spark, sf):
    """K3 + A8: one epoch of pairs with their texts, written by the epoch feed
    with the number of rows it must have, and read back as the files hold it."""
    from quire.session import scratch_path
    from quire.sources import writers
    from quire.streaming.epochs import write_epochs

    base = scratch_path(spark, "epoch_texts")
    docs = _resolved(spark, sf)

    def build(e):
        ps = P.build_cross_role_pairs(docs, EPOCH_SPLIT, e, strict=False)
        return P.attach_texts(ps.rows, docs, ("row_id",)), ps.expected_rows

    write_epochs(build, [EPOCH], base)
    return _in_file_order(writers.read_committed(spark, base), "file_pos").select(
        F.col("epoch").cast("int").alias("epoch"), "pair_kind", "author_id", "row_pos", "file_pos", "anchors", "positives"
    )


def _sql_epoch_texts(epoch: int) -> str:
    return f"""SELECT * FROM (WITH {SQL_DOCS}, {sql_pairs_qc(epoch)}
    SELECT {epoch} AS epoch, pair_kind, ep.author_id, CAST(row_pos AS BIGINT) AS row_pos,
           a.full_text AS anchors, b.full_text AS positives
    FROM ep JOIN rd a ON a.doc_id = ep.anchor_doc_id JOIN rd b ON b.doc_id = ep.positive_doc_id)"""


@register("epochs_from_stored_texts", " UNION ALL ".join(_sql_epoch_texts(e) for e in (EPOCH, EPOCH + 1)))
def q_epochs_from_stored_texts(spark, sf):
    """C2/C3 + K3: two epochs whose texts come from one bucketed table, so that
    neither epoch shuffles the corpus' text."""
    from quire.operators.textstore import stored_texts
    from quire.session import scratch_path
    from quire.sources import writers
    from quire.streaming.epochs import write_epochs

    base = scratch_path(spark, "epochs_stored")
    docs = _resolved(spark, sf)
    with stored_texts(docs) as texts:

        def build(e):
            ps = P.build_cross_role_pairs(docs, EPOCH_SPLIT, e, strict=False)
            return P.attach_texts(ps.rows, texts, ("row_id",)), ps.expected_rows

        write_epochs(build, [EPOCH, EPOCH + 1], base)
    return writers.read_committed(spark, base).select(
        F.col("epoch").cast("int").alias("epoch"), "pair_kind", "author_id", "row_pos", "anchors", "positives"
    )


@register(
    "labelled_rows_written",
    f"""WITH {SQL_DOCS}, {SQL_LABELS},
    rr AS (SELECT *, CASE WHEN side = 'query' THEN 0 ELSE 1 END AS r FROM rd),
    big AS (SELECT author_id, arg_min(r, (r, seq, doc_id)) AS f_r, arg_min(seq, (r, seq, doc_id)) AS f_seq,
                   arg_min(doc_id, (r, seq, doc_id)) AS f_doc
            FROM rr GROUP BY author_id HAVING COUNT(*) > 5)
    SELECT rr.author_id, doc_id, full_text AS anchors, '' AS others, CAST(lab.label AS BIGINT) AS labels,
           CAST(ROW_NUMBER() OVER (ORDER BY f_r, f_seq, f_doc, rr.r, rr.seq, rr.doc_id) - 1 AS BIGINT) AS file_pos
    FROM rr JOIN big USING (author_id) JOIN lab ON lab.id = rr.author_id""",
)
def q_labelled_rows_written(spark, sf):
    """K4 + A8: labelled rows written in writer order, their number checked
    against the dataset statistics, and read back as the files hold them."""
    from quire.session import scratch_path
    from quire.sources import writers

    base = scratch_path(spark, "labelled")
    docs = _resolved(spark, sf)
    expected = authors.dataset_stats(docs).first()["n_labelled_rows"]
    rows = P.build_labelled_rows(docs, authors.expand_id_map(fx.fx_id_map(spark, sf), "mixed"))
    writers.write_labelled_rows(rows, base, EPOCH_SPLIT, expected)
    return _in_file_order(writers.read_committed(spark, base), "file_pos").select(
        "author_id", "doc_id", "anchors", "others", "labels", "file_pos"
    )
