"""Queries over vectors, search and consolidation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterforge.functions.scalars import recency
from rosterforge.functions.vectors import dot
from rosterforge.operators import consolidate as C
from rosterforge.operators import entity_search as E
from rosterforge.operators import lineups as L
from rosterforge.operators import scope as O
from rosterforge.operators import search as S
from rosterforge.operators import vectors as V
from rosterforge.plans.queries_lineups import counted, lineup_sql, lineups
from rosterforge.plans.registry import query
from rosterforge.plans.storage import materialize
from rosterforge.sources import adapter as A

#: Query of the player-set searches, targets of the adaptive one, and the anchor of the neighbour lists.
PLAYERS, TARGETS, ANCHOR = (2, 3, 5, 7), (4, 9, 15), 7

SCORES = ("rerank_score", "embed_score", "player_overlap", "pair_overlap", "lineup_overlap")

_DOT = "list_dot_product"
_SNAP = A.with_frames("snapshot")


def _vec(name: str, value: str) -> str:
    return f", {name} AS (SELECT {value} AS v)"


@query()
def semantic_vectors(spark, d):
    support = L.player_support(counted(spark, d))
    return V.dense(V.semantic_cells(counted(spark, d), V.hashed_players(support)), "team_id", 64)


@query()
def identity_vectors(spark, d):
    support = L.player_support(counted(spark, d))
    return V.dense(V.identity_cells(support, L.player_idf(support), V.hashed_players(support)), "team_id", 256)


@query()
def final_vectors(spark, d):
    support = L.player_support(counted(spark, d))
    return V.team_vectors(counted(spark, d), support, L.player_idf(support)).select("team_id", "final_vector")


def anchor_vector(spark, d, vector="final_vector"):
    return A.snapshot(spark, d).where(f"team_id = {ANCHOR}").select(vector).collect()[0][0]  # one row


@query(_SNAP + f", q AS (SELECT * FROM snapshot WHERE team_id = {ANCHOR}) SELECT s.team_id, round({_DOT}(s.final_vector, q.final_vector), 5) AS similarity, "
       f"round({_DOT}(s.semantic_vector, q.semantic_vector), 5) AS semantic, round({_DOT}(s.identity_vector, q.identity_vector), 5) AS ident "
       f"FROM snapshot s, q WHERE s.team_id <> {ANCHOR} ORDER BY {_DOT}(s.final_vector, q.final_vector) DESC, s.team_id LIMIT 20")
def vector_neighbors(spark, d):
    from rosterforge.functions.vectors import literal

    near = V.neighbors(A.snapshot(spark, d), anchor_vector(spark, d), 20, [ANCHOR])
    part = lambda v: F.round(dot(F.col(f"{v}_vector"), literal(anchor_vector(spark, d, f"{v}_vector"))), 5)
    return near.select("team_id", F.round("similarity", 5).alias("similarity"), part("semantic").alias("semantic"), part("identity").alias("ident"))


@query(_SNAP + f", q AS (SELECT * FROM snapshot WHERE team_id = {ANCHOR}) SELECT s.team_id, round(1 - {_DOT}(s.final_vector, q.final_vector) / (sqrt({_DOT}(s.final_vector, s.final_vector)) * sqrt({_DOT}(q.final_vector, q.final_vector))), 5) + 0.0::DOUBLE AS distance "
       f"FROM snapshot s, q WHERE s.team_id <> {ANCHOR} ORDER BY {_DOT}(s.final_vector, q.final_vector) / sqrt({_DOT}(s.final_vector, s.final_vector)) DESC, s.team_id LIMIT 15")
def cosine_nearest(spark, d):
    rows = A.snapshot(spark, d).where(f"team_id <> {ANCHOR}")
    return V.nearest_by_cosine_distance(rows, anchor_vector(spark, d), 15).select("team_id", (F.round("distance", 5) + 0.0).alias("distance"))


@query(_SNAP + f", q AS (SELECT * FROM snapshot WHERE team_id = {ANCHOR}), b AS (SELECT s.team_id, 0.35::DOUBLE * {_DOT}(s.semantic_vector, q.semantic_vector) + 0.65::DOUBLE * {_DOT}(s.identity_vector, q.identity_vector) AS x FROM snapshot s, q WHERE s.team_id <> {ANCHOR}) "
       "SELECT team_id, round(x, 5) AS blended FROM b ORDER BY x DESC, team_id LIMIT 20")
def blended_neighbors(spark, d):
    from rosterforge.functions.vectors import literal

    s, i = (literal(anchor_vector(spark, d, f"{v}_vector")) for v in ("semantic", "identity"))
    score = V.blended_score(dot(F.col("semantic_vector"), s), dot(F.col("identity_vector"), i), 0.35)
    rows = A.snapshot(spark, d).where(f"team_id <> {ANCHOR}").withColumn("x", score)
    return rows.orderBy(F.desc("x"), "team_id").limit(20).select("team_id", F.round("x", 5).alias("blended"))


_PROFILE = _SNAP + f""", t AS (SELECT *, least(1, greatest(0, 0.60::DOUBLE * top_lineup_share + 0.40::DOUBLE * (1 - lineup_entropy))) AS steady FROM snapshot WHERE team_id IN {TARGETS}),
w AS (SELECT *, sqrt(greatest(lineup_count, 1)) * (0.75::DOUBLE + 0.25::DOUBLE * steady) AS w FROM t),
st AS (SELECT sum(w * steady) / sum(w) AS qs FROM w), wt AS (SELECT least(0.85::DOUBLE, greatest(0.20::DOUBLE, 0.15::DOUBLE + 0.70::DOUBLE * qs)) AS wi FROM st),
cs AS (SELECT list(x ORDER BY i) AS v FROM (SELECT i, sum(w * semantic_vector[i]) / sum(w) AS x FROM w, range(1, 33) r(i) GROUP BY i)), ci AS (SELECT list(x ORDER BY i) AS v FROM (SELECT i, sum(w * identity_vector[i]) / sum(w) AS x FROM w, range(1, 33) r(i) GROUP BY i)),
e AS (SELECT s.team_id, event_time_ms, (1 - wi) * {_DOT}(s.semantic_vector, cs.v) / sqrt({_DOT}(cs.v, cs.v)) + wi * {_DOT}(s.identity_vector, ci.v) / sqrt({_DOT}(ci.v, ci.v)) AS embed_score FROM snapshot s, cs, ci, wt)
"""


def targets(spark, d):
    return A.snapshot(spark, d).where(F.col("team_id").isin(*TARGETS))


@query(_PROFILE + "SELECT team_id, round(embed_score, 5) AS embed_score FROM e ORDER BY e.embed_score DESC, team_id LIMIT 25")
def adaptive_rank(spark, d):
    r = V.adaptive_rank(A.snapshot(spark, d), targets(spark, d))
    return r.orderBy(F.desc("embed_score"), "team_id").limit(25).select("team_id", F.round("embed_score", 5).alias("embed_score"))


@query(_PROFILE + """, n AS (SELECT max(event_time_ms) AS m FROM snapshot), x AS (SELECT team_id, 0.7::DOUBLE * embed_score + 0.3::DOUBLE * exp(-0.693::DOUBLE * ((m - event_time_ms) / 86400000.0::DOUBLE) / 90.0::DOUBLE) AS s FROM e, n)
SELECT team_id, round(s, 5) AS embed_score FROM x ORDER BY s DESC, team_id LIMIT 25""")
def recency_rank(spark, d):
    r = V.adaptive_rank(A.snapshot(spark, d), targets(spark, d), recency_weight=0.3)
    return r.orderBy(F.desc("embed_score"), "team_id").limit(25).select("team_id", F.round("embed_score", 5).alias("embed_score"))


@query(_PROFILE + "SELECT team_id, round(embed_score, 5) AS embed_score FROM e WHERE e.embed_score >= 0.25")
def relevance_threshold(spark, d):
    r = V.above_threshold(V.adaptive_rank(A.snapshot(spark, d), targets(spark, d)), 0.25)
    return r.select("team_id", F.round("embed_score", 5).alias("embed_score"))


@query(_PROFILE + """, c AS (SELECT count(*) FILTER (WHERE embed_score >= 0.66) AS s, count(*) FILTER (WHERE embed_score >= 0.5) AS l FROM e), r AS (SELECT s < 3 AND l > s AS relax FROM c)
SELECT team_id, round(embed_score, 5) AS embed_score, relax AS relevance_relaxed FROM e, r WHERE e.embed_score >= CASE WHEN relax THEN 0.5 ELSE 0.66 END""")
def relevance_relaxed(spark, d):
    r = V.relaxed_threshold(V.adaptive_rank(A.snapshot(spark, d), targets(spark, d)), 0.66)
    return r.select("team_id", F.round("embed_score", 5).alias("embed_score"), "relevance_relaxed")


_WEIGHTS = f""", idf AS (SELECT player_id, greatest(least(ln(((SELECT count(DISTINCT team_id) FROM support) + 1.0::DOUBLE) / (count(DISTINCT team_id) + 1.0::DOUBLE)), 3.0::DOUBLE), 1e-9::DOUBLE) AS w FROM support GROUP BY player_id),
qw AS (SELECT p AS player_id, coalesce(w, 1.0::DOUBLE) AS w FROM (SELECT unnest({list(PLAYERS)}) AS p) LEFT JOIN idf ON player_id = p),
pov AS (SELECT team_id, sum(w * support) / (SELECT sum(w) FROM qw) AS x FROM support JOIN qw USING (player_id) GROUP BY team_id),
qp AS (SELECT a.player_id AS lo, b.player_id AS hi, a.w * b.w AS w FROM qw a JOIN qw b ON a.player_id < b.player_id),
psup AS (SELECT team_id, lo, hi, sum(n)::DOUBLE / any_value(total) AS support FROM (SELECT team_id, n, lo, unnest(lineup) AS hi FROM (SELECT team_id, n, lineup, unnest(lineup) AS lo FROM variants)) JOIN totals USING (team_id) WHERE lo < hi GROUP BY team_id, lo, hi),
prov AS (SELECT team_id, sum(w * support) / (SELECT sum(w) FROM qp) AS x FROM psup JOIN qp USING (lo, hi) GROUP BY team_id),
lov AS (SELECT team_id, max(CASE WHEN shared = 4 AND len(lineup) = 4 THEN n::DOUBLE / total WHEN {{near}} THEN n::DOUBLE / total * shared / least(len(lineup), 4) END) AS x
  FROM (SELECT *, len(list_intersect(lineup, {list(PLAYERS)}::BIGINT[])) AS shared FROM variants JOIN totals USING (team_id)) GROUP BY team_id)
"""
#: Near match of a lineup of 2..6 players with a signature of four, in SQL over `lineup` and `shared`.
_NEAR4 = ("least(len(lineup), 4) >= 3 AND abs(len(lineup) - 4) <= 2 AND len(lineup) + 4 - 2 * shared <= 2 + least(abs(len(lineup) - 4), 1) "
          "AND shared >= greatest(3, least(len(lineup), 4) - 1)")
_OVERLAPS = lineup_sql(2, 6) + _WEIGHTS.format(near=_NEAR4)


def wide_counted(spark, d):
    return L.variants(lineups(spark, d, 2, 6))


def profile(spark, d, support):
    idf = {r["player_id"]: r["idf"] for r in L.player_idf(support).where(F.col("player_id").isin(*PLAYERS)).collect()}  # one row a query player
    return S.player_profile(PLAYERS, idf)


@query(_OVERLAPS + "SELECT team_id, round(x, 6) AS player_overlap FROM pov")
def player_overlap(spark, d):
    support = L.player_support(wide_counted(spark, d))
    return S.player_overlap(support, profile(spark, d, support).weights).withColumn("player_overlap", F.round("player_overlap", 6))


@query(_OVERLAPS + "SELECT team_id, round(x, 6) AS pair_overlap FROM prov")
def pair_overlap(spark, d):
    counts = wide_counted(spark, d)
    p = profile(spark, d, L.player_support(counts))
    return S.pair_overlap(L.pair_support(counts), p.pair_weights).withColumn("pair_overlap", F.round("pair_overlap", 6))


@query(_OVERLAPS + "SELECT team_id, round(x, 6) AS lineup_overlap FROM lov WHERE x IS NOT NULL")
def lineup_overlap(spark, d):
    out = S.lineup_overlap(wide_counted(spark, d), [PLAYERS])
    return out.where("lineup_overlap > 0").withColumn("lineup_overlap", F.round("lineup_overlap", 6))


_RERANK = _OVERLAPS.replace("WITH appearances", "WITH snapshot AS (" + A.FRAMES["snapshot"] + "), appearances", 1) + f""", q AS (SELECT final_vector FROM snapshot WHERE team_id = {ANCHOR}),
b AS (SELECT s.team_id, lineup_count, {_DOT}(s.final_vector, q.final_vector) AS e, coalesce(pov.x, 0) AS p, coalesce(prov.x, 0) AS pr, coalesce(lov.x, 0) AS l
  FROM snapshot s CROSS JOIN q LEFT JOIN pov USING (team_id) LEFT JOIN prov USING (team_id) LEFT JOIN lov USING (team_id)),
c AS (SELECT *, least(1, greatest(0, 0.7::DOUBLE * e + 0.15::DOUBLE * p + 0.15::DOUBLE * pr)) AS base FROM b),
r AS (SELECT *, CASE WHEN l > 0 THEN least(1, greatest(0, base + 0.35::DOUBLE * l * (1 - base))) ELSE base END AS rr FROM c)
SELECT team_id, round(rr, 5) AS rerank_score, round(e, 5) AS embed_score FROM r ORDER BY round(rr, 9) DESC, round(l, 9) DESC, round(e, 9) DESC, lineup_count DESC, team_id LIMIT 30"""


@query(_RERANK)
def rerank_score(spark, d):
    counts = wide_counted(spark, d)
    support = L.player_support(counts)
    p = profile(spark, d, support)
    p.vector = list(anchor_vector(spark, d))
    index = S.Index(A.snapshot(spark, d), support, L.pair_support(counts), counts)
    found = S.whole_set_search(index, p, min_score=-1.0, rerank_limit=1_000_000)
    keyed = found.withColumns({k: F.round(k, 9) for k in ("rerank_score", "lineup_overlap", "embed_score")})
    return keyed.orderBy(*S.best_first()).limit(30).select("team_id", F.round("rerank_score", 5).alias("rerank_score"), F.round("embed_score", 5).alias("embed_score"))


def index_of(spark, d):
    counts = counted(spark, d)
    support = L.player_support(counts)
    vectors = V.team_vectors(counts, support, L.player_idf(support))
    totals = counts.groupBy("team_id").agg(F.sum("n").alias("lineup_count"))
    return S.Index(vectors.join(totals, "team_id").select("team_id", "final_vector", "lineup_count"), support, L.pair_support(counts), counts)


@query()
def whole_set_search(spark, d):
    index = index_of(spark, d)
    return S.whole_set_search(index, profile(spark, d, index.support)).orderBy(*S.best_first()).limit(20).select(
        "team_id", *(F.round(c, 5).alias(c) for c in ("rerank_score", "embed_score", "player_overlap", "pair_overlap", "lineup_overlap")))


def rosters(spark, d):
    """team_id, player_id, lineup_count, roster_size."""
    support = L.player_support(wide_counted(spark, d))
    per = support.groupBy("team_id").agg(F.count(F.lit(1)).alias("roster_size"))
    totals = wide_counted(spark, d).groupBy("team_id").agg(F.sum("n").alias("lineup_count"))
    return support.select("team_id", "player_id").join(per, "team_id").join(totals, "team_id")


@query()
def subset_projection(spark, d):
    out = S.subset_projection(rosters(spark, d), (2, 3, 5, 7, 8, 9, 10))
    return out.orderBy(F.desc("score"), F.desc("hits"), "team_id").limit(20).withColumn("score", F.round("score", 5))


_ROSTER = lineup_sql(2, 6) + ", rs AS (SELECT team_id, count(*) AS size FROM support GROUP BY 1)"


@query(_ROSTER + f", h AS (SELECT team_id, count(*) AS overlap FROM support WHERE player_id IN {PLAYERS} GROUP BY 1) SELECT team_id, overlap, total AS lineup_count FROM h JOIN totals USING (team_id) ORDER BY overlap DESC, lineup_count DESC, team_id LIMIT 50")
def targets_by_players(spark, d):
    return S.targets_by_players(rosters(spark, d), PLAYERS)


@query(_ROSTER + f""", h AS (SELECT team_id, count(*) AS overlap, any_value(size) AS size FROM support JOIN rs USING (team_id) WHERE player_id IN {PLAYERS} GROUP BY 1),
q AS (SELECT *, 2.0::DOUBLE * (overlap / size::DOUBLE) * (overlap / 4.0::DOUBLE) / (overlap / size::DOUBLE + overlap / 4.0::DOUBLE) AS f1 FROM h), g AS (SELECT *, f1 * f1 * (1 + overlap / 4.0::DOUBLE) AS quality FROM q)
SELECT team_id, overlap, round(quality, 6) AS quality FROM g WHERE overlap >= (SELECT max(overlap) FROM g) - 1 AND quality >= 0.4::DOUBLE * (SELECT max(quality) FROM g)""")
def seed_quality(spark, d):
    return S.seed_quality(rosters(spark, d), PLAYERS).withColumn("quality", F.round("quality", 6))


# Consolidation over the top lineups of four to six players.

_TOP = lineup_sql(3, 6) + """, st AS (SELECT team_id, sum(n)::BIGINT AS lineup_count, count(*) AS distinct_lineup_count, max(n)::DOUBLE / sum(n) AS top_lineup_share FROM variants GROUP BY 1),
top AS MATERIALIZED (SELECT team_id, lineup, lineup_count, distinct_lineup_count, top_lineup_share FROM variants JOIN st USING (team_id) QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY n DESC, lineup) = 1),
sh AS MATERIALIZED (SELECT a.team_id AS a, b.team_id AS b, a.lineup AS la, b.lineup AS lb, len(list_intersect(a.lineup, b.lineup)) AS s, a.lineup_count AS ca, b.lineup_count AS cb, a.distinct_lineup_count AS da, b.distinct_lineup_count AS db, a.top_lineup_share AS ta, b.top_lineup_share AS tb
  FROM top a JOIN top b ON a.team_id < b.team_id AND list_has_any(a.lineup, b.lineup)),
nm AS (SELECT *, len(la) + len(lb) - 2 * s <= 2 * (CASE WHEN least(len(la), len(lb)) <= 4 THEN 1 ELSE 1 + (least(len(la), len(lb)) - 4) // 3 END) + least(abs(len(la) - len(lb)), 1)
  AND abs(len(la) - len(lb)) <= 2 AND s >= greatest(3, least(len(la), len(lb)) - (CASE WHEN least(len(la), len(lb)) <= 4 THEN 1 ELSE 1 + (least(len(la), len(lb)) - 4) // 3 END)) AS near FROM sh),
el AS (SELECT a, b FROM nm WHERE la = lb OR near OR (s::DOUBLE / (len(la) + len(lb) - s) >= 0.72 AND abs(ca - cb) <= greatest(5, floor(0.35::DOUBLE * greatest(ca, cb, 1))) AND abs(da - db) <= 2.5 AND abs(ta - tb) <= 0.3::DOUBLE))
"""


def top_rows(spark, d, counts=None):
    counts = L.variants(lineups(spark, d, 3, 6)) if counts is None else counts
    stats = counts.groupBy("team_id").agg(F.sum("n").alias("lineup_count"), F.count(F.lit(1)).alias("distinct_lineup_count"), (F.max("n") / F.sum("n")).alias("top_lineup_share"))
    return L.top_lineup(counts).drop("n").join(stats, "team_id")


@query(_TOP + "SELECT a, b FROM nm WHERE near")
def near_match_pairs(spark, d):
    return C.near_match_pairs(top_rows(spark, d))


@query(_TOP + "SELECT a, b FROM el")
def consolidation_pairs(spark, d):
    return C.eligible_pairs(top_rows(spark, d))


_SCOPES = _TOP + """, gr AS MATERIALIZED (SELECT a AS t, b AS m FROM el UNION SELECT b, a FROM el UNION SELECT team_id, team_id FROM top),
nmd AS (SELECT c_custkey + 1 AS m, c_mktsegment AS name, greatest(coalesce(lineup_count, 0), 1) AS w FROM customer LEFT JOIN top ON team_id = c_custkey + 1),
sz AS (SELECT t, count(*) AS size FROM gr GROUP BY 1),
gn AS (SELECT t, name FROM (SELECT t, name, sum(w) AS w FROM gr JOIN nmd USING (m) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY t ORDER BY w DESC, length(name), name DESC) = 1),
an AS MATERIALIZED (SELECT gr.t, gr.m AS anchor FROM gr JOIN gn USING (t) JOIN nmd ON nmd.m = gr.m AND nmd.name = gn.name QUALIFY row_number() OVER (PARTITION BY gr.t ORDER BY gr.m) <= 12),
vo AS MATERIALIZED (SELECT an.t, gr.m, count(*) AS votes FROM an JOIN gr ON gr.t = an.anchor GROUP BY 1, 2),
ag AS MATERIALIZED (SELECT t, m FROM vo JOIN (SELECT t, count(*) AS k FROM an GROUP BY 1) USING (t) WHERE votes >= 2 AND votes * 2 > k),
ok AS MATERIALIZED (SELECT t FROM ag GROUP BY t HAVING count(*) > 1 AND bool_or(m = t)),
le AS (SELECT an.t, anchor FROM an JOIN sz ON sz.t = anchor QUALIFY row_number() OVER (PARTITION BY an.t ORDER BY size, anchor) = 1),
sc AS MATERIALIZED (SELECT t, m FROM gr JOIN sz USING (t) WHERE size = 1 UNION ALL SELECT t, m FROM ag JOIN ok USING (t)
  UNION ALL SELECT le.t, gr.m FROM le JOIN sz ON sz.t = le.t AND size > 1 JOIN gr ON gr.t = le.anchor WHERE le.t NOT IN (SELECT t FROM ok)),
sn AS (SELECT t, name FROM (SELECT t, name, sum(w) AS w FROM sc JOIN nmd USING (m) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY t ORDER BY w DESC, length(name), name DESC) = 1)
SELECT t AS team_id, m AS member, name AS scope_name FROM sc JOIN sn USING (t)"""


@query(_SCOPES)
def family_scopes(spark, d):
    """Scopes of all teams: their groups are the teams they may be consolidated with, their names the market segments, which many share."""
    rows = materialize(top_rows(spark, d))
    pairs = materialize(C.eligible_pairs(rows))
    both = pairs.select(F.col("a").alias("team_id"), F.col("b").alias("member")).unionByName(pairs.select(F.col("b").alias("team_id"), F.col("a").alias("member")))
    groups = both.unionByName(rows.select("team_id", F.col("team_id").alias("member")))
    segments = A.read(spark, d, "customer").select((F.col("c_custkey") + 1).alias("team_id"), F.col("c_mktsegment").alias("name"))
    return O.consensus_scopes(groups, segments.join(rows.select("team_id", "lineup_count"), "team_id", "left"))


def recursive(sql: str, edges: str, nodes: str, tail: str) -> str:
    """Components of edges by a recursive closure, as comp(team_id, group_id), then tail."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) + f""", ed AS MATERIALIZED (SELECT a AS x, b AS y FROM {edges} UNION SELECT b, a FROM {edges}),
rc AS (SELECT x AS n, x AS r FROM ed UNION SELECT ed.y, rc.r FROM rc JOIN ed ON ed.x = rc.n),
comp AS (SELECT t.team_id, coalesce(min(r), t.team_id) AS group_id FROM {nodes} t LEFT JOIN rc ON rc.n = t.team_id GROUP BY t.team_id) {tail}"""


_CLUSTERS = """, sz AS (SELECT group_id, count(*) AS cluster_size FROM comp GROUP BY 1 HAVING count(*) >= 2), num AS (SELECT *, row_number() OVER (ORDER BY cluster_size DESC, group_id) - 1 AS cluster_id FROM sz)
SELECT team_id, cluster_id, cluster_size FROM comp JOIN num USING (group_id)"""


@query(recursive(_TOP, "el", "top", "SELECT group_id, count(*) AS members, sum(lineup_count)::BIGINT AS lineup_count, array_to_string(list_sort(list(team_id)), ',') AS team_ids FROM comp JOIN top USING (team_id) GROUP BY 1"))
def consolidated_groups(spark, d):
    rows = top_rows(spark, d)
    out = C.merged_groups(rows, C.groups(rows, C.eligible_pairs(rows)))
    return out.withColumn("team_ids", F.array_join(F.col("team_ids").cast("array<string>"), ","))


@query(recursive(_TOP, "el", "top", _CLUSTERS))
def family_clusters(spark, d):
    rows = top_rows(spark, d)
    return C.clusters(rows, C.eligible_pairs(rows))


@query(recursive(_SNAP + f", sim AS MATERIALIZED (SELECT a.team_id AS a, b.team_id AS b FROM snapshot a JOIN snapshot b ON a.team_id < b.team_id WHERE {_DOT}(a.final_vector, b.final_vector) >= 0.4)", "sim", "snapshot", _CLUSTERS))
def vector_union_clusters(spark, d):
    rows = A.snapshot(spark, d)
    return C.clusters(rows, C.similar_links(rows, 0.4))


_HYBRID = _TOP.replace("WITH appearances", "WITH snapshot AS (" + A.FRAMES["snapshot"] + "), appearances", 1) + f""", ro AS (SELECT team_id, list(player_id) AS players FROM support GROUP BY 1),
hv AS MATERIALIZED (SELECT a.team_id AS a, b.team_id AS b FROM snapshot a JOIN snapshot b ON a.team_id < b.team_id JOIN ro ra ON ra.team_id = a.team_id JOIN ro rb ON rb.team_id = b.team_id
  WHERE {_DOT}(a.final_vector, b.final_vector) >= 0.3 AND len(list_intersect(ra.players, rb.players)) >= 0.2 * least(len(ra.players), len(rb.players))),
he AS MATERIALIZED (SELECT a, b FROM el JOIN snapshot x ON x.team_id = a JOIN snapshot y ON y.team_id = b UNION SELECT a, b FROM hv)"""


@query(recursive(_HYBRID, "he", "(SELECT team_id FROM snapshot JOIN top USING (team_id))", _CLUSTERS))
def hybrid_clusters(spark, d):
    vectors = A.snapshot(spark, d).select("team_id", "final_vector")
    counts = materialize(L.variants(lineups(spark, d, 3, 6)).join(vectors.select("team_id"), "team_id", "left_semi"))
    rows = materialize(top_rows(spark, d, counts).join(vectors, "team_id"))
    return C.clusters(rows, C.hybrid_links(rows, L.roster(L.player_support(counts)), 0.3, 0.2))


@query()
def greedy_clusters_strict(spark, d):
    return C.greedy_clusters(A.snapshot(spark, d), 0.40, 3)


@query()
def greedy_clusters_explore(spark, d):
    return C.greedy_clusters(A.snapshot(spark, d), 0.35, 2)


@query()
def rescored_groups(spark, d):
    """Groups of the search result, scored by their centroid, merged supports and best member."""
    index = index_of(spark, d)
    p = profile(spark, d, index.support)
    out = E.rescored(S.whole_set_search(index, p), top_rows(spark, d), index, p)
    return out.select("group_id", "lineup_count", *(F.round(c, 5).alias(c) for c in SCORES))


@query()
def entity_search(spark, d):
    """The whole search: retrieval, widening, consolidation, rescoring, order and cut."""
    index = index_of(spark, d)
    out = E.entity_search(index, top_rows(spark, d), profile(spark, d, index.support), top_n=10)
    return out.select("place", "group_id", "team_id", "team_ids", "relaxed", "lineup_count", *(F.round(c, 5).alias(c) for c in SCORES))


_MEMBERS = A.with_frames("tournament_teams", "snapshot") + """, m AS (SELECT cluster_id, team_id, name, lineup_count, event_time_ms + tournament_id AS event_time_ms FROM tournament_teams JOIN snapshot USING (team_id)),
ex AS (SELECT cluster_id, name, sum(lineup_count) AS weight, max(event_time_ms) AS latest FROM m GROUP BY 1, 2)"""


def named_members(spark, d):
    m = A.tournament_teams(spark, d).join(A.snapshot(spark, d), "team_id")
    return m.select("cluster_id", "team_id", "name", "lineup_count", (F.col("event_time_ms") + F.col("tournament_id")).alias("event_time_ms"))


@query(_MEMBERS + """, bk AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '\\([^)]*\\)|\\[[^\\]]*\\]|\\{[^}]*\\}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS bucket FROM ex),
wb AS (SELECT cluster_id, bucket, max(weight) AS most FROM bk GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY sum(weight) DESC, max(latest) DESC, bucket) = 1)
SELECT cluster_id, name FROM bk JOIN wb USING (cluster_id, bucket) WHERE weight >= greatest(1, ceil(most * 0.4))
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN regexp_matches(name, '[\\(\\[\\{]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(name, '\\s[-:/|]\\s') THEN 1 ELSE 0 END, weight DESC, latest DESC, length(name), lower(name)) = 1""")
def representative_names(spark, d):
    return C.representative_names(named_members(spark, d), family=True)


@query(_MEMBERS + "SELECT cluster_id, name FROM ex QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, lower(name), name) = 1")
def representative_names_exact(spark, d):
    return C.representative_names(named_members(spark, d), family=False)


@query(_MEMBERS + "SELECT cluster_id AS group_id, name FROM ex QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, length(name), lower(name), name) = 1")
def canonical_name(spark, d):
    return C.canonical_name(named_members(spark, d).withColumnRenamed("cluster_id", "group_id"))


@query(_SNAP + ", n AS (SELECT max(event_time_ms) AS m FROM snapshot) SELECT team_id, round(exp(-0.693::DOUBLE * ((m - event_time_ms) / 86400000.0::DOUBLE) / 90.0::DOUBLE), 6) AS recency FROM snapshot, n")
def recency_scores(spark, d):
    s = A.snapshot(spark, d)
    newest = s.agg(F.max("event_time_ms").alias("m"))
    return s.join(F.broadcast(newest)).select("team_id", F.round(recency(F.col("event_time_ms"), F.col("m")), 6).alias("recency"))
