"""Queries of boosted trees and forests out of fold, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtab.operators import trees as T
from voxtab.plans.queries_learning import embedded
from voxtab.plans.registry import query, rounded

DIMS, CLASSES, FOLDS, SIDED = 64, 10, 5, 8
ROUNDS, DEPTH, RATE = 2, 2, 0.3
TREES, TRIED, FOREST_DEPTH = 3, 8, 3

#: DuckDB: rows and their mirror images with bins, one row per feature, and the weights of classes per held-out fold.
BINNED = {
    "o": "SELECT vec_id AS id, CAST(label AS INT) AS label, (vec_id // 3) % 5 AS fold, [v::DOUBLE FOR v IN embedding] AS x FROM embeddings",
    "e": "SELECT id, 0 AS copy, fold, label, x FROM o UNION ALL SELECT id, 1, fold, CASE WHEN label < 8 THEN xor(label, 1) ELSE label END, [x[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END] FOR i IN range(1, 65)] FROM o",
    "f": "SELECT id, copy, CAST(d AS INT) AS d, x[d] AS v FROM e, range(1, 65) t(d)",
    "w": "SELECT d, min(v) AS lo, (max(v) - min(v)) / 16 AS width FROM f GROUP BY 1",
    "b": "SELECT id, copy, d - 1 AS d, CAST(CASE WHEN width > 0 AND v IS NOT NULL THEN least(floor((v - lo) / width), 15) ELSE 0 END AS INT) AS bin FROM f JOIN w USING (d)",
    "k": "SELECT m.m, label, count(*) AS n FROM e, range(5) m(m) WHERE fold <> m.m GROUP BY 1, 2",
}


def _tables(body: str, parts: dict[str, str]) -> str:
    """Every table is computed once, as most are read several times."""
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in (BINNED | parts).items()) + " " + body


def _boosted_sql() -> str:
    parts = {
        "q": "SELECT m, label, (sum(n) OVER (PARTITION BY m)) / (n * count(*) OVER (PARTITION BY m)) AS w FROM k",
        "s0": "SELECT CAST(m.m AS INT) AS m, id, copy, fold, label, CAST(c.c AS INT) AS c, 0::DOUBLE AS s FROM e, range(5) m(m), range(10) c(c) WHERE fold <> m.m OR copy = 0",
    }
    for r in range(ROUNDS):
        parts[f"p{r}"] = f"SELECT *, u / sum(u) OVER (PARTITION BY m, id, copy) AS p FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY m, id, copy)) AS u FROM s{r})"
        parts[f"a{r}_0"] = f"SELECT m, id, copy, c, fold <> m AS tr, 0 AS node, CAST(floor(w * (p - (label = c)::INT) * {T.UNIT} + 0.5) AS BIGINT) AS g, CAST(floor(w * p * (1 - p) * {T.UNIT} + 0.5) AS BIGINT) AS h FROM p{r} JOIN q USING (m, label)"
        leaves = []
        for l in range(DEPTH + 1):
            a = f"a{r}_{l}"
            if l < DEPTH:
                parts[f"h{r}_{l}"] = f"SELECT m, c, node, d, bin, sum(g)::DOUBLE / {T.UNIT} AS g, sum(h)::DOUBLE / {T.UNIT} AS h, count(*) AS k FROM {a} JOIN b USING (id, copy) WHERE tr GROUP BY ALL"
                parts[f"c{r}_{l}"] = f"SELECT *, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(k) OVER o AS kl, sum(g) OVER t AS gt, sum(h) OVER t AS ht, sum(k) OVER t AS kt FROM h{r}_{l} WINDOW o AS (PARTITION BY m, c, node, d ORDER BY bin), t AS (PARTITION BY m, c, node, d)"
                gain = "round(gl*gl/(hl+1) + (gt-gl)*(gt-gl)/(ht-hl+1) - gt*gt/(ht+1), 9)"
                parts[f"d{r}_{l}"] = f"SELECT m, c, node, d, bin AS cut FROM (SELECT *, row_number() OVER (PARTITION BY m, c, node ORDER BY {gain} DESC, d, bin) AS rk FROM c{r}_{l} WHERE kl >= 3 AND kt - kl >= 3 AND {gain} > 0) WHERE rk = 1"
                parts[f"a{r}_{l + 1}"] = f"SELECT m, id, copy, c, tr, 2 * node + 1 + (bin > cut)::INT AS node, g, h FROM {a} JOIN d{r}_{l} USING (m, c, node) JOIN b USING (id, copy, d)"
                leaves.append(f"SELECT * FROM {a} ANTI JOIN d{r}_{l} USING (m, c, node)")
            else:
                leaves.append(f"SELECT * FROM {a}")
        parts[f"l{r}"] = f"SELECT m, id, copy, c, -{RATE}::DOUBLE * ((sum(g) FILTER (tr) OVER n)::DOUBLE / {T.UNIT}) / ((sum(h) FILTER (tr) OVER n)::DOUBLE / {T.UNIT} + 1) AS leaf FROM ({' UNION ALL '.join(leaves)}) WINDOW n AS (PARTITION BY m, c, node)"
        parts[f"s{r + 1}"] = f"SELECT s.m, s.id, s.copy, s.fold, s.label, s.c, s.s + coalesce(l.leaf, 0) AS s FROM s{r} s LEFT JOIN l{r} l USING (m, id, copy, c)"
    return _tables(
        f"SELECT id AS vec_id, label, c AS cls, round(u / sum(u) OVER (PARTITION BY id), 6) AS p FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY id)) AS u FROM s{ROUNDS} WHERE fold = m AND copy = 0)", parts
    )


def _forest_sql() -> str:
    draw = "((id * 7919 + t.t * 104729 + id * t.t * 31) % 1000)"
    parts = {
        "q": "SELECT m, label AS c, (sum(n) OVER (PARTITION BY m)) / (n * 10) AS w FROM k",
        "a0": f"SELECT * FROM (SELECT CAST(m.m AS INT) AS m, CAST(t.t AS INT) AS t, id, copy, label AS c, fold <> m.m AS tr, 0 AS node, CASE WHEN {draw} < 368 THEN 0 WHEN {draw} < 736 THEN 1 WHEN {draw} < 920 THEN 2 WHEN {draw} < 981 THEN 3 ELSE 4 END AS times FROM e, range(5) m(m), range({TREES}) t(t) WHERE fold <> m.m OR copy = 0) WHERE times > 0 OR NOT tr",
        "few": f"SELECT t, node, d FROM (SELECT CAST(t.t AS INT) AS t, CAST(n.n AS INT) AS node, CAST(d.d AS INT) AS d, row_number() OVER (PARTITION BY t.t, n.n ORDER BY (d.d * 7919 + (t.t * 64 + n.n + 1) * 104729 + d.d * (t.t * 64 + n.n + 1) * 31) % 1000, d.d) AS rk FROM range({TREES}) t(t), range({2**FOREST_DEPTH}) n(n), range({DIMS}) d(d)) WHERE rk <= {TRIED}",
    }
    leaves = []
    for l in range(FOREST_DEPTH + 1):
        a = f"a{l}"
        if l < FOREST_DEPTH:
            parts[f"h{l}"] = f"SELECT m, t, node, d, bin, c, sum(times) AS k FROM {a} JOIN few USING (t, node) JOIN b USING (id, copy, d) WHERE tr GROUP BY ALL"
            parts[f"g{l}"] = f"SELECT x.m, x.t, x.node, x.d, x.bin, y.c, coalesce(h.k, 0) AS k FROM (SELECT DISTINCT m, t, node, d, bin FROM h{l}) x JOIN (SELECT DISTINCT m, t, node, d, c FROM h{l}) y USING (m, t, node, d) LEFT JOIN h{l} h USING (m, t, node, d, bin, c)"
            parts[f"c{l}"] = f"SELECT m, t, node, d, bin, sum(k) OVER (PARTITION BY m, t, node, d, c ORDER BY bin) AS kl, sum(k) OVER (PARTITION BY m, t, node, d, c) AS kt, w FROM g{l} JOIN q USING (m, c)"
            gini = lambda x: f"(sum({x}*w) - sum({x}*w*{x}*w) / nullif(sum({x}*w), 0))"
            gain = f"round(coalesce({gini('kt')}, 0) - coalesce({gini('kl')}, 0) - coalesce({gini('(kt-kl)')}, 0), 9)"
            parts[f"v{l}"] = f"SELECT m, t, node, d, bin, {gain} AS gain FROM c{l} GROUP BY ALL HAVING sum(kl) >= 1 AND sum(kt-kl) >= 1"
            parts[f"d{l}"] = f"SELECT m, t, node, d, bin AS cut FROM (SELECT *, row_number() OVER (PARTITION BY m, t, node ORDER BY gain DESC, d, bin) AS rk FROM v{l} WHERE gain > 0) WHERE rk = 1"
            parts[f"a{l + 1}"] = f"SELECT m, t, id, copy, c, tr, 2 * node + 1 + (bin > cut)::INT AS node, times FROM {a} JOIN d{l} USING (m, t, node) JOIN b USING (id, copy, d)"
            leaves.append(f"SELECT * FROM {a} ANTI JOIN d{l} USING (m, t, node)")
        else:
            leaves.append(f"SELECT * FROM {a}")
    parts["leaf"] = " UNION ALL ".join(leaves)
    parts["share"] = "SELECT m, t, node, c, sum(times * w) / sum(sum(times * w)) OVER (PARTITION BY m, t, node) AS p FROM leaf JOIN q USING (m, c) WHERE tr GROUP BY m, t, node, c"
    parts["own"] = "SELECT id, t, m, node, c AS label FROM leaf WHERE NOT tr AND copy = 0"
    return _tables(
        f"SELECT o.id AS vec_id, o.label, k.cls, round(coalesce(sum(s.p), 0) / {TREES}, 6) AS p FROM own o CROSS JOIN (SELECT CAST(c AS INT) AS cls FROM range(10) r(c)) k LEFT JOIN share s ON s.m = o.m AND s.t = o.t AND s.node = o.node AND s.c = k.cls GROUP BY 1, 2, 3", parts
    )


def _rows(spark, sf_dir):
    return T.binned(T.mirrored(embedded(spark, sf_dir), "x", "label", SIDED, "vec_id"), "x", DIMS)


def _per_class(scored, p):
    return rounded(scored.select("vec_id", "label", F.posexplode(p).alias("cls", "p")))


@query(_boosted_sql())
def boosted_oof(spark, sf_dir):
    """CLF6, EXP2: class probabilities of every row by boosted trees that never saw its fold, nor a mirror image out of it."""
    scored, _ = T.boosted(_rows(spark, sf_dir), "label", CLASSES, DIMS, FOLDS, rounds=ROUNDS, depth=DEPTH, rate=RATE)
    return _per_class(scored, T.softmax("scores"))


@query(_forest_sql())
def forest_oof(spark, sf_dir):
    """CLF4, EXP2: the same by a forest of balanced trees on bootstrap samples."""
    scored, _ = T.forest(_rows(spark, sf_dir), "vec_id", "label", CLASSES, DIMS, FOLDS, trees=TREES, depth=FOREST_DEPTH, tried=TRIED)
    return _per_class(scored, F.col("p"))
