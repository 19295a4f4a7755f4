"""Every operator as a query over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import leaky_relu, logit, sigmoid
from ..operators import analyze, candidates, decode, generate, geometry, graph, metrics, model, score, split, store, train
from ..operators.metrics import THRESHOLDS
from ..sources import fixtures, readers
from ..sources.fixtures import table
from ..sources.shared import folder
from . import engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Named sub-queries of the SQL; each may use those before it.
T_LIST = ", ".join(map(str, THRESHOLDS))
PARTS = {
    "PT": """SELECT vec_id // 8 AS g, vec_id % 8 AS c, (vec_id % 8) // 2 AS ch, i, embedding[2 * i + 1]::DOUBLE + 0.3::DOUBLE * (vec_id % 8) AS x, embedding[2 * i + 2]::DOUBLE AS y
             FROM embeddings, (SELECT unnest(range(32)) AS i)""",
    "ND": "SELECT g, c * 32 + i AS n, c, ch, x, y FROM PT",
    "PL": """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, (epoch_us(ts) - 1704067200000000)::DOUBLE / 86400000000::DOUBLE AS x, value / 100 AS y FROM events""",
    "PTN": "SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM PT WINDOW w AS (PARTITION BY g, c ORDER BY i)",
    "PLN": "SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM PL WINDOW w AS (PARTITION BY user_id ORDER BY i)",
    "CT": """SELECT g, c, min(ch) AS ch, count(*) AS n, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS arc, sum(x * ny - nx * y) / 2 AS area, avg(x) AS cx, avg(y) AS cy,
             min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM PTN GROUP BY g, c""",
    "LS": """SELECT user_id, count(*) AS n, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS arc, sum(x * ny - nx * y) / 2 AS area, avg(x) AS cx, avg(y) AS cy,
             min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM PLN GROUP BY user_id""",
    "NM": "SELECT g, c, ch, n, arc, area, cy, min_y, max_y, l, cx - l AS cx, min_x - l AS min_x, max_x - l AS max_x FROM (SELECT *, min(min_x) OVER (PARTITION BY g) AS l FROM CT)",
    "SG": """SELECT *, coalesce(lag(hi) OVER (PARTITION BY g, c ORDER BY i), 0) AS lo, max(hi) OVER (PARTITION BY g, c) AS total, max(i) OVER (PARTITION BY g, c) AS last FROM (
             SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS len, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) OVER (PARTITION BY g, c ORDER BY i) AS hi FROM PTN)""",
    "RS": """SELECT g, c, k, k * total / cnt / total AS t, x + (nx - x) * f AS x, y + (ny - y) * f AS y, (nx - x) / greatest(len, 1.1920929e-07::DOUBLE) AS tx, (ny - y) / greatest(len, 1.1920929e-07::DOUBLE) AS ty FROM (
             SELECT *, least(greatest((k * total / cnt - lo) / greatest(len, 1.1920929e-07::DOUBLE), 0), 1) AS f FROM (
             SELECT SG.*, k, least(greatest(floor(total / 0.05::DOUBLE + 0.5), 6), 64)::INT AS cnt FROM SG, (SELECT unnest(range(64)) AS k))
             WHERE k < cnt AND hi > lo AND ((k * total / cnt > lo AND (k * total / cnt <= hi OR i = last)) OR (lo = 0 AND k = 0)))""",
    "KN": """SELECT g, a, b, d2 FROM (SELECT p.g, p.n AS a, q.n AS b, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS d2, row_number() OVER (PARTITION BY p.g, p.n ORDER BY (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), q.n) AS r
             FROM ND p JOIN ND q ON p.g = q.g AND p.n <> q.n WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 0.0625) WHERE r <= 8""",
    "UD": "SELECT DISTINCT g, least(a, b) AS a, greatest(a, b) AS b FROM KN",
    "CP": """SELECT g, ca, cb, m.d2 AS d2, m.a AS a, m.b AS b FROM (SELECT p.g, p.c AS ca, q.c AS cb, min({'d2': (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), 'a': p.n, 'b': q.n}) AS m
             FROM ND p JOIN ND q ON p.g = q.g AND p.c < q.c GROUP BY p.g, p.c, q.c)""",
    "ST": """SELECT g, ca, cb, overlap, gap FROM (SELECT a.g, a.c AS ca, b.c AS cb, least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x) AS overlap, greatest(b.min_y - a.max_y, a.min_y - b.max_y, 0) AS gap,
             greatest(least(a.max_x - a.min_x, b.max_x - b.min_x), 1.1920929e-07::DOUBLE) AS narrow FROM CT a JOIN CT b ON a.g = b.g AND a.c < b.c) WHERE overlap >= 0.5 * narrow AND gap <= 1""",
    "GE": """SELECT g, a, b FROM UD UNION SELECT g, least(a, b), greatest(a, b) FROM (SELECT CP.*, ST.g IS NOT NULL AS stacked FROM CP LEFT JOIN ST ON CP.g = ST.g AND CP.ca = ST.ca AND CP.cb = ST.cb)
             WHERE stacked OR d2 <= 0.35::DOUBLE * 0.35::DOUBLE""",
    "DE": """SELECT g, row_number() OVER (PARTITION BY g ORDER BY a, b, way) - 1 AS e, CASE way WHEN 0 THEN a ELSE b END AS src, CASE way WHEN 0 THEN b ELSE a END AS dst FROM GE, (SELECT unnest([0, 1]) AS way)""",
    "EF": """SELECT DE.g, e, src, dst, s.c AS ca, d.c AS cb, d.x - s.x AS dx, d.y - s.y AS dy, sqrt((d.x - s.x) * (d.x - s.x) + (d.y - s.y) * (d.y - s.y)) AS dist, s.c = d.c AS same, coalesce(s.ch = d.ch, false) AS label
             FROM DE JOIN ND s ON s.g = DE.g AND s.n = src JOIN ND d ON d.g = DE.g AND d.n = dst""",
    "SC": "SELECT *, CASE WHEN same THEN 1 ELSE exp(-40 * dist) END AS prob FROM EF",
    "PR": "SELECT g, least(ca, cb) AS ca, greatest(ca, cb) AS cb, count(*) AS n_edges, max(prob) AS prob, bool_or(label) AS label FROM SC WHERE ca <> cb GROUP BY ALL",
    "TH": f"SELECT unnest([{T_LIST}])::DOUBLE AS threshold",
    "LK": "SELECT threshold, g, ca AS a, cb AS b FROM PR, TH WHERE prob >= threshold UNION ALL SELECT threshold, g, cb, ca FROM PR, TH WHERE prob >= threshold",
    "RE": "SELECT g, threshold, c, c AS r FROM (SELECT DISTINCT g, c FROM ND), TH UNION SELECT RE.g, RE.threshold, RE.c, LK.b FROM RE JOIN LK ON LK.g = RE.g AND LK.threshold = RE.threshold AND LK.a = RE.r",
    "GR": "SELECT g, threshold, c, min(r) AS grp FROM RE GROUP BY ALL",
    "OW": "SELECT g, c, min(ch) AS ch FROM ND GROUP BY ALL",
    "CE": "SELECT DISTINCT GR.g, threshold, grp, ch FROM GR JOIN OW ON OW.g = GR.g AND OW.c = GR.c",
    "EX": """SELECT x.g, x.threshold, coalesce(n.ok, true) AS correct FROM (SELECT DISTINCT g, threshold FROM ND, TH) x LEFT JOIN
             (SELECT g, threshold, count(DISTINCT grp) = count(DISTINCT ch) AND count(DISTINCT ch) = count(*) AS ok FROM CE GROUP BY ALL) n ON n.g = x.g AND n.threshold = x.threshold""",
    "CR": """SELECT threshold, count(*) AS chars, count(*) FILTER (s) AS split, count(*) FILTER (m) AS merged FROM (
             SELECT CE.threshold, CE.g, ch, count(*) > 1 AS s, max(k) > 1 AS m FROM CE JOIN (SELECT threshold, g, grp, count(*) AS k FROM CE GROUP BY ALL) w
             ON w.threshold = CE.threshold AND w.g = CE.g AND w.grp = CE.grp GROUP BY ALL) GROUP BY ALL""",
    "PS": """SELECT threshold, tp, fp, fn, pairs, p AS pair_precision, r AS pair_recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS pair_f1 FROM (
             SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM (
             SELECT threshold, count(*) FILTER (prob >= threshold AND label) AS tp, count(*) FILTER (prob >= threshold AND NOT label) AS fp, count(*) FILTER (prob < threshold AND label) AS fn, count(*) AS pairs FROM PR, TH GROUP BY ALL))""",
    "SW": """SELECT a.threshold, a.grouping_acc, a.graphs, c.chars, c.split / c.chars AS char_split_rate, c.merged / c.chars AS char_merge_rate, p.pair_precision, p.pair_recall, p.pair_f1, p.pairs
             FROM (SELECT threshold, avg(correct::INT) AS grouping_acc, count(*) AS graphs FROM EX GROUP BY ALL) a JOIN CR c ON c.threshold = a.threshold LEFT JOIN PS p ON p.threshold = a.threshold""",
    "FX6": """SELECT d.doc_id, quality = 1 AS truth, n_chars >= 500 AS hit, greatest(least(n_chars / 20000::DOUBLE, 0.999::DOUBLE), 0.001::DOUBLE) AS prob FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "LG": "SELECT *, ln(prob / (1 - prob)) AS logit, truth::INT::DOUBLE AS y, (doc_id % 3 + 1)::DOUBLE AS weight FROM FX6",
    "EL": "SELECT *, ln(p / (1 - p)) AS logit, label::INT::DOUBLE AS y FROM (SELECT *, greatest(least(exp(-40 * dist), 0.999::DOUBLE), 0.001::DOUBLE) AS p FROM EF)",
    "BL": """SELECT item_id, i, trim(value, chr(32) || chr(9) || chr(10) || chr(13)) AS value FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM benchmark)""",
    "KL": "SELECT item_id, i, value FROM BL WHERE value <> '' AND value NOT LIKE '#%'",
}


def with_parts(sql: str) -> str:
    """sql after those of PARTS that it needs, in order."""
    used = lambda text: {k for k in PARTS if re.search(rf"\b{k}\b", text)}
    need, todo = set(), used(sql)
    while todo:
        k = todo.pop()
        if k not in need:
            need.add(k)
            todo |= used(PARTS[k]) - need
    return ("WITH RECURSIVE " + ",\n".join(f"{k} AS ({PARTS[k]})" for k in PARTS if k in need) + "\n" if need else "") + sql


def r6(*names: str, **named: str) -> str:
    """SQL that rounds columns to six places, without negative zeros."""
    return ", ".join(f"round({x}, 6) + 0::DOUBLE AS {n}" for n, x in [*[(n, n) for n in names], *named.items()])


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) + F.lit(0.0) for n in names})


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = with_parts(sql)
        return f

    return register


# Inputs that several queries share.


def _contours(spark, d):
    return geometry.contour_stats(fixtures.points(spark, d), ["g", "c"], carry=["ch"])


def _edges(spark, d):
    n = fixtures.nodes(spark, d)
    return graph.built_edges(n, _contours(spark, d))


def _scores(spark, d):
    """The stand-in for a model: exp(-40 dist) on edges between contours, 1 within."""
    e = _edges(spark, d)
    s = score.scored_edges(e).select("g", "e", F.exp(-40 * F.col("dist")).alias("prob"))
    return decode.filled(e, s)


def _scored(spark, d):
    """The same without the join, where only the result matters."""
    return _edges(spark, d).withColumn("prob", F.when(F.col("same"), 1.0).otherwise(F.exp(-40 * F.col("dist"))))


def _pairs(spark, d):
    return decode.pair_max(_scored(spark, d))


def _owner(spark, d):
    return metrics.contour_owner(fixtures.nodes(spark, d))


def _graphs(spark, d):
    return fixtures.nodes(spark, d).select("g").distinct()


def _groups(spark, d):
    return decode.char_groups(_pairs(spark, d), _owner(spark, d), THRESHOLDS)


def _cells(spark, d):
    return metrics.cells(_groups(spark, d), _owner(spark, d))


def _judged(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    p = F.greatest(F.least(F.col("n_chars") / F.lit(20000.0), F.lit(0.999)), F.lit(0.001))
    return rows.select("doc_id", (F.col("quality") == 1).alias("true"), (F.col("n_chars") >= 500).alias("hit"), p.alias("prob"))


def _logits(spark, d):
    return _judged(spark, d).select("doc_id", logit(F.col("prob")).alias("logit"), F.col("true").cast("double").alias("y"), (F.col("doc_id") % 3 + 1).cast("double").alias("weight"))


def _edge_logits(spark, d):
    p = F.greatest(F.least(F.exp(-40 * F.col("dist")), F.lit(0.999)), F.lit(0.001))
    return _edges(spark, d).withColumn("logit", logit(p)).withColumn("y", F.col("label").cast("double"))


def _lines(spark, d):
    return generate.list_lines(table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("i", "value"))).withColumn("line", F.struct("item_id", "i"))


# A: scans, lists, payloads


@query("SELECT item_id, value FROM KL")
def list_lines(spark, d):
    return _lines(spark, d).select("item_id", "value")


@query("SELECT row_number() OVER (ORDER BY item_id, i, j) - 1 AS pos, ch FROM (SELECT item_id, i, unnest(string_split(value, '')) AS ch, generate_subscripts(string_split(value, ''), 1) AS j FROM KL)")
def charset_pool(spark, d):
    return generate.charset(_lines(spark, d), "line")


@query("SELECT ch, count(*) AS weight FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '') GROUP BY ch")
def charset_weights(spark, d):
    return generate.weights(table(spark, d, "documents"), "text")


@query("SELECT row_number() OVER (ORDER BY item_id, i) - 1 AS pos, value AS text FROM KL")
def fixed_texts(spark, d):
    return generate.fixed_texts(_lines(spark, d), "line")


def _stored(spark, d):
    """documents as a packed store of a hundred to a shard."""
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    store.write({"documents": table(spark, d, "documents").withColumnRenamed("doc_id", "g").select("g", "source", "n_chars")}, path, 100)
    return path


@query("SELECT doc_id, doc_id // 100 AS shard FROM documents WHERE doc_id // 100 < 3")
def limit_shards(spark, d):
    return readers.packed(spark, _stored(spark, d), "documents", shards=3).select(F.col("g").alias("doc_id"), F.col("shard").cast("bigint").alias("shard"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def store_subset(spark, d):
    ids = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("g"))
    return readers.packed(spark, _stored(spark, d), "documents", ids).select(F.col("g").alias("doc_id"), "n_chars")


@query("SELECT 0 AS lim, count(*) AS n FROM documents UNION ALL SELECT 7, count(*) FROM documents WHERE doc_id // 100 < 7")
def limit_zero_is_all(spark, d):
    path = _stored(spark, d)
    count = lambda n: readers.packed(spark, path, "documents", shards=n).agg(F.lit(n).alias("lim"), F.count("*").alias("n"))
    return count(0).union(count(7))


@query("SELECT doc_id // 100 AS shard, count(*) AS n FROM documents GROUP BY 1")
def shard_counts(spark, d):
    return table(spark, d, "documents").groupBy(F.expr("doc_id div 100").alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM ND) AS nodes, (SELECT count(*) FROM EF) AS edges, (SELECT count(*) FILTER (label) FROM EF) AS positives, (SELECT count(*) FROM CT) AS contours, (SELECT count(DISTINCT g) FROM ND) AS graphs")
def pack_summary(spark, d):
    s = store.graph_sizes(fixtures.nodes(spark, d), _edges(spark, d))
    return s.agg(F.sum("num_nodes").alias("nodes"), F.sum("num_edges").alias("edges"), F.sum("positives").alias("positives"), F.sum("num_contours").alias("contours"), F.count("*").alias("graphs"))


@query("""SELECT n.g, n.n AS nodes, n.x0, e.e AS edges, e.s AS src_sum FROM (SELECT g, count(*) AS n, round(min_by(x, n), 6) + 0::DOUBLE AS x0 FROM ND GROUP BY g) n
          JOIN (SELECT g, count(*) AS e, sum(src)::BIGINT AS s FROM EF GROUP BY g) e ON e.g = n.g""")
def export_payload(spark, d):
    n = fixtures.nodes(spark, d)
    graphs = n.select("g").distinct().withColumn("text", F.concat(F.lit("line "), F.col("g")))
    p = readers.payloads(graphs, n, _scored(spark, d)).select("g", readers.from_payload(F.col("payload")).alias("p"))
    total = F.aggregate("p.edges.src", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rounded(p.select("g", F.size("p.nodes.x").cast("bigint").alias("nodes"), F.col("p.nodes.x")[0].alias("x0"), F.size("p.edges.src").cast("bigint").alias("edges"), total.alias("src_sum")), "x0")


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_roundtrip(spark, d):
    rows = table(spark, d, "conversations")
    packed = rows.select(F.to_json(F.struct(*rows.columns)).alias("j"))
    return packed.select(F.from_json("j", rows.schema).alias("r")).select("r.conv_id", "r.turn", "r.role", "r.text")


@query(f"SELECT g, c, i, {r6(x='x - l', y='y')} FROM (SELECT *, min(x) OVER (PARTITION BY g) AS l FROM PT)")
def normalize_points(spark, d):
    return rounded(geometry.moved_left(fixtures.points(spark, d)).select("g", "c", F.col("i").cast("bigint").alias("i"), "x", "y"), "x", "y")


@query("SELECT threshold, lpad(printf('%.2f', threshold), 6, ' ') || lpad(printf('%.4f', grouping_acc), 9, ' ') || lpad(printf('%.4f', char_split_rate), 9, ' ') || lpad(printf('%.4f', char_merge_rate), 9, ' ') || lpad(printf('%.4f', pair_f1), 9, ' ') AS line FROM SW")
def sweep_report(spark, d):
    return metrics.report(metrics.sweep(_pairs(spark, d), _owner(spark, d), _graphs(spark, d)))


# B: generation

POOL = list("abcdefghijklmnop")


@query("SELECT d.doc_id, b.value AS text FROM documents d JOIN (SELECT value, row_number() OVER (ORDER BY item_id, i) - 1 AS pos, count(*) OVER () AS n FROM KL) b ON b.pos = d.doc_id % b.n")
def round_robin(spark, d):
    texts = generate.fixed_texts(_lines(spark, d), "line")
    return generate.round_robin(table(spark, d, "documents").select("doc_id"), "doc_id", texts, texts.count()).select("doc_id", "text")


@query("SELECT event_id, " + r6(tracking="0.1::DOUBLE - 0.3::DOUBLE * pow(value / 1000, 2)") + " FROM events")
def skewed_draw(spark, d):
    e = table(spark, d, "events")
    return rounded(e.select("event_id", generate.skewed(F.col("value") / 1000, F.lit(-0.2), F.lit(0.1), 2.0).alias("tracking")), "tracking")


@query("SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY role) - 1 AS char_id FROM conversations")
def cluster_ids(spark, d):
    return geometry.cluster_ids(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "role").select("conv_id", "turn", "char_id")


@query("SELECT user_id, event_id, " + r6("pen") + """ FROM (SELECT user_id, event_id, value, coalesce(sum(value / 100 + 0.05::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pen FROM events)
          WHERE value >= 100""")
def pen_positions(spark, d):
    e = table(spark, d, "events").withColumn("t", fixtures.micros())
    rows = geometry.pen_positions(e, "user_id", ["t", "event_id"], F.col("value") / 100, F.lit(0.05)).where("value >= 100")
    return rounded(rows.select("user_id", "event_id", "pen"), "pen")


@query("SELECT g, c, i, " + r6(x="(x + 0.5::DOUBLE + 0.01::DOUBLE * (i % 3)) * 1.25::DOUBLE", y="y + 0.1::DOUBLE * c - 0.01::DOUBLE * (i % 2)") + " FROM PT")
def affine_points(spark, d):
    p = geometry.affine(fixtures.points(spark, d), F.lit(0.5), F.lit(0.1) * F.col("c"), F.lit(0.01) * (F.col("i") % 3), F.lit(-0.01) * (F.col("i") % 2), F.lit(1.25))
    return rounded(p.select("g", "c", F.col("i").cast("bigint").alias("i"), "x", "y"), "x", "y")


@query("SELECT g, c, i, " + r6(x="x * 0.5::DOUBLE", y="y * 0.5::DOUBLE + 0.25::DOUBLE") + " FROM PT")
def scale_shift(spark, d):
    return rounded(geometry.scale_shift(fixtures.points(spark, d), 0.5, 0.25).select("g", "c", F.col("i").cast("bigint").alias("i"), "x", "y"), "x", "y")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def rejects_anti(spark, d):
    return generate.rejected(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT user_id, i, s, " + r6(
    x="((1-t)*(1-t)*(1-t)*x0 + 3*(1-t)*(1-t)*t*x1 + 3*(1-t)*t*t*x2 + t*t*t*x3) / pi()", y="((1-t)*(1-t)*(1-t)*y0 + 3*(1-t)*(1-t)*t*y1 + 3*(1-t)*t*t*y2 + t*t*t*y3) / pi()",
) + """ FROM (SELECT *, s / 8 AS t FROM (SELECT user_id, i, x AS x0, y AS y0, lead(x, 1) OVER w AS x1, lead(y, 1) OVER w AS y1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2, lead(x, 3) OVER w AS x3, lead(y, 3) OVER w AS y3
          FROM PL WINDOW w AS (PARTITION BY user_id ORDER BY i)), (SELECT unnest(range(1, 9)) AS s)) WHERE i % 3 = 0 AND x3 IS NOT NULL""")  # fmt: skip
def bezier_flatten(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("i")
    p = fixtures.polylines(spark, d)
    cols = [F.lead(v, k).over(w).alias(f"{v}{k}") for v in ("x", "y") for k in (1, 2, 3)]
    c = p.select("user_id", "i", F.col("x").alias("x0"), F.col("y").alias("y0"), *cols, F.lit("c").alias("kind")).where("i % 3 = 0 and x3 is not null")
    out = geometry.flatten_curves(c, ["user_id"]).select("user_id", F.col("i").cast("bigint").alias("i"), F.col("s").cast("bigint").alias("s"), (F.col("x") / F.pi()).alias("x"), (F.col("y") / F.pi()).alias("y"))  # over pi: decimals would lie halfway between roundings
    return rounded(out, "x", "y")


@query("SELECT g, num_nodes, num_edges FROM (SELECT n.g, n.k AS num_nodes, coalesce(e.k, 0) AS num_edges FROM (SELECT g, count(*) AS k FROM ND WHERE y > 0.25 GROUP BY g) n LEFT JOIN (SELECT EF.g, count(*) AS k FROM EF JOIN ND s ON s.g = EF.g AND s.n = src JOIN ND t ON t.g = EF.g AND t.n = dst WHERE s.y > 0.25 AND t.y > 0.25 GROUP BY EF.g) e ON e.g = n.g) WHERE num_nodes >= 8 AND num_edges > 0")
def reject_small(spark, d):
    high = fixtures.nodes(spark, d).where("y > 0.25")
    ids = high.select("g", "n")
    e = _edges(spark, d).join(ids.withColumnRenamed("n", "src"), ["g", "src"]).join(ids.withColumnRenamed("n", "dst"), ["g", "dst"])
    return store.reject_small(store.graph_sizes(high, e)).select("g", "num_nodes", "num_edges")


def _draw(row: str, what: str, k: str = "0", seed: int = 0) -> str:
    """SQL of generate.draw."""
    return f"(('0x' || substr(md5('{seed}|' || {row} || '|{what}|' || {k}), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


@query("SELECT doc_id, " + r6(jitter="0.2::DOUBLE * " + _draw("doc_id", "jitter"), aspect="0.8::DOUBLE + (1.2::DOUBLE - 0.8::DOUBLE) * " + _draw("doc_id", "aspect"), noise="0.1::DOUBLE * " + _draw("doc_id", "noise"), tracking="0.1::DOUBLE - 0.3::DOUBLE * pow(" + _draw("doc_id", "tracking") + ", 2)") + " FROM documents")
def seeded_draws(spark, d):
    rows = generate.layout_draws(table(spark, d, "documents").select("doc_id"), "doc_id", (-0.2, 0.1), 2.0, (0.8, 1.2), 0.2, 0.1)
    return rounded(rows, "jitter", "aspect", "noise", "tracking")


@query(f"SELECT doc_id, CASE WHEN {_draw('doc_id', 'pool')} < 0.3 THEN ['deco a', 'deco b'][1 + floor({_draw('doc_id', 'deco')} * 2)::INT] ELSE ['body a', 'body b', 'body c'][1 + floor({_draw('doc_id', 'body')} * 3)::INT] END AS font FROM documents")
def pool_choice(spark, d):
    return generate.pool_choice(table(spark, d, "documents").select("doc_id"), "doc_id", ["body a", "body b", "body c"], ["deco a", "deco b"])


def _some(row: str, what: str, n: str) -> str:
    """SQL of n characters of the pool."""
    return f"array_to_string(list_transform(range(1, {n} + 1), lambda i: {POOL}[1 + floor({_draw(row, what, 'i')} * {len(POOL)})::INT]), '')"


@query(f"SELECT doc_id, {_some('doc_id', 'char', 'n')} AS text FROM (SELECT doc_id, 2 + floor({_draw('doc_id', 'length')} * 11)::INT AS n FROM documents)")
def random_text(spark, d):
    return generate.random_text(table(spark, d, "documents").select("doc_id"), "doc_id", POOL)


@query(f"""SELECT row, pattern, {_some('row', 'left', 'before')} || pattern || {_some('row', 'right', '(pad - before)')} AS text FROM (
          SELECT row, pattern, pad, floor({_draw('row', 'before')} * (pad + 1))::INT AS before FROM (
          SELECT row, pattern, greatest(2, size) + floor({_draw('row', 'total')} * (greatest(400, size) - greatest(2, size) + 1))::INT - size AS pad FROM (
          SELECT item_id * 1000 + i - 1 AS row, value AS pattern, length(value) AS size FROM KL)))""")
def embed_pattern(spark, d):
    rows = _lines(spark, d).select((F.col("item_id") * 1000 + F.col("i")).alias("row"), F.col("value").alias("pattern"))
    return generate.embed_pattern(rows, "row", "pattern", POOL, high=400)


def _corpus(spark, d):
    fonts = ["body a", "body b", "deco a"]
    options = engine.CorpusOptions(count=table(spark, d, "conversations").count(), tracking=(-0.1, 0.2), aspect=(0.9, 1.1), jitter=0.02, noise=0.005)
    lines = engine.lines(spark, options, [*fonts[:2], "lost font"], fonts[2:], [*POOL, " "])
    return lines, *fixtures.glyphs(spark, d, POOL, fonts), options


@query()
def corpus_records(spark, d):
    """A generated corpus: one line for each row of conversations."""
    r, _ = engine.generate_corpus(*_corpus(spark, d))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return r.select("g", "text", "font", "num_nodes", "num_edges", "num_contours", total("node_char_ids").alias("char_sum"), total("edge_index").alias("edge_sum"))


@query()
def corpus_rejects(spark, d):
    return engine.generate_corpus(*_corpus(spark, d))[1]


@query(f"""SELECT g, c, ch, i, """ + r6("x", "y") + f""" FROM (SELECT g, dense_rank() OVER (PARTITION BY g ORDER BY mark) - 1 AS c, rank - 1 AS ch, i,
          (ox + (rank - 1) * (600 + tracking * 1000) + {_draw("g || ',' || mark || ',0,' || i", 'noise x')} * 2 * noise * 1000 - noise * 1000) * aspect / 1000 AS x,
          (oy + 10 + {_draw("g || ',' || mark", 'baseline')} * 2 * jitter * 1000 - jitter * 1000 + {_draw("g || ',' || mark || ',0,' || i", 'noise y')} * 2 * noise * 1000 - noise * 1000) / 1000 AS y FROM (
          SELECT *, 0.02::DOUBLE * {_draw('g', 'jitter')} AS jitter, 0.005::DOUBLE * {_draw('g', 'noise')} AS noise, 0.9::DOUBLE + (1.1::DOUBLE - 0.9::DOUBLE) * {_draw('g', 'aspect')} AS aspect, 0.2::DOUBLE - 0.3::DOUBLE * pow({_draw('g', 'tracking')}, 1) AS tracking FROM (
          SELECT g, mark, rank, i, x * 200 AS ox, y * 200 AS oy FROM (SELECT g, mark, mark + 1 AS rank, {POOL}[1 + k] AS char, k FROM (SELECT g, mark, floor({_draw('g', 'char', '(mark + 1)')} * 16)::INT AS k FROM (
          SELECT g, unnest(range(n)) AS mark FROM (SELECT g, 2 + floor({_draw('g', 'length')} * 11)::INT AS n FROM (SELECT unnest(range((SELECT count(*) FROM conversations))) AS g))))) t
          JOIN (SELECT g AS pg, c AS pc, i, x, y FROM PT) p ON p.pg = t.k // 8 AND p.pc = t.k % 8)))""")  # fmt: skip
def layout_points(spark, d):
    """Lines of the first font, so that every character has a glyph."""
    options = engine.CorpusOptions(count=table(spark, d, "conversations").count(), tracking=(-0.1, 0.2), aspect=(0.9, 1.1), jitter=0.02, noise=0.005)
    points = engine.laid_out(engine.lines(spark, options, ["body a"], [], POOL), *fixtures.glyphs(spark, d, POOL, ["body a"]), options)
    return rounded(points.select("g", "c", "ch", F.col("i").cast("bigint").alias("i"), "x", "y"), "x", "y")


@query("SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) || '.parquet' AS name, true AS valid")
def scan_binary_pool(spark, d):
    return readers.binary_pool(spark, d, ("parquet",), ("50415231",)).select("name", "valid")


@query(f"SELECT doc_id, coalesce(length(text) * 2 - length(regexp_replace(text, '{metrics.WIDE}', '', 'g')), 0)::BIGINT AS width FROM documents")
def display_width(spark, d):
    return table(spark, d, "documents").select("doc_id", metrics.display_width(F.col("text")).alias("width"))


# C: contour geometry


def _line_stats(spark, d, *names):
    return rounded(geometry.contour_stats(fixtures.polylines(spark, d), ["user_id"]).select("user_id", *names), *names)


for _name, _columns in {"arc_length": ("arc",), "signed_area": ("area",), "centroid": ("cx", "cy"), "bbox": ("min_x", "min_y", "max_x", "max_y")}.items():
    query(f"SELECT user_id, {r6(*_columns)} FROM LS", _name)(lambda spark, d, _c=_columns: _line_stats(spark, d, *_c))


@query("SELECT g, c, k, " + r6("t", "x", "y", "tx", "ty") + " FROM RS")
def resample(spark, d):
    r = geometry.resample(fixtures.points(spark, d), ["g", "c"])
    return rounded(r.select("g", "c", F.col("k").cast("bigint").alias("k"), "t", "x", "y", "tx", "ty"), "t", "x", "y", "tx", "ty")


@query("SELECT user_id, i, " + r6(cos_phase="cos(2 * pi() * (i / n))", sin_phase="sin(2 * pi() * (i / n))") + " FROM (SELECT user_id, i, count(*) OVER (PARTITION BY user_id) AS n FROM PL)")
def phase(spark, d):
    p = fixtures.polylines(spark, d)
    n = p.groupBy("user_id").agg(F.count("*").alias("n"))
    cos, sin = geometry.phase(F.col("i") / F.col("n"))
    return rounded(p.join(n, "user_id").select("user_id", F.col("i").cast("bigint").alias("i"), cos.alias("cos_phase"), sin.alias("sin_phase")), "cos_phase", "sin_phase")


# D: graph construction


@query("SELECT g, c, " + r6("cx", "min_x", "max_x") + " FROM NM")
def normalize_graph(spark, d):
    return rounded(graph.normalized(_contours(spark, d)).select("g", "c", "cx", "min_x", "max_x"), "cx", "min_x", "max_x")


@query("SELECT g, c, row_number() OVER (PARTITION BY g ORDER BY c) - 1 AS new_c FROM (SELECT *, c % 3 = 1 AS thin FROM CT) WHERE NOT thin AND n >= 3 AND arc > 1.1920929e-07::DOUBLE")
def dense_contour_ids(spark, d):
    thin = fixtures.points(spark, d).where("c % 3 <> 1 or i < 2")
    return graph.dense_contours(geometry.contour_stats(thin, ["g", "c"])).select("g", "c", "new_c")


_NODE = ("x", "y", "tan_x", "tan_y", "off_x", "off_y", "cx", "cy", "w", "h", "arc", "cos_phase", "sin_phase")


@query("SELECT r.g, row_number() OVER (PARTITION BY r.g ORDER BY r.c, k) - 1 AS n, r.c, " + r6(
    x="r.x - m.l", y="r.y", tan_x="tx", tan_y="ty", off_x="r.x - m.l - m.cx", off_y="r.y - m.cy", cx="m.cx", cy="m.cy", w="m.max_x - m.min_x", h="m.max_y - m.min_y", arc="m.arc", cos_phase="cos(2 * pi() * t)", sin_phase="sin(2 * pi() * t)",
) + " FROM RS r JOIN NM m ON m.g = r.g AND m.c = r.c")
def node_features(spark, d):
    r = geometry.resample(fixtures.points(spark, d), ["g", "c"])
    return rounded(graph.node_features(r, _contours(spark, d)), *_NODE)


@query("SELECT g, a, b, " + r6("d2") + " FROM KN")
def knn_radius(spark, d):
    return rounded(graph.neighbours(fixtures.nodes(spark, d)), "d2")


@query("SELECT g, a, b, " + r6("d2") + " FROM KN")
def knn_radius_all_pairs(spark, d):
    return rounded(graph.neighbours_all_pairs(fixtures.nodes(spark, d)), "d2")


@query("SELECT g, a, b, " + r6("d2") + " FROM KN")
def knn_radius_by_cells(spark, d):
    return rounded(graph.neighbours_by_cells(fixtures.nodes(spark, d)), "d2")


@query("SELECT g, a, b FROM UD")
def undirected_pairs(spark, d):
    return graph.undirected(graph.neighbours(fixtures.nodes(spark, d)))


@query("SELECT g, ca, cb, a, b, " + r6("d2") + " FROM CP")
def closest_pair(spark, d):
    return rounded(graph.closest_pairs(fixtures.nodes(spark, d)), "d2")


@query("SELECT g, ca, cb, " + r6("overlap", "gap") + " FROM ST")
def stacked_pairs(spark, d):
    return rounded(graph.stacked_pairs(_contours(spark, d)), "overlap", "gap")


@query("SELECT g, a, b FROM GE")
def graph_edges(spark, d):
    return graph.graph_edges(fixtures.nodes(spark, d), _contours(spark, d))


@query("SELECT g, e, src, dst FROM DE")
def directed_edges(spark, d):
    return graph.directed(graph.graph_edges(fixtures.nodes(spark, d), _contours(spark, d)))


@query("SELECT g, e, src, dst, same, " + r6("dx", "dy", "dist") + " FROM EF")
def edge_features(spark, d):
    return rounded(_edges(spark, d).select("g", "e", "src", "dst", "same", "dx", "dy", "dist"), "dx", "dy", "dist")


@query("SELECT g, e, label FROM EF")
def edge_labels(spark, d):
    n = fixtures.nodes(spark, d)
    return graph.edge_features(graph.directed(graph.graph_edges(n, _contours(spark, d))), n).select("g", "e", "label")


@query("SELECT g, c, " + r6("cx", "cy", w="max_x - min_x", h="max_y - min_y", min_x="min_x", min_y="min_y", arc="arc", area="area") + " FROM NM")
def contour_features(spark, d):
    return rounded(graph.contour_features(_contours(spark, d)), "cx", "cy", "w", "h", "min_x", "min_y", "arc", "area")


@query("""SELECT n.g, 'line ' || n.g AS text, 'font ' || n.g % 3 AS font, n.num_nodes, e.num_edges, k.num_contours, n.char_sum, e.end_sum, e.labels, """ + r6("x_sum", "dist_sum", "area_sum") + """ FROM (SELECT g, count(*) AS num_nodes, sum(ch)::BIGINT AS char_sum, sum(x::FLOAT::DOUBLE) AS x_sum FROM ND GROUP BY g) n
          JOIN (SELECT g, count(*) AS num_edges, sum(src + dst)::BIGINT AS end_sum, count(*) FILTER (label) AS labels, sum(dist::FLOAT::DOUBLE) AS dist_sum FROM EF GROUP BY g) e ON e.g = n.g JOIN (SELECT g, count(*) AS num_contours, sum(area::FLOAT::DOUBLE) AS area_sum FROM CT GROUP BY g) k ON k.g = n.g""")
def graph_records(spark, d):
    r = _records(spark, d)
    total = lambda c, kind: F.aggregate(c, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))
    every = lambda c, step, at: F.filter(c, lambda _, i: i % step == at)
    sums = [total(every("node_features", 13, 0), "double").alias("x_sum"), total(every("edge_features", 4, 2), "double").alias("dist_sum"), total(every("contour_features", 8, 7), "double").alias("area_sum")]
    whole = [total("node_char_ids", "bigint").alias("char_sum"), total("edge_index", "bigint").alias("end_sum"), total("edge_labels", "bigint").alias("labels")]
    return rounded(r.select("g", "text", "font", "num_nodes", "num_edges", "num_contours", *whole, *sums), "x_sum", "dist_sum", "area_sum")


def _records(spark, d):
    n = fixtures.nodes(spark, d)
    n = n.select(*n.columns, *[F.lit(0.0).alias(c) for c in model.NODE if c not in n.columns])
    names = n.select("g").distinct().select("g", F.concat(F.lit("line "), F.col("g")).alias("text"), F.concat(F.lit("font "), F.col("g") % 3).alias("font"))
    return readers.records(n, graph.built_lists(n, _contours(spark, d)), graph.contour_features(_contours(spark, d)), names)


@query("SELECT " + ", ".join(f"count(*) FILTER (g % 10 = {k})::BIGINT AS {n}" for k, n in enumerate(["nodes_dim", "edges_dim", "edges_size", "contours_dim", "ids_size", "edges_range", "contours_range", "wide", "flags"])) + " FROM (SELECT DISTINCT g FROM ND)")
def validate_records(spark, d):
    """A tenth of the records breaks each rule, just that one."""
    bad = lambda k, good, broken: F.when(F.col("g") % 10 == k, broken).otherwise(good)
    longer = lambda c: F.concat(c, F.slice(c, 1, 1))
    r = _records(spark, d)
    r = r.withColumn("node_features", bad(0, F.col("node_features"), longer("node_features"))).withColumn("edge_features", bad(1, F.col("edge_features"), longer("edge_features")))
    r = r.withColumn("edge_index", bad(2, F.col("edge_index"), longer("edge_index"))).withColumn("contour_features", bad(3, F.col("contour_features"), longer("contour_features")))
    r = r.withColumn("node_char_ids", bad(4, F.col("node_char_ids"), longer("node_char_ids"))).withColumn("edge_index", bad(5, F.col("edge_index"), F.transform("edge_index", lambda x, i: F.when(i == 0, F.col("num_nodes")).otherwise(x))))
    r = r.withColumn("node_contour_ids", bad(6, F.col("node_contour_ids"), F.transform("node_contour_ids", lambda x, i: F.when(i == 0, F.col("num_contours")).otherwise(x))))
    r = r.withColumn("node_char_ids", bad(7, F.col("node_char_ids"), F.transform("node_char_ids", lambda x, i: F.when(i == 0, F.lit(70_000)).otherwise(x))))
    return store.record_violations(r.withColumn("edge_labels", bad(8, F.col("edge_labels"), F.transform("edge_labels", lambda x, i: F.when(i == 0, F.lit(2)).otherwise(x).cast("smallint")))))


# E: store


@query("""SELECT (SELECT count(*) FROM ND WHERE g % 5 = 0 AND n = 3) AS wide_nodes, (SELECT count(*) FROM ND WHERE g % 5 = 1 AND c = 2) AS wide_contours, (SELECT count(*) FROM ND WHERE g % 5 = 2 AND ch = 1) AS wide_chars,
          (SELECT count(*) FILTER (src = 3) + count(*) FILTER (dst = 3) FROM EF WHERE g % 5 = 0) AS lost_ends, (SELECT count(DISTINCT (g, c)) FROM ND WHERE (g % 5 = 3 AND c = 4) OR (g % 5 = 1 AND c = 2)) AS bare_contours, (SELECT count(*) FROM EF WHERE g % 5 = 4 AND e % 7 = 0) AS self_edges""")
def validate_store(spark, d):
    """A store with a fault of each kind in a fifth of its graphs."""
    far = lambda g, rule, c: F.when((F.col("g") % 5 == g) & rule, F.col(c) + 70_000).otherwise(F.col(c))
    n = fixtures.nodes(spark, d)
    n = n.withColumns({"n": far(0, F.col("n") == 3, "n"), "c": far(1, F.col("c") == 2, "c"), "ch": far(2, F.col("ch") == 1, "ch")})
    e = _edges(spark, d)
    e = e.withColumn("dst", F.when((F.col("g") % 5 == 4) & (F.col("e") % 7 == 0), F.col("src")).otherwise(F.col("dst")))
    return store.validate(n, e, _contours(spark, d).where("not (g % 5 = 3 and c = 4)"))


@query("SELECT g, e, " + r6(dist="sqrt(dx::FLOAT::DOUBLE * dx::FLOAT::DOUBLE + dy::FLOAT::DOUBLE * dy::FLOAT::DOUBLE)") + " FROM EF")
def rebuild_dist(spark, d):
    return rounded(store.unpacked_edges(store.packed_edges(_edges(spark, d))).select("g", "e", "dist"), "dist")


@query("SELECT g, e, (label::INT + 2 * same::INT)::SMALLINT AS flags, label, same FROM EF")
def flag_pack(spark, d):
    p = store.packed_edges(_edges(spark, d))
    label, same = store.unpack_flags(F.col("flags"))
    return p.select("g", "e", "flags", label.alias("label"), same.alias("same"))


@query("SELECT " + r6(drift="max(abs(dist - sqrt(dx::FLOAT::DOUBLE * dx::FLOAT::DOUBLE + dy::FLOAT::DOUBLE * dy::FLOAT::DOUBLE)))") + " FROM EF")
def dist_drift(spark, d):
    return rounded(store.dist_drift(_edges(spark, d)), "drift")


@query("SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS id FROM (SELECT DISTINCT source FROM documents)")
def dict_encode(spark, d):
    return store.dictionary(table(spark, d, "documents"), "source").select("source", F.col("id").cast("bigint").alias("id"))


@query("SELECT user_id, n, coalesce(sum(n) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def prefix_offsets(spark, d):
    return store.offsets(table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "n")


@query("SELECT count(DISTINCT n.g) AS graphs, count(DISTINCT n.g % 3) AS fonts, count(*) AS nodes, (SELECT count(*) FROM EF) AS edges, (SELECT count(*) FILTER (label) FROM EF) AS positives, " + r6(pos_ratio="(SELECT count(*) FILTER (label) / count(*) FROM EF)") + " FROM ND n")
def store_stats(spark, d):
    sizes = store.graph_sizes(fixtures.nodes(spark, d), _edges(spark, d)).withColumn("font", F.concat(F.lit("font "), F.col("g") % 3))
    return rounded(store.statistics(sizes), "pos_ratio")


# F: split, sample, batch


@query("""SELECT doc_id, source, CASE WHEN source IN (SELECT source FROM (SELECT source, row_number() OVER (ORDER BY md5('7|' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
          WHERE n > 1 AND r <= greatest(1, floor(n * 0.1))) THEN 'val' ELSE 'train' END AS part FROM documents""")
def holdout_by_group(spark, d):
    return split.holdout_by_group(table(spark, d, "documents").select("doc_id", "source"), "source").select("doc_id", "source", "part")


@query("SELECT doc_id, CASE WHEN r <= floor(n * 0.1) THEN 'val' ELSE 'train' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)")
def random_split_exact(spark, d):
    return split.random_split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("""SELECT lane, id, weight, batch FROM (WITH RECURSIVE o AS (SELECT doc_id AS id, n_chars AS weight, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
          f AS (SELECT 0 AS lane, r, id, weight, 0::BIGINT AS batch, weight AS total, 1 AS held FROM o WHERE r = 1 UNION ALL
          SELECT 0, o.r, o.id, o.weight, CASE WHEN held >= 8 OR total + o.weight > 20000 THEN batch + 1 ELSE batch END, CASE WHEN held >= 8 OR total + o.weight > 20000 THEN o.weight ELSE total + o.weight END,
          CASE WHEN held >= 8 OR total + o.weight > 20000 THEN 1 ELSE held + 1 END FROM f JOIN o ON o.r = f.r + 1) SELECT * FROM f)""")
def edge_budget_batches(spark, d):
    return split.edge_budget_batches(table(spark, d, "documents"), "doc_id", "n_chars", 20000, 8, lanes=1)


@query("""SELECT lane, pos, doc_id, weight, b.batch, turn FROM (WITH RECURSIVE o AS (SELECT doc_id, n_chars AS weight, row_number() OVER (ORDER BY md5('10|' || doc_id), doc_id) AS r FROM documents),
          f AS (SELECT 0 AS lane, r, doc_id, weight, 0::BIGINT AS batch, weight AS total, 1 AS held FROM o WHERE r = 1 UNION ALL
          SELECT 0, o.r, o.doc_id, o.weight, CASE WHEN held >= 8 OR total + o.weight > 20000 THEN batch + 1 ELSE batch END, CASE WHEN held >= 8 OR total + o.weight > 20000 THEN o.weight ELSE total + o.weight END,
          CASE WHEN held >= 8 OR total + o.weight > 20000 THEN 1 ELSE held + 1 END FROM f JOIN o ON o.r = f.r + 1) SELECT lane, r - 1 AS pos, doc_id, weight, batch, dense_rank() OVER (ORDER BY md5('10|0|' || batch), batch) - 1 AS turn FROM f) b""")
def epoch_batches(spark, d):
    return split.epoch_batches(table(spark, d, "documents"), "doc_id", "n_chars", 20000, 8, 7, 3, lanes=1)


@query("SELECT CT.g, c, ch, c + dc AS flat_c, ch + dch AS flat_ch FROM CT JOIN (SELECT g, coalesce(sum(nc) OVER w, 0)::BIGINT AS dc, coalesce(sum(nch) OVER w, 0)::BIGINT AS dch FROM (SELECT g, max(c) + 1 AS nc, max(ch) + 1 AS nch FROM CT GROUP BY g) WINDOW w AS (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) s ON s.g = CT.g")
def disjoint_ids(spark, d):
    return split.disjoint_ids(_contours(spark, d).select("g", "c", "ch"))


@query("SELECT doc_id, pos FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) WHERE pos IN (SELECT trunc(i * (n - 1) / 49)::BIGINT FROM (SELECT unnest(range(50)) AS i), (SELECT count(*) AS n FROM documents))")
def even_sample(spark, d):
    return split.even_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50).select("doc_id", F.col("pos").cast("bigint").alias("pos"))


@query("SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 50")
def hash_sample(spark, d):
    return split.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


# G: scoring


@query("SELECT g, n, " + r6(norm="(x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5::DOUBLE)") + " FROM ND WINDOW w AS (PARTITION BY g, c)")
def layer_norm(spark, d):
    return rounded(score.layer_norm(fixtures.nodes(spark, d), ["g", "c"], "x").select("g", "n", "norm"), "norm")


@query("SELECT g, n, " + r6(relu="greatest(y, 0)", leaky="CASE WHEN y >= 0 THEN y ELSE 0.2::DOUBLE * y END", sigm="1 / (1 + exp(-y))") + " FROM ND")
def activations(spark, d):
    y = F.col("y")
    return rounded(fixtures.nodes(spark, d).select("g", "n", F.greatest(y, F.lit(0.0)).alias("relu"), leaky_relu(y).alias("leaky"), sigmoid(y).alias("sigm")), "relu", "leaky", "sigm")


@query("SELECT g, n, " + r6(soft="e / sum(e) OVER (PARTITION BY g, c)") + " FROM (SELECT *, exp(y - max(y) OVER (PARTITION BY g, c)) AS e FROM ND)")
def softmax_rows(spark, d):
    return rounded(score.softmax(fixtures.nodes(spark, d), ["g", "c"], "y").select("g", "n", "soft"), "soft")


@query("SELECT g, dst, " + r6(total="sum(dx)") + " FROM EF GROUP BY ALL")
def segment_sum(spark, d):
    e = _edges(spark, d)
    return rounded(score.segment(e.select("g", "dst").distinct(), e, ["g", "dst"], "dx").select("g", "dst", "total"), "total")


@query("SELECT ND.g, ND.n, " + r6(mean="coalesce(avg(EF.dist), 0)") + " FROM ND LEFT JOIN EF ON EF.g = ND.g AND EF.dst = ND.n AND NOT EF.same GROUP BY ALL")
def segment_mean(spark, d):
    e = score.scored_edges(_edges(spark, d)).select("g", F.col("dst").alias("n"), "dist")
    return rounded(score.segment(fixtures.nodes(spark, d).select("g", "n"), e, ["g", "n"], "dist").select("g", "n", "mean"), "mean")


@query("SELECT g, dst, ids, coalesce(sum(len(ids)) OVER (PARTITION BY g ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT g, dst, list(e ORDER BY e)::VARCHAR AS shown, list(e ORDER BY e) AS ids FROM EF GROUP BY ALL)")
def incoming_csr(spark, d):
    return analyze.incoming(_edges(spark, d))


@query("SELECT g, dst, " + r6(out="sum(w * h) / (sum(w) + 1e-9::DOUBLE)") + " FROM (SELECT *, exp(x - max(x) OVER (PARTITION BY g)) AS w FROM (SELECT EF.g, dst, s.y AS h, CASE WHEN dx >= 0 THEN dx ELSE 0.2::DOUBLE * dx END AS x FROM EF JOIN ND s ON s.g = EF.g AND s.n = src)) GROUP BY ALL")
def attention_agg(spark, d):
    h = fixtures.nodes(spark, d).select("g", F.col("n").alias("src"), F.col("y").alias("h"))
    e = _edges(spark, d).select("g", "src", "dst", F.col("dx").alias("logit")).join(h, ["g", "src"])
    return rounded(score.attention(e), "out")


_REL = ("dx", "dy", "dist", "over_x", "over_y", "share_x", "share_y", "inside", "holds", "arc_ratio", "winding")


@query("SELECT g, ca, cb, " + r6(
    dx="bcx - acx", dy="bcy - acy", dist="sqrt((bcx - acx) * (bcx - acx) + (bcy - acy) * (bcy - acy))", over_x="ox", over_y="oy",
    share_x="least(greatest(ox / greatest(least(ax1 - ax0, bx1 - bx0), 1e-6::DOUBLE), -4), 1)", share_y="least(greatest(oy / greatest(least(ay1 - ay0, by1 - by0), 1e-6::DOUBLE), -4), 1)",
    inside="least(ax0 - bx0, ay0 - by0, bx1 - ax1, by1 - ay1)", holds="least(bx0 - ax0, by0 - ay0, ax1 - bx1, ay1 - by1)", arc_ratio="ln((aarc + 1e-6::DOUBLE) / (barc + 1e-6::DOUBLE))", winding="sign(aarea) * sign(barea)",
) + """ FROM (SELECT *, least(ax1, bx1) - greatest(ax0, bx0) AS ox, least(ay1, by1) - greatest(ay0, by0) AS oy FROM (SELECT a.g, a.c AS ca, b.c AS cb, a.cx AS acx, b.cx AS bcx, a.cy AS acy, b.cy AS bcy, a.min_x AS ax0, b.min_x AS bx0, a.max_x AS ax1, b.max_x AS bx1,
          a.min_y AS ay0, b.min_y AS by0, a.max_y AS ay1, b.max_y AS by1, a.arc AS aarc, b.arc AS barc, a.area AS aarea, b.area AS barea FROM NM a JOIN NM b ON a.g = b.g))""")  # fmt: skip
def contour_relations(spark, d):
    return rounded(graph.contour_relations(graph.contour_features(_contours(spark, d))), *_REL)


@query("SELECT g, " + r6(mean_x="avg(x)", max_x="max(x)", mean_y="avg(y)", max_y="max(y)") + " FROM ND GROUP BY g")
def graph_pool(spark, d):
    return rounded(score.graph_pool(fixtures.nodes(spark, d), ["x", "y"]), "mean_x", "max_x", "mean_y", "max_y")


@query("SELECT g, e, src, dst FROM EF WHERE ca <> cb")
def scored_edges(spark, d):
    return score.scored_edges(_edges(spark, d)).select("g", "e", "src", "dst")


@query("SELECT g, e, " + r6("prob") + " FROM SC")
def prob_fill(spark, d):
    return rounded(_scores(spark, d).select("g", "e", "prob"), "prob")


@query("SELECT CT.g, c // 2 AS grp, count(*) AS n, " + r6(sum_s="sum(cy)", max_s="max(cy)", min_x="min(min_x)", min_y="min(min_y)", max_x="max(max_x)", max_y="max(max_y)", arc="sum(arc)", area="sum(abs(area))") + " FROM CT GROUP BY ALL")
def group_accumulators(spark, d):
    return rounded(_accumulated(spark, d), "sum_s", "max_s", "min_x", "min_y", "max_x", "max_y", "arc", "area")


def _accumulated(spark, d):
    c = _contours(spark, d).withColumn("s", F.col("cy"))
    return decode.accumulators(c, c.select("g", "c", F.expr("c div 2").alias("grp")))


@query("SELECT g, grp, " + r6(width="w", height="h", aspect="w / greatest(h, 1e-6::DOUBLE)", compact="arc / greatest(w + h, 1e-6::DOUBLE)") + " FROM (SELECT g, c // 2 AS grp, greatest(max(max_x) - min(min_x), 0) AS w, greatest(max(max_y) - min(min_y), 0) AS h, sum(arc) AS arc FROM CT GROUP BY ALL)")
def group_scalars(spark, d):
    return rounded(decode.group_scalars(_accumulated(spark, d)).select("g", "grp", "width", "height", "aspect", "compact"), "width", "height", "aspect", "compact")


@query()
def model_scores(spark, d):
    """A seeded model with all its parts over resampled outlines."""
    contours, nodes, edges = engine.build(fixtures.points(spark, d))
    return rounded(engine.seeded_scorer(nodes, edges, contours), "prob")


@query()
def merge_scorer_sweep(spark, d):
    return rounded(engine.evaluate_merging(fixtures.points(spark, d)), "grouping_acc", "char_split_rate", "char_merge_rate")


_LIGATURES = [("serif", "th", "\ue000"), ("serif", "the", "\ue001"), ("serif", "an", "\ue002"), ("serif", "ing", "\ue003"), ("sans", "on", "\ue004")]
_KERNING = [("serif", "\ue001", " ", -40.0), ("serif", "a", "t", -25.0), ("sans", "o", "f", -15.0), ("sans", "\ue004", "e", 30.0)]


@query(f"""SELECT conv_id, turn, count(*) AS glyphs, count(DISTINCT k) AS clusters, sum(500 + coalesce(kern, 0))::DOUBLE AS width FROM (SELECT *, lead(char) OVER (PARTITION BY conv_id, turn ORDER BY k, j) AS next FROM (
          SELECT conv_id, turn, font, k, generate_subscripts(parts, 1) AS j, unnest(list_transform(parts, lambda p: coalesce(of[p], p))) AS char FROM (SELECT conv_id, turn, font, k, of, regexp_extract_all(part, anyone) AS parts FROM (
          SELECT *, generate_subscripts(regexp_extract_all(text, '(?:' || anyone || ')\\p{{M}}*'), 1) AS k, unnest(regexp_extract_all(text, '(?:' || anyone || ')\\p{{M}}*')) AS part FROM (SELECT *, CASE font WHEN 'serif' THEN 'the|ing|th|an|(?s:.)' ELSE 'on|(?s:.)' END AS anyone,
          CASE font WHEN 'serif' THEN MAP {{{', '.join(f"'{p}': '{c}'" for f, p, c in _LIGATURES if f == "serif")}}} ELSE MAP {{{', '.join(f"'{p}': '{c}'" for f, p, c in _LIGATURES if f == "sans")}}} END AS of
          FROM (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN 'serif' ELSE 'sans' END AS font FROM conversations WHERE length(text) > 0)))))) c
          LEFT JOIN (VALUES {', '.join(f"('{f}', '{a}', '{b}', {k})" for f, a, b, k in _KERNING)}) n(font, char, next, kern) ON n.font = c.font AND n.char = c.char AND n.next = c.next GROUP BY conv_id, turn""")
def shaped_glyphs(spark, d):
    """Texts as glyphs with ligatures and kerning: how many glyphs and clusters, and how wide."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", "text", F.when(F.col("turn") % 2 == 0, "serif").otherwise("sans").alias("font"), F.struct("conv_id", "turn").alias("line"))
    marks = geometry.shaped(lines, spark.createDataFrame(_LIGATURES, "font string, parts string, char string"))
    marks = geometry.kerned(marks, spark.createDataFrame(_KERNING, "font string, char string, next string, kern double"), "line")
    return marks.groupBy("conv_id", "turn").agg(F.count("*").alias("glyphs"), F.count_distinct("at").alias("clusters"), F.sum(F.lit(500) + F.col("kern")).alias("width"))


@query()
def training(spark, d):
    """Two epochs of a small model over the outlines: what each cost."""
    trained = engine.train_model(fixtures.points(spark, d), model.Options(hidden=8), train.Recipe(epochs=2, graphs=256, rate=0.01))
    return rounded(spark.createDataFrame([tuple(h.values()) for h in trained.history], "epoch int, loss double, point double, pair double, part double, rate double, graphs long, skipped long, score double"), "loss", "point", "pair", "part", "rate", "score")


# H: losses

_FOCAL = "(0.25::DOUBLE * y + 0.75::DOUBLE * (1 - y)) * pow(1 - (p * y + (1 - p) * (1 - y)), 2) * (greatest({z}, 0) - {z} * y + ln(1 + exp(-abs({z}))))"


@query("SELECT " + r6(mean="avg(l)", total="sum(l)", weighted="sum(l * weight) / count(*)") + f" FROM (SELECT weight, {_FOCAL.format(z='logit')} AS l FROM (SELECT *, 1 / (1 + exp(-logit)) AS p FROM LG))")
def focal_loss(spark, d):
    return rounded(score.focal_loss(_logits(spark, d)), "mean", "total", "weighted")


@query("SELECT g, ca, cb, " + r6(pooled="sum(w * logit) / (sum(w) + 1e-9::DOUBLE)") + " FROM (SELECT *, exp((logit - max(logit) OVER (PARTITION BY g, ca, cb)) / 0.5::DOUBLE) AS w FROM (SELECT g, least(ca, cb) AS ca, greatest(ca, cb) AS cb, logit FROM EL WHERE ca <> cb)) GROUP BY ALL")
def softmax_pool(spark, d):
    e = _edge_logits(spark, d).where("ca <> cb").select("g", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), "logit")
    return rounded(score.softmax_pool(e, ["g", "ca", "cb"], 0.5), "pooled")


@query("SELECT " + r6(pos_weight="w", loss="(SELECT avg(CASE WHEN y = 1 THEN w ELSE 1 END * (greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit))))) FROM LG)") + " FROM (SELECT least(greatest(sum(1 - y) / greatest(sum(y), 1), 1), 20) AS w FROM LG)")
def balanced_bce(spark, d):
    return rounded(score.balanced_bce(_logits(spark, d)), "pos_weight", "loss")


@query("SELECT " + r6("point", "pair", loss="0.5::DOUBLE * point + 0.5::DOUBLE * pair") + f""" FROM (SELECT sum(l * CASE WHEN same THEN 0.05::DOUBLE ELSE 1 END) / count(*) AS point FROM (SELECT same, {_FOCAL.format(z='logit')} AS l FROM EL)),
          (SELECT avg({_FOCAL.format(z='pooled')}) AS pair FROM (SELECT *, 1 / (1 + exp(-pooled)) AS p FROM (SELECT g, a, b, max(y) AS y, sum(w * logit) / (sum(w) + 1e-9::DOUBLE) AS pooled FROM
          (SELECT *, exp((logit - max(logit) OVER (PARTITION BY g, a, b)) / 0.1::DOUBLE) AS w FROM (SELECT g, least(ca, cb) AS a, greatest(ca, cb) AS b, logit, y FROM EL WHERE NOT same)) GROUP BY ALL)))""")
def two_level_loss(spark, d):
    return rounded(score.two_level_loss(_edge_logits(spark, d)), "point", "pair", "loss")


@query("SELECT g, ch, m.other AS other, " + r6(gap="m.gap") + " FROM (SELECT a.g, a.ch, min({'gap': abs(a.x - b.x), 'other': b.ch}) AS m FROM (SELECT g, ch, avg(cx) AS x FROM CT GROUP BY ALL) a JOIN (SELECT g, ch, avg(cx) AS x FROM CT GROUP BY ALL) b ON a.g = b.g AND a.ch <> b.ch GROUP BY ALL)")
def nearest_char(spark, d):
    return rounded(analyze.nearest_char(_contours(spark, d)), "gap")


# I: decoding


@query("SELECT g, ca, cb, n_edges, label, " + r6("prob") + " FROM PR")
def pair_max(spark, d):
    return rounded(_pairs(spark, d), "prob")


@query("SELECT g, threshold, c, grp FROM GR")
def char_groups(spark, d):
    return _groups(spark, d)


@query("SELECT g, threshold, c, grp FROM GR")
def char_groups_by_forest(spark, d):
    return decode.char_groups_by_forest(_pairs(spark, d), _owner(spark, d).select("g", "c"), THRESHOLDS)


@query("SELECT g, c, grp FROM GR WHERE threshold = 0.3::DOUBLE")
def char_groups_by_labels(spark, d):
    return decode.char_groups_by_labels(_pairs(spark, d).where("prob >= 0.3").select("g", "ca", "cb"), _owner(spark, d).select("g", "c"))


_ORDERED = "SELECT g, threshold, row_number() OVER (PARTITION BY g, threshold ORDER BY x, grp) - 1 AS pos, grp, members FROM (SELECT GR.g, threshold, grp, min(x) AS x, list(GR.c ORDER BY GR.c) AS members FROM GR JOIN (SELECT g, c, min(x) AS x FROM ND GROUP BY ALL) l ON l.g = GR.g AND l.c = GR.c GROUP BY ALL)"


@query(f"SELECT g, threshold, pos, grp, array_to_string(members, ',') AS members FROM ({_ORDERED})")
def ordered_groups(spark, d):
    return decode.ordered_groups(_groups(spark, d), fixtures.nodes(spark, d)).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query(f"SELECT g, threshold, unnest(members) AS c, pos FROM ({_ORDERED})")
def contour_to_group(spark, d):
    return decode.ordered_groups(_groups(spark, d), fixtures.nodes(spark, d)).select("g", "threshold", F.explode("members").alias("c"), "pos")


@query("SELECT g, ch, array_to_string(list(c ORDER BY c), ',') AS members FROM OW GROUP BY ALL")
def truth_groups(spark, d):
    return decode.truth_groups(_owner(spark, d)).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("SELECT g, threshold, correct AS equal FROM EX")
def groups_equal(spark, d):
    return decode.partitions_equal(_groups(spark, d), decode.truth_groups(_owner(spark, d)))


@query("SELECT CT.g, c // 4 AS grp, count(*) AS n, " + r6(sum_s="sum(cy)", max_s="max(cy)", min_x="min(min_x)", min_y="min(min_y)", max_x="max(max_x)", max_y="max(max_y)", arc="sum(arc)", area="sum(abs(area))") + " FROM CT GROUP BY ALL")
def accumulator_merge(spark, d):
    halves = _accumulated(spark, d).withColumn("grp", F.expr("grp div 2"))
    return rounded(decode.merged(halves), "sum_s", "max_s", "min_x", "min_y", "max_x", "max_y", "arc", "area")


@query("SELECT g, ca, cb, " + r6("prob") + " FROM (SELECT g, ca, cb, prob FROM PR UNION ALL SELECT g, cb, ca, prob FROM PR)")
def bridge_symmetric(spark, d):
    return rounded(decode.symmetric(_pairs(spark, d)), "prob")


def _greedy(margins: str) -> str:
    """SQL of decode.greedy_groups by _halved, one candidate after the other."""
    end = lambda x, f: f"{f}(par[{x}.ca + 1], par[{x}.cb + 1])"
    return f"""(WITH RECURSIVE gp AS (SELECT g, list({{'ca': ca, 'cb': cb, 'prob': prob}}) AS ps FROM PR GROUP BY g),
          go AS (SELECT g, ca, cb, row_number() OVER (PARTITION BY g ORDER BY prob DESC, ca, cb) AS r FROM PR WHERE prob >= 0.1),
          gs AS (SELECT g, margin, 0::BIGINT AS r, range(8) AS par FROM (SELECT DISTINCT g FROM ND), (SELECT unnest({margins})::DOUBLE AS margin) UNION ALL
          SELECT g, margin, r, CASE WHEN a <> b AND (CASE WHEN len(list_filter(par, lambda v: v IN (a, b))) <= 3 THEN link ELSE link / 2 END) >= margin THEN list_transform(par, lambda v: CASE WHEN v = b THEN a ELSE v END) ELSE par END FROM (
          SELECT *, list_max(list_transform(list_filter(ps, lambda q: {end('q', 'least')} = a AND {end('q', 'greatest')} = b), lambda q: q.prob)) AS link FROM (
          SELECT gs.g, margin, go.r, par, ps, {end('go', 'least')} AS a, {end('go', 'greatest')} AS b FROM gs JOIN go ON go.g = gs.g AND go.r = gs.r + 1 JOIN gp ON gp.g = gs.g)))
          SELECT f.g, margin AS threshold, OW.c, par[OW.c + 1] AS grp FROM (SELECT g, margin, max_by(par, r) AS par FROM gs GROUP BY ALL) f JOIN OW ON OW.g = f.g)"""


def _halved(left, right, link):
    """A stand-in for the merge scorer: links of more than three contours count half."""
    return link if len(left) + len(right) <= 3 else link / 2


@query(f"SELECT g, c, grp FROM {_greedy('[0.3]')}")
def greedy_groups(spark, d):
    return decode.greedy_groups(_pairs(spark, d), _owner(spark, d), _halved, 0.3)


@query(f"""SELECT e.margin, graphs, chars, """ + r6(grouping_acc="e.acc", char_split_rate="split / chars", char_merge_rate="merged / chars") + f""" FROM (WITH ce AS MATERIALIZED (SELECT DISTINCT x.g, threshold AS margin, grp, ch FROM {_greedy('[0.2, 0.3, 0.5]')} x JOIN OW ON OW.g = x.g AND OW.c = x.c)
          SELECT a.margin, acc, graphs, chars, split, merged FROM (SELECT margin, avg(ok::INT) AS acc, count(*) AS graphs FROM (SELECT g, margin, count(DISTINCT grp) = count(DISTINCT ch) AND count(DISTINCT ch) = count(*) AS ok FROM ce GROUP BY ALL) GROUP BY ALL) a
          JOIN (SELECT margin, count(*) AS chars, count(*) FILTER (s) AS split, count(*) FILTER (m) AS merged FROM (SELECT ce.margin, ce.g, ch, count(*) > 1 AS s, max(k) > 1 AS m FROM ce JOIN (SELECT margin, g, grp, count(*) AS k FROM ce GROUP BY ALL) w ON w.margin = ce.margin AND w.g = ce.g AND w.grp = ce.grp GROUP BY ALL) GROUP BY ALL) b ON b.margin = a.margin) e""")
def greedy_sweep(spark, d):
    pairs, owner = _pairs(spark, d), _owner(spark, d)
    margins = [0.2, 0.3, 0.5]
    groups = [decode.greedy_groups(pairs, owner, _halved, m).withColumn("threshold", F.lit(m)) for m in margins]
    return rounded(metrics.group_sweep(functools.reduce(DataFrame.union, groups), owner, _graphs(spark, d), margins), "grouping_acc", "char_split_rate", "char_merge_rate")


# J: evaluation


@query("SELECT g, c, ch FROM OW")
def contour_owner(spark, d):
    return _owner(spark, d)


@query("SELECT threshold, tp, fp, fn, pairs, " + r6("pair_precision", "pair_recall", "pair_f1") + " FROM PS")
def pair_prf(spark, d):
    return rounded(metrics.pair_scores(_pairs(spark, d), THRESHOLDS), "pair_precision", "pair_recall", "pair_f1")


@query("""SELECT tp, fp, fn, tn, """ + r6(precision="p", recall="r", f1="2 * p * r / greatest(p + r, 1e-12::DOUBLE)", negative_f1="2 * np * nr / greatest(np + nr, 1e-12::DOUBLE)") + """ FROM (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r, tn / greatest(tn + fn, 1) AS np, tn / greatest(tn + fp, 1) AS nr FROM (
          SELECT count(*) FILTER (hit AND truth) AS tp, count(*) FILTER (hit AND NOT truth) AS fp, count(*) FILTER (NOT hit AND truth) AS fn, count(*) FILTER (NOT hit AND NOT truth) AS tn FROM FX6))""")
def edge_confusion(spark, d):
    return rounded(metrics.confusion(_judged(spark, d)), "precision", "recall", "f1", "negative_f1")


@query("SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS k FROM events")
def dense_relabel(spark, d):
    return geometry.cluster_ids(table(spark, d, "events"), "user_id", "event_type").select("user_id", "event_id", F.col("char_id").alias("k"))


@query("SELECT threshold, count(*) AS graphs, " + r6(grouping_acc="avg(correct::INT)") + " FROM EX GROUP BY ALL")
def grouping_accuracy(spark, d):
    e = metrics.exact_graphs(_cells(spark, d), _graphs(spark, d), THRESHOLDS)
    return rounded(e.groupBy("threshold").agg(F.count("*").alias("graphs"), F.avg(F.col("correct").cast("double")).alias("grouping_acc")), "grouping_acc")


@query("SELECT threshold, chars, split, " + r6(rate="split / chars") + " FROM CR")
def split_rate(spark, d):
    return rounded(metrics.char_rates(_cells(spark, d)).select("threshold", "chars", "split", (F.col("split") / F.col("chars")).alias("rate")), "rate")


@query("SELECT threshold, chars, merged, " + r6(rate="merged / chars") + " FROM CR")
def merge_rate(spark, d):
    return rounded(metrics.char_rates(_cells(spark, d)).select("threshold", "chars", "merged", (F.col("merged") / F.col("chars")).alias("rate")), "rate")


_SWEEP = ("grouping_acc", "char_split_rate", "char_merge_rate", "pair_precision", "pair_recall", "pair_f1")


def _sweep(spark, d):
    return rounded(metrics.sweep(_pairs(spark, d), _owner(spark, d), _graphs(spark, d)), *_SWEEP)


@query("SELECT threshold, graphs, chars, pairs, " + r6(*_SWEEP) + " FROM SW")
def threshold_sweep(spark, d):
    return _sweep(spark, d)


@query("SELECT threshold, graphs, chars, pairs, " + r6(*_SWEEP) + " FROM SW ORDER BY grouping_acc DESC, threshold DESC LIMIT 1")
def best_threshold(spark, d):
    return metrics.best(_sweep(spark, d))


_BROKEN = "(SELECT 'line ' || (g % 5) AS text, count(*) AS n, count(*) FILTER (correct) AS correct FROM EX WHERE threshold = 0.3::DOUBLE GROUP BY 1)"


def _breakdown(spark, d, top):
    e = metrics.exact_graphs(_cells(spark, d), _graphs(spark, d), THRESHOLDS).where("threshold = 0.3").withColumn("text", F.concat(F.lit("line "), F.col("g") % 5))
    return metrics.breakdown(e, "text", top)


@query("SELECT text, n, correct, 2::BIGINT AS more, " + r6(accuracy="correct / n") + f" FROM {_BROKEN} ORDER BY correct / n, n DESC, text LIMIT 3")
def text_breakdown(spark, d):
    return rounded(_breakdown(spark, d, 3), "accuracy")


@query(f"""SELECT row_number() OVER (ORDER BY correct / n, n DESC, text) AS pos, text || lpad(n::VARCHAR, 7, ' ') || lpad(correct::VARCHAR, 9, ' ') || lpad(printf('%.4f', correct / n), 9, ' ') AS line FROM (SELECT * FROM {_BROKEN} ORDER BY correct / n, n DESC, text LIMIT 3)
          UNION ALL SELECT 4, '... 2 more'""")
def breakdown_report(spark, d):
    return metrics.breakdown_report(_breakdown(spark, d, 3))


@query("SELECT 'all' AS kind, count(*) FILTER (label) AS tp, count(*) FILTER (NOT label) AS fp, 0::BIGINT AS fn FROM PR UNION ALL SELECT 'oracle', count(*) FILTER (label), 0, 0 FROM PR UNION ALL SELECT 'none', 0, 0, count(*) FILTER (label) FROM PR")
def known_answers(spark, d):
    p = decode.pair_max(_edges(spark, d).withColumn("prob", F.lit(0.0)))
    rows = p.withColumn("kind", F.explode(F.array(F.lit("oracle"), F.lit("all"), F.lit("none"))))
    rows = rows.withColumn("hit", F.when(F.col("kind") == "oracle", F.col("label")).otherwise(F.col("kind") == "all")).withColumnRenamed("label", "true")
    return metrics.confusion(rows, ["kind"]).select("kind", "tp", "fp", "fn")


# K: analysis


@query("SELECT i.*, n.*, p.*, " + r6(decision_share="inter / (intra + inter)") + """ FROM (SELECT count(*) FILTER (same) AS intra, count(*) FILTER (same AND label) AS intra_positive, count(*) FILTER (NOT same) AS inter, count(*) FILTER (NOT same AND label) AS inter_positive FROM EF) i,
          (SELECT count(*) AS nodes, count(DISTINCT (g, c)) AS contours FROM ND) n, (SELECT count(*) AS pairs, count(*) FILTER (label) AS pair_positive FROM PR) p""")
def edge_composition(spark, d):
    return rounded(analyze.edge_composition(_edges(spark, d), fixtures.nodes(spark, d)), "decision_share")


@query("SELECT " + r6("median", "mean", "p95", amplified="1 - pow(0.99::DOUBLE, greatest(median, 1))") + " FROM (SELECT quantile_cont(n_edges, 0.5) AS median, avg(n_edges) AS mean, quantile_cont(n_edges, 0.95) AS p95 FROM PR)")
def pair_edge_stats(spark, d):
    return rounded(analyze.pair_edge_stats(_pairs(spark, d)), "median", "mean", "p95", "amplified")


@query("""SELECT h.g, start, """ + r6("reach", "width", share="CASE WHEN width = 0 THEN 0 ELSE reach / width END") + """ FROM (SELECT w.g, start, max(abs(a.x - b.x)) AS reach FROM (
          WITH RECURSIVE w AS (SELECT g, n AS start, n, 0 AS h FROM ND WHERE n % 64 = 0 UNION SELECT w.g, start, EF.dst, h + 1 FROM w JOIN EF ON EF.g = w.g AND EF.src = w.n WHERE h < 4) SELECT DISTINCT g, start, n FROM w) w
          JOIN ND a ON a.g = w.g AND a.n = w.n JOIN ND b ON b.g = w.g AND b.n = start GROUP BY ALL) h JOIN (SELECT g, max(x) - min(x) AS width FROM ND GROUP BY g) s ON s.g = h.g""")
def hop_reach(spark, d):
    n = fixtures.nodes(spark, d)
    return rounded(analyze.hop_reach(_edges(spark, d), n, n.where("n % 64 = 0"), 4), "reach", "width", "share")


@query("SELECT " + r6("mean", "median", "p95", "line_width", share="mean / greatest(line_width, 1e-9::DOUBLE)") + """ FROM (SELECT avg(reach) AS mean, quantile_cont(reach, 0.5) AS median, quantile_cont(reach, 0.95) AS p95 FROM (SELECT w.g, start, max(abs(a.x - b.x)) AS reach FROM (
          WITH RECURSIVE w AS (SELECT g, n AS start, n, 0 AS h FROM ND WHERE n % 64 = 0 UNION SELECT w.g, start, EF.dst, h + 1 FROM w JOIN EF ON EF.g = w.g AND EF.src = w.n WHERE h < 8) SELECT DISTINCT g, start, n FROM w) w
          JOIN ND a ON a.g = w.g AND a.n = w.n JOIN ND b ON b.g = w.g AND b.n = start GROUP BY ALL)), (SELECT avg(width) AS line_width FROM (SELECT g, max(x) - min(x) AS width FROM ND GROUP BY g))""")
def receptive_field(spark, d):
    n = fixtures.nodes(spark, d)
    return rounded(analyze.receptive_field(analyze.hop_reach(_edges(spark, d), n, n.where("n % 64 = 0"), 8)), "mean", "median", "p95", "line_width", "share")


@query("""SELECT count(*) AS chars, count(*) FILTER (k > 1) AS multi, count(*) FILTER (parts > 1) AS broken, """ + r6(ceiling="1 - count(*) FILTER (parts > 1) / count(*)") + """ FROM (SELECT g, ch, count(*) AS k, count(DISTINCT r) AS parts FROM (
          WITH RECURSIVE l AS (SELECT DISTINCT EF.g, ca, cb FROM EF WHERE ca <> cb AND label), q AS (SELECT g, c, ch, c AS r FROM OW UNION SELECT q.g, q.c, q.ch, l.cb FROM q JOIN l ON l.g = q.g AND l.ca = q.r)
          SELECT g, c, ch, min(r) AS r FROM q GROUP BY ALL) GROUP BY ALL)""")
def connectivity_ceiling(spark, d):
    return rounded(analyze.connectivity_ceiling(_edges(spark, d), _owner(spark, d)), "ceiling")


_percent = lambda a, b: f"printf('%.1f%%', CASE WHEN {b} = 0 THEN 0 ELSE 100 * {a} / {b} END)"


@query(f"""SELECT unnest(range(5))::INTEGER AS pos, unnest(['edges within contours ' || {_percent('intra', '(intra + inter)')} || ', positive ' || {_percent('intra_positive', 'intra')},
          'edges between contours ' || {_percent('inter', '(intra + inter)')} || ', positive ' || {_percent('inter_positive', 'inter')}, 'contour pairs ' || pairs || ', positive ' || {_percent('pair_positive', 'pairs')},
          'characters ' || chars || ', of several contours ' || {_percent('multi', 'chars')} || ', out of reach ' || {_percent('broken', 'multi')}, 'ceiling ' || {_percent('ceiling', '1')}]) AS line FROM ({ORACLES['edge_composition']}), ({ORACLES['connectivity_ceiling']})""")
def percent_report(spark, d):
    edges = _edges(spark, d)
    ceiling = rounded(analyze.connectivity_ceiling(edges, _owner(spark, d)), "ceiling")
    return analyze.percent_report(analyze.edge_composition(edges, fixtures.nodes(spark, d)), ceiling)


_CANDIDATES = f"""(WITH ch AS (SELECT g, ch, list(c ORDER BY c) AS m, avg(cx) AS x FROM CT GROUP BY ALL),
          nb AS (SELECT a.g, a.ch, min({{'gap': abs(a.x - b.x), 'other': b.ch}}).other AS other FROM ch a JOIN ch b ON a.g = b.g AND a.ch <> b.ch GROUP BY ALL),
          cuts AS (SELECT g, ch, m, unnest(range(least(len(m) - 1, 3))) AS k FROM ch WHERE len(m) > 1),
          own AS (SELECT g, ch, 'cut' AS kind, k, list_filter(m, lambda c: c = m[1] OR (c <> m[len(m)] AND {_draw("(g || ',' || ch || ',' || k || ',' || c)", 'cut')} < 0.5)) AS l, m, 1 AS label FROM cuts),
          every AS (SELECT g, ch, kind, k, l AS "left", list_filter(m, lambda c: NOT list_contains(l, c)) AS "right", label FROM own
          UNION ALL SELECT ch.g, ch.ch, 'whole', 0, ch.m, o.m, 0 FROM ch JOIN nb ON nb.g = ch.g AND nb.ch = ch.ch JOIN ch o ON o.g = ch.g AND o.ch = nb.other
          UNION ALL SELECT ch.g, ch.ch, 'part', 0, ch.m[:len(ch.m) - 1], o.m, 0 FROM ch JOIN nb ON nb.g = ch.g AND nb.ch = ch.ch JOIN ch o ON o.g = ch.g AND o.ch = nb.other WHERE len(ch.m) > 1)
          SELECT e.g, ch, kind, k, array_to_string("left", ',') AS "left", array_to_string("right", ',') AS "right", e.label, coalesce(max(prob), 0) AS link FROM every e LEFT JOIN PR ON PR.g = e.g AND ((list_contains("left", ca) AND list_contains("right", cb)) OR (list_contains("left", cb) AND list_contains("right", ca))) GROUP BY ALL)"""


@query('SELECT g, ch, kind, k, "left", "right", label, ' + r6("link") + f" FROM {_CANDIDATES}")
def merge_candidates(spark, d):
    c = _contours(spark, d).select("g", "c", "ch", "cx")
    return candidates.merge_candidates(c, _pairs(spark, d)).withColumn("left", F.array_join(F.col("left").cast("array<string>"), ",")).withColumn("right", F.array_join(F.col("right").cast("array<string>"), ",")).withColumn("link", F.round("link", 6) + F.lit(0.0)).withColumn("k", F.col("k").cast("bigint"))
