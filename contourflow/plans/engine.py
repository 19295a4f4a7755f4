"""From contours to groups, scores and payloads in one call each; options with their defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logit
from ..operators import analyze, candidates, decode, generate, geometry, graph, metrics, model, score, store, train
from ..operators.buckets import in_buckets
from ..sources import readers, shards
from ..sources.shared import checkpointed, passed, written


@dataclass(frozen=True)
class GraphOptions:
    """How a graph is built. Scoring must use what training used."""

    knn: int = graph.KNN
    radius: float = graph.RADIUS
    contour_bridge: float = graph.CONTOUR_BRIDGE
    stack_bridge: float = graph.STACK_BRIDGE
    spacing: float = geometry.SPACING
    fewest: int = geometry.FEWEST
    most: int = geometry.MOST


@dataclass(frozen=True)
class CorpusOptions:
    """What a generated corpus draws from; ranges are checked."""

    count: int = 1000
    seed: int = 0
    shard_size: int = 1000
    text_length: tuple[int, int] = (2, 12)
    aspect: tuple[float, float] = (1.0, 1.0)
    tracking: tuple[float, float] = (0.0, 0.0)
    tracking_skew: float = 1.0
    decorative: float = generate.DECORATIVE
    jitter: float = 0.0
    noise: float = 0.0
    em_scale: float = 1.0
    baseline: float = 0.0
    text_ratio: float = 1.0
    graph: GraphOptions = field(default_factory=GraphOptions)

    def __post_init__(self):
        generate.check_bounds(text_length=self.text_length, aspect=self.aspect, tracking=self.tracking, jitter=(0.0, self.jitter), noise=(0.0, self.noise))
        if self.count < 0 or self.shard_size < 1:
            raise ValueError("count must not be negative and shard_size must be positive")


def build(points: DataFrame, options: GraphOptions = GraphOptions()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """contours, nodes and edges of outlines: points has g, c, ch, i, x, y in em. Each is written once; all that follows reads
    them. Nodes and edges are Parquet: of a checkpoint, rows of plain numbers, they would take most of the disk."""
    dense = checkpointed(graph.dense_contours(geometry.contour_stats(points, ["g", "c"], carry=["ch"])))
    kept = dense.drop("c").withColumnRenamed("new_c", "c")
    own = points.join(dense.select("g", "c", "new_c"), ["g", "c"]).drop("c").withColumnRenamed("new_c", "c")
    samples = geometry.resample(own, ["g", "c"], options.spacing, options.fewest, options.most)
    nodes = written(graph.node_features(samples, kept).join(kept.select("g", "c", "ch"), ["g", "c"]))
    edges = written(graph.built_edges(nodes, graph.normalized(kept), options.knn, options.radius, options.contour_bridge, options.stack_bridge))
    return kept, nodes, edges


def seeded_scorer(nodes: DataFrame, edges: DataFrame, contours: DataFrame) -> DataFrame:
    """What a model that learned nothing says."""
    return model.model_scores(nodes, edges, graph.contour_features(contours))


def trained_scorer(raw: bytes) -> Callable[[DataFrame, DataFrame, DataFrame], DataFrame]:
    """The scorer of a weight dump (readers.write_weights)."""
    options, weights = model_of(raw)
    return lambda nodes, edges, contours: model.model_scores(nodes, edges, graph.contour_features(contours), options, weights)


def model_of(raw: bytes) -> tuple[model.Options, dict[str, np.ndarray]]:
    """Options and checked weights of a dump."""
    named, weights = readers.read_weights(raw)
    options = model.Options.of(named)
    return options, model.checked(options, weights)


def scored(nodes: DataFrame, edges: DataFrame, contours: DataFrame, scorer: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = seeded_scorer) -> DataFrame:
    """edges with prob: the scorer's (g, e, prob) between contours, 1 within."""
    return decode.filled(edges, scorer(nodes, edges, contours))


def segment(points: DataFrame, scorer=seeded_scorer, threshold: float = 0.5, options: GraphOptions = GraphOptions()) -> DataFrame:
    """(g, threshold, pos, grp, members): the characters of each line, from left to right."""
    contours, nodes, edges = build(points, options)
    groups = decode.char_groups(decode.pair_max(scored(nodes, edges, contours, scorer)), contours, [threshold])
    return decode.ordered_groups(groups, nodes)


def evaluate(points: DataFrame, scorer=seeded_scorer, thresholds: list[float] = metrics.THRESHOLDS, options: GraphOptions = GraphOptions()) -> DataFrame:
    """A row of metrics for each threshold, on lines whose characters are known."""
    contours, nodes, edges = build(points, options)
    return metrics.sweep(decode.pair_max(scored(nodes, edges, contours, scorer)), contours.select("g", "c", "ch"), contours.select("g").distinct(), thresholds)


def evaluate_merging(points: DataFrame, raw: bytes | None = None, margins: list[float] = model.MARGINS, options: GraphOptions = GraphOptions()) -> DataFrame:
    """A row of metrics for each margin of the merge scorer: of a weight dump, or of a model that learned nothing."""
    contours, nodes, edges = build(points, options)
    how, weights = model_of(raw) if raw else (model.Options(), None)
    groups = model.merged_groups(nodes, edges, graph.contour_features(contours), margins, how, weights)
    return metrics.group_sweep(groups, contours.select("g", "c", "ch"), contours.select("g").distinct(), margins)


def losses(points: DataFrame, raw: bytes | None = None, pair_weight: float = 0.5, options: GraphOptions = GraphOptions()) -> DataFrame:
    """One row (point, pair, loss): the two-level loss of a weight dump, or of a model that learned nothing, on lines whose
    characters are known; edges within contours are scored too."""
    contours, nodes, edges = build(points, options)
    how, weights = model_of(raw) if raw else (model.Options(), None)
    probs = model.model_scores(nodes, edges, graph.contour_features(contours), how, weights, every=True)
    p = F.greatest(F.least("prob", F.lit(1 - 1e-12)), F.lit(1e-12))
    rows = edges.join(probs, ["g", "e"]).select("g", "ca", "cb", logit(p).alias("logit"), F.col("label").cast("double").alias("y"))
    return score.two_level_loss(rows, pair_weight)


def train_model(points: DataFrame, how: model.Options = model.Options(), recipe: train.Recipe = train.Recipe(), held: DataFrame | None = None, options: GraphOptions = GraphOptions(), thresholds: list[float] = metrics.THRESHOLDS) -> train.Trained:
    """A model fitted to lines whose characters are known. The epoch that groups the held lines best stays, or, without
    any, that of the smallest loss. The merge scorer, if how has one, learns from merge candidates of the same lines."""
    cands = None
    if how.group:
        contours = graph.dense_contours(geometry.contour_stats(points, ["g", "c"], carry=["ch"])).drop("c").withColumnRenamed("new_c", "c")
        contours = passed(contours.select("g", "c", "ch", "cx"))
        links = points.sparkSession.createDataFrame([], "g bigint, ca bigint, cb bigint, prob double")
        cands = candidates.merge_candidates(contours.where("ch is not null").select("g", "c", "ch", "cx"), links, recipe.seed)
    judge = None
    if held is not None:
        own = build(held, options)

        def judge(weights: dict[str, np.ndarray]) -> float:
            probs = model.model_scores(own[1], own[2], graph.contour_features(own[0]), how, weights)
            swept = metrics.sweep(decode.pair_max(decode.filled(own[2], probs)), own[0].select("g", "c", "ch"), own[0].select("g").distinct(), thresholds)
            return metrics.best(swept).first()["grouping_acc"]

    # A contour's points give some twice as many nodes.
    n = 2 * points.count()
    rows = graph.outline_samples(in_buckets(points, n), ["bucket", "g"], options.spacing, options.fewest, options.most)
    graphs = train.built_graphs(rows, n, cands, options.knn, options.radius, options.contour_bridge, options.stack_bridge)
    return train.fit(graphs, how, recipe, judge=judge)


def dumped(trained: train.Trained) -> bytes:
    """The weight dump of a trained model, as trained_scorer and others take it."""
    return readers.write_weights(asdict(trained.options), trained.weights)


def export_json(points: DataFrame, texts: DataFrame, scorer=seeded_scorer, options: GraphOptions = GraphOptions(), timing: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(g, payload): each line's text, outlines, nodes and scored edges as JSON; texts has g and text."""
    contours, nodes, edges = build(points, options)
    ids = graph.dense_contours(geometry.contour_stats(points, ["g", "c"])).select("g", "c", "new_c")
    outlines = points.join(ids, ["g", "c"]).drop("c").withColumnRenamed("new_c", "c")
    return readers.payloads(texts, nodes, scored(nodes, edges, contours, scorer), outlines, timing)


def oracle_scorer(nodes: DataFrame, edges: DataFrame, contours: DataFrame) -> DataFrame:
    """Scores edges by their labels: what a perfect model would say."""
    return score.scored_edges(edges).select("g", "e", F.col("label").cast("double").alias("prob"))


def lines(spark, options: CorpusOptions, body: list[str], decorative: list[str], pool: list[str], texts: DataFrame | None = None, n_texts: int = 0) -> DataFrame:
    """(g, text, font, tracking, aspect, jitter, noise): what each line of a corpus is drawn as, by its number g.

    texts (pos, text) with pos from 0 to n_texts - 1 are taken in turn; below a text_ratio of 1 that share of the lines
    holds one among characters of the pool, the others are of the pool alone. Every number is drawn from (seed, g, purpose).
    """
    low, high = options.text_length
    rows = generate.pool_choice(spark.range(options.count).withColumnRenamed("id", "g"), "g", body, decorative, options.decorative, options.seed)
    if not n_texts:
        rows = generate.random_text(rows, "g", pool, low, high, options.seed)
    else:
        rows = generate.round_robin(rows, "g", texts.select("pos", F.col("text").alias("pattern")), n_texts).drop("pos").withColumn("text", F.col("pattern"))
        if options.text_ratio < 1:
            fixed = generate.draw(options.seed, F.col("g"), "mixed") < options.text_ratio
            rows = generate.embed_pattern(rows, "g", "pattern", pool, low, high, options.seed).withColumnRenamed("text", "mixed")
            rows = generate.random_text(rows, "g", pool, low, high, options.seed).withColumn("text", F.when(fixed, F.col("mixed")).otherwise(F.col("text"))).drop("mixed")
        rows = rows.drop("pattern")
    return generate.layout_draws(rows, "g", options.tracking, options.tracking_skew, options.aspect, options.jitter, options.noise, options.seed)


def laid_out(lines: DataFrame, glyphs: DataFrame, outlines: DataFrame, options: CorpusOptions = CorpusOptions(), ligatures: DataFrame | None = None, kerning: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, g, c, ch, i, x, y) in em: the outlines of each line's characters, set side by side. by: columns of lines that tell
    what they are dealt by; rows that are dealt by them stay where they are.

    glyphs has font, char, upem, advance, dx, dy; outlines font, char, k, i, x, y, all in font units; ligatures font, parts,
    char, where char is a glyph's; kerning font, char, next, kern. Characters without
    a glyph take no room, glyphs without an outline (spaces) only room. Each point is moved by pen and offset, by the
    glyph's own baseline jitter and its own noise, then scaled in x.
    """
    seed, line = options.seed, [*by, "g"]
    marks = geometry.shaped(lines.select(*line, "font", "text", "tracking", "aspect", "jitter", "noise"), ligatures).withColumnRenamed("k", "place")
    marks = geometry.cluster_ids(marks, line, "at").join(glyphs, ["font", "char"])
    if kerning is not None:
        marks = geometry.kerned(marks.withColumnRenamed("place", "k"), kerning, line).withColumnRenamed("k", "place").withColumn("advance", F.col("advance") + F.col("kern")).drop("kern")
    marks = geometry.pen_positions(marks, line, ["place"], F.col("advance"), F.col("tracking") * F.col("upem"))
    spread = lambda what, cap, *of: (2 * generate.draw(seed, F.concat_ws(",", "g", "place", *of), what) - 1) * F.col(cap) * F.col("upem")
    marks = marks.withColumn("up", F.col("dy") + F.when(F.col("jitter") > 0, spread("baseline", "jitter")).otherwise(0.0))
    points = marks.join(outlines, ["font", "char"])
    noise = [F.when(F.col("noise") > 0, spread(what, "noise", "k", "i")).otherwise(0.0) for what in ("noise x", "noise y")]
    points = geometry.affine(points, F.col("pen") + F.col("dx"), F.col("up"), *noise, F.col("aspect"))
    em = F.col("upem") * options.em_scale
    number = F.dense_rank().over(Window.partitionBy(*line).orderBy("place", "k")) - 1
    return points.select(*line, number.cast("bigint").alias("c"), F.col("char_id").alias("ch"), "i", (F.col("x") / em).alias("x"), ((F.col("y") + F.lit(options.baseline) * F.col("upem")) / em).alias("y"))


def generate_corpus(lines: DataFrame, glyphs: DataFrame, outlines: DataFrame, options: CorpusOptions = CorpusOptions(), ligatures: DataFrame | None = None, kerning: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): a nested record for each line, with its text and font, and (g, reason) of the lines that gave none.

    Reasons: no font, no glyphs (nothing to draw), small (fewer than eight nodes, or no edge).

    Only the lines are written and shuffled: they are dealt in buckets of whole lines, and what is drawn of a line, its samples
    and its edges stay in the task that makes its record. Fonts are written too, so that Spark knows which are small enough to
    be sent to all tasks; larger ones are joined by shuffles.
    """
    lines, glyphs, outlines = written(lines), written(glyphs), written(outlines)
    known = glyphs.select("font").distinct().withColumn("known", F.lit(True))
    # A character has some 32 nodes.
    lines = in_buckets(lines.join(known, "font", "left"), 32 * (lines.agg(F.sum(F.length("text"))).first()[0] or 0))
    how = options.graph
    rows = graph.outline_samples(laid_out(lines, glyphs, outlines, options, ligatures, kerning, ("bucket",)), ["bucket", "g"], how.spacing, how.fewest, how.most)
    given = rows, lines.select("bucket", "g", "text", "font", F.coalesce("known", F.lit(False)).alias("known")), how.knn, how.radius, how.contour_bridge, how.stack_bridge
    return readers.built_records(*given), readers.built_rejects(*given)


def write_corpus(lines: DataFrame, glyphs: DataFrame, outlines: DataFrame, folder: str, options: CorpusOptions = CorpusOptions()) -> DataFrame:
    """Writes a corpus to the shards of a folder; (shard, n) of each."""
    return shards.write(generate_corpus(lines, glyphs, outlines, options)[0], folder, options.shard_size, options.count)


def main(arguments: list[str] | None = None) -> None:
    """Of the outlines in a Parquet table (g, c, ch, i, x, y): sweep, merge, segment, export, analyze, pack (a store in --out)
    or train (a weight dump in --out)."""
    import argparse

    from pyspark.sql import SparkSession

    options = argparse.ArgumentParser(description=main.__doc__)
    options.add_argument("what", choices=["sweep", "merge", "segment", "export", "analyze", "pack", "train"])
    options.add_argument("points")
    options.add_argument("--out", help="folder for the rows as Parquet, else they are shown; for pack and train where the store or dump goes")
    options.add_argument("--weights", help="a weight dump")
    options.add_argument("--threshold", type=float, default=0.5)
    options.add_argument("--knn", type=int, default=graph.KNN)
    options.add_argument("--radius", type=float, default=graph.RADIUS)
    options.add_argument("--contour-bridge", type=float, default=graph.CONTOUR_BRIDGE)
    options.add_argument("--stack-bridge", type=float, default=graph.STACK_BRIDGE)
    options.add_argument("--epochs", type=int, default=train.Recipe.epochs)
    options.add_argument("--hidden", type=int, default=model.Options.hidden)
    given = options.parse_args(arguments)
    if given.what in ("pack", "train") and not given.out:
        options.error(f"{given.what} needs --out")
    points = SparkSession.builder.getOrCreate().read.parquet(given.points)
    how = GraphOptions(given.knn, given.radius, given.contour_bridge, given.stack_bridge)
    raw = None
    if given.weights:
        with open(given.weights, "rb") as f:
            raw = f.read()
    scorer = trained_scorer(raw) if raw else seeded_scorer
    if given.what == "sweep":
        rows = metrics.report(evaluate(points, scorer, options=how)).orderBy("threshold")
    elif given.what == "merge":
        rows = metrics.group_report(evaluate_merging(points, raw, options=how)).orderBy("margin")
    elif given.what == "segment":
        rows = segment(points, scorer, given.threshold, how).orderBy("g", "pos")
    elif given.what == "analyze":
        contours, nodes, edges = build(points, how)
        rows = analyze.edge_composition(edges, nodes).join(analyze.pair_edge_stats(decode.pair_max(edges.withColumn("prob", F.lit(0.0)))))
    elif given.what == "pack":
        contours, nodes, edges = build(points, how)
        store.write({"graphs": store.graph_sizes(nodes, edges), "nodes": nodes, "edges": store.packed_edges(edges), "contours": contours}, given.out)
        return
    elif given.what == "train":
        trained = train_model(points, model.Options(hidden=given.hidden), train.Recipe(epochs=given.epochs), options=how)
        fs, at = shards.opened(given.out)
        with fs.open_output_stream(at) as f:
            f.write(dumped(trained))
        print("\n".join(", ".join(f"{k} {v:.4g}" for k, v in h.items()) for h in trained.history))
        return
    else:
        rows = export_json(points, points.select("g").distinct().withColumn("text", F.lit("")), scorer, how)
    if given.out:
        rows.write.mode("overwrite").parquet(given.out)
    else:
        rows.show(100, truncate=False)


if __name__ == "__main__":
    main()
