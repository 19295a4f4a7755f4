"""How well groups of contours match characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from ..sources.shared import checkpointed
from . import decode

#: Wide and full-width characters, by the ranges that Unicode gives them.
WIDE = "[ᄀ-ᅟ⺀-〾ぁ-꓏ꥠ-ꥼ가-힣豈-﫿︰-﹯！-｠￠-￦\U0001f300-\U0001f64f\U0001f900-\U0001f9ff\U00020000-\U0003fffd]"
#: The thresholds of a sweep.
THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]


def contour_owner(nodes: DataFrame) -> DataFrame:
    """(g, c, ch): one character for each contour, the smallest if its nodes disagree."""
    return nodes.groupBy("g", "c").agg(F.min("ch").alias("ch"))


def pair_scores(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 of pairs at each threshold; 0 on empty denominators."""
    rows = pairs.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hit, true = F.col("prob") >= F.col("threshold"), F.col("label")
    return scored(rows.groupBy("threshold").agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count("*").alias("pairs")))


def confusion(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """tp, fp, fn, tn of hit against true, scores of both classes; denominators at least 1, and 1e-12 for F1."""
    c = rows.groupBy(*keys).agg(F.count_if(F.col("hit") & F.col("true")).alias("tp"), F.count_if(F.col("hit") & ~F.col("true")).alias("fp"), F.count_if(~F.col("hit") & F.col("true")).alias("fn"), F.count_if(~F.col("hit") & ~F.col("true")).alias("tn"))

    def scores(tp: str, fp: str, fn: str):
        p, r = F.col(tp) / F.greatest(F.col(tp) + F.col(fp), F.lit(1)), F.col(tp) / F.greatest(F.col(tp) + F.col(fn), F.lit(1))
        return p, r, 2 * p * r / F.greatest(p + r, F.lit(1e-12))

    p, r, f = scores("tp", "fp", "fn")
    return c.select(*keys, "tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), f.alias("f1"), scores("tn", "fn", "fp")[2].alias("negative_f1"))


def cells(groups: DataFrame, owner: DataFrame) -> DataFrame:
    """(g, threshold, grp, ch): which groups and characters share a contour."""
    return groups.join(owner, ["g", "c"]).select("g", "threshold", "grp", "ch").distinct()


def exact_graphs(shared: DataFrame, graphs: DataFrame, thresholds: list[float]) -> DataFrame:
    """(g, threshold, correct): groups, characters and cells are equally many; graphs without contours are right."""
    n = shared.groupBy("g", "threshold").agg(F.count_distinct("grp").alias("groups"), F.count_distinct("ch").alias("chars"), F.count("*").alias("cells"))
    every = graphs.select("g", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return every.join(n, ["g", "threshold"], "left").select("g", "threshold", F.coalesce((F.col("groups") == F.col("chars")) & (F.col("chars") == F.col("cells")), F.lit(True)).alias("correct"))


def char_rates(shared: DataFrame) -> DataFrame:
    """(threshold, chars, split, merged): characters, those in several groups, those in a group with others."""
    chars = shared.groupBy("threshold", "g", "ch").agg((F.count("*") > 1).alias("is_split"))
    crowd = shared.groupBy("threshold", "g", "grp").agg(F.count("*").alias("n"))
    mixed = shared.join(crowd, ["threshold", "g", "grp"]).groupBy("threshold", "g", "ch").agg(F.max(F.col("n") > 1).alias("is_merged"))
    rows = chars.join(mixed, ["threshold", "g", "ch"])
    return rows.groupBy("threshold").agg(F.count("*").alias("chars"), F.count_if("is_split").alias("split"), F.count_if("is_merged").alias("merged"))


def tally(own: list[tuple], links: list[tuple], thresholds: list[float]) -> list[tuple]:
    """(threshold, correct, chars, split, merged, tp, fp, fn, pairs) of one graph: own has (contour, character) and links
    (ca, cb, prob, label)."""
    ch, out = {c: x for c, x in own if c is not None}, []
    n, true = len(links), sum(1 for *_, label in links if label)
    for t, roots in decode.falling(list(ch), [(p, a, b) for a, b, p, _ in links], thresholds):
        of_char, of_group = {}, {}
        for c, r in roots.items():
            of_char.setdefault(ch[c], set()).add(r)
            of_group.setdefault(r, set()).add(ch[c])
        split, merged = sum(len(x) > 1 for x in of_char.values()), sum(any(len(of_group[r]) > 1 for r in x) for x in of_char.values())
        hits = [label for _, _, p, label in links if p >= t]
        tp = sum(map(bool, hits))
        out.append((t, not split and not merged, len(of_char), split, merged, tp, len(hits) - tp, true - tp, n))
    return out


def tallies(pairs: DataFrame, contours: DataFrame, graphs: DataFrame, thresholds: list[float]) -> DataFrame:
    """(g, threshold, correct, chars, split, merged, tp, fp, fn, pairs) of each graph at each threshold, pairs read once.

    correct: groups and characters are the same; a graph without contours is right. split: characters in several groups,
    merged: those in a group with others.
    """

    own = contours.select("g", "c", F.col("ch").cast("bigint").alias("ch"))
    every = own.union(graphs.select("g", F.lit(None), F.lit(None)).distinct())
    return decode.in_buckets(pairs, every, lambda own, links: tally(own, links, thresholds), ["ch"], "g bigint, threshold double, correct boolean, chars bigint, split bigint, merged bigint, tp bigint, fp bigint, fn bigint, pairs bigint")


def scored(rows: DataFrame) -> DataFrame:
    """pair_precision, pair_recall and pair_f1 of tp, fp and fn; 0 on empty denominators."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.withColumn("pair_precision", p).withColumn("pair_recall", r).withColumn("pair_f1", ratio(2 * F.col("pair_precision") * F.col("pair_recall"), F.col("pair_precision") + F.col("pair_recall")))


def sweep(pairs: DataFrame, contours: DataFrame, graphs: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """One row for each threshold: grouping accuracy, split and merge rate of characters, and the scores of pairs.

    One pass over pairs: each graph tallies all thresholds, the tallies are summed. Without any pair the pairs' columns
    are null.
    """
    return summed(tallies(pairs, contours, graphs, thresholds))


def summed(rows: DataFrame) -> DataFrame:
    """The rows of sweep of the tallies of all graphs."""
    sums = rows.groupBy("threshold").agg(
        F.avg(F.col("correct").cast("double")).alias("grouping_acc"), F.count("*").alias("graphs"), *[F.sum(c).alias(c) for c in ("chars", "split", "merged", "tp", "fp", "fn", "pairs")],
    ).where("chars > 0")
    rows = scored(sums.withColumn("char_split_rate", ratio(F.col("split"), F.col("chars"))).withColumn("char_merge_rate", ratio(F.col("merged"), F.col("chars"))))
    seen = lambda c: F.when(F.col("pairs") > 0, F.col(c)).alias(c)
    return rows.select("threshold", "grouping_acc", "graphs", "chars", "char_split_rate", "char_merge_rate", seen("pair_precision"), seen("pair_recall"), seen("pair_f1"), seen("pairs"))


def group_sweep(groups: DataFrame, owner: DataFrame, graphs: DataFrame, margins: list[float]) -> DataFrame:
    """One row for each margin of a decoder that isn't a threshold on pairs (groups has g, threshold, c, grp): margin,
    grouping_acc, graphs, chars, char_split_rate, char_merge_rate."""
    shared = checkpointed(cells(groups, owner))
    exact = exact_graphs(shared, graphs, margins).groupBy("threshold").agg(F.avg(F.col("correct").cast("double")).alias("grouping_acc"), F.count("*").alias("graphs"))
    rates = char_rates(shared).select("threshold", "chars", ratio(F.col("split"), F.col("chars")).alias("char_split_rate"), ratio(F.col("merged"), F.col("chars")).alias("char_merge_rate"))
    return exact.join(rates, "threshold").withColumnRenamed("threshold", "margin")


def best(rows: DataFrame, ties_high: bool = True, by: str = "threshold") -> DataFrame:
    """The row of highest accuracy, of equals that of the highest (or lowest) threshold or margin."""
    key = F.struct("grouping_acc", F.col(by) if ties_high else -F.col(by))
    return rows.agg(F.max_by(F.struct(*rows.columns), key).alias("r")).select("r.*")


def breakdown(correct: DataFrame, text: str, top: int) -> DataFrame:
    """(text, n, correct, accuracy, more): by text, the worst first, of equals the more frequent, then by text; the top,
    each with how many texts are left out."""
    rows = correct.groupBy(text).agg(F.count("*").alias("n"), F.count_if("correct").alias("correct")).withColumn("accuracy", F.col("correct") / F.col("n"))
    rows = checkpointed(rows)
    return rows.orderBy("accuracy", F.desc("n"), text).limit(top).withColumn("more", F.lit(max(0, rows.count() - top)).cast("bigint"))


def display_width(text: Column) -> Column:
    """Columns that a text takes up: two for wide and full-width characters, one for others; null takes none."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) * 2 - F.length(F.regexp_replace(text, WIDE, ""))).cast("bigint")


def _cell(column: str, width: int, places: int) -> Column:
    return F.lpad(F.format_number(F.col(column), places), width, " ")


def report(rows: DataFrame) -> DataFrame:
    """(line): a line of fixed width for each row of a sweep."""
    return rows.select("threshold", F.concat(_cell("threshold", 6, 2), *[_cell(c, 9, 4) for c in ("grouping_acc", "char_split_rate", "char_merge_rate", "pair_f1")]).alias("line"))


def group_report(rows: DataFrame, ties_high: bool = True) -> DataFrame:
    """(margin, line): a line of fixed width for each margin, the best marked."""
    top = best(rows, ties_high, "margin").select(F.col("margin").alias("top"))
    mark = F.when(F.col("margin") == F.col("top"), "  <- best").otherwise("")
    return rows.join(F.broadcast(top)).select("margin", F.concat(_cell("margin", 7, 2), *[_cell(c, 9, 4) for c in ("grouping_acc", "char_split_rate", "char_merge_rate")], mark).alias("line"))


def breakdown_report(rows: DataFrame, text: str = "text") -> DataFrame:
    """(pos, line): a breakdown as lines of fixed width, and a last one of how many texts are left out, if any.

    rows is a breakdown, as many rows as its top."""
    wide = rows.withColumn("w", display_width(F.col(text)))
    whole = wide.crossJoin(F.broadcast(wide.agg(F.greatest(F.max("w"), F.lit(4)).alias("width"))))
    pos = F.row_number().over(Window.orderBy("accuracy", F.desc("n"), text)).cast("bigint")
    shown = F.concat(F.col(text), F.repeat(F.lit(" "), (F.col("width") - F.col("w")).cast("int")), F.lpad(F.col("n").cast("string"), 7, " "), F.lpad(F.col("correct").cast("string"), 9, " "), _cell("accuracy", 9, 4))
    lines = whole.select(pos.alias("pos"), shown.alias("line"))
    rest = rows.agg(F.max("more").alias("more"), F.count("*").alias("n")).where("more > 0").select((F.col("n") + 1).alias("pos"), F.concat(F.lit("... "), F.col("more").cast("string"), F.lit(" more")).alias("line"))
    return lines.union(rest)
