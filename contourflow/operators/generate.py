"""Making corpora: pools, texts and layout numbers drawn from counters, so that each row is the same however it is run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running

DECORATIVE = 0.3


def draw(seed: int, row: Column, what: str, k: Column | int = 0) -> Column:
    """A uniform number in [0, 1) for a row, a purpose and a counter: 52 bits of a hash of the four as text."""
    parts = F.concat_ws("|", F.lit(str(seed)), row.cast("string"), F.lit(what), (k if isinstance(k, Column) else F.lit(k)).cast("string"))
    return F.conv(F.substring(F.md5(parts), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def between(u: Column, low, high) -> Column:
    return F.lit(low) + (F.lit(high) - F.lit(low)) * u


def integer(u: Column, low, high) -> Column:
    """An integer from low to high inclusive."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (low + F.floor(u * (high - low + 1))).cast("int")


def skewed(u: Column, low: Column, high: Column, skew: float) -> Column:
    """high - (high - low) * u ** max(skew, 0.001); high if the span is none or negative."""
    span = high - low
    return F.when(span <= 0, high).otherwise(high - span * F.pow(u, F.lit(max(skew, 1e-3))))


def list_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines without the white space around them; blank ones and those that begin with # go."""
    x = F.regexp_replace(column, r"(?U)^\s+|\s+$", "")
    return lines.withColumn(column, x).where((F.col(column) != "") & ~F.col(column).startswith("#"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos: the place of each row in the order, from 0, counted in ranges (scan.running)."""
    return running(rows, order)


def charset(lines: DataFrame, order: str, column: str = "value") -> DataFrame:
    """(pos, ch): all characters of the kept lines in order, repeats included, which weigh. An empty pool is an error.

    Lines are placed by the sizes of those before (numbered by ranges), characters within their line.
    """
    kept = list_lines(lines, column).select(F.col(order).alias("line"), F.filter(F.split(column, ""), lambda c: c != "").alias("chars")).where("size(chars) > 0")
    placed = running(kept.withColumn("n", F.size("chars")), ["line"], {"start": "n"})
    if placed.isEmpty():
        raise ValueError("the character pool is empty")
    return placed.select("start", F.posexplode("chars").alias("i", "ch")).select((F.col("start") + F.col("i")).cast("bigint").alias("pos"), "ch")


def weights(rows: DataFrame, column: str) -> DataFrame:
    """(ch, weight): how often each code point occurs in a text column."""
    chars = rows.where(F.col(column).isNotNull()).select(F.explode(F.split(column, "")).alias("ch")).where("ch <> ''")
    return chars.groupBy("ch").agg(F.count("*").alias("weight"))


def fixed_texts(lines: DataFrame, order: str, column: str = "value") -> DataFrame:
    """(pos, text): the kept lines of a list in order, numbered from 0. An empty list is an error."""
    out = numbered(list_lines(lines, column).select(order, F.col(column).alias("text")), [order]).select("pos", "text")
    if out.isEmpty():
        raise ValueError("the list of texts is empty")
    return out


def round_robin(rows: DataFrame, index: str, texts: DataFrame, n: int) -> DataFrame:
    """rows with the text of number index modulo n; texts has pos and text, one row for each of n."""
    return rows.withColumn("pos", F.pmod(F.col(index), F.lit(n))).join(texts, "pos")


def rejected(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among those kept."""
    return rows.join(kept.select(key), key, "left_anti")


def layout_draws(rows: DataFrame, row: str, tracking: tuple[float, float] = (0.0, 0.0), skew: float = 1.0, aspect: tuple[float, float] = (1.0, 1.0), jitter: float = 0.0, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Adds tracking, aspect, and the caps jitter and noise, each drawn once for a row."""
    u = lambda what: draw(seed, F.col(row), what)
    return (
        rows.withColumn("tracking", skewed(u("tracking"), F.lit(float(tracking[0])), F.lit(float(tracking[1])), skew))
        .withColumn("aspect", between(u("aspect"), float(aspect[0]), float(aspect[1])))
        .withColumn("jitter", between(u("jitter"), 0.0, float(jitter)))
        .withColumn("noise", between(u("noise"), 0.0, float(noise)))
    )


def random_text(rows: DataFrame, row: str, pool: list[str], low: int = 2, high: int = 12, seed: int = 0) -> DataFrame:
    """Adds text: between low and high characters of the pool, drawn with replacement."""
    chars = F.array(*[F.lit(c) for c in pool])
    n = integer(draw(seed, F.col(row), "length"), low, high)
    pick = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(chars, integer(draw(seed, F.col(row), "char", i), 1, len(pool))))
    return rows.withColumn("text", F.array_join(pick, ""))


def embed_pattern(rows: DataFrame, row: str, pattern: str, pool: list[str], low: int = 2, high: int = 12, seed: int = 0) -> DataFrame:
    """Adds text: the pattern of each row with characters around it, together between low (or the pattern's length) and
    high long."""
    size = F.length(pattern)
    total = integer(draw(seed, F.col(row), "total"), F.greatest(F.lit(low), size), F.greatest(F.lit(high), size))
    pad = total - size
    before = integer(draw(seed, F.col(row), "before"), F.lit(0), pad)
    chars = F.array(*[F.lit(c) for c in pool])

    def padding(what: str, n: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.element_at(chars, integer(draw(seed, F.col(row), what, i), 1, len(pool))))
        return F.when(n > 0, F.array_join(F.slice(some, F.lit(1), n), "")).otherwise("")

    return rows.withColumn("text", F.concat(padding("left", before), F.col(pattern), padding("right", pad - before)))


def pool_choice(rows: DataFrame, row: str, body: list[str], decorative: list[str], share: float = DECORATIVE, seed: int = 0) -> DataFrame:
    """Adds font: of the decorative pool with probability share, if there is one, else of the body pool."""
    pick = lambda pool, what: F.element_at(F.array(*[F.lit(x) for x in pool]), integer(draw(seed, F.col(row), what), 1, len(pool)))
    if not decorative:
        return rows.withColumn("font", pick(body, "body"))
    return rows.withColumn("font", F.when(draw(seed, F.col(row), "pool") < share, pick(decorative, "deco")).otherwise(pick(body, "body")))


def text_source(charset_file: str | None, text_file: str | None, ratio: float) -> str:
    """fixed: texts only (the character pool isn't even read); mixed: texts in part; charset: characters only."""
    if text_file is None:
        return "charset"
    return "fixed" if ratio >= 1 else "mixed"


def check_bounds(**bounds: tuple[float, float]) -> None:
    """Raises ValueError for a range whose ends are the wrong way round."""
    for name, (low, high) in bounds.items():
        if low > high:
            raise ValueError(f"{name}: {low} is more than {high}")
