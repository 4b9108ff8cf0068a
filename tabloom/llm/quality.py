"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Native: DataFrame and SQL functions only.

Each document has five base counts and, from them, shares in thousandths. A
sketch of a share is its counts over the grid 0 .. 1000: sketches merge by
adding counts, give every quantile to a thousandth, and do not depend on the
order of the rows. There is one sketch for each language and source; groups
of fewer than ``least`` documents use the merged sketch of their language, and
languages of fewer that of the whole table. A document passes if no share lies
beyond its group's fence, q75 + reach * max(q75 - q25, the share's own floor).
Where bad documents are over a quarter of a group, q75 is itself a bad value;
so the fence is bounded by two that rest on what lies below the median and
below q25. Neither binds where q75 - q25 is within the floor, nor where shares
are spread evenly about the median; a group of which more than three quarters
are bad sets its own norm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, bind, cut

WINDOW = 8
LEAST_WORDS = 20
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares, and the least spread that a fence reckons with, in thousandths.
FLOORS = {"__symbols": 25, "__upper": 50, "__dup_lines": 60, "__repeats": 50}
#: Quantiles of a sketch, in twentieths.
QUANTILES = {"q05": 1, "q25": 5, "q50": 10, "q75": 15}
#: Tables of thresholds of so many groups at most are broadcast (100 bytes each); larger ones are joined by salted keys.
BROADCAST_GROUPS, SALTS = 20_000, 32


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that the text has twice or more."""

    def covered(windows: Column) -> Column:
        order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
            return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

        def length(starts: Column) -> Column:
            parts = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
            return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)

        return bind(bind(order, twice), length)

    def count(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        return bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(bind(hashed, count))


def _thousandths(part: Column, whole: Column) -> Column:
    """Rounded down, 0 .. 1000; 0 where there is nothing."""
    return F.when(whole > 0, F.floor(F.least(part, whole) * 1000 / whole)).otherwise(0).cast("int")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the base counts and the shares ``__...`` to each row; a null text has no words.

    Input columns named like the counts are dropped.
    """
    kept = [c for c in docs.columns if c.lower() not in BASE and not c.startswith("__")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(NOT_SPACE + "+"), F.lit(0))
    solid = F.regexp_replace(text, SPACE + "+", "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    counts = F.struct(
        bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"),
        bind(
            solid,
            lambda s: F.struct(
                F.length(s).cast("long").alias("word_chars"),
                (F.length(s) - F.length(F.translate(s, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.length(s) - F.length(F.translate(s, UPPER, ""))).cast("long").alias("n_upper"),
            ),
        ).alias("s"),
        bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )
    # Filters are not pushed below a generator; below a projection each of their columns would count the words anew.
    made = docs.select(*[f"`{c}`" for c in kept], F.explode_outer(F.array(counts)).alias("__m"))
    return made.select(
        *[f"`{c}`" for c in kept],
        F.col("__m.w.n_words").alias("n_words"),
        F.col("__m.s.word_chars").alias("word_chars"),
        F.col("__m.s.n_symbols").alias("n_symbols"),
        F.col("__m.l.dup").alias("n_dup_lines"),
        F.col("__m.w.n_repeat_words").alias("n_repeat_words"),
        _thousandths(F.col("__m.s.n_symbols"), F.col("__m.s.word_chars")).alias("__symbols"),
        _thousandths(F.col("__m.s.n_upper"), F.col("__m.s.word_chars")).alias("__upper"),
        _thousandths(F.col("__m.l.dup"), F.col("__m.l.n")).alias("__dup_lines"),
        _thousandths(F.col("__m.w.n_repeat_words"), F.col("__m.w.n_words")).alias("__repeats"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sketches(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts over the grid by language, source and share: (lang, source, share, at, n). Null keys are a group of their own."""
    shares = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.col(s).alias("at")) for s in FLOORS])).alias("x")
    narrow = measured.select(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), shares)
    return narrow.groupBy("lang", "source", F.col("x.share").alias("share"), F.col("x.at").alias("at")).agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Merge the sketches of equal *keys*; give size and fence of each share, as one row a group."""
    merged = sketch.groupBy(*keys, "share", "at").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "share")
    # At most 1001 rows in a window: the grid.
    ranked = merged.select(*keys, "share", "at", F.sum("n").over(group.orderBy("at")).alias("upto"), F.sum("n").over(group).alias("size"))
    quantiles = ranked.groupBy(*keys, "share").agg(
        F.max("size").alias("size"),
        *[F.min(F.when(20 * F.col("upto") >= k * F.col("size"), F.col("at"))).alias(q) for q, k in QUANTILES.items()],
    )
    q05, q25, q50, q75 = map(F.col, QUANTILES)
    return quantiles.groupBy(*keys).agg(
        F.max("size").alias("size"),
        *[F.max(F.when(F.col("share") == s, _bounded(q05, q25, q50, q75, F.lit(floor), reach, F.least, F.greatest))).alias(f"{s}_fence") for s, floor in FLOORS.items()],
    )


def _bounded(q05, q25, q50, q75, floor, reach: int, least, greatest):
    """The least of the fence and its two bounds; of columns or of numbers, by the functions given."""
    return least(
        q75 + reach * greatest(q75 - q25, floor),
        q50 + (reach + 1) * greatest(2 * (q50 - q25), floor),
        q25 + (reach + 1) * greatest(4 * (q25 - q05), floor),
    )


def _fence(counts: dict[int, int], floor: int, reach: int) -> int:
    """The fence of one sketch: counts by thousandths."""
    size, upto, q = sum(counts.values()), 0, {}
    for at in sorted(counts):
        upto += counts[at]
        for name, k in QUANTILES.items():
            if name not in q and 20 * upto >= k * size:
                q[name] = at
    return _bounded(*(q.get(name, 0) for name in QUANTILES), floor, reach, min, max)


def thresholds(measured: DataFrame, lang_col: str = "lang", source_col: str = "source", least: int = 50, reach: int = 4) -> DataFrame:
    """One row for each language and source: its fences, from the sketch of the smallest group that is large enough."""
    sketch = cut(sketches(measured, lang_col, source_col))
    names = [f"{s}_fence" for s in FLOORS]
    fine = fences(sketch, ["lang", "source"], reach)
    by_lang = fences(sketch, ["lang"], reach).select(F.col("lang").alias("l"), F.col("size").alias("l_size"), *[F.col(c).alias(f"l_{c}") for c in names])
    # The sketch of the whole table has a grid of counts for each share, so 4004 rows at most.
    grid: dict[str, dict[int, int]] = {s: {} for s in FLOORS}
    for r in sketch.groupBy("share", "at").agg(F.sum("n").alias("n")).collect():
        grid[r["share"]][r["at"]] = r["n"]
    whole = {f"{s}_fence": _fence(grid[s], floor, reach) for s, floor in FLOORS.items()}
    joined = fine.join(by_lang, fine["lang"].eqNullSafe(by_lang["l"]), "left")
    pick = [F.when(F.col("size") >= least, F.col(c)).when(F.col("l_size") >= least, F.col(f"l_{c}")).otherwise(F.lit(whole[c])).alias(c) for c in names]
    return joined.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *pick)


def judge(measured: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Add ``base_failed`` and ``kept`` to measured rows by the thresholds of their group."""
    rows = measured.drop("base_failed", "kept")
    limits = cut(limits)
    same = F.col(lang_col).cast("string").eqNullSafe(F.col("__lang")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source"))
    if limits.count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(limits), same, "left")
    else:
        # A hot group is split over the salts; each of them holds a copy of the thresholds.
        salted = limits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__salt_of", F.pmod(F.xxhash64(*[f"`{c}`" for c in rows.columns]), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, same & (F.col("__salt_of") == F.col("__salt")), "left").drop("__salt_of", "__salt")
    within = F.lit(True)
    for s in FLOORS:
        within = within & (F.col(s) <= F.col(f"{s}_fence"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))).drop("__lang", "__source", *[f"{s}_fence" for s in FLOORS])


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: its id, the base counts, base_failed, kept. Texts are read once and never moved.

    A null or empty text has no words and fails. Rows that repeat an id are
    judged each; null languages and sources are groups of their own.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    measured = cut(measure(narrow).drop("text"))
    out = judge(measured, thresholds(measured))
    return out.select(F.col("id").alias(id_col), *BASE, "base_failed", "kept")


def keep_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows that pass, with their columns as they are, whatever their names. Texts are measured twice rather than moved."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    measured = measure(docs.select(whole, F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")))
    return judge(measured, thresholds(measured)).where("kept").select("row.*")
