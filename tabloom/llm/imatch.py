"""Document fingerprints: I-Match over randomised subsets of a lexicon.

Native: DataFrame and SQL functions only.

Terms are hashed to 2**BITS term numbers. The lexicon is the set of term
numbers whose frequency lies inside a band of shares of all different texts,
so that a text with many copies does not make its own terms common; no more than (mean distinct terms a document) / (least share) can
do so, however large the corpus, and as a bitmap it takes 2**BITS / 8 bytes
always.

LEVELS * CELLS random subsets are taken of the lexicon: a term lies in one of
the CELLS cells, by its hash, and with a chance of 2**-k in that cell's subset
of level k as well, so each level drops half of what the one before it keeps.
The distinct in-band terms of a document are sorted, and those of each subset
are hashed. A subset survives an edit if it has none of the terms that the
edit changes; so long texts, of which many terms change, agree in the higher
levels, whose subsets hold few of their terms, and short ones in the lower.
Two documents are held against each other in the highest level of which half
the subsets have a term of either, else in the lowest; the share of equal
hashes there, among subsets that have a term of either, is their likeness.

Of a document without in-band terms all terms take their place, marked so that
they only equal those of another such document; without any terms, its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, bound_table, cut, n_parts, range_bounds, range_of

BITS = 21
CELLS, LEVELS = 16, 7
#: Characters of a subset's hash in a fingerprint, and what stands for a subset without terms.
WIDTH = 4
EMPTY = "." * WIDTH
#: A sorted term: its cell, then how far down its level is from the highest, then bits of its hash, never all zero.
_CELL, _LEVEL = 56, 48
_REST = (1 << _LEVEL) - 1

def term_hashes(text: Column) -> Column:
    """Distinct hashes of the lower-cased runs of letters and digits."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _number(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << BITS) - 1))


def _bitmap(numbers: DataFrame, bits: int) -> list[int]:
    """The one column of *numbers*, 0 .. 2**bits - 1, as a bitmap of 2**bits / 64 longs, which is also the most rows collected."""
    (name,) = numbers.columns
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(name).bitwiseAND(F.lit(63)).cast("int"))
    words = numbers.groupBy(F.shiftright(name, 6).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits"))
    out = [0] * ((1 << bits) // 64)
    for r in words.collect():
        out[r["w"]] = r["bits"]
    return out


def _holds(bitmap: list[int]):
    """Whether the bitmap holds the low bits of a hash, as a function of columns."""
    table = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")  # folded to one constant
    mask = F.lit(64 * len(bitmap) - 1)

    def test(h: Column) -> Column:
        word = F.get(table, F.shiftright(h.bitwiseAND(mask), 6).cast("int"))
        return F.bit_get(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def distinct_texts(source: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of *source* (id, h, text) without those whose text has come with a lesser id.

    Only rows that a bitmap of 2**BITS bits takes for repetitions are moved, to
    decide on them exactly; where a corpus has many times as many, that is most.
    """
    lows = keys.groupBy("h").agg(F.min(F.struct("id")).alias("low"), F.count(F.lit(1)).alias("ids")).where("ids > 1")
    again = keys.alias("a").join(lows.alias("b"), F.col("a.h") == F.col("b.h")).where(~F.col("a.id").eqNullSafe(F.col("b.low.id"))).select(F.col("a.id").alias("r_id"), F.col("a.h").alias("r_h"))
    again = cut(again)
    mask = F.lit((1 << BITS) - 1)
    may = _holds(_bitmap(again.select(F.xxhash64("r_id", "r_h").bitwiseAND(mask).alias("t")), BITS))(F.xxhash64("id", "h"))
    asked = source.where(may).join(again, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h")), "left_anti")
    return source.where(~may).unionByName(asked)


def lexicon(docs: DataFrame, text_col: str, least_share: float, most_share: float) -> list[int]:
    """The bitmap of the in-band term numbers as 2**BITS / 64 longs, from the frequencies of all documents."""
    terms = docs.select(F.explode(F.array_distinct(F.transform(term_hashes(F.col(text_col)), _number))).alias("t"))
    n = docs.count()
    counts = terms.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= F.lit(least_share * n)) & (F.col("df") <= F.lit(most_share * n)))
    return _bitmap(counts.select("t"), BITS)


def _placed(h: Column) -> Column:
    """A term as it is sorted: by cell, then by level from the highest down, then by hash."""
    cell = F.shiftright(h, 40).bitwiseAND(F.lit(CELLS - 1))
    odds = F.shiftright(h, 44).bitwiseAND(F.lit((1 << (LEVELS - 1)) - 1))
    # Levels are the number of zero bits that the odds begin with: each is half as likely as the one below it.
    down = F.length(F.ltrim(F.lpad(F.bin(odds), LEVELS - 1, "0"), F.lit("0")))
    low = F.xxhash64(h).bitwiseAND(F.lit(_REST)).bitwiseOR(F.lit(1))
    return F.shiftleft(cell, _CELL).bitwiseOR(F.shiftleft(down.cast("long"), _LEVEL)).bitwiseOR(low)


def subsets(text: Column, bitmap: list[int]) -> Column:
    """The fingerprint: WIDTH hex digits a subset, level after level from the highest, EMPTY for one without terms."""
    test = _holds(bitmap)
    # A mark ends each subset of a cell in the sorted terms: it is the greatest value of its level.
    marks = F.array(*[F.lit((c << _CELL) | (down + 1) << _LEVEL) for c in range(CELLS) for down in range(LEVELS)])
    which = F.array(*[F.lit(c * LEVELS + down) for down in range(LEVELS) for c in range(CELLS)])

    def hashes(terms: Column, lead: Column) -> Column:
        placed = F.array_sort(F.concat(F.transform(terms, _placed), marks))

        def of_sorted(s: Column) -> Column:
            ends = F.filter(F.transform(s, lambda x, i: F.when(x.bitwiseAND(F.lit(_REST)) == 0, i)), lambda i: i.isNotNull())

            def of_ends(e: Column) -> Column:
                def subset(k: Column) -> Column:
                    down = F.pmod(k, F.lit(LEVELS))
                    first = F.when(k == down, F.lit(0)).otherwise(F.get(e, k - down - 1) + 1)
                    size = F.get(e, k) - first  # terms, and a mark for each level above
                    mine = F.xxhash64(lead, F.slice(s, first + 1, F.greatest(size, F.lit(0))))
                    return F.when(size == down, F.lit(EMPTY)).otherwise(F.right(F.lpad(F.lower(F.hex(mine)), 16, "0"), F.lit(WIDTH)))

                return F.array_join(F.transform(which, subset), "")

            return bind(ends, of_ends)

        return bind(placed, of_sorted)

    def all_of(terms: Column) -> Column:
        none = F.array(F.xxhash64(text))
        chosen = F.when(F.size(terms) == 0, F.struct(F.lit(2).alias("lead"), none.alias("t"))).otherwise(
            bind(F.filter(terms, test), lambda known: F.when(F.size(known) > 0, F.struct(F.lit(0).alias("lead"), known.alias("t"))).otherwise(F.struct(F.lit(1).alias("lead"), terms.alias("t"))))
        )
        return bind(chosen, lambda c: hashes(c["t"], c["lead"]))

    return bind(term_hashes(text), all_of)


def fingerprint(text: Column, bitmap: list[int]) -> Column:
    return subsets(F.coalesce(text, F.lit("")), bitmap)


def likeness(a: Column, b: Column) -> Column:
    """The share of subsets with equal hashes among those of which either has a term, 0 to 1, in the level that tells most."""
    size = CELLS * WIDTH

    def of_level(k: int) -> Column:
        def part(x: Column, c: Column) -> Column:
            return F.substring(x, F.lit(k * size + 1) + c * WIDTH, F.lit(WIDTH))

        same = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: F.when((part(a, c) == EMPTY) & (part(b, c) == EMPTY), F.lit(None)).otherwise((part(a, c) == part(b, c)).cast("int")))
        return F.filter(same, lambda x: x.isNotNull())

    def share(s: Column) -> Column:
        return F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.aggregate(s, F.lit(0), lambda p, x: p + x) / F.size(s).cast("double"))

    def best(k: int) -> Column:
        if k == LEVELS - 1:
            return bind(of_level(k), share)
        below = best(k + 1)
        return bind(of_level(k), lambda s: F.when(2 * F.size(s) >= CELLS, share(s)).otherwise(below))

    return best(0)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.002, most_share: float = 0.1) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by
    the first as many of the next document in ascending id order; the first
    follows the last. A null text is empty. Rows that repeat an id are ordered
    by their texts' hashes; rows equal in id and text are one document and give
    equal rows. A single document is its own next.

    Each text moves once, to the range that its id lies in. The first document
    of each range goes to the end of the range before it as well, so that each
    finds its next one beside it.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    keys = cut(source.groupBy("id", "h").agg(F.count(F.lit(1)).alias("copies")))
    n = n_parts(spark)
    bounds = range_bounds(keys.select("id", "h"), n)
    if not bounds:
        bounds = [(0, 0)]
    if keys.where("copies > 1").limit(1).count():
        source = source.groupBy("id", "h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    else:
        source = source.withColumn("copies", F.lit(1).cast("long"))
    bitmap = lexicon(distinct_texts(source.select("id", "h", "text"), keys), "text", least_share, most_share)
    kind = f"struct<a:{docs.schema[id_col].dataType.simpleString()},b:bigint>"
    key = F.struct(F.col("id").alias("a"), F.col("h").alias("b"))
    first = F.array_contains(bound_table(bounds, kind), key.cast(kind))
    ranged = source.withColumn("at", range_of(key, bounds, kind)).withColumn("first", first)
    here = F.struct(F.col("at").alias("at"), F.lit(0).alias("ghost"))
    there = F.struct(F.pmod(F.col("at") - 1, F.lit(len(bounds))).alias("at"), F.lit(1).alias("ghost"))
    dealt = ranged.select("id", "h", "text", "copies", F.explode(F.when(F.col("first"), F.array(here, there)).otherwise(F.array(here))).alias("p"))
    dealt = dealt.select("id", "h", "text", "copies", "p.at", "p.ghost").repartition(n, "at")
    order = Window.partitionBy("at").orderBy("ghost", "id", "h")
    size = F.length("text")
    keep = size - F.floor(size / 4).cast("int")
    # The following text's head only: texts would double what the window holds.
    edited = F.concat(F.left(F.col("text"), keep), F.coalesce(F.left(F.col("following"), size - keep), F.lit("")))
    near = dealt.withColumn("following", F.lead("text").over(order)).select("at", "ghost", "id", "h", "copies", F.length("text").cast("long").alias("n_chars"), "text", F.when(F.col("ghost") == 0, edited).alias("edited"))
    made = near.select(
        *("at", "ghost", "id", "h", "copies", "n_chars"),
        subsets(F.col("text"), bitmap).alias("fingerprint"),
        F.when(F.col("ghost") == 0, bind(F.col("edited"), lambda e: F.struct(F.sha2(e, 256).alias("sha"), subsets(e, bitmap).alias("cells")))).alias("e"),
    )
    out = made.withColumn("next", F.lead("fingerprint").over(order)).where("ghost = 0")
    rows = out.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.col("e.sha").alias("edited_sha256"),
        "fingerprint",
        F.col("e.cells").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("e.cells")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    return rows.drop("copy")
