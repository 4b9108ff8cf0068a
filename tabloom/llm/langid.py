"""Language identification by interpolated Kneser-Ney character models.

One model a language, over the lower-cased characters of a text. The counts of
a bounded sample of labelled rows (``per_language`` documents a language in
expectation, chosen by a hash of their texts) are gathered by Spark; all lower
orders follow from them. The models are stored together as sorted arrays of
hashed n-grams, one array an order, with a row of log probabilities for each
n-gram (a value for each language) and a row of back-off weights for each
history. A text is scored whole: its language is the one of least
cross-entropy a character, and it is rejected if that entropy is beyond what
texts of its length in that language have in a calibration part of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = 4
UND = "und"
#: Log probability of a character that no model has seen, given the unigram back-off.
UNSEEN = float(np.log(1 / 65_536))
_PAD = np.full(ORDER - 1, 2, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _keys(text: str) -> np.ndarray:
    """The text's n-grams of order 4, 16 bits a character (one beyond them is a pair, as in UTF-16); before its start stand three pads."""
    codes = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), dtype="<u2").astype(np.uint64)
    codes = np.concatenate([_PAD, codes])
    n = len(codes) - ORDER + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | codes[k : k + n]
    return out


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (16 * order)) - 1)


def _hash(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return keys * _ODD


def _places(sorted_hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where *keys* stand in an array of sorted hashes; -1 if they don't."""
    if not len(sorted_hashes):
        return np.full(len(keys), -1, dtype=np.int64)
    h = _hash(keys)
    at = np.searchsorted(sorted_hashes, h)
    at[at == len(sorted_hashes)] = 0
    return np.where(sorted_hashes[at] == h, at, -1)


def _one_language(keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """For orders 1 .. ORDER: (n-grams, probabilities, histories, back-off weights)."""
    levels, n, grams = [], counts.astype(float), keys
    for order in range(ORDER, 0, -1):
        levels.append((order, grams, n))
        grams, n = np.unique(grams & _mask(order - 1), return_counts=True)
        n = n.astype(float)
    out, lower = [], None
    for order, grams, n in reversed(levels):
        ones, twos = (n == 1).sum(), (n == 2).sum()
        discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
        histories, of = np.unique(grams >> np.uint64(16), return_inverse=True)
        total, types = np.bincount(of, weights=n), np.bincount(of)
        gamma = discount * types / total
        if lower is None:
            below = np.full(len(grams), np.exp(UNSEEN))
        else:
            below = lower[1][np.searchsorted(lower[0], grams & _mask(order - 1))]
        p = np.maximum(n - discount, 0) / total[of] + gamma[of] * below
        out.append((grams, p, histories, gamma))
        lower = (grams, p)
    return out


class Models:
    """The models of all languages in sorted hash arrays."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        own = [_one_language(*counts[x]) for x in self.languages]
        self.grams, self.logs, self.histories, self.weights = [], [], [], []
        for k in range(ORDER):
            grams = np.unique(np.concatenate([o[k][0] for o in own])) if own else np.zeros(0, np.uint64)
            histories = np.unique(np.concatenate([o[k][2] for o in own])) if own else np.zeros(0, np.uint64)
            weights = np.zeros((len(histories), len(own)), dtype=np.float64)
            for j, o in enumerate(own):
                weights[np.searchsorted(histories, o[k][2]), j] = np.log(o[k][3])
            # Where a language has not seen an n-gram, its back-off is stored.
            if k:
                below = self.logs[k - 1][_places(self.grams[k - 1], grams & _mask(k))]
            else:
                below = np.full((len(grams), len(own)), UNSEEN)
            logs = below + weights[np.searchsorted(histories, grams >> np.uint64(16))]
            for j, o in enumerate(own):
                logs[np.searchsorted(grams, o[k][0]), j] = np.log(o[k][1])
            by, hist = np.argsort(_hash(grams)), np.argsort(_hash(histories))
            self.grams.append(_hash(grams)[by])
            self.logs.append(logs[by])
            self.histories.append(_hash(histories)[hist])
            self.weights.append(weights[hist])
        self.limits: dict[str, tuple[float, float]] = {}

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """(n-grams, languages): the log probability of each last character given those before it."""
        out = np.zeros((len(keys), len(self.languages)))
        left = np.arange(len(keys))
        for k in range(ORDER - 1, -1, -1):
            now = keys[left] & _mask(k + 1)
            at = _places(self.grams[k], now)
            hit = at >= 0
            out[left[hit]] += self.logs[k][at[hit]]
            left, now = left[~hit], now[~hit]
            if not len(left):
                return out
            at = _places(self.histories[k], now >> np.uint64(16))
            hit = at >= 0
            out[left[hit]] += self.weights[k][at[hit]]
        out[left] += UNSEEN
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) cross-entropies a character, and the numbers of characters. Long texts are read in blocks."""
        total = np.zeros((len(texts), len(self.languages)))
        sizes = np.zeros(len(texts), dtype=np.int64)
        block, owners, held = [], [], 0

        def flush():
            nonlocal block, owners, held
            if block:
                logs = self.log_probabilities(np.concatenate(block))
                starts = np.cumsum([0] + [len(b) for b in block[:-1]])
                np.add.at(total, owners, np.add.reduceat(logs, starts, axis=0))
            block, owners, held = [], [], 0

        for i, text in enumerate(texts):
            keys = _keys(text)
            sizes[i] = len(keys)
            for a in range(0, len(keys), 100_000):
                part = keys[a : a + 100_000]
                block.append(part)
                owners.append(i)
                held += len(part)
                if held >= 100_000:
                    flush()
        flush()
        return -total / np.maximum(sizes, 1)[:, None], sizes

    def calibrate(self, texts: list[str], reach: float = 8.0, slack: float = 0.5) -> None:
        """For each language the entropy beyond which a text is rejected: mean + slack + reach * spread / sqrt(characters).

        The spread is that of entropies times the root of the length, and 1 at least.
        """
        entropy, sizes = self.entropies(texts)
        best = entropy.argmin(axis=1) if len(texts) else np.zeros(0, int)
        low = entropy[np.arange(len(texts)), best] if len(texts) else np.zeros(0)
        for j, language in enumerate(self.languages):
            mine = best == j
            if mine.any():
                mean = float(np.average(low[mine], weights=sizes[mine]))
                spread = float(np.sqrt(np.mean((low[mine] - mean) ** 2 * sizes[mine])))
                self.limits[language] = (mean + slack, reach * max(spread, 1.0))
            else:
                self.limits[language] = (float("inf"), 0.0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected). No text, no letter or no model: und, 0, rejected."""
        out: list[tuple[str, float, bool]] = [(UND, 0.0, True)] * len(texts)
        if not self.languages:
            return out
        some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        entropy, sizes = self.entropies([texts[i] for i in some])
        for i, row, n in zip(some, entropy, sizes, strict=True):
            best = int(row.argmin())
            score = 1.0 / float(np.exp(np.minimum(0, -(row - row[best]) * min(n, 40))).sum())
            limit, spread = self.limits.get(self.languages[best], (float("inf"), 0.0))
            out[i] = (self.languages[best], score, bool(row[best] > limit + spread / np.sqrt(n)))
        return out


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; such rows are never learned from. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600) -> Models:
    """Fit the models on about *per_language* documents of each language, whole, and calibrate on a fifth as many others.

    The sample is bounded by that parameter: a text is in it if a hash of it
    falls below per_language / different texts of its language, so copies don't
    use up the rate. The text of least hash is always learned from, so every
    language with a labelled text has a model.
    """
    spark = docs.sparkSession
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id"))
    )
    # Equal texts are drawn together and counted once, or a group of copies would be learned by heart.
    draw = F.pmod(F.xxhash64(F.lit("langid"), "text"), F.lit(1_000_000))
    drawn = labelled.select("lang", "text", draw.alias("draw"))
    # Narrow rows: a language, a hash and the draw for each different text.
    texts = drawn.select("lang", F.xxhash64("text").alias("h"), "draw").distinct()
    sizes = {r["lang"]: (r["n"], r["low"]) for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("low")).collect()}  # a row a language
    if not sizes:
        return Models({})
    share = F.create_map(*[F.lit(x) for k, (n, _) in sizes.items() for x in (k, min(1.0, 1.2 * per_language / n))])
    low = F.create_map(*[F.lit(x) for k, (_, least) in sizes.items() for x in (k, least)])
    first = F.col("draw") == F.element_at(low, F.col("lang"))
    part = F.col("draw") / 1_000_000.0 / F.element_at(share, F.col("lang"))
    sample = drawn.where((part < 1) | first).select("lang", "text", ((part > 1 / 1.2) & ~first).alias("check")).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(_keys(text))
            for lang, keys in held.items():
                grams, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.where("not check").select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Bounded by the sample: no more n-grams than it has characters.
    table = counted.toArrow().to_pandas()
    counts = {}
    for lang, rows in table.groupby("lang"):
        keys = rows["gram"].to_numpy().view(np.uint64)
        by = np.argsort(keys)
        counts[lang] = (keys[by], rows["n"].to_numpy()[by])
    models = Models(counts)
    models.calibrate([r["text"] for r in sample.where("check").select("text").collect()])
    return models


def predictor(spark, models: Models):
    """A column function: text -> struct(lang_pred, score, rejected). The models, of bounded size, are broadcast."""
    shared = spark.sparkContext.broadcast(models)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        rows = shared.value.predict([None if t is None else t for t in text.tolist()])
        return pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: its id, held_out, lang_pred, score, rejected.

    lang_pred is a learned language, or und with score 0 if the text is null or
    has no letter. Rows that repeat an id are judged each. With no labelled row
    to learn from, all are und.
    """
    predict = predictor(docs.sparkSession, train(docs, id_col, text_col, lang_col))
    made = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), predict(F.col(text_col).cast("string")).alias("p"))
    return made.select(id_col, "held_out", "p.lang_pred", "p.score", "p.rejected")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is known and not rejected, with their columns."""
    predict = predictor(docs.sparkSession, train(docs, id_col, text_col, lang_col))
    return docs.withColumn("__lid", predict(F.col(text_col).cast("string"))).where(~F.col("__lid.rejected")).drop("__lid")
