"""Secret scans: fixed patterns, and a conditional random field that adds what they miss.

Tokens are words. A word without a digit, without one of ``_ + / =`` and
without a run of sixteen letters and digits is plain, and plain words are
outside by definition; so the chains to decode are the runs of other words,
with features of their shape, of the words around them and of the file. A word
is cut where a span of the fixed patterns begins or ends in it, so the field
judges what such a span leaves of the word by itself. The field is trained on a bounded sample of the documents, labelled by the fixed
patterns, with generated secrets of other shapes put into it.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .crf import BEGIN, CRF, INSIDE, OUT

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs are taken whole, so those of 24 and more are what is left of all runs.
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A sign that a text has a word that is not plain.
_SIGN = re.compile(r"[0-9_+/=]|[A-Za-z0-9]{16}")
_EDGES = "\"'`()[]{}<>,;:!?."
_CUES = ("password", "passwd", "secret", "token", "key", "auth", "bearer", "credential", "login", "pass", "private", "access")
#: Words whose features are held at once; chains of any length are decoded whole, from their scores.
BLOCK = 2_000
#: Words of a chain that the field is trained on at once; longer ones of the sample are trained on in pieces.
TRAINED = 50
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, in code points, by start and then kind."""
    out: list[Span] = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _EDGES:
        start += 1
    while end > start and text[end - 1] in _EDGES:
        end -= 1
    return start, end


def _entropy(word: str) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values()) if n else 0.0


def _cue(word: str) -> bool:
    low = word.lower()
    return any(c in low for c in _CUES)


def _shape(word: str) -> list[float]:
    core = word.strip(_EDGES)
    n = max(len(core), 1)
    digits, upper, lower = (sum(map(f, core)) / n for f in (str.isdigit, str.isupper, str.islower))
    changes = sum(a.isalpha() != b.isalpha() for a, b in zip(core, core[1:], strict=False)) / n
    cased = sum(a.isupper() != b.isupper() for a, b in zip(core, core[1:], strict=False) if a.isalpha() and b.isalpha()) / n
    h = _entropy(core)
    return [
        *(float(n >= k) for k in (8, 12, 16, 20, 24, 32, 40, 64)),
        *(float(h >= k) for k in (2.5, 3.0, 3.5, 4.0, 4.5)),
        digits,
        upper,
        lower,
        changes,
        cased,
        float(digits > 0 and upper > 0 and lower > 0),
        float(digits in (0.0, 1.0)),
        float(digits >= 0.8),
        float("@" in core),
        float("://" in core or core.startswith("www.")),
        float("." in core),
        float("-" in core),
        float("_" in core),
        float("=" in core[:-2] or ":" in core[:-1]),
        float(any(c in core for c in "+/")),
        float(not core.isascii()),
        float(core.startswith(("ghp_", "gho_", "sk_", "pk_", "xox", "eyJ", "AIza", "AKIA", "ssh-", "glpat"))),
        float(_cue(word)),
        float(re.fullmatch(r"[0-9a-fA-F]+", core) is not None),
        float(re.fullmatch(r"[A-Za-z0-9+/_=-]+", core) is not None),
    ]


def features(words: list[str], at: int, file: list[float]) -> list[float]:
    """Of the word at *at*: shape, cues among the two before and the one after, and the file's."""
    before = words[at - 1] if at else ""
    before2 = words[at - 2] if at > 1 else ""
    after = words[at + 1] if at + 1 < len(words) else ""
    return [1.0, *_shape(words[at]), float(_cue(before)), float(_cue(before2)), float(before[-1:] in (":", "=")), float(after[:1] in ("=", ":")), float(not before), *file]


N_FEATURES = len(features(["a"], 0, [0.0, 0.0]))


def plain(word: str) -> bool:
    return _SIGN.search(word) is None


def file_features(n_words: int, n_odd: int) -> list[float]:
    """How many of a file's words are not plain, and whether it is short."""
    return [min(1.0, n_odd / max(n_words, 1)), float(n_words < 50)]


def _cut(places: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The places of words, cut where a span begins or ends inside one."""
    edges, out, k = sorted({x for s in spans for x in s}), [], 0
    for a, b in places:
        while k < len(edges) and edges[k] <= a:
            k += 1
        while k < len(edges) and edges[k] < b:
            out.append((a, edges[k]))
            a = edges[k]
            k += 1
        out.append((a, b))
    return out


def chains(text: str, spans: list[tuple[int, int]] | None = None) -> Iterator[tuple[list[tuple[int, int]], Iterator[np.ndarray]]]:
    """Runs of words that are not plain, cut at the *spans* of the fixed patterns: their places, and their features by blocks."""
    if not _SIGN.search(text):
        return
    places = [m.span() for m in _WORD.finditer(text)]
    if spans:
        places = _cut(places, spans)
    words = [text[a:b] for a, b in places]
    odd = [i for i, w in enumerate(words) if not plain(w)]
    file = file_features(len(words), len(odd))

    def blocks(run: list[int]) -> Iterator[np.ndarray]:
        for a in range(0, len(run), BLOCK):
            yield np.array([features(words, i, file) for i in run[a : a + BLOCK]])

    at = 0
    while at < len(odd):
        end = at + 1
        while end < len(odd) and odd[end] == odd[end - 1] + 1:
            end += 1
        run = odd[at:end]
        yield [places[i] for i in run], blocks(run)
        at = end


def _pieces(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A chain with its states in pieces of TRAINED words; a span that goes on begins anew."""
    for a in range(0, len(y), TRAINED):
        states = y[a : a + TRAINED].copy()
        if states[0] == INSIDE:
            states[0] = BEGIN
        yield x[a : a + TRAINED], states


def labels(places: list[tuple[int, int]], spans: list[tuple[int, int]]) -> np.ndarray:
    """Begin for the first word that meets a span, inside for those after it, outside for the rest."""
    out = np.full(len(places), OUT)
    for a, b in spans:
        met = [i for i, (s, e) in enumerate(places) if s < b and e > a]
        for k, i in enumerate(met):
            out[i] = BEGIN if k == 0 else INSIDE
    return out


_HEXES, _DIGITS = "0123456789abcdef", "0123456789"
_MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _generated(rng: random.Random) -> tuple[str, bool]:
    """A word, and whether it is a secret."""

    def draw(letters: str, low: int, high: int) -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))

    def assigned() -> str:
        return rng.choice(("password", "passwd", "secret", "token", "api_key")) + rng.choice(("=", ":", '="', "='")) + draw(_MIXED, 6, 20)

    makers = [
        (lambda: draw(_MIXED, 20, 64), True),
        (lambda: draw(_MIXED + "+/", 24, 64) + rng.choice(("", "=", "==")), True),
        (lambda: draw(_HEXES, 32, 64), True),
        (lambda: draw(_HEXES.upper(), 32, 64), True),
        (lambda: rng.choice(("ghp_", "sk_live_", "xoxb-", "glpat-")) + draw(_MIXED, 20, 40), True),
        (lambda: "eyJ" + draw(_MIXED, 12, 30) + "." + draw(_MIXED, 20, 60) + "." + draw(_MIXED + "-_", 20, 43), True),
        (lambda: "AKIA" + draw(_MIXED[:26] + _DIGITS, 16, 16), True),
        # Secrets of which the assignment pattern takes the first part only, and whole ones with something else behind.
        (lambda: assigned() + rng.choice("!$%&*#@~^?") + draw(_MIXED + "!$%&*#@~^", 6, 24), True),
        (lambda: assigned() + rng.choice(("&", ";", ",", '","')) + draw(_MIXED[26:52], 3, 8) + rng.choice(("=", ":", '":"')) + draw(_MIXED[26:52] + _DIGITS, 1, 8), False),
        (lambda: draw(_DIGITS, 3, 20), False),
        (lambda: draw(_MIXED[26:52], 4, 9) + "." + draw(_DIGITS, 2, 2) + "@mail" + draw(_DIGITS, 1, 1) + ".example.com", False),
        (lambda: "https://" + draw(_MIXED[26:52], 4, 10) + ".example.com/" + draw(_MIXED[26:52] + "/-", 4, 30), False),
        (lambda: "-".join(draw(_DIGITS, 2, 4) for _ in range(3)), False),
        (lambda: draw(_MIXED[26:52], 16, 40), False),
        (lambda: "_".join(draw(_MIXED[26:52], 3, 8) for _ in range(3)), False),
    ]
    make, secret = rng.choice(makers)
    return make(), secret


def _short(rng: random.Random) -> str:
    """A secret of 6 to 15 characters: letters of both cases, digits, sometimes marks."""
    letters = _MIXED + rng.choice(("", "!$%&*#@~^"))
    word = [rng.choice(x) for x in (_MIXED[:26], _MIXED[26:52], _DIGITS, _DIGITS)] + [rng.choice(letters) for _ in range(rng.randint(2, 11))]
    rng.shuffle(word)
    return "".join(word)


def examples(texts: list[str], seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chains with states: of the texts as the patterns label them, and of words generated into them."""
    rng, out = random.Random(seed), []
    for text in texts:
        spans = [(a, b) for a, b, _ in base_spans(text)]
        for places, blocks in chains(text, spans):
            out += _pieces(np.concatenate(list(blocks)), labels(places, spans))
    stock = [t.split() for t in texts if t and t.split()] or [["text"]]
    for k in range(1500):
        words = rng.choice(stock)
        at = rng.randint(0, len(words))
        word, secret = _generated(rng)
        lead = rng.choice(([], [], ["key:"], ["Bearer"], ["secret", "="], ["id"]))
        if k % 6 == 0:  # a short secret, known by its shape and what stands before it
            word, secret = _short(rng), True
            lead = rng.choice((["key:"], ["Bearer"], ["login"], ["pass"], ["credential", "is"], ["private", "key:"]))
        quote = rng.choice(("", "", '"', "'"))
        made = [*words[max(0, at - 6) : at], *lead, quote + word + quote, *words[at : at + 6]]
        text = " ".join(made)
        start = len(" ".join(made[: len(words[max(0, at - 6) : at]) + len(lead)]))
        base = [(a, b) for a, b, _ in base_spans(text)]
        spans = base + ([(start, start + len(word) + 1)] if secret else [])
        for places, blocks in chains(text, base):
            out += _pieces(np.concatenate(list(blocks)), labels(places, spans))
    return out


def train(docs: DataFrame, text_col: str = "text", sample: int = 600) -> CRF:
    """Fit the field on about *sample* documents, drawn by a hash of their texts, and the generated words."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    n = texts.count()
    draw = F.pmod(F.xxhash64(F.lit("secrets"), "text"), F.lit(1_000_000))
    some = [r["text"] for r in texts.where(draw < int(1_000_000 * min(1.0, sample / max(n, 1)))).distinct().sort("text").collect()]
    return CRF(N_FEATURES).fit(examples(some))


def field_spans(text: str, field: CRF, base: list[Span]) -> list[Span]:
    """What the field tags outside the base spans, trimmed of marks at its edges."""
    out: list[Span] = []
    spans = sorted((a, b) for a, b, _ in base)
    starts = [a for a, _ in spans]
    reach = np.maximum.accumulate([-1, *[b for _, b in spans]])
    for places, blocks in chains(text, spans):
        # Words are cut at the spans, so those that start inside one lie inside it.
        at = np.searchsorted(starts, [a for a, _ in places], side="right")
        covered = reach[at] > [a for a, _ in places]
        run: list[tuple[int, int]] = []
        for state, place, hidden in [*zip(field.viterbi(np.concatenate([x @ field.weights for x in blocks])), places, covered, strict=True), (BEGIN, (0, 0), True)]:
            if run and (state != INSIDE or hidden):
                start, end = _trim(text, run[0][0], run[-1][1])
                if start < end:
                    out.append((start, end, "crf"))
                run = []
            if state != OUT and not hidden:
                run.append(place)
    return out


def scan(text: str, field: CRF) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text."""
    base = base_spans(text)
    return base, ordered(base + field_spans(text, field, base))


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_assign, n_access, n_hex, base_sha256, spans.

    A null or empty text has no spans and the digest of nothing. Rows that
    repeat an id are scanned each.
    """
    field = docs.sparkSession.sparkContext.broadcast(train(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = scan(text or "", field.value)
                count = Counter(kind for _, _, kind in base)
                rows.append((count["assign"], count["access"], count["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[f.name for f in schema])

    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    )
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


MASK = "[secret]"


def mask(text: str, spans: list[Span]) -> str:
    """The text with each stretch covered by spans replaced by one mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows with their columns; secrets in the text are masked, and *length_col*, where there is one, follows."""

    field = docs.sparkSession.sparkContext.broadcast(train(docs, text_col))

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mask(t, scan(t, field.value)[1]) for t in texts], dtype=object)

    made = docs.withColumn(text_col, masked(F.col(text_col).cast("string")))
    if length_col in docs.columns:
        # A null text has the length that it came with.
        made = made.withColumn(length_col, F.coalesce(F.length(text_col).cast(docs.schema[length_col].dataType), F.col(length_col)))
    return made.select(*[f"`{c}`" for c in docs.columns])
