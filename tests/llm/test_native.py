"""Sharding, quality rules, fingerprints and URL filters by brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import components, imatch, quality, queries, sharding, url_filter


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 10, 97, 1000, 4097])
def test_feistel_is_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.feistel(F.col("id"), n, 3)).collect()]
    assert sorted(got) == list(range(n))
    if n >= 97:
        assert got != sorted(got)


def balanced(rows, n):
    shards = Counter(r.shard for r in rows)
    counts = [shards.get(i, 0) for i in range(n)]
    assert max(counts) - min(counts) <= 1 and set(shards) <= set(range(n))
    for i in range(n):
        assert sorted(r.slot for r in rows if r.shard == i) == list(range(counts[i]))


def test_shards(spark, sf, odd, none):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_sharding(spark, sf).collect()
    balanced(rows, 24)
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(k, len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in texts.items()}
    again = queries.op1_sharding(spark, sf).collect()
    assert sorted(rows) == sorted(again)
    rows = sharding.shard_documents(odd, 4).collect()
    balanced(rows, 4)
    assert [(r.size, r.text_crc32) for r in rows if r.doc_id == 2] == [(8, 0)]
    assert len(rows) == odd.count()
    assert sharding.shard_documents(none, 4).count() == 0
    assert sharding.shard_rows(odd, 3, ["doc_id", "text"]).columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    words = WORD.findall(text or "")
    windows, covered = {}, set()
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(covered)


def fence(values, floor):
    counts = Counter(values)
    return quality._fence(counts, floor, 4)


def test_quality(spark, odd, none):
    odd = odd.unionByName(odd.limit(0)).unionByName(spark.createDataFrame([(100 + i, f"Plain words come here again and again in number {i} and they go on for long enough to be counted as text", "en", "big", 1, None, 0, "") for i in range(60)] + [(999, "Odd *** ### $$$ %%% &&& *** ### $$$ %%% &&& *** ### $$$ of symbols in this one for more than twenty words all told", "en", "big", 1, None, 0, "")], odd.schema))
    rows = quality.judge_documents(odd).collect()
    want = Counter((r.doc_id, *counted(r.text)) for r in odd.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in rows}
    assert all(kept[100 + i] for i in range(60)) and not kept[999]
    assert quality.judge_documents(none).count() == 0
    passed = quality.keep_documents(odd)
    assert passed.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in passed.collect()) == sorted(r.doc_id or 0 for r in rows if r.kept)


def test_quality_fences(spark):
    """The fences of a group are those of its own shares; small groups use the language's, and those of rare languages the table's."""
    rows = [(i, "a" * (40 - i % 7) + "#" * (i % 7) + " word" * 25, "en", "s" if i < 70 else "small") for i in range(80)] + [(200, "x" * 30 + " word" * 25, "zz", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = quality.measure(docs)
    shares = [(r["lang"], r["source"], r["__symbols"]) for r in measured.collect()]
    limits = {(r["__lang"], r["__source"]): r["__symbols_fence"] for r in quality.thresholds(measured).collect()}
    assert limits["en", "s"] == fence([x for a, b, x in shares if (a, b) == ("en", "s")], 25)
    assert limits["en", "small"] == fence([x for a, _, x in shares if a == "en"], 25)
    assert limits["zz", "s"] == fence([x for _, _, x in shares], 25)


@pytest.mark.parametrize("bad", [30, 60, 70])
def test_quality_rule_of_a_bad_source_still_fires(spark, bad):
    """A source of which over a quarter, or over half, is junk does not loosen its own fence; one that is evenly rich in symbols keeps its own."""
    words = " ".join(f"plain{chr(97 + i)}{chr(97 + i * 7 % 26)}" for i in range(26))
    rows = [(i, words + (" " + "#" * 98 if i < bad else ""), "en", "hot") for i in range(100)]
    rows += [(1000 + i, words + " " + "#" * (60 + 7 * i % 60), "en", "code") for i in range(100)]
    kept = {r.doc_id: r.kept for r in quality.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [kept[i] for i in range(100)] == [i >= bad for i in range(100)]
    assert all(kept[1000 + i] for i in range(100))


def test_kept_documents_keep_their_columns(spark, odd):
    """Columns named like the operator's own come back unchanged."""
    docs = odd.withColumn("__lang", F.lit(7)).withColumn("base_failed", F.lit("mine"))
    rows = {r.doc_id: r.asDict() for r in docs.where("doc_id in (6, 7, 10)").collect()}
    kept = quality.keep_documents(docs)
    assert kept.schema == docs.schema
    got = [r.asDict() for r in kept.where("doc_id in (6, 7, 10)").collect()]
    assert got and all(r == rows[r["doc_id"]] for r in got)


def test_quality_salted_join_is_the_broadcast_join(spark, odd, monkeypatch):
    want = sorted(map(repr, quality.judge_documents(odd).collect()))
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    assert sorted(map(repr, quality.judge_documents(odd).collect())) == want


def test_fingerprints(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = {r.doc_id: r for r in queries.op10_imatch(spark, sf).collect()}
    assert len(rows) == len(docs)
    for i, (key, text) in enumerate(docs):
        k = len(text) // 4
        edited = text[: len(text) - k] + docs[(i + 1) % len(docs)][1][:k]
        assert (rows[key].n_chars, rows[key].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = rows[key].fingerprint, rows[key].edited_fingerprint, rows[docs[(i + 1) % len(docs)][0]].fingerprint
        assert (rows[key].near_edited, rows[key].near_next) == (pytest.approx(brute_likeness(a, b)), pytest.approx(brute_likeness(a, c)))
    by_text = {}
    for key, text in docs:
        by_text.setdefault(text, set()).add(rows[key].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    n = len(rows)
    assert sum(r.near_edited for r in rows.values()) / n > 0.3 > 0.05 > sum(r.near_next for r in rows.values()) / n


def xx(values, seed=42):
    """Spark's hash of longs in a row: each is the seed of the next."""
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_fingerprint(text, in_band):
    """Subset by subset from the docstring: terms are runs of ASCII letters and digits here."""
    terms = {xxhash.xxh64_intdigest(w, 42) for w in re.findall("[a-z0-9]+", text.lower())}
    known = {t for t in terms if t & ((1 << imatch.BITS) - 1) in in_band}
    lead, chosen = (0, known) if known else (1, terms)
    out = []
    for level in reversed(range(imatch.LEVELS)):
        for cell in range(imatch.CELLS):
            mine, marks = [], [(cell << 56) | (d + 1) << 48 for d in range(imatch.LEVELS - 1 - level)]
            for t in chosen:
                zeros = imatch.LEVELS - 1 - ((t >> 44) & 63).bit_length()
                if (t >> 40) & 15 == cell and zeros >= level:
                    low = xx([t - (1 << 64) if t >> 63 else t]) & ((1 << 48) - 1) | 1
                    mine.append((cell << 56) | (imatch.LEVELS - 1 - zeros) << 48 | low)
            seed = xxhash.xxh64_intdigest(struct.pack("<i", lead), 42)
            out.append(f"{xx(sorted(mine + marks), seed) & 0xFFFF:04x}" if mine else "....")
    return "".join(out)


def brute_likeness(a, b):
    size = imatch.CELLS * imatch.WIDTH
    for k in range(0, len(a), size):
        pairs = [(x, y) for x, y in zip(re.findall("....", a[k : k + size]), re.findall("....", b[k : k + size]), strict=True) if (x, y) != ("....", "....")]
        if 2 * len(pairs) >= imatch.CELLS or k + size == len(a):
            return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def test_fingerprints_by_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(f"t{rng.randrange(900)}" for _ in range(n)) for n in (1, 2, 5, 30, 200, 2000)] + ["alone"]
    words = sorted({w for t in texts[:-1] for w in t.split()})[::2]
    in_band = {xxhash.xxh64_intdigest(w, 42) & ((1 << imatch.BITS) - 1) for w in words}
    bitmap = [0] * ((1 << imatch.BITS) // 64)
    for t in in_band:
        bitmap[t >> 6] |= 1 << (t & 63)
    bitmap = [w - (1 << 64) if w >> 63 else w for w in bitmap]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", imatch.fingerprint(F.col("t"), bitmap).alias("f")).collect()
    assert {r.k: r.f for r in rows} == {k: brute_fingerprint(t, in_band) for k, t in enumerate(texts)}


def test_fingerprints_of_odd_rows(spark, odd, none):
    rows = imatch.fingerprint_edits(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    texts = {r.text: r.doc_id for r in odd.where("doc_id is not null").collect()}
    one = {r.fingerprint for r in rows if r.doc_id in (1, 4)}
    assert len(one) == 1 and texts
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    alone = imatch.fingerprint_edits(odd.where("doc_id = 6")).first()
    assert alone.near_next == 1.0
    assert imatch.fingerprint_edits(none).count() == 0


def test_fingerprints_do_not_switch_at_a_number_of_terms(spark):
    """One in-band term more or less changes one cell, however many there are."""
    inside, outside = [f"in{i}" for i in range(40)], [f"out{i}" for i in range(60)]
    bitmap = [0] * ((1 << imatch.BITS) // 64)
    for r in spark.createDataFrame([(w,) for w in inside], "w string").select(F.xxhash64("w").alias("h")).collect():
        t = r.h & ((1 << imatch.BITS) - 1)
        bitmap[t >> 6] |= (1 << (t & 63)) - ((1 << 64) if t & 63 == 63 else 0)
    texts = [" ".join(inside[:n] + outside) for n in range(1, 41)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", imatch.fingerprint(F.col("t"), bitmap).alias("c")).orderBy("k").collect()
    cells = [re.findall("....", r.c) for r in rows]
    for a, b in zip(cells, cells[1:], strict=False):
        assert len({i % imatch.CELLS for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y}) == 1


def test_fingerprints_of_a_hot_text(spark):
    """A text that a third of the rows hold counts once; its copy with the last quarter replaced stays like it."""
    hot = " ".join(f"hot{i}" for i in range(80))
    rows = [(i, hot if i % 3 == 0 else " ".join(f"w{(i * 37 + k * k) % 400}" for k in range(80))) for i in range(300)]
    got = imatch.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    near = [r.near_edited for r in got if r.doc_id % 3 == 0]
    assert len(near) == 100 and min(near) > 0.15 and sum(near) > 25


def test_lexicon_is_the_band(spark):
    rows = [(i, "common " + ("half " if i % 2 else "") + f"own{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "id long, text string")
    bits = imatch.lexicon(docs, "text", 0.3, 0.7)
    h = spark.sql("SELECT xxhash64('half') AS h").first().h & ((1 << imatch.BITS) - 1)
    set_bits = [64 * i + k for i, w in enumerate(bits) for k in range(64) if w >> k & 1]
    assert set_bits == [h]


def brute_rule(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path)) if fits else None
    return host, path, best


def test_url_rules(spark, sf):
    rules = url_filter.parse_rules(queries.RULES)
    rows = {r.page_id: r for r in queries.op6_url_filter(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        host, path, best = brute_rule(r.url, rules)
        got = rows[r.page_id]
        assert (got.host, got.path, got.rule, got.verdict) == (host, path, best.host + best.path if best else None, best.verdict if best else "allow")


def test_url_equivalents(spark):
    rules = url_filter.parse_rules("block bad.net/, allow good.org/ok/, block evil.com/x")
    link = '<html><head><LINK href="{}" rel=canonical></head>'
    pages = [
        (1, "http://a.example.com/1", link.format("https://bad.net/page#top")),
        (2, "https://b.example.com/2?q=1", link.format("http://a.example.com/1")),
        (3, "http://c.example.com/3", "<meta http-equiv='refresh' content='0; url=/4'>"),
        (4, "http://c.example.com/4", link.format("//bad.net/other")),
        (5, "http://d.example.com/5", link.format("http://good.org/ok/5")),
        (6, "http://d.example.com/5#again", link.format("http://bad.net/5")),
        (7, "http://sub.EVIL.com/xyz", None),
        (8, None, "canonical"),
        (9, "no host here", "<p>"),
        (10, "http://e.example.com/", '<link rel="stylesheet" href="http://bad.net/">'),
        (11, "http://sub.evil.com/xyz", link.format("http://good.org/ok/1")),
        (11, "http://sub.evil.com/xyz", link.format("http://good.org/ok/1")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = url_filter.judge_pages(df, rules).collect()
    got = {r.page_id: (r.verdict, r.rule) for r in rows}
    assert len(rows) == 12
    assert got == {1: ("block", None), 2: ("block", None), 3: ("block", None), 4: ("block", None), 5: ("allow", None), 6: ("allow", None), 7: ("block", "evil.com/x"), 8: ("allow", None), 9: ("allow", None), 10: ("allow", None), 11: ("block", "evil.com/x")}
    redirects = spark.createDataFrame([("http://e.example.com/", "http://f.example.com/"), ("http://f.example.com/", "http://bad.net/"), (None, "http://x/")], "source string, target string")
    got = {r.page_id: r.verdict for r in url_filter.judge_pages(df, rules, redirects).collect()}
    assert got[10] == "block"
    assert url_filter.judge_pages(df.where("false"), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_pages(df, []).collect()} == {"allow"}


def test_url_links(spark):
    """Targets as urllib resolves them; where a link leads nowhere there is no edge."""
    from urllib.parse import urldefrag, urljoin

    links = ["/a", "b.html", "../x", "../../../x", "./", "..", ".", "?id=2", "?a=1&amp;b=2", "/c/./d/../e?q=..", "//Other.org", "http://Other.org?z", "/é/ü", "c/#f"]
    bases = ["http://h.com/p/q/r.html?old", "https://H.com", "http://h.com/", "http://h.com/p/"]
    rows = [(f"{b}", f"<link href='{x}' rel='nofollow canonical'>") for b in bases for x in links]
    got = {(r.url, r.html): r.v for r in spark.createDataFrame(rows, "url string, html string").select("url", "html", url_filter._target(F.col("url"), F.regexp_extract("html", url_filter._HREF, 1)).alias("v")).collect()}
    for b, html in rows:
        whole = urldefrag(urljoin(b, html.split("'")[1].replace("&amp;", "&")))[0]
        host, _, rest = whole.split("://")[1].partition("/") if "/" in whole.split("://")[1].split("?")[0] else (*whole.split("://")[1].partition("?")[:1], "", "?" + whole.partition("?")[2] if "?" in whole else "")
        assert got[(b, html)] == f"{host.lower()}/{rest}", (b, html)
    pages = [
        ("http://h.com/1", '<link rel="canonical" href="/2"><LINK REL="x canonical" HREF="3"><link rel="not-canonical" href="/4"><meta http-equiv=refresh content="0;url=5">'),
        ("http://h.com/6", '<link rel=canonical href="mailto:x@y"><link rel=canonical href="#top"><a href="/7">canonical</a>'),
        (None, '<link rel=canonical href="/8">'),
        ("http://h.com/9", None),
    ]
    edges = url_filter.page_edges(spark.createDataFrame(pages, "url string, html string")).collect()
    assert {(r.u, r.v) for r in edges} == {("h.com/1", f"h.com/{k}") for k in (2, 3, 5)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    import random

    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(7, 7), (500, 500), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
