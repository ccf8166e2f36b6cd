"""The other operators: brute force, round trips, held-out accuracy and edge cases on small tables."""

import gzip
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from odresil.llm import base, decontaminate, extract, fixity, huffman, packing, ppm, quality, toxicity

LONG = "word " * 5000
TEXTS = [(1, None), (2, ""), (3, " \n"), (4, "One two, three. Four!"), (5, "Ünï cödé 日本語 &&& $$$"), (6, LONG), (7, "One two, three. Four!"), (7, "again and again"), (None, "no id here"), (8, "a <|endoftext|> b")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "'x' as score", "1L as n_words", "cast(null as string) as kept", "'en' as lang")


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, score double")


# ---------------------------------------------------------------- 1


def test_fixity(spark):
    rows = [(i, i * 700, 700, f"d{i}") for i in range(3000)]
    a = spark.createDataFrame(rows, "record_id long, offset long, length long, digest string").withColumn("volume", F.lit(0).cast("long"))
    bad = {5: "x", 2999: "y"}
    b = spark.createDataFrame([(i, o, n, bad.get(i, d)) for i, o, n, d in rows if i != 1500] + [(7000, 3000 * 700, 9, "new")], "record_id long, offset long, length long, digest string").withColumn("volume", F.lit(0).cast("long"))
    got = sorted((r.record_id, r.kind) for r in fixity.audit(a, b, span=20000, fan=8).collect())
    assert got == [(5, "corrupt"), (1500, "missing"), (2999, "corrupt"), (7000, "extra")]
    assert fixity.audit(a.limit(0), a.limit(0)).count() == 0
    ranges = fixity.differing_ranges(fixity.merkle_tree(a, 20000, 16), fixity.merkle_tree(b, 20000, 16), 16).count()
    assert ranges <= 4  # the other leaves are never looked at


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a", "<p>é</p>"), (2, None, None)], "id long, url string, html string")
    records = [r[0].encode() for r in df.select(fixity.warc_record(F.col("id"), F.col("url"), F.col("html"))).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(fixity.compressed, records)))
    got = fixity.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.file[-6:], r.url, bytes(r.body).decode()) for r in got) == sorted((f, u, b) for f in ("a.warc", "arc.gz") for u, b in (("http://a", "<p>é</p>"), ("", "")))
    plain = sorted((r.offset, r.length) for r in got if r.file.endswith(".warc"))
    assert plain == [(0, len(records[0])), (len(records[0]), len(records[1]))]
    assert gzip.decompress(fixity.compressed(records[0])) == records[0]


def test_broken_warc_gives_error_rows(spark, tmp_path):
    df = spark.createDataFrame([(k, f"http://{k}", "<p>x</p>" * k) for k in range(3)], "id long, url string, html string")
    one, two, three = (r[0].encode() for r in df.select(fixity.warc_record(F.col("id"), F.col("url"), F.col("html"))).orderBy("id").collect())
    gz = list(map(fixity.compressed, (one, two, three)))
    files = {"cut.warc": one + two[:-9], "junk.warc": one + b"junk", "cut.gz": gz[0] + gz[1][:-5], "junk.gz": gz[0] + gz[1][:20] + b"xxxxxxxxx" + gz[2]}
    for name, data in files.items():
        got = list(fixity.parse_warc(data))
        start = len(gz[0]) if name.endswith("gz") else len(one)
        assert [g[4] is None for g in got] == [True, False] and got[1][:2] == (start, len(data) - start), name
        (tmp_path / name).write_bytes(data)
    rows = fixity.read_warc(spark, str(tmp_path)).collect()
    assert sum(r.error is not None for r in rows) == 4 and all(r.digest is None for r in rows if r.error)


def test_audit_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, 3, "a", "x"), (1, 5, "b", "y"), (1, 5, "b", "y"), (2, 0, None, "z")], "record_id long, length long, digest string, other string")
    placed = fixity.laid_out(rows.withColumn("Volume2", F.lit(1)), ["record_id", "length", "digest"])
    got = sorted((r.offset, r.length) for r in placed.collect())
    assert sum(n for _, n in got) == 13 and fixity.audit(placed, placed).count() == 0
    assert {r.kind for r in fixity.audit(placed, placed.where("record_id = 1")).collect()} == {"missing"}


# ---------------------------------------------------------------- 2


def brute_overlap(text, items, size=13):
    w = decontaminate.words_of(text)
    hit, names = set(), set()
    for name, item in items:
        v = decontaminate.words_of(item)
        for k in range(max(1, len(v) - size + 1) if v else 0):
            window = v[k : k + size]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    names.add(name)
    return len(w), len(hit), sorted(x for x in names if x is not None)


@pytest.mark.parametrize("block", [2_000_000, 25, 7])
def test_decontamination(spark, block):
    rng = random.Random(2)
    word = lambda: rng.choice("ab")
    items = [(str(k), " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 5, 13, 14, 20, 40])] + [("0", "zz"), (None, "qq rr"), ("9", None), ("8", "")]
    texts = [(i, " ".join(word() if rng.random() < 0.9 else "c" for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(99, items[7][1].upper() + " x"), (99, "zz!"), (100, "qq RR"), (101, None), (102, "é-É")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("hits", F.lit(3))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {(r.doc_id, r.text): (r.n_words, sum(h["to"] - h["from"] for h in r.hits), r["items"]) for r in decontaminate.find_overlap(docs, bench, block=block).collect()}
    assert got == {(i, t): brute_overlap(t, items) for i, t in texts}
    clean = decontaminate.judged(docs, bench.limit(0)).collect()
    assert len(clean) == len(texts) and not any(r.contaminated for r in clean)


# ---------------------------------------------------------------- 3


def test_extraction(spark):
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies, really, yes.</div><article><h1>Head&shy;line</h1><p>One,  two,
    three &lt;four&gt; &#233;.<p><b>Five<br>six, seven.<script>x("</p>")</script><ul><li>item</ul><form>name</form><aside>side</aside>
    <section class="comments"><p>First, comment, by a reader, long enough.</p></section></article><footer>&copy; x</footer>"""
    want = "Head\xadline\nOne, two, three <four> é.\nFive six, seven.\nitem"
    assert extract.main_text(page) == want
    rows = [(1, page), (2, None), (3, ""), (4, "plain"), (5, "<p>a" * 3000), (6, "<" * 50), (7, "<p>x</p" ), (8, "<div>" * 5000 + "deep")]
    got = {r.page_id: r.text for r in extract.extract_text(spark.createDataFrame(rows, "page_id long, html string").withColumn("TEXT", F.lit(1))).collect()}
    assert got[1] == want and got[2] == got[3] == "" and got[4] == "plain" and got[5].count("\n") == 2999 and got[7] == "x" and got[8] == "deep"
    assert extract.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


BODY = "<h1>Head</h1>" + "<p>A paragraph of the article, with some words, and some more of them, so that it counts.</p>" * 4
WANT = "Head" + "\nA paragraph of the article, with some words, and some more of them, so that it counts." * 4
WRAPPERS = ['div class="layout has-sidebar"', 'div class="page with-comments"', 'div class="share-page"', 'form id="aspnetForm"', 'div id="no-ads"', "div", 'div class="sidebar-layout widget-area"']


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["", "article", "main", 'div class="content"'])
def test_wrappers_hold_the_article(wrapper, inner):
    body = f"<{inner}>{BODY}</{inner.split()[0]}>" if inner else BODY
    name = wrapper.split()[0]
    parts = '<nav><a href="/">Menu</a></nav><div class="ad">Buy it, now, cheap, all of it.</div>'
    readers = '<section class="comments">' + "<article class='comment'><p>I read this, and liked it, a lot, yes, really, thanks.</p></article>" * 9 + "</section>"
    page = f"<html><body>{parts}<{wrapper}><div class='sidebar'><p>Other, things, here.</p></div>{body}{readers}</{name}><footer>x</footer></body></html>"
    assert extract.main_text(page) == WANT


def test_parts_stay_cut():
    assert extract.main_text('<div class="ad">Only an advert, with words, and commas, here.</div>') == ""
    assert extract.main_text(f'<article>{BODY}</article><aside><article><p>One, two, three, four.</p></article></aside><div hidden>{BODY}</div>') == WANT


def brute_page(page):
    """For the tables' pages: the article's paragraphs and headings by plain splitting."""
    import html
    import re

    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|ul|li)>", article.replace("<br>", " "))
    return "\n".join(t for t in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in parts) if t)


def test_pages_against_splitting(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = extract.extract_text(pages.select("page_id", "html")).collect()
    assert len(got) > 2000 and all(r.text == brute_page(r.html) for r in got)


def test_deep_and_long_pages_take_linear_time():
    import time

    deep = "<div>" * 20_000 + "<p>one, two</p>" * 20_000 + "</span>" * 20_000
    start = time.process_time()
    assert extract.main_text(deep).count("\n") == 19_999
    assert time.process_time() - start < 10


# ---------------------------------------------------------------- 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60), st.integers(7, 12))
def test_code_lengths(counts, limit):
    n = np.array(counts)
    length = huffman.limited_lengths(n, limit)
    used = length[n > 0].astype(int)
    assert (length[n == 0] == 0).all() and (used <= limit).all()
    if len(used) > 1:
        assert sum(2.0**-x for x in used) == pytest.approx(1)
        import heapq

        heap = sorted(n[n > 0].tolist())
        free = 0
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            free += x
            heapq.heappush(heap, x)
        if limit == 12 and max(used) < limit:
            assert int((n[n > 0] * used).sum()) == free  # the limit does not bind: as short as Huffman's own


def test_block_round_trip():
    rng = np.random.default_rng(1)
    ids = (rng.pareto(1.0, 5000) * 3).astype(np.int64) % 3000
    lengths = huffman.limited_lengths(np.bincount(ids))
    for n in (1, 127, 128, 129, 5000):
        bits, marks = huffman.encode_block(ids[:n], lengths, huffman.canonical_codes(lengths))
        assert (huffman.decode_block(bits, marks, n, *huffman.decode_table(lengths)) == ids[:n]).all()


def expected(path, rows):
    t = Tokenizer.from_file(path)
    return [(k, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for k, x in rows]


def test_token_files(spark, docs, none, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(huffman, "BLOCK", 50)
    where = base.scratch_path(spark, "test")
    huffman.write_tokens(docs, where, path)
    got = huffman.read_tokens(spark, where).collect()
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in got), key=lambda r: r[1])
    want, at = expected(path, TEXTS), 0
    assert [r[0] for r in got] == sorted((k for k, _ in want), key=lambda k: (k is not None, k))
    for k, start, n, crc, ids in got:
        want.remove((k, ids))
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    assert not want
    where = base.scratch_path(spark, "test")
    huffman.write_tokens(none, where, path)
    assert huffman.read_tokens(spark, where).count() == 0


# ---------------------------------------------------------------- 5


def brute_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def brute_llr(text, weights):
    h = [xxhash.xxh64_intdigest(w, seed=42) for w in quality_words(text)]
    pair = lambda a, b: xxhash.xxh64_intdigest(int(b).to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(int(a).to_bytes(8, "little"), seed=42))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    total = sum(weights[signed(x) % len(weights)] for x in h) + sum(weights[signed(pair(a, b)) % len(weights)] for a, b in zip(h, h[1:]))
    return total / (2 * len(h) - 1) if h else None


def listed(weights):
    return [r.weight for r in weights.orderBy("place").collect()]


def quality_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality(spark, docs, none):
    rng = random.Random(4)
    more = [(100 + k, " ".join(rng.choice(["a", "b", "c\n", "a b c d e", "#x|", "\t", "é"]) for _ in range(rng.randint(0, 60)))) for k in range(40)]
    rows = TEXTS + more
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("KEPT", F.lit(1))
    weights = [rng.uniform(-1, 1) for _ in range(64)]
    got = quality.judge(df, quality.as_table(spark, weights), 0.0, buckets=64).collect()
    for r in got:
        base_row = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_row, r.text[:80]
        failed = base_row[0] < 10 or 100 * base_row[4] > 20 * base_row[0]
        score = brute_llr(r.text, weights)
        assert r.base_failed == failed and (r.llr is None if score is None else r.llr == pytest.approx(score))
        assert r.kept == (not failed and score >= 0)
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    fitted = listed(quality.fit_weights(docs, quality.trusted_ids(labels), 128))
    assert len(fitted) == 128 and any(fitted) and any(w != round(w, 6) for w in fitted)
    assert set(listed(quality.fit_weights(docs, quality.trusted_ids(labels.limit(0)), 16))) == {0.0}
    zeros = quality.as_table(spark, [0.0] * 4)
    assert quality.judge(none, zeros, 0.0, buckets=4).count() == 0
    nothing, threshold = quality.fit(none, labels)
    assert listed(nothing) == [0.0] * quality.BUCKETS * quality.FOLDS and threshold == 0.0
    own = quality.judge(docs.withColumn("_w", F.lit(1)).withColumn("_h", F.lit(2)), zeros, 0.0, buckets=4)
    assert {(r._w, r._h) for r in own.select("_w", "_h").collect()} == {(1, 2)}


def test_quality_folds(spark):
    """A document's weights come from the trusted documents of the other folds alone."""
    docs = spark.createDataFrame([(k, f"word{k} common") for k in range(40)], "doc_id long, text string")
    trusted, folds, buckets = docs.select("doc_id"), 3, 64
    weights = listed(quality.fit_weights(docs, trusted, buckets, folds))
    of = {r.doc_id: r.k for r in docs.selectExpr("doc_id", f"{quality.fold_of(folds)} as k").collect()}
    for k in range(folds):
        without = docs.where(F.col("doc_id").isin([i for i, f in of.items() if f != k])).select("doc_id")
        assert weights[k * buckets : (k + 1) * buckets] == listed(quality.fit_weights(docs, without, buckets))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_quality_does_not_know_the_trusted(spark, sf):
    """Unlabelled documents are kept about as often as trusted ones; what is labelled bad is mostly rejected."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judge(d.select("doc_id", "text"), *quality.fit(d, labels), quality.FOLDS).join(labels, "doc_id", "left")
    kept = {r.quality: (r.share, r.bad) for r in out.groupBy("quality").agg(F.expr("avg(int(kept)) filter (where not base_failed) as share"), F.expr("avg(int(not kept)) as bad")).collect()}
    # one in twelve of the unlabelled that pass the base rules is junk, as among the labelled ones
    assert kept[1][0] > 0.98 and kept[None][0] > 0.88 and kept[0][1] > 0.7


# ---------------------------------------------------------------- 6


def windows(text: bytes):
    b = np.frombuffer(ppm.PAD + text, np.uint8).astype(np.int64)
    return np.unique((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:], return_counts=True)


def brute_ppm(training: bytes, text: bytes) -> float:
    """Code length by plain counting: escapes from three bytes of context down to none, then 256 equal bytes."""
    data, bits = ppm.PAD + training, 0.0
    for i in range(len(text)):
        past, p = (ppm.PAD + text[:i])[-3:], 1 / 256
        for n in range(4):
            context = past[3 - n :]
            after = Counter(data[j] for j in range(3, len(data)) if data[j - n : j] == context)
            total, kinds = sum(after.values()), len(after)
            if total:
                p = (after[text[i]] + kinds * p) / (total + kinds)
        bits -= np.log2(p)
    return bits


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30), min_size=1, max_size=3), st.lists(st.binary(max_size=12), min_size=1, max_size=3))
def test_code_lengths_against_counting(training, texts):
    trees = ppm.ByteTrees({f"l{k}": windows(t) for k, t in enumerate(training)})
    want = [[brute_ppm(t, x) for t in training] for x in texts]
    assert trees.bits(texts) == pytest.approx(np.array(want), rel=1e-4, abs=1e-3)


def test_code_is_a_distribution():
    rng = random.Random(1)
    texts = {"x": "abra cadabra " * 20, "y": "".join(rng.choice("xyz é") for _ in range(300)), "z": "日本語 и русский " * 9}
    trees = ppm.ByteTrees({lang: windows(t.encode()) for lang, t in texts.items()})
    for context in (b"", b"a", b"ab", b"abr", b"\xff\xfe", "本".encode()):
        bits = trees.bits([context + bytes([c]) for c in range(256)]) - trees.bits([context])
        assert np.exp2(-bits).sum(0) == pytest.approx([1, 1, 1], rel=1e-4)
    assert trees.langs[trees.bits([b"abra cadabra"]).argmin()] == "x"
    assert trees.langs[trees.bits(["русский".encode()]).argmin()] == "z"
    long = ("abra cadabra " * 60000).encode()
    assert trees.bits([long, b"abra"])[0] == pytest.approx(trees.bits([long])[0])


def test_language(spark, docs, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = base.fold(F.col("doc_id"), 4) == 2
    model = ppm.train(d, ~held)
    seen = ppm.identify(d, model).where(held).selectExpr("avg(cast(lang = lang_pred as int))", "min(score)", "max(score)").first()
    assert seen[0] > 0.98 and 0 <= seen[1] <= seen[2] <= 1
    edge = ppm.identify(docs, model).collect()
    assert len(edge) == len(TEXTS) and {r.lang_pred for r in edge if not (r.text or "").strip()} == {"und"}
    assert ppm.train(none, F.lit(True)) is None and {r.lang_pred for r in ppm.identify(docs, None).collect()} == {"und"}


# ---------------------------------------------------------------- 9


def test_toxicity(spark, docs, none):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    held = base.fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(d, labels, ~held)
    rows = toxicity.score(d.where(held), model).join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    bad, good = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(rows) > 500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    above = sum((b.score > g.score) + 0.5 * (b.score == g.score) for b in bad for g in good)
    assert above > 0.98 * len(bad) * len(good)
    assert sum(r.predicted for r in bad) > 0.9 * len(bad) and sum(r.predicted for r in good) < 0.01 * len(good)
    out = toxicity.score(docs, model)
    assert out.count() == len(TEXTS) and out.columns.count("score") == 1


def test_toxicity_without_labels(spark, docs, none):
    few = spark.createDataFrame([(4, 1), (5, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    for labels, constant in ((few.limit(0), 0.0), (few, 1.0)):
        model = toxicity.train(docs, labels, F.lit(True))
        assert {r.score for r in toxicity.score(docs, model).collect()} == {constant}
    assert toxicity.score(none, model).count() == 0 and not toxicity.train(none, few, F.lit(True)).fitted


def test_toxicity_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {k % 40}") for k in range(80)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, labels, F.lit(True), 10).collect()
    assert len(rows) == 10 == len({(r.doc_id, r.text) for r in rows}) and {(r.doc_id, r.toxic) for r in rows} <= {(1, 1), (2, 0)}


def test_toxicity_lexicon_counts_texts():
    rng = random.Random(3)
    words = [toxicity.words_of(" ".join(rng.choices(["You", "fool5", "sh1ny", "car", "tree"], k=6))) for _ in range(5)]
    assert {"fool5", "fools", "fool*"} & toxicity.terms_of(words[0]) or "fool5" not in words[0]
    assert toxicity.weight(9, 0, 10, 100) > toxicity.weight(3, 0, 10, 100) > toxicity.weight(3, 30, 10, 100)


def test_isotonic():
    x, p = toxicity.isotonic(np.array([0.1, 0.4, 0.3, 0.9, 0.8]), np.array([0, 0, 1, 1, 1.0]))
    assert (np.diff(x) >= 0).all() and (np.diff(p) >= 0).all() and 0 < p[0] and p[-1] < 1


# ---------------------------------------------------------------- 10


def test_packing(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, path, partitions=2).collect()
    want = sorted(expected(path, TEXTS), key=repr)
    rebuilt = Counter()
    by_seq = {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    assert sum(r.length for r in got) == sum(len(ids) for _, ids in want)
    for r in got:
        rebuilt[(r.doc_id, r.start, tuple(r.ids))] += 1
    # a repeated doc_id has two documents: the multiset of its pieces' ids is theirs
    twice = sorted(t for k, ids in want if k == 7 for t in ids)
    assert sorted(t for r in got if r.doc_id == 7 for t in r.ids) == twice
    once = {k: ids for k, ids in want if k not in (7,)}
    for k, ids in once.items():
        parts = sorted((s, x) for (d, s, x) in rebuilt if d == k)
        assert [t for _, x in parts for t in x] == ids and all(r.doc_tokens == len(ids) for r in got if r.doc_id == k)
    assert packing.pack(none, path).count() == 0


def test_packing_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 30_000)
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(6)
    rows = [(k, " ".join(rng.choice(["alpha", "beta,", "gamma.", "delta"]) for _ in range(rng.choice([0, 5, 60, 700, 9000])))) for k in range(60)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path, partitions=1).collect()
    ids = dict(expected(path, rows))
    filled = Counter()
    for k, want in ids.items():
        parts = sorted((r.start, list(r.ids)) for r in got if r.doc_id == k)
        assert [t for _, x in parts for t in x] == want
    for r in got:
        filled[r.sequence_id] += r.length
    n = sum(map(len, ids.values()))
    padded = sum(packing.LENGTH - v for v in filled.values() if v & (v - 1))
    # each group of about GROUP tokens may end in a sequence that is not full
    assert n > 2 * packing.GROUP and padded < 0.02 * n + packing.LENGTH * (n / packing.GROUP + 1)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.sampled_from([0.0, 2.0, 7.0])), min_size=1, max_size=14))
def test_cuts_are_optimal(steps):
    at = np.cumsum([s for s, _ in steps])
    pen = np.array([p for _, p in steps])
    length = 8
    short = [1 << k for k in range(4) if length // 4 <= 1 << k < length]
    best = {0: 0.0}
    for i, p in zip(at.tolist(), pen.tolist()):
        best[i] = p + min([best[j] + length - (i - j) for j in best if i - length <= j < i] + [best[j] + packing.SHORT for j in best if i - j in short])
    cuts = packing.choose_cuts(at, pen, length)
    cost, last = 0.0, 0
    for c in cuts:
        cost += pen[at.tolist().index(c)] + min([length - (c - last)] + [packing.SHORT] * ((c - last) in short))
        last = c
    assert last == at[-1] and cost == pytest.approx(best[int(at[-1])])
