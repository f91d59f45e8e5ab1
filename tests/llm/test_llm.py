"""The corpus operators against brute force, round trips and held-out accuracy, and on awkward tables."""

import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from windrow.llm import chat, decontaminate, html_text, minhash, packing, passages, quality, simhash, suffix_dedup, topk, toxicity
from windrow.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, tmp_path, rows, schema):
    path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def odd_docs(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(9000))
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "one two three four five six"), (5, long), (6, long), (7, long + " tail"), (None, long), (8, "é ü 日本 \U0001f600 <|endoftext|> \u00a0 x"), (8, "é ü 日本 \U0001f600 <|endoftext|> \u00a0 x"), (9, "a" * 5000)]
    df = table(spark, tmp_path, [(*r, "en", None, None, 1, 2) for r in rows], DOCS + ", score int, fp int")
    return rows, df


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}


# 1: passages


def test_compact_windows_are_the_tree_nodes():
    rng = np.random.default_rng(0)
    v, doc = rng.integers(0, 2**63, 400).astype(np.uint64), np.repeat([0, 1], [150, 250])
    want = set()
    for i in range(400):
        a = b = i
        while a > 0 and doc[a - 1] == doc[i] and v[a - 1] > v[i]:
            a -= 1
        while b < 399 and doc[b + 1] == doc[i] and v[b + 1] > v[i]:
            b += 1
        if b - a + 1 >= 20:
            want.add((a, i, b))
    assert set(zip(*(x.tolist() for x in passages.compact_windows(v, doc, 20)), strict=True)) == want


def test_planted_passages_are_found_and_cut(spark, tmp_path):
    rng = random.Random(1)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = words(60)
    near = list(shared)
    near[30] = "changed"
    rows = [(i, " ".join(words(200))) for i in range(30)]
    for i, p in ((3, shared), (7, shared), (11, near), (12, shared[:40])):
        rows[i] = (i, " ".join(words(50) + p + words(50)))
    df = table(spark, tmp_path, rows, "doc_id long, text string")
    links = passages.repeated_passages(df)
    found = {r["doc_id"]: r["class_id"] for r in passages.classes(links).collect()}
    assert {3: 3, 7: 3}.items() <= found.items() and set(found) <= {3, 7, 11}
    kept = {r["doc_id"]: r["text"] for r in passages.without_repeats(df, links).collect()}
    assert kept[3] == rows[3][1] and kept[7].split() == rows[7][1].split()[:50] + rows[7][1].split()[-50:] and kept[12] == rows[12][1]


def near_pairs(texts):
    """Pairs of texts with stretches of WIDTH shingles that share NEED of them, by comparing all stretches."""
    grams = [[tuple(t[i : i + 5]) for i in range(len(t) - 4)] for t in texts]
    out = set()
    for a in range(len(texts)):
        for b in range(a):
            place = {g: j for j, g in enumerate(grams[b])}
            hits = np.array([place.get(g, -1) for g in grams[a]])
            if (hits >= 0).sum() < passages.NEED:
                continue
            for i in range(len(hits) - passages.WIDTH + 1):
                own = np.sort(hits[i : i + passages.WIDTH])
                own = own[own >= 0]
                if len(own) >= passages.NEED and (own[passages.NEED - 1 :] - own[: len(own) - passages.NEED + 1]).min() < passages.WIDTH:
                    out.add((a, b))
                    break
    return out


def families(rng):
    """40 families of 5 variants of one template, and 20 clusters of 15 copies of a passage with one word changed in each."""
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    template, texts = words(60), []
    for _ in range(40):
        family = list(template)
        for i in rng.sample(range(60), 4):
            family[i] = words(1)[0]
        for _ in range(5):
            one = list(family)
            one[rng.choice([1, 2, 57, 58])] = words(1)[0]
            texts.append(one)
    for _ in range(20):
        passage = words(60)
        for _ in range(15):
            one = list(passage)
            one[rng.randrange(60)] = words(1)[0]
            texts.append(one)
    rng.shuffle(texts)
    return texts, [" ".join(words(20) + t + words(20)) for t in texts]


def test_families_of_near_passages_are_whole(spark, tmp_path):
    """Near passages end in one class, whoever holds a key first; a document without a near passage has no link."""
    texts, whole = families(random.Random(3))
    df = table(spark, tmp_path, list(enumerate(whole)), "doc_id long, text string")
    want = near_pairs([t.split() for t in whole])
    links = passages.repeated_passages(df)
    found = {r["doc_id"]: r["class_id"] for r in passages.classes(links).collect()}
    linked = {(r["doc"], r["other"]) for r in links.collect()}
    one = sum(a in found and found[a] == found.get(b) for a, b in want)
    assert len(want) >= 1000 and one >= 0.99 * len(want)
    assert linked <= want


def marked_rows(texts, buckets=4, side=None, monkeypatch=None):
    """The operator's tasks run by hand: windows, meeting, marks and clusters of a list of texts."""
    if side:
        monkeypatch.setattr(passages, "SIDE", side)
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    none = np.zeros(0, np.int64)
    dealt = pa.Table.from_batches(list(passages._windows(buckets, none)(iter([rows]))))
    ones, asks = [], []
    for b in range(buckets):
        met = passages._meet(none)(dealt.filter(pa.compute.equal(dealt.column("bucket"), b)))
        for r in met.to_pylist():
            (ones if r["kind"] == 1 else asks).append(passages._unpacked(r["blob"], 6 if r["kind"] == 1 else 5))
    ask = np.hstack(asks)
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("at", "ext", "key", "block")]))
    asked = [[dict(zip(("at", "ext", "key", "block"), x, strict=True)) for x in ask[1:, ask[0] == d].T.tolist()] for d in range(len(texts))]
    asked = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(asked, kind)], names=["doc_id", "text", "asks"])
    return ones, pa.Table.from_batches(list(passages._marked(buckets)(iter([asked]))))


def test_keys_in_blocks_lose_no_class(spark, monkeypatch):
    """Keys of more than SIDE windows: blocks give links and centres, centres meet by a second least shingle, in parts if they are still many."""
    texts, whole = families(random.Random(5))
    want = near_pairs([t.split() for t in whole])
    ones, marked = marked_rows(whole, side=6, monkeypatch=monkeypatch)
    assert max(marked.column("block").to_pylist()) > 3
    first = passages._clustered(False)(marked)
    monkeypatch.undo()
    made = [passages._unpacked(r["blob"], 6) for r in first.to_pylist() if r["kind"] == 1]
    centres = spark.createDataFrame([r for r in first.to_pylist() if r["kind"] == 3], passages._CLUSTERED)
    made += [passages._unpacked(r["blob"], 6) for r in passages._centre_links(centres, 4).where("kind = 1").collect()]
    up = list(range(len(whole)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in np.hstack(ones + made).T.tolist():
        up[find(x[0])] = find(x[3])
    assert sum(find(a) == find(b) for a, b in want) >= 0.97 * len(want)


def test_more_buckets_than_one_pass_deals(monkeypatch):
    """The rows emitted grow with the windows, not with the buckets, and both passes put a key where one pass does."""
    _, whole = families(random.Random(6))
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(whole)), pa.int64()), pa.array(whole)], names=["doc_id", "text"])
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(passages, "FAN", 16)
    first = list(passages._windows(5000, none)(iter([rows])))
    assert sum(b.num_rows for b in first) <= 17 * passages.FUNCTIONS
    second = [r for b in passages._redealt(5000, none)(iter(first)) for r in b.to_pylist() if r["kind"] == 0]
    monkeypatch.setattr(passages, "FAN", 10000)
    once = [r for b in passages._windows(5000, none)(iter([rows])) for r in b.to_pylist() if r["kind"] == 0]

    def keys(rows):
        out = set()
        for r in rows:
            x = passages._unpacked(r["blob"], 5)
            out |= {(r["bucket"], *c) for c in zip(*[np.cumsum(x[0]).tolist(), *x[1:].tolist()], strict=True)}
        return out

    assert keys(second) == keys(once) and len(keys(once)) > 1000
    hot = np.unique([k for _, k, *_ in keys(once)])[:3]
    wide = [r for b in passages._windows(5000, hot)(iter([rows])) for r in b.to_pylist() if r["kind"] == 0]
    assert {k[1:] for k in keys(wide)} == {k[1:] for k in keys(once)}


def test_long_texts_in_pieces(spark, tmp_path, monkeypatch):
    """A passage is found wherever the pieces of a long text end."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = [words(60) for _ in range(12)]
    text = " ".join(" ".join(words(rng.randrange(60, 140)) + s) for s in shared)
    others = [" ".join(words(30) + s + words(30)) for s in shared]
    monkeypatch.setattr(passages, "BLOCK", 5000)
    cuts = list(passages._pieces(text.encode()))
    assert len(cuts) > 2 and all(text.split()[base : base + len(p.split())] == p.decode().split() for base, p in cuts)
    ones, marked = marked_rows([*others, text])
    made = [passages._unpacked(r["blob"], 6) for r in passages._clustered(False)(marked).to_pylist() if r["kind"] == 1]
    x = np.hstack(ones + made).T.tolist()
    for i, s in enumerate(shared):
        at = text.split().index(s[0])
        assert any(d == 12 and o == i and abs(a - at) <= 1 and abs(b - at - 60) <= 1 for d, a, b, o, _, _ in x)


def test_passages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns; the pipeline's stage on the same rows."""
    import corpus_pipeline

    rows, df = odd_docs(spark, tmp_path)
    df = df.withColumns({"spans": F.lit(1), "start": F.lit(2), "other": F.lit(3), "_later": F.lit(4), "_cut": F.lit(5)})
    links = passages.repeated_passages(df)
    got = {r["doc_id"]: r for r in passages.classes(links).collect()}
    assert set(got) == {5, 6, 7} and {r["class_id"] for r in got.values()} == {5} and [got[i]["first"] for i in (5, 6, 7)] == [True, False, False]
    assert passages.classes(passages.repeated_passages(df.limit(0))).count() == 0
    kept = corpus_pipeline.drop_passages(spark, df, SF)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in (6,))
    assert {r["text"].strip() for r in kept.where("doc_id = 7").collect()} == {"tail"}
    bare = df.select("doc_id", "text")
    assert corpus_pipeline.drop_passages(spark, bare, SF).columns == ["doc_id", "text"]


# 2: pages


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<p", ""),
        ("just words &amp; more", "just words & more"),
        ("<nav><a href=/>Home</a></nav><article><h1>T</h1><p>One,\n two&nbsp;three.<p>Fo<b>ur</b></article><footer>x</footer>", "T One, two three. Four"),
        ("<div id=menu><ul><li><a>m</a></ul></div><div class=content><p>Long text, with commas, and words enough to score well here.</p><div class='ad'>buy</div><p>End.</p></div><div id=comments><p>Nice, very nice, so nice, thank you, really.</p></div>", "Long text, with commas, and words enough to score well here. End."),
        ("<script>var a='<p>no</p>'</script><main><p>yes</p><form><p>field</p></form></main>", "yes"),
    ],
)
def test_main_text(page, want):
    assert html_text.extract(page) == want


ARTICLE = "<h1>Title</h1><p>First, a long paragraph with commas, words, and enough of them to score.</p><p>Second, another one, which is also long enough to count as text.</p>"
PLAIN = "Title First, a long paragraph with commas, words, and enough of them to score. Second, another one, which is also long enough to count as text."


@pytest.mark.parametrize("name", ["no-sidebar", "with-comments", "social-science", "legal-news", "has-ads", "sidebar", "page comments-open", "layout-sidebar"])
def test_wrappers_with_an_unwanted_word_keep_the_article(name):
    assert html_text.extract(f"<body><nav>menu</nav><div class='{name}'>{ARTICLE}</div></body>") == PLAIN


@pytest.mark.parametrize("name", ["sidebar", "ad", "site-footer", "comments", "comment-list", "cookie-notice", "related", "ad-3", "social-share", "newsletter-signup"])
def test_unwanted_names_beside_an_article_go(name):
    extra = f"<div class='{name}'><p>Reader, one, says something long enough, with commas, to score points.</p><p>And, again, more of it, even longer than the first one was.</p></div>"
    for page in (f"<main>{ARTICLE}</main>{extra}", f"<div>{ARTICLE}{extra}</div>", f"<div>{ARTICLE}</div>{extra}{extra}"):
        assert html_text.extract(page) == PLAIN


def test_deep_and_unbalanced_pages_take_linear_time():
    import time

    def took(n):
        pages = ["<div>" * n + "text, here" + "</b>" * n, "<div>x" * n, "<b>" * n + "<p>y</p>" * n, "<b><table><td>" + "<div>" * n + "</b>" * n, "<ul>" + "<b>" * n + "<li>z" * n]
        began = time.process_time()
        for p in pages:
            html_text.extract(p)
        return time.process_time() - began

    took(500)
    assert took(16000) < 12 * max(took(4000), 0.02)


def plain_text(page):
    """Blocks of a well-formed page outside unwanted tags, by the standard library's parser: what a page of one article should give."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.off, self.blocks, self.now = 0, [], ""

        def cut(self):
            if self.now.split():
                self.blocks.append(" ".join(self.now.split()))
            self.now = ""

        def handle_starttag(self, tag, attrs):
            if tag in html_text.BLOCK:
                self.cut()
            self.off += tag in html_text.DROP_TAG | html_text.DOUBT_TAG

        def handle_endtag(self, tag):
            if tag in html_text.BLOCK:
                self.cut()
            self.off -= tag in html_text.DROP_TAG | html_text.DOUBT_TAG

        def handle_data(self, data):
            if not self.off:
                self.now += data

    t = Text()
    t.feed(page)
    t.cut()
    return " ".join(t.blocks)


def test_generated_articles_match_another_parser():
    rng = random.Random(9)
    word = lambda: rng.choice(["alpha", "beta,", "gamma &amp; delta", "<b>bold</b>", "<em>x</em>y", "caf&eacute;", "&lt;tag&gt;", "1&nbsp;2"])
    for _ in range(60):
        body = ""
        for _ in range(rng.randrange(3, 9)):
            inner = " ".join(word() for _ in range(rng.randrange(15, 40)))
            body += rng.choice([f"<p>{inner}, long enough, with commas.</p>", f"<h2>{inner}</h2>", f"<blockquote><p>{inner}, said, again.</p></blockquote>", f"<ul><li>{inner}</li><li>{inner}</li></ul>"])
        page = f"<html><head><title>t</title><script>var a = '<p>';</script></head><body><nav><a href='/'>Home</a></nav><article>{body}<form><p>field</p></form></article><footer><p>foot</p></footer></body></html>"
        assert html_text.extract(page) == plain_text(page)


def test_pages_on_odd_tables(spark, tmp_path):
    rows = [(1, None, "x", 1), (1, None, "x", 1), (2, "", None, 2), (None, "<p>words</p>", "y", 3)]
    df = table(spark, tmp_path, rows, "page_id long, html string, text string, n_chars int")
    got = html_text.extract_pages(df.withColumn("score", F.lit(1)))
    assert got.columns == ["page_id", "html", "score", "text", "n_chars"] and sorted(r["text"] for r in got.collect()) == ["", "", "", "words"]
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_pages_keep_every_row(spark):
    got = html_text.op2_html(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/pages.parquet").count() and got.where("n_chars <> char_length(text) or text is null").count() == 0


# 3: packing


def check_packing(rows, got):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = sorted((d if d is not None else -1, zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)) for d, t in rows for ids in [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]] if len(ids) <= 2048)
    one = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids_crc32"], r["length"]) for r in got if r["doc_tokens"] <= 2048)
    assert one == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048


def test_packing(spark, tmp_path):
    rows, df = odd_docs(spark, tmp_path)
    check_packing(rows, packing.pack_documents(df).collect())
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = packing.op3_packing(spark, SF).collect()
    check_packing(docs, got)
    assert sum(r["length"] for r in got) >= 0.97 * 2048 * len({r["sequence_id"] for r in got})
    assert packing.pack_documents(df.limit(0)).count() == 0


# 4: repeated bytes


def repeated(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1 if d is not None else 0):
            first[b[i : i + length]] = min(d, first.get(b[i : i + length], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1 if d is not None else 0):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out.append((d, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_repeated_bytes(spark, tmp_path):
    rows, _ = odd_docs(spark, tmp_path)
    rng = random.Random(3)
    base = [(100 + r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    for i in range(30):
        _, t = rng.choice(base)
        a = rng.randrange(max(1, len(t) - 200))
        rows.append((1000 + i, f"zq{i} " + t[a : a + rng.choice([30, 49, 50, 51, 70, 200])] + f" q{i}"))
    rows += base
    got = sorted(map(tuple, suffix_dedup.repeated_bytes(table(spark, tmp_path, rows, "doc_id long, text string")).collect()), key=str)
    assert got == repeated(rows)


# 5: top k


def test_top_k_matches_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.integers(-4, 5, (300, 6)) / 8
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 6), (902, [None, 1.0] * 3), (903, [])]
    got = topk.integer_vectors(table(spark, tmp_path, rows, "vec_id long, embedding array<double>"))
    assert got.count() == 301
    q = np.vstack([np.floor(256 * x), np.zeros(6)])  # an empty vector has the product 0 with all
    ids = [*range(300), 903]
    want = {(i, k, j, int(s)) for i in range(0, 300, 50) for k, (s, j) in enumerate(sorted(((-(q[i] @ q[n]), j) for n, j in enumerate(ids) if j != i))[:5], 1) for s in [-s]}
    assert {tuple(r) for r in topk.top_k(got, got.where("id % 50 = 0"), pivots=8, page=16).collect()} == want
    assert topk.top_k(got.limit(0), got.limit(0)).count() == 0


# 6 and 9: classifiers


@pytest.mark.parametrize("score, label, least", [(quality.op6_quality, "quality", 0.97), (toxicity.op9_toxicity, "toxic", 0.8)])
def test_held_out_accuracy(spark, score, label, least):
    sf = SF.replace("0.001", "0.1")
    rows = score(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", label).collect()
    pos, neg = (np.array([r["score"] for r in rows if r[label] == v]) for v in (1, 0))
    area = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    assert area >= least


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_tables(spark, tmp_path, module, label):
    rows, df = odd_docs(spark, tmp_path)
    marks = table(spark, tmp_path, [(4, 1), (5, 0), (4, 0), (None, 1), (7, None)], f"doc_id long, {label} int")
    got = module.score_documents(df, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert module.score_documents(df, marks.limit(0)).count() == len(rows)
    assert module.score_documents(df.limit(0), marks).count() == 0


def test_label_model_finds_accuracies_and_shared_weight(spark, tmp_path):
    rng = np.random.default_rng(5)
    n, right = 6000, np.array([[0.5, 0.45, 0.05], [0.05, 0.25, 0.7]])
    y = rng.random(n) < 0.3
    # voters 0 to 4 vote by the class alone, voter 5 repeats voter 4
    draws = (rng.random((n, 5, 1)) > np.cumsum(right, 1)[y.astype(int)][:, None, :2]).sum(2) - 1
    votes = np.hstack([draws, draws[:, 4:]]).astype(np.int8)
    voters = toxicity.Voters([])
    voters.voters = 6
    each = table(spark, tmp_path, [(bytearray(v.tobytes()), 1) for v in votes], "votes binary, n long")
    start = toxicity.LabelModel(np.tile(np.array([[0.3, 0.6, 0.1], [0.1, 0.5, 0.4]])[:, :, None], 6), 0.2, np.ones(6))
    one, many = (toxicity.fit_label_model(p, voters, start, 30) for p in (toxicity.counted_patterns(each), each))
    assert toxicity.counted_patterns(each).count() == len(np.unique(votes, axis=0)) < n
    for a, b in ((one.chance, many.chance), (one.share, many.share), (one.prior, many.prior)):
        assert np.allclose(a, b, atol=1e-9)
    assert np.abs(one.chance[:, :, :4] - right[:, :, None]).max() < 0.08 and abs(one.prior - 0.3) < 0.06
    assert one.share[:4].min() > 0.75 and np.abs(one.share[4:] - 0.5).max() < 0.1
    guess = one.posterior(votes) > 0.5
    assert (guess == y).mean() > 0.85
    assert toxicity.fit_label_model(each.limit(0), voters, start) is start


# 7: SimHash


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_match_brute_force(spark, tmp_path):
    rows, _ = odd_docs(spark, tmp_path)
    rows += [(100 + r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    marks = [plain_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 2:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = sorted(((d, f"{m:016x}", least.get(find(i))) for i, ((d, _), m) in enumerate(zip(rows, marks, strict=True))), key=str)
    df = table(spark, tmp_path, rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_vantage_shards_lose_no_pair():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 500, dtype=np.uint64)
    points = np.unique(np.r_[base, base ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)), base[:50] ^ np.uint64(3)])
    nodes = simhash.vantage_tree(points[::3], 16)
    index, shard, home = simhash.route(points, nodes, 2)
    assert home.sum() == len(points)
    labels = np.arange(len(points))
    for s in np.unique(shard):
        own = index[shard == s]
        child, root = simhash.shard_forest(points[own], home[shard == s], 2, leaf=16)
        simhash._settle(labels, own[child], own[root])
    want = np.arange(len(points))
    x, y = np.nonzero(np.bitwise_count(points[:, None] ^ points[None]) <= 2)
    simhash._settle(want, x, y)
    assert (labels == want).all()


# 8: decontamination


def test_occurrences_match_edit_distance(spark, tmp_path):
    def brute(item, text, most):
        prev = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            cur = [i]
            for j, t in enumerate(text, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != t)))
            prev = cur
        return min(prev) if min(prev) <= most else None

    rng = random.Random(1)
    doc = lambda n: " ".join("".join(rng.choice(["th", "on", "er", "an", "tion", "ing", "the"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    texts = [doc(rng.randint(8, 30)) for _ in range(6)] + ["tiny"]
    items = decontaminate.Items(list(range(7)), [t.encode() for t in texts])
    for _ in range(15):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, len(t) // 7)):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "yz"])
        text = f"{doc(15)} {''.join(t)} {doc(15)}".encode()
        got = {j: e for j, e, _, _ in decontaminate.occurrences(text, items)}
        for j in range(6):
            assert got.get(j) == brute(items.texts[j], decontaminate.fold(text), int(items.edits[j]))
    rows, df = odd_docs(spark, tmp_path)
    bench = table(spark, tmp_path, [(1, None), (2, ""), (3, "one, TWO three"), (None, "x"), (3, "one, TWO three")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, bench).collect()] == [(4, 3)]
    assert decontaminate.matches(df, bench.limit(0)).count() == decontaminate.matches(df.limit(0), bench).count() == 0


# 10: chats


def test_chats(spark):
    call = '{"content":"","tool_calls":[{"id":"c1","name":"add","arguments":{"b":2,"a":1}},{"id":"c2","name":"add","arguments":{"a":"x","z":1}}]}'
    rows = [(1, 0, "user", 'say "hi"\n'), (1, 1, "tool", '{"tool_call_id":"c1","content":"3"}'), (1, 2, "assistant", call), (1, 3, "tool", '{"tool_call_id":"c9","content":"?"}'), (2, None, None, None), (None, 1, "user", "{not json"), (2, 1, "user", "x"), (2, 1, "user", "x")]
    schemas = spark.createDataFrame([("add", "a", "integer", True), ("add", "b", "integer", True)], "tool string, param string, type string, required boolean")
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()
    assert len(out) == len(rows) and all(json.loads(r["json"]) for r in out)
    one = [(r["turn"], r["link"]) for r in sorted((r for r in out if r["conv_id"] == 1), key=lambda r: r["position"])]
    assert one == [(0, "none"), (2, "call"), (1, "result"), (3, "orphan")]
    made = next(r for r in out if r["link"] == "call")
    assert made["problems"] == "missing b; unknown parameter z; wrong type of a"
    assert json.loads(made["json"])["tool_calls"][0] == {"arguments": {"a": 1, "b": 2}, "id": "c1", "name": "add"} and '{"a":1,"b":2}' in made["json"]


def plain_chats(rows, schemas):
    """The formatter in plain Python: {(conv, turn, role, text): (n_calls, link, problems, message)}."""

    def parse(text):
        def once(pairs):
            if len({k for k, _ in pairs}) < len(pairs):
                raise ValueError
            return dict(pairs)

        try:
            return json.loads(text, object_pairs_hook=once)
        except ValueError:
            return ...

    out, ids = {}, {}
    made = {}
    for conv, turn, role, text in rows:
        body = parse(text) if (text or "").lstrip().startswith("{") else ...
        if not isinstance(body, dict) or not (body.get("tool_calls") or body.get("tool_call_id") is not None):
            body = {"content": text or ""}
        own = []
        for i, c in enumerate(body.get("tool_calls") or []):
            args = c.get("arguments", c.get("function", {}).get("arguments", {}))
            args = args if not isinstance(args, str) else args if parse(args) is ... else parse(args)
            own.append({"arguments": args, "id": c.get("id", f"call_{'null' if turn is None else turn}_{i}"), "name": c.get("name", c.get("function", {}).get("name", ""))})
            ids.setdefault(conv, set()).add(own[-1]["id"])
        made[conv, turn, role, text] = body, own
    kinds = {"integer": int, "number": (int, float), "string": str}
    for key, (body, own) in made.items():
        problems = set()
        for c in own:
            params = {p: (t, need) for tool, p, t, need in schemas if tool == c["name"]}
            if not params:
                problems.add(f"unknown tool {c['name']}")
            if not isinstance(c["arguments"], dict):
                problems.add("arguments are not an object")
            elif params:
                problems |= {f"missing {p}" for p, (_, need) in params.items() if need and p not in c["arguments"]}
                problems |= {f"unknown parameter {p}" for p in c["arguments"] if p not in params}
                problems |= {f"wrong type of {p}" for p, v in c["arguments"].items() if p in params and not isinstance(v, kinds[params[p][0]])}
        to = body.get("tool_call_id")
        message = {**body, "content": body.get("content") or "", "role": key[2] or ""}
        message.pop("tool_calls", None)
        if own:
            message["tool_calls"] = own
        link = "call" if own else "none" if to is None else "result" if to in ids.get(key[0], ()) else "orphan"
        out[key] = len(own), link, "; ".join(sorted(problems)), message
    return out


def test_chats_match_plain_python(spark):
    """Every call, result, problem and field, with null turns and ids, ties, repeated rows, bad JSON and extra columns."""
    rng = random.Random(12)
    schemas = [("add", "a", "integer", True), ("add", "b", "number", False), ("say", "t", "string", True)]
    args = [{"a": 1}, {"a": 1, "b": 2.5}, {"b": 2}, {"a": "x", "z": 1}, "{\"a\": 4}", "no json {", '{"a":1,"a":2}', [1, 2], {"t": "h\u00e9 \"q\" \n"}]
    rows = []
    for conv in [None, *range(12)]:
        for i in range(rng.randrange(2, 9)):
            kind, turn = rng.random(), rng.choice([i, i, i, None])
            if kind < 0.4:
                calls = [{"name": rng.choice(["add", "say", "other"]), "arguments": rng.choice(args), **({"id": f"c{rng.randrange(4)}"} if rng.random() < 0.7 else {})} for _ in range(rng.randrange(1, 3))]
                if rng.random() < 0.3:
                    calls = [{"id": c.get("id", "f"), "function": {"name": c["name"], "arguments": c["arguments"]}} for c in calls]
                rows.append((conv, turn, "assistant", json.dumps({"content": rng.choice([None, "hi"]), "tool_calls": calls, **({"zeta": {"b": 1, "a": [1]}, "audio": None} if rng.random() < 0.4 else {})})))
            elif kind < 0.7:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{rng.randrange(5)}", "content": "ok", **({"name": "add"} if rng.random() < 0.5 else {})})))
            else:
                rows.append((conv, turn, rng.choice(["user", None]), rng.choice(["plain", "{not json", None, '{"a": 1}'])))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "problems": F.lit("x"), "calls": F.lit(2)})
    got = chat.format_chats(df, spark.createDataFrame(schemas, "tool string, param string, type string, required boolean")).collect()
    want = plain_chats(rows, schemas)
    canonical = lambda m: json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    mine = sorted((str(r["conv_id"]), str(r["turn"]), r["role"], r["n_calls"], r["link"], r["problems"], canonical(json.loads(r["json"]))) for r in got)
    assert all(r["json"] == canonical(json.loads(r["json"])) for r in got)
    assert mine == sorted((str(c), str(t), role or "", n, link, p, canonical(m)) for (c, t, role, _), (n, link, p, m) in ((k, want[k]) for k in rows))
    for conv in {r["conv_id"] for r in got}:
        order = [json.loads(r["json"]) for r in sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["position"])]
        seen = set()
        known = {c["id"] for m in order for c in m.get("tool_calls", [])}
        for m in order:
            seen |= {c["id"] for c in m.get("tool_calls", [])}
            assert "tool_calls" in m or m.get("tool_call_id") not in known or m["tool_call_id"] in seen
    assert chat.format_chats(df.limit(0)).count() == 0
    inferred = {(r["tool"], r["param"]): (r["type"], r["required"]) for r in chat.inferred_schemas(df).collect()}
    assert inferred["add", "a"][0] == "integer" and set(inferred[t, p][1] for t, p in inferred) <= {True, False}


def test_near_copies_of_the_pipeline(spark, tmp_path):
    """Planted copies of Jaccard 0.8 to 1 all leave; a chain joins; pairs under 0.8 stay."""
    import corpus_pipeline

    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    sets = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    texts = {}
    for i in range(60):
        texts[i] = words(rng.randrange(60, 400))
        near = list(texts[i])
        for _ in range(rng.randrange(0, 12)):
            near[rng.randrange(len(near))] = "changed"
        texts[1000 + i] = near
    for i in range(40):  # one large group: each member near its neighbours only
        texts[2000 + i] = texts[2000 + i - 1][8:] + words(8) if i else words(200)
    texts |= {3000: ["a", "b"], 3001: ["A", "b"], 3002: ["a", "c"], 3003: [], 3004: []}
    ids = sorted(texts)
    own = {i: sets([w.lower() for w in texts[i]]) for i in ids}
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    df = table(spark, tmp_path, [(i, " ".join(t), "en", "s", 1) for i, t in texts.items()], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_copies(df).collect()}
    assert got == {i: find(i) for i in ids}
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_first(spark, df, SF).collect()) == sorted({find(i) for i in ids})
    assert minhash.near_copies(df.limit(0)).count() == 0
    odd = odd_docs(spark, tmp_path)[1]
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_copies(odd).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 5), (8, 8), (9, 9)}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= seen.count()
        seen = out
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == seen.count()
    assert corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_oracles(spark):
    import glob
    import os

    import duckdb

    from windrow.llm import queries

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, SF)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        order = sorted(got.columns)
        assert sorted(map(tuple, got.select(*order).collect()), key=str) == sorted(con.sql(f"SELECT {', '.join(order)} FROM ({sql})").fetchall(), key=str)
    assert {f.name for f in queries.QUERIES["op10_chat"](spark, SF).schema} and F


def test_chained_links_keep_both_sides():
    from windrow.llm import passages

    rng = np.random.default_rng(3)
    rows = []
    for doc, other in ((5, 1), (5, 2), (9, 1)):
        for shift in (-40, 0, 7, 300):
            start = rng.integers(400, 900, 60)
            drift = rng.integers(0, 5, 60)
            rows.append(np.stack([np.full(60, doc), start, start + rng.integers(45, 95, 60), np.full(60, other), start + shift + drift, start + shift + drift + rng.integers(45, 95, 60)]))
    links = np.hstack(rows).astype(np.int64)
    out = passages._chained(links)
    assert out.shape[1] < links.shape[1] / 4

    def held(x, side):
        return {(d, o, w) for d, s, e, o, t, u in x.T.tolist() for w in range(*((s, e) if side else (t, u)))}

    assert held(out, True) == held(links, True) and held(out, False) == held(links, False)
    assert passages._chained(links[:, :0]).shape == (6, 0)
