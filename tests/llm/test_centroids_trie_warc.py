"""Centroids, prefix tries and archives against plain Python, and on awkward tables."""

import base64
import hashlib
import random
import uuid
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard

from windrow.llm import centroids, trie, warc
from windrow.llm.textkit import shared_folder

SF = "/root/testdata/sf0.001"


def table(spark, tmp_path, rows, schema):
    path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


# 11: centroids


def plain_clusters(vectors, k, rounds):
    """vectors: (vec_id, integers). Assignments by Python's integers alone."""
    name = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centres = [v for _, v in sorted(vectors, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in vectors:
            held[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(held[i]) for x in zip(*held[i], strict=True)] if held[i] else c for i, c in enumerate(centres)]
    found = [(i, *nearest(v)[::-1]) for i, v in vectors]
    inertia = defaultdict(int)
    for _, c, d in found:
        inertia[c] += d
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashes[c]) for i, c, d in found), key=str)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("case", ["ties", "clusters", "large", "few"])
def test_clusters_match_plain_python(spark, tmp_path, case):
    rng = random.Random(7)
    if case == "ties":  # a small grid: many equal distances, equal vectors and repeated ids
        vectors = [(i % 90, [rng.randrange(-1, 2) for _ in range(4)]) for i in range(120)] + [(None, [0, 0, 0, 1])]
    elif case == "clusters":
        vectors = [(i, [rng.gauss(100 * (i % 9), 9) // 1 for _ in range(4)]) for i in range(300)]
    elif case == "large":  # squares of differences beyond 2^53
        vectors = [(i, [rng.randrange(-(1 << 29), 1 << 29) for _ in range(4)]) for i in range(80)]
    else:
        vectors = [(5, [1, 2, 3, 4]), (3, [1, 2, 3, 5])]
    vectors = [(i, [int(x) for x in v]) for i, v in vectors]
    df = table(spark, tmp_path, vectors, "vec_id long, v array<long>")
    got = centroids.cluster_vectors(df, k=12, rounds=4, dim=4)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == plain_clusters(vectors, 12, 4)


def test_bounds_skip_distances_and_stay_bounds(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = (rng.integers(-2000, 2000, (16, 8))[rng.integers(0, 16, 2000)] + rng.integers(-20, 20, (2000, 8))).astype(np.int64)
    df = table(spark, tmp_path, list(enumerate(vectors.tolist())), "vec_id long, v array<long>")
    computed = centroids.cluster_vectors(df, k=16, rounds=5, dim=8).agg({"computed": "sum"}).first()[0]
    assert computed < 0.35 * 2000 * 16 * 6
    centres = vectors[:16]
    cluster, upper, lower = np.zeros(2000, np.int32), np.full(2000, np.inf, np.float32), np.zeros((2000, 16), np.float32)
    own, _ = centroids.assign(vectors, centres, cluster, upper, lower, True)
    true = ((vectors[:, None, :] - centres[None]) ** 2).sum(2)
    assert (own == true.min(1)).all() and (cluster == true.argmin(1)).all()
    assert (lower.astype(float) ** 2 <= true).all() and (upper.astype(float) ** 2 >= own).all()


def test_vectors_that_take_part(spark, tmp_path):
    good = [0.5] * 64
    rows = [(1, good), (2, None), (3, []), (4, good[:-1]), (5, [*good, 1.0]), (6, [None, *good[1:]]), (7, [float("nan"), *good[1:]]), (8, [float("inf"), *good[1:]]), (9, [-0.001, *good[1:]]), (1, good)]
    df = table(spark, tmp_path, [(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v int")
    whole = centroids.whole_vectors(df)
    got = sorted((r["vec_id"], r["v"][0], r["v"][1]) for r in whole.collect())
    assert got == [(1, 128, 128), (1, 128, 128), (9, -1, 128)]
    found = centroids.cluster_vectors(whole)
    assert sorted((r["vec_id"], r["distance"]) for r in found.collect()) == [(1, 0), (1, 0), (9, 0)]
    assert centroids.cluster_vectors(whole.limit(0)).collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(centroids.whole_vectors(table(spark, tmp_path, [(1, [1e30] * 64)], "vec_id long, embedding array<double>"))).collect()


# 12: prefix trie


def plain_trie(rows, bundle=100, most=6):
    """rows: (conv_id, turn, role, text). A dict of tuples, and recursion replaced by sums over all pairs of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, len(role or ""), (role or "")[:64], hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[-2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        donor = c - int(np.fmod(c, bundle))
        built[c] = tuple(own.get(donor, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        ends[built[c]].append(c)
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    hashed = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p] if p in children else 0, leaves[p], saved[p], hashed(p)) for p, m in members.items()), key=str)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(df):
    return sorted((tuple(r[c] for c in NODE) for r in trie.prefix_trie(df).collect()), key=str)


def random_talks(rng):
    rows = []
    for c in range(-130, 260, 3):
        for turn in range(rng.choice([0, 1, 2, 5, 9, 17])):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else ("user", "assistant")[turn % 2], rng.choice("ab") if turn % 4 == 3 else f"say {turn % 5} é"))
    rows += [(1000, t, "user", "same") for t in range(70)] + [(1001, t, "user", "same") for t in range(41)]
    return rows


def test_trie_matches_plain_python(spark, tmp_path, monkeypatch):
    rows = random_talks(random.Random(5))
    # awkward: null turns, roles, texts and ids, repeated rows and turns, an empty and a very long text
    rows += [(7, None, None, None), (7, None, None, "x"), (8, 1, "user", ""), (8, 1, "user", ""), (8, 1, "user", "y"), (None, 1, "user", "z"), (9, 2, None, "w" * 100_000), (9, 1, "tool", "日本 \U0001f600")]
    monkeypatch.setattr(trie, "BLOCK", 3)
    got = nodes_of(table(spark, tmp_path, [(*r, 1, "q") for r in rows], "conv_id long, turn long, role string, text string, depth int, name string"))
    assert got == plain_trie(rows)


def test_many_equal_rows_and_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 5)
    rows = [(500, 1, "user", "again")] * 37 + [(c, t, "user", f"{t}") for c in range(100, 160) for t in range(6, 9)]
    assert nodes_of(table(spark, tmp_path, rows, "conv_id long, turn long, role string, text string")) == plain_trie(rows)


def test_trie_of_nothing(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    assert nodes_of(table(spark, tmp_path, [], schema)) == []
    assert nodes_of(table(spark, tmp_path, [(None, 1, "user", "x")], schema)) == []
    # 3 has fewer turns than its opening and no donor: only the root
    c = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 6 > 1)
    assert nodes_of(table(spark, tmp_path, [(c, 0, "user", "x")], schema)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


# 13: archives


def plain_records(rows, least=0):
    """rows: (page_id, url, html) -> sorted (page_id, bytes, digest, type, refers_to)."""
    groups = defaultdict(list)
    for i, (page, url, page_html) in enumerate(rows):
        groups[(page_html or "").encode() if len((page_html or "").encode()) >= least else i].append((page is not None, page or 0, url is not None, url or "", i))
    out = []
    for held in groups.values():
        top = max(held)[-1]
        for *_, i in held:
            page, _, page_html = rows[i]
            payload = (page_html or "").encode()
            out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if i == top else "revisit", None if i == top else rows[top][0]))
    return sorted(out, key=str)


def odd_pages():
    rng = random.Random(11)
    words = ["<div class='x'>", "</div>", "<p>", "</p>", "some", "text", "é", "日本"]
    rows = [(i, f"http://a.example/{i % 7}?q=a b", "".join(rng.choice(words) for _ in range(rng.randrange(400)))) for i in range(300)]
    rows += [(1000 + i, None, "<html>one copy of many</html>") for i in range(120)] + [(2000, "", None), (2001, "http://b\r\nX: y/\t", ""), (2002, None, ""), (None, None, "no id"), (None, "u", "no id"), (3000, "u", "\r\n\r\n" * 9)]
    rows += [(4000, "same", "row")] * 23 + [(4000, "other", "row")] + [(1, "long", "lorem ipsum " * 200_000)]
    return rows


@pytest.mark.parametrize("least", [0, 25])
def test_archives_round_trip(spark, tmp_path, least):
    rows = odd_pages()
    pages = table(spark, tmp_path, [(*r, 1, "q") for r in rows], "page_id long, url string, html string, kind int, payload string")
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    warc.write_archives(pages, folder, least, size=50_000)
    records = warc.resolved(warc.read_archives(spark.read.parquet(folder)))
    got = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == plain_records(rows, least)
    kept = warc.read_archives(spark.read.parquet(folder), payloads=True)
    payloads = {bytes(r["payload"]) for r in kept.where("record_type = 'response'").collect()}
    assert payloads == {(r[2] or "").encode() for r in rows}
    assert kept.select("record").distinct().count() == len(rows)
    assert {r["url"] for r in kept.where("page_id = 2001").collect()} == {"http://b%0D%0AX:%20y/%09"}


def test_archive_files_are_plain_zstandard(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    warc.write_archives(pages, folder, size=400_000)
    files = warc.export(spark.read.parquet(folder), f"file://{tmp_path}/files").collect()
    assert files and sum(r["records"] for r in spark.read.parquet(folder).collect()) == pages.count()
    for r in files:
        content = (tmp_path / "files" / r["name"]).read_bytes()
        assert len(content) == r["bytes"]
        magic, size = int.from_bytes(content[:4], "little"), int.from_bytes(content[4:8], "little")
        assert magic == 0x184D2A5D  # the dictionary comes first
        raw = content[8 : 8 + size]
        raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == b"\x28\xb5\x2f\xfd" else raw
        words = zstandard.ZstdCompressionDict(raw)
        assert raw[:4] == b"\x37\xa4\x30\xec" and words.dict_id()
        # the library's own reader of frames agrees with ours, one record a frame
        plain, rest = [], content[8 + size :]
        while rest:
            one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
            plain.append(one.decompress(rest))
            rest = one.unused_data
        assert all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in plain)
        assert len(plain) == len(list(warc.read_records(content)))
        assert b"warcinfo" in plain[0]


def test_dictionaries_help_and_bad_archives_are_errors(spark):
    records = [f"<html><head><title>{i}</title></head><body class='page layout-{i % 3}'>{'words and words ' * (i % 9)}</body></html>".encode() for i in range(400)]
    content = warc.archive_bytes(records)
    bare = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    assert len(content) < 0.8 * bare
    assert warc.dictionary_of(records[:3]) is None and list(warc.frames(warc.archive_bytes([b"x"])))[0][0] == warc.FRAME
    with pytest.raises(ValueError):
        list(warc.frames(content[:-1]))
    with pytest.raises(ValueError):
        list(warc.frames(b"junk" + content))


def test_archives_of_nothing(spark, tmp_path):
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    warc.write_archives(table(spark, tmp_path, [], "page_id long, url string, html string"), folder)
    assert warc.resolved(warc.read_archives(spark.read.parquet(folder))).collect() == []
