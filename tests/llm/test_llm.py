"""The ten operators against brute force, exact round trips and held-out accuracy, and on awkward tables: nulls, empty and very
long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import collections
import hashlib
import html
import random
import re
import textwrap
import tracemalloc
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import covertree, dartminhash, decontam, licences, mixing, quality, sharding, tokens, warc, wrappers
from helixframe.llm.common import components, fresh_path, ranked, token_hashes, windows
from helixframe.llm.queries import ORACLES, QUERIES

CLASH = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n int, h long, rank long, size long, copies int, shard int, kept boolean, _id long"


def docs(spark, rows):
    """Documents with extra columns whose names operators might use themselves."""
    full = [(i, t, "en", s, len(t) if t else None, 7, "k", 1, 2, 3, 4, 5, 6, True, 8) for i, t, s in rows]
    return spark.createDataFrame(full, CLASH)


def words_of(text):
    return re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", text.lower())


def grouped(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ---- shared pieces ------------------------------------------------------------------------------------------------------


def test_token_hashes_follow_the_words():
    texts = ["Hello World hello", "", None, "élan, Élan  x", "a_b 1!", "x" * 100_000 + " y", "z"]
    h, at = token_hashes(pa.array(texts))
    assert np.diff(at).tolist() == [len(words_of(t or "")) for t in texts]
    assert h[0] == h[2] and h[3] == h[4] and h[0] != h[1]
    alone = [token_hashes(pa.array([t]))[0].tolist() for t in texts if t]
    assert sum(alone, []) == h.tolist()  # the same whatever stands beside it
    sliced = pa.array(["junk", *texts]).slice(1)
    assert token_hashes(sliced)[0].tolist() == h.tolist()
    w, w_at = windows(h, at, 3)
    assert np.diff(w_at).tolist() == [max(len(words_of(t or "")) - 2, min(len(words_of(t or "")), 1)) for t in texts]


def test_ranked_and_components(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), i) for i in range(500)]
    got = ranked(spark.createDataFrame(rows, "g string, v int, i long").repartition(7), ["g"], ["v", "i"]).collect()
    for g in ("a", "b", None):
        mine = sorted((r.v, r.i, r["rank"]) for r in got if r.g == g)
        assert [m[2] for m in mine] == list(range(len(mine)))
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(50)]
    want = grouped(edges, {x for e in edges for x in e})
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1: decontamination ---------------------------------------------------------------------------------------------------


def brute_tiles(a, b, m):
    """Greedy string tiling as published: all maximal matches, longest first."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best, found = m, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        done = False
        for i, j in found:
            if not any(ma[i : i + best]) and not any(mb[j : j + best]):
                ma[i : i + best] = mb[j : j + best] = [True] * best
                out.append((i, j, best))
                done = True
        if not done:
            return out


def test_tiles_equal_the_published_algorithm():
    rng = random.Random(3)
    for _ in range(60):
        item = [rng.choice("abcdefgh") for _ in range(rng.randrange(3, 25))]
        parts = [item[:8], item[12:], item[8:12], [rng.choice("abcdefgh") for _ in range(10)]]
        rng.shuffle(parts)
        doc = sum(parts, [])
        block = decontam.Block([1], [" ".join(item)], 3)
        got = list(block.matches(*token_hashes(pa.array([" ".join(doc)])), 0.01))
        want = brute_tiles(doc, item, 3)
        assert sorted(got[0][3] if got else []) == sorted(want)


def test_tiles_of_repetitive_texts():
    rng = random.Random(8)
    for n, k, letters in [(30, 12, "ab"), (40, 25, "a"), (35, 30, "aab"), (50, 20, "abc")] * 12:
        doc, item = [rng.choice(letters) for _ in range(rng.randrange(3, n))], [rng.choice(letters) for _ in range(rng.randrange(3, k))]
        got = list(decontam.Block([1], [" ".join(item)], 3).matches(*token_hashes(pa.array([" ".join(doc)])), 0.01))
        assert sorted(got[0][3] if got else []) == sorted(brute_tiles(doc, item, 3)), (doc, item)


def test_tiling_needs_no_memory_for_repetition():
    block = decontam.Block([1, 2], ["pad " * 1000, "pad word " * 300], 4)
    h, at = token_hashes(pa.array(["pad " * 20_000, "pad word " * 10_000]))
    tracemalloc.start()
    got = [(row, item, round(share, 3)) for row, item, share, _ in block.matches(h, at, 0.5)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 1, 1.0), (1, 2, 1.0)] and peak < 100_000_000, (got, peak)


def test_short_items_match_whole_texts_only(spark):
    bench = spark.createDataFrame([(1, "yes"), (2, "to be or"), (3, "")], "item_id long, text string")
    rows = [(1, "Yes.", "s"), (2, "yes it is", "s"), (3, "to be, or", "s"), (4, "to be or not to be", "s"), (5, "...", "s")]
    got = {r.doc_id: r.item_ids for r in decontam.decontaminate(docs(spark, rows), bench).collect()}
    assert got == {1: [1], 2: [], 3: [2], 4: [], 5: []}


def test_decontamination_finds_reordered_passages(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    w = item.split()
    rows = [(1, "x y z " + item.upper() + " q", "s"), (2, " ".join(w[6:] + ["gap"] + w[:6]), "s"), (3, " ".join(w[:5]), "s"), (4, None, "s"), (5, "", "s"), (6, "clean text of other words entirely", "s"), (7, "pad " * 50_000 + item, "s"), (1, "x y z " + item.upper() + " q", "s"), (None, item, None)]
    bench = spark.createDataFrame([(9, item, 1), (9, item, 2), (10, "too short", 3), (None, item, 4), (11, None, 5), (12, "", 6)], "item_id long, text string, doc_id int")
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontam.decontaminate(docs(spark, rows), bench).collect()}
    assert got == {1: (True, [9]), 2: (True, [9]), 3: (False, []), 4: (False, []), 5: (False, []), 6: (False, []), 7: (True, [9]), None: (True, [9])}
    assert sorted(r.doc_id for r in decontam.clean_documents(docs(spark, rows), bench).collect()) == [3, 4, 5, 6]
    assert decontam.decontaminate(docs(spark, []), bench).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminate(docs(spark, rows), bench.where("item_id < 0")).collect())


def test_decontamination_in_blocks(spark, sf, monkeypatch):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted((r.doc_id, r.item_ids) for r in df.collect())
    one = key(decontam.decontaminate(d, b))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    assert key(decontam.decontaminate(d, b)) == one and any(x[1] for x in one)


# ---- 2: vectors -----------------------------------------------------------------------------------------------------------


def test_cover_tree_links_are_exact():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base, base[:20] + rng.normal(scale=0.15, size=(20, 8)), np.repeat(base[:1], 30, 0) + rng.normal(scale=0.01, size=(30, 8)), base[:2] * 3])
    x /= np.sqrt((x * x).sum(1))[:, None]
    w = rng.integers(1, 4, len(x)).astype(float)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    tree = covertree.CoverTree(x)
    for node, kids in enumerate(tree.children):  # nested, covering
        assert not kids or tree.centre[kids[0]] == tree.centre[node]
        assert np.linalg.norm(x[tree.members(node)] - x[tree.centre[node]], axis=1).max() <= tree.radius[node] + 1e-12
    n, _, joins = covertree.dual_links(tree, tree, 0.93, w, w)
    assert n.tolist() == (near * w[None, :]).sum(1).tolist()
    want = grouped(list(zip(*np.nonzero(near))), range(len(x)))
    assert grouped(joins, range(len(x))) == want
    a, b = covertree.CoverTree(x[:50]), covertree.CoverTree(x[50:])
    na, nb, _ = covertree.dual_links(a, b, 0.93, w[:50], w[50:])
    assert na.tolist() == (near[:50, 50:] * w[None, 50:]).sum(1).tolist() and nb.tolist() == (near[:50, 50:] * w[:50, None]).sum(0).tolist()


def test_near_vectors_awkward_rows(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.01], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [None, 1.0], 0), (10, [], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1.0, 0.0], 0), (13, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (12, [1.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep long, kind string")
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(df).collect())
    want = [(1, 3, 1, True), (2, 3, 1, False), (12, 3, 1, False), (12, 3, 1, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 13)] + [(None, 0, None, True)]
    assert got == collections.Counter(want)
    assert covertree.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 16)
    monkeypatch.setattr(covertree, "PIVOTS", 3)
    monkeypatch.setattr(covertree, "LEAF", 4)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 6))
    x = np.concatenate([centres, centres[:15] + rng.normal(scale=0.2, size=(15, 6)), centres[0] + rng.normal(scale=0.02, size=(40, 6))])
    df = spark.createDataFrame([(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None, :] % 2)
    np.fill_diagonal(near, False)
    want = grouped(list(zip(*np.nonzero(near))), range(len(x)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_vectors(df).collect()}
    assert got == {i: (int(near[i].sum()), want[i]) for i in range(len(x))}


def test_near_vectors_of_extreme_sizes_and_odd_labels(spark):
    rows = [
        (1, [1e-200, 1e-200], "x"), (2, [1.0, 1.0], "x"), (3, [1e200, 1e200], "x"), (4, [5e-324, 0.0], "x"), (5, [1e308, 0.0], "x"),
        (10, [1.0, 2.0], "a"), (11, [2.0], "a,1.0"), (12, [2.0], "a|1"), (13, [4.0], "a|1"),
        (20, [93.0, 36.0, 7.0, 2.0, 1.0, 1.0], "y"), (21, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], "y"),  # a cosine of 0.93 as exactly as can be
        (30, [1.0, 1.0], "z"), (31, [3.0, 3.0], ""), (32, [1.0, 0.0], ""),
    ]
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    want = {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 10: (0, 10), 11: (0, 11), 12: (1, 12), 13: (1, 12), 20: (1, 20), 21: (1, 20), 30: (0, 30), 31: (0, 31), 32: (0, 32)}
    assert got == want
    with pytest.raises(ValueError):
        covertree.CoverTree(np.array([[np.nan, 1.0]]))
    # an id on two different vectors doesn't tie their groups together
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.001, 1.0], 0)]
    got = collections.Counter((r.vec_id, r.n_links, r.component_id) for r in covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == collections.Counter([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)])


def test_cells_send_a_vector_only_where_links_may_be(spark, monkeypatch):
    """Vectors in tight groups: cells are pruned, and the number of blocks that a vector is sent to doesn't grow with the table."""
    monkeypatch.setattr(covertree, "BLOCK", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    sent = []
    for n in (400, 2000):
        x = centres[np.arange(n) % 40] + rng.normal(scale=0.05, size=(n, 16))
        reps = spark.createDataFrame([(i, "a", 16, v.tolist()) for i, v in enumerate(x)], "num long, label string, dim int, v array<double>")
        dealt = covertree._deal(reps, float(np.sqrt(0.14)))
        sent.append(dealt.count() / n)
        assert dealt.select("num").distinct().count() == n
    assert sent[1] <= 1.5 * sent[0] and sent[1] < 5, sent


# ---- 3: archives ------------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    big = "<p>" + "ä" * 800 + "</p>"
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "<i>\r\n\r\n</i>"), (6, "u", big), (None, "u", big), (7, "u", "z" * 300_000), (6, "u", big), (8, "u", "s" * 999), (9, "u", "s" * 999)]
    rows += [(100 + i, f"http://h/{i}", f"<html><body><p>page {i} " + "common words of all pages " * (i % 40) + "</p></body></html>") for i in range(400)]
    df = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    manifest = warc.write_archives(df, fresh_path(spark, "test"))
    assert sum(r.n_records for r in manifest.collect()) == len(rows)
    got = warc.read_archives(manifest, with_payload=True).collect()
    want = collections.Counter((i, hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode())) for i, _, h in rows)
    assert collections.Counter((r.page_id, r.payload_digest, r.payload_bytes) for r in got) == want
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[6] == ("response", None) and kinds[1] == kinds[2] == kinds[None] == ("revisit", 6) and kinds[8] == kinds[9] == ("response", None)
    texts = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response")
    path = manifest.first().path.removeprefix("file://")
    assert open(path, "rb").read(4) == b"\x5d\x2a\x4d\x18"  # the dictionary's skippable frame leads
    assert warc.read_archives(warc.write_archives(df.limit(0), fresh_path(spark, "test"))).count() == 0


def test_every_archive_has_a_dictionary(spark, tmp_path):
    for n in (1, 2, 4, 9, 40):
        w = warc.ArchiveWriter(f"file://{tmp_path}/{n}.warc.zst")
        rows = [warc.record(i, f"http://h/{i}", b"<p>%d</p>" % i * i, hashlib.sha1(b"<p>%d</p>" % i * i).hexdigest(), None) for i in range(n)]
        for r in rows:
            w.add(r)
        w.close()
        assert open(tmp_path / f"{n}.warc.zst", "rb").read(4) == b"\x5d\x2a\x4d\x18"
        assert list(warc.read_records(f"file://{tmp_path}/{n}.warc.zst")) == rows
    df = spark.createDataFrame([(1, "http://h/1", "x" * 2000), (2, "http://h/2", "x" * 2000)], "page_id long, url string, html string").repartition(1)
    path = warc.write_archives(df, fresh_path(spark, "test")).first().path
    text = b"".join(warc.read_records(path)).decode()
    assert "WARC-Refers-To-Target-URI: http://h/2" in text and text.count("WARC-Type: revisit") == 1


def test_a_broken_archive_is_noticed(tmp_path):
    w = warc.ArchiveWriter(f"file://{tmp_path}/a.warc.zst")
    for i in range(50):
        w.add(warc.record(i, "u", b"x" * i, hashlib.sha1(b"x" * i).hexdigest(), None))
    w.close()
    data = (tmp_path / "a.warc.zst").read_bytes()
    (tmp_path / "b").write_bytes(data[:-3])
    with pytest.raises(Exception):
        list(warc.read_records(f"file://{tmp_path}/b"))
    assert len(list(warc.read_records(f"file://{tmp_path}/a.warc.zst"))) == 50


# ---- 4 and 5: mixing and sharding ---------------------------------------------------------------------------------------------


def test_mix_follows_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", "c", None])) for i in range(600)] + [(900, None, "a"), (901, "", "z"), (902, "\x0b \t", "z"), (903, "w " * 30_000, "b")]
    d = docs(spark, rows)
    got = mixing.mix(d, [5.0, 2.0, 1.0]).collect()
    assert len(got) == len(rows) and all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 2 for r in got)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    per = {}
    for r in got:
        per.setdefault(r.source, [r.source_size, r.target, 0, 0])[2] += r.taken
        per[r.source][3] = max(per[r.source][3], r["size"])
    assert sum(p[1] for p in per.values()) == pytest.approx(1.5 * total) and all(p[1] <= 2 * p[0] + 1e-9 for p in per.values())
    assert all(abs(p[2] - p[1]) <= 2 * p[3] + 1 for p in per.values())
    again = {r.doc_id: r.copies for r in mixing.mix(d.repartition(5), [5.0, 2.0, 1.0]).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    mixed = mixing.apply_mix(d, mixing.mix(d, [5.0, 2.0, 1.0]))
    assert mixed.columns == d.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(d.limit(0), [5.0]).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(d.where("doc_id in (900, 901)"), [5.0]).collect())


def test_shards_move_only_to_the_new_one(spark):
    rows = [(i, "t" * (i % 7), "s") for i in range(3000)] + [(5, "other", "s"), (None, None, None), (None, "x", None)]
    got = sharding.shard_documents(docs(spark, rows), [1.0] * 24).collect()
    assert len(got) == len(rows) and all(r.grown_shard in (r.shard, 24) for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r["size"] >= 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(24))
    assert 60 < sum(r.grown_shard == 24 for r in got) < 190
    crc = {r.doc_id: r.text_crc32 for r in got if r.doc_id not in (5, None)}
    assert crc[13] == zlib.crc32(b"tttttt")
    heavy = collections.Counter(r.shard for r in sharding.shard_documents(docs(spark, rows), [3.0, 1.0]).collect())
    assert 2.5 < heavy[0] / heavy[1] < 3.6
    assert sharding.shard_documents(docs(spark, []), [1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [1.0, 0.0])


# ---- 6: tokens -------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def piece():
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    f = public.path("piece_bpe_32k.model")
    return f, sentencepiece.SentencePieceProcessor(model_file=f)


def test_token_counts_equal_the_library(piece):
    rng = random.Random(1)
    al = ["a", "b", "th", "e", " ", "  ", "▁", "\n", "\t", "é", "ﬁ", "中", "文", "😀", "0", "=", "-", "​", "<s>", "<0x0A>", "\x00", "   ", "in", "g", "ing", "The", "\r\n"]
    texts = ["".join(rng.choice(al) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["=" * 3000, "ab" * 2000, " " * 777, "▁" * 33, "-=" * 700, "中文" * 600, "", " ", "\n", "".join(rng.choice("abcdefghij") for _ in range(4000))]
    want = [len(x) for x in piece[1].encode(texts)]
    assert tokens.BpeCounter(piece[0]).count_all(texts) == want


def test_long_pre_tokens_equal_the_library(piece):
    rng = random.Random(2)
    bpe = tokens.BpeCounter(piece[0])
    kinds = ["abcdefghij", "=-", "ab", "aab", ["th", "e", "in", "g", "ing", "a"], "中文字符的一是不了人", "ABCabc0123456789+/", ["a", "b", "é", "😀"]]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(1, 700))) for _ in range(60)]
    texts += ["".join(rng.choice(k) for _ in range(rng.randrange(1, 700))) for k in kinds for _ in range(20)]
    texts.append("".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(200_000)))
    assert [bpe.merge_long("▁" + t) for t in texts] == [len(x) for x in piece[1].encode(texts)]


def test_a_model_of_another_kind_is_refused(piece):
    class Normalises:
        def encode(self, text):
            return piece[1].encode(unicodedata.normalize("NFKC", text))

    with pytest.raises(ValueError):
        tokens.BpeCounter(piece[0])._check(Normalises())


def test_token_counts_of_tables(spark, sf, piece):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(d, piece[0]).collect()}
    for r in d.collect():
        n = len(piece[1].encode(r.text))
        assert got[r.doc_id] == (len(r.text.encode()), n, n > 4096)
    odd = docs(spark, [(1, None, "s"), (2, "", "s"), (3, "a b", "s"), (3, "a b", "s"), (4, "wörd " * 60_000, None)])
    got = collections.Counter((r.doc_id, r.n_tokens) for r in tokens.count_tokens(odd, piece[0]).collect())
    assert got == collections.Counter({(1, 0): 1, (2, 0): 1, (3, 2): 2, (4, len(piece[1].encode("wörd " * 60_000))): 1})
    assert tokens.count_tokens(odd.limit(0), piece[0]).count() == 0


# ---- 7: pages --------------------------------------------------------------------------------------------------------------------


def test_wrapper_finds_groups_and_options():
    page = lambda items, extra: wrappers.expression(wrappers.parse("<body><ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" + extra + "<div>fix</div></body>"))
    w = wrappers.combine([page("ab", "<p>one</p>"), page("abc", "")])
    body = w[0][5]
    assert [x[0] for x in body] == ["ul", "p", "div()"] and "?" in body[1][1] and "+" in body[0][5][0][1]
    assert "=" in body[2][5][0][1] and body[2][5][0][5] == wrappers._crc("fix") and "=" not in body[0][5][0][5][0][1]


def brute_article(page):
    """The article by a plain parser."""
    a = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", a)]
    return "\n".join(b for b in blocks if b)


def test_pages_against_a_plain_parser(spark, sf):
    d = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: brute_article(r.html) for r in d.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.extract_text(d).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


HEAD = "<html><head><title>t</title></head><body><div class='top-menu'><a href=x>Home</a> <a>News</a></div><aside>side</aside><div id=cookie-notice>We use cookies</div>"
TAIL = "<section class=comments><p>Nice post!</p></section><form>Mail <input><button>Go</button></form><div class='ad'>Buy</div><footer>(c)</footer></body></html>"


def test_pages_of_other_shapes(spark):
    rows = [
        (1, "http://a.b/1", HEAD + "<article><h1>T &amp; x</h1><p>One\n two&nbsp;<b>bo</b>ld<p>Three<script>var a='<p>no</p>'</script><ul><li>i<li>j</ul></article>" + TAIL, "T & x\nOne two bold\nThree\ni\nj"),
        (2, "http://a.b/2", HEAD + "<main><div><p>only</p></div><!-- <p>no</p> --><style>p{}</style></main>" + TAIL, "only"),
        (3, None, "<p>loose<div>text</div>tail", "loose\ntext\ntail"),
        (4, "not a url", None, ""),
        (5, "http://c/", "", ""),
        (6, "http://c/", "<html><body>", ""),
        (7, "http://c/", "<article><p>cut off &am", "cut off &am"),
        (8, "http://c/", "<article><p>a</p><foot", "a"),
        (9, "http://c/", "<article>" + "<div>" * 3000 + "deep", "deep"),
        (9, "http://c/", "plain text without markup &lt;3", "plain text without markup <3"),
        (10, "http://d/", "<article><p>x <a href=\"a>b\">link</a> y</article>", "x link y"),
        (11, "http://d/", "<article><table><tr><td>1<td>2</table><p hidden>h</p></article>", "1\n2"),
    ]
    df = spark.createDataFrame([(i, u, h, 1, "t") for i, u, h, _ in rows], "page_id long, url string, html string, host int, text string")
    got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in wrappers.extract_text(df).collect())
    assert got == collections.Counter((i, u, t, len(t)) for i, u, _, t in rows)
    assert wrappers.extract_text(df.limit(0)).count() == 0


def test_pages_without_names_use_the_wrapper(spark):
    """No telling names: what all pages of a host share and what is little but links goes."""
    page = lambda i: f"<body><div><a>Home {i}</a><a>All</a></div><div>Share this with friends</div><div><p>{'story %d ' % i * 30}</p><p>{'more %d ' % i * 20}</p></div></body>"
    df = spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(8)], "page_id long, url string, html string")
    for r in wrappers.extract_text(df).collect():
        assert r.text == ("story %d " % r.page_id * 30).strip() + "\n" + ("more %d " % r.page_id * 20).strip()


def test_constant_places_go_by_themselves(spark):
    """A constant paragraph takes no other of its kind with it, and copies of a page are no evidence."""
    post = lambda i: f"<body><div>Menu of this site</div><div class=post><p>Our daily column</p><h2>Day {i}</h2><p>{'long text %d ' % i * 20}</p></div></body>"
    rows = [(i, f"http://a/{i}", post(i)) for i in range(5)] + [(10 + i, f"http://b/{i}", "<body><h1>Title</h1><p>One short paragraph.</p></body>") for i in range(5)]
    got = {r.page_id: r.text for r in wrappers.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Our daily column\nDay {i}\n" + ("long text %d " % i * 20).strip() for i in range(5)} | {10 + i: "Title\nOne short paragraph." for i in range(5)}


def test_boilerplate_words_around_articles(spark):
    article = "<h1>Head</h1><p>The whole story of the day.</p>"
    pages = [
        f'<body class="has-sidebar"><article>{article}</article><div class=sidebar>Side</div></body>',
        f'<body><div class="layout with-sidebar"><article>{article}</article><div class=sidebar>Side</div></div></body>',
        f'<body><article class="post comments-open">{article}</article><section class=comments><article class=comment><p>Nice!</p></article></section></body>',
        f'<body><main class="with-sidebar">{article}<div class=sidebar>Side</div></main></body>',
        f'<body><div class="page with-sidebar">{article}<div class=sidebar>Side</div></div></body>',
    ]
    rows = [(i * 10 + k, f"http://h{i}-{n}/{k}", x) for i, x in enumerate(pages) for n in (1, 5) for k in range(n)]
    got = [(r.page_id, r.text) for r in wrappers.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == 30 and all(t == "Head\nThe whole story of the day." for _, t in got), got


def test_pages_joined_by_salt(spark, sf, monkeypatch):
    d = spark.read.parquet(f"{sf}/pages.parquet")
    key = lambda df: sorted((r.page_id, r.text) for r in df.collect())
    one = key(wrappers.extract_text(d))
    monkeypatch.setattr(wrappers, "HOSTS", 0)
    monkeypatch.setattr(wrappers, "HELD", 3)
    assert key(wrappers.extract_text(d.repartition(9))) == one


def extracted(spark, rows):
    return {r.page_id: r.text for r in wrappers.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("n", [1, 6])
def test_names_that_mislead(spark, n):
    """On a host of one page and on one of several: names inside an article take nothing from it that isn't boilerplate."""
    story = lambda i: f"<p>{'word%d ' % i * 30}</p>"
    pages = [
        (lambda i: f"<body><article><h1 class=header>Head {i}</h1><div class=legal><p>The law says {i}.</p></div><div class='social-science'>{story(i)}</div></article></body>", lambda i: f"Head {i}\nThe law says {i}.\n" + ("word%d " % i * 30).strip()),
        (lambda i: f"<body><div class=post>{story(i)}<p class='tags-of-war'>War {i}</p></div><div class=footer>x {i}</div></body>", lambda i: ("word%d " % i * 30).strip() + f"\nWar {i}"),
        (lambda i: f"<body><article><h2 class=menu>Menu of day {i}</h2>{story(i)}<div class=ad>Buy {i}</div><div class=comments><div class=comment>nice {i}</div><div class=comment>good {i}</div></div></article></body>", lambda i: f"Menu of day {i}\n" + ("word%d " % i * 30).strip()),
        (lambda i: f"<body><article><p>The sum is <math><mi>a</mi><mo>+</mo><mn>{i}</mn></math>.</p><object>plain {i}</object></article></body>", lambda i: f"The sum is a+{i}.\nplain {i}"),
        (lambda i: f"<body><article><p>One <span style='display: none'>secret</span><span class=ad>Buy</span> two {i}</p><p style='display:none'>no</p><p>three</p></article></body>", lambda i: f"One two {i}\nthree"),
    ]
    rows = [(100 * k + i, f"http://h{k}/{i}", page(i)) for k, (page, _) in enumerate(pages) for i in range(n)]
    got = extracted(spark, rows)
    assert got == {100 * k + i: want(i) for k, (_, want) in enumerate(pages) for i in range(n)}


def test_the_wrapper_decides_against_names(spark):
    """Teasers in article elements are little beside the story that no name tells of."""
    page = lambda i: f"<body><div><article><a href=x>See {i}</a></article><article><a href=y>And {i}</a></article></div><div id=x><p>{'story %d ' % i * 40}</p><p>{'more %d ' % i * 30}</p></div><div><p>{'The same legal words on all pages. ' * 20}</p></div></body>"
    got = extracted(spark, [(i, f"http://h/{i}", page(i)) for i in range(6)])
    assert got == {i: ("story %d " % i * 40).strip() + "\n" + ("more %d " % i * 30).strip() for i in range(6)}


def test_deep_pages(spark):
    """However deep, levels count: a menu below 205 or 5000 others is none of the article."""
    deep = lambda n, x: "<div>" * n + x + "</div>" * n
    article = "<article><h1>Head</h1><p>Text of the article.</p></article>"
    rows = [(n, f"http://h{n}/", "<body>" + deep(n, "<nav><ul><li>menu item</li></ul></nav>" + article + "<footer>end</footer>") + "</body>") for n in (1, 99, 101, 205, 500, 5000)]
    assert extracted(spark, rows) == {r[0]: "Head\nText of the article." for r in rows}
    rows = [(i, "http://deep/", "<body>" + deep(500, f"<p>{'tale %d ' % i * 20}</p>") + "<div>Always the same</div></body>") for i in range(5)]
    assert extracted(spark, rows) == {i: ("tale %d " % i * 20).strip() for i in range(5)}


def test_constant_texts_are_compared_whole():
    same = "We use all of these words on every page. " * 8
    page = lambda i: f"<body><div class=a>{same}</div><div class=b>{same}{i}</div><div><p>{'story %d ' % i * 90}</p></div></body>"
    rule = wrappers.rules(wrappers.combine([wrappers.expression(wrappers.parse(page(i))) for i in range(5)]), 5)
    body = wrappers._path(0, "body")
    assert rule["constant"] == [[wrappers._path(body, "div.a"), [wrappers._crc(same.strip())]]]


def test_runs_of_any_length_fold():
    run = "".join(f"<{t}>x</{t}>" for t in ("h2", "p", "ul", "h3", "pre", "blockquote", "h4"))
    e = wrappers.expression(wrappers.parse("<body>" + run * 5 + "</body>"))
    assert [x[0] for x in e[0][5]] == ["h2", "p", "ul", "h3", "pre", "blockquote", "h4"] and all("+" in x[1] for x in e[0][5])
    assert wrappers._matches(list("abcxde"), list("abyde")) == [(0, 0), (1, 1), (4, 3), (5, 4)]


def test_wrappers_do_not_depend_on_the_layout(spark, sf):
    rng = random.Random(3)
    block = lambda: rng.choice(["<p>a b c</p>", "<ul><li>x</li><li>y</li></ul>", "<div class=box><p>t</p></div>", "<h2>h</h2>", "<table><tr><td>1</td></tr></table>"])
    rows = [(i, f"http://h{i % 3}/", "<body><div>Top</div><div id=main>" + "".join(block() for _ in range(rng.randrange(1, 9))) + f"<p>{'text %d ' % i * rng.randrange(1, 30)}</p></div></body>") for i in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    key = lambda df: sorted((r.host, r.shape, r.numbers, r.kinds) for r in wrappers.infer_wrappers(df).collect())
    one = key(df.repartition(1))
    assert key(df.orderBy(F.desc("page_id")).repartition(7)) == one and key(df.repartition(4, "html")) == one and len(one) == 3


# ---- 8: licences ------------------------------------------------------------------------------------------------------------------


def test_licences(spark):
    plain = ["The river was low and the boats lay on the sand for most of the summer.", "All rights of way were closed by the council last year.", "She reserved a table and all the others came late."]
    known = {1: ("All rights reserved.", "Proprietary"), 2: ("released under the mit license", "MIT"), 3: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), 4: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), 5: ("   Licensed under the Apache License, Version 2.0!", "Apache-2.0")}
    rows = [(i, "\n".join([plain[i % 3], line, plain[0]]), "s") for i, (line, _) in known.items()]
    rows += [(10 + i, p, "s") for i, p in enumerate(plain)] + [(20, None, "s"), (21, "", "s"), (22, "\n\n", "s"), (23, "word " * 100_000 + "\nAll rights reserved.", "s"), (24, "All rights reserved.\nReleased under the MIT License.", "s"), (24, "other row", "s")]
    got = {(r.doc_id, r.n_paragraphs): (r.n_licences, r.families) for r in licences.scan_licences(docs(spark, rows)).collect()}
    for i, (_, family) in known.items():
        assert got[i, 3] == (1, family)
    assert all(got[k] == (0, "") for k in [(10, 1), (11, 1), (12, 1), (20, 0), (21, 0), (22, 3)])
    assert got[23, 2] == (1, "Proprietary") and got[24, 2] == (2, "MIT,Proprietary") == got[24, 1]
    assert licences.scan_licences(docs(spark, [])).count() == 0


def test_licences_broadcasts_in_small_pieces(spark, monkeypatch):
    """Each broadcast took a buffer of 4 MB in the driver, however small it was."""
    sc, jvm = spark.sparkContext._jsc, spark.sparkContext._jvm
    conf, key, seen, fit = sc.sc().env().conf(), "spark.broadcast.blockSize", [], licences.LogisticRegression.fit

    def pieces() -> int:
        b = sc.broadcast(bytearray(np.random.default_rng(1).bytes(1_000_000)))
        there = [sc.sc().env().blockManager().getStatus(jvm.org.apache.spark.storage.BroadcastBlockId(b.id(), f"piece{i}")).isDefined() for i in range(8)]
        b.destroy()
        return sum(there)

    monkeypatch.setattr(licences.LogisticRegression, "fit", lambda self, rows: seen.append(pieces()) or fit(self, rows))
    d = docs(spark, [(1, "Released under the MIT License.", "s"), (2, None, "s")])
    found = lambda: {r.doc_id: r.families for r in licences.scan_licences(d).collect()}
    try:
        conf.remove(key)
        assert found() == {1: "MIT", 2: ""} and seen == [4] * (licences.FOLDS + 2) and pieces() == 4
        conf.set(key, "1m")  # a number of the application's own stays
        seen.clear()
        assert found() == {1: "MIT", 2: ""} and set(seen) == {1} and conf.get(key) == "1m"
    finally:
        conf.remove(key)


def test_licences_in_documents(spark, sf):
    known = {"All rights reserved.": "Proprietary", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    d = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: ",".join(sorted({known[x] for x in r.text.split("\n") if x in known})) for r in d.collect()}
    assert {r.doc_id: r.families for r in licences.scan_licences(d).collect()} == want
    plan = licences.scan_licences(d)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


MIT_TEXT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
GPL_TEXT = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
ISC_TEXT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


def test_licences_wrapped_and_several_in_a_line(spark):
    wrap = lambda text, n: "\n".join(textwrap.fill(x, n) for x in text.split("\n"))
    prose = "The river was low and the boats lay on the sand for most of the summer.\n" * 3
    texts = [(MIT_TEXT, "MIT"), (BSD_TEXT, "BSD"), (GPL_TEXT.format(":", 3), "GPL-3.0"), (GPL_TEXT.format(";", 2), "GPL-2.0"), (ISC_TEXT, "ISC")]
    want = {(i, n): (prose + wrap(t, n) + "\n" + prose, f) for i, (t, f) in enumerate(texts) for n in (40, 72, 80)}
    lines = ["SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX-License-Identifier: Apache-2.0 OR MIT", "Licensed under the MIT license or the Apache License, Version 2.0.", "x " * 300 + "Licensed under the MIT license. " + "y " * 300 + "All rights reserved. " + "z " * 300]
    want |= {(9, i): (x, f) for i, (x, f) in enumerate(zip(lines, ["Apache-2.0,MIT"] * 3 + ["MIT,Proprietary"]))}
    want |= {(10, 0): ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), (10, 1): ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"), (10, 2): (prose, "")}
    keys = list(want)
    got = {keys[r.doc_id]: r.families for r in licences.scan_licences(docs(spark, [(i, want[k][0], "s") for i, k in enumerate(keys)])).collect()}
    assert got == {k: f for k, (_, f) in want.items()}


# the beginnings and notices of whole public licence files, as they stand there
WHOLE = {
    "MIT": MIT_TEXT + """

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD": """Copyright (c) 2015, The Authors

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

* Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "Apache-2.0": """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.""",
    "GPL-3.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.

  13. Use with the GNU Affero General Public License.

  Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU Affero General Public License into a single combined work, and to convey the resulting work.

    This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.""",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": GPL_TEXT.format(":", 3).replace("GNU General", "GNU Affero General"),
    "ISC": "Copyright (c) 2011, Some Body\n\n" + ISC_TEXT + """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
# none of these is among the sentences that the fit sees
NEWS = [
    "Copyright law was reformed last year, with all rights reserved to the states.", "The senator wants a licence for every drone above the city.", "Under the deal the band keeps all rights to its first three albums.",
    "He released a statement under the heading of public safety.", "The MIT lab asked for permission to use the copy of the map.", "Apache is the name of a people, a helicopter and a web server.",
    "A judge ruled that the GNU General Public License is a contract.", "Permission is needed to copy, modify or sell the recordings, the union said.", "The software is provided by the city to every school free of charge.",
    "She wrote a history of the BSD license and of the people behind it.", "The Mozilla Public License was discussed in version after version.", "Creative Commons attribution is often forgotten by newspapers.",
    "The following conditions must be met before the bridge opens.", "Version 3 of the general plan is licensed to nobody.", "The notice and the list of conditions were pinned to the wall.",
    "All seats are reserved, and all rights to refunds expire at noon.", "The public domain is where old films go when copyright ends.", "Distribution of the leaflet without prior permission of the mayor was fined.",
    "The Free Software Foundation celebrated with cake.", "The licensed dealer sold cars under the terms of the new law.",
]


def test_licences_of_whole_files_and_news(spark):
    wrap = lambda text, n: "\n".join(textwrap.fill(x, n) for x in text.split("\n"))
    forms = [(f, t) for f, text in WHOLE.items() for t in (text, wrap(text, 72), wrap(text, 40), text.replace("\n", " "), "\n".join("# " + x for x in wrap(text, 72).split("\n")))]
    texts = forms + [("", x) for x in NEWS] + [("", "\n".join(NEWS)), ("", " ".join(NEWS))]
    got = {r.doc_id: r.families for r in licences.scan_licences(docs(spark, [(i, t, "s") for i, (_, t) in enumerate(texts)])).collect()}
    assert [(got[i], f, t[:60]) for i, (f, t) in enumerate(texts) if got[i] != f] == []


def test_every_confirmed_text_has_an_anchor():
    known = licences.anchors(0.7)
    for _, t in licences.TEMPLATES:
        pairs = licences.plain_pairs(t)
        bare = [p for p in pairs if not any(a in w.split() for w in [p] for a in known)]
        assert len(bare) < 0.7 * len(pairs)


# ---- 9: quality -------------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["the", "re", "an", "on", "ti", "er"]) for _ in range(rng.randrange(1, 4)))
    good = lambda: " ".join(word() for _ in range(60)).capitalize() + "."
    bad = lambda: rng.choice([lambda: " | ".join(word() for _ in range(60)), lambda: " ".join(word().upper() + "!!" for _ in range(60)), lambda: " ".join([word()] * 60)])()
    made = [(i, bad() if i % 5 == 0 else good(), "s") for i in range(700)]
    d = docs(spark, [*made, (900, None, "s"), (901, "", None), (902, "good words of a text. " * 9000, "s")])
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(400)] + [(3, None), (4, 0), (5000, 1), (None, 1)], "doc_id long, quality int")
    model = quality.fit(d, labels)
    assert model.report["accuracy"] > 0.95
    got = {r.doc_id: r for r in quality.score(d, model).collect()}
    unseen = range(400, 700)
    assert sum(got[i].kept == (i % 5 != 0) for i in unseen) >= 0.97 * len(unseen)
    assert not got[900].kept and not got[901].kept and got[900].score == 0
    kept = quality.score(d, model, keep_columns=True)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)
    assert quality.score(d.limit(0), model).count() == 0
    none = quality.fit(d, labels.limit(0))
    assert sum(r.kept for r in quality.score(d, none).collect()) == 701
    assert quality.fit(d.limit(0), labels).text is None
    assert quality.score(d.select("doc_id", "text"), model).count() == 703


@pytest.mark.parametrize("kind", ["long", "string", "decimal(12,2)", "timestamp"])
def test_quality_sample_needs_no_plain_python_workers(spark, monkeypatch, kind):
    """The labelled sample goes to the JVM as Arrow, whatever the ids are; as a list it started workers on the executors that stay there idle."""
    typed = lambda df: df.withColumn("doc_id", F.col("doc_id").cast(kind))
    d = typed(docs(spark, [(i, "| a | b | c" if i % 3 == 0 else "Some good words here.", "s") for i in range(120)]))
    labels = typed(spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(90)], "doc_id long, quality int"))

    def refused(*args, **kwargs):
        raise AssertionError("rows were handed over as a list")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    model = quality.fit(d, labels)
    assert model.report["fitted"] + model.report["calibrated"] + model.report["unseen"] == 90
    assert sorted(r.n for r in quality.score(d, model, keep_columns=True).select(F.col("n_chars").alias("n")).collect()) == [21] * 80


def test_views_exchange_labels():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 1200).astype(float)
    view = lambda: np.stack([y * 4 - 2 + rng.normal(size=1200), rng.normal(size=1200)], 1)
    a, b = view(), view()
    k = np.arange(1200) < 200
    model = quality.co_train(a[k], b[k], y[k], np.arange(200) % 5 - 2 * (np.arange(200) % 5 > 2), quality.pool(a[~k], b[~k]), exchanged=100)
    assert model.report["from_meta"] >= 300 and model.report["from_text"] >= 300
    p, pa_, pb = model.scores(a[~k], b[~k])
    acc = [((v >= 0.5) == (y[~k] > 0)).mean() for v in (p, pa_, pb)]
    assert acc[0] >= max(acc[1:]) and acc[0] > 0.97


def test_exchange_helps_a_weak_view():
    """A text view with few labels and a telling second view: what the second hands over makes the first better."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 4000).astype(float)
    a = np.concatenate([rng.normal(size=(4000, 40)) * 1.5 + (y * 2 - 1)[:, None] * 0.35, rng.normal(size=(4000, 20))], 1)
    b = np.stack([y * 5 - 2.5 + rng.normal(size=4000)], 1)
    k = np.arange(4000) < 80
    held = np.where(np.arange(80) % 3 == 2, 1, 0)
    model = quality.co_train(a[k], b[k], y[k], held, quality.pool(a[~k][:2000], b[~k][:2000]), exchanged=300)
    alone = quality.co_train(a[k], b[k], y[k], held, quality.pool(a[:0], b[:0]))
    unseen = lambda m: ((m.text.raw(a[2100:]) > 0) == (y[2100:] > 0)).mean()
    assert unseen(model) > unseen(alone) + 0.03


def test_distributed_picks_equal_those_in_memory(spark):
    rng = np.random.default_rng(6)
    n = 900
    f = np.zeros((n, quality.TEXT_DIM + quality.META_DIM), np.float16)
    f[:, :3] = rng.normal(size=(n, 3))
    f[:, quality.TEXT_DIM] = rng.integers(0, 3, n)  # many ties
    df = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(f)], "row long, f binary").repartition(5)
    pick = quality._distributed(df)
    w = np.zeros(quality.TEXT_DIM + 1)
    w[:3] = 1, -2, 0.5
    text = quality.View(w)
    wide = f.astype(float)
    wm = np.zeros(quality.META_DIM + 1)
    wm[0] = 1.0
    views = {"text": text, "meta": quality.View(wm)}
    odds = np.floor(text.raw(wide[:, : quality.TEXT_DIM]) * quality.STEPS)
    bins = lambda x: np.floor(text.raw(x) * quality.STEPS)
    (first, _), (low, _), (_, tied) = pick(views, [("text", 1, 50), ("text", 0, 30), ("meta", 1, 20)])
    more = pick(views, [("text", 1, 50)])[0][0]
    got = bins(np.concatenate([first, more]))
    assert sorted(got) == sorted(np.sort(odds)[-100:]) and len(first) == 50 and got[:50].min() >= got[50:].max()
    assert sorted(bins(low)) == sorted(np.sort(odds)[:30])
    assert len(tied) == 20 and (tied[:, 0] == 2).all()  # a third of all rows are as sure
    assert len(pick(views, [("meta", 1, 2000)])[0][1]) == n - 20 and len(pick(views, [("meta", 1, 5)])[0][1]) == 0


# ---- 10: near duplicates -------------------------------------------------------------------------------------------------------------


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    a, b = [], []
    for q in range(120):
        x = [f"v{rng.integers(60)}" if rng.random() < 0.3 else f"w{q}_{i}" for i in range(200)]
        y = list(x)
        for i in rng.choice(200, q % 25, replace=False):
            y[i] = f"z{i}"
        a.append(" ".join(x + x[:80]))
        b.append(" ".join(y + y[:60]))
    a, b = pa.array(a), pa.array(b)
    true = dartminhash.pair_similarity(a, b, 5)
    for t, x, y in zip(true, a.to_pylist(), b.to_pylist()):
        c, d = (collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (x.split(), y.split()))
        assert t == pytest.approx(sum((c & d).values()) / sum((c | d).values()))
    sa, sb = (dartminhash.dart_signatures(*dartminhash.text_sets(x, 5), len(x), 500) for x in (a, b))
    est = (sa == sb).mean(1)
    z = (est - true) / np.sqrt(true * (1 - true) / 500 + 1e-9)
    assert abs(z.mean()) < 0.4 and z.std() < 1.3
    alone = dartminhash.dart_signatures(*dartminhash.text_sets(a.slice(5, 1), 5), 1, 500)
    assert (alone[0] == sa[5]).all()  # the same whatever stands beside it


def brute_groups(rows, threshold=0.8):
    texts = {i: t or "" for i, t, _ in rows if i is not None}
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        sets[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
    ids = sorted(texts)
    pairs = []
    for x, i in enumerate(ids):
        for j in ids[:x]:
            union = sum((sets[i] | sets[j]).values())
            if texts[i] == texts[j] or union and sum((sets[i] & sets[j]).values()) / union >= threshold:
                pairs.append((i, j))
    return grouped(pairs, ids)


def near_copies(rng, n, edits):
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    for _ in range(n):
        w = list(base)
        for i in rng.sample(range(150), rng.randrange(edits + 1)):
            w[i] = f"e{rng.randrange(10**6)}"
        yield " ".join(w)


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, t, "s") for i, t in enumerate([t for _ in range(8) for t in near_copies(rng, 9, 4)])]
    top = len(rows)
    rows += [(top + 1, rows[0][1], "s"), (top + 2, rows[0][1].upper(), "s"), (top + 3, None, "s"), (top + 4, "", "s"), (top + 5, "!!!", "s"), (top + 6, "???", "s"), (top + 7, "a b", "s"), (top + 8, "A, b", "s"), (top + 9, "word " * 40_000, "s"), (top + 10, "word " * 40_001, "s"), (None, "a b", "s"), (0, rows[0][1], "s")]
    want = brute_groups(rows)
    d = docs(spark, rows)
    got = dartminhash.near_duplicates(d).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    monkeypatch.setattr(dartminhash, "BLOCK", 4)
    monkeypatch.setattr(dartminhash, "CLUSTER", 6)  # buckets of larger clusters are compared each for itself
    assert {r.doc_id: r.component_id for r in dartminhash.near_duplicates(d).collect() if r.doc_id is not None} == want
    assert dartminhash.near_duplicates(d.limit(0)).count() == 0


def test_block_links():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**39, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 100 - k], rng.integers(2**39, 2**40, k).astype(np.uint64)])) for k in (0, 5, 8, 40, 45, 90)]
    sets = [dartminhash._unpacked(dartminhash._packed(s)) for s in sets]
    sim = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    pairs = [(i, j) for i in range(6) for j in range(i) if sim(sets[i], sets[j]) >= 0.8]
    got = dartminhash.block_links(sets, np.arange(6), np.arange(6), np.arange(6), 0.8)
    assert dict(enumerate(got.tolist())) == grouped(pairs, range(6))


# ---- queries and pipeline ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    plain = lambda df: df[sorted(df.columns)].astype(object).where(df.notna(), None).astype(str).sort_values(sorted(df.columns)).reset_index(drop=True)
    a, b = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLES[name]).df()
    a, b = (df.assign(refers_to=df["refers_to"].astype("Int64")) if "refers_to" in df else df for df in (a, b))
    assert plain(a).equals(plain(b))


def test_queries_read_whole_tables(spark, sf):
    n = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "embeddings", "pages")}
    assert len([q for q in QUERIES if re.fullmatch(r"op\d+_.*", q)]) == 10
    for name, q in QUERIES.items():
        table = "embeddings" if name.startswith("op2_") else "pages" if name.startswith(("op3_", "op7_")) else "documents"
        assert q(spark, sf).count() == n[table], name


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    assert [s[0] for s in p.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination", "mixing", "sharding"]
    model = quality.fit(docs_, spark.read.parquet(f"{sf}/labels.parquet"))
    ids = {r.doc_id for r in quality.score(docs_, model).collect() if r.kept}
    groups = brute_groups([(r.doc_id, r.text, "") for r in docs_.collect() if r.doc_id in ids])
    ids = {i for i in ids if groups[i] == i}
    found = decontam.decontaminate(docs_, spark.read.parquet(f"{sf}/benchmark.parquet"))
    ids -= {r.doc_id for r in found.collect() if r.contaminated}
    left = docs_.where(F.col("doc_id").isin(*ids))
    copies = {r.doc_id: r.copies for r in mixing.mix(left, [5.0, 2.0, 1.0]).collect()}
    out = p.run(spark, sf).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter({i: n for i, n in copies.items() if n})


def test_pipeline_on_awkward_rows(spark, sf, tmp_path):
    import corpus_pipeline as p

    real = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    texts = [r.text for r in real.collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    odd = [(1, texts[0], "a"), (1, texts[0], "a"), (1, texts[1], "a"), (None, texts[2], "b"), (None, texts[2], "b"), (None, texts[3], None), (None, item, "a"), (None, texts[4], "b"), (7, None, "a"), (8, "", "a"), (9, texts[2], "b")]
    rows = docs(spark, odd)
    assert p.without_near_copies(spark, rows, sf).columns == rows.columns
    got = collections.Counter((r.doc_id, r.text) for r in p.without_near_copies(spark, rows.where("text <> ''"), sf).collect())
    groups = brute_groups([(i, t, "s") for i, (_, t, _) in enumerate(odd) if t])
    first = {}
    for i, g in sorted(groups.items(), key=lambda x: (odd[x[0]][0] is None, odd[x[0]][0] or 0, x[0])):
        first.setdefault(g, odd[i][:2])
    assert got == collections.Counter(first.values())
    clean = collections.Counter((r.doc_id, r.text) for r in p.without_benchmark(spark, rows, sf).collect())
    assert clean == collections.Counter(x[:2] for x in odd if x[1] != item)
    copies = {(r.doc_id, r.size, r.source): r.copies for r in mixing.mix(rows.dropDuplicates(["doc_id", "text"]), [5.0, 2.0, 1.0]).collect()}
    mixed = p.mix_sources(spark, rows, sf)
    counts = collections.Counter((r.doc_id, r.text) for r in mixed.collect())
    assert mixed.columns == rows.columns and len(copies) == 9
    assert all(n <= 2 * odd_count for (k, n) in counts.items() for odd_count in [sum(x[:2] == k for x in odd)])
    # the whole pipeline over such a table, and over an empty one
    for name, df in (("odd", rows), ("none", rows.limit(0))):
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = p.run(spark, f"{tmp_path}/{name}").collect()
        if name == "none":
            assert out == []
        assert all(r.shard in range(24) for r in out)
