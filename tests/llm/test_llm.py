import itertools
import os
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from metrolith.llm import chroma, chunks, decontam, langid, near, packing, quality, rans, sharding, simhash, wrappers
from metrolith.llm.common import Encoder, components, cut, release, shared_folder

SF = "/root/testdata/sf0.001"
WORD, BYTE = "/opt/tokenizers/word_bpe_49k.json", "/opt/tokenizers/byte_bpe_50k.json"
ODD = [None, "", " ", "\n\n a", "don't  I'LL x²½ 1234 ÀÉ", "日本 text", "ΣΑΣ ﬁ é", "a" * 5000, "Tab\there", "a\r\nb", "x.y,z!?", "\u00a0x", "<|endoftext|>", "one <|ENDOFTEXT|> two<|startoftext|>"]


def docs(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _component string")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_is_the_library(path, spark):
    own, t = Encoder(path, keep=50), Tokenizer.from_file(path)
    for x in ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]:
        assert np.frombuffer(own(x), np.uint32).tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_rans_round_trip_and_random_access():
    for ids in (np.array([7], np.uint32), np.full(3000, 5, np.uint32), np.random.default_rng(0).integers(0, 49408, 70000).astype(np.uint32)):
        table = rans.Table(*rans.frequencies(ids))
        data, marks = rans.encode_block(ids, table)
        assert (rans.decode_block(data, len(ids), marks, table) == ids).all()
        assert (rans.decode_block(data, len(ids), marks, table, len(ids) // 2, len(ids) // 2 + 9) == ids[len(ids) // 2 : len(ids) // 2 + 9]).all()


def test_blocks_are_read_side_by_side(tmp_path, monkeypatch):
    """Documents by block, from checkpoints, are those of the whole file; documents may span blocks."""
    monkeypatch.setattr(rans, "BLOCK", 5000)
    monkeypatch.setattr(rans, "EVERY", 2)
    rng = np.random.default_rng(5)
    lengths = [1, 4999, 1, 12000, 3, 4996, *rng.integers(1, 3000, 20).tolist()]
    ids = rng.integers(0, 40000, sum(lengths)).astype(np.uint32)
    (tmp_path / "x.rans").write_bytes(rans.pack_file(list(enumerate(lengths)), ids))
    f = rans.TokenFile(str(tmp_path / "x.rans"))
    at, want = 0, []
    for i, n in enumerate(lengths):
        want.append((i, at, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes())))
        at += n
    assert list(f.documents()) == want and len(f.blocks) > 5
    assert [r for b in range(len(f.blocks)) for r in f.documents(b)] == want


def test_token_files(spark, tmp_path):
    d = docs(spark, [*ODD, "same", "same"])
    got = rans.encode_and_read_back(d, WORD, folder=f"file://{tmp_path}").orderBy("doc_id").collect()
    own, at = Encoder(WORD), 0
    for r, x in zip(got, [*ODD, "same", "same"], strict=True):
        raw = own(x) + np.array([1], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(raw) // 4, zlib.crc32(raw))
        at += r.n_tokens
    assert rans.encode_and_read_back(d.limit(0), WORD).count() == 0
    file = next(tmp_path.glob("*.rans"))
    file.write_bytes(file.read_bytes()[:-4] + b"\0\1\2\3")
    with pytest.raises(ValueError):
        list(rans.TokenFile(str(file)).documents())


def test_golay_keys_meet_for_two_errors():
    g = simhash.Golay()
    words = np.array([np.random.default_rng(i).integers(1 << 23) for i in range(400)], np.uint32)
    keys = g.keys(words)
    for flip in [1 << i for i in range(23)] + [1 << i | 1 << j for i, j in itertools.combinations(range(23), 2)]:
        other = g.keys(words ^ np.uint32(flip))
        assert ((keys[:, :, None] == other[:, None, :]) & (keys[:, :, None] >= 0)).any(axis=(1, 2)).all()


def brute_components(fps):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_simhash_against_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(docs(spark, [None, "", "one two", "One TWO "]).selectExpr("doc_id + 5000", "text"))
    got = simhash.near_duplicates(d).collect()
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in d.collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps)
    assert simhash.near_duplicates(d.limit(0)).count() == 0
    assert near.keep_first(docs(spark, ["a b c d", "a b c d", None])).columns == docs(spark, [""]).columns


def plain_fingerprint(text):
    """By the contract, bit by bit."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_bit_by_bit(spark):
    for t in [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [None, "", "a", "A b", "x\u00a0y z w", "a\x0bb\x0cc d", "É é É é", "q " * 70000]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_simhash_links_random_neighbours(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    all_ = sorted({b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base for _ in range(3)} | set(base))
    signed = [x - (1 << 64) if x >> 63 else x for x in all_]
    got = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {frozenset((a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def test_near_copies_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(600).select("doc_id", "text")
    base = d.first().text.split()[:200]
    edited = [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in (20, 60, 100, 140)]  # a few bits more than two apart
    d = d.union(docs(spark, [" ".join(base), *edited, "few words", "Few  words", "", None]).selectExpr("doc_id + 50000", "text"))
    sets = {r.doc_id: set(near.shingles(r.text).tolist()) for r in d.collect()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    real = 0
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
            real += x != y
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert real >= 10
    assert {r.doc_id for r in near.keep_first(d).collect()} == {i for i in sets if find(i) == i}
    assert near.keep_first(d.limit(0)).count() == 0


def test_group_about_the_threshold(spark, monkeypatch):
    """Copies of which some link and others don't: the groups are right, compared in one place or in several, and a
    set isn't moved for each of its pairs."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(320):
        own = list(base)
        for j in rng.choice(120, int(rng.integers(2, 6)), replace=False):
            own[j] = f"x{i}-{j}"
        texts.append(" ".join(own))
    sets = [set(near.shingles(t).tolist()) for t in texts]
    group = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    seen, real = [], near._verified

    def watched(pairs, *rest):
        moved = pairs.select("cell", "a").union(pairs.select("cell", "b")).distinct()
        seen.append((pairs.count(), moved.count()))
        return real(pairs, *rest)

    monkeypatch.setattr(near, "_verified", watched)
    for cell in (16, 2_048):
        monkeypatch.setattr(near, "CELL", cell, raising=False)
        seen.clear()
        assert {r.doc_id for r in near.keep_first(docs(spark, texts)).collect()} == set(group)
    assert seen[-1][1] < seen[-1][0] / 2 and len(seen) == 2


def test_frequent_shingles_are_found_in_a_large_table(spark, monkeypatch):
    """A phrase of a sixteenth of all documents, over a table of 32 times the sample."""
    monkeypatch.setattr(near, "SAMPLE", 50)
    given = spark.createDataFrame([(i, "a phrase of many documents" if i % 16 == 0 else f"a b c d {i}") for i in range(1600)], "d long, t string")
    assert near._frequent(given, 5).tolist() == near.shingles("a phrase of many documents").tolist()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.id: r.component for r in components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_packing(spark):
    d = docs(spark, [*ODD, "word " * 9000])
    rows = packing.pack_documents(d, BYTE, capacity=128, open_bins=4).toPandas()
    own = Encoder(BYTE)
    for i, x in enumerate([*ODD, "word " * 9000]):
        raw = own(x) + np.zeros(1, "<u4").tobytes()
        p = rows[rows.doc_id == i].sort_values("piece")
        assert p.length.sum() == len(raw) // 4 and (p.start == p.length.cumsum() - p.length).all() and (p.length[1:] == 128).all()
        assert [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(p.start, p.length, strict=True)] == p.ids_crc32.tolist()
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 128
    full = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), BYTE).toPandas()
    assert full.sequence_id.nunique() <= -(-full.length.sum() // 2048) * 1.01 + 1


def test_sharding(spark):
    d = docs(spark, ["x" * 100] * 50 + [None, "", "y" * 5000])
    r = sharding.shards(d, 1000).toPandas()
    assert len(r) == 53 and (r[r.shard_docs > 1].shard_bytes <= 1000).all() and (r.groupby("shard").n_bytes.sum() == r.groupby("shard").shard_bytes.first()).all()
    hot = sharding.shards(d.selectExpr("1 as doc_id", "repeat('z', 100) as text"), 1000).toPandas()
    assert len(hot) == 53 and hot.shard_bytes.max() <= 1000
    assert sharding.shards(d.limit(0), 10).count() == 0 and sharding.shards(d, 10**9).select("shard").distinct().count() == 1


def test_written_shards(spark, tmp_path):
    rows = [(i % 5, "x" * (i * 7 % 300), "é" * (i % 9), None) for i in range(400)] + [(None, None, None, 1), (3, "y" * 9000, "", 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, shard string, _row int")
    directory = {r.shard: r for r in sharding.write_shards(d, str(tmp_path / "s"), 4000).collect()}
    sizes = {}
    for r in spark.read.parquet(str(tmp_path / "s" / "rows")).collect():
        sizes.setdefault(r._shard, []).append(sum(len(str(x).encode()) for x in (r.doc_id, r.text, r.shard, r._row) if x is not None))
    assert sum(map(len, sizes.values())) == len(rows) == sum(r.shard_docs for r in directory.values())
    assert all(sum(v) <= 4000 or len(v) == 1 for v in sizes.values()) and sorted(map(sum, sizes.values())) == sorted(r.shard_bytes for r in directory.values())


def test_chunks_resist_shifts_and_find_passages(spark):
    rng = np.random.default_rng(0)
    text = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))
    one = text(900).encode()
    parts = lambda b: {b[x:y] for x, y in itertools.pairwise([0, *chunks.boundaries(b)])}
    assert len(parts(one[:500] + b"inserted" + one[500:]) - parts(one)) <= 6
    passage = text(55)
    texts = [text(300) + " " + passage + " " + text(200), text(40) + " " + passage + " é " + text(90), text(400), None, "", text(80)]
    d = docs(spark, texts)
    spans = chunks.repeated_spans(d).collect()
    assert {(r.doc_id, r.first_doc_id) for r in spans} == {(1, 0)}
    out = {r.doc_id: r for r in chunks.without_repeats(d).collect()}
    assert set(out) == set(range(6)) and len(out[1].text) < len(texts[1]) - 150 and out[1].n_chars == len(out[1].text) and out[2].text == texts[2]
    assert chunks.repeated_spans(d.limit(0)).count() == 0
    for b in (b"", "é".encode() * 400, b"a" * 1000):
        e = chunks.boundaries(b)
        assert b"".join(b[x:y] for x, y in itertools.pairwise([0, *e])) == b and all(b[x:y].decode() for x, y in itertools.pairwise([0, *e]))


def test_passages_are_exact_to_the_word(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 3))
    texts, want = [], {}
    for n in (50, 51, 51, 51, 51, 52, 60):  # passages of short words, of 204 bytes and more
        passage = " ".join(word() for _ in range(n))
        texts += [" ".join(word() for _ in range(90)) + "\n" + passage + " " + word() for _ in range(2)]
        if n > 50:
            want[len(texts) - 1] = (len(texts) - 2, texts[-1].encode().index(passage.encode()), passage)
    far = "".join(chr(0x4E00 + i) for i in rng.integers(0, 5000, 70))
    texts += ["é" + far, far + " x"]
    want[len(texts) - 1] = (len(texts) - 2, 0, far)
    got = {r.doc_id: (r.first_doc_id, r.start_byte, texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode()) for r in chunks.repeated_spans(docs(spark, texts)).collect()}
    assert got == want


def test_chroma_alignment(spark):
    rng = np.random.default_rng(1)
    v = [list(rng.normal(0, 0.13, 64)) for _ in range(6)]
    pcm = [chroma.render(x) for x in v]
    cut_ = pcm[0][2 * chroma.HOP * 9 :]
    rows = [(0, pcm[0]), *[(i, pcm[i]) for i in range(1, 6)], (7, cut_), (8, None), (9, b""), (40, pcm[3])]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "id long, pcm binary"), "id", "pcm")
    got = {(r.query_id, r.id): r for r in chroma.align(prints).collect()}
    assert set(got) == {(0, 7), (40, 3)} and got[0, 7].offset == 9 and got[0, 7].bit_error < 0.02 and got[40, 3].bit_error == 0


def test_chroma_keeps_all_partners(spark):
    rng = np.random.default_rng(7)
    one = chroma.render(list(rng.normal(0, 0.13, 64)))
    rows = [(0, one), (1, one), (2, one), (3, one[2 * chroma.HOP * 9 :]), (4, None)]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "id long, pcm binary"), "id", "pcm")
    every = chroma.matches(prints).collect()
    of = {r.id: r["class"] for r in every if r.other_class is None}
    linked = {(r["class"], r.other_class) for r in every if r.other_class is not None}
    assert set(of) == set(range(5)) and of[0] == of[1] == of[2] != of[3] and of[4] is None and linked == {(of[0], of[3])}


def test_chroma_meets_changed_copies(spark):
    rng = np.random.default_rng(7)
    rows, pcm = [], {}
    for q in range(12):  # a query with copies: re-encoded, noisy, cut off the hop, exact twice
        one = np.frombuffer(chroma.render(list(rng.normal(0, 0.13, 64))), "<i2").astype(np.float64)
        made = [one, one // 64 * 64, one + rng.normal(0, 100, len(one)), one + rng.normal(0, 300, len(one)), one[int(3.3 * chroma.HOP) :], one, one]
        for k, x in enumerate(made):
            pcm[20 * q + k] = np.clip(x, -32768, 32767).astype("<i2")
            rows.append((20 * q + k, pcm[20 * q + k].tobytes()))
    prints = chroma.fingerprints(spark.createDataFrame(rows, "id long, pcm binary"), "id", "pcm")
    codes = {i: chroma.fingerprint(x / 32768.0) for i, x in pcm.items()}

    def brute(a, b):
        overlaps = [(a[max(0, o) : min(len(a), len(b) + o)], b[max(0, -o) : min(len(b), len(a) - o)]) for o in range(20 - len(b), len(a) - 20)]
        return min(int(np.bitwise_count(x ^ y).sum()) / (32 * len(x)) for x, y in overlaps)

    want = {(q, i) for q in codes if q % 20 == 0 for i in codes if i != q and brute(codes[q], codes[i]) <= 0.12}
    got = {(r.query_id, r.id) for r in chroma.align(prints).collect()}
    assert len(want) > 36 and len(want & got) >= 0.9 * len(want)
    every = chroma.matches(prints).collect()
    of = {r.id: r["class"] for r in every if r.other_class is None}
    linked = {(r["class"], r.other_class) for r in every if r.other_class is not None}
    assert len(of) == len(rows) and got == {(q, i) for q in of if q % 20 == 0 for i in of if i != q and (of[q] == of[i] or (of[q], of[i]) in linked)}


def slow_tones(rng, n=20, note=3200):
    """Notes of 0.4 s with harmonics."""
    pitch = 220 * 2 ** (np.clip(np.floor(rng.normal(12, 5, n)), 0, 24) / 12)
    t = np.arange(note) / chroma.RATE
    return (sum(np.sin(2 * np.pi * pitch[:, None] * k * t) / k for k in (1, 2, 3)) * np.hanning(note) ** 0.3).ravel() * 8000


def changed(rng, one):
    """Copies: re-encoded, noisy at 10 dB, cut anywhere off the hops."""
    return [one // 64 * 64, one + rng.normal(0, one.std() * 0.316, len(one)), one[int(rng.uniform(0, 9) * chroma.HOP) :], one[9 * chroma.HOP + 85 :], one[chroma.HOP // 4 :]]


def test_chroma_links_against_brute_force(spark):
    """All pairs at all offsets; of those within the bounds at least 0.9 are found, and no others."""
    rng = np.random.default_rng(7)
    silent = [np.zeros(9000), np.zeros(20000), np.zeros(20000)]
    rows, codes = [], {}

    def add(i, x):
        rows.append((i, np.clip(x, -32768, 32767).astype("<i2").tobytes()))
        codes[i] = chroma.fingerprint(np.frombuffer(rows[-1][1], "<i2") / 32768.0)

    for q in range(16):
        one = slow_tones(rng) if q % 2 else np.frombuffer(chroma.render(list(rng.normal(0, 0.13, 64))), "<i2").astype(np.float64)
        if q == 5:
            one = np.concatenate([np.zeros(30000), one])  # silence before, which must not vote
        for k, x in enumerate([one, one, *changed(rng, one)]):
            add(20 * q + k, x)
    for k, x in enumerate([*silent, np.sin(np.arange(40000) * 0.2) * 9000, np.sin(np.arange(60000) * 0.2) * 9000]):  # silent, and a held tone
        add(400 + k, x)
    add(405, np.frombuffer(rows[0][1], "<i2")[:9000].astype(np.float64))  # shorter than the stretch
    rows += [(500, None), (501, b""), (None, rows[0][1]), rows[3], (502, b"abc")]
    prints = chroma.fingerprints(spark.createDataFrame([(*r, "c", True) for r in rows], "id long, pcm binary, class string, asked boolean"), "id", "pcm")
    d = [i for i in codes if i % 20 == 0]
    silence = {400, 401, 402}

    def linked(a, b):
        if a in silence and b in silence or np.array_equal(codes[a], codes[b]):
            return True
        n = min(chroma.OVERLAP, len(codes[a]), len(codes[b]))
        return not (a in silence or b in silence) and any(chroma.least_error(codes[a], codes[b], o)[1] <= chroma.MOST_ERROR for o in range(n - len(codes[b]), len(codes[a]) - n + 1))

    want = {(q, i) for q in d for i in codes if i != q and linked(q, i)}
    got = {(r.query_id, r.id) for r in chroma.align(prints).collect()}
    assert len(want) > 90 and got <= want and len(got) >= 0.9 * len(want)
    every = chroma.matches(prints).collect()
    of = {r.id: r["class"] for r in every if r.other_class is None and r.id is not None}
    pairs = {(r["class"], r.other_class) for r in every if r.other_class is not None}
    assert sum(r.other_class is None for r in every) == len(rows) and of[500] is of[501] is of[502] is None and of[400] == of[401]
    assert got == {(q, i) for q in d for i in codes if i != q and (of[q] == of[i] or (of[q], of[i]) in pairs)}
    assert chroma.matches(prints.limit(0)).count() == 0


def test_long_recordings_are_taken_in_parts():
    rng = np.random.default_rng(1)
    assert chroma.SILENCE == int(chroma.fingerprint(np.zeros(30000))[3])
    one = rng.normal(0, 3000, 700_000)
    long = chroma.chroma(one / 32768.0)
    assert len(long) == (len(one) - chroma.FRAME) // chroma.HOP + 1
    parts = chroma.chroma(one / 32768.0, together=100)
    assert np.allclose(long, parts)


PAGE = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a>m</a></ul></nav><div class='sidebar'>side</div><div class='c{n}'><h2>Head &eacute;{n}</h2><p>One &amp; {n}<p>Two\n\n more<br>here</div><div class='comments'><article>reader {n}</article></div><form>f</form><footer>foot</footer>"


def test_wrappers(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("{n}", str(i))) for i in range(5)] + [(9, None, None), (10, "x", ""), (11, "http://p.example", "plain  text"), (12, "http://q.example/", "<article><p>a<p>b</article><p>c</p>")]
    got = {r.page_id: r for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i].text == f"Head é{i}\nOne & {i}\nTwo more here" and got[i].n_chars == len(got[i].text)
    assert (got[9].text, got[10].text, got[11].text, got[12].text) == ("", "", "plain text", "a\nb")
    a, b = (wrappers.page_items(wrappers.blocks(x)) for x in ("<div><p>a</p><ul><li>x</ul></div>", "<div><p>b</p><p>c</p></div>"))
    assert wrappers.expression(wrappers.align(a, b)) == "(<div> (<p> # </>)+ (<ul> (<li> \"x\" </>) </>)? </>)"


def test_wrappers_keep_what_follows_unclosed_elements():
    for odd in ("<svg-icon></svg-icon>", "<title-bar>", "<select-box></select-box>", "<template-part>", "<svg width='1'/>", "<object data=x>", "<select><svg>", "<object><object>no</object>", "<svg><svg>no</svg><text>no</text></svg>", "<SELECT>no</Select>", "<script>no</script >"):
        got = [b[1] for b in wrappers.blocks(f"<body><p>one</p>{odd}<p>two</p><p>three</p></body>")]
        assert got == ["one", "two", "three"], odd
    assert [b[1] for b in wrappers.blocks("<p>one</p><script>never closed <p>two</p>")] == ["one"]


def accepts(wrapper, items):
    """Whether the expression yields the sequence, by trying everything."""
    if not wrapper:
        return not items
    own, *rest = wrapper
    if own[1] in ("?", "*") and accepts(rest, items):
        return True
    k = 0
    while k < len(items) and items[k][0] == own[0] and (own[0] == "#" and own[5] in (None, items[k][5]) or own[0] != "#" and accepts(own[5], items[k][5])):
        k += 1
        if accepts(rest, items[k:]):
            return True
        if own[1] not in ("+", "*"):
            break
    return False


def test_wrappers_accept_all_they_come_from():
    rng = np.random.default_rng(3)

    def tree(depth):
        kids = [f"<{t}>{tree(depth - 1)}</{t}>" if depth and rng.random() < 0.6 else f"<p>{'abc'[int(rng.integers(3))]}</p>" for t in rng.choice(["div", "section", "ul"], int(rng.integers(1, 4)))]
        return "".join(kids)

    for _ in range(150):
        pages = [wrappers.page_items(wrappers.blocks(tree(2))) for _ in range(4)]
        total = pages[0]
        for x in pages[1:]:
            total = wrappers.align(total, x)
        assert all(accepts(total, x) for x in pages)
        assert not accepts(total, [["table", "", 1, 1, 0, [], {}]])


def test_the_wrapper_decides(spark):
    """Other pages of a host change what is extracted: fixed texts, and a doubtful name that holds the host's articles."""
    rng = np.random.default_rng(8)
    say = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    page = lambda a, b: f"<body><div class='story-text'><p>{a}</p><p>Share this story with friends</p><p>{b}</p></div></body>"
    told = [(say(30), say(40)) for _ in range(6)]
    news = [(say(3), say(30)) for _ in range(5)]
    rows = [(i, f"http://a.example/{i}", page(*x)) for i, x in enumerate(told)] + [(20, "http://alone.example/", page(*told[0]))]
    notice = "<body><div class='c'><p>{}</p></div><div class='notice'><p>{}</p></div></body>"
    rows += [(30 + i, f"http://n.example/{i}", notice.format(*x)) for i, x in enumerate(news)]
    rows += [(40, "http://n.example/short", notice.format(say(9), say(5))), (41, "http://m.example/", notice.format(say(9), say(5)))]
    rows += [rows[0], (None, None, rows[0][2]), (50, "http://a.example/copy", rows[0][2])]
    d = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], "page_id long, url string, html string, host string, h string, main string")
    made = wrappers.main_text(d).collect()
    got = {r.page_id: r.text for r in made}
    assert len(made) == len(rows) and all(r.n_chars == len(r.text) for r in made)
    assert all(got[i] == "\n".join(x) for i, x in enumerate(told)) and "Share this" in got[20] and got[50] == got[0]
    assert all(x[1] in got[30 + i] for i, x in enumerate(news)) and "\n" not in got[41] and len(got[40].split()) >= 5 and got[40].split()[-1] in rows[12 + 0][2] + rows[12][2]
    assert wrappers.main_text(d.limit(0)).count() == 0


@pytest.mark.parametrize("name", "side related alert notice share-price social-science article-share search-results login-guide".split())
def test_no_article_is_lost_to_a_name(name):
    assert wrappers.extract(f'<body><nav>m</nav><div class="{name}"><p>One.</p><p>Two.</p></div><footer>f</footer></body>') == "One.\nTwo."
    assert wrappers.extract(f'<body><h1>Head</h1><div class="{name}"><p>Much longer than the heading is.</p></div></body>') == "Head\nMuch longer than the heading is."


def test_broken_markup_takes_time_in_proportion():
    for part in ("<b x='", '<a "', "<div>", "<ul><li>", "<!--", "<script>", "<svg>", "<", "</", "<p>", '<i a="<b a=\'', "<td><table>"):
        t = time.process_time()
        wrappers.extract(part * (400_000 // len(part)))
        assert time.process_time() - t < 20, part


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    crc = got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    assert (crc == got.held_out).all()
    odd = langid.identify(docs(spark, [None, "", "123 !", "the the the"])).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3
    mixed = langid.fit(d).proportions(" ".join(r.text for r in d.where("lang = 'en'").limit(3).collect()) + " " + " ".join(r.text for r in d.where("lang = 'de'").limit(3).collect()))
    assert set(mixed) == {"en", "de"}


def test_quality(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(d, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()
    odd = quality.classify(docs(spark, [None, "", "x"]), labels.limit(0)).collect()
    assert [r.score for r in odd] == [0.5] * 3


def test_quality_against_dense_densities():
    """Scores from cached Cholesky factors are those of the densities written out."""
    rng = np.random.default_rng(3)
    d = len(quality.NAMES)
    x = {k: rng.normal(k * 0.5, 1 + k, (300, d)) @ rng.normal(0, 1, (d, d)) for k in (0, 1)}
    model = quality.discriminant({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()})
    every = np.concatenate([x[0], x[1]])
    centre, scale = every.mean(axis=0), every.std(axis=0)
    z = {k: (v - centre) / scale for k, v in x.items()}
    spread = {k: np.cov(v.T, bias=True) for k, v in z.items()}
    pooled = (spread[0] + spread[1]) / 2
    density = []
    for k in (0, 1):
        own = 0.9 * spread[k] + 0.1 * pooled
        own = 0.95 * own + 0.05 * np.eye(d) * np.trace(own) / d
        diff = (every - centre) / scale - z[k].mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(own), diff) - 0.5 * np.linalg.slogdet(own)[1] + np.log(301 / 602))
    want = density[1] - density[0]
    assert np.allclose(model.score(every), 0.5 + 0.5 * want / (4 + np.abs(want)), atol=1e-6)


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(0, 1), (0, 1), (0, 0), (1, 1), (None, 1), (3, None), (3, 7), (99, 1)], "doc_id long, quality int")
    d = spark.createDataFrame([(0, "a b c", 1), (0, "a b c", 1), (1, None, 2), (None, "x" * 300_000, 3), (3, "", 4)], "doc_id long, text string, quality int")
    got = quality.classify(d, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in got)
    one = quality.classify(d, labels.where("quality = 1"))  # one class only
    assert one.count() == 5 and quality.classify(d.limit(0), labels).count() == 0 and quality.classify(d, labels.limit(0)).where("score != 0.5").count() == 0


def slow_mixture(like, n):
    """Proportions of one document by plain expectation-maximisation."""
    share = np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(2000):
        mix = like * share
        share = (n[:, None] * mix / mix.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
    return share


def test_language_mixtures_against_brute_force():
    rng = np.random.default_rng(2)
    langs = ["aa", "bb", "cc"]
    words = [["".join(chr(97 + int(rng.integers(9 * k // 2, 9 * k // 2 + 12))) for _ in range(6)) for _ in range(80)] for k in range(3)]
    counts = np.stack([np.bincount(langid.places(w * 5).ravel(), minlength=langid.OFFSETS[4]) for w in words]).astype(np.float32)
    model = langid.Model(langs, counts)
    texts = [" ".join(words[0]), " ".join(words[0][:60] + words[1][:40]), " ".join(words[0][:30] + words[1][:30] + words[2][:30]), None, "½ 12 ⅷ", words[2][0]]
    got = model.mixtures(texts)
    for t, g in zip(texts, got, strict=True):
        if g:
            w = langid.words_of(t)
            like = model._likelihoods(w).astype(float)
            everyone = {c: slow_mixture(like[:, list(c)], np.ones(len(w))) for r in (1, 2, 3) for c in itertools.combinations(range(3), r)}
            score = {c: np.log((like[:, list(c)] * s).sum(axis=1)).sum() - 0.5 * np.log(len(w) + 1) * len(c) for c, s in everyone.items()}
            best = max(score, key=score.get)
            assert set(g) == {langs[k] for k in best} and all(abs(g[langs[k]] - s) < 0.01 for k, s in zip(best, everyone[best], strict=True))
    assert got[3] == got[4] == {} and langid.words_of("x²½y हिन्दी") == ["x", "y", "हिन्दी"]


def test_language_of_odd_tables(spark):
    d = spark.createDataFrame([(1, "alpha beta", None, 1), (None, "gamma", "xx", 2), (3, None, "xx", 3), (3, "12", None, 4)], "doc_id long, text string, lang string, _sure int")
    assert {r.doc_id: r.lang_pred for r in langid.identify(d).collect()} == {1: "und", None: "und", 3: "und"}  # a null id teaches nothing
    kept = langid.keep_identified(d)  # nothing is learnt, so only letters count
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"] and langid.keep_identified(d.limit(0)).count() == 0


def slow_alignment(a, b):
    """Smith-Waterman, cell by cell: the best score."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_decontamination(spark):
    rng = np.random.default_rng(2)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(400)]
    text = lambda n: [words[i] for i in rng.integers(0, 400, n)]
    item = text(40)
    edited = list(item)
    for i in (5, 17, 29):
        edited[i] = "changed"
    del edited[11]
    texts = [" ".join(text(80) + item + text(50)), " ".join(text(10) + edited), " ".join(text(200)), None, "", " ".join(item).upper()]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, " ".join(item))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.matches(docs(spark, texts), bench).collect())
    assert got == [(d, i) for d in (0, 1, 5) for i in (1, 4)]
    assert {r.doc_id for r in decontam.keep_clean(docs(spark, texts), bench).collect()} == {2, 3, 4}
    assert decontam.matches(docs(spark, texts), bench.limit(0)).count() == 0
    for _ in range(30):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 20)
        assert decontam.smith_waterman(a, b)[0][0] == slow_alignment(a, b)


def test_decontamination_against_brute_force(spark):
    """All documents against all items, cell by cell, with edits; frequent phrases, repeats, null ids, short items."""
    rng = np.random.default_rng(9)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 4)) for _ in range(150)]
    text = lambda n: [words[i] for i in rng.integers(0, 150, n)]
    phrase = text(5)
    items = [phrase + text(int(rng.integers(6, 30))) for _ in range(6)] + [["uno", "dos"], ["solo"]]
    rows = []
    for i in range(70):
        body = text(int(rng.integers(0, 50))) + phrase  # a phrase of the items that every document has
        if i % 3 == 0:
            part = list(items[i % len(items)])
            for k in range(len(part)):
                if rng.random() < (0.0, 0.15, 0.3)[i // 3 % 3]:
                    part[k] = words[int(rng.integers(150))]
            body += part + text(int(rng.integers(0, 20)))
        rows.append((i, " ".join(body)))
    rows += [rows[0], (None, rows[0][1]), (200, None), (201, ""), (0, rows[3][1])]
    d = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, h string, d int")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(0, " ".join(items[0])), (None, "x y z")], "item_id long, text string")
    want = []
    for i, t in rows:
        w = (t or "").split()
        for k, x in enumerate(items):
            if len(x) < 3:
                score = 1.0 if any(w[j : j + len(x)] == x for j in range(len(w))) else 0.0
            else:
                score = slow_alignment(x, w) / (2 * len(x))
            if score >= 0.5:
                want.append((str(i), k, round(score, 9)))
    found = decontam.matches(d, bench).collect()
    got = [(str(r.doc_id), r.item_id, round(r.score, 9)) for r in found]
    assert len(want) > 20 and set(got) <= set(want) and len(got) >= 0.95 * len(want) and len(got) == len([x for x in want if x in set(got)])
    for r in found:
        if r.doc_id == 9:
            passage = rows[9][1].split()[r.first_word : r.end_word]
            assert round(slow_alignment(items[r.item_id], passage) / (2 * len(items[r.item_id])), 9) == round(r.score, 9)
    kept = decontam.keep_clean(d, bench)
    assert kept.columns == d.columns and sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(str(i) for i, t in rows if not any(str(i) == x[0] for x in want) or (i == 0 and t == rows[3][1] and False))
    assert decontam.keep_clean(d, bench.limit(0)).count() == len(rows) and decontam.matches(d.limit(0), bench).count() == 0


def test_every_stretch_of_an_item_keeps_a_seed():
    rng = np.random.default_rng(0)
    for n in (1, 5, 8, 9, 40, 200):
        used = decontam.rare(rng.integers(0, 10**6, n))
        assert used.any() and all(used[i : i + decontam.STRETCH].any() for i in range(max(1, n - decontam.STRETCH + 1)))


def brute_groups(texts):
    """Ids whose text is not the first of its group: five-word shingles, Jaccard 0.8 or more, all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) != i}


def test_pipeline(spark, tmp_path):
    """All stages against brute force, with nulls, repeated rows and ids, and a clashing column."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    some = d.first()
    more = [(None, "alpha beta " * 40, some.lang), (some.doc_id, some.text, some.lang), (9001, None, "en"), (9002, "", "en"), (9003, "123 !", "en"), (9004, bench.first().text, "en"), (9005, some.text + " tail", some.lang), (None, bench.first().text, None)]
    odd = spark.createDataFrame(more, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as long) as n_chars")
    given = d.select("doc_id", "text", "lang", "source", d.n_chars.cast("long").alias("n_chars")).union(odd).selectExpr("*", "1 as _twin", "'x' as h")
    given.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    rows = [(r.doc_id, r.text) for r in given.collect()]
    model = langid.fit(given.where(langid.remainder("doc_id", 4) != 2))
    rows = [r for r in rows if max(model.proportions(r[1]).values(), default=0) >= 0.5]
    later = brute_groups({i: t for i, t in rows if i is not None})
    rows = [r for r in rows if r[0] not in later]
    order = sorted({r for r in rows if r[0] is not None})
    holes = {}
    for k, a, b in brute_spans([t for _, t in order]):
        holes.setdefault(order[k], []).append((a, b))
    left = []
    for r in rows:
        raw = (r[1] or "").encode()
        for a, b in reversed(holes.get(r, [])):
            raw = raw[:a] + raw[b:]
        if r not in holes or raw.strip():
            left.append((r[0], raw.decode()))
    items = [decontam.hashes(r.text) for r in bench.collect()]
    width = max(map(len, items))
    full = np.zeros((len(items), width), np.uint64)
    for k, x in enumerate(items):
        full[k, : len(x)] = x
    sizes = np.array([len(x) for x in items])
    clean = []
    for i, t in left:
        w = decontam.hashes(t)
        if not len(w) or (decontam.smith_waterman(full, np.tile(w, (len(items), 1)), sizes)[0] / (2 * sizes)).max() < 0.5:
            clean.append((i, t))
    tok = Tokenizer.from_file(BYTE)
    want = []
    for i, t in clean:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        cut_at = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cut_at))]
    got = [("None" if np.isnan(r.doc_id) else str(int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()]
    assert len(corpus_pipeline.STAGES) == 5 and len(rows) < given.count() and len(clean) < len(rows) and sorted(got) == sorted(want)
    for _, x in out.sort_values("offset").groupby("sequence_id"):
        assert x.offset.tolist() == (x.length.cumsum() - x.length).tolist() and x.length.sum() <= 2048


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_spans(texts):
    """(doc, first byte, end byte) of all words that lie in a run of 51 words that an earlier document holds."""
    out, seen = [], set()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        starts, ends = chunks.words_of(raw) if raw else ([], [])
        words = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        runs = [tuple(words[k : k + 51]) for k in range(len(words) - 50)]
        last = None
        for k in [k for k, r in enumerate(runs) if r in seen]:
            if last is not None and k - last < 51:
                out[-1] = (i, out[-1][1], int(ends[k + 50]))
            else:
                out.append((i, int(starts[k]), int(ends[k + 50])))
            last = k
        seen.update(runs)
    return out


def test_passages_against_brute_force(spark):
    rng = np.random.default_rng(11)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(words[i] for i in rng.integers(0, 300, n))
    pool = [text(int(n)) for n in rng.integers(40, 900, 12)]
    texts = []
    for _ in range(60):
        parts = [p if rng.random() < 0.7 else " ".join(p.split()[int(rng.integers(30)) :]) for p in (pool[i] for i in rng.integers(0, 12, rng.integers(0, 4)))]
        texts.append(" \n".join([text(int(rng.integers(0, 60))), *parts, text(int(rng.integers(0, 60)))]))
    texts += [texts[3], texts[3], "a " * 400, "a " * 300, None, "", "x" * 100_000]
    got = sorted((r.doc_id, r.start_byte, r.end_byte) for r in chunks.repeated_spans(docs(spark, texts)).collect())
    assert len(got) > 30 and got == sorted(brute_spans(texts))


def test_passages_of_repeated_ids(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join("é" + "".join(chr(97 + c) for c in rng.integers(0, 26, 4)) for _ in range(n))
    one, two = text(60), text(60)
    rows = [(1, one + " " + two), (5, text(9) + " " + one), (5, two + " end"), (5, two + " end"), (7, text(70)), (7, None), (None, one)]
    d = spark.createDataFrame([(i, t, 0, "s", "c") for i, t in rows], "doc_id long, text string, n_chars int, h string, settled string")
    left = [(r.doc_id, r.text, r.n_chars) for r in chunks.without_repeats(d).collect()]
    assert sorted(left, key=str) == sorted([(1, rows[0][1], 0), (5, rows[1][1][: -len(one)], len(rows[1][1]) - len(one)), (5, " end", 4), (5, " end", 4), (7, rows[4][1], 0), (7, None, 0), (None, one, 0)], key=str)
    assert chunks.repeated_spans(d).count() == 2


def test_passages_leave_nothing_on_disk(spark, monkeypatch):
    """Folders go once what they gave is cut, and shuffles are let go after each step: else a run's disk is left to when
    the driver happens to collect its garbage."""
    rng = np.random.default_rng(12)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"], 300)) for _ in range(4)]
    d = docs(spark, [*texts, texts[0], texts[1] + " and more", "before " + texts[2]])
    folder, done = shared_folder(spark).removeprefix("file://").removeprefix("file:"), []
    kept = lambda: {x for x in os.listdir(folder) if x.startswith(("metrolith-chunks", "metrolith-runs"))} if os.path.isdir(folder) else set()
    for name in ("cut", "_stored", "release"):
        monkeypatch.setattr(chunks, name, lambda *x, f=getattr(chunks, name), name=name: (done.append(name), f(*x))[1])
    before = kept()
    got = chunks.repeated_spans(d)
    assert kept() == before
    assert all(b == "release" for a, b in itertools.pairwise(done[1:]) if a != "release") and done[-1] == "release"  # the first step shuffles nothing
    assert sorted(r.doc_id for r in got.collect()) == [4, 5, 6]


def test_released_shuffles_are_gone(spark):
    """Those of the last query too, whose rows were cut, while these are still in use."""
    alive = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()

    def left(n):  # at last; the files go in the background
        end = time.time() + 3
        while alive.size() > n and time.time() < end:
            time.sleep(0.1)
        return alive.size()

    release(spark)
    release(spark)
    before = left(0)
    kept = cut(spark.range(1000).groupBy((F.col("id") * 7 % 1000).alias("k")).count())
    assert alive.size() > before
    release(spark)
    assert left(before) <= before
    assert kept.count() == 1000


def test_posts_of_prefixes_are_moved_once(spark):
    rng = np.random.default_rng(4)
    sets = [(c, rng.choice(60, 5, replace=False).tolist()) for c in range(12)]
    own = spark.createDataFrame([(c, len(x), x) for c, x in [*sets, sets[0], sets[3], (99, [1000, 1001]), (99, [1000, 1001])]], "class long, n int, first array<long>")
    shared = near._shared(own)
    assert shared._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    held = {s: {c for c, x in sets if s in x} for s in range(60)}
    assert sorted(map(tuple, shared.collect())) == sorted((s, c, 5, x.index(s)) for c, x in sets for s in x if len(held[s]) > 1)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_marks_after_a_word_are_one_piece(path):
    """Without the expression that splits words, and merged once for the word; ids are the library's all the same."""

    class Split:
        def findall(self, text, given=Encoder(path).split):
            asked.append(text)
            return given.findall(text)

    own, t, asked = Encoder(path), Tokenizer.from_file(path), []
    own.split = Split()
    text = "x " + " ".join(f"Übermut{m}" for m in ["", "###", ",%%%", '"', ")_", "'", "''", "***", ".", "'s", "-x"])
    assert np.frombuffer(own(text), np.uint32).tolist() == t.encode(text, add_special_tokens=False).ids
    assert {x.strip().lower() for x in asked} <= {"x", "übermut's", "übermut-x"}
    for text in [f"{a}one{b}two{c}" for a in ("", " ", "\n", "\t") for b in (" ", "\n", "  ", "\n\n", " \n", "\n ", "\t") for c in ("", " ", "\n", "\t")]:
        assert np.frombuffer(own(text), np.uint32).tolist() == t.encode(text, add_special_tokens=False).ids
