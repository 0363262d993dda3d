"""The training-data operators against brute force, round trips and odd inputs."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import bpe_roundtrip, license_scan, line_dedup, ngram_join, packing, quality_rules, token_codes, tokenizing, toxicity, url_filter, vector_neardup
from quillmark.llm.common import Scratch, connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 997}x{i % 89}" for i in range(30_000))
SCHEMA = "doc_id long, text string, score double, block long, ids string"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a  b   c\n\n d "), (6, "MIT License. Under the MIT license!"), (7, LONG), (8, LONG + " tail"), (9, LONG),
    (10, "İstanbul ΣΑΣ 日本語   x\x1cy é"), (11, "'s don't I'll <|endoftext|> 1234 ½"), (None, "no id here at all"), (4, "one"), (4, "two other words"), (12, "a" * 5000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 0.5, 7, "x") for i, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    return spark.read.parquet(f"{SF}/documents.parquet")


def library_ids(name, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizing.tokenizer_path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def key(row):
    return (row["doc_id"] is not None, row["doc_id"] or 0)


# 1 -------------------------------------------------------------------------------


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(3000)), [50000] * 1500 + [1] * 700])
def test_codes_round_trip(ids):
    codes = token_codes.Codes(token_codes.pack_codes(np.array(ids, "<u4")))
    assert len(codes) == len(ids) and codes.slice(0, len(ids)).tolist() == ids
    assert [codes[i] for i in range(0, len(ids), 7)] == ids[::7]
    for a in range(0, len(ids), 311):
        assert codes.slice(a, min(len(ids), a + 97)).tolist() == ids[a : a + 97]


def test_token_codes(spark, odd, empty, tmp_path):
    path = tokenizing.tokenizer_path("byte_bpe_50k.json")
    token_codes.write_token_codes(odd, str(tmp_path / "a"), path, segment_ids=500)
    rows = sorted(token_codes.read_token_codes(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    want = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for row, (doc, text) in zip(rows, want, strict=True):
        ids = [*library_ids("byte_bpe_50k.json", text), 0]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc, start, len(ids), crc(ids))
        start += len(ids)
    for doc in (1, 7, 11):
        ids = [*library_ids("byte_bpe_50k.json", dict(ODD)[doc]), 0]
        for i in {0, len(ids) // 2, len(ids) - 1}:
            assert token_codes.token_at(spark, str(tmp_path / "a"), doc, i) == ids[i]
        assert token_codes.token_at(spark, str(tmp_path / "a"), doc, len(ids)) is None
    assert token_codes.token_at(spark, str(tmp_path / "a"), 99, 0) is None
    token_codes.write_token_codes(empty, str(tmp_path / "b"), path)
    assert token_codes.read_token_codes(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", tokenizing.BYTE_LEVEL), ("word_bpe_49k.json", tokenizing.WORD_LEVEL)])
def test_another_splitting_is_not_cut(name, kind):
    other = tokenizing.WORD_LEVEL if kind == tokenizing.BYTE_LEVEL else tokenizing.BYTE_LEVEL
    encoder = tokenizing.UnitEncoder(tokenizing.tokenizer_path(name), other)
    assert encoder.whole and not tokenizing.UnitEncoder(tokenizing.tokenizer_path(name), kind).whole
    texts = ["Two words, one's 12.", "", "  x "]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library_ids(name, t) for t in texts]


def test_worker_keeps_one_memory():
    made = [tokenizing.worker_memory((n,), object) for n in (1, 1, 2, 1)]
    assert made[0] is made[1] and made[3] is not made[0]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", tokenizing.BYTE_LEVEL), ("word_bpe_49k.json", tokenizing.WORD_LEVEL)])
def test_units_equal_whole_texts(name, kind):
    encoder = tokenizing.UnitEncoder(tokenizing.tokenizer_path(name), kind, places=16, width=2, entries=3)
    texts = [t for _, t in ODD] + [LONG.replace("7 ", "7  ", 40), "a\n \nb", "x  \n", " lead", "trail ", "tab\t\tx \t y", "a\u00a0 b", "don't\u2028 stop"]
    for size in (50, 3000, 1 << 21):
        for text, ids in zip(texts, encoder.encode(texts, group_bytes=size), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library_ids(name, text)


# 3 -------------------------------------------------------------------------------


def test_packing(odd, empty):
    rows = packing.packed_digest(odd).collect()
    pieces, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    tokens = Counter()
    for doc, text in ODD:
        tokens[doc] += len(library_ids("word_bpe_49k.json", text)) + 1
    for r in rows:
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
    assert pieces == dict(tokens)
    for doc in (5, 10, 11, 7):
        ids = [*library_ids("word_bpe_49k.json", dict(ODD)[doc]), 2]
        own = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == doc)
        at = 0
        for start, length, check, total in own:
            assert start == at and total == len(ids) and check == crc(ids[start : start + length])
            at += length
        assert at == len(ids)
    assert packing.packed_digest(empty).count() == 0


def test_cost_balance():
    b = packing.CostBalancer(4, 100, 1.0, 0.01)
    b.fill([(i, 0, n) for i, n in enumerate([90, 80, 70, 60, 40, 30, 20, 10])])
    assert (b.room == 0).all() and sum(n for s in b.placed for _, _, n in s) == 400


# 6 -------------------------------------------------------------------------------


def test_bpe(odd, empty):
    ranks, pattern = tokenizing.tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizing.split_pattern()
    encoding = tokenizing.rank_encoding(ranks, pattern)
    rows = bpe_roundtrip.decode_ids(bpe_roundtrip.encode_texts(odd, ranks, pattern, long_text=50), ranks, pattern).collect()
    got = sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode(), bytes(r["ids"])) for r in rows)
    want = sorted((d or 0, t or "", np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes()) for d, t in ODD)
    assert got == want
    assert bpe_roundtrip.encode_texts(empty, ranks, pattern).count() == 0


# 2 -------------------------------------------------------------------------------


def brute_components(rows, size, threshold):
    sets = []
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text in rows:
        w = WORD.findall((text or "").translate(low))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and 100 * both >= threshold * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    low_id = {g: min([d for d in ds if d is not None], default=None) for g, ds in groups.items()}
    return sorted(((doc is not None, doc or 0), len(sets[i]), low_id[find(i)]) for i, (doc, _) in enumerate(rows))


def near_copies(n, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(n):
        words = list(rng.choice(vocabulary, int(rng.integers(5, 120))))
        for _ in range(int(rng.integers(1, 6)) if g else 60):
            own = list(words)
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(len(own)))] = f"e{rng.integers(10**6)}"
            rows.append(" ".join(own))
    boiler = "this line stands in very many documents of the whole table"
    rows += [boiler] * 5 + [f"{boiler} {i}" for i in range(30)]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("size, threshold, rare", [(4, 85, 2), (5, 80, 16)])
def test_ngram_join_equals_brute_force(spark, size, threshold, rare):
    rows = near_copies(40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.ngram_components(df, size, threshold, rare=rare, block_bytes=5000, bucket_tokens=500).collect()
    assert sorted((key(r), r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, size, threshold)


def continuum(n):
    """A large group whose pairs lie between similarities of about 0.4 and 0.95, beside smaller ones."""
    rng = np.random.default_rng(5)
    rows = []
    for g, m in ((0, n), (1, n // 4), (2, 5)):
        base = [f"g{g}w{k}" for k in range(150)]
        for _ in range(m):
            words = list(base)
            for k in rng.choice(150, int(rng.integers(0, 9)), replace=False):
                words[k] = f"x{int(rng.integers(40))}"
            if rng.random() < 0.2:
                words = words[: int(rng.integers(120, 150))]
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("size, threshold, rare, chunk", [(4, 85, 2, 16), (5, 80, 16, 1024)])
def test_ngram_join_of_a_continuum(spark, size, threshold, rare, chunk):
    rows = continuum(120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.ngram_components(df, size, threshold, rare=rare, block_bytes=20_000, bucket_tokens=500, chunk_rows=chunk).collect()
    want = brute_components(rows, size, threshold)
    assert 5 < len({c for _, _, c in want}) < len(rows) - 20  # some link, some do not
    assert sorted((key(r), r["n_shingles"], r["component_id"]) for r in got) == want


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(np.concatenate([rng.integers(0, 50, 30), rng.integers(100, 2000, 40)])) for _ in range(60)]
    row, token = np.repeat(np.arange(60), list(map(len, sets))), np.concatenate(sets).astype(np.uint64)
    for left, right in ((np.arange(60), np.arange(60)), (np.arange(0, 60, 2), np.arange(1, 60, 2))):
        got = ngram_join.overlaps(row, token, left, right, 60, heavy=8, width=7)
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                assert a == b or got[i, j] == len(np.intersect1d(sets[a], sets[b]))


def test_ngram_join_odd(odd, empty):
    got = ngram_join.ngram_components(odd).collect()
    want = {(k, n, c) for k, n, c in brute_components(ODD, 4, 85)}
    assert len(got) == len(ODD) and {(key(r), r["n_shingles"], r["component_id"]) for r in got} == want
    assert ngram_join.ngram_components(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (150, 300), (7, 7)]
    found = connected_components(spark, spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    got = {r["id"]: r["component"] for r in found}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 150, 200, 300)}


# 4 -------------------------------------------------------------------------------


def test_toxicity_learns(spark):
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(["ba", "lo", "mi", "ne", "ru", "ta"], 3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, 40))
        if i % 4 == 0:
            words[int(rng.integers(40))] = str(rng.choice(["vilefoul", "hatespew", "grimslur"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, marks)
    out = toxicity.score_toxicity(docs, model).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.keep_harmless(docs, model).count() == sum(r["predicted"] == 0 for r in out)


def test_toxicity_odd(spark, odd, empty):
    none = toxicity.fit_toxicity(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in toxicity.score_toxicity(odd, none).collect()] == [0] * len(ODD)
    texts = [b"good words only here", b"more good words"] * 10
    model = toxicity.fit_texts([t + b" awfulword" for t in texts], texts)
    assert toxicity.score_toxicity(odd, model).count() == len(ODD)
    assert toxicity.keep_harmless(odd, model).columns == odd.columns
    assert toxicity.score_toxicity(empty, model).count() == 0


# 5 -------------------------------------------------------------------------------


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        base = rng.standard_normal(16)
        for k in range(1 if i % 3 else 40 if i == 0 else 4):
            v = base / np.linalg.norm(base) + rng.standard_normal(16) * (0.06 if k else 0)
            rows.append(v.tolist())
    rows += [rows[3]] * 9 + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, key string").repartition(3)
    got = {r["vec_id"]: r for r in vector_neardup.near_vectors(df, window=64, block=16).collect()}
    fine = [v if v and len(v) == 16 and None not in v else [float("nan")] * 16 for v in rows]
    x = np.array(fine, float)
    with np.errstate(invalid="ignore"):
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = np.nan_to_num(x @ x.T) >= 0.9
    np.fill_diagonal(close, False)
    label = np.arange(len(rows))
    while True:
        new = np.minimum(label, np.where(close, label[None, :], 10**9).min(1))
        if (new == label).all():
            break
        label = new
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * close.sum()
    assert all(got[i]["n_links"] <= n for i, n in enumerate(close.sum(1)))
    assert np.mean([got[i]["component_id"] == label[i] for i in range(len(rows))]) > 0.97
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(len(rows) - 6, len(rows)))


def test_vectors_in_a_hot_cluster(spark):
    """A third of the rows at a cosine of 0.8 with each other, pairs at 0.91 among them."""
    rng = np.random.default_rng(2)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(64))
    aside = lambda m: unit(m - np.outer(m @ centre, centre))
    own = aside(rng.standard_normal((1_000, 64)))
    other = rng.standard_normal((1_000, 64))
    other = aside(other - (other * own).sum(1, keepdims=True) * own)
    twin = unit(0.55 * own + np.sqrt(1 - 0.55**2) * other)
    hot = unit(np.concatenate([0.8**0.5 * centre + 0.2**0.5 * own, 0.8**0.5 * centre + 0.2**0.5 * twin]))
    x = np.concatenate([hot, unit(rng.standard_normal((4_000, 64)))])
    close = x[:2_000] @ x[:2_000].T >= 0.9
    np.fill_diagonal(close, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: r["n_links"] for r in vector_neardup.near_vectors(df, window=64, chunk=700).collect()}
    assert close.sum() > 1_500
    assert [got[i] for i in range(2_000)] == close.sum(1).tolist()


def test_vectors_of_several_lengths_and_ranges(spark):
    rng = np.random.default_rng(4)
    rows = []
    for width, n in ((12, 900), (7, 300)):
        base = rng.standard_normal((n, width))
        for k in range(n):
            v = base[k] if k % 3 else base[k - k % 9] + 0.08 * rng.standard_normal(width)
            rows.append((len(rows), [float(np.float32(x)) for x in v]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {r["vec_id"]: r["component_id"] for r in vector_neardup.near_vectors(df, window=16).collect()}
    want, met, pairs = {}, 0, 0
    for a in range(len(rows)):
        for b in range(a):
            if len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                    pairs += 1
                    met += got[a] == got[b]
                    want.setdefault(a, b)
    assert pairs > 100 and met >= 0.99 * pairs
    assert all((a in want) or (got[a] == a) or any(got[a] == got[b] for b in want) for a in got)
    assert len({len(rows[i][1]) for i in got if got[i] != i}) == 2


def test_vectors_odd(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_neardup.near_vectors(empty).count() == 0
    two = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<float>")
    out = sorted((key({"doc_id": r["vec_id"]}), r["n_links"], r["component_id"]) for r in vector_neardup.near_vectors(two).collect())
    assert out == [((False, 0), 1, 5), ((True, 5), 0, 5), ((True, 5), 1, 5)]


# 7 -------------------------------------------------------------------------------


def test_patience():
    a, b = [1, 2, 3, 4, 5, 9], [7, 1, 2, 8, 4, 5]
    assert line_dedup.patience(a, b) == [(0, 1), (1, 2), (3, 4), (4, 5)]
    # blocks in another order are both found
    assert line_dedup.common_blocks([1, 2, 3, 4], [3, 4, 1, 2], [10] * 4, 20) == [(0, 2), (2, 4)]
    assert line_dedup.common_blocks([1, 2], [1, 5], [10, 10], 20) == []


def test_line_dedup(spark):
    passage = "\n".join(f"this is line number {i} of a passage which goes round" for i in range(4))
    rows = [(i, f"own opening {i}\n{passage}\nown ending of document {i}") for i in range(50)] + [(90, passage), (91, "All rights reserved."), (92, "All rights reserved.")]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["lines_deleted"] == 0
    for i in range(1, 50):
        assert out[i]["text"] == f"own opening {i}\nown ending of document {i}"
    assert out[90]["text"] == "" and out[92]["text"] == "All rights reserved."


def test_patience_of_repeated_lines():
    passage = [5, 6, 7, 8]
    early, late = [1, *passage, 2, *passage, 3], [11, *passage, 12, *passage, 13]
    blocks = line_dedup.common_blocks(early, late, [10] * len(late), 20)
    assert sorted(k for x, y in blocks for k in range(x, y)) == [1, 2, 3, 4, 6, 7, 8, 9]
    assert line_dedup.common_blocks(early, [21, *passage, 22], [10] * 6, 20) == [(1, 5)]
    assert line_dedup.common_blocks([21, *passage, 22], late, [10] * len(late), 20) == [(1, 5), (6, 10)]
    assert line_dedup.common_blocks([1, 9, 2, 9, 3, 5, 6], [5, 6, 1, 9, 9, 2, 8, 3], [10, 10, 9, 1, 1, 9, 9, 9], 20) == [(0, 2)]
    assert line_dedup.common_blocks([1, 9, 2, 9, 3], [11, 9, 12], [60] * 3, 20) == [(1, 2)]
    assert line_dedup.common_blocks([31, 5, 0, 6, 32, 5, 0, 6, 33], [41, 5, 0, 6, 42], [0, 10, 0, 10, 0], 20) == [(1, 4)]


def test_line_dedup_passage_twice(spark):
    passage = "\n".join(f"this is line number {i} of a passage which stands twice here" for i in range(4))
    twice = lambda i: f"own opening {i}\n{passage}\nown middle {i}\n{passage}\nown ending {i}"
    df = spark.createDataFrame([(1, twice(1)), (2, twice(2)), (3, f"head\n{passage}\nfoot")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert out[1]["text"] == twice(1) and out[3]["text"] == "head\nfoot"
    assert out[2]["text"] == "own opening 2\nown middle 2\nown ending 2"


def test_line_dedup_run_of_frequent_lines(spark):
    lines = [f"frequent line {i} has ten words in it as counted" for i in range(3)]
    block = "\n".join([lines[0], "", *lines[1:]])
    rows = [(i, f"opening of {i}\n{line}\nending of {i}") for i, line in enumerate(lines)]
    rows += [(10, f"opening b\n{block}\nending b"), (11, f"opening c\n{block}\nending c"), (12, f"opening d\n{block}\nending d")]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(out[i]["text"] == text for i, text in rows[:4])
    assert out[11]["text"] == "opening c\nending c" and out[12]["text"] == "opening d\nending d"


def test_line_dedup_odd(odd, empty):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "lines_total", "lines_deleted", "blocks_deleted"]
    rows = {(r["doc_id"], r["lines_total"], r["lines_deleted"]) for r in out.collect()}
    assert (9, 1, 1) in rows and (7, 1, 0) in rows and (1, 0, 0) in rows
    assert line_dedup.dedup_lines(empty).count() == 0


# 8 -------------------------------------------------------------------------------


def test_line_dedup_equals_all_pairs(spark):
    """Every block that two documents share goes from the later one."""
    rng = np.random.default_rng(7)
    pool = [" ".join(f"l{k}w{j}" for j in range(int(rng.integers(3, 14)))) for k in range(60)]
    rows = []
    for d in range(60):
        lines = [str(rng.choice(pool)) if rng.random() < 0.5 else f"own {d} {k} " + " ".join(f"u{d}x{k}y{j}" for j in range(6)) for k in range(12)]
        if d % 4 == 0:
            at = int(rng.integers(50))
            lines[3:3] = pool[at : at + 4]
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, lines_deleted int").repartition(3)
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert line_dedup.dedup_lines(df).columns == ["doc_id", "text", "lines_total", "lines_deleted", "blocks_deleted"]
    whole = {d: t.split("\n") for d, t in rows}
    for d in whole:
        places = set()
        for e in range(d):
            a, b = [hash(x) | 1 for x in whole[e]], [hash(x) | 1 for x in whole[d]]
            for x, y in line_dedup.common_blocks(a, b, [len(x.split()) for x in whole[d]], 20):
                places |= set(range(x, y))
        # what any earlier document shares as a block is gone; nothing else is
        gone = len(whole[d]) - len(out[d]["text"].split("\n")) if out[d]["text"] else len(whole[d])
        assert out[d]["lines_deleted"] == gone
        left = out[d]["text"].split("\n")
        assert [x for k, x in enumerate(whole[d]) if k not in places] == left, d


def test_quality_counts(odd, empty, documents):
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()][:120] + ODD
    df = documents.sparkSession.createDataFrame(texts, "doc_id long, text string")
    model = quality_rules.fit_quality(df)
    got = sorted(tuple(r)[:7] for r in quality_rules.judge_quality(df, model).where("doc_id is not null").collect())
    want = []
    for doc, text in texts:
        if doc is None:
            continue
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        again = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        want.append((doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed))
    assert got == sorted(want)
    kept = quality_rules.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == quality_rules.judge_quality(df, model).where("kept").count()
    assert quality_rules.judge_quality(empty, quality_rules.fit_quality(empty)).count() == 0


def test_quality_agrees_with_labels(spark, documents):
    model = quality_rules.fit_quality(documents)
    judged = quality_rules.judge_quality(documents, model).join(spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id")
    good = judged.where("label = 1 AND NOT base_failed")
    assert good.where("kept").count() >= 0.97 * good.count()


# 9 -------------------------------------------------------------------------------


def test_license_base(odd, empty):
    extra = [(20, "Under the MIT-License, under THE mit license"), (21, "CC BY-NC 4.0, cc  by\nnc"), (22, "Licensed under the Apache License, Version 2.0."), (23, "GNU General Public License, version 3.")]
    rows = ODD + extra
    df = odd.sparkSession.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in license_scan.scan_licenses(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [p for p, _ in places]
        want = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert want in [tuple(r)[1:6] for r in got[doc]]
    assert "gpl-3" in got[23][0]["labels"] and got[4][0]["labels"] == "" and 0 < got[21][0]["score"] <= 1
    assert len(license_scan.signature_rules()) > 200
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_suppression():
    hits = license_scan.Scanner().rule_hits(" licensed under the gnu general public license version 3 or later ok ")
    assert [h[3] for h in hits] == ["gpl-3-or-later"]


def test_license_identifiers_and_containment():
    scan = license_scan.Scanner()
    samples = {
        "GPLv3": "gpl-3", "GPLv2+ or later": "gpl-2-or-later", "LGPLv2.1 or later": "lgpl-2.1-or-later", "Apache-2.0": "apache-2", "SPDX-License-Identifier: Apache-2.0": "apache-2", "SPDX-License-Identifier: MIT": "mit", "EUPL-1.2": "eupl-1.2",
        "Artistic-2.0": "artistic-2", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3-or-later", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "MPL-2.0": "mpl-2", "AGPL-3.0-only": "agpl-3",
        "Creative Commons Attribution 4.0 International": "cc-by-4.0", "CC BY-SA 3.0": "cc-by-sa-3.0", "Attribution-NonCommercial License": "cc-by-nc",
    }
    for text, label in samples.items():
        assert scan(text.encode())[5].split(",") == [label], text
    assert scan(b"the attribution of this painting to 4 0 masters")[5] == ""
    # a container of lower priority goes, overlaps in part stay
    scan.rules = [("k", "long", 1, re.compile("(?<= )a k b(?= )")), ("k", "short", 2, re.compile("(?<= )k(?= )")), ("k", "next", 1, re.compile("(?<= )b c(?= )"))]
    scan.keywords.clear()
    scan.keywords.add_word("k", [0, 1, 2])
    scan.keywords.make_automaton()
    assert [h[3] for h in scan.rule_hits(" a k b c ")] == ["short", "next"]


def test_license_long_text_is_linear():
    import time

    scan, spent = license_scan.Scanner(), []
    for n in (20_000, 80_000):
        began = time.process_time()
        found = scan(b"under the mit license gpl version 3 or later " * n)
        spent.append(time.process_time() - began)
        assert found[1] == n
    assert spent[1] < 10 * spent[0]


def test_license_gates_let_their_rules_pass():
    scan = license_scan.Scanner((("a phrase of the caller", "own"),))
    samples = {
        "do what the fuck you want to public license": "wtfpl", "do whatever you want to public licence": "wtfpl", "OpenRAIL-M": "openrail", "open rail": "openrail", "responsible AI license": "openrail",
        "library general public license": "lgpl", "open database commons open database license": "odbl", "Open Data Commons Open Database License": "odbl", "Mulan PSL": "mulan-psl", "a phrase of the caller": "own",
    }
    for text, label in samples.items():
        assert label in scan(text.encode())[5].split(","), text


# 10 ------------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        (1, "https://a.example.com/en/7?x", "com/en/"), (2, None, None), (3, "no scheme", None), (4, "HTTP://WWW.Example.COM/en/71#t", "example.com/en/7"), (5, "x://com/en/", "com/en/"), (6, "x://scom/en/", "com/en/"),
        (7, "ftp://b.net/de/", "net/de/"), (8, "ftp://example.net/de/8", "example.net/de/8"), (9, "https://cheap-pills.example.xx/", None), (10, "https://pornography.xx/", None), (11, "https://free.poker.xx/", None), (13, "https://free.win.xx/deals", None), (14, "https://free-download.click.xx/", None), (12, "https://free.xx/free", None), (12, "https://free.xx/free", None),
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u, _ in rows], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()}
    assert got[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("www.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[5][2:] == ("com/en/", "block") and got[6][2:] == (None, "allow")
    assert got[7][3] == "allow" and got[8][2:] == ("example.net/de/8", "block")
    assert [got[i][3] for i in (9, 10, 11, 12, 13, 14)] == ["block", "allow", "block", "allow", "allow", "block"]
    same = url_filter.RuleTable((("xx", "/abc", "block"), ("a.xx", "/a", "allow")))
    assert same("a.xx", "/abcd") == ("a.xx/a", "allow")  # equally long: the longer host
    assert url_filter.RuleTable((("xx", "/abcd", "block"), ("a.xx", "/a", "allow")))("a.xx", "/abcd") == ("xx/abcd", "block")
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_urls_equal_sql(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    theirs = con.execute(url_filter.oracle_sql()).fetchall()
    ours = [tuple(r) for r in url_filter.op10_url_filter(spark, SF).collect()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))


# pipeline --------------------------------------------------------------------------


def test_pipeline_stages(spark, documents):
    import corpus_pipeline

    docs, before = documents, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = Scratch(spark, "stage").write(stage(spark, docs, SF), "out")
        assert docs.columns == documents.columns
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before and after
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert all(c == k[1] for k, _, c in brute_components(left, 5, 80))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == after


def test_pipeline_stages_on_odd_tables(spark, odd, empty, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns and empty tables pass all stages."""
    import corpus_pipeline

    rich = odd.withColumn("lines_total", F.lit(3)).withColumn("component", F.lit("c")).withColumn("n_chars", F.length("text").cast("long"))
    for docs in (rich, rich.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = Scratch(spark, "odd").write(stage(spark, docs, SF), "out")
            assert docs.columns == rich.columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_near_copies_go_by_row(spark):
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (2, a + " end"), (2, b), (None, b + " end"), (None, None), (7, ""), (8, "c d"), (8, "c d"), (9, "e f")]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [(1, a), (2, b), (None, None), (7, ""), (8, "c d"), (9, "e f")]))


def test_digest_of_line_dedup(spark, documents):
    out = line_dedup.op7_line_dedup(spark, SF).where("lines_deleted = 0").collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert out and all(r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out)
