"""Alignment, centroids and token-id files against brute force, and on awkward tables."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokenizers_of
import pytest
from pyspark.sql import functions as F

from weftline.llm import alignment, centroids, token_files, token_units
from weftline.llm.shared import new_path

SF = "/root/testdata/sf0.001"
A, B = tokenizers_of.path("byte_bpe_50k.json"), tokenizers_of.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, block long, n_a long, grp string, start long, ids string"
HARD = [
    "", " ", "\n", "a b", "a  b", "a   b", "a\n\nb", "a \n b", " lead", "tail ", "tail\n", "a\tb\r\nc", "x<|endoftext|>y z <|endoftext|>", "é é ﬁ ß ÀŽ", "漢字 かな、、、、", "😀😀 👩‍👩‍👧", "a b c d",
    "x▁y ▁", "it's we'll DON'T 'S", "123 4567 1,234.5", "<s> </s> <unk> <0x41>", "a\x00b", "\x00", "\x1c \x1d", "᠎ z", "w " * 3000 + "w", "aaaaaaaaaaaaaaaaaaaaaaaa" * 50, "one\ntwo three\nfour", "﻿bom", "...!!!???---", "a​b",
    "\u0085 x", "ÿþ ŀ", "word" * 3 + "\nnext", "\n\n\nx", "x\n\n\n y",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(None, None), (None, "lost"), (3, "again"), (3, "again"), (-5, "below zero"), (7, None)]
    return spark.createDataFrame([(i, t, "en", 1, 2, "g", 3, "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _tokenizer(plain):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = plain
    return tok


def _mixed(n, seed=1):
    rng = random.Random(seed)
    parts = ["word", "é", " ", "\n", "  ", "'s", "12", ",", ".", "漢", "😀", "The", "zzz", "-", "\t", "ing", "▁", "ſ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_unit_ids_equal_the_tokenizers():
    enc, tok = token_units.UnitIds(A, "<u4"), _tokenizer(False)
    texts = HARD + _mixed(3000)
    for t, raw in zip(texts, enc.many(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_unit_cache_forgets(monkeypatch):
    monkeypatch.setattr(token_units, "CACHE_UNITS", 20)
    enc, tok = token_units.UnitIds(A, "<u2"), _tokenizer(False)
    for k in range(20):
        texts = [f"alpha beta{k} gamma{k}\ndelta{k} eps{k * k}", "alpha"]
        assert [np.frombuffer(x, "<u2").tolist() for x in enc.many(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(enc.cache) < 40


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], [2**40], [1, 2, 3, 900, 900, 901, 2**33], list(range(5000)), sorted(random.Random(3).randrange(2**63) for _ in range(70_000)), [0] * 1000 + [2**64 - 1] * 1000])
def test_elias_fano(values):
    low, *sections = token_files.EliasFano.pack(np.array(values, np.uint64))
    data = b"".join(sections)
    seq = token_files.EliasFano(lambda at, n: data[at : at + n], len(values), low, tuple(map(len, sections)))
    assert seq.get(0, len(values)).tolist() == values
    for k in random.Random(1).sample(range(len(values)), min(40, len(values))):
        assert seq.get(k, k + 1).tolist() == [values[k]] and seq.get(k, min(k + 300, len(values))).tolist() == values[k : k + 300]
    if len(values) > 1000:
        assert 8 * len(data) <= len(values) * (3 + max(1, values[-1].bit_length() - len(values).bit_length() + 1) + 32 / token_files.SAMPLE) + 64


def _ids_by_hand(rows):
    tok = _tokenizer(False)
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_op13_brute_force(spark, docs):
    got = [tuple(r) for r in token_files.op13_token_files(spark, SF).collect()]
    assert sorted(got) == sorted(_ids_by_hand(docs.select("doc_id", "text").collect()))


@pytest.mark.parametrize("file_tokens", [1, 50, 10**9])
def test_op13_awkward(spark, odd, monkeypatch, file_tokens):
    monkeypatch.setattr(token_files, "RUN", 7)
    folder = new_path(spark, "ids-test")
    index = token_files.write_ids(odd, A, folder, file_tokens)
    got = token_files.read_ids(index, folder, keep_ids=True).orderBy("start").collect()
    want = _ids_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    assert [r.doc_id for r in got] == [w[0] for w in want] and sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(w[0]), w[2], w[3]) for w in want)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.ids[-1] == 2 for r in got)


def test_op13_few_files_and_shared_reading(spark, odd, monkeypatch):
    """The index is one file however many tasks write ids, and reading is dealt out by ids, not by the index's bytes."""
    monkeypatch.setattr(token_files, "READ_TOKENS", 2000, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = new_path(spark, "ids-few")
        index = token_files.write_ids(odd, A, folder, 50)
        assert len({r.file[:10] for r in index.select("file").collect()}) > 1  # several tasks wrote
        assert len(index.inputFiles()) == 1
        total = sum(w[2] for w in _ids_by_hand([(r.doc_id, r.text) for r in odd.collect()]))
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        got = token_files.read_ids(index, folder)
        assert got.rdd.getNumPartitions() == 1 + total // 2000 > 1
        assert got.count() == odd.count() and got.agg(F.sum("n_tokens")).first()[0] == total
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_op13_empty(spark, odd):
    folder = new_path(spark, "ids-empty")
    assert token_files.read_ids(token_files.write_ids(odd.limit(0), A, folder), folder).count() == 0


def _align_by_hand(rows):
    import sentencepiece

    tok, pieces = _tokenizer(True), sentencepiece.SentencePieceProcessor(model_file=B)
    names = {k: v for v, k in tok.get_vocab().items()}
    to_byte = token_units.byte_table()
    cut, per = [], defaultdict(int)
    for d, t in rows:
        groups = []
        if t:
            a, b = tok.encode(" " + t, add_special_tokens=False).ids, pieces.encode(t)
            raw_a = [b"<|endoftext|>" if i == 50256 else bytes(to_byte[c] for c in names[i]) for i in a]
            raw_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [pieces.id_to_piece(i)]]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
                i = j = i0 = j0 = na = nb = 0
                while i < len(a):
                    na, i = na + len(raw_a[i]), i + 1
                    while nb < na:
                        nb, j = nb + len(raw_b[j]), j + 1
                    while nb > na:
                        na, i = na + len(raw_a[i]), i + 1
                        while nb < na:
                            nb, j = nb + len(raw_b[j]), j + 1
                    groups.append((a[i0:i], b[j0:j]))
                    i0, j0 = i, j
        cut.append((d, groups))
        for pair in {(x, y) for g in groups for x in g[0] for y in g[1]}:
            per[pair] += 1
    best = defaultdict(int)
    for (x, _), n in per.items():
        best[x] = max(best[x], n)
    for d, groups in cut:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        yield (d, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(per[p] == best[p[0]] for p in links), sum(per[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "")


def test_op11_brute_force(spark, docs):
    got = Counter(tuple(r) for r in alignment.op11_alignment(spark, SF).collect())
    assert got == Counter(_align_by_hand(docs.select("doc_id", "text").collect()))


@pytest.mark.parametrize("block_chars, at_once", [(1, 8_000_000), (300, 10), (10**7, 100)])
def test_op11_awkward(spark, odd, block_chars, at_once):
    extra = spark.createDataFrame([(100 + k, t, "", 0, 0, "", 0, "") for k, t in enumerate(_mixed(150, 5))], SCHEMA)
    rows = odd.unionByName(extra).coalesce(2)
    # Slices of pairs are set where the tasks read it: in the function they run.
    counted = alignment._count_pairs
    try:
        alignment.PAIRS_AT_ONCE = at_once
        got = Counter(tuple(r) for r in alignment.align(rows, A, B, block_chars).collect())
        model = alignment.Groups(A, B)
        parts = list(alignment._block(model, 0, [1, 2], ["one two 漢字 three", "two 漢字漢字 ing"]))
    finally:
        alignment.PAIRS_AT_ONCE = 8_000_000
    assert got == Counter(_align_by_hand([(r.doc_id, r.text) for r in rows.collect()]))
    pairs = [p for b in parts for p in b.to_pylist() if p["kind"] == "pair"]
    assert len({(p["a"], p["b"]) for p in pairs}) == len(pairs) and counted is alignment._count_pairs


def test_op11_empty(spark, odd):
    assert alignment.align(odd.limit(0), A, B).count() == 0
    assert {r.n_links for r in alignment.align(odd.where("text is null"), A, B).collect()} == {0}


def _lloyd(rows, k=40, rounds=5, dims=64, scale=256):
    import math

    def whole(v):
        return int(v * scale // 1) if abs(v) < 2.0**900 else int(v) * scale

    kept = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    assign = lambda: [min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, c[j], strict=True)), j)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    return [(i, a, sum((x - y) ** 2 for x, y in zip(v, c[a], strict=True))) for (i, v), a in zip(kept, at, strict=True)], c


def test_op12_sql_is_lloyd(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = con.sql(centroids.OP12_SQL + " ORDER BY vec_id").fetchall()
    got = centroids.op12_centroids(spark, SF).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == want
    hand, c = _lloyd([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])
    assert [(r.vec_id, r.cluster, r.distance) for r in got] == sorted(hand)
    assert {r.cluster: r.centroid_sha256 for r in got}.items() <= {j: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for j, v in enumerate(c)}.items()


def test_op12_awkward(spark):
    rng = random.Random(2)
    base = [[rng.choice([0.0, 0.5, -0.25]) for _ in range(4)] for _ in range(6)]
    rows = [(k, base[k % 6]) for k in range(60)]  # ties and copies of copies
    rows += [(None, base[0]), (7, base[1]), (7, base[2]), (80, None), (81, []), (82, [1.0] * 5), (83, [1.0, None, 0.0, 0.0]), (84, [float("nan")] * 4), (85, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(90, [3e38, -3e38, 1.0, 0.0]), (91, [2.0**70, 1.0, 1.0, 1.0]), (92, [1e6 + 0.001, 2.0, 3.0, 4.0]), (93, [-1e6, 2.0, 3.0, 4.0]), (94, [1e300, 1e308, 0.0, -1e308]), (95, [2.0**40, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(5)
    for k, rounds in ((5, 3), (40, 2), (200, 1)):
        got, c = centroids.cluster(df, k, rounds, 4)
        want, own = _lloyd(rows, k, rounds, 4)
        assert c.tolist() == own
        short = lambda r: (str(r[0]), r[1], r[2] if r[2] is not None and r[2] < 1 << 63 else None)
        assert Counter(map(short, (tuple(r) for r in got.collect()))) == Counter(map(short, want))
    assert centroids.cluster(df.limit(0), 3, 2, 4)[0].count() == 0 and centroids.cluster(df.where("vec_id = 80"), 3, 2, 4)[0].count() == 0


def test_op12_intervals_hold_the_truth():
    rng = np.random.default_rng(4)
    for size in (3, 200, 1 << 20, 1 << 26):
        x, c = rng.integers(-size, size + 1, (500, 64)), rng.integers(-size, size + 1, (40, 64))
        c[7], c[9], x[0] = c[3], c[3] + np.eye(64, dtype=np.int64)[5], c[3]
        d = ((x[:, None, :] - c) ** 2).sum(2)
        near = centroids.shortlist(x, c)
        assert near[np.arange(500), d.argmin(1)].all()
        at, dist = centroids.nearest(x, c)
        assert (at == d.argmin(1)).all() and (dist == d.min(1)).all()
    assert near.sum(1).mean() < 3  # nearly all are decided by the screen


def test_op12_plan_has_one_pass_and_small_shuffles(spark):
    v = F.col("embedding").cast("array<double>")
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where(centroids.usable(v, 64)).select("vec_id", v.alias("v"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "label" not in plan.split("ReadSchema")[1]


def test_byte_table_is_a_bijection():
    table = token_units.byte_table()
    assert sorted(table.values()) == list(range(256)) and base64.b64encode(bytes(sorted(table.values())))
