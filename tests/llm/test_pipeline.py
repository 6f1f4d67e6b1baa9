"""The pipeline's stages: each against brute force on what its predecessor kept, clean documents kept."""

import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_operators import groups, words_of

from weftline.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows before, rows after) of every stage but the last, and the pieces."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.staged(stage(spark, docs, SF), "t")
        assert after.columns == corpus_pipeline.COLUMNS
        out.append((name, {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}))
        docs = after
    return {n: (b, a) for n, b, a in out}, docs, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_clean_documents_stay(stages):
    for before, after in stages[0].values():
        assert 0.7 * len(before) < len(after) <= len(before) and after.keys() <= before.keys()


def test_toxicity(spark, stages):
    before, after = stages[0]["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = before.keys() - after.keys()
    clean = [d for d in before if labels.get(d) == 0]
    assert sum(d in gone for d in clean) <= 0.02 * len(clean)  # so few labels may single out nothing at all
    assert all(before[d].text == after[d].text for d in after)


def test_line_dedup(stages):
    before, after = stages[0]["line_dedup"]
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, r in before.items():
        for line in (r.text or "").split("\n"):
            held[key(line)].add(d)
    for d, r in before.items():
        kept = [x for x in (r.text or "").split("\n") if len(key(x)) < 40 or len(held[key(x)]) < 5 or max(held[key(x)]) == d]
        assert after[d].text == "\n".join(kept) and after[d].n_chars == len(after[d].text)


def test_near_duplicates(stages):
    before, after = stages[0]["minhash"]
    want = groups([(d, r.text) for d, r in before.items()], 80)
    assert set(after) == {d for d, (_, root) in want.items() if d == root}


def test_decontamination(spark, stages):
    before, after = stages[0]["decontamination"]
    plain = lambda t: " ".join(words_of(re.sub("[^a-z ]+", " ", (t or "").lower())))
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 5]) for x in items for w in [x.split()] for i in range(len(w) - 4)}
    for d, r in before.items():
        text = plain(r.text)
        if any(f" {x} " in f" {text} " for x in items if len(x.split()) >= 5):
            assert d not in after
        if d not in after:  # slots aside, a document that goes shares words with an item
            w = text.split()
            assert any(tuple(w[i : i + 3]) == x[:3] or tuple(w[i : i + 3]) == x[2:] for i in range(len(w) - 2) for x in windows if x[0] == w[i] or x[2] == w[i])


def test_packing(stages):
    _, docs, pieces = stages
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    for r in docs.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
        own = sorted(by[r.doc_id], key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own]).tolist()][:-1] and sum(p.length for p in own) == n == own[0].doc_tokens
    rooms = defaultdict(list)
    for p in pieces:
        rooms[p.sequence_id].append(p)
    for own in rooms.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own]).tolist()][:-1] and sum(p.length for p in own) <= 4096


def test_packing_keeps_few_words_and_packs_the_same(spark, monkeypatch):
    """A worker's words stay within the bound it is given, here below those of the texts, and ids and pieces are the same."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in docs.select("text").collect()]
    few, many = packing.Encoder(path, 400), packing.Encoder(path)
    for t in texts:
        assert few.ids(t).tolist() == many.ids(t).tolist()
        assert len(few.cache) <= max(200, len(set(many._words(t) or []))) + 200
    rows = lambda **k: sorted(map(tuple, packing.pack_documents(docs, path, **k).collect()))
    assert rows(words=400) == rows()
    given = {}
    monkeypatch.setattr(corpus_pipeline.packing, "pack_documents", lambda *a, **k: given.update(k))
    corpus_pipeline.pack(spark, docs, SF)
    assert given["words"] < packing._CACHE_WORDS
