import random

import numpy as np

from draftloom.llm import bins, packing


def decode(tokens):
    encoder = packing.tokenizer(open(packing.VOCABULARY, "rb").read())
    return encoder.encoding.decode([int(t) for t in tokens])


def test_tokens_equal_whole_encoding():
    encoder = packing.tokenizer(open(packing.VOCABULARY, "rb").read())
    for text in ("", " ", "a b", "a  b", "a \n b", "\n\n x", "it's 12 o'clock,\tok ", "é ñ ß 漢字 <|endoftext|>", "a   b", " lead", "x " * 50):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.encoding.encode_ordinary(text)


def test_best_fit_equals_plain_search():
    rng = random.Random(1)
    for _ in range(20):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 200))]
        free, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fitting = [f for f in free if f >= lengths[i]]
            if fitting:
                free.remove(min(fitting))
                free.append(min(fitting) - lengths[i])
            else:
                free.append(64 - lengths[i])
            want.append(lengths[i])
        got = packing.best_fit_decreasing(lengths, 64)
        assert sorted(64 - sum(lengths[i] for i in b) for b in got) == sorted(free)
        assert sorted(i for b in got for i in b) == list(range(len(lengths)))


def test_matrix_holds_every_document(odd):
    rows = packing.pack_tokens(odd, length=256, buffer_ids=20_000).collect()
    parts = {}
    for r in rows:
        ids = packing.matrix([r.ids], 256)[0]
        assert r.cu_seqlens[-1] == r.n_tokens <= 256 and r.n_segments == len(r.doc_ids) and (ids[r.n_tokens:] == packing.END).all()
        places = packing.positions(r.position_resets, 256)
        for doc, part, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault((doc, part), []).append(tuple(ids[a:b]))
            assert places[a:b].tolist() == list(range(b - a))
    for doc in odd.select("doc_id", "text").distinct().collect():
        copies = len(parts[doc.doc_id, 0])
        assert copies == (2 if doc.doc_id == 4 else 1)
        tokens = [t for k in sorted(p for d, p in parts if d == doc.doc_id) for t in parts[doc.doc_id, k][0]]
        assert tokens[-1] == packing.END and decode(tokens[:-1]) == (doc.text or "")
    assert packing.pack_tokens(odd.limit(0)).count() == 0


def test_bins_are_whole_and_downsized(odd):
    rows = bins.pack_documents(odd, capacities=(16, 64, 256), buffer_words=5000).collect()
    parts = {}
    for r in rows:
        assert r.used == sum(r.lengths) == r.cu_lengths[-1] <= r.capacity
        assert r.capacity == min(c for c in (16, 64, 256) if c >= r.used)
        for doc, part, text, n in zip(r.doc_ids, r.parts, r.texts, r.lengths):
            assert len(text.encode().split()) == n
            parts.setdefault((doc, part), []).append(text)
    assert len(parts[4, 0]) == 2
    for doc in odd.select("doc_id", "text").distinct().collect():
        assert "".join(parts[doc.doc_id, k][0] for k in sorted(p for d, p in parts if d == doc.doc_id)) == (doc.text or "")
    assert bins.pack_documents(odd.limit(0)).count() == 0


def test_joint_choice_is_no_worse_than_any_single_length():
    rng = random.Random(2)
    for _ in range(10):
        lengths = [min(512, int(rng.expovariate(1 / 90)) + 1) for _ in range(300)]
        spent = sum(bins.cost(c) for c, _ in bins.pack(lengths, (64, 128, 512)))
        assert all(spent <= sum(bins.cost(c) for c, _ in bins.best_fit(lengths, (64, 128, 512), p)) for p in (64, 128, 512))
        assert spent <= sum(bins.cost(512) for _ in bins.best_fit(lengths, (512,)))
