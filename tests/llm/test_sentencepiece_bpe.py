import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from tickloom.llm import sentencepiece_bpe as op

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rnd = random.Random(7)
    letters = "ab \n\t▁ééçö中文😀\x00�   the er in re <0x41></s>"
    parts = ["aba", "ab", "a", "th", "he", "in", "ing", "g", "."]
    odd = ["", " ", "  ", "▁", "a" * 3000, " " * 2000, "ab" * 1500, "-" * 2000, "<s>", "͸\U000e0001x"]
    mixed = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 200))) for _ in range(400)]
    wide = ["".join(chr(rnd.choice([rnd.randint(1, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(60)) for _ in range(200)]
    return odd + mixed + wide + ["".join(rnd.choice(parts) for _ in range(150)) for _ in range(200)]


def test_equals_the_library():
    xs, enc = texts(), op.encoder(op.read_model(PATH))
    ids, counts = enc.encode(xs)
    expected = LIBRARY.encode(xs, num_threads=1)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for n, e in zip(counts.tolist(), ends.tolist(), strict=True)] == expected
    assert op.decode(enc.model, ids, counts) == LIBRARY.decode(expected)


def test_decoding_of_broken_bytes():
    model = op.encoder(op.read_model(PATH)).model
    rnd = random.Random(2)
    for _ in range(300):
        ids = [rnd.choice([rnd.randint(3, 258), rnd.randint(259, 31999)]) for _ in range(rnd.randint(1, 12))]
        assert op.decode(model, np.array(ids), np.array([len(ids)])) == [LIBRARY.decode(ids)]


def test_words_with_one_hash_are_told_apart():
    """The Thue-Morse word and its complement agree modulo 2 ** 64 under any odd base, in one batch and across batches."""
    pairs = []
    for letters in (1_024, 2_048, 4_096):
        word = "".join("ab"[bin(k).count("1") % 2] for k in range(letters))
        pairs += [word, word.translate(str.maketrans("ab", "ba"))]
    for batches in ([pairs], [[x] for x in pairs], [[x] for x in pairs[::-1]] + [pairs, pairs[::-1]]):
        enc = op.encoder(op.read_model(PATH))
        enc.clear()
        for xs in batches:
            ids, counts = enc.encode(xs)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == LIBRARY.encode(xs)
            assert op.decode(enc.model, ids, counts) == xs


def test_every_key_taken(monkeypatch):
    """With all words under one key at first, each finds a key of its own."""
    monkeypatch.setattr(op, "mix", lambda x: (x % op.U64(7)) * op.U64(3) + x // op.U64(1 << 61))
    xs = ["ab cd ef", "cd ab", "gh ab zz", "a b c d"]
    enc = op.Encoder(op.Model(op.read_model(PATH)))
    for _ in range(2):
        ids, counts = enc.encode(xs)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == LIBRARY.encode(xs)


def test_a_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(op, "CACHED_WORDS", 50)
    enc = op.Encoder(op.Model(op.read_model(PATH)))
    for x in texts()[:60]:
        assert enc.encode([x])[0].tolist() == LIBRARY.encode(x)


def test_memory_does_not_grow_with_the_batch():
    """A batch of 6 MB takes no more than 60 MB at a time besides the model."""
    rnd, serialized = random.Random(1), op.read_model(PATH)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(1, 9))) for _ in range(2000)]
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(rnd.choices(words, k=500)) for _ in range(2000)]})
    op.encoder(serialized)
    tracemalloc.start()
    try:
        total = sum(int(counts.sum()) for _, _, counts in op.encode_texts(serialized, batch, "text"))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert batch.nbytes > 5_500_000 and total == sum(map(len, LIBRARY.encode(batch["text"].to_pylist())))
    assert most < 60_000_000


def test_digests(frame, odd):
    rows = op.digests(frame(odd), PATH).collect()
    assert len(rows) == len(odd)
    for r, (k, t) in zip(sorted(rows, key=lambda r: (r.doc_id or 0, r.n_tokens)), sorted(odd, key=lambda x: (x[0] or 0)), strict=True):
        ids = LIBRARY.encode(t or "")
        assert (r.doc_id, r.n_tokens) == (k, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_columns(frame):
    out = op.encode_column(frame([(1, "hello world"), (2, None)], ids="clash"), PATH)
    assert {r.doc_id: r.ids for r in out.collect()} == {1: LIBRARY.encode("hello world"), 2: []}
    counted = op.count_column(frame([(1, "hello world")]), PATH).collect()[0]
    assert counted.n_tokens == len(LIBRARY.encode("hello world")) and counted.source == "s"
    assert op.count_column(frame([]), PATH).count() == 0
