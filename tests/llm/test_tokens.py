import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, chunks, packing, shared, token_counts, token_files

BYTES, WORDS = chunks.vocabulary("byte_bpe_50k.json"), chunks.vocabulary("word_bpe_49k.json")


def ids_of(path, texts, plain=False):
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = plain
    return [e.ids for e in made.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    letters = [*"abcdeABC 019 '\n\t.,!$ 　é́ßñ日本 \x1c\x85😀<|>", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "  ", "\r\n", "hello", "aaaa"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["a" * n for n in range(1, 60)] + ["", None, " "]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_give_the_ids_of_whole_texts(odd_texts, path, monkeypatch):
    monkeypatch.setattr(chunks, "MOST_CHUNKS", 500)
    made = chunks.library_encoder.__wrapped__(path)
    for _ in range(2):
        ids, begins = made.encode(pa.array(odd_texts))
        assert [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == ids_of(path, odd_texts)


def test_backtracking_gives_exact_merges(odd_texts):
    vocabulary = bpe.vocabulary(BYTES)
    assert [vocabulary.encode(t or "") for t in odd_texts] == ids_of(BYTES, odd_texts)


def test_round_trip_query(corpus, docs, nothing):
    texts = dict(corpus)
    hf = Tokenizer.from_file(BYTES)
    for r in bpe.round_trip(docs, BYTES, outputs=True).collect():
        ids = ids_of(BYTES, [texts[r["doc_id"]]])[0]
        told = hf.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(told.encode()).hexdigest())
        assert r["ids"] == ids and r["decoded"] == told
    assert bpe.round_trip(nothing, BYTES).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 20_000))
    made = token_files.PerfectHash.of(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
    again, used = token_files.PerfectHash.from_bytes(made.to_bytes() + b"more")
    assert used == len(made.to_bytes()) and (again.slots(keys) == made.slots(keys)).all()
    assert len(token_files.PerfectHash.of(np.zeros(0, np.int64)).slots(keys)) == len(keys)


def test_token_files(spark, corpus, docs, nothing):
    folder = shared.fresh_folder(spark, "t")
    shards = token_files.write(docs, folder, WORDS, end_id=2)
    want, start = [], 0
    for (i, _), ids in zip(corpus, ids_of(WORDS, [t for _, t in corpus]), strict=True):
        want.append((i, start, len(ids) + 1, crc([*ids, 2])))
        start += len(ids) + 1
    assert sorted(map(tuple, token_files.read(shards).collect())) == want
    shard = token_files.Shard(shards.orderBy("part").first()["uri"])
    assert crc(shard.get(int(shard.keys[0]))) == want[0][3] and shard.get(10**12) is None
    assert token_files.read(token_files.write(nothing, shared.fresh_folder(spark, "t"), WORDS, 2)).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "b c"), (None, "d")], "doc_id long, text string")
    assert [r["doc_id"] for r in token_files.read(token_files.write(twice, shared.fresh_folder(spark, "t"), WORDS, 2)).orderBy("start").collect()] == [None, 1, 1]


def test_first_fit_decreasing():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2048, 700)
    where, place = packing.first_fit_decreasing(lengths, 2048)
    bins = []
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, used in enumerate(bins) if used + lengths[i] <= 2048), len(bins))
        bins += [0] * (k == len(bins))
        assert (where[i], place[i]) == (k, bins[k])
        bins[k] += lengths[i]


def test_packing(corpus, docs, nothing):
    full = {i: [*ids, 1] for (i, _), ids in zip(corpus, ids_of(BYTES, [t for _, t in corpus]), strict=True)}
    rows = packing.pack(docs, BYTES, end_id=1, room=256, with_ids=True).collect()
    parts, sequences = {}, {}
    for r in rows:
        assert r["ids"] == full[r["doc_id"]][r["start"] : r["start"] + r["length"]] and crc(r["ids"]) == r["ids_crc32"] and r["doc_tokens"] == len(full[r["doc_id"]])
        parts.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert parts.keys() == full.keys()
    for pieces, limit in [*((p, len(full[i])) for i, p in parts.items()), *((s, 256) for s in sequences.values())]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at <= limit
    assert sum(n for p in parts.values() for _, n in p) == sum(map(len, full.values()))
    assert packing.pack(nothing, BYTES, 1).count() == 0


@pytest.mark.parametrize("block", [2, 64, 1 << 20])
def test_separator_scan(spark, tmp_path, block):
    rng = np.random.default_rng(5)
    stream = np.where(rng.random(700) < 0.1, 9, rng.integers(10, 99, 700)).astype("<u2")
    stream[-1] = 50
    files = []
    for k, part in enumerate(np.split(stream, [0, 120, 121, 400])):
        (tmp_path / f"{k}").write_bytes(part.tobytes())
        files.append((str(tmp_path / f"{k}"), part.nbytes))
    ends = np.flatnonzero(stream == 9)
    want = [(i, int(n), True) for i, n in enumerate(np.diff(ends, prepend=-1))] + [(len(ends), len(stream) - int(ends[-1]) - 1, False)]
    got = sorted(map(tuple, token_counts.count_tokens(spark, files, 9, block).collect()))
    assert got == want


def test_documents_counted(corpus, docs, nothing):
    want = {i: len(ids) + 1 for (i, _), ids in zip(corpus, ids_of(BYTES, [t for _, t in corpus], plain=True), strict=True)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.documents_counted(docs, BYTES, 50256, block=4096).collect()} == want
    assert token_counts.documents_counted(nothing, BYTES, 50256).count() == 0
