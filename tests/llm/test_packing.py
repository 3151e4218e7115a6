import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from atlaspark.llm import packing, shards, tokens


def reference_ids(text):
    return [*Tokenizer.from_file(tokens.vocabulary_path()).encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_tokenizer():
    coder, plain = tokens.Encoder(), Tokenizer.from_file(tokens.vocabulary_path())
    r = random.Random(5)
    letters = list("\x1c\x00ab'ßéŠſ \t\n\x0b1²!_-<|>sSİıŉ日́")
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(2000)] + ["<|endoftext|> a's''s", "it'S we'LL"]
    for t in texts:
        assert np.frombuffer(coder.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION", 3)
    coder, plain = tokens.Encoder(), tokens.Encoder()
    for t in ("a b c", "c d e f g", "a b", "h", "c d a"):
        monkeypatch.setattr(tokens, "GENERATION", 3)
        got = coder.ids(t)
        monkeypatch.setattr(tokens, "GENERATION", 1000)
        assert got == plain.ids(t)


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_every_piece_once(seed):
    r = np.random.default_rng(seed)
    sizes = np.maximum(1, r.lognormal(6, 1.2, 3000).astype(int)) if seed % 2 else r.integers(1, [3000, 40, 100][seed // 2], 3000)
    h = Counter(c for n in sizes.tolist() for c in packing.cut_points(n, 2048, 32))
    plan, at = packing.make_plan(dict(h)), defaultdict(list)
    for length, rows in plan.items():
        rank = 0
        for first, n, sequence, offset in rows:
            assert first == rank
            rank += n
            for i in range(n):
                at[sequence + i].append((offset, length))
        assert rank == h[length]
    assert set(at) == set(range(len(at)))
    padding = 0
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
        padding += 2048 - end if end & (end - 1) else 0
    assert padding <= 2048 + 0.05 * 2048 * len(at)


def test_nnls():
    a = np.array([[1.0, 0.0, 1.0], [0.0, 1.0, 1.0]])
    assert np.allclose(a @ packing.nnls(a, np.array([3.0, 5.0])), [3, 5])
    assert (packing.nnls(a, np.array([-1.0, 2.0])) >= 0).all()


def test_pack(spark, odd_documents):
    rows = packing.pack(odd_documents).collect()
    want = Counter()
    for d in odd_documents.collect():
        ids = reference_ids(d.text)
        want[d.doc_id, len(ids)] += len(ids)
    assert Counter({k: sum(r.length for r in rows if (r.doc_id, r.doc_tokens) == k) for k in want}) == want
    long = reference_ids(next(d.text for d in odd_documents.collect() if d.doc_id == 5))
    for r in rows:
        if r.doc_id == 5:
            assert r.ids_crc32 == zlib.crc32(np.array(long[r.start : r.start + r.length], "<u4").tobytes())
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        assert end <= 2048
    assert packing.pack(odd_documents.limit(0)).count() == 0


def permuted(p):
    """All numbers of a permutation, permuted, in order."""
    at, chunk = (x.ravel() for x in np.meshgrid(np.arange(p.span), np.arange(1 << p.chunk_bits), indexing="ij"))
    left, right = p.halves(at, chunk)
    return [int(a) << p.half | int(b) for a, b in zip(left, right, strict=True)]


def test_permutation():
    for span in (1, 2, 3, 100, 1000, 4097):
        for bits in (0, 1, 3, 8):
            p = shards.Permutation(span, bits)
            assert sorted(permuted(p)) == list(range(span << p.chunk_bits))
    assert permuted(shards.Permutation(1000, 0, b"a")) != permuted(shards.Permutation(1000, 0, b"b"))


def test_wide_ids_are_written_in_permuted_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_BYTES", 1 << 10)
    ids = [-(2**63), -9 * 10**18, *range(40), 9 * 10**18, 2**63 - 1]
    rows = [(i, "some words " * (n % 7 * 120)) for n, i in enumerate(ids)] + [(None, f"without {n}") for n in range(60)]
    out = shards.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), str(tmp_path / "w")).collect()
    assert sorted(x.slot for x in out) == list(range(len(out)))
    p = shards.Permutation(2**64, (max(len(t) for _, t in rows) // shards.SEQUENCE).bit_length())
    known = [x for x in sorted(out, key=lambda x: x.slot) if x.doc_id is not None]
    left, right = p.halves(np.array([x.doc_id + 2**63 for x in known], np.uint64), np.array([x.chunk for x in known], np.uint64))
    place = list(zip(left.tolist(), right.tolist(), strict=True))
    assert place == sorted(place) and len({x.shard for x in out}) > 5
    assert len({x.shard for x in out if x.doc_id is None}) > 5
    assert not list((tmp_path / "w").glob("_*"))


def test_shards_hold_every_sequence(spark, odd_documents, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SHARD_BYTES", 1 << 14)
    out = shards.write_shards(odd_documents, str(tmp_path / "s"))
    rows = out.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    want, got = Counter(), Counter()
    for d in odd_documents.collect():
        ids = reference_ids(d.text)
        for c in range(-(-len(ids) // shards.SEQUENCE)):
            want[-1 if d.doc_id is None else d.doc_id, c, tuple(ids[shards.SEQUENCE * c : shards.SEQUENCE * (c + 1)])] += 1
    place = {(r.shard, r.record): r for r in rows}
    for s in {r.shard for r in rows}:
        for n, (doc_id, chunk, ids) in enumerate(shards.read_records(str(tmp_path / "s"), s)):
            got[doc_id, chunk, tuple(ids.tolist())] += 1
            r = place[s, n]
            assert (r.chunk, r.length, r.ids_crc32) == (chunk, len(ids), zlib.crc32(ids.tobytes()))
    assert got == want and len({r.shard for r in rows}) > 1
    s = rows[0].shard
    every = list(shards.read_records(str(tmp_path / "s"), s))
    assert [x[:2] for x in shards.read_records(str(tmp_path / "s"), s, 1, 2)] == [x[:2] for x in every[1:3]]
    assert shards.write_shards(odd_documents.limit(0), str(tmp_path / "e")).count() == 0
