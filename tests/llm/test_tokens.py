"""Token shards, packing and counts against the libraries."""

import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tests.llm.conftest import docs_of, found  # noqa: E402
from tracery.llm import packing, sstable, token_counts  # noqa: E402
from tracery.llm.encoding import Encoder  # noqa: E402

PIECES = [" ", "  ", "\n", "\n\n", "\t", "a", "The", "the.", "it's", "'", "é", "É,", "漢", "😀", "12", "!", "...", "́", " ", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "Σ", "ﬁ", "_", "​", "İ", "▁", "\x00", "<s>"]


def odd_strings(seed, n=3000):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(25))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name, odd_texts):
    from tokenizers import Tokenizer

    texts = odd_strings(1) + [t or "" for t in odd_texts]
    library, own = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name))
    for _ in range(2):
        got = own.encode([t.encode() for t in texts])
        assert [np.frombuffer(g, own.dtype).tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_with_any_marks_ask_the_model_directly(name):
    from tokenizers import Tokenizer

    rng, marks = random.Random(6), [chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<"]
    words = [w + "".join(rng.choice(marks) for _ in range(n)) for w in ("haedon", "Théranble", "É", "s") for n in (1, 1, 2, 3, 5, 9)] + ["haedon" + m for m in marks]
    own, library = Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    text = "x " + " ".join(words)
    own.encode([b"x"])
    own.library = None
    assert np.frombuffer(own.encode([text.encode()])[0], own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("change", ["cased", "prefix", "plain"])
def test_other_vocabularies_are_encoded_whole(tmp_path, change, odd_texts):
    """A cased word vocabulary, one that puts a space first, and one that cuts at nothing: cuts could be wrong there."""
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json" if change == "prefix" else "word_bpe_49k.json"), encoding="utf-8").read())
    if change == "prefix":
        spec["pre_tokenizer"]["add_prefix_space"] = True
    elif change == "cased":
        spec["normalizer"]["normalizers"].pop()
    else:
        spec["pre_tokenizer"] = spec["pre_tokenizer"]["pretokenizers"][1]
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    library, own = Tokenizer.from_file(path), Encoder(path)
    assert own.kind is None
    texts = odd_strings(5, 300) + [t or "" for t in odd_texts]
    got = own.encode([t.encode() for t in texts])
    assert [np.frombuffer(g, own.dtype).tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_models_are_not_counted(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="byte fallback"):
        token_counts.MergeCounter(str(path))


def test_shards_of_other_identifiers(spark, tmp_path):
    docs = spark.sql("select cast(id as decimal(10,2)) doc_id, concat('text ', id) text from range(30)")
    manifest = sstable.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), 1, f"file://{tmp_path}/decimal")
    got = sstable.read_shards(manifest, docs.schema["doc_id"].dataType)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted(int(r["doc_id"]) for r in got.collect()) == list(range(30))


def test_counts_equal_library(spark, odd_texts):
    import sentencepiece

    texts = odd_strings(2) + odd_texts
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = found(token_counts.count_tokens(docs_of(spark, texts), public_tokenizers.path("piece_bpe_32k.model"), limit=20))
    expected = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 20) for i, t in enumerate(texts)]
    assert got == expected
    assert token_counts.count_tokens(docs_of(spark, []), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_shards_round_trip(spark, tmp_path, odd_texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = odd_strings(3, 400) + odd_texts
    ids = [*range(-5, len(texts) - 9), None, None, 7, 7]
    docs = docs_of(spark, texts, ids).repartition(3)
    manifest = sstable.write_shards(docs, path, 1, f"file://{tmp_path}/shards", shard_bytes=4096)
    assert manifest.count() > 4
    library = Tokenizer.from_file(path)
    tokens = {}
    for i, t in zip(ids, texts, strict=True):
        tokens.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    got = sstable.read_shards(manifest, docs.schema["doc_id"].dataType).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(ids, key=lambda x: (x is not None, x or 0))
    at = 0
    crc = lambda v: zlib.crc32(np.array(v, "<u4").tobytes())
    for r in got:
        assert r["start"] == at
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(v), crc(v)) for v in tokens[r["doc_id"]]]
        at += r["n_tokens"]
    shards = [sstable.open_shard(r["path"]) for r in manifest.collect()]
    for want in (-5, 0, 7, 200, None):
        seen = [v.tolist() for s in shards for v in s.find(want)]
        assert sorted(seen) == sorted(tokens[want])
    assert not [v for s in shards for v in s.find(10_000)]
    assert sum(s.may_hold(x) for s in shards for x in range(20_000, 20_500)) < 0.05 * 500 * len(shards)


def test_no_documents_no_shard(spark, tmp_path):
    manifest = sstable.write_shards(docs_of(spark, []), public_tokenizers.path("word_bpe_49k.json"), 1, f"file://{tmp_path}/none")
    assert manifest.count() == 0 and sstable.read_shards(manifest, docs_of(spark, []).schema["doc_id"].dataType).count() == 0


def test_text_keys_and_damage(tmp_path):
    keys = sorted(["", "a", "a\x00", "a\x00b", "ab", "é"], key=lambda k: k.encode())
    assert [sstable.key_id(sstable.id_key(k) + b"\0\0\0\0", True) for k in keys] == keys
    assert sorted(map(sstable.id_key, keys)) == [sstable.id_key(k) for k in keys]
    assert sorted(map(sstable.id_key, (-3, 0, 5, 1 << 40))) == [sstable.id_key(x) for x in (-3, 0, 5, 1 << 40)]
    name = str(tmp_path / "one.sst")
    with pafs.LocalFileSystem().open_output_stream(name) as out:
        writer = sstable.ShardWriter(out, 2)
        for i in range(100):
            writer.add(sstable.id_key(i) + b"\0\0\0\0", bytes([i, 0]))
        writer.close()
    data = bytearray((tmp_path / "one.sst").read_bytes())
    data[40] ^= 1
    (tmp_path / "one.sst").write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.open_shard(f"file://{name}"))


@pytest.mark.parametrize("seed", range(6))
def test_plans_fill_sequences(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1024, 100, 7])
    counts = {n: rng.choice([0, 1, 2, 5, 100]) for n in rng.sample(range(1, capacity + 1), min(capacity, 60))}
    used, placed = {}, dict.fromkeys(counts, 0)
    for length, low, high, sequence, each, offset in packing.plan(counts, capacity):
        assert low == placed[length]
        placed[length] = high
        for k in range(high - low):
            used.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
    assert placed == counts
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(n * k for n, k in counts.items())
    assert sorted(used) == list(range(len(used)))
    large = sum(k for n, k in counts.items() if 2 * n > capacity)
    assert len(used) <= max(large, -(-total // capacity)) * 1.25 + 2


def test_packing(spark, odd_texts):
    from tokenizers import Tokenizer

    texts = odd_strings(4, 300) + odd_texts + ["one two three"] * 5
    ids = [*range(len(texts) - 2), None, 3]
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs_of(spark, texts, ids).repartition(3), path, 2, 256).collect()
    library = Tokenizer.from_file(path)
    crc = lambda v: zlib.crc32(np.array(v, "<u4").tobytes())
    expected = []
    for i, t in zip(ids, texts, strict=True):
        v = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        start, stop, piece = 0, len(v) % 256 or min(len(v), 256), 0
        while start < len(v):
            expected.append((i, piece, start, stop - start, crc(v[start:stop])))
            start, stop, piece = stop, stop + 256, piece + 1
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got) == sorted(map(str, expected))
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(used) <= 1.05 * sum(e[3] for e in expected) / 256 + 2
    assert packing.pack(docs_of(spark, []), path, 2).count() == 0
