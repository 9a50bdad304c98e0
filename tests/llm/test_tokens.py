import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from samples import texts

from grove.llm import bpe, segments, token_store
from grove.llm.scratch import Scratch

ODD = ["", " ", "  ", " a", "a ", "a  b", "\na", "a\n b", "a \n", " \x00", "x\x00 y", "a,b ,c", "!!, x", "é a", "　 a", "a\u0085 b", "  lead"]


def test_words_give_back_the_text():
    all_texts = [t for _, t in texts() if t] + ODD
    words, offsets, order = segments.cut(pa.array(all_texts))
    words = words.to_pylist()
    back = ["".join(words[a:b]) for a, b in zip(offsets, offsets[1:])]
    assert [back[i] for i in order] == all_texts


def test_forgets_and_still_encodes():
    encoder = segments.WordEncoder(lambda part: [x.encode() for x in part], 5)
    all_texts = [t for _, t in texts() if t]
    assert encoder(pa.array(all_texts))[0].to_pylist() == [t.encode() for t in all_texts]
    assert encoder(pa.array(all_texts[::-1]))[0].to_pylist() == [t.encode() for t in all_texts[::-1]]
    assert encoder(pa.array([None, "a b"]))[0].to_pylist() == [b"", b"a b"]
    assert encoder(pa.array([], pa.string()))[0].to_pylist() == []
    assert len(encoder.values.young) <= 5 + len(set(" ".join(all_texts).split()))


def test_slices_are_bounded_and_whole():
    batch = pa.record_batch([pa.array(["x" * n if n >= 0 else None for n in (5, 50, -1, 3, 3, 3, 90)])], ["t"])
    parts = list(segments.slices(iter([batch, batch.slice(0, 0)]), 0, 9))
    assert [len(p) for p in parts] == [1, 1, 4, 1] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, dtype = token_store.tokenizer_encoder(path)
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    pieces = ["a", "Bc", "é", "ß", "5", "42", ".", ",!", "'", "'s", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u3000", "ж", "中", "\u0301", "ᲀ", "😀", "<|endoftext|>"]
    made = ["".join(rng.choices(pieces, k=rng.randrange(1, 30))) for _ in range(3_000)]
    all_texts = [t for _, t in texts() if t] + ODD + made
    for text, ids in zip(all_texts, encoder(pa.array(all_texts))[0].to_pylist(), strict=True):
        assert np.frombuffer(ids, dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]
    trip = bpe.production_encoder()
    encoding, both = tiktoken_encoding(), bpe._round_trip(*trip)(pa.array(all_texts))
    for text, ids, back in zip(all_texts, *(x.to_pylist() for x in both), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text) and back == text.encode(), text[:50]


def test_store_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = Scratch(spark, "test").path("store")
    name = public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_store(docs, path, name)
    library = Tokenizer.from_file(name)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    got = sorted(token_store.read_checksums(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in texts()), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = sorted((i if i is not None else -1, len(x := ids(t)), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in texts())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == want
    back = {(r.start): r.ids for r in token_store.read_ids(spark, path).collect()}
    for r in got:
        assert zlib.crc32(np.array(back[r.start], "<u4").tobytes()) == r.ids_crc32
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_damage_is_noticed(spark):
    path = Scratch(spark, "test").path("store")
    df = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    token_store.write_store(df, path, public_tokenizers.path("byte_bpe_50k.json"))
    recipes = spark.read.parquet(f"{path}/recipes").collect()
    spark.createDataFrame(recipes[:1], spark.read.parquet(f"{path}/recipes").schema).write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_checksums(spark, path)


def test_swapped_lengths_of_chunks_are_noticed(spark):
    path = Scratch(spark, "test").path("store")
    df = spark.createDataFrame([(1, " ".join(f"w{i * i}" for i in range(20_000)))], "doc_id long, text string")
    token_store.write_store(df, path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.read_checksums(spark, path).count() == 1
    recipes, schema = (stored := spark.read.parquet(f"{path}/recipes")).collect(), stored.schema
    row = recipes[0].asDict(recursive=True)
    lengths = [x["n_ids"] for x in row["chunks"]]
    assert len(set(lengths)) > 1
    row["chunks"] = [{**x, "n_ids": n} for x, n in zip(row["chunks"], lengths[1:] + lengths[:1])]
    spark.createDataFrame([row], schema).write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(Exception, match="is damaged"):
        token_store.read_checksums(spark, path).collect()


def test_store_of_nothing(spark, no_docs):
    path = Scratch(spark, "test").path("store")
    token_store.write_store(no_docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.read_checksums(spark, path).count() == 0


def test_crc_of_joined_streams():
    rng = np.random.default_rng(0)
    for n in (0, 1, 4, 1000, 70_000):
        a, b = rng.bytes(37), rng.bytes(n)
        assert token_store.combine_crc(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def test_cuts_move_little_with_an_edit():
    ids = np.random.default_rng(1).integers(0, 50_000, 40_000).astype(np.uint16)
    edited = np.concatenate([ids[:20_000], [7], ids[20_000:]]).astype(np.uint16)
    ends = lambda x: token_store.cuts(token_store.marks(x).tolist(), len(x))
    pieces = lambda x: {x[a:b].tobytes() for a, b in zip([0, *ends(x)], ends(x))}
    assert len(pieces(ids) & pieces(edited)) >= len(pieces(ids)) - 3
    assert max(np.diff([0, *ends(np.zeros(50_000, np.uint16))])) <= token_store.MOST
    stream, stops = token_store._with_end(pa.array([ids.tobytes(), b"", edited.tobytes()]), 7, np.dtype("<u2"))
    assert stream.tolist() == [*ids, 7, 7, *edited, 7] and stops.tolist() == [len(ids) + 1, len(ids) + 2, len(stream)]


def tiktoken_encoding():
    import tiktoken

    path, pattern = bpe.production_encoder()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_agrees_with_tiktoken_and_decodes(spark, docs):
    encoding = tiktoken_encoding()
    rows = bpe.digests(bpe.encode_decode(docs, *bpe.production_encoder()), "ids").collect()
    want = sorted(str((i, hashlib.sha256(np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())) for i, t in texts())
    assert sorted(str((r.doc_id, r.ids_sha256, r.decoded_sha256)) for r in rows) == want
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows)
    encoded = bpe.encode_decode(docs.filter("doc_id < 20"), *bpe.production_encoder())
    back = {r.doc_id: r.text for r in bpe.decode(encoded, *bpe.production_encoder()).collect()}
    assert back == {i: t for i, t in texts() if i is not None and i < 20}


def test_bpe_of_nothing(no_docs):
    assert bpe.encode_decode(no_docs, *bpe.production_encoder()).count() == 0


def test_long_matches_are_exact_and_bounded():
    """All places of a pair at once give what one at a time gives; no state but the last is kept."""
    rng, encoding = random.Random(1), tiktoken_encoding()
    trip = bpe._round_trip(*bpe.production_encoder())
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    made = [letters(n) for n in (63, 64, 65, 300, 3_000)] + ["a" * 20_000, "ab" * 5_000, "größe" * 400, "7" * 500, "=" * 700, letters(90) + "!" * 90]
    ids, back = trip(pa.array(made))
    for text, got, bytes_ in zip(made, ids.to_pylist(), back.to_pylist(), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == encoding.encode_ordinary(text) and bytes_ == text.encode()


def test_damaged_and_missing_chunks_are_noticed(spark):
    path = Scratch(spark, "test").path("store")
    df = spark.createDataFrame([(1, " ".join(f"w{i * i}" for i in range(9_000))), (2, "d e f")], "doc_id long, text string")
    token_store.write_store(df, path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.read_ids(spark, path).count() == 2
    chunks, schema = (stored := spark.read.parquet(f"{path}/chunks")).collect(), stored.schema
    hurt = [r.asDict() for r in chunks]
    hurt[0]["data"] = bytes(hurt[0]["data"][:-1]) + bytes([hurt[0]["data"][-1] ^ 1])
    for rows in (hurt, hurt[1:]):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/chunks")
        for read in (token_store.read_ids, token_store.read_checksums):
            with pytest.raises(Exception, match="damaged"):
                read(spark, path).collect()


def test_scratch_is_cleared(spark):
    from grove.llm import scratch

    own = Scratch(spark, "test")
    own.write(spark.range(3), "table")
    assert own.read("table", spark.range(1).schema).count() == 3
    kept, scratch._made[:] = scratch._made[:-1], [own]
    scratch.clear()
    scratch._made[:] = kept
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        own.read("table", spark.range(1).schema).count()
