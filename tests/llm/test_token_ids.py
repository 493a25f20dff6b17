"""Token-id shards and their index: exact round trips, keyed access, edges."""

import random
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandframe.llm import token_ids

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(FILE)
ENCODER = token_ids.Encoder(FILE)
SCHEMA = "doc_id long, text string"


def encoded(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


def built(spark, rows, tmp_path, **options):
    path = str(tmp_path / uuid.uuid4().hex)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("x")).withColumn("key", F.lit(1)).withColumn("h", F.lit(2))
    token_ids.build_shards(df, path, FILE, **options)
    token_ids.build_index(spark, path)
    return path, df


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab '’s\t\n\r\x0b\x0c\x1c\x85\xa0   　é1٣!_漢😀", "<|endoftext|>", "'ll", "  "]), max_size=25).map("".join), max_size=4))
def test_pieces_are_encoded_as_whole_texts(texts):
    encoder = ENCODER
    assert encoder.pieces
    for t in texts * 2:
        assert np.frombuffer(encoder(t), dtype="<u4").tolist() == PLAIN.encode(t, add_special_tokens=False).ids


def test_what_is_kept_is_bounded(monkeypatch):
    monkeypatch.setattr(token_ids, "KEPT", 50)
    encoder = token_ids.Encoder(FILE)
    rng = random.Random(2)
    for _ in range(40):
        t = " ".join("".join(rng.choices("abcdeé,", k=rng.randrange(1, 4))) for _ in range(60))
        assert np.frombuffer(encoder(t), dtype="<u4").tolist() == PLAIN.encode(t, add_special_tokens=False).ids
        assert max(len(x) for k in (encoder.words, encoder.cut) for x in (k, k.old)) <= 100


def test_tokenizers_that_see_more_than_pieces_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = token_ids.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.pieces
    assert np.frombuffer(encoder("A  b\nc"), dtype="<u4").tolist() == plain.encode("A  b\nc", add_special_tokens=False).ids


def test_special_tokens_may_be_text():
    assert np.frombuffer(token_ids.Encoder(FILE)("a<|endoftext|>"), dtype="<u4")[-1] == 50256
    assert 50256 not in np.frombuffer(token_ids.Encoder(FILE, special_as_text=True)("a<|endoftext|>"), dtype="<u4")


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_the_hash_is_perfect_and_minimal(n):
    hashes = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.int64)).view(np.uint64)
    made = token_ids.PerfectHash.build(hashes)
    assert sorted(made.slots(hashes).tolist()) == list(range(len(hashes)))
    assert not n or sum(made.sizes) < 64 * len(made.sizes) + 5 * n


def test_query_agrees_with_one_pass_over_the_texts(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    start, want = 0, {}
    for r in docs:
        ids = encoded(r.text)
        want[r.doc_id] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    got = token_ids.op11_token_ids(spark, SF).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def all_ids(path):
    shards = [token_ids.Shard(f"{path}/{n}") for n in token_ids.Manifest.read(path).names]
    return [i for s in shards for i in s.ids(0, s.tokens).tolist()]


def test_rows_of_ids_make_the_shards_of_texts(spark, tmp_path):
    df = spark.createDataFrame([(2, "a b"), (1, None), (3, "é<|endoftext|>")], SCHEMA).coalesce(1).sortWithinPartitions("doc_id")
    for special in (False, True):
        made, path = str(tmp_path / f"m{special}"), str(tmp_path / f"p{special}")
        token_ids.write_shards(token_ids.encode(df, FILE, end=None, special_as_text=special), made, 2)
        token_ids.build_shards(df, path, FILE, end=None, special_as_text=special)
        assert all_ids(made) == all_ids(path) and (50256 in all_ids(path)) != special


def test_edges(spark, tmp_path):
    rows = [(5, "x y"), (5, "x y"), (5, "another"), (-7, None), (0, ""), (None, "no key"), (None, None), (2**63 - 1, "long " * 100_000), (-(2**63), "漢字")]
    path, df = built(spark, rows, tmp_path)
    got = token_ids.lookup(spark, path, df).collect()
    assert sorted((r.key is not None, r.key or 0, bytes(r.ids)) for r in got) == sorted((k is not None, k or 0, struct.pack(f"<{len(encoded(t))}I", *encoded(t))) for k, t in rows)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.key for r in ordered] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered[:-1]]]).tolist()
    asked = spark.createDataFrame([(5,), (5,), (6,), (1 << 40,)], "doc_id long")
    assert sorted(r.key for r in token_ids.lookup(spark, path, asked).collect()) == [5, 5, 5]
    store = token_ids.Store(path)
    assert sorted(x.tolist() for x in store.get(5)) == sorted([encoded("x y"), encoded("x y"), encoded("another")])
    assert store.get(-7)[0].tolist() == [2] and store.get(6) == []
    assert store.get(2**63 - 1)[0].tolist() == encoded("long " * 100_000)
    store.close()
    empty, none = built(spark, [], tmp_path)
    assert token_ids.lookup(spark, empty, df).count() == 0
    assert token_ids.lookup(spark, path, none).count() == 0


def test_a_key_of_many_rows_goes_over_shards(spark, tmp_path):
    rng = random.Random(4)
    rows = [(1, "before"), (3, "after")] + [(2, f"row {i} {rng.random()}") for i in range(400)]
    path = str(tmp_path / "hot")
    df = spark.createDataFrame(rows, SCHEMA)
    on = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        token_ids.build_shards(df, path, FILE)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", on)
    token_ids.build_index(spark, path)
    manifest = token_ids.Manifest.read(path)
    assert len(manifest.names) >= 3 and max(manifest.rows) < 300
    got = token_ids.lookup(spark, path, df).collect()
    assert sorted((r.key, bytes(r.ids)) for r in got) == sorted((k, struct.pack(f"<{len(encoded(t))}I", *encoded(t))) for k, t in rows)
    assert len(token_ids.Store(path).get(2)) == 400


def test_a_fingerprint_of_another_key_is_found_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_ids, "_fingerprints", lambda h: np.zeros(len(h), np.uint32))
    keys = np.arange(100)
    hashes = np.array([xxhash.xxh64_intdigest(struct.pack("<q", k), seed=42) for k in keys.tolist()], dtype=np.uint64)
    made = token_ids._index_bytes(hashes, np.zeros(100, token_ids._SLOT))
    (tmp_path / "i").write_bytes(made)
    hit, _ = token_ids.Index(str(tmp_path / "i")).find(hashes + np.uint64(1))
    assert hit.any()  # which is why the shard's own key decides
    monkeypatch.undo()
    path, _ = built(spark, [(int(k), "t") for k in keys], tmp_path)
    assert token_ids.Store(path).get(100) == []


@pytest.mark.parametrize("width, tokens", [(2, 65535), (4, 70000)])
def test_ids_of_both_widths(spark, tmp_path, width, tokens):
    ids = struct.pack("<2I", tokens, 2)
    df = spark.createDataFrame([(1, bytearray(ids))], "key long, ids binary").coalesce(1)
    path = str(tmp_path / str(width))
    token_ids.write_shards(df, path, width)
    token_ids.build_index(spark, path)
    assert token_ids.Store(path).get(1)[0].tolist() == [tokens, 2]


def test_words_are_kept_once():
    """A word behind a space isn't kept as a piece too, and its head is kept for the word without a mark; ids are the library's."""
    encoder = token_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "first second second, Straße Straße. größer"
    assert encoder(text) == encoder._whole(text)
    assert set(encoder.words) == {"second", "second,", "Straße", "Straße.", "größer"}
    assert set(encoder.cut) == {"first", ",", "."}
