import hashlib
import random
import struct

import public_tokenizers
import pyarrow.parquet as pq
import tiktoken
from pyspark.sql import functions as F

from rosterloom.llm import byte_bpe, registry

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def brute(rows):
    out = []
    for k, text in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        out.append((k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(LIBRARY.decode_bytes(ids)).hexdigest()))
    return sorted(out)


def test_supplied_documents(spark, small):
    t = pq.read_table(f"{small}/documents.parquet").to_pydict()
    assert sorted(map(tuple, registry.op7_byte_bpe(spark, small).collect())) == brute(zip(t["doc_id"], t["text"], strict=True))


def test_odd_texts_in_small_blocks(odd, odd_rows, empty):
    for limit in (1, 200, 1 << 25):
        got = byte_bpe.encode_and_decode(odd, PATH, public_tokenizers.PATTERN, limit)
        got = got.select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256)).collect()
        assert sorted(map(tuple, got)) == brute(odd_rows)
    assert byte_bpe.encode_and_decode(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_shared_words_fold_once_for_all_blocks(odd, odd_rows, monkeypatch):
    """Every word is shared, some are, or none: the ids are the same."""
    monkeypatch.setattr(byte_bpe, "SAMPLE", 1)
    monkeypatch.setattr(byte_bpe, "FOLD_WORDS", 7)
    for least, room in ((1, 1 << 20), (2, 1 << 20), (1, 300), (1, 0)):
        monkeypatch.setattr(byte_bpe, "LEAST_FOUND", least)
        monkeypatch.setattr(byte_bpe, "SHARED_BYTES", room)
        got = byte_bpe.encode_and_decode(odd, PATH, public_tokenizers.PATTERN, 200)
        got = got.select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256)).collect()
        assert sorted(map(tuple, got)) == brute(odd_rows)


def test_null_ids_clashing_names_and_a_text_over_a_block(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SAMPLE", 1)
    long = " ".join(f"word{k % 5000}x{k % 7}" for k in range(800_000))
    rows = [(None, long), (7, None), (None, "twice"), (None, "twice"), (3, long[: 1 << 20])]
    assert len(long) > byte_bpe.VOCABULARY_BLOCK_BYTES
    df = spark.createDataFrame([(k, t, 1, b"x", 2) for k, t in rows], "doc_id long, text string, ids int, word binary, codes int")
    got = byte_bpe.encode_and_decode(df, PATH, public_tokenizers.PATTERN).select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((k, *brute([(0, t)])[0][1:]) for k, t in rows), key=str)


def test_heap_and_column_folds_agree(spark):
    rng = random.Random(4)
    words = {bytes(rng.choice(b"aehnrst \xc3\xa9") for _ in range(rng.randrange(1, 40))) for _ in range(200)} | {b"aaaaaaaaaaaaaaaaa", b"\xff\xfe"}
    rows = [(w, [RANKS[bytes([b])] for b in w]) for w in map(bytes, words)]
    df = spark.createDataFrame([(bytearray(w), ids) for w, ids in rows], "w binary, bytes array<int>")
    folded = df.select("w", byte_bpe._let(byte_bpe.rank_literal(RANKS), lambda pairs: byte_bpe.fold_word(F.col("bytes"), pairs)).alias("ids"))
    for r in folded.collect():
        word = bytes(r.w)
        assert r.ids == byte_bpe.merge_long_word(word, RANKS)
        assert r.ids == LIBRARY._core_bpe.encode_single_piece(word)


def test_every_token_is_its_own_fold():
    """The library takes a word that is a token as it is; merging its bytes gives the same."""
    assert all(byte_bpe.merge_long_word(piece, RANKS) == [rank] for piece, rank in RANKS.items())
