import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from rosterloom.llm import line_rules, media, packing, registry, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def texts_of(folder):
    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


# ------------------------------------------------------------------ token counts


def brute_counts(rows):
    t = Tokenizer.from_file(JSON)
    return sorted((k, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for k, x in rows)


def test_token_counts_match_whole_text_encoding(spark, small):
    got = registry.op3_token_counts(spark, small).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == brute_counts(texts_of(small))
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_token_counts_of_odd_texts(odd, odd_rows, empty):
    got = token_counts.count_tokens(odd, JSON).collect()
    assert sorted(map(tuple, got)) == brute_counts(odd_rows)
    assert token_counts.count_tokens(empty, JSON).count() == 0


def test_safe_segments_join_to_the_whole_encoding():
    t = Tokenizer.from_file(JSON)
    for text in ["a b\nc  d \n e", "it's  two\n\nlines\t\tx y", " <|endoftext|> a<|endoftext|> b", "é  b c d"]:
        parts = token_counts.safe_segments(text)
        assert "".join(parts) == text
        assert [i for p in parts for i in t.encode(p, add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids


# ------------------------------------------------------------------ packing


def check_packing(rows, pieces, size=2048):
    t = Tokenizer.from_file(WORDS)
    want = Counter()
    for k, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), size):
            part = ids[start : start + size]
            want[(k, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids))] += 1
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return sum(p.length for p in pieces) / (size * len(sequences))


def test_packing_of_supplied_documents(spark, small):
    assert check_packing(texts_of(small), registry.op6_packing(spark, small).collect()) > 0.97


def test_packing_in_several_groups(odd, odd_rows, empty):
    pieces = packing.pack_documents(odd, WORDS, group_rows=7).collect()
    check_packing(odd_rows, pieces)
    assert packing.pack_documents(empty, WORDS).count() == 0


def test_first_fit_decreasing_matches_a_plain_scan():
    rng = np.random.default_rng(5)
    for capacity in (10, 100, 2048):
        lengths = sorted(rng.integers(1, capacity + 1, 300).tolist(), reverse=True)
        free, bins, offsets = [], [], []
        for need in lengths:
            k = next((i for i, f in enumerate(free) if f >= need), len(free))
            if k == len(free):
                free.append(capacity)
            bins.append(k)
            offsets.append(capacity - free[k])
            free[k] -= need
        assert packing.first_fit_decreasing(lengths, capacity) == (bins, offsets)


# ------------------------------------------------------------------ media


def test_media_round_trip(odd, odd_rows, empty):
    got = media.read_png(media.write_png(odd)).collect()
    want = Counter((k, media.padded((x or "").encode())) for k, x in odd_rows)
    assert Counter((r.doc_id, bytes(r.payload)) for r in got) == want
    by_payload = defaultdict(set)
    for r in got:
        assert r.width == 64 and len(r.payload) % 192 == 0 and len(r.dct_hash) == 8
        by_payload[bytes(r.payload)].add((bytes(r.png), bytes(r.dct_hash)))
    assert all(len(v) == 1 for v in by_payload.values())
    assert media.read_png(media.write_png(empty)).count() == 0


def test_every_row_filter_is_undone():
    rng = np.random.default_rng(1)
    for step in (1, 3, 4):
        rows = rng.integers(0, 256, (12, 8 * step)).astype(np.uint8)
        kinds = np.array([0, 1, 1, 2, 2, 3, 3, 4, 4, 1, 3, 4], np.uint8)
        raw = np.zeros((12, 8 * step + 1), np.uint8)
        for y in range(12):
            for x in range(8 * step):
                left = int(rows[y, x - step]) if x >= step else 0
                up = int(rows[y - 1, x]) if y else 0
                corner = int(rows[y - 1, x - step]) if y and x >= step else 0
                p = left + up - corner
                paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                raw[y, x + 1] = (int(rows[y, x]) - [0, left, up, (left + up) // 2, paeth][kinds[y]]) % 256
            raw[y, 0] = kinds[y]
        assert (media.unfiltered(raw, step) == rows).all()


def test_broken_png_is_refused():
    png = media.encode_png(media.padded(b"some payload " * 40))
    for at in (3, 20, 45, len(png) - 2):
        broken = bytearray(png)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(broken))
    with pytest.raises(ValueError):
        media.decode_png(png[:-12])


def test_hash_is_stable_under_small_noise():
    rng = np.random.default_rng(3)
    image = np.clip(np.cumsum(np.cumsum(rng.normal(0, 2, (64, 64, 3)), 0), 1) + 128, 0, 255)
    noisy = np.clip(image + rng.normal(0, 1, image.shape), 0, 255)
    bits = lambda x: np.unpackbits(np.frombuffer(media.dct_hash(x.astype(np.uint8)), np.uint8))
    assert (bits(image) != bits(noisy)).sum() <= 4
    assert (bits(image) != bits(255 - image)).sum() >= 40


# ------------------------------------------------------------------ line rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_line_rules_base_figures(spark, odd, odd_rows, empty, small):
    for rows, df in ((odd_rows, line_rules.apply_line_rules(odd)), (texts_of(small), registry.op4_quality_rules(spark, small))):
        got = df.collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((k, *brute_base(x)) for k, x in rows)
        assert not any(r.kept and r.base_failed for r in got)
    assert line_rules.apply_line_rules(empty).count() == 0


def test_large_vocabularies_use_the_exact_window_codes():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 6, 400)
    assert line_rules.repeated_words(codes) == line_rules.repeated_words(np.where(codes == 5, 1 << 22, codes))


@pytest.mark.parametrize(
    ("line", "fault"),
    [
        ("A plain sentence of words, with an ending.", None),
        ("THIS!! IS!! SHOUTED!! AGAIN!!", "punctuation"),
        ("some*** odd&&& words%%% with### marks", "punctuation"),
        ("Costs rose by 5% & 6% between the years, as reported by all of them.", None),
        ("Home | About us | Contact | Help", "navigation"),
        ("Shop > Shoes > Running", "navigation"),
        ("Licensed under the Apache License, Version 2.0.", "boilerplate"),
        ("Copyright 2020 Someone. All rights reserved.", "boilerplate"),
    ],
)
def test_line_faults(line, fault):
    assert line_rules.line_fault(line.encode(), line.encode().split()) == fault


def test_documents_lose_failed_lines(spark):
    prose = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(1, prose + "\nHome | About | Help"), (2, prose + "\n" + "\n".join(f"item{i} | part{i} | piece{i} | end{i}" for i in range(90))), (3, prose + "\nshort line here.\nshort line here.")]
    got = {r.doc_id: r for r in line_rules.apply_line_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].cleaned == prose and got[1].n_lines_removed == 1
    assert not got[2].kept and not got[2].base_failed
    assert got[3].cleaned == prose + "\nshort line here." and got[3].n_dup_lines == 1


def test_junk_goes_and_clean_documents_stay(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    rows = registry.op4_quality_rules(spark, medium).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) == 0
    assert n.get((0, True), 0) <= 0.05 * n.get((0, False), 1)


def test_stems_encode_as_in_their_texts(medium):
    """Words of every kind, with signs, in upper case, with long s, dotted I, ligatures and stray marks."""
    t = Tokenizer.from_file(WORDS)
    words = {w for _, x in texts_of(medium) for w in x.replace("\n", " ").split(" ")}
    words |= {"İx.", "ǅa,", "ſ.", "ß", "ẞ,", "é.", "é.", "ª,", "º", "ĳ.", "a.b.", "...", ",", "it's.", "x2.", "2.", "É,", "ŉ.", "ΑΣ.", "ﬁ,", "µ.", "ÿ,"}
    encoder = packing.WordEncoder(WORDS)
    for w in words:
        assert encoder.encode([w, "a " + w + "\nb"]) == [struct.pack(f"<{len(i)}I", *i) for i in (t.encode(w, add_special_tokens=False).ids, t.encode("a " + w + "\nb", add_special_tokens=False).ids)]
