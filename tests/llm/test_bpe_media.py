"""BPE against the public library, PNG files round trip."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tabulon.llm import bpe, media
from tabulon.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe._file(vocabulary_path()))


@pytest.fixture(scope="module")
def library(vocabulary):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


SPECIAL = st.lists(st.sampled_from([*"abs'tredlvmRE 12.,!\n\t\r  　é日²١", "'re", "'ll", "  ", " 's"]), max_size=60).map("".join)


@given(texts=st.lists(st.one_of(SPECIAL, st.text(max_size=40)), max_size=8))
def test_like_the_library(vocabulary, library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = vocabulary.encode(texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    for t, ids in zip(texts, got):
        ids = np.array(ids, dtype=np.int64)
        assert vocabulary.decode(ids, vocabulary.offsets(ids)) == t.encode()


def test_classes_of_all_code_points(library):
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, kinds in ((r"\p{L}", [bpe.LETTER]), (r"\p{N}", [bpe.NUMBER]), (r"\s", [bpe.SPACE, bpe.WHITE])):
        found = bytes(tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(points)).decode()
        assert {ord(c) for c in found} == set(np.flatnonzero(np.isin(bpe.classes(), kinds)).tolist()) - set(range(0xD800, 0xE000))


def test_long_slices_and_blocks(vocabulary, library):
    rng = random.Random(1)
    texts = ["a" * 3000, "".join(rng.choice("abcdefgh") for _ in range(3000)), "é" * 1500, "' " * 2000, "x y'll " * 900, "\n" * 700 + "z"]
    assert vocabulary.encode(texts) == [library.encode_ordinary(t) for t in texts]


def test_odd_rows(odd, empty, library):
    rows = odd.collect()
    got = bpe.digests(odd, vocabulary_path(), with_ids=True).collect()
    assert len(got) == len(rows)
    want = sorted((hashlib.sha256((r.text or "").encode()).hexdigest(), tuple(library.encode_ordinary(r.text or ""))) for r in rows)
    assert sorted((g.decoded_sha256, tuple(g.token_ids)) for g in got) == want
    assert all(g.ids_sha256 == hashlib.sha256(" ".join(map(str, g.token_ids)).encode()).hexdigest() and g.n_tokens == len(g.token_ids) for g in got)
    assert bpe.digests(empty, vocabulary_path()).count() == 0
    encoded = bpe.encode(odd, vocabulary_path())
    assert sorted(bytes(r.decoded) for r in bpe.decode(encoded, vocabulary_path()).collect()) == sorted((r.text or "").encode() for r in rows)
    assert all(r.byte_offsets[0] == 0 and len(r.byte_offsets) == len(r.token_ids) + 1 for r in encoded.collect())


@given(raw=st.binary(max_size=4000))
def test_png_round_trip(raw):
    payload = media.pad(raw)
    assert len(payload) % media.WIDTH == 0 and payload and payload.startswith(raw)
    assert media.read_png(media.write_png(payload)).tobytes() == payload


@pytest.mark.parametrize("bpp", [1, 3, 4])
def test_all_filters(bpp):
    rng = np.random.default_rng(bpp)
    height, width = 23, 11 * bpp
    image, kinds = rng.integers(0, 256, (height, width), dtype=np.uint8), rng.integers(0, 5, height)
    lines = np.zeros((height, width + 1), np.uint8)
    lines[:, 0] = kinds
    for r in range(height):
        for c in range(width):
            a = int(image[r, c - bpp]) if c >= bpp else 0
            b = int(image[r - 1, c]) if r else 0
            x = int(image[r - 1, c - bpp]) if r and c >= bpp else 0
            near = min((abs(b - x), 0, a), (abs(a - x), 1, b), (abs(a + b - 2 * x), 2, x))[2]
            lines[r, c + 1] = (int(image[r, c]) - [0, a, b, (a + b) // 2, near][kinds[r]]) % 256
    assert (media.unfilter(lines, bpp) == image).all()


def test_damage_is_found():
    good = media.write_png(media.pad(b"hello" * 300))
    for at in (3, 20, 30, 60, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.read_png(bytes(bad))
    with pytest.raises(ValueError):
        media.read_png(good[:-6])


def test_media_rows(odd, empty):
    got = media.features(media.store(odd)).collect()
    want = []
    for r in odd.collect():
        payload = media.pad((r.text or "").encode())
        want.append((hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-32:]), len((r.text or "").encode())))
    assert sorted((g.payload_sha256, g.payload_bytes, g.tail_crc32, g.n_bytes) for g in got) == sorted(want)
    assert len({bytes(g.hash) for g in got if g.n_bytes == 0}) == 1
    assert media.features(media.store(empty)).count() == 0
    spark = odd.sparkSession
    bad = spark.createDataFrame([(1, bytearray(b"x"), "keep"), (2, None, "keep")], "id int, png binary, error string")
    rows = {r.id: r for r in media.features(bad).collect()}
    assert rows[1].error == "no PNG signature" and rows[1].payload_bytes is None and rows[2].error is None and rows[2].hash is None
