import hashlib

import numpy as np
import pytest

from pricelode.llm import webp
from pricelode.llm.media import decode_media, encode_payloads, images_payload, payload_images, pick_tools, read_media, store_texts

from .conftest import rows


def images():
    draw = np.random.default_rng(0)
    for _ in range(4):
        h, w = draw.integers(1, 30, 2)
        yield draw.integers(0, 2**32, (h, w), dtype=np.uint32)
        yield draw.integers(0, draw.integers(1, 30), (h, w)).astype(np.uint32) * np.uint32(0x01020305)
        yield np.resize(draw.integers(0, 5, draw.integers(3, 12)), (h, w)).astype(np.uint32) * np.uint32(0x11111111)


@pytest.mark.parametrize("number,image", list(enumerate(images())))
def test_round_trip_of_every_tool(number, image):
    draw = np.random.default_rng(number)
    bits = int(draw.integers(2, 5))
    blocks = -(-image.shape[0] // (1 << bits)) * -(-image.shape[1] // (1 << bits))
    modes, multipliers = draw.integers(0, 14, blocks), draw.integers(0, 2**24, blocks, dtype=np.uint32)
    tools = [
        {},
        {"copies": True},
        {"cache_bits": int(draw.integers(1, 12))},
        {"copies": True, "cache_bits": 3},
        {"subtract_green": True},
        {"predictor": (bits, modes)},
        {"cross": (bits, multipliers)},
        {"tiles": (bits, draw.permutation(blocks) % 3), "copies": True},
        {"predictor": (bits, modes), "cross": (bits, multipliers), "subtract_green": True, "copies": True, "cache_bits": 5},
    ]
    if len(np.unique(image)) <= 256:
        tools += [{"palette": True}, {"palette": True, "copies": True, "cache_bits": 2}]
    for some in tools:
        (back,) = webp.decode_webp(webp.encode_webp(image, **some))
        assert (back == image).all(), some


def test_a_stream_by_hand():
    # 2 x 1 pixels, no alpha; simple codes: green 7 or 9, red 1, blue 2, alpha 255; then one bit a pixel.
    bits = [(0x2F, 8), (1, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    bits += [(1, 1), (1, 1), (1, 1), (7, 8), (9, 8)]
    for symbol in (1, 2, 255, 0):
        bits += [(1, 1), (0, 1), (1, 1), (symbol, 8)]
    bits += [(1, 1), (0, 1)]
    value, at = 0, 0
    for x, n in bits:
        value |= x << at
        at += n
    assert webp.decode_vp8l(value.to_bytes((at + 7) // 8, "little")).tolist() == [[0xFF010902, 0xFF010702]]


def test_broken_streams_are_refused():
    data = webp.encode_vp8l(np.arange(64, dtype=np.uint32).reshape(4, 16) * np.uint32(77777))
    for bad in (data[: len(data) // 2], b"\0" + data[1:], data[:6]):
        with pytest.raises(ValueError):
            webp.decode_vp8l(bad)


def test_stores_and_reads_texts(docs, no_docs):
    got = read_media(store_texts(docs)).collect()
    want = []
    for r in rows():
        data = (r[1] or "").encode()
        want.append((-1 if r[0] is None else r[0], len(data), hashlib.sha256(data + bytes(-len(data) % 64) or bytes(64)).hexdigest()))
    assert sorted((-1 if r.id is None else r.id, r.n_bytes, hashlib.sha256(r.payload).hexdigest()) for r in got) == sorted(want)
    assert read_media(store_texts(no_docs)).count() == 0


def test_tools_are_picked():
    plain = bytes(np.random.default_rng(1).integers(97, 123, 6400, dtype=np.uint8))
    (image,) = payload_images(plain)
    assert pick_tools(image) == {}
    (image,) = payload_images(b"abcd" * 1600)
    assert pick_tools(image)["palette"]
    (image,) = payload_images((plain[:3200]) * 2)
    assert pick_tools(image)["copies"]


def test_images_side_by_side_are_those_decoded_alone():
    draw = np.random.default_rng(9)
    words = [bytes(draw.integers(97, 123, draw.integers(2, 9), dtype=np.uint8)) for _ in range(300)]
    payloads = []
    for size in (0, 1, 3, 40, 400, 3000, 9000, 20_000):
        text = b" ".join(words[k] for k in draw.integers(0, 300, size))
        payloads += [text, text[: len(text) // 2] * 2, bytes(draw.integers(0, 256, len(text), dtype=np.uint8)), b"z" * size]
    payloads = [p + bytes(-len(p) % 64) or bytes(64) for p in payloads]
    media = encode_payloads(payloads)
    assert [images_payload(i) for i in decode_media(media)] == payloads
    assert [images_payload(webp.decode_webp(m)) for m in media] == payloads
    assert [encode_payloads([p])[0] for p in payloads] == media
    assert decode_media([None, media[3], None])[0] is None


def test_code_lengths_are_those_of_a_heap():
    draw = np.random.default_rng(3)
    counts = np.stack([np.where(draw.random(256) < share, (draw.pareto(0.7, 256) * 9).astype(np.int64) % 5000 + 1, 0) for share in (0.03, 0.1, 0.3, 0.6, 1.0)])
    counts[:, :3] += 1
    for row, lengths in zip(counts, webp._many_code_lengths(counts, 15)):
        assert (row * lengths).sum() == (row * np.array(webp._code_lengths(row.tolist()))).sum()
    short = webp._many_code_lengths(counts, 9)
    assert short.max() <= 9 and all(sum(2.0 ** -n for n in row if n) == 1 for row in short.tolist())


def stream(*parts):
    """Bytes of (value, bits) pairs, lowest bit first."""
    value = at = 0
    for x, n in parts:
        value |= x << at
        at += n
    return value.to_bytes((at + 7) // 8, "little")


def simple(*symbols):
    """A prefix code of one or two symbols of eight bits."""
    return [(1, 1), (len(symbols) - 1, 1), (1, 1), *[(s, 8) for s in symbols]]


def flat_image(green, red, blue, alpha):
    """An image of one colour, without a cache."""
    return [(0, 1), *simple(green), *simple(red), *simple(blue), *simple(alpha), *simple(0)]


def head(width, height):
    return [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)]


def test_predictor_and_cross_colour_by_hand():
    # 3 x 2 residuals of (1, 2, 3, 4): the first pixel adds to opaque black, the first row to its left, the first column to what is above, the rest by mode 2 (above).
    data = head(3, 2) + [(1, 1), (0, 2), (0, 3), *flat_image(2, 0, 0, 255), (0, 1), (0, 1), (0, 1), *simple(3), *simple(2), *simple(4), *simple(1), *simple(0)]
    grey = lambda k, a: (a << 24) | (2 * k << 16) | (3 * k << 8) | 4 * k
    want = [[grey(1, 0), grey(2, 1), grey(3, 2)], [grey(2, 1), grey(3, 2), grey(4, 3)]]
    assert webp.decode_vp8l(stream(*data)).tolist() == want
    # Multipliers green to red 32 / 32 = 1, green to blue 64 / 32 = 2, red to blue -32 / 32 = -1: red 2 + 3, blue 4 + 6 - 5.
    data = head(1, 1) + [(1, 1), (1, 2), (0, 3), *flat_image(64, 256 - 32, 32, 255), (0, 1), (0, 1), (0, 1), *simple(3), *simple(2), *simple(4), *simple(1), *simple(0)]
    assert webp.decode_vp8l(stream(*data)).tolist() == [[1 << 24 | 5 << 16 | 3 << 8 | 5]]


def test_palette_and_groups_by_hand():
    # Two colours, packed eight a pixel: deltas (0, 9) in green; the indices 1, 0, 1 are bits of one green value.
    table = [(0, 1), *simple(0, 9), *simple(0), *simple(0), *simple(255, 0), *simple(0)]
    bits = [(0, 1), (1, 1), (1, 1), (0, 1)]  # green 0 alpha 255 (the larger symbol), then green 9 alpha 0
    data = head(3, 1) + [(1, 1), (3, 2), (1, 8), *table, *bits, (0, 1), (0, 1), (0, 1), *simple(5), *simple(0), *simple(0), *simple(255), *simple(0)]
    assert webp.decode_vp8l(stream(*data)).tolist() == [[0xFF000900, 0xFF000000, 0xFF000900]]
    # Tiles of 4 x 4: the first uses group 0 (green 7), the second group 1 (green 8).
    meta = [(0, 1), *simple(0, 1), *simple(0), *simple(0), *simple(255), *simple(0), (0, 1), (1, 1)]
    data = head(5, 1) + [(0, 1), (0, 1), (1, 1), (0, 3), *meta]
    for green in (7, 8):
        data += [*simple(green), *simple(0), *simple(0), *simple(255), *simple(0)]
    assert [p >> 8 & 255 for p in webp.decode_vp8l(stream(*data))[0].tolist()] == [7, 7, 7, 7, 8]


def test_extended_files_nulls_and_clashing_columns(spark):
    content = webp.encode_vp8l(np.arange(64, dtype=np.uint32).reshape(4, 16))
    chunk = b"VP8L" + len(content).to_bytes(4, "little") + content + bytes(len(content) % 2)
    inner = b"WEBPVP8X" + (10).to_bytes(4, "little") + bytes(10) + chunk + b"EXIF" + (3).to_bytes(4, "little") + b"abc\0"
    data = b"RIFF" + len(inner).to_bytes(4, "little") + inner
    assert (webp.decode_webp(data)[0] == np.arange(64).reshape(4, 16)).all()
    got = read_media(spark.createDataFrame([(1, data, "p", 5), (2, None, "p", 5), (1, data, "p", 5)], "id int, media binary, payload string, feature int")).orderBy("id").collect()
    assert [(r.id, r.payload is None, r.feature is None) for r in got] == [(1, False, False), (1, False, False), (2, True, True)]
    with pytest.raises(ValueError):
        webp.webp_contents(b"RIFF\0\0\0\0WEBP")
