"""A second reading of the AVI files, written from the formats alone: chunks in file order, bits one by one, sums for the transform."""

import math
import random
import struct
import zlib
from hashlib import sha256

from marlstone.llm import avi, bpe
from tests.llm.test_documents import docs, texts_of  # noqa: F401


def chunks(b, at, end):
    while at + 8 <= end:
        name, n = b[at : at + 4], struct.unpack_from("<I", b, at + 4)[0]
        if name in (b"RIFF", b"LIST"):
            yield from chunks(b, at + 12, at + 8 + n)
        else:
            yield name, b[at + 8 : at + 8 + n]
        at += 8 + n + n % 2


def diagonal_order():
    out, row, col, up = [], 0, 0, True
    for _ in range(64):
        out.append(8 * row + col)
        if up:
            row, col, up = (row, col + 1, False) if row == 0 and col < 7 else (row + 1, col, False) if col == 7 else (row - 1, col + 1, True)
        else:
            row, col, up = (row + 1, col, True) if col == 0 and row < 7 else (row, col + 1, True) if row == 7 else (row + 1, col - 1, False)
    return out


def blocks_of(frame):
    """Quantised coefficients of each block of a grey baseline frame with restarts, in zigzag order."""
    at, tables, every, size = 2, {}, 0, None
    while True:
        marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        if marker == 0xC4:
            code, k, codes = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    codes[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            tables[body[0]] = codes
        elif marker == 0xC0:
            size = struct.unpack_from(">HH", body, 1)
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        at += 2 + n
        if marker == 0xDA:
            break
    total = (size[0] // 8) * (size[1] // 8)
    out, before = [], 0

    def reader():
        nonlocal at
        while True:
            byte = frame[at]
            at += 2 if byte == 0xFF else 1
            for k in range(7, -1, -1):
                yield byte >> k & 1

    bits = reader()

    def symbol(codes):
        length = code = 0
        while (length, code) not in codes:
            length, code = length + 1, code << 1 | next(bits)
            assert length <= 16
        return codes[length, code]

    def extra(n):
        v = 0
        for _ in range(n):
            v = v << 1 | next(bits)
        return v if not n or v >> n - 1 else v - (1 << n) + 1

    for k in range(total):
        if k and every and k % every == 0:
            assert frame[at] == 0xFF and frame[at + 1] == 0xD0 + (k // every - 1) % 8
            at, before, bits = at + 2, 0, reader()
        before += extra(symbol(tables[0]))
        block = [before]
        while len(block) < 64:
            s = symbol(tables[16])
            if s == 0:
                break
            block += [0] * (s >> 4) + ([extra(s & 15)] if s & 15 else [])
        out.append(block + [0] * (64 - len(block)))
    assert frame[at : at + 2] == b"\xff\xd9"
    return out


def test_a_second_decoder_finds_the_bytes():
    r = random.Random(8)
    for payload in (b"plain text of some words, ".ljust(64, b"\0"), r.randbytes(64 * 3), bytes([255] * 128), r.randbytes(64 * 66)):
        media = avi.write_avi(payload)
        found = list(chunks(media, 0, len(media)))
        frames = [b for name, b in found if name == b"00dc"]
        values = [v for f in frames for block in blocks_of(f) for v in block]
        stored = bytes(v + 255 if v < 0 else v for v in values)
        # the first of a block is a difference from nothing, as each block follows a restart; category 8 holds -255..-128 and 128..255
        assert stored[: len(payload)] == payload
        assert int(dict(found)[b"ICMT"].rstrip(b"\0")) == len(payload)


def test_luma_is_the_transform_of_the_coefficients():
    order = diagonal_order()
    assert avi.ZIGZAG.tolist() == order
    media = avi.write_avi(b"some words that make a block".ljust(64, b"\0"))
    frame = dict(chunks(media, 0, len(media)))[b"00dc"]
    block = blocks_of(frame)[0]
    freq = [0] * 64
    for k, v in zip(order, block):
        freq[k] = v
    c = lambda u: math.sqrt(0.5) if u == 0 else 1.0
    got = avi.decode_jpeg(frame)
    luma = avi.pixels(got["coefs"], got["quant"])[0]
    for y in range(8):
        for x in range(8):
            s = sum(c(u) * c(v) * freq[8 * v + u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8)) / 4
            assert abs(int(luma[8 * y + x]) - min(255, max(0, s + 128))) <= 1


def test_media_files_are_what_the_digests_are_of(docs):  # noqa: F811
    files = {r.doc_id: bytes(r.media) for r in avi.media_files(docs).collect()}
    for r in avi.media_digests(docs).collect():
        if r.doc_id is not None:
            media = files[r.doc_id]
            assert (r.media_bytes, r.media_sha256) == (len(media), sha256(media).hexdigest())
            n = sum(name == b"00dc" for name, _ in chunks(media, 0, len(media)))
            assert r.feature.startswith(f"frames={n};clips=0.00-")
            hists = [avi.histogram(avi.pixels(f["coefs"], f["quant"])) for f in map(avi.decode_jpeg, (b for name, b in chunks(media, 0, len(media)) if name == b"00dc"))]
            mean = sum(hists) / len(hists)
            assert r.feature.endswith(f"{zlib.crc32((mean * 1000).round().astype('<i4').tobytes()):08x}")


def test_encoded_documents(docs):  # noqa: F811
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    text = {i: t for i, t in texts_of(docs) if i is not None}
    got = [r for r in bpe.encode_documents(docs).collect() if r.doc_id is not None]
    assert {r.doc_id for r in got} == set(text)
    for r in got:
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
