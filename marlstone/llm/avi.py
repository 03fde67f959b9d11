"""AVI motion-JPEG: RIFF and its index, intra frames, shots and clips.

Reading: chunks are found by the file's index (idx1), frames are baseline
JPEGs, decoded to quantised coefficients and luma, and shots end where the
histogram difference of two frames stands out from those just before.

Writing is lossless for any bytes: a byte is the eight extra bits of one
coefficient of magnitude category 8 (-255..-128 and 128..255), for which the
frame's Huffman tables have a single one-bit code.  A block of 64 bytes is so
72 bytes of scan, byte-aligned between restart markers, and any baseline
decoder reads it.
"""

from __future__ import annotations

import struct
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, table

FPS = 25
SIDE = 8  # blocks of a full frame's side
#: Zigzag order of an 8x8 block: position k holds the coefficient at row-major ZIGZAG[k]; diagonals in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8))))
DCT = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)], np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_head(wide: int, high: int) -> bytes:
    """Everything before the scan of a grey frame of wide x high blocks with the one-code tables."""
    one = bytes([1, *[0] * 15, 8])
    return (
        b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * high, 8 * wide, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\0" + one) + _segment(0xC4, b"\x10" + one) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, b"\1\1\0\0\x3f\0")
    )


def pack_blocks(data: np.ndarray) -> np.ndarray:
    """(n, 64) bytes to (n, 72) bytes of scan: a zero bit before each byte."""
    b = data.reshape(-1, 8)
    out = np.empty((len(b), 9), np.uint8)
    out[:, 0] = b[:, 0] >> 1
    for j in range(1, 8):
        out[:, j] = (b[:, j - 1] << (8 - j)) | (b[:, j] >> (j + 1))
    out[:, 8] = b[:, 7]
    return out.reshape(-1, 72)


def unpack_blocks(scan: np.ndarray) -> np.ndarray | None:
    """The inverse; None if a code bit is set, which is no code of the table."""
    s = scan.reshape(-1, 9)
    out = np.empty((len(s), 8), np.uint8)
    for j in range(8):
        if (s[:, j] & (0x80 >> j)).any():
            return None
        out[:, j] = (s[:, j] << (j + 1)) | (s[:, j + 1] >> (7 - j))
    return out.reshape(-1, 64)


def write_avi(payload: bytes, fps: int = FPS) -> bytes:
    """An AVI whose frames' coefficients hold payload, whose length is a positive multiple of 64."""
    blocks = len(payload) // 64
    wide, high = (blocks, 1) if blocks <= SIDE * SIDE else (SIDE, SIDE)
    each = wide * high
    data = np.frombuffer(payload.ljust(-(-blocks // each) * each * 64, b"\0"), np.uint8).reshape(-1, 64)
    head, frames = jpeg_head(wide, high), []
    if (data == 0xFF).any():  # stuffing makes blocks of unlike length
        packed = [row.tobytes().replace(b"\xff", b"\xff\0") for row in pack_blocks(data)]
        for at in range(0, len(packed), each):
            parts = [p for k, s in enumerate(packed[at : at + each]) for p in ((bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b""), s)]
            frames.append(head + b"".join(parts) + b"\xff\xd9")
    else:
        rows = np.empty((len(data), 74), np.uint8)
        rows[:, :72] = pack_blocks(data)
        rows[:, 72] = 0xFF
        rows[:, 73] = 0xD0 + np.arange(len(data)) % each % 8
        rows[each - 1 :: each, 73] = 0xD9
        raw = rows.tobytes()
        frames = [head + raw[at : at + 74 * each] for at in range(0, len(raw), 74 * each)]
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(chunk(b"00dc", f))
        at += len(movi[-1])
    big = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, big * fps, 0, 0x10, len(frames), 0, 1, big, 8 * wide, 8 * high, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), big, 0xFFFFFFFF, 0, 0, 0, 8 * wide, 8 * high)
    strf = struct.pack("<IiiHH4sIiiII", 40, 8 * wide, 8 * high, 1, 24, b"MJPG", 64 * each * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"%d\0" % len(payload)))
    return chunk(b"RIFF", b"AVI " + hdrl + info + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def _chunks(buf: memoryview, at: int, end: int):
    while at + 8 <= end:
        name, n = bytes(buf[at : at + 4]), struct.unpack_from("<I", buf, at + 4)[0]
        yield name, at + 8, min(at + 8 + n, end)
        at += 8 + n + n % 2


def parse_avi(media: bytes) -> dict:
    """fps, comment and frames (memoryviews in display order) of the first video stream.

    Frames come by the index; without one, by the order of the movie's chunks.
    """
    buf = memoryview(media)
    if bytes(buf[:4]) != b"RIFF" or bytes(buf[8:12]) != b"AVI ":
        raise ValueError("no AVI file")
    out, frames, index, movi = {"fps": float(FPS), "comment": ""}, [], [], None

    def walk(at, end, depth=0):
        nonlocal movi
        for name, a, z in _chunks(buf, at, end):
            if name == b"LIST" and depth < 8:
                if bytes(buf[a : a + 4]) == b"movi":
                    movi = (a, z)
                else:
                    walk(a + 4, z, depth + 1)
            elif name == b"strh" and bytes(buf[a : a + 4]) == b"vids":
                scale, rate = struct.unpack_from("<II", buf, a + 20)
                out["fps"] = rate / scale if rate and scale else out["fps"]
            elif name == b"ICMT":
                out["comment"] = bytes(buf[a:z]).rstrip(b"\0").decode("latin-1")
            elif name == b"idx1":
                index.extend(struct.iter_unpack("<4sIII", buf[a : a + (z - a) // 16 * 16]))

    walk(12, min(len(buf), 8 + struct.unpack_from("<I", buf, 4)[0]))
    video = [(o, n) for name, _, o, n in index if name[2:] in (b"dc", b"db")]
    if video and movi:
        base = movi[0] if bytes(buf[movi[0] + video[0][0] :][:4])[2:] in (b"dc", b"db") else 0  # offsets from the list or from the file's start
        frames = [buf[base + o + 8 : base + o + 8 + n] for o, n in video]
    elif movi:
        frames = [buf[a:z] for name, a, z in _chunks(buf, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    return out | {"frames": frames}


def _tables(body: bytes, into: dict) -> None:
    at = 0
    while at + 17 <= len(body):
        counts, code, k, codes = body[at + 1 : at + 17], 0, at + 17, {}
        for n, c in enumerate(counts, 1):
            for _ in range(c):
                codes[n, code] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        into[body[at]] = codes
        at = k


def decode_jpeg(frame) -> dict:
    """coefs: (blocks, 64) quantised luma coefficients in zigzag order, rows of blocks; wide, high; quant."""
    f, at, huff, quant, every, comps, size = bytes(frame), 2, {}, {}, 0, [], (0, 0)
    if f[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while True:
        while at < len(f) and f[at] != 0xFF:
            at += 1
        if at + 4 > len(f):
            raise ValueError("no scan")
        mark, n = f[at + 1], struct.unpack_from(">H", f, at + 2)[0]
        body = f[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int32)
                k += 65 + 64 * wide
        elif mark in (0xC0, 0xC1):
            size = struct.unpack_from(">HH", body, 1)
            comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif mark in (0xC2, 0xC3, 0xC9, 0xCA):
            raise ValueError("not a baseline JPEG")
        elif mark == 0xC4:
            _tables(body, huff)
        elif mark == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif mark == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    if len(comps) == 1:
        comps = [(comps[0][0], 1, 1, comps[0][3])]
    hmax, vmax = max(c[1] for c in comps), max(c[2] for c in comps)
    across, down = -(-size[1] // (8 * hmax)), -(-size[0] // (8 * vmax))
    wide, high = across * comps[0][1], down * comps[0][2]
    out = {"wide": wide, "high": high, "quant": quant.get(comps[0][3], np.ones(64, np.int32))}
    pick = chosen.get(comps[0][0], 0)
    one = {(1, 0): 8}
    if len(comps) == 1 and every == 1 and huff.get(pick >> 4) == one == huff.get(0x10 | pick & 15) and len(f) - at >= 74 * wide * high:
        rows = np.frombuffer(f, np.uint8, 74 * wide * high, at).reshape(-1, 74)
        marks = rows[:, 73]
        if (rows[:, 72] == 0xFF).all() and (marks[:-1] == 0xD0 + np.arange(len(rows) - 1) % 8).all() and marks[-1] == 0xD9 and not (rows[:, :72] == 0xFF).any():
            data = unpack_blocks(np.ascontiguousarray(rows[:, :72]))
            if data is not None:  # every code is the one of category 8: what the bit reader below would give
                return out | {"bytes": data, "coefs": from_extra(data)}
    coefs = _scan(f, at, huff, chosen, comps, across, down, every)
    return out | {"coefs": coefs}


def from_extra(data: np.ndarray) -> np.ndarray:
    v = data.astype(np.int16)
    return np.where(v < 128, v - 255, v)


def to_bytes(coefs: np.ndarray) -> np.ndarray:
    """The bytes that category-8 coefficients stand for."""
    return np.where(coefs < 0, coefs + 255, coefs).astype(np.uint8)


def _scan(f, at, huff, chosen, comps, across, down, every) -> np.ndarray:
    """A bit-by-bit baseline decoder; only the first component is kept."""
    bits = have = 0
    pred = [0] * len(comps)
    luma = np.zeros((down * comps[0][2], across * comps[0][1], 64), np.int16)

    def need(n):
        nonlocal bits, have, at
        while have < n:
            b = f[at] if at < len(f) else 0
            if b == 0xFF:
                if at + 1 < len(f) and f[at + 1] == 0:
                    at += 2
                else:
                    b = 0  # a marker: zero bits follow, as decoders do
            else:
                at += 1
            bits, have = (bits << 8 | b) & ((1 << 40) - 1), have + 8

    def take(n):
        nonlocal have
        if not n:
            return 0
        need(n)
        have -= n
        return bits >> have & ((1 << n) - 1)

    def symbol(codes):
        code = 0
        for n in range(1, 17):
            code = code << 1 | take(1)
            s = codes.get((n, code))
            if s is not None:
                return s
        raise ValueError("no such code")

    def extend(v, n):
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    for mcu in range(across * down):
        if every and mcu and mcu % every == 0:
            have, pred = 0, [0] * len(comps)
            while at + 1 < len(f) and not (f[at] == 0xFF and 0xD0 <= f[at + 1] <= 0xD7):
                at += 1
            at += 2
        for c, (name, h, v, _) in enumerate(comps):
            dc, ac = huff[chosen[name] >> 4], huff[0x10 | chosen[name] & 15]
            for y in range(v):
                for x in range(h):
                    block = [0] * 64
                    n = symbol(dc)
                    pred[c] += extend(take(n), n)
                    block[0], k = pred[c], 1
                    while k < 64:
                        s = symbol(ac)
                        if s & 15:
                            k += s >> 4
                            if k > 63:
                                raise ValueError("run past the block")
                            block[k] = extend(take(s & 15), s & 15)
                            k += 1
                        elif s == 0xF0:
                            k += 16
                        else:
                            break
                    if c == 0:
                        luma[mcu // across * v + y, mcu % across * h + x] = block
    return luma.reshape(-1, 64)


def pixels(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(blocks, 64) luma samples 0..255 of zigzag coefficients."""
    x = np.empty(coefs.shape, np.float32)
    x[:, ZIGZAG] = coefs * quant
    x = (x.reshape(-1, 8) @ DCT).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ DCT  # now column by column
    return np.clip(x + 128.5, 0, 255).astype(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64)


def histogram(luma: np.ndarray, bins: int = 16) -> np.ndarray:
    return np.bincount((luma >> 4).ravel(), minlength=bins).astype(np.float64) / max(1, luma.size)


def shots(hists: list[np.ndarray], window: int = 8, k: float = 3.0, least: float = 0.1) -> list[tuple[int, int]]:
    """(first, last) frame of each shot.  A frame opens a shot if its histogram's
    difference from the frame before exceeds the mean by k deviations of the last
    `window` differences in the running shot, and `least`."""
    if not hists:
        return []
    cuts, recent = [0], []
    for i in range(1, len(hists)):
        d = float(np.abs(hists[i] - hists[i - 1]).sum()) / 2
        mean = sum(recent) / len(recent) if recent else 0.0
        dev = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > max(least, mean + k * dev):
            cuts.append(i)
            recent = []
        else:
            recent = [*recent[1 - window :], d]
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], len(hists)])]


def clips_of(media: bytes) -> tuple[list[dict], dict, list[dict]]:
    """Clip rows (clip, first_frame, last_frame, start_s, end_s), the file's facts and its decoded frames."""
    avi = parse_avi(media)
    frames = [decode_jpeg(f) for f in avi["frames"]]
    hists = [histogram(pixels(f["coefs"], f["quant"])) for f in frames]
    rows = [{"clip": i, "first_frame": a, "last_frame": b, "start_s": a / avi["fps"], "end_s": (b + 1) / avi["fps"]} for i, (a, b) in enumerate(shots(hists))]
    return rows, avi | {"hists": hists}, frames


def payload_of(avi: dict, frames: list[dict]) -> bytes:
    """The bytes that write_avi stored."""
    data = np.concatenate([f["bytes"] if "bytes" in f else to_bytes(f["coefs"]) for f in frames])
    return data.tobytes()[: int(avi["comment"])]


def clips(files: DataFrame) -> DataFrame:
    """Timed clip rows of files (path, content binary): path, clip, first_frame, last_frame, start_s, end_s, error.

    A null, empty or undecodable file gives one row with the error and nulls; a
    file without frames gives none.
    """

    def run(batches):
        for b in batches:
            rows = []
            for path, media in zip(b.column("path").to_pylist(), b.column("content")):
                try:
                    rows += [{"path": path, **r, "error": None} for r in clips_of(media.as_py() or b"")[0]]
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows.append({"path": path, "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("error", pa.string())]))

    return files.select("path", "content").mapInArrow(run, "path string, clip int, first_frame int, last_frame int, start_s double, end_s double, error string")


def media_files(docs: DataFrame) -> DataFrame:
    """doc_id, media (binary): each whole text stored as an AVI file."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([write_avi(padded((x.as_py() or "").encode())) for x in b.column("text")], pa.binary())], ["doc_id", "media"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, media binary")


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def media_digests(docs: DataFrame) -> DataFrame:
    """What each text's AVI gives when read back; the columns of op3's contract.

    Null and empty texts are stored as 64 zero bytes.  Texts of any length are
    stored whole; repeated rows repeat; extra columns are ignored; an empty
    table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            rows = []
            for x in b.column("text"):
                raw = (x.as_py() or "").encode()
                media = write_avi(padded(raw))
                rows_, avi, frames = clips_of(media)
                back = payload_of(avi, frames)
                feature = f"frames={len(frames)};clips=" + ",".join(f"{r['start_s']:.2f}-{r['end_s']:.2f}" for r in rows_)
                feature += f";hist={zlib.crc32(np.round(np.mean(avi['hists'], axis=0) * 1000).astype('<i4').tobytes()):08x}"
                rows.append((len(raw), len(back), sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), sha256(media).hexdigest(), feature))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", *names])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op3_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
