"""Removal of repeated byte strings over the whole corpus, by suffix sorting.

Every byte goes that is covered by a string of LENGTH bytes that also starts
anywhere else.  No machine can hold the corpus's suffix array, and no shuffle
its suffixes, so what must be sorted is narrowed down first, exactly:

1.  Each start has an anchor: the K-byte string with the lowest hash in its
    LENGTH bytes.  Equal strings have equal anchors at equal places.  Starts in
    a row with one anchor form a record; its span is all bytes of its strings.
    Records are counted by (anchor, span): equal spans repeat as a whole.
2.  A record whose span stands alone but whose anchor does not is where a
    repeat begins or ends.  Its starts are cut into stretches of STRETCH; the
    strings of a stretch share a core.  Records meet by the core's hash.
3.  Those that meet are sorted: the core, the same in all of them, is one
    symbol, so a stretch is at most 2 * STRETCH - 1 symbols, and strings of
    LENGTH bytes are strings of STRETCH symbols.  A start repeats if it agrees
    with a neighbour in the suffix array on as many symbols.
"""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .blocks import arrow_blocks, buckets_of, dealt, numbers_in_bucket, rows_of, squeeze, unsqueeze
from .common import bounded_batches, bucketed, materialise, table
from .suffix_array import repeated_starts

LENGTH, K, STRETCH = 200, 64, 17
SEGMENT = 1 << 19  # starts whose anchors are found at once; below 2 ** 24
CHUNK = 200_000  # symbols sorted at once, about
LARGE = 20_000  # distinct stretches around one core from which they are counted instead of sorted
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = 1 << n.bit_length()
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(m - 1, np.uint64(b), np.uint64))), dtype=np.uint64) for b in (_BASE, pow(int(_BASE), -1, 1 << 64))]
    return _powers[0], _powers[1]


def window_hashes(raw: bytes, k: int) -> np.ndarray:
    """A 64-bit hash of each k bytes of raw."""
    up, down = _tables(len(raw) + 1)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * down[: len(raw)], out=total[1:])
    h = (total[k:] - total[:-k]) * up[: len(raw) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchor_places(h: np.ndarray, starts: int, width: int) -> np.ndarray:
    """For each start s, the leftmost place of the lowest of h[s : s + width] (by its upper 40 bits)."""
    m, step = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * step <= width:
        m, step = np.minimum(m[:-step], m[step:]), 2 * step
    if step < width:
        m = np.minimum(m[: step - width], m[width - step :])
    return (m[:starts] & np.uint64(0xFFFFFF)).astype(np.int32)


def span_hashes(raw: bytes, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each lo to hi + LENGTH and of the anchor's place in them."""
    up, down = _tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * down[: len(raw)], out=total[1:])
    h = (total[hi + LENGTH] - total[lo]) * up[lo]
    h ^= h >> np.uint64(32)
    h = (h + (hi - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return (h + (at - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)


def records(raw: bytes, lens: np.ndarray):
    """(anchor hash, span hash, first start, last start, anchor place) of the records of the texts joined in raw, a segment at a time."""
    ends = np.cumsum(lens)
    firsts, lasts = (ends - lens)[lens >= LENGTH], (ends - LENGTH)[lens >= LENGTH]  # first and last start of each text
    a, n = 0, len(raw) - LENGTH + 1
    while a < n:
        z = min(n, a + SEGMENT)
        part = raw[a : z - 1 + LENGTH]
        inside = np.zeros(z - a + 1, np.int32)
        i, j = np.searchsorted(lasts, a), np.searchsorted(firsts, z)
        np.add.at(inside, np.maximum(firsts[i:j] - a, 0), 1)
        np.add.at(inside, np.minimum(lasts[i:j] + 1 - a, z - a), -1)
        starts = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
        if len(starts):
            h = window_hashes(part, K)
            place = anchor_places(h, z - a, LENGTH - K + 1)[starts].astype(np.int64)
            cut = np.flatnonzero((place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
            heads = np.concatenate(([0], cut))
            lo, hi = starts[heads], starts[np.concatenate((cut - 1, [len(starts) - 1]))]
            at = place[heads]
            if z < n and hi[-1] == z - a - 1 and (len(lo) > 1 or lo[0] > 0):  # the last one may go on: once more with the next segment
                z = a + int(lo[-1])
                lo, hi, at = lo[:-1], hi[:-1], at[:-1]
            if len(lo):
                yield h[at], span_hashes(part, lo, hi, at), lo + a, hi + a, at + a
        a = z


def distinct(anchor: np.ndarray, span: np.ndarray, count: np.ndarray):
    """The distinct (anchor, span) with their counts, and each row's place among them."""
    order = np.lexsort((span, anchor))
    a, s = anchor[order], span[order]
    new = np.concatenate((np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (s[1:] != s[:-1])))
    heads = np.flatnonzero(new)
    at = np.empty(len(a), np.int64)
    at[order] = np.cumsum(new) - 1
    return a[heads], s[heads], np.add.reduceat(count[order], heads) if len(heads) else count, at


def text_and_records(docs: DataFrame, parts: int) -> DataFrame:
    """Blocks of docs: the other columns, texts, records, and distinct (anchor, span) dealt into parts with counts."""

    def run(batches):
        from pyspark import TaskContext

        numbers = numbers_in_bucket(TaskContext.get().partitionId(), buckets_of(parts))  # a task writes one file
        for (_, rest, texts), number in zip(arrow_blocks(batches), numbers):
            lens = np.array([len(t) for t in texts], np.int64)
            raw = b"".join(texts)
            texts.clear()
            own, places, n = [], [[], [], []], 0
            uids = []
            for anchor, span, *where in records(raw, lens):
                a, s, c, at = distinct(anchor, span, np.ones(len(anchor), np.int64))
                own.append((a, s, c))
                uids.append((at + n).astype("<u4"))
                n += len(a)
                for x, v in zip(places, where):
                    x.append(v.astype("<u4"))
            a, s, c, at = distinct(*(np.concatenate(x) for x in zip(*own))) if own else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            deal, borders = dealt(a % np.uint64(parts), parts)
            back = np.empty(len(a), np.int64)
            back[deal] = np.arange(len(deal))
            uid = back[at][np.concatenate(uids)] if uids else np.zeros(0, np.int64)
            lo, hi, place = (np.concatenate(x) if x else np.zeros(0, "<u4") for x in places)
            cells = [rest, squeeze(lens), squeeze(raw), *[squeeze(x.astype("<u4")) for x in (lo, hi, place, uid, borders)], a[deal].tobytes(), s[deal].tobytes(), squeeze(c[deal].astype("<u4"))]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([x], pa.binary()) for x in cells]], BLOCK_COLUMNS)

    return bounded_batches(docs).mapInArrow(run, ", ".join(f"{c} {KEY_TYPES.get(c, 'binary')}" for c in BLOCK_COLUMNS))


KEY_TYPES = {"block": "long", "part": "int"}
BLOCK_COLUMNS = ["block", "rest", "lens", "raw", "lo", "hi", "at", "uid", "borders", "anchors", "spans", "counts"]
ALONE, REPEATED, REPEATED_SHOWN, OPEN = range(4)


def _split(batches, parts: int, cells, names: list[str]):
    """Rows (block, part, cells) of each block's slices by part; cells(row) gives borders and functions of a slice."""
    for b in batches:
        for row in b.to_pylist():
            borders, slices = cells(row)
            out = [(row["block"], p, *[f(slice(borders[p], borders[p + 1])) for f in slices]) for p in range(parts) if borders[p] < borders[p + 1]]
            if out:
                kinds = [pa.int64(), pa.int32(), *[pa.binary()] * len(slices)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["block", "part", *names])


def span_service(blocks: DataFrame, parts: int) -> DataFrame:
    """(block, part, status): what each distinct (anchor, span) of a block is, over all blocks."""

    def ask(batches):
        def cells(row):
            a, s, c = np.frombuffer(row["anchors"], "<u8"), np.frombuffer(row["spans"], "<u8"), unsqueeze(row["counts"], "<u4")
            return unsqueeze(row["borders"], "<u4"), [lambda x: a[x].tobytes(), lambda x: s[x].tobytes(), lambda x: squeeze(c[x])]

        yield from _split(batches, parts, cells, ["anchors", "spans", "counts"])

    def answer(t: pa.Table) -> pa.Table:
        a, s, c = ([np.frombuffer(x.as_py(), "<u8") for x in t["anchors"]], [np.frombuffer(x.as_py(), "<u8") for x in t["spans"]], [unsqueeze(x.as_py(), "<u4") for x in t["counts"]])
        borders = np.cumsum([len(x) for x in a])[:-1]
        a, s, c = np.concatenate(a), np.concatenate(s), np.concatenate(c).astype(np.int64)
        order = np.lexsort((s, a))
        a, s = a[order], s[order]
        new_a = np.concatenate(([True], a[1:] != a[:-1]))
        new = new_a | np.concatenate(([True], s[1:] != s[:-1]))
        total = np.add.reduceat(c[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        spans = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_a))[np.cumsum(new_a) - 1]
        got = np.where(total > 1, np.where((spans > 1) & new, REPEATED_SHOWN, REPEATED), np.where(spans > 1, OPEN, ALONE)).astype(np.uint8)
        status = np.empty_like(got)
        status[order] = got
        return pa.table({"block": t["block"], "part": t["part"], "status": pa.array([squeeze(x) for x in np.split(status, borders)], pa.binary())})

    asked = blocks.select("block", "borders", "anchors", "spans", "counts").mapInArrow(ask, "block long, part int, anchors binary, spans binary, counts binary")
    return asked.groupBy("part").applyInArrow(answer, "block long, part int, status binary")


def stretches(raw: bytes, lo: int, hi: int, at: int):
    """(first start, core hash, left bytes, right bytes) of each stretch of a record."""
    digest = xxhash.xxh3_64_intdigest
    for j in range((at - hi) // STRETCH, (at - lo) // STRETCH + 1):
        top = at - STRETCH * j
        low = top - STRETCH + 1
        a, z = max(lo, low), min(hi, top)
        yield a, digest(raw[top : low + LENGTH], (j << 8) + 1), raw[a:top], raw[low + LENGTH : z + LENGTH]


def open_blocks(blocks: DataFrame, statuses: DataFrame, parts: int) -> DataFrame:
    """What is settled in each block, and the stretches of its open records, dealt into parts by core."""
    names = ["block", "from", "to", "first", "borders", "cores", "lengths", "sides"]

    def run(b: pa.Table, r: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in names}
        for row in b.to_pylist():
            lo, hi, at, uid, borders = (unsqueeze(row[c], "<u4").astype(np.int64) for c in ("lo", "hi", "at", "uid", "borders"))
            status = np.zeros(borders[-1], np.uint8)
            for p, s in zip(r["part"].to_pylist(), r["status"].to_pylist()):
                status[borders[p] : borders[p + 1]] = unsqueeze(s, np.uint8)
            mine = status[uid] if len(uid) else np.zeros(0, np.uint8)
            settled = (mine == REPEATED) | (mine == REPEATED_SHOWN)
            _, once = np.unique(uid, return_index=True)  # a span that the block has several times is shown once
            shown = once[mine[once] >= REPEATED_SHOWN]
            raw = unsqueeze(row["raw"]) if len(shown) else b""
            got = [x for i in shown.tolist() for x in stretches(raw, int(lo[i]), int(hi[i]), int(at[i]))]
            cores = np.array([g[1] for g in got], np.uint64)
            order, cut = dealt(cores % np.uint64(parts), parts)
            got = [got[i] for i in order.tolist()]
            for c, v in zip(names, (
                row["block"], squeeze(lo[settled].astype("<u4")), squeeze((hi[settled] + LENGTH).astype("<u4")), squeeze(np.array([g[0] for g in got], "<u4")), squeeze(cut.astype("<u4")),
                cores[order].tobytes(), bytes(len(x) for g in got for x in g[2:]), b"".join(x for g in got for x in g[2:]),
            )):
                out[c].append(v)
        return pa.table({c: pa.array(v, {"block": pa.int64()}.get(c, pa.binary())) for c, v in out.items()})

    left = blocks.select("block", "raw", "lo", "hi", "at", "uid", "borders").groupBy("block")
    schema = ", ".join(f"`{c}` {KEY_TYPES.get(c, 'binary')}" for c in names)
    return left.cogroup(statuses.groupBy("block")).applyInArrow(run, schema)


def sort_stretches(groups: list[list[tuple[bytes, bytes]]]) -> list[list[int]]:
    """For each group of distinct (left, right) around one core: a mask of each one's starts that repeat within the group."""
    out = [[0] * len(g) for g in groups]
    text: list[int] = []
    owner: list[tuple[int, int, int]] = []  # place of a stretch's first start, group, member

    def settle():
        starts = [o[0] for o in owner]
        k = 0
        for i in repeated_starts(text, STRETCH):
            while k + 1 < len(starts) and starts[k + 1] <= i:
                k += 1
            at, g, m = owner[k]
            left, right = groups[g][m]
            if i - at <= len(left) and i - at + STRETCH <= len(left) + 1 + len(right):  # it holds the core and ends in the stretch
                out[g][m] |= 1 << (i - at)
        text.clear()
        owner.clear()

    for g, members in enumerate(groups):
        if len(members) >= LARGE:
            out[g] = count_stretches(members)
            continue
        for m, (left, right) in enumerate(members):
            owner.append((len(text), g, m))
            text.extend(left)
            text.append(257 + g)
            text.extend(right)
            text.append(256)
        if len(text) >= CHUNK:
            settle()
    if text:
        settle()
    return out


def count_stretches(members: list[tuple[bytes, bytes]]) -> list[int]:
    """The same for a core with very many distinct sides: each string is counted by its left and right part."""
    out = [0] * len(members)
    for n in range(STRETCH):  # bytes on the left
        has = [(i, left[len(left) - n :], right[: STRETCH - 1 - n]) for i, (left, right) in enumerate(members) if len(left) >= n and len(right) >= STRETCH - 1 - n]
        seen = Counter((a, b) for _, a, b in has)
        for i, a, b in has:
            if seen[a, b] > 1:
                out[i] |= 1 << (len(members[i][0]) - n)
    return out


def stretch_service(opened: DataFrame, parts: int) -> DataFrame:
    """(block, part, masks): for each stretch of a block the starts that repeat, as bits."""

    def ask(batches):
        def cells(row):
            cores, lengths = np.frombuffer(row["cores"], "<u8"), np.frombuffer(row["lengths"], np.uint8)
            at, sides = np.concatenate(([0], np.cumsum(lengths.astype(np.int64)))), row["sides"]
            return unsqueeze(row["borders"], "<u4"), [
                lambda x: cores[x].tobytes(), lambda x: lengths[2 * x.start : 2 * x.stop].tobytes(), lambda x: sides[at[2 * x.start] : at[2 * x.stop]]
            ]

        yield from _split(batches, parts, cells, ["cores", "lengths", "sides"])

    def answer(t: pa.Table) -> pa.Table:
        cores = [np.frombuffer(x.as_py(), "<u8") for x in t["cores"]]
        borders = np.cumsum([len(x) for x in cores])[:-1]
        cores = np.concatenate(cores)
        lengths = np.frombuffer(b"".join(t["lengths"].to_pylist()), np.uint8).astype(np.int64)
        at, sides = np.concatenate(([0], np.cumsum(lengths))).tolist(), b"".join(t["sides"].to_pylist())
        masks = np.zeros(len(cores), "<u4")
        order = np.argsort(cores, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], cores[order][1:] != cores[order][:-1])))
        sizes = np.diff(np.append(heads, len(order)))
        asked, groups = [], []
        for a, n in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            same: dict[tuple[bytes, bytes], list[int]] = {}
            for i in order[a : a + n].tolist():
                same.setdefault((sides[at[2 * i] : at[2 * i + 1]], sides[at[2 * i + 1] : at[2 * i + 2]]), []).append(i)
            for (left, right), mine in same.items():
                if len(mine) > 1:  # the whole stretch repeats
                    masks[mine] = (1 << (len(left) + len(right) - STRETCH + 2)) - 1
            if len(same) > 1:
                asked.append(list(same.values()))
                groups.append(list(same))
        for mine, found in zip(asked, sort_stretches(groups)):
            for members, mask in zip(mine, found):
                if mask:
                    masks[members] |= np.uint32(mask)
        return pa.table({"block": t["block"], "part": t["part"], "masks": pa.array([squeeze(x) for x in np.split(masks, borders)], pa.binary())})

    asked = opened.select("block", "borders", "cores", "lengths", "sides").mapInArrow(ask, "block long, part int, cores binary, lengths binary, sides binary")
    return asked.groupBy("part").applyInArrow(answer, "block long, part int, masks binary")


def _removed(size: int, replies: pa.Table) -> np.ndarray:
    """A mask of the block's removed bytes, from what open_blocks settled (the row without a part) and the masks of the parts."""
    rows = replies.to_pylist()
    (row,) = [r for r in rows if r["part"] is None]
    first, borders = unsqueeze(row["first"], "<u4").astype(np.int64), unsqueeze(row["borders"], "<u4")
    masks = np.zeros(len(first), "<u4")
    for r in rows:
        if r["part"] is not None:
            masks[borders[r["part"]] : borders[r["part"] + 1]] = unsqueeze(r["masks"], "<u4")
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, unsqueeze(row["from"], "<u4").astype(np.int64), 1)
    np.add.at(change, unsqueeze(row["to"], "<u4").astype(np.int64), -1)
    for bit in range(STRETCH):
        s = first[(masks >> np.uint32(bit)) & np.uint32(1) == 1] + bit
        np.add.at(change, s, 1)
        np.add.at(change, s + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def _per_document(docs: DataFrame, schema: T.StructType, emit) -> DataFrame:
    """Runs the three steps; emit(rows, text bytes, removed mask, starts, ends) gives each block's result table."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(text_and_records(docs, parts), "suffix-blocks", "block", buckets_of(parts))
    opened = materialise(open_blocks(blocks, span_service(blocks, parts), parts), "suffix-open")
    masks = stretch_service(opened, parts)
    to_arrow = [f.name for f in schema.fields]

    def run(b: pa.Table, r: pa.Table) -> pa.Table:
        out = []
        for row in b.to_pylist():  # one: a block's text meets what is settled and its masks
            lens, raw = unsqueeze(row["lens"], np.int64), unsqueeze(row["raw"])
            ends = np.cumsum(lens)
            out.append(emit(rows_of(row["rest"]), raw, _removed(len(raw), r), ends - lens, ends).select(to_arrow))
        return pa.concat_tables(out)

    found = opened.select("block", F.lit(None).cast("int").alias("part"), "from", "to", "first", "borders", F.lit(None).cast("binary").alias("masks")).unionByName(masks, allowMissingColumns=True)
    # texts stay in the files of their buckets; only what was found out about them moves
    left = blocks.select("block", "rest", "lens", "raw").groupBy("block")
    return left.cogroup(found.groupBy("block")).applyInArrow(run, schema)


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text).

    Strings are judged on the input; a repeated row or text repeats as a whole
    if it is LENGTH bytes or more.  Shorter, null and empty texts lose nothing.
    Texts of any length are used whole; a null doc_id is a row like any other;
    extra columns are ignored; an empty table gives no rows.
    """
    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    schema = T.StructType([id_field, *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])

    def emit(rows, raw, gone, starts, ends):
        before = np.concatenate(([0], np.cumsum(gone)))
        opens = gone & ~np.concatenate(([False], gone[:-1]))
        opens[starts[(starts < ends)]] |= gone[starts[starts < ends]]
        spans = np.concatenate(([0], np.cumsum(opens)))
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        n_gone = before[ends] - before[starts]
        at = (starts - before[starts]).tolist()
        sizes = (ends - starts - n_gone).tolist()
        return pa.table({
            "doc_id": rows["doc_id"], "n_bytes": pa.array(ends - starts, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "n_spans": pa.array(spans[ends] - spans[starts], pa.int64()),
            "kept_sha256": pa.array([sha256(kept[a : a + n]).hexdigest() for a, n in zip(at, sizes)], pa.string()),
        })

    return _per_document(docs.select("doc_id", "text"), schema, emit)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated strings cut out of text, all other columns as they are.

    Cuts are narrowed to whole characters.  A null text stays null; a text that
    repeats as a whole becomes empty.
    """

    def emit(rows, raw, gone, starts, ends):
        data = np.frombuffer(raw, np.uint8)
        lead = (data & 0xC0) != 0x80  # first bytes of characters
        if len(data):
            char = np.cumsum(lead) - 1
            whole = np.bincount(char, ~gone, minlength=int(char[-1]) + 1)[char] == 0 if char[0] == 0 else gone
            kept_mask = ~whole
        else:
            kept_mask = np.zeros(0, bool)
        before = np.concatenate(([0], np.cumsum(kept_mask)))
        kept = data[kept_mask].tobytes()
        texts = [kept[a:z].decode("utf-8", "replace") for a, z in zip(before[starts].tolist(), before[ends].tolist())]
        null = rows["__null"].to_pylist()
        return rows.append_column("text", pa.array([None if n else t for t, n in zip(texts, null)], pa.string()))

    return _per_document(docs.withColumn("__null", F.col("text").isNull()), docs.schema, emit)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))
