"""Operators on documents against brute force, on edge rows, on empty tables and on the smallest data."""

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import avi, bpe, exact_dedup, lang_id, lm_score, packing, simhash, suffix_dedup
from marlstone.llm.common import table
from marlstone.llm.suffix_array import suffix_array
from tests.llm.conftest import edge_rows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["edge", "data"])
def docs(request, spark, sf, edge):
    return edge if request.param == "edge" else table(spark, sf, "documents")


# op1


def test_lm_counts_and_base(docs):
    got = sorted(map(tuple, lm_score.score_documents(docs).drop("score").collect()), key=repr)
    tokens = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in texts_of(docs)]
    learnt = Counter(w for i, ws in tokens if i is not None and zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(learnt.values()), len(learnt)
    want = sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(learnt[w] > 0 for w in ws), n, sum(math.log10((learnt[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


def test_lm_scores_follow_the_mixture(spark):
    data = [(i, t) for i, t in enumerate(["a b a b", "a b c", "b a", "c c a b", "a b a", "", "b b a", "a b", "c a b", "a b b", "a c"] * 3)]
    got = {r.doc_id: r.score for r in lm_score.score_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    seq = lambda t: [b""] + t.encode().split() + [b""]
    uni, pair, uni_em, pair_em = Counter(), Counter(), Counter(), Counter()
    for i, t in data:
        if fold(i):
            s = seq(t)
            uni.update(s[1:])
            pair.update(zip(s, s[1:]))
            if fold(i) == 1:
                uni_em.update(s[1:])
                pair_em.update(zip(s, s[1:]))
    n, v, ne = sum(uni.values()), len(uni), sum(uni_em.values())
    bucket = lambda c: c.bit_length()
    events = Counter()
    for i, t in data:
        if fold(i) == 1:
            s = seq(t)
            for a, b in zip(s, s[1:]):
                ca, cb, cab = uni[a] - uni_em[a], uni[b] - uni_em[b], pair[a, b] - pair_em[a, b]
                q = lambda x: round(-lm_score.STEPS * math.log2(x)) if x > 0 else -1
                events[bucket(ca), q(cab / ca) if ca else -1, q((cb + 0.1) / (n - ne + 0.1 * (v + 1)))] += 1
    import pandas as pd

    grid = pd.DataFrame([(*k, c) for k, c in events.items()], columns=["bucket", "q2", "q1", "n"])
    lam = lm_score.learn_weights(grid, 1 / (v + 1))
    for i, t in data:
        s, total = seq(t), 0.0
        for a, b in zip(s, s[1:]):
            w = lam[bucket(uni[a])]
            total += math.log10(w[0] * pair[a, b] / max(uni[a], 1) + w[1] * (uni[b] + 0.1) / (n + 0.1 * (v + 1)) + w[2] / (v + 1))
        assert abs(total - got[i]) < 1e-6


def test_lm_keeps_large_and_textual_ids(spark):
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "one two"), (None, "two"), (big + 1, None)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in lm_score.score_documents(docs).collect()} == {big, None, big + 1}
    got = lm_score.score_documents(docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))).collect()
    assert {r.doc_id for r in got} == {f"d{big}", None, f"d{big + 1}"}


def test_em_raises_held_out_likelihood_over_even_weights():
    import pandas as pd

    grid = pd.DataFrame({"bucket": [3, 3, 3], "q2": [4, -1, 2], "q1": [20, 28, 16], "n": [50, 10, 30]})
    w = lm_score.learn_weights(grid, 1e-4)
    like = lambda w: sum(n * math.log(sum(x * y for x, y in zip(w, (0 if a < 0 else 2 ** (-a / 4), 2 ** (-b / 4), 1e-4)))) for _, a, b, n in grid.itertuples(index=False))
    assert like(w[3]) > like([1 / 3] * 3) and abs(w[3].sum() - 1) < 1e-9
    assert (w[7] == w[3]).all() and (w[0] == w[3]).all()


def test_lm_beats_its_base_on_held_out_text(spark, sf):
    got = [r for r in lm_score.op1_lm_score(spark, sf).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


# op2


def test_language_accuracy_on_held_out_rows(spark, sf):
    lang = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    got = [r for r in lang_id.op2_lang_id(spark, sf).collect() if r.held_out]
    assert len(got) > 40 and sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(edge):
    model = lang_id.fit(edge)
    got = lang_id.identify(edge, model)
    assert got.count() == edge.count()
    by = {r.doc_id: r for r in got.collect()}
    assert all(by[i].lang_pred == "und" and by[i].rejected for i in (0, 1, 2, 12))
    assert by[5].lang_pred in ("en", "fr") and not by[5].rejected
    kept = lang_id.keep_identified(edge, model)
    assert kept.columns == edge.columns and {0, 1, 2, 12}.isdisjoint(r.doc_id for r in kept.collect())


def test_nearest_centroid_is_the_brute_force_one(spark, sf):
    docs = table(spark, sf, "documents")
    model = lang_id.fit(docs)
    for r in docs.limit(40).collect():
        x = np.log1p(lang_id.term_counts(r.text)) * model["idf"]
        cos = [float(x @ c) / (np.linalg.norm(x) or 1) for c in model["centroids"]]
        (lang, score, _), = lang_id.predict_texts([r.text], model)
        assert lang == model["langs"][int(np.argmax(cos))] and abs(score - max(cos)) < 1e-4


# op3


def test_media_round_trip(docs):
    got = {r.doc_id: r for r in avi.media_digests(docs).collect()}
    for i, t in texts_of(docs):
        if i is not None:
            raw = (t or "").encode()
            full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
            r = got[i]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), sha256(full).hexdigest(), zlib.crc32(full[-64:]))


def test_any_bytes_survive_and_both_decoders_agree():
    r = random.Random(3)
    for n in (64, 640, 64 * 64, 64 * 65):
        raw = bytes(r.choice((0, 255, 255, 1, 127, 128)) for _ in range(n))
        _, facts, frames = avi.clips_of(avi.write_avi(raw))
        assert avi.payload_of(facts, frames) == raw
    frame = avi.parse_avi(avi.write_avi(b"plain text " * 64))["frames"][0]
    fast = avi.decode_jpeg(frame)
    slow = avi._scan(bytes(frame), bytes(frame).index(b"\xff\xda") + 10, {0: {(1, 0): 8}, 16: {(1, 0): 8}}, {1: 0}, [(1, 1, 1, 0)], fast["wide"], fast["high"], 1)
    assert (fast["coefs"] == slow).all()


def test_shots_split_where_the_histogram_jumps():
    dark, light = np.eye(16)[1], np.eye(16)[14]
    assert avi.shots([dark] * 5 + [light] * 4 + [dark]) == [(0, 4), (5, 8), (9, 9)]
    assert avi.shots([]) == []


def test_clips_of_broken_files(spark):
    files = spark.createDataFrame([("a", bytearray(avi.write_avi(b"x" * 64))), ("b", bytearray(b"RIFFxxxx")), ("c", None)], "path string, content binary")
    got = {r.path: r for r in avi.clips(files).collect()}
    assert got["a"].end_s == 0.04 and got["b"].error and got["c"].error


# op5


def brute_removed(texts, n=200):
    starts = Counter(t[s : s + n] for t in texts for s in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - n + 1):
            if starts[t[s : s + n]] > 1:
                gone[s : s + n] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        out.append((len(t), int(gone.sum()), runs, sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def check_removed(df):
    pairs = texts_of(df)
    want = sorted([(i, *w) for (i, _), w in zip(pairs, brute_removed([(t or "").encode() for _, t in pairs]))], key=repr)
    assert rows(suffix_dedup.removal_digests(df)) == want


def test_repeats_are_the_brute_force_ones(docs):
    check_removed(docs)


def test_repeats_in_short_alphabets(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcdé ") for _ in range(600)) for _ in range(4)]
    data = []
    for i in range(120):
        t = list(r.choice(base)[r.randint(0, 200) : r.randint(300, 600)])
        for _ in range(r.randint(0, 3)):
            t[r.randrange(len(t))] = r.choice("xyz")
        data.append((i, "".join(t)))
    data += [(900, "a" * 1000), (901, "ab" * 300), (902, "a" * 199), (903, "a" * 200), (904, "abc" * 100)]
    check_removed(spark.createDataFrame(data, "doc_id long, text string").repartition(4))


def test_suffix_array_sorts_suffixes():
    r = random.Random(0)
    for _ in range(3000):
        s = [r.randrange(r.choice((1, 2, 3, 200))) for _ in range(r.randint(0, 40))] * r.choice((1, 1, 2))
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_counting_many_stretches_agrees_with_sorting(monkeypatch):
    r = random.Random(1)
    side = lambda: bytes(r.choice(b"ab") for _ in range(r.randint(10, 16)))
    groups = [list({(side(), side()) for _ in range(12)}) for _ in range(40)]
    sorted_ = suffix_dedup.sort_stretches(groups)
    monkeypatch.setattr(suffix_dedup, "LARGE", 1)
    assert suffix_dedup.sort_stretches(groups) == sorted_


def test_cut_texts_keep_columns_and_whole_characters(edge):
    got = suffix_dedup.without_repeats(edge)
    assert got.columns == edge.columns and got.count() == edge.count()
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[0] is None and by[1] == "" and by[5] == "" and "�" not in "".join(t or "" for t in by.values())


# op7, op9


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_ids_are_the_library_s(docs, library):
    got = {r.doc_id: r for r in bpe.encoding_digests(docs).collect()}
    for i, t in texts_of(docs):
        if i is not None:
            ids = library.encode(t or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(back.encode()).hexdigest())


def test_random_words(library):
    r = random.Random(2)
    texts = ["".join(r.choice("aabeinrst'’.é9ΣİS漢 ") for _ in range(r.randint(0, 25))) for _ in range(3000)] + ["a" * n for n in range(1, 90)] + ["ha" * n for n in range(1, 40)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert bpe.encode(t) == e.ids
        assert b"".join(i.to_bytes(4, "little") for i in e.ids) == packing.token_bytes(t, bpe.default_path(), None)


def check_packing(df, library):
    got = packing.pack(df, group=7).collect()
    pieces, seqs = {}, {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    want = Counter()
    for i, t in texts_of(df):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for a in range(0, len(ids), 4096):
            want[i, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want


def test_every_id_is_packed_once(docs, library):
    check_packing(docs, library)


def test_first_fit_decreasing_is_the_plain_one():
    r = random.Random(4)
    for _ in range(200):
        sizes = [r.randint(1, 100) for _ in range(r.randint(0, 60))]
        room, want = [], [None] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b, x in enumerate(room) if x >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            want[i] = (b, 100 - room[b])
            room[b] -= sizes[i]
        assert packing.first_fit_decreasing(sizes, 100) == want


def test_sequences(spark, sf):
    docs = table(spark, sf, "documents").limit(40)
    total = sum(len(packing.token_bytes(t, bpe.default_path())) // 4 for _, t in texts_of(docs))
    assert sum(r.n_ids for r in packing.packed_sequences(docs).collect()) == total


# op8


def brute_fingerprint(t):
    toks = (t or "").encode().lower().split()
    grams = [b" ".join(toks[i : i + 4]) for i in range(max(1, len(toks) - 3))] if toks else []
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, a in pairs:
        for j, b in pairs:
            if (a ^ b).bit_count() <= 4:
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in pairs}


def test_fingerprints_and_components(docs):
    pairs = [(i, brute_fingerprint(t)) for i, t in texts_of(docs)]
    comp = brute_components([p for p in pairs if p[0] is not None])
    of_fp = {f: comp[i] for i, f in pairs if i is not None}
    want = sorted(((i, f"{f:016x}", of_fp.get(f)) for i, f in pairs), key=repr)
    assert rows(simhash.near_duplicates(docs)) == want


@pytest.mark.parametrize("distinct", [10, 10**6, 10**9])
def test_close_fingerprints_meet_in_a_shard(distinct):
    r = random.Random(6)
    masks = simhash.bands(distinct, 4)
    for _ in range(2000):
        a = r.getrandbits(64)
        b = a ^ sum(1 << i for i in r.sample(range(64), 4))
        assert any(a & m == b & m for m in masks)


def test_chains_and_clusters_of_fingerprints(spark):
    r = random.Random(8)
    fps, at = [], r.getrandbits(64)
    for _ in range(60):  # a chain of steps of four bits
        at ^= sum(1 << i for i in r.sample(range(64), 4))
        fps.append(at)
    fps += [fps[0] ^ (1 << i) for i in range(64)] + [r.getrandbits(64) for _ in range(200)] + [0, 0, 1 << 63]
    data = list(enumerate(fps, 100))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in data], "doc_id long, fp long")
    got = {r.fp & (1 << 64) - 1: r.component_id for r in simhash.link_components(df).collect()}
    comp = brute_components(data)
    assert all(got[f] == comp[i] for i, f in data)


def test_bk_tree_finds_all_within_the_radius():
    r = random.Random(9)
    fps = [r.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for i, f in enumerate(fps):
        tree.add(f, i)
    for f in fps[:50]:
        assert sorted(tree.within(f, 3)) == [i for i, g in enumerate(fps) if (f ^ g).bit_count() <= 3]


def test_representatives(edge):
    kept = simhash.keep_representatives(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 5 in ids and 6 not in ids and 0 in ids and 1 not in ids


# op10


def test_exact_groups(docs, spark):
    pairs = texts_of(docs)
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in pairs:
        keep = max((x for x in groups[t or ""] if x is not None), default=None)
        want.append((i, keep, len(groups[t or ""]), i == keep, sha256((t or "").encode()).hexdigest()))
    assert rows(exact_dedup.deduplicate(docs, exact_dedup.new_index(spark))) == sorted(want, key=repr)


def test_the_index_outlives_a_load(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    later = spark.createDataFrame([(9, "b"), (10, "c"), (11, "c")], "doc_id long, text string")
    exact_dedup.deduplicate(first, exact_dedup.DigestIndex(spark, at)).collect()
    got = exact_dedup.deduplicate(later, exact_dedup.DigestIndex(spark, at))
    assert {r.doc_id: (r.keep_id, r.kept) for r in got.collect()} == {9: (3, False), 10: (11, False), 11: (11, True)}
    again = exact_dedup.DigestIndex(spark, at, buckets=5)
    assert again.buckets == exact_dedup.BUCKETS and again.read().count() == 3 == again.files().count()


def test_a_text_that_a_third_of_the_rows_share(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id) END AS text")
    got = exact_dedup.deduplicate(df, exact_dedup.new_index(spark))
    assert got.where("text_sha256 = sha2('hot', 256) AND group_size = 1000 AND keep_id = 2997").count() == 1000
    assert got.where("kept").count() == 2001
    assert exact_dedup.keep_first_seen(df, exact_dedup.new_index(spark)).count() == 2001


def test_compaction_leaves_each_digest_once(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/doubled")
    for ids in ((1, 2, 3), (3, 4)):
        rows_ = spark.createDataFrame([(f"{i:064x}", i, 1) for i in ids], "text_sha256 string, keep_id long, group_size long")
        index._write(rows_.withColumn("load", F.lit(f"load{len(ids)}")))  # as two loaders would that do not see each other
    assert index.read().count() == 5
    small = index.compacted(f"file://{tmp_path}/compact")
    assert sorted((r.keep_id, r.load) for r in small.read().collect()) == [(1, "load3"), (2, "load3"), (3, "load2"), (4, "load2")]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_ids_of_text(spark):
    df = spark.createDataFrame([("b", "same words here"), ("a", "same words here"), (None, "same words here"), ("c", "another text"), ("c", "another text")], "doc_id string, text string")
    got = exact_dedup.deduplicate(df, exact_dedup.new_index(spark, id_type="string")).collect()
    assert sorted((r.doc_id or "", r.keep_id, r.kept) for r in got) == [("", "b", False), ("a", "b", False), ("b", "b", True), ("c", "c", True), ("c", "c", True)]
    assert sorted(r.doc_id for r in exact_dedup.keep_first_seen(df, exact_dedup.new_index(spark, id_type="string")).collect()) == ["b", "c"]
    near = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), ("c", "five six seven eight"), (None, "five six seven eight")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.component_id) for r in simhash.near_duplicates(near).collect()) == [("", "c"), ("a", "a"), ("b", "a"), ("c", "c")]
    linked = spark.createDataFrame([("x", 0), ("y", 7), ("w", 63), ("v", -1)], "doc_id string, fp long")
    assert sorted((r.fp, r.component_id) for r in simhash.link_components(linked).collect()) == [(-1, "v"), (0, "w"), (7, "w"), (63, "w")]


def test_rows_that_stay(edge, spark):
    kept = exact_dedup.keep_first_seen(edge, exact_dedup.new_index(spark))
    assert kept.columns == edge.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in edge_rows()})


# empty tables


@pytest.mark.parametrize("run", [
    lm_score.score_documents, lambda d: lang_id.identify(d, lang_id.fit(d)), avi.media_digests, suffix_dedup.removal_digests, suffix_dedup.without_repeats, bpe.encoding_digests,
    simhash.near_duplicates, simhash.keep_representatives, packing.pack, lambda d: exact_dedup.deduplicate(d, exact_dedup.new_index(d.sparkSession)), lambda d: exact_dedup.keep_first_seen(d, exact_dedup.new_index(d.sparkSession)),
], ids="lm lang avi repeats cut bpe simhash representatives pack exact stay".split())
def test_empty_table(empty, run):
    assert run(empty).count() == 0


@pytest.mark.parametrize("run", [lm_score.score_documents, lambda d: lang_id.identify(d, lang_id.fit(d)), avi.media_digests, bpe.encoding_digests, packing.pack], ids="lm lang avi bpe pack".split())
def test_edge_rows_all_come_back(edge, run):
    assert {r.doc_id for r in run(edge).select("doc_id").collect()} == {r[0] for r in edge_rows()}
