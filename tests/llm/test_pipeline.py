"""Each stage of the pipeline against brute force on what the stage before it kept: exact ids, texts and columns."""

import base64
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from marlstone.llm import bpe, lang_id
from marlstone.llm.common import table
from tests.llm.test_documents import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def planted(spark, sf):
    """The smallest documents and planted rows: copies, near copies, a long passage in several texts, noise, nulls."""
    docs = table(spark, sf, "documents")
    have = [tuple(r) for r in docs.collect()]
    r = random.Random(11)
    clean = max((x for x in have if x[2] and x[1]), key=lambda x: len(x[1]) if len(x[1]) < 6000 else 0)
    words = sorted({w for x in have if x[2] == clean[2] for w in (x[1] or "").split()})
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, lang = prose(70), clean[2]
    rows = [(900_000 + i, clean[1], lang, "planted", len(clean[1])) for i in range(3)]  # copies of one document
    rows += [(900_010, clean[1] + " " + prose(1), lang, "planted", None)]  # a near copy
    rows += [(900_020 + i, f"{prose(80)} {passage} {prose(80)}", lang, "planted", None) for i in range(4)]
    rows += [(900_030 + i, base64.b64encode(r.randbytes(900)).decode(), None, "noise", 1200) for i in range(5)]
    rows += [(900_040, None, lang, None, None), (900_041, "", lang, "planted", 0), (900_042, "12 34 !!", lang, "planted", 8), (None, prose(90), lang, "planted", None), (None, prose(90), None, None, None)]
    whole = docs.unionByName(spark.createDataFrame(rows, docs.schema)).repartition(4)
    return whole, passage


@pytest.fixture(scope="module")
def stages(spark, sf, planted, tmp_path_factory):
    """(docs, result) of each stage, written and read again."""
    out, docs = [], planted[0]
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp(name)}/rows"
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out.append(([tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()], docs.columns, after.columns))
        docs = after
    return out


def same(a, b):
    return Counter(a) == Counter(b)


def test_stage_1_keeps_what_is_identified(spark, planted, stages):
    before, after, columns, kept_columns = stages[0]
    model = lang_id.fit(planted[0].select("doc_id", "text", "lang"))
    want = []
    for row in before:
        x = np.log1p(lang_id.term_counts(row[1] or "")) * model["idf"]
        cos = model["centroids"] @ x / (np.linalg.norm(x) or 1)
        low = lang_id.SLACK * model["typical"][int(np.argmax(cos)), int(lang_id.length_class(lang_id.term_counts(row[1] or "")))]
        if lang_id.has_letter(row[1]) and cos.max() >= low:
            want.append(row)
    assert same(after, want) and kept_columns == columns
    ids = {r[0] for r in after}
    assert {900_000, 900_010, 900_020} <= ids and ids.isdisjoint({*range(900_030, 900_035), 900_040, 900_041, 900_042})
    assert sum(r[2] is not None for r in after) >= 0.97 * sum(r[2] is not None and lang_id.has_letter(r[1]) for r in before)


def test_stage_2_keeps_one_of_each_text(stages):
    before, after, columns, kept_columns = stages[1]
    best = {}
    for r in before:
        t = r[1] or ""
        if t not in best or (r[0] is not None and (best[t][0] is None or r[0] > best[t][0])):
            best[t] = r
    assert same(after, best.values()) and kept_columns == columns
    assert 900_002 in {r[0] for r in after} and 900_000 not in {r[0] for r in after}


def test_stage_3_keeps_one_of_each_group(stages):
    before, after, columns, kept_columns = stages[2]
    pairs = [(r[0], brute_fingerprint(r[1])) for r in before if r[0] is not None]
    component = brute_components(pairs)
    want = [r for r in before if r[0] is None or component[r[0]] == r[0]]
    assert same(after, want) and kept_columns == columns and len(after) < len(before)
    assert len({900_002, 900_010} & {r[0] for r in after}) == 1 if component[900_002] == component[900_010] else True


def test_stage_4_cuts_strings_that_start_twice(planted, stages):
    before, after, columns, kept_columns = stages[3]
    texts = [(r[1] or "").encode() for r in before]
    starts = Counter(t[s : s + 200] for t in texts for s in range(len(t) - 199))
    want = []
    for r, t in zip(before, texts):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - 199):
            if starts[t[s : s + 200]] > 1:
                gone[s : s + 200] = True
        kept, at = "", 0
        for ch in r[1] or "":
            n = len(ch.encode())
            if not gone[at : at + n].all():  # whole characters only
                kept += ch
            at += n
        text = None if r[1] is None else kept
        want.append((r[0], text, *r[2:4], None if text is None else len(text)))
    assert same(after, want) and kept_columns == columns
    assert not any(planted[1] in (r[1] or "") for r in after)


def test_stage_5_packs_every_id_once(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    before, after, _, columns = stages[4]
    want, sequences = Counter(), defaultdict(list)
    for r in before:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        for a in range(0, len(ids), 4096):
            want[r[0], a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()), len(ids)] += 1
    at = {c: columns.index(c) for c in columns}
    assert Counter(tuple(r[at[c]] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in after) == want
    for r in after:
        sequences[r[at["sequence_id"]]].append((r[at["offset"]], r[at["length"]]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) <= 1.1 * sum(w[2] * n for w, n in want.items()) / 4096 + 2


def test_the_whole_run_is_the_stages(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    want = Counter(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, sf).select(columns).collect()))
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).select(columns).collect())) == want and want


def test_stages_of_an_empty_table(spark, sf, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_intermediate_tables_go(spark, sf):
    from pathlib import Path

    from marlstone.llm import common

    mark = common.made_so_far()
    corpus_pipeline.run(spark, sf).write.format("noop").mode("overwrite").save()
    left = [Path(p.removeprefix("file:")) for p in common._made[mark:]]
    assert left and all(p.exists() for p in left) and not any("simhash" in p.name or "language_id" in p.name for p in left)
    assert common.drop_scratch(spark, mark) == len(left) and not any(p.exists() for p in left)
