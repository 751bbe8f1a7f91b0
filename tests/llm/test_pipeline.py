"""The pipeline's stages on the smallest tables: each one's effect against plain versions."""

import collections
import zlib

import numpy as np
from test_operators_llm import brute_components

import corpus_pipeline as C
from spanforge.llm.common import table, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    seen = [docs]
    for _, stage in C.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SF).cache())
        assert seen[-1].columns == docs.columns
    texts = [[(r.doc_id, r.text) for r in d.collect()] for d in seen]
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {i for i, _ in texts[1]}
    assert kept <= {i for i, _ in texts[0]}
    good = [i for i, _ in texts[0] if labels.get(i) == 1]
    assert sum(i in kept for i in good) >= 0.9 * len(good)
    comp = brute_components(texts[1], 80)
    assert {i for i, _ in texts[2]} == {i for i, (_, c) in comp.items() if c == i}
    assert 0 < len(texts[3]) <= len(texts[2])
    counts = collections.Counter(i for i, _ in texts[4])
    assert max(counts.values()) <= 3 and set(counts) <= {i for i, _ in texts[3]}
    tok = Tokenizer.from_file(tokenizer_path())
    want = [(i, [*tok.encode(t, add_special_tokens=False).ids, 1]) for i, t in sorted(texts[4])]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in C.run(spark, SF).collect())
    starts = np.cumsum([0, *(len(x) for _, x in want)])
    assert got == [(starts[k], i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, (i, x) in enumerate(want)]


def test_awkward_tables(spark):
    """Nulls, empty and long texts, repeated rows and clashing or dotted columns go through every stage; empty tables too."""
    rng = np.random.default_rng(1)
    prose = lambda n: " ".join(f"word{x}" for x in rng.integers(0, 5000, n))
    twin, long = prose(200), prose(40_000)
    rows = [(1, twin, "a"), (2, twin, "b"), (2, twin, "b"), (3, None, "a"), (4, "", None), (None, prose(60), None), (None, None, None), (5, long, "c"), (6, long + " end", "c"), (7, prose(80), "a"), (7, prose(80), "a"), (8, "one two", "a")]
    schema = "doc_id bigint, text string, source string, `row` string, `a.b` int, n_words int, doc bigint, h bigint, copy int"
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], schema)
    for table_ in (docs, docs.limit(0)):
        d = table_
        for _, stage in C.STAGES[:-1]:
            d = spark.createDataFrame(stage(spark, d, SF).collect(), docs.schema)
            assert d.columns == docs.columns
        ids = collections.Counter(r.doc_id for r in d.collect())
        assert set(ids) <= {1, None, 5, 7} and max(ids.values(), default=0) <= 3
        assert C.STAGES[-1][1](spark, d, SF).count() == d.count()
