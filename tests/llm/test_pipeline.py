from collections import Counter, defaultdict

import corpus_pipeline
from netloom.llm.common import WORD_PY
from tests.llm.sqlcheck import SF
from tests.llm.test_jaccard_and_html import brute_components
from tests.llm.test_native_ops import ODD
from tests.llm.test_python_ops import packs_right


def test_stages_against_brute_force(spark, tmp_path):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    outs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or docs.dtypes == first.dtypes
        outs.append(docs.collect())
    all_docs = {r.doc_id: r for r in first.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    classified, exact, near, mixed, packed = outs
    kept = {r.doc_id for r in classified}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i in kept for i, r in labels.items() if r.quality == 0) <= 2
    best = defaultdict(list)
    for r in classified:
        best["".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")].append(r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(max(v) for v in best.values())
    groups = brute_components([(r.doc_id, r.text) for r in exact], 5, 80, 100)
    assert sorted(r.doc_id for r in near) == sorted({c for _, _, c in groups})
    for r in near:
        assert r == all_docs[r.doc_id]
    size = {r.doc_id: len(WORD_PY.findall(r.text or "")) for r in near}
    got, by = Counter(), Counter()
    for r in mixed:
        got[r.doc_id] += len(WORD_PY.findall(r.text))
    assert all(got[i] <= 3 * size[i] for i in got) and abs(sum(got.values()) - sum(size.values())) <= 40
    for r in near:
        by[r.source] += got[r.doc_id]
    names = sorted(by)
    share = [by[n] / (1 + i % 3) for i, n in enumerate(names) if by[n] < 2.99 * sum(size[r.doc_id] for r in near if r.source == n)]
    assert max(share) - min(share) <= 2
    assert packs_right([(r.sequence_id, r.offset, r.length) for r in packed], 4096) <= 1.02 * sum(r.length for r in packed) / 4096 + 1
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_stages_on_odd_rows(spark):
    """Nulls, empty and repeated rows, and columns that share names with what operators add; and empty tables."""
    names = ("kept", "low", "p_low", "size", "target", "taken", "source_size", "row", "raw", "id", "may_be", "nth")
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    words = [(20 + i, " ".join(f"w{i}x{k}" for k in range(80)), "s") for i in range(6)]
    docs = spark.createDataFrame([(i, t, None, s, len(t or ""), *(f"{n} of {i}" for n in names)) for i, t, s in [*ODD, *words, words[0]]], ddl)
    labels = "/root/testdata/sf0.001"
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, labels)
            assert out.columns == docs.columns
            rows = out.collect()
            assert all(r.kept == f"kept of {r.doc_id}" and r.size == f"size of {r.doc_id}" for r in rows) and (rows or not given.count())
        assert corpus_pipeline.pack(spark, given, labels).count() == (len(ODD) + len(words) + 1 + 7 if given is docs else 0)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, labels).collect()) == [2, 4, 5, 6, 7, 20, 21, 22, 23, 24, 25]
    near = corpus_pipeline.drop_near_copies(spark, docs, labels).collect()
    assert sorted(map(str, (r.doc_id for r in near))) == sorted(map(str, [1, 3, 4, 5, 6, 7, 20, 21, 22, 23, 24, 25]))
