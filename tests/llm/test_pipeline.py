"""The corpus pipeline's stages on a small corpus, each against what brute force keeps."""

import random
import shutil

import numpy as np
import pytest
from test_llm_operators import TOKENIZER, alnum, plain_components, plain_counts, plain_ids, some_text

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, at = random.Random(6), tmp_path_factory.mktemp("corpus")
    item = " ".join(some_text(77, 40).split())
    data = [(i, some_text(1000 + i, r.randint(60, 150)), "en", f"s{i % 3}", None) for i in range(60)]
    data += [(100 + i, data[i][1], "en", "s0", None) for i in range(10)]
    data += [(200 + i, f"{some_text(50 + i, 60)} {item}", "en", "s1", 5) for i in range(5)]
    data += [(300, None, None, None, None), (301, "too short", "en", "s1", 9), (302, some_text(9, 70) + " mail a.b@c.org", "de", None, 3), (302, some_text(9, 70) + " mail a.b@c.org", "de", None, 3)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    yield str(at), data
    shutil.rmtree(at)


def test_stages(spark, corpus, tmp_path):
    at, data = corpus
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    long = [x for x in data if (c := plain_counts(x[1]))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    assert sorted(x.doc_id for x in kept["quality rules"]) == sorted(x[0] for x in long)
    groups = {c for *_, c in plain_components([x[:2] for x in long])}
    assert sorted(str(x.doc_id) for x in kept["n-gram Jaccard join"]) == sorted(groups)
    item = alnum(some_text(77, 40))
    clean = [x for x in kept["n-gram Jaccard join"] if " ".join(item[:13]) not in " ".join(alnum(x.text))]
    assert sorted(x.doc_id for x in kept["benchmark decontamination"]) == sorted(x.doc_id for x in clean) and len(clean) < len(kept["n-gram Jaccard join"])
    private = {x.doc_id: x for x in kept["personal data"]}
    assert len(private) == len(clean) and private[302].text.endswith("mail [EMAIL]") and private[302].n_chars == len(private[302].text)
    want = {d: ids for d, ids in plain_ids([(x.doc_id, x.text) for x in private.values()])}
    got = {d: np.zeros(0, "<u4") for d in want}
    for p in sorted(kept["packing"], key=lambda p: (p.doc_id, p.start)):
        got[p.doc_id] = np.concatenate([got[p.doc_id], np.frombuffer(p.ids, "<u4")])
    assert {d: v.tolist() for d, v in got.items()} == want and TOKENIZER


def test_near_copies_on_five_words_go(spark):
    """Pairs that are linked on five-word shingles from 0.8, but not on three-word ones from 0.9."""
    base = [[f"w{k}x{i}" for i in range(n)] for k, n in enumerate((100, 200, 100, 100))]
    swap = lambda w, at: [f"new{i}" if i in at else x for i, x in enumerate(w)]
    near = [swap(base[0], {30, 60}), swap(base[1], {30, 60, 90, 120}), base[2] + [f"end{i}" for i in range(12)], swap(base[3], {20, 45, 70})]
    data = [(i, " ".join(w)) for i, w in enumerate(base + near)]
    kept = sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string"), "").collect())
    assert kept == sorted({int(c) for *_, c in plain_components(data, 5, 80)}) == [0, 1, 2, 3, 7]
    assert len({c for *_, c in plain_components(data)}) == 8


def test_run_and_empty(spark, corpus, tmp_path):
    at, _ = corpus
    assert corpus_pipeline.run(spark, at).count() > 50
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
