"""Bit-plane clustering, url filters and fill-in-middle against brute force, and on nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import infill, planes, urlfilter

# ---------------------------------------------------------------- clustering


def brute_clusters(rows, k, rounds, size, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    far = {n: sum(d for _, c, d in found if c == n) for _, n, _ in found}
    return sorted(((i, c, d, far[c], sum(far.values()), tuple(centroids[c])) for i, c, d in found), key=str)


VECTORS = "vec_id long, embedding array<double>, planes string, norm string, cluster string, v int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "p", "n", "c", 1) for i, v in rows], VECTORS)


@pytest.mark.parametrize("size", [3, 64, 70])
def test_clusters_are_those_of_brute_force(spark, size):
    r = random.Random(size)
    rows = [(i, [r.choice([-3, 0, 3]) + r.uniform(-1, 1) for _ in range(size)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(80)]  # a vector with a third of all rows
    rows += [rows[5], rows[5], (None, rows[7][1]), (300, [0.0] * size), (301, [0.0] * size)]
    rows += [(400, None), (401, []), (402, [1.0] * (size - 1)), (403, [1.0] * (size - 1) + [None]), (404, [float("nan")] * size), (405, [float("inf")] + [1.0] * (size - 1))]
    got = planes.cluster(vectors(spark, rows).repartition(5), k=7, size=size).collect()
    assert sorted(((x.vec_id, x.cluster, x.distance, x.cluster_inertia, x.inertia, tuple(x.centroid)) for x in got), key=str) == brute_clusters(rows, 7, 3, size, 64, 1)


def test_planes_give_exact_products_at_their_widest():
    r = np.random.default_rng(3)
    values = np.concatenate([r.integers(-(1 << 27), 1 << 27, (40, 64)), [[-(1 << 27)] * 64, [(1 << 27) - 1] * 64, [0] * 64]])
    p = planes.to_planes(values, 28)
    assert (planes.from_planes(p, 64) == values).all()
    want = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in values] for x in values]
    assert planes.dots(p, p).tolist() == want


def test_ties_go_to_the_smaller_centroid_and_empty_ones_stay(spark):
    rows = [(i, [1.0, 1.0]) for i in range(30)]
    got = planes.cluster(vectors(spark, rows), k=4, size=2).collect()
    assert {(x.cluster, x.distance, x.inertia, tuple(x.centroid)) for x in got} == {(0, 0, 0, (64, 64))}


def test_few_or_no_vectors_and_too_great_ones(spark):
    assert planes.cluster(vectors(spark, []), size=2).collect() == []
    assert planes.cluster(vectors(spark, [(1, None), (2, [1.0])]), size=2).collect() == []
    assert [(x.cluster, x.distance) for x in planes.cluster(vectors(spark, [(1, [0.5, -0.5])]), size=2).collect()] == [(0, 0)]
    with pytest.raises(ArithmeticError):
        planes.cluster(vectors(spark, [(1, [1e12, 0.0])]), size=2)


# ---------------------------------------------------------------- urls

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
LISTED = [("bad.example.org", None), ("Farm.org", None), (None, None), (None, "/x"), ("", None), ("good.org", "/one"), ("good.org", "/one"), ("good.org", ""), ("com.evil.net", None), ("never-seen.org", None)]


def some_urls():
    r = random.Random(5)
    hosts = ["example.com", "www.example.com", "EXAMPLE.com", "notexample.com", "x.net", "a.b.c.farm.org", "farm.org", "bigfarm.org", "bad.example.org", "deep.bad.example.org", "example.org", "good.org", "www.good.org", "com.evil.net", "com", "h:80", "", "a..org"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/es/2", "/fr/", "/one", "/ONE", "/one/", "?x://y", "#z", "/en/?q#r", "/a://b/c"]
    urls = [f"{s}://{h}{p}" for s in ("http", "https", "") for h in hosts for p in paths]
    urls += [f"http://s{r.randrange(3000)}.org/{r.randrange(9)}" for _ in range(4000)] + ["http://hot.org/x"] * 2000
    return [None, "", "no scheme", "://", "http:///p", "http://é.org/ü\n/x", "line\nhttp://farm.org/q", "http://" + "a." * 300 + "farm.org/" + "p" * 5000, *urls]


def brute_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if rest is not None else ""
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1] if rest is not None else ""
    hit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    hosts = {h.lower() for h, p in LISTED if h and p is None}
    listed = host != "" and (any(host == h or host.endswith("." + h) for h in hosts) or any(h == host and p == path for h, p in LISTED if h and p is not None))
    rule, verdict = (max(hit)[1], max(hit)[2]) if hit else (None, "block" if listed else "allow")
    return host, path, rule, listed, verdict


def listed_table(spark, rows):
    return spark.createDataFrame(rows, "host string, path string")


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "v", 1) for i, u in enumerate(urls)], "page_id int, url string, host string, verdict string, _hit int")


@pytest.mark.parametrize("max_bits", [urlfilter.MAX_BITS, 64])
def test_verdicts_are_those_of_brute_force(spark, max_bits):
    urls = some_urls()
    got = urlfilter.judge(pages(spark, urls).repartition(4), listed_table(spark, LISTED), RULES, max_bits=max_bits).collect()
    assert len(got) == len(urls)
    assert all((x.host, x.path, x.rule, x.listed, x.verdict) == brute_judge(urls[x.page_id]) for x in got)
    assert {(x.host_given, x.verdict_given, x._hit_given) for x in got} == {("h", "v", 1)}


def test_a_cascade_is_exact_over_its_universe(spark):
    r = random.Random(9)
    listed = {f"k{r.randrange(10**9)}" for _ in range(3000)}
    others = {f"k{r.randrange(10**9)}" for _ in range(60_000)} - listed
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    universe = [*others, *sorted(listed)[:2000], *["hot"] * 9000, None]
    c = urlfilter.build_cascade(frame([*listed, *listed, None]), frame(universe))
    assert len(c.levels) > 2
    asked = frame([*others, *listed, "hot"]).withColumn("hit", c.holds(F.col("key")))
    assert {x.key for x in asked.where("hit").collect()} == listed
    assert sum(level.bits for level in c.levels) < 20 * len(listed)


def test_no_list_no_pages(spark):
    some = pages(spark, ["http://a.org/", None])
    assert {x.verdict for x in urlfilter.judge(some, listed_table(spark, []), RULES).collect()} == {"allow"}
    assert urlfilter.judge(pages(spark, []), listed_table(spark, LISTED), RULES).collect() == []
    assert {x.rule for x in urlfilter.judge(some, listed_table(spark, LISTED), []).collect()} == {None}


# ---------------------------------------------------------------- fill in the middle


def brute_infill(i, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", f"<P>{p}<S>{s}<M>{m}")


def infill_rows():
    r = random.Random(2)
    made = [(i, "".join(r.choice(["a", "é", "😀", "\n", "\r", "$1", "\\", "<", "P", ">", " ", "\u2028", "\x85", "\x00"]) for _ in range(r.randrange(60)))) for i in range(400)]
    long = "\n".join("word " * (k % 9) for k in range(60_000))
    return [*made, (None, "a\nb\nc"), (None, None), (500, None), (501, ""), (502, "\n"), (503, "\n\n\n"), (504, "<P>\nx\ny"), (505, "x" * 300_000), (506, long), (507, long), (508, "<S"), (3, "again\nand\nagain"), (509, "same\nrow\n"), (509, "same\nrow\n")]


@pytest.mark.parametrize(("seed", "rate", "spm"), [(7, 100, 50), (3, 60, 20)])
def test_outputs_are_those_of_brute_force(spark, seed, rate, spm):
    data = infill_rows()
    docs = spark.createDataFrame([(n, i, t, "o", "f") for n, (i, t) in enumerate(data)], "n int, doc_id long, text string, output string, form string").repartition(3)
    made = infill.fill_in_middle(docs, seed=seed, rate=rate, spm=spm)
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).withColumn("parts", infill.parts(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(data)
    for x in got:
        i, text = data[x.n]
        assert (x.n_units, x.form, x.output) == brute_infill(i, text, seed, rate, spm)
        assert x.back == (text or "") and (x.output_given, x.form_given, x.doc_id, x.text) == ("o", "f", i, text)
        assert x.parts is None if x.form == "plain" else "".join(x.parts) == text
    assert {x.form for x in got} == {"plain", "psm", "spm"}


def test_no_documents_and_other_units(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    words = spark.createDataFrame([(i, f"one two  three {i}\nfour") for i in range(50)], "doc_id long, text string")
    made = infill.fill_in_middle(words, unit=r"\s*\S+").withColumn("p", infill.parts(F.col("output"), F.col("form"))).collect()
    assert all(x.n_units == 5 and "".join(x.p) == x.text and all(re.fullmatch(r"(\s*\S+)*", p) for p in x.p) for x in made)


# ---------------------------------------------------------------- filters that others share


def test_bloom_filters_of_any_size_hold_their_keys(spark):
    from tidewell.llm.common import bloom_bits, bloom_of, in_bloom

    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64)
    inside, outside = keys[:4000], keys[4000:]
    frame = spark.createDataFrame([(int(k),) for k in inside] + [(None,)], "k long")
    for bits in (bloom_bits(len(inside)), 16, 23, 28):
        bitmap = bloom_of(frame, "k", bits)
        assert len(bitmap) * 8 == 1 << bits and in_bloom(bitmap, inside.view(np.uint64)).all()
        assert in_bloom(bitmap, outside.view(np.uint64)).mean() < (0.1 if bits >= 15 else 1)
    assert [bloom_bits(n) for n in (0, 1, 10**5, 10**9)] == [16, 16, 20, 28]


def test_sets_are_found_in_several_passes(spark, monkeypatch):
    from tidewell.llm import jaccard

    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefgh") * 3 for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [t + " tail" for t in texts])], "doc_id long, text string")
    key = lambda df: sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()))
    want = key(jaccard.near_duplicates(docs))
    monkeypatch.setattr(jaccard, "BLOOM_KEYS", 25)
    assert key(jaccard.near_duplicates(docs)) == want and [c for _, _, c in want] == list(range(60)) * 2
