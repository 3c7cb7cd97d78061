"""Archives, top-k, quality, mixing and the pipeline against brute force."""

import collections
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import mixing, quality, topk, warc
from veilframe.llm.common import shared_folder, stored

SMALL = "/root/testdata/sf0.001"


def test_round_trip_of_odd_pages(spark):
    big = "é" * 60
    rows = [(5, "http://a.example.com/x", big), (3, "http://b.example.com/\r\ny", big), (None, None, None), (8, "http://a.example.com/x", "short"),
            (9, "http://a.example.com/x", "short"), (2, "x", big + "!"), (4, "http://a.example.com/x", big), (4, "http://a.example.com/x", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    want = collections.Counter()
    for page_id, _, html in rows:
        body = (html or "").encode()
        revisit = html == big and page_id != 3
        want[page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_index_finds_keys_over_many_blocks(spark):
    """Small blocks, one host with most of the keys, keys that are not there."""
    captures = spark.range(2000).select(
        F.when(F.col("id") % 3 > 0, "com,hot)/x").otherwise(F.concat(F.lit("com,h"), F.col("id") % 7, F.lit(")/"))).alias("urlkey"),
        F.col("id").alias("page_id"), F.lit("f").alias("file"), F.col("id").alias("offset"), F.lit(1).cast("long").alias("length"),
    )
    folder = shared_folder(spark, "cdx")
    shards = warc.build_index(captures, folder, block_lines=7)
    asked = captures.unionByName(captures.withColumn("page_id", F.col("page_id") + 5000))
    found = warc.look_up(asked, folder, shards)
    assert sorted(r["offset"] for r in found.collect()) == list(range(2000))


def test_archives_are_records_in_gzip_members(spark):
    folder = shared_folder(spark, "warc")
    captures = warc.write_archives(spark.read.parquet(f"{SMALL}/pages.parquet"), folder).collect()
    files, root = warc._open(folder)
    for c in captures[:20]:
        with files.open_input_file(f"{root}/{c['file']}") as f:
            record = gzip.decompress(f.read_at(c["length"], c["offset"]))
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")


def test_url_keys(spark):
    urls = {"http://a.Example.com/p?q#f": "com,example,a)/p?q", "https://u:p@h.org:81/": "org,h):81/", "": ")", None: ""}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.url_key(F.col("u")).alias("k"))
    assert {r["u"]: r["k"] for r in rows.collect()} == urls


@pytest.mark.parametrize(("seed", "top"), [(1, 3.0), (2, 0.002), (3, 1e5)])
def test_top_k(spark, seed, top):
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = (rng.standard_normal((150, 5)) * top).tolist()
    vectors[10:60] = [vectors[10]] * 50  # ties
    rows = [(i, v, i) for i, v in enumerate(vectors)]
    rows += [(200, None, 0), (201, [float("nan")] * 5, 0), (202, [None] * 5, 0), (203, [1.0, 2.0], 0), (204, [1.0, 1.0], 0), (None, vectors[0], 0), (300, [], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long")
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 4 == 0, 10).collect())
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in whole:
        if q % 4 == 0:
            found = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:10])]
    assert got == sorted(want)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 4 == 0).count() == 0


def test_quality_rates(spark):
    """Rates and posteriors from the evidence of the rows, recomputed."""
    rows = quality.query(spark, SMALL).toPandas()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    sums = rows.groupby(["source", "lang"])["evidence"].agg(["size", "sum"])
    hosts = rows.groupby("source")["evidence"].agg(["size", "sum"])
    mean = rows["evidence"].mean()

    def strength(m, v):
        return quality.LIMIT if not v or v <= 0 else min(quality.LIMIT, max(1.0, m * (1 - m) / v - 1))

    def between(groups, rate):
        some = groups[groups["size"] > 1]
        rate = rate if np.isscalar(rate) else rate[some.index]
        seen = (some["sum"] / some["size"] - rate) ** 2 - rate * (1 - rate) / some["size"]
        return (some["size"] * seen).sum() / some["size"].sum()

    a = strength(mean, between(hosts, mean))
    host_rate = (a * mean + hosts["sum"]) / (a + hosts["size"])
    of_path = sums.index.get_level_values("source").map(host_rate).to_numpy()
    some = sums["size"].to_numpy() > 1
    p, n = sums["sum"].to_numpy(), sums["size"].to_numpy()
    v = (n[some] * ((p[some] / n[some] - of_path[some]) ** 2 - of_path[some] * (1 - of_path[some]) / n[some])).sum() / n[some].sum()
    b = strength(mean, v)
    logit = lambda x: np.log(np.clip(x, 1e-9, 1 - 1e-9) / (1 - np.clip(x, 1e-9, 1 - 1e-9)))
    for r in rows.itertuples():
        s = sums.loc[(r.source, r.lang)]
        h = host_rate[r.source]
        assert r.host_rate == pytest.approx(h) and r.path_rate == pytest.approx((b * h + s["sum"]) / (b + s["size"]))
        rest = (b * h + max(s["sum"] - r.evidence, 0)) / (b + s["size"] - 1)
        want = 1 / (1 + np.exp(-(logit(r.evidence) + 0.5 * (logit(rest) - logit(mean)))))
        assert r.quality == pytest.approx(want, rel=1e-6) and r.kept == (r.quality >= 0.5)


def test_quality_on_held_out_rows_and_odd_tables(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = quality.query(spark, folder).join(labels.withColumnRenamed("quality", "label"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    wrong = held.where("kept <> (label = 1)").count()
    assert wrong <= 0.02 * held.count()
    odd = spark.createDataFrame([(None, None, None, None, 1.0), (1, "", "", "x", 1.0), (1, "fine text", "en", None, 1.0)], "doc_id long, text string, lang string, source string, evidence double")
    assert quality.judged(odd, labels).count() == 3
    assert quality.accepted(odd.limit(0), labels).count() == 0 and quality.accepted(odd, labels).columns == odd.columns


def test_raking(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    tokens = rng.integers(1, 100, (3, 4, 2))
    tokens[0, 1, :] = 0
    cells = [(f"s{i}", f"l{j}", f"t{k}", int(tokens[i, j, k])) for i in range(3) for j in range(4) for k in range(2) if tokens[i, j, k]]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    shares = {"source": [0.2, 0.3, 0.5], "lang": [0.1, 0.2, 0.3, 0.4], "topic": [0.5, 0.5]}
    targets = {d: spark.createDataFrame([(f"{d[0]}{i}", s) for i, s in enumerate(v)] + [("absent", 0.5)], f"{d} string, share double") for d, v in shares.items()}
    raked = mixing.rake(frame, targets, 1e-9, 60)
    want, total = tokens.astype(float), tokens.sum()
    for _ in range(200):
        for axis, d in enumerate(shares):
            other = tuple(x for x in range(3) if x != axis)
            shape = [1, 1, 1]
            shape[axis] = -1
            want = want * (np.array(shares[d]) * total / want.sum(axis=other)).reshape(shape)
    for r in raked.collect():
        assert r["raked"] == pytest.approx(want[int(r["source"][1]), int(r["lang"][1]), int(r["topic"][1])], rel=1e-5)
    c = mixing.calibrate(raked, 0.6)
    expected = sum(min(r["tokens"], c * r["raked"]) for r in raked.collect())
    assert expected == pytest.approx(0.6 * total, rel=1e-3)


def test_mixing_of_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, None, None, 1), (1, "", "", "x", 1), (2, "fine text", "en", None, 1), (2, "fine text", "en", None, 1)], "doc_id long, text string, lang string, source string, tokens int")
    got = mixing.drawn(odd)
    assert got.count() == 4 and got.where("tokens = 0 AND NOT kept").count() == 0
    assert mixing.mixed(odd).columns == odd.columns
    kept = sorted(str(r["doc_id"]) for r in got.where("kept").collect())
    assert kept == sorted(str(r["doc_id"]) for r in mixing.mixed(odd).collect())
    assert mixing.drawn(odd.limit(0)).count() == 0


def test_skewed_sources_meet_their_targets(spark):
    """One source with a third of the tokens and 19 equal ones."""
    rows = [(i, "a b c d e f g h i j", "en" if i % 3 else "de", "hot" if i < 950 else f"s{i % 19}") for i in range(2850)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    tokens = mixing.marked(docs).groupBy(*mixing.DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    for r in mixing.marginals(mixing.probabilities(docs), tokens).collect():
        assert r["expected"] == pytest.approx(r["target"], rel=1e-3)
    short = mixing.marginals(mixing.probabilities(docs, keep=0.9), tokens).where("value = 'hot'").first()
    assert short["expected"] > 1.05 * short["target"]
    kept = {r["hot"]: r["n"] for r in mixing.mixed(docs).groupBy((F.col("source") == "hot").alias("hot")).agg(F.count("*").alias("n")).collect()}
    want = 950**0.8 / (950**0.8 + 19 * 100**0.8)
    assert abs(kept[True] / sum(kept.values()) - want) < 0.025


def nearest(tokens, shares, rounds=2000):
    """Weights by numpy: coordinate steps on the divergence from the tokens plus the marginals' from the targets."""
    factors, total = [np.ones(n) for n in tokens.shape], tokens.sum()
    for _ in range(rounds):
        for axis in range(tokens.ndim):
            x = tokens.astype(float)
            for other in range(tokens.ndim):
                if other != axis:
                    shape = [1] * tokens.ndim
                    shape[other] = -1
                    x = x * factors[other].reshape(shape)
            factors[axis] = np.sqrt(np.array(shares[axis]) * total / x.sum(axis=tuple(a for a in range(tokens.ndim) if a != axis)))
    x = tokens.astype(float)
    for axis, f in enumerate(factors):
        shape = [1] * tokens.ndim
        shape[axis] = -1
        x = x * f.reshape(shape)
    return x * total / x.sum()


def test_monolingual_sources(spark):
    """No weights meet the default targets; the answer is the nearest, and a sample is drawn."""
    words = " ".join("word" for _ in range(50))
    rows = [(i, words, "en" if i % 4 else "de", "s1" if i % 4 else "s2") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {(r["source"], r["lang"]): r["weight"] for r in mixing.probabilities(docs).collect()}
    tokens = np.zeros((2, 2, 1))
    tokens[0, 0], tokens[1, 1] = 300 * 50, 100 * 50
    share = lambda power: np.array([15000.0, 5000.0]) ** power / (np.array([15000.0, 5000.0]) ** power).sum()
    want = nearest(tokens, [share(0.8), share(0.9), [1.0]])
    assert got["s1", "en"] == pytest.approx(want[0, 0, 0] / 15000, rel=1e-3) and got["s2", "de"] == pytest.approx(want[1, 1, 0] / 5000, rel=1e-3)
    kept = mixing.drawn(docs).where("kept").groupBy("source").count().collect()
    assert {r["source"] for r in kept} == {"s1", "s2"}


def test_a_tiny_source_does_not_rule_the_sample(spark):
    text = " ".join("w" for _ in range(100))
    rows = [(i, text, "en", f"s{i % 3}") for i in range(3000)] + [(5000, "few words", "en", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cells = {r["source"]: r for r in mixing.probabilities(docs).where("topic = 'short'").collect()}
    assert cells["tiny"]["probability"] == 1.0 and cells["tiny"]["weight"] > 3 * cells["s0"]["weight"]
    assert min(cells[f"s{i}"]["probability"] for i in range(3)) > 0.99
    assert mixing.probabilities(docs, short=0.0).where("source = 's0' AND topic = 'short'").first()["probability"] < 0.4


def test_plan_of_a_cycle_stays_the_same(spark):
    cells = stored(spark.createDataFrame([("s0", "l0", "t", 10), ("s1", "l1", "t", 10), ("s0", "l1", "t", 5)], "source string, lang string, topic string, tokens long"), "cells")
    cells, factors = mixing._start(cells, mixing.default_targets(cells))
    joins = []
    for _ in range(3):
        cycle = mixing._cycle(cells, factors, list(mixing.DIMENSIONS), 1.0)
        joins.append(cycle._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        factors = stored(cycle, "factors")
    assert joins[0] == joins[1] == joins[2]


def test_names_that_clash(spark):
    """Tables with the names that operators use inside keep their columns."""
    from veilframe.llm import exact_dedup, jaccard_join

    names = ["doc_id", "text", "lang", "source", "row", "_row", "place", "host", "_host", "_path", "n", "_n", "s", "_s", "strength", "evidence", "_evidence", "quality",
             "kept", "_kept", "topic", "_topic", "_source", "_lang", "probability", "_probability", "_t", "_T2", "tokens", "some", "recipe", "best", "part", "odd name"]
    rows = [(i, f"some words of text {i} that are long enough {i * i} to be a text", "en", "a", *[f"{n}-{i}" for n in names[4:]]) for i in range(20)]
    docs = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    want = sorted(rows)
    assert sorted(map(tuple, exact_dedup.deduplicated(docs).collect())) == want
    assert sorted(map(tuple, jaccard_join.deduplicated(docs, k=5, p=80).collect())) == want
    for out in (quality.accepted(docs, labels, threshold=0.0), quality.accepted(docs, labels), mixing.mixed(docs)):
        assert out.columns == names and set(map(tuple, out.collect())) <= set(want)
    assert quality.accepted(docs, labels, threshold=0.0).count() == 20
    assert exact_dedup.exact_groups(docs).count() == 20 and mixing.drawn(docs).count() == 20


def test_one_row_of_repeated_ids_stays(spark):
    from veilframe.llm import exact_dedup

    rows = [(1, "same text"), (1, "same text"), (1, "same  text"), (2, "other"), (None, "other"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in exact_dedup.exact_groups(docs).where("kept").select("doc_id", "keep_id", "group_size").collect()]
    assert sorted(kept, key=str) == sorted([(1, 1, 3), (2, 2, 2), (None, None, 2)], key=str)
    assert exact_dedup.deduplicated(docs).count() == 3


def test_targets_that_cannot_be_met_are_an_error_on_request(spark):
    cells = spark.createDataFrame([("s0", "l0", "t", 10), ("s1", "l1", "t", 10)], "source string, lang string, topic string, tokens long")
    targets = {"source": spark.createDataFrame([("s0", 0.5), ("s1", 0.5)], "source string, share double"), "lang": spark.createDataFrame([("l0", 0.9), ("l1", 0.1)], "lang string, share double")}
    with pytest.raises(ValueError, match="raking is off"):
        mixing.rake(cells, targets, cycles=20, strict=True)


def test_pipeline_stages(spark):
    """What each stage keeps, recomputed from its operator's rows."""
    import corpus_pipeline as c
    from veilframe.llm import exact_dedup, jaccard_join
    from veilframe.llm.common import stored, table

    assert [name for name, _ in c.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"]
    docs = table(spark, SMALL, "documents")
    ids = lambda rows: {r["doc_id"] for r in rows.select("doc_id").collect()}
    good = stored(c.keep_good(spark, docs, SMALL), "t")
    assert good.columns == docs.columns and ids(good) == ids(quality.query(spark, SMALL).where("kept"))
    single = stored(c.drop_copies(spark, good, SMALL), "t")
    assert ids(single) == ids(exact_dedup.exact_groups(good).where("kept"))
    far = stored(c.drop_near_copies(spark, single, SMALL), "t")
    assert ids(far) == ids(jaccard_join.similar_components(single, 5, 80).where("doc_id = component_id"))
    drawn = stored(c.mix(spark, far, SMALL), "t")
    assert ids(drawn) == ids(mixing.drawn(far).where("kept"))
    assert ids(c.run(spark, SMALL)) == ids(c.tokenise(spark, drawn, SMALL)) == ids(drawn)
