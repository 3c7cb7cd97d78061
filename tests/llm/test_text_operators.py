"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import exact_dedup, hashing, jaccard_join, licences, pieces, substring_dedup, toxicity
from veilframe.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def made_texts(seed, n=60):
    """Texts over few words, with copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(30)] + ["The", "the"]
    passage = " ".join(rng.choices(vocabulary, k=20))
    texts = []
    for _ in range(n):
        kind = rng.random()
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 12, 14, 22, 30, 60]))
        if kind < 0.25 and texts:
            words = (rng.choice(texts) or "x").split()
            if words and rng.random() < 0.7:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.45:
            words = words + passage.split() + words[:3]
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    return texts + [None, "", " \n", " ".join(vocabulary * 300), "a b", "x" * 70_000]


def frame(spark, texts, repeat=True):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    if repeat:
        rows.append((len(texts), texts[0], "clash", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, norm string, n int")


def by_id(rows):
    return {r["doc_id"]: r for r in rows.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    texts = made_texts(seed)
    got = by_id(substring_dedup.substring_dedup(frame(spark, texts, False)))
    first = {}
    words = [WORDS.findall(t or "") for t in texts]
    for i, w in enumerate(words):
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, w in enumerate(words):
        gone = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_substring_dedup_of_a_null_id_and_an_empty_table(spark):
    text = " ".join(map(str, range(20)))
    rows = spark.createDataFrame([(None, text), (7, text)], "doc_id long, text string")
    got = by_id(substring_dedup.substring_dedup(rows))
    assert got[7]["n_removed"] == 0 and got[None]["n_removed"] == 20
    assert substring_dedup.substring_dedup(rows.limit(0)).count() == 0


def test_exact_groups(spark):
    texts = made_texts(3) + ["a b\tc", "abc", "ab  c", "ab  c"]
    got = by_id(exact_dedup.exact_groups(frame(spark, texts)))
    groups = collections.defaultdict(list)
    for i, t in enumerate([*texts, texts[0]]):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    for norm, members in groups.items():
        for _, i in members:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(members)[1], len(members), i == min(members)[1])
            assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
    assert exact_dedup.exact_groups(frame(spark, texts).limit(0)).count() == 0
    stay = exact_dedup.deduplicated(frame(spark, texts))
    assert {r["doc_id"] for r in stay.collect()} == {min(m)[1] for m in groups.values()} and stay.columns == ["doc_id", "text", "norm", "n"]


def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize(("seed", "k", "p", "block", "short"), [(4, 3, 90, 2048, 64), (5, 1, 80, 3, 2), (6, 2, 60, 4, 3)])
def test_similar_components(spark, monkeypatch, seed, k, p, block, short):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    texts = made_texts(seed, 90)
    base = [f"b{i}" for i in range(80)]
    for i in range(25):  # near copies around one text, and sets that the subsets find
        copy = list(base)
        for j in range(i % 4):
            copy[(7 * i + 11 * j) % 80] = f"c{i}{j}"
        texts.append(" ".join(copy))
        texts.append(" ".join(base[: 9 + i % 3]))
    sets = shingle_sets(texts, k)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j])]
    want = union_find(len(texts), links)
    got = by_id(jaccard_join.similar_components(frame(spark, texts, False), k, p, block=block))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == [(len(s), c) for s, c in zip(sets, want)]


@pytest.mark.parametrize("bounded", [0, 1000])
def test_similar_components_of_large_sets(spark, monkeypatch, bounded):
    """Sets with bitmaps of their own size, of two lengths, around the threshold; lists of both kinds."""
    monkeypatch.setattr(jaccard_join, "BOUNDED", bounded)
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=700)) for _ in range(3)]
    for size in (255, 262, 505, 520, 1030):
        base = [f"v{size}x{i}" for i in range(size)]
        texts.append(" ".join(base))
        for share in (0.005, 0.012, 0.017, 0.0178, 0.019, 0.03):
            copy = list(base)
            for i in rng.sample(range(0, size, 3), round(share * size)):
                copy[i] = f"z{len(texts)}x{i}"
            texts.append(" ".join(copy + [f"end{len(texts)}"] * rng.randrange(9)))
        texts.append(" ".join(base[: size // 2] + [f"o{i}" for i in range(size // 2)]))
    sets = shingle_sets(texts, 3)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    got = by_id(jaccard_join.similar_components(frame(spark, texts, False)))
    assert len(links) > 10 and [got[i]["component_id"] for i in range(len(texts))] == union_find(len(texts), links)


def test_bitmaps_never_overstate_the_difference():
    rng = np.random.Generator(np.random.PCG64(4))
    for n, gone, new in ((300, 3, 4), (511, 20, 30), (700, 0, 0), (1000, 900, 50)):
        one = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        other = np.append(one[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64))
        maps = [jaccard_join._parities(x, 1 << (len(x) - 1).bit_length()).tobytes() for x in (one, other)]
        assert jaccard_join._differ([maps[0]], [maps[1]])[0] <= gone + new
        assert jaccard_join._differ([maps[0], None], [maps[0], maps[1]]).tolist() == [0, 0]


def test_similar_components_of_odd_tables(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (2, "a b c d"), (2, "a b c d"), (9, "A B C D")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in jaccard_join.similar_components(rows).collect())
    assert got == [(-1, None), (2, 2), (2, 2), (9, 2)]
    assert jaccard_join.similar_components(rows.limit(0)).count() == 0


def test_subsets_are_chosen_by_cost():
    assert jaccard_join.choose_boundary([0] * 65, 90) == 0
    assert jaccard_join.choose_boundary([0] * 2 + [1000] * 8 + [0] * 55, 90) == 9
    assert jaccard_join.choose_boundary([0] * 30 + [1000] * 8 + [0] * 27, 90) < 27
    assert jaccard_join.overlap(18, 18, 90) == 18 and jaccard_join.overlap(19, 19, 90) == 18


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(200, 260)]
    want = union_find(261, links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: want[x] for x in {y for link in links if link[0] != link[1] for y in link}}


def test_packed_values():
    rng = np.random.Generator(np.random.PCG64(1))
    for top in (3, 1 << 20, 1 << 63):
        values = np.sort(rng.integers(0, top, 500, dtype=np.uint64))
        assert (hashing.unpacked(hashing.packed(values)) == values).all()


def test_licences(spark):
    mit, apache, gpl = (licences.TEMPLATES[k] for k in ("MIT-notice", "Apache-2.0-line", "GPL-3.0-line"))
    changed = licences.TEMPLATES["MIT"].replace("free of charge", "at no charge").upper()
    texts = [f"été. {mit}\nmore", f"{apache} {gpl} {apache}", "the license of nothing", None, "", changed + " word " * 3000, mit.replace("MIT", "BSD")]
    found = collections.defaultdict(list)
    for r in licences.scan(frame(spark, texts, False)).collect():
        found[r["doc_id"]].append((r["start"], r["license"], texts[r["doc_id"]][r["start"] : r["end"]], r["coverage"]))
    assert found[0] == [(5, "MIT-notice", mit.rstrip("."), 1.0)]
    assert [x[1] for x in sorted(found[1])] == ["Apache-2.0-line", "GPL-3.0-line", "Apache-2.0-line"]
    assert [x[1] for x in found[5]] == ["MIT"] and 0.97 < found[5][0][3] < 1
    assert not found[2] and not found[3] and not found[4] and not found[6]
    assert licences.scan(frame(spark, texts), {}).count() == 0


def test_licences_of_other_names_and_repeated_notices(spark):
    texts = ["Released under the GPL License.", "Released under the Apache License.", "Released under the Proprietary License.", "Released under a MIT License.",
             "All rights reserved. " * 2, "All rights reserved. " * 5, "Released under the MIT License. " * 7 + "All rights reserved."]
    found = collections.defaultdict(list)
    for r in licences.scan(frame(spark, texts, False)).collect():
        found[r["doc_id"]].append((r["first_word"], r["license"]))
    assert not found[0] and not found[1] and not found[2] and found[3] == [(0, "MIT-notice")]
    assert [len(found[i]) for i in (4, 5, 6)] == [2, 5, 8]


def test_licences_against_alignment_of_all_templates():
    """Without an index and a band: every template aligned with the whole text, what is left and right of a match again."""
    pick = random.Random(8)
    made = licences.index(licences.TEMPLATES, 3, 2, 0.8)
    short = [t for t in range(len(made["words"])) if len(made["words"][t][1]) < 45]
    filler = np.arange(1, 400, dtype=np.uint64)
    for _ in range(25):
        words = []
        for t in pick.sample(short, 3):
            words += pick.sample(filler.tolist(), pick.randint(0, 6))
            copy = made["words"][t][1].tolist()
            if pick.random() < 0.5:
                copy[pick.randrange(len(copy))] = 7
            words += copy * pick.randint(1, 2)
        words = np.array(words, np.uint64)
        matches = []
        for t in range(len(made["words"])):
            template, todo = made["words"][t][1], [(0, len(words))]
            while todo:
                start, stop = todo.pop()
                if stop - start < 0.8 * len(template):
                    continue
                part = words[start:stop]
                _, matched, first, last = licences.align(part, template, 0, len(part) + len(template))
                if matched >= 0.8 * len(template):
                    todo += [(start, start + first), (start + last + 1, stop)]
                    if licences._holds(part[first : last + 1], made["named"][t]):
                        matches.append((t, start + first, start + last, matched, matched / len(template)))
        kept = []
        for m in sorted(matches, key=lambda m: (-m[3], -m[4], m[1], m[0])):
            if all(m[2] < o[1] or m[1] > o[2] for o in kept):
                kept.append(m)
        assert [m[:3] for m in licences.scan_words(words, made, 4, 0.8)] == [m[:3] for m in sorted(kept, key=lambda m: m[1])]


def best_sum(part, encoder):
    best = [0.0] + [-1e18] * len(part)
    for e in range(1, len(part) + 1):
        for s in range(max(0, e - 16), e):
            if part[s:e] in encoder.pieces:
                best[e] = max(best[e], best[s] + encoder.pieces[part[s:e]][1])
        if part[e - 1] not in encoder.pieces:
            best[e] = max(best[e], best[e - 1] + encoder.lowest)
    return best[-1]


def test_pieces_have_the_best_sum_and_decode_exactly(spark):
    import sentencepiece

    encoder = pieces.Encoder(pieces.load())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    score = {i: s for i, s in encoder.pieces.values()}
    rng = random.Random(9)
    texts = ["", " ", "  two  spaces ", "tab\tand\nline", "été 門 😀 \u0000", "Zu" * 500] + [
        "".join(rng.choices("abcdeéß 漢😀\n", k=rng.randrange(1, 40))) for _ in range(200)
    ]
    for text in texts:
        ids = encoder.encode(text)
        assert encoder.decode(ids) == text == library.decode(ids.tolist()) if text.strip() else encoder.decode(ids) == text
        if len(text) < 60 and text:
            marked = "▁" + text.replace(" ", "▁")
            alone = sum(c not in encoder.pieces for c in marked)
            total = sum(score.get(i, 0.0) for i in ids.tolist()) + alone * encoder.lowest
            assert total == pytest.approx(best_sum(marked, encoder))
    rows = frame(spark, [*texts, None])
    done = pieces.encoded(rows)
    assert done.where("NOT round_trip").count() == 0
    back = by_id(pieces.decoded(done))
    assert [back[i]["text"] for i in range(len(texts) + 1)] == [*texts, ""]


def test_maximal_segments():
    rng = np.random.Generator(np.random.PCG64(2))
    for _ in range(200):
        scores = rng.integers(-4, 5, rng.integers(1, 25)).astype(float)

        def split(low, high):
            best = max(((scores[i:j].sum(), -(j - i), i, j) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0,))
            if best[0] <= 0:
                return []
            _, _, i, j = best
            return split(low, i) + [(scores[i:j].sum(), i, j - 1)] + split(j, high)

        got = toxicity.maximal_segments(scores)
        want = split(0, len(scores))
        assert sum(x[0] for x in got) == pytest.approx(sum(x[0] for x in want))
        assert max((x[0] for x in got), default=0) == max((x[0] for x in want), default=0)
        assert all(a[2] < b[1] for a, b in zip(got, got[1:]))
        assert all(scores[i : j + 1].sum() == s for s, i, j in got)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    held = toxicity.scored(docs, model).where("held_out").join(labels, "doc_id")
    seen = {(r["toxic"], r["predicted"]): r["count"] for r in held.groupBy("toxic", "predicted").count().collect()}
    assert seen[1, 1] >= 0.8 * (seen[1, 1] + seen.get((1, 0), 0)) and seen.get((0, 1), 0) <= 0.01 * seen[0, 0]
    odd = spark.createDataFrame([(None, None, 3), (1, "", 3), (1, "idiot", 3)], "doc_id long, text string, score int")
    got = toxicity.scored(odd, model).collect()
    assert len(got) == 3 and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"]
    assert toxicity.passages(docs, model).where("p_value >= 0.01 OR passage = ''").count() == 0
    none = toxicity.fit(docs.limit(0), labels)
    assert toxicity.scored(odd, none).count() == 3 and toxicity.scored(odd.limit(0), model).count() == 0


def test_several_moderate_passages_count_together(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    words = sorted((u for u, s in model["units"].items() if s > 0 and not u.endswith("*")), key=lambda u: (model["units"][u], u))
    word = words[len(words) // 2]
    clean = ["xxqz"] * 3000
    apart = [w for i, w in enumerate(clean) for w in ([word] if i % 250 == 100 else []) + [w]]
    mixed = spark.createDataFrame([(1, " ".join(apart)), (2, " ".join(apart[:150])), (3, " ".join(clean + [word]))], "doc_id long, text string")
    got = by_id(toxicity.scored(mixed, model))
    assert got[1]["predicted"] == 1 and got[3]["predicted"] == 0 and got[1]["score"] > got[3]["score"]
    found = toxicity.passages(mixed, model).where("doc_id = 1").collect()
    assert sorted(r["first_word"] for r in found) == [i for i, w in enumerate(apart) if w == word]


def test_joint_probability_of_segments():
    """The bound against sums of the negative binomial distribution, and a hand-made evidence."""
    lam, k, shape = 1.2, 0.01, 0.7
    best = np.array([6.0, 5.0, 5.0, 4.0, 1.0, 0.1])
    for r, got in enumerate(toxicity.joint(best, 1000, (lam, k, shape)), 1):
        mean = k * 1000 * math.exp(-lam * best[r - 1])
        terms = [math.exp(math.lgamma(shape + j) - math.lgamma(shape) - math.lgamma(j + 1)) * (shape / (mean + shape)) ** shape * (mean / (mean + shape)) ** j for j in range(r)]
        tail = 1 - sum(terms)
        assert math.exp(got) >= tail - 1e-9 and (mean > 0.1 or math.exp(got) <= 1.1 * tail)
    one = toxicity.evidence([6.0], 1000, 1.0, 0.01, (lam, k, shape))
    assert one == pytest.approx(6.0 - math.log(10))
    assert toxicity.evidence([6.0, 5.0, 5.0], 1000, 1.0, 0.01, (lam, k, shape)) > one + 1
    assert toxicity.evidence([], 1000, 1.0, 0.01, (lam, k, shape)) == pytest.approx(-math.log(10))


def test_licences_are_not_taken_for_each_other(spark):
    named = ["CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC-BY-4.0", "all-rights-reserved", "MPL-2.0", "ISC", "BSD-2-Clause", "BSD-3-Clause", "LGPL-3.0-or-later", "AGPL-3.0-or-later"]
    texts = [f"one two. {licences.TEMPLATES[n]} three four" for n in named] + ["Licensed under CC BY 3.0.", "Released under a MIT License."]
    found = collections.defaultdict(list)
    for r in licences.scan(frame(spark, texts, False)).collect():
        found[r["doc_id"]].append((r["license"], round(r["coverage"], 3)))
    assert [found[i] for i in range(len(named))] == [[(n, 1.0)] for n in named]
    assert not found[len(named)] and found[len(named) + 1] == [("MIT-notice", 0.8)]


def test_one_row_of_each_group_stays(spark):
    """Repeated and null ids: one row of each text, and of each near text."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, "A a"), (5, "A a"), (5, "B b"), (7, "C c"), (7, "C  c"), (None, "D d"), (None, "D d"), (None, "A a"), (8, long), (8, long + " x"), (9, long + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    single = exact_dedup.deduplicated(docs)
    want = [("3", "A a"), ("5", "B b"), ("7", "C  c"), ("8", long), ("8", long + " x"), ("9", long + " y"), ("None", "D d")]
    assert sorted((str(r["doc_id"]), r["text"]) for r in single.collect()) == want and single.columns == docs.columns
    far = jaccard_join.deduplicated(single, k=5, p=80).collect()
    assert sorted(str(r["doc_id"]) for r in far) == ["3", "5", "7", "8", "None"]
