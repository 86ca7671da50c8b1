"""Text operators against plain code, and their defined results for odd input."""

import collections
import math
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from runlumen.llm import (components, decontaminate, jaccard, lines, lm, mixing, postings, quality, search,
                          sharding, suffixes, tokens)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def tuples(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- joins and repeats


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_components(corpus, corpus_rows, n, percent):
    got = tuples(jaccard.join(corpus, n, percent), "doc_id", "n_shingles", "component_id")
    assert got == brute.jaccard_components(pairs(corpus_rows), n, percent)
    assert any(a != c for a, _, c in got)


def test_jaccard_in_blocks(corpus, corpus_rows):
    got = tuples(jaccard.join(corpus, block=50), "doc_id", "n_shingles", "component_id")
    assert got == brute.jaccard_components(pairs(corpus_rows))


def test_jaccard_links_at_the_threshold(spark):
    rng = random.Random(3)
    rows = []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(rng.randint(5, 90))]
        for k in range(4):
            changed = list(words)
            for _ in range(k):
                changed[rng.randrange(len(changed))] = f"c{rng.random()}"
            rows.append((4 * g + k, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = tuples(jaccard.join(docs), "doc_id", "n_shingles", "component_id")
    expected = brute.jaccard_components(rows)
    assert got == expected
    assert 0 < sum(a != c for a, _, c in expected) < len(rows)


def test_jaccard_odd_rows(odd, empty):
    result = [tuple(r) for r in jaccard.join(odd).select("doc_id", "n_shingles", "component_id").collect()]
    counts = collections.Counter(result)
    assert counts[(1, 14, 1)] == 2 or any(k[0] == 1 and k[2] == 1 and v == 2 for k, v in counts.items())
    assert all(c is None for d, _, c in result if d is None)
    assert len(result) == 8
    assert (3, 0, 3) in counts and counts[(4, 1, 4)] == 2
    assert jaccard.join(empty).count() == 0


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    names = list(range(500))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(299)] + [(names[i], names[300]) for i in range(301, 400)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(tuples(components.components(df), "node", "component"))
    assert {got[n] for n in names[:300]} == {min(names[:300])}
    assert {got[n] for n in names[300:400]} == {min(names[300:400])}
    assert components.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("length", [50, 64])
def test_suffix_dedup(corpus, corpus_rows, length):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = tuples(suffixes.deduplicate(corpus, length), *names)
    assert got == brute.suffix_dedup(pairs(corpus_rows), length)
    assert sum(r[2] for r in got) > 0


def test_suffix_dedup_of_hot_keys(spark, corpus, corpus_rows):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    rng = random.Random(9)
    line = "a line of forty-four bytes that many have..."
    rows = [(i, f"{rng.random()} {line} {rng.choice('abc')} {rng.random()}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = postings.meetings(docs, suffixes._extract(50), postings.KEY, 200)
    counts = {r["x"]: r["y"] for r in found.filter(F.col("kind") == postings.HOT).collect()}
    own = collections.Counter()
    for _, text in rows:
        own.update(set(suffixes.window_keys(np.frombuffer(text.encode(), np.uint8), 50).view(np.int64).tolist()))
    assert counts and counts == {k: n for k, n in own.items() if n >= 200}  # counted exactly
    assert len(suffixes.hot_keys(found, 1)) == 1
    want = brute.suffix_dedup(rows, 50)
    for hot, told in ((200, 1000), (200, 1), (2, 1000), (suffixes.OFTEN, suffixes.TOLD)):
        assert tuples(suffixes.deduplicate(docs, 50, hot=hot, told=told), *names) == want
    assert tuples(suffixes.deduplicate(corpus, 50, hot=2), *names) == brute.suffix_dedup(pairs(corpus_rows), 50)


def test_suffix_ranks_follow_suffix_order():
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab\x00\xff") for _ in range(400))
    ranks = suffixes.suffix_ranks(np.frombuffer(data, np.uint8), np.array([150, 250]), 20)
    places = [*range(131), *range(150, 381)]
    assert sorted(places, key=lambda i: (ranks[i], i)) == sorted(places, key=lambda i: (data[i:i + 20], i))


def test_suffix_dedup_odd_rows(odd, empty):
    rows = suffixes.deduplicate(odd).collect()
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert len(rows) == 8
    assert all(r["n_removed"] == 0 for r in by_id[1] + by_id[4] + by_id[None] + by_id[3])
    assert by_id[2][0]["n_removed"] == by_id[2][0]["n_bytes"] > 0
    assert suffixes.deduplicate(empty).count() == 0


def plain_lines(rows, run):
    seen, result = {}, {}
    for d, t in sorted(rows):
        own = t.split("\n")
        gone = set()
        for i in range(len(own) - run + 1):
            key = tuple(own[i:i + run])
            if key in seen:
                gone.update(range(i, i + run))
            seen.setdefault(key, (d, i))
        result[d] = (len(own), len(gone), "\n".join(x for i, x in enumerate(own) if i not in gone))
    return result


@pytest.mark.parametrize("run", [2, 3])
def test_line_dedup(spark, run):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c d", ""]) if rng.random() < 0.5 else f"line {rng.random()}"
                          for _ in range(rng.randint(1, 30)))) for i in range(60)]
    rows += [(60, rows[3][1]), (61, ""), (62, "a\na\na\na")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in lines.deduplicate(docs, run).collect()}
    assert got == plain_lines(rows, run)


def test_line_dedup_of_long_lines(spark):
    long, other = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    split = [" ".join(f"c{i}" for i in range(n, n + 25)) for n in (0, 25)]
    rows = [(1, f"one\n{long}\ntwo"), (2, f"three\n{long}\nfour"), (3, long), (4, other), (5, other),
            (6, "short"), (7, "short"), (8, "x\nshort"), (9, long.rsplit(" ", 1)[0]), (10, long.rsplit(" ", 1)[0]),
            (11, "\n".join(["m", *split, "n"])), (12, "\n".join(["o", *split, "p"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for run, both in ((2, 2), (3, 2), (1, 2)):
        got = {r["doc_id"]: r["n_removed"] for r in lines.deduplicate(docs, run).collect()}
        want = {1: 0, 2: 1, 3: 1, 4: 0, 5: 1, 6: 0, 7: 0, 8: 0, 9: 0, 10: 0, 11: 0, 12: both}
        if run == 1:
            want |= {7: 1, 8: 1, 10: 1}
        assert got == want
    assert all(r["n_removed"] == 0 for r in lines.deduplicate(docs, 3, words=None).collect())


@pytest.mark.parametrize("run, words", [(1, None), (2, 3), (4, 5)])
def test_line_fingerprints(spark, run, words):
    rng = random.Random(run)
    rows = [(i, "\n".join(rng.choice(["a", "b b", "c d e", ""]) if rng.random() < 0.6 else f"line {rng.random()}"
                          for _ in range(rng.randint(1, 25)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lines.fingerprints(docs, run, words)
    cut = sorted((r["doc"], r["place"], r["size"]) for r in lines.extend(found, run, words).collect())
    want = []
    for d, t in rows:
        own = [len(x.split()) for x in t.split("\n")]
        for size in range(1 if words else run, run + 1):
            want += [(d, i + 1, size) for i in range(len(own) - size + 1)
                     if size == run or sum(own[i:i + size]) >= words]
    assert cut == sorted(want)  # every window once, by way of the place it selects
    places = [(r["doc"], r["place"]) for r in found.collect()]
    assert len(places) == len(set(places)) <= len(want)


def test_line_dedup_odd_rows(odd, empty):
    rows = lines.deduplicate(odd).collect()
    assert len(rows) == 8 and all(r["n_removed"] == 0 for r in rows)
    assert all(r["n_lines"] == 0 and r["kept"] is None for r in rows if r["text"] is None)
    assert lines.deduplicate(empty).count() == 0


def test_line_dedup_is_native(corpus):
    plan = lines.deduplicate(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


# --- decontamination


def test_distance_is_that_of_the_best_passage():
    rng = random.Random(6)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))
        assert decontaminate.best_distance(item, text) == brute.substring_distance(item, text)


def test_decontamination(spark, corpus):
    rng = random.Random(7)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12))) for i in range(20)]
    rows = []
    for d in range(60):
        item = items[d % 20][1]
        edited = list(item)
        for _ in range(d // 5):
            at = rng.randrange(len(edited))
            kind = rng.randrange(3)
            edited[at:at + 1] = [[], ["z"], [edited[at], "z"]][kind]
        rows.append((d, "before it " + "".join(edited).upper().replace(" ", " \n", 2) + " after it"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame([*items, (99, None), (None, "x" * 30), (98, "short")], "item_id long, text string")
    expected = {d: [i for i, t in items if brute.substring_distance(
        decontaminate.normal(t), decontaminate.normal(x)) <= int(0.1 * len(t))] for d, x in rows}
    for most in (1 << 20, 300):
        got = {r["doc_id"]: r["items"] for r in decontaminate.contaminating(docs, table, most=most).collect()}
        assert got == expected
    assert 10 < sum(map(bool, expected.values())) < 60
    assert decontaminate.contaminating(corpus, table).filter("size(items) > 0").count() == 0
    assert {tuple(r["items"]) for r in decontaminate.contaminating(docs, table.limit(0)).collect()} == {()}


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(5, "TEXT that is long  enough to be compared")], "item_id long, text string")
    rows = decontaminate.contaminating(odd, items).collect()
    assert sorted(len(r["items"]) for r in rows) == [0, 0, 0, 0, 1, 1, 1, 1]
    assert decontaminate.contaminating(empty, items).count() == 0


# --- mixing and sharding


def water(sizes, weights, cap):
    left, full = dict(weights), {}
    total = sum(sizes.values())
    while left:
        level = (total - sum(full.values())) / sum(left.values())
        over = [s for s in left if level * left[s] > cap * sizes[s]]
        if not over:
            return {**full, **{s: level * w for s, w in left.items()}}
        for s in over:
            full[s] = cap * sizes[s]
            del left[s]
    return full


def test_mix_meets_its_targets(corpus, corpus_rows):
    schedule = mixing.constant_schedule(mixing.cyclic_weights(corpus))
    rows = mixing.mix(corpus, schedule, cap=1.2).collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        sizes[r["source"]] += len(brute.WORD.findall(r["text"] or ""))
        taken[r["source"]] += r["mix_taken"]
        target[r["source"]] = r["mix_target"]
        assert r["mix_taken"] <= 1.2 * r["mix_size"] + r["mix_size"]
        assert (r["mix_taken"] > 0) == bool(r["mix_positions"])
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: 1.0 + i % 3 for i, s in enumerate(names)}
    expected = water(sizes, weights, 1.2)
    for s in names:
        assert target[s] == pytest.approx(expected[s])
        assert taken[s] == round(target[s])
    assert len(rows) == len(corpus_rows)


def test_mix_follows_the_schedule_over_time(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(4000)],
                                 "doc_id long, text string, source string")
    schedule = spark.createDataFrame([("a", [(0.0, 0.0), (1.0, 2.0)]), ("b", [(0.0, 3.0), (0.5, 0.0), (1.0, 0.0)])],
                                     "source string, knots array<struct<t: double, w: double>>")
    rows = mixing.training_order(mixing.mix(docs, schedule)).collect()
    at = {s: sorted(r["position"] for r in rows if r["source"] == s) for s in "ab"}
    assert len(at["a"]) == pytest.approx(4000 / 1.75, rel=0.01)
    for x in (0.2, 0.4, 0.7, 0.9):  # a's share by time x is x squared, b's a falling line until one half
        assert sum(p <= x for p in at["a"]) / len(at["a"]) == pytest.approx(x * x, abs=0.01)
        y = min(x, 0.5)
        assert sum(p <= x for p in at["b"]) / len(at["b"]) == pytest.approx(4 * y - 4 * y * y, abs=0.01)
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)


def test_mix_odd_rows(odd, empty):
    def plan(docs):
        return mixing.mix(docs, mixing.constant_schedule(mixing.cyclic_weights(docs)))

    rows = plan(odd).collect()
    assert len(rows) == 8 and all(r["mix_taken"] == 0 for r in rows if r["text"] is None)
    assert sum(r["mix_taken"] for r in rows) == sum(r["mix_size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, plan(odd.repartition(7)).collect()))
    assert plan(empty).count() == 0
    text = plan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in text and "Python" not in text


def test_shards(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"))
    rows = sharding.assign(docs, [1.0] * 5 + [3.0]).collect()
    size = collections.Counter(r["shard"] for r in rows)
    assert size[5] == pytest.approx(20000 * 3 / 8, rel=0.05)
    assert all(size[s] == pytest.approx(20000 / 8, rel=0.1) for s in range(5))
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {6} and len(moved) == pytest.approx(20000 / 9, rel=0.1)
    again = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, [1.0] * 5 + [3.0, 1.0]).collect()}
    assert all(again[r["doc_id"]] == r["grown_shard"] for r in rows)
    for s in range(6):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(size[s]))


def test_shard_bids_by_hand():
    import xxhash

    def bits(key, shard):
        first = xxhash.xxh64_intdigest(key.encode(), 42)
        return xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), first) >> 12

    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    docs = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    for r in sharding.assign(docs, 7).collect():
        bids = [-math.log((bits(str(r["doc_id"]), s) + 0.5) / 2 ** 52) for s in range(8)]
        assert r["shard"] == bids.index(min(bids[:7])) and r["grown_shard"] == bids.index(min(bids))


def test_shard_odd_rows(odd, empty):
    rows = sharding.assign(odd, 3).collect()
    assert len(rows) == 8 and len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    for s in range(3):
        own = [r["slot"] for r in rows if r["shard"] == s]
        assert sorted(own) == list(range(len(own)))
    assert sharding.assign(empty, 3).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(empty, [])


# --- tokens, classifier, language model, search


def model_path():
    return str(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))


def test_token_counts(corpus, corpus_rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    got = {r["doc_id"]: tuple(r)[1:] for r in tokens.count_tokens(corpus, model_path(), kept=50).collect()}
    for d, t, *_ in corpus_rows:
        n = len(model.encode(t or ""))
        assert got[d] == (len((t or "").encode()), n, n > 4096)


def test_token_counts_of_odd_texts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path())
    counter = tokens.PieceCounter(model_path())
    rng = random.Random(8)
    texts = ["".join(rng.choice(" \n\t▁aAbe<s>th0é漢🙂　\x00\r.,") for _ in range(rng.randint(0, 14)))
             for _ in range(4000)]
    assert counter.count(texts) == [len(model.encode(t)) for t in texts]


def test_token_counts_odd_rows(odd, empty):
    rows = tokens.count_tokens(odd, model_path()).collect()
    assert len(rows) == 8 and all(r["n_tokens"] == 0 for r in rows if r["n_bytes"] == 0)
    assert tokens.count_tokens(empty, model_path()).count() == 0


def test_classifier_on_held_out_rows(spark, odd, empty):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(400):
        good = i % 4 > 0
        words = [f"word{int(rng.expovariate(0.05))}" for _ in range(40)]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        marks.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(
        [*marks, (None, 1), (7777, None), (1, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    held = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    right = sum((got[i] >= 0.5) == dict(marks)[i] for i in held)
    assert right >= 0.95 * len(held)
    same = {r["quality_score"] for r in quality.score(odd, model).filter("text is null").collect()}
    assert len(same) == 1 and quality.score(odd, model).count() == 8
    assert quality.score(empty, model).count() == 0
    assert {r["quality_score"] for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}


def test_language_model(spark, corpus, corpus_rows):
    words, count = {}, collections.Counter()
    for d, t, *_ in corpus_rows:
        words[d] = [*(t or "").encode().lower().split(), None]
        if zlib.crc32(str(d).encode()) % 5 != 1:
            count.update(words[d])
    total, distinct = sum(count.values()), len(count)
    for frequent in (1 << 19, 20, 0):
        rows = lm.score(corpus, frequent=frequent).collect()
        assert len(rows) == len(corpus_rows)
        for r in rows:
            own = words[r["doc_id"]]
            base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
            assert r["base_score"] == pytest.approx(base)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (
                len(own), sum(count[w] > 0 for w in own), total)
            assert r["score"] < 0


def test_language_model_beats_its_base_on_held_out_texts(spark):
    rng = random.Random(10)
    kinds = [[f"{a}{i}{z}" for i in range(200)] for a, z in (("x", "ing"), ("y", "eau"), ("z", "ung"))]
    rows = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(80))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = lm.score(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1] * 0.99


def test_language_model_odd_rows(odd, empty):
    rows = lm.score(odd).collect()
    assert len(rows) == 8 and all(r["n_tokens"] >= 1 for r in rows)
    assert lm.score(empty).count() == 0


def test_top_k(corpus, corpus_rows):
    asked = corpus.filter(F.col("doc_id") % 5 == 0)
    got = collections.defaultdict(list)
    for r in sorted(search.top_k(corpus, asked, k=4, query_terms=300).collect()):
        got[r["query_id"]].append((r["rank"], r["doc_id"], r["score"]))
    own = {d: collections.Counter((t or "").encode().lower().split()) for d, t, *_ in corpus_rows}
    df = collections.Counter(w for c in own.values() for w in c)
    n, mean = len(own), sum(sum(c.values()) for c in own.values()) / len(own)
    for q in (d for d in own if d % 5 == 0):
        scores = []
        for d, c in own.items():
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm)
                        for w in own[q] if w in c)
            if score > 0 and d != q:
                scores.append((-round(score, 9), d))
        best = sorted(scores)[:4]
        assert [d for _, d, _ in got[q]] == [d for _, d in best]
        assert [s for _, _, s in got[q]] == pytest.approx([-s for s, _ in best])


def test_top_k_odd_rows(odd, empty):
    assert search.top_k(empty, empty).count() == 0
    rows = search.top_k(odd, odd, k=2).collect()
    assert all(r["query_id"] is not None and r["doc_id"] is not None for r in rows)
    assert {r["doc_id"] for r in rows if r["query_id"] == 2} == {1}


def test_operators_do_not_depend_on_partitions(corpus):
    few, many = corpus.coalesce(1), corpus.repartition(9)
    for run in (jaccard.join, suffixes.deduplicate, lambda d: lines.deduplicate(d).drop("text")):
        assert sorted(map(str, run(few).collect())) == sorted(map(str, run(many).collect()))
