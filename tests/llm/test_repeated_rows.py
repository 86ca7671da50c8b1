"""Repeated ids with unlike texts, ties, short items, texts that do not fit, and columns with clashing names."""

import random

import brute
import pytest
from conftest import SCHEMA, prose
from pyspark.sql import functions as F

import corpus_pipeline
from runlumen.llm import decontaminate, jaccard, mixing, quality, sharding


def unlike_rows(n=12, seed=4):
    """Each id stands at two unlike texts, and each of these has a near copy of its own under another id."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        one, two = prose(rng, 60), prose(rng, 70)
        rows += [(100 + 2 * i, one), (101 + 2 * i, two), (500 + i, one + " more"), (500 + i, two + " words"),
                 (500 + i, two + " words")]
    return [(i, t, "en", "s", len(t)) for i, t in rows]


def test_join_keeps_the_links_of_each_text(spark):
    rows = unlike_rows()
    found = jaccard.join(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(tuple(r) for r in found) == brute.jaccard_components([r[:2] for r in rows])
    small = [(1, "a b c d e f g h"), (2, "p q r s t u v w"), (5, "a b c d e f g h i"), (5, "p q r s t u v w x")]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in small], SCHEMA)
    assert {r["component_id"] for r in jaccard.join(df, n=1, percent=80).collect()} == {1}
    # the same in blocks of few elements
    in_blocks = jaccard.join(spark.createDataFrame(rows, SCHEMA), block=150).collect()
    assert sorted(tuple(r) for r in in_blocks) == sorted(tuple(r) for r in found)


def test_stage_drops_only_rows_whose_own_text_is_in_a_group(spark):
    rng = random.Random(8)
    texts = [prose(rng, 50) for _ in range(6)]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[1]), (1, texts[1]), (7, texts[2]), (7, texts[3]),
            (9, texts[3] + " end"), (None, texts[4]), (None, texts[4]), (11, None), (11, None)]
    names = ["near_id", "near_text", "near_row", "several", "again", "least"]
    df = spark.createDataFrame([(*r, "en", "s", 0, *range(len(names))) for r in rows],
                               SCHEMA + "".join(f", {n} int" for n in names))
    kept = corpus_pipeline.keep_one_of_each(spark, df, "")
    assert kept.columns == df.columns
    found = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert found == sorted([(5, texts[0]), (1, texts[1]), (7, texts[2]), (7, texts[3]), (0, texts[4]), (0, texts[4]), (11, "")])
    assert {tuple(r[n] for n in names) for r in kept.collect()} == {tuple(range(len(names)))}


def test_mix_agrees_in_any_layout(spark):
    rng = random.Random(2)
    rows = [(i % 3, prose(rng, rng.randint(1, 9)), None, f"s{i % 2}", i) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    schedule = mixing.ramps(mixing.cyclic_weights(df))
    seen = set()
    for layout in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("n_chars")), df.orderBy("text")):
        mixed = mixing.mix(layout, schedule).select("doc_id", "text", "n_chars", "mix_taken", "mix_positions")
        seen.add(str(sorted(map(str, mixed.collect()))))
    assert len(seen) == 1


def test_ramps_vary_in_time_and_keep_the_shares(spark):
    df = spark.createDataFrame([(i, "w " * 5, None, f"s{i % 3}", 0) for i in range(300)], SCHEMA)
    weights = mixing.cyclic_weights(df)
    flat, ramp = (mixing.mix(df, s).select("doc_id", "mix_target", F.explode("mix_positions").alias("t"))
                  for s in (mixing.constant_schedule(weights), mixing.ramps(weights)))
    def target(m):
        return {r["doc_id"]: round(r["mix_target"], 6) for r in m.collect()}
    assert target(flat) == target(ramp)
    early = [m.filter("t < 0.5").count() / m.count() for m in (flat, ramp)]
    assert abs(early[0] - 0.5) < 0.03 and abs(early[1] - 0.375) < 0.03  # a ramp from 1/2 to 3/2 has 3/8 there


def test_own_columns_come_back(spark):
    names = ["mix_key", "mix_block", "mix_before", "mix_name", "mix_tie", "own", "shard_key", "shard_won", "shard_order",
             "shard_row", "shard_block", "shard_of"]
    rows = [(i, f"text {i}", "en", "s", 0, *range(len(names))) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} int" for n in names))
    for out in (mixing.mix(df, mixing.ramps(mixing.cyclic_weights(df))), sharding.assign(df, 4)):
        assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}


def test_short_items_are_found_between_word_bounds(spark):
    items = spark.createDataFrame([(1, "Short  secret item"), (2, "x-1"), (3, " "), (4, "a longer item of many words")],
                                  "item_id long, text string")
    texts = ["a SHORT secret\nitem here", "short secret items", "f(x-1)", "xx-1", "x-12", "x-1", "", None,
             "an a longer itm of many words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["items"] for r in decontaminate.contaminating(docs, items).collect()}
    assert found == {0: [1], 1: [], 2: [2], 3: [], 4: [], 5: [2], 6: [], 7: [], 8: [4]}


def test_texts_that_do_not_fit_are_passed_over(spark):
    good, bad = "calm clear prose of some length", "click buy now free casino"
    rows = [(i, good if i % 2 else bad) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(70)], "doc_id long, quality int, toxic int")
    long = [(i, bad * 40_000) for i in range(60, 70)]
    df = spark.createDataFrame(rows + long, "doc_id long, text string")
    # nothing but the long texts is too much for the sample
    model = quality.train(df, labels, most_bytes=500_000)
    shown = {r["doc_id"]: r["quality_score"] for r in quality.score(df, model).collect()}
    assert shown[1] > 0.5 > shown[0]
    with pytest.raises(Exception, match="fits"):
        quality.train(spark.createDataFrame(long, "doc_id long, text string"), labels, most_bytes=1000)
