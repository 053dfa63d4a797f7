"""op7 and pipeline: lines are compared in two steps, and components end as soon as they are stars."""

import random

from test_review_r03 import _changed, _word

from verdure.llm import common, lines


def test_components_of_stars_take_one_round(spark, monkeypatch):
    made, real = [], common.checkpointed
    monkeypatch.setattr(common, "checkpointed", lambda df: made.append(1) or real(df))
    edges = [(1, 5), (1, 6), (2, 8)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.id, r.comp) for r in got) == [(1, 1), (2, 2), (5, 1), (6, 1), (8, 2)] and len(made) == 2
    chain = list(range(60))
    random.Random(1).shuffle(chain)
    got = common.connected_components(spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long")).collect()
    assert sorted((r.id, r.comp) for r in got) == [(i, 0) for i in range(60)]


def test_links_join_old_components(spark):
    comps = spark.createDataFrame([(1, 1), (5, 1), (2, 2), (8, 2), (3, 3), (9, 3)], "id long, comp long")
    got = lines._merged(comps, spark.createDataFrame([(5, 8), (20, 9), (30, 31)], "a long, b long")).collect()
    assert sorted((r.id, r.comp) for r in got) == [(1, 1), (2, 1), (3, 3), (5, 1), (8, 1), (9, 3), (20, 3), (30, 30), (31, 30)]


def test_lines_are_compared_in_two_steps(spark, monkeypatch):
    """Lines with a common passage: the least ones of a key and of its parts in one step, what is open in another; few pairs are made in that."""
    rng = random.Random(7)
    passage = [_word(rng) for _ in range(45)]
    texts = [" ".join([*(_word(rng) for _ in range(20)), *passage, *(_word(rng) for _ in range(20))]) for _ in range(150)]
    texts += [" ".join(_changed(rng, texts[i].split(" "), 6)) for i in range(0, 30, 10)]
    made, real = [], lines.verified
    monkeypatch.setattr(lines, "verified", lambda pairs, texts: made.append(pairs.count()) or real(pairs, texts))
    got = lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if r.n_removed) == [150, 151, 152] and len(made) <= 2 and all(n < 30 for n in made[1:]), made
