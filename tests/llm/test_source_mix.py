import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm.source_mix import budgets, mix_sources, smoothed


def water_fill(supply, weights, budget, epochs):
    """Brute force: pours the budget in small steps. Every node splits a drop among children that
    can still take some, so siblings take what one cannot before their parents' siblings do."""
    tree = {}
    for leaf in supply:
        for d in range(len(leaf)):
            tree.setdefault(leaf[:d], set()).add(leaf[: d + 1])
    got = dict.fromkeys(supply, 0.0)
    room = lambda p: sum(n * epochs - got[leaf] for leaf, n in supply.items() if leaf[: len(p)] == p)

    def pour(p, x):
        if p in supply:
            got[p] += x
            return
        fit = [c for c in tree[p] if room(c) > 1e-9]
        total = sum(weights.get(c, 1.0) for c in fit)
        for c in fit:
            pour(c, x * weights.get(c, 1.0) / total)

    drop = budget / 2000
    for _ in range(2000):
        pour((), drop)
    return got


@pytest.mark.parametrize("seed", range(6))
def test_budgets_against_pouring(seed):
    rng = random.Random(seed)
    supply = {(d, lang, s): rng.choice([10, 50, 200, 1000]) for d in "ab" for lang in ("x", "y") for s in "pqr" if rng.random() < 0.8}
    weights = {p: rng.choice([0.5, 1, 2, 3]) for leaf in supply for p in (leaf[:1], leaf[:2], leaf)}
    total = sum(supply.values())
    for part in (0.3, 0.9, 1.5):
        give = budgets(supply, weights, total * part, 2)
        want = water_fill(supply, weights, total * part, 2)
        assert abs(sum(give.values()) - min(total * part, total * 2)) <= len(supply)
        for p in supply:
            assert abs(give[p] - want[p]) <= 0.02 * total


def test_shortage_goes_to_siblings_first():
    supply = {("a", "x", "p"): 10, ("a", "x", "q"): 1000, ("a", "y", "p"): 1000, ("b", "x", "p"): 1000}
    give = budgets(supply, {}, 400, 1)
    assert give == {("a", "x", "p"): 10, ("a", "x", "q"): 90, ("a", "y", "p"): 100, ("b", "x", "p"): 200}


def test_selection_is_the_seeded_prefix(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["s1", "s2", "t1", None]), rng.choice(["en", "de", None]), " ".join(["w"] * rng.choice([0, 1, 7, 30])), "x") for i in range(400)]
    rows += [(None, "s1", "en", None, "x"), (5, "s1", "en", "w", "x"), (5, "s1", "en", "w", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, epoch string")
    levels = {"domain": F.regexp_replace("source", "[0-9]+$", ""), "lang": F.col("lang"), "source": F.col("source")}
    got = mix_sources(df, levels, smoothed(0.5), seed=3).collect()
    none = lambda x: "(none)" if x is None else x
    tokens = lambda t: len((t or "").split()) + 1
    leaf = lambda s, lang: (none(s and s.rstrip("0123456789")), none(lang), none(s))
    supply = {}
    for _, s, lang, t, _ in rows:
        supply[leaf(s, lang)] = supply.get(leaf(s, lang), 0) + tokens(t)
    give = budgets(supply, smoothed(0.5), sum(supply.values()), 2.0)
    for p, n in supply.items():
        own = [x for x in got if leaf(x.source, x.lang) == p]
        assert all(x.n_tokens == tokens(x.text) for x in own)
        passes, rest = divmod(give[p], n)
        for e in range(passes):
            assert sum(x.n_tokens for x in own if x.epoch == e) == n
        last = [x.n_tokens for x in own if x.epoch == passes]
        assert len(own) == len([x for x in own if x.epoch <= passes])
        # the prefix reaches the share, and would not without one of its documents
        assert sum(last) >= rest and (not last or sum(last) - max(last) < rest)
    again = mix_sources(df.repartition(7), levels, smoothed(0.5), seed=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mix_sources(df, {"source": F.col("source")}, {}).count() == 0
