"""Label propagation in file order against a sweep over the nodes one by one."""

import random
from collections import Counter

from weftline.operators.traverse import sweep_labels


def _sweep(links, order, rounds=10):
    at = dict(order)
    near = {}
    for a, b in links:
        near.setdefault(at[a], set()).add(at[b])
        near.setdefault(at[b], set()).add(at[a])
    label = {i: i for i in near}
    for _ in range(rounds):
        changed = False
        for i in sorted(near):
            votes = Counter(label[j] for j in sorted(near[i]))
            best = votes.most_common(1)[0][0]  # of equal counts the one met first
            changed, label[i] = changed or best != label[i], best
        if not changed:
            break
    names = {p: n for n, p in order}
    return {names[i]: x for i, x in label.items()}


def test_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((12, 14), (40, 90)):
        order = [(f"n{k}", p) for k, p in enumerate(rng.sample(range(1000), n))]
        links = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]  # links to oneself and repeated ones too
        got = sweep_labels(spark.createDataFrame(links, "a string, b string"), spark.createDataFrame(order, "node string, pos long"))
        assert {r.node: r.label for r in got.collect()} == _sweep(links, order)


def test_few_rounds_and_no_links(spark):
    order = [(f"n{k}", k) for k in range(8)]
    links = [(f"n{k}", f"n{k + 1}") for k in range(7)]
    at = spark.createDataFrame(order, "node string, pos long")
    for rounds in (2,):
        assert {r.node: r.label for r in sweep_labels(spark.createDataFrame(links, "a string, b string"), at, rounds).collect()} == _sweep(links, order, rounds)
    assert sweep_labels(spark.createDataFrame([], "a string, b string"), at).count() == 0
