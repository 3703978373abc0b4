"""The plans of raking stay small, so that its rounds leave little on the driver."""

from morrow.llm import mixing


def test_a_marginal_reads_the_cells_twice(spark, monkeypatch):
    relations, store = [], mixing.stored

    def recorded(df, name, *args):
        if name == "cells":
            relations.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return store(df, name, *args)

    monkeypatch.setattr(mixing, "stored", recorded)
    rows = [(s, g, t, 100 + 10 * i) for i, (s, g, t) in enumerate((s, g, t) for s in "ab" for g in "de" for t in "xy")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {
        name: spark.createDataFrame([(first, 0.4), (second, 0.6)], "value string, share double")
        for name, (first, second) in zip(mixing.MARGINALS, ("ab", "de", "xy"), strict=True)
    }
    raked = mixing.rake(cells, targets, tolerance=1e-6, budget=0.5).collect()
    # The cells twice and the goals once, whatever the number of marginals.
    assert max(relations) == 3
    total = sum(r.tokens * min(1.0, r.factor) for r in raked)
    assert abs(total - 0.5 * sum(r.tokens for r in raked)) < 1e-3 * total
    for name, (first, _) in zip(mixing.MARGINALS, ("ab", "de", "xy"), strict=True):
        share = sum(r.tokens * min(1.0, r.factor) for r in raked if r[name] == first) / total
        assert abs(share - 0.4) < 1e-4
