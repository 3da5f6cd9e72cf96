from drivelaws.operators import sample as S


def test_large_constant_groups_are_not_gathered(spark, monkeypatch):
    """Where every large group is constant, only the small ones may be ordered from their rows."""
    gathered, inside = [], S._inside
    monkeypatch.setattr(S, "_inside", lambda *a: gathered.append(inside(*a)) or gathered[-1])
    rows = [("hot", 1.0)] * 3000 + [("off", 0.0)] * 2000 + [("few", float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "criteria string, x double")
    got = {r.criteria: r.pct for r in S.percentiles(df, [0.0, 0.5, 1.0], gather=100).collect()}
    assert got == {"hot": [1.0] * 3, "off": [0.0] * 3, "few": [0.0, 2.0, 4.0]}
    assert [g.count() for g in gathered] == [5]
