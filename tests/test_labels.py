import math
import random

import pytest

from asterism.operators import labels


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "text string, cluster int")


def named(df, k, **kw):
    return [r.label for r in labels.label_groups(df, k=k, **kw).orderBy("cluster").collect()]


def test_clusters_are_named_by_distinctive_terms(spark):
    df = docs(
        spark, ("prune every rose in March", 0), ("feed the rose weekly", 0), ("rose wants full sun", 0),
        ("tune the banjo first", 1), ("restring an old banjo", 1),
    )
    first, second = named(df, 2)
    assert first.startswith("rose") and second.startswith("banjo")


def test_a_group_without_terms_is_misc(spark):
    assert named(docs(spark, ("gravel path", 0)), 2)[1] == "misc"
    assert named(docs(spark).limit(0), 3) == ["misc"] * 3
    assert named(docs(spark, ("-- ?; --", 0)), 1) == ["misc"]


def plain_best(rows, k, top):
    """Label of every group by counting: count times ln(1 + N / df), equal scores by the alphabet."""
    inside = [(set(t.split()), c) for t, c in rows if c is not None and 0 <= c < k]
    out = []
    for group in range(k):
        score = {}
        for word in {w for words, c in inside if c == group for w in words}:
            tf, df = (sum(word in words for words, c in inside if g is None or c == g) for g in (group, None))
            score[word] = round(tf * math.log(1 + len(rows) / df), 9)
        best = sorted(score, key=lambda w: (-score[w], w))[:top]
        out.append(" · ".join(best) or "misc")
    return out


@pytest.mark.parametrize("seed", range(4))
def test_only_assignments_inside_the_range_name_clusters_but_all_texts_count(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("bdgkmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(12)]
    rows = [
        (" ".join(rng.choices(words, k=rng.randint(1, 5))), rng.choice([None, -2, -1, 0, 1, 1, 2, 3, 9])) for _ in range(60)
    ]
    assert named(docs(spark, *rows), 4, top_n=3) == plain_best(rows, 4, 3)


def test_terms_count_once_per_text_and_df_spans_groups(spark):
    df = docs(spark, ("copper copper copper", 0), ("dull copper", 0), ("bright copper", 1), ("bright", 1))
    got = {(r.cluster, r.term): (r.tf, r.df) for r in labels.term_df(df, k=2).collect()}
    assert got == {(0, "copper"): (2, 3), (0, "dull"): (1, 1), (1, "copper"): (1, 3), (1, "bright"): (2, 2)}


def test_ties_follow_the_alphabet_not_the_bytes(spark):
    df = docs(spark, ("zebra écran eclair apple ångström", 0))
    assert named(df, 1, top_n=5) == ["ångström · apple · eclair · écran · zebra"]


def test_any_column_can_group(spark):
    df = spark.createDataFrame([("tin drum", "x"), ("loose wire", "y"), ("(?)", "z")], "body string, kind string")
    got = {r.kind: r.label for r in labels.label_groups(df, "kind", "body").collect()}
    assert got == {"x": "drum · tin", "y": "loose · wire", "z": "misc"}


def test_ranking_limits_groups_before_the_last_shuffle(spark):
    df = docs(spark, ("walnut larch", 0))
    plan = labels.top_terms(df, k=1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
