import random

from loomwright.operators import model

NAMES = ["Foo", "Foo 2", "Foo 2 2", "foo-3", "Foo 10", "Bar", "", "!", "Section", "section 2", "Foo2", "Foo 02", "2", "2 2"]


def plain(names):
    taken, out = set(), []
    for n in names:
        b = "-".join("".join(c if c.isalnum() else " " for c in n.lower()).split()) or "section"
        k, i = b, 2
        while k in taken:
            k, i = f"{b}-{i}", i + 1
        taken.add(k)
        out.append(k)
    return out


def test_anchors_against_a_plain_fold(spark):
    rng = random.Random(3)
    pages = {p: [rng.choice(NAMES[: rng.choice((2, 5, 14))]) for _ in range(rng.choice((1, 2, 5, 12, 40)))] for p in range(60)}
    rows = [(p, i, n, 1) for p, names in pages.items() for i, n in enumerate(names)]
    got = model.unique_anchors(spark.createDataFrame(rows, "slug int, pos int, name string, id int").drop("id").repartition(5), "slug", "pos", "name")
    assert got.columns == ["slug", "pos", "name", "id"]
    have = {(r.slug, r.pos): r.id for r in got.collect()}
    assert have == {(p, i): k for p, names in pages.items() for i, k in enumerate(plain(names))}
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
