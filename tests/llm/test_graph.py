import random

from kmerloom.llm._graph import components, grown

from . import helpers as H


def roots(edges):
    return H.union_components({x for e in edges for x in e}, edges)


def test_components_and_what_is_added_to_them(spark):
    r = random.Random(2)
    first = [(r.randrange(80), r.randrange(80)) for _ in range(40)] + [(500, 100 + k) for k in range(60)] + [(7, 7)]  # a hub, and a loop
    more = [(r.randrange(120), r.randrange(700)) for _ in range(30)] + [(900, 901), (901, 902)]
    frame = lambda e: spark.createDataFrame(e, "u long, v long")
    root = components(frame(first))
    of = lambda df: {x["node"]: x["root"] for x in df.collect()}
    assert of(root) == {x: y for x, y in roots([e for e in first if e[0] != e[1]]).items()}
    got = of(grown(root, frame(more)))
    want = roots([e for e in first + more if e[0] != e[1]])
    assert {x: got.get(x, x) for x in want} == want
    assert of(grown(root, frame(more).where("false"))) == of(root) and of(grown(root, frame(first))) == of(root)
