import pytest

from evenkeel.operators import memory
from evenkeel.sources import remote


def test_column_orders_differ_and_repeat():
    columns = list("abcdefgh")
    orders = {tuple(memory.column_order(columns, i)) for i in range(5)}
    assert len(orders) == 5 and all(sorted(o) == columns for o in orders)
    assert memory.column_order(columns, 3) == memory.column_order(columns, 3)


def test_layers(spark):
    known = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.0, 10.0)], "id long, a double, b double")
    own = spark.createDataFrame([(3, 1.0, 0.0), (4, 0.5, 5.0), (5, 0.98, 0.0)], "id long, a double, b double")
    got = {r.id: r.verdict for r in memory.layers(own, known, ["a", "b"], cosine=0.99999999, gower=0.05).collect()}
    assert got[3] == "hash" and got[4] == "new" and got[5] in ("cosine", "gower")
    assert memory.layers(own.where("false"), known, ["a", "b"]).count() == 0


def test_retries():
    waits, calls = [], []

    def model(prompt):
        calls.append(prompt)
        if len(calls) == 1:
            raise remote.Busy("rate limited, try again in 2.5 s")
        if len(calls) == 2:
            raise TimeoutError
        return "ok"

    assert remote.ask(model, "p", pause=1.0, sleep=waits.append) == "ok" and waits == [2.5, 2.0]
    with pytest.raises(KeyError):
        remote.ask(lambda p: {}[p], "p")


def test_proposals_from_a_model(spark):
    anchors = spark.createDataFrame([(1, 120.4, "x"), (2, 3.25, "y")], "id long, price double, kind string")
    echo = lambda prompt: "```\nprice,kind\n" + prompt.splitlines()[-1] + "\nbroken\n```"
    got = sorted(map(tuple, remote.propose(anchors, {"price": "double", "kind": "string"}, echo).collect()))
    assert got == [(1, 2, 120.0, "x"), (2, 2, 3.3, "y")] or got == [(1, 2, 120.0, "x"), (2, 2, 3.2, "y")]
