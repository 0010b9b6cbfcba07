"""The lattice walk kept step by step, against the walk worked out anew."""

import random

import numpy as np

from lakewright.llm import toxicity


def walked(model, written):
    states = {("", "")}
    for ch in written:
        if ch in toxicity.MARKS:
            continue
        now = set()
        for at, last in states:
            for out in (ch, *toxicity.LOOKALIKES.get(ch, "")):
                if at + out in model.begin:
                    return True, set()
                if at + out in model.alive:
                    now.add((at + out, out))
                if out == last:
                    now.add((at, last))
        states = now
    return any(at in model.whole for at, _ in states), states


def test_kept_steps_walk_alike_and_are_worked_out_once():
    weights = {"=stupid": 3.0, "^stu": 2.0, "=idiot": 2.5, "=fool": 2.0, "^trash": 4.0, "=lies": 1.0, "=été": 2.0, "=a": 1.0}
    model = toxicity.ToxicityModel(None, weights, np.empty(0))
    r, worked = random.Random(5), []
    follow = model._follow
    model._follow = lambda node, ch: worked.append(1) or follow(node, ch)
    signs, total = "stupidfolraheé" * 3 + "10$@!.-4+|xß", 0
    for _ in range(20_000):
        written = "".join(r.choices(signs, k=r.randrange(9)))
        if r.random() < 0.5:
            w = r.choice(["stupid", "idiot", "fool", "trash", "lies", "été"])
            written = "".join(c * r.choice([1, 1, 2]) + r.choice(["", "", ".", "-"]) for c in w)[:r.randrange(14)]
        weighs, ends = model._walk(model._node(toxicity._START), written)
        assert (weighs, set(ends.states) if ends else set()) == walked(model, written), written
        total += len(written)
    assert len(worked) < total / 20


def test_a_reset_changes_no_reading():
    weights = {"=stupid": 3.0, "^stu": 2.0, "=idiot": 2.5, "=fool": 2.0}
    r = random.Random(6)
    words = ["stu", "pid", "s", "t", "u", "p", "i", "d,", "1d10t", "f00", "l", "foo", "the", "man", "f-o-o-l", "iddiot!", "(fo)", "ol"]
    texts = [" ".join(r.choices(words, k=12)) for _ in range(800)]
    plenty, few = toxicity.ToxicityModel(None, weights, np.empty(0)), toxicity.ToxicityModel(None, weights, np.empty(0), size=3)
    assert [plenty.prepare(t) for t in texts] == [few.prepare(t) for t in texts]
