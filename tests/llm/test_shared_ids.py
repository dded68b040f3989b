"""Different texts under one id, or without an id, are documents of their own."""

import random

import pytest
import xxhash

import corpus_pipeline
from evenkeel.llm import substring_dedup

from .frames import WORD, documents


def words(seed, n):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))


def shared():
    passage = words(0, 30)
    texts = [
        (None, words(1, 50) + " " + passage), (None, words(2, 12)), (None, words(3, 100)), (None, passage + " " + words(4, 40)), (None, words(3, 100)),
        (1, passage + " " + words(5, 70)), (7, words(6, 40) + " " + passage + " " + passage), (7, words(7, 90)), (7, words(8, 5)), (8, words(7, 90)), (9, words(9, 60)),
    ]
    return [(d, t, "en", "s1", len(t), i, "r", "k") for i, (d, t) in enumerate(texts)]


def brute(table, width=20):
    key = lambda d, t: (-(1 << 63) if d is None else d, xxhash.xxh64_intdigest(t.encode(), 42))
    docs = [(d, key(d, t), WORD.findall(t)) for d, t, *_ in table]
    first = {}
    for _, k, w in docs:
        for s in range(len(w) - width + 1):
            at = tuple(w[s : s + width])
            first[at] = min(first.get(at, (k, s)), (k, s))
    out = []
    for d, k, w in docs:
        gone = {s + x for s in range(len(w) - width + 1) if first[tuple(w[s : s + width])] < (k, s) for x in range(width)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [substring_dedup.MAX_CLASHES, 1])
@pytest.mark.parametrize("parts", [1, 5])
def test_substring_dedup_tells_texts_of_one_id_apart(spark, monkeypatch, most, parts):
    monkeypatch.setattr(substring_dedup, "MAX_CLASHES", most)
    got = substring_dedup.dedup_substrings(documents(spark, shared()).repartition(parts)).collect()
    assert sorted(map(tuple, got), key=str) == brute(shared())


def test_near_dedup_keeps_unrelated_texts_without_an_id(spark):
    near = words(21, 200)
    texts = [(None, words(20, 80)), (None, near), (None, words(22, 60)), (None, words(22, 60)), (5, near + " more"), (6, words(23, 70)), (6, words(24, 70)), (7, words(24, 70))]
    docs = documents(spark, [(d, t, "en", "s1", len(t), i, "r", "k") for i, (d, t) in enumerate(texts)])
    got = [(r.doc_id, r.text) for r in corpus_pipeline.stage_near_dedup(spark, docs.repartition(3), "").collect()]
    want = [texts[k] for k in (0, 1, 2, 5, 6)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert corpus_pipeline.stage_substring_dedup(spark, docs.where("doc_id IS NULL"), "").count() == 4
