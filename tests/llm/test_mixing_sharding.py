import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from evenkeel.llm import mixing, sharding

from .frames import WORD, documents, rows


def brute_mix(docs):
    """(doc_id, source, text) to {row number: (size, source_size, target, taken, start, words)}."""
    sizes = [len(WORD.findall(t or "")) for _, _, t in docs]
    own = defaultdict(list)
    for i, (_, s, _) in enumerate(docs):
        own[s].append(i)
    names = sorted((s for s in own if s is not None), key=lambda s: s.encode()) + ([None] if None in own else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(sizes[i] for i in own[s]) for s in names}
    target, free, rest = {}, set(names), float(sum(sizes))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            rest -= target[s]
            free.discard(s)
        if not free:
            break
    out = {}
    for s in names:
        words, start = int(target[s] + 0.5), 0
        key = lambda i: (hashlib.md5(((docs[i][2] or "") if docs[i][0] is None else str(docs[i][0])).encode()).hexdigest(), sizes[i])
        for i in sorted(own[s], key=key):
            taken = 0
            if total[s]:
                taken = sizes[i] * (words // total[s]) + max(0, min(sizes[i], words % total[s] - start))
            out[i] = (sizes[i], total[s], target[s], taken)
            start += sizes[i]
    return out


def test_mix_matches_brute_force(spark):
    table = rows()
    want = Counter((r[0], a, b, round(c, 6), d) for r, (a, b, c, d) in zip(table, (brute_mix([(r[0], r[3], r[1]) for r in table])[i] for i in range(len(table)))))
    got = mixing.mix_digest(documents(spark)).collect()
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == want
    assert all(r.taken <= 3 * r.size for r in got) and any(r.taken > r.size for r in got)


def test_mixed_documents_hold_the_words_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 37)
    docs = documents(spark)
    taken = Counter()
    for r in mixing.mix_digest(docs).collect():
        taken[r.doc_id] += r.taken
    words = Counter()
    for r in mixing.mix(docs).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_the_mix_comes_in_the_order_of_its_slots(spark, monkeypatch):
    """Sources are spread evenly over the mix, and each document stands at its first slot."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    docs = documents(spark, [(i, f"d{i} " + "w " * (20 + i % 60), None, f"s{i % 3}", 1, 1, "", "") for i in range(600)])
    first = {r.doc_id: r.first_slot for r in mixing.mix_digest(docs).collect()}
    seen, order = [], [(r.doc_id, r.source, len(r.text.split())) for r in mixing.mix(docs).collect()]
    met = {}
    for d, _, _ in order:
        if d not in met:
            met[d] = len(met)
            seen.append(first[d])
    assert seen == sorted(seen) and set(met) == {d for d, s in first.items() if s is not None}
    words = Counter()
    for _, s, n in order:
        words[s] += n
    half = Counter()
    for _, s, n in order[: len(order) // 2]:
        half[s] += n
    share = sum(half.values()) / sum(words.values())
    assert all(abs(half[s] - words[s] * share) < 500 for s in words)


def test_points_stay_exact_beyond_32_bits(spark):
    ids = [0, 1, 65535, 65536, (1 << 32) - 1, 1 << 32, 3 * 10**9 + 7, 10**13 + 1]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(mixing.point(F.col("i"))).collect()]
    assert got == [i * mixing.GOLDEN % (1 << 32) for i in ids]


def test_schedule_is_even(spark):
    base = documents(spark, [(i, "w " * 3000, None, f"s{i % 3}", 1, 1, "", "") for i in range(30)])
    sized = mixing.sized(base).cache()
    slots = sorted(map(tuple, mixing.schedule(sized, mixing.targets(sized).cache()).collect()))
    n = len(slots)
    share = Counter(k for _, k, _ in slots)
    for k, count in share.items():
        assert sorted(b for _, x, b in slots if x == k) == list(range(count))
        for part in (n // 4, n // 2):
            assert abs(sum(x == k for _, x, _ in slots[:part]) - count * part / n) < 4


def test_empty_mix(spark):
    assert mixing.mix_digest(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix_digest(documents(spark, [(1, None, None, None) + (None,) * 4])).collect()] == [0]


def test_shards(spark):
    table = rows()
    got = sharding.assign(documents(spark)).collect()
    assert len(got) == len(table)
    best = lambda d, n: max(range(n), key=lambda i: hashlib.md5(f"{'' if d is None else d}:{i}".encode()).hexdigest())
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()), best(r[0], 40), best(r[0], 41)) for r in table)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(documents(spark, [])).count() == 0


def test_weighted_shards(spark):
    docs = documents(spark, [(i, "t") + (None,) * 6 for i in range(3000)])
    n = Counter(r.shard for r in sharding.assign(docs, 4, [1.0, 1.0, 2.0, 4.0]).collect())
    assert all(abs(n[i] / 3000 - w / 8) < 0.04 for i, w in enumerate([1, 1, 2, 4]))
    moved = [r for r in sharding.assign(docs, 4, [1.0, 1.0, 2.0, 4.0], 2.0).collect() if r.grown_shard != r.shard]
    assert moved and all(r.grown_shard == 4 for r in moved)


def test_tables_of_the_mix_that_grow_are_not_broadcast(spark):
    """Schedule, pieces and spans are joined by shuffling both sides, however small; sources and sums may be broadcast."""
    base = mixing.stored(mixing.sized(documents(spark)))
    goals = mixing.stored(mixing.targets(base))
    for out in (mixing.pieces(base, goals), mixing.mix_digest(documents(spark)), mixing.mix(documents(spark))):
        assert out.count()
        plan = out._jdf.queryExecution().executedPlan().toString()
        sides = [x for x in plan.splitlines() if "BroadcastHashJoin" in x]
        assert "SortMergeJoin" in plan and not any(re.search(r"block#|slot#|\brn#|own_h#", x) for x in sides)
