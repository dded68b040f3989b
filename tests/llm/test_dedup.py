import hashlib

import xxhash

from evenkeel.llm import simhash, substring_dedup

from .frames import WORD, documents, rows


def brute_substring(table, width=20):
    docs = [(-(1 << 63) if r[0] is None else r[0], WORD.findall(r[1] or "")) for r in table]
    first = {}
    for d, w in docs:
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            first[key] = min(first.get(key, (d, s)), (d, s))
    out = []
    for d, w in docs:
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (d, s):
                gone.update(range(s, s + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((None if d == -(1 << 63) else d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_matches_brute_force(spark):
    got = sorted(map(tuple, substring_dedup.substring_digest(documents(spark)).collect()), key=str)
    assert got == brute_substring(rows())
    assert any(x[2] for x in got)


def test_substring_dedup_with_a_crowded_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MAX_CELLS_LOG2", 16)
    got = sorted(map(tuple, substring_dedup.substring_digest(documents(spark).repartition(5)).collect()), key=str)
    assert got == brute_substring(rows())


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.substring_digest(documents(spark, [])).count() == 0
    assert substring_dedup.substring_digest(documents(spark, [(1, None) + (None,) * 6])).first()[1:3] == (0, 0)


def brute_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Of each row's component, joined by fingerprints alone, the smallest id; None if it has none."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 4:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [min((d for (d, _), h in zip(prints, group) if h == g and d is not None), default=None) for g in group]


def test_simhash_matches_brute_force(spark):
    table = rows()
    prints = [(r[0], brute_print(r[1])) for r in table]
    want = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints))), key=str)
    got = sorted(map(tuple, simhash.near_duplicates(documents(spark)).collect()), key=str)
    assert got == want


def test_simhash_links_and_chunks(spark, monkeypatch):
    import random

    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(4)]
    prints = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(0, 5))) for b in base for _ in range(60)}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    want = brute_components([(i, p) for i, p in enumerate(prints)])
    for tile in (2048, 7):
        monkeypatch.setattr(simhash, "TILE", tile)
        edges = [tuple(r) for r in simhash.link_edges(spark.createDataFrame(signed, "fp long, rep long")).collect()]
        assert all(bin(prints[a] ^ prints[b]).count("1") <= 4 for a, b in edges)
        label = list(range(len(prints)))
        for _ in prints:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        assert label == want


def test_simhash_ties_no_texts_by_their_id(spark):
    texts = [(None, "a b c d e f"), (None, "now for something quite different"), (7, "one text here"), (7, "and other words there"), (8, "and other words there"), (None, "a b c d e f")]
    table = [(d, t) + (None,) * 6 for d, t in texts]
    got = sorted(map(tuple, simhash.near_duplicates(documents(spark, table)).collect()), key=str)
    prints = [(d, brute_print(t)) for d, t in texts]
    assert got == sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints))), key=str)


def test_substring_dedup_of_words_alike_to_a_weak_hash(spark):
    """Words of a Thue-Morse sequence and of its complement collide in any polynomial hash modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = ("".join("ab"[b ^ x] for b in bits) for x in (0, 1))
    table = [(1, " ".join([one] * 20)) + (None,) * 6, (2, " ".join([two] * 20)) + (None,) * 6, (3, " ".join([two] * 20)) + (None,) * 6]
    assert [tuple(r)[1:3] for r in substring_dedup.substring_digest(documents(spark, table)).orderBy("doc_id").collect()] == [(20, 0), (20, 0), (20, 20)]


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_growing_tables_are_not_broadcast(spark, monkeypatch):
    """Neither the rounds of the components nor the joins around them leave a table to the driver, however small."""
    from evenkeel.llm import runtime, simhash

    plans, cut = [], runtime.checkpoint

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(runtime, "checkpoint", seen)
    docs = spark.createDataFrame([(i, "one two three four five six" if i % 2 else f"a b c {i}") for i in range(12)], "doc_id long, text string")
    for out in (simhash.near_duplicates(docs), simhash.leaders(docs), runtime.connected_components(spark.range(9).selectExpr("id a", "id + 1 b"))):
        assert out.count()
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
