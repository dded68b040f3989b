import math
import zlib

import numpy as np
import pyarrow as pa

from evenkeel.llm import language_id as L

from .frames import documents


def slow_bits(counts, languages, size, text, lang):
    """PPM-C code length by dictionaries, from the same grams."""
    grams = {}
    for name, gram, n in counts:
        if name == lang:
            symbols = [(gram >> (8 * k)) & 255 for k in range(L.ORDER + 1)]
            for order in range(L.ORDER + 1):
                grams.setdefault(tuple(symbols[1 : order + 1]), {}).setdefault(symbols[0], 0)
                grams[tuple(symbols[1 : order + 1])][symbols[0]] += n
    folded = [0x20] * L.ORDER + [int(L.FOLD[b]) for b in text]
    bits = 0.0
    for i in range(L.ORDER, len(folded)):
        for order in range(L.ORDER, -1, -1):
            seen = grams.get(tuple(folded[i - order : i][::-1]))
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if folded[i] in seen:
                bits += math.log2(total / seen[folded[i]])
                break
            bits += math.log2(total / len(seen))
        else:
            bits += math.log2(size)
    return bits


def test_code_lengths_are_exact(monkeypatch):
    monkeypatch.setattr(L, "MIN_COUNT", 1)
    texts = {"en": b"the cat sat on the mat. The dog ran 12 miles", "fr": "le chat est là où le chien dort, été".encode()}
    counts = []
    for name, text in texts.items():
        folded = [0x20] * L.ORDER + [int(L.FOLD[b]) for b in text]
        found = {}
        for i in range(L.ORDER, len(folded)):
            gram = sum(folded[i - k] << (8 * k) for k in range(L.ORDER + 1))
            found[gram] = found.get(gram, 0) + 1
        counts += [(name, g, n) for g, n in found.items()]
    names, which = np.unique([x[0] for x in counts], return_inverse=True)
    model = L.Model.train(names.tolist(), which, np.array([x[1] for x in counts]), np.array([x[2] for x in counts]))
    for text in ("the dog sat", "le chat", "Zq%9 été", "", "x"):
        got = model.code_lengths(pa.array([text]))[0]
        for j, name in enumerate(model.languages):
            assert abs(got[j] - slow_bits(counts, model.languages, model.cost.shape[1], text.encode(), name)) < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(got.doc_id, got.held_out))
    assert got.score.between(0, 1).all() and set(got.lang_pred) <= {"en", "fr", "de", "es", "und"}
    held = got[got.held_out & got.lang.notna() & (got.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_no_language_is_starved_by_others(spark, monkeypatch):
    """With tables for few contexts, a language with one short document keeps its most frequent ones, and its singletons count."""
    monkeypatch.setattr(L, "MAX_CONTEXTS", 12)
    big = "the quick brown fox jumps over the lazy dog and runs away from here "
    table = [(3 * i, big * 20, "en") + (None,) * 5 for i in range(40) if zlib.crc32(str(3 * i).encode()) % 3 != 1]
    small = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 3 != 1)
    table += [(small, "zwölf boxkämpfer jagen", "de") + (None,) * 5, (9001, "jagen zwölf", None) + (None,) * 5, (9002, "over the fox", None) + (None,) * 5]
    got = {r.doc_id: r.lang_pred for r in L.identify(documents(spark, table)).collect()}
    assert got[9001] == "de" and got[9002] == "en"


def test_many_languages(spark):
    """More languages than ever fitted a fixed bound, each of them learnt and told apart by its only singletons."""
    letters = [chr(0x4E00 + 97 * k) for k in range(300)]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1][:300]
    table = [(i, c * 5, f"l{k:03d}") + (None,) * 5 for k, (i, c) in enumerate(zip(ids, letters))]
    got = {r.doc_id: r.lang_pred for r in L.identify(documents(spark, table)).collect()}
    assert sum(got[i] == f"l{k:03d}" for k, i in enumerate(ids)) > 290


def test_rows_without_an_id_are_sampled(spark):
    table = [(None, f"{w} some words of this tongue {k}", lang) + (None,) * 5 for k in range(60) for w, lang in (("the cat", "en"), ("le chat est là", "fr"))]
    got = L.identify(documents(spark, table), max_docs=20).collect()
    assert {r.lang_pred for r in got} == {"en", "fr"}


def test_awkward_rows(spark):
    got = {r.doc_id: r for r in L.identify(documents(spark)).collect()}
    assert [got[i].lang_pred for i in (6, 7, 8, 11)] == ["und"] * 4
    assert L.identify(documents(spark, [])).count() == 0
    only = L.identify(documents(spark, [(1, "abc", None) + (None,) * 5])).collect()
    assert [tuple(r) for r in only] == [(1, False, "und", 0.0)]
