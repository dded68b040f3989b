import random

import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from evenkeel.llm import byte_bpe, language_id

from .frames import WORD, documents, rows
from .test_dedup import brute_print
from .test_mixing_sharding import brute_mix


def key(row):
    """What orders documents: the id, null first, then a hash of the text."""
    tag = xxhash.xxh64_intdigest(row[2].encode(), 42)
    return (-(1 << 63) if row[0] is None else row[0], tag - (1 << 64) if tag >> 63 else tag)


def brute_pipeline(table):
    docs = [(r[0], r[3], r[1]) for r in table if any(c.isalpha() for c in r[1] or "")]
    prints = [brute_print(t) for _, _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    kept = sorted({min((d for d, h in zip(docs, group) if h == g), key=key) for g in group}, key=key)
    order = lambda r: (key(r)[0], key(r)[1] % (1 << 64))
    first = {}
    for r in kept:
        w = WORD.findall(r[2])
        for k in range(len(w) - 19):
            first[tuple(w[k : k + 20])] = min(first.get(tuple(w[k : k + 20]), (order(r), k)), (order(r), k))
    cut = []
    for r in kept:
        d, s, t = r
        w = WORD.findall(t)
        gone = {k + x for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (order(r), k) for x in range(20)}
        if len(gone) < len(w):
            cut.append((d, s, t if not gone else " ".join(x for k, x in enumerate(w) if k not in gone)))
    out = []
    for i, (size, _, _, taken) in brute_mix(cut).items():
        d, s, t = cut[i]
        while taken > 0:
            n = min(size, taken)
            out.append((d, s, t if n == size else WORD.findall(t)[:n]))
            taken -= n
    return out


def shared_ids():
    """The awkward rows, and different texts under one id or without any."""
    text = lambda k: " ".join(f"w{random.Random(k * 1000 + i).randrange(10**6)}" for i in range(40 + k))
    more = [(None, text(1)), (None, text(2)), (3, text(3)), (3, text(4)), (None, text(2)), (300, text(1) + " " + text(5)), (300, text(6) + " " + text(4))]
    return rows() + [(d, t, "en", "s2", len(t), 1, "r", "k") for d, t in more]


@pytest.mark.parametrize("table", [rows, shared_ids])
def test_run_matches_brute_force(spark, tmp_path, table):
    documents(spark, table()).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    codec = byte_bpe.codec()
    public = tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=codec.ranks, special_tokens={})
    want = []
    for d, s, t in brute_pipeline(table()):
        text = t if isinstance(t, str) else " ".join(t)
        want.append((str(d), str(s), text, public.encode_ordinary(text)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.source), r.decoded, list(r.ids)) for r in got) == sorted(want)


def test_stages_keep_the_columns(spark):
    docs = documents(spark)
    own = {c: F.lit("mine") for c in ("null", "null_", "row", "tag", "from", "to", "own_h", "cut", "run", "__id", "__tag", "__null")}
    mine = docs.withColumns(own)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, mine, "")
        assert got.schema.names == mine.schema.names and {tuple(r) for r in got.select(*own).distinct().collect()} == {("mine",) * len(own)}, name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").schema.names == docs.schema.names, name
        assert stage(spark, documents(spark, []), "").count() == 0
    assert stage(spark, docs.limit(0), "").count() == 0


def test_language_stage_rejects_only_what_has_no_letter(spark):
    docs = documents(spark)
    kept = corpus_pipeline.stage_language_id(spark, docs, "")
    assert kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in rows())
    assert language_id.UNDETERMINED not in {r.lang for r in kept.collect()}
