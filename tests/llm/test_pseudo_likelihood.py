import numpy as np

from evenkeel.llm import pseudo_likelihood as M

from .frames import documents, rows


def test_gradient_is_the_slope():
    rnd = np.random.default_rng(0)
    net = M.Network(M.Network.start(rnd.integers(0, 50, M.SYMBOLS)).flat.astype(np.float64))
    tokens = rnd.integers(0, M.SYMBOLS, (20, 2 * M.SIDE + 1))
    weight = rnd.random(20) + 0.1
    grad = net.gradient(tokens, weight)

    def loss(flat):
        logs = M.Network(flat).forward(tokens)[1][np.arange(20), tokens[:, 0]]
        return -(weight * logs).sum() / weight.sum()

    for k in [*rnd.integers(0, len(net.flat), 30), *np.flatnonzero(np.abs(grad) > 1e-3)[:30]]:
        step = np.zeros_like(net.flat)
        step[k] = 1e-5
        assert abs((loss(net.flat + step) - loss(net.flat - step)) / 2e-5 - grad[k]) < 1e-4


def test_a_token_is_not_predicted_from_itself():
    net = M.Network(M.Network.start(np.ones(M.SYMBOLS)).flat)
    tokens = np.array([[1, 2, 3, 4, 5, 6, 7], [9, 2, 3, 4, 5, 6, 7]])
    logs = net.forward(tokens)[1]
    assert np.allclose(logs[0], logs[1]) and np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-5)


def test_windows_by_hand():
    code = np.zeros(256, np.int64)
    code[[0x20, *b"abc"]] = [1, 2, 3, 4]
    data = np.frombuffer(b"abca", np.uint8)
    keys = M.windows(data, np.array([0, 3, 4]), code)
    assert M._tokens(keys).tolist() == [[2, 1, 3, 1, 4, 1, 1], [3, 2, 4, 1, 1, 1, 1], [4, 3, 1, 2, 1, 1, 1], [2, 1, 1, 1, 1, 1, 1]]


def test_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    code, flat = M.train(docs.select("text"))
    start = M.Network.start(np.bincount(code, minlength=M.SYMBOLS))
    text = np.frombuffer("".join(r.text for r in docs.limit(20).collect()).encode(), np.uint8)
    keys = M.windows(text, np.array([0, len(text)]), code)
    assert M.Network(flat).log_probability(keys).mean() > start.log_probability(keys).mean() + 0.2
    shuffled = np.random.default_rng(1).permutation(text)
    assert M.Network(flat).log_probability(M.windows(shuffled, np.array([0, len(text)]), code)).mean() < M.Network(flat).log_probability(keys).mean() - 0.3


def test_scores_do_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_BYTES", 40_000)  # several parts
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts, shuffled in ((2, 3), (7, 9), (31, 2)):
            spark.conf.set("spark.sql.shuffle.partitions", str(shuffled))
            spark.conf.set("spark.sql.adaptive.enabled", str(shuffled != 9).lower())
            got.append(sorted(map(tuple, M.score(docs.repartition(parts), rounds=2).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got[0] == got[1] == got[2]


def test_scores_by_a_slow_network(spark):
    """Token by token, in double precision, straight from the weights."""
    docs = documents(spark)
    code, flat = M.train(docs.select("text"))
    table, bias, out, out_bias = (p.astype(np.float64) for p in M.Network(flat).parts)
    found = {r.doc_id: r for r in M.score(docs).collect()}
    for i in (0, 2, 9, 11, 13, 17):
        tokens = [int(code[0x20])] * M.SIDE + [int(code[b]) for b in rows()[i][1].encode()] + [int(code[0x20])] * M.SIDE
        total = 0.0
        for at in range(M.SIDE, len(tokens) - M.SIDE):
            hidden = bias.copy()
            for k in range(1, M.SIDE + 1):
                hidden += table[2 * k - 2][tokens[at - k]] + table[2 * k - 1][tokens[at + k]]
            logits = np.tanh(hidden) @ out + out_bias
            total += logits[tokens[at]] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        assert found[i].n_tokens == len(tokens) - 2 * M.SIDE
        assert abs(found[i].log_prob - total) < 1e-3 * found[i].n_tokens ** 0.5 + 1e-4
        assert abs(found[i].perplexity - np.exp(-total / found[i].n_tokens)) < 1e-2


def test_awkward_rows(spark):
    got = M.score(documents(spark)).collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r.n_tokens == 0) == (r.mean_log_prob is None) and r.log_prob <= 0
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].log_prob == by_id[1].log_prob and by_id[6].n_tokens == 0
    assert M.score(documents(spark, [])).count() == 0
