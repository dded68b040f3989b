"""Small document tables with every awkward row, and brute-force helpers."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, end int, rank string, key string"


def rows():
    rnd = random.Random(7)
    vocabulary = ["Alpha", "beta", "gamma", "É", "delta-x", "42", "日本", "eps ilon", "zeta", "eta", "THETA", "iota", "kappa"]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    text = lambda n: " ".join(rnd.choice(vocabulary) + str(rnd.randrange(50)) for _ in range(n))
    base = text(120)
    out = [
        base,
        base,
        base.replace("Alpha", "alphA"),
        text(40) + " " + passage + "\n" + text(40),
        text(10) + "\t" + passage + " " + text(90),
        passage + "  " + passage,
        None,
        "",
        " \t\n ",
        "one",
        "one two three",
        "1234 %% --",
        "x" * 5000,
        "a b c d e " * 30,
        text(3000),
        text(19),
        base + " tail",
        "Ünïcödé " * 25,
    ]
    out += [base.rsplit(" ", k)[0] for k in (1, 2, 3)]
    table = [(i, t, ["en", "fr", None][i % 3], [None, "s1", "s2", "s3"][i % 4 if i % 5 else 1], None if t is None else len(t), i, "r", "k") for i, t in enumerate(out)]
    table.append(table[0])  # a repeated row
    table.append((None, base, "en", "s1", 1, 1, None, None))  # a null id
    return table


#: Names that operators use themselves, present in the input with other meanings.
CLASHING = "row score lang_pred kept n_words n_removed id doc fp rep bucket kind size taken target slot shard source_size h rn node component label v ids n_tokens window n media".split()


def documents(spark, table=None):
    df = spark.createDataFrame(rows() if table is None else table, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})
