"""A small documents table with the awkward cases: nulls, empty and very long texts, repeats, columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, size string, row string, n string, gid string, hit string, label string, term string"


def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    texts = []
    for i, b in enumerate(base):
        w = b.split()
        texts += [b, b.upper(), " ".join([*w[:30], "changed", *w[31:]])]
        if i % 3 == 0:
            texts.append(" ".join(w[:55]) + " tail of some new words")
    texts += [None, "", " \t\n", "one", "One", "two words", "the same four words", "The Same four words", "a b c d e", "é É", "ß \U0001f600 ☃", "x" * 5000, "long text " * 20000]
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, [None, "en", "de"][i % 3], [None, "src1", "src2", "src2", "src2"][i % 5], None if t is None else len(t), 0.5, "k", "s", "r", "n", "g", "h", "l", "t"))
    out.append(out[0])  # a repeated row
    out.append((None, base[1], "en", None, 1, 0.1, "k", "s", "r", "n", "g", "h", "l", "t"))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
