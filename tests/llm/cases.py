"""Rows that every operator has to take, and plain readings of the texts."""

import random
import re

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def twins():
    """Two different words of 1024 letters whose polynomial hashes modulo 2^64 are equal for any odd base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def rows():
    """Words that hash alike, nulls in any column, empty, blank and very long texts, exact and near copies, ties and repeated rows."""
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma,", "délta", "ε", "zeta.", "eta", "theta"]) + str(rng.randrange(40)) for _ in range(n))
    base, passage, long = say(120), say(70), say(30_000)
    near = base.split(" ")
    near[3] = "changed"
    texts = [None, "", " \t\n", "one", "One two three four", base, base, " ".join(near), base + " end", f"{say(40)} {passage} {say(40)}", f"{say(30)}\n{passage}\n{say(20)}", passage, long, f"{long} tail", "a b " * 400, "<|im_end|> x", "😀 ü ß " * 30, say(50), say(49), "\n".join([say(12)] * 5)]
    a, b = twins()
    lead, rest = say(40), say(40)
    texts += [a, b, f"{lead} {a} {rest}", f"{lead} {b} {rest}", f"{a}\n{b}\n{a}"]
    out = [(i, t, [None, "de", "en", "xx"][i % 4], None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[5], out[1], (9, say(60), "en", "s0", 1), (None, base, None, None, None), (None, None, None, None, None), (-7, passage, "en", None, 5)]


def docs(spark, parts=3):
    return spark.createDataFrame(rows(), DOCS).repartition(parts)


def clashing(frame):
    """The same rows with columns named like those that operators use."""
    for c in ("row", "Keep", "tx", "sketch", "_score", "is_null", "found", "spans", "component_id", "score"):
        frame = frame.withColumn(c, F.lit(1))
    return frame


def nothing(spark):
    return spark.createDataFrame([], DOCS)
