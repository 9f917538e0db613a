"""Small tables and plain reference forms for the tests of the training-data operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as further columns of the input.
CLASHING = ["score", "predicted", "shard", "slot", "line", "node", "pos", "component", "text_key", "n_lines", "n_removed", "_id", "_key", "key", "y", "n"]


def documents(spark, texts, ids=None, clashing=False):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame([(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(c) for c in CLASHING})
    return df


def letters(number):
    """A number as letters: some operators see nothing else."""
    return "".join("abcdefghij"[int(d)] for d in str(number))


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{letters(rng.randrange(vocabulary))}" for _ in range(n)]


def edited(words, seed, k):
    rng = random.Random(seed)
    out = list(words)
    for i in rng.sample(range(len(out)), k):
        out[i] = f"x{letters(seed)}y{letters(i)}"
    return out


def odd_texts():
    long = " ".join(prose(99, 30_000))
    return [None, "", "   \n\t ", "one", "one two", "Ünï çödé – 字 字 字", "same same same same same same same", long, long, "a\x00b c", " x y"]


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
