"""Small document tables with everything that has gone wrong somewhere."""

import random

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(6000))
PASSAGE = " ".join(f"shared{i}" for i in range(70))


def texts(seed: int = 0) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) rows: nulls, empties, copies, near copies, repeats, ties, odd characters."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "Und", "été", "x", "#$", "lorem", "　ipsum", "a|b"]) + str(rng.randrange(40))
    line = lambda n: " ".join(word() for _ in range(n))
    base = [line(rng.randrange(3, 14)) for _ in range(14)]
    out = ["\n".join(rng.choice(base) for _ in range(rng.randrange(1, 9))) for _ in range(20)]
    body = line(160)
    out += [body, body, body.replace("the", "THE", 1), body + " tail", "head " + body, line(30) + " " + PASSAGE + " " + line(30), PASSAGE, PASSAGE + " " + line(5)]
    out += ["", " \n\t ", "one", "a b c d", "\n\n", LONG, LONG + " end", "Der " * 120, "Der " * 300, "é" * 400, "  Leading and trailing words here  \n  LEADING and trailing WORDS here"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", None]), len(t)) for i, t in enumerate(out)]
    rows += [(90, None, None, None, None), (None, body, "en", None, 1), (None, None, None, None, None), (91, body, "en", "s0", 5), (91, body, "en", "s0", 5), (91, PASSAGE, "de", "s1", 6)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None, extra=True):
    """The rows as a table, with further columns named like those the operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(texts() if rows is None else rows, SCHEMA)
    names = ["doc", "d", "t", "th", "row", "pos", "line", "h1", "keep", "kept", "first", "n_words", "h", "words", "path", "id", "marks", "z"]
    return df.select("*", *(F.lit(7).alias(n) for n in names)) if extra else df


def key(row):
    return tuple((x is None, str(x)) for x in row)
