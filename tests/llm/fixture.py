"""Small documents with every awkward case, for all operators."""

from __future__ import annotations

import random

PASSAGE = "the quick brown fox jumps over the lazy dog and runs away from the old mill by the river"
LINE = "Subscribe to our newsletter!"


def rows() -> list[tuple]:
    r = random.Random(3)
    syllables = "an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    out: list[tuple] = [(k, text(r.randrange(5, 150)) + "\n" + (LINE if k % 3 else " " + LINE.lower() + "\t") + "\n" + text(20), "en") for k in range(40)]
    base = text(200)
    out += [(40 + k, base, "en") for k in range(15)]  # exact copies
    out += [(60 + k, base + f" {word()}.", "en") for k in range(6)]  # near copies
    out += [(70, text(30) + " " + PASSAGE + ". " + text(30), "en"), (71, PASSAGE.upper(), "en"), (72, "Short item.", "en")]
    out += [(80, None, "en"), (81, "", None), (82, " \n\t ", "en"), (83, "12345 678 !!", "en"), (84, "Ça été ñandú 日本語 text  wide", "es")]
    out += [(85, text(6000), "en"), (86, "a" * 3000, "en"), (87, "tie tie tie tie tie tie tie", "en"), (88, "<|endoftext|> don't 's it'll  we\n\nre", "en")]
    out += [(5, out[5][1], "en"), (6, "another text with the same id, long enough to have some words of its own", "en"), (None, base, "en"), (None, None, None)]
    return out


def documents(spark, clash: bool = False):
    """clash: with columns named as those that operators add."""
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string").repartition(3)
    if clash:
        from pyspark.sql import functions as F

        for c in ("th", "fp", "keep", "n_words", "n_hit", "hits", "score", "lang_pred", "n_lines", "prefix", "component_id", "n_matches", "label", "start", "length"):
            df = df.withColumn(c, F.lit(c))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


BENCHMARK = [(1, PASSAGE), (2, "Short item"), (3, None), (4, ""), (7, "short ITEM!"), (None, "quick brown fox"), (9, "nothing of this is anywhere at all in any of these documents")]


def benchmark(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


def key(x):
    return tuple((v is not None, v) for v in x)
