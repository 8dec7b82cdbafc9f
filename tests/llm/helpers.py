import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators make themselves.
CLASHING = ["n_words", "kept", "priority", "log_weight", "n_grams", "taken", "key", "bands", "token_ids", "decoded", "n_removed", "h1", "site", "line", "k", "base", "tokens", "_words", "_lang", "rank", "_n", "_k1", "id", "k1", "k2", "gone", "_gone", "_noise", "_scored", "_rank", "times", "rows", "_id", "_doc", "_source", "_key", "_text", "row", "at", "first", "size", "start", "end", "span", "found", "passed", "words", "row_id"]


def words(text):
    return WORD.findall(text or "")


def make(spark, rows, clash=False):
    """Documents of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING]) if clash else df


def prose(rnd, n, vocabulary=400):
    return " ".join(f"{'aeiou'[rnd.randrange(5)]}w{rnd.randrange(vocabulary)}" for _ in range(n))


def odd_rows(rnd):
    """Nulls, empty and long texts, ties and repeated rows."""
    same = prose(rnd, 60)
    return [(1, None, None, None), (2, "", "en", ""), (3, " \n\t ", "en", "a"), (4, same, "en", "a"), (4, same, "en", "a"), (5, same, "de", "b"), (None, same, "en", "a"), (None, None, "en", "a"), (6, "one two", "en", "é"), (7, prose(rnd, 20_000), "en", "a"), (8, "x" * 30_000, "xx", "c"), (9, "naïve 😀 日本語 text", "en", "a")]


def pairs(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))
