"""Quality rules: divergence of a document from its language's distributions.

Everything runs as DataFrame expressions. One pass over the texts makes a row
of counts for each document; the references are the sums of those counts for
each language over all documents; a second, narrow pass compares.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WS, let, materialize, whole_text

#: Common words by language, each a bin of the word histogram.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "ist", "im", "mit", "für"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "dans", "que", "pour"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"],
}
#: Character classes that are counted with a pattern; letters and the rest are what remains.
CLASSES = {"upper": r"[\p{Lu}]+", "digit": r"[0-9]+", "punct": r"[.,;:!?'\"()\-]+", "symbol": r"[#*$%&|<>]+"}
WINDOW = 5


def _removed(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of ``window`` words that the text has twice or more."""

    def hashed(h: Column) -> Column:
        n = F.size(h) - (window - 1)
        return F.when(
            n < 2, F.array().cast("array<bigint>")
        ).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])))

    def positions(s: Column) -> Column:
        same = lambda e, k: (F.get(s, k - 1)["w"] == e["w"]) | (F.get(s, k + 1)["w"] == e["w"])
        return F.sort_array(F.transform(F.filter(s, lambda e, k: F.coalesce(same(e, k), F.lit(False))), lambda e: e["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda v, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - v, F.lit(window))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(let(pairs, positions), covered))

    return let(let(F.transform(words, lambda x: F.xxhash64(x)), hashed), counted)


def features(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add the base counts, ``char_hist`` and ``word_hist`` to each document.

    Null texts count as empty. ``word_hist`` is empty where the language has
    no list of common words.
    """
    # A frame of a table that lacks the language has one reference for all.
    language = F.coalesce(F.col(lang), F.lit("")) if lang in docs.columns else F.lit("")
    t = whole_text(text)
    vocab = F.array().cast("array<string>")
    for name, words in COMMON_WORDS.items():
        vocab = F.when(language == name, F.array(*map(F.lit, words))).otherwise(vocab)
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})

    def word_hist(pair: Column) -> Column:
        own = F.filter(pair["words"], lambda w: w.isin(every))
        return let(
            F.struct(own.alias("own"), vocab.alias("vocab")),
            lambda p: let(
                F.transform(p["vocab"], lambda v: F.size(F.filter(p["own"], lambda w: w == v)).cast("long")),
                lambda h: F.when(F.size(h) == 0, h).otherwise(F.concat(h, F.array(F.size(pair["words"]).cast("long") - F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x)))),
            ),
        )

    lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))
    counts = docs.select(
        "*",
        language.alias("_lang"),
        F.array_remove(F.split(t, WS), "").alias("_words"),
        F.length(F.regexp_replace(t, WS, "")).cast("long").alias("word_chars"),
        F.length(t).cast("long").alias("_chars"),
        *[_removed(t, p).alias(f"_{c}") for c, p in CLASSES.items()],
        lines.alias("n_dup_lines"),
    )
    rest = F.col("word_chars") - F.col("_upper") - F.col("_digit") - F.col("_punct") - F.col("_symbol")
    return counts.select(
        *docs.columns,
        "_lang",
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        F.col("_symbol").alias("n_symbols"),
        "n_dup_lines",
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.array(rest, F.col("_upper"), F.col("_digit"), F.col("_punct"), F.col("_symbol"), F.col("_chars") - F.col("word_chars")).alias("char_hist"),
        let(F.struct(F.col("_words").alias("words")), word_hist).alias("word_hist"),
    )


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts; 0 where either is empty."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def entropy(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / ((p + q) / 2))).otherwise(0.0)

    def divergence(v: Column) -> Column:
        each = F.zip_with(v["a"], v["b"], lambda x, y: entropy(x / v["na"], y / v["nb"]) + entropy(y / v["nb"], x / v["na"]))
        return F.when((v["na"] > 0) & (v["nb"] > 0), F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))).otherwise(0.0)

    x, y = F.transform(a, lambda v: v.cast("double")), F.transform(b, lambda v: v.cast("double"))
    return let(F.struct(x.alias("a"), y.alias("b")), lambda p: let(F.struct(p["a"].alias("a"), p["b"].alias("b"), total(p["a"]).alias("na"), total(p["b"]).alias("nb")), divergence))


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_char_distance: float = 0.22,
    max_word_distance: float = 0.27,
    min_words: int = 50,
    min_reference_words: int = 2000,
) -> DataFrame:
    """Judge each document by its distance from its language's distributions.

    Returns the columns of ``docs`` without the text, and ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``char_distance``, ``word_distance``, ``base_failed`` and ``kept``.

    The references are counted over all of ``docs``. A document of fewer than
    ``min_words`` words, or whose language has fewer than
    ``min_reference_words``, is too short to compare and isn't rejected for its
    distances (``base_failed`` still rejects). Null and empty texts have no
    words and so fail the base rule. A null language is a language of its own.
    Repeated rows are judged alike, each with a row. An empty table gives no rows.
    Texts of any length count whole. Columns of the input called like those
    above are replaced; all others are kept, whatever their names.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept"]
    keep = [c for c in docs.columns if c not in made and c != text]
    # The row is one column beside those made here, so that no name of it can clash.
    language = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.struct(*keep, F.lit(0).alias("no column")).alias("row"), F.col(text).alias("text"), language.alias("lang"))
    per_doc = materialize(features(rows).drop("text", "lang"))
    n_bins = max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.sum(F.get("char_hist", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 2)] + [F.sum(F.get("word_hist", F.lit(i))).alias(f"w{i}") for i in range(n_bins)]
    named = per_doc.groupBy("_lang").agg(F.sum("n_words").alias("_ref_words"), *sums)
    refs = named.select(
        "_lang",
        "_ref_words",
        F.array(*[f"c{i}" for i in range(len(CLASSES) + 2)]).alias("_ref_char"),
        F.array(*[f"w{i}" for i in range(n_bins)]).alias("_ref_word"),
    )
    judged = per_doc.join(refs, "_lang").select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_ref_words",
        js_distance(F.col("char_hist"), F.col("_ref_char")).alias("char_distance"),
        F.when(F.size("word_hist") == 0, F.lit(0.0)).otherwise(js_distance(F.col("word_hist"), F.col("_ref_word"))).alias("word_distance"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )
    comparable = (F.col("n_words") >= min_words) & (F.col("_ref_words") >= min_reference_words)
    far = (F.col("char_distance") > max_char_distance) | (F.col("word_distance") > max_word_distance)
    judged = judged.withColumn("kept", ~F.col("base_failed") & ~(comparable & far))
    return judged.select(*[F.col("row")[c].alias(c) for c in keep], *made)
