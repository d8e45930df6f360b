"""Quality rules by distribution divergence, in native DataFrame functions only.

Every text gets the counts of a few base rules, a histogram of character classes
and one of the common words of its language: four languages have a fixed list, any
other (and none) has the words that its own rows use most.  The sums of these histograms over
all documents of a language are its references.  A document whose Jensen-Shannon
distance to its language's reference is too large is not kept; guards on length
leave short texts, whose histograms are noise, to the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import folder, save

# Common words of each language.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "on", "by"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
}
#: Common words of every language.
MOST_WORDS = 16

MAX_CLASS_DISTANCE, MIN_CHARS = 0.29, 300
MAX_WORD_DISTANCE, MIN_WORDS = 0.275, 100
#: Reference rows and word lists (one for each language, under 2 KB with words of usual length) are broadcast up to this many.
BROADCAST_LANGUAGES = 10_000
_SPACE = r"\x20\x09-\x0D"


def _split(text: Column) -> Column:
    return F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != "")


def learned_words(docs: DataFrame) -> DataFrame:
    """(of, learned): the most frequent words of every language without a fixed list, by count and then code point.

    Words are counted with partial sums, and ranked within partial limits, so that no task sees all words of a language.
    """
    other = docs.select(F.col("lang").cast("string").alias("of"), F.col("text").cast("string").alias("text")).where(~F.coalesce(F.col("of").isin(list(COMMON_WORDS)), F.lit(False)) & F.col("text").isNotNull())
    counts = other.select("of", F.explode(_split(F.col("text"))).alias("w")).groupBy("of", "w").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("of").orderBy(F.desc("n"), "w"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= MOST_WORDS)
    return top.groupBy("of").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "w"))), lambda x: x["w"]).alias("learned"))


def _words_of(lang: Column, learned: Column) -> Column:
    padded = lambda words: F.concat(words, F.array_repeat(F.lit(""), F.lit(MOST_WORDS) - F.size(words)))
    out = padded(F.coalesce(learned, F.array().cast("array<string>")))
    for code, words in COMMON_WORDS.items():
        out = F.when(lang == code, F.array(*[F.lit(w) for w in words])).otherwise(out)
    return out


def features(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts and the two histograms of each row of ``docs(doc_id, text, lang)``; ``learned`` as from ``learned_words``."""
    fixed = sorted({w for words in COMMON_WORDS.values() for w in words})
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t0"), F.col("lang").cast("string").alias("lang"))
    t = t.join(learned, F.col("lang").eqNullSafe(F.col("of")), "left")
    t = t.withColumn("t1", F.regexp_replace("t0", r"\p{Ll}+", ""))
    t = t.withColumn("t2", F.regexp_replace("t1", f"[{_SPACE}]+", ""))
    t = t.withColumn("t3", F.regexp_replace("t2", r"\p{Lu}+", ""))
    t = t.withColumn("t4", F.regexp_replace("t3", r"\p{Nd}+", ""))
    t = t.withColumn("t5", F.regexp_replace("t4", r"""[.,;:?'"()\-]+""", ""))
    size = [F.length(f"t{i}").cast("long") for i in range(6)]
    t = t.select(
        "doc_id",
        "lang",
        "learned",
        _split(F.col("t0")).alias("w"),
        F.filter(F.split("t0", "\n"), lambda x: x.rlike(f"[^{_SPACE}]")).alias("lines"),
        (size[0] - size[1] + size[2]).alias("word_chars"),
        (F.length("t5") - F.length(F.regexp_replace("t5", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.array(*[size[i] - size[i + 1] for i in range(5)], size[5]).alias("classes"),
    )
    h = F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(5)]))
    t = t.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 5, h).otherwise(F.array().cast("array<bigint>")).alias("h"),
        F.when(F.col("learned").isNull(), F.filter("w", lambda w: w.isin(fixed))).otherwise(F.filter("w", lambda w: F.array_contains("learned", w))).alias("c"),
        _words_of(F.col("lang"), F.col("learned")).alias("list"),
    ).drop("w", "lines", "learned")
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    t = t.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs))
    twice = F.filter("s", lambda s, k: F.coalesce(s["x"] == F.get("s", k - 1)["x"], F.lit(False)) | F.coalesce(s["x"] == F.get("s", k + 1)["x"], F.lit(False)))
    t = t.withColumn("p", F.sort_array(F.transform(twice, lambda s: s["i"])))
    covered = F.aggregate(F.transform("p", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("p", k + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    counts = F.transform("list", lambda c: F.size(F.filter("c", lambda w: w == c)).cast("long"))
    return t.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "classes", counts.alias("common"))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: c.cast("double") / F.nullif(total, F.lit(0)))


def js_distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of shares."""
    part = lambda a, b: F.when(a > 0, a * F.log2(a * F.lit(2.0) / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / F.lit(2.0))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _with_rest(t: DataFrame) -> DataFrame:
    """The common words' histogram gets a last bin for all other words."""
    known = F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    return t.withColumn("common", F.concat("common", F.array(F.col("n_words") - known)))


def judge(docs: DataFrame, max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """Base counts and verdict for every row of ``docs(doc_id, text, lang)``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, class_distance, word_distance.

    A null text counts as empty: no words, so base_failed.  A null lang, as any
    language, is compared with the reference of its own rows.  A distance is null
    below its guard (``min_chars`` characters, ``min_words`` words), and then has no
    say; a distance at its limit keeps.  Texts of any length are read as a whole.  Repeated rows are judged alike.  Other columns are ignored; an empty
    table gives an empty result.
    """
    where = folder(docs.sparkSession)
    learned = save(learned_words(docs), where, "words")
    if learned.count() <= BROADCAST_LANGUAGES:
        learned = F.broadcast(learned)
    known = save(_with_rest(features(docs, learned)), where, "features")
    sums = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(n)])
    totals = known.groupBy("lang").agg(sums("classes", 6).alias("rc"), sums("common", 17).alias("rw"))
    plus = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    refs = save(totals.select(F.col("lang").alias("ref_lang"), _shares(F.col("rc"), plus("rc")).alias("rc"), _shares(F.col("rw"), plus("rw")).alias("rw")), where, "references")
    if refs.count() <= BROADCAST_LANGUAGES:
        refs = F.broadcast(refs)
    t = known.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")))
    chars = plus("classes")
    t = t.withColumns({"p": _shares(F.col("classes"), chars), "q": _shares(F.col("common"), F.col("n_words")), "chars": chars})
    t = t.withColumn("class_distance", F.when(F.col("chars") >= min_chars, js_distance("p", "rc")))
    t = t.withColumn("word_distance", F.when(F.col("n_words") >= min_words, js_distance("q", "rw")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    good = (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= max_class_distance) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= max_word_distance)
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & good).alias("kept"), "class_distance", "word_distance")
