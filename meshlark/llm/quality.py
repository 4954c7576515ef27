"""Quality rules: base rules on words and lines, then the divergence of a document from its language.

Character-class and common-word histograms of a document are compared with the histograms of its language by
Jensen-Shannon distance (base 2, so between 0 and 1). The references are counted over all documents of the language that
pass the base rules and have few symbols. DataFrame functions only; no document is exploded, so nothing but one row a document is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.llm._common import SPACE, let, stored, words

#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in a is that for it as was with be by on are this from or an at",
    "der die und das ist nicht ein eine zu von mit den auf für dem im sich des auch als",
    "le la les de des un une et est que qui dans pour pas sur au avec par du ce il en",
    "el los las del una por con para su se lo como y no es más al este esta que",
)
#: Character classes, counted by what is left when all else is removed; the rest is a class of its own.
CLASSES = {"lower": r"[^\p{Ll}]+", "upper": r"[^\p{Lu}]+", "digit": r"[^\p{Nd}]+", "space": r"[^\x20\x09-\x0D]+", "symbol": r"[^#*$%&|<>!]+", "stop": r"[^.,;:?'\"()\-]+"}
WINDOW = 8
MIN_CHARS, MIN_WORDS = 200, 40
CHARS_FROM, WORDS_FROM = 0.22, 0.55
#: A document counts towards its language's reference if it has at least this many word characters for each symbol.
REFERENCE_SYMBOLS = 100


def repeated_window_words(w: Column, window: int = WINDOW) -> Column:
    """How many words of the array w lie in windows that w holds twice or more, first ones included.

    Windows are hashed from word hashes; hashes and places are sorted only where a hash repeats.
    """
    places = F.sequence(F.lit(0), F.size(w) - window)

    def marked(pairs: Column) -> Column:
        """Starts, in order, of windows whose hash occurs again; pairs: (hash, start), sorted."""
        same = lambda x, i: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(pairs, lambda x, i: same(x, i + 1) | F.when(i > 0, same(x, i - 1)).otherwise(False)), lambda x: x["at"]))

    def covered(starts: Column) -> Column:
        """Words under [start, start + window) for ordered starts."""
        steps = F.transform(starts, lambda at, i: F.least(F.coalesce(F.get(starts, i + 1) - at, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def of_hashes(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.array_sort(pairs), lambda p: let(marked(p), covered)))

    def of_words(wh: Column) -> Column:
        return let(F.transform(places, lambda i: F.xxhash64(*(F.get(wh, i + k) for k in range(window)))), of_hashes)

    return F.when(F.size(w) <= window, 0).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), of_words))


def base_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs), base_failed.

    A null text has no words and fails; so does an empty one. Ids, and rows that repeat, play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    rows = docs.withColumn("_words", words(text)).withColumn("_lines", lines)
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_window_words(F.col("_words")).cast("long"),
    }).drop("_words", "_lines")
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def histograms(text: Column) -> tuple[Column, Column]:
    """Counts of the character classes, and of the common words with all other words last."""
    text = F.coalesce(text, F.lit(""))
    counts = [F.length(F.regexp_replace(text, keep, "")) for keep in CLASSES.values()]
    classes = let(F.array(*counts), lambda c: F.concat(c, F.array(F.length(text) - F.aggregate(c, F.lit(0), lambda a, x: a + x))))
    common = list(dict.fromkeys(" ".join(COMMON_WORDS).split()))
    listed = F.array(*(F.lit(x) for x in common))
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: x != "")

    def counted(t: Column) -> Column:
        """Each common word of the text becomes one character, and what is left without that character gives its count."""
        hits = F.array_join(F.transform(F.filter(t, lambda x: x.isin(*common)), lambda x: F.char(F.array_position(listed, x) + F.lit(33))), "")
        counts = lambda h: [F.length(h) - F.length(F.replace(h, F.lit(chr(34 + k)), F.lit(""))) for k in range(len(common))]
        return let(hits, lambda h: F.array(*counts(h), F.size(t) - F.length(h)))

    return classes, let(tokens, counted)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null if either is empty."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    share = lambda c: let(total(c), lambda t: F.transform(c, lambda x: F.when(t > 0, x / t)))
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = lambda a, b: F.zip_with(a, b, lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2))
    value = let(share(p), lambda a: let(share(q), lambda b: F.when(F.get(a, F.lit(0)).isNotNull() & F.get(b, F.lit(0)).isNotNull(), total(terms(a, b)))))
    return let(value, lambda v: F.when(v.isNotNull(), F.sqrt(F.greatest(v / 2, F.lit(0.0)))))


def language_references(rows: DataFrame) -> DataFrame:
    """Per language: the summed histograms of the documents that pass the base rules and have few symbols. rows: _lang, classes, common, n_symbols, base_failed."""
    n, m = len(CLASSES) + 1, len(dict.fromkeys(" ".join(COMMON_WORDS).split())) + 1
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n)] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(m)]
    per = rows.where(~F.col("base_failed") & (REFERENCE_SYMBOLS * F.col("n_symbols") <= F.col("word_chars"))).groupBy("_lang").agg(*sums)
    return per.select("_lang", F.array(*(f"c{i}" for i in range(n))).alias("ref_classes"), F.array(*(f"w{i}" for i in range(m))).alias("ref_common"))


def judge(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: id_cols, the base features, base_failed, chars_distance, words_distance and kept.

    Short documents (MIN_CHARS, MIN_WORDS) are not judged by the respective histogram. A null language is a language of
    its own; where no document of a language passes the base rules, only those rules decide.
    """
    classes, common = histograms(F.col(text_col))
    rows = base_features(docs.select(*id_cols, F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"), F.col(text_col).alias("_text")), "_text")
    classes, common = histograms(F.col("_text"))
    rows = stored(rows.withColumn("classes", classes).withColumn("common", common).drop("_text"))
    out = rows.join(language_references(rows), "_lang", "left")
    chars = F.when(reduce(Column.__add__, [F.get("classes", F.lit(i)) for i in range(len(CLASSES) + 1)]) >= MIN_CHARS, js_distance(F.col("classes"), F.col("ref_classes")))
    out = out.withColumn("chars_distance", chars).withColumn("words_distance", F.when(F.col("n_words") >= MIN_WORDS, js_distance(F.col("common"), F.col("ref_common"))))
    bad = (F.coalesce(F.col("chars_distance"), F.lit(0.0)) > CHARS_FROM) | (F.coalesce(F.col("words_distance"), F.lit(0.0)) > WORDS_FROM)
    return out.withColumn("kept", ~F.col("base_failed") & ~bad).drop("_lang", "classes", "common", "ref_classes", "ref_common")


__all__ = ["base_features", "histograms", "js_distance", "judge", "language_references", "repeated_window_words", "SPACE"]
