"""Quality rules by distribution divergence, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.plans.session import cut_lineage

# Frequent words of the reference languages, most frequent first
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "as", "with", "be", "this", "from"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para"),
}
#: Languages whose references are broadcast; more are joined.
BROADCAST_ROWS = 10_000
#: Limits of the divergence (0 to 1) from the language's reference, and the fewest words at which it counts.
CHAR_LIMIT = 0.06
WORD_LIMIT = 0.06
CHAR_GUARD = 50
WORD_GUARD = 100

#: fixed values of the contract
SPACE = r"[ \t\n\x0B\f\r]+"
SYMBOLS = r"[#*$%&|<>]+"
MIN_WORDS = 50
REPEAT_PERCENT = 50

#: Character classes that are taken out one after the other; what is left is a class of its own.
CLASSES = (("c_lower", "[a-z]+"), ("c_upper", "[A-Z]+"), ("c_mark", r"[.,;:!?'\"()\-]+"), ("c_symbol", SYMBOLS), ("c_digit", "[0-9]+"))
BINS = (*(n for n, _ in CLASSES), "c_other")


def with_counts(rows: DataFrame) -> DataFrame:
    """rows (id, t, lang) with the base counts of each text; each step is a column that the next one reads."""
    one = rows.withColumn("words", F.array_remove(F.split(F.coalesce("t", F.lit("")), SPACE), ""))
    two = one.select("id", "lang", "words", F.array_join("words", "").alias("solid"), F.expr("filter(split(coalesce(t, ''), '\n'), x -> x rlike '[^ \\t\\n\\x0B\\f\\r]')").alias("lines"))
    three = two.select("*", F.size("words").cast("long").alias("n_words"), F.length("solid").cast("long").alias("word_chars"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")).drop("lines")
    return _with_repeats(_with_classes(three))


def _with_classes(rows: DataFrame) -> DataFrame:
    """Characters of each class; the classes are taken out one by one, so that the later patterns meet short rests only."""
    rest = "solid"
    for name, pattern in CLASSES:
        rows = rows.withColumn(f"without_{name}", F.regexp_replace(rest, pattern, ""))
        rows = rows.withColumn(name, (F.length(rest) - F.length(f"without_{name}")).cast("long")).drop(rest)
        rest = f"without_{name}"
    return rows.withColumn("c_other", F.length(rest).cast("long")).drop(rest).withColumn("n_symbols", F.col("c_symbol"))


def _with_repeats(rows: DataFrame) -> DataFrame:
    """n_repeat_words: words in runs of three that occur twice or more in the text.

    Runs are 64-bit hashes. Texts whose runs are all different need no more; in others hashes are sorted with their places in
    the low bits (as many as the text's length needs), so that equal runs stand side by side. Neighbours that agree in the bits
    left are compared by their words, so runs that only share a hash are no repeats. The places of the repeated ones and of the
    two words after them are counted once.
    """
    hashed = rows.withColumn("hw", F.expr("transform(words, x -> xxhash64(x))"))
    runs = hashed.withColumn("runs", F.expr("if(n_words < 3, array(), transform(slice(hw, 1, greatest(0, cast(n_words as int) - 2)), (x, i) -> xxhash64(x, hw[i + 1], hw[i + 2])))")).drop("hw")
    some = runs.withColumn("again", F.expr("size(runs) > size(array_distinct(runs))")).withColumn("low", F.expr("shiftleft(1L, cast(ceil(log2(n_words + 2)) as int)) - 1"))
    keyed = some.withColumn("keyed", F.expr("if(again, sort_array(transform(runs, (x, i) -> (x & ~low) | cast(i as long))), cast(array() as array<bigint>))")).drop("runs")

    def same(other: str) -> str:
        word = "get(words, cast(({x} & low) as int) + {k})".format
        return f"((x & ~low) <=> ({other} & ~low) and " + " and ".join(f"{word(x='x', k=k)} <=> {word(x=other, k=k)}" for k in range(3)) + ")"

    found = keyed.withColumn("found", F.expr(f"transform(filter(keyed, (x, i) -> {same('get(keyed, i + 1)')} or {same('get(keyed, i - 1)')}), x -> x & low)")).drop("keyed", "again", "low")
    return found.withColumn("n_repeat_words", F.expr("cast(size(array_distinct(concat(found, transform(found, x -> x + 1), transform(found, x -> x + 2)))) as bigint)")).drop("found")


def _jensen_shannon(rows: DataFrame, own: Sequence[str], reference: Sequence[str], name: str) -> DataFrame:
    """rows with the divergence, to the base 2, of two lists of count columns; null if one of them is empty."""
    rows = rows.withColumn("p", F.array(*own)).withColumn("q", F.array(*reference))
    for x in "pq":
        rows = rows.withColumn(f"n_{x}", F.expr(f"cast(aggregate({x}, 0L, (a, b) -> a + b) as double)")).withColumn(x, F.expr(f"transform({x}, a -> a / nullif(n_{x}, 0D))"))
    parts = "zip_with(p, q, (x, y) -> (if(x > 0, x * log2(2 * x / (x + y)), 0D) + if(y > 0, y * log2(2 * y / (x + y)), 0D)) / 2)"
    return rows.withColumn(name, F.expr(f"if(n_p > 0 and n_q > 0, round(greatest(aggregate({parts}, 0D, (a, b) -> a + b), 0D), 6), null)")).drop("p", "q", "n_p", "n_q")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common_words: Mapping[str, Sequence[str]] = COMMON_WORDS,
                  char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, char_guard: int = CHAR_GUARD, word_guard: int = WORD_GUARD) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_chars, js_words, kept.

    Base rules: fewer than 50 words, or over half of them in repeated runs of three, fail. Of the others a text is kept if the
    Jensen-Shannon divergence (base 2) of its characters' classes from those of all texts in its language is at most char_limit,
    and that of its counts of the language's common words (and all other words) at most word_limit. A text with fewer words than a
    guard says too little for that divergence and is not judged by it. References are sums over all documents of a language; the
    rows of that table are as many as languages, and common words as many as the parameter names.

    Null and empty texts have no words and fail the base rules. Documents with null lang share one reference of characters; they
    and languages without common words are not judged by words. Null doc_ids and repeated rows are rows like others; columns other
    than the three named ones are not looked at; an empty table gives no rows.
    """
    size = max(map(len, common_words.values()), default=0)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"))
    counted = with_counts(rows)
    known = sorted({w for x in common_words.values() for w in x})
    common, listed = F.expr("cast(array() as array<string>)"), F.expr("cast(null as array<string>)")
    if known:
        common = F.filter("words", lambda x: x.isin(known))
    for name, words in common_words.items():
        listed = F.when(F.col("lang") == name, F.array(*map(F.lit, words))).otherwise(listed)
    counted = counted.withColumn("common", common).withColumn("listed", listed)
    bins = [f"w_{k}" for k in range(size)]
    counted = counted.select("*", *[F.when(F.col("listed").isNotNull(), F.coalesce(F.size("common") - F.size(F.array_remove("common", F.get("listed", F.lit(k)))), F.lit(0))).cast("long").alias(n) for k, n in enumerate(bins)])
    rest = F.col("n_words")
    for n in bins:
        rest = rest - F.col(n)
    columns = ["id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *BINS, *bins]
    counted = cut_lineage(counted.select(*columns, rest.alias("w_rest")))
    bins.append("w_rest")
    reference = cut_lineage(counted.groupBy(F.col("lang").alias("of")).agg(*[F.sum(n).alias(f"r_{n}") for n in (*BINS, *bins)]))
    # one row for each language; a column with very many values is joined by shuffling
    reference = F.broadcast(reference) if reference.count() <= BROADCAST_ROWS else reference
    judged = counted.join(reference, F.col("lang").eqNullSafe(F.col("of")))
    judged = _jensen_shannon(judged, BINS, [f"r_{n}" for n in BINS], "js_chars")
    judged = _jensen_shannon(judged, bins, [f"r_{n}" for n in bins], "js_words")
    judged = judged.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    fits = F.coalesce((F.col("n_words") < char_guard) | (F.col("js_chars") <= char_limit), F.lit(True)) & F.coalesce((F.col("n_words") < word_guard) | (F.col("js_words") <= word_limit), F.lit(True))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fits).alias("kept"), "js_chars", "js_words")


def op3_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
