"""Label and transcript text: normalising, stems, tests and verdict parts, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import BUILT_IN
from ..sources.stored import stored

#: The 81 characters that labels may hold.
ALPHABET = "` ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789'-\"/,.+_!#&():;?*"


def normalised(text: Column) -> Column:
    """TXT-2: lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def clean_label(text: Column) -> Column:
    """TXT-7: typographic quotes, dashes and ellipsis in ASCII, outer blanks off."""
    return F.trim(F.replace(F.translate(text, "’‘“”–—", "''\"\"--"), F.lit("…"), F.lit("...")))


def stem(text: Column) -> Column:
    """TXT-8: lower case without . , ; : ! ? ' " at either end, possessive 's off."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\A[.,;:!?'\"]+|[.,;:!?'\"]+\z", ""), r"'s\z", "")


def is_number(text: Column) -> Column:
    """FLT-6."""
    return text.rlike(r"\A[0-9]+([./-][0-9]+)*\z")


def is_initialism(text: Column) -> Column:
    """FLT-7: two to four characters once outer dots are off, all or all but one (two at least) capitals."""
    bare = F.regexp_replace(text, r"\A\.+|\.+\z", "")
    return (F.length(bare) > 1) & (F.length(bare) <= 4) & (F.regexp_count(bare, F.lit(r"\p{Lu}")) >= F.greatest(F.lit(2), F.length(bare) - 1))


def offending(text: Column, alphabet: str = ALPHABET) -> Column:
    """FLT-8: the distinct characters outside the alphabet, sorted, as one string. What the alphabet holds goes first, run by run,
    so that only a text's other characters become an array."""
    known = "[" + "".join(c if c.isalnum() else f"\\{c}" for c in alphabet) + "]+"
    others = F.split(F.regexp_replace(text, known, ""), "")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(others, lambda c: c != ""))), "")


def vocabulary(benchmark: DataFrame) -> DataFrame:
    """SET-1: the distinct stems of a word source, with the built-in words."""
    words = benchmark.select(F.explode(F.split("text", r"[ \n]")).alias("t")).select(stem(F.col("t")).alias("word")).where("word rlike '^[a-z]+$'")
    return words.union(benchmark.sparkSession.createDataFrame([(w,) for w in BUILT_IN], "word string")).distinct()


def alphabet_table(spark: SparkSession, source: str, name: str) -> DataFrame:
    """TXT-22: ch, idx of the alphabet that a source text holds as a literal after 'name':, its escapes decoded. At most a few
    hundred characters of program text, hence read here."""
    found = re.search(rf"'{re.escape(name)}':\s*'((?:[^'\\]|\\.)*)'", source)
    letters = re.sub(r"\\u([0-9a-fA-F]{4})|\\(.)", lambda m: chr(int(m[1], 16)) if m[1] else {"n": "\n", "t": "\t"}.get(m[2], m[2]), found[1]) if found else ""
    return spark.createDataFrame([(c, i) for i, c in enumerate(letters)], "ch string, idx long")


def document_frequency(tok: DataFrame, vocab: DataFrame) -> DataFrame:
    """AGG-1: occurrences of words, outer punctuation off, that pass the letter gate and are real: in the vocabulary or an inflection
    of a word there. Words are counted first, so that each is judged once."""
    core = F.regexp_replace(F.lower(F.trim("tok")), r"\A[.,;:!?'\"]+|[.,;:!?'\"]+\z", "")
    counts = tok.select(core.alias("word")).where(r"word rlike '\\A[a-z][a-z\'-]+\\z'").groupBy("word").agg(F.count("*").alias("n"))
    counts = stored(counts)  # judged and counted from one pass
    return counts.join(inflected(counts, vocab).where("known"), "word", "left_semi")


def inflected(stems: DataFrame, vocab: DataFrame) -> DataFrame:
    """TXT-9: word and whether it, or a base form of it, is in the vocabulary."""
    w, n = F.col("word"), F.length("word")

    def off(k: int) -> Column:
        return F.expr(f"substring(word, 1, length(word) - {k})")

    forms = [w, F.when(w.endswith("ies") & (n > 5), F.concat(off(3), F.lit("y"))), F.when(w.endswith("es") & (n > 4), off(2)), F.when(w.endswith("s") & (n > 3), off(1))]
    for end in ("ed", "ing", "ly", "er", "est"):
        base = off(len(end))
        ok = w.endswith(end) & (F.length(base) >= 3)
        forms += [F.when(ok, base), F.when(ok, F.concat(base, F.lit("e"))), F.when(ok & base.endswith("i"), F.concat(F.expr(f"substring(word, 1, length(word) - {len(end) + 1})"), F.lit("y"))), F.when(ok & (F.expr(f"substring(word, length(word) - {len(end)}, 1)") == F.expr(f"substring(word, length(word) - {len(end) + 1}, 1)")), F.expr(f"substring(word, 1, length(word) - {len(end) + 1})"))]
    tried = stems.select("word").distinct().select("word", F.explode(F.array_compact(F.array_distinct(F.array(*forms)))).alias("form"))
    known = tried.join(vocab.select(F.col("word").alias("form")), "form", "left_semi").select("word").distinct()
    return stems.select("word").distinct().join(known.withColumn("known", F.lit(True)), "word", "left").select("word", F.coalesce("known", F.lit(False)).alias("known"))


def near_by_deletion(words: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """Distinct (word, candidate), unequal, that share a form with up to k letters deleted of each: all pairs within k edits
    (swaps of neighbours included for k = 1) and some beyond, by an equi-join on forms."""

    def cuts(form: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(form), F.lit(1))), lambda i: F.concat(F.substr(form, F.lit(1), i - 1), F.substr(form, i + 1)))

    def formed(df: DataFrame, name: str) -> DataFrame:
        df = df.select("word").distinct().withColumn("forms", F.array("word"))
        for _ in range(k):
            df = df.withColumn("forms", F.array_distinct(F.concat("forms", F.flatten(F.transform("forms", cuts)))))
        return df.select(F.col("word").alias(name), F.explode("forms").alias("form"))

    # written, so that Spark knows its size: a small vocabulary is broadcast, a large one is not
    forms = stored(formed(vocab, "candidate"))
    lengths = vocab.select(F.explode(F.sequence(F.length("word") - k, F.length("word") + k)).alias("n")).distinct()
    near = words.select("word").distinct().withColumn("n", F.length("word")).join(lengths, "n", "left_semi")
    return formed(near, "word").join(forms, "form").where("word <> candidate").select("word", "candidate").distinct()


def one_edit(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """JON-12: (word, candidate) one edit apart: delete, insert, replace, swap of neighbours."""
    a, b, n = F.col("word"), F.col("candidate"), F.length("word")
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1, F.lit(1)), F.substr("word", i, F.lit(1)), F.substr("word", i + 2)) == b)
    return near_by_deletion(words, vocab, 1).where((F.levenshtein(a, b) == 1) | ((n == F.length(b)) & (n > 1) & swapped))
