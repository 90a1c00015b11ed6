"""Line-first quality rules: judge each line, remove failing lines, then reject documents that lose too much text.

DataFrame functions only; nothing is shuffled, every document is judged in its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD, whole_text

#: A line fails as navigation with two separators that are followed by text, as boilerplate with one of these phrases
#: (English, German, French, Spanish). Every repeat ends where the next part begins, so that long lines take linear time.
NAVIGATION = r"[|»›·•>]\s*[^\s|»›·•>]"
BOILERPLATE = r"(?i)(lorem ipsum|javascript|cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|sign (in|up)\b|log ?in\b|subscribe to|datenschutzerkl|nutzungsbedingungen|alle rechte vorbehalten|hier klicken|politique de confidentialit|tous droits r|cliquez ici|pol.tica de privacidad|todos los derechos reservados|haga clic)"
#: A line longer than this many words must hold sentence punctuation; one with this share of marks fails.
LEAST_WORDS, MARKS_SHARE = 12, 0.1


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the same array, the first occurrence included.

    Windows are told apart by 64-bit hashes within one document, sorted with their places: equal ones become
    neighbours, so the work is n log n for any repetition.
    """
    n = F.size(words)
    hashed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_covered(hashed))


def _covered(hashed: Column) -> Column:
    """Fold over windows sorted by (hash, place): keep the places of equal neighbours, then measure their union."""

    def places(s):
        last = F.size(s) - 1
        twin = F.filter(
            s,
            lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])),
        )
        return F.sort_array(F.transform(twin, lambda x: x["i"]))

    at = F.transform(F.array(F.sort_array(hashed)), places)[0]
    union = F.transform(F.array(at), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b))
    return union[0]


def line_fails(line: Column) -> Column:
    """Whether a line that has words breaks a line rule: navigation, boilerplate, mostly marks or capitals, or long without any sentence punctuation."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    marks = F.regexp_count(line, F.lit(r"[#*$%&|<>!]"))
    long_line = F.length(line) >= 6 * LEAST_WORDS
    return (
        (F.regexp_count(line, F.lit(NAVIGATION)) >= 2)
        | line.rlike(BOILERPLATE)
        | (marks > MARKS_SHARE * F.length(line))
        | (long_line & (capitals > 0.5 * letters))
        | (long_line & ~line.rlike(r"[.!?…。？！]"))
    )


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = 0.5) -> DataFrame:
    """One row per input row: id, base metrics, base_failed, lost_share (share of word characters on failing lines),
    kept, and cleaned (the text without failing lines).

    Null texts count as empty: all metrics 0, base_failed true. Repeated rows are judged alike. Other columns of the
    input don't matter.
    """
    df = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    df = df.withColumn("_words", F.filter(F.split("_text", GAP, -1), lambda w: w != ""))
    df = df.withColumn("_lines", F.split("_text", "\n", -1))
    df = df.withColumn("_full", F.filter("_lines", lambda x: x.rlike(WORD)))
    chars = F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    df = df.select(
        "_id",
        "_text",
        "_lines",
        F.size("_words").cast("long").alias("n_words"),
        chars.alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )
    df = df.withColumn("_good", F.filter("_lines", lambda x: ~(x.rlike(WORD) & line_fails(x))))
    left = F.aggregate("_good", F.lit(0).cast("long"), lambda a, x: a + F.length(F.regexp_replace(x, GAP, "")))
    df = df.withColumn("lost_share", F.when(F.col("word_chars") == 0, F.lit(0.0)).otherwise(1.0 - left / F.col("word_chars")))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "lost_share",
        (~F.col("base_failed") & (F.col("lost_share") <= most_lost)).alias("kept"),
        F.array_join("_good", "\n").alias("cleaned"),
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The metrics and verdict of clean_lines, without the cleaned texts; nulls, empties and repeats as there, and an empty
    table gives no rows."""
    return clean_lines(docs, id_col, text_col).drop("cleaned", "lost_share")
