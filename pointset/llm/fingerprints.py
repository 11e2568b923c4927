"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

A sketch holds every shingle hash below a fixed fraction of the hash range, and the smallest hash in any case, so that a
document with any word has one.  Whether a hash is kept does not depend on the document's length, so sketches merge by union
and estimate containment between very unequal documents as well as Jaccard similarity.

Words are what white space separates, in lower case; shingles are five words; fewer words are one shingle.

Defined cases: null is the empty text; a text without words has an empty sketch; two empty sketches are alike (1), an empty
one and another are not (0); equal texts have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointset.llm.common import id_key, partitions

LOWEST = -(1 << 63)


def with_sketch(df: DataFrame, text: str, name: str, words: int = 5, fraction: int = 8) -> DataFrame:
    """``df`` with the sketch (sorted longs) of column ``text``; one of ``fraction`` hashes is kept."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    word = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    hashed = df.select(*kept, F.transform(word, lambda w: F.xxhash64(w)).alias("__words"))
    h, n = F.col("__words"), F.size("__words")
    rolled = F.when(n >= words, F.transform(F.sequence(F.lit(1), F.greatest(n - (words - 1), F.lit(1))), lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(words)])))
    short = F.when(n > 0, F.array(F.aggregate(h, n.cast("long"), lambda a, x: F.xxhash64(a, x))))
    rolled = hashed.select(*kept, F.coalesce(rolled, short, F.array().cast("array<bigint>")).alias("__shingles"))
    s = F.col("__shingles")
    low = F.filter(s, lambda x: x < F.lit(LOWEST + (1 << 64) // fraction))
    least = F.when(F.size(s) > 0, F.array(F.array_min(s))).otherwise(F.array().cast("array<bigint>"))
    return rolled.select(*kept, F.array_sort(F.array_union(low, least)).alias(name))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both documents together (it may hold one hash above the threshold besides the smallest)."""
    return F.array_sort(F.array_union(a, b))


def similarity(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / F.greatest(every, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def printed(sketch: Column) -> Column:
    return F.array_join(sketch.cast("array<string>"), ",")


def with_next(df: DataFrame, key: str, text: str, carried: str, ranges: int | None = None) -> DataFrame:
    """``df`` with next_text and next_carried of the row that follows in the order of (key, hash of the text, text); after the last the first.

    Rows are dealt into ranges of the key at approximate quantiles, and rows of a key that makes several quantiles into as
    many ranges of the hash; a row's successor is in its range, or the first row of
    the next range that has one.  So no task sees more than a range, and the ranges' first rows are all that is global.
    """
    n = ranges or 4 * partitions(df.sparkSession)
    cuts = df.select(F.percentile_approx(key, [k / n for k in range(1, n)], 10 * n)).first()[0] or []
    often = {c: cuts.count(c) for c in set(cuts) if cuts.count(c) > 1}
    tie = F.xxhash64(text)
    number = F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    if often:  # such a key is the first of its range
        width = max(often.values()) + 1
        own = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in often.items() for x in pair]), F.col(key)), F.lit(0))
        number = number * width + F.when(own > 0, F.floor(F.shiftrightunsigned(tie, 11) / float(1 << 53) * own)).otherwise(width - 1)
    rows = df.withColumn("range", number.cast("long")).withColumn("tie", tie)
    own = Window.partitionBy("range").orderBy(key, F.shiftrightunsigned("tie", 1), "tie", text)
    inside = rows.withColumn("after", F.lead(F.struct(text, carried)).over(own))
    firsts = rows.groupBy("range").agg(F.min(F.struct(key, F.shiftrightunsigned("tie", 1).alias("high"), "tie", text, carried)).alias("f")).select("range", F.struct(F.col(f"f.{text}").alias(text), F.col(f"f.{carried}").alias(carried)).alias("f"))
    every = Window.orderBy("range")  # one row a range: at most twice ``ranges`` rows
    follows = firsts.withColumn("follow", F.coalesce(F.lead("f").over(every), F.first("f").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).select("range", "follow")
    joined = inside.join(follows, "range").withColumn("after", F.coalesce("after", "follow"))
    return joined.withColumn("next_text", F.col(f"after.{text}")).withColumn("next_carried", F.col(f"after.{carried}")).drop("range", "tie", "after", "follow")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, fraction: int = 8) -> DataFrame:
    """Per row: doc_key, text, sketch."""
    rows = docs.select(id_key(id_col).alias("doc_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_sketch(rows, "text", "sketch", words, fraction)


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, fraction: int = 8) -> DataFrame:
    """Fingerprints of each text and of its edited form: the last half of its characters replaced by the beginning of the next document."""
    rows = with_next(fingerprint(docs, id_col, text_col, words, fraction), "doc_key", "text", "sketch")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_key", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_carried")
    rows = with_sketch(rows, "edited", "edited_sketch", words, fraction)
    return rows.select(
        "doc_key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        similarity(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), similarity(F.col("sketch"), F.col("next_carried")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"), containment(F.col("sketch"), F.col("next_carried")).alias("contained_in_next"),
    )
