"""I-Match fingerprints: hashes of several randomised subsets of the lexicon's terms that a text has.

Each term of the lexicon is in MEMBERS of SUBSETS random subsets, so subsets overlap. A fingerprint is a row of pieces,
one for each subset of whose terms the text has some: two digits for the subset and sixteen of the 64-bit hash of its
sorted distinct terms. A text without a term of the lexicon has pieces of all its terms, in as many subsets of their
own, and one that isn't empty but has no words a piece of itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shalebed.llm.common import materialize, partitions

#: Terms that so large shares of all documents hold make up the lexicon: inverse document frequencies from ln 20 to ln 500.
LEAST_SHARE, MOST_SHARE = 0.002, 0.05
#: Random subsets of the lexicon (at most 64, the bits of a mask), and how many of them a seeded hash gives each term.
SUBSETS, MEMBERS = 64, 2
#: Rows that carry what is known about a text pass the join with the lexicon under so many terms that no text has.
CARRIERS = 256
#: A lexicon of more terms is joined by shuffle. It has at most (distinct terms of a mean document) / LEAST_SHARE terms.
BROADCAST_TERMS = 1_000_000


def terms(text: Column) -> Column:
    """Distinct words in lower case (A-Z)."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.array_remove(F.split(low, r"[\x20\x09-\x0D]+"), ""))


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Terms held by a share of distinct texts from least to most, and by two at least; counted over all of them, so copies don't lift a term above the band."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    n = texts.select(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(41)).alias("b")).distinct().count()
    counted = texts.distinct().select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return materialize(counted.where((F.col("df") >= max(2, least * n)) & (F.col("df") <= max(2, most * n))).select("term"), "lexicon")


def likeness(a: str, b: str) -> Column:
    """The share of equal hashes among the subsets of which either text has terms; 0 if one text alone has terms of the lexicon, 1 if both are empty.

    a and b name structs of pieces, mask (the subsets) and bare (whether the pieces are of all terms).
    """
    either = F.bit_count(F.col(f"{a}.mask").bitwiseOR(F.col(f"{b}.mask")))
    share = F.size(F.array_intersect(f"{a}.pieces", f"{b}.pieces")) / either
    return F.when(F.col(f"{a}.bare") != F.col(f"{b}.bare"), F.lit(0.0)).when(either == 0, F.lit(1.0)).otherwise(share)


def _numbers(hashes: Column) -> Column:
    """Each term's hash once for each of its subsets, sorted: the subset, then 52 bits of the hash."""

    def each(h: Column) -> Column:
        first, step = F.pmod(h, F.lit(SUBSETS)), F.pmod(F.shiftright(h, 6), F.lit(SUBSETS // MEMBERS - 1)) + 1
        rest = F.shiftrightunsigned(h, 12)
        return F.array(*((F.pmod(first + step * i, F.lit(SUBSETS)) * F.lit(1 << 52) + rest) for i in range(MEMBERS)))

    return F.sort_array(F.flatten(F.transform(hashes, each)))


def _starts(numbers: Column) -> Column:
    """Where in sorted numbers of terms each subset begins."""
    subset = lambda i: F.shiftright(F.get(numbers, i), 52)
    last = F.size(numbers) - 1
    return F.when(last < 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (i == 0) | (subset(i) != subset(i - 1))))


def _pieces(numbers: str, starts: str, bare: Column) -> Column:
    """pieces, mask and bare of sorted numbers of terms."""
    n, s = F.col(numbers), F.col(starts)
    subset = lambda i: F.shiftright(F.get(n, i), 52).cast("int")
    piece = lambda i, k: F.xxhash64(F.slice(n, i + 1, F.coalesce(F.get(s, k + 1), F.size(n)) - i), bare)
    bits = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(SUBSETS)))
    mask = F.aggregate(s, F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.get(bits, subset(i))))
    return F.struct(F.transform(s, piece).alias("pieces"), mask.alias("mask"), bare.alias("bare"))


def _text(fingerprint: str) -> Column:
    """The digits of a fingerprint; pieces of all terms count their subsets from SUBSETS on."""
    f = F.col(fingerprint)
    subsets = F.filter(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda i: F.getbit(f["mask"], i) == 1)
    first = F.when(f["bare"], SUBSETS).otherwise(0)
    digits = lambda x, n: F.lower(F.lpad(F.hex(x), n, "0"))
    return F.array_join(F.zip_with(subsets, f["pieces"], lambda i, p: F.concat(digits(i + first, 2), digits(p, 16))), "")


def _once(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    """df with a struct of columns that is computed once a row; plain columns would be copied into the functions that use them."""
    return df.withColumn(name, F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _buckets(docs: DataFrame) -> Column:
    """A number for each range of doc_id, higher for higher ids, 0 for null; ranges of about equal size."""
    n = 4 * partitions(docs.sparkSession)
    bounds = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))})
    if not bounds:
        return F.when(F.col("doc_id").isNull(), 0).otherwise(1)
    steps = math.ceil(math.log2(len(bounds) + 1)) + 1
    array = F.array(*map(F.lit, bounds))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def halve(s: Column, _: Column) -> Column:
        above = F.get(array, middle(s)) <= F.col("doc_id")
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(above, middle(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(middle(s)).alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["lo"])
    return F.when(F.col("doc_id").isNull(), 0).otherwise(found + 1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half the next document's beginning replaces.

    docs has doc_id and text; other columns are not read. The next document is the one of the next smaller doc_id, equal
    ids by text, nulls last; after the last comes the first, so a single document is its own next. A null text counts as
    empty. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Texts
    without a term of the lexicon have fingerprints of all their terms, blank ones of the text itself, empty ones an
    empty fingerprint. near_edited compares all terms if one of its two texts alone has terms of the lexicon. Two texts
    are as 1 only if all their pieces are equal. An empty table gives no rows.
    """
    chosen = lexicon(docs)
    few = chosen.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    carrier = lambda i: F.concat(F.lit(" "), i.cast("string"))
    chosen = chosen.unionByName(docs.sparkSession.range(CARRIERS).select(carrier(F.col("id")).alias("term")))
    if few:
        chosen = F.broadcast(chosen)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("bucket", _buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"))))
    line = W.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    lined = texts.withColumn("row", F.row_number().over(line)).withColumn("next", F.lead("text").over(line))
    # The first row of each bucket follows the last row of the bucket above it.
    small = W.partitionBy(F.lit(1)).orderBy(F.col("bucket").desc())
    ids = texts.groupBy("bucket").agg(F.count("*").alias("rows"), F.max(F.struct("doc_id", "text")).alias("top"))
    linked = materialize(ids, "tops")
    after = linked.select("bucket", "rows").withColumn("below", F.coalesce(F.lead("bucket").over(small), F.first("bucket").over(small)))
    edge = after.join(linked.select(F.col("bucket").alias("below"), F.col("top.text").alias("edge")), "below").select("bucket", "rows", "below", "edge")
    half = F.floor(F.length("text") / 2).cast("int")
    other = F.coalesce("next", "edge")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(other, F.lit(1), half))
    both = lined.join(edge, "bucket").select("bucket", "row", "rows", "below", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    both = both.withColumn("about", F.struct("rows", "below", "doc_id", "n_chars", "edited_sha256"))
    held = lambda k, text: F.struct(F.lit(k).alias("k"), terms(F.col(text)).alias("t"), F.col(text).alias("text"))
    kinds = both.select("bucket", "row", "about", F.explode(F.array(held(0, "text"), held(1, "edited"))).alias("kind"))
    # One row of each text has a term that no text has; it carries all terms and what is known about the document.
    mark = carrier(F.pmod(F.xxhash64("bucket", "row"), F.lit(CARRIERS)))
    marked = F.startswith(F.col("term"), F.lit(" "))
    each = kinds.select("bucket", "row", "about", "kind", F.explode(F.concat(F.array(mark), F.col("kind.t"))).alias("term"))
    all_ = F.when(F.size("kind.t") > 0, F.col("kind.t")).when(F.length("kind.text") > 0, F.array("kind.text")).otherwise(F.col("kind.t"))
    each = each.select("bucket", "row", F.col("kind.k").alias("k"), "term", F.when(marked & (F.col("kind.k") == 0), F.col("about")).alias("about"), F.when(marked, all_).alias("all"))
    hashed = each.join(chosen, "term").select("bucket", "row", "k", F.when(~marked, F.xxhash64("term", F.lit(41))).alias("h"), "about", "all")
    some = lambda k: F.collect_list(F.when(F.col("k") == k, F.col("h")))
    every = lambda k: F.first(F.when(F.col("k") == k, F.col("all")), ignorenulls=True)
    grouped = hashed.groupBy("bucket", "row").agg(some(0).alias("mine"), some(1).alias("theirs"), every(0).alias("my_all"), every(1).alias("their_all"), F.first("about", ignorenulls=True).alias("about"))
    all_of = lambda whole: F.transform(whole, lambda t: F.xxhash64(t, F.lit(41)))
    or_all = lambda x, whole: F.when(F.size(x) > 0, F.col(x)).otherwise(all_of(whole))
    # Where one of the two alone has terms of the lexicon, they are compared by all their terms.
    bare = (F.size("mine") == 0, F.size("theirs") == 0)
    instead = F.when(bare[0] & ~bare[1], all_of("their_all")).when(bare[1] & ~bare[0], all_of("my_all")).otherwise(F.array().cast("array<bigint>"))
    grouped = _once(grouped, "a", mine=_numbers(or_all("mine", "my_all")), theirs=_numbers(or_all("theirs", "their_all")), other=_numbers(instead), my_bare=bare[0], their_bare=bare[1])
    grouped = _once(grouped, "b", mine=_starts(F.col("a.mine")), theirs=_starts(F.col("a.theirs")), other=_starts(F.col("a.other")))
    flags = {"mine": F.col("a.my_bare"), "theirs": F.col("a.their_bare"), "other": F.lit(True)}
    grouped = _once(grouped.select("bucket", "row", "about", "a", "b"), "c", **{x: _pieces(f"a.{x}", f"b.{x}", flags[x]) for x in flags})
    near = F.when(F.col("c.mine.bare") == F.col("c.theirs.bare"), likeness("c.mine", "c.theirs")).when(F.col("c.mine.bare"), likeness("c.mine", "c.other")).otherwise(likeness("c.theirs", "c.other"))
    done = materialize(grouped.select("bucket", "row", "about.*", "c.mine", "c.theirs", near.alias("near_edited")), "fingerprints")
    inside = F.col("row") < F.col("rows")
    asked = done.withColumn("to_bucket", F.when(inside, F.col("bucket")).otherwise(F.col("below"))).withColumn("to_row", F.when(inside, F.col("row") + 1).otherwise(1))
    nexts = done.select(F.col("bucket").alias("to_bucket"), F.col("row").alias("to_row"), F.col("mine").alias("following"))
    return asked.join(nexts, ["to_bucket", "to_row"]).select("doc_id", "n_chars", "edited_sha256", _text("mine").alias("fingerprint"), _text("theirs").alias("edited_fingerprint"), "near_edited", likeness("mine", "following").alias("near_next"))
