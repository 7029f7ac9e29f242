"""Successors of text segments from one version of a document to the next, by similarity of their words.

Candidates come from a set-similarity join inside each document: words are ordered rarest first, and two segments as similar as asked for
share one of their first few words. Segments of one text are one class with a number of members, so repeated lines form no pairs among themselves, and those of
a text that both versions hold go together first. What is left is
then assigned one to one, the most similar pair first; every round settles all pairs that are the best for both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions.text import words
from foldline.sources.tables import kept


def word_set(text):
    """Column: the distinct lower-case words of ``text``; one empty word where it has none, so that blank texts are alike."""
    found = F.array_distinct(words(F.lower(F.coalesce(text, F.lit("")))))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def _classes(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts of both sides that go together as they are: doc_id, a, b, taken; the texts that are left over on one side: doc_id, old, first, n, used, words). A class is named by its first id on a side."""
    side = lambda rows, is_old: rows.select("doc_id", F.lit(is_old).alias("old"), "id", F.coalesce("text", F.lit("")).alias("text"))
    of = lambda is_old: F.when(F.col("old") == is_old, F.col("id"))
    both = side(old, True).unionByName(side(new, False)).groupBy("doc_id", F.unhex(F.md5("text")).alias("cls")).agg(
        F.count(of(True)).alias("a"), F.count(of(False)).alias("b"), F.min(of(True)).alias("a_first"), F.min(of(False)).alias("b_first"), F.any_value("text").alias("text"),
    )
    both = kept(both.withColumn("text", F.when(F.col("a") != F.col("b"), F.col("text"))), "texts")  # what matches in full needs no more comparing
    taken = F.least("a", "b").alias("taken")
    left = both.where("a <> b").select("doc_id", (F.col("a") > F.col("b")).alias("old"), F.when(F.col("a") > F.col("b"), F.col("a_first")).otherwise(F.col("b_first")).alias("first"), F.abs(F.col("a") - F.col("b")).alias("n"), taken.alias("used"), word_set(F.col("text")).alias("words"))
    return both.select("doc_id", F.col("a_first").alias("a"), F.col("b_first").alias("b"), taken).where("taken > 0"), kept(left, "left")


def similar_pairs(classes: DataFrame, least: float) -> DataFrame:
    """(doc_id, a, b, similarity): classes of the old and the new side of a document, by their first ids, whose word sets have a Jaccard similarity of ``least`` or more.

    A set of n words needs only its n - ceil(least * n) + 1 rarest ones as keys, by how many classes of the document hold them. A key is met only where the sizes of
    the sets and the places of the key in them leave ``least`` possible; the sets themselves travel once for each pair that is left. Keys are 64-bit hashes; similarities count the words.
    The sets are dealt by document once, and all that follows up to the pairs keeps to that dealing: a document, which was one row before it was segments, is sorted in one task and spills there.
    """
    dealt = classes.select("doc_id", "old", "first", F.size("words").alias("size"), F.transform("words", lambda x: F.xxhash64(x)).alias("w")).repartition("doc_id")
    held = dealt.select("doc_id", "old", "first", "size", F.explode("w").alias("word")).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "word")))
    placed = held.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "old", "first").orderBy("df", "word")) - 1)
    keys = placed.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9))
    side = lambda old: F.collect_list(F.when(F.col("old") == old, F.struct("first", "size", "place")))
    met = keys.groupBy("doc_id", "word").agg(side(True).alias("x"), side(False).alias("y")).where("size(x) > 0 AND size(y) > 0").select("doc_id", F.explode("x").alias("x"), "y")

    def possible(y):
        x = F.col("x")
        left = F.least(x["size"] - x["place"], y["size"] - y["place"])  # the first shared word is here, or was met before
        return (left / (x["size"] + y["size"] - left) >= least - 1e-9) & (F.least(x["size"], y["size"]) >= F.lit(least - 1e-9) * F.greatest(x["size"], y["size"]))

    pairs = met.select("doc_id", F.col("x.first").alias("a"), F.explode(F.filter("y", possible)).alias("y")).select("doc_id", "a", F.col("y.first").alias("b")).distinct()
    sets = lambda old, name: classes.where(F.col("old") == old).select("doc_id", F.col("first").alias(name), F.col("words").alias(f"{name}_words"))
    full = kept(pairs, "pairs").join(sets(True, "a"), ["doc_id", "a"]).join(sets(False, "b"), ["doc_id", "b"])
    shared = F.size(F.array_intersect("a_words", "b_words"))
    score = shared / (F.size("a_words") + F.size("b_words") - shared)
    return full.select("doc_id", "a", "b", score.alias("similarity")).where(F.col("similarity") >= least - 1e-9)


def _assigned(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, a, b, similarity, a_from, b_from, taken): how many members of which classes go together, from which member on, best pairs first."""
    order = F.struct(F.negative("similarity").alias("s"), F.col("a").alias("x"), F.col("b").alias("y"))
    live = kept(pairs.withColumn("order", order).select("doc_id", "a", "b", "similarity", "order"), "pairs")
    sizes = lambda old, name: classes.where(F.col("old") == old).select("doc_id", F.col("first").alias(name), F.col("n").alias(f"{name}_left"), F.col("used").alias(f"{name}_from"))
    live = kept(live.join(sizes(True, "a"), ["doc_id", "a"]).join(sizes(False, "b"), ["doc_id", "b"]), "live")
    done = live.limit(0).withColumn("taken", F.col("a_left")).select("doc_id", "a", "b", "similarity", "a_from", "b_from", "taken")
    while not live.isEmpty():
        best = live.withColumn("_a", F.min("order").over(Window.partitionBy("doc_id", "a"))).withColumn("_b", F.min("order").over(Window.partitionBy("doc_id", "b")))
        settled = best.where((F.col("order") == F.col("_a")) & (F.col("order") == F.col("_b"))).withColumn("taken", F.least("a_left", "b_left"))
        settled = kept(settled.select(*done.columns), "settled")
        done = done.unionByName(settled)
        for name in ("a", "b"):
            used = settled.select("doc_id", name, F.col("taken").alias("_used"))
            some = F.coalesce("_used", F.lit(0).cast("long"))
            live = live.join(used, ["doc_id", name], "left").withColumn(f"{name}_left", F.col(f"{name}_left") - some).withColumn(f"{name}_from", F.col(f"{name}_from") + some).drop("_used")
        live = kept(live.where("a_left > 0 AND b_left > 0"), "live")
    return done


def text_lineage(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, id, successor, similarity): for each old segment (doc_id, id, text) the new one that takes its place, null where none does.

    Pairs of equal texts go first, then others of one document by Jaccard similarity of their words, ``least`` at least; ties go to the pair whose texts come
    first by old and then new id. No segment has two successors or predecessors; members of one text go together in the order of ids. Null texts are
    empty, and texts without words are alike. Ids are unique in a version of a document; documents of one side only have no pairs. ``least`` must be above 0.
    """
    if least <= 0:
        raise ValueError("least must be positive")
    equal, classes = _classes(old, new)
    zero = F.lit(0).cast("long")
    equal = equal.select("doc_id", "a", "b", F.lit(1.0).alias("similarity"), zero.alias("a_from"), zero.alias("b_from"), "taken")
    taken = kept(equal.unionByName(_assigned(similar_pairs(classes, least), classes)), "taken")
    same = Window.partitionBy("doc_id", "_cls")
    member = lambda rows, name, at: rows.select("doc_id", "id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("_cls")).select("doc_id", "id", F.min("id").over(same).alias(name), (F.row_number().over(same.orderBy("id")) - 1).alias(at))
    each = taken.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)))
    each = each.withColumn("_at", F.col("a_from") + F.col("_k")).withColumn("_to", F.col("b_from") + F.col("_k"))
    ours = each.join(member(old, "a", "_at"), ["doc_id", "a", "_at"])
    theirs = member(new, "b", "_to").withColumnRenamed("id", "successor")
    found = ours.join(theirs, ["doc_id", "b", "_to"]).select("doc_id", "id", "successor", "similarity")
    return old.select("doc_id", "id").join(found, ["doc_id", "id"], "left")
