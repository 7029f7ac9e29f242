"""Paragraphs of code in running text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions.text import WS, not_blank, strip

#: Words of code, and symbols.
KEYWORDS = (
    "function class interface enum const let var def return returns switch case if else for while try catch throw import from "
    "public private protected service rpc message type struct func go"
).split()
SYMBOLS = "{}();[]=<>"


def paragraphs(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, para_no, paragraph): runs of lines that are not blank, in order."""
    found = F.filter(F.split("text", rf"\n(?:[{WS}]*\n)+", -1), not_blank)
    return docs.select(*keys, F.posexplode(found).alias("para_no", "paragraph"))


def is_code(paragraph: Column) -> Column:
    """Column: at least two of four signals (keyword, indent, line ending, symbols); one line needs three, or symbols and one of keyword and ending."""
    lines = F.filter(F.transform(F.split(paragraph, "\n", -1), lambda x: F.regexp_replace(x, rf"[{WS}]+\z", "")), lambda x: x != "")

    def judged(a: Column) -> Column:
        joined = F.array_join(a, "\n")
        keyword = joined.rlike(rf"(?i)\b({'|'.join(KEYWORDS)})\b")
        indent = F.exists(a, lambda x: x.startswith("    ") | x.startswith("\t"))
        ending = F.exists(a, lambda x: x.rlike(r"(;|\{|\}|\],|\),)\z"))
        n = F.length(joined) - F.length(F.translate(joined, SYMBOLS, ""))
        symbols = (n >= 6) | ((n >= 4) & (n / F.greatest(F.length(joined), F.lit(1)) >= 0.03))
        total = sum((x.cast("int") for x in (keyword, indent, ending)), symbols.cast("int"))
        one = (total >= 3) | (symbols & (keyword | ending))
        return (F.size(a) > 0) & ~joined.contains("```") & F.when(F.size(a) == 1, one).otherwise(total >= 2)

    return F.transform(F.array(lines), judged)[0]


def language(paragraph: Column) -> Column:
    """Column: javascript, python, json or text by tell-tale substrings, in that order."""
    low = F.lower(paragraph)
    any_of = lambda *x: F.greatest(*[low.contains(t) for t in x])
    return (
        F.when(any_of("function ", "const ", "let ", "=>", "switch("), "javascript").when(any_of("def ", "import ", "from ") & paragraph.contains(":"), "python")
        .when(paragraph.contains("{") & paragraph.contains("}") & paragraph.contains(":") & paragraph.contains('"'), "json").otherwise("text")
    )


def fence_code(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_fenced): paragraphs of code put into fences with their language; text in fences stays as it is.

    Null texts have no row; ids are unique. Paragraphs are judged in partitions of (doc_id, paragraph) that the one of doc_id serves.
    """
    at = Window.partitionBy("doc_id").orderBy("no")
    upto = at.rowsBetween(Window.unboundedPreceding, 0)
    rows = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1)).alias("no", "line"))
    fence = strip(F.col("line")).startswith("```")
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(upto))
    rows = rows.withColumn("plain", ~fence & (F.col("fences") % 2 == 0) & not_blank(F.col("line")))
    rows = rows.withColumn("para", F.sum((~F.col("plain")).cast("int")).over(upto))
    runs = rows.groupBy("doc_id", "para", "plain").agg(F.min("no").alias("no"), F.array_sort(F.collect_list(F.struct("no", "line"))).alias("x"))
    body = F.array_join(F.transform("x", lambda s: s["line"]), "\n")
    judged = runs.select("doc_id", "no", "plain", body.alias("body")).withColumn("code", F.col("plain") & is_code(F.col("body")))
    text = F.when(F.col("code"), F.concat(F.lit("```"), language(F.col("body")), F.lit("\n"), "body", F.lit("\n```"))).otherwise(F.col("body"))
    joined = judged.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", text.alias("text")))).alias("x"), F.sum(F.col("code").cast("long")).alias("n_fenced"))
    return joined.select("doc_id", F.array_join(F.transform("x", lambda s: s["text"]), "\n").alias("text"), "n_fenced")
