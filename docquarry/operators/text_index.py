"""Substring search by an inverted index of character trigrams.

A text that contains a literal contains each of its trigrams, so the documents that hold the rarest
few of them are the only candidates; they are read from the corpus and judged by the query
model itself.  Patterns take part with the literals that every match must contain.  What has no
trigram to go by (literals of one or two characters, alternations) is searched by a scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from docquarry.functions.values import DocumentLayout, elements_at
from docquarry.operators.steps import let
from docquarry.plans.query import Q, find
from docquarry.session import cut_lineage
from docquarry.sources.keyed import KeyedTable

SIZE = 3
#: Trigrams of a literal that are looked up, the rarest ones.
ASKED = 3


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, in time linear in its length."""

    def joined(chars: Column) -> Column:
        whole = F.transform(chars, lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2)))
        return F.array_distinct(F.filter(whole, lambda g: g.isNotNull()))

    return let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), joined)


def literal_grams(literal: str) -> set[str]:
    return {literal[i : i + SIZE] for i in range(len(literal) - SIZE + 1)}


def required_literals(pattern: str) -> list[str]:
    """Runs of characters that every match of a pattern contains; none where that isn't plain to see."""
    if set("|()") & set(pattern):
        return []
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c in "*?{":  # the character before may be absent
            runs.append(run[:-1])
            run, i = "", pattern.find("}", i) if c == "{" else i
            if i < 0:
                return []
        elif c == "\\" and i + 1 < len(pattern) and not pattern[i + 1].isalnum():
            run, i = run + pattern[i + 1], i + 1
        elif c == "\\":  # a class or a control character, perhaps with a value in hexadecimal or by name
            return []
        elif c == "[":
            runs.append(run)
            run, i = "", pattern.find("]", i + 2)
            if i < 0 or "[" in pattern[pattern.find("[") + 1 : i] or "&&" in pattern or "\\" in pattern:
                return []
        elif c in ".^$+":
            runs.append(run)
            run = ""
        else:
            run += c
        i += 1
    return [r for r in [*runs, run] if len(r) >= SIZE]


@dataclass(frozen=True)
class TextIndex:
    """Trigrams of the text at one path (a ``[*]`` path: of all elements), kept batch by batch.

    A posting row holds the 32-bit hashes of the ids that one task found under a gram; ids that share a
    hash are candidates together, and the search judges them.  Documents without an id, or under a
    repeated one, are judged like all others when a search reads them.
    """

    path: str
    field: str
    buckets: int = 64

    @cached_property
    def postings(self) -> KeyedTable:
        return KeyedTable(f"{self.path}/postings", "gram", "gram string, ids array<int>", self.buckets)

    @cached_property
    def counts(self) -> KeyedTable:
        return KeyedTable(f"{self.path}/counts", "gram", "gram string, n long", self.buckets, counted="n")

    def update(self, docs: DataFrame, batch: int) -> None:
        """Take in a batch of documents (numbered from 0); a batch given again replaces what it wrote."""
        texts = elements_at(DocumentLayout(docs.schema), self.field, lambda p: p.text())
        if texts is None:
            return
        whole = F.filter(texts if "[*]" in self.field else F.coalesce(texts, F.array().cast("array<string>")), lambda x: x.isNotNull())
        found = F.flatten(F.transform(whole, grams))
        named = docs.where(F.col("id").isNotNull())
        rows = named.select(F.hash("id").alias("id"), F.spark_partition_id().alias("task"), F.explode(F.array_distinct(found)).alias("gram"))
        # A list a task: short rows, and most of the ids travel as four bytes.
        lists = rows.groupBy("gram", "task").agg(F.sort_array(F.collect_set("id")).alias("ids"))
        lists = cut_lineage(lists.select("gram", "ids"), "grams")
        self.postings.append(lists, batch)
        self.counts.append(lists.groupBy("gram").agg(F.sum(F.size("ids").cast("long")).alias("n")), batch)

    def asked(self, leaf: Q) -> set[str]:
        """Trigrams that a document must hold to fulfil a leaf; empty where the index can't help."""
        if leaf.field != self.field:
            return set()
        if leaf.operation in ("contains_string", "exact_string"):
            return literal_grams(leaf.param1)
        if leaf.operation == "regexp":
            return set().union(*[literal_grams(r) for r in required_literals(leaf.param1)])
        return set()

    def candidates(self, corpus: DataFrame, leaf: Q, before: int) -> DataFrame | None:
        """Hashes (``id``) of the ids of documents that may fulfil the leaf, or None: all of them may."""
        wanted = sorted(self.asked(leaf))
        if not wanted:
            return None
        spark = corpus.sparkSession
        keys = spark.createDataFrame([(g,) for g in wanted], "gram string")
        held = {r["gram"]: r["n"] for r in self.counts.lookup(keys, before).collect()}  # a row a trigram of the literal
        if len(held) < len(wanted):
            return spark.createDataFrame([], "id int")
        rarest = sorted(wanted, key=lambda g: (held[g], g))[:ASKED]
        rows = self.postings.lookup(spark.createDataFrame([(g,) for g in rarest], "gram string"), before)
        return rows.select("gram", F.explode("ids").alias("id")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select("id")

    def search(self, corpus: DataFrame, leaf: Q, before: int) -> DataFrame:
        """The documents of ``corpus`` that fulfil the leaf; all of it must have been taken in."""
        ids = self.candidates(corpus, leaf, before)
        if ids is None:
            return find(corpus, leaf)
        wanted = cut_lineage(ids, "candidates").select(F.col("id").alias("__id"))
        some = corpus.join(wanted, F.hash("id") == F.col("__id"), "left_semi")
        return find(some.unionByName(corpus.where(F.col("id").isNull())), leaf)
