"""Benchmark decontamination by a positional inverted index.

The index is a written table of postings ``(term, doc_id, pos)``: one row per
training token, sorted by term within each segment (one segment per input
partition, so building it moves no rows between executors and a frequent term
is spread over all segments). Queries read the lists of the rarest test terms,
shift them by the offset of the term in the test item, and intersect them on
(document, alignment). What survives is compared with the document word by word,
so the result is exact whatever the hashes of the terms do.

Defined cases: a null text has no words; an empty benchmark hits nothing; repeated
document rows each get the full result; documents that share an id but not the
text are judged by their own text; repeated benchmark rows count once; an item
with a null id can hit words but is not among the listed items. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxtally.llm.common import alnum_words, broadcast_if_small
from boxtally.session import scratch_path

WINDOW_WORDS = 13
#: A table of terms or anchors up to this many rows (about 64 MB) may be broadcast.
BROADCAST_ROWS = 500_000
#: Bytes of item texts that may be broadcast, and words of a document whose alignments are one row.
BROADCAST_BYTES, STRETCH = 32 << 20, 1 << 16


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Write the postings of whole texts and return them.

    ``vocabulary`` (``term``) leaves out terms that no query will ask for; the
    lists of the others stay complete.
    """
    spark = docs.sparkSession
    posts = (docs.select("doc_id", F.posexplode(alnum_words(F.col("text"))).alias("pos", "word"))
             .select(F.xxhash64("word").alias("term"), "doc_id", "pos"))
    if vocabulary is not None:
        posts = posts.join(broadcast_if_small(vocabulary, BROADCAST_ROWS), "term", "left_semi")
    path = scratch_path(spark, "postings")
    posts.sortWithinPartitions("term", "doc_id", "pos").write.parquet(path)
    return spark.read.schema(posts.schema).parquet(path)


def test_items(benchmark: DataFrame) -> DataFrame:
    """Distinct items with words: ``item_key, item_id, words``."""
    items = benchmark.select("item_id", alnum_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    key = F.sha2(F.concat_ws(" ", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "words"), 256)
    return items.select(key.alias("item_key"), "item_id", "words").dropDuplicates(["item_key"])


def item_terms(items: DataFrame) -> DataFrame:
    return items.select("item_key", F.size("words").alias("len"),
                        F.posexplode("words").alias("at", "word")).withColumn("term", F.xxhash64("word"))


def anchors(index: DataFrame, items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """The two rarest places of every window: ``item_key, at1, term1, at2, term2``.

    Windows of one item mostly share their rarest words, so there are few. The
    second place is null for windows of one word.
    """
    lists = index.groupBy("term").agg(F.count("*").alias("listed"))
    places = item_terms(items).join(lists, "term", "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
    last_start = F.greatest(F.col("len") - window, F.lit(0))
    starts = F.sequence(F.least(F.greatest(F.col("at") - window + 1, F.lit(0)), last_start),
                        F.least(F.col("at"), last_start))
    in_window = places.withColumn("start", F.explode(starts))
    order = Window.partitionBy("item_key", "start").orderBy("listed", "at")
    ranked = in_window.withColumn("rank", F.row_number().over(order)).where("rank <= 2")

    def pick(rank: int, name: str):
        return F.max(F.when(F.col("rank") == rank, F.col(name)))

    return (ranked.groupBy("item_key", "start")
            .agg(pick(1, "at").alias("at1"), pick(1, "term").alias("term1"),
                 pick(2, "at").alias("at2"), pick(2, "term").alias("term2"))
            .drop("start").distinct())


def alignments(index: DataFrame, items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Where the rarest lists agree: distinct ``doc_id, item_key, shift``.

    ``shift`` is the place in the document that faces the first word of the item.
    """
    found = anchors(index, items, window)
    second_terms = found.where("term2 is not null").select(F.col("term2").alias("term")).distinct()
    first = (index.join(broadcast_if_small(found, BROADCAST_ROWS), F.col("term") == F.col("term1"))
             .select("doc_id", "item_key", (F.col("pos") - F.col("at1")).alias("shift"), "term2",
                     (F.col("pos") - F.col("at1") + F.col("at2")).alias("pos2")).distinct())
    second = (index.join(broadcast_if_small(second_terms, BROADCAST_ROWS), "term", "left_semi")
              .select(F.col("doc_id").alias("doc2"), "term", "pos"))
    both = first.where("term2 is not null").join(
        second, F.col("doc_id").eqNullSafe(F.col("doc2")) & (F.col("term2") == F.col("term"))
        & (F.col("pos2") == F.col("pos")))
    alone = first.where("term2 is null")
    keys = ["doc_id", "item_key", "shift"]
    return both.select(keys).unionByName(alone.select(keys)).distinct()


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def _spans_at(text: Column, item: Column, shift: Column, window: int) -> Column:
    """Windows of an item that stand in a text when its first word faces the place ``shift``."""
    from_doc, from_item = F.greatest(shift, F.lit(0)), F.greatest(-shift, F.lit(0))
    here = F.slice(text, from_doc + 1, F.size(item) - from_item)
    there = F.slice(item, from_item + 1, F.size(item))
    width = F.least(F.size(item), F.lit(window))

    def spans(same: Column) -> Column:
        starts = F.when(F.size(same) >= width, F.filter(
            F.sequence(F.lit(0), F.size(same) - width), lambda s: F.forall(F.slice(same, s + 1, width), lambda x: x)))
        return F.transform(starts, lambda s: F.struct((from_doc + s).alias("start"), (from_doc + s + width).alias("end")))

    # A text that ends before the item does leaves nothing to compare with.
    return F.coalesce(_bound(F.zip_with(there, here, lambda a, b: F.coalesce(a == b, F.lit(False))), spans),
                      F.array().cast("array<struct<start:int,end:int>>"))


def phrase_matches(docs: DataFrame, index: DataFrame, items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Exact windows in documents: ``doc_id, text_hash, item_id, spans``.

    ``spans`` lists ``(start, end)`` word places of the item's windows. All alignments of a document within
    ``STRETCH`` words come together, by item, so a text is parted into words once per stretch and the work
    follows the alignments.
    """
    size = items.agg(F.coalesce(F.sum(F.octet_length(F.array_join("words", " "))), F.lit(0))).first()[0]
    stretch = F.floor(F.col("shift") / STRETCH).alias("stretch")
    lines = alignments(index, items, window).groupBy("doc_id", stretch, "item_key").agg(F.collect_list("shift").alias("shifts"))
    lines = (lines.join(F.broadcast(items) if size <= BROADCAST_BYTES else items, "item_key")
             .groupBy(F.col("doc_id").alias("found_in"), "stretch")
             .agg(F.collect_list(F.struct("item_id", "words", "shifts")).alias("lines")))
    met = docs.select("doc_id", "text").join(lines, F.col("doc_id").eqNullSafe(F.col("found_in")))
    # explode(array(x)) keeps the optimizer from copying the split into every use of it.
    parted = met.select("doc_id", F.xxhash64("text").alias("text_hash"), "lines",
                        F.explode(F.array(alnum_words(F.col("text")))).alias("own"))
    found = F.transform("lines", lambda x: F.struct(x["item_id"].alias("item_id"), F.flatten(F.transform(
        x["shifts"], lambda shift: _spans_at(F.col("own"), x["words"], shift, window))).alias("spans")))
    return parted.select("doc_id", "text_hash", F.inline(F.filter(found, lambda x: F.size(x["spans"]) > 0)))


def near_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """Places of the rarest word of a query that has all its other words near.

    ``queries`` has ``query_id, words``. Near is at most ``slop`` words farther than the
    words would take side by side, in any order. Returns ``query_id, doc_id, pos``.
    """
    terms = (queries.select("query_id", F.size(F.array_distinct("words")).alias("need"),
                            F.explode(F.array_distinct("words")).alias("word"))
             .withColumn("term", F.xxhash64("word")))
    lists = index.groupBy("term").agg(F.count("*").alias("listed"))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("listed", F.lit(0)), "term")
    ranked = terms.join(lists, "term", "left").withColumn("rank", F.row_number().over(order))
    reach = F.col("need") - 1 + slop
    posts = index.join(terms.select("term").distinct(), "term", "left_semi")
    first = (posts.join(ranked.where("rank = 1").select("query_id", "need", "term"), "term")
             .select("query_id", "need", F.col("doc_id").alias("doc1"), F.col("pos").alias("pos1"),
                     F.explode(F.sequence(F.floor((F.col("pos") - reach) / (reach + 1)),
                                          F.floor((F.col("pos") + reach) / (reach + 1)))).alias("cell")))
    rest = (posts.join(ranked.where("rank > 1").select(F.col("query_id").alias("q2"), "need", "term"), "term")
            .select("q2", "doc_id", "pos", "term", F.floor(F.col("pos") / (reach + 1)).alias("cell2")))
    met = (first.join(rest, (F.col("query_id").eqNullSafe(F.col("q2"))) & F.col("doc1").eqNullSafe(F.col("doc_id"))
                      & (F.col("cell") == F.col("cell2")), "left")
           .where((F.col("need") == 1) | (F.abs(F.col("pos") - F.col("pos1")) <= reach)))
    return (met.groupBy("query_id", "doc1", "pos1", "need").agg(F.countDistinct("term").alias("met"))
            .where("need = 1 or met = need - 1")
            .select("query_id", F.col("doc1").alias("doc_id"), F.col("pos1").alias("pos")))


def _covered(spans):
    """Number of places that the spans cover together."""
    step = F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n")))
    return step["n"].cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """One row per document row: words, words hit, items found, and the verdict.

    Contaminated: at least a twentieth of the words, and at least one, is hit.
    """
    items = test_items(benchmark)
    index = build_index(docs, item_terms(items).select("term").distinct())
    hits = (phrase_matches(docs, index, items, window).groupBy("doc_id", "text_hash")
            .agg(F.collect_set("spans").alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
            .select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "items",
                    _covered(F.flatten("spans")).alias("n_hit")))
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                      F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    joined = own.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")),
                      "left")
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(listed), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns as they are."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti")
