"""Near-duplicates by an inverted join over signature coordinates.

Every document gets COORDINATES minima over its set of shingles. A token is a pair
(coordinate, value); a document is posted under its tokens. Pairs that agree in at least
MATCHES coordinates are candidates. By the prefix rule two such documents share a token
among the PREFIX = COORDINATES - MATCHES + 1 rarest of each, so only these short lists
are merged; the long lists of frequent values are skipped and probed, for the pairs
found, by comparing the stored signatures. At a similarity of 0.8 a pair agrees
in fewer than MATCHES coordinates with a chance of about 8 in a hundred million. Candidates are
confirmed on the full shingle sets (of 64-bit hashes of shingles), which are made again from the texts of the
documents in candidate pairs, and of no other.

In a large corpus most pairs of a list agree in that one token by chance. So each posting carries the last two
bits of all coordinates: where two signatures agree in MATCHES coordinates, these differ in no more than the others,
and pairs that differ in more are dropped where they meet, before any signature or set is moved for them. Of pairs
that agree in one coordinate alone about 5 in a million get past that.

Documents with equal sets are one class before any posting, so groups of exact copies
never make pairs. Lists of near copies would still hold the square of their length. So of a long
list only a head faces the others at first, and members that are connected by then need no
comparison with each other. Of lists up to MIDDLE_LIST those members go that differ by their bits from all of another
component. Pairs of different components that remain are ruled out, or linked, by what
their sets have other than most of their list has (``_rest_of_lists``); few are left to be confirmed, and no link
between components is lost.

Defined cases: null and empty texts and texts of white space only have an empty set, stand
alone and are kept; rows that share an id are one document, linked by any of its texts; a row
with a null id takes the component of a copy that has one, else it is kept with a null
component. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.llm.common import ascii_lower, broadcast_if_small
from boxtally.session import cut_lineage

SHINGLE_WORDS = 5
COORDINATES = 64
#: Chance of fewer agreements at similarity 0.8: about 8e-8.
MATCHES = 33
#: Lists up to this length are compared in full at once.
SHORT_LIST = 8
#: Of longer lists up to this length that their heads do not connect, members without a partner by bits are dropped.
MIDDLE_LIST = 256
#: Heads of longer lists that a class faces at first; all other pairs are left to the deltas, so no link depends on it.
HEADS = 3
#: Ids of documents (8 bytes each) that are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


_BREAKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _word_hashes(data: bytes) -> np.ndarray:
    """A polynomial 64-bit hash of each run between white space, for the whole text at once."""
    raw = np.frombuffer(data.translate(_BREAKS), np.uint8)
    space = raw == 32
    inside = ~space
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        at = np.arange(len(raw), dtype=np.int64)
        word = np.cumsum(np.diff(inside.astype(np.int8), prepend=np.int8(0)) == 1) - 1
        place = at - starts[np.maximum(word, 0)]
        part = _mix((raw.astype(np.uint64) + np.uint64(1)) * _ODD + place.astype(np.uint64) * _ODD2)
        part[space] = 0
        sums = np.cumsum(part)
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        return _mix(sums[ends - 1] - before + (ends - starts).astype(np.uint64) * _ODD3)


_ODD, _ODD2, _ODD3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text that is lower-cased already."""
    w = _word_hashes((text or "").encode())
    if not len(w):
        return np.zeros(0, np.int64)
    k = min(words, len(w))
    with np.errstate(over="ignore"):
        out = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            out = _mix(out * _ODD3 + w[i:len(w) - k + 1 + i] + np.uint64(i + 1))
    return np.unique(out).view(np.int64)


_RNG = np.random.default_rng(20240)
_KEYS = _RNG.integers(1, 2**63, (COORDINATES, 1), dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """COORDINATES minima of scrambled hashes, 32 bits each."""
    with np.errstate(over="ignore"):
        low = np.full(COORDINATES, 2**64 - 1, np.uint64)
        for at in range(0, len(hashes), 4096):
            y = (hashes.view(np.uint64)[at:at + 4096] ^ _KEYS) * _ODD
            y ^= y >> np.uint64(29)
            y *= _ODD2
            low = np.minimum(low, y.min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _lists(arrays: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from numpy arrays; None becomes null."""
    sizes = np.array([0 if a is None else len(a) for a in arrays], np.int32)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    filled = [a for a in arrays if a is not None and len(a)]
    values = pa.array(np.concatenate(filled), kind) if filled else pa.array([], kind)
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([a is None for a in arrays]))


def describe(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, n_shingles, set_key, signature`` per document row; an empty set has nulls."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sizes, keys, signatures = [], [], []
            for t in batch.column("text"):
                s = shingle_set(t.as_py(), words)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 _lists(signatures, pa.int32())], ["doc_id", "n_shingles", "set_key", "signature"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", ascii_lower(F.col("text")).alias("text"))
            .mapInArrow(batches, f"doc_id {id_type}, n_shingles long, set_key binary, signature array<int>"))


def shingle_sets(texts: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``id, hashes`` of rows ``id, text`` with lower-cased texts."""
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sets = [shingle_set(t.as_py(), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(sets, pa.int64())], ["id", "hashes"])

    id_type = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(batches, f"id {id_type}, hashes array<long>")


def _postings(classes: DataFrame, prefix: int) -> DataFrame:
    """``token, id, n, alone`` of the rarest tokens of each class, without tokens of one class only.

    ``alone`` counts the tokens that no other class has.
    """
    tokens = classes.select("id", "n", F.posexplode("signature").alias("i", "v")).select(
        "id", "n", (F.shiftleft(F.col("i").cast("long"), 32) + (F.col("v").cast("long") + 2**31)).alias("token"))
    listed = tokens.groupBy("token").agg(F.count("*").alias("listed")).where("listed > 1")
    # Tokens of one class only are rarest of all: they use up places of the prefix without being posted.
    shared = tokens.join(listed, "token")
    packed = shared.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("listed", "token"))).alias("t"))
    alone = F.lit(COORDINATES) - F.size("t")
    take = F.slice("t", F.lit(1), F.greatest(F.lit(prefix) - alone, F.lit(0)))
    return packed.where(alone < prefix).select("id", "n", alone.alias("alone"), F.explode(take).alias("x")).select(
        "x.token", "id", "n", "alone")


def _within_reach(a: str, b: str, percent: int) -> Column:
    """Whether sets of so many shingles can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _sets_of(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """The shingle sets of some documents; their texts are not shuffled unless the ids are too many to broadcast."""
    wanted = cut_lineage(ids.distinct())
    return cut_lineage(shingle_sets(texts.join(broadcast_if_small(wanted, BROADCAST_IDS), "id", "left_semi"), words))


def _agree(a: str, b: str) -> Column:
    """Whether two signatures agree in enough coordinates."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same >= MATCHES


def _bits(bit: int) -> Column:
    """One bit of each coordinate of a signature, the first coordinate lowest."""
    one = F.transform("signature", lambda v, i: F.call_function(
        "shiftleft", F.shiftright(v, bit).bitwiseAND(F.lit(1)).cast("long"), i))
    return F.aggregate(one, F.lit(0).cast("long"), lambda bits, b: bits.bitwiseOR(b))


def _may_agree(a: str, b: str) -> Column:
    """Whether signatures with these bits can agree in enough coordinates."""
    apart = F.col(f"{a}low").bitwiseXOR(F.col(f"{b}low")).bitwiseOR(F.col(f"{a}high").bitwiseXOR(F.col(f"{b}high")))
    return F.bit_count(apart) <= COORDINATES - MATCHES


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that agree in enough coordinates."""
    def sig(c):
        return classes.select(F.col("id").alias(c), F.col("signature").alias(f"sig_{c}"))

    return cut_lineage(pairs.join(sig("a"), "a").join(sig("b"), "b").where(_agree("sig_a", "sig_b")).select("a", "b"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are similar enough."""
    def full(c):
        return sets.select(F.col("id").alias(c), F.col("hashes").alias(f"set_{c}"))

    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return (pairs.join(full("a"), "a").join(full("b"), "b")
            .where(shared * 100 >= union * percent).select("a", "b"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, component`` of every id in the links ``(a, b)``: the smallest id it reaches.

    Each round links every id to the smallest among itself and its neighbours, and so does
    every neighbour that is smaller (large star, then small star), until nothing changes. Aggregates
    are minima, which combine before the shuffle.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct())
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(near, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                              F.col("m").alias("v")).where("u <> v").distinct())
        after = cut_lineage(small)
        # Done when every id has one link, to an id that has none upwards.
        shape = after.groupBy("u").agg(F.count("*").alias("n"))
        loose = shape.where("n > 1").select("u").unionByName(
            after.select(F.col("v").alias("u")).distinct().join(after.select("u").distinct(), "u", "left_semi"))
        edges = after
        if not loose.take(1):
            break
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


def _linked_classes(classes: DataFrame, texts: DataFrame, known: DataFrame, words: int, percent: int) -> DataFrame:
    """``id, component`` of the classes that have links (others are left out).

    ``known`` are links ``(a, b)`` that hold beforehand.
    """
    # Different sets of fewer shingles cannot be similar enough.
    able = classes.where(F.col("n") * (100 - percent) >= percent)
    posts = cut_lineage(_postings(able, COORDINATES - MATCHES + 1))
    lists = posts.groupBy("token").agg(F.count("*").alias("len")).where("len > 1")
    bits = classes.select("id", _bits(0).alias("low"), _bits(1).alias("high"))
    posts = cut_lineage(posts.join(lists, "token").join(bits, "id"))
    short = posts.where(F.col("len") <= SHORT_LIST)
    long_ = posts.where(F.col("len") > SHORT_LIST)

    def meeting(lists: DataFrame, *more: str) -> DataFrame:
        """The pairs of each list that can be similar enough, by sizes and bits."""
        def side(c):
            return lists.select("token", F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("n", "low", "high", *more)])

        return side("a").join(side("b"), "token").where(
            (F.col("a") < F.col("b")) & _within_reach("a_n", "b_n", percent) & _may_agree("a_", "b_"))

    pairs = meeting(short).select("a", "b")
    # The head of a list is the member with the fewest tokens of its own. A class faces the HEADS best of its lists.
    heads = long_.groupBy("token").agg(F.min(F.struct("alone", "id", "n", "low", "high")).alias("h"))
    faced = long_.join(heads, "token").withColumns({"h_low": F.col("h.low"), "h_high": F.col("h.high")})
    facing = (faced.where((F.col("id") != F.col("h.id")) & _within_reach("n", "h.n", percent) & _may_agree("", "h_"))
              .groupBy("id").agg(F.slice(F.sort_array(F.collect_set("h")), 1, HEADS).alias("hs"))
              .select("id", F.explode("hs.id").alias("h"))
              .select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b")))
    agreeing = _agreeing(facing.unionByName(pairs).distinct(), classes)
    ids = agreeing.select(F.col("a").alias("id")).unionByName(agreeing.select(F.col("b").alias("id")))
    links = known.unionByName(cut_lineage(_confirmed(agreeing, _sets_of(texts, ids, words), percent)))
    comp = components(links)
    # A list is finished when all of it is connected.
    active = (long_.join(comp.withColumnRenamed("component", "comp"), "id", "left")
              .select("token", "id", "n", "len", "low", "high", F.coalesce("comp", "id").alias("comp")))
    open_ = cut_lineage(active.join(active.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                                    .where("lo <> hi").select("token"), "token"))
    if not open_.take(1):
        return comp
    met = meeting(open_.where(F.col("len") <= MIDDLE_LIST), "comp").where("a_comp <> b_comp")
    partnered = met.select("token", F.explode(F.array("a", "b")).alias("id")).distinct()
    rest = cut_lineage(open_.join(partnered, ["token", "id"], "left_semi").unionByName(
        open_.where(F.col("len") > MIDDLE_LIST)).select("token", "id", "n", "comp"))
    sets = _sets_of(texts, rest.select("id"), words)
    sure, pairs = _rest_of_lists(rest, sets, percent)
    more = cut_lineage(_confirmed(_agreeing(pairs, classes), sets, percent))
    return components(comp.select(F.col("id").alias("a"), F.col("component").alias("b"))
                      .unionByName(sure).unionByName(more))


def _rest_of_lists(lists: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links that hold for certain, and the pairs still to be confirmed, of lists ``token, id, n, comp``.

    Each list belongs to its most frequent component, the owner; what more than half of the members of an
    owner's lists hold is the core, and a member differs from it by its delta. The symmetric difference of
    two sets is that of their deltas, so with similarity s two linked sets have
    |da| + |db| - 2 |da & db| <= (|a| + |b|) (1 - s) / (1 + s).
    The excess of a member is |d| - |set| (1 - s) / (1 + s). Two members whose excesses sum to no more than 0 are
    linked without a look; all of these are connected through the member of least excess. All other linked
    pairs share elements of their deltas, so the rarest of them in one order (frequency, element) are
    merged; the place of a common element bounds how many can follow it.
    """
    whole, part = 100 + percent, 100 - percent
    owners = (lists.groupBy("token", "comp").agg((-F.count("*")).alias("less")).groupBy("token")
              .agg(F.min(F.struct("less", "comp"))["comp"].alias("owner")))
    members = cut_lineage(lists.join(owners, "token").select("owner", "id", "n", "comp").distinct())
    full = members.join(sets, "id")
    half = members.groupBy("owner").agg((F.count("*") / 2).alias("half"))
    core = (full.select("owner", F.explode("hashes").alias("e")).groupBy("owner", "e").agg(F.count("*").alias("f"))
            .join(half, "owner").where("f > half").groupBy("owner").agg(F.collect_list("e").alias("core")))
    none = F.array().cast("array<bigint>")
    delta = full.join(core, "owner", "left").withColumn("core", F.coalesce("core", none)).select(
        "owner", "id", "n", "comp",
        F.concat(F.array_except("hashes", "core"), F.array_except("core", "hashes")).alias("delta"))
    delta = cut_lineage(delta.withColumn("d", F.size("delta").cast("long"))
                        .withColumn("excess", F.col("d") * whole - F.col("n") * part))
    nearest = delta.groupBy("owner").agg(F.min(F.struct("excess", "id", "comp")).alias("z"))
    near = F.col("excess") + F.col("z.excess") <= 0
    placed = delta.drop("delta").join(nearest, "owner")
    sure = placed.where(near & (F.col("comp") != F.col("z.comp"))).select(F.col("id").alias("a"), F.col("z.id").alias("b"))
    placed = placed.select("owner", "id", "n", "d", "excess", F.when(near, F.col("z.comp")).otherwise(F.col("comp")).alias("comp"),
                           F.col("z.excess").alias("least"))
    # Of two members in different components one is no member of the owner.
    outside = placed.where("comp <> owner").groupBy("owner").agg(F.min("excess").alias("least_out"))
    elements = delta.select("owner", "id", F.explode("delta").alias("e"))
    known = elements.groupBy("owner", "e").agg(F.count("*").alias("f")).where("f > 1")
    packed = (elements.join(known, ["owner", "e"]).groupBy("owner", "id")
              .agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("t")))
    ranked = (placed.join(outside, "owner").join(packed, ["owner", "id"])
              .select("owner", "id", "n", "d", "excess", "least", "least_out", "comp", (F.col("d") - F.size("t")).alias("own"),
                      F.posexplode("t").alias("i", "x"))
              # How many elements of the delta can be common from here on.
              .select("owner", "id", "n", "excess", "least", "least_out", "comp", F.col("x.e").alias("e"),
                      (F.col("d") - F.col("own") - F.col("i")).alias("left")))
    ranked = cut_lineage(ranked.where(F.col("left") * (2 * whole) >= F.col("excess") + F.least("least", "least_out")))

    def side(x: str, least: str) -> DataFrame:
        return ranked.where(F.col("left") * (2 * whole) >= F.col("excess") + F.col(least)).select(
            "owner", "e", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "excess", "left", "comp")))

    a, b = side("a", "least").where("comp_a <> owner"), side("b", "least_out")
    pairs = a.join(b, ["owner", "e"]).where(
        (F.col("comp_a") != F.col("comp_b")) & ((F.col("comp_b") == F.col("owner")) | (F.col("id_a") < F.col("id_b")))
        & (F.least("left_a", "left_b") * (2 * whole) >= F.col("excess_a") + F.col("excess_b"))
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent))
    return sure, pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def near_components(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = 80) -> DataFrame:
    """One row per document row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when their shingle sets have a Jaccard similarity of at least ``percent``
    hundredths; a component is named by its smallest id, and that document is kept.
    """
    described = cut_lineage(describe(docs, words))
    filled = described.where("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(filled.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"),
                                                        F.first("signature").alias("signature"))
                          .select("set_key", "id", "n", "signature"))
    # An id with several texts belongs to the class of each and so links them.
    several = filled.groupBy("doc_id").agg(F.min("set_key").alias("k1"), F.max("set_key").alias("k2")).where("k1 <> k2")
    known = (filled.join(several.select("doc_id"), "doc_id", "left_semi").join(classes.select("set_key", "id"), "set_key")
             .select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    texts = docs.select(F.col("doc_id").alias("id"), ascii_lower(F.col("text")).alias("text"))
    comp = _linked_classes(classes, texts, cut_lineage(known), words, percent)
    named = classes.select("set_key", "id").join(comp, "id", "left").select(
        "set_key", F.coalesce("component", "id").alias("component_id"))
    joined = described.join(named, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = 80) -> DataFrame:
    """The documents that stay, one per component, with their columns as they are."""
    gone = near_components(docs, words, percent).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
