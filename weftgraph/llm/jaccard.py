"""N-gram Jaccard join: prefix filters under several global orders, intersected before verification.

A document is the set of its distinct word n-grams; documents with one set form a class and go on as one. Two sets of
sizes x and y with Jaccard similarity t or more share at least t * max(x, y) tokens, so whatever the global order of
tokens, their prefixes of lengths x - ceil(t x) + l and y - ceil(t y) + l share at least l tokens.

1. Order A is a hash order. Every class emits its prefix; a class stays if at least l of its prefix tokens also stand in the
   prefix of another class. l grows with the set, so a passage that many documents share keeps none of them, unless it makes
   up a good part of the prefix.
2. Order B is another hash order, asked the same of those that stayed. In the third order the tokens that only one class has come
   first: a class with u of them shares at most n - u tokens, and with more than the threshold allows it goes.
3. What is left is listed under the prefix tokens of order C with l = 1. Candidates under a token would be all pairs, so links are found in
   two steps. Each class is first compared with at most two hubs, those with the fewest tokens of their own under most of its
   tokens; the links found join classes to components. Then the pairs under a token that lie in different components are
   compared. Pairs inside a component need no look, since only components are asked for. Of two classes compared with one
   hub, what each shares with it and has beside it bounds what they share with each other. So groups of near copies
   cost a few comparisons each.
4. Sets are compared in blocks of classes, so a set travels once to a block however many of its pairs are there, and in full only if
   the two share a prefix token in A and in B too.

The sets of the classes that stayed after order A are made again from the texts. They are chosen by a bit table of fixed size, as
are those that stay later; what it lets through by chance is sorted out by a join. Classes are named by 64 bits of a digest of their set.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import ODD, TO_LOWER, mixed, slices, span_hashes, text_bytes, words
from weftgraph.operators.components import weak_components
from weftgraph.session import cut

WORDS, PERCENT = 5, 80
BITS = 1 << 26  # of the bit table, 8 MB
PLACES = 3
BLOCK = 1500  # classes on either side of a block of comparisons
FIRST = 12  # tokens by which a pair is found under its first common token
ORDER_B, ORDER_C = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct 64-bit shingles of k words; shorter texts are one shingle, empty ones none."""
    data, offsets = text_bytes(texts)
    data = TO_LOWER[data]
    starts, ends, firsts = words(data, offsets)
    h = span_hashes(data, starts, ends)
    n = max(len(h) - k + 1, 0)
    rolled = np.full(n, k, np.uint64)
    for j in range(k):
        rolled = mixed(rolled + h[j:j + n] * ODD)
    out = []
    for a, z in zip(firsts[:-1], firsts[1:], strict=True):
        if z - a >= k:
            out.append(np.unique(rolled[a:z - k + 1]))
        else:
            short = np.full(min(z - a, 1), z - a, np.uint64)
            for j in range(a, z):
                short = mixed(short + h[j:j + 1] * ODD)
            out.append(short)
    return out


def _class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


class Bounds:
    """Prefix lengths for a threshold of ``percent`` / 100."""

    def __init__(self, percent: int):
        self.percent = percent

    def need(self, n: int) -> int:  # the least overlap of a set of n
        return -(-self.percent * n // 100)

    def shared(self, n: int) -> int:  # l
        return max(1, n // 10)

    def own(self, n: int) -> int:
        return n - self.need(n) + self.shared(n)

    def emitted(self, n: int) -> int:  # long enough for the l of any partner, which has at most n / t tokens
        return min(n, n - self.need(n) + self.shared(n * 100 // self.percent))

    def linked(self, both: int, x: int, y: int) -> bool:
        return 100 * both >= self.percent * (x + y - both)


def _signed(tokens: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(tokens).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_signed(flat), pa.int64()))


def _row_key(c: int, doc) -> int:
    """Where a document of a class is looked up in the bit table."""
    return int.from_bytes(hashlib.blake2b(f"{c} {doc}".encode(), digest_size=8).digest(), "little") >> 1


def _sets(docs: DataFrame, k: int, bounds: Bounds, kind: str) -> DataFrame:
    """(doc_id, n, c, row_key, prefix): size, class and emitted prefix in order A of every document."""

    def built(batches):
        for batch in batches:
            for piece in slices(batch):
                sets = shingles(piece.column(1), k)
                classes = [_class_of(s) for s in sets]
                keys = map(_row_key, classes, piece.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(map(len, sets), pa.int64()), pa.array(classes, pa.int64()),
                     pa.array(keys, pa.int64()), _lists([s[: bounds.emitted(len(s))] for s in sets])],
                    names=["doc_id", "n", "c", "row_key", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(built, f"doc_id {kind}, n long, c long, row_key long, prefix array<long>")


def _meeting(prefixes: DataFrame, bounds: Bounds) -> DataFrame:
    """Of (c, n, prefix): the (c, n) with enough prefix tokens that another class emits too.

    Only tokens are shuffled, combined before the shuffle: a token of one class names the class that has it alone.
    """
    enough = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    own = F.col("n") - F.ceil(bounds.percent * F.col("n") / 100) + enough
    posted = prefixes.select("c", own.alias("own"), F.posexplode("prefix").alias("i", "token"))
    alone = (
        posted.groupBy("token").agg(F.min("c").alias("c"), F.max("c").alias("high"), F.max(F.col("i") < F.col("own")).alias("counts"))
        .where("c = high AND counts").groupBy("c").agg(F.count(F.lit(1)).alias("alone"))
    )
    classes = prefixes.where("n > 0").groupBy("c").agg(F.first("n").alias("n"))
    return classes.join(alone, "c", "left").where(
        F.least(own, F.col("n")) - F.coalesce("alone", F.lit(0)) >= enough).select("c", "n")


def _marked(keys: DataFrame) -> np.ndarray:
    """A table of ``BITS`` bits with ``PLACES`` bits set for each row_key."""
    place = F.explode(F.array(*[F.shiftright("row_key", 18 * i) % BITS + 1 for i in range(PLACES)]))
    rows = (
        keys.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()  # BITS / 8 bytes at most
    )
    table = np.zeros(BITS // 8, np.uint8)
    for row in rows:  # Spark counts bits and buckets from 1
        at = (row.bucket - 1) * len(row.bits)
        table[at:at + len(row.bits)] = np.frombuffer(bytes(row.bits), np.uint8)
    return table


def _is_marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for i in range(PLACES):
        place = (keys >> (18 * i)) % BITS
        out &= (table[place >> 3] >> (place & 7) & 1).astype(bool)
    return out


def _whole_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(c, n, tokens) of the ``wanted`` (c, row_key), one row per class."""
    table = docs.sparkSession.sparkContext.broadcast(_marked(wanted))

    def built(batches):
        for batch in batches:
            for piece in slices(batch):
                sets = shingles(piece.column(1), k)
                classes = [_class_of(s) for s in sets]
                keys = np.fromiter(map(_row_key, classes, piece.column(0).to_pylist()), np.int64, len(sets))
                kept = np.flatnonzero(_is_marked(table.value, keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([classes[i] for i in kept], pa.int64()), pa.array([len(sets[i]) for i in kept], pa.int64()),
                     pa.array([sets[i].tobytes() for i in kept], pa.binary())], names=["c", "n", "tokens"])

    made = docs.select("doc_id", "text").mapInArrow(built, "c long, n long, tokens binary")
    # copies that got through, and rows that stand in the table twice, have the same set
    return made.join(wanted.select("c"), "c", "left_semi").groupBy("c").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))


def _only(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets of ``classes`` (c), and a few others by chance, without a shuffle."""
    table = sets.sparkSession.sparkContext.broadcast(_marked(classes.select(F.shiftrightunsigned("c", 1).alias("row_key"))))

    def chosen(batches):
        for batch in batches:
            keys = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(1)).view(np.int64)
            yield batch.filter(pa.array(_is_marked(table.value, keys)))

    return sets.mapInArrow(chosen, sets.schema)


def _prefixes(sets: DataFrame, change, length) -> DataFrame:
    """(c, n, prefix) with the least tokens of every set under the order ``change`` gives."""

    def built(batches):
        for batch in batches:
            rows = [change(np.frombuffer(t.as_buffer(), np.uint64)) for t in batch.column(2)]
            sizes = [length(len(r)) for r in rows]
            lists = [np.sort(np.partition(r, s - 1)[:s]) if s < len(r) else np.sort(r) for r, s in zip(rows, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(lists)], names=["c", "n", "prefix"])

    return sets.select("c", "n", "tokens").mapInArrow(built, "c long, n long, prefix array<long>")


def _alone(sets: DataFrame) -> DataFrame:
    """(c, u): how many tokens of a set no other of the sets has; no row where there are none."""
    tokens = _prefixes(sets, lambda t: t, lambda n: n).select("c", F.explode("prefix").alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("c")).where("df = 1").groupBy("c").agg(
        F.count(F.lit(1)).alias("u"))


def _sharing(sets: DataFrame, bounds: Bounds) -> DataFrame:
    """(c, u) of the sets that share as many tokens with others as a link needs."""
    return sets.select("c", "n").join(_alone(sets), "c", "left").select("c", "n", F.coalesce("u", F.lit(0)).alias("u")).where(
        F.col("n") - F.col("u") >= F.ceil(bounds.percent * F.col("n") / 100)).select("c", "u")


def _homes(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """(c, side): classes with one first hub on one side of the blocks of comparisons, or on several if they are many."""
    hubs = chosen.select(F.col("hub").alias("c")).distinct().select("c", F.col("c").alias("own"))
    homes = sets.select("c").join(chosen.where("r = 1").select("c", "hub"), "c", "left").join(hubs, "c", "left").select(
        "c", F.coalesce("own", "hub", "c").alias("home"))
    sizes = homes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    groups = max(1, -(-sets.count() // BLOCK))
    part = F.pmod(F.xxhash64("c"), F.col("parts"))
    return homes.join(sizes, "home").select("c", F.pmod(F.xxhash64("home", part), F.lit(groups)).alias("side"))


def _compared(pairs: DataFrame, sets: DataFrame, homes: DataFrame, bounds: Bounds, every: bool) -> DataFrame:
    """(a, b, overlap, linked) of the ``pairs`` (a, b), all of them or only those that share prefix tokens in A and in B."""
    of = lambda c: homes.select(F.col("c").alias(c), F.col("side").alias(f"_{c}"))
    placed = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select(
        "a", "b", F.concat_ws(" ", "_a", "_b").alias("block"))
    asked = placed.select("block", F.col("a").alias("c")).unionByName(placed.select("block", F.col("b").alias("c"))).distinct()
    held = asked.join(sets.select("c", "tokens"), "c").select(F.col("block").alias("of_block"), "c", "tokens")

    def compare(pairs: pa.Table, held: pa.Table) -> pa.Table:
        tokens = {c: np.frombuffer(t.as_buffer(), np.uint64) for c, t in zip(held.column("c").to_pylist(), held.column("tokens"), strict=True)}
        second: dict = {}

        def in_b(c):
            if c not in second:
                z = mixed(tokens[c] ^ ORDER_B)
                s = bounds.own(len(z))
                second[c] = np.partition(z, s)[:s] if s < len(z) else z
            return second[c]

        def worth(a, b, x, y):
            if not bounds.linked(min(len(x), len(y)), len(x), len(y)):
                return False
            if not len(np.intersect1d(x[: bounds.own(len(x))], y[: bounds.own(len(y))], assume_unique=True)):
                return False
            # for small sets the overlap itself is as cheap
            return min(len(x), len(y)) <= 64 or len(np.intersect1d(in_b(a), in_b(b), assume_unique=True)) > 0

        rows = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            x, y = tokens[a], tokens[b]
            if every or worth(a, b, x, y):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                overlap = int((y[at] == x).sum())
                rows.append((a, b, overlap, bounds.linked(overlap, len(x), len(y))))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "overlap", "linked"])

    return placed.groupBy("block").cogroup(held.groupBy("of_block")).applyInArrow(compare, "a long, b long, overlap long, linked boolean")


def _components(links: DataFrame) -> DataFrame:
    """(c, comp) of the classes that have a link."""
    edges = links.select(F.lit("").alias("project_id"), F.col("a").alias("source"), F.col("b").alias("target"))
    nodes = edges.select("project_id", F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return weak_components(nodes, edges).select(F.col("node_id").alias("c"), F.col("component").alias("comp"))


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _need(bounds: Bounds, n, m):
    """The overlap that links sets of n and m tokens."""
    return F.ceil(bounds.percent * (n + m) / (100 + bounds.percent))


def _may_link(bounds: Bounds, n, u, m, v):
    """Whether sets of n and m tokens, u and v of them nobody else's, are near enough in size and share enough."""
    overlap = _need(bounds, n, m)
    return ((100 * n >= bounds.percent * m) & (100 * m >= bounds.percent * n) & (n - u >= overlap) & (m - v >= overlap))


def class_components(docs: DataFrame, k: int, bounds: Bounds) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n, c) of all documents, (c, comp) of the classes with a link to another class)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = cut(_sets(docs, k, bounds, kind))
    stay = _meeting(base, bounds).select("c")
    wanted = cut(base.groupBy("c").agg(F.min("row_key").alias("row_key")).join(stay, "c", "left_semi"))
    sets = cut(_whole_sets(docs, wanted, k))
    sets = _only(sets, cut(_meeting(_prefixes(sets, lambda t: mixed(t ^ ORDER_B), bounds.emitted), bounds)))
    sharing = cut(_sharing(sets, bounds))
    sets = cut(_only(sets, sharing))

    postings = _prefixes(sets, lambda t: mixed(t ^ ORDER_C) >> np.uint64(1), lambda n: n - bounds.need(n) + 1).join(
        sharing, "c").select("c", "n", "u", F.slice("prefix", 1, FIRST).alias("first"), F.explode("prefix").alias("token"))
    postings = cut(postings)
    met = postings.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("token")
    listed = cut(postings.join(met, "token", "left_semi"))

    # sizes that differ by more than the threshold allows never link; a band holds about one such factor
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(bounds.percent / 100)))
    banded = listed.drop("first").withColumn("band", band)
    centre = banded.groupBy("token", "band").agg(
        F.min(F.struct((F.col("u") / F.col("n")).alias("r"), "c", "n", "u")).alias("s"))
    stars = banded.join(centre, ["token", "band"]).where(F.col("c") != F.col("s.c")).where(
        _may_link(bounds, F.col("n"), F.col("u"), F.col("s.n"), F.col("s.u"))).select("c", F.col("s.c").alias("hub"))
    most = Window.partitionBy("c").orderBy(F.desc("times"), "hub")
    chosen = cut(stars.groupBy("c", "hub").agg(F.count(F.lit(1)).alias("times")).withColumn("r", F.row_number().over(most))
                 .where("r <= 2").select("c", "hub", "r", *_pair("c", "hub")))
    homes = cut(_homes(sets, chosen))
    tested = cut(_compared(chosen.select("a", "b").distinct(), sets, homes, bounds, every=True))
    near = chosen.join(tested, ["a", "b"]).select("c", "hub", "overlap").unionByName(
        sets.join(chosen.select(F.col("hub").alias("c")), "c", "left_semi").select("c", F.col("c").alias("hub"), F.col("n").alias("overlap")))
    hubs = near.groupBy("c").agg(F.collect_list(F.struct("hub", "overlap")).alias("hubs"))  # two, and itself

    # one end of every other pair lies outside the component that has most classes under their token
    comps = _components(tested.where("linked"))
    placed = listed.join(comps, "c", "left").join(hubs, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    placed = cut(placed)
    sizes = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("token").agg(F.max_by("comp", F.struct("size", "comp")).alias("most"), F.count(F.lit(1)).alias("parts")).where(
        "parts > 1").select("token", "most")
    open_ = cut(placed.join(largest, "token"))
    other = open_.select(*[F.col(c).alias(f"_{c}") for c in ("token", "c", "n", "u", "first", "comp", "hubs")])
    found_before = F.coalesce(F.array_min(F.array_intersect("first", "_first")) < F.col("token"), F.lit(False))
    need = _need(bounds, F.col("n"), F.col("_n"))
    # shared inside the hub, and outside it among the tokens that are not one class's alone
    reach = lambda x, y: F.least(x["overlap"], y["overlap"]) + F.least(
        F.col("n") - F.col("u") - x["overlap"], F.col("_n") - F.col("_u") - y["overlap"])
    too_far = F.coalesce(F.exists("hubs", lambda x: F.exists("_hubs", lambda y: (x["hub"] == y["hub"]) & (reach(x, y) < need))), F.lit(False))
    rest = open_.where("comp <> most").join(
        other, (F.col("token") == F.col("_token")) & (F.col("comp") != F.col("_comp")) & ((F.col("_comp") == F.col("most")) | (F.col("c") < F.col("_c")))
        & _may_link(bounds, F.col("n"), F.col("u"), F.col("_n"), F.col("_u")) & ~found_before & ~too_far).select(*_pair("c", "_c")).distinct()
    rest = cut(rest.join(tested, ["a", "b"], "left_anti"))
    links = cut(tested.where("linked").select("a", "b").unionByName(
        _compared(rest, sets, homes, bounds, every=False).where("linked").select("a", "b")))
    return base.select("doc_id", "n", "c"), cut(_components(links))


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Documents link when their sets of ``words``-word shingles have a Jaccard similarity of ``percent`` / 100 or more; component_id is the
    smallest doc_id that links lead to. A text without words has no shingles and links with nothing, not with its copies either. Null ids
    take part and are never the smallest, unless there is no other. Repeated rows are copies. Other columns are ignored; an empty table
    gives an empty one.
    """
    base, comps = class_components(docs, words, Bounds(percent))
    named = base.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    smallest = named.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest doc_id stays, nulls last.

    Of repeated ids the text with the smallest hash goes first, and of repeated rows one stays. Every text without words stays.
    """
    place = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(2**63 - 1).cast("decimal(20,0)")).cast("string"), 20, "0")
    key = F.concat_ws("-", F.coalesce(place, F.lit("null")), F.hex(F.xxhash64("text")))
    keyed = docs.withColumn("_key", key)
    found = components(keyed.select(F.col("_key").alias("doc_id"), "text"), words, percent)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    again = Window.partitionBy("_key").orderBy("_key")
    return keyed.join(stay, "_key", "left_semi").withColumn("_again", F.row_number().over(again)).where("_again = 1").select(*docs.columns)
