"""Near-duplicate documents: MinHash with an inverted join on signature coordinates.

1. Every document becomes the set of its word shingles (64-bit hashes) and a MinHash signature of COORDINATES tokens; a token
   is a coordinate together with its value.
2. Documents with equal sets are one class; its smallest id represents it.
3. Representatives are posted under their tokens. Tokens of one document alone can't collide and fall away; the rest are
   ordered by frequency, rarest first. Two documents with MATCHES collisions or more share one of their
   COORDINATES - MATCHES + 1 first tokens (prefix merging), so frequent tokens, as shared passages have, are left out of
   the lists (skip merging) and only counted when a pair's signatures are held against each other.
4. In each list, members are held against a hub instead of each other: the most central one, then others by chance. Links are
   contracted to components, and lists whose members are all connected are done. So a large group of copies costs rows in proportion
   to its size.
5. Members of the lists that are left are many and mostly unlike, as those that share a passage. They are thinned out by a second prefix
   merging, over their full sets with places counted, which leaves out what is connected or can't reach the threshold, and by longer
   sketches of minima; of what meets there, collisions are counted as before.
6. Pairs are confirmed on their full sets.

A token that holds more than one in HOT of all postings (there are fewer than HOT such) is spread over SALTS parts in every join by token.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, released, spread, wrapped

COORDINATES, MATCHES = 24, 10
#: At similarity 0.8 a pair has fewer than 10 of 24 collisions in 6 cases of a million.
PREFIX = COORDINATES - MATCHES + 1
#: Each turn halves, at the least, what a large group of near copies leaves to be merged pair by pair.
HUB_TURNS = 4
#: Hash buckets in which shingles are counted to order them.
SKETCH = 1 << 20
#: Word hashes kept by a task; they are dropped together when there are more.
KNOWN_WORDS = 1 << 18
SALTS = 64
#: Tokens with more than one in so many of all postings are hot; their number has this bound, and so they are broadcast.
HOT = 10_000
#: Bits of the sketch that members of the second merging carry (one of each of so many minima), 64 in a word, and how many
#: standard deviations more bits than expected at the threshold may differ: one pair in a million at the threshold has more.
SKETCH_BITS, SLACK = 512, 4.75
#: Shingles hashed at a time.
BLOCK = 1 << 15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sets of word shingles as sorted arrays of distinct 64-bit hashes."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def _words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # bytes: A-Z alone are lowered, and the split is at space and U+0009 to U+000D
        if not words:
            return np.empty(0, np.uint64)
        hashes = self._words(words)
        width = min(self.width, len(words))
        n = len(words) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = mixed(out + hashes[k : k + n])
        return np.unique(out)


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One token per coordinate: the smallest value of that coordinate's permutation, mixed with the coordinate."""
    blocks = [mixed(shingles[k : k + BLOCK] ^ seeds[:, None]).min(axis=1) for k in range(0, len(shingles), BLOCK)]
    return mixed(np.min(blocks, axis=0) + seeds * np.uint64(3))


def _seeds() -> np.ndarray:
    return mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def rows_of(batches: Iterator[pa.RecordBatch], n: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of n rows at most, so that what is made of one stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, n):
            yield batch.slice(k, n)


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def node_of(shingles: np.ndarray) -> int:
    """The set's 64-bit name."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (the set's name, null for an empty set), tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seeds = Shingler(width), _seeds()
        for batch in rows_of(batches):
            sizes, nodes, tokens = [], [], []
            for text in _texts(batch, "text"):
                found = shingle(text)
                sizes.append(len(found))
                nodes.append(node_of(found) if len(found) else None)
                tokens.append(signature(found, seeds).view(np.int64) if len(found) else None)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "tokens"])
        released()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, node long, tokens array<long>")


def salted(postings: DataFrame, hot: DataFrame) -> DataFrame:
    """Postings (token, id, ...) with parts (SALTS for a hot token, else 1) and salt, one of these."""
    met = postings.join(F.broadcast(hot.select("token", F.lit(SALTS).alias("parts"))), "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return met.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))


def in_parts(tokens: DataFrame) -> DataFrame:
    """One row of (token, parts, ...) for each of its salts."""
    return tokens.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")).drop("parts")


def prefix_lists(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(token, id, central, parts, salt): each representative under its first tokens, in order of frequency. central: the frequencies of its tokens, summed."""
    posted = reps.select("id", F.explode("tokens").alias("token"))
    shared = scratch.put(posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "frequent")
    hot = shared.filter(F.col("df") * HOT > reps.count() * COORDINATES)
    spread = in_parts(shared.join(F.broadcast(hot.select("token", F.lit(SALTS).alias("parts"))), "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1))))
    ranked = salted(posted, hot).join(spread, ["token", "salt"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token", "parts", "salt"))).alias("shared"), F.sum("df").alias("central"))
    kept = ranked.filter(F.size("shared") >= MATCHES).select("id", "central", F.expr(f"slice(shared, 1, size(shared) - {MATCHES - 1})").alias("first"))
    return kept.select("id", "central", F.explode("first").alias("f")).select("f.token", "id", "central", "f.parts", "f.salt")


def with_component(rows: DataFrame, parents: DataFrame | None) -> DataFrame:
    """`rows` (with id) and comp."""
    if parents is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(parents, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")


def unmerged(lists: DataFrame) -> DataFrame:
    """The lists whose members stand in several components."""
    several = lists.groupBy("token", "parts").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("token", "parts")
    return lists.join(in_parts(several), ["token", "salt"], "left_semi")


def hub_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """(a, b): every member of a list against one hub: first the most central, then one by chance; connected pairs are left out."""
    order = -F.col("central") if turn == 0 else F.xxhash64(F.lit(turn), "id")
    hubs = lists.groupBy("token", "parts").agg(F.min(F.struct(order.alias("o"), F.col("id").alias("hub"), F.col("comp").alias("hub_comp"))).alias("h")).select("token", "parts", "h.hub", "h.hub_comp")
    met = lists.join(in_parts(hubs), ["token", "salt"]).filter("comp != hub_comp")
    return met.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def colliding(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs with MATCHES equal tokens or more whose sizes admit the threshold.

    Here and below, what grows with the corpus is merged at any size, so that a plan for few rows is the plan for many.
    """
    tokens = reps.select("id", "tokens", "n_shingles")
    left = pairs.hint("merge").join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("ta"), F.col("n_shingles").alias("na")), "a")
    both = left.hint("merge").join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("tb"), F.col("n_shingles").alias("nb")), "b")
    near = F.aggregate(F.zip_with("ta", "tb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v) >= MATCHES
    return both.filter(near & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "b")


def sets_of(ids: DataFrame, reps: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles): the full sets of the named representatives, made anew from their texts."""
    wanted = reps.select("id", "doc_id").join(ids, "id", "left_semi")
    # the names grow with the corpus, so they are merged at any size instead of being broadcast while they are few
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in rows_of(batches):
            ids = batch.column(0).to_pylist()
            found = [shingle(text) for text in _texts(batch, "text")]
            own = [k for k, x in enumerate(found) if node_of(x) == ids[k]]  # not another row with the representative's doc_id
            yield pa.record_batch([pa.array([ids[k] for k in own], pa.int64()), pa.array([found[k].tobytes() for k in own], pa.binary())], ["id", "shingles"])
        released()

    return texts.mapInArrow(run, "id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    b's set goes to a as hub, which spreads over SALTS parts where it has many partners; sorted by part with the hub
    first, a task holds one hub's set at a time.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    roles = dealt.select(F.col("b").alias("id"), F.col("a").alias("hub"), "salt").unionByName(dealt.select(F.col("a").alias("id"), F.col("a").alias("hub"), "salt").distinct())
    sent = sets.join(roles.hint("merge"), "id").select("hub", "salt", "id", "shingles")
    placed = sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("id") != F.col("hub"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, np.uint64)
        for batch in rows_of(batches):
            a, b = [], []
            for hub, salt, i, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                found = np.frombuffer(data, np.uint64)
                if i == hub:
                    at, own = (hub, salt), found
                    continue
                assert at == (hub, salt), "a hub's set comes before its partners'"
                both = np.concatenate((own, found))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    a.append(hub)
                    b.append(i)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        released()

    return placed.mapInArrow(compare, "a long, b long")


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The last bits of SKETCH_BITS minima, as 64-bit words. Two sets differ in a bit with half their Jaccard distance."""
    seeds = mixed(np.arange(1, SKETCH_BITS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    blocks = [mixed(shingles[k : k + 1024] ^ seeds[:, None]).min(axis=1) for k in range(0, len(shingles), 1024)]
    bits = (np.min(blocks, axis=0) >> np.uint64(40)).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall into each of SKETCH hash buckets: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                x = np.frombuffer(b"".join(batch.column(0)[k : k + 256].to_pylist()), np.uint64)
                total += np.bincount((x % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    table = sets.select("shingles").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def set_pairs(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of (id, comp) members in different components whose full sets may reach the threshold.

    Prefix merging on the sets themselves: with all shingles in one order, rare ones first, a pair at the threshold has a first common
    shingle, and what is left after it in both sets must be enough for the overlap. Its place in the smaller set is
    bounded by the overlap of sets of its own size, in the larger by that of the smallest admitted.
    """
    own = members.hint("merge").join(sets, "id")
    shared = scratch.share(frequencies(own))
    words = SKETCH_BITS // 64
    names = [f"b{k}" for k in range(words)]
    apart = (1 - percent / 100) / 2
    most = int(SKETCH_BITS * apart + SLACK * (SKETCH_BITS * apart * (1 - apart)) ** 0.5) + 1
    differ = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in rows_of(batches, 128):
            out = [[], [], [], [], []]
            sketches = [np.empty((0, words), np.int64)]
            for i, comp, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x = np.frombuffer(data, np.uint64)
                n = len(x)
                first = n + percent * n // -100 + 1  # n - ceil(percent n / 100) + 1
                order = np.lexsort((x, often[(x % np.uint64(SKETCH)).astype(np.int64)]))[:first]
                out[0] += x[order].view(np.int64).tolist()
                out[1] += [i] * first
                out[2] += [comp] * first
                out[3] += [n] * first
                out[4] += range(1, first + 1)
                sketches.append(np.tile(sketch(x), (first, 1)))
            marks = np.concatenate(sketches)
            yield pa.record_batch([*[pa.array(c, pa.int64()) for c in out], *[pa.array(marks[:, k]) for k in range(words)]], ["token", "id", "comp", "n", "at", *names])
        released()

    listed = own.select("id", "comp", "shingles").mapInArrow(run, "token long, id long, comp long, n long, at long, " + ", ".join(f"{w} long" for w in names))
    x, y = listed.alias("x"), listed.alias("y")
    need = F.expr(f"({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent}")
    smaller = F.expr(f"x.at <= x.n - ({2 * percent} * x.n + {99 + percent}) div {100 + percent} + 1")
    met = x.filter(smaller).join(
        y,
        (F.col("x.token") == F.col("y.token")) & (F.struct("x.n", "x.id") < F.struct("y.n", "y.id")) & (F.col("x.comp") != F.col("y.comp"))
        & (100 * F.col("x.n") >= percent * F.col("y.n")) & (1 + F.least(F.expr("x.n - x.at"), F.expr("y.n - y.at")) >= need) & (differ <= most),
    )
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def connected(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(id, root): the smallest id that each linked id reaches.

    In each turn, an id hooks to its smallest neighbour if that is smaller; parents are followed twice, links renamed and those inside a
    tree dropped. An id that keeps its name is smaller than all its neighbours, so at least half of the linked ids go in each turn.
    """
    ups, edges = [], links
    while True:
        turn = len(ups)
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("root"))
        up = scratch.put(hooked, f"{label}-hooked-{turn}")
        for _ in range(2):
            up = followed(up, up)
        ups.append(scratch.put(up, f"{label}-up-{turn}"))
        edges = scratch.put(renamed(edges, ups[-1]), f"{label}-edges-{turn}")
        if edges.isEmpty():
            return scratch.put(reduce(followed, ups), f"{label}-parents") if turn else ups[0]


def followed(parents: DataFrame, above: DataFrame) -> DataFrame:
    """`parents` (id, root) with roots that have one in `above` (id, root) replaced by it."""
    return parents.join(above.select(F.col("id").alias("root"), F.col("root").alias("higher")), "root", "left").select("id", F.coalesce("higher", "root").alias("root"))


def renamed(links: DataFrame, parents: DataFrame) -> DataFrame:
    """Links (a, b) between the roots of `links`, without those inside a component."""
    ends = links.join(parents.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left").join(parents.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left")
    a, b = F.coalesce("ra", "a"), F.coalesce("rb", "b")
    return ends.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a != b").distinct()


def merged(parents: DataFrame | None, links: DataFrame, scratch: Scratch, label: str) -> DataFrame | None:
    """`parents` (id, root; None: nothing is linked) after further links. Only components are linked anew, not their members, so what is known isn't found again."""
    fresh = links if parents is None else scratch.put(renamed(links, parents), f"{label}-fresh")
    if fresh.isEmpty():
        return parents
    above = connected(fresh, scratch, label)
    if parents is None:
        return above
    # a root is among the ids on both sides, with the same new root
    return scratch.put(followed(parents, above).unionByName(above).distinct(), f"{label}-merged")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs` (doc_id, text).

    A document's words are lower-cased (A-Z) runs of anything but space and U+0009 to U+000D; fewer words than `width` are one
    shingle, none an empty set, which is linked with nothing. component_id is the smallest doc_id that can be
    reached over links, itself included, and kept says whether it is the own one.
    Null text: an empty set. Null doc_id: linked with nothing, component_id null, kept. Rows that repeat an id are
    one document; where their texts differ, the id links their sets. Other columns are ignored. No rows: no rows.
    What is returned reads two tables of `scratch`.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    signed = scratch.put(signatures(spread(docs.select("doc_id", "text")), width), "signed")
    full = signed.filter("node is not null and doc_id is not null")
    reps = full.groupBy(F.col("node").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"))
    reps = scratch.put(reps, "reps")
    lists = scratch.put(unmerged(with_component(prefix_lists(reps, scratch), None)), "lists").drop("comp")
    sets = scratch.put(sets_of(lists.select("id").distinct(), reps, docs, width), "sets")
    # an id that stands on rows with different sets links them
    several = full.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a != z")
    links = scratch.put(full.join(several, "doc_id").filter("node != a").select("a", F.col("node").alias("b")).distinct(), "same-id")
    parents = merged(None, links, scratch, "cc-ids")
    for turn in range(HUB_TURNS + 1):
        scratch.settle()
        lists = scratch.put(unmerged(with_component(lists, parents)), f"lists-{turn}")
        if lists.isEmpty():
            break
        met = hub_pairs(lists, turn) if turn < HUB_TURNS else scratch.put(set_pairs(lists.select("id", "comp").distinct(), sets, percent, scratch), "met")
        found = scratch.put(confirmed(scratch.put(colliding(met, reps, percent), f"pairs-{turn}"), sets, percent), f"links-{turn}")
        scratch.unshare()
        lists = lists.drop("comp")
        parents = merged(parents, found, scratch, f"cc-{turn}")
    scratch.settle()
    classed = with_component(reps.select("id"), parents)
    smallest = classed.join(reps.select("id", "doc_id"), "id").groupBy("comp").agg(F.min("doc_id").alias("component"))
    named = scratch.put(classed.join(smallest, "comp").select(F.col("id").alias("node"), "component"), "named")
    scratch.drop_all_but("signed", "named")
    return (
        signed.drop("tokens").join(named, "node", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
        .select("doc_id", "n_shingles", "component_id", "kept")
    )


def survivors(docs: DataFrame, width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """The rows of `docs` without those of documents that near_duplicates() doesn't keep, with all their columns, whatever their names.

    Of rows with equal id and text one stays, the first by its JSON; rows of a kept id with other texts stay, so no text is lost.
    Rows without an id stay, those without text too. No rows: no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    judged = scratch.put(near_duplicates(docs, width, percent, scratch), "judged")
    scratch.drop("signed", "named")
    gone = judged.filter("not kept").select("doc_id").distinct()
    repeated = judged.filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    rows = wrapped(docs)
    key = F.col("row.doc_id").cast("long") == F.col("doc_id")
    rest = rows.join(gone, key, "left_anti")
    single = rest.join(repeated, key, "left_anti")
    twice = rest.join(repeated, key, "left_semi").groupBy("row.doc_id", F.md5(F.col("row.text").cast("binary")).alias("text")).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(twice).select("row.*")
