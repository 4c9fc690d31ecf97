"""N-gram Jaccard join with token-combination prefixes.

Documents are sets of 5-word shingles; equal sets form one class, and one
document stands for it.  Two classes link when their sets' Jaccard similarity
reaches 0.8; the operator returns the links it needs and the components.

Candidates.  Shingles have one global order: those that repeat (found by
counting all documents) come last, the frequent classes at the very end.  With
q = n - ceil(0.8 n), two sets that link share a shingle among the first q + 1
of both.  If that one is rare, its single-token key finds the pair.  If it is
frequent, all shared ones are; then q' + 1 shared ones lie in the prefixes
extended to 2q + 1, so close together that two successive shared ones are at
most GAP apart in both sets: the key of that 2-combination finds the pair.  Rare
shingles are indexed alone, frequent ones only in such combinations.

Pairs.  All pairs within a key are never made.  Each key links its members to
one leader (the member with the fewest rare shingles); links merge components;
only keys whose members are still in several components go on, with another
leader.  Then the members of a key of up to ``FEW``, and after
``ROUNDS`` of all others, are compared in pairs of blocks of about ``BLOCK``
members, those in different components only, by size and parity bits: only the
pairs that these leave become rows.  So every pair that could join two
components is compared, and the components are exact.  Verification compares
whole sets.  ``every_link`` compares all members of a key and returns each link
of two classes, whatever their components.

Defined results: null text or one without words has an empty set, links with
nothing and is its own component; with fewer than five words the whole
sequence is the one shingle; repeated ids count as one document; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import checkpoint, lean_batches, release, tidy
from orrery.llm.components import components
from orrery.llm.shingles import mix, shingle_lists

# The contract's threshold, 80 of 100.
NUMER, DENOM = 8, 10
GAP = 4
#: Repeated shingles come after all others, by their counts; those counted so often are the frequent class.
FREQUENT = 200
#: Counts of at most so many shingles, the most frequent, are known; the order of the others is their hash.
COUNTS_KEPT = 1 << 18
#: Keys with at most so many members end with pairs at once.
FEW = 4096
ROUNDS = 4
#: Members of a key in one block; a task compares two blocks at a time.
BLOCK = 1024
#: Pairs that a task remembers; beyond that it starts anew, and tells some twice.
TOLD = 100_000
FILTER_BITS_A_DOC, FILTER_BITS_MOST = 16, 1 << 27


def missing(n: int) -> int:
    """Shingles that a set of ``n`` may lack in the other set of a link."""
    return n - -(-NUMER * n // DENOM)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted set of each text."""
    for found in shingle_lists(texts):
        found = np.sort(found)
        yield found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def class_of(tokens: np.ndarray) -> int:
    """63 bits of the set's hash; a class is named by these and its size."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1


def _batch(schema: dict, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[k], v) for k, v in schema.items()], list(schema))


_SEEN = {k: pa.int64() for k in ("doc_id", "n", "cls", "token", "count")} | {"parity": pa.list_(pa.int64())}
SEEN = "doc_id bigint, n bigint, cls bigint, token bigint, count bigint, parity array<bigint>"


def parities(tokens: np.ndarray) -> np.ndarray:
    """Parity of the set's hashes in each of 512 or more ranges, more than it has shingles.

    Two sets differ in as many shingles as their parities differ in bits, at least.
    """
    bits = max(9, (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _classes(lot: int = 2_000_000, least: int = 3):
    """A row per document, and a row per shingle that ``least`` documents of a lot hold."""

    def frequent(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        tokens, counts = tokens[counts >= least].view(np.int64), counts[counts >= least]
        none = pa.nulls(len(tokens), pa.int64())
        return _batch(_SEEN, doc_id=none, n=none, cls=none, token=tokens, count=counts, parity=pa.nulls(len(tokens), _SEEN["parity"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            n, cls, parity = [], [], []
            for tokens in shingle_sets(batch.column(1).to_pylist()):
                n.append(len(tokens))
                cls.append(class_of(tokens))
                parity.append(parities(tokens))
                held.append(tokens)
                size += len(tokens)
                if size >= lot:
                    yield frequent(held)
                    held, size = [], 0
            none = pa.nulls(len(n), pa.int64())
            yield _batch(_SEEN, doc_id=batch.column(0), n=n, cls=cls, token=none, count=none, parity=parity)
        if held:
            yield frequent(held)

    return tidy(run)


_KEYS = {"key": pa.int64(), "cls": pa.int64(), "n": pa.int32(), "prio": pa.int32(), "combined": pa.bool_()}
KEYS = "key bigint, cls bigint, n int, prio int, combined boolean"


def prefix_keys(tokens: np.ndarray, counted: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Single keys, combined keys, and the rare shingles per 1000 of the set."""
    n = len(tokens)
    q = missing(n)
    count = np.zeros(n, np.int64)
    if len(counted):
        at = np.minimum(np.searchsorted(counted, tokens), len(counted) - 1)
        count = np.where(counted[at] == tokens, counts[at], 0)
    order = np.argsort(count, kind="stable")
    n_rare = int((count < FREQUENT).sum())
    prio = n_rare * 1000 // n
    none = np.empty(0, np.uint64)
    if n < 4:
        return none, none, prio
    if n_rare > q:
        return tokens[order[: q + 1]], none, prio
    # a set of four may lie in one of five: its first two are among the first three there, which are all combined
    last = tokens[order[n_rare : max(2 * q + 1, 2)]]
    pairs = [mix(mix(last[:-g]) + last[g:]) for g in range(1, GAP + 1) if g < len(last)]
    return tokens[order[:n_rare]], np.concatenate(pairs) if pairs else none, prio


def _keys(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            keys, cls, sizes, prios, combined = [], [], [], [], []

            def flush():
                reps = [len(k) for k in keys]
                every = np.concatenate(keys).view(np.int64)
                repeat = lambda x, t: np.repeat(np.array(x, t), reps)
                return _batch(_KEYS, key=every, cls=repeat(cls, np.int64), n=repeat(sizes, np.int32), prio=repeat(prios, np.int32), combined=repeat(combined, bool))

            for tokens in shingle_sets(batch.column(0).to_pylist()):
                c = class_of(tokens)
                if not len(tokens) or c in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(c)
                single, pairs, prio = prefix_keys(tokens, counted, counts)
                for found, mark in ((single, False), (pairs, True)):
                    if len(found):
                        keys.append(found)
                        cls.append(c)
                        sizes.append(len(tokens))
                        prios.append(prio)
                        combined.append(mark)
                if sum(map(len, keys[-1:])) > 100_000 or len(keys) >= 500:
                    yield flush()
                    keys, cls, sizes, prios, combined = [], [], [], [], []
            if keys:
                yield flush()

    return tidy(run)


_MEMBERS = {"key": pa.int64(), "cls": pa.int64(), "n": pa.int32(), "lcls": pa.int64(), "ln": pa.int32()}
MEMBERS = "key bigint, cls bigint, n int, lcls bigint, ln int"


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members beyond the first of each key, with the first; rows come sorted by key, prio and class."""
    last = None  # key, class, leader's class and size of the row before
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cls, n = (batch.column(i).to_numpy() for i in range(3))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        same = np.zeros(len(key), bool)
        same[1:] = (cls[1:] == cls[:-1]) & ~new[1:]
        goes_on = last is not None and key[0] == last[0]
        if goes_on:
            new[0], same[0] = False, cls[0] == last[1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        lcls, ln = cls[first], n[first]
        if goes_on:
            lcls, ln = np.where(first < 0, last[2], lcls), np.where(first < 0, last[3], ln)
        member = ~new & ~same & (cls != lcls)
        if member.any():
            yield _batch(_MEMBERS, key=key[member], cls=cls[member], n=n[member], lcls=lcls[member], ln=ln[member])
        last = (key[-1], cls[-1], lcls[-1], ln[-1])


def _folded(parity: np.ndarray) -> np.ndarray:
    """Parities over ranges twice as wide."""
    bits = np.unpackbits(parity.view(np.uint8), axis=1).reshape(len(parity), -1, 2)
    return np.packbits(bits[:, :, 0] ^ bits[:, :, 1], axis=1).view(np.uint64)


def near_pairs(n: np.ndarray, root: np.ndarray, parity: list[np.ndarray], block: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of members in different components, and blocks if given, whose sizes and parities leave room for a link."""
    words = np.array([len(p) for p in parity])
    for size in np.unique(words):
        own = np.flatnonzero(words == size)
        own = own[np.argsort(n[own], kind="stable")]
        mine = np.array([parity[i] for i in own]).view(np.uint64)
        # sets that may link are of like sizes: their parities have as many ranges, or twice as many
        wider = np.flatnonzero(words == 2 * size)
        wider = wider[np.argsort(n[wider], kind="stable")]
        others = [(own, mine)] + ([(wider, _folded(np.array([parity[i] for i in wider])))] if len(wider) else [])
        for other, theirs in others:
            step = max(1, (1 << 21) // (len(other) * int(size)))
            for at in range(0, len(own), step):
                part = slice(at, at + step)
                first = at + 1 if other is own else 0
                last = np.searchsorted(n[other], n[own[part]][-1] * DENOM // NUMER, side="right")
                if first >= last:
                    continue
                differ = np.bitwise_count(mine[part, None] ^ theirs[None, first:last]).sum(axis=2)
                a, b = own[part][:, None], other[None, first:last]
                both = n[a] + n[b]
                fits = (differ * (DENOM + NUMER) <= (DENOM - NUMER) * both) & (root[a] != root[b])
                fits &= DENOM * np.minimum(n[a], n[b]) >= NUMER * np.maximum(n[a], n[b])
                if block is not None:
                    fits &= block[a] != block[b]
                if other is own:
                    fits &= np.arange(first, last)[None] > np.arange(at, at + len(a))[:, None]
                i, j = np.nonzero(fits)
                if len(i):
                    yield a[i, 0], b[0, j]


PAIRED = "a bigint, b bigint, doc_id_a bigint, doc_id_b bigint"


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, lo, hi, block, cls, n, root, doc_id, parity come sorted by key, lo and hi; members of two blocks are compared as they are together.

    A pair shares many keys: a task remembers what it has told.
    """
    told: set[tuple[int, int]] = set()

    def compared(parts: list[list[np.ndarray]], parity: list[np.ndarray], apart: bool) -> Iterator[pa.RecordBatch]:
        block, cls, n, root, doc = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
        for i, j in near_pairs(n, root, parity, block if apart else None):
            swap = cls[i] > cls[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            pairs = list(zip(cls[i].tolist(), cls[j].tolist(), strict=True))
            new = np.array([p not in told for p in pairs])
            if len(told) > TOLD:
                told.clear()
            told.update(pairs)
            i, j = i[new], j[new]
            if not len(i):
                continue
            cols = [pa.array(x, pa.int64()) for x in (cls[i], cls[j], doc[i], doc[j])]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "doc_id_a", "doc_id_b"])

    parts: list[list[np.ndarray]] = []
    parity: list[np.ndarray] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, lo, hi, *cols = (batch.column(k).to_numpy() for k in range(8))
        own = [p.values.to_numpy() for p in batch.column(8)]
        new = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            group = (key[a], lo[a], hi[a])
            if group != last and parts:
                yield from compared(parts, parity, last[1] != last[2])
                parts, parity = [], []
            last = group
            parts.append([c[a:b] for c in cols])
            parity.extend(own[a:b])
    if parts:
        yield from compared(parts, parity, last[1] != last[2])


def in_blocks(rows: DataFrame, size: str) -> DataFrame:
    """Members of keys, once for each pair (lo, hi) of blocks that holds theirs; ``size`` is the column of a key's members."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    placed = rows.withColumn("_blocks", F.greatest(blocks, F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("_blocks")).cast("int"))
    # beyond one block, pairs within a block are told by (block, block)
    each = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return each.withColumn("lo", F.least("block", "_o")).withColumn("hi", F.greatest("block", "_o")).drop("_blocks", "_o")


def _sets(shared):
    """Sets of the documents that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            spot = batch.column(0).to_numpy()
            take = np.flatnonzero((words[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1))
            for lot in np.array_split(take, max(1, len(take) // 200)):
                if len(lot):
                    sets = list(shingle_sets(batch.column(1).take(pa.array(lot)).to_pylist()))
                    cls = pa.array([class_of(x) for x in sets], pa.int64())
                    tokens = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([cls, tokens], ["cls", "tokens"])

    return tidy(run)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            common = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * common >= 80 * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays(
            [c.filter(pa.array(good, pa.bool_())) for c in (batch.column(0), batch.column(1))], ["a", "b"]
        )


def sizes_fit(n: Column, m: Column) -> Column:
    return DENOM * F.least(n, m) >= NUMER * F.greatest(n, m)


def may_link() -> Column:
    """Whether sizes and parities leave room for a link: sets of n and m shingles differ in (n + m) / 9 at most."""
    n, m = F.col("n_a"), F.col("n_b")
    bits = F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(bits, F.lit(0), lambda s, x: s + x)
    # parities over different ranges are not compared
    fits = differ * (DENOM + NUMER) <= (DENOM - NUMER) * (n + m)
    return sizes_fit(n, m) & F.when(F.size("parity_a") == F.size("parity_b"), fits).otherwise(F.lit(True))


class JaccardJoin:
    """The join's parts for one table of documents."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        lean_batches(docs)
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
        seen = self.seen = checkpoint(self.docs.mapInArrow(_classes(), SEEN))
        #: doc_id, n, cls of every row
        self.classes = seen.where("n is not null").select("doc_id", "n", "cls")
        nodes = seen.where("n >= 4").groupBy("cls").agg(
            F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("parity").alias("parity")
        )
        #: cls, the document that stands for it, n and parities of every class that can link to another
        self.nodes = checkpoint(nodes)
        often = seen.where("token is not null").groupBy("token").agg(F.sum("count").alias("count"))
        rows = often.orderBy(F.desc("count"), "token").limit(COUNTS_KEPT).toArrow()
        tokens = rows["token"].to_numpy().view(np.uint64)
        order = np.argsort(tokens)
        #: the repeated shingles, sorted, and their counts
        self.counted = tokens[order], rows["count"].to_numpy()[order]

    def members(self) -> DataFrame:
        """Keys with two classes or more: their members and leader."""
        shared = self.spark.sparkContext.broadcast(self.counted)  # COUNTS_KEPT pairs at most
        keys = self.docs.select("text").mapInArrow(_keys(shared), KEYS)
        single = keys.where(~F.col("combined")).drop("combined").repartition("key").sortWithinPartitions("key", "prio", "cls")
        led = single.select("key", "cls", "n").mapInArrow(tidy(_led), MEMBERS)
        pairs = keys.where("combined").drop("combined")
        lead = pairs.groupBy("key").agg(
            F.min(F.struct("prio", "cls", "n")).alias("l"), F.min("cls").alias("lo"), F.max("cls").alias("hi")
        )
        lead = lead.where("lo <> hi").select("key", F.col("l.cls").alias("lcls"), F.col("l.n").alias("ln"))
        joined = pairs.join(lead, "key").where("cls <> lcls").select("key", "cls", "n", "lcls", "ln").distinct()
        return checkpoint(led.unionByName(joined))

    def sets(self, ids: DataFrame) -> DataFrame:
        """cls, tokens of the documents ``doc_id``, and of a few that a filter lets pass by chance."""
        most = ids.count() * FILTER_BITS_A_DOC
        bits = 1 << 16
        while bits < min(most, FILTER_BITS_MOST):
            bits *= 2
        spot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("s").bitwiseAND(63).cast("int"))
        words = ids.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(one).alias("m")).toArrow()
        held = np.zeros(bits // 64, np.int64)
        held[words["w"].to_numpy()] = words["m"].to_numpy()  # at most FILTER_BITS_MOST / 64 rows
        shared = self.spark.sparkContext.broadcast(held.view(np.uint64))
        # what passes by chance, or twice, is another row that no pair asks for or a pair compared twice
        return self.docs.select(spot.alias("spot"), "text").mapInArrow(_sets(shared), "cls bigint, tokens array<bigint>")

    def described(self, rows: DataFrame, cls: str, mark: str) -> DataFrame:
        """``rows`` with size, parities and document of their class ``cls``, as columns that end in ``mark``."""
        side = self.nodes.select(*(F.col(c).alias(cls if c == "cls" else f"{c}{mark}") for c in self.nodes.columns))
        return rows.join(side, cls)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs ``a``, ``b`` of classes, with their documents, those that link."""
        left = checkpoint(pairs.select("a", "b", "doc_id_a", "doc_id_b").distinct())
        ids = checkpoint(left.select(F.col("doc_id_a").alias("doc_id")).union(left.select("doc_id_b")).distinct())
        if ids.isEmpty():
            return left.select("a", "b")
        sets = checkpoint(self.sets(ids))
        x, y = (sets.select(F.col("cls").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab")
        both = left.join(x, "a").join(y, "b").select("a", "b", "ta", "tb")
        links = checkpoint(both.mapInArrow(tidy(_linked), "a bigint, b bigint"))
        release(sets, ids, left)
        return links

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links ``a``, ``b`` of classes that span every component; ``node``, ``root`` of their ends."""
        members = self.members()
        fit = members.where(sizes_fit(F.col("n"), F.col("ln")))
        ordered = (F.least("cls", "lcls").alias("a"), F.greatest("cls", "lcls").alias("b"))
        pairs = self.described(self.described(fit.select(*ordered).distinct(), "a", "_a"), "b", "_b")
        links = self.verified(pairs.where(may_link()))
        self.found = [links]
        every = members.select("key", "cls", F.lit(False).alias("led")).union(members.select("key", "lcls", F.lit(True)))
        every = every.groupBy("key", "cls").agg(F.max("led").alias("led"))
        roots = components(links)
        waits: list[DataFrame] = []
        for turn in range(ROUNDS + 1):
            last = turn == ROUNDS
            rooted = every.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
            rooted = rooted.withColumn("root", F.coalesce("root", "cls"))
            # done are keys in one component, and those with at most one member that has not led
            waiting = rooted.groupBy("key").agg(
                F.min("root").alias("lo"),
                F.max("root").alias("hi"),
                F.count_if(~F.col("led")).alias("left"),
                F.min(F.when(~F.col("led"), F.struct("cls", "root"))).alias("next"),
            )
            waiting = waiting.where("lo <> hi and left > 1").select("key", "left", "next")
            open_ = checkpoint(rooted.where(~F.col("led")).join(waiting, "key"))
            if open_.isEmpty():
                break
            few = open_.where(F.lit(last) | (F.col("left") <= FEW)).select("key", "cls", "root", F.col("next.cls").alias("near"), "left")
            near = self.compared(few)
            many = open_.where(~F.lit(last) & (F.col("left") > FEW))
            led = many.where(F.col("root") != F.col("next.root"))
            led = led.select(F.least("cls", "next.cls").alias("a"), F.greatest("cls", "next.cls").alias("b")).distinct()
            led = self.described(self.described(led, "a", "_a"), "b", "_b").where(may_link())
            new = self.verified(near.union(led.select("a", "b", "doc_id_a", "doc_id_b")))
            if not new.isEmpty():
                links = links.union(new)
                self.found.append(new)
                release(roots)
                roots = components(links)
            if last or many.isEmpty():
                break
            every = many.select("key", "cls", (F.col("cls") == F.col("next.cls")).alias("led"))
            waits.append(open_)
        release(members, open_, *waits)
        return links, roots

    def compared(self, rows: DataFrame) -> DataFrame:
        """Pairs of members of a key (key, cls, root, near, left) in different components that may link.

        Keys that wait with the same class ``near`` meet in some tasks, which tell a pair once each.
        """
        spread = F.pmod(F.xxhash64("key"), F.lit(max(16, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)))
        placed = in_blocks(rows.join(self.nodes, "cls"), "left")
        sorted_ = placed.repartition("near", "lo", "hi", spread).sortWithinPartitions("key", "lo", "hi")
        return sorted_.select("key", "lo", "hi", "block", "cls", "n", "root", "doc_id", "parity").mapInArrow(tidy(_paired), PAIRED)

    def every_link(self) -> DataFrame:
        """Each link ``a``, ``b`` of two classes, once: as many rows as there are, whatever the components."""
        members = self.members()
        every = members.select("key", "cls").union(members.select("key", F.col("lcls").alias("cls"))).distinct()
        sizes = every.groupBy("key").agg(F.count(F.lit(1)).alias("left"), F.min("cls").alias("near"))
        rows = every.join(sizes, "key").select("key", "cls", F.col("cls").alias("root"), "near", "left")
        links = self.verified(self.compared(rows))
        release(members)
        return links

    def counted_links(self) -> DataFrame:
        """doc_id, n_links: the documents, equal ones too, that each document links with."""
        links = self.every_link()
        held = self.classes.where("n > 0").select("doc_id", "cls").distinct().groupBy("cls").agg(F.count(F.lit(1)).alias("docs"))
        both = links.union(links.select("b", "a"))
        others = both.join(held.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("docs").alias("others"))
        each = held.join(others, "cls", "left").select("cls", (F.col("docs") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        return self.classes.select("doc_id", "cls").distinct().join(each, "cls", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def grouped(self) -> DataFrame:
        """doc_id, n_shingles, component_id: one row per document; a written table, and the only one that stays."""
        _, roots = self.links()
        docs = self.classes.groupBy("doc_id").agg(F.max(F.struct("n", "cls")).alias("c")).select("doc_id", F.col("c.n").alias("n"), F.col("c.cls").alias("cls"))
        rooted = docs.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
        rooted = rooted.withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "cls")))
        least = rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
        # documents without words have no root and stay alone
        found = rooted.join(least, "root", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
        )
        found = checkpoint(found)
        release(roots, self.seen, self.nodes, *self.found)
        return found


def op6_ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    return JaccardJoin(docs).grouped()


def op6_sql() -> str:
    """The same over the view ``documents``, in DuckDB's dialect: sets joined on their shingles, links followed to their ends."""
    cut = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x20\x09-\x0D]+')"
    )
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {cut} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
  lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
c AS (SELECT s, min(doc_id) AS cls, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
t AS (SELECT cls, n, unnest(s) AS t FROM c),
l AS (SELECT a.cls AS a, b.cls AS b FROM t a JOIN t b ON a.t = b.t AND a.cls <> b.cls AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT cls AS a, cls AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS cls, min(b) AS root FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m ON c.cls = m.cls"""
