"""Similarity join of word shingle sets with a prefix tree (operator 8).

Every set is a path of shingle hashes in one global order. Two sets of which one could reach
the threshold share a hash near the start of their paths, so only those starts are shuffled.
Candidates of one document are then sorted as paths: a sorted list of paths is a prefix tree
read depth first. The walk keeps the overlap of every node on the current path, goes on
from where the next path leaves it, and drops a subtree as soon as what is left of either set can
not reach the overlap asked for.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.llm.arrow import column_type, parted, pieces, texts
from pulsegrid.llm.shingles import shingle_sets
from pulsegrid.session import stored

SPOTS = 1 << 23  # bits of the filter of candidates: 1 MB, whatever the input
LANES = 8  # words of 64 bits in a class's parity sketch


def least_overlap(a: int, b: int, percent: int) -> int:
    """Shared shingles from which sets of a and b link: 100 * shared >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _prefix(n: np.ndarray | int, percent: int):
    """Hashes at the start of a path of which a similar set must share at least one."""
    return n - (-(-percent * n // 100)) + 1


def _slack(n: np.ndarray | int):
    """Hashes more than that; so many frequent ones may be left out of a path's start."""
    return n // 20 + 2


def _prefix_slack(n: Column, percent: int) -> Column:
    """Frequent hashes that any similar set, which may be smaller, could leave out as well."""
    return F.floor(F.ceil(n * percent / 100) / 20) + 2


def _parity(own: np.ndarray) -> np.ndarray:
    """For each of 64 * LANES buckets whether an odd number of the set's hashes fall in it.

    Two sketches differ in as many bits as sets differ in hashes, or fewer: equal hashes cancel out.
    """
    odd = np.bincount((own & np.uint64(64 * LANES - 1)).astype(np.int64), minlength=64 * LANES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _least_difference(left: str, right: str) -> Column:
    """Hashes that two sets differ in, at least, by their parity sketches."""
    return sum((F.bit_count(F.col(left)[k].bitwiseXOR(F.col(right)[k])) for k in range(1, LANES)),
               F.bit_count(F.col(left)[0].bitwiseXOR(F.col(right)[0])))


def _classes(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, n, sig, the path's start and the parity sketch of each text; the last two once per class
    and task.

    `sig` digests the whole set, so equal sets are one class, and copies send no paths.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in parted(batches, "text"):
            values = texts(batch, "text")
            for part in pieces(values, 400_000):
                sets = shingle_sets(values[part])
                sizes = np.array([len(s) for s in sets], np.int64)
                sigs = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                starts: list[np.ndarray | None] = []
                sketches: list[np.ndarray | None] = []
                for own, n, sig in zip(sets, sizes.tolist(), sigs.tolist()):
                    if not n or sig in sent:
                        starts.append(None)
                        sketches.append(None)
                        continue
                    if len(sent) < 1_000_000:  # else a copy's start is sent again, and dropped later
                        sent.add(sig)
                    starts.append(own[:_prefix(n, percent) + _slack(n)].view(np.int64))
                    sketches.append(_parity(own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start:part.stop], batch.column(2)[part.start:part.stop], pa.array(sizes), pa.array(sigs),
                     pa.array(starts, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                    names=["id", "text_hash", "n", "sig", "start", "sketch"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    kind = column_type(docs, id_col)
    return rows.mapInArrow(read, f"id {kind}, text_hash long, n long, sig long, start array<bigint>, sketch array<bigint>")


def _spot(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(SPOTS)) + 1


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """sig and the whole set of the wanted classes (first_id, sig), made anew from the texts.

    A bitmap of fixed size keeps most other texts from being hashed again, so no text is
    shuffled; the caller's join by sig drops the rest.
    """
    spots = (wanted.select(_spot("first_id").alias("spot"))
             .groupBy(F.expr("bitmap_bucket_number(spot)").alias("bucket"))
             .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(spot))").alias("bits")))
    width = 32768 // 8
    bits = np.zeros(SPOTS // 8, np.uint8)
    for row in spots.collect():  # SPOTS / 32768 rows at most
        at = (row["bucket"] - 1) * width
        bits[at:at + width] = np.frombuffer(bytes(row["bits"]), np.uint8)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches, "text"):
            spot = batch.column(0).to_numpy() - 1
            own = np.flatnonzero(bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
            values = texts(batch.take(pa.array(own)), "text")
            for part in pieces(values, 400_000):
                sets = shingle_sets(values[part])
                sigs = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sigs), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["sig", "path"])

    rows = docs.select(_spot(id_col).alias("spot"), F.col(text_col).alias("text"))
    return rows.mapInArrow(read, "sig long, path array<bigint>")


class PathWalk:
    """Overlap of one set with many, given as sorted paths that share their starts."""

    STEP = 64

    def __init__(self, probe: np.ndarray, percent: int):
        self.probe, self.percent = probe, percent
        self.path = np.empty(0, np.uint64)
        self.overlap = np.zeros(1, np.int64)  # of the first d hashes of the path

    def similar(self, path: np.ndarray) -> bool:
        need = least_overlap(len(self.probe), len(path), self.percent)
        shared = min(len(path), len(self.path), len(self.overlap) - 1)
        differs = np.flatnonzero(path[:shared] != self.path[:shared])
        depth = int(differs[0]) if len(differs) else shared
        overlap = self.overlap[:depth + 1]
        self.path = path
        while True:
            reached = int(overlap[depth])
            after = int(np.searchsorted(self.probe, path[depth])) if depth < len(path) else len(self.probe)
            if reached + min(len(path) - depth, len(self.probe) - after) < need:
                self.overlap = overlap
                return False
            if depth == len(path):
                self.overlap = overlap
                return reached >= need
            step = path[depth:depth + self.STEP]
            at = np.minimum(np.searchsorted(self.probe, step), len(self.probe) - 1)
            overlap = np.concatenate([overlap, reached + np.cumsum(self.probe[at] == step)])
            depth += len(step)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, per_task: int = 2_000) -> DataFrame:
    """Of the pairs (a, b) of classes, those whose sets link.

    All partners of a probe are walked together, in parts of about `per_task` when there are more.
    Sets meet probes and partners in one join, so each is shuffled by sig once.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("partners"))
    parts = counts.select("a", F.ceil(F.col("partners") / per_task).alias("parts"))
    split = F.pmod(F.xxhash64("b"), F.col("parts"))
    partners = (pairs.join(parts, "a").withColumn("part", split)
                .select("a", "part", F.lit(1).alias("kind"), F.col("b").alias("sig")))
    probes = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                          F.lit(0).alias("kind"), F.col("a").alias("sig"))
    dealt = (probes.unionByName(partners).join(sets, "sig").repartition("a", "part")
             .sortWithinPartitions("a", "part", "kind", "path").select("a", "kind", F.col("sig").alias("b"), "path"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            kinds, paths = batch.column(1).to_pylist(), batch.column(3)
            links: list[tuple[int, int]] = []
            for row in range(len(a)):
                path = paths[row].values.to_numpy().view(np.uint64)
                if kinds[row] == 0:
                    now = PathWalk(path, percent)
                elif now.similar(path):
                    links.append((a[row], b[row]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in list(zip(*links)) or [[], []]], names=["a", "b"])

    return dealt.mapInArrow(walk, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and the smallest node it is linked with, for the nodes of the links (a, b).

    Large and small stars in turn: each node hands its larger neighbours, then its smaller
    ones, over to the smallest it knows. Stops when nothing changes, in logarithmically many
    rounds; each is a written table.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(smallest, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        edges = stored(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _shared(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes in different components, with how many hashes of their starts they share and must share.

    Only pairs whose sizes and sketches allow a link meet. Both sides need the same columns of the same
    rows, so one shuffle serves them.
    """
    of_hash = Window.partitionBy("tok")
    rows = (rows.withColumn("c0", F.min("comp").over(of_hash)).withColumn("c1", F.max("comp").over(of_hash))
            .where("c0 <> c1").drop("c0", "c1"))
    left = rows.select("tok", "by_df", F.col("sig").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"),
                       F.col("often").alias("often_a"), F.col("full").alias("full_a"), F.col("pos").alias("pa"),
                       F.col("known").alias("ka"), F.col("sketch").alias("sa"))
    right = rows.select("tok", F.col("by_df").alias("by_df_b"), F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"),
                        F.col("often").alias("often_b"), F.col("full").alias("full_b"), F.col("pos").alias("pb"),
                        F.col("known").alias("kb"), F.col("sketch").alias("sb"))
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    # What may be shared before this hash, and from it on.
    most = F.least("ka", "kb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    # In an order that leaves out none, the first hash that a pair shares has all the others behind it.
    first = (F.col("pa") <= F.col("na") - need) & (F.col("pb") <= F.col("nb") - need)
    # Else both starts are longer, and hold some that were left out of one of them.
    slack = F.least(F.floor(F.col("na") / 20), F.floor(F.col("nb") / 20)) + 3
    asked = F.when(F.col("by_df"), 1).otherwise(F.greatest(F.lit(1), slack - F.least("often_a", "often_b")))
    return (left.join(right, "tok")
            .where((F.col("ca") != F.col("cb")) & (F.col("by_df") == F.col("by_df_b")) & (F.col("a") < F.col("b")) & (most >= need)
                   & F.when(F.col("by_df"), first).otherwise(~(F.col("full_a") & F.col("full_b")))
                   & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
                   & (_least_difference("sa", "sb") <= F.col("na") + F.col("nb") - 2 * need))
            .groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(asked).alias("asked")))


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """Starts of the paths of some classes in the order of frequency among them, the rarest first.

    They are as long as the others, so two similar classes share as many hashes in them.
    """
    rows = (sets.select("sig", F.size("path").cast("long").alias("n"), F.explode("path").alias("hash"))
            .repartition("hash").groupBy("hash", "sig", "n").agg(F.lit(True).alias("by_df"))
            .withColumn("df", F.count("*").over(Window.partitionBy("hash"))))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 + F.floor(F.col("n") / 20) + 2
    place = F.row_number().over(Window.partitionBy("sig").orderBy("df", "hash")) - 1
    own = F.count(F.when(F.col("df") == 1, 1)).over(Window.partitionBy("sig"))  # no other class has them
    return (rows.withColumn("pos", place).withColumn("known", F.col("pos") - own)
            .where((F.col("pos") < length) & (F.col("df") > 1))
            .select(F.xxhash64("hash", F.lit("by df")).alias("tok"), "sig", "n", "pos", "known", "df", "by_df"))


def _stars(meet: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the most typical class under a hash with the others there that could link to it."""
    ends = meet.groupBy("tok").agg(F.max_by("sig", "typical").alias("a"), F.min("sig").alias("low"),
                                   F.max("sig").alias("high")).where("low <> high").select("tok", "a")
    one, other = (classes.select(F.col("sig").alias(sig), F.col("n").alias(n), F.col("sketch").alias(sketch))
                  for sig, n, sketch in (("a", "na", "sa"), ("b", "nb", "sb")))
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    return (meet.join(ends, "tok").where("a <> sig")
            .groupBy("a", F.col("sig").alias("b")).agg(F.count("*").alias("met"), F.min("n").alias("size"))
            # A link shares many hashes; a pair under few may wait for step 4.
            .where(F.col("met") >= F.greatest(F.lit(1), F.floor(F.col("size") / 80)))
            .groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
            .agg(F.max_by("a", "met").alias("a"))
            .select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))
            .join(one, "a").join(other, "b")
            .where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
                   & (_least_difference("sa", "sb") <= F.col("na") + F.col("nb") - 2 * need))
            .select("a", "b"))


def linked_weights(paths: list[np.ndarray], sides: np.ndarray | None, weights: np.ndarray, percent: int) -> np.ndarray:
    """For each set the sum of the weights of the sets it links with; with sides, of those on the other one.

    Hashes in many sets are counted by a matrix product, the others pair by pair.
    """
    size = len(paths)
    lengths = np.array([len(p) for p in paths], np.int64)
    _, column, df = np.unique(np.concatenate(paths), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    row = np.repeat(np.arange(size), lengths)[order]  # by hash
    first = np.cumsum(df) - df
    shared = np.zeros((size, size), np.float32)  # whole numbers, exact to 2^24
    few = min(32, size // 14)
    for count in np.unique(df[(df > 1) & (df <= few)]).tolist():
        rows = row[first[df == count][:, None] + np.arange(count)]
        np.add.at(shared.reshape(-1), (rows[:, :, None] * size + rows[:, None, :]).ravel(), np.float32(1))
    many = np.flatnonzero(df > max(few, 1))
    for at in range(0, len(many), 2_048):
        own = many[at:at + 2_048]
        table = np.zeros((size, len(own)), np.float32)
        for k, column_of in enumerate(own.tolist()):
            table[row[first[column_of]:first[column_of] + df[column_of]], k] = 1
        shared += table @ table.T
    links = (100 + percent) * shared.astype(np.int64) >= percent * (lengths[:, None] + lengths)
    if sides is None:
        np.fill_diagonal(links, False)
    else:
        links &= sides[:, None] != sides
    return links @ weights


def _linked(docs: DataFrame, members: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """sig and how many documents of other classes link with it, of all classes (sig, first_id, size) of some components.

    A component (root) is dealt into `blocks`; each two of them, and each with itself, are compared
    in one place, so that there are rows for sets and blocks but never for pairs.
    """
    block = F.pmod(F.xxhash64("sig"), F.col("blocks"))
    own = (members.withColumn("block", block)
           .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
           .select("sig", "root", "size", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                   (F.col("block") > F.col("other")).cast("int").alias("side")))
    dealt = (own.join(_sets_of(docs, members, id_col, text_col), "sig").repartition("root", "low", "high")
             .sortWithinPartitions("root", "low", "high").select("root", "low", "high", "sig", "size", "side", "path"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(key: tuple[int, int, int], held: dict[int, tuple]) -> pa.RecordBatch:
            weights, sides, paths = zip(*held.values())
            found = linked_weights(list(paths), None if key[1] == key[2] else np.array(sides),
                                   np.array(weights, np.int64), percent)
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(found, pa.int64())],
                                              names=["sig", "linked"])

        now, held = None, {}
        for batch in batches:
            roots, lows, highs, sigs, weights, sides = (batch.column(c).to_pylist() for c in range(6))
            for at, key in enumerate(zip(roots, lows, highs)):
                if key != now and held:
                    yield counted(now, held)
                    held = {}
                now = key
                # copies of a text may come with it
                held.setdefault(sigs[at], (weights[at], sides[at], batch.column(6)[at].values.to_numpy().view(np.uint64)))
        if held:
            yield counted(now, held)

    return dealt.mapInArrow(count, "sig long, linked long").groupBy("sig").agg(F.sum("linked").alias("linked"))


def link_documents(docs: DataFrame, percent: int = 80, frequent: int = 64, id_col: str = "doc_id",
                   text_col: str = "text", count_links: bool = True, per_block: int = 1_000,
                   name_rows: bool = False) -> DataFrame:
    """Class every document by what it links to: id_col, n_shingles, component_id, n_links if `count_links`;
    with `name_rows` also text_hash and root, which tell rows of one id and components apart.

    Documents link when 100 times the shingles they share are at least `percent` times those
    of their union. component_id is the smallest id reachable by links; n_links is the number of other
    documents that this one links with, copies included. Other columns are not kept.

    Null and empty texts have no shingles and link with nothing; rows that repeat an id are one
    document's; a null id is never the smallest one unless all of its class are null.

    1. Equal sets are one class. Each class sends the start of its path, in the order of
       the hashes: the prefix that a similar set must meet, and some more.
    2. Hashes in more than `frequent` classes are left out of a start that has few enough of
       them: it is so long that a similar set still shares another hash. Classes with more of them
       meet each other by their whole paths, in the order of frequency, the rarest first.
    3. Each class is walked against the most typical class under the same hash, that with the
       most frequent hashes: of copies of one text it is the text. That is linear, and connects
       groups of copies of any size. Pairs whose parity sketches differ in more bits than
       the sets may differ in hashes are not walked, here and below.
    4. Classes under one hash that are still in different components are compared in full: all pairs whose
       shared hashes are as many as a link needs.
    5. Links lie inside components. Where there are two classes they link; in components of more all sets
       are compared, in blocks of about `per_block` classes.
    """
    known = stored(_classes(docs, percent, id_col, text_col), "classes")
    lanes = [F.max(F.col("sketch")[k]).alias(f"lane{k}") for k in range(LANES)]
    classes = stored(known.where("n > 0").groupBy("sig", "n").agg(F.min("id").alias("first_id"), *lanes)
                     .select("sig", "n", "first_id", F.array(*(f"lane{k}" for k in range(LANES))).alias("sketch")),
                     "distinct-classes")
    rows = (known.where("start is not null").select("sig", "n", F.posexplode("start").alias("pos", "tok"))
            .repartition("tok").groupBy("tok", "sig", "n").agg(F.min("pos").alias("pos"))
            .withColumn("df", F.count("*").over(Window.partitionBy("tok"))).where("df > 1"))
    shared = stored(rows, "shared-hashes")
    # Frequent hashes of a class, and whether they are too many to leave out.
    often = shared.where(F.col("df") > frequent).groupBy("sig", "n").agg(F.count("*").alias("often"))
    often = stored(often.withColumn("full", F.col("often") > _prefix_slack(F.col("n"), percent)), "often")
    full = stored(often.where("full").join(classes.select("sig", "first_id"), "sig").select("sig", "first_id"), "full")
    full_sets = _sets_of(docs, full, id_col, text_col).join(full.select("sig"), "sig", "left_semi")
    by_df = _rare_first(full_sets, percent)
    by_hash = shared.where(F.col("df") <= frequent).withColumn("by_df", F.lit(False)).withColumn("known", F.col("pos"))
    meet = by_hash.unionByName(by_df)
    # Copies of a text have hashes that it has not; the text itself has but frequent ones.
    typical = meet.groupBy("sig").agg((F.avg("df") + F.pmod("sig", F.lit(1000)) / 1e6).alias("typical"))
    meet = stored(meet.join(typical, "sig"), "meetings")

    checked = stored(_stars(meet, classes, percent), "stars-to-check")
    links = _check(docs, checked, classes, percent, id_col, text_col)
    found = components(links)
    labelled = (meet.drop("typical").join(found.withColumnRenamed("node", "sig"), "sig", "left")
                .withColumn("comp", F.coalesce("root", "sig")).drop("root")
                .join(often.select("sig", "often", "full"), "sig", "left").join(classes.select("sig", "sketch"), "sig")
                .withColumn("often", F.coalesce("often", F.lit(0).cast("long")))
                .withColumn("full", F.coalesce("full", F.lit(False))))
    labelled = stored(labelled, "labelled")
    checked = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = (_shared(labelled, percent).where("shared >= asked").select("a", "b")
            .join(checked, ["a", "b"], "left_anti"))
    rest = stored(rest, "pairs-to-check")
    links = stored(links.unionByName(_check(docs, rest, classes, percent, id_col, text_col)), "all-links")
    found = stored(components(links), "components")

    rooted = (classes.drop("sketch").join(found.withColumnRenamed("node", "sig"), "sig", "left")
              .withColumn("root", F.coalesce("root", "sig")))
    own = known.select("id", "text_hash", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
    wanted = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")]
    named = ["text_hash", "root"] if name_rows else []
    if not count_links:
        least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
        return own.join(rooted.join(least, "root").select("sig", "root", "component_id"), "sig", "left").select(*wanted, *named)

    ids = own.where("n > 0").groupBy("sig", "id").agg(F.count("*").alias("rows"))
    sizes = ids.groupBy("sig").agg(F.sum(F.when(F.col("id").isNull(), F.col("rows")).otherwise(1)).alias("size"))
    rooted = rooted.join(sizes, "sig")
    whole = rooted.groupBy("root").agg(
        F.min("first_id").alias("component_id"), F.count("*").alias("n_classes"), F.sum("size").alias("n_docs"),
        F.greatest(F.ceil(F.count("*") / per_block), F.ceil(F.sum("n") / (400 * per_block))).alias("blocks"))
    of_class = stored(rooted.join(whole, "root"), "components-of-classes")
    linked = _linked(docs, of_class.where("n_classes > 2"), percent, id_col, text_col)
    of_class = of_class.join(linked, "sig", "left").select("sig", "root", "component_id", (F.col("size") - 1 + F.when(
        F.col("n_classes") > 2, F.col("linked")).otherwise(F.col("n_docs") - F.col("size"))).alias("n_links"))
    return own.join(of_class, "sig", "left").select(*wanted, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *named)


def _check(docs: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int, id_col: str,
           text_col: str) -> DataFrame:
    """The linked pairs among some pairs of classes, as a written table."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
                    .join(classes, "sig").select("sig", "first_id"), "wanted")
    return stored(_verified(pairs, _sets_of(docs, wanted, id_col, text_col), percent), "links")


def keep_one(docs: DataFrame, linked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, one with its smallest id, with all its columns.

    `linked` is what `link_documents` gives with `name_rows`. An id may repeat with other texts: each
    row goes by the component of its own text, so a text that links with nothing kept stays, whatever
    its id. Of rows with the smallest id in one component one stays, by a hash of the text; of rows
    without words that repeat an id one stays. Rows with a null id all stay.
    """
    first = (linked.where(F.col(id_col) == F.col("component_id")).groupBy(id_col, "root")
             .agg(F.min("text_hash").alias("_text_hash")).select(id_col, "_text_hash").distinct())
    turn = F.row_number().over(Window.partitionBy(id_col, "_text_hash").orderBy("_text_hash"))
    kept = (docs.withColumn("_text_hash", F.xxhash64(text_col)).join(first, [id_col, "_text_hash"], "left_semi")
            .withColumn("_turn", turn).where("_turn = 1").select(*(F.col(f"`{c}`") for c in docs.columns)))
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
