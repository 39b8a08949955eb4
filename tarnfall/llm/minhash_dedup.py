"""Near-duplicate groups by min-max hashing.

Signatures: under each of PERMUTATIONS hash functions a text's shingle set keeps its
smallest and its largest value, so one evaluation gives two signature values. Bands
of ROWS values, from the smallest or from the largest of ROWS permutations, are
hashed to keys; two texts with Jaccard similarity 0.75 share none of the 60 keys
with a probability of 8e-6. Every link is confirmed on the full sets, as 64-bit hashes.

Groups: texts with equal sets are one node. A bucket (a shared key) first links its
members to its smallest one, its hub: a row a member, not a pair. Components of the
confirmed links follow by alternating large-star and small-star steps. Only buckets
of three or more that then still hold several components are compared further:

* A bucket of more than WIDE members is first dealt into narrower ones, by the rarest
  quarter of each member's shingles: two sets with the least similarity share one of
  them, so nothing is lost. Those have hubs again, and link most of what is left.
* Other buckets, and what the narrower ones leave, are compared block against block and
  without pairs inside a component: a task has two blocks of about BLOCK members or
  BLOCK_VALUES hashes, finds all intersections by a matrix product and gives a spanning
  forest of exact links.

So the bands are the only source of missed links, and no list of pairs is made.

Skew: a key, hub, shingle or set with many members is dealt over salts (``spread_join``),
with the other side repeated once a salt; minima and counts are pre-aggregated.

Defined results: texts with fewer than k words are one shingle; without words the set
is empty and linked with nothing; a null text is empty; a very long text is one set like
any other (its bytes bound the blocks); ids are meant to be unique: rows that share id and
text share a node, of an id with several texts each has its own; a null id is never a
representative, and its group is named by the other ids (null if there are none); empty
tables give no rows; extra columns are carried untouched by ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfall.llm import tokens as K
from tarnfall.llm.common import MAX_BROADCAST_IDS, Scratch, prepare, spread_join, tidy, written

SHINGLE = 5
PERMUTATIONS, ROWS = 180, 6
BANDS = 2 * (PERMUTATIONS // ROWS)
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Members and shingle hashes of a block, about.
BLOCK, BLOCK_VALUES = 256, 1 << 19
#: Buckets with more members are dealt into narrower ones first.
WIDE = 2048

_A = K.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_SALT = K.mix(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(20))


def band_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows x BANDS keys of non-empty sets: values[first[r]:first[r + 1]]."""
    keys = np.empty((len(first), BANDS), np.uint64)
    for g in range(PERMUTATIONS // ROWS):
        low, high = np.repeat(_SALT[2 * g], len(first)), np.repeat(_SALT[2 * g + 1], len(first))
        for a in _A[g * ROWS : (g + 1) * ROWS]:
            v = values * a
            v ^= v >> np.uint64(29)
            low = K.mix(low ^ np.minimum.reduceat(v, first)) * np.uint64(3)
            high = K.mix(high ^ np.maximum.reduceat(v, first)) * np.uint64(3)
        keys[:, 2 * g], keys[:, 2 * g + 1] = low, high
    return keys


def texts(column: pa.Array, k: int) -> Iterator[list[np.ndarray]]:
    offsets, raw = K.utf8(column)
    for a, b in K.slices(offsets):
        yield K.shingles(K.Words(offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]]), k)


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, bool]:
    """A number for each id and text, and whether it is the id itself, as ids are unique."""
    rows, with_id, ids = docs.agg(F.count(F.lit(1)), F.count(id_col), F.count_distinct(id_col)).first()
    if rows == with_id == ids:
        return F.col(id_col).cast("bigint"), True
    return F.xxhash64(F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)), F.col(id_col).isNull(), F.coalesce(F.col(text_col), F.lit(""))), False


def signatures(docs: DataFrame, key: Column, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for sets in texts(b.column(2), k):
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                keys = np.zeros((0, BANDS), np.uint64)
                if len(full):
                    keys = band_keys(np.concatenate(sets), (np.cumsum(size) - size)[full])
                ends = np.concatenate(([0], np.cumsum(np.where(size > 0, BANDS, 0)))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
                prints = pa.array([fingerprint(s) for s in sets], pa.binary())
                ids, own = (b.column(c).slice(at, len(sets)) for c in (0, 1))
                at += len(sets)
                yield pa.RecordBatch.from_arrays([ids, own, pa.array(size), prints, bands], ["id", "own", "n", "print", "bands"])

    schema = "id bigint, own bigint, n bigint, print binary, bands array<bigint>"
    return docs.select(key.alias("id"), F.col(id_col).cast("bigint").alias("own"), text_col).mapInArrow(tidy(run), schema)


def full_sets(docs: DataFrame, key: Column, text_col: str, k: int, ids: DataFrame) -> DataFrame:
    """id, n and s (sorted 64-bit shingle hashes) of the ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for sets in texts(b.column(1), k):
                wide = pa.array([s.tobytes() for s in sets], pa.binary())
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), n, wide], ["id", "n", "s"])
                at += len(sets)

    few = ids.count() <= MAX_BROADCAST_IDS
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return rows.mapInArrow(tidy(run), "id bigint, n bigint, s binary")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, tmp: Scratch) -> DataFrame:
    """The pairs (a, b) that are links. ``a`` may have many partners, ``b`` a few."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    one = sets.select("id", "s")
    fan = tmp.written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("fan")), "fan")
    hubs = fan.join(one.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
    joined = pairs.join(one.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    joined = spread_join(joined, hubs, ["a"], "fan", F.xxhash64("b"))
    return joined.select("a", "b", "x", "y").mapInArrow(tidy(run), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of an edge; component is the smallest id reachable.

    Large-star and small-star steps in turn until nothing changes: each is one
    pre-aggregated minimum and one join, in which nodes with many edges are dealt over
    salts, written to the shared folder."""
    tmp = Scratch(edges.sparkSession)
    edges = tmp.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "star-0")
    state, step = None, 0
    degree = F.count(F.lit(1)).alias("degree")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = tmp.written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), degree), "least")
        large = spread_join(both, least, ["u"], "degree", F.xxhash64("v")).where("v > u")
        large = tmp.written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        least = tmp.written(large.groupBy("u").agg(F.min("v").alias("m"), degree), "least")
        small = spread_join(large, least, ["u"], "degree", F.xxhash64("v"))
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        step += 1
        edges = tmp.written(small.where("u != v").distinct(), f"star-{step}")
        tmp.drop(f"star-{step - 1}", "least", "large")
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.min("u")).first()
        if state == now:
            break
        state = now
    labels = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return labels.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def hub_pairs(members: DataFrame) -> DataFrame:
    """(hub, member) as (a, b), where their sizes allow a link. members: as from ``bucketed``."""
    fits = 100 * F.least("n", "hub_n") >= PERCENT * F.greatest("n", "hub_n")
    return members.where((F.col("id") != F.col("hub")) & fits).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def bucketed(keyed: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """key, id, n, hub, hub_n and size of the members of all buckets of two or more.

    keyed: key, id and n."""
    shared = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = tmp.written(shared, f"{name}-buckets")
    members = spread_join(keyed, shared, ["key"], "size", F.xxhash64("id"))
    members = members.select("key", "id", "n", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), "size")
    members = tmp.written(members, name)
    tmp.drop(f"{name}-buckets")
    return members


def mixed_members(members: DataFrame, labels: DataFrame, tmp: Scratch) -> DataFrame:
    """key, id, n, component and size of the members of buckets that hold several components.

    The hub was compared with all, so it stays out; buckets with the same members are one."""
    m = members.where("size > 2 AND id != hub").join(labels, "id", "left")
    m = m.select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = m.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"),
        F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(id, 1))").alias("y"),
    )
    mixed = mixed.where("lo != hi").groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    mixed = tmp.written(mixed, "mixed-keys")
    return tmp.written(spread_join(m, mixed, ["key"], "size", F.xxhash64("id")), "mixed")


def narrower(members: DataFrame, sets: DataFrame, tmp: Scratch) -> DataFrame:
    """key, id and n, where the keys are the rarest shingles of each member.

    Of a set of n shingles, any set with the least similarity holds PERCENT per cent of
    them, so it holds one of any n - PERCENT * n / 100 + 1. Those that the fewest members
    hold, in one order for all, are the first of either set that both may share."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n, s in zip(*[c.to_pylist() for c in b.columns]):
                s = np.frombuffer(s, np.int64)
                for k in range(0, len(s), 1 << 20):
                    part = s[k : k + (1 << 20)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), i)), pa.array(np.full(len(part), n)), pa.array(part)], ["id", "n", "key"]
                    )

    wide = sets.join(members.select("id").distinct(), "id", "left_semi").select("id", "n", "s")
    grams = wide.mapInArrow(tidy(run), "id bigint, n bigint, key bigint")
    df = tmp.written(grams.groupBy("key").agg(F.count(F.lit(1)).alias("df")), "df")
    grams = spread_join(grams, df, ["key"], "df", F.xxhash64("id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "key"))  # one set's shingles
    first = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    return grams.withColumn("rank", rank).where((F.col("rank") <= first) & (F.col("df") > 1)).select("key", "id", "n")


def block_links(m: DataFrame, sets: DataFrame, tmp: Scratch) -> DataFrame:
    """Links between components that still share a bucket. m: as from ``mixed_members``."""
    # A component that fills half a block or more has blocks of its own; the others share.
    size = m.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("values"))
    size = size.withColumn("fill", F.greatest(F.col("members") / BLOCK, F.col("values") / BLOCK_VALUES))
    size = size.withColumn("alone", F.col("fill") >= 0.5)
    few = size.where("NOT alone").groupBy("key").agg(F.ceil(F.sum("fill")).alias("few"))
    size = tmp.written(size.join(few, "key", "left"), "block-sizes")
    m = spread_join(m, size, ["key", "component"], "members", F.xxhash64("id"))
    own = F.struct(F.col("component").alias("of"), F.pmod(F.xxhash64("id"), F.ceil("fill")).alias("part"))
    other = F.struct(F.lit(None).cast("bigint").alias("of"), F.pmod(F.xxhash64("component"), F.col("few")).alias("part"))
    m = m.select("key", "id", "component", F.when(F.col("alone"), own).otherwise(other).alias("block"))
    m = tmp.written(m, "blocks")
    blocks = m.select("key", "block").distinct()
    left, right = blocks.withColumnRenamed("block", "i"), blocks.withColumnRenamed("block", "j")
    tasks = left.join(right, "key").where("i <= j AND (i.of IS NULL OR j.of IS NULL OR i.of != j.of)")
    tasks = tasks.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = m.join(tasks, ["key", "block"]).join(sets.select("id", "n", "s"), "id")
    rows = rows.select("key", F.to_json("i").alias("i"), F.to_json("j").alias("j"), "id", "component", "n", "s")

    def compare(table: pa.Table) -> pa.Table:
        ids, comp = table["id"].to_numpy(), table["component"].to_numpy()
        n = table["n"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table["s"].to_pylist()]
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        distinct, column = np.unique(flat, return_inverse=True)
        often = np.bincount(column) > 1  # a shingle of one member adds to no intersection
        where = np.cumsum(often) - 1
        keep = often[column]
        row, column = row[keep], where[column[keep]]
        both = np.zeros((len(sets), len(sets)))
        width = 1 << 14
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for c in range(0, int(often.sum()), width):
            a, b = np.searchsorted(column, (c, c + width))
            part = np.zeros((len(sets), width), np.float32)
            part[row[a:b], column[a:b] - c] = 1
            both += part @ part.T
        total = n[:, None] + n[None, :]
        ok = (100 * both >= PERCENT * (total - both)) & (comp[:, None] != comp[None, :])
        # A spanning forest of the components is enough.
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = x = root.get(y, y)
            return x

        out = []
        for p, q in zip(*np.nonzero(np.triu(ok))):
            x, y = find(int(comp[p])), find(int(comp[q]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(min(ids[p], ids[q])), int(max(ids[p], ids[q]))))
        return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def grouped(docs: DataFrame, key: Column, id_col: str, text_col: str, k: int) -> DataFrame:
    """id (the row's key), own (its id), n and component (a row's key, the smallest) of every row."""
    prepare(docs.sparkSession)
    tmp = Scratch(docs.sparkSession)
    signed = written(signatures(docs, key, id_col, text_col, k), "signed")
    nodes = signed.where("n > 0").groupBy("print").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows")
    )
    nodes = tmp.written(nodes, "nodes")
    members = bucketed(nodes.select(F.explode("bands").alias("key"), "id", "n"), tmp, "members")
    pairs = tmp.written(hub_pairs(members), "pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(members.where("size > 2").select("id")).distinct()
    wanted = tmp.written(wanted, "wanted")
    sets = tmp.written(full_sets(docs, key, text_col, k, wanted), "sets")
    if sets.count() > wanted.count():  # repeated rows
        sets = tmp.written(sets.dropDuplicates(["id"]), "sets")
    links = tmp.written(confirmed(pairs, sets, tmp), "links")
    labels = components(links)
    m = mixed_members(members, labels, tmp)
    wide = m.where(F.col("size") > WIDE)
    parts = [m.where(F.col("size") <= WIDE)]
    if not wide.isEmpty():
        narrow = bucketed(narrower(wide, sets, tmp), tmp, "narrow")
        more = tmp.written(confirmed(hub_pairs(narrow), sets, tmp), "links")
        links = tmp.written(links.unionByName(more), "links")
        labels = components(links)
        parts.append(mixed_members(narrow, labels, tmp))
    found = None
    for part in parts:
        more = tmp.written(block_links(part, sets, tmp), "links")
        if not more.isEmpty():
            found = more if found is None else found.unionByName(more)
    if found is not None:
        labels = components(links.unionByName(found))
    groups = nodes.select("print", "id", "rows").join(labels, "id", "left")
    groups = written(groups.select("print", F.coalesce("component", "id").alias("component"), "rows"), "groups")
    tmp.drop(*list(tmp.paths))
    full = signed.where("n > 0").select("id", "own", "n", "print")
    full = spread_join(full, groups, ["print"], "rows", F.xxhash64("id"))
    return full.select("id", "own", "n", "component").unionByName(signed.where("n = 0").select("id", "own", "n", F.col("id").alias("component")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """id, n_shingles and component of every row; and key, the row's number in ``row_key``."""
    return named(docs, *row_key(docs, id_col, text_col), id_col, text_col, k)


def named(docs: DataFrame, key: Column, unique: bool, id_col: str, text_col: str, k: int) -> DataFrame:
    out = grouped(docs, key, id_col, text_col, k)
    if not unique:  # a component's name is the smallest of its ids
        out = written(out, "near")
        names = out.groupBy("component").agg(F.min("own").alias("name"), F.count(F.lit(1)).alias("rows"))
        names = written(names, "names")
        out = spread_join(out, names, ["component"], "rows", F.xxhash64("id"))
        out = out.withColumn("component", F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("own")))
    return out.select(F.col("own").alias("id"), F.col("n").alias("n_shingles"), "component", F.col("id").alias("key"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """One row of each group stays, that of its smallest id; rows without an id or words stay."""
    key, unique = row_key(docs, id_col, text_col)
    marked = named(docs, key, unique, id_col, text_col, k)
    drop = written(marked.where("id IS NOT NULL AND id != component").select("key").distinct(), "drop")
    few = drop.count() <= MAX_BROADCAST_IDS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    return rows.join(F.broadcast(drop) if few else drop, "key", "left_anti").select("row.*")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
