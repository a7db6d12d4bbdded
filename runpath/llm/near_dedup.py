"""MinHash near-dedup with b-bit signatures.

1. Each text becomes its set of hashed word shingles, ``bands * rows`` minima of
   that set, one key for each band of minima, and a packed signature that keeps
   the ``bits`` low bits of each minimum.
2. Texts of equal sets form one class, represented by its smallest id, so copies
   cost nothing further on.
3. Representatives that share a band key are candidates.  First each is paired
   with the smallest id of its bucket (rows in proportion to the bucket).  The
   similarity estimated from the bit counts of the packed signatures, corrected
   for chance agreement of low bits, drops the hopeless pairs; the rest are
   confirmed on the full sets.
4. What these links do not join yet is searched once more: within each bucket
   that holds several components, every member outside the most common one is
   compared with all others, on the packed signatures first and then on the full
   sets, and the links that join components are kept.  Large buckets are cut into
   blocks of bounded size that meet pair by pair, and no pair is left out.
5. Components of the links, by smallest id.

Every link (similarity of at least ``percent``/100) that shares a band is found;
a pair at the threshold itself shares one but for about 3 in a million.

Sets are compared as sets of 64-bit hashes of their shingles; sets are taken for
equal if their sizes and two 64-bit sums over their hashes are.

Defined results: null and empty texts, and texts of separators only, have an
empty set, are linked with nothing and keep their own id; texts with fewer words
than a shingle are one shingle; rows of a repeated id are one node of the graph
(each row is returned) with the union of their links; a row whose id is null is
returned with a null component and is kept; of a group the smallest id stays, so
there are no ties; texts are read whole, however long; an empty table gives no
rows; columns besides id and text are not looked at, and pass through keep_one()
whatever their names.  keep_one() takes rows of one id with different texts for
different documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath.llm import filters, kernel
from runpath.llm.storage import Tables, materialize, small_batches


@dataclass(frozen=True)
class NearDupParams:
    """words per shingle; percent of the union that the intersection must reach; signature shape."""

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    bits: int = 4
    #: Pairs whose estimate lies this many standard deviations under the threshold are dropped.
    sigmas: float = 5.5
    #: Members of one block when a bucket is searched for the second time.
    block: int = 1000

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def lanes(self) -> int:
        """Minima packed in one long."""
        return 64 // self.bits

    @property
    def agreeing(self) -> int:
        """Fewest agreeing minima of a pair that is confirmed on full sets."""
        t, chance = self.percent / 100, 2.0**-self.bits
        share = t + (1 - t) * chance
        return int(np.floor(self.minima * (share - self.sigmas * np.sqrt(share * (1 - share) / self.minima))))


OP5 = NearDupParams(words=4)
PIPELINE = NearDupParams(words=5)


#: Texts, and bytes of them, that are worked on at a time.
CHUNK_ROWS, CHUNK_BYTES = 500, 4 << 20


def shingle_hashes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and the number of the first shingle of each text."""
    h, first = kernel.word_hashes(column)
    n_words = np.diff(first)
    count = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    cut = np.zeros(len(first), dtype=np.int64)
    np.cumsum(count, out=cut[1:])
    out = np.zeros(cut[-1], dtype=np.uint64)
    if len(h) >= width:
        full = kernel.combine(*(h[i : len(h) - width + 1 + i] for i in range(width)))
        own = kernel.owner(first)
        whole = own[: len(full)] == own[width - 1 :]
        long = np.repeat(n_words >= width, count)
        out[long] = full[whole]
    for i in np.flatnonzero((n_words > 0) & (n_words < width)):
        part = [h[j : j + 1] for j in range(first[i], first[i + 1])]
        out[cut[i]] = kernel.combine(np.array([len(part)], dtype=np.uint64), *part)[0]
    return out, cut


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(8191)
    return r.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each permutation over a set of 64-bit hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 512):
        part = x[lo : lo + 512]
        np.minimum(out, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return out


def pack(mins: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of each row of minima, packed into longs (rows x longs)."""
    per = 64 // bits
    low = (mins & np.uint32((1 << bits) - 1)).astype(np.uint64)
    pad = -low.shape[1] % per
    low = np.pad(low, ((0, 0), (0, pad))).reshape(len(low), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(bits)), axis=2).view(np.int64)


def _signature_rows(p: NearDupParams):
    a, b = _permutations(p.minima)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.chunks(batches, CHUNK_ROWS, CHUNK_BYTES):
            sh, cut = shingle_hashes(batch.column("text"), p.words)
            n = batch.num_rows
            size, sig = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
            mins = np.zeros((n, p.minima), np.uint32)
            for i in range(n):
                if cut[i] < cut[i + 1]:
                    s = np.unique(sh[cut[i] : cut[i + 1]])
                    size[i] = len(s)
                    sig[i] = s.sum(dtype=np.uint64), kernel.mix(s ^ kernel.STEP).sum(dtype=np.uint64)
                    mins[i] = minima(s, a, b)
            groups = mins.reshape(n, p.bands, p.rows).astype(np.uint64)
            keys = kernel.combine(np.broadcast_to(np.arange(p.bands, dtype=np.uint64), (n, p.bands)).copy(), *(groups[:, :, j].copy() for j in range(p.rows)))
            packed = pack(mins, p.bits)
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m.shape[1], pa.int32()), pa.array(m.view(np.int64).ravel()))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(sig[:, 0].view(np.int64)), pa.array(sig[:, 1].view(np.int64)), lists(keys), lists(packed)],
                names=["doc_id", "n_shingles", "sig_a", "sig_b", "bands", "packed"],
            )

    return kernel.trimmed(run)


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.chunks(batches, CHUNK_ROWS, CHUNK_BYTES):
            sh, cut = shingle_hashes(batch.column("text"), width)
            sets = [np.unique(sh[cut[i] : cut[i + 1]]).view(np.int64) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return kernel.trimmed(run)


def _narrow(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def _agree(p: NearDupParams, x: str, y: str):
    """Agreeing lanes of two packed signatures, as a column of bit counts."""
    lane = int(sum(1 << (i * p.bits) for i in range(p.lanes)))
    lane = lane - (1 << 64) if lane >= 1 << 63 else lane
    out = F.lit(p.minima)
    for i in range(-(-p.minima // p.lanes)):
        d = F.get(F.col(x), i).bitwiseXOR(F.get(F.col(y), i))
        any_bit = d
        for s in range(1, p.bits):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(d, s))
        out = out - F.bit_count(any_bit.bitwiseAND(F.lit(lane)))
    return out


def _confirm(tables: Tables, documents: DataFrame, pairs: DataFrame, p: NearDupParams) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold. The texts of ids in pairs are read again."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _sets(tables, documents, ids, p)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= p.percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): smallest label of the neighbours, then pointer jumping, until nothing changes."""
    with Tables(links.sparkSession) as tables:
        edges = tables.write(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        labels = tables.write(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
        while True:
            seen = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
            met = labels.join(seen, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
            jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
            after = tables.write(met.join(jump, "component").select("id", "was", F.least("component", "further").alias("component")), "labels")
            labels = after.select("id", "component")
            if after.where(F.col("was") != F.col("component")).isEmpty():
                return tables.keep(labels, "components")


class _Merged:
    """Union-find over the component labels of one block."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (u := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(u, u)
            x = u
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _block_links(p: NearDupParams):
    """Links that join components within one pair of blocks of one bucket, confirmed on full sets.

    Two members of the most common component need no comparison; every other member is
    compared with all of the opposite block: by the bit counts of the signatures first, then
    by the exact size of the intersection, counted along the postings of its shingles.
    """
    least, bits, n = p.agreeing, p.bits, p.minima
    lane = np.uint64(sum(1 << (i * bits) for i in range(64 // bits)))

    def run(table: pa.Table) -> pa.Table:
        ids, comp = table.column("rep").to_numpy(), table.column("component").to_numpy()
        side, x, y = (table.column(c).to_numpy() for c in ("side", "x", "y"))
        _, label, count = np.unique(comp, return_inverse=True, return_counts=True)
        out: list[tuple[int, int]] = []
        if len(count) > 1:
            sig = np.array(table.column("packed").to_pylist(), dtype=np.int64).view(np.uint64)
            lists = table.column("shingles").combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            _, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            first = np.cumsum(size) - size
            holder = np.repeat(np.arange(len(ids)), size)[np.argsort(code, kind="stable")]
            posting = np.concatenate([[0], np.cumsum(np.bincount(code))])
            merged = _Merged()
            for i in np.flatnonzero(label != count.argmax()):
                d = sig[i] ^ sig
                any_bit = d.copy()
                for k in range(1, bits):
                    any_bit |= d >> np.uint64(k)
                agree = n - np.bitwise_count(any_bit & lane).sum(axis=1)
                near = (agree >= least) & (label != label[i])
                if x[0] != y[0]:
                    near &= side != side[i]
                if not near.any():
                    continue
                own = code[first[i] : first[i] + size[i]]
                common = np.bincount(np.concatenate([holder[posting[c] : posting[c + 1]] for c in own]), minlength=len(ids))
                for j in np.flatnonzero(near & (100 * common >= p.percent * (size + size[i] - common))):
                    if merged.join(int(label[i]), int(label[j])):
                        out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([min(o) for o in out], pa.int64()), "b": pa.array([max(o) for o in out], pa.int64())})

    return run


def _sets(tables: Tables, documents: DataFrame, ids: DataFrame, p: NearDupParams) -> DataFrame:
    """(id, shingles) of the ids in ids (id): their texts are read again. The sets are shuffled, the texts are not."""
    maybe, _ = filters.split(documents, "doc_id", filters.bit_map(ids.withColumnRenamed("id", "doc_id"), "doc_id"))
    sets = maybe.mapInArrow(_set_rows(p.words), "id long, shingles array<bigint>").join(ids, "id", "left_semi")
    return tables.write(sets.dropDuplicates(["id"]), "sets")


def _second_search(tables: Tables, documents: DataFrame, spokes: DataFrame, signed: DataFrame, found: DataFrame, p: NearDupParams) -> DataFrame | None:
    """Links within buckets that hold members of several components, or None where there is no such bucket."""
    placed = spokes.where("members > 2").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    by_key = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"), F.count("*").alias("n"))
    # Buckets of several bands that have the same members are searched once.
    mixed = tables.write(by_key.where("low <> high").groupBy("who", "n").agg(F.min("key").alias("key")).select("key"), "mixed")
    if mixed.isEmpty():
        return None
    hard = tables.write(placed.join(mixed, "key", "left_semi").select("key", "rep", "component", "members"), "hard")
    sets = _sets(tables, documents, hard.select(F.col("rep").alias("id")).distinct(), p)
    blocks = F.ceil(F.col("members") / p.block).cast("int")
    side = F.pmod(F.xxhash64("rep", F.lit(1)), blocks).cast("int")
    spread = hard.select("key", "rep", "component", side.alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).select(
        "key", "rep", "component", "side", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y")
    )
    whole = spread.join(signed, "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
    return tables.write(whole.groupBy("key", "x", "y").applyInArrow(_block_links(p), "a long, b long").distinct(), "links")


def near_duplicates(documents: DataFrame, p: NearDupParams = NearDupParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of documents."""
    small_batches(documents.sparkSession)
    texts = _narrow(documents, id_col, text_col)
    with Tables(documents.sparkSession) as tables:
        return tables.keep(_near_duplicates(tables, texts, p), "classes")


def _near_duplicates(tables: Tables, texts: DataFrame, p: NearDupParams) -> DataFrame:
    rows = tables.write(texts.mapInArrow(_signature_rows(p), "doc_id long, n_shingles long, sig_a long, sig_b long, bands array<bigint>, packed array<bigint>"), "signatures")
    with_set = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    one = ["n_shingles", "sig_a", "sig_b"]
    classes = with_set.groupBy(*one).agg(F.min("doc_id").alias("rep"))
    reps = tables.write(with_set.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"] + one).select(F.col("doc_id").alias("rep"), "bands", "packed"), "reps")
    # Different sets under one id, and an id that represents one set and also has another, are joined through the id.
    member = with_set.select("doc_id", *one).distinct().join(classes, one).select("doc_id", "rep").where("doc_id <> rep").distinct()

    keyed = reps.select("rep", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("members")).where("members > 1")
    spokes = tables.write(keyed.join(buckets, "key"), "spokes")
    signed = reps.select("rep", "packed").dropDuplicates(["rep"])
    stars = spokes.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    near = (
        stars.join(signed.select(F.col("rep").alias("a"), F.col("packed").alias("pa")), "a")
        .join(signed.select(F.col("rep").alias("b"), F.col("packed").alias("pb")), "b")
        .where(_agree(p, "pa", "pb") >= p.agreeing)
        .select("a", "b")
    )
    links = tables.write(_confirm(tables, texts, tables.write(near, "stars"), p), "links")
    found = components(links)

    more = _second_search(tables, texts, spokes, signed, found, p)
    if more is not None:
        links = links.union(more)
    return _result(rows, components(links.union(member.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))))


def _result(rows: DataFrame, found: DataFrame) -> DataFrame:
    own = rows.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = own.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(documents: DataFrame, p: NearDupParams = PIPELINE) -> DataFrame:
    """documents with one row of each group of near duplicates: that of the smallest id; of equal rows of one id, one.

    Rows of one id with different texts are different documents: the text of the smallest digest goes by the id, others by
    a number of their own beyond all ids.  Rows without an id are all kept.  Columns are those of documents.
    """
    digest = lambda text: F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    repeated = documents.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(digest(F.col("text"))).alias("first")).where("n > 1")
    twins = materialize(repeated.select("doc_id", "first"), "repeated-ids")
    # Rows go whole, in one column, so that no name of theirs meets one of ours.
    whole = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col("doc_id").alias("id"))
    many, single = filters.split(whole, "id", filters.bit_map(twins.select(F.col("doc_id").alias("id")), "id"))
    text = F.col("row")["text"]
    own = F.shiftrightunsigned(F.xxhash64("id", digest(text)), 2).bitwiseOR(F.lit(1 << 61))
    named = many.join(twins.withColumnRenamed("doc_id", "twin"), F.col("id") == F.col("twin"), "left")
    named = named.select("row", F.when(F.col("twin").isNull() | (digest(text) == F.col("first")), F.col("id").cast("long")).otherwise(own).alias("key"), F.col("twin").isNotNull().alias("is_twin"))
    rows = named.where("not is_twin").select("row", "key").union(named.where("is_twin").select("row", "key").dropDuplicates(["key"]))
    rows = single.select("row", F.col("id").cast("long").alias("key")).union(rows)
    classes = near_duplicates(rows.select(F.col("key").alias("doc_id"), text.alias("text")), p)
    gone = materialize(classes.where(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct(), "duplicates")
    return filters.without(rows, gone, "key").select(*(F.col("row")[c].alias(c) for c in documents.columns))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), OP5)
