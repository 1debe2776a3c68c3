"""Near duplicates: MinHash signatures joined within a Hamming distance, confirmed on full sets.

A signature has chunks of slots of 16 bits. It is entered under every chunk with each of the chunk's
slots left out in turn, so two signatures share a key if they differ in at most one slot of some chunk.
Pairs that share a key are tested slot by slot, the rest on whole shingle sets.

With ``c`` chunks, ``2 c - 1`` slots may differ in all: then some chunk has one error at most. So every pair
of signatures within that distance shares a key, whatever the data (pigeonhole). The layout follows from the
similarity asked for (``layout_for``): a pair of exactly that similarity has signatures further apart at most
once in a million times, a closer one less often. These odds are computed from the slots' independent
chances to agree; that two different least values agree in 16 bits only adds candidates. Similarities that no
layout serves so are refused.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stayframe.llm.components import components
from stayframe.llm.shingles import mix, text_shingles
from stayframe.llm.spread import spread_lookup
from stayframe.session import scratch_path

MISSES = 1e-6
# The most slots of a signature, by the width of its chunks. Wide chunks come first: a key of three slots is
# shared by fewer unlike texts than one of two, and far fewer than one of a single slot.
MOST_BY_WIDTH = {4: 40, 3: 60, 2: 24}
MOST_SLOTS = max(MOST_BY_WIDTH.values())


@dataclass(frozen=True)
class Layout:
    """Chunks of slots in a signature."""

    chunks: int
    width: int

    @property
    def slots(self) -> int:
        return self.chunks * self.width

    @property
    def reach(self) -> int:
        """The most slots in which two signatures may differ and surely share a key."""
        return 2 * self.chunks - 1

    def misses(self, similarity: float) -> float:
        """The share of pairs of a similarity whose signatures are further apart than ``reach``."""
        s, d = similarity, 1 - similarity
        return sum(math.comb(self.slots, k) * d**k * s ** (self.slots - k) for k in range(self.reach + 1, self.slots + 1))


@cache
def layout_for(num: int, den: int) -> Layout:
    """The layout of the widest chunks, and then of the fewest, that misses at most ``MISSES`` at ``num / den``."""
    if not 0 < num <= den:
        raise ValueError(f"a similarity lies above 0 and is at most 1, not {num} / {den}")
    for width, most in MOST_BY_WIDTH.items():
        for chunks in range(1, most // width + 1):
            made = Layout(chunks, width)
            if made.misses(num / den) <= MISSES:
                return made
    raise ValueError(f"no signature of {MOST_SLOTS} slots finds pairs of similarity {num} / {den} with {MISSES} misses")


# The layout of signatures where no other is named.
CHUNKS = 6
WIDTH = 4
SLOTS = CHUNKS * WIDTH
_PLAIN = Layout(CHUNKS, WIDTH)
REACH = _PLAIN.reach
# Members of a key that one task compares with each other, and bytes of their whole sets.
BLOCK = 1024
BLOCK_BYTES = 8_000_000
# Rows of texts or sets that a task is handed at once.
_FEW_ROWS = 256
_SHORT = 24

_DRAW = np.random.default_rng(77)
_FACTOR = _DRAW.integers(0, 2**64, MOST_SLOTS, np.uint64) | np.uint64(1)
_SHIFT = _DRAW.integers(0, 2**64, MOST_SLOTS, np.uint64)


def signature(hashes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """16 bits of the least value under each of ``slots`` hash functions of a non-empty set."""
    out = np.empty(slots, np.uint16)
    for k in range(slots):
        out[k] = (hashes * _FACTOR[k] + _SHIFT[k]).min() >> np.uint64(8) & np.uint64(0xFFFF)
    return out


def sign(
    docs: DataFrame, size: int, lower: bool, text: str = "text", doc_id: str = "doc_id", slots: int = SLOTS
) -> DataFrame:
    """``doc_id, n_shingles, set_key, signature``: a digest of the set of word shingles, and its signature.

    A text without words has no shingles, no signature and a key of its own.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, keys, signs = batch.column(0).to_pylist(), [], [], []
            for i, found in text_shingles(batch.column(1), size, lower):
                counts.append(len(found))
                raw = found.tobytes() if len(found) else f"empty {ids[i]}".encode()
                keys.append(hashlib.blake2b(raw, digest_size=16).digest())
                signs.append(signature(found, slots).tobytes() if len(found) else None)
            made = [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_shingles", "set_key", "signature"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, n_shingles bigint, set_key binary, signature binary")


def _matrix(column: pa.Array, slots: int) -> np.ndarray:
    """A binary column of whole signatures as rows of slots."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, slots)


def chunk_keys(slots: np.ndarray, layout: Layout = _PLAIN) -> np.ndarray:
    """Keys of signatures: one column for each chunk and left-out slot."""
    keys, width = np.empty((len(slots), layout.slots), np.uint64), layout.width
    for which in range(layout.slots):
        chunk, out = divmod(which, width)
        key = np.full(len(slots), which, np.uint64)
        for s in range(chunk * width, chunk * width + width):
            if s != chunk * width + out:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + slots[:, s])
        keys[:, which] = key
    return keys


def within_reach(a: np.ndarray, b: np.ndarray, which: np.ndarray, layout: Layout = _PLAIN) -> np.ndarray:
    """Pairs of signatures within the layout's reach whose first common key is the one numbered ``which``."""
    differ = a != b
    close = differ.sum(1) <= layout.reach
    by_chunk = differ.reshape(-1, layout.chunks, layout.width)
    errors = by_chunk.sum(2)
    first = np.argmax(errors <= 1, axis=1)
    at = np.arange(len(a))
    out = np.where(errors[at, first] == 1, np.argmax(by_chunk[at, first], axis=1), 0)
    return close & (errors[at, first] <= 1) & (first * layout.width + out == which)


def _keys(reps: DataFrame, layout: Layout, narrow: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4000):
                part = batch.slice(a, 4000)
                slots = _matrix(part.column(2), layout.slots)
                keys = pa.array(chunk_keys(slots, layout).astype(np.int64).reshape(-1))
                each = pa.array(np.repeat(np.arange(len(part)), layout.slots))
                if narrow:
                    yield pa.RecordBatch.from_arrays([keys, part.column(1).take(each)], ["key", "n"])
                    continue
                which = pa.array(np.tile(np.arange(layout.slots, dtype=np.int32), len(part)))
                cols = [part.column(c).take(each) for c in range(3)]
                yield pa.RecordBatch.from_arrays([keys, which, *cols], ["key", "which", "rep", "n", "signature"])

    kind = "key bigint, n bigint" if narrow else "key bigint, which int, rep bigint, n bigint, signature binary"
    return reps.select("rep", "n", "signature").mapInArrow(work, kind)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of rows that agree in the first ``keys`` columns, many at once, and where runs begin."""
    held: list[pa.RecordBatch] = []

    def begins(rows: pa.Table) -> np.ndarray:
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for c in range(keys):
            col = rows.column(c).to_numpy()
            new[1:] |= col[1:] != col[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        starts = begins(rows)
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]), starts[:-1]
            held = rows.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, begins(rows)


def _unit_frame(keyed: DataFrame) -> DataFrame:
    return keyed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")


def _candidates(keyed: DataFrame, layout: Layout, num: int, den: int) -> DataFrame:
    """Members of each unit that have a partner there: ``key, i, j, block, rep``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _runs(batches, 3):
            lengths = np.diff(np.append(starts, len(rows)))
            run = np.repeat(np.arange(len(starts)), lengths)
            cross = rows.column("i").to_numpy() != rows.column("j").to_numpy()
            block, which = rows.column("block").to_numpy(), rows.column("which").to_numpy()
            n, slots = rows.column("n").to_numpy(), _matrix(rows.column("signature"), layout.slots)
            hit = np.zeros(len(rows), bool)

            def test(a: np.ndarray, b: np.ndarray) -> None:
                ok = (num * np.maximum(n[a], n[b]) <= den * np.minimum(n[a], n[b])) & (~cross[a] | (block[a] != block[b]))
                a, b = a[ok], b[ok]
                ok = within_reach(slots[a], slots[b], which[a], layout)
                hit[a[ok]] = True
                hit[b[ok]] = True

            short = np.repeat(lengths <= _SHORT, lengths)
            for d in range(1, min(_SHORT, len(rows))):
                a = np.flatnonzero((run[:-d] == run[d:]) & short[:-d])
                if not len(a):
                    break
                test(a, a + d)
            for r in np.flatnonzero(lengths > _SHORT).tolist():
                begin, end = starts[r], starts[r] + lengths[r]
                for a in range(begin, end - 1):
                    test(np.full(end - a - 1, a), np.arange(a + 1, end))
            yield from rows.select(["key", "i", "j", "block", "rep"]).filter(pa.array(hit)).to_batches()

    ordered = keyed.select("key", "i", "j", "block", "which", "rep", "n", "signature")
    return _unit_frame(ordered).mapInArrow(work, "key bigint, i int, j int, block int, rep bigint")


def spanning_links(
    names: np.ndarray, sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links that connect what all links of similarity ``num / den`` or more would connect.

    Exact: a pair goes untested only if it is connected already, or cannot reach the similarity by the
    number of shingles that others here have too. With ``side``, only pairs of different sides count.
    """
    m, sizes = len(names), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    _, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[code] >= 2
    code, owner = code[shared], owner[shared]
    common = np.bincount(owner, minlength=m)
    begins = np.searchsorted(owner, np.arange(m + 1))
    label, left, links = np.arange(m), np.ones(m, bool), []
    for x in np.argsort(-common, kind="stable").tolist():
        left[x] = False
        may = left & (label != label[x]) & ((den + num) * np.minimum(common, common[x]) >= num * (sizes + sizes[x]))
        if side is not None:
            may &= side != side[x]
        if not may.any():
            continue
        mark = np.zeros(len(seen), bool)
        mark[code[begins[x] : begins[x + 1]]] = True
        both = np.bincount(owner[mark[code]], minlength=m)
        for y in np.flatnonzero(may & (den * both >= num * (sizes + sizes[x] - both))).tolist():
            if label[y] != label[x]:
                links.append((int(names[x]), int(names[y])))
                label[label == label[y]] = label[x]
    return links


def confirm(members: DataFrame, docs: DataFrame, size: int, lower: bool, num: int, den: int) -> DataFrame:
    """Spanning links ``a, b`` of each unit, on the members' full sets taken from their texts again.

    A task holds the sets of one unit, twice ``BLOCK_BYTES`` or so, and is handed a few rows at a time.
    """
    units = members.groupBy("rep").agg(F.collect_list(F.struct("key", "i", "j", "block")).alias("units"))
    # Members grow with the corpus: the same join at every size, not a broadcast while they are few.
    texts = docs.join(units.hint("merge"), docs["doc_id"] == units["rep"]).select("rep", "text", "units")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, units = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows, held = [], 0
            for i, found in text_shingles(batch.column(1), size, lower):
                raw = found.tobytes()
                for unit in units[i]:
                    rows.append({**unit, "rep": reps[i], "set": raw})
                    held += len(raw) + 50
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kind)

    kind = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("rep", pa.int64()), ("set", pa.binary())])
    met = texts.mapInArrow(sets, "key bigint, i int, j int, block int, rep bigint, set binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _runs(batches, 3):
            reps, block = rows.column("rep").to_numpy(), rows.column("block").to_numpy()
            i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
            raw, found = rows.column("set").to_pylist(), []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
                own = [np.frombuffer(x, np.uint64) for x in raw[a:b]]
                found += spanning_links(reps[a:b], own, num, den, block[a:b] if i[a] != j[a] else None)
            cols = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1])], ["a", "b"])

    return _unit_frame(met).mapInArrow(work, "a bigint, b bigint")


def equal_sets(signed: DataFrame) -> DataFrame:
    """``set_key, rep, n, signature, copies``: one row per distinct non-empty set of rows with an id.

    Partial sums run before the shuffle, so a large group of copies costs little.
    """
    return signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"),
        F.count(F.lit(1)).alias("copies"),
    )


def units(keyed: DataFrame, counts: DataFrame, total: int, block: int) -> DataFrame:
    """Rows whose key others have too, in units ``key, i, j`` that one task compares.

    A key with more than ``block`` members, or ``BLOCK_BYTES`` of sets, is compared block against block, each
    pair of blocks a unit. ``counts`` has ``key, size, shingles`` of shared keys: their members and the sum of
    these members' set sizes. ``total`` is the number of keyed rows.
    """
    met = spread_lookup(keyed, counts, ["key"], "size", total).where("size > 1")
    by_bytes = F.least(F.ceil(8 * F.col("shingles") / BLOCK_BYTES), F.col("size"))
    blocks = F.greatest(F.ceil(F.col("size") / block), by_bytes).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")),
    )
    dealt = met.select(*keyed.columns, own.alias("block"), F.explode(pairs).alias("unit"))
    return dealt.select("*", "unit.i", "unit.j").drop("unit")


def with_components(signed: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every signed row, from links between sets."""
    found = components(links)
    moved = sets.join(found, sets["rep"] == found["node"], "left").where("copies > 1 or component is not null").select(
        "set_key", F.coalesce("component", "rep").alias("component"), "copies"
    )
    result = spread_lookup(signed.drop("signature"), moved, ["set_key"], "copies", signed.count())
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return result.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"),
    )


@contextmanager
def few_rows_at_once(spark: SparkSession, rows: int = _FEW_ROWS) -> Iterator[None]:
    """What is written inside hands tasks at most so many rows at once: for rows that may hold whole texts or sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again."""
    place = scratch_path(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def key_counts(keyed: DataFrame) -> DataFrame:
    """``key, size, shingles`` of the keys of more than one row of ``key, n``."""
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).where("size > 1")


def near_duplicates(
    docs: DataFrame, *, size: int = 3, num: int = 85, den: int = 100, lower: bool = True, block: int = BLOCK,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents whose sets of ``size``-word shingles have a similarity of ``num / den`` or more are
    linked; the component is the smallest id that links lead to. A text of fewer words has all of
    them as its one shingle. Null and empty texts, and texts of white space, link with nothing, equal
    or not. Equal sets are one member of the join. Rows with a null id link with nothing, have no
    component and are kept. Rows that repeat an id are one document. No rows give no rows; extra
    columns are ignored.
    """
    plain = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    layout = layout_for(num, den)
    with few_rows_at_once(docs.sparkSession, 10 * _FEW_ROWS):
        signed = written(sign(plain, size, lower, slots=layout.slots), "signed")
    sets = written(equal_sets(signed), "sets")
    counts = written(key_counts(_keys(sets, layout, narrow=True)), "keys")
    keyed = units(_keys(sets, layout, narrow=False), counts, layout.slots * sets.count(), block)
    members = written(_candidates(keyed, layout, num, den), "members")
    with few_rows_at_once(docs.sparkSession):
        links = written(confirm(members, plain, size, lower, num, den).distinct(), "links")
    return with_components(signed, sets, links)
