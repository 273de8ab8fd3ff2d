"""Near-duplicates by SuperMinHash, banding, exact verification and union-find (operator 6), and what line dedup shares.

Units (documents, lines) are sets of shingles. Equal sets are one unit. The rest runs over distinct sets:

1. SuperMinHash signatures: each element's ranks come from one random permutation of the slots, which lowers the
   variance, and a row stops as soon as every slot is taken by an earlier round (``textkernel.super_minhash``).
2. Banding: units that agree on all slots of a band share a bucket. Rows carry half a byte of some slots, by which a
   pair is likely, possible or neither. Within a bucket, a unit is paired with the first unit that is likely, or leads
   those after it; so a bucket of n units gives n - 1 pairs at most. Units with possible partners only are noted.
3. Pairs are verified on the full sets, from the texts. Links give components (``components``).
4. What step 2 leaves open are pairs of a bucket from different components. The buckets are gone through again, now with
   the components, and all such pairs that sketch and size allow are verified; further links join the components. Here
   rows carry a parity sketch too, which proves most pairs of dissimilar sets to be below the threshold.

In step 2 a batch with many units of one bucket pairs them itself and sends their leaders only, and a bucket has at most
LEADERS of them; units that none of these takes are left to step 4. There a bucket of one component has nothing to
compare and goes first; one of more than GROUP units is dealt by parts: those of its largest component against those of
all others, and these among each other. So no task holds more than a fixed number of units, and no pair is lost.

With 32 bands of 4 slots a pair at a similarity of 0.75 shares no bucket with a probability of 5e-6; sketches rule out a
pair at the threshold with a probability of 3e-6.

Defined results: a text that is null, empty or without words has the empty set and no links; fewer than five words are
one shingle; rows that share an id are one document; a row without an id takes the group of its set, is never the one
that stays for others, and is never removed; very long texts are taken whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .components import connected
from .runtime import Scratch, table, tune


def word_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets of five lower-cased words in a row, as sorted hashes and their bounds by row."""
    starts, ends = K.spans_of_words(data, offsets)
    words = K.hash_spans(data, starts, ends, K.LOWER_TABLE)
    return K.distinct_by_row(*K.shingles(words, K.rows_of(starts, offsets), 5))


#: Slots of a band: four of 16 bits are one long.
ROWS = 4


@dataclass(frozen=True)
class Method:
    """``sets``: from text to sets; ``part`` of ``whole``: the least similarity; ``bands`` of ROWS slots; ``parity_bits``
    and ``sketch_slots``: lengths of the sketches; ``described``: from text to sets and to what signatures are made from,
    if that isn't the sets; ``short``: values of sets have 48 bits, the upper ones."""

    sets: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] = word_sets
    part: int = 75
    whole: int = 100
    bands: int = 32
    parity_bits: int = 512
    sketch_slots: int = 64
    described: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] | None = None
    short: bool = False

    @property
    def slots(self) -> int:
        return self.bands * ROWS


#: Units that one group of step 4 may have; larger buckets are dealt over several groups.
GROUP = 512


def sketches(sig: np.ndarray, slots: int) -> np.ndarray:
    """Half a byte of the first slots of each signature, two to a byte."""
    low = (sig[:, :slots] & 15).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << 4)


def parities(values: np.ndarray, bounds: np.ndarray, bits: int) -> np.ndarray:
    """For each set, a bit by hash: is the number of elements there odd? Two sketches differ in no more bits than the sets
    differ in elements, so many differing bits prove a pair to be below the threshold."""
    n = len(bounds) - 1
    at = np.repeat(np.arange(n), np.diff(bounds)) * bits + (K.mix(values) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits), axis=1)


def binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(rows)])


def band_names(method: Method) -> list[str]:
    """Columns of a signature: the slots of each band as one long."""
    return [f"band{k}" for k in range(method.bands)]


def bands_of(sig: np.ndarray) -> np.ndarray:
    """For each band, the slots of all rows as 64-bit values."""
    return np.ascontiguousarray(np.ascontiguousarray(sig, "<u2").view("<i8").T)


def signatures(texts: DataFrame, keys: list[str], method: Method) -> DataFrame:
    """(keys, n_shingles, set_hi, set_lo, bands): size, 128-bit digest and signature of each text's set."""
    names = [*keys, "n_shingles", "set_hi", "set_lo", *band_names(method)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column("text")):
                values, bounds = method.sets(data, offsets)
                sig = K.super_minhash(values, bounds, method.slots)
                with np.errstate(over="ignore"):
                    hi = K.row_sums(K.mix(values + np.uint64(0xA24BAED4963EE407)), bounds)
                    lo = K.row_sums(K.mix(values ^ np.uint64(0x9FB21C651E98DF25)), bounds)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(np.diff(bounds)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), *map(pa.array, bands_of(sig))], names)

    schema = T.StructType([*[texts.schema[k] for k in keys], *[T.StructField(k, T.LongType()) for k in names[len(keys) :]]])
    return texts.select(*keys, "text").mapInArrow(run, schema)


def band_keys(method: Method, bands: int | None = None) -> Column:
    return F.array(*[F.xxhash64(F.lit(k), name) for k, name in enumerate(band_names(method)[:bands])])


#: From a table (uid) of distinct units, (uid, text).
Fetch = Callable[[DataFrame], DataFrame]


#: Pairs whose units may be broadcast: two rows of four numbers each.
FEW_PAIRS = 10_000

#: Partners of a unit that one group of pairs to verify has; the unit's text is sent once for each group.
PARTNERS = 64


def verified(scratch: Scratch, pairs: DataFrame, texts: DataFrame, method: Method) -> DataFrame:
    """Those pairs (a, b) whose sets reach the threshold. ``texts``: (uid, text) of all units in pairs.

    Each pair's texts meet at its first unit. A unit with many partners is dealt over several groups.
    """
    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).alias("fan"))
    dealt = pairs.join(fan, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("fan")).alias("salt"))
    dealt = scratch.keep(dealt)
    wanted = dealt.select("a", "salt", F.col("b").alias("uid"), F.lit(1).alias("member")).unionByName(
        dealt.select("a", "salt", F.col("a").alias("uid"), F.lit(0).alias("member")).distinct()
    )
    # A few pairs go to the texts; more of them, and the texts are dealt out to meet them.
    few = dealt.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS
    with_text = (F.broadcast(wanted) if few else wanted.hint("merge")).join(texts, "uid").repartition("a", "salt").sortWithinPartitions("a", "salt", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hubs = None, []
        for batch in batches:
            a, salt, member = batch.column("a").to_numpy(zero_copy_only=False), batch.column("salt").to_numpy(), batch.column("member").to_numpy()
            n = batch.num_rows
            if not n:
                continue
            keep = np.zeros(n, bool)
            for lo, hi, data, offsets in K.chunks(batch.column("text")):
                values, bounds = method.sets(data, offsets)
                # Runs of rows with the same first unit: the sets of that unit (several if rows share its id), then its partners'.
                own = np.flatnonzero(np.concatenate([[True], (a[lo + 1 : hi] != a[lo : hi - 1]) | (salt[lo + 1 : hi] != salt[lo : hi - 1])])) + lo
                ends = np.concatenate([own[1:], [hi]])
                if method.short:
                    # Groups that begin and end in here and have one first unit are verified together.
                    plain = np.add.reduceat((member[lo:hi] == 0).astype(np.int64), own - lo) == 1
                    plain[[0, -1]] = False
                    partners = K.ragged(own[plain] + 1, ends[plain] - own[plain] - 1)
                    keep[partners] = _reach_pairs(method, values, bounds, np.repeat(own[plain], ends[plain] - own[plain] - 1) - lo, partners - lo)
                    own, ends = own[~plain], ends[~plain]
                for first, last in zip(own.tolist(), ends.tolist(), strict=True):
                    key = (a[first], salt[first])
                    heads = first + int((member[first:last] == 0).sum())
                    mine = [values[bounds[k - lo] : bounds[k - lo + 1]] for k in range(first, heads)]
                    hubs = [*hubs, *mine] if hub == key else mine
                    hub = key
                    if heads < last:
                        keep[heads:last] = _reach(method, [x for x in hubs if len(x)], values, bounds[heads - lo : last - lo + 1])
            if keep.any():
                kept = batch.select(["a", "uid"]).take(pa.array(np.flatnonzero(keep)))
                yield pa.RecordBatch.from_arrays(kept.columns, ["a", "b"])

    kind = pairs.schema["a"].dataType
    return with_text.select("a", "salt", "uid", "member", "text").mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _reach(method: Method, hubs: list[np.ndarray], values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which of the sets, values between successive bounds, reach the threshold with one of the hubs."""
    own, sizes = values[bounds[0] : bounds[-1]], np.diff(bounds)
    out = np.zeros(len(sizes), bool)
    for hub in hubs:
        at = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
        both = K.row_sums((hub[at] == own).astype(np.int64), bounds - bounds[0])
        out |= (sizes > 0) & (method.whole * both >= method.part * (len(hub) + sizes - both))
    return out


#: Pairs that are verified by one sort.
PAIRS = 512


def _reach_pairs(method: Method, values: np.ndarray, bounds: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which pairs of rows reach the threshold, for values of 48 bits: what two sets share stands side by side when sorted."""
    sizes, out = np.diff(bounds), np.zeros(len(one), bool)
    low, high = np.minimum(sizes[one], sizes[other]), np.maximum(sizes[one], sizes[other])
    allowed = np.flatnonzero((low > 0) & (method.whole * low >= method.part * high))
    for k in range(0, len(allowed), PAIRS):
        pairs = allowed[k : k + PAIRS]
        rows = np.concatenate([one[pairs], other[pairs]])
        place = np.repeat(np.tile(np.arange(len(pairs), dtype=np.uint64), 2), sizes[rows])
        packed = np.sort((place << np.uint64(48)) | (values[K.ragged(bounds[rows], sizes[rows])] >> np.uint64(16)))
        shared = packed[1:][packed[1:] == packed[:-1]] >> np.uint64(48)
        both = np.bincount(shared.astype(np.int64), minlength=len(pairs))
        out[pairs] = method.whole * both >= method.part * (low[pairs] + high[pairs] - both)
    return out


#: Standard deviations below the expected sketch of a pair at the threshold: for pairs worth a try, and for possible pairs.
LIKELY, POSSIBLE = 1.5, 4.5


def _near(method: Method, one: np.ndarray, other: np.ndarray, deviations: float) -> np.ndarray:
    """Which rows of sketches are near enough."""
    slots = 2 * one.shape[-1]
    p = method.part / method.whole
    p += (1 - p) / 16
    least = slots * p - deviations * (slots * p * (1 - p)) ** 0.5
    x = one ^ other
    return ((x & 15) == 0).sum(axis=-1) + ((x & 240) == 0).sum(axis=-1) >= least


def _entry(method: Method) -> np.dtype:
    """What a unit leaves in each of its buckets."""
    return np.dtype([("key", "<u8"), ("uid", "<i8"), ("sketch", "u1", method.sketch_slots // 2)])


_PAIR = np.dtype([("u", "<i8"), ("v", "<i8")])


def _leaders(method: Method, entries: np.ndarray, head: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In each group (a run of entries), an entry is paired with the first one whose sketch is near; if there is none, it
    leads those after it. What LEADERS have not taken stays without a partner here. Returns positions of pairs, and of
    the leaders."""
    sketch = entries["sketch"]
    two = head[size == 2]
    near = _near(method, sketch[two], sketch[two + 1], LIKELY)
    left, right, lead = [two[near]], [two[near] + 1], [two, two[~near] + 1]
    rest, group = K.ragged(head[size > 2], size[size > 2]), np.repeat(np.arange((size > 2).sum()), size[size > 2])
    for _ in range(LEADERS):  # all groups at once
        if not len(rest):
            break
        at, n = _runs(group)
        lead.append(rest[at])
        others = np.ones(len(rest), bool)
        others[at] = False
        first, rest, group = np.repeat(rest[at], n)[others], rest[others], group[others]
        near = _near(method, sketch[first], sketch[rest], LIKELY)
        left.append(first[near])
        right.append(rest[near])
        rest, group = rest[~near], group[~near]
    return np.concatenate(left), np.concatenate(right), np.concatenate(lead)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return head, np.diff(np.concatenate([head, [len(key)]]))


#: Entries of a group that others are compared with in step 2, which bounds its time; step 4 goes through what is left.
LEADERS = 64

#: Entries of one bucket in one batch from which they are paired on the map side, and only their leaders are sent on.
LOCAL = 16


#: Marks a leader that took others of its bucket on the map side: who has no partner among the leaders may have one there.
FOLLOWED = np.int64(-(1 << 63))


def _possible(method: Method, sketch: np.ndarray, alone: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the entries ``alone`` have a possible partner in their group (in a large group: all of them)."""
    out = np.zeros(len(alone), bool)
    large = size > GROUP
    at = K.ragged(head[large], size[large])
    out[at] = alone[at]
    head, size = head[~large], size[~large]
    for d in range(1, int(size.max(initial=1))):
        i = K.ragged(head[size > d], size[size > d] - d)
        i = i[(alone[i] & ~out[i]) | (alone[i + d] & ~out[i + d])]
        i = i[_near(method, sketch[i], sketch[i + d], POSSIBLE)]
        out[i] |= alone[i]
        out[i + d] |= alone[i + d]
    return out


def candidates(units: DataFrame, method: Method) -> DataFrame:
    """(a, b): in each bucket, each unit with its leader; and (a, a) for a unit that has only less likely partners there.

    Entries are packed by bucket range before the shuffle: a row holds all entries that a batch has for a range. Where a
    batch has many entries of one bucket, it pairs them itself, so a bucket with a third of all units is shuffled as a few
    leaders of each batch.
    """
    entry = _entry(method)
    ranges = 8 * max(8, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    seeds = K.mix(np.arange(1, method.bands + 1, dtype=np.uint64))

    def packed(kind: int, part: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        order = np.argsort(part, kind="stable")
        head, size = _runs(part[order])
        for h, n in zip(head.tolist(), size.tolist(), strict=True):
            yield int(part[order[h]]), kind, rows[order[h : h + n]].tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.stack([batch.column(k + 1).to_numpy() for k in range(method.bands)], axis=1).view(np.uint64)
            entries = np.empty((n, method.bands), entry)
            with np.errstate(over="ignore"):
                entries["key"] = K.mix(seeds + K.mix(sig))
            entries["uid"], entries["sketch"] = batch.column(0).to_numpy()[:, None], sketches(sig.view("<u2"), method.sketch_slots)[:, None, :]
            entries = entries.ravel()
            entries = entries[np.argsort(entries["key"])]
            head, size = _runs(entries["key"])
            out = []
            if (size >= LOCAL).any():
                left, right, _ = _leaders(method, entries, head[size >= LOCAL], size[size >= LOCAL])
                pairs = np.empty(len(left), _PAIR)
                pairs["u"], pairs["v"] = entries["uid"][left], entries["uid"][right]
                out += packed(1, (pairs["u"] % ranges).astype(np.int32), pairs)
                entries["uid"][left] |= FOLLOWED
                stays = np.ones(len(entries), bool)
                stays[right] = False
                entries = entries[stays]
            part = (((entries["key"] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int32)
            out += packed(0, part, entries)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["part", "kind", "rows"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}

        def close() -> Iterator[pa.RecordBatch]:
            entries = np.frombuffer(b"".join(held.pop(0, [])), entry)
            given = np.frombuffer(b"".join(held.pop(1, [])), _PAIR)
            key = np.ascontiguousarray(entries["key"])
            order = np.argsort(key)
            head, size = _runs(key[order])
            # Most entries are alone in their buckets and go no further.
            entries = entries[order[K.ragged(head[size > 1], size[size > 1])]]
            followed = entries["uid"] < 0
            entries["uid"] &= ~FOLLOWED
            head, size = _runs(entries["key"])
            left, right, _ = _leaders(method, entries, head, size) if len(entries) else (np.zeros(0, np.int64),) * 3
            alone = np.ones(len(entries), bool)
            alone[left] = alone[right] = False
            noted = _possible(method, entries["sketch"], alone, head, size)
            if followed.any():
                noted |= alone & np.repeat(np.logical_or.reduceat(followed, head), size)
            own = np.unique(entries["uid"][noted])
            u = np.concatenate([given["u"], entries["uid"][left], own])
            v = np.concatenate([given["v"], entries["uid"][right], own])
            if len(u):
                both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        now = None
        for batch in batches:
            for part, kind, rows in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if part != now and now is not None:
                    yield from close()
                now = part
                held.setdefault(kind, []).append(rows)
        if held:
            yield from close()

    sent = units.select("uid", *band_names(method)).mapInArrow(pack, "part int, kind int, rows binary")
    met = sent.repartition("part").sortWithinPartitions("part").mapInArrow(pair, "a long, b long")
    return met.distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    """Bytes of a column of equally long binary values, one row each."""
    column = column if isinstance(column, pa.Array) else column.combine_chunks()
    column = column if isinstance(column, pa.Array) else column.chunk(0)
    data, offsets = K.flat(column)
    return data.reshape(len(offsets) - 1, -1)


def _groups(rows: DataFrame, found: Callable[[pa.Table, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Streams sorted rows (key, uid, ...) group by group; ``found`` gives positions of pairs in a table of whole groups."""

    def cut_out(t: pa.Table) -> pa.RecordBatch | None:
        head, size = _runs(t["key"].to_numpy())
        if not (size > 1).any():
            return None
        left, right = found(t, head[size > 1], size[size > 1])
        if not len(left):
            return None
        uid = t["uid"].to_numpy()
        both = np.unique(np.stack([np.minimum(uid[left], uid[right]), np.maximum(uid[left], uid[right])], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # sorted: the last group may go on
            held = t.slice(cut)
            if cut and (out := cut_out(t.slice(0, cut))) is not None:
                yield out
        if held is not None and held.num_rows and (out := cut_out(held)) is not None:
            yield out

    return rows.mapInArrow(run, "a long, b long").distinct()


#: Partners of each unit in a bucket, and the share of the bands, in the first of the two rounds of step 4. It needs to
#: find only enough to join most of what is still apart; the second round goes through all pairs of all bands.
BEST, FIRST_BANDS = 2, 2


def _across(method: Method, best: int | None) -> Callable[[pa.Table, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket from two components that sketches, parities and sizes allow to reach the threshold: all, or
    for each unit the ``best`` by sketch.

    ``side``: only rows of different sides are compared, but for side -1, which is compared with itself.
    """

    def found(t: pa.Table, head: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sketch, sets, side = _matrix(t["sketch"]), t["n_shingles"].to_numpy(), t["side"].to_numpy()
        parity = np.ascontiguousarray(_matrix(t["parity"])).view(np.uint64)
        component, band = t["component"].to_numpy(), t["band"].to_numpy()
        bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(band), -1)
        left, right, gap = [], [], []

        def pruned() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            u, v, g = (np.concatenate(x) for x in (left, right, gap))
            chosen = np.zeros(len(u), bool)
            for unit in (u, v):
                order = np.lexsort((g, unit))
                first, length = _runs(unit[order])
                chosen[order[(np.arange(len(order)) - np.repeat(first, length)) < best]] = True
            return u[chosen], v[chosen], g[chosen]

        for d in range(1, int(size.max())):
            at = head[size > d]
            n = size[size > d] - d
            i = K.ragged(at, n)
            i = i[(component[i] != component[i + d]) & ((side[i] < 0) | (side[i] != side[i + d]))]
            low, high = np.minimum(sets[i], sets[i + d]), np.maximum(sets[i], sets[i + d])
            i = i[method.whole * low >= method.part * high]
            differing = np.bitwise_count(parity[i] ^ parity[i + d]).sum(axis=1, dtype=np.int64)
            allowed = differing * (method.whole + method.part) <= (sets[i] + sets[i + d]) * (method.whole - method.part)
            i, differing = i[allowed], differing[allowed]
            near = _near(method, sketch[i], sketch[i + d], POSSIBLE)
            i, differing = i[near], differing[near]
            # A pair that shares several buckets is given by the first of them.
            later = ((bands[i] == bands[i + d]) & (np.arange(method.bands)[None, :] < band[i][:, None])).any(axis=1)
            left.append(i[~later])
            right.append(i[~later] + d)
            gap.append(differing[~later])
            if best is not None and sum(map(len, left)) > 1 << 19:
                left, right, gap = ([x] for x in pruned())
        if best is not None and left:
            return pruned()[:2]
        return np.concatenate(left), np.concatenate(right)

    return found


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (key, uid, ...) sorted by key, so that each pair of a bucket from two components meets once and no task holds
    a large bucket. ``main`` and ``rest``: numbers of parts of the bucket's largest component and of all its others.

    The largest component's rows are not compared with each other: each of its parts meets each part of the others, so a
    bucket that is one component but for a few rows is dealt in as many rows as it has, and those few by part.
    """
    zero, some = F.lit(0).cast("long"), lambda n: F.greatest(F.col(n), F.lit(1).cast("long"))
    parts = lambda n: F.sequence(zero, some(n) - 1)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("long").alias("side"))
    inside = F.col("component") == F.col("largest")
    own = F.pmod(F.xxhash64("uid"), F.when(inside, some("main")).otherwise(some("rest")))
    whole = F.array(place(0, zero, zero, F.lit(-1)))
    with_rest = F.transform(parts("rest"), lambda x: place(1, own, x, F.lit(0)))
    with_main = F.transform(parts("main"), lambda x: place(1, x, own, F.lit(1)))
    each_other = F.transform(parts("rest"), lambda x: place(2, F.least(own, x), F.greatest(own, x), F.when(own == x, -1).otherwise(own)))
    places = F.when(F.col("main") == 0, whole).when(inside, with_rest).otherwise(F.concat(with_main, each_other))
    dealt = rows.withColumn("place", F.explode(places))
    key = F.when(F.col("main") == 0, F.col("key")).otherwise(F.xxhash64("key", "place.kind", "place.i", "place.j"))
    dealt = dealt.select(key.alias("key"), "uid", "n_shingles", "component", "sketch", "parity", "band", "bands", F.col("place.side").alias("side"))
    return dealt.repartition("key").sortWithinPartitions("key")


def _open(scratch: Scratch, facts: DataFrame, component: DataFrame, method: Method, bands: int) -> DataFrame:
    """(key, uid, facts, component, largest, main, rest) of the units in buckets that hold more than one component."""
    named = facts.join(component, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    keyed = named.select("uid", "component", F.posexplode(band_keys(method, bands)).alias("band", "key"))
    several = keyed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n"))
    several = several.where("least <> most").select("key", "n")
    some = scratch.keep(keyed.join(several, "key"))
    # Only buckets of more than GROUP units are dealt; their largest components are told by sums before the shuffle.
    large = some.where(F.col("n") > GROUP).groupBy("key", "component").agg(F.count("*").alias("n"))
    large = large.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("main"), F.sum("n").alias("n"))
    large = large.select("key", "largest", F.ceil(F.col("main") / GROUP).alias("main"), F.ceil((F.col("n") - F.col("main")) / GROUP).alias("rest"))
    some = some.drop("n").join(large, "key", "left").fillna(0, ["main", "rest"])
    return some.join(facts.select("uid", "n_shingles", "sketch", "parity", F.array(*band_names(method)).alias("bands")), "uid")


def links(scratch: Scratch, units: DataFrame, fetch: Fetch, method: Method) -> DataFrame:
    """(uid, component) of all units that link. ``units``: (uid long, bands), a row for each distinct set."""
    met = scratch.keep(candidates(units, method))
    first = met.where("a <> b")
    shared = met.select(F.col("a").alias("uid")).unionByName(met.select(F.col("b").alias("uid"))).distinct()
    texts = scratch.keep(fetch(shared))
    linked = scratch.keep(verified(scratch, first, texts, method))
    component = scratch.keep(connected(scratch, linked))

    # Units that share a bucket, with their components (a unit without links is its own): first the best pairs across
    # components, which join most of what is still apart, then all pairs that are left.
    facts = scratch.keep(described(texts, method))
    tried = first
    for best in (BEST, None):
        rows = _open(scratch, facts, component, method, method.bands if best is None else max(1, method.bands // FIRST_BANDS))
        more = scratch.keep(_groups(_dealt(rows), _across(method, best)).join(tried, ["a", "b"], "left_anti"))
        if more.isEmpty():
            continue
        linked = scratch.keep(verified(scratch, more, texts, method))
        tried = tried.unionByName(more)
        if not linked.isEmpty():
            # Components are stars already: their edges stand for all links found before.
            stars = component.select(F.col("component").alias("a"), F.col("uid").alias("b"))
            component = scratch.keep(connected(scratch, stars.unionByName(linked)))
    scratch.free(met, texts, facts)
    return component


def described(texts: DataFrame, method: Method) -> DataFrame:
    """(uid, n_shingles, sketch, parity, bands) of (uid, text)."""
    names = ["uid", "n_shingles", "sketch", "parity", *band_names(method)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column(1)):
                values, bounds, *signed = method.described(data, offsets) if method.described else method.sets(data, offsets)
                sig = K.super_minhash(*(signed or (values, bounds)), method.slots)
                made = [binary(sketches(sig, method.sketch_slots)), binary(parities(values, bounds, method.parity_bits))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), *made, *map(pa.array, bands_of(sig))], names)

    # Rows that share an id may have several texts here, which are one unit all the same.
    return texts.select("uid", "text").mapInArrow(run, "uid long, n_shingles long, sketch binary, parity binary, " + ", ".join(f"{k} long" for k in band_names(method)))


def least_of(placed: DataFrame, value: str) -> DataFrame:
    """(component, least): the least value of each component."""
    return placed.groupBy("component").agg(F.min(value).alias("least"))


def near_duplicates(documents: DataFrame, scratch: Scratch, method: Method = Method(), id_column: str = "doc_id") -> DataFrame:  # noqa: B008
    """(id, n_shingles, component_id, kept) of each row of documents."""
    texts = documents.select(id_column, "text")
    features = scratch.keep(signatures(texts, [id_column], method))
    same = ["n_shingles", "set_hi", "set_lo"]
    bands = band_names(method)
    sets = features.where("n_shingles > 0").groupBy(*same).agg(F.min(id_column).alias("first"), *[F.first(k).alias(k) for k in bands])
    sets = scratch.keep(sets.withColumn("uid", F.monotonically_increasing_id()))
    ids = sets.select("uid", "first")

    def fetch(wanted: DataFrame) -> DataFrame:
        named = texts.join(wanted.join(ids, "uid").hint("shuffle_hash"), F.col("first") == F.col(id_column)).select("uid", "text")
        lost = sets.where("first is null")
        if lost.isEmpty():
            return named
        # Sets of rows without id only: those rows are read again and told by their digests.
        nameless = signatures(texts.where(F.col(id_column).isNull()).withColumn("whole", F.col("text")), ["whole"], method)
        nameless = nameless.join(lost.select("uid", *same), same).select("uid", F.col("whole").alias("text")).dropDuplicates(["uid"])
        return named.unionByName(nameless.join(wanted, "uid", "left_semi"))

    component = links(scratch, sets.select("uid", *bands), fetch, method)
    placed = sets.select(*same, "uid", "first").join(component, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = scratch.keep(least_of(placed, "first"))
    labelled = scratch.keep(placed.join(least, "component").select(*same, F.col("least").alias("component_id")))
    # A set that very many documents share is split over tasks by the adaptive skew join.
    out = features.select(id_column, *same).join(labelled, same, "left")
    own = F.coalesce(F.col("component_id"), F.col(id_column))
    return out.select(id_column, "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col(id_column)).alias("kept"))


def keep_one(documents: DataFrame, scratch: Scratch, id_column: str = "doc_id") -> DataFrame:
    """The rows of documents whose id is the least of its group, all columns unchanged.

    Rows without a set are their own groups.
    """
    found = near_duplicates(documents, scratch, id_column=id_column)
    gone = scratch.keep(found.where(~F.col("kept")).select(id_column).distinct())
    return documents.join(gone, id_column, "left_anti")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op6"))


