"""N-gram Jaccard join by partitioning the universe of shingles (pigeonhole over segments).

Sets whose Jaccard is at least ``share`` per cent differ in at most H(n, m) shingles. Sizes are cut into bands
that grow by 100 / share, so partners lie in one band or in neighbours; the sets that may
meet from a band on (its own and the next) form a group with one bound H. Per group the universe is hashed into
H + 1 + s segments: two sets that link agree in at least s + 1, so each set is filed under what it holds of each
segment but the up to s smallest subsets, which are the common ones (empty, or a shared passage alone). Costs decide about exceptions: on a sample of at most ``sample`` rows the candidate pairs of
every segment are counted, and a segment whose subset is common (frequent shingles, empty) is not filed
where it is cheaper to file another under its one-deletion neighbourhood too, which tolerates one
difference and so pays for both. Any allocation finds all links; the sample only sets the work.

Sets that share an entry are candidates, but a group of near copies shares one with everybody, so
pairs are not listed. In each entry the set that meets most others is the centre; all are verified
against it, which gives components. In entries of several components the rest meets the next centre where that is of another
component, ``CENTRES`` times in all (``FEW`` times in entries of more than ``MANY`` members), and components are merged. Where those left
in an entry are still in several components, each is described by its difference from the first centre, whose symmetric differences are those of the sets: two
sets of different components that link must share labels of their differences, among the first ones in
an order common to all (inserted before missing ones, frequent inserted ones last where asked for), as prefix filtering has it. A set needs at
most H + 1 of them, whatever its length. What meets there is verified, and components are built again.
Before whole sets are moved for verification, pairs are ruled out by histograms of their hashes, whose
differences bound those of the sets from below. Every link is verified on the whole sets, or both its ends
are in one component already.

Rows that hash alike more than ``HOT`` times in one batch are passed on without being dealt out by key, so an entry
that holds a third of all rows sends few to one task.

Defined results: words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer
than ``width`` words is one shingle; null, empty and blank texts have size 0 and are their own component. Shingles are
compared by 64-bit hashes. Equal sets are linked, so repeated rows share a component. Null ids are
ignored unless a component has no other. Very long texts are joined whole. An empty table gives an empty result.
Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.common import Scratch, connected, lean, merged, table

WIDTH, SHARE, SAMPLE, HOT, CENTRES, COMMON = 4, 85, 2000, 16, 12, 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ONE, _TWO, _THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ROW_COST = 0.1  # an entry more, in candidate pairs
MARKS = ("marks_low", "marks_high")
FEW, MANY = 4, 1000  # centres of entries with more members than MANY: few of them would leave, the differences settle the rest


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _TWO
    values = (values ^ (values >> np.uint64(27))) * _THREE
    return values ^ (values >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, width: int = WIDTH):
        self.width, self.hashes = width, _Hashes()

    def of(self, text: bytes | str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        words = (text.encode() if isinstance(text, str) else text).translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        one = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(one))
        count = len(one) - width + 1
        found = np.full(count, width, np.uint64)
        for j in range(width):
            found = (found ^ one[j : j + count]) * _ONE
            found ^= found >> np.uint64(29)
        return np.unique(_mix(found))


def may_differ(n: int, m: int, share: int) -> int:
    """Most elements by which sets of sizes n and m may differ and still reach the share."""
    return (n + m) * (100 - share) // (100 + share)


class Bands:
    """Size bands and the groups that meet in them; group ``b`` holds band ``b`` and what it may meet in the next."""

    def __init__(self, share: int):
        self.share, self.upper = share, [100 // share]

    def groups(self, n: int) -> list[tuple[int, int]]:
        """(group, H) of the groups that a set of ``n`` takes part in, without those that only equal sets meet in."""
        while self.upper[-1] < n:
            self.upper.append((self.upper[-1] + 1) * 100 // self.share)
        own, found = bisect_left(self.upper, n), []
        for band in (own - 1, own):
            if band >= 0 and n <= (most := self.upper[band] * 100 // self.share):
                bound = may_differ(self.upper[band], most, self.share)
                if bound:
                    found.append((band, bound))
        return found


@lru_cache(maxsize=4096)
def _edges(count: int) -> np.ndarray:
    return np.array([(i << 64) // count for i in range(1, count)], np.uint64)


def _segments(shingles: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of ``count`` segments in the sorted hashes (one more at the end), sums of mixed hashes up to each place."""
    starts = np.concatenate([[0], np.searchsorted(shingles, _edges(count)), [len(shingles)]])
    return starts, np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(shingles ^ _ONE))])


def _tagged(sums: np.ndarray, group: int, segment: np.ndarray) -> np.ndarray:
    start = np.uint64((group + 1) * int(_ONE) % 2**64)
    return _mix(_mix(sums + start) ^ (segment.astype(np.uint64) + np.uint64(1)) * _TWO)


def slack(bound: int) -> int:
    """Segments beyond H + 1: so many more agree in two sets that link, and so many may be left unfiled."""
    return (bound + 1) // 8 + 1


def exact_entries(shingles: np.ndarray, group: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """One entry per segment: what the set holds of it; and how much that is."""
    starts, sums = _segments(shingles, count)
    return _tagged(sums[starts[1:]] - sums[starts[:-1]], group, np.arange(count)), np.diff(starts)


def deletion_entries(shingles: np.ndarray, group: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, entry) for each shingle: what the set holds of its segment without it."""
    starts, sums = _segments(shingles, count)
    segment = np.repeat(np.arange(count), np.diff(starts))
    whole = sums[starts[1:]] - sums[starts[:-1]]
    return segment, _tagged(whole[segment] - _mix(shingles ^ _ONE), group, segment)


def entries(shingles: np.ndarray, bands: Bands, plan: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """All entries a set is filed under.

    Subsets of the smallest sizes are left out as long as they are no more than the slack: of the segments in
    which two linked sets agree, one more than the slack, each of the two leaves out at most the slack, and by a size
    that both subsets have, so one is filed by both.
    """
    found = []
    for group, bound in bands.groups(len(shingles)) if len(shingles) else []:
        spare = slack(bound)
        count = bound + 1 + spare
        exact, sizes = exact_entries(shingles, group, count)
        filed, single = np.ones(count, bool), np.ones(count, bool)
        if group in plan:
            skipped, widened = plan[group]
            segment, more = deletion_entries(shingles, group, count)
            found.append(more[np.isin(segment, widened)])
            filed[skipped], single[skipped], single[widened] = False, False, False
        small = np.searchsorted(np.cumsum(np.bincount(sizes[single], minlength=1)), spare, side="right")
        filed &= ~(single & (sizes < small))
        found.append(exact[filed])
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _sampled(width: int, share: int) -> Callable:
    """(text) -> group, segment, widened, entry of all entries that any plan may file; segment -1 counts sets and shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bands = Shingles(width), Bands(share)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                found = shingles.of(text.as_py())
                for group, bound in bands.groups(len(found)) if len(found) else []:
                    count = bound + 1 + slack(bound)
                    exact, _ = exact_entries(found, group, count)
                    segment, more = deletion_entries(found, group, count)
                    segments = np.concatenate([np.arange(count), np.arange(count), segment, [-1]])
                    widened = np.concatenate([np.zeros(len(exact), bool), np.ones(len(exact) + len(more), bool), [False]])
                    values = np.concatenate([exact, exact, more, np.array([len(found)], np.uint64)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), group, np.int32)), pa.array(segments.astype(np.int32)), pa.array(widened), pa.array(values.view(np.int64))], names=["grp", "segment", "widened", "entry"]
                    )

    return run


def allocate(costs: dict[tuple[int, int, bool], float], sets: dict[int, tuple[float, float]], share: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per group the segments that are not filed and those that are filed with their one-deletion neighbourhoods.

    ``costs``: candidate pairs by (group, segment, widened); ``sets``: number of sets of a group and their shingles.
    H + 1 units and the slack are needed; an exact segment brings one, a widened one two, one that is left out none.
    """
    bands, plan = Bands(share), {}
    for group, (_, shingles) in sets.items():
        while len(bands.upper) <= group:
            bands.groups(bands.upper[-1] + 1)
        upper = bands.upper[group]
        bound = may_differ(upper, upper * 100 // share, share)
        count = bound + 1 + slack(bound)
        exact = np.array([costs.get((group, i, False), 0.0) for i in range(count)])
        extra = np.array([costs.get((group, i, True), 0.0) for i in range(count)]) - exact + ROW_COST * shingles / count
        dear, cheap = list(np.argsort(-exact, kind="stable")), list(np.argsort(extra, kind="stable"))
        skipped, widened = [], []
        while dear and cheap:
            if cheap[0] in skipped or cheap[0] == dear[0]:
                cheap.pop(0)
            elif dear[0] in widened or exact[dear[0]] <= extra[cheap[0]]:
                break
            else:
                skipped.append(int(dear.pop(0)))
                widened.append(int(cheap.pop(0)))
        if skipped:
            plan[group] = (np.array(skipped), np.array(widened))
    return plan


def _plan(rows: DataFrame, width: int, share: int, sample: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    thin = max(1, -(-rows.count() // sample))
    some = rows.filter(F.pmod(F.xxhash64("row"), F.lit(thin)) == 0).select("text")
    filed = some.mapInArrow(lean(_sampled(width, share)), "grp int, segment int, widened boolean, entry long")
    filed = filed.groupBy("grp", "segment", "widened", "entry").agg(F.count(F.lit(1)).alias("c"))
    pairs = F.when(F.col("segment") < 0, F.col("c")).otherwise(F.col("c") * (F.col("c") - 1))
    found = filed.filter("c > 1 or segment < 0").groupBy("grp", "segment", "widened").agg(F.sum(pairs).alias("c"), F.sum(F.expr("if(segment < 0, entry * c, 0)")).alias("shingles")).collect()
    sets = {r["grp"]: (float(r["c"] * thin), float(r["shingles"] * thin)) for r in found if r["segment"] < 0}
    costs = {(r["grp"], r["segment"], r["widened"]): float(r["c"]) * thin * thin for r in found if r["segment"] >= 0}
    return allocate(costs, sets, share)


def histogram(shingles: np.ndarray) -> np.ndarray:
    """Shingles by hash range, a power of two of them, counts of at most 255; the sum of differences bounds how sets differ from below."""
    bits = max(4, (len(shingles) // 4).bit_length() - 1)
    counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8)


def least_difference(one: np.ndarray, two: np.ndarray) -> int:
    """A lower bound of the elements by which two sets differ, from their histograms."""
    if len(one) > len(two):
        one, two = two, one
    fine = two.astype(np.int64).reshape(len(one), -1).sum(1)
    wide = np.minimum(fine, 255) if len(one) != len(two) else fine  # the coarser one is cut at 255
    return int(np.abs(one.astype(np.int64) - wide).sum())


def _features(width: int, share: int, plan: dict) -> Callable:
    """(id, row, text) -> id, row, node, n, histogram, entries; a set met before in the task is not filed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bands, seen = Shingles(width), Bands(share), set()
        for batch in batches:
            nodes, sizes, bins, filed = [], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                found = shingles.of(text.as_py())
                node = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                nodes.append(node)
                sizes.append(len(found))
                bins.append(histogram(found).tobytes())
                filed.append(np.zeros(0, np.int64) if node in seen else entries(found, bands, plan).view(np.int64))
                seen.add(node)
                if len(seen) > 200_000:
                    seen.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bins, pa.binary()), pa.array(filed, pa.list_(pa.int64()))],
                names=["id", "row", "node", "n", "bins", "entries"],
            )

    return run


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(num, entries) -> entry, hot, num: one row per entry."""
    for batch in batches:
        values = batch.column(1).flatten().to_numpy()
        nums = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
        _, place, count = np.unique(values, return_inverse=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(count[place] > HOT), pa.array(nums)], names=["entry", "hot", "num"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by entry -> those that are not alone with theirs, and all hot ones; ``hot`` is the second column."""
    held, kept = None, False  # the last row, of which it is not known yet whether another follows
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        entry, use = rows.column(0).to_numpy(), rows.column(1).to_numpy(zero_copy_only=False).copy()
        same = entry[1:] == entry[:-1]
        use[0] |= kept
        use[1:] |= same
        use[:-1] |= same
        held, kept = rows.slice(rows.num_rows - 1), bool(use[-1])
        yield rows.slice(0, rows.num_rows - 1).filter(pa.array(use[:-1]))
    if kept:
        yield held


def _sets(width: int) -> Callable:
    """(node, text) -> node, sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            found = [shingles.of(text.as_py()).tobytes() for text in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "items"])

    return run


def _near(share: int) -> Callable:
    """(a, b, n_a, bins_a, n_b, bins_b) -> the pairs that their histograms do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            one, two = batch.column(3), batch.column(5)
            use = np.array([least_difference(np.frombuffer(one[i].as_buffer(), np.uint8), np.frombuffer(two[i].as_buffer(), np.uint8)) <= may_differ(int(n[i]), int(m[i]), share) for i in range(len(n))], bool)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(k).to_numpy()[use]) for k in (0, 1)], names=["a", "b"])

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, bins) -> node and its histogram over sixteen ranges, a byte each, in two longs."""
    for batch in batches:
        wide = [np.frombuffer(one.as_buffer(), np.uint8).reshape(16, -1).sum(1) for one in batch.column(1)]
        marks = np.minimum(np.array(wide, np.int64).reshape(-1, 16), 255).astype(np.uint8).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy())], names=["node", *MARKS])


def _meets(share: int, one: str, two: str) -> str:
    """Whether rows may link by what their marks differ at least; ``one`` and ``two`` name the columns n and marks of either."""
    ranges = [(mark, bit) for mark in MARKS for bit in range(0, 64, 8)]
    apart = " + ".join(f"abs((shiftright({one.format(mark)}, {bit}) & 255) - (shiftright({two.format(mark)}, {bit}) & 255))" for mark, bit in ranges)
    return f"coalesce({apart}, 0) <= (({one.format('n')} + {two.format('n')}) * {100 - share}) div {100 + share}"


def _items(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _linked(share: int) -> Callable:
    """(a, b, items_a, items_b) -> the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                left, right = _items(batch.column(2)[i]), _items(batch.column(3)[i])
                common = len(np.intersect1d(left, right, assume_unique=True))
                use[i] = 100 * common >= share * (len(left) + len(right) - common)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(k).to_numpy()[use]) for k in (0, 1)], names=["a", "b"])

    return run


def difference_prefix(centre: np.ndarray, own: np.ndarray, share: int, strict: bool = True, rank: Callable | None = None) -> tuple[np.ndarray, int]:
    """The first labels of the difference that a link to another component has to share one of, and its size.

    With ``strict``, sets near the centre are in its component, so their partners elsewhere are far from it.
    ``rank`` orders the inserted labels, the same way for all sets of a centre.
    """
    n, c = len(own), len(centre)
    inserted = np.setdiff1d(own, centre, assume_unique=True)
    if rank is not None:
        inserted = inserted[np.lexsort((inserted, rank(inserted)))]
    labels = np.concatenate([inserted, np.setdiff1d(centre, own, assume_unique=True)])
    size = len(labels)
    # the other's difference is at least size - H, so at least size - H labels are common
    needed = max(1, size - may_differ(n, n * 100 // share, share))
    if strict and size <= may_differ(n, c, share):  # in the centre's component, so the other one is not linked to the centre
        needed = max(needed, -(-(size + (c - n) * (100 - share) // (100 + share) + 1) // 2))
    return labels[: max(0, size - needed + 1)], size


def _place(labels: np.ndarray, centre: np.ndarray | int, salt: np.uint64 = _TWO) -> np.ndarray:
    """Entries of labels under centres."""
    return _mix(labels ^ _mix(np.asarray(centre).astype(np.int64).view(np.uint64) * _ONE + salt))


def _inserted(share: int) -> Callable:
    """(member, centre, items of the centre, items) -> centre, entry of each label that the centre lacks, for sets not much farther than links reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                middle, own = np.sort(_items(batch.column(2)[i])), np.sort(_items(batch.column(3)[i]))
                labels = np.setdiff1d(own, middle, assume_unique=True)
                if len(labels) <= 4 * (may_differ(len(own), len(own), share) + 1):
                    centre = np.full(len(labels), batch.column(1)[i].as_py(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(centre), pa.array(_place(labels, centre).view(np.int64))], names=["centre", "entry"])

    return run


def _differences(share: int, strict: bool) -> Callable:
    """(member, centre, items of the centre, items, common entries, their counts) -> entry (of centre and label), hot, member, size, place.

    Labels that are common among the sets of a centre come after the others it lacks. Place 0 is a row of the
    member as such, with an entry of the centre alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = []
            for i in range(batch.num_rows):
                rank, centre = None, batch.column(1)[i].as_py()
                if batch.column(4)[i].is_valid:
                    known, counts = (batch.column(at)[i].values.to_numpy() for at in (4, 5))
                    order = np.argsort(known)
                    known, counts = known[order], counts[order]

                    def rank(labels, known=known, counts=counts, centre=centre):
                        entry = _place(labels, np.full(len(labels), centre, np.int64)).view(np.int64)
                        at = np.minimum(np.searchsorted(known, entry), len(known) - 1)
                        return np.where(known[at] == entry, counts[at], 0)

                parts.append(difference_prefix(np.sort(_items(batch.column(2)[i])), np.sort(_items(batch.column(3)[i])), share, strict, rank))
            counts = np.array([len(labels) + 1 for labels, _ in parts], np.int64)
            each = lambda values: np.repeat(np.asarray(values, np.int64), counts)
            places = np.arange(counts.sum()) - each(np.cumsum(counts) - counts)
            labels = np.concatenate([np.concatenate([np.zeros(1, np.uint64), labels]) for labels, _ in parts])
            centres = each(batch.column(1).to_numpy())
            entry = np.where(places == 0, _place(labels, centres, _THREE), _place(labels, centres))
            columns = [entry.view(np.int64), places == 0, each(batch.column(0).to_numpy()), each([size for _, size in parts]).astype(np.int32), places.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["entry", "hot", "member", "size", "place"])

    return run


def _pairs(met: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) of the members of entries and their centres ``top``, without those whose sizes differ too much."""
    fits = met.filter(f"100 * least(n, top.n) >= {share} * greatest(n, top.n)")
    return fits.select(F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b"))


def centred(known: DataFrame, bins: DataFrame, share: int, scratch: Scratch, sets_of: Callable, verify: Callable) -> tuple[DataFrame, ...]:
    """(entry, node, n, c) -> what is left of mixed entries after all centres (entry, node, n, centre: the first), pairs met, (node, comp), sets.

    What the first centres link is one component before others are chosen, so entries of one component are settled, and
    later centres meet other components only, and those whose histograms over sixteen ranges do not rule out a link. ``sets_of``: nodes -> (node, items); ``verify``: (pairs, items, name) -> links.
    """
    weight = known.groupBy("node").agg(F.sum("c").alias("weight"))
    left = known.filter("c > 1").join(weight, "node").select("entry", "node", "n", "weight")
    first = left.groupBy("entry").agg(F.max(F.struct("weight", "node", "n")).alias("top"))
    met = scratch.write(left.join(first, "entry").filter("node != top.node"), "round-0")
    star = scratch.write(_pairs(met, share).distinct(), "star-0")
    near = may_link(star, bins, share, scratch, "near-0")
    items = scratch.write(sets_of(near.select("a").union(near.select("b")).toDF("node").distinct()), "items-0")
    scratch.settle()
    links = verify(near, items, "links-0")
    parts = connected(links, scratch, "parts-0")

    marks = bins.select("node", "bins").mapInArrow(lean(_marks), f"node long, {MARKS[0]} long, {MARKS[1]} long").join(parts, "node", "left")
    placed = met.join(marks, "node", "left").select("entry", "node", "n", "weight", *MARKS, F.col("top.node").alias("centre"), F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("entry").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("c")).filter("low != high").select("entry", "c")
    left, pairs = scratch.write(placed.join(mixed, "entry"), "round-mixed"), None
    scratch.drop("round-0")
    last = "round-mixed"
    for turn in range(1, CENTRES):  # whoever meets a centre leaves the entry to the next one without it
        top = left.groupBy("entry").agg(F.max(F.struct("weight", "node", "n", "comp", *MARKS)).alias("top"))
        met = scratch.write(left.join(top, "entry").filter("node != top.node"), f"round-{turn}")
        found = scratch.write(_pairs(met.filter("comp != top.comp").filter(_meets(share, "{}", "top.{}")), share).distinct(), f"pairs-{turn}")
        pairs = found if pairs is None else pairs.unionByName(found)
        left = met.drop("top")
        if turn == FEW:
            aside, left = left.filter(f"c > {MANY}"), left.filter(f"c <= {MANY}")
        if turn != FEW + 1:  # what is aside is read in the end
            scratch.drop(last)
        last = f"round-{turn}"
        if turn % 4 == 0:
            scratch.settle()
    left = left.unionByName(aside)
    more = scratch.write(pairs.distinct().join(star, ["a", "b"], "left_anti"), "star-1")
    scratch.settle()
    near = may_link(more, bins, share, scratch, "near-1")
    nodes = near.select("a").union(near.select("b")).union(left.select("node")).union(left.select("centre")).toDF("node").distinct()
    items = items.unionByName(scratch.write(sets_of(nodes.join(items, "node", "left_anti")), "items-1"))
    scratch.settle()
    again = verify(near, items, "links-1")
    return left.drop("comp", "c"), star.unionByName(more), merged(parts, again, scratch, "parts-1"), items


def across(left: DataFrame, parts: DataFrame, items: DataFrame, share: int, scratch: Scratch, moved: bool = False, ranked: bool = False) -> DataFrame:
    """Pairs (a, b) of different components that may link, of those left in the same entry.

    ``parts``: node, comp by the links found so far. Differences from a common centre have to share what a link needs.
    With ``moved``, a link asks for more than the share, so a set near the centre need not be in its component;
    such sets also meet those near it with which they need not share a label. ``ranked`` puts labels that are
    frequent among the sets of a centre last, for groups whose members differ little more than links may.
    """
    placed = left.join(parts, "node", "left").select("entry", "node", "n", "centre", *MARKS, F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("entry").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("entry")
    members = placed.join(mixed, "entry", "left_semi").select("centre", "node", "n", "comp", *MARKS).distinct()
    members = members.join(parts.select(F.col("node").alias("centre"), F.col("comp").alias("comp_c")), "centre", "left").withColumn("comp_c", F.coalesce("comp_c", "centre"))
    members = scratch.write(members.withColumn("member", F.monotonically_increasing_id()), "members")
    # only the items that are asked for are dealt out
    nodes = scratch.write(members.select("node").distinct(), "member-nodes")
    centres = scratch.write(members.select(F.col("centre").alias("node")).distinct(), "member-centres")
    owns, middles = (items.join(some, "node", "left_semi") for some in (nodes, centres))
    described = members.join(owns.toDF("node", "own"), "node").join(middles.toDF("centre", "middle"), "centre")
    described = described.select("member", "centre", "middle", "own")
    if ranked:  # the sets are read twice for it
        place = F.row_number().over(W.partitionBy("centre").orderBy(F.col("c").desc(), "entry"))
        counted = described.mapInArrow(lean(_inserted(share)), "centre long, entry long").groupBy("centre", "entry").agg(F.count(F.lit(1)).alias("c")).filter("c > 2")
        counted = scratch.write(counted.withColumn("at", place).filter(F.col("at") <= COMMON), "common")
        lists = counted.groupBy("centre").agg(F.collect_list(F.struct("entry", "c")).alias("common"))
        described = described.join(lists, "centre", "left").select("member", "centre", "middle", "own", "common.entry", "common.c")
    else:
        none = F.lit(None).cast("array<long>")
        described = described.withColumns({"entry": none, "c": none})
    described = described.mapInArrow(lean(_differences(share, not moved)), "entry long, hot boolean, member long, size int, place int")
    described = described.repartition(F.when(F.col("hot"), F.col("member")).otherwise(F.col("entry"))).sortWithinPartitions("entry")
    described = scratch.write(described.mapInArrow(lean(_shared), "entry long, hot boolean, member long, size int, place int").drop("hot"), "differences")
    described = scratch.write(described.join(members, "member"), "described")
    names = ["node", "comp", "n", "size", "place", *MARKS]
    rows = described.filter("place > 0")
    other = rows.select("entry", *[F.col(c).alias(f"{c}_b") for c in names])
    common = f"((size + size_b - ((n + n_b) * {100 - share}) div {100 + share} + 1) div 2)"
    met = F.expr(f"node < node_b and comp != comp_b and 100 * least(n, n_b) >= {share} * greatest(n, n_b) and place <= size - {common} + 1 and place_b <= size_b - {common} + 1")
    pairs = rows.join(other, "entry").filter(met).filter(_meets(share, "{}", "{}_b")).select(F.col("node").alias("a"), F.col("node_b").alias("b"))
    if moved:
        sizes = items.select(F.col("node").alias("centre"), (F.length("items") / 8).cast("long").alias("n_c"))
        near = described.filter("place = 0").join(sizes, "centre").filter(f"size <= ((n + n_c) * {100 - share}) div {100 + share}")
        strange = near.filter("comp != comp_c").select("centre", F.col("node").alias("node_b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("size").alias("size_b"))
        # what differs more in sum has to share labels and has met by them
        meet = near.join(strange, "centre").filter(f"node != node_b and comp != comp_b and size + size_b <= ((n + n_b) * {100 - share}) div {100 + share}")
        pairs = pairs.unionByName(meet.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")))
    return pairs.distinct()


def may_link(pairs: DataFrame, bins: DataFrame, share: int, scratch: Scratch, name: str) -> DataFrame:
    both = pairs.join(bins.toDF("b", "n_b", "bins_b"), "b").join(bins.toDF("a", "n_a", "bins_a"), "a")
    return scratch.write(both.select("a", "b", "n_a", "bins_a", "n_b", "bins_b").mapInArrow(lean(_near(share)), "a long, b long"), name)


def _row(id: str, text: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("null")), F.lit("\x1f"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def components(docs: DataFrame, scratch: Scratch, id: str = "doc_id", text: str = "text", width: int = WIDTH, share: int = SHARE, sample: int = SAMPLE) -> DataFrame:
    """One row per row: id, n_shingles, component_id (the smallest id that links lead to)."""
    rows = docs.select(F.col(id).cast("long").alias("id"), _row(id, text).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plan = _plan(rows, width, share, sample)
    made = rows.mapInArrow(lean(_features(width, share, plan)), "id long, row string, node binary, n long, bins binary, entries array<long>")
    features = scratch.write(made.withColumn("num", F.monotonically_increasing_id()), "features")
    first = features.filter("n > 0").groupBy("node").agg(F.min("num").alias("rep"))
    owners = scratch.write(features.select("num", "id", "row", "node", "n").join(first, "node", "left").select("num", "id", "row", "n", F.coalesce("rep", "num").alias("rep")), "owners")
    bins = scratch.write(features.filter("size(entries) > 0").select(F.col("num").alias("node"), "n", "bins"), "bins")
    filed = features.select("num", "entries").mapInArrow(lean(_filed), "entry long, hot boolean, num long")
    dealt = filed.repartition(F.when(F.col("hot"), F.col("num")).otherwise(F.col("entry"))).sortWithinPartitions("entry")
    shared = scratch.write(dealt.mapInArrow(lean(_shared), "entry long, hot boolean, num long").drop("hot"), "shared")
    scratch.drop("features")
    scratch.settle()
    met = shared.join(owners.select("num", "rep", "n"), "num").select("entry", F.col("rep").alias("node"), "n").distinct()
    met = scratch.write(met, "met")
    scratch.drop("shared")
    sizes = met.groupBy("entry").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    known = scratch.write(met.join(sizes, "entry"), "known")
    scratch.drop("met")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = owners.join(nodes, owners["num"] == nodes["node"], "left_semi").select("row", F.col("num").alias("node"))
        return rows.join(wanted, "row").dropDuplicates(["node"]).select("node", "text").mapInArrow(lean(_sets(width)), "node long, items binary")

    def verify(pairs: DataFrame, items: DataFrame, name: str) -> DataFrame:
        both = pairs.join(items.toDF("b", "items_b"), "b").join(items.toDF("a", "items_a"), "a").select("a", "b", "items_a", "items_b")
        return scratch.write(both.mapInArrow(lean(_linked(share)), "a long, b long"), name)

    left, star, parts, items = centred(known, bins, share, scratch, sets_of, verify)
    scratch.drop("known")
    rest = scratch.write(across(left, parts, items, share, scratch).join(star, ["a", "b"], "left_anti"), "rest")
    more = verify(may_link(rest, bins, share, scratch, "near-rest"), items, "links-rest")
    found = merged(parts, more, scratch, "all")
    named = scratch.write(owners.join(found, owners["rep"] == found["node"], "left").select("id", "num", "n", F.coalesce("comp", "rep").alias("comp")), "named")
    for spent in ("owners", "bins", "items-0", "items-1", "differences", "described", f"round-{FEW}", f"round-{CENTRES - 1}"):  # the result reads ``named`` alone
        scratch.drop(spent)
    smallest = named.groupBy("comp").agg(F.min("id").alias("smallest"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("comp", "smallest")
    return named.join(smallest, "comp", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"), Scratch(spark, "sets"))
    return found.withColumnRenamed("id", "doc_id")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE = f"""
WITH RECURSIVE worded AS (SELECT row_number() OVER () AS place, doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT place, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s FROM worded),
each AS (SELECT place, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (SELECT a.place AS a, b.place AS b FROM each a JOIN each b ON a.shingle = b.shingle AND a.place <> b.place
          GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT place, place AS other FROM sets UNION SELECT reach.place, b FROM reach JOIN links ON a = other)
SELECT sets.doc_id, CAST(len(any_value(sets.s)) AS BIGINT) AS n_shingles, min(far.doc_id) AS component_id
FROM sets JOIN reach ON reach.place = sets.place JOIN sets far ON far.place = reach.other GROUP BY sets.place, sets.doc_id
"""
