"""Near-duplicate records: consistent weighted sampling, banded and verified.

A record is a bag of shingles.  Improved consistent weighted sampling draws,
for each of K hash functions, one (shingle, level) such that two records agree
with the probability of the weighted Jaccard similarity of their counts, which
is the similarity that is asked for: the chance to become a candidate depends
on it alone, not on how rare the shingles are.  (Under TF-IDF weights it has no
lower bound: records that share frequent words and differ in rare ones fall far
below the threshold.)  Samples are joined into bands.  A band row carries one
bit of each of 192 samples, so that two records that only share a band are told
apart where they meet, and few pairs travel on to be verified by the exact
similarity.  Equal bags are one class from the start.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import discard, join_shuffled, materialise

THRESHOLD = 0.7
#: A pair at the threshold is missed by all bands with the probability (1 - 0.7 ** 6) ** 56 = 0.0009, one at 0.8 with 4e-8.
ROWS, BANDS = 6, 56
#: Samples of which a band row carries a bit, and how far below the expected agreement a pair may lie (4e-6 of them lie further).
SKETCH, DEVIATIONS = 192, 4.5
SKETCHES = [f"s{i}" for i in range(SKETCH // 64)]  # its columns
_LONGS = ", ".join(f"{s} long" for s in SKETCHES)
#: Shingles in more than this share of the records are counted in a broadcast table, which bounds it.
FREQUENT = 0.002
#: A band with more records is not enumerated: they go the exact way by rare-shingle prefixes.
WIDE = 512
#: Shingles of one draw.
BLOCK = 2_000_000
#: Up to this many exact copies of a record are expanded into all pairs, more into a star.
EXPAND = 64

_WORD = re.compile(r"[^\W_]+")


def bag(parts: list[str | None], size: int = 1) -> Counter:
    """Counts of runs of ``size`` words (longest runs of letters or digits, lower-cased)."""
    ws = _WORD.findall(" ".join(p for p in parts if p).lower())
    if size > 1:
        ws = [" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)]
    return Counter(ws)


def _number(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little", signed=True)


def bags(df: DataFrame, key: str, columns: list[str], size: int = 1) -> DataFrame:
    """(k, u array<long> sorted, total, same, copy).

    ``u`` has a number for each occurrence of a shingle: its 56-bit number and
    how many came before, in eight bits (from the 257th occurrence on it is
    numbered anew), so that common occurrences are common numbers.  ``same``
    is equal for equal bags, ``copy`` for exactly equal columns (NULL is not
    the empty string).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            us: list[int] = []
            off, same, copy = [0], [], []
            for parts in zip(*[b.column(i + 1).to_pylist() for i in range(len(columns))]):
                rows: list[int] = []
                for w, n in bag(list(parts), size).items():
                    h = cache.get(w)
                    if h is None:
                        if len(cache) > 500_000:
                            cache.clear()
                        h = cache[w] = _number(w) >> 8 << 8
                    if n == 1:
                        rows.append(h)
                    else:
                        rows.extend(range(h, h + min(n, 256)))
                        for more in range(256, n, 256):
                            g = _number(f"{w} {more}") >> 8 << 8
                            rows.extend(range(g, g + min(n - more, 256)))
                rows.sort()
                us.extend(rows)
                off.append(len(us))
                same.append(hashlib.blake2b(np.array(rows, np.int64).tobytes(), digest_size=16).digest())
                copy.append(hashlib.blake2b(repr(parts).encode(), digest_size=16).digest())
            u = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(us, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), u, pa.array(np.diff(off), pa.int32()), pa.array(same, pa.binary()), pa.array(copy, pa.binary())], names=["k", "u", "total", "same", "copy"])

    rows = df.where(F.col(key).isNotNull()).select(key, *columns)
    return rows.mapInArrow(run, f"k {dict(df.dtypes)[key]}, u array<long>, total int, same binary, copy binary").where("total > 0")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniforms(h: np.ndarray, k: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers between 0 and 1 for each shingle, sample and part."""
    salt = ((k * 4 + part + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = _mix(h + np.uint64(salt))
    return ((x >> np.uint64(32)).astype(np.float64) + 0.5) / float(1 << 32), ((x & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / float(1 << 32)


class Sampler:
    """Consistent samples of many records at once.

    What a shingle with a weight draws does not depend on the record, so it is
    drawn once for each distinct (shingle, weight); a record's sample is the
    least of what its own have drawn.
    """

    def __init__(self, h: np.ndarray, weight: np.ndarray, starts: np.ndarray):
        self.starts = starts
        order = np.lexsort((weight, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (weight[order][1:] != weight[order][:-1])
        self.inv = np.empty(len(h), np.int32)
        self.inv[order] = np.cumsum(new) - 1
        self.h, self.log = h[order][new].view(np.uint64), np.log(weight[order][new])

    def draw(self, k: int) -> np.ndarray:
        """Sample ``k`` of each record, as numbers: equal with the weighted Jaccard probability.

        What a shingle and level have drawn is the same in every record, so the least drawn stands for both.
        """
        u1, u2 = _uniforms(self.h, k, 0)
        u3, u4 = _uniforms(self.h, k, 1)
        beta, _ = _uniforms(self.h, k, 2)
        r = -np.log(u1 * u2)
        t = np.floor(self.log / r + beta)
        drawn = np.log(-np.log(u3 * u4)) - r * (t - beta) - r
        return _mix(np.minimum.reduceat(drawn[self.inv], self.starts).view(np.uint64) + np.uint64(k + 1))


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return col.flatten().to_numpy(), np.diff(col.offsets.to_numpy())


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together up to ``most`` shingles: the more records, the fewer distinct shingles for each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += len(b.column(1).flatten())
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def band_rows(reps: DataFrame, rows: int, bands: int) -> DataFrame:
    """(band long, k, total, s0 long, ...): one row a record and band, with the record's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, BLOCK):
            u, n = _flat(t.column(1).chunk(0))
            new = (u & 255) == 0  # the first occurrence of a shingle in its record
            first = np.flatnonzero(new)
            row_starts = (np.cumsum(new) - 1)[np.cumsum(n) - n]
            sampler = Sampler(u[first], np.diff(np.append(first, len(u))).astype(np.float64), row_starts)
            keys = np.zeros((bands, t.num_rows), np.uint64)
            sketch = np.zeros((SKETCH // 64, t.num_rows), np.uint64)
            for i in range(max(bands * rows, SKETCH)):
                x = sampler.draw(i)
                if i < bands * rows:
                    keys[i // rows] = _mix((keys[i // rows] + np.uint64(i // rows)) * np.uint64(31) + x)
                if i < SKETCH:
                    sketch[i // 64] |= (x & np.uint64(1)) << np.uint64(i % 64)
            cols = [t.column(0).chunk(0), t.column(2).chunk(0), *(pa.array(x.view(np.int64)) for x in sketch)]
            for key in keys:
                for lo in range(0, t.num_rows, 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)[lo : lo + 10_000]), *(x.slice(lo, 10_000) for x in cols)], names=["band", "k", "total", *SKETCHES])

    return reps.select("k", "u", "total").mapInArrow(run, f"band long, k {dict(reps.dtypes)['k']}, total int, {_LONGS}")


def least_agreement(threshold: float) -> float:
    """Bits of the sketches of two records that reach the threshold agree at least so often."""
    share = (1 + threshold) / 2
    return SKETCH * share - DEVIATIONS * math.sqrt(SKETCH * share * (1 - share))


def _pair_up(threshold: float, wide: int):
    """Band rows, sorted by band, to candidate pairs (a, b); each record of a wide band to (k, NULL, its sketch)."""
    least = least_agreement(threshold)

    def candidates(t: pa.Table) -> pa.RecordBatch | None:
        """Pairs of the whole bands of ``t``, whose width allows it."""
        band, total = t.column(0).to_numpy(), t.column(2).to_numpy().astype(np.float64)
        sketch = [t.column(s).to_numpy().view(np.uint64) for s in SKETCHES]
        lefts, rights = [], []
        at = np.arange(len(band))
        for step in range(1, wide):
            at = at[at + step < len(band)]
            at = at[band[at] == band[at + step]]
            if not len(at):
                break
            x, y = at, at + step
            agree = SKETCH - sum(np.bitwise_count(s[x] ^ s[y]).astype(np.int64) for s in sketch)
            ok = (agree >= least) & (total[x] >= total[y] * threshold - 1e-9) & (total[y] >= total[x] * threshold - 1e-9)
            lefts.append(x[ok])
            rights.append(y[ok])
        if not lefts or not sum(map(len, lefts)):
            return None
        k = t.column(1).combine_chunks()
        a, b = k.take(pa.array(np.concatenate(lefts))), k.take(pa.array(np.concatenate(rights)))
        less = pc.less(a, b)
        none = pa.nulls(len(a), pa.int64())
        out = pa.RecordBatch.from_arrays([pc.if_else(less, a, b), pc.if_else(less, b, a), *[none] * len(SKETCHES)], names=["a", "b", *SKETCHES])
        return out.filter(pc.not_equal(out.column(0), out.column(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        hot_band: int | None = None

        def hot(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for b in t.to_batches():
                yield pa.RecordBatch.from_arrays([b.column(1), pa.nulls(len(b), b.column(1).type), *b.columns[3:]], names=["a", "b", *SKETCHES])

        def close(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """Pairs and hot records of whole bands."""
            band = t.column(0).to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
            size = np.diff(np.append(edge, len(band)))
            broad = np.repeat(size > wide, size)
            if broad.any():
                yield from hot(t.filter(pa.array(broad)))
                t = t.filter(pa.array(~broad))
            if t.num_rows and (out := candidates(t)) is not None:
                yield out

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            band = t.column(0).to_numpy()
            if hot_band is not None:  # a wide band goes on
                n = int(np.searchsorted(band != hot_band, True)) if (band != hot_band).any() else len(band)
                yield from hot(t.slice(0, n))
                t, band = t.slice(n), band[n:]
                held = None
                if not len(band):
                    continue
                hot_band = None
            last = len(band) - int(np.argmax(band[::-1] != band[-1])) if (band != band[-1]).any() else 0
            yield from close(t.slice(0, last)) if last else ()
            held = t.slice(last)
            if held.num_rows > wide:
                hot_band = int(band[-1])
                yield from hot(held)
                held = None
        if held is not None and held.num_rows:
            yield from close(held)

    return run


def prefixes(hot: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(token, k, total, place): the rarest shingles of each hot record, one of which any similar record shares.

    Shingles are ordered by how many records have them.  The few frequent ones
    are counted in a broadcast table, the others in a join, each of whose keys
    has a bounded share of the rows.  ``token`` tells two size classes too:
    similar records lie in one or in two neighbouring classes, and for each of
    these a record's prefix is only as long as the smallest partner there asks.
    """
    n = reps.count()
    shingle = lambda u: u - u.bitwiseAND(F.lit(255))
    first = F.transform(F.filter("u", lambda u: u.bitwiseAND(F.lit(255)) == 0), shingle)
    freq = materialise(reps.select(F.explode(first).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "frequencies")
    many = F.col("n") > F.lit(FREQUENT * n)
    rows = hot.select("k", "total", *SKETCHES, F.explode("u").alias("x")).withColumn("w", shingle(F.col("x")))
    frequent = F.broadcast(freq.where(many))
    counted = rows.join(frequent, "w").unionByName(join_shuffled(rows.join(frequent, "w", "left_anti"), freq.where(~many), "w"))
    ordered = counted.groupBy("k", "total", *SKETCHES).agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("x")).select("k", "total", F.col("x.x").alias("u"), *SKETCHES)
    grow = 1 / threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tok: list[int] = []
            row: list[int] = []
            place: list[int] = []
            for i, (total, u) in enumerate(zip(*(b.column(j).to_pylist() for j in (1, 2)))):
                own = math.floor(math.log(total) / math.log(grow) + 1e-9)
                for pair in (0, 1, 2):  # partners of the same, the next and the previous class
                    other = own + (0, 1, -1)[pair]
                    smallest = max(total * threshold, grow**other)
                    need = total - math.ceil(threshold / (1 + threshold) * (total + smallest) - 1e-6) + 1
                    key = np.uint64((min(own, other) * 2 + (pair > 0)) & 0xFFFFFFFF)
                    for at, x in enumerate(u[: max(need, 0)]):
                        tok.append((x, int(key)))
                        row.append(i)
                        place.append(at)
            if not tok:
                continue
            x, key = (np.array(z, np.int64).view(np.uint64) for z in zip(*tok))
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(_mix(_mix(x) + key).view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(place, pa.int32()), *(c.take(at) for c in b.columns[3:])], names=["token", "k", "total", "place", *SKETCHES])

    return ordered.mapInArrow(run, f"token long, k {dict(reps.dtypes)['k']}, total int, place int, {_LONGS}")


def token_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a < b) that share a token, whose sizes, sketches and the rest after it allow the threshold.

    A token that many records have is spread over salts: one side is copied to each of them.
    """
    counts = rows.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    salted = join_shuffled(rows, counts, "token").withColumn("salts", F.ceil(F.col("m") / 4096).cast("int"))
    left = salted.select("token", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("k").alias("a"), F.col("total").alias("ta"), (F.col("total") - F.col("place")).alias("la"), *[F.col(s).alias(f"p{s}") for s in SKETCHES])
    right = salted.select("token", F.pmod(F.xxhash64("k"), "salts").cast("int").alias("salt"), F.col("k").alias("b"), F.col("total").alias("tb"), (F.col("total") - F.col("place")).alias("lb"), *[F.col(s).alias(f"q{s}") for s in SKETCHES])
    fits = (F.col("ta") >= F.col("tb") * threshold - 1e-9) & (F.col("tb") >= F.col("ta") * threshold - 1e-9)
    fits &= F.least("la", "lb") >= (F.col("ta") + F.col("tb")) * (threshold / (1 + threshold)) - 1e-9
    apart = sum((F.bit_count(F.col(f"p{s}").bitwiseXOR(F.col(f"q{s}"))) for s in SKETCHES), F.lit(0))
    fits &= apart <= SKETCH - least_agreement(threshold)
    return join_shuffled(left, right, ["token", "salt"]).where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()


def _verify(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold."""
    left = reps.select(F.col("k").alias("a"), F.col("u").alias("ua"))
    right = reps.select(F.col("k").alias("b"), F.col("u").alias("ub"))
    common = F.size(F.array_intersect("ua", "ub"))
    both = join_shuffled(join_shuffled(pairs, left, "a"), right, "b").select("a", "b", (common / (F.size("ua") + F.size("ub") - common)).alias("similarity"))
    return both.where(F.col("similarity") >= threshold - 1e-12)


def near_duplicates(df: DataFrame, key: str, columns: list[str], threshold: float = THRESHOLD, size: int = 1, rows: int = ROWS, bands: int = BANDS, wide: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal bags, and the membership.

    Gives (a, b, similarity) with a < b, representatives of classes, and
    (k, rep, lead): every record with shingles, the smallest key of its class
    and the smallest key of its exact copies (equal in all ``columns``).
    Repeated rows count once.  Records without words are in no class.  Bands
    that more than ``wide`` classes share are resolved exactly: any two of
    their records that reach the threshold share one of their rarest shingles.
    """
    kind = dict(df.dtypes)[key]
    all_bags = materialise(bags(df, key, columns, size), "bags")
    classes = all_bags.groupBy("same").agg(F.min("k").alias("rep"))
    leads = all_bags.groupBy("same", "copy").agg(F.min("k").alias("lead"))
    led = join_shuffled(all_bags.select("k", "same", "copy").distinct(), leads, ["same", "copy"])
    members = materialise(join_shuffled(led, classes, "same").select("k", "rep", "lead"), "members")
    reps = join_shuffled(all_bags, members.where("k = rep").select("k"), "k", "left_semi").dropDuplicates(["k"])
    reps = materialise(reps, "reps")
    discard(all_bags)
    sorted_bands = band_rows(reps, rows, bands).repartition("band").sortWithinPartitions("band")
    met = sorted_bands.mapInArrow(_pair_up(threshold, wide), f"a {kind}, b {kind}, {_LONGS}").dropDuplicates(["a", "b"])
    met = materialise(met, "candidates")
    found = met.where("b IS NOT NULL").select("a", "b")
    hot = met.where("b IS NULL").select(F.col("a").alias("k"), *SKETCHES)
    if not hot.isEmpty():
        exact = materialise(prefixes(join_shuffled(reps, hot, "k"), reps, threshold), "prefixes")
        found = found.unionByName(token_pairs(exact, threshold)).distinct()
    return materialise(_verify(found, reps, threshold), "links"), members


def expand(links: DataFrame, members: DataFrame, largest: int = EXPAND) -> DataFrame:
    """Pairs of records (a, b), a < b, from class links and membership.

    All links between records that differ are given, also those of equal bags
    (other word order, case or punctuation).  Only of exact copies, up to
    ``largest`` are expanded; more are linked as a star, each copy with the
    smallest key, which alone has their links to other records, so that copies
    never multiply.  With the membership (k, lead) every pair follows: copies
    of one lead are all pairs, and copies have the links of their lead.
    """
    sizes = members.groupBy("rep", "lead").agg(F.countDistinct("k").alias("n"))
    m = join_shuffled(members, sizes, ["rep", "lead"])
    ends = m.where((F.col("n") <= largest) | (F.col("k") == F.col("lead"))).select("rep", "k")
    cross = join_shuffled(links, ends.select(F.col("rep").alias("a"), F.col("k").alias("x")), "a")
    cross = join_shuffled(cross, ends.select(F.col("rep").alias("b"), F.col("k").alias("y")), "b").select("x", "y")
    many = join_shuffled(ends, ends.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep"), "rep", "left_semi")
    inside = join_shuffled(many.select("rep", F.col("k").alias("x")), many.select("rep", F.col("k").alias("y")), "rep").where("x < y").select("x", "y")
    star = m.where((F.col("n") > largest) & (F.col("k") != F.col("lead"))).select(F.col("lead").alias("x"), F.col("k").alias("y"))
    both = cross.unionByName(inside).unionByName(star)
    return both.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def groups(links: DataFrame, members: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected groups: (k, group_id, n_links), group_id the smallest key of the group.

    Every round each class takes the smallest label among its neighbours and
    its label's own label (so chains halve); rounds are written to the shared
    folder.  ``n_links`` counts the other classes a record is linked to.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = edges.select(F.col("a").alias("v")).distinct()
    label = materialise(nodes.select("v", F.col("v").alias("l")), "labels")
    for _ in range(max_rounds):
        near = join_shuffled(edges, label.withColumnRenamed("v", "b"), "b").select(F.col("a").alias("v"), "l")
        least = near.unionByName(label).groupBy("v").agg(F.min("l").alias("l"))
        up = label.select(F.col("v").alias("l"), F.col("l").alias("ll"))
        new = materialise(join_shuffled(least, up, "l", "left").select("v", F.least("l", F.coalesce("ll", "l")).alias("l")), "labels")
        changed = join_shuffled(new, label.withColumnRenamed("l", "o"), "v").where("l <> o").limit(1).count()
        label = new
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    degree = edges.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_links"))
    out = join_shuffled(members.select("k", "rep").distinct(), label.withColumnRenamed("v", "rep"), "rep", "left")
    out = join_shuffled(out, degree, "rep", "left")
    return out.select("k", F.coalesce("l", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
