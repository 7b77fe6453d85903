"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Texts with equal sets are one class. A class takes part only if enough of its smallest elements are
among another's smallest, as those of similar sets must be; most texts end there. The others, the candidates, are
linked in two ways, and a boundary between small and large sets, chosen by cost, says which:

* Two small sets. Similar sets share one of their first elements in one global order, and two of their first ones
  and one more. Each small set lists the subsets of SUBSET elements of these; sets that list the same one are compared.
* A pair with a large set. Each set that can be paired with a large one stands in the inverted lists of its first elements.

Elements of one set alone come first in that order (no list or subset needs them), heavy ones, of many sets, last. Sets that meet
are filtered by size and position, and what is left is compared as whole sets. Cost is counted in rows over all
candidates: subsets on one side, on the other list entries, each with the pair it makes and that pair's lookups.

The sets of a list, or of a subset, aren't compared all with all. A pivot is compared with the others; the classes that turn out
connected need no comparison among themselves, and only pairs across components remain. The
links found this way have the same components as all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import wordhash
from gaugeworks.llm.common import keyed_join, slices, stored, table, text_bytes
from gaugeworks.llm.components import components

#: Size of the subsets that small sets list. Sets that share more than half of all their elements, and aren't equal, share two.
SUBSET = 2
#: Rows that an entry of an inverted list costs where a subset costs one: itself, its pair, and the pair's four lookups.
SCAN_ROWS = 6
#: Most elements of two sets or more that a filter tells, which the driver makes and every worker holds: 16 bits each, so at most
#: 32 MB, in a power of two of at least so many bits. Beyond it the elements are joined.
FILTER_MOST, FILTER_LEAST_BITS = 1 << 24, 1 << 16
#: An element counts as heavy from so many lists on; doubled until at most HEAVY_MOST are.
HEAVY_LEAST, HEAVY_MOST = 16, 500_000
#: Most rows of ids or elements that are broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: The rest of the pairs is compared at once when it is at most so many times the rows of the lists, or so many.
WORK, WORK_LEAST = 4, 200_000_000
#: Pairs of one list that a task may be given whatever its even share.
PAIRS_LEAST = 1_000_000


def _first(n: int, num: int, den: int) -> int:
    """How many first elements of a set of n must be listed."""
    return n - -(-num * n // den) + 1


def _smallest(n: int, num: int, den: int, quarters: int) -> int:
    """How many smallest elements tell whether a set of n can be similar to another."""
    return min(n, _first(n, num, den) * quarters // 4 + 4)


def _common(n: int, num: int, den: int, quarters: int) -> int:
    """How many of its smallest elements a set of n shares at least with those of any similar set.

    Of the smallest elements of either set at most _first - 1 lie outside the other. Take the set whose
    smallest ones end first: the rest of these are among the other's smallest. The bound grows
    with the size, so the least partner sets it.
    """
    t = max(1, -(-num * n // den))
    return _smallest(t, num, den, quarters) - _first(t, num, den) + 1


def _needed(a: int, b: int, num: int, den: int) -> int:
    """Least number of shared elements of similar sets of sizes a and b."""
    return -(-num * (a + b) // (num + den))


def _spark_sets(batch: pa.RecordBatch, at: int, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = text_bytes(batch.column(at))
    for a, b in slices(np.diff(offsets), 2_000_000):
        h, n = wordhash.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        ends = np.cumsum(n)
        for i in range(b - a):
            yield a + i, wordhash.shingles(h[ends[i] - n[i] : ends[i]], shingle)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set: sums of two unlike mixes of its elements."""
    u = s.view(np.uint64)
    one, two = wordhash.mix(u).sum(dtype=np.uint64), wordhash.mix(u * np.uint64(wordhash.BASE) + np.uint64(1)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _profiles(docs: DataFrame, id: str, text: str, shingle: int, num: int, den: int, quarters: int, whole: bool) -> DataFrame:
    """id_, n, d1, d2 and some: the set (whole), or its smallest elements."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                n, d1, d2, some = [], [], [], []
                for _, s in _spark_sets(part, 1, shingle):
                    n.append(len(s))
                    one, two = _digest(s)
                    d1.append(one)
                    d2.append(two)
                    some.append(s if whole else s[: _smallest(len(s), num, den, quarters)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _lists(some)], ["id_", "n", "d1", "d2", "some"])

    return docs.select(docs[id].alias("id_"), docs[text].cast("string").alias("text_")).mapInArrow(run, f"id_ {kind}, n int, d1 long, d2 long, some array<long>")


class _Filter:
    """A filter of fixed size over elements: says yes for all it was made of and few others."""

    def __init__(self, elements: DataFrame, count: int):
        self.bits = max(FILTER_LEAST_BITS, 1 << (16 * max(count, 1) - 1).bit_length())
        self.words = np.zeros(self.bits // 64, np.uint64)
        mask = self.bits - 1
        bit = F.explode(F.array(F.expr(f"e & {mask}L"), F.expr(f"shiftrightunsigned(e, 27) & {mask}L")))
        words = elements.select(bit.alias("b")).groupBy(F.expr("shiftright(b, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("v"))
        got = words.toArrow()  # at most FILTER_MOST / 4 rows
        self.words[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)

    def holds(self, e: np.ndarray) -> np.ndarray:
        u, mask, out = e.view(np.uint64), np.uint64(self.bits - 1), True
        for b in (u & mask, (u >> np.uint64(27)) & mask):
            out = out & ((self.words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def _candidates(classes: DataFrame, shared: _Filter, num: int, den: int, quarters: int) -> DataFrame:
    """cid of the classes that can be similar to another, as far as their smallest elements tell."""
    told = classes.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, keep = batch.column(2), []
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            known = np.concatenate(([0], np.cumsum(told.value.holds(values))))
            for i, n in enumerate(batch.column(1).to_pylist()):
                end = min(offsets[i + 1], offsets[i] + _smallest(n, num, den, quarters))
                keep.append(known[end] - known[offsets[i]] >= _common(n, num, den, quarters))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], ["cid"])

    return classes.select("cid", "n", "some").mapInArrow(run, "cid long")


def _firsts(sets: DataFrame, shared: _Filter, heavy: np.ndarray, num: int, den: int) -> DataFrame:
    """cid, n, first: the elements to list, and one more. Order: not shared, shared, heavy; each by value. alone: how many come first that nobody shares."""
    told = sets.sparkSession.sparkContext.broadcast((shared, heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, firsts, alone = batch.column(2), [], []
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            kind = told.value[0].holds(values).astype(np.int8)
            kind[np.isin(values, told.value[1])] = 2
            for i, n in enumerate(batch.column(1).to_pylist()):
                s, k = values[offsets[i] : offsets[i + 1]], kind[offsets[i] : offsets[i + 1]]
                p = min(n, _first(n, num, den) + SUBSET - 1)
                own = int((k == 0).sum())
                alone.append(min(own, p))
                firsts.append(np.concatenate((s[k == 1], s[k == 2]))[: max(0, p - own)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(firsts), pa.array(alone, pa.int32())], ["cid", "n", "first", "alone"])

    return sets.select("cid", "n", "some").mapInArrow(run, "cid long, n int, first array<long>, alone int")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class _Join:
    """One run of the join; the stored tables that its steps share."""

    def __init__(self, docs: DataFrame, id: str, text: str, shingle: int, num: int, den: int, quarters: int):
        self.quarters = quarters
        self.docs, self.id, self.text, self.shingle, self.num, self.den = docs, id, text, shingle, num, den
        self.rows = stored(_profiles(docs, id, text, shingle, num, den, quarters, whole=False), "jaccard-profiles")
        grouped = self.rows.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("id_").alias("least_id"), F.first("some").alias("some"))
        self.classes = stored(grouped.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
        self.needed = lambda a, b: f"(({num} * ({a} + {b}) + {num + den - 1}) div {num + den})"

    def shared(self, sets: DataFrame) -> tuple[DataFrame, int]:
        """Elements of two sets or more, stored, with the number of sets; and how many they are."""
        counts = sets.select(F.explode("some").alias("e")).groupBy("e").agg(F.count("*").alias("df"))
        out = stored(counts.filter("df > 1"), "jaccard-shared")
        return out, out.count()

    def heavy(self, shared: DataFrame) -> int:
        """How many sets must hold an element that counts as heavy, so that at most HEAVY_MOST do."""
        steps = [HEAVY_LEAST << i for i in range(40)]
        many = shared.agg(*(F.count_if(F.col("df") >= x).alias(f"c{x}") for x in steps)).first()
        return next(x for x, k in zip(steps, many) if k <= HEAVY_MOST)

    def candidates(self) -> DataFrame:
        """cid of the classes that can be similar to another, as far as their smallest elements tell."""
        shared, count = self.shared(self.classes)
        if count <= FILTER_MOST:
            return _candidates(self.classes, _Filter(shared, count), self.num, self.den, self.quarters)
        met = keyed_join(self.classes.select("cid", "n", F.explode("some").alias("e")), shared.select("e", F.col("df").alias("__rows")), ["e"], by=["cid"])
        up = lambda x: f"(({self.num}L * {x} + {self.den - 1}) div {self.den})"
        # As _common, _first and _smallest have it.
        least = met.groupBy("cid", "n").agg(F.count("*").alias("k")).withColumn("t", F.expr(f"greatest(1L, {up('n')})")).withColumn("f", F.expr(f"t - {up('t')} + 1"))
        return least.filter(f"k >= least(t, f * {self.quarters} div 4 + 4) - f + 1").select("cid")

    def firsts(self, sets: DataFrame) -> DataFrame:
        """As _firsts has it, by a filter or by a join."""
        shared, count = self.shared(sets)
        heavy = self.heavy(shared)
        if count <= FILTER_MOST:
            # At most HEAVY_MOST elements.
            most = np.sort(shared.filter(F.col("df") >= heavy).select("e").toArrow().column(0).to_numpy())
            return _firsts(sets, _Filter(shared, count), most, self.num, self.den)
        met = keyed_join(sets.select("cid", "n", F.explode("some").alias("e")), shared.select("e", "df", F.col("df").alias("__rows")), ["e"], "left", by=["cid"])
        kind = F.when(F.col("df") >= heavy, 2).when(F.col("df").isNotNull(), 1)
        held = met.groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.when(kind.isNotNull(), F.struct(kind.alias("kind"), "e")))).alias("held"), F.count_if(F.col("df").isNull()).alias("own"))
        held = held.withColumn("p", F.expr(f"least(n, n - ({self.num}L * n + {self.den - 1}) div {self.den} + {SUBSET})")).withColumn("alone", F.least("own", "p").cast("int"))
        return held.select("cid", "n", F.expr("transform(slice(held, 1, cast(p - alone as int)), x -> x.e)").alias("first"), "alone")

    def whole(self, wanted: DataFrame) -> DataFrame:
        """cid, n, some: the whole sets of the wanted classes, from one text of each."""
        wanted = stored(wanted.distinct().join(self.classes.select("cid", "n", "d1", "d2", "least_id"), "cid"), "jaccard-wanted")
        count = wanted.count()
        ids = _bounded(wanted.select(F.col("least_id").alias("w_")).distinct(), count)
        texts = self.docs.select(self.id, self.text).join(ids, F.col(self.id).eqNullSafe(F.col("w_")), "left_semi")
        sets = _profiles(texts, self.id, self.text, self.shingle, self.num, self.den, self.quarters, whole=True)
        return sets.join(_bounded(wanted.select("cid", "n", "d1", "d2"), count), ["n", "d1", "d2"]).dropDuplicates(["cid"]).select("cid", "n", "some")

    def lists(self) -> tuple[DataFrame, DataFrame]:
        """sets: cid, n, some (whole) of the candidates; first: cid, n, first, alone."""
        sets = stored(self.whole(self.candidates()), "jaccard-sets")
        return sets, stored(self.firsts(sets), "jaccard-first")

    def boundary(self, first: DataFrame) -> int:
        """The size up to which sets are small: the one with the least cost of subsets and scans.

        Sets whose partners are all small are in no list. Sets that may share less than SUBSET elements are never small.
        """
        if 2 * self.num <= self.den:
            return 0
        held = F.size("first").cast("long")
        listed = F.least(held, F.expr(f"greatest(0, n - ({self.num}L * n + {self.den - 1}) div {self.den} + 1 - alone)"))
        told = first.groupBy("n").agg(F.sum(held * (held - 1) / 2).alias("subsets"), F.sum(listed).alias("entries")).collect()  # a row for each size
        scans = sum(r["entries"] for r in told) * SCAN_ROWS
        best, least, paid = 0, scans, 0
        lists = sorted((r["n"] * self.den // self.num, r["entries"]) for r in told)
        at = 0
        rows = sorted(told, key=lambda r: r["n"])
        for r, larger in zip(rows, [x["n"] for x in rows[1:]] + [lists[-1][0] + 1 if rows else 0]):
            paid += r["subsets"]
            size = larger - 1  # no set is larger than r and up to it
            while at < len(lists) and lists[at][0] <= size:
                scans, at = scans - SCAN_ROWS * lists[at][1], at + 1
            if paid + scans <= least:
                best, least = size, paid + scans
        return best

    def meetings(self, first: DataFrame, most: int) -> DataFrame:
        """e, f, cid, n, pos: who stands in the list of e (there f = e), or lists the subset of e and f. pos: how many of the
        set's elements come before the first that a partner met here first shares; of a subset one less, as two are shared."""
        listed = first.filter(f"n * {self.den}L div {self.num} > {most}").select("cid", "n", "alone", F.posexplode("first").alias("at", "e"))
        listed = listed.select("e", F.col("e").alias("f"), "cid", "n", (F.col("at") + F.col("alone")).alias("pos")).filter(f"pos <= n - ({self.num}L * n + {self.den - 1}) div {self.den}")
        twos = "flatten(transform(sequence(0, size(first) - 2), i -> transform(sequence(i + 1, size(first) - 1), j -> struct(first[i] as e, first[j] as f, j + alone - 1 as pos))))"
        subsets = first.filter((F.col("n") <= most) & (F.size("first") > 1)).select("cid", "n", F.expr(f"inline({twos})")).select("e", "f", "cid", "n", "pos")
        return stored(listed.unionByName(subsets), "jaccard-lists")

    def _fit(self, met: DataFrame, most: int, also: str = "true") -> DataFrame:
        """u, v of the pairs (cid, n, pos with p_cid, p_n, p_pos) that sizes and positions let be similar; in lists, one of them large."""
        fits = f"cid <> p_cid and (f <> e or greatest(n, p_n) > {most}) and {self.den}L * least(n, p_n) >= {self.num}L * greatest(n, p_n) and least(n - pos, p_n - p_pos) >= {self.needed('n', 'p_n')}"
        return met.filter(f"{fits} and {also}").select(F.least("cid", "p_cid").alias("u"), F.greatest("cid", "p_cid").alias("v")).distinct()

    def verified(self, pairs: DataFrame, sets: DataFrame, first: DataFrame) -> DataFrame:
        """The pairs that are similar, with the greater size: filtered by their listed elements, then compared as whole sets."""
        short = lambda key: first.select(F.col("cid").alias(key), F.col("n").alias(f"n_{key}"), F.col("first").alias(f"s_{key}"), (F.size("first") + F.col("alone")).alias(f"k_{key}"))
        full = lambda key: sets.select(F.col("cid").alias(key), F.col("n").alias(f"n_{key}"), F.col("some").alias(f"s_{key}"))
        pairs = stored(pairs, "jaccard-asked")
        near = keyed_join(keyed_join(pairs, short("u"), ["u"], by=["v"]), short("v"), ["v"], by=["u"], counted=pairs)
        # Beyond the listed elements of the one whose list ends first, at most the rest of it is shared.
        bound = f"size(array_intersect(s_u, s_v)) + greatest(n_u - k_u, n_v - k_v) >= {self.needed('n_u', 'n_v')}"
        kept = stored(near.filter(bound).select("u", "v"), "jaccard-pairs")
        met = keyed_join(keyed_join(kept, full("v"), ["v"], by=["u"]), full("u"), ["u"], by=["v"], counted=kept).withColumn("both", F.size(F.array_intersect("s_u", "s_v")))
        return stored(met.filter(f"{self.den}L * both >= {self.num}L * (n_u + n_v - both)").select("u", "v", F.greatest("n_u", "n_v").alias("size")), "jaccard-links")

    def links(self) -> DataFrame:
        """Links between classes that have the same components as all links."""
        sets, first = self.lists()
        most = self.boundary(first)
        lists = self.meetings(first, most)
        key = ["e", "f"]
        pivots = lists.groupBy(*key).agg(F.min(F.struct("pos", F.xxhash64("cid").alias("h"), "cid", "n")).alias("p"), F.count("*").alias("__rows")).filter("__rows > 1")
        pivots = stored(pivots.select(*key, F.col("p.cid").alias("p_cid"), F.col("p.n").alias("p_n"), F.col("p.pos").alias("p_pos"), "__rows"), "jaccard-pivots")
        found = self.verified(self._fit(keyed_join(lists, pivots, key), most), sets, first)
        left = lists.join(pivots.select(*key, F.col("p_cid").alias("cid")), [*key, "cid"], "left_anti")
        size, turn, tasks = lists.count(), 0, int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        while True:
            turn += 1
            groups = components(found)
            marked = left.join(groups, F.col("cid") == F.col("node"), "left").select(*key, "cid", "n", "pos", F.coalesce("component", "cid").alias("comp"))
            marked = stored(marked, "jaccard-marked")
            # Strays of a list: those outside the component with the smallest name. Counted by component first.
            per = marked.groupBy(*key, "comp").agg(F.count("*").alias("c")).groupBy(*key).agg(F.sum("c").alias("k"), F.min("comp").alias("main"), (F.sum("c") - F.min_by("c", "comp")).alias("s"))
            odd = stored(per.filter("s > 0"), "jaccard-odd")
            work, lengths = odd.agg(F.coalesce(F.sum(F.col("s") * F.col("k")), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
            if not work:
                break
            open_ = stored(keyed_join(marked, odd, key), "jaccard-open")
            limit = max(WORK * size, WORK_LEAST)
            last = work <= limit
            each = max(1, limit // max(lengths, 1))
            chance = F.lit(True) if last else F.pmod(F.xxhash64("cid", F.lit(turn)), F.col("s")) < each
            # A list's strays are compared with all others of it; not last: about ``each`` of them now, the rest later.
            # Where that is much work the others are dealt to several tasks, and the strays go to each.
            share = max(PAIRS_LEAST, 2 * min(work, limit) // tasks)
            parts = F.expr(f"cast(1 + {'s' if last else f'least(s, {each})'} * k div {share} as int)")
            strays = stored(open_.filter(F.col("comp") != F.col("main")).filter(chance), "jaccard-strays")
            dealt = open_.withColumn("salt", F.pmod(F.xxhash64("cid"), parts).cast("int"))
            copies = strays.select(*key, F.col("cid").alias("p_cid"), F.col("n").alias("p_n"), F.col("pos").alias("p_pos"), F.col("comp").alias("p_comp"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
            found = found.unionByName(self.verified(self._fit(dealt.join(copies, [*key, "salt"]), most, "comp <> p_comp"), sets, first))
            if last:
                break
            left = open_.select(*key, "cid", "n", "pos").join(strays.select(*key, "cid"), [*key, "cid"], "left_anti")
        small = F.count_if(F.col("size") <= most)
        of_subsets, of_scans = found.agg(small, F.count("*") - small).first()
        self.told = {"candidates": first.count(), "boundary": most, "subset_links": of_subsets, "scan_links": of_scans}
        return found


def ngram_jaccard_join(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, num: int = 80, den: int = 100, quarters: int | None = None, told: dict | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, class_id (the smallest id with an equal set) and
    component_id (the smallest id that links reach). Two texts are linked when
    den * shared shingles >= num * all shingles of both. These are components and not the links: pairs within
    a component that is connected already are not compared, so neither the links nor their number are given.

    A word is a run of bytes other than white space (20, 09-0D), A-Z as a-z. A text of fewer words is one
    shingle; null, empty or blank texts have none and link with nothing. Repeated rows fall into one
    class and stay rows. quarters: how many smallest elements decide who takes part, in quarters of those that must
    be listed; more of them tell better, and short shingles, often shared by chance, ask for more (8 up to three words,
    else 5). The result doesn't depend on it. told: takes the number of candidates, the boundary between small and large sets, and how
    many links subsets and scans have found. A null id takes part; it is nobody's smallest id unless all are null.
    """
    if not 0 < num <= den:
        raise ValueError("0 < num <= den")
    run = _Join(docs, id, text, shingle, num, den, quarters or (8 if shingle <= 3 else 5))
    groups = components(run.links())
    if told is not None:
        told |= run.told
    named = run.classes.select("cid", "n", "d1", "d2", "least_id").join(groups, F.col("cid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cid"))
    named = stored(named.select("n", "d1", "d2", "least_id", "comp"), "jaccard-named")
    least = stored(named.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.count("*").alias("__rows")), "jaccard-least")
    classes = stored(keyed_join(named, least, ["comp"]).select("n", "d1", "d2", "least_id", "component_id"), "jaccard-classes")
    return keyed_join(run.rows.drop("some"), classes, ["n", "d1", "d2"], "left", by=["id_"]).select(
        F.col("id_").alias(id), F.col("n").cast("long").alias("n_shingles"), F.coalesce("least_id", "id_").alias("class_id"), F.coalesce("component_id", "id_").alias("component_id")
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS s FROM d
), s AS (SELECT doc_id, unnest(s) AS e FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN g a ON a.doc_id = x JOIN g b ON b.doc_id = y WHERE 100 * c >= 90 * (len(a.s) + len(b.s) - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS o FROM g UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.o)
SELECT g.doc_id, len(g.s) AS n_shingles, CASE WHEN len(g.s) = 0 THEN g.doc_id ELSE min(g.doc_id) OVER (PARTITION BY g.s) END AS class_id, c.component_id
FROM g JOIN (SELECT doc_id, min(o) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
