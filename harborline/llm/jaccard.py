"""Exact Jaccard join of word-shingle sets, and the groups its links make.

Jaccard distance is a metric, and the join works by regions and pivots. In high dimension almost every pair lies at a
distance near 1, so regions drawn around pivots alone would each hold nearly all documents. The first regions are
therefore cells that provably hold both ends of every link: shingles that a linked pair has in common. They are found in
two steps. A sieve looks at the first few shingles of each set in hash order, of which linked sets share a known number;
sets that share fewer with all others have no partner. Of the sets that are left all shingles are counted. A linked pair
shares percent/100 of either set, so each set can leave out as many of its most frequent shingles as that, less one, and
the rarest common one stays: texts that share a license or a passage, and no more, meet nowhere. From PARTS_FROM percent
on, linked sets differ in so few shingles that each set is instead dealt to more parts than that, and an equal part is a
region: parts then hold enough shingles that unrelated texts seldom agree in one, and fewer rows move. Inside a region,
distances to pivots decide. What lies near a pivot belongs to its Voronoi region, with a window as wide as the triangle
inequality asks for, so that partners end up in one coarse group; what no pivot has taken goes on with other pivots. A
coarse group is then joined exactly: in one task if small, else against pivots first and in blocks for what they left
outside. Equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from harborline.llm.common import components, fresh, hash_words, key128, mix, rolling, split_words, text_slices, whole
from harborline.session import materialize

WORDS = 5
PERCENT = 80
# Members of a region whose pairs are measured outright.
SMALL = 16
# How often sets that share too little with all others are taken out of the regions.
PRUNINGS = 2
# Of every hundred shingles, how many more than it takes to share one the sieve looks at.
SPARE = 10
# Shingles that so many of one in SAMPLED sets hold are known to be shared and are counted by no single task.
SAMPLED, HOT = 256, 32
# Regions are equal parts from this percentage on, shared shingles below it. Sizes of one class of parts differ by
# CLASS_RATIO at most.
PARTS_FROM, CLASS_RATIO = 87, 1.5
# Sets within this distance of a pivot belong to its Voronoi core.
CORE = 0.4
# Members of a coarse group that one task joins; larger groups are joined in blocks.
LOCAL_ROWS, BLOCK_ROWS, ASK_ROWS = 400, 512, 128


def shingle_sets(column, words: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of every text; a text of fewer words is one shingle, one without words none."""
    for _, _, data, offsets in text_slices(column):
        starts, ends, first = split_words(data, offsets)
        hashed = hash_words(data, starts, ends, lower=True)
        for i in range(len(offsets) - 1):
            h = hashed[first[i] : first[i + 1]]
            yield np.unique(rolling(h, words)) if len(h) >= words else (mix(rolling(h, len(h)) + np.uint64(len(h))) if len(h) else h)


def common_least(n: int, percent: int) -> int:
    """How many shingles a set of n has in common with any set it links with, at least."""
    return -(-n * percent // 100)


def sieve_least(n: int, percent: int) -> int:
    """How many of these stand among the first of both, at least, the smaller of n shingles. Grows with n."""
    return min(1 + n * SPARE // 100, common_least(n, percent))


def sieve(s: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """The set's first shingles in hash order, and how many of them a partner shares at least.

    Of the common shingles no more than common_least - sieve_least can come after those taken here. The smallest partner
    has common_least shingles.
    """
    n = len(s)
    if n == 0:
        return 1, s
    common = common_least(n, percent)
    take = n - common + sieve_least(n, percent)
    h = mix(s)
    return sieve_least(common, percent), np.partition(h, take - 1)[:take]


class Parts:
    """How sets of a size class are dealt to parts so that linked sets agree in a part worth comparing."""

    def __init__(self, percent: int):
        self.percent = percent
        # A part of fewer than `least` shingles tells little. `slack` more parts than needed let a set leave those out.
        self.slack, self.least = 0.06, 2
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * CLASS_RATIO)))
        self.bounds = np.array(bounds)

    def differ(self, top: int) -> int:
        """Most shingles in which two linked sets differ, the smaller of size `top` at most."""
        return (top + top * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def signatures(self, s: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For the set's own size class and the one below: how many signatures a partner shares at least, and all of them."""
        n = len(s)
        if n == 0:
            return [(1, s), (1, s)]
        own = int(np.searchsorted(self.bounds, n, side="right")) - 1
        # A set also joins the class below when a partner there can be large enough.
        low = own > 0 and -(-n * self.percent // 100) <= self.bounds[own] - 1
        return [self._of_class(s, own), self._of_class(s, own - 1) if low else (1, s[:0])]

    def _of_class(self, s: np.ndarray, k: int) -> tuple[int, np.ndarray]:
        most = self.differ(int(self.bounds[k + 1]) - 1)
        if most == 0:
            return 1, s[:0]  # linked sets are equal here
        spare = 2 + int(self.slack * most)
        m = most + 1 + spare
        strong = mix(s + np.uint64(k))
        part = (strong >> np.uint64(16)) % np.uint64(m)
        order = np.argsort(part, kind="stable")
        part, strong = part[order], strong[order]
        counts = np.bincount(part.astype(np.int64), minlength=m)
        full = np.flatnonzero(counts)
        sums = np.zeros(m, np.uint64)
        sums[full] = np.add.reduceat(mix(strong), (np.cumsum(counts) - counts)[full])
        weak = counts < self.least
        n_weak = int(weak.sum())
        take = np.arange(m) if n_weak > spare else np.flatnonzero(~weak)
        # Linked sets agree in 1 + spare parts or more, of which no more than n_weak are left out.
        need = 1 if n_weak > spare else 1 + spare - n_weak
        return need, mix(sums[take] + mix(take.astype(np.uint64) + np.uint64(k << 32)))


def _node(s: np.ndarray) -> int:
    m = mix(s)
    return int(mix(np.array([m.sum(dtype=np.uint64)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_xor.reduce(mix(m)) + np.uint64(len(s)))[0])


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32())
    return pa.ListArray.from_arrays(ends, _long(np.concatenate([np.zeros(0, np.uint64), *arrays])))


def _sign(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            sizes, nodes, firsts, leasts = [], [], [], []
            for s in shingle_sets(b.column("text"), words):
                node = _node(s)
                # Equal sets sign once a task.
                least, first = (1, s[:0]) if node in seen else sieve(s, percent)
                seen.add(node)
                sizes.append(len(s))
                nodes.append(node)
                firsts.append(first)
                leasts.append(least)
            columns = [b.column("id"), b.column("tk"), pa.array(sizes, pa.int64()), _long(nodes), _lists(firsts), pa.array(leasts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "tk", "n", "node", "first", "least"])

    return run


def _sign_parts(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen = Parts(percent), set()
        for b in batches:
            sizes, nodes, lists, needs = [], [], ([], []), ([], [])
            for s in shingle_sets(b.column("text"), words):
                node = _node(s)
                sizes.append(len(s))
                nodes.append(node)
                # Equal sets sign once a task.
                signed = [(1, s[:0])] * 2 if node in seen else parts.signatures(s)
                seen.add(node)
                for level, (need, sigs) in enumerate(signed):
                    lists[level].append(sigs)
                    needs[level].append(need)
            made = [_lists(own) for own in lists]
            wanted = [pa.array(own, pa.int32()) for own in needs]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tk"), pa.array(sizes, pa.int64()), _long(nodes), *made, *wanted], ["id", "tk", "n", "node", "sigs0", "sigs1", "need0", "need1"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column("text"), words))
            yield pa.RecordBatch.from_arrays([_long([_node(s) for s in sets]), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "s"])

    return run


def _shingles(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("s")]
            leasts = pa.array([common_least(len(s), percent) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("node"), _lists(sets), leasts], ["node", "all", "least"])

    return run


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        na, nb, common = [], [], []
        for x, y in zip(b.column("sa"), b.column("sb")):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            na.append(len(p))
            nb.append(len(q))
            common.append(int((q[at] == p).sum()))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(na, pa.int64()), pa.array(nb, pa.int64()), pa.array(common, pa.int64())], ["a", "b", "na", "nb", "common"])


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, distance, union, common) of the pairs, written once."""
    # Written first: of few pairs Spark then knows that they are few, and the sets needn't be shuffled.
    pairs = materialize(pairs)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    got = both.mapInArrow(_measure, "a long, b long, na long, nb long, common long")
    union = F.col("na") + F.col("nb") - F.col("common")
    return materialize(got.select("a", "b", "common", union.alias("total"), (1 - F.col("common") / union).alias("distance")))


def _linked(percent: int) -> Column:
    return F.col("common") * 100 >= F.col("total") * percent


def _local(percent: int):
    """Exact links of one region: members are compared with those they are not yet connected to, the most typical first."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        nodes = part["node"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in part["s"]]
        sizes = np.array([len(s) for s in sets])
        _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        begin = np.cumsum(sizes) - sizes
        typical = np.add.reduceat(often[ids].astype(float), begin) / sizes
        group = np.arange(len(nodes))
        a, b = [], []
        mark = np.zeros(len(often), np.int64)
        for i in np.argsort(-typical, kind="stable"):
            if (group == group[i]).all():
                if (group == group[0]).all():
                    break
                continue
            own = ids[begin[i] : begin[i] + sizes[i]]
            mark[own] = 1
            common = np.add.reduceat(mark[ids], begin)
            mark[own] = 0
            for j in np.flatnonzero(100 * common >= percent * (sizes + sizes[i] - common)):
                if group[j] != group[i]:
                    a.append(nodes[i])
                    b.append(nodes[j])
                    group[group == group[j]] = group[i]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _blocks(percent: int):
    """Links between the asking rows of a block pair and its other rows; one per asking row and component is enough."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        asks = part["asks"].to_numpy(bool)
        a, b = [], []
        if asks.any() and not asks.all():
            sets = [np.frombuffer(x, np.uint64) for x in part["s"][~asks]]
            nodes, roots = part["node"].to_numpy()[~asks], part["root"].to_numpy()[~asks]
            sizes = np.array([len(s) for s in sets])
            words, ids = np.unique(np.concatenate(sets), return_inverse=True)
            begin = np.cumsum(sizes) - sizes
            for node, root, raw in zip(part["node"].to_numpy()[asks], part["root"].to_numpy()[asks], part["s"][asks]):
                s = np.frombuffer(raw, np.uint64)
                at = np.searchsorted(words, s)
                at[at == len(words)] = 0
                mark = np.zeros(len(words), np.int64)
                mark[at[words[at] == s]] = 1
                common = np.add.reduceat(mark[ids], begin)
                hit = np.flatnonzero((100 * common >= percent * (sizes + len(s) - common)) & (roots != root))
                for j in hit[np.unique(roots[hit], return_index=True)[1]]:
                    a.append(node)
                    b.append(nodes[j])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _joined_blocks(asking: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between asking(region, node, root) and all members(region, node, root, size) of their regions, in bounded blocks."""
    asked = asking.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / ASK_ROWS).cast("int").alias("across"))
    shape = members.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("down")).join(asked, "region")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = members.join(shape, "region").withColumn("i", own("down")).select("region", "i", spread("across").alias("j"), F.lit(False).alias("asks"), "node", "root")
    left = asking.join(shape, "region").withColumn("j", own("across")).select("region", spread("down").alias("i"), "j", F.lit(True).alias("asks"), "node", "root")
    return left.unionByName(right).join(sets, "node").groupBy("region", "i", "j").applyInPandas(_blocks(percent), "a long, b long")


def _near(regions: DataFrame, sets: DataFrame, percent: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """(coarse edges, links): edges join a pivot to what lies near it, so that linked sets end up in one coarse group.

    A set within CORE of a pivot leaves its region: a partner is within CORE + r of that pivot and shares the group.
    What no pivot has taken goes on with other pivots; the pairs of a region that has become small are measured.
    """
    r = 1 - percent / 100
    edges = links = None
    open_ = regions
    while True:
        # The most shared member stands for the middle of its group.
        popular = open_.groupBy("node").agg(F.count(F.lit(1)).alias("pop"))
        # Regions with the same members are one. Members are distinct, so two xors of their full hashes tell sets apart.
        one, two = key128(F.col("node"))
        about = open_.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("low"), F.max("node").alias("far"), F.bit_xor(one).alias("mark"), F.bit_xor(two).alias("mark2"))
        once = about.filter("size > 1").groupBy("size", "low", "far", "mark", "mark2").agg(F.min("region").alias("region"))
        members = materialize(open_.join(once.select("region", "size"), "region").join(popular, "node"))
        if members.isEmpty():
            return edges, links
        if edges is None:
            chosen = members.groupBy("region").agg(F.min_by("node", F.struct(-F.col("pop"), "node")).alias("pivot"))
        else:
            w = Window.partitionBy("region").orderBy(F.desc("pop"), "node")
            wanted = F.when(F.col("size") <= SMALL, SMALL).otherwise(pivots)
            # The first bound, a constant, is applied before the shuffle.
            ranked = members.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= max(SMALL, pivots))
            chosen = ranked.filter(F.col("k") <= wanted).select("region", F.col("node").alias("pivot"))
        asked = members.select("region", "node").join(chosen, "region")
        measured = _distances(asked.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), sets)
        close, linked = measured.filter(F.col("distance") <= CORE + r + 1e-9).select("a", "b"), measured.filter(_linked(percent)).select("a", "b")
        edges, links = (close, linked) if edges is None else (edges.union(close), links.union(linked))
        held = asked.join(measured, (F.col("node") == F.col("a")) & (F.col("pivot") == F.col("b")), "left")
        taken = held.filter((F.col("node") == F.col("pivot")) | (F.col("distance") <= CORE)).select("region", "node").distinct()
        open_ = materialize(members.select("region", "node").join(taken, ["region", "node"], "left_anti"))


def _met(rows: DataFrame) -> DataFrame:
    """Rows (region, node, least) whose region has several nodes, with `c`, how many rows it has."""
    counts = rows.groupBy("region").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("low"), F.max("node").alias("far"))
    return rows.join(counts.filter("low < far").select("region", "c"), "region")


def _pruned(rows: DataFrame) -> DataFrame:
    """Distinct rows (region, node, least, c) without the nodes that share fewer than `least` with all others, written."""
    for _ in range(PRUNINGS):
        enough = rows.groupBy("node").agg(F.count(F.lit(1)).alias("shared"), F.max("least").alias("asked")).filter("shared >= asked")
        rows = materialize(_met(rows.select("region", "node", "least").join(enough.select("node"), "node", "left_semi")))
    return rows


def _sieved(signed: DataFrame) -> DataFrame:
    """(node) of the sets that may have a partner."""
    rows = signed.select(F.explode("first").alias("region"), "node", "least")
    part = rows.filter(F.pmod("node", F.lit(SAMPLED)) == 0).groupBy("region").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("low"), F.max("node").alias("far"))
    hot = materialize(part.filter(F.col("c") >= HOT).filter("low < far").select("region"))
    w = Window.partitionBy("region")
    ends = rows.join(hot, "region", "left_anti").withColumns({"low": F.min("node").over(w), "far": F.max("node").over(w)})
    met = ends.filter("low < far").drop("low", "far").unionByName(rows.join(hot, "region", "left_semi"))
    return materialize(_pruned(materialize(met.distinct())).select("node").distinct())


def _regions(sets: DataFrame, percent: int) -> DataFrame:
    """(region, node): every linked pair of the sets shares a region."""
    rows = sets.mapInArrow(_shingles(percent), "node long, all array<long>, least int").select(F.explode("all").alias("region"), "node", "least")
    rows = _pruned(materialize(_met(rows)))
    # Of the common shingles the rarest comes after all others, so neither set leaves it out.
    w = Window.partitionBy("node").orderBy(F.desc("c"), "region")
    rare = rows.withColumn("k", F.row_number().over(w)).filter("k >= least").select("region", "node", "least")
    return materialize(_met(rare).select("region", "node"))


def _part_regions(base: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signed documents, and (region, node): linked sets that aren't equal share a region."""
    kind = dict(base.dtypes)["id"]
    signed = materialize(base.mapInArrow(_sign_parts(words, percent), f"id {kind}, tk long, n long, node long, sigs0 array<long>, sigs1 array<long>, need0 int, need1 int"))
    level = lambda k: signed.select(F.explode(f"sigs{k}").alias("region"), "node", F.lit(k).alias("level"), F.col(f"need{k}").alias("need"))
    spread = level(0).unionByName(level(1))
    w = Window.partitionBy("region")
    met = lambda df: df.withColumns({"low": F.min("node").over(w), "far": F.max("node").over(w)}).filter("low < far").drop("low", "far")
    regions = materialize(met(spread).distinct())
    # A set that shares fewer signatures with all others than one partner must share has no partner.
    for _ in range(PRUNINGS):
        enough = regions.groupBy("node", "level").agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("least")).filter("c >= least").select("node", "level")
        regions = materialize(met(regions.join(enough, ["node", "level"], "left_semi")))
    return signed, materialize(regions.select("region", "node").distinct())


def _wanted_sets(base: DataFrame, signed: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, s) of the nodes, each from one document."""
    wanted = signed.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("tk", "id")).alias("d")).select("d.tk", "d.id")
    texts = base.alias("x").join(wanted.alias("y"), (F.col("x.tk") == F.col("y.tk")) & F.col("x.id").eqNullSafe(F.col("y.id")), "left_semi")
    return materialize(texts.mapInArrow(_sets(words), "node long, s binary").dropDuplicates(["node"]))


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, local_rows: int = LOCAL_ROWS, pivots: int = 16) -> DataFrame:
    """Every row's id, `tk` (hash of its text), `n` (size of its set) and `root`, alike in what links connect."""
    base = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("tk", F.xxhash64("text"))
    if percent >= PARTS_FROM:
        signed, regions = _part_regions(base, words, percent)
        sets = _wanted_sets(base, signed, regions.select("node").distinct(), words)
    else:
        kind = dict(base.dtypes)["id"]
        signed = materialize(base.mapInArrow(_sign(words, percent), f"id {kind}, tk long, n long, node long, first array<long>, least int"))
        sets = _wanted_sets(base, signed, _sieved(signed), words)
        regions = _regions(sets, percent)

    none = docs.sparkSession.createDataFrame([], "a long, b long")
    edges, links = _near(regions, sets, percent, pivots)
    links = links if links is not None else none
    coarse = components(edges) if edges is not None else none.toDF("node", "root")
    members = coarse.select(F.col("root").alias("region"), "node")
    sized = members.groupBy("region").agg(F.count(F.lit(1)).alias("size"))
    members = materialize(members.join(materialize(sized), "region"))
    small, large = members.filter(F.col("size") <= local_rows), members.filter(F.col("size") > local_rows)
    within = small.select("region", "node").join(sets, "node").groupBy("region").applyInPandas(_local(percent), "a long, b long")
    links = materialize(links.union(within))
    labels = components(links)
    if not large.isEmpty():
        # Only the sets of large groups are moved in the rounds below.
        held = materialize(sets.join(large.select("node"), "node", "left_semi"))
        pop = regions.groupBy("node").agg(F.count(F.lit(1)).alias("pop"))
        last = None
        while True:
            # Who is outside its region's main component; pivots from there, until they gain little more.
            placed = large.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
            sizes = placed.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"))
            main = sizes.groupBy("region").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
            placed = materialize(placed.join(main, "region").join(pop, "node"))
            outside = placed.filter("root <> main")
            n = outside.count()
            if n == 0:
                break
            full = last is not None and n > 0.8 * last
            last = n
            top = Window.partitionBy("region").orderBy(F.desc("pop"), "node")
            asking = outside if full else outside.withColumn("k", F.row_number().over(top)).filter(F.col("k") <= pivots).drop("k")
            found = _joined_blocks(asking.select("region", "node", "root"), placed.select("region", "node", "root"), held, percent)
            links = materialize(links.union(found))
            labels = components(links)
            if full:
                break
    return signed.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def join_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, local_rows: int = LOCAL_ROWS, pivots: int = 16) -> DataFrame:
    """One row per document: `id`, `n_shingles`, `component_id`, the smallest id reachable by links (itself included).

    Documents link when their sets of `words`-word shingles (ASCII white space parts words, A-Z folded) have a Jaccard
    similarity of `percent`/100 or more. A text of fewer words is one shingle. Texts null, empty or without words have
    an empty set and link with nothing. Null ids are kept as rows and never name a component. Rows that repeat an id or
    a text are rows of their own. Sets are compared by 64-bit hashes of their shingles.
    """
    member = _grouped(docs, id_col, text_col, words, percent, local_rows, pivots)
    named = materialize(member.filter("n > 0").groupBy("root").agg(F.min("id").alias("component_id")))
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return member.join(named, "root", "left").select("id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without near-duplicates: of each component one row stays, with all columns.

    It is the row with the smallest id, a null id coming last; texts of one id are told apart by their hashes, and of
    rows alike in id and text one stays. Texts without words are no duplicates and stay.
    """
    key, tk, text_key, row = fresh(docs, "key", "tk", "text_key", "row")
    keys = _grouped(docs, id_col, text_col, words, percent).filter("n > 0").groupBy("root", "id", "tk").agg(F.count(F.lit(1)).alias("rows"))
    keys = materialize(keys)
    first = keys.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "tk")).alias("first"))
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tk") == F.col("first.tk"))
    told = materialize(keys.join(first, "root").select(F.col("id").alias(key), F.col("tk").alias(text_key), "rows", stays.alias("stays")))
    gone, again = told.filter("not stays").select(key, text_key), told.filter("stays and rows > 1").select(key, text_key)
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(tk) == F.col(text_key))
    kept = docs.withColumn(tk, F.xxhash64(whole(text_col))).join(gone, same, "left_anti")
    if again.isEmpty():
        return kept.drop(tk)
    whole_row = F.struct(*docs.columns)
    once = kept.join(again, same, "left_semi").groupBy(id_col, tk).agg(F.min_by(whole_row, F.to_json(whole_row)).alias(row)).select(f"{row}.*")
    return kept.join(again, same, "left_anti").drop(tk).unionByName(once)
