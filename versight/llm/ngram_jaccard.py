"""Exact Jaccard joins on word n-grams, by rare-first prefixes.

1. Sketch. Every text's distinct shingles (64-bit hashes) are counted in a fixed number
   of buckets. (bucket count, hash) is a total order of all shingles, rare ones first.
   The sketch has a fixed size and only steers efficiency: any total order is right.
2. Prefixes. Texts with equal shingle sets form one class. Two sets of sizes m and n with
   similarity t share a shingle among their first size - ceil(t * size) + 1. Postings
   (shingle, class, size, position) of these prefixes are grouped by shingle.
3. Candidates pass the length filter, the positional filter (what is left after the
   common shingle suffices) and a suffix filter on the rest: the parity of the number of
   shingles in each of 2 * size or more hash cells. Cells of unlike parity hold at least one
   shingle that only one set has, so their number bounds the symmetric difference.
4. Each candidate pair is verified once, on the whole sets.

Lists of at most ``full_list`` classes yield all their pairs. The classes of longer lists
(near copies by the thousand) are taken again, with exact shingle frequencies among them:
what only one has cannot be shared, so classes with too much of it drop out, and the
others get shorter prefixes and sharper filters. These lists yield links to leaders, a few
for each class and round; classes that verified links connect need no further pairs for
their component. What is not connected after these rounds is joined on *differences*:

5. A list that still spans components belongs to the cluster of its largest component.
   A cluster's core is the shingles that more than half of its classes have. For sets A
   and B, |A xor B| <= |A xor core| + |B xor core|, with what the two differences share
   counted off twice. If the sum alone proves the link, A also links to the class nearest
   to the core, so one star covers all such pairs. Otherwise the differences need a number
   of common shingles, and prefix filtering with lengths and positions applies to the
   differences, rare ones first. How many are needed depends on both sides: a posting with
   ``slack`` differences from it on can only be the first common one of a pair whose f add up to
   2 * (100 + percent) * slack at most. So each posting is keyed by its shingle, the band of its own
   f and each band of partners that its slack allows, and pairs that one shared edit cannot
   link never meet. What meets is filtered by parities and tested once. Where the variants of a
   text come from few words, true links grow with the square of their number, and so does
   what meets, with a small factor (see the README); no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from versight.llm import textscan
from versight.llm.components import components
from versight.llm.shared import discard, written

BUCKET_BITS = 18
#: A bitmap of classes has 2 to the power of these, at least and at most.
BLOOM_BITS = (16, 27)
#: Shingles of all cores that are broadcast; more are joined.
BROADCAST_SHINGLES = 1 << 20


def _sets(batch: pa.RecordBatch, k: int):
    """(row, sorted distinct shingles) of each row of a batch with columns _id, _text."""
    texts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in batch.column(1).to_pylist()]
    for first, words in textscan.word_hashes(texts, lower=True):
        for i, w in enumerate(words):
            yield first + i, textscan.shingles(w, k)


def _class_key(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _signed(s: np.ndarray) -> np.ndarray:
    return s.view(np.int64)


def bucket_counts(rows: DataFrame, k: int) -> np.ndarray:
    """Occurrences of shingles by bucket over all texts: 2**BUCKET_BITS numbers, whatever the input's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                found = [s for _, s in _sets(batch.slice(at, 1024), k)]
                total += np.bincount((np.concatenate([np.empty(0, np.uint64), *found]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    table = rows.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def _parities(s: np.ndarray) -> np.ndarray:
    """One bit for each of the least power of two of cells that is at least 2 * size and 64."""
    cells = 1 << max(6, (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefixes(rows: DataFrame, counts: np.ndarray, k: int, percent: int) -> DataFrame:
    """_id, v (class), n, prefix (rare first), parity (bits by hash cell) of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                keys, sizes, firsts, bits = [], [], [], []
                for _, s in _sets(batch, k):
                    n = len(s)
                    order = np.lexsort((s, counts[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))
                    firsts.append(_signed(s[order[: n - (n * percent + 99) // 100 + 1]]) if n else np.empty(0, np.int64))
                    bits.append(_parities(s))
                    keys.append(_class_key(s))
                    sizes.append(n)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), _lists(firsts), _lists(bits)], names=["_id", "v", "n", "prefix", "parity"])

    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"_id {id_type}, v long, n int, prefix array<long>, parity array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) for x in arrays)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _bloom(keys: DataFrame) -> np.ndarray:
    """A bitmap that holds the keys v, with 16 bits a key within ``BLOOM_BITS``; false positives only cost space."""
    bits = min(max((16 * keys.count()).bit_length(), BLOOM_BITS[0]), BLOOM_BITS[1])
    at = [F.shiftrightunsigned(F.xxhash64("v", F.lit(i)), 64 - bits) for i in range(2)]
    found = keys.select(F.explode(F.array(*at)).alias("b")).groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 AS int))")).alias("m")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[found["w"].to_numpy()] = found["m"].to_numpy().astype(np.uint32)
    return out


def _sets_of(rows: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """(v, s): the sorted shingles of the classes of ``keys`` (and few others), each once."""
    narrow = written(keys.select("v").distinct(), "classes")
    bitmap = rows.sparkSession.sparkContext.broadcast(_bloom(narrow))
    discard(narrow)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                made = {}
                for _, s in _sets(whole.slice(at, 1024), k):
                    made[_class_key(s)] = s
                keep = [v for v, inside in zip(made, _inside(bitmap.value, list(made)), strict=True) if inside]
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), _lists([_signed(made[v]) for v in keep])], names=["v", "s"])

    return rows.mapInArrow(make, "v long, s array<long>").dropDuplicates(["v"])


def _inside(bitmap: np.ndarray, keys: list[int]) -> list[bool]:
    h = np.array(keys, np.int64)
    bits = (len(bitmap) * 32).bit_length() - 1
    ok = np.ones(len(h), bool)
    for i in range(2):
        b = (_spark_hash(h, i) >> np.uint64(64 - bits)).astype(np.int64)
        ok &= (bitmap[b >> 5] >> (b & 31).astype(np.uint32)) & 1 == 1
    return ok.tolist()


def _spark_hash(h: np.ndarray, i: int) -> np.ndarray:
    """xxhash64(long, int) of Spark SQL: seed 42 for the first, its result for the second."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    def final(x):
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
        return x ^ (x >> np.uint64(32))

    with np.errstate(over="ignore"):
        x = np.uint64(42) + p5 + np.uint64(8)
        x = x ^ (turn(h.view(np.uint64) * p2, 31) * p1)
        x = final(turn(x, 27) * p1 + p4)
        x = x + p5 + np.uint64(4)
        x = x ^ (np.uint64(i) * p1)
        return final(turn(x, 23) * p2 + p3)


def _fits(percent: int):
    """Length and positional filter of two postings (1 and 2) of a shingle.

    n is a set's size, pos the shingle's place among those of the set that can be shared at
    all, and m their number.
    """
    n1, n2, m1, m2, p1, p2 = (F.col(c) for c in ("n1", "n2", "m1", "m2", "pos1", "pos2"))
    length = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent
    most = F.least(p1, p2) + 1 + F.least(m1 - p1 - 1, m2 - p2 - 1)
    return length & (most * (100 + percent) >= (n1 + n2) * percent) & (F.col("v1") != F.col("v2"))


def _side(postings: DataFrame, i: int, keys: list[str]) -> DataFrame:
    return postings.toDF(*(c if c in keys else f"{c}{i}" for c in postings.columns))


def _pairs(left: DataFrame, right: DataFrame, fits, on: str | list[str] = "s") -> DataFrame:
    """Distinct fitting pairs (a < b) of postings that share a shingle."""
    keys = [on] if isinstance(on, str) else on
    met = _side(left, 1, keys).join(_side(right, 2, keys), keys).where(fits)
    return met.select(F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b")).distinct()


def _suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose parities leave room for the similarity."""
    one, two = classes.select(F.col("v").alias("a"), F.col("n").alias("n1"), F.col("parity").alias("x")), classes.select(F.col("v").alias("b"), F.col("n").alias("n2"), F.col("parity").alias("y"))

    def folded(p: Column, other: Column) -> Column:
        """With half the cells if the other has fewer: cells that fall together add up."""
        half = (F.size(p) / 2).cast("int")
        return F.when(F.size(p) > F.size(other), F.zip_with(F.slice(p, 1, half), F.slice(p, half + 1, half), lambda i, j: i.bitwiseXOR(j))).otherwise(p)

    pair = F.array(F.struct(folded(F.col("x"), F.col("y")).alias("p"), folded(F.col("y"), F.col("x")).alias("q")))
    unlike = lambda z: F.aggregate(F.zip_with(z["p"], z["q"], lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda acc, c: acc + c)
    least = F.get(F.transform(pair, lambda z: F.when(F.size(z["p"]) == F.size(z["q"]), unlike(z)).otherwise(0)), F.lit(0))
    return pairs.join(one, "a").join(two, "b").where(least * (100 + percent) <= (F.col("n1") + F.col("n2")) * (100 - percent)).select("a", "b")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs and whether they link; one exact test a pair."""
    one, two = sets.select(F.col("v").alias("a"), F.col("s").alias("x")), sets.select(F.col("v").alias("b"), F.col("s").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    linked = common * (100 + percent) >= (F.size("x") + F.size("y")) * percent
    return written(pairs.join(one, "a").join(two, "b").select("a", "b", linked.alias("linked")), "verified")


def _exact_postings(sets: DataFrame, percent: int) -> DataFrame:
    """Postings of the classes in ``sets`` with exact frequencies among them.

    A shingle that one class has cannot be shared, and a class of which less than
    ``percent`` can be shared links with nothing. The others' shared shingles are ordered
    rare first; all but the last ceil(percent of the size) - 1 are the prefix.
    """
    each = written(sets.select("v", F.explode("s").alias("s")), "hotshingles")
    shared = written(each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "hotcounts")
    own = each.join(shared, "s").groupBy("v").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    own = own.join(sets.select("v", F.size("s").alias("n")), "v").withColumn("m", F.size("o")).withColumn("cut", F.col("m") - F.ceil(F.col("n") * percent / 100).cast("int") + 1).where("cut > 0")
    return own.select("v", "n", "m", F.posexplode(F.slice("o", 1, F.col("cut"))).alias("pos", "x")).select("x.s", "v", "n", "m", "pos")


def _links(tested: DataFrame) -> DataFrame:
    return tested.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _lead(lists: DataFrame, keys: list[str], best, fits, leaders: int, turn: int) -> DataFrame:
    """Pairs (a, b) of each class with the leaders (least ``best``) of up to ``leaders`` of its lists."""
    pick = written(lists.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in lists.columns if c not in keys)), best).alias("l")).select(*keys, "l.*"), "leaders")
    met = _side(lists, 1, keys).join(_side(pick, 2, keys), keys).where(fits & (F.col("c1") != F.col("c2")))
    met = met.withColumn("k", F.row_number().over(W.partitionBy("v1").orderBy(F.xxhash64("s", F.lit(turn)), "s"))).where(f"k <= {leaders}")
    return met.select(F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b")).distinct()


def _open(lists: DataFrame, label: DataFrame, keys: list[str]) -> DataFrame:
    """The lists that span components, with each class's component c."""
    now = written(lists.join(label.toDF("v", "root"), "v", "left").withColumn("c", F.coalesce("root", "v")).drop("root"), "labelled")
    mixed = written(now.groupBy(*keys).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(*keys), "mixed")
    out = written(now.join(mixed, keys), "open")
    discard(now, mixed)
    return out


def _apart(lists: DataFrame) -> DataFrame:
    """``lists`` with main: whether a class is of the list's largest component."""
    sizes = lists.groupBy("g", "s", "c").agg(F.count("*").alias("size"))
    main = written(sizes.groupBy("g", "s").agg(F.max_by("c", F.struct("size", "c")).alias("main")), "main")
    known = written(lists.join(main, ["g", "s"]).withColumn("main", F.col("c") == F.col("main")), "apart")
    discard(main)
    return known


def _band(f, unit: int):
    """0 for sums that prove links alone, then powers of two of ``unit``."""
    return F.when(f <= 0, 0).otherwise(1 + F.floor(F.log2(F.greatest(f / unit, F.lit(1.0))))).cast("int")


def _apart_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of classes of unlike components whose differences may have enough in common.

    Of a pair, the side with the larger f (then v) is ``big``. Their first common difference
    has places that leave both enough slack, which bounds the other's f; both sides are
    keyed by the bands of both f that are left, so lists only meet where the bounds allow. Classes of a
    list's largest component don't meet each other.
    """
    unit = 2 * (100 + percent)
    cap = unit * (F.col("m") - F.col("pos")) - F.col("f")
    own = _band(F.col("f"), unit)
    posts = lists.select("g", "s", "v", "n", "f", "c", "main", (F.col("m") - F.col("pos")).alias("slack"), cap.alias("cap"), own.alias("own"), "least")
    large = posts.where("cap >= least").withColumn("other", F.explode(F.sequence(F.lit(0), F.least(_band(F.col("cap"), unit), F.col("own"))))).select("g", "s", F.col("own").alias("bl"), F.col("other").alias("bs"), "v", "n", "f", "c", "main", "slack")
    small = posts.where("cap >= f").withColumn("other", F.explode(F.sequence("own", _band(F.col("cap"), unit)))).select("g", "s", F.col("other").alias("bl"), F.col("own").alias("bs"), "v", "n", "f", "c", "main", "slack")
    keys = ["g", "s", "bl", "bs"]
    fits = F.expr(f"c1 != c2 and (f2 < f1 or (f2 = f1 and v2 < v1)) and f1 + f2 <= {unit} * least(slack1, slack2) and least(n1, n2) * 100 >= greatest(n1, n2) * {percent}")
    parts = [_side(x, 1, keys).join(_side(y, 2, keys), keys).where(fits) for x, y in ((large.where("not main"), small), (large.where("main"), small.where("not main")))]
    return parts[0].unionByName(parts[1]).select(F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b")).distinct()


def _differences(lists: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """For the open ``lists``: links (u, v) that sizes alone prove, and postings (g, s, v, n, f, least, m, pos) of the differences.

    f is (100 + percent) * size of the difference - (100 - percent) * n: sets link if and
    only if 2 * (100 + percent) * (number of common differences) >= the sum of their f.
    """
    big, small = 100 + percent, 100 - percent
    sizes = lists.groupBy("s", "c").agg(F.count("*").alias("size"))
    # lists of single classes go together, as cluster 0: their core is what more than half of them have, most often nothing
    of = sizes.groupBy("s").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.max("size").alias("most")).select("s", F.when(F.col("most") > 1, F.col("main")).otherwise(0).alias("g"))
    member = written(lists.join(written(of, "clusters"), "s").select("g", "v", "n").distinct(), "members")
    number = written(member.groupBy("g").agg(F.count("*").alias("classes")), "numbers")
    few = number.count() <= BROADCAST_SHINGLES
    small_side = lambda df: F.broadcast(df) if few else df
    each = member.join(sets, "v").select("g", F.explode("s").alias("s")).groupBy("g", "s").agg(F.count("*").alias("df"))
    core = written(each.join(small_side(number), "g").where("2 * df > classes").groupBy("g").agg(F.collect_list("s").alias("core")), "cores")
    held = core.agg(F.sum(F.size("core"))).first()[0] or 0
    apart = member.join(sets, "v").join(F.broadcast(core) if held <= BROADCAST_SHINGLES else core, "g", "left")
    apart = apart.select("g", "v", "n", F.when(F.col("core").isNull(), F.col("s")).otherwise(F.concat(F.array_except("s", "core"), F.array_except("core", "s"))).alias("e"))
    apart = written(apart.withColumn("f", big * F.size("e") - small * F.col("n")), "differences")
    near = written(apart.groupBy("g").agg(F.min_by("v", F.struct("f", "v")).alias("center"), F.min("f").alias("least")), "centers")
    placed = apart.join(small_side(near), "g")
    star = written(placed.where("f + least <= 0 and v != center").select(F.col("center").alias("u"), "v"), "stars")
    common = written(apart.select("g", F.explode("e").alias("s")).groupBy("g", "s").agg(F.count("*").alias("df")).where("df > 1"), "common")
    own = placed.select("g", "v", "n", "f", "least", F.explode("e").alias("s")).join(common, ["g", "s"])
    own = own.groupBy("g", "v", "n", "f", "least").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o")).withColumn("m", F.size("o"))
    cut = F.col("m") - F.greatest(F.lit(1), F.ceil((F.col("f") + F.col("least")) / (2 * big)).cast("int")) + 1
    own = own.withColumn("cut", cut).where("cut > 0")
    out = written(own.select("g", "v", "n", "f", "least", "m", F.posexplode(F.slice("o", 1, F.col("cut"))).alias("pos", "x")).select("g", "x.s", "v", "n", "f", "least", "m", "pos"), "difflists")
    discard(member, number, core, apart, near, common)
    return star, out


def _apart_fits(percent: int):
    """Length and positional filter of two postings of a difference."""
    n1, n2, m1, m2, p1, p2 = (F.col(c) for c in ("n1", "n2", "m1", "m2", "pos1", "pos2"))
    most = F.least(p1, p2) + 1 + F.least(m1 - p1 - 1, m2 - p2 - 1)
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (most * 2 * (100 + percent) >= F.col("f1") + F.col("f2")) & (F.col("v1") != F.col("v2"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, full_list: int = 48, leaders: int = 8) -> DataFrame:
    """The id, n_shingles and component_id of each row.

    Rows link when 100 * intersection >= percent * union of their distinct k-word
    shingles (A-Z lower-cased; fewer words are one shingle). component_id is the
    smallest id reachable by links, itself included. Texts without words, and nulls,
    have an empty set and link with nothing, not even each other: their component is
    their own id. A null id is carried; it gets the smallest id of its component, null
    if there is none. Repeated rows repeat and are linked. An empty table gives an
    empty result. Only the two named columns are read, so others may have any names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counts = bucket_counts(rows, k)
    cut = written(prefixes(rows, counts, k, percent), "prefixes")
    post = cut.where("n > 0").select("v", "n", F.posexplode("prefix").alias("pos", "s"))
    shared = written(post.groupBy("s").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi").select("s"), "shared")
    lists = written(post.join(shared, "s").select("s", "v", "n", "pos").distinct().select("s", "v", "n", F.col("n").alias("m"), "pos"), "lists")
    large = written(lists.groupBy("s").agg(F.count("*").alias("size")).where(f"size > {full_list}").select("s"), "large")
    hot = written(lists.join(large, "s").select("v").distinct(), "hot")
    # pairs of two hot classes are found below, whatever they share
    cold = lists.join(large, "s", "left_anti").join(hot.select("v", F.lit(True).alias("hot")), "v", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    classes = cut.where("n > 0").select("v", "n", "parity").dropDuplicates(["v"])
    candidates = written(_suffix_filter(_pairs(cold, cold, _fits(percent) & F.expr("v1 < v2 and not (hot1 and hot2)")), classes, percent), "pairs")
    # read where it is verified: both joins share one exchange of the sets
    tested = _verify(candidates, _sets_of(rows, candidates.select(F.explode(F.array("a", "b")).alias("v")), k), percent)
    discard(shared, lists, large, candidates)
    label = components(_links(tested))
    discard(tested)
    if not hot.isEmpty():
        label = _connect_hot(written(_sets_of(rows, hot, k).join(hot, "v", "left_semi"), "sets"), classes, label, percent, leaders, full_list)
    discard(hot)
    named = written(cut.select("_id", "v", "n").join(label.toDF("v", "root"), "v", "left").select("_id", "n", F.coalesce("root", "v").alias("c")), "named")
    least = written(named.where("n > 0").groupBy("c").agg(F.min("_id").alias("least")), "least")
    discard(cut, label)
    return named.join(least, "c", "left").select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("_id")).alias("component_id"))


def _connect_hot(sets: DataFrame, classes: DataFrame, label: DataFrame, percent: int, leaders: int, full_list: int) -> DataFrame:
    """``label`` with all links between the classes of ``sets``."""
    tested: list[DataFrame] = []

    def connect(new: DataFrame, label: DataFrame) -> DataFrame:
        for old in tested:
            new = new.join(old.select("a", "b"), ["a", "b"], "left_anti")
        new = written(new, "pairs")
        if not new.isEmpty():
            tested.append(_verify(new, sets, percent))
            label, last = components(_links(tested[-1]).unionByName(label.toDF("u", "v"))), label
            discard(last)
        discard(new)
        return label

    lists = written(_exact_postings(sets, percent), "hotlists")
    for turn in range(2):  # first the class with the fewest shingles of its own: it is nearest to all; then any
        best = F.struct((F.col("n") - F.col("m") if turn == 0 else F.lit(0)).alias("own"), F.xxhash64("v", "s", F.lit(turn)).alias("h"))
        now = _open(lists, label, ["s"])
        label = connect(_lead(now, ["s"], best, _fits(percent), leaders, turn), label)
        discard(now)
    now = _open(lists, label, ["s"])
    discard(lists)
    if now.isEmpty():
        return label
    star, lists = _differences(now, sets, percent)
    discard(now)
    label, last = components(star.unionByName(label.toDF("u", "v"))), label
    discard(last, star)
    keys, fits = ["g", "s"], _apart_fits(percent)
    now = _open(lists, label, keys)
    size = now.groupBy(*keys).agg(F.count("*").alias("size")).agg(F.sum(F.col("size").cast("double") * F.col("size")), F.sum("size")).first()
    if size[1] and size[0] > full_list * size[1]:  # long lists: leaders once more
        label = connect(_lead(now, keys, F.struct("f", F.xxhash64("v", "s")), fits, leaders, 2), label)
        discard(now)
        now = _open(lists, label, keys)
    apart = _apart(now)
    label = connect(_suffix_filter(_apart_pairs(apart, percent), classes, percent), label)
    discard(now, apart, lists, sets, *tested)
    return label
