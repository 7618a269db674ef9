"""MinHash near-dedup (operator 4): bottom-k sketches of one hash function, inverted lists of the values they retain,
union-sketch estimates, exact Jaccard on full sets, and connected components of what is confirmed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from featurekit.llm.common import ascii_words, discard, free_name, materialize, window_hashes, word_hashes

#: Values that a sketch retains. Two sets of similarity 0.75 share each value of their union's sketch with that
#: probability, so fewer than LEAST of 40 shared have a probability under 1e-6.
RETAINED = 40
LEAST = 0.35
#: Sets up to this size, and all that may be similar to them, are retained whole: what they must share is known exactly.
WHOLE = 30
#: Lists up to this size give all their pairs. Longer ones are linked through hubs, and what hubs leave apart is compared in blocks.
SHORT = 8
#: Smallest values of a sketch whose long lists are looked at: the union's FRONT smallest are all unshared in one of a
#: million pairs of similarity 0.75.
FRONT = 10
#: Sets, and shingles, of a block of a list at most, on average.
MEMBERS, SHINGLES = 1024, 200_000
BATCH = 256


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; fewer words than ``width`` are one shingle, none are none."""
    words = ascii_words((text or "").encode("utf-8", "replace"))
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    return np.unique(window_hashes(word_hashes(words), list(range(width))))


def _signed(x: np.ndarray) -> np.ndarray:
    """uint64 as int64 in the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set's hash, as two signed numbers."""
    high, low = divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64)
    return high - (1 << 63), low - (1 << 63)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)])))


def _sets(docs: DataFrame, width: int, whole: bool) -> DataFrame:
    """Of documents (at, text): at, key and key2 (of the set), n (its size), values (the whole set, or its sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, BATCH) for i in range(0, big.num_rows, BATCH)):
                sets = [shingle_set(t, width) for t in b.column(1).to_pylist()]
                values = _lists([_signed(s if whole else s[:RETAINED]) for s in sets])
                keys = np.array([_key(s) for s in sets], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(s) for s in sets], pa.int64()), values], names=["at", "key", "key2", "n", "values"])

    numbers = [StructField(c, LongType()) for c in ("key", "key2", "n")]
    return docs.mapInArrow(run, StructType([docs.schema["at"], *numbers, StructField("values", ArrayType(LongType()))]))


def _of_size(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def _least(n: Column, percent: int) -> Column:
    """Values that a sketch of a set of n must share with any similar set's."""
    return F.when(n <= WHOLE, F.ceil(n * percent / 100)).otherwise(F.ceil(F.least(n, F.lit(RETAINED)) * LEAST))


def _whole_sets(some: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """cls and values (the whole set) of some classes, from a text that has the set."""
    wanted = classes.join(some, "cls", "left_semi").select("cls", F.col("rep").alias("at"))
    texts = docs.join(wanted.select("at"), "at", "left_semi").dropDuplicates(["at"])
    return _sets(texts, width, True).select("at", "values").join(wanted, "at").select("cls", "values")


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Of distinct pairs of classes (a < b) those whose sketches may, and then whose whole sets do, reach the similarity."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("values").alias(f"s{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(_of_size(F.col("na"), F.col("nb"), percent))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, RETAINED)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    near = materialize(near.filter(shared >= LEAST * F.size(union)).select("a", "b", "na", "nb"))
    some = near.select(F.col("a").alias("cls")).union(near.select("b")).distinct()
    whole = materialize(_whole_sets(some, classes, docs, width))
    with_a = near.join(whole.select(F.col("cls").alias("a"), F.col("values").alias("va")), "a")
    both = with_a.join(whole.select(F.col("cls").alias("b"), F.col("values").alias("vb")), "b")
    common = F.size(F.array_intersect("va", "vb"))
    found = materialize(both.filter(common * 100 >= (F.col("na") + F.col("nb") - common) * percent).select("a", "b"))
    discard(near, whole)
    return found


def components(links: DataFrame) -> DataFrame:
    """cls and root (its component's smallest class) of every class in links (a, b): labels of neighbours and of labels'
    own labels until nothing changes, each round written to the shared folder."""
    edges = materialize(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    labels = materialize(edges.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("m")).select("cls", F.least("cls", "m").alias("root")))
    while True:
        near = edges.join(labels.select(F.col("cls").alias("b"), "root"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("root").alias("m"))
        hooked = labels.join(near, "cls").select("cls", F.least("root", "m").alias("up"), F.col("root").alias("old"))
        # Where a label has found a smaller one, all that carry it follow.
        jump = hooked.groupBy(F.col("old").alias("up")).agg(F.min("up").alias("to"))
        new = materialize(hooked.join(jump, "up", "left").select("cls", F.least("up", F.coalesce("to", "up")).alias("root"), "old"))
        discard(labels)
        if not new.filter("root <> old").limit(1).count():
            discard(edges)
            return new.select("cls", "root")
        labels = new


def _apart(lists: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) that still join components of a list's members (lists: v, cls, n, root): whoever is outside the list's
    largest component meets all members of a size that may be similar, by whole sets, block against block. A block holds
    ``MEMBERS`` sets and ``SHINGLES`` shingles or so, of one class of size, which bounds a task's memory whatever the list.
    Of the pairs that reach the similarity a task returns as many as connect the same components."""
    parts = lists.groupBy("v", "root").agg(F.count("*").alias("members"))
    mixed = parts.groupBy("v").agg(F.max_by("root", F.struct("members", "root")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("v", "main")
    # Two sizes in the ratio of the similarity are two classes of size apart at most.
    size = F.floor(F.log(F.col("n")) / (math.log(100 / percent) / 2)).alias("size")
    listed = materialize(lists.join(mixed, "v").select("*", size))
    blocks = listed.groupBy("v", "size").agg(F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n") / SHINGLES)).alias("blocks"))
    rows = listed.join(blocks, ["v", "size"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    whole = materialize(_whole_sets(rows.select("cls").distinct(), classes, docs, width))
    rows = rows.join(whole, "cls").select("v", F.struct("size", "block").alias("mine"), "cls", "root", (F.col("root") != F.col("main")).alias("outside"), "values")
    met = blocks.select("v", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: F.col("size") + d)).alias("near"), "size", "blocks")
    others = met.select("v", "near", "size", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select(F.col("v").alias("of"), "near", F.struct("size", "block").alias("other"))
    each = rows.join(others, F.expr("v = of and mine.size = near")).drop("of", "near")
    left = each.filter("outside").select("v", F.col("mine").alias("i"), F.col("other").alias("j"), "cls", "root", "values")
    # Two that are both outside meet in the order of their blocks only.
    right = each.filter(~F.col("outside") | (F.col("mine") >= F.col("other"))).select(F.col("other").alias("i"), F.col("mine").alias("j"), *(F.col(x).alias(x) for x in ("v", "cls", "root", "values")))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_joining(a, b, percent) if len(a) and len(b) else [], columns=["a", "b"], dtype="int64")

    found = materialize(left.groupBy("v", "i", "j").cogroup(right.groupBy("v", "i", "j")).applyInPandas(run, "a bigint, b bigint").distinct())
    discard(listed, whole)
    return found


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set on the left shares with each on the right. Values of few sets are counted pair by pair,
    the others by products of matrices of a bounded number of columns."""
    flat = lambda x: (np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x]))
    (lv, lm), (rv, rm) = flat(left), flat(right)
    lo, ro = np.argsort(lv, kind="stable"), np.argsort(rv, kind="stable")
    lv, lm, rv, rm = lv[lo], lm[lo], rv[ro], rm[ro]
    values, at, n = np.unique(lv, return_index=True, return_counts=True)
    first = np.searchsorted(rv, values, "left")
    m = np.searchsorted(rv, values, "right") - first
    common = np.zeros((len(left), len(right)), np.int32)
    few = np.flatnonzero((m > 0) & (n * m <= 64))
    for some in np.array_split(few, max(1, len(few) // 100_000)):
        # Every member on the left of a value, and for each of them every member on the right.
        who = np.repeat(at[some] - np.cumsum(n[some]) + n[some], n[some]) + np.arange(n[some].sum())
        of = np.repeat(some, n[some])
        whom = np.repeat(first[of] - np.cumsum(m[of]) + m[of], m[of]) + np.arange(m[of].sum())
        np.add.at(common, (np.repeat(lm[who], m[of]), rm[whom]), 1)
    many = np.flatnonzero(n * m > 64)
    for some in np.array_split(many, max(1, -(-len(many) // 2048))):
        sides = []
        for member, begin, count, sets in ((lm, at, n, left), (rm, first, m, right)):
            x = np.zeros((len(sets), len(some)), np.float32)
            column = np.repeat(np.arange(len(some)), count[some])
            x[member[np.repeat(begin[some] - np.cumsum(count[some]) + count[some], count[some]) + np.arange(count[some].sum())], column] = 1
            sides.append(x)
        common += (sides[0] @ sides[1].T).astype(np.int32)
    return common


def _joining(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Pairs of classes, at the similarity or above, that connect what all such pairs between the two frames connect."""
    common = _shared(left["values"].to_list(), right["values"].to_list())
    ln, rn = left["values"].map(len).to_numpy()[:, None], right["values"].map(len).to_numpy()[None, :]
    near = common * 100 >= (ln + rn - common) * percent
    _, label = np.unique(np.concatenate([left["root"], right["root"]]), return_inverse=True)
    label = label.reshape(-1)
    lk, rk = left["cls"].tolist(), right["cls"].tolist()
    out = []
    for x in range(len(lk)):
        ys = np.flatnonzero(near[x])
        parts, which = np.unique(label[len(lk) + ys], return_index=True)
        for part, y in zip(parts.tolist(), ys[which].tolist(), strict=True):
            if part != label[x]:
                out.append((min(lk[x], rk[y]), max(lk[x], rk[y])))
                label[label == part] = label[x]
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5) -> DataFrame:
    """One row per document row: its id, n_shingles, component_id (the smallest id reachable), kept (it has that id).

    Sets are linked at Jaccard similarity ``percent``/100 or more, 75 at least. Rows with equal sets, exact copies among
    them, are one class from the start and meet no other way. Empty and null texts are linked with nothing: each has its
    own id as component. A null id never is a component's id, unless all ids of a component are null; its row is kept if
    its text is empty, else not. A repeated id keeps each of its rows.

    Sets are known by 64-bit hashes of their shingles, classes by 128 bits of these. Nothing else is left to chance but
    what the sketches' ``LEAST`` and ``FRONT`` state: a pair of sets of more than ``WHOLE`` shingles is missed in under
    two cases of a million at a similarity of exactly 0.75, more rarely above, and then only if no chain of links joins
    the two."""
    if percent < 75:
        raise ValueError("the bounds of this operator hold from 75 percent on")
    at = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text")).alias("at")
    rows = docs.select(at, F.col(text_col).alias("text"))
    sketched = materialize(_sets(rows, width, False))
    distinct = sketched.filter("n > 0").groupBy("key", "key2").agg(F.min("at").alias("rep"), F.first("n").alias("n"), F.first("values").alias("values"))
    classes = materialize(distinct.withColumn("cls", F.monotonically_increasing_id()))
    postings = classes.select("cls", "n", F.posexplode("values").alias("rank", "v"))
    sizes = materialize(postings.groupBy("v").agg(F.count("*").alias("df"), F.min("cls").alias("first"), F.max("cls").alias("last")).filter("df > 1"))
    few = postings.join(sizes.filter(F.col("df") <= SHORT).select("v"), "v")
    pairs = few.alias("x").join(few.alias("y"), F.expr("x.v = y.v and x.cls < y.cls")).filter(_of_size(F.col("x.n"), F.col("y.n"), percent)).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
    # A similar pair shares _least of its sketches. If no short list has it, both have that many values of long lists, and
    # of the FRONT smallest values of their union they share one.
    many = postings.join(sizes.filter(F.col("df") > SHORT), "v")
    needing = many.groupBy("cls").agg(F.count("*").alias("long_lists"), F.first("n").alias("n")).filter(F.col("long_lists") >= _least(F.col("n"), percent)).select("cls")
    many = materialize(many.filter(F.col("rank") < FRONT).join(needing, "cls", "left_semi"))
    hubs = many.select("cls", F.col("first").alias("hub")).union(many.select("cls", "last")).filter("cls <> hub").select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"))
    links = _verify(pairs.unionByName(hubs).distinct(), classes, rows, percent, width)
    # Of lists with the same members one is enough.
    same = many.groupBy("v").agg(F.count("*").alias("members"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("sum")).groupBy("members", "sum").agg(F.min("v").alias("v"))
    lists = many.select("v", "cls", "n").join(same.filter("members > 1").select("v"), "v", "left_semi")
    linked = components(links)
    rooted = lists.join(linked, "cls", "left").select("v", "cls", "n", F.coalesce("root", "cls").alias("root"))
    more = _apart(rooted, classes, rows, percent, width)
    roots = components(links.unionByName(more))
    discard(sizes, many, links, linked, more)
    joined = classes.select("cls", "key", "key2", "rep").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = joined.groupBy("root").agg(F.min("rep")["doc"].alias("component"))
    label = joined.join(smallest, "root").select("key", "key2", "component")
    full = sketched.select("at", "key", "key2", "n").filter("n > 0").join(label, ["key", "key2"]).select("at.doc", "n", "component")
    empty = sketched.filter("n = 0").select("at.doc", "n", F.col("at.doc").alias("component"))
    kept = F.when(F.col("n") == 0, True).otherwise(F.coalesce(F.col("doc") == F.col("component"), F.lit(False)))
    return full.unionByName(empty).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, its columns as they were. A row is known by its id and text: rows of one id and
    different texts are judged each for itself, of rows that repeat both one stays, and rows without an id are judged
    like others, but go before one that has an id does. Of empty texts without an id one stays."""
    row = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(1)).alias("h2"))
    name = free_name(docs, "row")
    known = docs.withColumn(name, row)
    kept = near_duplicates(known.select(F.col(name).alias("row"), "text"), "row").filter("kept").groupBy(F.col("row").alias(name)).agg(F.count("*").alias(f"{name}_copies"))
    found = known.join(kept, name)
    once = found.filter(F.col(f"{name}_copies") == 1).select(*docs.columns)
    return once.unionByName(found.filter(F.col(f"{name}_copies") > 1).dropDuplicates([name]).select(*docs.columns))
