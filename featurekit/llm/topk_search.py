"""Exact top-k search (operator 5): incremental multi-index hashing over binary codes. Search radii of the codes' segments
grow until the k-th verified Hamming distance is provably covered."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurekit.llm.common import materialize

#: Bits of a segment at most: in round r a segment of w bits is looked up by C(w, r) values, and five segments of 13 bits cover
#: a distance of 19 with 1,890 of them, four of 16 bits with 10,068.
WIDEST = 13


def sign_code(vector: Column, bits: int = 64) -> Column:
    """A code of the signs of a vector's first ``bits`` items: bit i is set where item i is above 0."""
    bit = lambda i: F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    out = bit(0)
    for i in range(1, bits):
        out = out.bitwiseOR(bit(i))
    return out


def segments(n: int, bits: int = 64) -> list[tuple[int, int]]:
    """Lowest bit and width of the segments of an index of ``n`` codes: about log2(n) bits each, ``WIDEST`` at most."""
    count = max(1, round(bits / max(4, min(WIDEST, n.bit_length() - 1))))
    edges = [round(i * bits / count) for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in pairwise(edges)]


def _value(code: Column, lo: int, width: int) -> Column:
    return F.shiftrightunsigned(code, lo).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _probes(code: Column, cuts: list[tuple[int, int]], radius: int) -> Column:
    """Every segment's number and the values that differ from the code's in ``radius`` bits."""

    def around(s: int, lo: int, width: int) -> Column:
        masks = [sum(1 << i for i in c) for c in combinations(range(width), radius)]
        held = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")  # folded to a literal
        return F.transform(held, lambda m: F.struct(F.lit(s).alias("segment"), _value(code, lo, width).bitwiseXOR(m).alias("value")))

    return F.flatten(F.array(*(around(s, lo, width) for s, (lo, width) in enumerate(cuts) if radius <= width)))


def _shown_first(query: Column, code: Column, cuts: list[tuple[int, int]], radius: int) -> Column:
    """Whether a code that its segment shows at this radius is shown by no smaller radius and by no segment before it, so
    that every code is met once."""
    apart = [F.bit_count(_value(query.bitwiseXOR(code), lo, width)) for lo, width in cuts]
    tests = [F.when(F.col("segment") > s, d > radius).otherwise(d >= radius) for s, d in enumerate(apart)]
    return reduce(Column.__and__, tests)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """query id, rank (from 1), neighbour id and distance: the k rows nearest to every query by Hamming distance of codes.

    Ties go to the smaller id. A row is not its own neighbour: rows that carry the query's id are left out; with fewer
    other rows than k there are fewer results. Null ids and codes take no part, a repeated id is one neighbour, at its
    least distance, and a repeated query with one code is one query. Rows of equal code are one entry with its k + 1
    smallest ids, which is all that a query can need.

    The index is a written table of (segment, value, code). In the round of radius r every open query meets, by a join,
    the values of each segment that differ from its own in r bits; codes it has not seen differ in more than r bits of
    every segment, hence in at least segments * (r + 1) bits. Its k + 1 best so far are carried from round to round; they
    drop whatever is farther before the shuffle, and close the query once they all lie below that bound."""
    known = rows.select(F.col(id_col).alias("id"), F.col(code_col).alias("code")).filter("id is not null and code is not null").distinct()
    ranked = known.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("r") <= k + 1)
    entries = materialize(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = queries.select(F.col(id_col).alias("query"), F.col(code_col).alias("code")).filter("query is not null and code is not null").distinct()
    cuts = segments(entries.count())
    values = F.array(*(F.struct(F.lit(s).alias("segment"), _value(F.col("code"), lo, width).alias("value")) for s, (lo, width) in enumerate(cuts)))
    index = materialize(entries.select(F.explode(values).alias("x"), "code", "ids").select("x.segment", "x.value", "code", "ids"))
    best = Window.partitionBy("q").orderBy("distance", "id")
    kind = rows.schema[id_col].dataType
    open_, found = asked.select(F.col("code").alias("q"), F.lit(64).alias("bar")).distinct(), None
    closed: list[DataFrame] = []
    for radius in range(max(w for _, w in cuts) + 1):
        probes = open_.select("q", "bar", F.explode(_probes(F.col("q"), cuts, radius)).alias("x")).select("q", "bar", "x.segment", "x.value")
        met = probes.hint("merge").join(index, ["segment", "value"]).withColumn("distance", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))))
        met = met.filter((F.col("distance") <= F.col("bar")) & _shown_first(F.col("q"), F.col("code"), cuts, radius))
        hits = met.select("q", "distance", F.explode("ids").alias("id"))
        # A query without any code so far stays known by a row of its own.
        held = open_.select("q", F.lit(65).alias("distance"), F.lit(None).cast(kind).alias("id")) if found is None else found
        ranked = held.unionByName(hits).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
        bound = F.max("distance").over(Window.partitionBy("q"))
        full = F.count("*").over(Window.partitionBy("q")) == k + 1
        covered = (bound < len(cuts) * (radius + 1)) & full
        state = materialize(ranked.drop("r").withColumns({"bar": F.when(full, F.least(bound, F.lit(64))).otherwise(64), "done": covered}))
        closed.append(state.filter("done").select("q", "distance", "id"))
        found = state.filter("not done").select("q", "distance", "id")
        open_ = state.filter("not done").select("q", "bar").distinct()
        if not open_.limit(1).count():
            break
    nearest = reduce(DataFrame.unionByName, [*closed, found]).filter("id is not null")
    lists = nearest.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))  # k + 1 at most
    mine = asked.join(lists, asked["code"] == lists["q"]).withColumn("near", F.slice(F.filter("near", lambda x: x["id"] != F.col("query")), 1, k))
    return mine.select("query", F.posexplode("near").alias("at", "x")).select(F.col("query").alias(id_col), (F.col("at") + 1).alias("rank"), F.col("x.id").alias("neighbour"), F.col("x.distance").alias("distance"))


def nearest_embeddings(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest of all rows for every row whose id is divisible by 20."""
    coded = embeddings.select("vec_id", sign_code(F.col("embedding")).alias("code"))
    return top_k(coded, coded.filter("vec_id % 20 = 0"), k)
