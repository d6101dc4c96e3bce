"""Connected groups of near duplicates from buckets of candidates, without all pairs of a bucket. DataFrame operations only.

Every item of a bucket is compared with one item of it, the hub, so that a bucket of n items gives n - 1 pairs. Where a bucket then still
holds several groups, its items are dealt to finer buckets, whose own hubs are closer to them; levels go on until one links nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


#: Edges up to which they are held in one partition, where no step needs a shuffle (16 bytes each).
ONE_TASK = 500_000
#: Items from which a last bucket meets hubs before it is compared whole, and how many of them.
SMALL, HUBS = 64, 2
#: Items of a tile: in larger buckets, each two tiles meet in a place of their own.
TILE = 512
#: Items up to which a first bucket of grouped_by_rarity() is compared whole.
WHOLE = 16


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b), long; component is the smallest node reachable.

    Large-star and small-star steps in turn (Kiveris et al., 2014), each written out, until nothing changes. Loops and repeated edges
    do no harm; nulls are left out. Up to ONE_TASK edges, as counted, steps run in one task each: same steps, no shuffles.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == seen or not state["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = state
        now = now.coalesce(1) if state["n"] <= ONE_TASK else now
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.when(F.col("b") == F.col("m"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        now = written(large.join(least, "a").select(pair.alias("e")).select("e.*").distinct())


def joined_keys(m: int):
    """Finer keys: each of an item's keys with the m - 1 that follow it, in a ring; as many as there are keys."""

    def keys(own: Column) -> Column:
        ring = F.concat(own, F.slice(own, 1, m - 1))
        return F.transform(own, lambda x, i: F.xxhash64(*(F.get(ring, i + j) for j in range(m))))

    return keys


def crowded(items: DataFrame, keys: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, item, n) and the columns to keep: the keys of each item that n > 1 items have. Keys of an item are distinct."""
    rows = items.select("item", *keep, F.explode(keys).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(counts, "bucket").select("bucket", "item", *keep, "n")


def met(items: DataFrame, keys: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """As crowded(), by one shuffle of the rows and not two: worth it where most rows are alone with their key."""
    rows = items.select("item", *keep, F.explode(keys).alias("bucket"))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).filter("n > 1").select("bucket", "item", *keep, "n")


def _with_hubs(rows: DataFrame, hubs: DataFrame, differ: str, alike: Column) -> DataFrame:
    """(a, b): the items of each bucket with its hub."""
    found = rows.join(hubs, "bucket").filter(F.expr(differ) & alike)
    return found.select(F.least("item", "hub.item").alias("a"), F.greatest("item", "hub.item").alias("b")).distinct()


def grouped(items: DataFrame, shared: DataFrame, finer: list[Callable[[Column], Column]], verify: Callable[[DataFrame], DataFrame], keep: tuple[str, ...] = (), alike: Column | None = None, last: Callable[[DataFrame], DataFrame] | None = None, worth: Callable[[Column, Column], Column] = lambda x, y: F.lit(True)) -> DataFrame:
    """(node, component) of items that are linked; items that are linked with nothing may be absent.

    items: (item, keys) and the columns to keep, the keys of each item as an array of distinct longs. shared: the written crowded() of
    these keys. finer: from the keys, those of each further level. verify: takes candidate pairs (a, b), returns those that are linked.
    alike: from the kept columns of an item and of `hub`, whether the two are worth a look.

    The hub of a first bucket is the item that shares its buckets with the most others, the likeliest to be what copies come from; that
    of a finer bucket any one, by hash. A link is found if both of its items are linked with a common hub, or if one is the hub.

    last: from items (item) of first buckets that still hold several groups after all levels, further buckets (item, bucket) and other columns, such that two
    items that are linked share one. These are compared whole, but for pairs that worth() rules out by these columns.
    """
    alike = F.lit(True) if alike is None else alike
    central = shared.groupBy("item").agg(F.sum("n").alias("met"))
    ranked = shared.join(central, "item")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("met", "item", *keep)).alias("hub"))
    label = written(components(verify(written(_with_hubs(shared, hubs, "item <> hub.item", alike)))))
    rows = shared.select("bucket", "item")
    for turn, deeper in enumerate(finer):
        marked = written(rows.join(label.withColumnRenamed("node", "item"), "item", "left").select("bucket", "item", F.coalesce("component", "item").alias("label")))
        split = marked.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
        open_items = marked.join(split, "bucket", "left_semi").select("item", "label").distinct()
        rows = written(items.join(open_items, "item").select("item", *keep, "label", F.explode(deeper(F.col("keys"))).alias("bucket")))
        order = F.struct(F.xxhash64("item", F.lit(turn)), "item", *keep, "label")
        hubs = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(order).alias("hub")).filter("lo <> hi").select("bucket", "hub")
        more = written(verify(written(_with_hubs(rows, hubs, "label <> hub.label", alike))))
        if more.isEmpty():
            break
        label = written(components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
        rows = rows.select("bucket", "item")
    if last is None:
        return label
    marked = written(shared.join(label.withColumnRenamed("node", "item"), "item", "left").select("bucket", "item", F.coalesce("component", "item").alias("label")))
    split = marked.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    open_items = written(marked.join(split, "bucket", "left_semi").select("item").distinct())
    return linked_whole(written(last(open_items)), label, worth, verify)


def _pair(x: Column, y: Column) -> Column:
    return F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def every_pair(rows: DataFrame, worth: Callable[[Column, Column], Column]) -> DataFrame:
    """(a, b): every two items of a bucket that differ in label and that worth() lets through. rows: (bucket, item, label, held) and others; `held` is how many rows the bucket has.

    Buckets of more than TILE items are dealt to tiles by hash, and each two tiles meet under a key of their own: no task holds more than a tile of either
    side, and a large bucket is spread over all tasks.
    """
    tiles = F.ceil(F.col("held") / TILE).cast("int")
    own = F.pmod(F.xxhash64("item"), tiles).cast("int")
    cells = rows.select("bucket", F.struct(*(c for c in rows.columns if c not in ("bucket", "held"))).alias("x"), own.alias("i"), tiles.alias("tiles"))
    a = cells.select("bucket", "x", "i", F.explode(F.sequence("i", F.col("tiles") - 1)).alias("j"))
    b = cells.select("bucket", F.col("x").alias("y"), F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), "i")).alias("i"))
    once = (F.col("i") < F.col("j")) | (F.col("x.item") < F.col("y.item"))
    met = a.join(b.hint("merge"), ["bucket", "i", "j"]).filter(once & F.expr("x.label <> y.label") & worth(F.col("x"), F.col("y")))
    return met.select(_pair(F.col("x.item"), F.col("y.item")).alias("p")).select("p.a", "p.b").distinct()


def linked_whole(rows: DataFrame, label: DataFrame, worth: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component): label, with all links between items of a bucket, of rows (bucket, item) and what worth() needs of two items.

    Large buckets meet their hub first, HUBS times over, which leaves few groups in most. Then every two items of a bucket that are of different groups
    still are compared, in buckets of any size.
    """
    for turn in range(HUBS + 1):
        labelled = rows.join(label.withColumnRenamed("node", "item"), "item", "left").withColumn("label", F.coalesce("component", "item")).drop("component")
        order = F.struct(F.xxhash64("item", F.lit(turn)), *labelled.drop("bucket").columns)
        sizes = labelled.groupBy("bucket").agg(F.count("*").alias("held"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(order).alias("hub")).filter("lo <> hi")
        if turn < HUBS:
            dealt = labelled.join(sizes.filter(F.col("held") > SMALL).select("bucket", "hub"), "bucket").withColumn("x", F.struct(*labelled.columns))
            pairs = dealt.filter(F.expr("label <> hub.label") & worth(F.col("x"), F.col("hub"))).select(_pair(F.col("item"), F.col("hub.item")).alias("p")).select("p.a", "p.b").distinct()
        else:
            pairs = every_pair(written(labelled.join(sizes.select("bucket", "held"), "bucket")), worth)
        pairs = written(pairs)
        if pairs.isEmpty():
            continue
        more = written(verify(pairs))
        if not more.isEmpty():
            label = written(components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    return label


def _beside(rows: DataFrame, size: str, alike: Callable[[Column, Column], Column], near: int) -> DataFrame:
    """(a, b): the rows (bucket, item, label, size) with the next `near` of their bucket by size, but for those of one label."""
    own = F.struct(F.col(size), F.xxhash64("item").alias("h"), "item", "label")
    lists = rows.groupBy("bucket").agg(F.sort_array(F.collect_list(own)).alias("all"))
    worth = lambda x: lambda y: (x["label"] != y["label"]) & alike(x[size], y[size])
    pairs = F.transform("all", lambda x, i: F.transform(F.filter(F.slice("all", i + 2, near), worth(x)), lambda y: _pair(x["item"], y["item"])))
    return lists.select(F.explode(F.flatten(pairs)).alias("p")).select("p.a", "p.b")


def grouped_by_rarity(shared: DataFrame, size: str, alike: Callable[[Column, Column], Column], prepare: Callable[[DataFrame], tuple], worth: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(node, component) of items that are linked; items that are linked with nothing may be absent.

    shared: the written crowded() of items with a column `size`. alike: of two sizes, whether their items are worth a look. prepare: from the
    items (item) that may be compared, the functions verify and last as for grouped(). Buckets of up to WHOLE items are compared whole. The hub of a larger
    one is the item that shares such buckets with the most others, and its items, if they then still are of several groups, go to the buckets of
    `last`, which are compared whole, but for pairs that alike() or worth() rules out; `last` may return the larger buckets themselves, with what worth() needs.
    """
    few = shared.filter(F.col("n") <= WHOLE).withColumn("label", F.col("item"))
    many = shared.filter(F.col("n") > WHOLE)
    central = many.groupBy("item").agg(F.sum("n").alias("met"))
    hubs = many.join(central, "item").groupBy("bucket").agg(F.max(F.struct("met", "item", size)).alias("hub"))
    with_hubs = _with_hubs(many, hubs, "item <> hub.item", alike(F.col(size), F.col(f"hub.{size}")))
    pairs = written(_beside(few, size, alike, WHOLE - 1).unionByName(with_hubs).distinct())
    verify, last = prepare(written(pairs.select(F.explode(F.array("a", "b")).alias("item")).unionByName(many.select("item")).distinct()))
    label = written(components(verify(pairs)))
    marked = written(many.join(label.withColumnRenamed("node", "item"), "item", "left").select("bucket", "item", size, F.coalesce("component", "item").alias("label")))
    split = marked.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    some = written(marked.join(split, "bucket", "left_semi").select("item", size).distinct())
    both = lambda x, y: alike(x[size], y[size]) & (worth(x, y) if worth else F.lit(True))
    return linked_whole(written(last(some.select("item")).join(some, "item")), label, both, verify)
