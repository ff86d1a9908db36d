"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target is its weight's share of all words, at most ``MOST`` times
its own words; what is cut off goes to the other sources by weight until none
is above. Each of its documents should then be taken target / size times. The
whole part is taken; the fraction is a probability, the same for all documents
of a source, and is rounded dependently: two documents meet, and words move
from one's expectation to the other's, a random way whose mean is nought, until
one of the two is taken or left for certain. The sum of words never changes, so
a source misses its target by less than its one last document.

Documents are dealt by hash into groups of about ``GROUP``; a fold over a
group, longest first, leaves one undecided document. Those are dealt again, so a
source of n documents takes log n / log ``GROUP`` rounds, a hot source as many
tasks as it has groups. Rounds carry ids and sizes, never texts, and are
written to the shared folder. The last document of a source is taken if its
probability is a half or more. A long document may be that last one, as each
meeting decides the shorter of the two; so one group of each source waits for the
last round, and that, of about twice ``GROUP`` documents at most, is folded with
``TRIES`` seeds and the fold that misses the target least is kept. This is the
one step that is not free of bias.

Random numbers are hashes of the seed, the round and the two documents, so
reruns agree, whatever the partitions.

Defined cases: null and wordless texts have size 0 and add nothing; documents
without source are one source, the last; rows that repeat an id, a source and a
size are interchangeable: all but one of them are decided at once, by their
number; rows without id are told apart by size alone, likewise; an empty table
gives no rows; columns other than doc_id, text and source are not read. Sources
are numbered in one window, which holds a row for each source, not for each
document.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import forget, kept

WEIGHTS = (5, 2, 1)
MOST = 3
GROUP = 256
TRIES = 16
ITEM = "struct<size:bigint,key:bigint,doc_id:{},p:double,base:int,rows:bigint,more:bigint>"


def size(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size): weights go round the sources by code point, the null source last.

    A source is full if its limit is below its weight's part. Sources in the order
    of limit by weight fill up first, so the full ones are a beginning of that order:
    running sums give what is left for the others at each place.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    by = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weights_left)
    # The level of the first source that its part does not fill is the level of all that follow.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(every)["level"]
    return rows.select("source", "source_size", F.coalesce(F.least("limit", level * F.col("weight")), F.col("limit")).alias("target"))


def uniform(*columns: Column) -> Column:
    """A hash as a number from 0 to below 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / float(1 << 53)


def pivot(items: Column, seed: Column, kind: str) -> Column:
    """Fold of a group's items, longest first: those decided (``p`` 0 or 1), and the one left."""

    def step(state: Column, b: Column) -> Column:
        a = state["left"]
        # Words that a may gain from b, or lose to it, before one of them is certain.
        up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
        down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        gains = uniform(seed, a["key"], a["size"], b["key"], b["size"]) * (up + down) < down
        moved = F.when(gains, up).otherwise(-down)
        # Whether it is a that becomes certain; compared by the very numbers that up and down are the lesser of.
        a_ends = F.when(gains, (1 - a["p"]) * a["size"] <= b["p"] * b["size"]).otherwise(a["p"] * a["size"] <= (1 - b["p"]) * b["size"])
        b_end = F.when(gains, 0.0).otherwise(1.0)

        def item(x: Column, p: Column) -> Column:
            return F.struct(x["size"].alias("size"), x["key"].alias("key"), x["doc_id"].alias("doc_id"), p.alias("p"), x["base"].alias("base"), x["rows"].alias("rows"), x["more"].alias("more"))

        near = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        sure = F.when(a_ends, item(a, F.when(gains, 1.0).otherwise(0.0))).otherwise(item(b, b_end))
        left = F.when(a_ends, item(b, near(b["p"] - moved / b["size"]))).otherwise(item(a, near(a["p"] + moved / a["size"])))
        return F.struct(left.alias("left"), F.concat(state["done"], F.array(sure)).alias("done"))

    none = F.expr(f"cast(array() as array<{ITEM.format(kind)}>)")
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), F.struct(F.get(items, F.lit(0)).alias("left"), none.alias("done")), step)


def nearest(items: Column, seed: Column, kind: str) -> Column:
    """The fold of ``TRIES`` that leaves least to round."""

    def tried(n: Column) -> Column:
        f = pivot(items, seed * TRIES + n, kind)
        return F.get(F.transform(F.array(f), lambda x: F.struct((F.least(x["left"]["p"], 1 - x["left"]["p"]) * x["left"]["size"]).alias("miss"), n.alias("n"), x["left"].alias("left"), x["done"].alias("done"))), F.lit(0))

    return F.get(F.transform(F.array(F.array_min(F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), tried))), lambda x: F.struct(x["left"].alias("left"), x["done"].alias("done"))), F.lit(0))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: int = MOST, seed: int = 0) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies): how often the mix takes each document; a row for each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Rows that cannot be told apart are counted before anything moves.
    counted = docs.select("doc_id", "source", size(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    counted = kept(counted, "sizes")
    goals = kept(targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, share, most), "targets")
    numbered = goals.select(F.col("source").alias("of"), "target", "source_size", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("each"))
    groups = counted.groupBy("source").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.lit(1)).alias("groups"))
    info = numbered.join(groups.withColumnRenamed("source", "of2"), F.col("of").eqNullSafe(F.col("of2"))).drop("of2")
    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = counted.join(info, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("base", F.floor("each").cast("int")).withColumn("key", key)
    # Of n equal rows, so many surely get one more; the rest of their sum is the probability of one of them.
    sum_of = F.col("rows") * (F.col("each") - F.col("base"))
    rows = rows.withColumn("more", F.floor(sum_of).cast("long")).withColumn("p", sum_of - F.floor(sum_of))
    item = F.struct("size", "key", "doc_id", "p", "base", "rows", "more").alias("item")
    items = rows.select("source", item, F.pmod(F.xxhash64(F.lit(seed), F.lit("group"), "key"), F.col("groups")).alias("grp"), "groups")
    fractional = kept(items.where("item.size > 0 and item.p > 0"), "open")
    # A source's group 0 waits until the round after which its other groups are one.
    waits = (F.col("groups") > 1) & (F.col("grp") == 0)
    rounds = F.size(F.filter(F.array(*[F.lit(GROUP**k) for k in range(7)]), lambda x: x < F.col("groups")))
    waiting = fractional.where(waits).withColumn("rounds", rounds).select("source", "item", "grp", F.lit(1).cast("long").alias("groups"), "rounds")
    open_items = fractional.where(~waits)
    decided = [items.where("not (item.size > 0 and item.p > 0)").select("source", "item")]
    turn = 0
    while True:
        turn += 1
        folded = open_items.groupBy("source", "grp", "groups").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        fold = F.when(F.col("groups") <= 1, nearest(F.col("items"), F.lit(seed + turn), kind)).otherwise(pivot(F.col("items"), F.lit(seed + turn), kind))
        folded = kept(folded.select("source", "grp", "groups", fold.alias("f")), "folded")
        decided.append(folded.select("source", F.explode("f.done").alias("item")))
        most_groups = folded.agg(F.max("groups")).first()[0] or 0
        if turn > 1:
            forget(open_items)
        if most_groups <= 1 and waiting.where(F.col("rounds") >= turn).isEmpty():
            last = folded.select("source", "f.left")
            decided.append(last.select("source", F.struct("left.size", "left.key", "left.doc_id", F.when(F.col("left.p") >= 0.5, 1.0).otherwise(0.0).alias("p"), "left.base", "left.rows", "left.more").alias("item")))
            break
        after = F.ceil(F.col("groups") / GROUP)
        left = folded.select("source", F.col("f.left").alias("item"), F.pmod(F.xxhash64(F.lit(seed + turn), F.lit("group"), "f.left.key"), after).alias("grp"), after.alias("groups"))
        open_items = kept(left.unionByName(waiting.where(F.col("rounds") == turn).drop("rounds")), "open")
    every = reduce(DataFrame.unionByName, decided).select("source", "item.*")
    # Each counted row is a row again for every time that it stood there.
    each = every.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    copies = F.col("base") + F.when(F.col("nth") <= F.col("more"), 1).when(F.col("nth") == F.col("more") + 1, F.col("p").cast("int")).otherwise(0)
    back = goals.withColumnRenamed("source", "of")
    return each.join(back, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source", "source_size", "target", copies.cast("int").alias("copies"))


def taken(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents of a mix, each as often as it is taken."""
    copies = mixed.where("copies > 0 and doc_id is not null").groupBy("doc_id").agg(F.max("copies").alias("copies_"))
    return docs.join(copies, "doc_id").withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_")))).select(*docs.columns)
