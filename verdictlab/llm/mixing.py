"""Mixing sources to target weights: epochs first, then an Efraimidis-Spirakis order cut at the token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from verdictlab.functions.shared import materialise

#: Slices of the key order of a source. Sums per slice find the one slice in which a budget runs out.
SLICES = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sample_key(key: Column, weight: Column, seed: int) -> Column:
    """Exponential key -ln(u)/w; the smallest keys are drawn first. ``u`` comes from 52 bits of the MD5 of ``seed`` and
    ``key``, so reruns agree."""
    digest = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), key.cast("string")), "UTF-8"))
    h = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return -F.log((h + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def targets(sources: DataFrame, weights: tuple = (5, 2, 1), most: int = 3) -> DataFrame:
    """``(source, source_size, target)``. Sources in code-point order, null last, take ``weights`` in turn and share
    the sum of all sizes; a target stops at ``most`` times its source's size and the excess is shared again.

    That fixpoint has a closed form: in the order of size/weight the capped sources come first, so the level is
    found from running sums. ``sources`` has one row per source (the mixture's own list, not the documents).
    """
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (n % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    s = (
        s.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("passed", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("all", F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        # the level, if just the sources before this one were capped
        .withColumn("level", (F.col("all") - F.col("used")) / (F.col("weights") - F.col("passed")))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.max(F.when(F.col("fits"), F.col("level"))).over(whole)
    return s.withColumn("level", F.coalesce(level, F.lit(0.0))).select(
        "source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target")
    )


def plan(rows: DataFrame) -> DataFrame:
    """One row per source of ``(source, source_size, target, epochs, cut, closing)`` from
    ``rows(source, size, key)``: each document is taken ``epochs`` times, once more where its key is up to ``cut``,
    and once more where its key is among ``closing``. Where less than a word is left after the epochs, nothing is."""
    at = F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * SLICES)
    rows = rows.withColumn("slice", F.least(at, F.lit(SLICES - 1)).cast("int"))
    per_slice = materialise(rows.groupBy("source", "slice").agg(F.sum("size").alias("size")))
    s = targets(per_slice.groupBy("source").agg(F.sum("size").alias("source_size")))
    s = s.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    s = s.withColumn("epochs", F.least("epochs", F.lit(3)))
    s = materialise(s.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    same = F.col("a.source").eqNullSafe(F.col("b.source"))

    # the slice in which the rest of the budget runs out, and what the slices before it hold
    run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    sums = per_slice.withColumn("upto", F.sum("size").over(run))
    cross = (
        sums.alias("a").join(F.broadcast(s.select("source", "rest")).alias("b") if _small(s) else s.select("source", "rest").alias("b"), same)
        .filter((F.col("rest") >= 1) & (F.col("upto") > F.col("rest")))
        .groupBy("a.source", "rest")
        .agg(F.min(F.struct("slice", (F.col("upto") - F.col("size")).alias("before"))).alias("at"))
        .select("source", "rest", F.col("at.slice").alias("slice"), F.col("at.before").alias("before"))
    )
    # rows of that one slice, in key order; rows of equal keys go together
    by_key = rows.groupBy("source", "slice", "key").agg(F.sum("size").alias("size"))
    edge = by_key.alias("a").join(cross.alias("b"), same & (F.col("a.slice") == F.col("b.slice"))).select("a.*", "rest", "before")
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source", "slice").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    cut = (
        edge.withColumn("upto", upto).filter("upto <= rest").groupBy("source")
        .agg(F.max("key").alias("cut"), F.max("upto").alias("got"))
    )
    cut = cross.alias("a").join(cut.alias("b"), same, "left").select(
        "a.source",
        # no row of the slice fits: everything up to the slice's lower end is in
        F.coalesce(F.col("cut"), -F.log(F.lit(1.0) - F.col("slice") / F.lit(float(SLICES))) * F.lit(1.0 - 1e-12)).alias("cut"),
        (F.col("rest") - F.coalesce(F.col("got"), F.col("before"))).alias("gap"),
    )
    # closing documents, one a round: of those not drawn the largest that fits the gap, at last the one nearest to it
    state = materialise(cut.withColumn("closing", F.array().cast("array<double>")))
    for at_most in (True, True, False):
        own = state.filter("gap > 0").withColumnRenamed("source", "__s")
        left = rows.join(own, F.col("source").eqNullSafe(F.col("__s"))).filter((F.col("key") > F.col("cut")) & ~F.array_contains("closing", F.col("key")))
        left = left.groupBy("source", "key").agg(F.sum("size").alias("size"), F.first("gap").alias("gap"))
        off = F.abs(F.col("size") - F.col("gap"))
        helps = (F.col("size") > 0) & (F.col("size") <= F.col("gap") if at_most else off < F.col("gap"))
        pick = left.filter(helps).groupBy("source").agg(F.min(F.struct(off.alias("off"), "key", "size")).alias("x"))
        found = state.alias("a").join(pick.alias("b"), same, "left")
        state = materialise(found.select(
            "a.source", "cut", (F.col("gap") - F.coalesce("x.size", F.lit(0))).alias("gap"),
            F.concat("closing", F.array_compact(F.array("x.key"))).alias("closing"),
        ))
    return (
        s.alias("a").join(state.alias("b"), same, "left")
        .select("a.source", "source_size", "target", "epochs", F.coalesce("cut", F.lit(-1.0)).alias("cut"), F.coalesce("closing", F.array().cast("array<double>")).alias("closing"))
    )


def _small(sources: DataFrame, most: int = 100_000) -> bool:
    """Whether the per-source table may be broadcast; checked, for the number of sources isn't bounded by itself."""
    return sources.limit(most + 1).count() <= most


def draw(docs: DataFrame, plans: DataFrame, key: Column, size: Column, out: str = "mix") -> DataFrame:
    """``docs`` with the struct ``out``: source_size, target, copies and taken (words, repeats counted)."""
    p = plans.select(F.struct(*plans.columns).alias("__p"), F.col("source").alias("__s"))
    p = F.broadcast(p) if _small(plans) else p
    d = docs.withColumn("__key", key).withColumn("__size", size)
    d = d.join(p, F.col("source").eqNullSafe(F.col("__s")), "left")
    more = ((F.col("__key") <= F.col("__p.cut")) | F.array_contains("__p.closing", F.col("__key"))).cast("long")
    copies = F.col("__p.epochs") + more
    found = F.struct(
        F.col("__p.source_size").alias("source_size"), F.col("__p.target").alias("target"),
        copies.alias("copies"), (copies * F.col("__size")).alias("taken"),
    )
    return d.withColumn(out, found).drop("__key", "__size", "__p", "__s")


def with_weight(docs: DataFrame, quality: DataFrame | None, key: str = "doc_id", good: float = 2.0, poor: float = 0.5) -> DataFrame:
    """``docs`` with ``__weight``: ``good``/``poor`` by the mean of the ``quality`` labels (0 or 1), 1 without one."""
    if quality is None:
        return docs.withColumn("__weight", F.lit(1.0))
    q = quality.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.avg("quality").alias("__q"))
    w = F.when(F.col("__q") >= 0.5, good).when(F.col("__q") < 0.5, poor).otherwise(1.0)
    # labels grow with the documents, so this is a sort-merge join at every size
    return docs.join(q.hint("merge"), F.col(key) == F.col("__id"), "left").withColumn("__weight", w).drop("__id", "__q")


def _slim(docs: DataFrame, quality: DataFrame | None, text: str, key: str, seed: int) -> DataFrame:
    """``(key, source, size, k)``: the texts are counted before anything is joined, so they aren't moved."""
    d = docs.select(F.col(key), F.col("source"), word_count(F.col(text)).alias("size"))
    d = with_weight(d, quality, key)
    k = sample_key(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("__weight"), seed)
    return materialise(d.select(F.col(key), "source", "size", k.alias("k")))


def sizes(docs: DataFrame, quality: DataFrame | None, text: str = "text", key: str = "doc_id", seed: int = 0) -> DataFrame:
    """``(key, size, source_size, target, copies, taken)``, one row per row of ``docs``: how often each document enters
    the mixture.

    Whole epochs of a source come first; the rest of its budget goes to its documents in the order of their
    exponential keys (scaled by quality weights), up to a prefix sum within the budget, and to at most three closing
    documents that fit the remaining gap best. No document is taken more than three times. The budget's prefix sum is found
    from sums over slices of the key order, so only one slice of each source is ever sorted. Null text has size 0,
    a null source is a source of its own; rows of one ``key`` share a sampling key and are drawn together (so
    repeated rows agree); null keys share one. An empty table stays empty.
    """
    slim = _slim(docs, quality, text, key, seed)
    found = draw(slim, plan(slim.select("source", "size", F.col("k").alias("key"))), F.col("k"), F.col("size"))
    return found.select(key, "size", "mix.*")


def mix(docs: DataFrame, quality: DataFrame | None = None, text: str = "text", key: str = "doc_id", seed: int = 0) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as ``sizes`` says (rows with no copy go), all columns kept."""
    slim = _slim(docs, quality, text, key, seed)
    found = draw(slim, plan(slim.select("source", "size", F.col("k").alias("key"))), F.col("k"), F.col("size"))
    copies = found.filter("mix.copies > 0").select(F.col(key).alias("__id"), F.col("source").alias("__from"), F.col("mix.copies").cast("int").alias("__n")).distinct()
    same = F.col(key).eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__from"))
    d = docs.join(copies.hint("merge"), same)
    return d.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__id", "__from", "__n", "__copy")
