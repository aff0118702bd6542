"""Mixes sources to target weights by a low-discrepancy schedule of equal-token blocks. Column expressions only.

Each source's documents are laid out in a shuffled order and cut in blocks of equal size. The schedule is a sequence of
slots; van der Corput points (the slot's number with its bits mirrored) fall into the sources' cumulative shares, so
every stretch of the schedule holds the sources close to their shares. A source's slots are ranked, and its k-th slot
takes its k-th block, starting over after the last one; the last slot takes what is left to the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.llm.totals import before
from tapewatch.session import cut

WEIGHTS = (5, 2, 1)
CELLS = 4096


def targets(sizes: DataFrame, source_col: str, size_col: str, weights: Sequence[float] = WEIGHTS, cap: int = 3) -> DataFrame:
    """(source, s, n, source_size, target): a row for each source, numbered by code point with null last.

    Weights repeat in that order and share out the total size. No target exceeds ``cap`` times its source's
    size; what is over is shared again by weight. Sources that stop are those with the smallest cap for their weight, so
    a running sum in that order finds them without repeating the sharing.
    """
    by_source = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"), F.count("*").alias("n"))
    at = Window.orderBy(F.col("source").asc_nulls_last())
    one = by_source.withColumn("s", F.row_number().over(at) - 1)
    one = one.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("s", F.lit(len(weights))) + 1).cast("int")))
    one = one.withColumn("most", (F.col("source_size") * cap).cast("double"))
    steps = Window.orderBy(F.col("most") / F.col("w"), "s").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = F.lit(0.0)
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(steps), zero))
             / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(steps), zero)))
    one = one.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), "s", "level"))
    one = one.withColumn("level", F.coalesce(F.min(fits).over(every).level, F.max(F.col("most") / F.col("w")).over(every)))
    return one.select("source", "s", "n", "source_size", F.least("most", F.col("level") * F.col("w")).alias("target"))


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, s, k): the slots in order; the k-th slot of source s. ``sources`` has s and ``slots``, as many as it needs.

    The sequence has at least four points for each slot that is needed, as many as a power of two: then every stretch
    of shares gets at least as many points as it needs, and a source's slots are its first ones.
    """
    spark = sources.sparkSession
    ends = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    spans = cut(sources.filter("slots > 0").select("s", "slots", F.sum("slots").over(ends).alias("hi")), "spans")
    total = spans.agg(F.max("hi")).first()[0] or 0
    bits = max(1, (4 * total - 1).bit_length()) if total else 1
    points = spark.range(0, (1 << bits) if total else 0).select(F.col("id").alias("slot"))
    mirrored = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("decimal(20,0)")
    points = points.withColumn("at", mirrored.cast("double") / float(1 << bits) * float(total))
    cell = lambda x: F.floor(x / F.lit(max(total, 1) / CELLS)).cast("int")
    held = spans.select("s", "slots", (F.col("hi") - F.col("slots")).alias("lo"), "hi",
                        F.explode(F.sequence(cell(F.col("hi") - F.col("slots")), cell(F.col("hi")))).alias("cell"))
    hit = (points.withColumn("cell", cell(F.col("at"))).join(held, "cell").filter("lo <= at and at < hi")
           .select("slot", "s", "slots", F.lit(1).alias("one"), (F.col("slot") / 65536).cast("long").alias("chunk")))
    return before(hit, "s", "chunk", ["slot"], "one", "k").filter("k < slots").select("slot", "s", F.col("k").cast("long").alias("k"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, cap: int = 3, block: int = 1024, seed: str = "mix", chunk_rows: int = 10_000) -> DataFrame:
    """One row per document: id, source, size (its words), source_size, target (its source's), taken (words the
    mix takes of it, repeats counted).

    Words are ``[^\\x20\\x09-\\x0D]+``. A source's taken words add up to its target, rounded to a whole number and
    at most ``cap`` times its size; no document exceeds ``cap`` times its own size. The order within a source
    follows md5 of ``seed`` and the id, so reruns agree. A null text has size 0 and takes nothing, null sources form one source,
    null ids take part, and repeated rows are documents of their own. An empty table gives no rows, sources without
    words have target 0, and other columns are ignored, whatever their names.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    rows = cut(rows, "sizes")  # texts are read once
    goals = targets(rows, "source", "size", weights, cap)
    b = F.lit(block)
    per_pass = F.ceil(F.col("source_size") / b).cast("long")
    take = F.least(F.round("target").cast("long"), F.col("source_size") * cap)
    whole = F.when(F.col("source_size") > 0, F.expr("take div source_size")).otherwise(F.lit(0))
    goals = goals.withColumn("per_pass", per_pass).withColumn("take", take).withColumn("passes", whole)
    rest = F.col("take") - F.col("passes") * F.col("source_size")
    goals = cut(goals.withColumn("slots", (F.col("passes") * F.col("per_pass") + F.ceil(rest / b)).cast("long")), "targets")

    slots = schedule(goals.select("s", "slots")).join(goals, "s")
    done = F.expr("k div per_pass") * F.col("source_size") + F.pmod("k", "per_pass") * b  # words taken by earlier slots
    full = F.least(b, F.col("source_size") - F.pmod("k", "per_pass") * b)
    slots = slots.select("s", F.pmod("k", "per_pass").alias("block"), full.alias("full"), F.least(full, F.col("take") - done).alias("got"))
    blocks = slots.groupBy("s", "block").agg(F.sum((F.col("got") == F.col("full")).cast("long")).alias("times"),
                                             F.max(F.when(F.col("got") < F.col("full"), F.col("got")).otherwise(0)).alias("part"),
                                             F.sum("got").alias("got"))
    blocks = blocks.withColumn("chunk", F.expr("block div 10000"))
    blocks = cut(before(blocks, "s", "chunk", ["block"], "got", "earlier").select("s", "block", "times", "part", "earlier"), "blocks")

    chunks = max(1, -(-(goals.agg(F.sum("n")).first()[0] or 0) // chunk_rows))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    chunk = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(chunks))
    placed = rows.join(goals.select("source", "s", "source_size", "target").withColumnRenamed("source", "its_source"),
                       F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    placed = placed.withColumn("digest", digest).withColumn("chunk", chunk)
    placed = before(placed, "s", "chunk", ["digest", "id", "size"], "size", "start")
    placed = placed.withColumn("last", F.col("start") + F.greatest(F.col("size") - 1, F.lit(0)))
    for end, x in (("start", F.col("start")), ("last", F.col("start") + F.col("size"))):
        at = blocks.select("s", F.col("block").alias("b"), *[F.col(c).alias(f"{end}_{c}") for c in ("times", "part", "earlier")])
        placed = placed.withColumn("b", F.expr(f"{end} div {block}")).join(at, ["s", "b"], "left")
        inside = x - F.col("b") * b
        got = F.col(f"{end}_earlier") + F.col(f"{end}_times") * inside + F.least(f"{end}_part", inside)
        placed = placed.withColumn(f"{end}_got", F.coalesce(got, F.lit(0))).drop("b")
    # a block that no slot takes lies behind all that are taken: nothing of it is counted, and the words before it are
    total = goals.select("s", "take", "passes")
    placed = placed.join(total, "s")
    last = F.when(F.col("last_times").isNull(), F.col("take")).otherwise(F.col("last_got"))
    start = F.when(F.col("start_times").isNull(), F.col("take")).otherwise(F.col("start_got"))
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(last - start).cast("long")
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (taken over size, rounded half up); all of its columns.

    Needs unique non-null ids, since decisions are joined back by them; rows with a null id are left out.
    """
    taken = mix(docs, id_col, **options).select(F.col(id_col).alias("mixed_id"), F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int").alias("copies"))
    taken = taken.filter("mixed_id is not null and copies > 0").dropDuplicates(["mixed_id"])
    whole = docs.select(F.col(f"`{id_col}`").alias("mixed_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))
    both = whole.join(taken, "mixed_id").select("whole_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return both.select("whole_row.*")
