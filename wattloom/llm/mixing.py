"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. A document's expected copies grow with its size as size ** TILT, so that long
documents, which hold more connected text, are kept more often than short ones; sizes count by powers of two, and the
copies are scaled so that a source's expected words are its target, MOST copies at most. Whole copies are
certain; the rest is the document's own inclusion probability p for one more copy. Documents of a source
are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), u from a hash of the id,
and taken in that order until the source's remaining words are spent; the document on the edge
gives the words that are still missing. The sample size is fixed in words, reruns agree.

The edge is found without sorting a source: its ranks are cut into LEVELS cells, sums per cell are
pre-aggregated, and only the cell on the edge is looked at more closely, twice. So a source with a third of
all rows is never one task's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DID, THASH, keyed, small, whole_rows, written

#: Weights in source order, share of all words, and most copies of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: How the expected copies of a document grow with its size; 0 makes all documents of a source alike.
TILT = 0.25
#: Cells that the ranks of a source are cut into, per step.
LEVELS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, share: float = SHARE, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources in code-point order, null last. What exceeds a source's ceiling of
    most times its size is shared again by weight among the others, until none is above. That water-filling has a
    closed form: with sources by ceiling per weight, those before the level get their ceiling. One row per
    source meets in one task here, never a row per document.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sizes.select("source", "source_size", weight.alias("weight"), F.sum("source_size").over(every).alias("total"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.col("total") * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("full", F.col("level") >= F.col("ratio"))
    # Once a source isn't full, none after it is, and the first such level holds for all of them.
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary")))
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.greatest(F.lit(0.0), F.least(F.col("cap"), level * F.col("weight"))))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def copies(classes: DataFrame, plan: DataFrame, tilt: float = TILT, most: float = MOST) -> DataFrame:
    """(source, class, rate) from (source, class, words) and (source, target): expected copies of a document of a size class.

    rate = min(most, scale * 2 ** (tilt * class)), with the source's scale such that the classes' words times rates are
    its target: the water-filling of targets() over a source's size classes, at most 64 rows per source.
    """
    weight = F.pow(F.lit(2.0), F.col("class") * tilt)
    rows = classes.join(plan.select(F.col("source").alias("p_source"), "target"), F.col("source").eqNullSafe(F.col("p_source")))
    order = Window.partitionBy("source").orderBy(F.desc("class"))  # the largest weight meets its ceiling first
    full = F.coalesce(F.sum(F.col("words") * most).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("words") * weight).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("scale", F.when(rest > 0, F.greatest(F.lit(0.0), F.col("target") - full) / rest).otherwise(F.lit(0.0)))
    # The first class that its scale doesn't lift to the ceiling sets the scale for itself and all below.
    below = F.when(F.col("scale") * weight < most, F.col("scale"))
    first = F.first(below, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("source", "class", F.when(first.isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), first * weight)).alias("rate"))


def ranks(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, row key, source, size in words, size class (its whole logarithm to base 2), and u in (0, 1)."""
    rows = keyed(docs, text=text, doc_id=doc_id, source=source)
    h = F.xxhash64(F.lit("mix"), DID, THASH)
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(2**53)
    rows = rows.select("doc_id", DID, THASH, F.col("source").cast("string").alias("source"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), u.alias("u"))
    return rows.withColumn("class", F.length(F.bin(F.greatest("size", F.lit(1).cast("long")))) - 1)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document row: doc_id, row key, source, size, source_size, target, taken, nth.

    taken counts words: whole copies times size, plus size if sampled, plus the words still missing on a
    source's edge. A null text has size 0 and takes nothing; null sources form a source of their own. Rows that
    repeat both id and text are each a document, told apart by nth. A source without words has target 0. Ties in rank
    go by key. A text of any length counts whole; extra columns aren't read; an empty table gives an empty one.
    """
    base = ranks(docs, text, source, doc_id).groupBy("doc_id", DID, THASH, "source", "size", "class", "u").agg(F.count("*").alias("rows"))
    base = written(base, "ranks")
    classes = written(base.groupBy("source", "class").agg(F.sum(F.col("size") * F.col("rows")).alias("words")), "classes")
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = written(targets(sizes, **options), "plan")
    rates = copies(classes, plan, most=options.get("most", MOST))
    rates = rates.withColumn("copies", F.floor(F.col("rate") + 1e-12).cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("copies")))
    same = F.col("source").eqNullSafe(F.col("r_source")) & (F.col("class") == F.col("r_class"))
    certain = classes.join(rates.select(F.col("source").alias("r_source"), F.col("class").alias("r_class"), "copies", "p"), same)
    certain = certain.groupBy("source").agg(F.sum(F.col("copies") * F.col("words")).alias("certain"))
    plan = plan.join(certain.select(F.col("source").alias("c_source"), "certain"), F.col("source").eqNullSafe(F.col("c_source")), "left")
    plan = plan.withColumn("rest", F.greatest(F.lit(0).cast("long"), F.round(F.col("target") - F.coalesce("certain", F.lit(0))).cast("long"))).drop("c_source", "certain")
    rates = rates.join(plan.select(F.col("source").alias("r_source"), "source_size", "target", "rest"), F.col("source").eqNullSafe(F.col("r_source"))).drop("r_source")
    # One row per source and size class: the only table that meets all documents.
    rates = written(rates.select(F.col("source").alias("r_source"), F.col("class").alias("r_class"), "copies", "p", "source_size", "target", "rest"), "rates")

    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    # Ranks run from 0 to infinity; rank / (1 + rank) keeps their order and lies between 0 and 1.
    place = F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(F.lit(1.0))
    rows = base.join(small(rates), same).drop("r_source", "r_class").withColumn("place", place)
    fine = F.floor(F.col("place") * (LEVELS * LEVELS)).cast("long")
    rows = written(rows.withColumn("cell", F.least(fine, F.lit(LEVELS * LEVELS - 1))).drop("u"), "placed")

    words = F.col("size") * F.col("rows")
    coarse = F.floor(F.col("cell") / LEVELS).cast("long")
    edge = plan.where("rest > 0").select(F.col("source").alias("edge_source"), F.col("rest").alias("left"))
    for key, within in ((coarse, None), (F.col("cell"), coarse)):
        part = rows if within is None else rows.join(
            edge.select(F.col("edge_source").alias("s"), "from_cell"), F.col("source").eqNullSafe(F.col("s")) & (within == F.col("from_cell"))
        )
        cells = part.groupBy("source", key.alias("k")).agg(F.sum(words).alias("words"))
        sums = F.sum("words").over(Window.partitionBy("source").orderBy("k"))
        cells = cells.withColumn("through", sums).join(edge.select("edge_source", "left"), F.col("source").eqNullSafe(F.col("edge_source")))
        found = cells.where((F.col("through") >= F.col("left")) & (F.col("through") - F.col("words") < F.col("left")))
        edge = written(found.select("edge_source", F.col("k").alias("from_cell"), (F.col("left") - F.col("through") + F.col("words")).alias("left")), "edge")

    # Documents in the one cell on the edge, in rank order; repeated rows stand one after the other.
    tail = rows.join(edge, F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("cell") == F.col("from_cell")))
    each = tail.select("source", DID, THASH, "place", "size", "left", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("nth"))
    through = F.sum("size").over(Window.partitionBy("source").orderBy("place", DID, THASH, "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("through", through).select(
        F.col("source").alias("t_source"), F.col(DID).alias("t_did"), F.col(THASH).alias("t_thash"), F.col("nth").alias("t_nth"),
        F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("left") - F.col("through") + F.col("size"))).alias("extra"),
    )
    out = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    out = out.join(edge.select(F.col("edge_source").alias("s"), "from_cell"), F.col("source").eqNullSafe(F.col("s")), "left")
    hit = F.col("source").eqNullSafe(F.col("t_source")) & (F.col(DID) == F.col("t_did")) & (F.col(THASH) == F.col("t_thash")) & (F.col("nth") == F.col("t_nth"))
    out = out.join(each, hit, "left")
    more = (
        F.when(F.col("rest") == 0, F.lit(0).cast("long"))
        .when(F.col("from_cell").isNull() | (F.col("cell") < F.col("from_cell")), F.col("size"))
        .when(F.col("cell") == F.col("from_cell"), F.coalesce("extra", F.lit(0).cast("long")))
        .otherwise(F.lit(0).cast("long"))
    )
    return out.select("doc_id", DID, THASH, "nth", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + more).alias("taken"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows of the mix, with the columns of docs: whole copies repeat a row; on an edge, a row's text is cut to its words taken.

    Only the text column changes, and only in at most one row per source. A null or empty text has no words and is in no
    mix. A repeated row stands once per copy of all its repeats; columns may have any name; an empty table gives an empty one.
    """
    rows = whole_rows(docs, text, doc_id, source=source).withColumn("source", F.col("source").cast("string"))
    # Repeated rows share a key; their copies are summed and one row stands for all of them.
    amount = mix(docs, text, source, doc_id).groupBy(F.col(DID).alias("t_did"), F.col(THASH).alias("t_thash"), F.col("source").alias("t_source")).agg(
        F.sum("taken").alias("taken"), F.max("size").alias("size")
    )
    one = (F.col(DID) == F.col("t_did")) & (F.col(THASH) == F.col("t_thash")) & F.col("source").eqNullSafe(F.col("t_source"))
    many = rows.join(amount.where("taken > 0"), one).dropDuplicates([DID, THASH, "source"])
    words = F.greatest("size", F.lit(1).cast("long"))
    many = many.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / words).cast("long"))))
    left = F.col("taken") - (F.col("nth") - 1) * F.col("size")
    cut = F.expr(r"regexp_substr(text, concat(r'^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){', cast(taken - (nth - 1) * size as string), '}+'))")
    own = F.col("row").getField
    body = F.when(left >= F.col("size"), own(text)).otherwise(cut)
    return many.select(*[(body if c == text else own(c)).alias(c) for c in docs.columns])
