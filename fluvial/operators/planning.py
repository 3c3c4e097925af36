"""Profiles of documents, plans of points, batches, coverage and style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.functions.text import language, letters_only
from fluvial.scans import along
from fluvial.staging import BROADCAST_KEYS, materialize, number_within

# Characters of a point, points of a document, points of a plan, batches of a run.
POINT_CHARS, MOST_POINTS, PLAN_POINTS, MOST_BATCHES = 800, 96, 96, 3


def analyze(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: counts, estimated points and language in one aggregation. Blank blocks count as blocks alone."""
    n = F.length("text")
    full = F.col("text").rlike(r"(?U)\S")
    cjk, latin = (F.sum(F.when(full, n - F.length(F.regexp_replace("text", p, ""))).otherwise(0)) for p in (r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+", "[A-Za-z]+"))
    return blocks.groupBy(key).agg(
        F.count("*").alias("block_count"),
        F.sum(F.when(full, n).otherwise(0)).cast("long").alias("characters"),
        F.count_if(full & (F.col("kind") == "code")).alias("code_blocks"),
        F.least(F.lit(MOST_POINTS), F.sum(F.when(full, F.greatest(F.lit(1), F.ceil(n / POINT_CHARS))).otherwise(0)).cast("long")).alias("estimated_points"),
        language(cjk, latin).alias("language"),
    )


def kinds(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks of each kind of each document."""
    return blocks.groupBy(key, "kind").agg(F.count("*").alias("n"))


def chunk_title(text: Column, kinds: Column | None = None) -> Column:
    """First line that is neither blank nor a heading, the second one where a table is among the kinds; without list marks, cut at 240 characters."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("# "))
    first = F.get(lines, 0) if kinds is None else F.when(F.array_contains(kinds, "table") & (F.size(lines) > 1), F.get(lines, 1)).otherwise(F.get(lines, 0))
    return F.substring(F.trim(F.regexp_replace(F.coalesce(first, F.lit("")), r"^[-*+ ]+", "")), 1, 240)


def round_robin(chunks: DataFrame, limit: int = PLAN_POINTS) -> DataFrame:
    """Points from chunks (section, chunk_ord, title), a chunk of every section in turn: section, chunk_ord, title, priority, point_ord.

    Sections come in the order of their first chunks. Blank titles and those that an earlier point has are left out;
    the first point of a section is of high priority. Chunks are numbered by ranges, so a section may hold most of them;
    the rest is a top-k.
    """
    order = chunks.groupBy("section").agg(F.min("chunk_ord").alias("section_ord"))
    rows = number_within(chunks.select("section", "chunk_ord", "title"), "section", ["chunk_ord"], "turn")
    rows = rows.join(F.broadcast(order) if order.count() <= BROADCAST_KEYS else order, "section").withColumn("key", letters_only(F.col("title"))).filter("key <> ''")
    first = rows.groupBy("key").agg(F.min_by(F.struct("section", "chunk_ord", "title", "turn", "section_ord"), F.struct("turn", "section_ord")).alias("p")).select("p.*")
    top = first.orderBy("turn", "section_ord").limit(limit)
    high = F.row_number().over(Window.partitionBy("section").orderBy("turn")) == 1
    place = F.row_number().over(Window.orderBy("turn", "section_ord")) - 1  # `limit` rows
    return top.select("section", "chunk_ord", "title", F.when(high, "high").otherwise("medium").alias("priority"), place.alias("point_ord"))


def batches(chunks: DataFrame, cards: int, most: int = MOST_BATCHES, key: str = "run") -> DataFrame:
    """Add batch (from 0, near-equal runs of chunk_ord, at most `most` a run) and quota, the batch's share of `cards`."""
    n = F.count("*").over(Window.partitionBy(key))
    w = Window.partitionBy(key).orderBy("chunk_ord")
    count = F.least(F.lit(most), n)
    place = F.row_number().over(w) - 1
    large = (n % count) * (F.floor(n / count) + 1)
    size = F.floor(n / count)
    batch = F.when(place < large, F.floor(place / (size + 1))).otherwise(n % count + F.floor((place - large) / size))
    out = chunks.withColumn("batch", batch.cast("int")).withColumn("_count", count)
    quota = F.floor(F.lit(cards) / F.col("_count")) + (F.col("batch") < F.lit(cards) % F.col("_count")).cast("int")
    return out.withColumn("quota", quota.cast("int")).drop("_count")


def coverage(points: DataFrame, cards: DataFrame) -> DataFrame:
    """Per point (point_id, section, priority): cards, whether it is missing (high priority, no card), over-covered (more than max(2, twice the mean))."""
    per = cards.groupBy("point_id").agg(F.count("*").alias("cards"))
    rows = points.join(per, "point_id", "left").withColumn("cards", F.coalesce("cards", F.lit(0)))
    mean = rows.agg(F.avg("cards").alias("mean"))  # one row
    rows = rows.crossJoin(F.broadcast(mean))
    return rows.select("point_id", "section", "priority", "cards", ((F.col("priority") == "high") & (F.col("cards") == 0)).alias("missing"), (F.col("cards") > F.greatest(F.lit(2.0), 2 * F.col("mean"))).alias("over_covered"))


def style(cards: DataFrame, key: str) -> DataFrame:
    """Lengths of fronts and backs and the share of question fronts (4 places) per deck."""
    f, b = F.length("front"), F.length("back")
    return cards.groupBy(key).agg(
        F.count("*").alias("cards"), F.min(f).alias("front_min"), F.max(f).alias("front_max"), F.min(b).alias("back_min"), F.max(b).alias("back_max"),
        F.round(F.count_if(F.col("front").contains("?")) / F.count("*"), 4).alias("question_ratio"),
    )


def evidence(points: DataFrame, chunks: DataFrame, most: int = 12_000) -> DataFrame:
    """(point_id, chunks, missing, text): the texts of each point's chunk_ids in their order, by lines, cut; missing ones are counted.

    Only chunks that begin within the first `most` characters of their point, or right behind them, come together, so a point may name any number.
    """
    text = chunks.select("chunk_id", F.substring("text", 1, most).alias("text"), F.length("text").alias("n"))
    refs = points.select(F.struct("point_id").alias("_key"), F.posexplode_outer("chunk_ids").alias("ord", "chunk_id")).join(text, "chunk_id", "left")
    refs = materialize(refs, "evidence")
    counts = refs.groupBy("_key").agg(F.count("n").cast("int").alias("chunks"), F.count_if(F.col("chunk_id").isNotNull() & F.col("n").isNull()).alias("missing"))
    ends = along(refs.filter("n is not null"), ["_key"], "ord", sums={"until": F.col("n") + 1})
    first = ends.filter(F.col("until") - F.col("n") - 1 <= most).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("own"))
    cut = F.substring(F.array_join(F.transform("own", lambda x: x["text"]), "\n"), 1, most)
    return counts.join(first, "_key", "left").select("_key.point_id", "chunks", "missing", F.coalesce(cut, F.lit("")).alias("text"))


# The upper bounds of size classes.
SIZE_CLASSES = (32, 64, 128)


def size_classes(rows: DataFrame, size: Column, bounds: tuple[int, ...] = SIZE_CLASSES) -> DataFrame:
    """(class, n): rows of each size class, classes without rows too."""
    names = [f"{low + 1 if low else 0}-{high}" for low, high in zip((0, *bounds), bounds, strict=False)] + [f"{bounds[-1] + 1}+"]
    of = F.lit(names[-1])
    for name, high in reversed(list(zip(names, bounds, strict=False))):
        of = F.when(size <= high, name).otherwise(of)
    counts = rows.groupBy(of.alias("class")).agg(F.count("*").alias("n"))
    classes = rows.sparkSession.createDataFrame([(x,) for x in names], "class string")
    return classes.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_tags(tags: DataFrame, k: int = 16) -> DataFrame:
    """The k most frequent tags; of equal counts the one seen first."""
    return tags.groupBy("tag").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord")).orderBy(F.desc("n"), "first_ord").limit(k)


def sessions(rows: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """(key, session, start, end, n): rows of a key that follow each other within the gap, as captions are merged."""
    w = Window.partitionBy(key).orderBy(ts)
    new = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) > int(gap_seconds * 1_000_000)
    marked = rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    numbered = marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key with the highest version: late results of older requests go."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")
