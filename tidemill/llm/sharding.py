"""Shards by balanced label propagation, in DataFrame functions only.

Documents that share a link group start in shards dealt by a hash; in each turn a cut group moves as a whole to the shard that
holds most of it among those with room for the rest, or to another with room for all; a group that fits no shard moves in
parts towards the shard that holds most of it. Where no room is left, cut groups exchange parts of equal rows. Documents
move in cells (group, first shard, salt), so a group with a third of all rows is a bounded number of cells.

Large groups settle first, within the quotas; the others then come together within quotas that are twice what is left. What
a shard then holds too much leaves it in the order of groups, and is put, in that order, where there is room: whole
groups again, but for those that stand at a shard's end. Unlinked documents fill the rest, which makes the row counts
exact: law `rows`, counts at most one apart.

Positions (slots) come from bucket counts and a row number within each bucket, never from one global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 8
#: Cells that one group's members in one shard are dealt to: so many, or one for so many rows of a shard.
SALTS, CELL_ROWS = 24, 1 << 20
#: A group is large if it has more than one in this many of a shard's rows: there are fewer than shards * LARGE.
LARGE = 64
#: Steps in which requests for a shard are admitted, and the numbers that are dealt to them.
STEPS, DRAWS = 1024, 1 << 30
#: Cut groups that are numbered together, about, to exchange parts.
SWAPS = 4096
#: Turns without a move after which none is left.
DRY = 2
#: A shard with less room than this part of its quota counts as full for groups that move in parts.
ROOM = 50
#: Rows in a bucket, about, when slots are numbered.
BUCKET_ROWS = 20_000


def _share(name: str, n: int, *cols: Column | str) -> Column:
    """A number below ``n`` by a hash of its own for each name."""
    return F.pmod(F.xxhash64(F.lit(name), *cols), F.lit(n)).cast("int")


def _cells(rows: DataFrame, shards: int) -> DataFrame:
    """Members of groups of two or more: group, first shard, salt, rows."""
    cells = rows.groupBy("grp", "first", "salt").agg(F.count("*").alias("n"))
    per_group = Window.partitionBy("grp")  # at most shards * salts cells each
    return cells.withColumn("size", F.sum("n").over(per_group)).where("size > 1")


def _room(cells: DataFrame, caps: list[int]) -> list[int]:
    used = {r["label"]: r["used"] for r in cells.groupBy("label").agg(F.sum("n").alias("used")).collect()}  # a row per shard
    return [cap - used.get(s, 0) for s, cap in enumerate(caps)]


def _asked(cells: DataFrame, room: list[int], total: int, turn: int) -> DataFrame:
    """Adds target (null: stays) and draw: where each cell wants to go, groups that fit a shard as a whole all to one."""
    shards = len(room)
    room_of = lambda label: F.element_at(F.array(*[F.lit(r).cast("long") for r in room]), label + 1)
    parts = cells.groupBy("grp", "label").agg(F.sum("n").alias("held"), F.first("size").alias("of"))
    alone = F.col("of") * LARGE > F.lit(total) / shards
    # a group that moves cell by cell leaves a shard alone that is all but full, and goes to its next best
    least = F.when(alone, F.greatest(F.lit(1.0), F.lit(total) / shards / ROOM)).otherwise(F.lit(1.0))
    order = F.struct("held", F.xxhash64(F.lit(turn), "grp", "label").alias("t"), "label")
    fits = room_of(F.col("label")) >= F.col("of") - F.col("held")
    best = parts.groupBy("grp").agg(F.max(F.when(fits, order)).alias("whole"), F.max(F.when(room_of(F.col("label")) >= least, order)).alias("part"), F.count("*").alias("spans"), F.first("of").alias("of"), F.min("label").alias("low"))
    # in none of its shards is room for all of it: another shard, if it is cut or its shard holds too much
    free = [s for s, r in enumerate(room) if r > 0]
    other = F.element_at(F.array(*[F.lit(s) for s in free]), F.pmod(F.xxhash64(F.lit(turn), F.lit("other"), "grp"), F.lit(len(free))).cast("int") + 1) if free else F.lit(None).cast("int")
    loose = (F.col("spans") > 1) | (room_of(F.col("low")) < 0)
    best = best.withColumn("to", F.coalesce("whole.label", F.when(loose & (room_of(other) >= F.col("of")), other)))
    best = best.select("grp", "to", F.col("part.held").alias("most"), F.col("part.label").alias("next"))
    joined = cells.join(parts, ["grp", "label"]).join(best, "grp")
    target = F.when(F.col("to").isNotNull(), F.col("to")).when(F.col("most") >= F.col("held"), F.col("next"))
    # groups that move as a whole, and small ones, ask as one; others ask cell by cell
    draw = F.when(F.col("to").isNull() & alone, _share(f"step {turn}", DRAWS, "grp", "first", "salt")).otherwise(_share(f"step {turn}", DRAWS, "grp"))
    return joined.select("grp", "first", "salt", "n", "size", "label", F.when(target != F.col("label"), target).alias("target"), draw.alias("draw"))


def _moved(asked: DataFrame, room: list[int]) -> tuple[DataFrame, int]:
    """The cells after this turn's moves, as many as there is room for, and the rows moved."""
    spark = asked.sparkSession
    wish = {r["target"]: r["n"] for r in asked.where("target is not null").groupBy("target").agg(F.sum("n").alias("n")).collect()}  # a row per shard
    # where more want to go than fit, steps are so short that all of them together hold twice the room
    width = [max(1, int(DRAWS / STEPS * min(1.0, 2 * max(r, 0) / wish.get(s, 1)))) for s, r in enumerate(room)]
    step = F.floor(F.col("draw") / F.element_at(F.array(*[F.lit(w) for w in width]), F.col("target") + 1)).cast("int")
    asked = asked.withColumn("step", step)
    sums = asked.where((F.col("target").isNotNull()) & (F.col("step") <= STEPS)).groupBy("target", "step").agg(F.sum("n").alias("n")).collect()  # at most STEPS + 1 a shard
    left, admitted, moved = list(room), [], 0
    for r in sorted(sums, key=lambda r: (r["target"], r["step"])):
        if r["n"] <= left[r["target"]]:
            left[r["target"]] -= r["n"]
            admitted.append((r["target"], r["step"], True))
            moved += r["n"]
    yes = spark.createDataFrame(admitted, "target int, step int, yes boolean")
    label = F.when(F.col("yes"), F.col("target")).otherwise(F.col("label"))
    return asked.join(F.broadcast(yes), ["target", "step"], "left").select("grp", "first", "salt", "n", "size", label.alias("label")), moved


def _swapped(cells: DataFrame, cut: int, turn: int) -> tuple[DataFrame, int]:
    """Cut groups of two shards exchange parts of equal rows, which needs no room; also the groups that moved."""
    parts = cells.groupBy("grp", "label").agg(F.sum("n").alias("k"))
    part = F.struct("k", F.xxhash64(F.lit(turn), "grp", "label").alias("t"), "label")
    ends = parts.groupBy("grp").agg(F.min(part).alias("a"), F.max(part).alias("b")).where("a.label <> b.label")
    low, high = F.least("a.label", "b.label").alias("low"), F.greatest("a.label", "b.label").alias("high")
    deal = _share(f"deal {turn}", max(1, cut // SWAPS), "grp").alias("deal")
    ends = ends.select("grp", low, high, F.col("a.k").alias("k"), (F.col("a.k") == F.col("b.k")).alias("either"), (F.col("a.label") < F.col("b.label")).alias("up"), deal)
    same = ["low", "high", "k", "deal"]
    turns = F.row_number().over(Window.partitionBy(*same, "either").orderBy("grp")) % 2 == 0
    ends = ends.withColumn("turns", turns).withColumn("up", F.when(F.col("either"), F.col("turns")).otherwise(F.col("up")))
    ends = ends.withColumn("r", F.row_number().over(Window.partitionBy(*same, "up").orderBy("grp"))).withColumn("mine", F.count("*").over(Window.partitionBy(*same, "up"))).withColumn("all", F.count("*").over(Window.partitionBy(*same)))
    source, goal = F.when(F.col("up"), F.col("low")).otherwise(F.col("high")), F.when(F.col("up"), F.col("high")).otherwise(F.col("low"))
    swaps = common.written(ends.where(F.col("r") <= F.least(F.col("mine"), F.col("all") - F.col("mine"))).select("grp", source.alias("label"), goal.alias("goal")), "swaps")
    n = swaps.count()
    return cells.join(swaps, ["grp", "label"], "left").select("grp", "first", "salt", "n", "size", F.coalesce("goal", "label").alias("label")), n


def _settle(cells: DataFrame, caps: list[int], total: int) -> DataFrame:
    """Turns until neither a move nor an exchange is left; each brings parts of a group together or empties a shard that
    holds too much, so turns end. A turn's draws are its own: DRY turns in a row must find nothing."""
    turn = dry = 0
    while dry < DRY:
        room = _room(cells, caps)
        cut = cells.groupBy("grp").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").count()
        if not cut and min(room) >= 0:
            break
        asked = common.written(_asked(cells, room, total, turn), "asked")
        after, moved = _moved(asked, room)
        if not moved:
            after, moved = _swapped(cells, cut, turn)
        dry = 0 if moved else dry + 1
        if moved:
            after = common.written(after, "cells")
            common.discard(cells)
            cells = after
        common.discard(asked)
        turn += 1
    return cells


def _numbered(rows: DataFrame, pool: Column) -> DataFrame:
    """Adds pos: gapless from 0 within each pool; large groups first, then the others, then unlinked rows, groups side by side;
    and last: the pos of its group's last row."""
    rows = rows.withColumn("pool", pool)
    sizes = rows.groupBy("pool", "bucket").agg(F.count("*").alias("k"))
    before = Window.partitionBy("pool").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("pool", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("pool", "bucket").orderBy("grp", "salt", "row")
    rows = rows.withColumn("r", F.row_number().over(within)).withColumn("end", F.max("r").over(Window.partitionBy("pool", "bucket", "grp")))
    rows = rows.join(offsets, ["pool", "bucket"]).withColumns({"pos": F.col("offset") + F.col("r") - 1, "last": F.col("offset") + F.col("end") - 1})
    return rows.drop("r", "end", "offset", "pool")


def shard(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds shard and slot to rows of (id, grp, size, crc); grp (a string, null for none) names the link group.

    Equal groups come together as far as equal row counts let them. Null ids and repeated rows are rows like any
    other; an empty table gives no rows; fewer rows than shards leave shards empty.
    """
    total = rows.count()
    salts = max(SALTS, total // shards // CELL_ROWS)
    # a number of its own for each row, so that repeated rows are dealt like any others; it is drawn once, in the written table
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = common.written(rows.withColumns({"salt": _share("salt", salts, "row"), "first": _share("first", shards, "row")}), "rows")
    caps = [total // shards + (s < total % shards) for s in range(shards)]
    cells = common.written(_cells(rows.where("grp is not null"), shards).withColumn("label", F.col("first")), "cells")
    large = F.col("size") * LARGE > F.lit(total) / shards
    big = _settle(common.written(cells.where(large), "large"), caps, total)
    spare = [max(0, r) for r in _room(big, caps)]
    small = _settle(common.written(cells.where(~large), "small"), [2 * r for r in spare], total)
    linked = big.unionByName(small).select("grp", "first", "salt", "label", large.alias("large"))
    placed = rows.join(linked, ["grp", "first", "salt"], "left")
    buckets = max(4, total // shards // BUCKET_ROWS)
    # large groups in a bucket for each salt; they come first, so that the others make room for them
    at_large = F.shiftleft(_share("large", 1 << 30, "grp").cast("long"), 24) + F.col("salt")
    among = lambda base, n, *cols: F.lit(base).cast("long") + F.pmod(F.xxhash64(F.lit("bucket"), *cols), F.lit(n))
    bucket = F.when(F.col("label").isNull(), among(1 << 61, buckets * shards, "row")).when(F.col("large"), at_large).otherwise(among(1 << 60, buckets, "grp"))
    # pools: the linked rows of each shard, then all others
    pool = F.coalesce(F.col("label"), F.lit(shards))
    placed = common.written(_numbered(placed.withColumn("bucket", bucket), pool), "placed")
    cap = F.element_at(F.array(*[F.lit(c).cast("long") for c in [*caps, 0]]), pool + 1)
    # a large group is cut where its shard ends; others leave it as a whole
    over = F.col("label").isNotNull() & (F.when(F.col("large"), F.col("pos")).otherwise(F.col("last")) >= cap)
    counts = {r["label"]: r for r in placed.where("label is not null").groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(over, 1)).alias("over")).collect()}
    have = [counts[s]["n"] - counts[s]["over"] if s in counts else 0 for s in range(shards)]
    free = [caps[s] - have[s] for s in range(shards)]
    settled = placed.where(F.col("label").isNotNull() & ~over).select("*", F.col("label").alias("shard"), F.col("pos").alias("slot"))
    rest = placed.where(F.col("label").isNull() | over)
    if any(r["over"] for r in counts.values()):  # what shards hold too much comes before unlinked rows
        rest = _numbered(rest.drop("pos", "last"), F.lit(0))
    shard_of, slot_of, at = F.lit(0), F.lit(0).cast("long"), 0
    for s in sorted(range(shards), key=lambda s: -free[s]):  # so that few groups meet an end
        here = (F.col("pos") >= at) & (F.col("pos") < at + free[s])
        at += free[s]
        shard_of = F.when(here, s).otherwise(shard_of)
        slot_of = F.when(here, F.col("pos") - (at - free[s]) + have[s]).otherwise(slot_of)
    return settled.unionByName(rest.select("*", shard_of.cast("int").alias("shard"), slot_of.alias("slot"))).select("id", "grp", "size", "crc", "shard", "slot")


def equal_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows for ``shard`` whose groups are equal texts; null texts are equal to each other and not to empty ones."""
    rows = common.pick(df, id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    group = F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5("text"))
    return rows.select("id", group.alias("grp"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, equal texts together as far as the row counts let them."""
    found = shard(equal_texts(common.table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
