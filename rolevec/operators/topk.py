"""Top-k motions per (role, level), padding, and per-role vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolevec import defaults


def level_grid(roles: DataFrame, lo: int, hi: int) -> DataFrame:
    """``(role, level)`` for every role and every level of ``lo..hi``
    (an explode per role row, no join)."""
    return roles.select("role", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("level"))


def rank_topk(scaled: DataFrame, k: int = defaults.TOP_K, pad_motion: str = defaults.PAD_MOTION,
              presence: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rank motions of every present (role, level) and fill up to ``k`` slots.

    ``(role, level, [carry], slot, motion, value, is_pad, pad_idx)``: real
    motions by value descending (ties: motion ascending) take the first slots,
    pads fill the rest.  ``scaled`` may hold rows with a NULL motion: they mark
    a level that is present without motions.  ``presence (role, level)`` adds
    further levels to pad (all pads).  Columns in ``carry`` (constant per role,
    e.g. the label) are kept.

    The cut is ``row_number() <= k`` over (role, level): Spark inserts a
    partial group limit before the exchange, so no group ever holds more than
    k rows per map task, however many motions a role has.  The padding is an
    aggregation over those few rows on the same partitioning (no second
    exchange), then array expressions."""
    extra = [F.col(c) for c in carry]
    src = scaled.select("role", "level", "motion", F.col("value").cast("double").alias("value"), *extra)
    if presence is not None:
        src = src.unionByName(presence.select("role", "level", F.lit(None).cast("string").alias("motion"),
                                              F.lit(None).cast("double").alias("value"), *extra))
    w = Window.partitionBy("role", "level").orderBy(
        F.col("motion").isNull().asc(), F.col("value").desc(), F.col("motion").asc())
    cut = src.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.lit(k))
    entry = F.when(F.col("motion").isNotNull(),
                   F.struct(F.col("_rn").alias("r"), F.col("motion").alias("m"), F.col("value").alias("v")))
    top = (cut.groupBy("role", "level")
           .agg(F.sort_array(F.collect_list(entry)).alias("_t"), *[F.max(c).alias(c) for c in carry]))
    pad = F.struct(F.lit(0).alias("r"), F.lit(pad_motion).alias("m"), F.lit(float(defaults.PAD_VALUE)).alias("v"))
    filled = F.concat(F.col("_t"), F.array_repeat(pad, F.lit(k) - F.size("_t")))
    return (top.select("role", "level", *carry, F.size("_t").alias("_n"), F.posexplode(filled).alias("_p", "_e"))
            .select("role", "level", *carry, (F.col("_p") + 1).cast("int").alias("slot"),
                    F.col("_e.m").alias("motion"), F.col("_e.v").alias("value"),
                    (F.col("_p") >= F.col("_n")).alias("is_pad"),
                    # -1: a real motion named like the pad, followed by pads in its slots
                    F.when((F.col("_p") < F.col("_n")) & (F.col("_n") < F.lit(k)) & (F.col("_e.m") == F.lit(pad_motion)), F.lit(-1))
                    .otherwise(F.greatest(F.col("_p") - F.col("_n") + 1, F.lit(0))).cast("int").alias("pad_idx")))


def topk_motions(ranked: DataFrame) -> DataFrame:
    """Real motions only: ``(role, level, slot, motion, value)``."""
    return ranked.where(~F.col("is_pad")).select("role", "level", "slot", "motion", "value")


def topk_padded(ranked: DataFrame) -> DataFrame:
    """Exactly ``k`` slots per (role, level): ``(role, level, slot, motion, value)``."""
    return ranked.select("role", "level", "slot", "motion", "value")


def sparse_cells(ranked: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Unique ``(role, level, motion, value)`` cells of the padded rows (plus
    ``carry`` columns): of equal motions the last slot wins, as in a map built from the
    slots and as in the text parser.  So the pad motion counts once per (role, level),
    also where a real motion has its name."""
    return (ranked.where((~F.col("is_pad") & (F.col("pad_idx") == 0)) | (F.col("pad_idx") == 1))
            .select("role", "level", "motion", "value", *carry))


def unaligned_vectors(padded: DataFrame, labelled_roles: DataFrame | None = None) -> DataFrame:
    """One row per role: ``(role, label, motions, values)`` in (level, slot)
    order.  A row holds levels x k cells, bounded by the parameters.  The
    label comes with the rows (a ``label`` column) or from ``labelled_roles``;
    either way one aggregation per role, no join."""
    rows = padded.select("role", "level", "slot", "motion", "value",
                         (F.col("label") if "label" in padded.columns else F.lit(None).cast("int")).alias("label"))
    if labelled_roles is not None and "label" not in padded.columns:
        rows = rows.unionByName(labelled_roles.select(
            "role", F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("slot"),
            F.lit(None).cast("string").alias("motion"), F.lit(None).cast("double").alias("value"),
            F.col("label").cast("int").alias("label")))
    cell = F.when(F.col("level").isNotNull(), F.struct("level", "slot", "motion", "value"))
    per_role = rows.groupBy("role").agg(F.max("label").alias("label"),
                                        F.sort_array(F.collect_list(cell)).alias("_s"))
    return per_role.where(F.size("_s") > 0).select(
        "role", "label",
        F.transform("_s", lambda s: s["motion"]).alias("motions"),
        F.transform("_s", lambda s: s["value"]).alias("values"))


def densify_dictionary(rows: DataFrame, dictionary: DataFrame, presence: DataFrame | None = None) -> DataFrame:
    """Dense vectors over a motion dictionary (no top-k):
    ``(role, label, features array<double>)`` = levels ascending x dictionary
    positions (repeated motions included), 0.0 where a role lacks the motion.

    ``rows``: ``(role, level, motion, value, label)`` with one row per held
    motion (a NULL motion marks a level present without motions);
    ``dictionary (position, motion)``; ``presence (role, level, label)`` adds levels to
    fill with zeros.  Held motions join their positions (a table the planner broadcasts
    while it is small); one aggregation per role gathers the cells, and the zeros between
    them are written as runs, so a vector costs its width."""
    src = rows.select("role", "level", "motion", "value", "label")
    if presence is not None:
        src = src.unionByName(presence.select("role", "level", F.lit(None).cast("string").alias("motion"),
                                              F.lit(None).cast("double").alias("value"), "label"))
    placed = src.join(dictionary.select("motion", "position"), "motion", "left")
    cell = F.when(F.col("position").isNotNull(), F.struct("level", "position", F.col("value").cast("double").alias("value")))
    per = placed.groupBy("role").agg(F.max("label").alias("label"), F.array_sort(F.collect_set("level")).alias("_levels"),
                                     F.array_sort(F.collect_list(cell)).alias("_c"))
    width = dictionary.agg(F.count(F.lit(1))).scalar()
    # the scalar is projected first: subqueries may not sit inside a lambda
    per = per.select("role", "label", "_levels", "_c", width.cast("int").alias("_w"))
    at = F.transform("_c", lambda c: F.struct(((F.array_position("_levels", c["level"]).cast("int") - 1) * F.col("_w") + c["position"]).alias("p"), c["value"].alias("v")))
    per = per.select("role", "label", at.alias("_c"), (F.size("_levels") * F.col("_w")).alias("_n"))
    c = F.col("_c")
    runs = F.transform(c, lambda e, i: F.concat(F.array_repeat(F.lit(0.0), (e["p"] - F.when(i == 0, F.lit(-1)).otherwise(c[i - 1]["p"]) - 1).cast("int")), F.array(e["v"])))
    tail = F.array_repeat(F.lit(0.0), (F.col("_n") - 1 - F.coalesce(F.try_element_at(c, F.lit(-1))["p"], F.lit(-1))).cast("int"))
    return per.select("role", "label", F.concat(F.flatten(runs), tail).alias("features"))
