"""The four batch jobs of the method, end to end on files.

* ``seq2vec``   level JSON + known-case ids -> unaligned top-k vectors (text)
* ``dimred``    unaligned vectors -> kept columns + reduced vectors
* ``pack``      ``dimred`` + two-round clustering -> report and checklist
* ``secondary`` reduced vectors -> sweep report over k and rounds

Outputs keep their partitions unless ``single_file`` is set; run folders are
stamped ``MMdd-HHmm`` where the original stamped them.  With ``registry`` a job also enters its
run, under that stamp, with its parameters and result tables (``rolevec.sinks.registry``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolevec import defaults
from rolevec.operators.counts import explode_sequences
from rolevec.operators.reduce import to_vector
from rolevec.operators.topk import densify_dictionary
from rolevec.plans.dimred import Reduction, reduce_dimensions
from rolevec.plans.sweep import sweep
from rolevec.plans.two_round import two_round_clustering
from rolevec.plans.vectorize import vectorize
from rolevec.session import checkpointed, stage_bucketed, stage_table, staging
from rolevec.sinks.registry import record_run
from rolevec.sinks.text import format_dense, format_kept, format_unaligned, report_lines, sweep_lines, write_lines, write_table
from rolevec.sources.levels import read_level_json, read_level_json_quarantined
from rolevec.sources.lists import read_id_list, read_motion_dictionary
from rolevec.sources.vectors import explode_cells, parse_reduced, parse_unaligned_rows, read_lines


def run_stamp(spark: SparkSession) -> str:
    return spark.range(1).select(F.date_format(F.current_timestamp(), defaults.RUN_STAMP_FORMAT)).first()[0]


def seq2vec(spark: SparkSession, levels_path: str, positives_path: str, out_path: str,
            lo: int = defaults.LEVEL_SPAN[0], hi: int = defaults.LEVEL_SPAN[1], k: int = defaults.TOP_K,
            expand: bool = False, dictionary_path: str | None = None, single_file: bool = False,
            keep_below: bool = False, rejected_path: str | None = None) -> str:
    """Write ``out_path/events``: unaligned lines (or, with a motion
    dictionary, dense aligned lines without the top-k cut), and the top-k they were
    written with beside them (``out_path/events_top``).

    A broken level record fails the job, unless ``rejected_path`` names a folder for such lines."""
    target = f"{out_path.rstrip('/')}/events"
    with staging(spark):
        records = (read_level_json_quarantined(spark, levels_path, rejected_path, expand)[0] if rejected_path
                   else read_level_json(spark, levels_path))
        rows = explode_sequences(records, expand=expand)
        v = vectorize(rows, read_id_list(spark, positives_path), lo, hi, k, keep_below=keep_below)
        if dictionary_path:
            dictionary = stage_table(read_motion_dictionary(spark, dictionary_path), "dictionary")
            dense = densify_dictionary(v.marked, dictionary, presence=v.presence if keep_below else None)
            lines = format_dense(dense, id_col="role")
        else:
            lines = format_unaligned(v.unaligned)
            write_lines(spark.range(1).select(F.lit(str(k)).alias("line")), f"{target}_top", single_file=True)
        write_lines(lines, target, single_file=single_file)
    return target


def stored_top(spark: SparkSession, unaligned_path: str) -> int | None:
    """The top-k stored beside unaligned vectors, if any."""
    try:
        row = spark.read.text(f"{unaligned_path.rstrip('/')}_top").first()
    except AnalysisException:
        return None
    return int(row["value"]) if row else None


def _cells_from_text(spark: SparkSession, unaligned_path: str, top: int | None) -> tuple[DataFrame, DataFrame, int]:
    stored = stored_top(spark, unaligned_path)
    if top is not None and stored is not None and top != stored:
        raise ValueError(f"the vectors were written with top={stored}, not {top}")
    top = top if top is not None else stored if stored is not None else defaults.TOP_K
    lines = read_lines(spark, unaligned_path)
    # parsed once: the cells, the role list (one line per role) and the shape read it
    per_line, _ = stage_bucketed(parse_unaligned_rows(lines, top), "parsed", "id")
    shape = per_line.agg(F.min("n_levels").alias("lo"), F.max("n_levels").alias("hi")).first()
    if shape["lo"] != shape["hi"]:
        raise ValueError(f"ragged vector rows: {shape['lo']} to {shape['hi']} levels")
    n_levels = shape["hi"] or 0
    cells = explode_cells(per_line).select("id", "label", F.col("c.level_pos").alias("level"), "c.motion", "c.value")
    roles = per_line.select("id", "label")
    return cells, roles, int(n_levels)


def _write_reduction(red: Reduction, kept_path: str, vecs_path: str, single_file: bool) -> None:
    write_table(red.kept, kept_path)
    write_lines(format_kept(red.kept, red.lo), f"{kept_path}_text", single_file=True)
    write_lines(format_dense(red.vectors), vecs_path, single_file=single_file)


def dimred(spark: SparkSession, unaligned_path: str, out_base: str, column_k: int = defaults.COLUMN_K,
           kept: int = defaults.KEPT_PER_LEVEL, top: int | None = None, order: str = "name",
           single_file: bool = False, registry: str | None = None) -> str:
    """Write ``out_base/<stamp>/redevents`` (kept columns) and
    ``out_base/<stamp>/redvecs`` (reduced vectors); returns ``out_base/<stamp>``.

    ``top`` defaults to the value stored beside the vectors; another one raises."""
    stamp = run_stamp(spark)
    base = f"{out_base.rstrip('/')}/{stamp}"
    with staging(spark):
        cells, roles, n_levels = _cells_from_text(spark, unaligned_path, top)
        red = reduce_dimensions(cells, 0, n_levels, column_k, kept, order, roles=roles)
        _write_reduction(red, f"{base}/redevents", f"{base}/redvecs", single_file)
        if registry:
            record_run(spark, registry, stamp, "dimred", {"input": unaligned_path, "column_k": column_k, "kept": kept, "order": order},
                       {"kept_columns": red.kept})
    return base


def pack(spark: SparkSession, unaligned_path: str, out_base: str, model: str = "bkm", k: int = 6,
         top: int | None = None, single_file: bool = False, registry: str | None = None) -> str:
    """Reduce with the fixed defaults, then cluster twice.  Writes ``events`` (kept
    columns), ``vecs``, ``<model>/eva`` and ``<model>/checklist``; returns ``out_base/<model>``."""
    if model not in defaults.MODELS:
        raise ValueError(f"model must be one of {defaults.MODELS}, got {model!r}")
    if k <= 0:
        raise ValueError(f"number of clusters must be positive, got {k}")
    base = out_base.rstrip("/")
    with staging(spark):
        cells, roles, n_levels = _cells_from_text(spark, unaligned_path, top)
        red = reduce_dimensions(cells, 0, n_levels, defaults.COLUMN_K, defaults.KEPT_PER_LEVEL, roles=roles)
        _write_reduction(red, f"{base}/events", f"{base}/vecs", single_file)
        points = checkpointed(red.vectors.select("id", "label", to_vector("features").alias("features")))
        rounds = two_round_clustering(points, model, k)
        write_lines(report_lines(rounds.summary1, rounds.summary2, rounds.report).orderBy("section", "cluster"),
                    f"{base}/{model}/eva", single_file=True)
        rounds.checklist.write.csv(f"{base}/{model}/checklist")
        if registry:
            record_run(spark, registry, run_stamp(spark), "pack", {"input": unaligned_path, "model": model, "k": k},
                       {"evaluation": rounds.report, "checklist": rounds.checklist})
    return f"{base}/{model}"


def secondary(spark: SparkSession, reduced_path: str, k_lo: int, k_hi: int, model: str, rounds: int,
              out_base: str, parallelism: int = 4, with_assignments: bool = False,
              registry: str | None = None) -> DataFrame:
    """Sweep report written to ``out_base/<stamp>/report``; with
    ``with_assignments`` also every fit's rows under ``out_base/<stamp>/res``."""
    vecs = parse_reduced(read_lines(spark, reduced_path))
    points = checkpointed(vecs.select("id", "label", to_vector("features").alias("features")))
    stamp = run_stamp(spark)
    base = f"{out_base.rstrip('/')}/{stamp}"
    report = sweep(points, model, k_lo, k_hi, rounds, parallelism=parallelism,
                   assignments_path=f"{base}/res" if with_assignments else None)  # a few collected rows
    write_lines(sweep_lines(report).orderBy("k", "round", "stage", "cluster"), f"{base}/report", single_file=True)
    if registry:
        record_run(spark, registry, stamp, "secondary", {"input": reduced_path, "k_lo": k_lo, "k_hi": k_hi, "model": model, "rounds": rounds},
                   {"sweep": report})
    return report

