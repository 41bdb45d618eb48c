"""DuckDB SQL for every registered query (the correctness oracle).

The SQL restates each query's definition directly -- cross joins and pairwise
segment tables are fine here, the oracle only runs on the small check data.
Tables are the pre-registered views ``events`` and ``embeddings``.
"""

from __future__ import annotations

from rolevec.catalog import params as P
from rolevec.sources.events import LEHMER_FACTOR, LEHMER_MODULUS, MAX_TOKENS
from rolevec.sources.levels import REJECT_REASONS


def ev_cte(days: int = P.DAYS, parity: bool = True, renamed: str | None = None) -> str:
    k = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
    motion = f"event_type || '_' || CAST({k} % 2 AS VARCHAR)" if parity else "event_type"
    if renamed:
        motion = f"CASE WHEN {motion} = '{renamed}' THEN '{P.PAD}' ELSE {motion} END"
    return f"""ev AS (
  SELECT event_id, ts, event_type, {k} AS k, CAST(user_id AS BIGINT) AS role,
         CAST(floor(date_diff('day', DATE '{P.EPOCH}', CAST(ts AS DATE)) / {float(days)}) AS INTEGER) + {P.FIRST_LEVEL} AS level,
         {motion} AS motion
  FROM events)"""


def stage1_ctes(lo: int = P.LO, hi: int = P.HI, k: int = P.TOP, days: int = P.DAYS, parity: bool = True,
                keep_below: bool = False, renamed: str | None = None) -> str:
    """CTEs ev, cnt, cc (covered counts), nr, rng, sc, tk, grid, pad, lab, cells."""
    keep = f"level <= {hi}" if keep_below else f"level BETWEEN {lo} AND {hi}"
    levels = (f"(SELECT unnest(range(least({lo}, (SELECT min(level) FROM cc)), {hi + 1})) AS level)"
              if keep_below else f"range({lo}, {hi + 1}) l(level)")
    return f"""WITH {ev_cte(days, parity, renamed)},
cnt AS (SELECT role, level, motion, count(*) AS cnt FROM ev WHERE {keep}
        GROUP BY role, level, motion),
cov AS (SELECT role FROM (SELECT DISTINCT role, level FROM cnt WHERE level BETWEEN {lo} AND {hi})
        GROUP BY role HAVING count(*) = {hi - lo + 1}),
cc AS (SELECT * FROM cnt WHERE role IN (SELECT role FROM cov)),
nr AS (SELECT count(DISTINCT role) AS n_roles FROM cc),
rng AS (SELECT level, motion, CAST(max(cnt) AS BIGINT) AS mx,
               CAST(CASE WHEN count(*) = (SELECT n_roles FROM nr) THEN min(cnt) ELSE 0 END AS BIGINT) AS mn
        FROM cc GROUP BY level, motion),
sc AS (SELECT role, level, motion,
              CAST(CASE WHEN mx = mn THEN 0.0
                        ELSE 100.0 * (CAST(cnt - mn AS DOUBLE) / CAST(mx - mn AS DOUBLE)) END AS DOUBLE) AS value
       FROM cc JOIN rng USING (level, motion)),
tk AS (SELECT role, level, motion, value,
              CAST(row_number() OVER (PARTITION BY role, level ORDER BY value DESC, motion) AS INTEGER) AS slot
       FROM sc QUALIFY slot <= {k}),
grid AS (SELECT r.role, CAST(level AS INTEGER) AS level, CAST(s.slot AS INTEGER) AS slot
         FROM (SELECT DISTINCT role FROM cc) r CROSS JOIN {levels}
         CROSS JOIN range(1, {k + 1}) s(slot)),
pad AS (SELECT g.role, g.level, g.slot, coalesce(t.motion, '{P.PAD}') AS motion,
               CAST(coalesce(t.value, 0.0) AS DOUBLE) AS value, t.motion IS NULL AS is_pad
        FROM grid g LEFT JOIN tk t ON t.role = g.role AND t.level = g.level AND t.slot = g.slot),
lab AS (SELECT DISTINCT role, CAST(CASE WHEN role % {P.POSITIVE_EVERY} = 0 THEN 1 ELSE 0 END AS INTEGER) AS label
        FROM cc),
cells AS (SELECT p.role AS id, l.label, p.level, p.motion, p.value FROM pad p JOIN lab l USING (role)
          QUALIFY p.slot = max(p.slot) OVER (PARTITION BY p.role, p.level, p.motion))"""


def stage2_ctes(column_k: int = P.COLUMN_K, n: int = P.KEPT, lo: int = P.LO, hi: int = P.HI, **kw) -> str:
    """Adds un, nid, hist, pts, nd, segc, d1..dk, cost, kept, red, feat."""
    width = (hi - lo + 1) * n
    layers = []
    for m in range(2, column_k + 1):
        layers.append(
            f"d{m} AS (SELECT s.level, s.motion, s.i, min(d.v + s.c) AS v FROM d{m - 1} d JOIN segc s "
            f"ON s.level = d.level AND s.motion = d.motion AND s.j = d.i GROUP BY s.level, s.motion, s.i)")
    dp = ",\n".join(layers)
    dp = (",\n" + dp) if dp else ""
    return stage1_ctes(lo=lo, hi=hi, **kw) + f""",
un AS (SELECT DISTINCT level, motion FROM cells),
nid AS (SELECT count(DISTINCT id) AS n FROM cells),
held AS (SELECT level, motion, value, count(*) AS w FROM cells GROUP BY level, motion, value),
hist AS (SELECT level, motion, value, CAST(sum(w) AS BIGINT) AS w FROM (
           SELECT level, motion, value, w FROM held
           UNION ALL
           SELECT level, motion, 0.0, (SELECT n FROM nid) - sum(w) FROM held GROUP BY level, motion
           HAVING (SELECT n FROM nid) - sum(w) > 0)
         GROUP BY level, motion, value),
pts AS (SELECT level, motion, value, w, row_number() OVER (PARTITION BY level, motion ORDER BY value) AS i
        FROM hist),
nd AS (SELECT level, motion, count(*) AS d FROM pts GROUP BY level, motion),
segs AS (SELECT a.level, a.motion, a.i AS s, b.i AS e FROM pts a JOIN pts b
         ON a.level = b.level AND a.motion = b.motion AND a.i <= b.i),
segm AS (SELECT g.level, g.motion, g.s, g.e, sum(p.w * p.value) / sum(p.w) AS mu FROM segs g JOIN pts p
         ON p.level = g.level AND p.motion = g.motion AND p.i BETWEEN g.s AND g.e
         GROUP BY g.level, g.motion, g.s, g.e),
segc AS (SELECT g.level, g.motion, g.s - 1 AS j, g.e AS i, sum(p.w * (p.value - g.mu) * (p.value - g.mu)) AS c
         FROM segm g JOIN pts p ON p.level = g.level AND p.motion = g.motion AND p.i BETWEEN g.s AND g.e
         GROUP BY g.level, g.motion, g.s, g.e),
d1 AS (SELECT level, motion, i, c AS v FROM segc WHERE j = 0){dp},
cost AS (SELECT nd.level, nd.motion, nd.d AS n_distinct,
                CAST(CASE WHEN nd.d <= {column_k} THEN 0.0 ELSE dk.v END AS DOUBLE) AS cost
         FROM nd LEFT JOIN d{column_k} dk ON dk.level = nd.level AND dk.motion = nd.motion AND dk.i = nd.d),
kept AS (SELECT level, CAST(row_number() OVER (PARTITION BY level ORDER BY motion) AS INTEGER) AS rank, motion, cost
         FROM cost WHERE n_distinct > {column_k} QUALIFY rank <= {n}),
red AS (SELECT c.id, CAST((c.level - {lo}) * {n} + k.rank - 1 AS INTEGER) AS pos, c.value
        FROM cells c JOIN kept k ON k.level = c.level AND k.motion = c.motion),
ids AS (SELECT DISTINCT id, label FROM cells),
feat AS (SELECT i.id, i.label, CAST(list(coalesce(r.value, 0.0) ORDER BY g.p) AS DOUBLE[]) AS features
         FROM ids i CROSS JOIN range(0, {width}) g(p)
         LEFT JOIN red r ON r.id = i.id AND r.pos = g.p
         GROUP BY i.id, i.label)"""


def _lines_of(features: str = "features") -> str:
    return f"array_to_string(list_transform({features}, lambda x: CAST(x AS VARCHAR)), ',')"


def _params_sql() -> str:
    return ("CAST(k AS VARCHAR) || ',,' || CAST(k % 10 AS VARCHAR) || ',,' || CAST(k // 10 AS VARCHAR)"
            " || ',,' || event_type")


def _expand_sql() -> str:
    parts = ["CAST(k AS VARCHAR)", "CAST(k % 10 AS VARCHAR)", "CAST(k // 10 AS VARCHAR)", "event_type"]
    whens = " ".join(f"WHEN '{m}' THEN {parts[i]}" for m, i in P.EXPAND_MAP.items())
    return f"(CASE motion {whens} ELSE '' END) || motion"


def _levels_sql(max_tokens: int = MAX_TOKENS) -> str:
    return f"""WITH {ev_cte()},
tok AS (SELECT role, level, ts, event_id, CAST(ts AS DATE) AS d,
               CAST(event_id AS VARCHAR) || '@' || motion || '@' || {_params_sql()} AS token FROM ev),
sized AS (SELECT *, count(*) OVER (PARTITION BY role, level, d) AS n FROM tok),
parted AS (SELECT *, CASE WHEN n > {max_tokens} THEN (((event_id % {LEHMER_MODULUS}) * {LEHMER_FACTOR}) % {LEHMER_MODULUS} * CAST(ceil(n / {float(max_tokens)}) AS BIGINT)) // {LEHMER_MODULUS} ELSE 0 END AS part FROM sized)
SELECT CAST(role AS VARCHAR) AS role, CAST(level AS VARCHAR) AS mark, list(token ORDER BY ts, event_id) AS seqs
FROM parted GROUP BY role, level, d, part"""


def _broken_sql() -> str:
    """Level records with their written line and the reason they are rejected for."""
    sound = "to_json({'role': role, 'mark': mark, 'seqs': seqs})::VARCHAR"
    return f"""WITH recs AS ({_levels_sql()}), judged AS (
  SELECT role, mark, seqs, CASE CAST(role AS BIGINT) % {P.BROKEN_OF}
    WHEN 1 THEN left({sound}, length({sound}) - 1)
    WHEN 2 THEN to_json({{'mark': mark, 'seqs': seqs}})::VARCHAR
    WHEN 3 THEN to_json({{'role': role, 'mark': 'L' || mark, 'seqs': seqs}})::VARCHAR
    WHEN 4 THEN to_json({{'role': role, 'mark': mark}})::VARCHAR
    WHEN 5 THEN to_json({{'role': role, 'mark': mark, 'seqs': list_append(seqs, 'x')}})::VARCHAR
    WHEN 6 THEN to_json({{'role': role, 'mark': mark, 'seqs': 'none'}})::VARCHAR
    ELSE {sound} END AS line,
  CASE CAST(role AS BIGINT) % {P.BROKEN_OF} WHEN 1 THEN 'not_a_record' WHEN 2 THEN 'no_role' WHEN 3 THEN 'level_not_a_number'
    WHEN 4 THEN 'no_seqs' WHEN 5 THEN 'token_without_motion' WHEN 6 THEN 'not_a_record' END AS reason FROM recs)"""


def _runs_sql(query: str) -> str:
    """The registered runs as (run_id, top): the last of every id."""
    last = dict(P.RUNS)
    rows = ", ".join(f"('{run}', {k})" for run, k in last.items())
    return stage1_ctes() + f",\nruns(run_id, top) AS (VALUES {rows})\n{query}"


def _unaligned_lines_cte() -> str:
    return """fu AS (SELECT p.role AS id,
               string_agg(p.motion || ',' || CAST(p.value AS VARCHAR), ',' ORDER BY p.level, p.slot)
               || ',' || CAST(p.role * 10 + l.label AS VARCHAR) AS line
        FROM pad p JOIN lab l USING (role) GROUP BY p.role, l.label)"""


def _dense_cte() -> str:
    return """names AS (SELECT DISTINCT motion FROM ev),
dct AS (SELECT motion, row_number() OVER (ORDER BY motion DESC) AS position FROM names
        UNION ALL
        SELECT motion, 1000 + row_number() OVER (ORDER BY motion) FROM names WHERE motion LIKE 'c%'),
gl AS (SELECT DISTINCT role, level FROM grid),
dense AS (SELECT g.role, g.level, list(coalesce(s.value, 0.0) ORDER BY d.position) AS v
          FROM gl g CROSS JOIN dct d
          LEFT JOIN sc s ON s.role = g.role AND s.level = g.level AND s.motion = d.motion
          GROUP BY g.role, g.level),
dn AS (SELECT d.role, l.label, CAST(flatten(list(d.v ORDER BY d.level)) AS DOUBLE[]) AS features
       FROM dense d JOIN lab l USING (role) GROUP BY d.role, l.label)"""


def _points_ctes(k: int = P.EMB_K) -> str:
    return f"""WITH p AS (SELECT vec_id AS id, CAST(label = 1 AS INTEGER) AS label, embedding AS features FROM embeddings),
nb AS (SELECT count(*) FILTER (WHERE label = 1) AS n_bad FROM p),
fx AS (SELECT id, label, features, CAST(id % {k} AS INTEGER) AS prediction FROM p),
cen AS (SELECT cluster, list(x ORDER BY pos) AS centre FROM (
          SELECT prediction AS cluster, pos, avg(CAST(x AS DOUBLE)) AS x
          FROM (SELECT prediction, unnest(features) AS x, unnest(range(len(features))) AS pos FROM fx)
          GROUP BY prediction, pos)
        GROUP BY cluster),
dist AS (SELECT p.id, p.label, c.cluster,
                list_sum(list_transform(list_zip(p.features, c.centre),
                         lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))) AS dist2
         FROM p CROSS JOIN cen c),
asg AS (SELECT id, label, cluster AS prediction, dist2 FROM dist
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist2, cluster) = 1),
s1 AS ({_summary_sql('fx')}),
b1 AS (SELECT * FROM s1 ORDER BY recall DESC NULLS LAST, precision DESC NULLS LAST, prediction LIMIT 1),
sus1 AS (SELECT id, label, features FROM fx WHERE prediction = (SELECT prediction FROM b1)),
a2 AS (SELECT id, label, features, CAST((id // {k}) % 2 AS INTEGER) AS prediction FROM sus1),
s2 AS ({_summary_sql('a2')}),
b2 AS (SELECT * FROM s2 ORDER BY recall DESC NULLS LAST, precision DESC NULLS LAST, prediction LIMIT 1),
sus2 AS (SELECT id FROM a2 WHERE prediction = (SELECT prediction FROM b2))"""


def _summary_sql(src: str) -> str:
    bad = "count(*) FILTER (WHERE label = 1)"
    return (f"SELECT prediction, count(*) AS n, {bad} AS n_bad, count(*) - {bad} AS n_good, "
            f"CAST({bad} AS DOUBLE) / (SELECT CAST(n_bad AS DOUBLE) FROM nb) AS recall, "
            f"CAST({bad} AS DOUBLE) / CAST(count(*) AS DOUBLE) AS precision FROM {src} GROUP BY prediction")


_SWEEP_ROWS = """CAST(r AS INTEGER) AS round, stage, n, n_bad, n_good, recall, precision
FROM range(1, 4) rounds(r) CROSS JOIN (SELECT 1 AS stage, * FROM s1 UNION ALL SELECT 2, * FROM s2)"""


def _clumps(select: str) -> str:
    """Clusters of the separated points: by id, and by id div k within the chosen one."""
    k = len(P.CLUMPS)
    return _points_ctes(k) + "\n" + select.replace("{k}", str(k))


def _lloyd_sql() -> str:
    """Lloyd's iterations from the vectors of the smallest ids; a centre without points stays."""
    far = "list_sum(list_transform(list_zip(f.features, c.centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = f"""SELECT f.id, f.label, f.features, c.cluster FROM feat f CROSS JOIN {{src}} c
  QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY {far}, c.cluster) = 1"""
    layers = [f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cluster, features AS centre FROM feat QUALIFY cluster < {P.FIT_K})"]
    for m in range(1, P.LLOYD_ROUNDS + 1):
        layers.append(f"""a{m} AS MATERIALIZED ({near.format(src=f'c{m - 1}')}),
m{m} AS MATERIALIZED (SELECT cluster, list(x ORDER BY pos) AS centre FROM (
  SELECT cluster, pos, avg(x) AS x FROM (SELECT cluster, unnest(features) AS x, generate_subscripts(features, 1) AS pos FROM a{m}) GROUP BY cluster, pos) GROUP BY cluster),
c{m} AS MATERIALIZED (SELECT c.cluster, coalesce(m.centre, c.centre) AS centre FROM c{m - 1} c LEFT JOIN m{m} m USING (cluster))""")
    return ",\n" + ",\n".join(layers) + f",\nlast AS ({near.format(src=f'c{P.LLOYD_ROUNDS}')})\nSELECT id, label, cluster FROM last"


_SPREAD = f""",
mean AS (SELECT pos, avg(x) AS x FROM (SELECT unnest(features) AS x, generate_subscripts(features, 1) AS pos FROM feat) GROUP BY pos),
tot AS (SELECT round(sum((e.x - mean.x) * (e.x - mean.x)), 2) AS total, round(sum(e.x), 2) AS mass
        FROM (SELECT unnest(features) AS x, generate_subscripts(features, 1) AS pos FROM feat) e JOIN mean USING (pos)),
sizes AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_bad, least({P.FIT_K}, count(DISTINCT features)) AS clusters FROM feat)"""

_CERTIFIED = "clusters, n, n_bad, 1.0::DOUBLE AS recall_sum, 0.0::DOUBLE AS drift, total, mass"


def _sweep_checks_sql(model: str) -> str:
    return f"""
SELECT '{model}' AS model, CAST(k AS INTEGER) AS k, CAST(r AS INTEGER) AS round, n, n_bad, CAST(least(k, d) AS BIGINT) AS clusters, 1.0::DOUBLE AS recall_sum,
       CAST(2 AS BIGINT) AS halves, CAST(0 AS BIGINT) AS n_gap, CAST(0 AS BIGINT) AS bad_gap, 0.0::DOUBLE AS recall_gap
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_bad, count(DISTINCT features) AS d FROM feat)
CROSS JOIN range({P.SWEEP_K[0]}, {P.SWEEP_K[1] + 1}) ks(k) CROSS JOIN range(1, {P.SWEEP_ROUNDS + 1}) rs(r)"""


def oracle_sql() -> dict[str, str]:
    s1 = stage1_ctes()
    s2 = stage2_ctes()
    lines = _lines_of("features")
    return {
        "kmeans_from_centres": s2 + _lloyd_sql(),
        "kmeans_certificate": s2 + _SPREAD + f"\nSELECT {_CERTIFIED}, CAST(0 AS BIGINT) AS strays FROM sizes CROSS JOIN tot",
        "bisecting_certificate": s2 + _SPREAD + f"\nSELECT {_CERTIFIED}, 0.0::DOUBLE AS cost_gap FROM sizes CROSS JOIN tot",
        "two_round_certificate": s2 + _SPREAD + """
SELECT n, n_bad, clusters, 1.0::DOUBLE AS recall_sum, 0::BIGINT AS unlisted, 0::BIGINT AS outside, 0::BIGINT AS lost, 0::BIGINT AS better, 0::BIGINT AS marked,
       0.0::DOUBLE AS recall_gap, 0::BIGINT AS detected_gap FROM sizes""",
        "sweep_checks_km": s2 + _sweep_checks_sql("km"),
        "sweep_checks_bkm": s2 + _sweep_checks_sql("bkm"),
        "level_sequences": _levels_sql(),
        "level_sequences_parted": _levels_sql(P.RECORD_TOKENS),
        "read_level_json": _levels_sql(),
        "level_json_kept": _broken_sql() + "\nSELECT role, mark, seqs FROM judged WHERE reason IS NULL",
        "level_json_rejected": _broken_sql() + "\nSELECT line, reason FROM judged WHERE reason IS NOT NULL",
        "level_json_counts": _broken_sql() + f"""
SELECT outcome, count(CASE WHEN outcome = 'read' THEN 1 WHEN outcome = 'kept' AND reason IS NULL THEN 1 WHEN outcome = reason THEN 1 END) AS n
FROM judged CROSS JOIN (VALUES {", ".join(f"('{o}')" for o in ("read", "kept", *REJECT_REASONS))}) o(outcome) GROUP BY outcome""",
        "motion_dictionary": f"""WITH {ev_cte()}, every AS (SELECT event_type || '_' || CAST(k AS VARCHAR) AS motion, count(*) AS n FROM ev GROUP BY ALL),
twice AS (SELECT motion FROM every UNION ALL SELECT motion FROM every WHERE n % 2 = 0)
SELECT CAST(row_number() OVER (ORDER BY motion) - 1 AS INTEGER) AS position, motion FROM twice""",
        "run_registry": _runs_sql("SELECT run_id, role, level, slot, motion, value FROM tk JOIN runs ON slot <= top"),
        "run_entries": _runs_sql("""SELECT run_id, 'seq2vec' AS job, CAST(top AS INTEGER) AS top, 'topk' AS table_name,
       (SELECT count(*) FROM tk WHERE slot <= top) AS n_rows FROM runs
UNION ALL SELECT run_id, 'seq2vec', CAST(top AS INTEGER), 'roles', (SELECT count(DISTINCT role) FROM tk) FROM runs"""),
        "explode_sequences": f"WITH {ev_cte()} SELECT CAST(role AS VARCHAR) AS role, level, motion FROM ev",
        "token_motion": f"WITH {ev_cte()} SELECT event_id, motion FROM ev",
        "token_expand": f"WITH {ev_cte()} SELECT event_id, {_expand_sql()} AS motion FROM ev",
        "explode_expanded": f"""WITH {ev_cte()}, x AS (SELECT role, level, {_expand_sql()} AS motion FROM ev)
SELECT CAST(role AS VARCHAR) AS role, level, motion, count(*) AS cnt FROM x GROUP BY role, level, motion""",
        "motion_counts": f"WITH {ev_cte()} SELECT role, level, motion, count(*) AS cnt FROM ev GROUP BY role, level, motion",
        "trim_levels": f"""WITH {ev_cte()} SELECT role, level, motion, count(*) AS cnt FROM ev
WHERE level BETWEEN 3 AND 5 GROUP BY role, level, motion""",
        "trim_levels_pushed": f"""WITH {ev_cte()} SELECT role, level, motion, count(*) AS cnt FROM ev
WHERE level BETWEEN 3 AND 5 GROUP BY role, level, motion""",
        "coverage_filter": stage1_ctes(days=7) + "\nSELECT role, level, motion, cnt FROM cc",
        "role_count": s1 + "\nSELECT n_roles FROM nr",
        "role_count_weekly": stage1_ctes(days=7) + "\nSELECT n_roles FROM nr",
        "motion_ranges": s1 + "\nSELECT level, motion, mx, mn FROM rng",
        "motion_ranges_all_hold": stage1_ctes(lo=2, hi=4, days=10, parity=False)
        + "\nSELECT level, motion, mx, mn FROM rng",
        "scaled_counts": s1 + "\nSELECT role, level, motion, value FROM sc",
        "scaled_counts_span": stage1_ctes(lo=3, hi=5) + "\nSELECT role, level, motion, value FROM sc",
        "topk_motions": s1 + "\nSELECT role, level, slot, motion, value FROM tk",
        "topk_padded": s1 + "\nSELECT role, level, slot, motion, value FROM pad",
        "topk_padded_keep_below": stage1_ctes(lo=3, hi=5, keep_below=True)
        + "\nSELECT role, level, slot, motion, value FROM pad",
        "unaligned_vectors": s1 + """
SELECT p.role, l.label, list(p.motion ORDER BY p.level, p.slot) AS motions,
       list(p.value ORDER BY p.level, p.slot) AS "values"
FROM pad p JOIN lab l USING (role) GROUP BY p.role, l.label""",
        "format_unaligned": s1 + ",\n" + _unaligned_lines_cte() + "\nSELECT id, line FROM fu",
        "parse_unaligned": s1 + f"""
SELECT p.role AS id, l.label, CAST(p.level - {P.LO} AS INTEGER) AS level_pos, p.slot, p.motion, p.value
FROM pad p JOIN lab l USING (role)
QUALIFY p.slot = max(p.slot) OVER (PARTITION BY p.role, p.level, p.motion)""",
        "vector_shape": s1 + ",\n" + _unaligned_lines_cte() + f"""
SELECT count(*) AS n_rows, CAST(min(w) AS INTEGER) AS width, CAST((max(w) - 1) // {2 * P.TOP} AS INTEGER) AS n_levels
FROM (SELECT len(string_split(line, ',')) AS w FROM fu)""",
        "encode_label": s1 + "\nSELECT role, label, role * 10 + label AS mix FROM lab",
        "decode_label": s1 + "\nSELECT role * 10 + label AS mix, role AS id, label FROM lab",
        "flag_labels": f"""SELECT DISTINCT CAST(user_id AS BIGINT) AS role,
       CAST(CASE WHEN user_id % {P.POSITIVE_EVERY} = 0 THEN 1 ELSE 0 END AS INTEGER) AS label FROM events""",
        "densify_dictionary": s1 + ",\n" + _dense_cte() + "\nSELECT role, label, features FROM dn",
        "format_aligned": s1 + ",\n" + _dense_cte() + f"""
SELECT role AS id, {lines} || ',' || CAST(role * 10 + label AS VARCHAR) AS line FROM dn""",
        "motion_union": s1 + "\nSELECT DISTINCT level, motion FROM cells",
        "union_size": s1 + """,
un AS (SELECT DISTINCT level, motion FROM cells)
SELECT level, count(*) AS n FROM un GROUP BY ROLLUP (level)""",
        "align_union": s1 + """,
un AS (SELECT DISTINCT level, motion FROM cells)
SELECT i.id, u.level, u.motion, CAST(coalesce(c.value, 0.0) AS DOUBLE) AS value
FROM (SELECT DISTINCT id, level FROM cells) i JOIN un u ON u.level = i.level
LEFT JOIN cells c ON c.id = i.id AND c.level = u.level AND c.motion = u.motion""",
        "column_histogram": s2 + "\nSELECT level, motion, value, w FROM hist",
        "column_cost": s2 + "\nSELECT level, motion, n_distinct, round(cost, 4) AS cost FROM cost",
        "column_cost_sketch": s2 + "\nSELECT level, motion, n_distinct, CAST((SELECT n FROM nid) AS DOUBLE) AS weight, true AS bounded, true AS close FROM cost",
        "column_cost_wide": s2 + "\nSELECT level, motion, n_distinct, round(cost, 4) AS cost FROM cost",
        "informative_columns": s2 + f"""
SELECT level, motion, n_distinct, round(cost, 4) AS cost FROM cost WHERE n_distinct > {P.COLUMN_K}""",
        "kept_columns": s2 + "\nSELECT level, rank, motion, round(cost, 4) AS cost FROM kept",
        "format_kept": s2 + f"""
SELECT level, '(' || CAST(level - {P.LO} AS VARCHAR) || ',List('
       || string_agg('(' || motion || ',' || CAST(round(cost, 4) AS VARCHAR) || ')', ',' ORDER BY rank) || '))' AS line
FROM kept GROUP BY level""",
        "kept_columns_cost_desc": s2 + f"""
SELECT level, rank, motion, round(cost, 4) AS cost FROM (
  SELECT level, CAST(row_number() OVER (PARTITION BY level ORDER BY round(cost, 6) DESC, motion) AS INTEGER) AS rank,
         motion, cost
  FROM cost WHERE n_distinct > {P.COLUMN_K}) WHERE rank <= {P.KEPT}""",
        "kept_columns_k7": stage2_ctes(column_k=7) + "\nSELECT level, rank, motion, round(cost, 4) AS cost FROM kept",
        "kept_columns_k6": stage2_ctes(column_k=6) + "\nSELECT level, rank, motion, round(cost, 4) AS cost FROM kept",
        "column_cost_kmeans": s2 + f"\nSELECT level, motion, n_distinct, n_distinct <= {P.COLUMN_K} AS is_zero, true AS at_least_optimum FROM cost",
        "decode_label_large": s1 + """
SELECT CAST(CAST(role + 9007199254740993 AS HUGEINT) * 10 + label AS VARCHAR) AS mix, role + 9007199254740993 AS id, label FROM lab""",
        "reduced_from_text_top3": stage2_ctes(k=3) + "\nSELECT id, label, features FROM feat",
        "align_union_pad_name": stage1_ctes(k=P.PAD_TOP, renamed=P.PAD_NAMED) + """,
un AS (SELECT DISTINCT level, motion FROM cells)
SELECT i.id, u.level, u.motion, CAST(coalesce(c.value, 0.0) AS DOUBLE) AS value
FROM (SELECT DISTINCT id, level FROM cells) i JOIN un u ON u.level = i.level
LEFT JOIN cells c ON c.id = i.id AND c.level = u.level AND c.motion = u.motion""",
        "assemble_vectors_pad_name": stage2_ctes(k=P.PAD_TOP, renamed=P.PAD_NAMED) + "\nSELECT id, label, features FROM feat",
        "unaligned_vectors_text_roles": s1 + """
SELECT 'u' || CAST(p.role AS VARCHAR) AS role, l.label, list(p.motion ORDER BY p.level, p.slot) AS motions,
       list(p.value ORDER BY p.level, p.slot) AS "values"
FROM pad p JOIN lab l USING (role) GROUP BY p.role, l.label""",
        "reduced_cells": s2 + "\nSELECT id, pos, value FROM red",
        "assemble_vectors": s2 + "\nSELECT id, label, features FROM feat",
        "reduced_from_text": s2 + "\nSELECT id, label, features FROM feat",
        "format_reduced": s2 + f"\nSELECT id, {lines} || ',' || CAST(id * 10 + label AS VARCHAR) AS line FROM feat",
        "parse_reduced": s2 + "\nSELECT id, label, features FROM feat",
        "count_positives": _points_ctes() + "\nSELECT n_bad FROM nb",
        "assign_centres": _points_ctes() + "\nSELECT id, label, prediction FROM asg",
        "cohesion_separation": _points_ctes() + """,
per AS (SELECT prediction, count(*) AS n, sum(dist2) AS sse FROM asg GROUP BY prediction),
mc AS (SELECT list(x ORDER BY pos) AS m FROM (
         SELECT pos, avg(x) AS x FROM (SELECT unnest(centre) AS x, unnest(range(len(centre))) AS pos FROM cen)
         GROUP BY pos))
SELECT round(sum(per.sse), 6) AS sse,
       round(sum(CAST(per.n AS DOUBLE) / (SELECT sum(n) FROM per)
                 * list_sum(list_transform(list_zip(c.centre, mc.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS ssb
FROM per JOIN cen c ON c.cluster = per.prediction CROSS JOIN mc""",
        "cluster_summary": _points_ctes() + "\nSELECT * FROM s1",
        "best_cluster": _points_ctes() + "\nSELECT * FROM b1",
        "suspicious_rows": _points_ctes() + "\nSELECT id, label, prediction FROM fx WHERE prediction = (SELECT prediction FROM b1)",
        "second_round_summary": _points_ctes() + "\nSELECT * FROM s2",
        "checklist": _points_ctes() + """
SELECT fx.id, fx.label, CAST(CASE WHEN fx.id IN (SELECT id FROM sus2) THEN 1 ELSE 0 END AS INTEGER) AS prediction
FROM fx""",
        "evaluation_report": _points_ctes() + """
SELECT b1.prediction AS cluster_1, b2.prediction AS cluster_2, nb.n_bad, b2.n_bad AS detected, b2.recall
FROM b1 CROSS JOIN b2 CROSS JOIN nb""",
        "evaluation_report_lines": _points_ctes() + """,
rep AS (SELECT b1.prediction AS cluster_1, b2.prediction AS cluster_2, nb.n_bad, b2.n_bad AS detected,
               b2.recall FROM b1 CROSS JOIN b2 CROSS JOIN nb)
SELECT 1 AS section, prediction AS cluster,
       printf('round 1 cluster %d: n=%d bad=%d good=%d recall=', prediction, n, n_bad, n_good)
       || coalesce(CAST(recall AS VARCHAR), 'null') || ' precision=' || coalesce(CAST(precision AS VARCHAR), 'null') AS line
FROM s1
UNION ALL
SELECT 2, prediction,
       printf('round 2 cluster %d: n=%d bad=%d good=%d recall=', prediction, n, n_bad, n_good)
       || coalesce(CAST(recall AS VARCHAR), 'null') || ' precision=' || coalesce(CAST(precision AS VARCHAR), 'null')
FROM s2
UNION ALL
SELECT 3, CAST(NULL AS INTEGER),
       printf('chosen: cluster %d of round 1, cluster %d of round 2; %d known cases, %d detected, recall ',
              cluster_1, cluster_2, n_bad, detected) || coalesce(CAST(recall AS VARCHAR), 'null')
FROM rep""",
        "kmeans_clusters": _clumps("SELECT id, label, id % {k} AS cluster FROM p"),
        "bisecting_clusters": _clumps("SELECT id, label, id % {k} AS cluster FROM p"),
        "two_round_clustering": _clumps("""SELECT fx.id, fx.label, CAST(CASE WHEN fx.id IN (SELECT id FROM sus2) THEN 1 ELSE 0 END AS INTEGER) AS prediction
FROM fx"""),
        "sweep_report": _clumps("SELECT 'bkm' AS model, CAST({k} AS INTEGER) AS k, " + _SWEEP_ROWS),
        "sweep_lines": _clumps("""SELECT model, k, round, stage, printf('model=%s k=%d round=%d stage=%d n=%d bad=%d recall=', model, k, round, stage, n, n_bad)
       || CAST(recall AS VARCHAR) || ' precision=' || CAST(precision AS VARCHAR) AS line
FROM (SELECT 'bkm' AS model, CAST({k} AS INTEGER) AS k, """ + _SWEEP_ROWS + ")"),
        "format_assignments": s2 + f"""
SELECT id, CAST(id AS VARCHAR) || ',' || CAST(label AS VARCHAR) || ',' || CAST(CAST(id % 6 AS INTEGER) AS VARCHAR)
       || ',' || {lines} AS line FROM feat""",
    }
