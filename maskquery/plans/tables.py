"""Queries: reports, trials, logs, names, validators and annotation rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from maskquery.functions import scalars as S
from maskquery.operators import annotations as A
from maskquery.operators import trials as TR
from maskquery.operators import validate as V
from maskquery.operators.numbering import order_by_score
from maskquery.plans.registry import query
from maskquery.plans.scoring import rounded
from maskquery.plans.views import COMMON, table, view
from maskquery.sources import reports as RP
from maskquery.sources import manifests as MF

# --- reports -------------------------------------------------------------------------------------------------

METRICS = ("aji", "f1_iou50", "f1_iou75", "mF1_iou50_95")


def report_texts(spark, sf):
    """One report document per customer, in one of the three layouts, built from per-order metric rows."""
    rows = metric_rows(spark, sf)
    opts = {"ignoreNullFields": "false"}
    body = F.to_json(F.struct(*METRICS), opts)
    flat = F.concat(F.lit('"s'), F.col("sample_id").cast("string"), F.lit('":'), body)
    listed = F.to_json(F.struct(F.concat(F.lit("s"), F.col("sample_id").cast("string")).alias("sample_id"), *METRICS), opts)
    g = rows.groupBy("custkey").agg(
        F.array_join(F.array_sort(F.collect_list(flat)), ",").alias("f"), F.array_join(F.array_sort(F.collect_list(listed)), ",").alias("l")
    )
    kind = F.col("custkey") % 3
    text = (
        F.when(kind == 0, F.concat(F.lit('{"mean":{"aji":0.5},"note":1,'), "f", F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"schema_version":1,"samples":['), "l", F.lit("]}")))
        .otherwise(
            F.concat(
                F.lit('{"samples":[],"extras":{"legacy":{"per_sample_flat":{"mean":{"aji":0.5},'), "f", F.lit("}}}}")
            )
        )
    )
    return g.select("custkey", text.alias("text"))


def metric_rows(spark, sf):
    o = F.col("o_orderkey")
    m = lambda k: ((o * k) % 1000).cast("double") / 1000.0
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("custkey"), o.alias("sample_id"), m(37).alias("aji"), m(53).alias("f1_iou50"), m(71).alias("f1_iou75"), m(89).alias("mF1_iou50_95")
    )


MROWS = """mr AS (SELECT o_custkey AS custkey, o_orderkey AS sample_id, CAST((o_orderkey * 37) % 1000 AS DOUBLE) / 1000.0e0 AS aji,
 CAST((o_orderkey * 53) % 1000 AS DOUBLE) / 1000.0e0 AS f1_iou50, CAST((o_orderkey * 71) % 1000 AS DOUBLE) / 1000.0e0 AS f1_iou75,
 CAST((o_orderkey * 89) % 1000 AS DOUBLE) / 1000.0e0 AS mf FROM orders)"""


@query(
    "a8_read_eval_reports",
    f"WITH {MROWS} SELECT custkey, CONCAT('s', CAST(sample_id AS STRING)) AS sample_id, aji, f1_iou50, f1_iou75, mf AS mF1_iou50_95 FROM mr",
)
def a8_read_eval_reports(spark, sf):
    return RP.parse_eval_reports(report_texts(spark, sf)).select("custkey", "sample_id", *METRICS)


@query(
    "a9_write_eval_report",
    f"""WITH {MROWS}, t AS (SELECT custkey, sample_id, aji, f1_iou50,
  CONCAT('{{"aji":', CAST(aji AS STRING), ',"f1_iou50":', CAST(f1_iou50 AS STRING), '}}') AS b FROM mr),
 g AS (SELECT custkey, COUNT(*) AS n,
  STRING_AGG(CONCAT('{{"sample_id":', CAST(sample_id AS STRING), ',', SUBSTRING(b, 2)), ',' ORDER BY sample_id) AS s,
  STRING_AGG(CONCAT('"', CAST(sample_id AS STRING), '":', b), ',' ORDER BY sample_id) AS f,
  CONCAT('{{"aji":', CAST(ROUND(AVG(aji), 10) AS STRING), ',"f1_iou50":', CAST(ROUND(AVG(f1_iou50), 10) AS STRING), '}}') AS m
  FROM t GROUP BY custkey)
SELECT CAST(custkey AS STRING) AS variant, CONCAT('{{"schema_version":1,"model_type":"unet","variant":"', CAST(custkey AS STRING),
 '","unit":"patch","samples":[', s, ']', CASE WHEN n > 1 THEN CONCAT(',"mean":', m) ELSE '' END,
 ',"extras":{{"legacy":{{"per_sample_flat":{{', f, CASE WHEN n > 1 THEN CONCAT(',"mean":', m) ELSE '' END, '}}}}}}}}') AS doc FROM g""",
)
def a9_write_eval_report(spark, sf):
    rows = metric_rows(spark, sf).withColumn("variant", F.col("custkey").cast("string"))
    return RP.eval_report_docs(rows, "unet", "patch", ("aji", "f1_iou50"), digits=10)


T_TAIL = """(1.959963984540054e0 + ({z3} + {z}) / 4 / v + (5 * {z5} + 16 * {z3} + 3 * {z}) / 96 / POW(v, 2)
 + (3 * {z7} + 19 * {z5} + 17 * {z3} - 15 * {z}) / 384 / POW(v, 3)
 + (79 * {z9} + 776 * {z7} + 1482 * {z5} - 1920 * {z3} - 945 * {z}) / 92160 / POW(v, 4))"""
for _k in (9, 7, 5, 3):
    T_TAIL = T_TAIL.replace("{z%d}" % _k, f"POW(1.959963984540054e0, {_k})")
T_TAIL = T_TAIL.replace("{z}", "1.959963984540054e0")


@query(
    "d12_ci95",
    f"""WITH g AS (SELECT variant, COUNT(CASE WHEN NOT isnan(aji) THEN aji END) AS n,
  STDDEV_SAMP(CASE WHEN NOT isnan(aji) THEN aji END) AS sd FROM fx_metric_rows GROUP BY variant),
 w AS (SELECT *, CAST(n - 1 AS DOUBLE) AS v FROM g)
SELECT variant, n, ROUND(sd / SQRT(n) * {T_TAIL}, 8) AS ci FROM w""",
)
def d12_ci95(spark, sf):
    ok = F.when(~F.isnan("aji"), F.col("aji"))
    return view(spark, sf, "fx_metric_rows").groupBy("variant").agg(F.count(ok).alias("n"), F.round(TR.ci95(ok), 8).alias("ci"))


@query(
    "d13_compare_variants",
    f"""WITH u AS (UNPIVOT fx_metric_rows ON aji, f1_iou50, f1_iou75, mf1_iou50_95 INTO NAME k VALUE x),
 g AS (SELECT variant, k, COUNT(*) AS samples, COUNT(CASE WHEN NOT isnan(x) THEN x END) AS n,
  AVG(CASE WHEN NOT isnan(x) THEN x END) AS mean, STDDEV_SAMP(CASE WHEN NOT isnan(x) THEN x END) AS sd FROM u GROUP BY variant, k),
 c AS (SELECT *, sd / SQRT(n) * {T_TAIL} AS ci FROM (SELECT *, CAST(n - 1 AS DOUBLE) AS v FROM g))
SELECT variant, MAX(samples) AS samples,
 {', '.join(f"ROUND(MAX(CASE WHEN k = '{k}' THEN mean END), 8) AS {k}_mean, ROUND(MAX(CASE WHEN k = '{k}' THEN ci END), 8) AS {k}_ci" for k in ('aji', 'f1_iou50', 'f1_iou75', 'mf1_iou50_95'))}
FROM c GROUP BY variant""",
)
def d13_compare_variants(spark, sf):
    out = TR.compare_variants(view(spark, sf, "fx_metric_rows"), ("aji", "f1_iou50", "f1_iou75", "mf1_iou50_95"))
    return rounded(out, ["variant", "samples"], 8)


@query(
    "a22_flatten_metric_sections",
    """SELECT o_orderkey, s AS section, k AS key, CAST(v AS STRING) AS value FROM (
 SELECT o_orderkey, 'box' AS s, 'map' AS k, o_orderkey % 10 AS v FROM orders UNION ALL
 SELECT o_orderkey, 'box', 'map50', o_custkey FROM orders UNION ALL
 SELECT o_orderkey, 'seg', 'f1', o_custkey % 7 FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT o_orderkey, '', 'speed', '{"map":1}' FROM orders""",
)
def a22_flatten_metric_sections(spark, sf):
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    text = F.concat(
        F.lit('{"box":{"map":'), (F.col("o_orderkey") % 10).cast("string"), F.lit(',"map50":'), c.cast("string"), F.lit(',"curves":[1]},"speed":{"map":1}'),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(',"seg":{"f1":'), (c % 7).cast("string"), F.lit("}"))).otherwise(F.lit(',"seg":{"f1":null}')),
        F.lit("}"),
    )
    return RP.flatten_metric_sections(table(spark, sf, "orders").select("o_orderkey", text.alias("text")))


# --- trials and logs ------------------------------------------------------------------------------------------


@query("a10_read_trials", "SELECT run, iteration, ROUND(lr0, 9) AS lr0, ROUND(dropout, 9) AS dropout, ROUND(fitness, 9) AS fitness FROM fx_trials WHERE NOT isnan(fitness)")
def a10_read_trials(spark, sf):
    return rounded(TR.valid_trials(view(spark, sf, "fx_trials")), ["run", "iteration"])


def smooth_sql(window: int) -> str:
    pad = window // 2
    k = TR._kernel(window)
    kern = "(VALUES " + ", ".join(f"({i - pad}, {w!r}e0)" for i, w in enumerate(k)) + ") kn(o, w)"
    step = lambda src: f"""SELECT s.run, s.pos, s.n, SUM(c.v * kn.w) AS v FROM {src} s, {kern}, {src} c
  WHERE c.run = s.run AND c.pos = LEAST(GREATEST(s.pos + kn.o, 1), s.n) GROUP BY s.run, s.pos, s.n"""  # noqa: E731
    return f"""WITH b AS (SELECT run, iteration, fitness AS v, ROW_NUMBER() OVER (PARTITION BY run ORDER BY iteration) AS pos,
  COUNT(*) OVER (PARTITION BY run) AS n, AVG(fitness) OVER (PARTITION BY run) AS mean FROM fx_trials WHERE NOT isnan(fitness)),
 p1 AS ({step('b')}), p2 AS ({step('p1')})
SELECT b.run, b.iteration, ROUND(CASE WHEN b.n < {window} THEN b.mean ELSE p2.v END, 8) AS smooth
FROM b JOIN p2 ON p2.run = b.run AND p2.pos = b.pos"""


@query("e6_gaussian_smooth", smooth_sql(7))
def e6_gaussian_smooth(spark, sf):
    return rounded(TR.gaussian_smooth(TR.valid_trials(view(spark, sf, "fx_trials")), 7), ["run", "iteration"], 8)


@query(
    "d14_fitness_limits",
    "SELECT ROUND(QUANTILE_CONT(fitness, 0.05e0), 9) AS lo, ROUND(QUANTILE_CONT(fitness, 0.95e0), 9) AS hi FROM fx_trials WHERE NOT isnan(fitness)",
)
def d14_fitness_limits(spark, sf):
    lo, hi = TR.fitness_limits(view(spark, sf, "fx_trials"))
    return spark.range(1).select(F.round(F.lit(lo), 9).alias("lo"), F.round(F.lit(hi), 9).alias("hi"))


@query(
    "d15_best_trial",
    """SELECT run, iteration, ROUND(fitness, 9) AS fitness FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run ORDER BY fitness DESC, iteration) AS r
 FROM fx_trials WHERE NOT isnan(fitness)) WHERE r = 1""",
)
def d15_best_trial(spark, sf):
    return rounded(TR.best_trial(TR.valid_trials(view(spark, sf, "fx_trials"))), ["run", "iteration"])


LOG = """lg AS (SELECT run, line_no, REGEXP_EXTRACT(line, 'accuracy:\\s+([\\d.]+)\\s+-\\s+loss:\\s+([\\d.]+)\\s+-\\s+val_accuracy:\\s+([\\d.]+)\\s+-\\s+val_loss:\\s+([\\d.]+)',
  ['a', 'b', 'c', 'd']) AS m FROM fx_log_lines),
 ep AS (SELECT run, CAST(ROW_NUMBER() OVER (PARTITION BY run ORDER BY line_no) AS INT) AS epoch, CAST(m.a AS DOUBLE) AS accuracy,
  CAST(m.b AS DOUBLE) AS loss, CAST(m.c AS DOUBLE) AS val_accuracy, CAST(m.d AS DOUBLE) AS val_loss FROM lg WHERE m.a <> '')"""


@query("a12_read_training_log", f"WITH {LOG} SELECT * FROM ep")
def a12_read_training_log(spark, sf):
    return RP.parse_training_log(view(spark, sf, "fx_log_lines"))


@query("e10_epoch_number", f"WITH {LOG} SELECT run, MAX(epoch) AS epochs FROM ep GROUP BY run")
def e10_epoch_number(spark, sf):
    return a12_read_training_log(spark, sf).groupBy("run").agg(F.max("epoch").alias("epochs"))


@query("d26_curve_minimum", f"WITH {LOG} SELECT run, MIN(val_loss) AS min_val_loss FROM ep GROUP BY run")
def d26_curve_minimum(spark, sf):
    return TR.curve_minimum(a12_read_training_log(spark, sf))


NOISE_SQL = """SELECT run, line_no, line FROM fx_log_lines WHERE NOT regexp_matches(line,
 'Unable to register cu(?:FFT|DNN|BLAS) factory|All log messages before absl::InitializeLog\\(\\) is called are written to STDERR|gpu_timer\\.cc:\\d+\\] Skipping the delay kernel, measurement accuracy will be reduced|.*\\(ignoring feature\\)')"""


@query("b12_drop_log_noise", NOISE_SQL)
def b12_drop_log_noise(spark, sf):
    return view(spark, sf, "fx_log_lines").where(~S.is_noise(F.col("line")))


def event_log_stream(spark, sf_dir):
    """The events table as a stream of log lines."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"events_{uuid.uuid4().hex}"
    events.createOrReplaceTempView(name)
    return spark.sql(COMMON["fx_log_lines"].replace("FROM events", f"FROM {name}"))


@query("k1_stream_log_filter", NOISE_SQL)
def k1_stream_log_filter(spark, sf):
    from maskquery.streaming import logs as L

    return L.drain(L.drop_noise(event_log_stream(spark, sf)))


@query("k2_stream_training_metrics", f"WITH {LOG} SELECT * FROM ep")
def k2_stream_training_metrics(spark, sf):
    from maskquery.streaming import logs as L

    return L.training_metrics(event_log_stream(spark, sf))


@query(
    "d17_source_summary",
    """SELECT CONCAT('c', CAST(o_custkey AS STRING)) AS sample_id, MIN(o_orderkey) AS first_pos,
 COUNT(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS region_count FROM orders GROUP BY o_custkey""",
)
def d17_source_summary(spark, sf):
    c = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    samples = table(spark, sf, "orders").select(
        c.alias("sample_id"), F.array(F.concat(c, F.lit("_PPL.tif"))).alias("images"), F.col("o_orderkey").alias("pos"),
        F.when(F.col("o_orderstatus") != "P", F.struct(F.lit(0).alias("y0"))).alias("region"),
    )
    return TR.source_summary(samples).select("sample_id", "first_pos", "region_count")


# --- parameter grids -------------------------------------------------------------------------------------------

# The default watershed grid.
GRID = dict(min_distance=[1, 3, 5], boundary_dilate_iter=[0, 1], watershed_connectivity=[1, 2], min_area_px=[0], exclude_border=[False, True], ridge_level=[])


@query(
    "c11_param_grid",
    """WITH m AS (SELECT * FROM (VALUES (1), (3), (5)) v(min_distance)), b AS (SELECT * FROM (VALUES (0), (1)) v(boundary_dilate_iter)),
 c AS (SELECT * FROM (VALUES (1), (2)) v(watershed_connectivity)), e AS (SELECT * FROM (VALUES (FALSE), (TRUE)) v(exclude_border))
SELECT f.sample_id, CAST(ROW_NUMBER() OVER (PARTITION BY f.sample_id ORDER BY min_distance, boundary_dilate_iter, watershed_connectivity, exclude_border) - 1 AS INT) AS grid_idx,
 min_distance, boundary_dilate_iter, watershed_connectivity, exclude_border FROM fx_frames f, m, b, c, e""",
)
def c11_param_grid(spark, sf):
    return samples_by_grid(view(spark, sf, "fx_frames").select("sample_id"), spark).select(
        "sample_id", "grid_idx", "min_distance", "boundary_dilate_iter", "watershed_connectivity", "exclude_border"
    )


def samples_by_grid(samples, spark):
    """Every sample with every parameter set: the grid is a fixed array on each row, not a joined table."""
    sets = [r.asDict() for r in TR.param_grid(spark, **GRID).collect()]  # 24 rows by definition
    row = lambda s: F.struct(*[F.lit(v).alias(k) for k, v in s.items() if k != "ridge_level"])
    return samples.select("*", F.explode(F.array(*[row(s) for s in sets])).alias("g")).select("*", "g.*").drop("g")


SCORES = """sc AS (SELECT CAST(p_size AS INT) AS grid_idx, CONCAT('s', CAST(p_partkey % 3 AS STRING)) AS sample_id,
 ROUND(AVG(CAST((p_partkey * 37) % 1000 AS DOUBLE) / 1000.0e0), 6) AS aji FROM part GROUP BY 1, 2)"""


def grid_scores(spark, sf):
    return table(spark, sf, "part").groupBy(
        F.col("p_size").alias("grid_idx"), F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string")).alias("sample_id")
    ).agg(F.round(F.avg(((F.col("p_partkey") * 37) % 1000).cast("double") / 1000.0), 6).alias("aji"))


@query(
    "d16_best_params",
    f"""WITH {SCORES}, m AS (SELECT grid_idx, AVG(aji) AS mean_aji FROM sc GROUP BY grid_idx)
SELECT grid_idx, ROUND(mean_aji, 8) AS mean_aji, ROW_NUMBER() OVER (ORDER BY mean_aji DESC, grid_idx) = 1 AS best FROM m""",
)
def d16_best_params(spark, sf):
    return TR.best_params(grid_scores(spark, sf)).select("grid_idx", F.round("mean_aji", 8).alias("mean_aji"), "best")


@query(
    "a11_write_grid_results",
    f"""WITH {SCORES} SELECT grid_idx, PRINTF('%.8f', AVG(aji)) AS mean_aji, PRINTF('%.8f', MAX(CASE WHEN sample_id = 's0' THEN aji END)) AS aji__s0,
 PRINTF('%.8f', MAX(CASE WHEN sample_id = 's1' THEN aji END)) AS aji__s1, PRINTF('%.8f', MAX(CASE WHEN sample_id = 's2' THEN aji END)) AS aji__s2
FROM sc GROUP BY grid_idx""",
)
def a11_write_grid_results(spark, sf):
    return TR.grid_results(grid_scores(spark, sf), ["s0", "s1", "s2"])


# --- names -----------------------------------------------------------------------------------------------------


@query(
    "b14_names",
    """SELECT page_id, REGEXP_REPLACE(url, '[^0-9A-Za-z_]+', '_', 'g') AS key,
 CASE WHEN TRIM(REGEXP_REPLACE(url, '[^\\p{L}\\p{N}+\\-_]', '_', 'g'), '_') = '' THEN 'model'
  ELSE TRIM(REGEXP_REPLACE(url, '[^\\p{L}\\p{N}+\\-_]', '_', 'g'), '_') END AS label FROM pages""",
)
def b14_names(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", S.sanitize_key(u).alias("key"), S.sanitize_label(u).alias("label"))


MODEL_NAMES = """mn AS (SELECT c_custkey, CONCAT('unet_finetuned_', CASE c_custkey % 5 WHEN 0 THEN 'PPL' WHEN 1 THEN 'PPLPPXblend'
 WHEN 2 THEN 'PPL+PPXblend' WHEN 3 THEN 'PPL+AllPPX' ELSE 'other' END, '_', CAST(c_custkey AS STRING)) AS model FROM customer)"""


@query(
    "b14_display_run",
    f"""WITH {MODEL_NAMES} SELECT c_custkey, REPLACE(REPLACE(REPLACE(model, 'PPL+AllPPX', 'PPL+XPL-Stack'), 'PPL+PPXblend', 'PPL+XPL-Comp'),
 'PPLPPXblend', 'Full-Comp') AS name FROM mn""",
)
def b14_display_run(spark, sf):
    return view(spark, sf, f"WITH {MODEL_NAMES} SELECT * FROM mn").select("c_custkey", S.display_run(F.col("model")).alias("name"))


@query(
    "b22_infer_variant",
    f"""WITH {MODEL_NAMES}, v AS (SELECT c_custkey, REPLACE(model, 'unet_finetuned_', '') AS label,
  CASE WHEN CONTAINS(model, 'PPL+AllPPX') THEN 1 WHEN CONTAINS(model, 'PPL+PPXblend') THEN 2 WHEN CONTAINS(model, 'PPLPPXblend') THEN 3
   WHEN CONTAINS(model, 'PPL') THEN 4 END AS k FROM mn)
SELECT c_custkey, label, CASE k WHEN 1 THEN 7 WHEN 2 THEN 2 ELSE 1 END AS num_inputs,
 CASE k WHEN 1 THEN '_PPL,_PPX1,_PPX2,_PPX3,_PPX4,_PPX5,_PPX6' WHEN 2 THEN '_PPL,_PPXblend' WHEN 3 THEN '_PPLPPXblend' ELSE '_PPL' END AS suffixes,
 CASE k WHEN 1 THEN 'PPL_AllPPX' WHEN 2 THEN 'PPL_PlusPPXblend' WHEN 3 THEN 'PPLPPXblend' ELSE 'PPL' END AS tune_subdir FROM v WHERE k IS NOT NULL""",
)
def b22_infer_variant(spark, sf):
    m = view(spark, sf, f"WITH {MODEL_NAMES} SELECT * FROM mn")
    return m.select("c_custkey", S.infer_variant(F.col("model")).alias("v")).where("v IS NOT NULL").select("c_custkey", "v.*")


# --- validators ------------------------------------------------------------------------------------------------


@query(
    "b4_validate_semantic",
    """SELECT event_id, value AS cls FROM events WHERE NOT (ABS(value - ROUND_EVEN(value, 0)) <= 1e-4 AND ROUND_EVEN(value, 0) BETWEEN 0 AND 255)""",
)
def b4_validate_semantic(spark, sf):
    px = table(spark, sf, "events").select("event_id", F.col("value").alias("cls"))
    return V.semantic_violations(px, 0, 255, allow_float=True)


@query(
    "b5_validate_sample_shapes",
    """WITH i AS (SELECT l_orderkey AS sample_id, CASE WHEN l_linestatus = 'O' THEN 'image' ELSE 'mask' END AS kind,
  CAST(l_discount * 100 AS INT) // 5 AS h, l_linenumber // 5 AS w, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 3 END AS c FROM lineitem),
 g AS (SELECT sample_id, COUNT(CASE WHEN kind = 'image' THEN 1 END) AS images,
  COUNT(DISTINCT CASE WHEN kind = 'image' THEN (h, w, c) END) AS sh, COUNT(DISTINCT (h, w)) AS hw FROM i GROUP BY sample_id)
SELECT * FROM (SELECT sample_id, CASE WHEN images = 0 THEN 'no image' WHEN sh > 1 THEN 'image shapes differ'
 WHEN hw > 1 THEN 'mask shape differs' END AS reason FROM g) WHERE reason IS NOT NULL""",
)
def b5_validate_sample_shapes(spark, sf):
    i = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), F.when(F.col("l_linestatus") == "O", "image").otherwise("mask").alias("kind"),
        F.floor(F.rint(F.col("l_discount") * 100) / 5).alias("h"), F.floor(F.col("l_linenumber") / 5).alias("w"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(3).alias("c"),
    )
    return V.shape_violations(i)


@query(
    "b13_check_params",
    """WITH p AS (SELECT l_orderkey, l_partkey, l_extendedprice, l_linenumber AS num_inputs, CAST(l_quantity AS INT) AS stride, 40 AS patch_size,
  l_linenumber - 1 AS min_distance, l_discount * 10 AS patch_overlap, l_tax * 20 AS min_iom, l_discount * 12 AS max_coverage FROM lineitem),
 b AS (SELECT *, LIST_FILTER([CASE WHEN NOT (num_inputs IN (1, 2, 7)) THEN 'num_inputs' END,
  CASE WHEN NOT (stride > 0 AND stride <= patch_size) THEN 'stride' END, CASE WHEN NOT (min_distance >= 1) THEN 'min_distance' END,
  CASE WHEN NOT (patch_overlap >= 0 AND patch_overlap <= 0.9e0) THEN 'patch_overlap' END,
  CASE WHEN NOT (min_iom >= 0 AND min_iom <= 1) THEN 'min_iom' END,
  CASE WHEN NOT (max_coverage > 0 AND max_coverage <= 1) THEN 'max_coverage' END], LAMBDA x : x IS NOT NULL) AS broken FROM p)
SELECT l_orderkey, l_partkey, l_extendedprice, ARRAY_TO_STRING(broken, ',') AS broken FROM b WHERE LEN(broken) > 0""",
)
def b13_check_params(spark, sf):
    p = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", F.col("l_linenumber").alias("num_inputs"), F.col("l_quantity").cast("int").alias("stride"), F.lit(40).alias("patch_size"),
        (F.col("l_linenumber") - 1).alias("min_distance"), (F.col("l_discount") * 10).alias("patch_overlap"), (F.col("l_tax") * 20).alias("min_iom"),
        (F.col("l_discount") * 12).alias("max_coverage"),
    )
    return V.param_violations(p).select("l_orderkey", "l_partkey", "l_extendedprice", F.array_join("broken", ",").alias("broken"))


@query(
    "b2_resolve_layout",
    """WITH m AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'YXS' WHEN 1 THEN 'SYX' WHEN 2 THEN 'CYX' ELSE 'QYX' END AS axes,
  CASE WHEN p_partkey % 8 = 7 THEN 500 ELSE 3 END AS a, 400 AS b, CASE WHEN p_partkey % 8 = 7 THEN 6 ELSE 400 + p_size END AS c FROM part)
SELECT p_partkey, CASE WHEN axes = 'YXS' THEN 'hwc' WHEN axes IN ('SYX', 'CYX') THEN 'chw' WHEN a < b AND c >= b THEN 'chw' ELSE 'hwc' END AS by_axes,
 CASE WHEN a <= 8 AND b > 64 AND c > 64 THEN 'chw' ELSE 'hwc' END AS by_size,
 CASE WHEN a % 3 = 0 THEN 'chw' ELSE 'hwc' END AS by_channels FROM m""",
)
def b2_resolve_layout(spark, sf):
    k = F.col("p_partkey")
    last = k % 8 == 7
    m = table(spark, sf, "part").select(
        "p_partkey", F.element_at(F.array(*[F.lit(x) for x in ("YXS", "SYX", "CYX", "QYX")]), (k % 4 + 1).cast("int")).alias("axes"),
        F.when(last, 500).otherwise(3).alias("a"), F.lit(400).alias("b"), F.when(last, 6).otherwise(F.lit(400) + F.col("p_size")).alias("c"),
    )
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return m.select(
        "p_partkey", V.resolve_layout(F.col("axes"), a, b, c).alias("by_axes"), V.layout_by_size(a, b, c).alias("by_size"),
        V.layout_by_channels(a, c, multiple=3).alias("by_channels"),
    )


# --- annotation rows --------------------------------------------------------------------------------------------


def masks(spark, sf):
    """Detected masks with tile origins (tiles of 128 px), as the mask generator stores them."""
    b = view(spark, sf, "fx_cboxes").where("side = 'dt'")
    tx, ty = (F.floor(F.col("x0") / 128) * 128).cast("int"), (F.floor(F.col("y0") / 128) * 128).cast("int")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    lx, ly = F.col("x0") - tx, F.col("y0") - ty
    area_text = F.when(F.col("inst_id") % 3 == 0, F.lit("n/a")).when(F.col("inst_id") % 3 == 1, (w * h).cast("string"))
    return b.select(
        "sample_id", "inst_id", tx.alias("tile_x"), ty.alias("tile_y"), (w * h).alias("px"), area_text.alias("area"),
        F.array(lx, ly, w, h).alias("bbox"), F.array(lx, ly, w, h).alias("crop_box"), F.array(F.array(lx, ly), F.array(lx + w, ly)).alias("point_coords"),
        F.col("score").alias("predicted_iou"), F.array(F.lit(0), w * h).alias("counts"), F.struct(F.array(w, h).alias("size")).alias("rle"),
    )


DT_BOX = "fx_cboxes WHERE side = 'dt'"


@query("b6_filter_mask_coverage", f"SELECT sample_id, inst_id FROM {DT_BOX} AND CAST((x1 - x0) * (y1 - y0) AS DOUBLE) / 200.0e0 < 0.5e0")
def b6_filter_mask_coverage(spark, sf):
    m = masks(spark, sf).select("sample_id", "inst_id", F.col("px").alias("area"))
    return A.filter_mask_coverage(m, 200, 0.5).select("sample_id", "inst_id")


@query("b7_filter_mask_area", f"SELECT sample_id, inst_id FROM {DT_BOX} AND (x1 - x0) * (y1 - y0) < 60")
def b7_filter_mask_area(spark, sf):
    return A.filter_mask_area(masks(spark, sf), 60).select("sample_id", "inst_id")


@query("b10_scalar_props", f"""SELECT sample_id, inst_id, x0 // 128 * 128 AS tile_x, y0 // 128 * 128 AS tile_y, (x1 - x0) * (y1 - y0) AS px,
 CASE inst_id % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST((x1 - x0) * (y1 - y0) AS STRING) END AS area, score AS predicted_iou FROM {DT_BOX}""")
def b10_scalar_props(spark, sf):
    return A.scalar_props(masks(spark, sf))


@query("b11_mask_attributes", f"""SELECT x0 // 128 * 128 AS tile_x, y0 // 128 * 128 AS tile_y, score AS predicted_iou, x1 - x0 AS w, y1 - y0 AS h FROM {DT_BOX}""")
def b11_mask_attributes(spark, sf):
    m = A.mask_attributes(masks(spark, sf))
    return m.select("tile_x", "tile_y", "predicted_iou", F.col("bbox")[2].alias("w"), F.col("bbox")[3].alias("h"))


@query("b15_local_to_global", f"SELECT sample_id, inst_id, x0, y0, x1 - x0 AS w, y1 - y0 AS h, x1 AS px1, x0 AS cx, y0 AS cy FROM {DT_BOX}")
def b15_local_to_global(spark, sf):
    g = A.local_to_global(masks(spark, sf))
    b, p, c = F.col("bbox"), F.col("point_coords"), F.col("crop_box")
    return g.select(
        "sample_id", "inst_id", b[0].alias("x0"), b[1].alias("y0"), b[2].alias("w"), b[3].alias("h"), p[1][0].alias("px1"), c[0].alias("cx"), c[1].alias("cy")
    )


@query("f1_order_by_score", f"""SELECT sample_id, inst_id, ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY CAST(COALESCE(score, 0) AS FLOAT) DESC, inst_id DESC) AS pos FROM {DT_BOX}""")
def f1_order_by_score(spark, sf):
    return order_by_score(view(spark, sf, "fx_cboxes").where("side = 'dt'")).select("sample_id", "inst_id", "pos")


@query("f4_top_detections", f"""SELECT sample_id, inst_id FROM (SELECT sample_id, inst_id, ROW_NUMBER() OVER (PARTITION BY sample_id
 ORDER BY CAST(COALESCE(score, 0) AS FLOAT) DESC, inst_id DESC) AS r FROM {DT_BOX}) WHERE r <= 100""")
def f4_top_detections(spark, sf):
    return f1_order_by_score(spark, sf).where("pos <= 100").select("sample_id", "inst_id")


@query("b21_normalize_category", f"""SELECT sample_id AS image_id, inst_id AS det_id, CASE WHEN inst_id % 4 = 0 THEN 1 ELSE inst_id % 4 END AS category_id,
 CAST((x1 - x0) * (y1 - y0) AS BIGINT) AS area, x1 - x0 AS w FROM {DT_BOX}""")
def b21_normalize_category(spark, sf):
    from maskquery.operators.runs import instance_stats

    r = view(spark, sf, "fx_runs").where("side = 'dt'")
    st = instance_stats(r, ("sample_id", "inst_id")).select(
        F.col("sample_id").alias("image_id"), F.col("inst_id").alias("det_id"), "area",
        F.array("min_x", "min_y", F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")).alias("bbox"), (F.col("max_y") - F.col("min_y")).alias("n_runs"),
    )
    none = F.lit(None)
    dts = st.select("image_id", "det_id", (F.col("det_id") % 4).alias("category_id"), none.cast("bigint").alias("area"), none.cast("array<int>").alias("bbox"), "n_runs")
    out = A.normalize_category(dts, st)
    return out.select("image_id", "det_id", "category_id", "area", F.col("bbox")[2].alias("w"))
