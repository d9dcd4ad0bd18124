"""Queries of the correlation engine over the driver's tables, each with its DuckDB SQL where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels as K
from .functions import scalars as S
from .operators import aggregates as A
from .operators import asof
from .operators import filters as Fl
from .operators import matrix as M
from .operators import scaling as Sc
from .operators import validation as Va
from .operators import views as V
from .operators import windows as W
from .plans.parameters import parameter_table
from .sources.events import HOURLY_SQL
from .sources.events import SQL as BASE
from .sources.events import angle_table, events_dataset, frame_table, intensity
from .sources.tables import SQL as WIDE
from .sources.tables import customer_rows, part_frames, supplier_angles

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool | str = True):
    """Register a query under its function's name; ``sql`` continues the adapter's WITH clause (or another ``base``) or, without ``base``, stands alone."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            _SQL[f.__name__] = ((base if isinstance(base, str) else BASE) + (text if text.upper().startswith("SELECT") else ", " + text)) if base else text
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import fits

    return {**_QUERIES, **fits.queries()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r9(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 9)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_dataset(spark, sf_dir).c2


def modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells beside a fixed decaying model and a sigma."""
    return cells(spark, sf_dir).withColumns({"model": _model(), "sigma": F.lit(0.01)})


def _model() -> Column:
    return 1 + 0.05 * F.exp(-F.abs(F.col("i") - F.col("j")) / 5.0)

MODEL_SQL = "m AS (SELECT angle_idx, i, j, c2, 1 + 0.05 * exp(-abs(i - j) / 5.0) AS model, 0.01 AS sigma FROM c2)"
DIAGONAL_SQL = """side AS (SELECT angle_idx, least(i, j) AS k, sum(c2) / 2 AS s FROM c2 WHERE abs(i - j) = 1 GROUP BY 1, 2),
diag AS (SELECT angle_idx, i, avg(s) AS d FROM (SELECT angle_idx, k AS i, s FROM side UNION ALL SELECT angle_idx, k + 1, s FROM side) GROUP BY 1, 2),
fixed AS (SELECT c.angle_idx, c.i, c.j, CASE WHEN c.i = c.j THEN coalesce(d.d, c.c2) ELSE c.c2 END AS c2 FROM c2 c LEFT JOIN diag d ON d.angle_idx = c.angle_idx AND d.i = c.i)"""


def _quantiles(source: str, low: float = 0.2, high: float = 0.8, floor: float = 0.1, ceiling: float = 0.9, bounded: bool = True) -> str:
    o = "CASE WHEN n_late >= 10 THEN late_floor ELSE all_floor END"
    o = f"greatest(least({o}, 1.5), 0.5)" if bounded else o
    c = "greatest(least(top - o, 1.0), 0.0)" if bounded else "top - o"
    return f"""lags AS (SELECT angle_idx, quantile_cont(abs(i - j)::DOUBLE, {low}) AS early, quantile_cont(abs(i - j)::DOUBLE, {high}) AS late FROM {source} GROUP BY 1),
stats AS (SELECT x.angle_idx, count(*) AS n, count(*) FILTER (WHERE abs(i - j) >= late) AS n_late, quantile_cont(c2, {floor}) FILTER (WHERE abs(i - j) >= late) AS late_floor,
  quantile_cont(c2, {floor}) AS all_floor, quantile_cont(c2, {ceiling}) FILTER (WHERE abs(i - j) <= early) AS top FROM {source} x JOIN lags USING (angle_idx) GROUP BY 1),
offs AS (SELECT angle_idx, n, top, {o} AS o FROM stats),
scal AS (SELECT angle_idx, n, CASE WHEN n >= 100 THEN {c} ELSE 0.5 END AS contrast, CASE WHEN n >= 100 THEN o ELSE 1.0 END AS off FROM offs)"""


# ---- sources ----


@query("SELECT angle_idx, i, cents FROM intensity")
def event_intensity(spark, sf_dir):
    return intensity(spark, sf_dir)


@query("SELECT angle_idx, i, j, c2 FROM c2")
def correlation_cells(spark, sf_dir):
    return cells(spark, sf_dir)


@query("SELECT round(avg(q), 9) AS q_mean, round(stddev_pop(q), 9) AS q_std, count(q) AS n_q, count(phi) AS n_phi, (SELECT min(i) FROM frame) AS first_frame, (SELECT max(i) FROM frame) AS last_frame FROM angle")
def cache_metadata(spark, sf_dir):
    d = events_dataset(spark, sf_dir)
    q = d.angle.agg(r9(F.avg("q")).alias("q_mean"), r9(F.stddev_pop("q")).alias("q_std"), F.count("q").alias("n_q"), F.count("phi").alias("n_phi"))
    return q.crossJoin(d.frame.agg(F.min("i").alias("first_frame"), F.max("i").alias("last_frame")))


@query("SELECT sha256(string_agg(name || '=' || q::VARCHAR, ',' ORDER BY name)) AS cache_key FROM angle", base=WIDE)
def cache_key(spark, sf_dir):
    rows = supplier_angles(spark, sf_dir).select(F.concat_ws("=", "name", F.col("q").cast("string")).alias("kv"))
    return rows.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("kv"))), 256).alias("cache_key"))


@query("SELECT format('{:.6f}', phi) AS phi_text, format('{:.8e}', q) AS q_text FROM angle", base=WIDE)
def text_lists(spark, sf_dir):
    return supplier_angles(spark, sf_dir).select(F.format_string("%.6f", "phi").alias("phi_text"), F.format_string("%.8e", "q").alias("q_text"))


@query("SELECT ((k - 1) // 5)::INTEGER AS q_idx, ((k - 1) % 5)::INTEGER AS phi_idx, k AS processed_bin FROM (SELECT p_partkey AS k FROM part) WHERE k >= 1 AND (k - 1) // 5 < 390", base=WIDE)
def bin_decode(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return Fl.decode_bins(parts.select(F.col("p_partkey").alias("processed_bin")), 390, 5)


@query("near AS (SELECT a.*, abs(a.q - 0.0068) AS gap FROM angle a), best AS (SELECT arg_min(q, gap) AS q0 FROM near), ok AS (SELECT count(*) FILTER (WHERE abs(q - q0) <= 0.1 * q0) AS n FROM near, best), top AS (SELECT angle_idx FROM near ORDER BY gap, angle_idx LIMIT 3) SELECT angle_idx, name, q, phi FROM near, best, ok WHERE (n >= 2 AND abs(q - q0) <= 0.1 * q0) OR (n < 2 AND angle_idx IN (SELECT angle_idx FROM top))", base=WIDE)
def legacy_q_selection(spark, sf_dir):
    return Fl.near_q(supplier_angles(spark, sf_dir), 0.0068, least=2, fallback=3)


# ---- filters ----


@query("SELECT count(*) FILTER (WHERE q BETWEEN 0.006 AND 0.008) AS selected, count(*) AS total, count(*) FILTER (WHERE q BETWEEN 0.006 AND 0.008) / count(*) AS fraction, min(q) AS data_min, max(q) AS data_max FROM angle", base=WIDE)
def q_range_filter(spark, sf_dir):
    return Fl.filter_statistics(supplier_angles(spark, sf_dir), "q", Fl.q_range(F.col("q"), 0.006, 0.008))


@query("SELECT * FROM angle WHERE phi >= 170 OR phi <= -160", base=WIDE)
def phi_range_wrap(spark, sf_dir):
    return supplier_angles(spark, sf_dir).where(S.angle_between(F.col("phi"), 170.0, -160.0))


@query("SELECT * FROM angle WHERE phi BETWEEN -10 AND 90", base=WIDE)
def angle_in_range(spark, sf_dir):
    return supplier_angles(spark, sf_dir).where(S.angle_between(F.col("phi"), -10.0, 90.0))


@query("SELECT angle_idx, CASE WHEN ((a % 360) + 360) % 360 > 180 THEN ((a % 360) + 360) % 360 - 360 ELSE ((a % 360) + 360) % 360 END AS phi FROM (SELECT angle_idx, phi * 3 - 370 AS a FROM angle)", base=WIDE)
def normalise_angles(spark, sf_dir):
    return supplier_angles(spark, sf_dir).select("angle_idx", S.normalise_angle(F.col("phi") * 3 - 370).alias("phi"))


_RANGES = [(-10.0, 10.0), (170.0, -165.0)]
_RANGE_SQL = "ranges(min_angle, max_angle) AS (VALUES (-10.0::DOUBLE, 10.0::DOUBLE), (170.0::DOUBLE, -165.0::DOUBLE))"
_IN_RANGE = "CASE WHEN min_angle <= max_angle THEN phi BETWEEN min_angle AND max_angle ELSE phi >= min_angle OR phi <= max_angle END"


@query(f"{_RANGE_SQL} SELECT * FROM angle WHERE EXISTS (SELECT 1 FROM ranges WHERE {_IN_RANGE})", base=WIDE)
def multi_range_angles(spark, sf_dir):
    return Fl.semi_join_ranges(supplier_angles(spark, sf_dir), spark.createDataFrame(_RANGES, "min_angle double, max_angle double"))


@query("turned AS (SELECT *, ((phi % 360) + 360) % 360 AS m FROM angle), kept AS (SELECT angle_idx FROM turned WHERE m <= 10 OR m >= 350 OR m BETWEEN 170 AND 190) SELECT * FROM angle WHERE angle_idx IN (FROM kept) OR NOT EXISTS (FROM kept)", base=WIDE)
def angles_for_optimisation(spark, sf_dir):
    return Fl.select_angles(supplier_angles(spark, sf_dir), Fl.DEFAULT_RANGES, normalise=True)


@query("kept AS (SELECT angle_idx FROM angle WHERE phi BETWEEN -10 AND 10 OR phi BETWEEN 80 AND 100 OR phi BETWEEN 170 AND 190 OR phi BETWEEN 260 AND 280) SELECT * FROM angle WHERE angle_idx IN (FROM kept) OR NOT EXISTS (FROM kept)", base=WIDE)
def anisotropic_angles(spark, sf_dir):
    return Fl.select_angles(supplier_angles(spark, sf_dir), Fl.ANISOTROPIC_RANGES)


@query("SELECT * FROM angle", base=WIDE)
def fallback_on_empty(spark, sf_dir):
    return Fl.or_all(supplier_angles(spark, sf_dir), Fl.q_range(F.col("q"), 0.5, 0.6))


@query("SELECT angle_idx, (q >= 0.006) AND (phi > 0) AS both_masks, (q >= 0.006) OR (phi > 0) AS either_mask FROM angle", base=WIDE)
def mask_combination(spark, sf_dir):
    masks = {"q": Fl.q_range(F.col("q"), 0.006), "phi": F.col("phi") > 0}
    return supplier_angles(spark, sf_dir).select("angle_idx", Fl.combine(masks, "AND").alias("both_masks"), Fl.combine(masks, "OR").alias("either_mask"))


@query("SELECT count(*) FILTER (WHERE idx < 0) AS negative, count(*) FILTER (WHERE idx >= 100) AS too_large, count(idx) - count(DISTINCT idx) AS repeated FROM (SELECT l_suppkey - 5 AS idx FROM lineitem)", base=True)
def index_sanity(spark, sf_dir):
    return Fl.index_sanity(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") - 5).alias("idx")), 100)


@query("SELECT count(*) AS total, min(phi) AS phi_min, max(phi) AS phi_max, avg(phi) AS phi_mean, round(stddev_pop(phi), 9) AS phi_std FROM angle", base=WIDE)
def angle_statistics(spark, sf_dir):
    out = Fl.angle_statistics(supplier_angles(spark, sf_dir), spark.createDataFrame(_RANGES, "min_angle double, max_angle double"))[0]
    return out.withColumn("phi_std", r9("phi_std"))


@query(f"{_RANGE_SQL} SELECT min_angle, max_angle, count(angle_idx) AS n, 100.0 * count(angle_idx) / (SELECT count(*) FROM angle) AS percent FROM ranges LEFT JOIN angle ON {_IN_RANGE} GROUP BY 1, 2", base=WIDE)
def angle_range_counts(spark, sf_dir):
    return Fl.angle_statistics(supplier_angles(spark, sf_dir), spark.createDataFrame(_RANGES, "min_angle double, max_angle double"))[1]


@query("want(w) AS (VALUES (5.4::DOUBLE), (84.2::DOUBLE)), near AS (SELECT w, arg_min(angle_idx, abs(phi - w)) AS angle_idx, min(abs(phi - w)) AS gap FROM angle, want GROUP BY w) SELECT * FROM angle WHERE (SELECT max(gap) FROM near) > 1.0 OR angle_idx IN (SELECT angle_idx FROM near)", base=WIDE)
def requested_angles(spark, sf_dir):
    return Fl.subset_by_request(supplier_angles(spark, sf_dir), spark.createDataFrame([(5.4,), (84.2,)], "want double"))


@query("SELECT angle_idx, i - 4 AS i, j - 4 AS j, c2 FROM c2 WHERE i >= 4 AND j >= 4 AND i < 20 AND j < 20")
def frame_slice(spark, sf_dir):
    return Fl.slice_frames(cells(spark, sf_dir), 5, 20)


@query("SELECT * FROM angle ORDER BY abs(q - 0.0064), angle_idx LIMIT 1", base=WIDE)
def nearest_wavevector(spark, sf_dir):
    return Fl.nearest(supplier_angles(spark, sf_dir), "q", 0.0064, "angle_idx")


@query("SELECT * FROM angle ORDER BY abs(q - 0.0064), angle_idx LIMIT 3", base=WIDE)
def nearest_wavevectors(spark, sf_dir):
    return Fl.nearest_k(supplier_angles(spark, sf_dir), "q", 0.0064, "angle_idx", 3)


@query("SELECT angle_idx, i, j, c2 FROM c2 WHERE i > 0 AND j > 0 AND i <> j")
def off_diagonal_cells(spark, sf_dir):
    return Fl.off_diagonal(cells(spark, sf_dir))


@query("SELECT angle_idx, i, j, c2 FROM c2 WHERE i > 0 AND j > 0")
def without_first_frame(spark, sf_dir):
    return Fl.drop_first_frame(cells(spark, sf_dir))


@query(f"{MODEL_SQL} SELECT angle_idx, i, j, CASE WHEN i = j THEN 0.0 ELSE round((c2 - model) / sigma, 9) END AS residual FROM m")
def masked_residuals(spark, sf_dir):
    return modelled(spark, sf_dir).select("angle_idx", "i", "j", Fl.masked_residual(r9((F.col("c2") - F.col("model")) / F.col("sigma"))).alias("residual"))


@query("SELECT angle_idx, i, j, c2 FROM c2 WHERE i <= j")
def upper_triangle(spark, sf_dir):
    return Fl.upper_triangle(cells(spark, sf_dir))


@query("half AS (SELECT * FROM c2 WHERE i <= j) SELECT angle_idx, i, j, c2 FROM half UNION ALL SELECT angle_idx, j, i, c2 FROM half WHERE i < j")
def mirrored_triangle(spark, sf_dir):
    return Fl.mirror(Fl.upper_triangle(cells(spark, sf_dir)))


@query("half AS (SELECT * FROM c2 WHERE i <= j), uu AS (SELECT angle_idx, i, j, c2 FROM half UNION ALL SELECT angle_idx, j, i, c2 FROM half) SELECT angle_idx, i, j, CASE WHEN i = j THEN sum(c2) / 2 ELSE sum(c2) END AS c2 FROM uu GROUP BY 1, 2, 3")
def half_to_full(spark, sf_dir):
    return Fl.half_to_full(Fl.upper_triangle(cells(spark, sf_dir)))


@query("skew AS (SELECT angle_idx, i, j, c2 + 0.25 * i AS c2 FROM c2) SELECT a.angle_idx, a.i, a.j, round((a.c2 + b.c2) / 2, 9) AS c2 FROM skew a JOIN skew b ON a.angle_idx = b.angle_idx AND a.i = b.j AND a.j = b.i")
def symmetrised(spark, sf_dir):
    return Fl.symmetrise(cells(spark, sf_dir).withColumn("c2", F.col("c2") + 0.25 * F.col("i"))).withColumn("c2", r9("c2"))


@query("SELECT vec_id, (p - 1)::INTEGER AS pos, embedding[p]::DOUBLE AS x FROM embeddings, range(1, 65) r(p) WHERE p <= len(embedding)")
def unpivot_arrays(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


@query("SELECT angle_idx, i, j, c2, 0.01::DOUBLE AS sigma, TRUE AS sigma_is_default FROM c2")
def default_sigma(spark, sf_dir):
    return Fl.with_defaults(cells(spark, sf_dir))


@query("SELECT angle_idx AS idx, phi AS angle, q AS wavevector FROM angle", base=WIDE)
def column_aliases(spark, sf_dir):
    return supplier_angles(spark, sf_dir).select(F.col("angle_idx").alias("idx"), F.col("phi").alias("angle"), F.col("q").alias("wavevector"))


# ---- joins ----


@query("SELECT c.angle_idx, c.i, c.j, c.c2, a.t AS t1, b.t AS t2 FROM c2 c JOIN frame a ON a.i = c.i JOIN frame b ON b.i = c.j")
def grid_lookup(spark, sf_dir):
    d = events_dataset(spark, sf_dir)
    f = F.broadcast(d.frame)
    return d.c2.join(f.withColumnRenamed("t", "t1"), "i").join(f.select(F.col("i").alias("j"), F.col("t").alias("t2")), "j").select("angle_idx", "i", "j", "c2", "t1", "t2")


@query("p AS (SELECT o_orderkey, (o_orderkey % 291) / 10.0 AS t FROM orders) SELECT o_orderkey, min(f.i) AS i FROM p JOIN frame f ON f.t >= p.t GROUP BY 1")
def ceiling_lookup(spark, sf_dir):
    """As-of join forward on a regular grid: the key is computed, so it is an equi-join."""
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", ((F.col("o_orderkey") % 291) / 10.0).alias("t"))
    return p.withColumn("i", F.ceil("t").cast("int")).join(F.broadcast(frame_table(spark, 30).select("i")), "i").select("o_orderkey", "i")


@query("SELECT angle_idx, k, count(*) AS n, round(sum(c2), 9) AS total FROM (SELECT angle_idx, i AS k, c2 FROM c2 WHERE i <> j AND abs(i - j) <= 3 UNION ALL SELECT angle_idx, j, c2 FROM c2 WHERE i <> j AND abs(i - j) <= 3) GROUP BY 1, 2")
def diagonal_neighbours(spark, sf_dir):
    return M._band(cells(spark, sf_dir), 3).groupBy("angle_idx", F.col("at").alias("k")).agg(F.count(F.lit(1)).alias("n"), r9(F.sum("c2")).alias("total"))


@query("SELECT a.i, b.i AS j, a.t * b.t AS product, a.t - b.t AS difference FROM frame a, frame b", base=WIDE)
def outer_products(spark, sf_dir):
    p = K.frame_pairs(part_frames(spark, sf_dir), ["t"])
    return p.select("i", "j", (F.col("t_i") * F.col("t_j")).alias("product"), (F.col("t_i") - F.col("t_j")).alias("difference"))


@query("SELECT angle_idx, i, j, round((0.1 + 0.05 * angle_idx) * c2 + 1, 9) AS scaled FROM c2")
def scaling_gather(spark, sf_dir):
    s = angle_table(spark).select("angle_idx", (0.1 + 0.05 * F.col("angle_idx")).alias("contrast"))
    return cells(spark, sf_dir).join(F.broadcast(s), "angle_idx").select("angle_idx", "i", "j", r9(F.col("contrast") * F.col("c2") + 1).alias("scaled"))


@query("SELECT angle_idx FROM angle WHERE q >= 0.006 INTERSECT SELECT angle_idx FROM angle WHERE phi > 0", base=WIDE)
def index_intersection(spark, sf_dir):
    a = supplier_angles(spark, sf_dir)
    return a.where("q >= 0.006").select("angle_idx").intersect(a.where("phi > 0").select("angle_idx"))


@query("wanted AS (SELECT p_partkey AS part, ['D0', 'alpha', 'phi0', 'contrast', 'unknown'][p_partkey % 5 + 1] AS name FROM part), param(name, lower, upper) AS (VALUES ('D0', 100.0::DOUBLE, 100000.0::DOUBLE), ('alpha', -2.0::DOUBLE, 2.0::DOUBLE), ('phi0', -10.0::DOUBLE, 10.0::DOUBLE), ('contrast', 0.0::DOUBLE, 1.0::DOUBLE)) SELECT part, name, lower, upper FROM wanted JOIN param USING (name)", base=WIDE)
def parameter_bounds(spark, sf_dir):
    names = F.array(*(F.lit(n) for n in ("D0", "alpha", "phi0", "contrast", "unknown")))
    wanted = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("part"), F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("name"))
    return wanted.join(F.broadcast(parameter_table(spark)), "name").select("part", "name", "lower", "upper")  # a row a parameter


@query("SELECT a.angle_idx, a.i, a.j, a.c2, b.c2 AS c2t FROM c2 a JOIN c2 b ON a.angle_idx = b.angle_idx AND a.i = b.j AND a.j = b.i")
def transpose_join(spark, sf_dir):
    c = cells(spark, sf_dir)
    return c.join(Fl.transpose(c), ["angle_idx", "i", "j"])


# ---- aggregations and quality ----


@query("n AS (SELECT l_suppkey::INTEGER AS angle_idx, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS total, max(n) AS most, min(n) AS least FROM n) SELECT angle_idx, n, n / total AS fraction, most / least AS imbalance, most / least < 5 AS balanced FROM n, t")
def angle_distribution(spark, sf_dir):
    return A.angle_distribution(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").cast("int").alias("angle_idx")))


@query("SELECT count(*) AS n, round(avg(c2), 9) AS mean, round(stddev_pop(c2), 9) AS std, min(c2) AS least, max(c2) AS most, 1.0::DOUBLE AS finite_fraction, round(sum(c2), 6) AS total, arg_min(c2, (angle_idx, i, j)) AS first_value, arg_max(c2, (angle_idx, i, j)) AS last_value FROM c2")
def array_statistics(spark, sf_dir):
    return A.array_statistics(cells(spark, sf_dir)).withColumns({"mean": r9("mean"), "std": r9("std"), "total": F.round("total", 6)})


@query("SELECT round(greatest(least(1 - 0.2 * (count(*) FILTER (WHERE c2 < 0.85)) - 0.05 * 2 + 0.1 - 0.1 * 0.0 + 0.1, 1.0), 0.0), 9) AS score FROM c2")
def validation_score(spark, sf_dir):
    s = cells(spark, sf_dir).agg(F.sum((F.col("c2") < 0.85).cast("long")).alias("errors"))
    return s.select(r9(A.validation_score(F.col("errors"), F.lit(2), F.lit(True), F.lit(0.0), F.lit(True))).alias("score"))


@query("SELECT angle_idx, round(avg(c2), 9) AS mean, CASE WHEN avg(c2) BETWEEN 0.5 AND 3 THEN 85.0::DOUBLE WHEN avg(c2) BETWEEN 0.1 AND 5 THEN 60.0::DOUBLE ELSE 30.0::DOUBLE END AS range_score, round(least(10 * avg(c2) / stddev_pop(c2), 100.0), 9) AS snr_score FROM c2 GROUP BY 1")
def basic_quality(spark, sf_dir):
    return A.basic_quality(cells(spark, sf_dir)).withColumns({"mean": r9("mean"), "snr_score": r9("snr_score")})


_GAP_SQL = "skew AS (SELECT angle_idx, i, j, c2 + 0.001 * i AS c2 FROM c2), gap AS (SELECT a.angle_idx, avg(abs(a.c2 - b.c2)) AS g, max(abs(a.c2)) AS m FROM skew a JOIN skew b ON a.angle_idx = b.angle_idx AND a.i = b.j AND a.j = b.i GROUP BY 1)"


def _skew(spark, sf_dir):
    return cells(spark, sf_dir).withColumn("c2", F.col("c2") + 0.001 * F.col("i"))


@query(_GAP_SQL + ", dec AS (SELECT angle_idx, max(c2) FILTER (WHERE i = 0 AND j = 0) AS d0, max(c2) FILTER (WHERE i = 10 AND j = 10) AS d10 FROM skew GROUP BY 1) SELECT angle_idx, round(100 * (1 - g / m), 9) AS symmetry, round(CASE WHEN (d0 - d10) / d0 BETWEEN 0 AND 1 THEN (d0 - d10) / d0 END, 9) AS decay FROM gap JOIN dec USING (angle_idx)")
def symmetry_and_decay(spark, sf_dir):
    return A.symmetry_and_decay(_skew(spark, sf_dir)).select("angle_idx", r9("symmetry").alias("symmetry"), r9("decay").alias("decay"))


@query(_GAP_SQL + ", s AS (SELECT angle_idx, max(c2) FILTER (WHERE i = 0 AND j = 0) AS d, avg(c2) AS mean FROM skew GROUP BY 1) SELECT angle_idx, round(0.4 + 0.3 * CASE WHEN d BETWEEN 0.5 AND 2 THEN 1.0 ELSE 0.5 END + 0.2 * greatest(1 - 100 * g, 0.0) + 0.1 * CASE WHEN mean BETWEEN 0.1 AND 5 THEN 1.0 ELSE 0.5 END, 9) AS score FROM gap JOIN s USING (angle_idx)")
def matrix_quality(spark, sf_dir):
    return A.matrix_quality(_skew(spark, sf_dir)).withColumn("score", r9("score"))


@query("SELECT angle_idx, count(*) AS n FROM c2 WHERE angle_idx IN (SELECT angle_idx FROM c2 WHERE i = 0 AND j = 0 AND c2 BETWEEN 0.5 AND 2) GROUP BY 1")
def quality_filtered(spark, sf_dir):
    return A.quality_filter(cells(spark, sf_dir), 0.95).groupBy("angle_idx").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT angle_idx, round(0.3 * 100.0 + 0.4 * 90.0 + 0.2 * least(10 * avg(c2) / stddev_pop(c2), 100.0) + 0.1 * 50.0, 9) AS readiness, round(greatest(least(0.2 * 100 + 0.25 * 90 + 0.2 * least(10 * avg(c2) / stddev_pop(c2), 100.0) + 0.15 * 85 + 0.1 * 50 + 0.1 * 100 - 10 - 5 * 2 + 5, 100.0), 0.0), 9) AS overall FROM c2 GROUP BY 1")
def quality_scores(spark, sf_dir):
    q = A.basic_quality(cells(spark, sf_dir))
    snr = F.col("snr_score")
    overall = A.overall_quality([F.lit(100.0), F.lit(90.0), snr, F.lit(85.0), F.lit(50.0), F.lit(100.0)], F.lit(1), F.lit(2), F.lit(1))
    return q.select("angle_idx", r9(A.readiness(F.lit(100.0), F.lit(90.0), snr, F.lit(50.0))).alias("readiness"), r9(overall).alias("overall"))


@query("st(stage, k) AS (VALUES ('raw', 0), ('filtered', 1), ('final', 2)), q AS (SELECT stage, k, round(avg(c2) FILTER (WHERE k = 0 OR (k = 1 AND i <> j) OR (k = 2 AND i > 0 AND j > 0 AND i <> j)), 9) AS mean FROM c2, st GROUP BY 1, 2) SELECT stage, mean, round(mean - lag(mean) OVER (ORDER BY k), 9) AS change FROM q")
def stage_evolution(spark, sf_dir):
    from pyspark.sql import Window

    c = cells(spark, sf_dir)
    stages = [("raw", c), ("filtered", Fl.off_diagonal(c, drop_first_frame=False)), ("final", Fl.off_diagonal(c))]
    out = None
    for k, (name, d) in enumerate(stages):
        row = d.agg(r9(F.avg("c2")).alias("mean")).select(F.lit(name).alias("stage"), F.lit(k).alias("k"), "mean")
        out = row if out is None else out.unionByName(row)
    return out.select("stage", "mean", r9(F.col("mean") - F.lag("mean").over(Window.orderBy("k"))).alias("change"))


@query(f"{MODEL_SQL} SELECT angle_idx, round(sum(((c2 - model) / sigma) ** 2), 6) AS chi2, count(*) AS n FROM m GROUP BY 1")
def chi_squared(spark, sf_dir):
    return A.chi_squared(modelled(spark, sf_dir), ["angle_idx"]).withColumn("chi2", F.round("chi2", 6))


@query("p(param_id, amplitude) AS (VALUES (0, 0.01::DOUBLE), (1, 0.05::DOUBLE), (2, 0.1::DOUBLE)) SELECT param_id, round(sum(((c2 - (1 + amplitude * exp(-abs(i - j) / 5.0))) / 0.01) ** 2), 6) AS chi2, count(*) AS n FROM c2, p GROUP BY 1")
def batch_chi_squared(spark, sf_dir):
    p = F.broadcast(spark.createDataFrame([(0, 0.01), (1, 0.05), (2, 0.1)], "param_id int, amplitude double"))
    c = cells(spark, sf_dir).crossJoin(p).withColumns({"model": 1 + F.col("amplitude") * F.exp(-F.abs(F.col("i") - F.col("j")) / 5.0), "sigma": F.lit(0.01)})
    return A.chi_squared(c, ["param_id"]).withColumn("chi2", F.round("chi2", 6))


@query(f"{MODEL_SQL}, s AS (SELECT angle_idx, sum((c2 - model) ** 2) AS ss, var_pop(c2) FILTER (WHERE abs(i - j) >= 15) AS v FROM m WHERE i <> j GROUP BY 1) SELECT angle_idx, round(ss, 9) AS chi2, 867::BIGINT AS dof, round(ss / v / 867, 9) AS reduced FROM s")
def reduced_chi_squared(spark, sf_dir):
    return A.per_angle_reduced(modelled(spark, sf_dir), 3).select("angle_idx", r9("chi2").alias("chi2"), "dof", r9("reduced").alias("reduced"))


@query("d AS (SELECT l_returnflag AS g, l_quantity AS a, l_tax AS b, l_extendedprice / 1000 AS r FROM lineitem) SELECT g, round(sum(a * a), 3) AS g_0_0, round(sum(a * b), 3) AS g_0_1, round(sum(b * b), 3) AS g_1_1, round(sum(a * r), 3) AS h_0, round(sum(b * r), 3) AS h_1, round(sum(r * r), 3) AS chi2, count(*) AS n FROM d GROUP BY 1")
def normal_equations(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"), (F.col("l_extendedprice") / 1000).alias("r"))
    out = A.normal_equations(d, ["a", "b"], "r", ["g"])
    return out.select("g", *(F.round(c, 3).alias(c) for c in ("g_0_0", "g_0_1", "g_1_1", "h_0", "h_1", "chi2")), "n")


@query(f"{MODEL_SQL} SELECT angle_idx, round(regr_slope(c2, model), 9) AS contrast, round(regr_intercept(c2, model), 9) AS off FROM m GROUP BY 1")
def least_squares_scaling(spark, sf_dir):
    return A.least_squares_scaling(modelled(spark, sf_dir)).select("angle_idx", r9("contrast").alias("contrast"), r9("offset").alias("off"))


@query(f"{MODEL_SQL}, f AS (SELECT angle_idx, regr_slope(c2, model) AS s, regr_intercept(c2, model) AS o FROM m GROUP BY 1) SELECT round(avg(s), 9) AS contrast, round(avg(o), 9) AS off FROM f")
def consistent_scaling(spark, sf_dir):
    return A.least_squares_scaling(modelled(spark, sf_dir)).agg(r9(F.avg("contrast")).alias("contrast"), r9(F.avg("offset")).alias("off"))


@query("e AS (SELECT 'p' || (l_suppkey % 7)::VARCHAR AS param, l_quantity AS value, l_discount + 0.01 AS variance, l_linenumber AS n_points FROM lineitem) SELECT param, round(sum(value / greatest(variance, 1e-10)) / sum(1 / greatest(variance, 1e-10)), 9) AS value, round(1 / sum(1 / (variance + 1e-10)), 12) AS variance FROM e GROUP BY 1")
def combined_estimates(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("p"), (F.col("l_suppkey") % 7).cast("string")).alias("param"), F.col("l_quantity").alias("value"), (F.col("l_discount") + 0.01).alias("variance"), F.col("l_linenumber").alias("n_points"))
    return A.combine_estimates(e).select("param", r9("value").alias("value"), F.round("variance", 12).alias("variance"))


@query("SELECT avg((o_orderstatus = 'F')::INTEGER) AS success_rate, avg((o_orderstatus = 'F')::INTEGER) >= 0.5 AS passes FROM orders")
def success_rate(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("success_rate"))
    return s.withColumn("passes", F.col("success_rate") >= 0.5)


@query("b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS batch, o_orderstatus = 'F' AS success, o_totalprice AS loss, o_custkey AS iterations FROM orders) SELECT batch, avg(success::INTEGER) OVER w AS success_rate, round(avg(loss) OVER w, 6) AS mean_loss, round(avg(iterations) OVER w, 6) AS mean_iterations FROM b WINDOW w AS (ORDER BY batch ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def ring_statistics(spark, sf_dir):
    o = W.numbered(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey"), "o_orderkey", "batch").select("batch", (F.col("o_orderstatus") == "F").alias("success"), F.col("o_totalprice").alias("loss"), F.col("o_custkey").alias("iterations"))
    return W.ring_statistics(o).withColumns({"mean_loss": F.round("mean_loss", 6), "mean_iterations": F.round("mean_iterations", 6)})


@query("s AS (SELECT count(*) FILTER (WHERE c2 < 0) AS neg, avg(c2) AS mean, stddev_pop(c2) AS sd FROM (SELECT c2 - 0.9 AS c2 FROM c2)) SELECT 'warning' AS severity, 'sign' AS category, 'negative correlation' AS message, 'c2' AS parameter, neg::DOUBLE AS value FROM s WHERE neg > 0 UNION ALL SELECT 'warning', 'statistics', 'mean outside 0.5 to 2', 'c2', round(mean, 9) FROM s WHERE NOT mean BETWEEN 0.5 AND 2 UNION ALL SELECT 'info', 'statistics', 'std above mean', 'c2', round(sd, 9) FROM s WHERE sd > mean")
def validation_issues(spark, sf_dir):
    return A.issues(cells(spark, sf_dir).withColumn("c2", F.col("c2") - 0.9)).withColumn("value", r9("value"))


@query("SELECT a.angle_idx, bool_and(abs(a.c2 - b.c2) <= 1e-10 + 1e-5 * abs(b.c2)) AS symmetric, max(a.c2) FILTER (WHERE a.i = 0 AND a.j = 1) BETWEEN 0.5 AND 2 AS near_zero_lag_ok FROM c2 a JOIN c2 b ON a.angle_idx = b.angle_idx AND a.i = b.j AND a.j = b.i GROUP BY 1")
def correlation_checks(spark, sf_dir):
    return A.correlation_checks(cells(spark, sf_dir))


@query("p AS (SELECT i::VARCHAR AS param, (i % 5) / 4.0::DOUBLE AS value, 0.0::DOUBLE AS lower, 1.0::DOUBLE AS upper FROM person) SELECT *, CASE WHEN abs(value - lower) <= 1e-8 THEN 'at_lower' WHEN abs(value - upper) <= 1e-8 THEN 'at_upper' ELSE 'active' END AS status FROM p", base=WIDE)
def parameter_status(spark, sf_dir):
    p = customer_rows(spark, sf_dir).select(F.col("i").cast("string").alias("param"), (F.col("i") % 5 / 4.0).alias("value"), F.lit(0.0).alias("lower"), F.lit(1.0).alias("upper"))
    return V.parameter_status(p)


@query("SELECT angle_idx, round(CASE WHEN abs(avg(c2)) > 1e-10 THEN stddev_pop(c2) / abs(avg(c2)) ELSE stddev_pop(c2) END, 9) AS cv FROM c2 GROUP BY 1")
def variation_coefficient(spark, sf_dir):
    s, m = F.stddev_pop("c2"), F.abs(F.avg("c2"))
    return cells(spark, sf_dir).groupBy("angle_idx").agg(r9(F.when(m > 1e-10, s / m).otherwise(s)).alias("cv"))


@query("SELECT angle_idx, bool_and(c2 BETWEEN -10 AND 100) AS clean FROM c2 GROUP BY 1")
def artefact_check(spark, sf_dir):
    return A.artefact_free(cells(spark, sf_dir))


@query("SELECT count(*) FILTER (WHERE i > 0 AND j > 0 AND i <> j)::DOUBLE / count(*) AS retention, 1.0::DOUBLE AS fidelity FROM c2")
def retention(spark, sf_dir):
    c = cells(spark, sf_dir)
    return A.retention(c, Fl.off_diagonal(c))


_HOLES = "holes AS (SELECT angle_idx, i, j, CASE WHEN (i * 7 + j) % 11 = 0 THEN 'nan'::DOUBLE WHEN (i + j) % 13 = 0 THEN -c2 ELSE c2 END AS c2 FROM c2)"


def _holes(spark, sf_dir):
    x = F.when((F.col("i") * 7 + F.col("j")) % 11 == 0, F.lit(float("nan"))).when((F.col("i") + F.col("j")) % 13 == 0, -F.col("c2")).otherwise(F.col("c2"))
    return cells(spark, sf_dir).withColumn("c2", x)


@query(f"{_HOLES}, med AS (SELECT angle_idx, median(c2) AS m FROM holes WHERE NOT isnan(c2) GROUP BY 1) SELECT angle_idx, i, j, round(CASE WHEN isnan(c2) THEN m ELSE c2 END, 9) AS c2 FROM holes JOIN med USING (angle_idx)")
def repair_conservative(spark, sf_dir):
    return A.repair(_holes(spark, sf_dir)).withColumn("c2", r9("c2"))


@query(f"{_HOLES}, med AS (SELECT angle_idx, median(c2) AS m FROM holes WHERE NOT isnan(c2) GROUP BY 1), f AS (SELECT angle_idx, i, j, CASE WHEN isnan(c2) THEN m ELSE c2 END AS c2 FROM holes JOIN med USING (angle_idx)) SELECT angle_idx, i, j, round(CASE WHEN c2 < 0 THEN 1e-6 ELSE c2 END, 9) AS c2 FROM f")
def repair_aggressive(spark, sf_dir):
    return A.repair(_holes(spark, sf_dir), "aggressive").withColumn("c2", r9("c2"))


# ---- quantiles ----


@query(f"{DIAGONAL_SQL}, chosen AS (SELECT f.* FROM fixed f JOIN angle USING (angle_idx) WHERE phi >= 170 OR phi <= -160 OR phi BETWEEN -10 AND 10), {_quantiles('chosen')} SELECT angle_idx, n, round(contrast, 9) AS contrast, round(off, 9) AS off FROM scal")
def contrast_offset(spark, sf_dir):
    """The flagship: angle selection, diagonal correction, contrast and offset per angle."""
    d = events_dataset(spark, sf_dir)
    phi = F.col("phi")
    chosen = d.angle.where(S.angle_between(phi, 170.0, -160.0) | S.angle_between(phi, -10.0, 10.0)).select("angle_idx")
    fixed = M.diagonal_basic(d.c2.join(F.broadcast(chosen), "angle_idx", "left_semi"))
    return Sc.quantile_scaling(fixed).select("angle_idx", "n", r9("contrast").alias("contrast"), r9("offset").alias("off"))


@query(f"{_quantiles('c2')} SELECT angle_idx, n, round(contrast, 9) AS contrast, round(off, 9) AS off FROM scal")
def quantile_scaling(spark, sf_dir):
    return Sc.quantile_scaling(cells(spark, sf_dir)).select("angle_idx", "n", r9("contrast").alias("contrast"), r9("offset").alias("off"))


@query(f"{_quantiles('c2')} SELECT round(avg(contrast), 9) AS contrast, round(avg(off), 9) AS off FROM scal")
def averaged_scaling(spark, sf_dir):
    return Sc.averaged_scaling(Sc.quantile_scaling(cells(spark, sf_dir))).select(r9("contrast").alias("contrast"), r9("offset").alias("off"))


@query(f"{_quantiles('c2', floor=0.05, ceiling=0.95, bounded=False)} SELECT angle_idx, n, round(contrast, 9) AS contrast, round(off, 9) AS off, n >= 100 AS complete FROM scal")
def strict_scaling(spark, sf_dir):
    return Sc.strict_scaling(cells(spark, sf_dir)).select("angle_idx", "n", r9("contrast").alias("contrast"), r9("offset").alias("off"), "complete")


@query("SELECT round(max(c2) - quantile_cont(c2, 0.05), 9) AS contrast, round(quantile_cont(c2, 0.05), 9) AS off FROM c2")
def global_scaling(spark, sf_dir):
    return Sc.global_scaling(cells(spark, sf_dir)).select(r9("contrast").alias("contrast"), r9("offset").alias("off"))


@query("SELECT round(quantile_cont(c2, 0.01), 9) AS lo, round(quantile_cont(c2, 0.99), 9) AS hi FROM c2")
def colour_limits(spark, sf_dir):
    return Sc.colour_limits(cells(spark, sf_dir)).select(r9("lo").alias("lo"), r9("hi").alias("hi"))


@query(f"{MODEL_SQL} SELECT round(quantile_cont(abs(c2 - model), 0.99), 9) AS lim FROM m")
def residual_limit(spark, sf_dir):
    return Sc.residual_limit(V.comparison(modelled(spark, sf_dir))).select(r9("limit").alias("lim"))


# ---- ordered ----

_RATE = "r AS (SELECT i, t, greatest(1000 * pow(greatest(t, 0.5), 0.5) + 10, 1e-10) AS v FROM frame), mids AS (SELECT i, coalesce((lag(v) OVER (ORDER BY i) + v) / 2, 0.0) AS m FROM r), cum AS (SELECT i, sum(m) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM mids)"


def _cumulative(spark, sf_dir):
    f = part_frames(spark, sf_dir).withColumn("v", S.rate(F.col("t"), 1000.0, 0.5, 10.0, 1.0))
    return K.cumulative_trapezoid(f, "v", "c")


@query(f"{_RATE} SELECT i, round(c, 6) AS c FROM cum", base=WIDE)
def cumulative_integral(spark, sf_dir):
    return _cumulative(spark, sf_dir).select("i", F.round("c", 6).alias("c"))


@query(f"{_RATE} SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN 0.0 ELSE round(sqrt((a.c - b.c) * (a.c - b.c) + 1e-12), 6) END AS integral, round(b.c - a.c, 6) AS signed FROM cum a, cum b", base=WIDE)
def integral_matrices(spark, sf_dir):
    p = K.frame_pairs(_cumulative(spark, sf_dir), ["c"])
    d = F.col("c_i") - F.col("c_j")
    return p.select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.round(K.time_integral(d), 6)).alias("integral"), F.round(-d, 6).alias("signed"))


@query("SELECT bool_and(t >= before) AS monotone FROM (SELECT t, lag(t, 1, t) OVER (ORDER BY i) AS before FROM frame)", base=WIDE)
def monotone_time(spark, sf_dir):
    return W.is_monotone(part_frames(spark, sf_dir))


@query("s AS (SELECT s_suppkey AS start, s_acctbal AS cost FROM supplier), k AS (SELECT greatest(3, floor(count(*) * 0.5)) AS k FROM s), rk AS (SELECT *, row_number() OVER (ORDER BY cost, start)::INTEGER AS rank FROM s) SELECT start, cost, rank FROM rk, k WHERE rank <= k")
def kept_starts(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("start"), F.col("s_acctbal").alias("cost"))
    return W.keep_best(s)


@query("SELECT arg_min(s_suppkey, s_acctbal) AS start, min(s_acctbal) AS chi2 FROM supplier WHERE s_nationkey < 12")
def best_start(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("start"), F.col("s_acctbal").alias("chi2"), (F.col("s_nationkey") < 12).alias("success"))
    return W.best_result(s)


_HISTORY = "h AS (SELECT event_id AS step, value, value > 60 AS triggered FROM events)"


def _history(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("step"), "value", (F.col("value") > 60).alias("triggered"))


@query(f"{_HISTORY}, g AS (SELECT *, row_number() OVER (ORDER BY step) - sum(triggered::INTEGER) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING) AS island FROM h), r AS (SELECT step, value, triggered, CASE WHEN triggered THEN sum(triggered::INTEGER) OVER (PARTITION BY island ORDER BY step ROWS UNBOUNDED PRECEDING) ELSE 0 END::BIGINT AS run FROM g) SELECT *, run >= 5 AS fires FROM r")
def consecutive_triggers(spark, sf_dir):
    return W.consecutive_triggers(_history(spark, sf_dir))


@query(f"{_HISTORY} SELECT step, round(regr_slope(value, step) OVER (ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS slope FROM h")
def metric_trend(spark, sf_dir):
    return W.trend(_history(spark, sf_dir)).withColumn("slope", F.round("slope", 6))


_POINTS = "pts AS (SELECT (l_suppkey % 5)::INTEGER AS angle_idx, l_orderkey * 10 + l_linenumber AS point_id FROM lineitem), ch AS (SELECT angle_idx, point_id, (ntile(7) OVER (PARTITION BY angle_idx ORDER BY point_id) - 1)::INTEGER AS chunk FROM pts)"


def _points(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") % 5).cast("int").alias("angle_idx"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id")).distinct()


@query(_POINTS.replace("SELECT (l_suppkey", "SELECT DISTINCT (l_suppkey", 1) + " SELECT angle_idx, point_id, chunk FROM ch")
def stratified_chunks(spark, sf_dir):
    return W.allocate_chunks(_points(spark, sf_dir), 7)


@query(_POINTS.replace("SELECT (l_suppkey", "SELECT DISTINCT (l_suppkey", 1) + ", per AS (SELECT chunk, count(*) AS n, count(DISTINCT angle_idx) AS a FROM ch GROUP BY 1) SELECT avg(n) AS mean_size, round(stddev_pop(n), 9) AS std_size, min(n) AS least_size, max(n) AS most_size, round(stddev_pop(n) / avg(n), 9) AS variation, count(*) FILTER (WHERE a = 5) AS complete_chunks, count(*) AS chunks FROM per")
def chunk_balance(spark, sf_dir):
    return A.chunk_balance(W.allocate_chunks(_points(spark, sf_dir), 7)).withColumns({"std_size": r9("std_size"), "variation": r9("variation")})


@query(f"{MODEL_SQL} SELECT angle_idx, round(var_samp(c2), 9) AS variance, round(sqrt(avg((c2 - model) ** 2)), 9) AS rmse FROM m WHERE i = j GROUP BY 1")
def diagonal_overlay(spark, sf_dir):
    return W.diagonal_overlay(modelled(spark, sf_dir)).select("angle_idx", r9("variance").alias("variance"), r9("rmse").alias("rmse"))


@query("SELECT DISTINCT phi FROM angle ORDER BY phi")
def distinct_grid(spark, sf_dir):
    return cells(spark, sf_dir).select("angle_idx").distinct().join(F.broadcast(angle_table(spark)), "angle_idx").select("phi").distinct().orderBy("phi")


@query("SELECT s_suppkey AS start, 'custom' AS kind FROM supplier WHERE s_acctbal > 0 AND s_suppkey <= 5 UNION ALL SELECT s_suppkey, 'generated' FROM supplier WHERE s_suppkey > 5")
def concatenated_starts(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    custom = s.where("s_acctbal > 0 AND s_suppkey <= 5").select(F.col("s_suppkey").alias("start"), F.lit("custom").alias("kind"))
    return custom.unionByName(s.where("s_suppkey > 5").select(F.col("s_suppkey").alias("start"), F.lit("generated").alias("kind")))


# ---- matrices ----


@query(f"{DIAGONAL_SQL} SELECT angle_idx, i, j, round(c2, 9) AS c2 FROM fixed")
def diagonal_basic(spark, sf_dir):
    return M.diagonal_basic(cells(spark, sf_dir)).withColumn("c2", r9("c2"))


_NEAR = "near AS (SELECT angle_idx, i AS k, c2 FROM c2 WHERE i <> j AND abs(i - j) <= 3 UNION ALL SELECT angle_idx, j, c2 FROM c2 WHERE i <> j AND abs(i - j) <= 3)"
_PUT = " SELECT c.angle_idx, c.i, c.j, round(CASE WHEN c.i = c.j THEN d.d ELSE c.c2 END, 9) AS c2 FROM c2 c LEFT JOIN d ON d.angle_idx = c.angle_idx AND d.k = c.i"


@query(f"{_NEAR}, d AS (SELECT angle_idx, k, median(c2) AS d FROM near GROUP BY 1, 2){_PUT}")
def diagonal_median(spark, sf_dir):
    return M.diagonal_statistical(cells(spark, sf_dir)).withColumn("c2", r9("c2"))


@query(f"{_NEAR}, d AS (SELECT angle_idx, k, avg(c2) AS d FROM near GROUP BY 1, 2){_PUT}")
def diagonal_mean(spark, sf_dir):
    return M.diagonal_statistical(cells(spark, sf_dir), estimator="mean").withColumn("c2", r9("c2"))


@query(f"{_NEAR}, rk AS (SELECT *, row_number() OVER (PARTITION BY angle_idx, k ORDER BY c2) AS r, count(*) OVER (PARTITION BY angle_idx, k) AS n FROM near), d AS (SELECT angle_idx, k, avg(c2) AS d FROM rk WHERE r > floor(0.2 * n) AND r <= n - floor(0.2 * n) GROUP BY 1, 2){_PUT}")
def diagonal_trimmed(spark, sf_dir):
    return M.diagonal_statistical(cells(spark, sf_dir), estimator="trimmed_mean").withColumn("c2", r9("c2"))


@query(f"d AS (SELECT angle_idx, j AS k, avg(c2) AS d FROM c2 WHERE abs(i - j) = 1 AND j BETWEEN 1 AND 28 GROUP BY 1, 2 UNION ALL SELECT angle_idx, 0, c2 FROM c2 WHERE i = 0 AND j = 1 UNION ALL SELECT angle_idx, 29, c2 FROM c2 WHERE i = 28 AND j = 29){_PUT}")
def diagonal_interpolated(spark, sf_dir):
    return M.diagonal_interpolation(cells(spark, sf_dir)).withColumn("c2", r9("c2"))


def _normalised(method: str, aggregates: str, expression: str):
    sql = f"s AS (SELECT angle_idx, {aggregates} FROM c2 GROUP BY 1) SELECT angle_idx, i, j, round({expression}, 9) AS c2 FROM c2 JOIN s USING (angle_idx)"

    def run(spark, sf_dir):
        return M.normalise(cells(spark, sf_dir), method).withColumn("c2", r9("c2"))

    run.__name__ = f"normalise_{method}"
    query(sql)(run)


_normalised("baseline", "max(c2) FILTER (WHERE i = 0 AND j = 0) AS o", "c2 / o")
_normalised("statistical", "avg(c2) AS m, stddev_pop(c2) AS sd", "(c2 - m) / sd")
_normalised("minmax", "min(c2) AS lo, max(c2) AS hi", "(c2 - lo) / (hi - lo)")
_normalised("robust", "median(c2) AS m, quantile_cont(c2, 0.25) AS lo, quantile_cont(c2, 0.75) AS hi", "(c2 - m) / (hi - lo)")
_normalised("physics_based", "max(c2) AS hi, max(c2) FILTER (WHERE i = 0 AND j = 0) AS o", "CASE WHEN o / hi < 1 THEN (c2 / hi) / (o / hi) ELSE c2 / hi END")

_REFLECT = "CASE WHEN {0} < 0 THEN -({0}) - 1 WHEN {0} > 29 THEN 59 - ({0}) ELSE {0} END"


@query(f"st(s) AS (VALUES (-1), (0), (1)), w AS (SELECT angle_idx, i AS ti, j AS tj, {_REFLECT.format('i + a.s')} AS i, {_REFLECT.format('j + b.s')} AS j FROM c2, st a, st b) SELECT w.angle_idx, ti AS i, tj AS j, round(median(c2), 9) AS c2 FROM w JOIN c2 USING (angle_idx, i, j) GROUP BY w.angle_idx, ti, tj")
def median_filter(spark, sf_dir):
    return M.median_filter(cells(spark, sf_dir)).withColumn("c2", r9("c2"))


_GAUSS = "ks AS (SELECT s::INTEGER AS s, exp(-0.5 * s * s) AS w FROM range(-4, 5) r(s)), kn AS (SELECT s, w / (SELECT sum(w) FROM ks) AS w FROM ks)"


@query(f"{_GAUSS}, a1 AS (SELECT angle_idx, i AS ti, {_REFLECT.format('i + s')} AS i, j, w FROM c2, kn), s1 AS (SELECT a1.angle_idx, ti AS i, j, sum(w * c2) AS c2 FROM a1 JOIN c2 USING (angle_idx, i, j) GROUP BY 1, 2, 3), a2 AS (SELECT angle_idx, j AS tj, {_REFLECT.format('j + s')} AS j, i, w FROM s1, kn) SELECT a2.angle_idx, i, tj AS j, round(sum(w * c2), 9) AS c2 FROM a2 JOIN s1 USING (angle_idx, i, j) GROUP BY 1, 2, 3")
def gaussian_filter(spark, sf_dir):
    return M.gaussian_filter(cells(spark, sf_dir)).withColumn("c2", r9("c2"))


@query("st(s) AS (VALUES (-1), (0), (1)), sent AS (SELECT angle_idx, i + a.s AS i, j + b.s AS j, c2 FROM c2, st a, st b), l AS (SELECT angle_idx, i, j, sum(c2) / 9 AS m, sum(c2 * c2) / 9 - (sum(c2) / 9) * (sum(c2) / 9) AS v FROM sent GROUP BY 1, 2, 3), x AS (SELECT c.angle_idx, c.i, c.j, c2, m, v FROM c2 c JOIN l USING (angle_idx, i, j)), nz AS (SELECT angle_idx, avg(v) AS noise FROM x GROUP BY 1) SELECT angle_idx, i, j, round(CASE WHEN v < noise THEN m ELSE m + (1 - noise / v) * (c2 - m) END, 9) AS c2 FROM x JOIN nz USING (angle_idx)")
def wiener_filter(spark, sf_dir):
    return M.wiener_filter(cells(spark, sf_dir)).withColumn("c2", r9("c2"))


def _savgol_taps() -> str:
    """(at, of, v): the weights of a quadratic over five cells; the ends by the polynomial of the first and last five."""
    ends = {0: (31, 9, -3, -5, 3), 1: (9, 13, 12, 6, -5), 28: (-5, 6, 12, 13, 9), 29: (3, -5, -3, 9, 31)}  # fixed values, over 35
    rows = [(at, of, v) for at, taps in ends.items() for of, v in enumerate(taps, 0 if at < 2 else 25)]
    rows += [(at, at + d, v) for at in range(2, 28) for d, v in zip(range(-2, 3), (-3, 12, 17, 12, -3))]
    return "sg(at_, of_, v) AS (VALUES " + ", ".join(f"({a}, {o}, {v}::DOUBLE / 35)" for a, o, v in rows) + ")"


@query(f"{_savgol_taps()}, rows_ AS (SELECT angle_idx, i, at_ AS j, sum(v * c2) AS c2 FROM c2 JOIN sg ON of_ = j GROUP BY ALL) SELECT angle_idx, at_ AS i, j, round(sum(v * c2), 9) AS c2 FROM rows_ JOIN sg ON of_ = i GROUP BY ALL")
def savgol_filter(spark, sf_dir):
    return M.savgol_filter(cells(spark, sf_dir)).withColumn("c2", r9("c2"))


@query(f"{_NEAR}, d AS (SELECT angle_idx, k, median(c2) AS d FROM near GROUP BY 1, 2), one AS (SELECT c.angle_idx, c.i, c.j, CASE WHEN c.i = c.j THEN d.d ELSE c.c2 END AS c2 FROM c2 c LEFT JOIN d ON d.angle_idx = c.angle_idx AND d.k = c.i), s AS (SELECT angle_idx, min(c2) AS lo, max(c2) AS hi FROM one GROUP BY 1), two AS (SELECT angle_idx, i, j, (c2 - lo) / (hi - lo) AS c2 FROM one JOIN s USING (angle_idx)), side AS (SELECT angle_idx, least(i, j) AS k, sum(c2) / 2 AS s FROM two WHERE abs(i - j) = 1 GROUP BY 1, 2), dg AS (SELECT angle_idx, i, avg(s) AS d FROM (SELECT angle_idx, k AS i, s FROM side UNION ALL SELECT angle_idx, k + 1, s FROM side) GROUP BY 1, 2) SELECT t.angle_idx, t.i, t.j, round(CASE WHEN t.i = t.j THEN d ELSE c2 END, 9) AS c2 FROM two t LEFT JOIN dg ON dg.angle_idx = t.angle_idx AND dg.i = t.i")
def preprocessing_pipeline(spark, sf_dir):
    return M.preprocess(cells(spark, sf_dir), "statistical", "minmax").withColumn("c2", r9("c2"))


# ---- scalar functions ----


@query("""x AS (SELECT i, (i % 30) / 10.0::DOUBLE - 1.5::DOUBLE AS x FROM person) SELECT i,
round(exp(greatest(least(x * 100, 700), -700)) / exp(150.0), 9) AS safe_exp, round(CASE WHEN abs(x) < 1e-4 THEN 1 - x * x / 6 + pow(x, 4) / 120 ELSE sin(x) / x END, 9) AS sinc,
round(CASE WHEN x > 0 THEN pow(x, 0.7) ELSE 0 END, 9) AS power, round(CASE WHEN abs(x) > 1e-30 THEN 1 / x ELSE -1 END, 9) AS divide,
round(ln(greatest(x, 1e-30)), 9) AS log, round(sqrt(greatest(x, 0.0)), 9) AS root, round(sqrt(x * x + 1e-12), 9) AS sabs,
round(1 - (greatest(50 * (1 - l), 0) + ln(1 + exp(-abs(50 * (1 - l))))) / 50, 9) AS sclip,
round(abs(x - 1) / greatest(abs(x), 1, 1e-10), 9) AS reldiff, round(greatest(3 * pow(greatest(x, 0.5), 0.5) - 2, 1e-10), 9) AS rate,
round(greatest(3 * CASE WHEN x > 0 THEN pow(x, 0.5) ELSE 0 END - 2, 0.0), 9) AS transport, round(3 * CASE WHEN x > 0 THEN pow(x, 0.5) ELSE 0 END - 2, 9) AS velocity,
round((x + 2) / 5, 9) AS unit, round(least(greatest(x, -1), 1), 9) AS clipped
FROM (SELECT i, x, (greatest(50 * x, 0) + ln(1 + exp(-abs(50 * x)))) / 50 AS l FROM x)""", base=WIDE)
def scalar_functions(spark, sf_dir):
    x = F.col("x")
    f = customer_rows(spark, sf_dir).select("i", (F.col("i") % 30 / 10.0 - 1.5).alias("x"))
    out = {
        "safe_exp": S.safe_exp(x * 100) / F.exp(F.lit(150.0)), "sinc": S.sinc_taylor(x), "power": S.safe_power(x, 0.7), "divide": S.safe_divide(F.lit(1.0), x, -1.0), "log": S.safe_log(x), "root": S.safe_sqrt(x), "sabs": S.smooth_abs(x), "sclip": S.smooth_clip(x),
        "reldiff": S.relative_difference(x, F.lit(1.0)), "rate": S.rate(x, 3.0, 0.5, -2.0, 1.0), "transport": S.transport_rate(x, 3.0, 0.5, -2.0), "velocity": S.velocity_rate(x, 3.0, 0.5, -2.0), "unit": S.to_unit(x, -2.0, 3.0), "clipped": S.clip(x, -1.0, 1.0),
    }
    return f.select("i", *(r9(v).alias(k) for k, v in out.items()))


@query("SELECT angle_idx, round(1 / (q * q * 1000) * 1.5, 9) AS tau, round((0.1 + 0.9 * pow(abs(cos(radians(10 - phi))), 2)) / (SELECT avg(0.1 + 0.9 * pow(abs(cos(radians(10 - phi))), 2)) FROM angle), 9) AS shear, round(cos(2 * radians(phi)), 9) AS c2phi, round(sin(2 * radians(phi)), 9) AS s2phi FROM angle", base=WIDE)
def angle_functions(spark, sf_dir):
    a = supplier_angles(spark, sf_dir).withColumn("w", S.shear_weight(F.col("phi"), 10.0, 0.1, 2.0))
    mean = F.broadcast(a.agg(F.avg("w").alias("mean")))
    return a.crossJoin(mean).select("angle_idx", r9(S.correlation_time(F.col("q"), 1000.0, 0.5)).alias("tau"), r9(F.col("w") / F.col("mean")).alias("shear"), r9(F.cos(2 * F.radians("phi"))).alias("c2phi"), r9(F.sin(2 * F.radians("phi"))).alias("s2phi"))


@query("SELECT angle_idx, i, j, 1.0::DOUBLE AS uniform, round(1 / 0.0001, 6) AS inverse_variance, round(1 / greatest(abs(c2), 1e-30), 9) AS inverse_c2 FROM c2")
def cell_weights(spark, sf_dir):
    c = modelled(spark, sf_dir)
    return c.select("angle_idx", "i", "j", S.weight("uniform", F.col("c2")).alias("uniform"), F.round(S.weight("inverse_variance", F.col("c2"), F.col("sigma")), 6).alias("inverse_variance"), r9(S.weight("inverse_c2", F.col("c2"))).alias("inverse_c2"))


# ---- kernels ----

STATIC = {"D0": 1000.0, "alpha": 0.5, "D_offset": 10.0}
FLOW = {**STATIC, "gamma_dot_t0": 0.01, "beta": 0.3, "gamma_dot_t_offset": 0.001, "phi0": 5.0}
TWO = dict(D0_ref=5000.0, alpha_ref=0.5, D_offset_ref=100.0, D0_sample=4000.0, alpha_sample=0.4, D_offset_sample=80.0, v0=50.0, v_beta=0.5, v_offset=5.0, f0=0.5, f1=0.01, f2=1.0, f3=0.1, phi0_het=2.0)


def _cum(name: str, expression: str) -> str:
    return f"{name}m AS (SELECT i, coalesce((lag(v) OVER (ORDER BY i) + v) / 2, 0.0) AS m FROM (SELECT i, {expression} AS v FROM frame)), {name} AS (SELECT i, sum(m) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM {name}m)"


_PAIR = "sqrt(({0}a.c - {0}b.c) * ({0}a.c - {0}b.c) + 1e-12)"


@query(_cum("d", "greatest(1000 * pow(greatest(t, 0.5), 0.5) + 10, 1e-10)") + f" SELECT angle_idx, da.i, db.i AS j, round(1.0 + 0.3 * pow(greatest(exp(greatest(-0.5 * q * q * CASE WHEN da.i = db.i THEN 0 ELSE {_PAIR.format('d')} END, -700)), 1e-10), 2), 6) AS g2 FROM d da, d db, angle", base=WIDE)
def homodyne_static_g2(spark, sf_dir):
    s = K.homodyne_surface(part_frames(spark, sf_dir), supplier_angles(spark, sf_dir), STATIC, 1.0)
    return s.select("angle_idx", "i", "j", F.round(K.scaled(F.col("g1"), F.lit(0.3), F.lit(1.0)), 6).alias("g2"))


@query(_cum("d", "greatest(1000 * pow(greatest(t, 0.5), 0.5) + 10, 1e-10)") + ", " + _cum("g", "greatest(0.01 * pow(greatest(t, 0.5), 0.3) + 0.001, 1e-10)") + f""", x AS (SELECT angle_idx, da.i, db.i AS j, exp(greatest(-0.5 * q * q * CASE WHEN da.i = db.i THEN 0 ELSE {_PAIR.format('d')} END, -700)) AS e,
q * 2e6 / (2 * pi()) * cos(radians(5 - phi)) * CASE WHEN da.i = db.i THEN 0 ELSE {_PAIR.format('g')} END AS a FROM d da, d db, g ga, g gb, angle WHERE ga.i = da.i AND gb.i = db.i),
y AS (SELECT angle_idx, i, j, e, CASE WHEN abs(a) < 1e-4 THEN 1 - a * a / 6 + pow(a, 4) / 120 ELSE sin(a) / a END AS s FROM x) SELECT angle_idx, i, j, round(greatest(e * s * s, 1e-10), 6) AS g1 FROM y""", base=WIDE)
def homodyne_flow_g1(spark, sf_dir):
    return K.homodyne_surface(part_frames(spark, sf_dir), supplier_angles(spark, sf_dir), FLOW, 1.0).withColumn("g1", F.round("g1", 6))


_T = "CASE WHEN t > 0 THEN pow(t, {}) ELSE 0 END"


@query(_cum("cr", f"greatest(5000 * {_T.format(0.5)} + 100, 0.0)") + ", " + _cum("cm", f"greatest(4000 * {_T.format(0.4)} + 80, 0.0)") + ", " + _cum("cv", f"50 * {_T.format(0.5)} + 5") + """,
fr AS (SELECT i, 1 - (greatest(50 * (1 - l), 0) + ln(1 + exp(-abs(50 * (1 - l))))) / 50 AS f FROM (SELECT i, (greatest(50 * x, 0) + ln(1 + exp(-abs(50 * x)))) / 50 AS l FROM (SELECT i, 0.5 * exp(0.01 * (t - 1)) + 0.1 AS x FROM frame))),
z AS (SELECT angle_idx, ra.i, rb.i AS j, fa.f AS fi, fb.f AS fj, exp(greatest(-0.5 * q * q * sqrt((rb.c - ra.c) * (rb.c - ra.c) + 1e-12), -700)) AS hr, exp(greatest(-0.5 * q * q * sqrt((mb.c - ma.c) * (mb.c - ma.c) + 1e-12), -700)) AS hs, cos(q * cos(radians(phi + 2)) * (vb.c - va.c)) AS beat
FROM cr ra, cr rb, cm ma, cm mb, cv va, cv vb, fr fa, fr fb, angle WHERE ma.i = ra.i AND mb.i = rb.i AND va.i = ra.i AND vb.i = rb.i AND fa.i = ra.i AND fb.i = rb.i)
SELECT angle_idx, i, j, round((pow((1 - fi) * (1 - fj) * hr, 2) + pow(fi * fj * hs, 2) + 2 * (1 - fi) * fi * (1 - fj) * fj * hr * hs * beat) / greatest((fi * fi + (1 - fi) * (1 - fi)) * (fj * fj + (1 - fj) * (1 - fj)), 1e-10), 6) AS model FROM z""", base=WIDE)
def heterodyne_surface(spark, sf_dir):
    return K.heterodyne_surface(part_frames(spark, sf_dir), supplier_angles(spark, sf_dir), TWO, 1.0).withColumn("model", F.round("model", 6))


# ---- views ----


@query(f"{MODEL_SQL} SELECT angle_idx, i, j, c2, round(model, 9) AS model, round(c2 - model, 9) AS residual FROM m")
def comparison_view(spark, sf_dir):
    return V.comparison(modelled(spark, sf_dir)).withColumns({"model": r9("model"), "residual": r9("residual")})


@query(f"{MODEL_SQL} SELECT angle_idx, least(floor((c2 - model + 0.2) / 0.0403), 9)::INTEGER AS bin, count(*) AS n FROM m WHERE c2 - model BETWEEN -0.2 AND 0.203 GROUP BY 1, 2")
def residual_histogram(spark, sf_dir):
    return V.residual_histogram(modelled(spark, sf_dir), -0.2, 0.203, 10)


@query("SELECT angle_idx, (i * 8 // 30)::INTEGER AS x, (j * 8 // 30)::INTEGER AS y, round(avg(c2), 9) AS c2 FROM c2 GROUP BY 1, 2, 3")
def rasterised(spark, sf_dir):
    return V.rasterise(cells(spark, sf_dir), 30, 8, 8).withColumn("c2", r9("c2"))


@query("v AS (SELECT a.angle_idx AS a, b.angle_idx AS b, sum(a.d * b.d) AS value FROM fluct a JOIN fluct b ON a.i = b.i GROUP BY 1, 2), s AS (SELECT a AS k, sqrt(value) AS sd FROM v WHERE a = b) SELECT a, b, round(value / (x.sd * y.sd), 9) AS value FROM v JOIN s x ON x.k = a JOIN s y ON y.k = b")
def correlation_matrix(spark, sf_dir):
    x = intensity(spark, sf_dir)
    m = x.groupBy("angle_idx").agg(F.avg("cents").alias("mu"))
    d = x.join(F.broadcast(m), "angle_idx").select(F.col("angle_idx").alias("a"), "i", (F.col("cents") - F.col("mu")).alias("d"))
    cov = d.join(F.broadcast(d.withColumnsRenamed({"a": "b", "d": "e"})), "i").groupBy("a", "b").agg(F.sum(F.col("d") * F.col("e")).alias("value"))
    return V.correlation_of(cov).withColumn("value", r9("value"))


@query("SELECT n_nationkey::INTEGER AS angle_idx, round(0.01::DOUBLE * (n_nationkey + 1), 9) AS contrast, round(1 + 0.01::DOUBLE * n_regionkey, 9) AS off FROM nation", base=WIDE)
def expanded_scaling(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", (0.01 * (F.col("n_nationkey") + 1)).alias("c"), (1 + 0.01 * F.col("n_regionkey")).alias("o"))
    s = n.agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "c", "o"))).alias("x")).select(F.col("x.c").alias("contrast"), F.col("x.o").alias("offset"))  # a row a nation
    return V.expand_scaling(s).withColumnRenamed("offset", "off").select("angle_idx", r9("contrast").alias("contrast"), r9("off").alias("off"))


@query("SELECT angle_idx, k AS n_parameters, greatest(count(*) - k, 1)::BIGINT AS dof FROM c2, range(1, 8) r(k) WHERE i <> j GROUP BY 1, 2")
def degrees_of_freedom(spark, sf_dir):
    counted = cells(spark, sf_dir).where("i <> j").groupBy("angle_idx").agg(F.count(F.lit(1)).alias("n"))
    tried = counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("n_parameters"))
    return tried.select("angle_idx", "n_parameters", F.greatest(F.col("n") - F.col("n_parameters"), F.lit(1)).cast("long").alias("dof"))


@query("f AS (SELECT i AS k, (i % 13) * 0.75::DOUBLE AS reduced, CASE WHEN i % 7 = 0 THEN 1e13 ELSE 1e3 END AS cond, (i % 5) + 0.5::DOUBLE AS sig FROM person) SELECT k, CASE WHEN cond > 1e12 OR sig < 2 THEN 'poor' WHEN reduced <= 2 THEN 'good' WHEN reduced <= 5 THEN 'marginal' ELSE 'poor' END AS quality FROM f", base=WIDE)
def fit_quality_bands(spark, sf_dir):
    i = F.col("i")
    f = customer_rows(spark, sf_dir).select(i.alias("k"), (i % 13 * 0.75).alias("reduced"), F.when(i % 7 == 0, 1e13).otherwise(1e3).alias("cond"), (i % 5 + 0.5).alias("sig"))
    return f.select("k", A.fit_quality(F.col("reduced"), F.col("cond"), F.col("sig")).alias("quality"))


# ---- fits of theory, pointwise models, advice ----


@query(_cum("d", "greatest(1000 * pow(greatest(t, 0.5), 0.5) + 10, 1e-10)") + f""", th AS (SELECT angle_idx, da.i, db.i AS j, 1.0 + pow(greatest(exp(greatest(-0.5 * q * q * CASE WHEN da.i = db.i THEN 0 ELSE {_PAIR.format('d')} END, -700)), 1e-10), 2) AS model FROM d da, d db, angle),
x AS (SELECT c.angle_idx, c.i, c.j, c2, model FROM c2 c JOIN th USING (angle_idx, i, j)), f AS (SELECT angle_idx, regr_slope(c2, model) AS s, regr_intercept(c2, model) AS o FROM x GROUP BY 1)
SELECT angle_idx, i, j, round(o + s * model, 9) AS fitted, round(c2 - (o + s * model), 9) AS residual FROM x JOIN f USING (angle_idx)""")
def theoretical_fit(spark, sf_dir):
    """Raw surface, least-squares scaling per angle, scaled surface, residuals."""
    d = events_dataset(spark, sf_dir)
    surface = K.homodyne_surface(d.frame, d.angle, STATIC, 1.0).withColumn("model", K.scaled(F.col("g1"), F.lit(1.0), F.lit(1.0)))
    both = d.c2.join(surface, ["angle_idx", "i", "j"])
    fit = F.broadcast(A.least_squares_scaling(both))  # a row an angle
    fitted = F.col("offset") + F.col("contrast") * F.col("model")
    return both.join(fit, "angle_idx").select("angle_idx", "i", "j", r9(fitted).alias("fitted"), r9(F.col("c2") - fitted).alias("residual"))


@query(_cum("cr", f"greatest(5000 * {_T.format(0.5)} + 100, 0.0)") + ", " + _cum("cm", f"greatest(4000 * {_T.format(0.4)} + 80, 0.0)") + ", " + _cum("cv", f"50 * {_T.format(0.5)} + 5") + " SELECT i, round(cr.c, 6) AS cr, round(cm.c, 6) AS cm, round(cv.c, 6) AS cv FROM cr JOIN cm USING (i) JOIN cv USING (i)", base=WIDE)
def heterodyne_vectors(spark, sf_dir):
    """The one-dimensional integrals that every two-component evaluation starts from."""
    return K.heterodyne_frames(part_frames(spark, sf_dir), TWO, 1.0).select("i", *(F.round(c, 6).alias(c) for c in ("cr", "cm", "cv")))


_SCATTERED = "p AS (SELECT l_orderkey * 10 + l_linenumber AS point_id, (l_suppkey % 5)::INTEGER AS angle_idx, (l_orderkey % 30)::INTEGER AS i, (l_partkey % 30)::INTEGER AS j FROM lineitem), "


def _scattered(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return p.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), (F.col("l_suppkey") % 5).cast("int").alias("angle_idx"), (F.col("l_orderkey") % 30).cast("int").alias("i"), (F.col("l_partkey") % 30).cast("int").alias("j"))


def _at_points(surface_sql: str, column: str) -> str:
    """The SQL of a surface, looked up at the scattered points."""
    own = surface_sql[len(WIDE) :]
    inner, last = own.rsplit(" SELECT angle_idx, ", 1) if " SELECT angle_idx, " in own else own.rsplit("\nSELECT angle_idx, ", 1)
    return f"{_SCATTERED}{inner.lstrip(', ')}, surface AS (SELECT angle_idx, {last}) SELECT point_id, p.angle_idx, p.i, p.j, {column} FROM p JOIN surface s ON s.angle_idx = p.angle_idx AND s.i = p.i AND s.j = p.j"


@query(_at_points(_SQL["homodyne_static_g2"], "g2"))
def pointwise_diffusion(spark, sf_dir):
    """The model at scattered points: equi-joins with the frames' integrals instead of a float lookup."""
    at = K.homodyne_at(_scattered(spark, sf_dir), frame_table(spark, 30), angle_table(spark), STATIC, 1.0)
    return at.select("point_id", "angle_idx", "i", "j", F.round(K.scaled(F.col("g1"), F.lit(0.3), F.lit(1.0)), 6).alias("g2"))


@query(_at_points(_SQL["homodyne_flow_g1"], "g1"))
def pointwise_shear(spark, sf_dir):
    return K.homodyne_at(_scattered(spark, sf_dir), frame_table(spark, 30), angle_table(spark), FLOW, 1.0).withColumn("g1", F.round("g1", 6))


@query(_at_points(_SQL["heterodyne_surface"], "model"))
def pointwise_two_component(spark, sf_dir):
    return K.heterodyne_at(_scattered(spark, sf_dir), frame_table(spark, 30), angle_table(spark), TWO, 1.0).withColumn("model", F.round("model", 6))


@query("SELECT i, round(CASE WHEN abs(x) <= 1e-10 THEN 1.0 ELSE sin(x) / x END, 9) AS sinc FROM (SELECT i, (i % 30 - 15) / 5.0::DOUBLE AS x FROM person)", base=WIDE)
def heterodyne_sinc(spark, sf_dir):
    return customer_rows(spark, sf_dir).select("i", r9(S.sinc_plain((F.col("i") % 30 - 15) / 5.0)).alias("sinc"))


@query("param(name, lower, upper) AS (VALUES ('D0', 100.0::DOUBLE, 100000.0::DOUBLE), ('alpha', -2.0::DOUBLE, 2.0::DOUBLE), ('phi0', -10.0::DOUBLE, 10.0::DOUBLE)), v AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'D0' WHEN 1 THEN 'alpha' ELSE 'phi0' END AS name, (p_retailprice - 1000) / (CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 100 END) AS value FROM part) SELECT name, greatest(least(value, upper), lower) AS value, value BETWEEN lower AND upper AS within FROM v JOIN param USING (name)")
def clipped_parameters(spark, sf_dir):
    kind = F.col("p_partkey") % 3
    v = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.when(kind == 0, "D0").when(kind == 1, "alpha").otherwise("phi0").alias("name"), ((F.col("p_retailprice") - 1000) / F.when(kind == 0, 1).otherwise(100)).alias("value"))
    return V.clipped(v, parameter_table(spark))


@query(_POINTS.split(", ch AS")[0].replace("SELECT (l_suppkey", "SELECT DISTINCT (l_suppkey", 1) + " SELECT angle_idx, point_id, floor(('0x' || substr(md5('42|' || angle_idx || '|' || point_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * 7)::INTEGER AS chunk FROM pts")
def shuffled_chunks(spark, sf_dir):
    return W.shuffled_chunks(_points(spark, sf_dir), 7)


@query("gaps AS (SELECT angle_idx, i, j, CASE WHEN angle_idx = 1 AND i = 3 AND j = 5 OR angle_idx = 2 AND i < 4 THEN NULL ELSE c2 + 0.001 * i END AS c2 FROM c2), g AS (SELECT a.angle_idx, avg(abs(a.c2 - b.c2)) AS e FROM gaps a JOIN gaps b ON a.angle_idx = b.angle_idx AND a.i = b.j AND a.j = b.i GROUP BY 1), s AS (SELECT angle_idx, count(c2) / count(*) AS f, max(c2) FILTER (WHERE i = 0 AND j = 0) AS d, avg(c2) AS m FROM gaps GROUP BY 1) SELECT angle_idx, round(CASE WHEN f < 0.9 THEN 0 ELSE 0.4 * f + 0.3 * (CASE WHEN d BETWEEN 0.5 AND 2 THEN 1 ELSE 0.5 END) + 0.2 * greatest(1 - 100 * e, 0) + 0.1 * (CASE WHEN m BETWEEN 0.1 AND 5 THEN 1 ELSE 0.5 END) END, 9) AS score FROM s JOIN g USING (angle_idx)")
def quality_with_gaps(spark, sf_dir):
    """Scores of matrices of which one lacks a cell and one four rows."""
    lost = ((F.col("angle_idx") == 1) & (F.col("i") == 3) & (F.col("j") == 5)) | ((F.col("angle_idx") == 2) & (F.col("i") < 4))
    gaps = cells(spark, sf_dir).withColumn("c2", F.when(lost, float("nan")).otherwise(F.col("c2") + 0.001 * F.col("i")))
    return A.matrix_quality(gaps).select("angle_idx", r9("score").alias("score"))


@query("keep AS (SELECT angle_idx FROM angle WHERE phi >= 0), raw AS (SELECT angle_idx, i, j, CASE WHEN angle_idx = 3 AND i = 2 AND j = 9 THEN NULL ELSE c2 END AS c2 FROM c2), fil AS (SELECT raw.* FROM raw JOIN keep USING (angle_idx)) SELECT 'raw' AS stage, count(*) AS n, round(count(c2) / count(*), 9) AS finite_fraction, round(avg(c2), 9) AS mean FROM raw UNION ALL SELECT 'filtered', count(*), round(count(c2) / count(*), 9), round(avg(c2), 9) FROM fil")
def stage_report(spark, sf_dir):
    """The first two stages of cells of which one is lost; tests hold the later ones against their operators."""
    lost = (F.col("angle_idx") == 3) & (F.col("i") == 2) & (F.col("j") == 9)
    raw = cells(spark, sf_dir).withColumn("c2", F.when(lost, float("nan")).otherwise(F.col("c2")))
    at = Va.stages(raw, angle_table(spark).where("phi >= 0"))
    report = Va.stage_report({k: at[k] for k in ("raw", "filtered")})
    return report.select("stage", "n", r9("finite_fraction").alias("finite_fraction"), r9("mean").alias("mean"))


@query("bad AS (SELECT l_suppkey::INTEGER AS angle_idx, l_discount AS q, (l_quantity * 10)::DOUBLE AS phi FROM lineitem), s AS (SELECT count(*) FILTER (WHERE NOT q BETWEEN 0.0001 AND 1.0) AS q, count(*) FILTER (WHERE NOT phi BETWEEN -360 AND 360) AS phi, count(phi) - count(DISTINCT (phi, q)) AS twice FROM bad) SELECT 'error' AS severity, 'range' AS category, 'wavevectors out of range' AS message, 'q' AS parameter, q::DOUBLE AS value FROM s WHERE q > 0 UNION ALL SELECT 'error', 'range', 'angles that aren''t', 'phi', phi::DOUBLE FROM s WHERE phi > 0 UNION ALL SELECT 'warning', 'repeated', 'angles that repeat', 'phi', twice::DOUBLE FROM s WHERE twice > 0")
def angle_issues(spark, sf_dir):
    bad = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").cast("int").alias("angle_idx"), (F.col("l_discount") + 0.0).alias("q"), (F.col("l_quantity") * 10).alias("phi"))
    return Va.angle_issues(bad)


# ---- hourly frames: some million cells at a tenth of the scale ----


@query(HOURLY_SQL + f", {_quantiles('c2')} SELECT angle_idx, n, round(contrast, 9) AS contrast, round(off, 9) AS off FROM scal", base=False)
def hourly_scaling(spark, sf_dir):
    out = Sc.quantile_scaling(events_dataset(spark, sf_dir, "hour").c2)
    return out.select("angle_idx", "n", r9("contrast").alias("contrast"), r9("offset").alias("off"))


@query(HOURLY_SQL + ", gap AS (SELECT a.angle_idx, avg(abs(a.c2 - b.c2)) AS g FROM c2 a JOIN c2 b ON a.angle_idx = b.angle_idx AND a.i = b.j AND a.j = b.i GROUP BY 1), s AS (SELECT angle_idx, max(c2) FILTER (WHERE i = 0 AND j = 0) AS d, avg(c2) AS m FROM c2 GROUP BY 1) SELECT angle_idx, round(0.4 + 0.3 * (CASE WHEN d BETWEEN 0.5 AND 2 THEN 1 ELSE 0.5 END) + 0.2 * greatest(1 - 100 * g, 0) + 0.1 * (CASE WHEN m BETWEEN 0.1 AND 5 THEN 1 ELSE 0.5 END), 9) AS score FROM s JOIN gap USING (angle_idx)", base=False)
def hourly_quality(spark, sf_dir):
    return A.matrix_quality(events_dataset(spark, sf_dir, "hour").c2).select("angle_idx", r9("score").alias("score"))


@query(HOURLY_SQL + ", st(s) AS (VALUES (-1), (0), (1)), w AS (SELECT angle_idx, i, j + s AS j, c2 FROM c2, st WHERE j + s BETWEEN 0 AND 719), one AS (SELECT angle_idx, i, j, sum(c2) AS c2 FROM w GROUP BY ALL), edge AS (SELECT angle_idx, i, j, one.c2 + CASE WHEN j IN (0, 719) THEN c2.c2 ELSE 0 END AS c2 FROM one JOIN c2 USING (angle_idx, i, j)), v AS (SELECT angle_idx, i + s AS i, j, c2 FROM edge, st WHERE i + s BETWEEN 0 AND 719), two AS (SELECT angle_idx, i, j, sum(c2) AS c2 FROM v GROUP BY ALL), box AS (SELECT angle_idx, i, j, (two.c2 + CASE WHEN i IN (0, 719) THEN edge.c2 ELSE 0 END) / 9 AS c2 FROM two JOIN edge USING (angle_idx, i, j)) SELECT angle_idx, count(*) AS n, round(avg(c2), 7) AS mean, round(max(c2), 7) AS most, round(min(c2), 7) AS least FROM box GROUP BY 1", base=False)
def hourly_box_filter(spark, sf_dir):
    """Means over 3 x 3 cells in tiles, edges reflected."""
    box = M.stencil(events_dataset(spark, sf_dir, "hour").c2, 1, _box)
    return box.groupBy("angle_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c2"), 7).alias("mean"), F.round(F.max("c2"), 7).alias("most"), F.round(F.min("c2"), 7).alias("least"))


def _box(a):
    rows = a[:-2] + a[1:-1] + a[2:]
    return (rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]) / 9


@query("SELECT l_returnflag AS g, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem GROUP BY 1")
def grouped_regression(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("g")).agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"), r9(F.regr_r2("l_extendedprice", "l_quantity")).alias("r2"))


_HASHED = "sum(('0x' || substr(md5({0}), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS hash, count(*) AS n"


@query(f"SELECT 'c2' AS component, {_HASHED.format("angle_idx || '|' || i || '|' || j || '|' || round(c2 * 1e6)::BIGINT")} FROM c2 UNION ALL SELECT 'angle', {_HASHED.format("angle_idx || '|' || name")} FROM angle UNION ALL SELECT 'frame', {_HASHED.format("i::VARCHAR")} FROM frame")
def component_hashes(spark, sf_dir):
    """Hashes of the parts of a data set; c2 in millionths, so that any engine writes it alike."""
    d = events_dataset(spark, sf_dir)
    parts = {"c2": d.c2.select("angle_idx", "i", "j", F.round(F.col("c2") * 1e6).cast("long").alias("c2")), "angle": d.angle.select("angle_idx", "name"), "frame": d.frame.select("i")}
    out = None
    for name, df in parts.items():
        row = A.component_hash(df).select(F.lit(name).alias("component"), "hash", "n")
        out = row if out is None else out.unionByName(row)
    return out


_ASOF = "spots AS (SELECT event_id, epoch_us(ts) / 1000000.0::DOUBLE AS at FROM events WHERE event_type <> 'signup'), grid AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS index FROM (SELECT DISTINCT epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events WHERE event_type = 'signup')) "


def _asof(spark, sf_dir, side):
    """Every event that isn't a signup, looked up on the uneven grid of the signups' times."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", seconds.alias("at"))
    grid = W.numbered(events.where("event_type = 'signup'").select(F.col("at").alias("t")).distinct(), "t", "index").withColumn("index", F.col("index") - 1)
    return asof.nearest_on_grid(events.where("event_type <> 'signup'").select("event_id", "at"), grid, "at", "found", side).select("event_id", "found")


@query(_ASOF + "SELECT event_id, coalesce(g.index, (SELECT max(index) FROM grid)) AS found FROM spots s ASOF LEFT JOIN grid g ON s.at <= g.t")
def asof_ceiling(spark, sf_dir):
    return _asof(spark, sf_dir, "ceiling")


@query(_ASOF + "SELECT event_id, coalesce(g.index, 0) AS found FROM spots s ASOF LEFT JOIN grid g ON s.at >= g.t")
def asof_floor(spark, sf_dir):
    return _asof(spark, sf_dir, "floor")
