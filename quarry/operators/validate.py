"""Train/test validation checks (V1-V7).

Each check returns a small report frame and a status. Per-column statistics of
both sides come from one long-form aggregate per side (one scan each); the
schema checks are full outer joins of ``(column, type)`` tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import types as qt
from quarry.functions.exprs import nan_to_null, qcol
from quarry.operators.profile import long_values


def _missing(df: DataFrame):
    """NULL, or NaN in a floating column, is missing (as in the reference's data model)."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return lambda c: (qcol(c).isNull() | F.isnan(qcol(c))) if c in floating else qcol(c).isNull()

# Default thresholds of the checks.
MISSING_THRESHOLD = 0.2
DRIFT_THRESHOLD = 0.2
IMBALANCE_THRESHOLD = 0.9


class ValidationError(ValueError):
    pass


@dataclass
class ValidationReport:
    checks: dict = field(default_factory=dict)      # name -> bool
    frames: dict = field(default_factory=dict)      # name -> DataFrame
    warnings: list = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return all(self.checks.values())

    def status_frame(self, spark) -> DataFrame:
        """V6: one row per check plus the overall row."""
        rows = [(k, bool(v)) for k, v in self.checks.items()] + [("overall", self.passed)]
        return spark.createDataFrame(rows, "check_name string, status boolean")


# ---------------------------------------------------------------- V1

def integrity(train: DataFrame, test: DataFrame):
    """V1: both sides non-empty (raises), equal column sets, shapes, sorted symmetric difference."""
    n_train, n_test = train.count(), test.count()
    if n_train == 0:
        raise ValidationError("no training rows")
    if n_test == 0:
        raise ValidationError("no test rows")
    a, b = set(train.columns), set(test.columns)
    mismatch = sorted(a ^ b)
    status = a == b
    frame = train.sparkSession.createDataFrame(
        [(status, n_train, len(train.columns), n_test, len(test.columns), ",".join(mismatch))],
        "status boolean, train_rows long, train_columns int, test_rows long, test_columns int, "
        "column_mismatch string")
    return status, frame


# ---------------------------------------------------------------- V2

def _schema_table(spark, df: DataFrame, side: str) -> DataFrame:
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields],
                                 f"column_name string, {side}_type string")


def schema_check(train: DataFrame, test: DataFrame, expected: dict | None):
    """V2: missing = expected minus the union of both sides; unexpected only when
    a schema is given; a type mismatch if either side differs from the expected."""
    spark = train.sparkSession
    expected = dict(expected or {})
    if isinstance(expected.get("columns"), dict):
        expected = expected["columns"]
    exp = spark.createDataFrame(list(expected.items()), "column_name string, expected_type string")
    tr = _schema_table(spark, train, "train")
    te = _schema_table(spark, test, "test")
    j = exp.join(tr, "column_name", "full_outer").join(te, "column_name", "full_outer")
    e, a, b = F.col("expected_type"), F.col("train_type"), F.col("test_type")
    state = (F.when(e.isNotNull() & a.isNull() & b.isNull(), "missing")
             .when(e.isNull() & F.lit(bool(expected)), "unexpected")
             .when(e.isNull(), "ok")
             .when(a.isNull() | b.isNull(), "ok")
             .when((F.lower(a) != F.lower(e)) | (F.lower(b) != F.lower(e)), "type_mismatch")
             .otherwise("ok"))
    frame = j.select("column_name", "expected_type", "train_type", "test_type", state.alias("state"))
    status = frame.where(F.col("state") != "ok").limit(1).count() == 0
    return status, frame


# ---------------------------------------------------------------- V3

def missing_rates(train: DataFrame, test: DataFrame, threshold: float = MISSING_THRESHOLD):
    """V3: per train column, NULL rate of both sides rounded to 4 (half-even)
    before comparing ``>`` threshold."""
    cols = train.columns
    tr = long_values(train, cols, _missing(train)).groupBy("position", "column_name").agg(
        F.bround(F.avg(F.col("x").cast("double")), 4).alias("train_missing"))
    test_cols = [c for c in cols if c in test.columns]
    te = long_values(test, test_cols, _missing(test)).groupBy("column_name").agg(
        F.bround(F.avg(F.col("x").cast("double")), 4).alias("test_missing")) if test_cols else None
    frame = tr.join(te, "column_name", "left") if te is not None else tr.withColumn(
        "test_missing", F.lit(None).cast("double"))
    thr = F.lit(float(threshold))
    frame = frame.select("position", "column_name", "train_missing", "test_missing",
                         ((F.col("train_missing") > thr) | F.coalesce(F.col("test_missing") > thr, F.lit(False)))
                         .alias("flagged"))
    status = frame.where("flagged").limit(1).count() == 0
    return status, frame


# ---------------------------------------------------------------- V4

def target_check(train: DataFrame, test: DataFrame, target: str, threshold: float = IMBALANCE_THRESHOLD):
    """V4: at least 2 distinct non-NULL values per side (raises); the largest
    share (NULL counted) above ``threshold`` on either side is a warning."""
    if not target:
        raise ValidationError("validation needs the name of a target")
    for side, df in (("train", train), ("test", test)):
        if target not in df.columns:
            raise ValidationError(f"the {side} side lacks the target {target!r}")

    def dist(df, side):
        n = df.count()
        counts = df.groupBy(qcol(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))
        return counts.select(F.lit(side).alias("side"), "class", "count",
                             (F.col("count") / F.lit(float(n))).alias("raw_share"))

    d = dist(train, "train").unionByName(dist(test, "test"))
    summary = d.groupBy("side").agg(F.count("class").alias("n_unique"), F.max("raw_share").alias("majority_share"))
    stats = {r["side"]: (r["n_unique"], r["majority_share"]) for r in summary.collect()}
    for side in ("train", "test"):
        if stats.get(side, (0, 0))[0] < 2:
            raise ValidationError(f"one value of {target!r} or none on the {side} side")
    warn = any(stats[s][1] > threshold for s in stats)
    frame = d.join(summary, "side").select(
        "side", "class", "count", F.bround("raw_share", 4).alias("share"), "n_unique",
        F.col("majority_share"), (F.col("majority_share") > F.lit(threshold)).alias("imbalanced"))
    return True, frame, warn


# ---------------------------------------------------------------- V5

def drift(train: DataFrame, test: DataFrame, target: str | None = None, threshold: float = DRIFT_THRESHOLD):
    """V5: per drift-numeric column in both sides (target excluded)

    score = max(|mean diff| / max(|train mean|, |train std|, 1),
                |std diff|  / max(|test mean|,  |test std|,  1))

    with sample std; a side without values counts as mean 0 and std 0; drift
    when the unrounded score exceeds ``threshold``.
    """
    num_test = set(qt.drift_numeric(test))
    cols = [c for c in qt.drift_numeric(train) if c in num_test and c != target]
    spark = train.sparkSession
    if not cols:
        return True, spark.createDataFrame([], "position int, column_name string, train_mean double, "
                                               "test_mean double, train_std double, test_std double, "
                                               "drift_score double, drift_detected boolean")

    def side_stats(df, tag):
        x = F.col("x")
        return long_values(df, cols).groupBy("position", "column_name").agg(
            F.coalesce(F.avg(x), F.lit(0.0)).alias(f"{tag}_mean"),
            F.when(F.count(x) == 0, F.lit(0.0)).otherwise(F.stddev_samp(x)).alias(f"{tag}_std"))

    j = side_stats(train, "train").join(side_stats(test, "test").drop("column_name"), "position")
    tm, ts, em, es = (F.col(c) for c in ("train_mean", "train_std", "test_mean", "test_std"))
    one = F.lit(1.0)
    score = F.greatest(F.abs(tm - em) / F.greatest(F.abs(tm), F.abs(ts), one),
                       F.abs(ts - es) / F.greatest(F.abs(em), F.abs(es), one))
    frame = j.select("position", "column_name", "train_mean", "test_mean", "train_std", "test_std",
                     score.alias("drift_score"), (score > F.lit(float(threshold))).alias("drift_detected"))
    status = frame.where("drift_detected").limit(1).count() == 0
    return status, frame


# ---------------------------------------------------------------- V6, V7

def side_profile(df: DataFrame, numeric: list[str]) -> dict:
    """One scan of one side: row count, and per column the NULL count, and for
    drift-numeric columns the mean and sample std (long form, few buffers per
    group, so the aggregate stays in codegen). Returns ``{column: dict}`` and
    the row count under ``None``."""
    cols = df.columns
    num = set(numeric)
    if not cols:
        return {None: df.count()}
    missing = _missing(df)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), missing(c).alias("isnull"),
                 (nan_to_null(qcol(c).cast("double")) if c in num else F.lit(None).cast("double")).alias("x"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")
    x = F.col("x")
    rows = long.groupBy("position").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("isnull")).alias("nulls"), F.count(x).alias("k"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).collect()
    out = {cols[r["position"]]: r.asDict() for r in rows}
    out[None] = rows[0]["n"] if rows else 0
    return out


def _score(tm, ts, em, es):
    """The V5 score in plain floats; a missing std is skipped like ``greatest`` skips NULL."""
    def big(*v):
        return max(x for x in v if x is not None)
    a = abs(tm - em) / big(abs(tm), abs(ts) if ts is not None else None, 1.0)
    if ts is None or es is None:
        return a
    return max(a, abs(ts - es) / big(abs(em), abs(es), 1.0))


def validate(train: DataFrame, test: DataFrame, target: str, expected_schema: dict | None = None,
             missing_threshold: float = MISSING_THRESHOLD, drift_threshold: float = DRIFT_THRESHOLD,
             imbalance_threshold: float = IMBALANCE_THRESHOLD) -> ValidationReport:
    """V1-V6 with shared scans: one profile aggregate per side feeds the
    integrity counts (V1), the missing rates (V3) and the drift statistics
    (V5); the schema check (V2) reads no data; the target check (V4) is one
    grouped count per side. PASS when all checks are true."""
    spark = train.sparkSession
    rep = ValidationReport()
    num_test = set(qt.drift_numeric(test))
    drift_cols = [c for c in qt.drift_numeric(train) if c in num_test and c != target]
    ptr = side_profile(train, [c for c in qt.drift_numeric(train)])
    pte = side_profile(test, [c for c in qt.drift_numeric(test)])
    n_train, n_test = ptr[None], pte[None]
    # V1
    if n_train == 0:
        raise ValidationError("no training rows")
    if n_test == 0:
        raise ValidationError("no test rows")
    a, b = set(train.columns), set(test.columns)
    rep.checks["data_integrity"] = a == b
    rep.frames["data_integrity"] = spark.createDataFrame(
        [(a == b, n_train, len(train.columns), n_test, len(test.columns), ",".join(sorted(a ^ b)))],
        "status boolean, train_rows long, train_columns int, test_rows long, test_columns int, "
        "column_mismatch string")
    # V2
    rep.checks["schema_validation"], rep.frames["schema_validation"] = schema_check(train, test, expected_schema)
    # V3: rates rounded half-even to 4 before the comparison
    rows, flagged = [], []
    for i, c in enumerate(train.columns):
        tr = round(ptr[c]["nulls"] / n_train, 4)
        te = round(pte[c]["nulls"] / n_test, 4) if c in pte else None
        flag = tr > missing_threshold or (te is not None and te > missing_threshold)
        rows.append((i, c, tr, te, flag))
        flagged.append(flag)
    rep.checks["missing_values"] = not any(flagged)
    rep.frames["missing_values"] = spark.createDataFrame(
        rows, "position int, column_name string, train_missing double, test_missing double, flagged boolean")
    # V4
    ok, frame, warn = target_check(train, test, target, imbalance_threshold)
    rep.checks["target_column"], rep.frames["target_column"] = ok, frame
    if warn:
        rep.warnings.append(f"one class of {target!r} has nearly all rows")
    # V5
    rows, drifted = [], []
    for i, c in enumerate(drift_cols):
        s_tr, s_te = ptr[c], pte[c]
        tm = s_tr["mean"] if s_tr["k"] else 0.0
        em = s_te["mean"] if s_te["k"] else 0.0
        ts = (s_tr["std"] if s_tr["k"] else 0.0)
        es = (s_te["std"] if s_te["k"] else 0.0)
        score = _score(tm, ts, em, es)
        rows.append((train.columns.index(c), c, tm, em, ts, es, score, score > drift_threshold))
        drifted.append(score > drift_threshold)
    rep.checks["data_drift"] = not any(drifted)
    rep.frames["data_drift"] = spark.createDataFrame(
        rows, "position int, column_name string, train_mean double, test_mean double, train_std double, "
              "test_std double, drift_score double, drift_detected boolean")
    return rep


def gate(report: ValidationReport) -> None:
    """V7: a failed validation stops the run."""
    if not report.passed:
        failed = [k for k, v in report.checks.items() if not v]
        raise ValidationError(f"failed checks: {failed}")


def spark_type_name(dt: T.DataType) -> str:
    return dt.simpleString()
