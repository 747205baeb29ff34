"""Lists of steps over tables: preparation, transformations, and resumable runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import content_words
from ..operators import clean, dates, encode, profile, reduce, scale, text
from ..operators.userfn import apply_user_function
from ..schema import TableError, as_timestamp, numeric_columns, q, string_columns
from ..session import durable
from ..sources import scan_parquet, sink_parquet

AUDIT_SCHEMA = "position int, step string, action string, column string, affected_rows long"


@dataclass
class Preparation:
    """What to do with a raw table."""

    drop_duplicates: bool = True
    numeric_fill: str | None = "median"
    text_fill: str | None = "mode"
    outliers: str | None = None
    label_columns: Sequence[str] = ()
    onehot_columns: Sequence[str] = ()
    scale_columns: Sequence[str] = ()
    scaling: str = "standard"
    max_rows: int = 1_000_000
    missing_threshold: float = 0.8
    raise_on_error: bool = False


@dataclass
class Prepared:
    table: DataFrame
    issues: DataFrame
    audit: DataFrame
    artifacts: dict[str, Any] = field(default_factory=dict)


def preprocess(df: DataFrame, config: Preparation) -> Prepared:
    """Validate, clean, encode and scale. Each fit is one aggregate; the result stays lazy."""
    issues = profile.validate_dataset(df, config.max_rows, missing_threshold=config.missing_threshold, raise_on_error=config.raise_on_error)
    audit: list[tuple] = []
    artifacts: dict[str, Any] = {}

    def note(step: str, action: str, column: str | None, rows: int | None = None) -> None:
        audit.append((len(audit), step, action, column, rows))

    if config.drop_duplicates:
        # Every later fit reads these rows: kept once, they are not shuffled again each time.
        df = clean.drop_duplicates(df).persist(StorageLevel.MEMORY_AND_DISK)
        artifacts["cached_rows"] = df  # for the caller to unpersist once the result is written
        note("clean", "drop_duplicates", None)
    held = df.agg(F.count("*").alias("__rows"), *[F.count(q(c)).alias(c) for c in df.columns]).first()
    for kind, columns, strategy in (
        ("numeric", numeric_columns(df), config.numeric_fill),
        ("text", string_columns(df), config.text_fill),
    ):
        if not strategy or not columns:
            continue
        gaps = [c for c in columns if held[c] < held["__rows"]]
        fills = clean.fit_impute(df, strategy, gaps) if gaps else {}
        df = clean.apply_impute(df, fills)
        artifacts[f"{kind}_fill"] = fills
        for c in fills:
            note("clean", f"impute_{strategy}", c, held["__rows"] - held[c])
    if config.outliers:
        df = clean.outlier_iqr(df, config.outliers)
        note("clean", f"outlier_{config.outliers}", None)
    for c in config.label_columns:
        artifacts[f"label_{c}"] = cats = encode.fit_categories(df, c)
        df = encode.apply_label(df, cats)
        note("encode", "label", c)
    for c in config.onehot_columns:
        df = encode.encode_onehot(df, c)
        note("encode", "onehot", c)
    if config.scale_columns:
        artifacts["scaler"] = scaler = scale.fit_scaler(df, list(config.scale_columns), config.scaling)
        df = scale.apply_scaler(df, scaler)
        for c in config.scale_columns:
            note("scale", config.scaling, c)
    return Prepared(df, issues, df.sparkSession.createDataFrame(audit, AUDIT_SCHEMA), artifacts)


def _scale(df: DataFrame, column: str | Sequence[str], method: str = "standard", custom_range: Sequence[float] = (0.0, 1.0)) -> DataFrame:
    return scale.scale_numeric(df, column, method, tuple(custom_range))


def _tokenize(
    df: DataFrame, column: str, method: str = "none", key: str | None = None, lemmas: DataFrame | None = None
) -> DataFrame:
    """`lemma` looks words up in the given dictionary; without one it stems, as the operator does."""
    if method == "lemma":
        return text.tokenize_lemma(df, column, key, lemmas)
    return {"none": text.tokenize_clean, "stem": text.tokenize_stem}[method](df, column)


def _user(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return apply_user_function(df, fn)[0]


# The names under which steps are listed in a specification.
ACTIONS: dict[str, Callable[..., DataFrame]] = {
    "extract_date_components": lambda df, column, components=tuple(dates.PARTS): dates.date_components(df, column, components),
    "extract_time_deltas": lambda df, date_col, reference_col="today", units=("days", "hours", "minutes"): dates.time_deltas(
        df, date_col, reference_col, units
    ),
    "encode_categorical": lambda df, column, method, custom_mapping=None: encode.encode_categorical(df, column, method, custom_mapping),
    "apply_frequency_encoding": lambda df, column: encode.encode_frequency(df, column),
    "scale_numeric": _scale,
    "tokenize_text": _tokenize,
    "apply_tfidf_vectorization": lambda df, column, max_features=1000: text.tfidf_wide(df, column, max_features),
    "apply_pca": lambda df, n_components, columns=None: reduce.pca(df, n_components, columns),
    "apply_user_function": _user,
    "impute": lambda df, strategy, columns=None, value=None: clean.impute(df, strategy, columns, value),
    "drop_duplicates": lambda df: clean.drop_duplicates(df),
}


# Steps whose fit reads one column, and those that change the rows, so that no fit may be taken before them.
_BY_CATEGORY = {"encode_categorical": ("label", "frequency", "count"), "apply_frequency_encoding": ("frequency",)}
_KEEPS_ROWS = ("extract_date_components", "extract_time_deltas", "encode_categorical", "apply_frequency_encoding", "scale_numeric", "tokenize_text")


def _parts(step: dict[str, Any]) -> tuple[str | None, dict[str, Any]]:
    return step.get("action") or step.get("function"), step.get("params") or step.get("args") or {}


def _counted(name: str | None, params: dict[str, Any]) -> str | None:
    """The encoding of a step that needs no more than the number of rows of each category."""
    methods = _BY_CATEGORY.get(name or "", ())
    method = params.get("method") if name == "encode_categorical" else "frequency"
    return method if method in methods else None


def _fits_of(df: DataFrame, steps: Sequence[dict[str, Any]]) -> dict[tuple[str, str, str], Any]:
    """Fits of columns that no step before has changed: all scalers from one aggregate and all categories from another, run together."""
    scaled: dict[str, list[str]] = {}
    listed: list[str] = []
    changed: set[str] = set()
    numeric = set(numeric_columns(df))
    for step in steps:
        name, params = _parts(step)
        column = params.get("column")
        if name not in _KEEPS_ROWS:
            break
        if not isinstance(column, str) or column not in df.columns or column in changed:
            continue
        if name == "scale_numeric" and column in numeric and scale.METHODS.get(params.get("method", "standard")) in ("minmax", "standard"):
            scaled.setdefault(scale.METHODS[params.get("method", "standard")], []).append(column)
        elif _counted(name, params):
            listed.append(column)
        if name in ("scale_numeric", "encode_categorical", "apply_frequency_encoding", "tokenize_text"):
            changed.add(column)
    tasks: list[Callable[[], dict]] = []
    if scaled:
        tasks.append(lambda: {("scale", m, c): f for m, found in scale.fit_scalers(df, scaled).items() for c, f in found.items()})
    if listed:
        tasks.append(lambda: {("categories", "", c): f for c, f in encode.fit_all_categories(df, listed).items()})
    if not tasks:
        return {}
    with ThreadPool(len(tasks)) as pool:
        found = pool.map(inheritable_thread_target(df.sparkSession)(lambda task: task()), tasks)
    return {k: v for part in found for k, v in part.items()}


def _run_step(df: DataFrame, name: str | None, params: dict[str, Any], fits: dict[tuple[str, str, str], Any], marked: int | None) -> DataFrame:
    """One step, with its fit where that is at hand; `marked` adds a column that tells rows whose value the step could not read."""
    if name not in ACTIONS:
        raise TableError(f"unknown action {name!r}")
    column = params.get("column")
    bad = None
    if marked is not None and name in ("extract_date_components", "extract_time_deltas"):
        for c in (params.get("column"), params.get("date_col"), params.get("reference_col")):
            if c in df.columns:
                miss = q(c).isNotNull() & as_timestamp(df, c).isNull()
                bad = miss if bad is None else bad | miss
    categories = fits.pop(("categories", "", column), None) if _counted(name, params) else None
    scaler = fits.pop(("scale", scale.METHODS.get(params.get("method", "standard"), ""), column), None) if name == "scale_numeric" and isinstance(column, str) else None
    # A mark of an earlier step is no column of the table for this one.
    marks = [c for c in df.columns if c.startswith(MARK)]
    if categories is not None:
        how = {"label": encode.apply_label, "frequency": lambda d, f: encode.encode_frequency(d, column, f), "count": lambda d, f: encode.encode_count(d, column, f)}
        changed = how[_counted(name, params)](df, categories)
    elif scaler is not None:
        low, high = params.get("custom_range", (0.0, 1.0))
        changed = scale.apply_scaler(df, replace(scaler, low=low, width=high - low) if scaler.method == "minmax" else scaler)
    else:
        changed = ACTIONS[name](df, **params)
    changed.schema  # resolve the plan here, so its errors belong to this step
    if any(m not in changed.columns for m in marks):
        raise TableError(f"{name} drops columns that it was not given")
    return changed if bad is None else changed.withColumn(f"{MARK}{marked}", bad)


MARK = "__step_failed_"


def _chain(df: DataFrame, steps: Sequence[tuple[int, dict[str, Any]]], continue_on_error: bool, mark: bool) -> tuple[DataFrame, list[tuple]]:
    fits = _fits_of(df, [s for _, s in steps])
    status = []
    for i, step in steps:
        name, params = _parts(step)
        try:
            df = _run_step(df, name, params, fits, i if mark else None)
            status.append((i, str(name), "success", None))
        except Exception as error:  # one bad step must not hide the others' results
            status.append((i, str(name), "error", str(error)[:500]))
            if not continue_on_error:
                break
    return df, status


def apply_transformations(
    df: DataFrame, steps: Sequence[dict[str, Any]], continue_on_error: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Run steps in order; returns the table and `(position, action, status, error)`.

    A failing step leaves the table as it was and is reported. Fits that do not depend on other steps are worked out together. The table is
    lazy: what goes wrong only when rows are read shows when it is used, or in `run_transformations`.
    """
    out, status = _chain(df, list(enumerate(steps)), continue_on_error, False)
    return out, df.sparkSession.createDataFrame(status, "position int, action string, status string, error string")


def run_transformations(
    df: DataFrame, steps: Sequence[dict[str, Any]], continue_on_error: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Run steps and write the table; returns it and `(position, action, status, failed_rows, error)` of what happened to its rows.

    Values that a step cannot read give no error: they are counted against the step in the same run, which reports it as `error` with their number, and
    its columns are missing in those rows. If the run itself fails, the first step that fails with all before it is found by halving, reported and left
    out, and the others are run again.
    """
    spark = df.sparkSession
    left = list(enumerate(steps))
    broken: dict[int, tuple] = {}
    while True:
        out, status = _chain(df, left, continue_on_error, True)
        marks = [c for c in out.columns if c.startswith(MARK)]
        try:
            # The marks are written with the rows, so counting them reads nothing else.
            written = durable(out)
            failed = written.agg(*[F.count_if(q(m)).alias(m) for m in marks]).first().asDict() if marks else {}
            break
        except Exception as error:
            good, bad = 0, len(left)  # the first `good` steps run, the first `bad` do not
            while bad - good > 1:
                middle = (good + bad) // 2
                try:
                    durable(_chain(df, left[:middle], continue_on_error, False)[0])
                    good = middle
                except Exception as closer:
                    bad, error = middle, closer
            i, step = left.pop(good)
            broken[i] = (i, str(_parts(step)[0]), "error", None, str(error)[:500])
            if not continue_on_error:
                left = left[:good]
    rows = list(broken.values())
    for i, name, state, error in status:
        if not continue_on_error and broken and i > min(broken):
            continue
        n = failed.get(f"{MARK}{i}")
        rows.append((i, name, "error" if n else state, n, f"{n} rows could not be read" if n else error))
    return written.drop(*marks), spark.createDataFrame(sorted(rows, key=lambda r: r[0]), "position int, action string, status string, failed_rows long, error string")


def pipeline_preview(df: DataFrame, steps: Sequence[dict[str, Any]], order: Sequence[str], rows: int = 100) -> tuple[DataFrame, DataFrame]:
    """The steps on the first rows only."""
    return apply_transformations(df.orderBy(*order).limit(rows), steps)


def export_steps(steps: Sequence[dict[str, Any]]) -> str:
    """JSON text of the steps with the hash of their content."""
    body = json.dumps(list(steps), sort_keys=True)
    return json.dumps({"steps": list(steps), "hash": hashlib.sha256(body.encode()).hexdigest()[:16]}, sort_keys=True)


def import_steps(content: str) -> list[dict[str, Any]]:
    loaded = json.loads(content)
    body = json.dumps(loaded["steps"], sort_keys=True)
    if hashlib.sha256(body.encode()).hexdigest()[:16] != loaded["hash"]:
        raise TableError("the steps do not match their hash")
    return loaded["steps"]


def pipeline_validate(steps: DataFrame) -> DataFrame:
    """Wrong dependencies of `(pipeline_id, position, depends_on)` rows.

    A step may only depend on earlier steps of its own list.
    """
    sizes = steps.groupBy("pipeline_id").agg(F.count("*").alias("steps"))
    deps = steps.select("pipeline_id", "position", F.explode("depends_on").alias("dependency")).join(sizes, "pipeline_id")
    problem = F.when(F.col("dependency") >= F.col("steps"), "missing_step").when(F.col("dependency") >= F.col("position"), "later_step")
    return deps.withColumn("problem", problem).filter(F.col("problem").isNotNull()).drop("steps")


@dataclass
class Step:
    name: str
    run: Callable[[DataFrame], DataFrame]


def _written(spark: SparkSession, path: str) -> bool:
    """A parquet folder is complete once its success marker is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def run_step_pipeline(df: DataFrame, steps: Sequence[Step], folder: str) -> tuple[DataFrame, DataFrame]:
    """Run steps one after the other, each writing its output below `folder`.

    A second run takes up after the last completed step; the first failure ends the run.
    Returns the last output and `(position, step, status, error)`.
    """
    spark = df.sparkSession
    status, current = [], df
    for i, step in enumerate(steps):
        path = f"{folder.rstrip('/')}/{i:02d}_{step.name}"
        if _written(spark, path):
            current = scan_parquet(spark, path)
            status.append((i, step.name, "resumed", None))
            continue
        try:
            current = scan_parquet(spark, sink_parquet(step.run(current), path))
            status.append((i, step.name, "completed", None))
        except Exception as error:  # reported with the step it belongs to
            status.append((i, step.name, "failed", str(error)[:500]))
            break
    return current, spark.createDataFrame(status, "position int, step string, status string, error string")


def word_count(df: DataFrame, column: str) -> DataFrame:
    """A table function used in examples: number of content words."""
    return df.withColumn(f"{column}_words", F.size(content_words(F.col(column))).cast("long"))
