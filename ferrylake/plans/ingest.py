"""Land a folder of CSV text, vote and settle its types, register the
raw table, write typed Parquet and register it, leaving a run ledger.

The driver only sequences the steps; each step is a Spark job (or catalog
DDL). Nothing but small per-column results (the profile, one row per column)
comes back to the driver.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylake.functions.scalars import has_suffix
from ferrylake.operators import apply as R6
from ferrylake.operators import profile as A
from ferrylake.operators import resolve as R
from ferrylake.plans import bulk as B
from ferrylake.plans import catalog as T
from ferrylake.plans.publish import publish
from ferrylake.session import remove_scratch, scratch_path
from ferrylake.sources import text as S
from ferrylake.sources.inventory import kind_of, object_inventory
from ferrylake.sources.schema_store import save_schema

RUN_LEDGER_SCHEMA = "run_id string, seq int, step string, success boolean, detail string"


@dataclass
class IngestRun:
    run_id: str
    steps: list = field(default_factory=list)
    errors: list = field(default_factory=list)
    locations: dict = field(default_factory=dict)
    next: str | None = None
    open_columns: list = field(default_factory=list)
    database: str | None = None
    table: str | None = None
    parquet_table: str | None = None
    _clock: float = field(default_factory=time.time)

    @property
    def success(self) -> bool:
        return not self.errors

    def step(self, name: str, ok: bool, **detail) -> None:
        now = time.time()
        detail["seconds"] = round(now - self._clock, 3)
        self._clock = now
        self.steps.append((name, bool(ok), json.dumps(detail, default=str, sort_keys=True)))
        if not ok:
            self.errors.append({"step": name, **detail})


def run_ledger(spark: SparkSession, run: IngestRun) -> DataFrame:
    """The run's steps in order as a DataFrame."""
    rows = [(run.run_id, i, s, ok, d) for i, (s, ok, d) in enumerate(run.steps)]
    return spark.createDataFrame(rows, RUN_LEDGER_SCHEMA)


def _passed_over(key: str) -> Column:
    """CSV objects that Spark does not list: ``_`` or ``.`` begins a part of the key."""
    return has_suffix(key) & F.col(key).rlike(r"(^|/)[_.]")


def _name_hash(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:8]


def ingest(spark: SparkSession, path: str, lake_root: str, database: str | None = None,
           table: str | None = None, choices: DataFrame | None = None,
           convert_to_parquet: bool = True, mode: str = "exclusive",
           raw_prefix: str = "raw/", processed_prefix: str = "processed/",
           ledger_root: str | None = None, multi_line: bool = True,
           report_rejects: bool = False, checksums: bool = False) -> IngestRun:
    """``path`` (a folder or one CSV file) -> tables in the catalog.

    Every dataset has places of its own, ``raw|processed|rejects/<database>/<table>``
    of the lake, and only its own are read. A second run copies what is new or changed
    and removes what left the source (``checksums``: by content, not by times); the
    typed table shows the old rows until the new ones are written whole. A source
    that is not there, CSV files that Spark would pass over (names that begin with
    ``_`` or ``.``) and a table registered with other columns are failures.

    Steps: sync to ``lake_root/raw_prefix`` (B8) -> read all CSVs landed there
    together (S1) -> vote (A6, ``mode``) -> settle with ``choices`` (R2) ->
    stop with ``next='disambiguate'`` if columns stay open (R5) -> database
    (T1) -> raw CSV table (T4) -> typed Parquet (R6, S5) published as the table
    ``<table>_parquet`` (T4, ``publish``) -> [rejects, R7, with ``report_rejects``] ->
    settled schema saved (S8). Any failed step makes the run failed. ``ledger_root`` receives the run ledger (I2) as Parquet.
    """
    run = IngestRun(run_id=uuid.uuid4().hex)
    lake = lake_root.rstrip("/")
    src = path.rstrip("/")
    try:
        db_name = T.slug_name(database or f"db_{_name_hash(run.run_id)}", "db")
        tbl_name = T.slug_name(table or f"tbl_{_name_hash(run.run_id + 't')}", "tbl")
        own = f"{db_name}/{tbl_name}"
        # 1. land
        kind = kind_of(src)
        if kind == "missing":
            run.step("land", False, error=f"no such file or folder: {path}")
            return _finish(spark, run, ledger_root)
        folder, only = src.rsplit("/", 1) if kind == "file" else (src, None)
        raw_root = f"{lake}/{raw_prefix.strip('/')}/{own}"
        landed = scratch_path(spark, "land-ledger")
        inv = object_inventory(spark, folder)
        if only is not None:
            inv = inv.filter(F.col("key") == only)
        plan = B.write_plan(B.sync_plan(spark, inv, raw_root, checksums=checksums))
        ledger = B.run_sync(spark, plan, landed)
        removed = F.col("action") == "remove"
        counts = ledger.groupBy().agg(F.count_if(F.col("action") == "copy").alias("n"),
                                      F.count_if(F.col("status") != "ok").alias("failed"),
                                      F.count_if(F.col("action") == "unchanged").alias("same"),
                                      F.count_if(removed).alias("removed"),
                                      F.count_if(has_suffix("dst_key") & ~removed).alias("csv"),
                                      F.count_if(_passed_over("dst_key") & ~removed)
                                      .alias("hidden")).first()
        run.step("land", counts["failed"] == 0, uploaded=counts["n"], failed=counts["failed"],
                 unchanged=counts["same"], removed=counts["removed"])
        run.locations["raw"] = raw_root
        if counts["failed"]:
            return _finish(spark, run, ledger_root)
        if counts["csv"] == 0:
            run.step("find_csv", True, message="nothing to ingest: no CSV file among the objects")
            return _finish(spark, run, ledger_root)
        if counts["hidden"]:
            some = [r["key"] for r in ledger.filter(_passed_over("dst_key") & ~removed)
                    .select("key").orderBy("key").limit(5).collect()]
            run.step("find_csv", False, files=counts["hidden"], first=some,
                     error="CSV files whose names begin with _ or . would not be read")
            return _finish(spark, run, ledger_root)
        remove_scratch(spark, landed, plan)

        # 2-3. read every landed CSV together and vote (Spark lists them)
        text = S.read_text_table(spark, raw_root, multi_line=multi_line, csv_only=True)
        try:
            inferred = A.infer_schema(text, mode=mode)
        except ValueError as e:
            run.step("infer_schema", False, error=str(e))
            return _finish(spark, run, ledger_root)
        prof = inferred.profile
        run.step("infer_schema", True, columns=inferred.columns, ambiguous=inferred.ambiguous)

        # 4. settle with the choices; stop if columns stay open
        if choices is not None:
            bad = R.invalid_choices(choices, text.columns).collect() + [
                (r["column"], r["types"]) for r in R.contradictions(choices).collect()
                if "seq" not in choices.columns]
            if bad:
                run.step("choices", False, invalid=[r.asDict() if hasattr(r, "asDict") else r for r in bad])
                return _finish(spark, run, ledger_root)
            prof = R.resolve(prof, choices)
        open_cols = [r["column"] for r in (R.open_after_choices(prof, choices) if choices is not None
                                           else R.open_columns(prof)).collect()]
        if open_cols:
            run.next = "disambiguate"
            run.open_columns = open_cols
            run.step("disambiguate", True, open_columns=open_cols)
            return _finish(spark, run, ledger_root)
        schema = R.settled_schema(prof)
        pairs = R.schema_pairs(schema)

        # 5. database
        res = T.create_database(spark, db_name)
        run.step("create_database", res["success"], **res)
        if not res["success"]:
            return _finish(spark, run, ledger_root)
        run.database = res["database"]

        # 6. raw CSV table over the landed folder, every column as text: the CSV
        # reader's own casts take other values than the vote does (1_000, yes,
        # 5-1-2024), so the types are given by the casts of step 7 alone
        cols = [{"Name": n, "Type": "string"} for n, _ in pairs]
        res = T.register_table(spark, run.database, tbl_name, raw_root, cols, fmt="csv",
                               multi_line=multi_line)
        run.step("create_table_raw", res["success"], **res)
        if not res["success"]:
            return _finish(spark, run, ledger_root)
        run.table = res["table"]

        # 7. typed Parquet + its table (written schema)
        if convert_to_parquet:
            typed = R6.apply_schema(text, pairs)
            res = publish(typed, f"{lake}/{processed_prefix.strip('/')}/{own}", run.database,
                          f"{run.table}_parquet")
            if res["success"]:
                out = res["location"]
                rows = spark.read.parquet(out).count()      # from the files' footers
                run.step("write_parquet", True, location=out, rows=rows)
                run.locations["processed"] = out
                run.parquet_table = res["table"]
            run.step("create_table_parquet", res["success"], **res)

        # 7b. values the settled types cannot hold (a second pass over the text)
        if report_rejects:
            rej_out = f"{lake}/rejects/{own}"
            R6.rejects(text, pairs).write.mode("overwrite").parquet(rej_out)
            n = spark.read.parquet(rej_out).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            run.step("rejects", True, location=rej_out, values=int(n))
            run.locations["rejects"] = rej_out

        # 8. keep the settled schema
        store = f"{lake}/_schemas"
        save_schema(schema, store, f"{run.database}.{run.table}")
        run.step("save_schema", True, store=store)
        run.locations["schema_store"] = store
    except Exception as e:  # noqa: BLE001 - every failure lands in the ledger
        run.step("error", False, error=f"{type(e).__name__}: {e}")
    return _finish(spark, run, ledger_root)


def _finish(spark: SparkSession, run: IngestRun, ledger_root: str | None) -> IngestRun:
    if ledger_root:
        run_ledger(spark, run).coalesce(1).write.mode("append").parquet(ledger_root)
    return run
