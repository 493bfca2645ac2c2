"""The layered tables raw -> staging -> marts, each written once when first needed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.config import Period, Settings
from shelfwise.operators import abc
from shelfwise.plans import marts, staging
from shelfwise.session import cuts_so_far, drop_cuts, shared_dir, write_and_read
from shelfwise.sources import versions
from shelfwise.sources.retail_feed import PERIOD, RetailFeed
from shelfwise.sources.schemas import RAW_TABLES

_opened: dict[tuple[str, str], "Warehouse"] = {}

PARTITION = {
    "fact_sales": "sales_month",
    "daily_sales": "sales_month",
    "daily_moments": "moments_of",
    "summed_moments": "moments_of",
    "product_moments": "moments_of",
    "fact_inventory_snapshot": "snapshot_type",
}


# their tasks hold few values of the partition column, so that they are written as they are
LAID_OUT = {"daily_sales", "daily_moments", "summed_moments", "product_moments", "fact_inventory_snapshot"}

# of the feed: projections of stored tables without a shuffle, and invoices, of which only two
# columns are used; they are computed where they are read, and only the columns that are
FEED_VIEWS = {"raw_sales", "raw_purchases", "raw_invoice_purchases", *staging.STAGED, "beg_places", "end_places"}


class Warehouse:
    """Tables by name. ``build`` plans one from its inputs; ``table`` stores it first.

    Each stored table has a manifest: the stamps of the tables it was built from, and for raw
    tables path, length and time of the files behind them. A table whose manifest still holds is
    read as it is, also by a later application over the same folder; others are built anew, as
    versions beside the old one. Stamps are looked at when a table is first asked for, and again
    after ``refresh``; ``over_feed`` refreshes by itself if files have changed.

    ``raw`` maps each raw table to a function that gives its DataFrame. ``views`` are never
    stored: ``table`` gives their plan, and their stamp comes from those of their inputs.
    """

    def __init__(
        self,
        spark: SparkSession,
        raw: dict[str, Callable[["Warehouse"], DataFrame]],
        period: Period,
        folder: str,
        raw_is_stored: bool = False,
        views: Iterable[str] = (),
    ):
        self.spark = spark
        self.settings = Settings(period)
        self.folder = folder
        self._raw = raw
        self._raw_is_stored = raw_is_stored
        self._views = frozenset(views)
        self._stored: dict[str, DataFrame] = {}
        self._stamps: dict[str, str] = {}
        self._folders: dict[str, list[str]] = {}
        self._asked: list[list[str]] = []

    @classmethod
    def over_feed(cls, spark: SparkSession, data_folder: str) -> "Warehouse":
        """The warehouse over the order tables in ``data_folder``, one per application."""
        key = (spark.sparkContext.applicationId, data_folder)
        if key not in _opened:
            feed = RetailFeed(spark, data_folder)
            raw = {
                "feed_lines": lambda w: feed.lines(),
                "raw_sales": lambda w: feed.sales(w.table("feed_lines")),
                "raw_purchases": lambda w: feed.purchases(w.table("feed_lines")),
                "raw_beg_inventory": lambda w: feed.beg_inventory(w.table("feed_lines")),
                "raw_end_inventory": lambda w: feed.end_inventory(w.table("feed_lines")),
                "beg_places": lambda w: feed.counted_places(w.table("feed_lines"), "raw_beg_inventory"),
                "end_places": lambda w: feed.counted_places(w.table("feed_lines"), "raw_end_inventory"),
                "raw_purchase_prices": lambda w: feed.purchase_prices(w.table("feed_lines")),
                "raw_invoice_purchases": lambda w: feed.invoice_purchases(
                    w.table("raw_purchases")
                ),
            }
            name = hashlib.sha1(data_folder.encode()).hexdigest()[:10]
            _opened[key] = cls(spark, raw, PERIOD, f"{shared_dir(spark)}/{name}", views=FEED_VIEWS)
        elif _opened[key].has_changed():
            _opened[key].refresh()
        return _opened[key]

    @classmethod
    def over_raw(
        cls,
        spark: SparkSession,
        raw: dict[str, DataFrame | Callable[[], DataFrame]],
        period: Period,
        folder: str,
    ) -> "Warehouse":
        """The warehouse over raw tables that are stored already, e.g. loaded from CSV.

        A function is called again after ``refresh`` and so reads files that were added; a
        DataFrame keeps the files it was made with.
        """
        given = {n: (lambda w, df=df: df() if callable(df) else df) for n, df in raw.items()}
        return cls(spark, given, period, folder, raw_is_stored=True)

    def raw_tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in RAW_TABLES}

    def staged_tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in staging.STAGED}

    # -- what is still good -------------------------------------------------------

    def _place(self, name: str) -> str:
        layer = "raw" if name in self._raw else "staging" if name in staging.STAGED else "marts"
        return f"{self.folder}/{layer}/{name}"

    def _outside(self, df: DataFrame) -> list[str]:
        """The folders of the files that ``df`` reads, but for those of this warehouse's tables."""
        own = [f"{self.folder}/{layer}/" for layer in ("raw", "staging", "marts")]
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        return sorted(f for f in folders if self._raw_is_stored or not any(o.partition(":")[2] in f for o in own))

    def has_changed(self) -> bool:
        """Whether files behind a raw table are not what they were."""
        return any(
            versions.stamp_of(versions.files_below(self.spark, folders)) != self._stamps[f"files of {name}"]
            for name, folders in self._folders.items()
        )

    def refresh(self) -> None:
        """Look at all manifests again; only tables whose inputs changed are built anew."""
        self._stored, self._stamps, self._folders = {}, {}, {}

    def _files_stamp(self, name: str, folders: list[str]) -> str:
        self._folders[name] = folders
        stamp = versions.stamp_of(versions.files_below(self.spark, folders))
        self._stamps[f"files of {name}"] = stamp
        return stamp

    def _holds(self, manifest: dict | None, name: str) -> bool:
        if manifest is None or manifest["period"] != str(self.settings.period):
            return False
        if name in self._raw and not manifest["folders"] and not manifest["inputs"]:
            return False  # made from no files: nothing to tell by
        if manifest["folders"] and self._files_stamp(name, manifest["folders"]) != manifest["files"]:
            return False
        for other, stamp in manifest["inputs"].items():
            self.table(other)
            if self._stamps[other] != stamp:
                return False
        return True

    def table(self, name: str) -> DataFrame:
        for asked in self._asked[-1:]:
            if name not in asked:
                asked.append(name)
        if name not in self._stored:
            self._asked.append([])
            try:
                self._stored[name] = self._open(name)
            finally:
                self._asked.pop()
        return self._stored[name]

    def _open(self, name: str) -> DataFrame:
        if name in RAW_TABLES and self._raw_is_stored:
            df = self._raw[name](self)
            folders = self._outside(df)
            # without files, such as rows given by a test, every warehouse has its own
            self._stamps[name] = self._files_stamp(name, folders) if folders else uuid.uuid4().hex
            return df
        if name in self._views:
            return self._view(name)
        place = self._place(name)
        manifest = versions.read_manifest(self.spark, f"{place}/manifest.json")
        if self._holds(manifest, name):
            self._stamps[name] = manifest["stamp"]
            schema = T.StructType.fromJson(manifest["schema"])
            return self.spark.read.schema(schema).parquet(f"{place}/version={manifest['version']:06d}")
        return self._store(name, place)

    def _view(self, name: str) -> DataFrame:
        df = self.build(name)
        folders = self._outside(df) if name in self._raw else []
        files = self._files_stamp(name, folders) if folders else ""
        inputs = {other: self._stamps[other] for other in self._asked[-1]}
        about = json.dumps([str(self.settings.period), files, inputs], sort_keys=True)
        self._stamps[name] = hashlib.sha1(about.encode()).hexdigest()
        return df

    def _store(self, name: str, place: str) -> DataFrame:
        self._asked[-1].clear()
        before = cuts_so_far(self.spark)
        df = self.build(name)
        inputs = {other: self._stamps[other] for other in self._asked[-1]}
        folders = self._outside(df) if name in self._raw else []
        files = self._files_stamp(name, folders) if folders else ""
        if name in staging.STAGED:
            df = staging.stamped(df)
        if name == "fact_sales":
            df = df.withColumn("sales_month", marts.sales_month(F.col("sales_date")))
        new = versions.Replacement(self.spark, place)
        stored = write_and_read(df, new.path, PARTITION.get(name), rebalance=name not in LAID_OUT)
        new.publish()
        self._stamps[name] = uuid.uuid4().hex
        versions.write_manifest(
            self.spark,
            f"{place}/manifest.json",
            {
                "stamp": self._stamps[name],
                "version": new.number,
                "period": str(self.settings.period),
                "inputs": inputs,
                "folders": folders,
                "files": files,
                "schema": json.loads(df.schema.json()),
            },
        )
        # copies made on the way to this table have served their purpose
        drop_cuts(self.spark, since=before)
        return stored

    def _places(self, count: str) -> DataFrame:
        """Stores and cities of a stock count; where the raw side tells them by themselves, the
        stores wait for no stock count."""
        staged, alone = f"stg_{count}_inventory", f"{count}_places"
        if alone not in self._raw:
            return self.table(staged)
        return staging.staged_columns(self.table(alone), staged, ["store", "city"])

    def build(self, name: str) -> DataFrame:
        """The plan of a table over its stored inputs."""
        t = self.table
        if name in self._raw:
            return self._raw[name](self)
        if name in staging.STAGED:
            return staging.stage(t(staging.STAGED_FROM[name]), name, self.settings.period)
        if name == "dim_vendor":
            return marts.dim_vendor(
                t("stg_purchases"),
                t("stg_sales"),
                t("stg_invoice_purchases"),
                t("stg_purchase_prices"),
            )
        if name == "dim_store":
            return marts.dim_store(self._places("beg"), self._places("end"), t("stg_sales"))
        if name == "product_base":
            return marts.product_base(t("stg_purchase_prices"), t("stg_sales"))
        if name == "fact_sales":
            return marts.fact_sales(
                t("stg_sales"), t("product_base"), t("dim_store"), t("dim_vendor")
            )
        if name == "daily_sales":
            return marts.daily_sales_of(t("stg_sales"), t("product_base"), t("dim_store"))
        if name == "daily_moments":
            return marts.daily_moments(t("daily_sales"), t("dim_product"))
        if name == "summed_moments":
            return marts.daily_moments(t("daily_sales"), t("dim_product"), marts.COARSE_KEYS)
        if name == "product_moments":
            return marts.daily_moments(t("daily_sales"), None, marts.PRODUCT_KEYS)
        if name == "fact_inventory_snapshot":
            return marts.fact_inventory_snapshot(
                t("stg_beg_inventory"), t("stg_end_inventory"), t("product_base"), t("dim_store")
            )
        if name == "abc_running_total":
            return abc.with_running_total(abc.revenue_by_brand(t("stg_sales"), t("product_base")))
        if name == "dim_product":
            return abc.classified(t("product_base"), abc.labels(t("abc_running_total")))
        if name == "dim_date":
            return marts.dim_date(t("stg_sales"))
        raise KeyError(name)
