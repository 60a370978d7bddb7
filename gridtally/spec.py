"""Declarative description of a dataset; every job in the package is driven by one of these."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Outcome names of the date classification.
PARSED = "parsed_datetime"
TIME_ONLY = "time_only"
FAILED = "failed"
MISSING = "missing"
FAILED_OR_MISSING = "failed_or_missing"
UNKNOWN = "unknown"

# Duplicate policies; any other text means keep_all.
DUPLICATE_POLICIES = ("keep_all", "drop_first", "drop_last", "error")

# Columns that record where a row was read; they order rows and never count as data.
ROW_ORDINAL = "row_ordinal"
SOURCE_FILE = "source_file"


@dataclass(frozen=True)
class DatePolicy:
    """How the text date column of a dataset becomes typed time columns.

    style "full": every value should hold a date; a success flag is derived.
    style "classified": values may hold only a time of day; a four-way status is derived.
    """

    column: str
    style: str = "full"
    prefix: str = ""
    day_first: bool = False
    extra_formats: tuple[str, ...] = ()
    per_file: bool = False
    # Years that fit whole into 64-bit nanoseconds. Dates outside, such as the placeholder
    # 9999-12-31, are not dates.
    min_year: int = 1678
    max_year: int = 2261

    def __post_init__(self) -> None:
        if self.style not in ("full", "classified"):
            raise ValueError(f"unknown date style: {self.style}")

    @property
    def raw(self) -> str:
        return f"{self.column}_raw"

    @property
    def parsed(self) -> str:
        return f"{self.column}_parsed"

    @property
    def success(self) -> str:
        return f"{self.column}_parse_success"

    @property
    def status(self) -> str:
        return f"{self.column}_parse_status"

    @property
    def is_time_only(self) -> str:
        return f"{self.column}_is_time_only"

    @property
    def time_only_text(self) -> str:
        return f"{self.column}_time_only_text"

    @property
    def time_hour(self) -> str:
        return f"{self.column}_time_hour"

    @property
    def date(self) -> str:
        return f"{self.prefix}date"

    @property
    def month(self) -> str:
        return f"{self.prefix}month"

    @property
    def week(self) -> str:
        return f"{self.prefix}week"

    @property
    def day_of_week(self) -> str:
        return f"{self.prefix}day_of_week"

    @property
    def hour(self) -> str:
        return f"{self.prefix}hour"

    @property
    def analysis_hour(self) -> str:
        return "analysis_hour"

    def derived_fields(self) -> list[tuple[str, T.DataType]]:
        """Names and types of the derived columns, in table order."""
        text, ts, day = T.StringType(), T.TimestampNTZType(), T.DateType()
        flag, whole = T.BooleanType(), T.IntegerType()
        calendar = [(self.date, day), (self.month, text), (self.week, whole), (self.day_of_week, text)]
        if self.style == "full":
            return [(self.raw, text), (self.parsed, ts), (self.success, flag), *calendar]
        return [
            (self.raw, text),
            (self.status, text),
            (self.is_time_only, flag),
            (self.parsed, ts),
            (self.time_only_text, text),
            (self.time_hour, whole),
            *calendar,
            (self.hour, whole),
            (self.analysis_hour, whole),
        ]


@dataclass(frozen=True)
class Thresholds:
    outlier_iqr_multiplier: float = 1.5
    max_future_days: int = 0
    stale_days: int = 90
    full_datetime_warning_pct: float = 70.0


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    display_name: str
    required_columns: tuple[str, ...]
    numeric_columns: tuple[str, ...]
    candidate_keys: tuple[str, ...]
    date: DatePolicy
    measure: str
    second_measure: str | None = None
    category: str | None = None
    file_patterns: tuple[str, ...] = ()
    # Digits kept when measures are summed as decimals, so that a sum does not depend on
    # the order in which partial sums meet. None sums plain doubles.
    measure_scale: int | None = None
    allow_lists: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    known_limitations: tuple[str, ...] = ()
    date_limitation: str | None = None
    duplicate_policy: str = "keep_all"
    dedup_exclude: tuple[str, ...] = ()
    thresholds: Thresholds = Thresholds()
    multi_line: bool = False
    malformed_policy: str = "fail_file"

    def __post_init__(self) -> None:
        if self.malformed_policy not in ("fail_file", "quarantine"):
            raise ValueError(f"unknown malformed policy: {self.malformed_policy}")

    @property
    def entity(self) -> str:
        return self.candidate_keys[0]

    def struct_type(self) -> T.StructType:
        """Schema of the typed table when only the required columns are present."""
        fields: dict[str, T.DataType] = {}
        for name in self.required_columns:
            fields[name] = T.DoubleType() if name in self.numeric_columns else T.StringType()
        fields[SOURCE_FILE] = T.StringType()
        fields.update(self.date.derived_fields())
        return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def resolve_duplicate_policy(mode: object) -> str:
    """Name of the duplicate policy; unknown names fall back to keep_all."""
    text = str(mode).strip().lower()
    return text if text in DUPLICATE_POLICIES else "keep_all"


# Limitation texts shown with every quality report.
LIMITATIONS = (
    "No common key currently exists between consumption and vend datasets.",
    "Vend issuedate may be incomplete or time-only in the current source extracts.",
    "Combined analysis should remain a placeholder until a valid linking key or mapping table is available.",
)
VEND_DATE_LIMITATION = (
    "Vend issuedate parsing is provisional. If source values are incomplete or "
    "time-only, the app preserves that limitation instead of inventing a full datetime."
)

CONSUMPTION = DatasetSpec(
    name="consumption",
    display_name="Consumption",
    required_columns=("mtrid", "midnightdate", "kwh_abs", "kvah_abs", "kwh_consumption", "kvah_consumption"),
    numeric_columns=("kwh_abs", "kvah_abs", "kwh_consumption", "kvah_consumption"),
    candidate_keys=("mtrid",),
    date=DatePolicy(column="midnightdate", style="full"),
    measure="kwh_consumption",
    second_measure="kvah_consumption",
    file_patterns=("*consumption*.csv",),
    known_limitations=LIMITATIONS,
)

VEND = DatasetSpec(
    name="vend",
    display_name="Vend / Recharge",
    required_columns=("servicepointno", "meterno", "categorycode", "transactionamount", "issuedate"),
    numeric_columns=("transactionamount",),
    candidate_keys=("servicepointno", "meterno"),
    date=DatePolicy(column="issuedate", style="classified", prefix="vend_"),
    measure="transactionamount",
    category="categorycode",
    file_patterns=("vend-*.csv",),
    known_limitations=LIMITATIONS,
    date_limitation=VEND_DATE_LIMITATION,
)
