"""Raw extracts -> clean events and machines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fieldcast import schemas as S
from fieldcast.functions.dates import month_span, month_start, parse_compact_date, parse_day, parse_month
from fieldcast.functions.text import composite_key, to_boolean
from fieldcast.operators.attach import apply_standard_configuration, attach_to_events, name_attachments
from fieldcast.operators.clean import drop_empty_columns, keep_emergencies
from fieldcast.operators.keys import left_join

# Columns of the attachment master and standard configuration.
MASTER_CODE = "周辺機機種略"
MASTER_NAME = "周辺機開発名"
MASTER_CLASS = "周辺機分類"
ATTACHMENT_NAME = "周辺機名"
DEVICE_CODE = "デバイスコード"
STANDARD_MODEL = "本体機種略"
STANDARD_DIGIT = "機番頭文字"
MACHINE_MODEL = "機種略号コード"
MACHINE_SERIAL = "機器番号"
MONTH_COLUMNS = ("年月度", "製造年月")
DAY_COLUMNS = ("納入日", "保守実施日")


@dataclass
class Sources:
    """The five extracts as frames of text columns."""

    events: DataFrame
    attachments: DataFrame
    machines: DataFrame
    master: DataFrame
    standard: DataFrame


def _typed_events(events: DataFrame, null_text: str | None = None) -> DataFrame:
    columns = {c: to_boolean(F.col(c)) for c in S.RAW_FLAG_COLUMNS if c in events.columns}
    columns[S.MACHINE_KEY] = composite_key(F.col("機種略号"), F.col("機番"), null_text=null_text)
    return events.withColumns(columns)


def _parsed(events: DataFrame) -> DataFrame:
    parsed: dict[str, Column] = {c: parse_month(F.col(c)) for c in MONTH_COLUMNS}
    parsed |= {c: parse_day(F.col(c)) for c in DAY_COLUMNS}
    parsed |= {c: F.col(c).try_cast("int") for c in ("稼動月", "ｺｰﾙ", "EM")}
    parsed["CE作業時間"] = F.col("CE作業時間").try_cast("double")
    return events.withColumns(parsed)


def clean_events(
    events: DataFrame,
    attachments: DataFrame,
    mode: str = "Call",
    manufacture_start: str = "2022-12-01",
    extra: dict[str, str] | None = None,
    drop_incomplete: bool = True,
    by: tuple[str, ...] = (),
    null_text: str | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Join attachments to events, select, parse, rename and age.

    ``attachments`` is (machine key, attachment name) and, like the events,
    has the columns ``by``, which are join keys too.  Rows without a required
    raw value are dropped; a raw value that can't be parsed becomes null and
    its row stays (``unparsed`` counts them).  The emergency filter and the
    column selection come before the join, so only needed rows and columns are
    shuffled.
    """
    extra = extra or {}
    names = S.EVENT_NAMES | extra
    wanted = [F.col(f"`{c}`") for c in names if c != ATTACHMENT_NAME]
    keyed = _typed_events(events, null_text)
    if drop_incomplete:
        raw = [c for c in S.REQUIRED_EVENT_COLUMNS if c in events.columns]
        keyed = _typed_events(events.dropna(subset=raw), null_text).dropna(
            subset=[c for c in S.REQUIRED_EVENT_COLUMNS if c not in raw]
        )
    rows = keep_emergencies(_parsed(keyed), "EM", mode).select(*wanted)
    joined = attach_to_events(rows, attachments, [*by, S.MACHINE_KEY], [ATTACHMENT_NAME], null_safe)
    renamed = joined.withColumnsRenamed(names)
    return renamed.withColumns(
        {
            "Elapsed_mf_months": month_span(
                F.lit(manufacture_start).cast("date"), F.col("Manufacturing_date")
            ),
            "Working_months": month_span(F.col("Due_date"), F.col("Maintenance_date")),
            "Maintenance_month": month_start(F.col("Maintenance_date")),
        }
    ).select(*names.values(), "Elapsed_mf_months", "Working_months", "Maintenance_month")


def unparsed(events: DataFrame) -> DataFrame:
    """One row: how many values of each parsed column are present but malformed."""
    parsed = _parsed(events.withColumns({f"__raw_{c}": F.col(c) for c in (*MONTH_COLUMNS, *DAY_COLUMNS)}))
    return parsed.agg(
        *[
            F.count_if(F.col(f"__raw_{c}").isNotNull() & F.col(c).isNull()).alias(c)
            for c in (*MONTH_COLUMNS, *DAY_COLUMNS)
        ]
    )


def clean_machines(
    machines: DataFrame, named: DataFrame, master: DataFrame, standard: DataFrame
) -> DataFrame:
    """Machines with attachment name and class, standard feeders unified,
    compact dates parsed."""
    classes = master.select(F.col(MASTER_NAME).alias(ATTACHMENT_NAME), MASTER_CODE, MASTER_CLASS)
    attached = left_join(named.select(S.MACHINE_KEY, ATTACHMENT_NAME), classes, [ATTACHMENT_NAME])
    keyed = machines.withColumn(
        S.MACHINE_KEY, composite_key(F.col(MACHINE_MODEL), F.col(MACHINE_SERIAL))
    )
    with_names = left_join(keyed, attached.distinct(), [S.MACHINE_KEY])
    unified = apply_standard_configuration(
        with_names,
        drop_empty_columns(standard),
        MACHINE_MODEL,
        MACHINE_SERIAL,
        MASTER_CLASS,
        ATTACHMENT_NAME,
        S.FEEDER_CLASS,
        STANDARD_MODEL,
        STANDARD_DIGIT,
        S.FEEDER_CLASS,
    )
    dates = {c: parse_compact_date(F.col(c)) for c in S.MACHINE_DATE_COLUMNS if c in unified.columns}
    return unified.withColumns(dates)


def build_events(
    sources: Sources, mode: str = "Call", manufacture_start: str = "2022-12-01",
    drop_incomplete: bool = True, null_text: str | None = None, null_safe: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(events, machines) from the five extracts.

    ``null_text`` stands for a missing part of a machine key, and with
    ``null_safe`` null keys match each other.
    """
    named = name_attachments(
        sources.attachments.select("機種略号", "機番", DEVICE_CODE),
        sources.master.select(MASTER_CODE, F.col(MASTER_NAME).alias(ATTACHMENT_NAME)).distinct(),
        DEVICE_CODE,
        MASTER_CODE,
        ["機種略号", "機番"],
        S.MACHINE_KEY,
        null_text,
        null_safe,
    )
    events = clean_events(
        sources.events, named, mode, manufacture_start, drop_incomplete=drop_incomplete,
        null_text=null_text, null_safe=null_safe,
    )
    return events, clean_machines(sources.machines, named, sources.master, sources.standard)


def build_events_by_period(
    events: DataFrame, attachments: DataFrame, machines: DataFrame, period: str = "period",
    manufacture_start: str = "2022-12-01",
) -> tuple[DataFrame, DataFrame]:
    """Monthly workbooks: emergencies with customer geography, per period.

    All three frames carry the period of their file; attachments already have
    the machine key and name.  Nulls are kept.
    """
    extra = S.PERIOD_EXTRA_NAMES | {period: period}
    cleaned = clean_events(
        events, attachments, "EM", manufacture_start, extra, drop_incomplete=False, by=(period,)
    )
    dates = {c: parse_compact_date(F.col(c)) for c in S.MACHINE_DATE_COLUMNS if c in machines.columns}
    return cleaned, machines.withColumns(dates)
