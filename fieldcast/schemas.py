"""Declared schemas and the reference tables that drive routing and labels.

Identifiers are text, dates arrive as digits and are parsed after reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from fieldcast.sources.constants import constant_table


def _schema(strings=(), ints=(), doubles=(), dates=(), booleans=()) -> T.StructType:
    schema = T.StructType()
    for names, kind in (
        (strings, T.StringType()),
        (ints, T.IntegerType()),
        (doubles, T.DoubleType()),
        (dates, T.DateType()),
        (booleans, T.BooleanType()),
    ):
        for name in names:
            schema.add(name, kind)
    return schema


# Column headers of the source extracts.
RAW_EVENT_COLUMNS = (
    "機種略号", "機番", "機種ｺｰﾄﾞ", "訪問区分", "年月度", "製造年月", "納入日", "稼動月",
    "保守実施日", "CE作業時間", "ｺｰﾙ", "EM", "現象", "現象SC名称", "処置場所",
    "初回訪問区分", "ｵﾌﾟｼｮﾝ機種略号", "ｵﾌﾟｼｮﾝ機番",
)
RAW_FLAG_COLUMNS = ("初回訪問区分", "ｵﾌﾟｼｮﾝ機種略号", "ｵﾌﾟｼｮﾝ機番")
REQUIRED_EVENT_COLUMNS = ("年月度", "製造年月", "納入日", "稼動月", "保守実施日")
MACHINE_DATE_COLUMNS = ("納品年月日", "製造年月", "納入月", "リンク日")
MACHINE_KEY = "機種略機番"
PERIOD_EXTRA_COLUMNS = ("...17", "顧客都道府県名", "顧客住所")

# Published names of the cleaned event columns.
EVENT_NAMES = {
    "機種略号": "Model_abbreviation",
    "機種略機番": "Machine_numbers",
    "機種ｺｰﾄﾞ": "Model_code",
    "訪問区分": "Visit_classification",
    "年月度": "Year_and_month",
    "製造年月": "Manufacturing_date",
    "納入日": "Due_date",
    "稼動月": "Working_month",
    "保守実施日": "Maintenance_date",
    "CE作業時間": "CE_Working_hours",
    "ｺｰﾙ": "Call",
    "EM": "EM",
    "現象": "Phenomenon",
    "現象SC名称": "SC_name",
    "処置場所": "Treatment_location",
    "周辺機名": "Peripheral_name",
}
PERIOD_EXTRA_NAMES = {
    "...17": "Peripheral_machine",
    "顧客都道府県名": "Prefectures",
    "顧客住所": "Customer_address",
}

# Classes of the attachment master.
FEEDER_CLASS = "ADF"
FINISHER_CLASS = "フィニッシャー"

CLEAN_EVENTS = _schema(
    strings=(
        "Model_abbreviation", "Machine_numbers", "Model_code", "Visit_classification",
        "Phenomenon", "SC_name", "Treatment_location", "Peripheral_name",
    ),
    ints=("Working_month", "Call", "EM", "Elapsed_mf_months", "Working_months"),
    doubles=("CE_Working_hours",),
    dates=(
        "Year_and_month", "Manufacturing_date", "Due_date", "Maintenance_date",
        "Maintenance_month",
    ),
)
CLEAN_MACHINES_A = _schema(
    strings=("機種機番", "ADF", "フィニッシャー"), dates=("納品年月日",)
)
CLEAN_MACHINES_B = _schema(
    strings=("機種略機番", "周辺機分類", "周辺機名"), dates=("納品年月日",)
)
DRAWS = _schema(
    ints=("chain", "iteration", "draw"),
    strings=("variable",),
).add("i1", T.IntegerType()).add("i2", T.IntegerType()).add("value", T.DoubleType())
RUNS = _schema(
    strings=("run_id", "title"), doubles=("user", "system", "elapsed")
)

ROUTING = "attachment string, location string, family string, ord int"

# Treated locations of feeders and finishers.
FEEDER_LOCATIONS = ("ADF部",)
FINISHER_LOCATIONS = ("ﾊﾟﾝﾁ部", "ﾌｨﾆｯｼｬｰ/ｿｰﾀｰ部", "ｽﾃｰﾌﾟﾙ部")
FINISHER_LOCATIONS_OLD = ("ﾊﾟﾝﾁ部", "ﾌｨﾆｯｼｬｰ/ｿｰﾀｰ部")

# Fixed values: (attachment, family, order) per generation; the families of
# the two generations correspond by order.
PREDECESSOR_FEEDERS = (("COOK-C", "COOK", 1), ("SINAI-H", "SINAI", 2))
PREDECESSOR_FINISHERS = (("VOLGA-E", "VOLGA", 3), ("AMUR-C中綴じ", "AMUR", 4))
SUCCESSOR_FEEDERS = (("COOK-D", "COOK", 1), ("CATHERINE", "CATHERINE", 2))
SUCCESSOR_FINISHERS = (
    ("VOLGA-H(中綴じ有)", "VOLGA", 3),
    ("VOLGA-H(中綴じ無)", "VOLGA", 3),
    ("AMUR-D", "AMUR", 4),
    ("AMUR-D HY", "AMUR", 4),
)
SUCCESSOR_FINISHERS_OLD = (("VOLGA-H", "VOLGA", 3), ("AMUR-D中綴じ", "AMUR", 4))

# Name tokens that identify a family in the installed base.
PREDECESSOR_TOKENS = {
    "COOK": "COOK-C", "SINAI": "SINAI-H", "VOLGA": "VOLGA-E", "AMUR": "AMUR-C中綴じ",
}
SUCCESSOR_TOKENS = {
    "COOK": "COOK-D", "CATHERINE": "CATHERINE", "VOLGA": "VOLGA-H", "AMUR": "AMUR-D",
}
PREDECESSOR_SERIES = list(PREDECESSOR_TOKENS)
SUCCESSOR_SERIES = list(SUCCESSOR_TOKENS)
FAMILY_GROUPS = {"feeder": ["COOK", "SINAI", "CATHERINE"], "finisher": ["VOLGA", "AMUR"]}


def _rules(attachments, locations):
    return [(a, loc, family, ord_) for a, family, ord_ in attachments for loc in locations]


def routing(spark: SparkSession, generation: str, old_locations: bool = False) -> DataFrame:
    """Routing table of a generation; ``old_locations`` selects the edition
    with two finisher locations and its attachment names."""
    places = FINISHER_LOCATIONS_OLD if old_locations else FINISHER_LOCATIONS
    if generation == "A":
        feeders, finishers = PREDECESSOR_FEEDERS, PREDECESSOR_FINISHERS
    else:
        feeders = SUCCESSOR_FEEDERS
        finishers = SUCCESSOR_FINISHERS_OLD if old_locations else SUCCESSOR_FINISHERS
    rows = _rules(feeders, FEEDER_LOCATIONS) + _rules(finishers, places)
    return constant_table(spark, rows, ROUTING)


def series_map(spark: SparkSession) -> DataFrame:
    """Which predecessor series a successor series borrows from (by order)."""
    pairs = list(zip(SUCCESSOR_SERIES, PREDECESSOR_SERIES))
    return constant_table(spark, pairs, "series string, donor string")
