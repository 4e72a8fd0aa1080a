"""Posting and profile schemas, column widths and table checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSTING_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), True),
        T.StructField("job_title", T.StringType(), False),
        T.StructField("company", T.StringType(), False),
        T.StructField("location", T.StringType(), True),
        T.StructField("salary", T.StringType(), True),
        T.StructField("skills_required", T.StringType(), False),
        T.StructField("job_link", T.StringType(), True),
        T.StructField("posted_date", T.DateType(), True),
        T.StructField("applicants", T.IntegerType(), True),
        T.StructField("source", T.StringType(), True),
        T.StructField("experience_level", T.StringType(), True),
        T.StructField("role", T.StringType(), True),
        T.StructField("job_description", T.StringType(), True),
        T.StructField("job_type", T.StringType(), True),
        T.StructField("embedding", T.ArrayType(T.FloatType()), True),
        T.StructField("scraped_at", T.TimestampType(), True),
    ]
)

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("candidate_id", T.LongType(), True),
        T.StructField(
            "personal_info",
            T.StructType([T.StructField(n, T.StringType()) for n in ("name", "email", "phone")]),
        ),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("skills", T.ArrayType(T.StringType())),
        T.StructField("total_experience_years", T.DoubleType()),
        T.StructField(
            "experience_details",
            T.ArrayType(
                T.StructType([T.StructField(n, T.StringType()) for n in ("start_date", "end_date", "duration")])
            ),
        ),
        T.StructField(
            "education",
            T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("degree", "field")])),
        ),
        T.StructField("experience_category", T.StringType()),
        T.StructField("best_job_roles", T.ArrayType(T.StringType())),
        T.StructField("resume_text", T.StringType()),
    ]
)

# Column widths of the posting table.
WIDTHS = {
    "job_title": 100,
    "company": 100,
    "location": 100,
    "salary": 100,
    "job_link": 500,
    "source": 20,
    "experience_level": 50,
    "role": 50,
    "job_type": 50,
}

REQUIRED = ("job_title", "company", "skills_required")
UNIQUE_KEY = ("job_title", "company", "source")

#: Columns a posting search returns (``role`` and ``scraped_at`` stay behind).
SEARCH_COLUMNS = [f.name for f in POSTING_SCHEMA if f.name not in ("role", "scraped_at")]
#: Of those, the ones shown in a recommendation list.
DISPLAY_COLUMNS = [c for c in SEARCH_COLUMNS if c not in ("job_description", "embedding")]


def clip_to_schema(df: DataFrame) -> DataFrame:
    """Cut text to its column width; a blank location becomes NULL."""
    clipped = {c: F.left(F.col(c), F.lit(n)) for c, n in WIDTHS.items() if c in df.columns}
    if "location" in clipped:
        clipped["location"] = F.nullif(clipped["location"], F.lit(""))
    return df.withColumns(clipped)


def _missing_required(names: tuple[str, ...] = REQUIRED) -> Column:
    missing = F.lit(False)
    for name in names:
        missing = missing | F.col(name).isNull()
    return missing


def accepted(df: DataFrame) -> DataFrame:
    """Rows with all the required columns that ``df`` has."""
    return df.filter(~_missing_required(tuple(c for c in REQUIRED if c in df.columns)))


def validate_postings(df: DataFrame) -> DataFrame:
    """Rows the table accepts: right columns and types, nothing required missing."""
    require(df, POSTING_SCHEMA.names)
    types = dict(df.dtypes)
    wrong = [
        f"{f.name}: {types[f.name]} instead of {f.dataType.simpleString()}"
        for f in POSTING_SCHEMA
        if types[f.name] != f.dataType.simpleString()
    ]
    if wrong:
        raise ValueError("wrong column types: " + "; ".join(wrong))
    return df.filter(~_missing_required()).select(*POSTING_SCHEMA.names)


def rejected_postings(df: DataFrame) -> DataFrame:
    """The rows ``validate_postings`` refuses, for the run report."""
    return df.filter(_missing_required())


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail early when a column a job needs is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def require_table(spark: SparkSession, table: str, columns: list[str]) -> DataFrame:
    """The catalog table, once it is known to exist and to hold ``columns``."""
    if not spark.catalog.tableExists(table):
        raise ValueError(f"table {table} does not exist")
    return require(spark.table(table), columns)
