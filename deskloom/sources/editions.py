"""Edition documents, ledgers, and reports on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.functions.text import escape_html

SOURCE = "struct<id:string,title:string,publisher:string,url:string,relationship:string,publishedAt:string,retrievedAt:string>"
CLAIM = "struct<id:string,statement:string,verification:string,sourceIds:array<string>>"
STORY = (
    "struct<id:string,canonicalEventKey:string,desk:string,status:string,priority:string,headline:string,deck:string,whatHappened:string,whyItMatters:string,whatToDoOrWatch:string,"
    "timing:struct<eventAt:string,firstPublishedAt:string,materiallyUpdatedAt:string>,editorial:struct<primaryEntity:string,aiAdjacent:boolean,deskFit:string,maturity:string>,"
    "selection:struct<score:double,materialDelta:string,selectedBecause:string>,confidence:struct<rationale:string>,securityAction:struct<affected:string,action:string,deadline:string>,"
    f"sources:array<{SOURCE}>,evidence:array<{CLAIM}>>"
)
DESK = f"struct<desk:string,story:{STORY},emptyReason:string>"
EDITION = (
    "schemaVersion int, id string, issueNumber int, editionDate string, status string, timezone string, "
    "reportingWindow struct<startInclusive:string,endExclusive:string,displayLabel:string>, "
    "publication struct<targetLocalTime:string,publishAt:string,generatedAt:string,publishedAt:string>, "
    "frontPage struct<note:string,estimatedMinutes:int,leadStoryId:string,storyOrder:array<string>,stopThePressesStoryId:string,diversityException:string>, "
    f"desks map<string,{DESK}>, "
    "backPage struct<watchNext:array<struct<topic:string,unresolved:string,meaningfulSignal:string,whyItMatters:string>>,"
    "tryThisTomorrow:struct<title:string,goal:string,successMeasure:string,riskCheck:string,steps:array<string>>>, "
    "provenance struct<policyVersion:string,promptVersion:string,pipelineVersion:string,"
    "automation:struct<workflow:string,runId:string,runUrl:string,candidate:boolean,generatedAt:string,pilotSequence:int>,"
    "sourceCheck:struct<status:string,checkedAt:string,checkedSourceCount:int,issues:array<string>>>"
)


def read_editions(spark: SparkSession, path: str) -> DataFrame:
    """Edition documents with the date that their file name states; unknown keys are not read."""
    rows = spark.read.schema(EDITION).json(path, multiLine=True)
    return rows.withColumn("fileDate", F.regexp_extract("_metadata.file_name", r"^(\d{4}-\d{2}-\d{2})\.json$", 1))


def directory_issues(editions: DataFrame) -> DataFrame:
    """(fileDate, code) for names that differ from dates, and dates, ids and issue numbers that repeat."""
    out = editions.where("fileDate <> editionDate OR editionDate IS NULL").select("fileDate", F.lit("DATE_DIFFERS_FROM_NAME").alias("code"))
    for column, code in (("editionDate", "DUPLICATE_DATE"), ("id", "DUPLICATE_ID"), ("issueNumber", "DUPLICATE_ISSUE")):
        again = editions.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).where("n > 1 AND v IS NOT NULL")
        out = out.unionByName(editions.join(again, F.col(column) == F.col("v"), "left_semi").select("fileDate", F.lit(code).alias("code")))
    return out


def stories(editions: DataFrame) -> DataFrame:
    """A row per story of each edition's desks."""
    rows = editions.select("editionDate", "issueNumber", F.explode("desks").alias("desk_key", "d")).where("d.story IS NOT NULL")
    return rows.select("editionDate", "issueNumber", "desk_key", F.col("d.story").alias("story"))


def markdown_rows(report: DataFrame) -> DataFrame:
    """A report's rows as lines of a Markdown table; bars within a value are escaped, nulls are empty."""
    cell = lambda c: F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return report.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in report.columns]), F.lit(" |")).alias("value"))


def html_rows(report: DataFrame) -> DataFrame:
    """A report's rows as rows of an HTML table, escaped."""
    cell = lambda c: F.concat(F.lit("<td>"), escape_html(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit("</td>"))
    return report.select(F.concat(F.lit("<tr>"), *[cell(c) for c in report.columns], F.lit("</tr>")).alias("value"))


def write_bundle(reports: dict[str, DataFrame], path: str) -> None:
    """Each report as JSON, Markdown and HTML rows in a folder of its own; fails where one is there already."""
    for name, report in reports.items():
        report.write.mode("errorifexists").json(f"{path}/{name}")
        markdown_rows(report).write.mode("errorifexists").text(f"{path}/{name}.md")
        html_rows(report).write.mode("errorifexists").text(f"{path}/{name}.html")


def write_version(table: DataFrame, path: str, version: str) -> None:
    """A new version of a ledger in a folder of its own; readers switch to it when it is whole."""
    table.write.mode("errorifexists").parquet(f"{path}/version={version}")


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last version whose write was finished."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("version")).first()[0]  # one value
    return rows.where(F.col("version") == last).drop("version")


def content_digest(*columns: str) -> Column:
    """The digest of a document as JSON, its keys in the order given; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def build_version(rows: DataFrame, key: str, columns: list[str], part: int = 1000) -> DataFrame:
    """(version), a name for a build by its content: rows are digested, then runs of keys, then the runs' digests.

    key is a unique integer; only the runs' digests, one for `part` keys, come together.
    """
    joined = lambda order, digest: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, digest))), lambda x: x[digest]), "\n")
    own = rows.select(F.col(key).alias("k"), content_digest(*columns).alias("row"))
    runs = own.groupBy(F.floor(F.col("k") / part).alias("run")).agg(F.sha2(joined("k", "row"), 256).alias("digest"))
    return runs.agg(F.substring(F.sha2(joined("run", "digest"), 256), 1, 12).alias("version"))
