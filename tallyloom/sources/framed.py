"""Sources of delimited text: framed records, override files, paged collections, key=value output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECTIVES = ("email", "alias", "bot", "human", "exclude", "name")
FIELDS = ("sha", "email", "name", "authored_at", "parents", "subject", "trailers", "shortstat")


def framed(records: DataFrame, value: str = "value") -> DataFrame:
    """Log records of unit-separated fields; group-separated trailers; numbers of the shortstat.

    A missing shortstat leaves its numbers NULL (not measurable); one without insertions or
    deletions means 0 of them.
    """
    parts = F.split(F.col(value), "\\u001f")
    rows = records.select(*[F.get(parts, i).alias(f) for i, f in enumerate(FIELDS)]).where(F.col("sha").rlike("^[0-9a-f]{7,40}$"))

    def number(word: str) -> Column:
        hit = F.regexp_extract("shortstat", rf"(\d+) {word}", 1)
        return F.when(F.col("shortstat") != "", F.coalesce(F.nullif(hit, F.lit("")).cast("long"), F.lit(0)))

    return rows.select("sha", F.lower("email").alias("email"), "name", F.to_timestamp_ntz("authored_at").alias("authored_at"), (F.size(F.filter(F.split("parents", " "), lambda x: x != "")) > 1).cast("int").alias("is_merge"), "subject", F.filter(F.split("trailers", "\\u001d"), lambda x: x != "").alias("trailers"), number("insertion").alias("insertions"), number("deletion").alias("deletions"), number("file").alias("files_changed"))


def numbered_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, line, value) of all text files below path, with line numbers from 1 in each file.

    A file is read as one value, as override files are small, so numbering needs no sort over files; an empty file has no line.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")
    return files.where("value != ''").select("file", F.posexplode(lines).alias("n", "value")).select("file", (F.col("n") + 1).cast("long").alias("line"), "value")


def tracked_files(spark: SparkSession, path: str, pruned: tuple[str, ...] = ("node_modules", "vendor", ".git", "dist", "build")) -> DataFrame:
    """(path, bytes, modified_at) of every file below a folder, without those in pruned folders.

    Contents are not read, as their column is not selected. Spark lists no empty files.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    return listed.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at")).where(~F.arrays_overlap(inside, F.array(*map(F.lit, pruned))))


def overrides(lines: DataFrame, file: str | None = None) -> DataFrame:
    """(line, directive, key, value, note, error) of an override file (line, value); errors are kept, not skipped. With file, its column is kept."""
    parts = F.split("value", "\t")
    own = [file] if file else []
    rows = lines.select(*own, "line", F.regexp_replace(F.get(parts, 0), r"\s", "").alias("directive"), *[F.coalesce(F.get(parts, i), F.lit("")).alias(n) for i, n in ((1, "key"), (2, "val"), (3, "note"))])
    rows = rows.where((F.coalesce("directive", F.lit("")) != "") & ~F.startswith("directive", F.lit("#")))
    needs = F.col("directive").isin("email", "alias", "name") & (F.col("val") == "")
    error = F.when(~F.col("directive").isin(*DIRECTIVES), "unknown directive").when(F.col("key") == "", "no key").when(needs, "no value")
    return rows.select(*own, "line", "directive", "key", F.col("val").alias("value"), "note", error.alias("error"))


def complete_pages(pages: DataFrame, collection: str, size: str, total: str) -> DataFrame:
    """Whether the pages of each collection add up: one constant total, no empty page before it, no overshoot."""
    per = pages.groupBy(collection).agg(F.countDistinct(total).alias("totals"), F.max(total).alias("total"), F.sum(size).alias("collected"), F.count("*").alias("pages"), F.count(F.when((F.col(size) == 0) & (F.col(total) > 0), 1)).alias("empty_pages"))
    return per.select(collection, "total", "collected", "pages", ((F.col("totals") == 1) & (F.col("collected") == F.col("total")) & (F.col("empty_pages") == 0)).cast("long").alias("is_complete"))


def setting(text: Column, key: str, otherwise: str) -> Column:
    """Value of the first key=value in text."""
    return F.coalesce(F.nullif(F.regexp_extract(text, rf"(?:^|\s){key}=(\S+)", 1), F.lit("")), F.lit(otherwise))


def targets(listed: DataFrame, least: int = 1) -> DataFrame:
    """Repositories to work on: not archived, not forks, not empty, with a default branch; each once.

    Fewer than `least` (none, by default) are refused: an empty listing is a failed one.
    """
    found = listed.where("not is_archived and not is_fork and not is_empty and default_branch is not null").dropDuplicates(["full_name"])
    have = found.limit(least).count()
    if have < least:
        raise ValueError(f"{have} targets; at least {least} are expected")
    return found
