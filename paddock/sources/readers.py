"""Readers for landed tables, result documents and research files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock import schemas
from paddock.functions.scalars import to_number
from paddock.session import cut_lineage

# Folders that hold no notebooks.
SKIPPED_FOLDERS = (".git", "node_modules", ".next", "target", "data", ".turbo", "platform", "papers")

# Id and position columns of a result table, most specific first.
ID_COLUMNS = ("Abbreviation", "Driver", "DriverNumber", "FullName")
QUALIFYING_POSITION_COLUMNS = ("Position", "GridPosition")
RACE_POSITION_COLUMNS = ("Position", "ClassifiedPosition")


def first_available(df: DataFrame, names: Sequence[str]) -> str | None:
    """First of the names that is a column; decided from the schema, no job."""
    return next((n for n in names if n in df.columns), None)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def table_status(
    spark: SparkSession, root: str, names: Sequence[str], formats: Sequence[str] = ("parquet", "csv")
) -> DataFrame:
    """(name, path, format, exists) of tables, the first existing format of each."""
    rows = []
    for name in names:
        found = next((f for f in formats if _exists(spark, f"{root}/{name}.{f}")), None)
        chosen = found or formats[0]
        rows.append((name, f"{root}/{name}.{chosen}", chosen, found is not None))
    return spark.createDataFrame(rows, "name string, path string, format string, exists boolean")


def read_best_format(
    spark: SparkSession,
    root: str,
    name: str,
    schema: T.StructType | None = None,
    formats: Sequence[str] = ("parquet", "csv"),
) -> DataFrame:
    """A table in its preferred existing format."""
    for form in formats:
        path = f"{root}/{name}.{form}"
        if _exists(spark, path):
            reader = spark.read.schema(schema) if schema is not None else spark.read
            return read_csv(spark, path, schema) if form == "csv" else reader.format(form).load(path)
    raise FileNotFoundError(f"{root}/{name} in none of {', '.join(formats)}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header; quotes are doubled inside quoted fields.

    With a schema its columns are taken by name, whatever their order in the
    file; an absent one is null, and so is a value that isn't of its type.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    if schema is None:
        return raw
    found = {c.strip().lower(): c for c in raw.columns}

    def typed(field: T.StructField) -> Column:
        if field.name.lower() not in found:
            return F.lit(None).cast(field.dataType).alias(field.name)
        text = F.col(f"`{found[field.name.lower()]}`")
        number = isinstance(field.dataType, (T.DoubleType, T.FloatType))
        return (to_number(text).cast(field.dataType) if number else text.try_cast(field.dataType)).alias(field.name)

    return raw.select(*map(typed, schema.fields))


def read_csv_checked(
    spark: SparkSession, path: str, schema: T.StructType, names: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV that fit the schema, and a note (reason, record) on every other one: together all records.

    A record doesn't fit if it has too many or too few fields, or if a field
    that isn't empty can't be read as its type; each such field is named.
    ``names`` are the columns of files without a header.
    """
    options = {"quote": '"', "escape": '"', "header": names is None}
    found = list(names) if names is not None else spark.read.options(**options).csv(path).columns
    texts = T.StructType([T.StructField(c, T.StringType()) for c in [*found, "_broken"]])
    raw = spark.read.schema(texts).options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken").csv(path)
    place = {c.strip().lower(): F.col(f"`{c}`") for c in found}

    def value(field: T.StructField) -> Column:
        text = place.get(field.name.lower(), F.lit(None).cast("string"))
        number = isinstance(field.dataType, (T.DoubleType, T.FloatType))
        return (to_number(text) if number else text.try_cast(field.dataType)).cast(field.dataType)

    unread = [
        F.when((F.trim(place[f.name.lower()]) != "") & value(f).isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}"))
        for f in schema.fields
        if f.name.lower() in place
    ]
    faults = F.array_join(F.array(*unread), "; ") if unread else F.lit("")
    reason = F.when(F.col("_broken").isNotNull(), "wrong number of fields").otherwise(faults)
    # Written once, as both results read it, and a query of the broken column alone would find none.
    whole = cut_lineage(raw.withColumn("_reason", reason), "csv")
    rows = whole.where("_reason = ''").select(*[value(f).alias(f.name) for f in schema.fields])
    record = F.coalesce("_broken", F.to_json(F.struct(*[F.col(f"`{c}`") for c in found])))
    return rows, whole.where("_reason <> ''").select(F.col("_reason").alias("reason"), record.alias("record"))


def read_endpoint(
    spark: SparkSession, root: str, endpoint: str, schema: T.StructType, **equal: object
) -> DataFrame:
    """Landed JSON of one endpoint; the parameters are equality filters."""
    df = spark.read.schema(schema).json(f"{root}/{endpoint}")
    for name, value in sorted(equal.items()):
        df = df.where(F.col(name) == value)
    return df


def results_from_columns(raw: DataFrame, positions: Sequence[str], third_segment: str = "Q3") -> DataFrame:
    """Result table with whatever id and position columns it has, in the fixed layout; ``ord`` stays if it is there."""
    id_col, pos_col = first_available(raw, ID_COLUMNS), first_available(raw, positions)
    if id_col is None:
        raise ValueError("no driver column")
    position = to_number(F.col(pos_col).cast("string")) if pos_col else F.lit(None).cast("double")
    time = to_number(F.col(third_segment).cast("string")) if third_segment in raw.columns else F.lit(None).cast("double")
    keys = [c for c in schemas.EVENT if c in raw.columns]
    order = ["ord"] if "ord" in raw.columns else []
    return raw.select(
        *keys,
        F.col(id_col).cast("string").alias("driver_id"),
        F.col(id_col).cast("string").alias("driver_name"),
        position.alias("position"),
        time.alias("q3_time"),
        *order,
    )


# -- football ----------------------------------------------------------------


def match_time(text: Column) -> Column:
    """A date or an ISO date-time in a text column, as a UTC timestamp."""
    return F.coalesce(
        F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm"))
    )


def read_matches(spark: SparkSession, root: str, name: str = "matches") -> DataFrame:
    return read_best_format(spark, root, name, schemas.MATCHES)


def read_teams(spark: SparkSession, root: str) -> DataFrame:
    return read_best_format(spark, root, "teams", schemas.TEAMS)


def read_schedule(spark: SparkSession, root: str) -> DataFrame:
    """The season schedule; rows without a season or round are no rounds and are dropped."""
    return read_best_format(spark, root, "schedule", schemas.SCHEDULE).where("year IS NOT NULL AND round_number IS NOT NULL")


def fixtures_of(matches: DataFrame) -> DataFrame:
    """Matches not played yet."""
    return matches.where(F.col("home_goals").isNull())


def fixtures_head(fixtures: DataFrame, limit: int = 5) -> DataFrame:
    """First fixtures as text, missing fields empty; a limit below 1 means 5."""
    cols = ("match_id", "date", "season", "league", "home_team_id", "away_team_id")
    shown = fixtures.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])
    return shown.limit(limit if limit > 0 else 5)


# -- documents and files -----------------------------------------------------


def read_experiments(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of runs, sweeps and the runs of each sweep."""
    names = {"runs": schemas.RUNS, "sweeps": schemas.SWEEPS, "sweep_runs": schemas.SWEEP_RUNS}
    runs, sweeps, bridge = (read_best_format(spark, root, name, schema) for name, schema in names.items())
    return runs, sweeps, bridge


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents (one JSON file per run) as (run_id, result); the folder, ``<id>`` or ``run_id=<id>``, names the run."""
    files = spark.read.option("wholetext", True).text(path).withColumn("_path", F.col("_metadata.file_path"))
    run_id = F.regexp_extract("_path", r"/(?:run_id=)?([^/]+)/[^/]+$", 1)
    return files.select(run_id.alias("run_id"), F.from_json("value", schemas.RESULT_DOCUMENT).alias("result"))


def file_inventory(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Paths and sizes of files below a folder; the content column is pruned, so no file is opened."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "length")
    )
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    skipped = F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS)))
    return files.withColumn("skipped", skipped)


def papers_under(spark: SparkSession, root: str) -> DataFrame:
    """PDF files directly in a sport's folder."""
    paths = file_inventory(spark, root, "*.pdf").select("path")
    sport = F.regexp_extract("path", r"/papers/([^/]+)/[^/]+$", 1)
    return paths.withColumn("sport", sport).where("sport <> ''")


def notebooks_under(spark: SparkSession, root: str) -> DataFrame:
    """Notebooks below the project folders with sport and project from the path."""
    relative = F.regexp_extract("path", r"/projects/(.*)$", 1)
    parts = F.split(relative, "/")
    listed = file_inventory(spark, root, "*.ipynb")
    inside = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    skipped = F.arrays_overlap(inside, F.array(*map(F.lit, SKIPPED_FOLDERS)))
    return listed.where(~skipped).select(
        F.coalesce(F.get(parts, F.lit(0)), F.lit("Unknown")).alias("sport"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("Unknown")).alias("project"),
        F.col("path").alias("file"),
    )


def projects_under(spark: SparkSession, root: str) -> DataFrame:
    """Project folders below the sports: name, research notebook and code folder, null where missing.

    A project is a folder that holds the notebook or any non-empty file of a code folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = F.split(F.regexp_extract("path", r"/projects/(.*)$", 1), "/")
    split = files.select(
        "path",
        F.get(parts, F.lit(0)).alias("sport"),
        F.get(parts, F.lit(1)).alias("name"),
        F.get(parts, F.lit(2)).alias("folder"),
        F.get(parts, F.lit(3)).alias("file"),
    )
    notebook = (F.col("folder") == "Jupyter") & (F.col("file") == "model-research.ipynb")
    code = (F.col("folder") == "Python") & F.col("file").isNotNull()
    home = F.regexp_extract("path", r"^(.*/projects/[^/]+/[^/]+)/", 1)
    visible = ~F.col("sport").startswith(".") & ~F.col("name").startswith(".")
    return (
        split.where((notebook | code) & visible)
        .groupBy("sport", "name")
        .agg(
            F.min(F.when(notebook, F.col("path"))).alias("notebook"),
            F.min(F.when(code, F.concat(home, F.lit("/Python")))).alias("python_dir"),
        )
    )


def notebook_cells(documents: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """One row per notebook cell; a source given as a list of lines is joined."""
    parsed = documents.select(key, F.from_json(text, schemas.NOTEBOOK_DOCUMENT).alias("nb"))
    cells = parsed.select(key, F.posexplode("nb.cells").alias("cell", "body"))
    source = F.col("body.source")
    lines = F.try_variant_get(source, "$", "array<string>")
    content = F.coalesce(F.array_join(lines, ""), F.try_variant_get(source, "$", "string"), F.lit(""))
    return cells.select(key, "cell", F.col("body.cell_type").alias("cell_type"), content.alias("source"))


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a paper index with their numbers; an index is one small file."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("doc"), "value")
    return files.select("doc", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
