"""Sources: sheets as cell tables, cached token documents, state files, folders of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderlake.functions import text as tx

TOKEN_SCHEMA = "schema string, mode string, source_file string, source_sha256 string, provider string, target_width int, target_height int, results array<string>"
# Header words of the sheets and the columns they mean.
ALIASES = {
    "rank": ("#", "rank", "platz", "rang"), "server": ("server", "srv", "warzone"), "alliance": ("alliance", "allianz", "tag", "alliancetag"),
    "player": ("player", "spieler", "name", "truename", "playername"), "value": ("strength", "stärke", "power", "thp", "heropower", "totalheropower"),
}


def canonical_header(name: str) -> str | None:
    """The canonical column a header stands for, by its letters and digits only."""
    plain = "".join(c for c in name.casefold() if c.isalnum() or c == "#")
    return next((k for k, words in ALIASES.items() if plain in words), None)


def canonical_sheet(sheet: DataFrame, required: tuple[str, ...] = ("server", "value")) -> DataFrame:
    """Columns renamed by their headers; of several with one meaning the first non-null value counts.

    Fails on a missing required column, naming it.
    """
    groups: dict[str, list[str]] = {}
    for c in sheet.columns:
        key = canonical_header(c)
        if key:
            groups.setdefault(key, []).append(c)
    missing = [r for r in required if r not in groups]
    if missing:
        raise ValueError(f"sheet lacks columns: {', '.join(missing)}")
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    out = sheet.select(*[F.coalesce(*[text(c) for c in cs]).alias(k) for k, cs in groups.items()])
    if "value" in out.columns:
        out = out.withColumn("value", tx.parse_magnitude(F.col("value")))
    return out.withColumn("server", tx.parse_server(F.col("server"))) if "server" in out.columns else out


def all_sheets(sheets: dict[str, DataFrame]) -> DataFrame:
    """All sheets under each other with a column that names the sheet."""
    out = None
    for name, df in sheets.items():
        tagged = df.withColumn("sheet", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sheets")
    return out


def wide_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every further column as rows (metric_name, value); nulls are left out."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in rest]).unpivot(keys, rest, "metric_name", "value").where("value is not null")


def section_rows(cells: DataFrame, sheet: str = "sheet", row: str = "row", first: str = "c0") -> DataFrame:
    """Rows below a row that names a server belong to that server."""
    found = F.regexp_extract(F.col(first), r"(?i)^\s*server\s*([0-9]{3,4})", 1)
    w = W.partitionBy(sheet).orderBy(row)
    marked = cells.withColumn("__s", F.when(found != "", found.cast("int")))
    return marked.withColumn("server", F.last("__s", ignorenulls=True).over(w)).where("__s is null and server is not null").drop("__s")


def adjacent_pairs(cells: DataFrame, least: int = 1_000_000) -> DataFrame:
    """(row, col, server, value) of neighbouring cells that hold a server and a value of at least ``least``.

    ``cells``: sheet, row, col, text, one row per cell.
    """
    w = W.partitionBy("sheet", "row").orderBy("col")
    nxt = cells.withColumn("next_col", F.lead("col").over(w)).withColumn("next_text", F.lead("text").over(w)).where("next_col = col + 1")
    server = F.when(F.col("text").rlike("^[0-9]{1,4}$"), tx.parse_server(F.col("text")))
    value = tx.parse_magnitude(F.col("next_text"))
    return nxt.select("sheet", "row", "col", server.alias("server"), value.alias("value")).where(F.col("server").isNotNull() & (F.col("value") >= least))


def headerless_block(df: DataFrame, server: int, value: int) -> DataFrame:
    """Server and value by column position."""
    c = df.columns
    return df.select(tx.parse_server(F.col(c[server]).cast("string")).alias("server"), tx.parse_magnitude(F.col(c[value]).cast("string")).alias("value")).where("server is not null and value is not null")


def cities_block(df: DataFrame, first: str, words: tuple[str, ...] = ("server", "cities")) -> DataFrame:
    """Rows whose first cell names a server by three or four digits; header words are skipped."""
    found = F.regexp_extract(F.col(first), r"([0-9]{3,4})", 1)
    return df.where(~F.lower(F.trim(first)).isin(*words)).withColumn("server", F.when(found != "", found.cast("int"))).where("server is not null")


def token_documents(spark: SparkSession, path: str) -> DataFrame:
    """Cached token documents as one row per token: file, position, box, text, confidence."""
    docs = spark.read.schema(TOKEN_SCHEMA).option("multiLine", True).json(path)
    token = F.posexplode("results")
    rows = docs.select("source_file", "mode", token.alias("token_id", "raw"))
    part = lambda i: F.get_json_object("raw", f"$[{i}]")
    return rows.select(
        "source_file", "mode", "token_id", F.from_json(part(0), "array<array<double>>").alias("box"), part(1).alias("text"), part(2).cast("double").alias("confidence")
    )


def json_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """State documents; a broken document is left out, a missing folder gives no rows."""
    try:
        return spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).json(path).where("_corrupt_record is null").drop("_corrupt_record")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def files(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """Names, sizes and content hashes of the files of a folder; the content itself stays in the tasks."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def blank_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null, blank and NaN texts become null once, at the door."""
    clean: dict[str, Column] = {c: F.when(~F.lower(F.trim(c)).isin("", "nan", "none"), F.col(c)) for c in columns}
    return df.withColumns(clean)
