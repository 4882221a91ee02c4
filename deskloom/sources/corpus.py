"""Corpus files and the tool catalogue."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from deskloom.functions import json as j, text as t

# Spark's limit of the tasks that list folders, and how many tasks a core gets to
# list folders and read files, more if they would read more than so many bytes each.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
TASKS_PER_CORE = 4
TASK_BYTES = 32 << 20

TOOLS = (
    "name string, description string, parameters struct<type: string, "
    "properties: map<string, struct<type: string, description: string>>, required: array<string>>"
)


def path_taxonomy(path: Column) -> dict[str, Column]:
    """domain, topic and subtopic of a path <domain>/[<topic>/[<subtopic>/...]]<file>."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    domain = F.lower(F.get(parts, F.lit(0)))
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    return {
        "domain": domain,
        "topic": F.when(depth >= 3, F.get(parts, F.lit(1))).otherwise(domain),
        "subtopic": F.when(depth >= 4, F.get(parts, F.lit(2))).otherwise(stem),
    }


def path_key(path: Column) -> Column:
    """A key whose text order is the order of the path's parts."""
    return F.translate(path, "/", "\x01")


def corpus_records(files: DataFrame, root_name: str) -> DataFrame:
    """Corpus records from (path below the root, content, mtime) rows.

    Empty documents and files outside a domain directory are dropped.
    """
    rel = F.col("rel_path")
    content = t.strip(F.translate(F.col("content"), "�", ""))
    kept = (
        files.where(F.contains(rel, F.lit("/")))
        .withColumn("content", content)
        .where(F.length("content") > 0)
    )
    return kept.select(
        path_key(rel).alias("doc_id"),
        F.concat(F.lit(root_name + "/"), rel).alias("doc_path"),
        *[c.alias(name) for name, c in path_taxonomy(rel).items()],
        "content",
        F.sha2("content", 256).alias("content_hash"),
        "mtime",
    )


def resolved(spark: SparkSession, path: str) -> tuple[str, str]:
    """The scheme of the file system a path is in, and the path in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = path.makeQualified(system.getUri(), system.getWorkingDirectory()).toUri()
    return whole.getScheme(), whole.getPath().rstrip("/")


def read_corpus(spark: SparkSession, root: str, root_name: str = "data", pattern: str = "*.md") -> DataFrame:
    """One record per file of the pattern, markdown by default, at any depth below the root.

    Folders are listed, and small files read, many in a task: a corpus has as
    many of them as documents, and a task for each would take longer than the file.
    """
    folder = resolved(spark, root)[1]
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), tasks)))
    try:
        files = (
            spark.read.format("text")
            .option("wholetext", True)
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern)
            .load(root)
        )
    finally:
        spark.conf.set(LISTING, before)
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    # Below the root as the file system resolved it, whatever folders further down are called.
    below = F.regexp_replace(full, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    files = files.select(
        F.substring(below, len(folder) + 2, 1 << 30).alias("rel_path"),
        F.make_valid_utf8("value").alias("content"),
        F.col("_metadata.file_modification_time").alias("mtime"),
    ).coalesce(max(tasks, size // TASK_BYTES))
    return corpus_records(files, root_name)


def front_matter(content: Column) -> dict[str, Column]:
    """Front matter of a document: a map of its keys and its list of breadcrumbs."""
    head = F.regexp_extract(content, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    lines = F.split(head, r"\r?\n")
    pairs = F.filter(lines, lambda x: F.rlike(x, F.lit(r"^[A-Za-z_]+:\s*\S")))
    entries = F.transform(
        pairs,
        lambda x: F.struct(
            F.regexp_extract(x, r"^([A-Za-z_]+):", 1).alias("key"),
            F.regexp_extract(x, r'^[A-Za-z_]+:\s*"?(.*?)"?\s*$', 1).alias("value"),
        ),
    )
    # The last value wins when a key is repeated.
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    values = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
    trail = F.regexp_extract(F.concat(head, F.lit("\n")), r"(?m)^breadcrumbs:[ \t]*\r?\n((?:[ \t]+-[ \t].*\r?\n)+)", 1)
    items = F.filter(F.split(trail, r"\r?\n"), lambda x: x != "")
    crumbs = F.transform(items, lambda x: F.regexp_extract(x, r'^\s+-\s+"?(.*?)"?\s*$', 1))
    return {"front": F.map_from_arrays(keys, values), "breadcrumbs": crumbs}


def front_date(front: Column) -> Column:
    """The date of a document, from any of the three formats in use."""
    def field(key):
        return F.try_element_at(front, F.lit(key))

    iso = F.coalesce(field("last_updated_iso"), field("last_modified"))
    exact = F.regexp_replace(field("last_updated_exact"), r"(?U)\s+", " ")
    return F.coalesce(
        F.try_to_timestamp(iso),
        F.try_to_timestamp(exact, F.lit("MMM d, yyyy, h:mm a")),
    )


def tool_rows(text: DataFrame) -> DataFrame:
    """Tools of catalogues given as JSON text (one column): a list of objects
    that have a name, or else an action, or an object keyed by tool. What is no
    tool is left out, and a catalogue that is no JSON has none.
    """
    parsed = text.select(F.try_parse_json(F.col(text.columns[0])).alias("v"))
    listed = F.filter(j.elements(F.col("v")), j.is_object)
    keyed = F.when(j.is_object(F.col("v")), F.try_variant_get("v", "$", "map<string,variant>"))
    entries = F.transform(
        F.map_entries(keyed), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("tool"))
    )
    named = F.transform(
        listed,
        lambda v: F.struct(F.coalesce(j.text_field(v, "name"), j.text_field(v, "action")).alias("name"), v.alias("tool")),
    )
    tools = parsed.select(F.inline(F.coalesce(named, entries)))
    kind = T.StructType.fromDDL(TOOLS)["parameters"].dataType
    return tools.where("name is not null").select(
        "name",
        j.text_field(F.col("tool"), "description").alias("description"),
        F.from_json(F.to_json(F.try_variant_get("tool", "$.parameters", "variant")), kind).alias("parameters"),
    )


def read_tools(spark: SparkSession, *paths: str) -> DataFrame:
    """The tool catalogue from the first path that exists and is JSON, else empty.

    The catalogue is one small configuration file. A path that cannot be reached
    is an error, not an empty catalogue.
    """
    for path in paths:
        try:
            text = spark.read.text(path, wholetext=True)
            if text.where(F.try_parse_json("value").isNotNull()).isEmpty():
                continue
        except AnalysisException as failure:
            if failure.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return tool_rows(text)
    return spark.createDataFrame([], TOOLS)
