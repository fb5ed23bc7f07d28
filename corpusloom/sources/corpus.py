"""Sources and sinks: file trees, memory tables, plans, tasks, status lines, validated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import paths as P
from corpusloom.sources import repository


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, bytes) of the source files under ``root``; ignored folders are not listed, and files that can't be
    read are left out: ``repository.skipped`` of ``repository.read`` names them."""
    return repository.readable(repository.read(spark, root))


def assets(spark: SparkSession, root: str) -> DataFrame:
    """(path, class, content) of files that aren't source: content only of schema files, which alone are read."""
    rows = repository.read(spark, root).where("kind <> 'source' and error is null").withColumn("class", P.asset_class(F.col("path"))).where("class is not null")
    return rows.select("path", "class", "content")


def save_memory(tables: dict[str, DataFrame], root: str) -> None:
    """Each table of a memory layer as Parquet under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def load_memory(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{name}") for name in names}


def save_plans(plans: DataFrame, path: str) -> None:
    """Plans (id, ...) as JSON lines, partitioned by the beginning of a hash of the id, so a lookup reads one partition."""
    plans.withColumn("part", F.substring(F.sha2("id", 256), 1, 1)).write.mode("overwrite").partitionBy("part").json(path)


def plan_by_id(spark: SparkSession, path: str, plan_id: str, schema: str) -> DataFrame:
    part = F.substring(F.sha2(F.lit(plan_id), 256), 1, 1)
    return spark.read.schema(f"{schema}, part string").json(path).where((F.col("part") == part) & (F.col("id") == plan_id)).drop("part")


TASKS = "tasks array<struct<id string, description string, files array<string>>>"


def tasks(json: DataFrame) -> DataFrame:
    """json (value) -> (id, description, n_files); a text that isn't a list of tasks raises."""
    parsed = json.select(F.from_json("value", TASKS, {"mode": "FAILFAST"}).alias("j"))
    return parsed.select(F.explode("j.tasks").alias("t")).select("t.id", "t.description", F.coalesce(F.size("t.files"), F.lit(0)).alias("n_files"))


def porcelain(lines: DataFrame) -> DataFrame:
    """lines (value) of a status listing -> (status, path)."""
    code = F.substring("value", 1, 2)
    status = F.when(code == "??", "untracked").when(code.contains("D"), "deleted").when(code.contains("A"), "added").when(code.contains("R"), "renamed").when(code.contains("M"), "modified").otherwise("other")
    return lines.where(F.length("value") > 3).select(status.alias("status"), F.trim(F.element_at(F.split(F.substring("value", 4, 10_000), " -> "), -1)).alias("path"))


def related(imports: DataFrame, files: DataFrame, most: int = 500) -> DataFrame:
    """imports (path, resolved) x files (path, content) -> (path, related, snippet)."""
    return imports.where("resolved is not null").join(files.select(F.col("path").alias("resolved"), F.substring("content", 1, most).alias("snippet")), "resolved").select("path", F.col("resolved").alias("related"), "snippet")


def context(ids: DataFrame, files: DataFrame) -> DataFrame:
    """ids (node_id) -> (path, code) of their files, once each; an empty code where there is none."""
    p = ids.select(P.path_of_id(F.col("node_id")).alias("path")).distinct()
    return p.join(files.select("path", F.col("content").alias("code")), "path", "left").select("path", F.coalesce("code", F.lit("")).alias("code"))


def validate(rows: DataFrame, schema: T.StructType, rules: dict[str, Column], defaults: dict[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows. Defaults fill nulls first; a rule that isn't true, or a null in a required column,
    rejects a row, and ``reasons`` names all that it breaks."""
    for c, v in (defaults or {}).items():
        rows = rows.withColumn(c, F.coalesce(c, F.lit(v)))
    required = {f"{f.name} is missing": F.col(f.name).isNotNull() for f in schema.fields if not f.nullable}
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in (required | rules).items()]), lambda x: x.isNotNull())
    judged = rows.withColumn("reasons", broken)
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    return judged.where(F.size("reasons") == 0).select(*fields), judged.where(F.size("reasons") > 0)


def read_yaml_key(text: Column, section: str, key: str) -> Column:
    """The value of a key within a section of a YAML text."""
    return F.regexp_extract(text, rf"(?m)^{section}:\s*\n(?:[ \t]+.*\n)*?[ \t]+{key}:\s*[\"']?([^\"'\n#]*?)[\"']?\s*(?:#.*)?$", 1)
