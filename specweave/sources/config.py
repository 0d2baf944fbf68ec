"""Facts of configuration files: versions, keys and settings, never values that may be secret."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .yaml_lines import parsed, spread


# Names of configuration files, and folders that are not scanned for them.
NAMES = ("host.json", "local.settings.json", "local.settings.sample.json", "appsettings.json", "appsettings.Development.json", "appsettings.Production.json", "extensions.json", "function.json")
SKIPPED = ("bin", "obj", ".git", "node_modules", ".github", ".vs", "packages")


def config_files(files: DataFrame) -> DataFrame:
    """Files (path) that are configuration: by name, or YAML, outside skipped folders."""
    parts = F.split("path", "/")
    known = F.element_at(parts, -1).isin(*NAMES) | F.lower("path").rlike(r"\.ya?ml$")
    return files.filter(known & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED))))


def is_yaml(path: Column) -> Column:
    return F.lower(path).rlike(r"\.ya?ml$")


def config_facts(files: DataFrame) -> DataFrame:
    """(path, host_version, runtime, bundle, setting_keys, pipeline, code) of JSON and YAML files (path, text).

    pipeline says that a YAML file's top level has jobs, stages or a trigger. code is YAML001 where there is
    no text, YAML002 where it does not parse as what its name says.
    """
    yaml = is_yaml(F.col("path"))
    rows = spread(files.select("path", "text")).select("path", "text", yaml.alias("yaml"), F.when(yaml, parsed(F.col("text"))).alias("y"))
    ok = F.when(F.col("yaml"), ~F.col("y.wrong")).otherwise(F.try_parse_json("text").isNotNull())
    get = lambda p: F.when(ok & ~F.col("yaml"), F.get_json_object("text", p))
    keys = F.sort_array(F.coalesce(F.when(ok & ~F.col("yaml"), F.json_object_keys(F.get_json_object("text", "$.Values"))), F.array().cast("array<string>")))
    builds = F.col("yaml") & ok & F.exists("y.facts", lambda f: f["path"].isin("jobs", "stages", "trigger"))
    return rows.select(
        "path", get("$.version").alias("host_version"), get("$.Values.FUNCTIONS_WORKER_RUNTIME").alias("runtime"), get("$.extensionBundle.id").alias("bundle"), keys.alias("setting_keys"),
        F.coalesce(builds, F.lit(False)).alias("pipeline"), F.when(F.col("text").isNull(), "YAML001").when(~ok, "YAML002").alias("code"),
    )


def pipelines(files: DataFrame) -> DataFrame:
    """Paths of YAML files (path, text) that describe a build: jobs, stages or a trigger at the top level."""
    return config_facts(files.filter(is_yaml(F.col("path")))).filter("pipeline").select("path")
