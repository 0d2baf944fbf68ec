"""Discovery documents: one JSON object for each region and system, as tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE = "struct<kind:string,name:string,nullable:boolean,collection:boolean,referenceId:string,format:string>"
IDS = "evidenceIds:array<string>"
#: The document's schema; values of any type stay JSON text.
SCHEMA = (
    "contractVersion string, run struct<id:string,status:string,toolVersion:string>, region string, system string, sources array<struct<id:string,kind:string,path:string,sha256:string>>, "
    f"operations array<struct<id:string,name:string,method:string,route:string,parameters:array<struct<id:string,name:string,location:string,required:boolean,type:{TYPE}>>,"
    f"requestEntityId:string,responses:array<struct<id:string,statusCode:int,entityId:string,type:{TYPE},description:string>>,{IDS}>>, "
    f"entities array<struct<id:string,name:string,originalName:string,attributes:array<struct<id:string,name:string,originalName:string,type:{TYPE},required:boolean,{IDS}>>,baseEntityId:string,{IDS}>>, "
    f"enums array<struct<id:string,name:string,values:array<struct<name:string,value:string>>,{IDS}>>, validations array<struct<id:string,targetId:string,rule:string,arguments:string,{IDS}>>, "
    f"relationships array<struct<id:string,kind:string,sourceId:string,targetId:string,{IDS}>>, evidence array<struct<id:string,sourceId:string,subjectId:string,observedValue:string>>, "
    "lineage array<struct<id:string,sourceId:string,subjectId:string,path:string,startLine:int,endLine:int,pointer:string>>, "
    f"diagnostics array<struct<id:string,severity:string,code:string,message:string,subjectIds:array<string>,{IDS}>>, "
    "summary struct<operationCount:int,entityCount:int,enumCount:int,relationshipCount:int,diagnosticCount:int>"
)
VERSION = "1.0"
#: Columns of each table that refer to others: (table, column, table referred to).
REFERENCES = [
    ("operations", "request_entity_id", "entities"), ("responses", "entity_id", "entities"), ("entities", "base_entity_id", "entities"), ("attributes", "entity_id", "entities"),
    ("evidence", "source_id", "sources"), ("lineage", "source_id", "sources"), ("parameters", "operation_id", "operations"), ("responses", "operation_id", "operations"),
]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents below ``path``, a row each; those of another contract version or that don't parse are left out."""
    raw = spark.read.schema(SCHEMA + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path)
    return raw.filter(F.col("_corrupt").isNull() & (F.col("contractVersion") == VERSION)).drop("_corrupt")


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def _fields(df: DataFrame, item: str, skip: tuple[str, ...] = ()) -> list[Column]:
    """The members of a struct column as columns in snake case; a type's members without its name."""
    out = []
    for f in df.schema[item].dataType.fields:
        if f.name in skip:
            continue
        if f.name == "type":
            names = {"kind": "kind", "name": "type_name", "nullable": "nullable", "collection": "collection", "referenceId": "reference_id", "format": "format"}
            out += [F.col(f"{item}.type.{k}").alias(v) for k, v in names.items()]
        else:
            out.append(F.col(f"{item}.{f.name}").alias(_snake(f.name)))
    return out


def tables(documents: DataFrame) -> dict[str, DataFrame]:
    """The parts of documents as tables keyed by (region, system); position keeps the order within a parent."""
    scope = [F.col("region"), F.col("system")]
    out = {}
    for name in ("sources", "operations", "entities", "enums", "validations", "relationships", "evidence", "lineage", "diagnostics"):
        rows = documents.select(*scope, F.posexplode(name).alias("position", "x"))
        out[name] = rows.select(*scope, "position", *_fields(rows, "x", ("parameters", "responses", "attributes")))
    for parent, child, key in (("operations", "parameters", "operation_id"), ("operations", "responses", "operation_id"), ("entities", "attributes", "entity_id")):
        rows = documents.select(*scope, F.explode(parent).alias("p")).select(*scope, F.col("p.id").alias("_k"), F.posexplode(f"p.{child}").alias("position", "x"))
        own = [c for c in _fields(rows, "x")]
        out[child] = rows.select(*scope, F.col("_k").alias(key), "position", *own)
    return out


def summary_errors(documents: DataFrame) -> DataFrame:
    """(region, system, what, stated, found): counts of a document's summary that its content belies."""
    parts = {"operations": "operationCount", "entities": "entityCount", "enums": "enumCount", "relationships": "relationshipCount", "diagnostics": "diagnosticCount"}
    rows = F.array(*[F.struct(F.lit(n).alias("what"), F.col(f"summary.{c}").alias("stated"), F.size(n).alias("found")) for n, c in parts.items()])
    return documents.select("region", "system", F.explode(rows).alias("x")).select("region", "system", "x.*").filter(~F.col("stated").eqNullSafe(F.col("found")))


def span_errors(documents: DataFrame) -> DataFrame:
    """(region, system, id): lineage whose lines are half given, before one or in reverse, or that points nowhere."""
    x = documents.select("region", "system", F.explode("lineage").alias("l"))
    s, e = F.col("l.startLine"), F.col("l.endLine")
    bad = (s.isNull() != e.isNull()) | (s < 1) | (e < s) | (s.isNull() & F.col("l.pointer").isNull())
    return x.filter(F.coalesce(bad, F.lit(False))).select("region", "system", "l.id")


def documents(model: dict[str, DataFrame]) -> DataFrame:
    """(region, system, document): tables() put together again, JSON with every list in order of id and nulls left out."""
    key = ["region", "system"]

    def nested(child: str, parent_key: str) -> DataFrame:
        df = model[child]
        cols = [c for c in df.columns if c not in (*key, parent_key, "position")]
        return df.groupBy(*key, F.col(parent_key).alias("id")).agg(F.sort_array(F.collect_list(F.struct("position", *cols))).alias(child))

    rows = dict(model)
    for parent, child, k in (("operations", "parameters", "operation_id"), ("operations", "responses", "operation_id"), ("entities", "attributes", "entity_id")):
        rows[parent] = rows[parent].join(nested(child, k), [*key, "id"], "left")
    out = None
    for name in ("sources", "operations", "entities", "enums", "validations", "relationships", "evidence", "lineage", "diagnostics"):
        df = rows[name].drop("position")
        cols = ["id", *(c for c in df.columns if c not in (*key, "id"))]
        one = df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
        out = one if out is None else out.join(one, key, "full_outer")
    return out.select(*key, F.to_json(F.struct(F.lit(VERSION).alias("contract_version"), *out.columns)).alias("document"))
