"""Contract evidence, links and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def links(evidence: DataFrame) -> DataFrame:
    """(provider, consumer, key, basis) across repositories, as guarded equi-joins.

    ``evidence`` is (id, repository, surface, role, identity, detail). A gRPC name without its package stands for the
    one declaration that ends in it, if there is just one. An OpenAPI operation meets an HTTP consumer through the one
    declaration of that route, if operation and route are unambiguous.
    """
    e = evidence.where("identity <> ''")
    short = e.where("surface = 'grpc' AND role = 'declaration' AND instr(identity, '|') > 0").groupBy(F.expr("substring(identity, instr(identity, '|') + 1)").alias("short")).agg(F.count("*").alias("n"), F.first("identity").alias("full")).where("n = 1")
    bars = F.length("identity") - F.length(F.replace("identity", F.lit("|"), F.lit("")))
    key = F.when((F.col("surface") == "grpc") & (bars < 2), F.col("full")).otherwise(F.col("identity"))
    keyed = e.join(short.select("short", "full"), e["identity"] == F.col("short"), "left").withColumn("key", key).where("key IS NOT NULL")
    sends = (F.col("role") == "provider") | (F.col("surface") == "openapi") | ((F.col("surface") == "topic") & (F.col("role") == "declaration") & (F.col("detail") == "provider"))
    takes = (F.col("role") == "consumer") | ((F.col("surface") == "topic") & (F.col("role") == "declaration") & (F.col("detail") == "consumer"))
    p = keyed.where(sends).select(F.col("id").alias("provider"), F.col("repository").alias("pr"), F.col("surface").alias("ps"), "key")
    c = keyed.where(takes).select(F.col("id").alias("consumer"), F.col("repository").alias("cr"), F.col("surface").alias("cs"), F.col("key").alias("ck"), F.when(F.col("key") == F.col("identity"), "exact").otherwise("declaration_resolved").alias("basis"))
    direct = p.join(c, (p["ps"] == c["cs"]) & (p["key"] == c["ck"]) & (p["pr"] != c["cr"])).where("NOT (ps = 'openapi' AND cs = 'http')")
    route = e.where("surface = 'http' AND role = 'declaration' AND detail LIKE 'operationId=%'").groupBy(F.col("identity").alias("route")).agg(F.count("*").alias("n"), F.first(F.concat("repository", F.lit("|"), F.substring("detail", 13, 4096))).alias("operation")).where("n = 1").select("route", "operation")
    once = e.where("surface = 'openapi' AND role = 'declaration'").groupBy(F.col("identity").alias("op")).agg(F.count("*").alias("n")).where("n = 1").select("op")
    named = p.where("ps = 'openapi'").join(once, p["key"] == F.col("op"), "left_semi")
    through = named.join(route, named["key"] == route["operation"]).join(c.where("cs = 'http'"), F.col("route") == F.col("ck")).where("pr <> cr")
    return direct.select("provider", "consumer", "key", "basis").unionByName(through.select("provider", "consumer", "key", "basis"))


def field_verdicts(accesses: DataFrame, shapes: DataFrame, fields: DataFrame) -> DataFrame:
    """K9: (link, field, origin, verdict) of each access.

    ``accesses`` is (link, field, origin, required, dynamic), ``shapes`` (link, closed, closure), ``fields`` (link,
    field, guaranteed): fields that responses hold, all of them or some.
    """
    has = fields.groupBy("link").agg(F.max(F.col("guaranteed").cast("int")).alias("any_guaranteed"))
    f = fields.groupBy("link", "field").agg(F.max(F.col("guaranteed").cast("int")).alias("present"))
    j = accesses.join(f, ["link", "field"], "left").join(shapes, "link", "left").join(has, "link", "left")
    closed = F.coalesce("closed", F.lit(False))
    verdict = (
        F.when((F.col("link") == "") | F.col("dynamic") | (F.col("field") == ""), "unknown")
        .when(F.col("present") == 1, "compatible")
        .when(F.col("present") == 0, "possible")
        .when(closed & F.col("required") & F.col("closure").isin("observed", "declared"), "proven")
        .when((F.coalesce("any_guaranteed", F.lit(0)) == 1) | closed, "possible")
        .otherwise("unknown")
    )
    return j.select("link", "field", "origin", verdict.alias("verdict"))


def guaranteed_fields(responses: DataFrame) -> DataFrame:
    """(link, field, guaranteed): a field is guaranteed if every response of the link has it."""
    n = responses.groupBy("link").agg(F.countDistinct("response").alias("responses"))
    each = responses.groupBy("link", "field").agg(F.countDistinct("response").alias("seen"))
    return each.join(n, "link").select("link", "field", (F.col("seen") == F.col("responses")).alias("guaranteed"))


def openapi_rows(lines: DataFrame) -> DataFrame:
    """K1: (file, method, path, operation) of an OpenAPI text as (file, n, line): the last path and method above each operationId."""
    above = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    held = lambda pattern: F.last(F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1)), ignorenulls=True).over(above)
    marked = lines.withColumn("path", held(r"^\s{2,}(/[^\s:]*):")).withColumn("method", held(r"^\s+(get|post|put|patch|delete|head|options):"))
    return marked.where(F.col("line").rlike(r"^\s*operationId:")).select("file", F.upper("method").alias("method"), "path", F.regexp_extract("line", r"operationId:\s*['\"]?([\w.-]+)", 1).alias("operation"))


def protobuf_rows(files: DataFrame) -> DataFrame:
    """K2: (file, identity) package.Service|Method of every rpc in (file, text)."""
    package = F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    services = files.select("file", package.alias("package"), F.explode(F.regexp_extract_all("text", F.lit(r"service\s+\w+\s*\{[^}]*\}"), 0)).alias("body"))
    each = services.select("file", "package", F.regexp_extract("body", r"service\s+(\w+)", 1).alias("service"), F.explode(F.regexp_extract_all("body", F.lit(r"rpc\s+(\w+)\s*\("), 1)).alias("method"))
    return each.select("file", F.concat("package", F.lit("|"), "service", F.lit("|"), "method").alias("identity"))


#: How source declares routes: framework and a pattern of verb and path.
ROUTES = (
    ("express", r"(?i)(?<![@\w])(?:app|router)\.(get|post|put|delete|patch|use)\s*\(\s*['\"`]([^'\"`]+)['\"`]"),
    ("fastapi", r"(?i)@(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("flask", r"(?i)@(?:app|bp|blueprint)\s*\.\s*(route)\s*\(\s*['\"]([^'\"]+)['\"]"),
)


def route_rows(files: DataFrame) -> DataFrame:
    """(file, framework, method, path) of routes that the path and text of files declare, each once.

    Files named route below app/, and those below pages/api/, are routes by their folder, for any method; so are
    those of decorators that name no verb.
    """
    found = None
    for framework, pattern in ROUTES:
        each = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("m"))
        verb = F.upper(F.regexp_extract("m", pattern, 1))
        rows = each.select("file", F.lit(framework).alias("framework"), F.when(verb == "ROUTE", "ANY").otherwise(verb).alias("method"), F.regexp_extract("m", pattern, 2).alias("path"))
        found = rows if found is None else found.unionByName(rows)
    by_folder = F.col("path").rlike(r"(^|/)app/(.*/)?route\.[jt]sx?$") | F.col("path").rlike("(^|/)pages/api/")
    folder = F.regexp_replace(F.regexp_replace("path", "^(app|pages)/", ""), "/?[^/]*$", "")
    pages = files.where(by_folder).select("file", F.lit("nextjs").alias("framework"), F.lit("ANY").alias("method"), F.concat(F.lit("/"), folder).alias("path"))
    return found.unionByName(pages).distinct()
