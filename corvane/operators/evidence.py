"""Evidence from source and shapes, and its upkeep (K3-K5, K7, K8, G9, G12, F9, F14, F17, S7, S11, D11, B3, B10, T-8, T-13, R12, S14)."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval
from .graph import numbered

#: What a call in source says about a contract.
PROVIDES_HTTP = r"(?i)\b(?:app|router)\.(get|post|put|patch|delete)\s*\(\s*['\"](/[^'\"]+)['\"]\s*,\s*(?:async\s+)?function\s+([A-Za-z_]\w*)"
CALLS_HTTP = r"(?i)\b(?:httpx|requests|http|client)\.(get|post|put|patch|delete)\s*\(\s*['\"]https?://([^/'\"]+)(/[^?#'\"]*)"
CALLS_RPC = r"\b(?:[A-Za-z_]\w*)\.([A-Z]\w*)Async\s*\("
PROVIDES_RPC = r"\bpublic\s+[A-Za-z_]\w*\s+([a-z]\w*)\s*\("
BROKER, TOPIC = r"\b(?:broker|BROKER)\s*=\s*['\"]([^'\"]+)['\"]", r"\b(?:topic|TOPIC)\s*[:=]\s*['\"]([^'\"]+)['\"]"


def observed(files: DataFrame, methods: DataFrame) -> DataFrame:
    """K4: (file, surface, role, identity) of what (file, path, text) provides and calls, each once.

    HTTP routes are named by verb and path, calls by host, verb and path. A topic without its broker has no identity
    (''), as brokers may share names. A remote procedure is the one of ``methods`` (service, method, identity) that
    its client's type, or for Java its class, names; where none or several fit, nothing is known ('').
    """
    each = lambda pattern: files.select("file", "path", "text", F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("m"))
    part = lambda pattern, k: F.regexp_extract("m", pattern, k)
    named = lambda rows, surface, role, identity: rows.select("file", F.lit(surface).alias("surface"), F.lit(role).alias("role"), identity.alias("identity"))
    http = named(each(PROVIDES_HTTP), "http", "provider", F.concat_ws("|", F.upper(part(PROVIDES_HTTP, 1)), part(PROVIDES_HTTP, 2)))
    http = http.unionByName(named(each(CALLS_HTTP), "http", "consumer", F.concat_ws("|", F.lower(part(CALLS_HTTP, 2)), F.upper(part(CALLS_HTTP, 1)), part(CALLS_HTTP, 3))))
    known = methods.groupBy("service", "method").agg(F.when(F.countDistinct("identity") == 1, F.min("identity")).otherwise("").alias("known"))
    client = F.regexp_extract("text", r"\b([A-Za-z_]\w*)\.\1Client\s+[A-Za-z_]\w*\b", 1)
    calls = each(CALLS_RPC).select("file", client.alias("service"), part(CALLS_RPC, 1).alias("method"), F.lit("consumer").alias("role"))
    owner = F.regexp_extract("text", r"\bclass\s+([A-Za-z_]\w*)", 1)
    serves = each(PROVIDES_RPC).where(F.col("path").endswith(".java")).select("file", owner.alias("service"), F.initcap(F.substring(part(PROVIDES_RPC, 1), 1, 1)).alias("first"), part(PROVIDES_RPC, 1).alias("name"))
    serves = serves.select("file", "service", F.concat("first", F.expr("substring(name, 2)")).alias("method"), F.lit("provider").alias("role"))
    rpc = calls.unionByName(serves).join(known, ["service", "method"], "left").where("role = 'consumer' OR known <> ''")
    rpc = rpc.select("file", F.lit("grpc").alias("surface"), "role", F.coalesce("known", F.lit("")).alias("identity"))
    broker, topic = F.lower(F.regexp_extract("text", BROKER, 1)), F.regexp_extract("text", TOPIC, 1)
    role = F.when(F.col("text").rlike(r"(?s)producer\.send"), "provider").when(F.col("text").rlike(r"\bsubscribe\s*\(\s*(?:TOPIC|topic)\s*,"), "consumer")
    topics = files.where((topic != "") & role.isNotNull()).select("file", F.lit("topic").alias("surface"), role.alias("role"), F.when(broker != "", F.concat_ws("|", F.lit("kafka"), broker, topic)).otherwise("").alias("identity"))
    return http.unionByName(rpc).unionByName(topics).distinct()


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """K7: rows of ``old`` that went and rows of ``new`` that came, repeats included; empty where evidence needn't be replaced."""
    gone = old.exceptAll(new).withColumn("change", F.lit("gone"))
    return gone.unionByName(new.exceptAll(old).withColumn("change", F.lit("new")))


def asyncapi(files: DataFrame) -> DataFrame:
    """K3: (file, role, channel) of a text with one server and one channel; with more of either the role is unknown."""
    servers = F.regexp_count("text", F.lit(r"(?m)^\s+(?:url|host):\s*\S+"))
    channels = F.regexp_extract_all("text", F.lit(r"(?m)^  ([\w./{}-]+):\s*\n\s+(?:publish|subscribe):"), 1)
    role = F.when((servers != 1) | (F.size(channels) != 1), "unknown").when(F.col("text").rlike(r"(?m)^\s+publish:"), "provider").otherwise("consumer")
    return files.where(F.col("text").rlike(r"(?m)^asyncapi:")).select("file", role.alias("role"), F.explode(channels).alias("channel"))


def nearest_function(lines: DataFrame) -> DataFrame:
    """K5: (file, n, owner) of each line: the last function that a line above, or itself, starts."""
    name = F.regexp_extract("line", r"\b(?:function|def|func|fn)\s+([A-Za-z_]\w*)", 1)
    above = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("file", "n", F.last(F.when(name != "", name), ignorenulls=True).over(above).alias("owner"))


def differs(old: DataFrame, new: DataFrame) -> bool:
    """K7: whether two sets of evidence rows, repeats included, aren't the same."""
    return not changes(old, new).isEmpty()


def object_keys(code: str) -> list[str] | None:
    """The top-level keys of the literal object that ``code`` starts with; None if it isn't closed or spreads another."""
    depth, quote, start, keys, expect = 0, "", -1, [], False
    for i, c in enumerate(code):
        if quote:
            quote = "" if c == quote and code[i - 1] != "\\" else quote
            continue
        if c in "\"'`":
            quote = c
            start = i + 1 if expect and start < 0 else start
        elif c in "{[(":
            depth += 1
            expect, start = (True, -1) if depth == 1 else (expect, start)
        elif c in "}])":
            depth -= 1
            if depth == 0:
                if expect and start >= 0:
                    keys.append(code[start:i].strip().strip("\"'"))
                return keys
        elif depth == 1:
            if expect and code.startswith("...", i):
                return None
            if c == "," or c == ":":
                if expect and start >= 0:
                    keys.append(code[start:i].strip().strip("\"'`"))
                expect, start = c == ",", -1
            elif expect and start < 0 and not c.isspace():
                start = i
    return None


def response_shapes(handlers: DataFrame) -> DataFrame:
    """K8: (id, response, keys, closed) of each literal object that a handler's body (id, body) responds with."""
    import re

    @F.pandas_udf("array<struct<response:int,keys:array<string>,closed:boolean>>")
    def shapes(body: pd.Series) -> pd.Series:
        def of(code: str | None) -> list[dict]:
            out = []
            for k, m in enumerate(re.finditer(r"(?:\.json|\.send|return)\s*\(?\s*(?=\{)", code or "")):
                keys = object_keys(code[m.end() :])
                out.append({"response": k, "keys": sorted(set(keys or [])), "closed": keys is not None})
            return out

        return body.map(of)

    return handlers.select("id", F.explode(shapes("body")).alias("s")).select("id", "s.response", "s.keys", "s.closed")


def execution_nodes(symbols: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, kind): symbols that evidence makes handlers, those whose text reaches an output, and the others."""
    output = F.when(F.col("text").rlike(r"\b(?:INSERT|UPDATE|DELETE)\b|\.(?:save|write|insert)\("), "persistence").when(F.col("text").rlike(r"\b(?:fetch|axios|requests)\b"), "external_http")
    role = evidence.where("role = 'provider'").groupBy("id").agg(F.max("surface").alias("surface"))
    kind = F.when(F.col("surface").isNotNull(), F.concat("surface", F.lit("_handler"))).when(output.isNotNull(), F.concat(F.lit("output_"), output)).otherwise("symbol")
    return symbols.join(role, "id", "left").select("id", kind.alias("kind"))


def capped(rows: DataFrame, most: int, id_col: str = "id") -> tuple[DataFrame, bool]:
    """The first ``most`` rows by id, and whether there are more."""
    more = rows.orderBy(id_col).limit(most + 1).count() > most
    return rows.orderBy(id_col).limit(most), more


def json_summary(text: str, depth: int = 3, entries: int = 8) -> str:
    """the shape of a JSON text: keys and sizes, values dropped."""

    def of(value: object, left: int) -> object:
        if isinstance(value, dict):
            return {k: of(v, left - 1) for k, v in sorted(value.items())[:entries]} if left else f"object[{len(value)}]"
        if isinstance(value, list):
            return [f"array[{len(value)}]", *([of(value[0], left - 1)] if value and left else [])]
        return "null" if value is None else {bool: "boolean", int: "number", float: "number"}.get(type(value), "string")

    try:
        return json.dumps(of(json.loads(text), depth))
    except ValueError:
        return ""


def json_summaries(rows: DataFrame) -> DataFrame:
    """F14 over (id, text); what isn't JSON gives an empty text."""

    @F.pandas_udf("string")
    def summary(text: pd.Series) -> pd.Series:
        return text.map(lambda t: json_summary(t or ""))

    return rows.select("id", summary("text").alias("summary"))


def valid_utf8(data: Column) -> Column:
    """bytes as text, with replacement characters for what isn't UTF-8."""
    return F.make_valid_utf8(data.cast("string"))


def valid_timestamp(text: Column) -> Column:
    """a UTC timestamp by its form and by the calendar."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$") & F.try_to_timestamp(text).isNotNull()


def valid_uuid(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def wanted_files(files: DataFrame, paths: DataFrame, root: str, suffixes: list[str]) -> DataFrame:
    """The files of a list of paths that lie under ``root`` and have one of the suffixes."""
    ending = F.lit(False)
    for s in suffixes:
        ending = ending | F.endswith("path", F.lit(s))
    return files.join(paths.select("path").distinct(), "path", "left_semi").where(F.startswith("path", F.lit(root.rstrip("/") + "/")) & ending)


def declarations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(id, name, bounded_context, contracts) of JSON declaration files, one to a file or to a line; other versions and incomplete entries are left out."""
    schema = "schema_version int, capabilities array<struct<id:string,name:string,bounded_context:string,contracts:array<string>>>"
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path).where("schema_version = 1").select(F.explode("capabilities").alias("c")).select("c.*")
    return rows.where("id IS NOT NULL AND name IS NOT NULL")


def recovered_all(artifacts: DataFrame, sidecars: DataFrame, wanted: DataFrame) -> DataFrame:
    """(artifact_id, content, came_from) of the ids in ``wanted``: the table's copy, else the side file's."""
    table = artifacts.select("artifact_id", F.struct(F.lit(0).alias("priority"), F.lit("table").alias("came_from"), "content").alias("c"))
    both = table.unionByName(sidecars.select("artifact_id", F.struct(F.lit(1).alias("priority"), F.lit("side").alias("came_from"), "content").alias("c")))
    best = both.join(wanted.select("artifact_id").distinct(), "artifact_id", "left_semi").groupBy("artifact_id").agg(F.min_by("c", "c.priority").alias("c"))
    return best.select("artifact_id", "c.content", "c.came_from")


def recovered(artifacts: DataFrame, sidecars: DataFrame, wanted: str) -> DataFrame:
    """D11 for one id."""
    only = F.col("artifact_id") == wanted
    return recovered_all(artifacts.where(only), sidecars.where(only), artifacts.where(only).select("artifact_id").unionByName(sidecars.where(only).select("artifact_id"))).select("artifact_id", "content")


def cache_key(query: str, budget: int, epoch: str, version: str, mode: str) -> Column:
    """What a cached capsule is filed under."""
    return T.canonical_fingerprint(*[F.lit(str(x)) for x in (query, budget, epoch, version, mode)])


def current(cache: DataFrame, epoch: str) -> DataFrame:
    """The entries of the epoch; others are out of date."""
    return cache.where(F.col("epoch") == epoch)


def by_files(pivots: DataFrame, support: DataFrame, budget: int) -> DataFrame:
    """(id, form, tokens): the pivots (a few) share 60 % of the budget evenly, whole if they fit and as skeletons if not; then support, as skeletons while it fits.

    ``pivots`` (a few) and ``support`` are (id, rank, tokens, skeleton_tokens).
    """
    share = budget * 0.6 / max(1, pivots.count())
    p = pivots.select("id", F.when(F.col("tokens") <= share, "full").otherwise("skeleton").alias("form"), F.when(F.col("tokens") <= share, F.col("tokens")).otherwise(F.col("skeleton_tokens")).alias("tokens"))
    used = p.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    ordered = numbered(support.withColumn("spot", F.struct("rank", "id")), "spot", "skeleton_tokens")
    return p.unionByName(ordered.where(F.col("run") + used <= budget).select("id", F.lit("support").alias("form"), F.col("skeleton_tokens").alias("tokens")))


def synced(advance: Callable[[], DataFrame], verify: Callable[[DataFrame], bool], rebuild: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """T-8: the advanced table if it verifies, else the rebuilt one."""
    found = advance()
    return (found, "advanced") if verify(found) else (rebuild(), "rebuilt")


def due(queue: DataFrame, lines: int, seconds: int) -> DataFrame:
    """T-13: queues that have ``lines`` entries, or whose oldest is ``seconds`` old: (queue, entries)."""
    found = queue.groupBy("queue").agg(F.count("*").alias("entries"), F.max("age_seconds").alias("oldest"))
    return found.where((F.col("entries") >= lines) | (F.col("oldest") >= seconds)).select("queue", "entries")


def expanded(chosen: DataFrame, candidates: DataFrame, most: int = 3) -> DataFrame:
    """(file_id, id, score): up to ``most`` further symbols of a file by local references.

    6 if a chosen body mentions the candidate, 1 if the candidate mentions a chosen one, 1 if they share a long term.
    Both sides are (file_id, id, name, body); bodies meet names through their words, within the file.
    """
    words = lambda c: F.array_distinct(F.split(F.col(c), r"\W+"))
    c = chosen.select("file_id", F.col("name").alias("c_name"), words("body").alias("c_words"))
    j = candidates.withColumn("words", words("body")).join(c, "file_id")
    long = F.size(F.filter(F.array_intersect("words", "c_words"), lambda w: F.length(w) >= 8)) > 0
    score = F.when(F.array_contains("c_words", F.col("name")), 6).otherwise(0) + F.when(F.array_contains("words", F.col("c_name")), 1).otherwise(0) + F.when(long, 1).otherwise(0)
    best = j.groupBy("file_id", "id").agg(F.max(score).alias("score")).where("score > 0")
    return best.withColumn("rn", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("score"), "id"))).where(F.col("rn") <= most).drop("rn")


def filtered_knn(rows: DataFrame, wanted: list[float], identity: dict[str, str], k: int) -> DataFrame:
    """The k (200 at most) nearest vectors of one model and generation; the filters reach the scan."""
    if not 1 <= k <= 200:
        raise ValueError("k must be from 1 to 200")
    for name, value in identity.items():
        rows = rows.where(F.col(name) == value)
    return retrieval.knn(rows, "embedding", wanted, k)
