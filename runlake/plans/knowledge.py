"""The knowledge base: documents of three kinds, context and diagnosis texts.

Vectors are made in ``vectors``, and searched in ``search``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.functions.text import stem
from runlake.schemas import CATEGORIES, DIAGNOSIS


#: Heading and empty sentence of a context, cause of a reply that does not parse.
HEADING, NO_HITS, UNPARSED = "## Relevant Knowledge Base Entries", "No similar past errors found in knowledge base.", "Response parsing failed"


def text_docs(files: DataFrame) -> DataFrame:
    """id, document, source, type from whole text files (path, text)."""
    return files.select(F.concat(F.lit("runbook_"), stem(F.col("path"))).alias("id"), F.col("text").alias("document"), F.col("path").alias("source"), F.lit("runbook").alias("type"))


def rule_docs(files: DataFrame) -> DataFrame:
    """The same from JSON files (path, text): one row for each entry of a list, or for the single value."""
    text = F.trim("text")
    entries = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    each = files.select("path", F.posexplode(entries).alias("i", "document"))
    return each.select(F.concat(F.lit("error_pattern_"), stem(F.col("path")), F.lit("_"), F.col("i").cast("string")).alias("id"), "document", F.col("path").alias("source"), F.lit("error_pattern").alias("type"))


def broken_rules(files: DataFrame) -> DataFrame:
    """path and text of the JSON files that do not parse; a list that does not gives no documents."""
    text = F.trim(F.coalesce("text", F.lit("")))
    as_list, as_value = F.from_json(text, "array<string>"), F.from_json(text, "map<string,string>")
    bad = F.when(text.startswith("["), as_list.isNull()).when(text.startswith("{"), as_value.isNull()).otherwise(True)
    return files.where(bad).select("path", "text")


def incident_docs(incidents: DataFrame, versioned: bool = False) -> DataFrame:
    """Resolved incidents as documents; the id hashes the error text alone, so the newest incident of a text wins.

    Missing texts count as empty. Equal times go to the greater run_id. ``versioned`` keeps that order as version.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    lines = F.concat(F.lit("Pipeline: "), part("pipeline_name"), F.lit("\nError: "), part("error_message"), F.lit("\nRoot Cause: "), part("root_cause"), F.lit("\nResolution: "), part("resolution"))
    ident = F.concat(F.lit("incident_"), F.substring(F.md5(part("error_message")), 1, 12))
    docs = incidents.select(ident.alias("id"), lines.alias("document"), F.lit("incident_history").alias("source"), F.lit("resolved_incident").alias("type"), F.struct("timestamp", "run_id").alias("version"))
    found = upsert(docs, "version")
    return found if versioned else found.drop("version")


def upsert(docs: DataFrame, version: str) -> DataFrame:
    """The last version of each id, by partial aggregates: an id of any size meets as one row a task."""
    return docs.groupBy("id").agg(F.max_by(F.struct(*docs.columns), F.col(version)).alias("d")).select("d.*")


def corpus(*kinds: DataFrame) -> DataFrame:
    """All kinds in one frame, the last kind winning on equal ids, then the greatest document."""
    numbered = [k.select("id", "document", "source", "type", F.struct(F.lit(i).alias("kind"), F.col("document").alias("d")).alias("version")) for i, k in enumerate(kinds)]
    out = numbered[0]
    for more in numbered[1:]:
        out = out.unionByName(more)
    return upsert(out, "version").drop("version")


def context(hits: DataFrame, docs: DataFrame, queries: DataFrame, top: int = 3, chars: int = 500) -> DataFrame:
    """query_id and context: the first ``top`` hits with source, score and the first characters, or a fixed sentence."""
    text = F.concat(F.lit("**Source**: "), "source", F.lit(" (relevance: "), F.format_string("%.3f", F.round("score", 3)), F.lit(")\n"), F.left(F.col("document"), F.lit(chars)), F.lit("\n---"))
    few = hits.where(F.col("rank") <= top).join(docs.select("id", "document", "source"), "id").select("query_id", F.struct("rank", text.alias("text")).alias("hit"))
    joined = few.groupBy("query_id").agg(F.array_sort(F.collect_list("hit")).alias("h")).select("query_id", F.concat(F.lit(f"{HEADING}\n\n"), F.array_join("h.text", "\n")).alias("context"))
    return queries.select("query_id").join(joined, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(NO_HITS)))


def references(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, similar (ids of resolved incidents) and runbooks (sources), each in rank order."""
    kinds = hits.join(docs.select("id", "source", "type"), "id")
    listed = lambda kind, value: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("rank", F.col(value).alias("x"))))), lambda s: s["x"])
    return kinds.groupBy("query_id").agg(listed("resolved_incident", "id").alias("similar"), listed("runbook", "source").alias("runbooks"))


def diagnosis_requests(runs: DataFrame, tail: int = 2000) -> DataFrame:
    """run_id and request: the fields of a failed run with its defaults, the log's tail and the context.

    ``runs`` has the run's columns, log_text and context. Only the request is cut.
    """
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    log = F.nullif(F.col("log_text"), F.lit(""))
    text = F.concat_ws(
        "\n",
        field("Pipeline", F.coalesce("pipeline_name", F.lit(""))),
        field("Pipeline ID", F.coalesce("pipeline_id", F.lit(""))),
        field("Run ID", F.coalesce("run_id", F.lit(""))),
        field("Workspace", F.coalesce("workspace_id", F.lit(""))),
        field("Failed At", F.coalesce(F.date_format("end_time", "yyyy-MM-dd HH:mm:ss"), F.lit(""))),
        field("Error Message", F.coalesce(F.nullif("error_message", F.lit("")), F.lit("No error message available"))),
        field("Error Code", F.coalesce(F.nullif("error_code", F.lit("")), F.lit("N/A"))),
        field(f"Run Logs (last {tail} chars)", F.coalesce(F.right(log, F.lit(tail)), F.lit("No logs available"))),
        F.coalesce("context", F.lit("")),
    )
    return runs.select("run_id", text.alias("request"))


def parse_replies(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Adds the diagnosis columns read from a reply: the first ```json fence, else the first fence, else all of it,
    and therein what stands between the first and the last brace.

    A reply that does not parse is unknown, not fixable, of confidence 0, with the cause that parsing
    failed. Absent and null values get defaults; an unknown category name becomes unknown.
    """
    trimmed = F.trim(F.coalesce(F.col(text), F.lit("")))
    after = lambda s, mark: F.get(F.split(s, mark), F.lit(1))
    until = lambda s: F.trim(F.get(F.split(s, "```"), F.lit(0)))
    fenced = F.when(F.contains(trimmed, F.lit("```json")), until(after(trimmed, "```json"))).when(F.contains(trimmed, F.lit("```")), until(after(trimmed, "```"))).otherwise(trimmed)
    braces = F.regexp_extract(F.col("_text"), r"(?s)\{.*\}", 0)
    out = replies.withColumn("_text", fenced).withColumn("_json", F.when(braces != "", braces).otherwise(F.col("_text")))
    out = out.withColumn("_d", F.from_json("_json", f"{DIAGNOSIS}, _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    failed = F.col("_d").isNull() | F.col("_d._corrupt_record").isNotNull() | ~F.startswith(F.trim("_json"), F.lit("{"))
    category = F.when(F.col("_d.error_category").isin(*CATEGORIES), F.col("_d.error_category")).otherwise("unknown")
    return out.withColumn("_bad", F.coalesce(failed, F.lit(True))).select(
        *[F.col(c) for c in replies.columns],
        (~F.col("_bad")).alias("parsed"),
        F.when(F.col("_bad"), "unknown").otherwise(category).alias("error_category"),
        F.when(F.col("_bad"), False).otherwise(F.coalesce("_d.is_auto_fixable", F.lit(False))).alias("is_auto_fixable"),
        F.when(F.col("_bad"), UNPARSED).otherwise(F.coalesce("_d.root_cause", F.lit("Unknown"))).alias("root_cause"),
        F.when(F.col("_bad"), "Investigate manually").otherwise(F.coalesce("_d.recommended_action", F.lit("Investigate manually"))).alias("recommended_action"),
        F.when(F.col("_bad"), 0.0).otherwise(F.coalesce("_d.confidence_score", F.lit(0.0))).alias("confidence_score"),
    )


