"""Notes with frontmatter: parsing, derived records, and the saved views over them. "Today" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import all_matches, col, label_for

FRONTMATTER = "(?s)^---[ \\t\\r\\f]*\\n(.*?)\\n---[ \\t\\r\\f]*\\n"
# Note types by the store that their records go to.
EPISODE_TYPES = ("episode-architecture-summary", "episode-architecture-decision", "episode-workflow-constraint", "episode-release-note", "episode-pr-repair", "episode-session-note")
GRAPH_TYPES = ("spec", "adr", "playbook")
NODE_KINDS = ("Capability", "Receipt", "Guard", "Policy", "Protocol", "Standard")


def frontmatter_block(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(text), FRONTMATTER, 1), F.lit(""))


def body(text: Column | str) -> Column:
    return F.regexp_replace(col(text), FRONTMATTER, "")


def frontmatter(text: Column | str) -> Column:
    """The frontmatter as a map of texts; the first line of a key counts. Quotes around a value and comments behind it go.

    A list in block form, `- item` lines under a key, becomes `[item, item]`, and a nested map, indented `key: value` lines, becomes
    `{key: value, key: value}`, as if they had been written in one line. Folded and literal texts become one line.
    """
    kinds = "struct<k:string,v:string,items:array<string>,pairs:array<string>,more:array<string>>"
    none = F.array().cast("array<string>")
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), "(?<=[^\"'\\s])\\s+#.*$", ""), "^([\"'])(.*)\\1$", "$2")
    lines = F.filter(F.split(F.coalesce(frontmatter_block(text), F.lit("")), "\n"), lambda x: x.rlike("\\S") & ~x.rlike("^\\s*#"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        changed = lambda **new: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(*(new.get(f, last[f]).alias(f) for f in ("k", "v", "items", "pairs", "more")))))
        begins = x.rlike("^[A-Za-z_][A-Za-z0-9_.-]*\\s*:(?:\\s|$|[^\\s/])")
        new = F.struct(F.trim(F.regexp_extract(x, "^([^:]+):", 1)).alias("k"), bare(F.regexp_extract(x, "^[^:]+:(.*)$", 1)).alias("v"), none.alias("items"), none.alias("pairs"), none.alias("more"))
        item = x.rlike("^\\s*-(?:\\s|$)") & last["v"].isin("", "|", ">", "|-", ">-")
        pair = x.rlike("^\\s+[^\\s:-][^:]*:(?:\\s|$)") & (last["v"] == "")
        return (
            F.when(begins, F.when(F.exists(acc, lambda a: a["k"] == new["k"]), acc).otherwise(F.concat(acc, F.array(new))))
            .when(F.size(acc) == 0, acc)
            .when(item, changed(items=F.concat(last["items"], F.array(bare(F.regexp_replace(x, "^\\s*-", ""))))))
            .when(pair, changed(pairs=F.concat(last["pairs"], F.array(F.concat(F.trim(F.regexp_extract(x, "^([^:]+):", 1)), F.lit(": "), bare(F.regexp_extract(x, "^[^:]+:(.*)$", 1)))))))
            .when(x.rlike("^\\s"), changed(more=F.concat(last["more"], F.array(F.trim(x)))))
            .otherwise(acc)
        )

    found = F.aggregate(lines, F.array().cast(f"array<{kinds}>"), step)
    joined = lambda a, c, z: F.concat(F.lit(a), F.array_join(c, ", "), F.lit(z))
    folded = lambda e: F.array_join(F.concat(F.when(e["v"].isin("|", ">", "|-", ">-", ""), none).otherwise(F.array(e["v"])), e["more"]), " ")
    value = lambda e: F.when(F.size(e["items"]) > 0, joined("[", e["items"], "]")).when(F.size(e["pairs"]) > 0, joined("{", e["pairs"], "}")).otherwise(folded(e))
    return F.map_from_entries(F.transform(found, lambda e: F.struct(e["k"].alias("k"), value(e).alias("v"))))


def list_value(value: Column) -> Column:
    """`[a, b]` or `a` as an array; null and empty give an empty one."""
    inner = F.regexp_replace(F.coalesce(value, F.lit("")), "^\\[|\\]$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def notes(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, id, type, status, node_kind, owners, last_validated, properties, n_links, n_decision_links of files with frontmatter."""
    fm = files.select(F.col(path).alias("path"), frontmatter(text).alias("fm"), body(text).alias("body")).filter(F.size("fm") > 0)
    links = all_matches("body", "\\[\\[([^\\]|]+)", 1)
    get = lambda k: F.nullif(F.element_at("fm", k), F.lit(""))
    return fm.select("path", get("id").alias("id"), get("type").alias("type"), get("status").alias("status"), get("node-kind").alias("node_kind"), list_value(get("owners")).alias("owners"), F.try_to_timestamp(get("last-validated")).cast("date").alias("last_validated"), F.col("fm").alias("properties"), F.size(links).alias("n_links"), F.size(F.filter(links, lambda x: x.contains("decisions/"))).alias("n_decision_links"))


#: Properties that a graph record does without: its label is beside them, its chunks are rows of their own.
DROPPED = ("label", "chunks")


def derived_records(notes_: DataFrame, label_prefix: str = "", dropped: tuple[str, ...] = DROPPED) -> DataFrame:
    """target, id, payload: episodes go to the episode store, typed notes of a known kind to the graph, without the dropped properties."""
    labels = {k: label_prefix + k for k in NODE_KINDS}
    p = lambda k, d="": F.coalesce(F.element_at("properties", k), F.lit(d))
    episode = notes_.filter(F.col("type").isin(*EPISODE_TYPES)).select(F.lit("episodes").alias("target"), "id", F.create_map(F.lit("name"), F.coalesce(F.element_at("properties", "episode_name"), p("title")), F.lit("type"), F.col("type"), F.lit("scope"), p("scope", "repo"), F.lit("source_description"), p("source_description")).alias("payload"))
    node = notes_.withColumn("label", label_for("node_kind", labels)).filter(F.col("type").isin(*GRAPH_TYPES) & F.col("label").isNotNull())
    graph = node.select(F.lit("graph").alias("target"), "id", F.map_concat(F.create_map(F.lit("label"), F.col("label")), F.map_filter("properties", lambda k, _: ~k.isin(*dropped))).alias("payload"))
    return episode.unionAll(graph)


def _no_owner() -> Column:
    return F.col("owners").isNull() | (F.size("owners") == 0)


def stale(notes_: DataFrame, today: str, days: int = 90) -> DataFrame:
    """Accepted specs that were last validated over `days` ago or never."""
    old = F.col("last_validated").isNull() | (F.col("last_validated") < F.date_sub(F.to_date(F.lit(today)), days))
    return notes_.filter((F.col("type") == "spec") & (F.col("status") == "accepted") & old).select("id", "owners", "last_validated").orderBy(F.asc_nulls_first("last_validated"), "id")


def decision_links(notes_: DataFrame) -> DataFrame:
    return notes_.filter((F.col("type") == "spec") & (F.coalesce(F.col("status"), F.lit("")) != "superseded")).select("id", "status", "owners", "n_decision_links").orderBy("id")


def linkless(notes_: DataFrame) -> DataFrame:
    return notes_.filter((F.col("type") == "spec") & (F.col("status") == "accepted") & (F.col("n_links") == 0)).select("id").orderBy("id")


def unowned(notes_: DataFrame, node_kind: str | None = None, status: str | None = None) -> DataFrame:
    out = notes_.filter((F.col("type") == "spec") & _no_owner())
    out = out if node_kind is None else out.filter(F.col("node_kind") == node_kind)
    out = out if status is None else out.filter(F.col("status") == status)
    return out.select("id", "node_kind", "status", "last_validated").orderBy(F.asc_nulls_first("node_kind"), F.asc_nulls_first("last_validated"), "id")


def unowned_by_kind(notes_: DataFrame) -> DataFrame:
    return unowned(notes_, status="accepted").groupBy("node_kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("node_kind"))


def decisions_by_status(notes_: DataFrame, status: str, today: str | None = None, days: int = 14) -> DataFrame:
    """Decisions of a status, with today only those filed over `days` ago, oldest first."""
    filed = F.try_to_timestamp(F.element_at("properties", "date")).cast("date")
    out = notes_.filter((F.col("type") == "adr") & (F.col("status") == status)).withColumn("filed", filed)
    if today is not None:
        out = out.filter(F.col("filed") < F.date_sub(F.to_date(F.lit(today)), days))
    return out.select("id", "filed", "owners").orderBy(F.asc_nulls_first("filed"), "id")


def spec_index(notes_: DataFrame) -> DataFrame:
    return notes_.filter(F.col("type") == "spec").select("id", "node_kind", "status", "last_validated").orderBy(F.asc_nulls_first("node_kind"), "id")


def specs_by_kind(notes_: DataFrame) -> DataFrame:
    return notes_.filter(F.col("type") == "spec").groupBy("node_kind").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n")).orderBy(F.asc_nulls_first("node_kind"))


def recent(files: DataFrame, modified: str = "modified", n: int = 10) -> DataFrame:
    return files.orderBy(F.desc(modified), "path").limit(n)


def recently_active(files: DataFrame, folders: tuple[str, ...], today: str, days: int = 14, n: int = 10, modified: str = "modified") -> DataFrame:
    """The last changed notes of some folders."""
    inside = F.lit(False)
    for f in folders:
        inside = inside | F.col("path").startswith(f)
    return recent(files.filter(inside & (F.to_date(modified) >= F.date_sub(F.to_date(F.lit(today)), days))), modified, n)


def promoted(files: DataFrame, today: str, folder: str = "episodes/", modified: str = "modified") -> DataFrame:
    """Episodes of the last day."""
    return files.filter(F.col("path").startswith(folder) & (F.to_date(modified) >= F.date_sub(F.to_date(F.lit(today)), 1))).orderBy(F.desc(modified), "path")


def own_open_decisions(notes_: DataFrame, owner: str) -> DataFrame:
    return decisions_by_status(notes_.filter(F.array_contains("owners", owner)), "proposed")


def own_stale(notes_: DataFrame, owner: str, today: str, days: int = 60) -> DataFrame:
    old = F.col("last_validated").isNull() | (F.col("last_validated") < F.date_sub(F.to_date(F.lit(today)), days))
    return notes_.filter((F.col("type") == "spec") & F.array_contains("owners", owner) & old).select("id", "last_validated").orderBy(F.asc_nulls_first("last_validated"), "id")
