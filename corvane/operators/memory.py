"""Governed memory: an append-only table of sections; revoking one appends a section that names it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import all_matches, slug

REVOKED = "~~(memory\\.[a-zA-Z0-9_.-]+)~~"


def entry(id_: Column, session: Column, recorded_at: Column, title: Column, tags: Column, text: Column) -> Column:
    """A section as it is stored."""
    return F.struct(id_.alias("id"), slug(session).alias("session"), recorded_at.alias("recorded_at"), title.alias("title"), tags.alias("tags"), F.trim(text).alias("body"))


def revocation(memory_id: Column, reason: Column) -> Column:
    return F.concat(F.lit("~~"), memory_id, F.lit("~~\n\nRevoked memory.\n\nReason: "), reason)


def revoked_ids(sections: DataFrame, text: str = "body") -> DataFrame:
    return sections.select(F.explode(all_matches(text, REVOKED, 1)).alias("id")).distinct()


def query(sections: DataFrame, needle: str, limit: int = 10, text: str = "body", order: tuple[str, ...] = ("path", "position"), head_lines: int = 12) -> DataFrame:
    """The first sections, by path and position, that hold the needle in any case; revoked ones and revocations are left out."""
    head = F.lower(F.array_join(F.slice(F.split(text, "\n"), 1, head_lines), "\n"))
    own = sections.filter(~head.contains("tags: revocation") & ~head.contains("title: revocation for") & ~head.contains("~~memory."))
    found = own.filter(F.lower(text).contains(needle.lower())) if needle else own
    live = found.join(revoked_ids(sections, text), "id", "left_anti")
    excerpt = F.substring(F.array_join(F.slice(F.split(text, "\n"), 1, 8), "\n"), 1, 500)
    return live.orderBy(*order).limit(limit).select("id", *order, excerpt.alias("excerpt"))


def episodes(rows: DataFrame, stamp: str, source: str = "episode", name: str = "name", body: str = "body") -> DataFrame:
    """path, id, text of episode notes; the stamp keeps names that are written twice apart."""
    own = F.coalesce(F.nullif(slug(name), F.lit("")), F.lit("untitled"))
    key = F.concat(F.lit("episode."), own, F.lit(f".{stamp}"))
    head = F.concat(F.lit("---\nid: "), key, F.lit("\ntype: episode-architecture-summary\nstatus: active\ntitle: \""), F.col(name), F.lit(f'"\nsource_description: "{source}"\n---\n\n# '), F.col(name), F.lit("\n\n"))
    return rows.select(F.concat(F.lit("episodes/"), own, F.lit(f"-{stamp}.md")).alias("path"), key.alias("id"), F.concat(head, F.trim(body), F.lit("\n")).alias("text"))
