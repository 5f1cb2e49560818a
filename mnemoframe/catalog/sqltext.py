"""Small generators for check SQL."""

from __future__ import annotations


def field(x: str) -> str:
    return f"(unhex(printf('%016x', octet_length(encode({x})))) || encode({x}))"


def hash_sql(tag: str, *fields: str) -> str:
    return "sha256(" + " || ".join([field(f"'{tag}'"), *map(field, fields)]) + ")"


def hash_blob(*parts: str) -> str:
    """Parts are blobs already encoded."""
    return "sha256(" + " || ".join(parts) + ")"


def list_hex(expr: str) -> str:
    """Hex text of all encoded strings of a list."""
    return (f"coalesce(list_aggregate(list_transform({expr}, lambda f: printf('%016X', octet_length(encode(f))) || "
            f"hex(encode(f))), 'string_agg', ''), '')")


SCOPE = "tenant_ref, scope_kind, agent_ref, relationship_ref, session_ref"
SCOPE_FIELDS = ("scope_kind", "tenant_ref", "agent_ref", "relationship_ref", "session_ref")
GROUP = SCOPE + ", run_ref, source_group_ref"
EPISODE_REF = "'episode_' || " + hash_sql("episode.v1", *SCOPE_FIELDS, "run_ref", "source_group_ref")
