"""Permission decisions, users, audit and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERMISSION = "tool_name string, required_roles array<string>, required_permissions array<string>, action string, description string"
# Default permissions (tool, roles, action, description).
DEFAULTS = [
    ("pii_analyze", ["user", "admin"], "allow", "Analyze text for PII entities"),
    ("pii_anonymize", ["user", "admin"], "allow", "Anonymize PII in text"),
    ("prompt_injection_screen", ["user", "admin"], "allow", "Screen text for prompt injection attacks"),
    ("image_analyze", ["user", "admin"], "allow", "Analyze images for PII via OCR"),
    ("safety_router", ["admin"], "require_approval", "Run VLM safety router (paid API call)"),
    ("data_review", ["reviewer", "admin"], "allow", "Access safety_v0 review queue and data"),
    ("override_labels", ["reviewer", "admin"], "allow", "Save human label overrides"),
    ("export_data", ["admin"], "require_approval", "Export datasets and annotations"),
    ("admin_config", ["admin"], "allow", "Modify permission configuration"),
]


def default_permissions(spark) -> DataFrame:
    return spark.createDataFrame([(t, r, [], a, d) for t, r, a, d in DEFAULTS], PERMISSION)


_ENTRY = "struct<tool_name:string,required_roles:array<string>,required_permissions:array<string>,action:string,description:string>"
#: Where a configuration is looked for, in order, if none is named.
CONFIG_PLACES = ["config/permissions.json", ".permissions.json"]


def permissions_json(permissions: DataFrame) -> DataFrame:
    """The table of tools (a configuration's size) as one JSON object by tool name: a row (value)."""
    entry = F.struct("tool_name", "required_roles", "required_permissions", "action", "description")
    listed = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("tool_name").alias("key"), entry.alias("value")))))
    return permissions.agg(F.to_json(listed).alias("value"))


def permissions_from_json(documents: DataFrame, column: str = "value") -> DataFrame:
    """The table of tools of a JSON object; absent fields: the key as name, no roles and permissions, allow, no description."""
    entries = documents.select(F.explode(F.from_json(column, f"map<string,{_ENTRY}>")).alias("key", "p"))
    none = F.array().cast("array<string>")
    return entries.select(
        F.coalesce("p.tool_name", "key").alias("tool_name"), F.coalesce("p.required_roles", none).alias("required_roles"), F.coalesce("p.required_permissions", none).alias("required_permissions"),
        F.coalesce("p.action", F.lit("allow")).alias("action"), F.coalesce("p.description", F.lit("")).alias("description"),
    )


def load_permissions(spark, path: str | None = None) -> DataFrame:
    """The configured table: of the named file, else of the first place that has one, else the default."""
    import os

    for place in [path] if path else CONFIG_PLACES:
        if os.path.exists(place):
            return permissions_from_json(spark.read.text(place, wholetext=True))
    return default_permissions(spark)


def user_context(headers: Column, force_deny: bool = False) -> Column:
    """struct<user_id, roles, permissions> of request headers (map): without a user id anonymous, with the role user unless denied."""
    parts = lambda k: F.filter(F.transform(F.split(F.coalesce(headers[k], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    user, roles = F.nullif(F.trim(headers["X-User-Id"]), F.lit("")), parts("X-User-Roles")
    default = F.array().cast("array<string>") if force_deny else F.array(F.lit("user"))
    return F.struct(F.coalesce(user, F.lit("anonymous")).alias("user_id"), F.when(F.size(roles) > 0, roles).otherwise(default).alias("roles"), parts("X-User-Permissions").alias("permissions"))


def decide(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """Decisions on rows tool_name, user_id, roles, permissions.

    A denied tool is denied, one that requires approval isn't allowed to anyone, then a role and a permission of the user must be
    among the required ones where any are.  A tool without an entry asks for the role user.  The table of tools is small and
    fixed by configuration; Spark broadcasts it below its own size limit and joins by shuffle beyond.
    """
    p = permissions.select("tool_name", F.col("required_roles").alias("rr"), F.col("required_permissions").alias("rp"), F.col("action").alias("rule"))
    none = F.array().cast("array<string>")
    own = lambda k: F.coalesce(F.col(k), none)
    j = requests.join(p, "tool_name", "left").withColumn("rr", F.when(F.col("rule").isNull(), F.array(F.lit("user"))).otherwise(own("rr"))).withColumn("rp", own("rp")).withColumn("rule", F.coalesce("rule", F.lit("allow")))
    meets = lambda need, have: (F.size(need) == 0) | F.arrays_overlap(F.col(need), own(have))
    allowed = (F.col("rule") == "allow") & meets("rr", "roles") & meets("rp", "permissions")
    wants = F.array_join(F.filter(F.array(F.when(F.size("rr") > 0, F.concat(F.lit("requires role in "), F.array_join("rr", ", "))), F.when(F.size("rp") > 0, F.concat(F.lit("requires permission in "), F.array_join("rp", ", ")))), lambda x: x.isNotNull()), "; ")
    tool = F.col("tool_name")
    reason = (
        F.when(F.col("rule") == "deny", F.concat(F.lit("Tool "), tool, F.lit(" is explicitly denied"))).when(F.col("rule") == "require_approval", F.concat(F.lit("Tool "), tool, F.lit(" requires explicit approval")))
        .when(allowed, F.concat(F.lit("Access granted to "), tool)).otherwise(F.concat(F.lit("Insufficient permissions for "), tool, F.lit(": "), wants))
    )
    action = F.when(F.col("rule") == "require_approval", "require_approval").when(allowed, "allow").otherwise("deny")
    return j.select(*requests.columns, allowed.alias("allowed"), action.alias("action"), reason.alias("reason"))


def recent(log: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The n newest records, newest first."""
    return log.orderBy(F.desc(seq)).limit(n)
