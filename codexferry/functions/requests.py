"""Columns of the provisioning requests: addresses, bodies, status tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.functions.text import first_nonempty, nonempty, strip_space


def target_email(override: Column | str, ge_target_email: Column, owner: Column) -> Column:
    override = F.lit(override) if isinstance(override, str) else override
    return first_nonempty(
        F.coalesce(strip_space(override), F.lit("")),
        F.coalesce(strip_space(ge_target_email), F.lit("")),
        owner,
    )


def checkpoint_key(owner: Column, title: Column) -> Column:
    """Ledger key: the title as it is, not the merge key."""
    return F.concat_ws("::", F.coalesce(owner, F.lit(C.DEFAULT_OWNER_KEY)), title)


def endpoint_prefix(location: Column) -> Column:
    host = F.when(location == "global", C.SERVICE_HOST).otherwise(
        F.concat(location, F.lit("-" + C.SERVICE_HOST))
    )
    return F.concat(F.lit("https://"), host)


def endpoint_parts(project: Column, location: Column, notebook: Column) -> Column:
    """Addresses of all calls for one notebook; ``notebook`` is its id or a placeholder."""
    prefix = endpoint_prefix(location)
    parent = F.concat(F.lit("projects/"), project, F.lit("/locations/"), location)
    base = F.concat(prefix, F.lit("/v1alpha/"), parent, F.lit("/notebooks"))
    upload = F.concat(prefix, F.lit("/upload/v1alpha/"), parent, F.lit("/notebooks/"))
    return F.struct(
        prefix.alias("prefix"),
        parent.alias("parent"),
        F.concat(base, F.lit("?serviceAccountUser=true")).alias("create_url"),
        F.concat(base, F.lit("/"), notebook, F.lit("/sources:batchCreate")).alias("batch_url"),
        F.concat(upload, notebook, F.lit("/sources:uploadFile")).alias("upload_url"),
        F.concat(base, F.lit("/"), notebook, F.lit("/notes")).alias("notes_url"),
        F.concat(base, F.lit(":share")).alias("share_url"),
    )


def retryable(status: Column) -> Column:
    """NULL status means that the call raised."""
    return status.isNull() | status.isin(C.RETRYABLE_STATUS)


def http_ok(status: Column) -> Column:
    return F.coalesce(status.isin(C.OK_STATUS), F.lit(False))


def has_target(email: Column) -> Column:
    return F.coalesce(F.contains(email, F.lit("@")), F.lit(False))


def notebook_id(name: Column, fallback: Column) -> Column:
    """Last segment of a resource name that has segments, else the given id."""
    return F.when(F.contains(name, F.lit("/")), F.substring_index(name, "/", -1)).otherwise(
        F.coalesce(fallback, F.lit(""))
    )


def is_native_url(source_type: Column, source_url: Column, youtube_url: Column) -> Column:
    return (nonempty(youtube_url).isNotNull()) | (
        (source_type == C.TYPE_URL) & nonempty(source_url).isNotNull()
    )
