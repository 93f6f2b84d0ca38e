"""`${NAME}` templates and nested connection settings of import rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .. import model
from .values import merged_map


def template_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(model.TEMPLATE_NAME), F.lit(1))


def missing_names(text: Column, lookup: Column) -> Column:
    """Names used in the text that the lookup map does not hold or holds as null."""
    return F.array_distinct(F.filter(template_names(text), lambda n: F.try_element_at(lookup, n).isNull()))


def _sewn(pieces: Column, values: Column) -> Column:
    """Pieces with the values that stood between them; null when a value is null.

    The lambda of a one-element array names the values, so that each is worked out once, not once for every piece.
    """
    joined = lambda found: F.concat_ws("", F.zip_with(pieces, found, lambda piece, v: F.concat(piece, F.coalesce(v, F.lit("")))))
    sewn = lambda found: F.when(F.exists(found, lambda v: v.isNull()), None).otherwise(joined(found))
    return F.get(F.transform(F.array(values), sewn), F.lit(0))


def _resolved(text: Column, lookup: Column, printed: Callable[[Column], Column]) -> Column:
    values = F.transform(template_names(text), lambda n: printed(F.try_element_at(lookup, n)))
    return _sewn(F.split(text, model.TEMPLATE_NAME, -1), values)


def resolved_text(text: Column, lookup: Column) -> Column:
    """The text with every `${NAME}` replaced once; null when a name is missing.

    The text is cut at the templates and sewn together again, so a replaced value is never scanned.
    """
    return _resolved(text, lookup, lambda v: v)


_LITERAL = r'"(?:[^"\\]|\\.)*"(?:\s*:)?'


def resolved_json(document: Column, lookup: Column) -> Column:
    """Resolve templates inside the text values of a JSON document; keys stay as they are.

    The document is cut at its string literals. Looked-up values are escaped as JSON text first, so quotes and line
    breaks stay inside their strings.
    """
    inside = lambda v: F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":"(.*)"\}$', 1)
    escaped = lambda v: F.when(v.isNotNull(), inside(v))
    literals = F.regexp_extract_all(document, F.lit(_LITERAL), F.lit(0))
    settled = F.transform(literals, lambda s: F.when(s.endswith(":"), s).otherwise(_resolved(s, lookup, escaped)))
    return _sewn(F.split(document, _LITERAL, -1), settled)


def flattened_ssh(item: Column) -> Column:
    """Lift the fields of a nested `ssh` object to `ssh_*`; `enabled` defaults to true.

    ``item`` is a MAP<STRING,VARIANT>; rows without an `ssh` object are left as they are.
    """
    ssh = F.try_variant_get(F.try_element_at(item, F.lit("ssh")), "$", "map<string,variant>")
    fields = F.transform_keys(F.map_filter(ssh, lambda k, _v: k != "enabled"), lambda k, _v: F.concat(F.lit("ssh_"), k))
    enabled = F.coalesce(F.try_element_at(ssh, F.lit("enabled")), F.parse_json(F.lit("true")))
    fields = F.map_filter(fields, lambda k, _v: k != "ssh_enabled")
    lifted = F.map_concat(fields, F.create_map(F.lit("ssh_enabled"), enabled))
    return F.when(ssh.isNull(), item).otherwise(merged_map(item, lifted))
