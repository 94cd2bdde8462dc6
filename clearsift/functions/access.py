"""Column functions for entitlements."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearsift.constants import MASKED_QUERY


def visible(required_clearance, allowed_departments, clearance, department) -> Column:
    """May this principal see the row?  Null verdicts become false.

    Clearance and department form a lattice: high clearance never overrides
    the department list.  A null or empty list means open to everyone.
    """
    allowed = _col(allowed_departments)
    is_open = allowed.isNull() | (F.size(allowed) == 0)
    verdict = (_col(required_clearance) <= _col(clearance).cast("int")) & (
        is_open | F.array_contains(allowed, _col(department).cast("string"))
    )
    return F.coalesce(verdict, F.lit(False))


def access_keys(allowed_departments) -> Column:
    """The department list as join keys: ``*`` when open, else ``d:<name>``."""
    allowed = F.array_compact(_col(allowed_departments))
    is_open = _col(allowed_departments).isNull() | (F.size(_col(allowed_departments)) == 0)
    keys = F.sort_array(F.array_distinct(F.transform(allowed, lambda d: F.concat(F.lit("d:"), d))))
    return F.when(is_open, F.array(F.lit("*"))).otherwise(keys)


def signature(required_clearance, access_keys) -> Column:
    """Clearance and access keys as one text: rows of one signature are visible
    to the same classes."""
    return F.concat_ws("|", _col(required_clearance).cast("string"), F.array_join(_col(access_keys), ","))


def principal_keys(department) -> Column:
    """Every access key this department opens."""
    return F.array(F.lit("*"), F.concat(F.lit("d:"), _col(department)))


def class_key(department, clearance) -> Column:
    """Principals with equal department and clearance see exactly the same rows."""
    return F.concat_ws("|", _col(clearance).cast("int").cast("string"), _col(department))


def open_as_null(allowed_departments) -> Column:
    """Writers store 'open to everyone' as null."""
    allowed = _col(allowed_departments)
    return F.when(F.size(allowed) > 0, allowed)


def null_as_open(allowed_departments) -> Column:
    """Readers see 'open to everyone' as an empty list."""
    return F.coalesce(_col(allowed_departments), F.array().cast("array<string>"))


def masked_query(query, row_session, viewer_session) -> Column:
    """Show free text only to the session that wrote it; unknown equals nothing."""
    row, mine = _col(row_session), _col(viewer_session)
    own = (row != "") & (mine != "") & (row == mine)
    return F.when(own, _col(query)).otherwise(F.lit(MASKED_QUERY))


def clamp(value, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(_col(value), F.lit(high)))


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
