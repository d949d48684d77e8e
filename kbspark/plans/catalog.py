"""All queries of the library, other than those of its optional parts."""

from kbspark.plans import reports, search, wikis  # noqa: F401
from kbspark.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
