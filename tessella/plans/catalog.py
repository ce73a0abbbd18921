"""All queries of this package; importing a module registers its queries."""

from tessella.plans import analytic, relational, streams, udfs  # noqa: F401
from tessella.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
