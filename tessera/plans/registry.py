"""All registered queries. Importing the query modules fills ``QUERIES`` and ``ORACLE``."""

from tessera.plans import queries as _corpus  # noqa: F401
from tessera.plans import queries_windows as _windows  # noqa: F401
from tessera.plans import queries_apps as _apps  # noqa: F401
from tessera.plans import queries_models as _models  # noqa: F401
from tessera.plans import queries_stream as _stream  # noqa: F401
from tessera.plans import queries_sources as _sources  # noqa: F401
from tessera.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
