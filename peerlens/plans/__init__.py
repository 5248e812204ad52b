"""Queries of the engine, each as a DataFrame plan and as SQL that must give the same rows."""

from . import data_queries as _data_queries
from . import audit_queries as _audit_queries
from . import peer_queries as _peer_queries
from . import text_queries as _text_queries
from . import filing_queries as _filing_queries  # isort: skip
from . import serving_queries as _serving_queries  # isort: skip
from . import source_queries as _source_queries  # isort: skip
from .registry import ORACLE as ORACLE
from .registry import QUERIES as QUERIES
