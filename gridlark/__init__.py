"""Table exploration and query results on PySpark."""

from gridlark.session import get_session

__all__ = ["get_session"]
