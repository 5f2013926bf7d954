"""loglake: log analytics and corpus preparation on PySpark."""

from loglake.session import get_session

__all__ = ["get_session"]
