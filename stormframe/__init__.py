"""Spark-native analytics over gridded and point weather data.

Everything takes and returns ``DataFrame``.  Grids live as packed blocks (one row
per rectangular tile of cells), catalogs are ordinary tables, and each operator is
a declarative plan that Catalyst and AQE can optimise.
"""

from stormframe.session import build_session, configure

__all__ = ["build_session", "configure"]
