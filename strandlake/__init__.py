"""Column-group wide tables on PySpark."""

from .lake import ROOT_SETTING, Lake
from .operators.catalog import Catalog, attach
from .plans.layout import LayoutError

__all__ = ["ROOT_SETTING", "Catalog", "Lake", "LayoutError", "attach"]
