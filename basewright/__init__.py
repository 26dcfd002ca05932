"""Customer bases from collections snapshots, as Spark DataFrame operators."""

from .plans.build import base_for, build_base
from .plans.save import save_base
from .plans.spec import BaseSpec
from .sources.tables import Tables

__all__ = ["BaseSpec", "Tables", "base_for", "build_base", "save_base"]
