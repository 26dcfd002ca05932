from .collections import collections_source, latest_state, wanted_products
from .naming import renamed
from .tables import Tables

__all__ = ["Tables", "collections_source", "latest_state", "renamed", "wanted_products"]
