"""Every operator bound to the driver tables."""

from greenledger.bindings import archive, assess, marts, pages, text  # noqa: F401
from greenledger.bindings.registry import ORACLE, QUERIES  # noqa: F401
