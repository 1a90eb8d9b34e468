from quern.operators.mapping import Mapping
from quern.operators.routing import Definition, route

__all__ = ["Definition", "Mapping", "route"]
