"""Column expressions: special functions and scalar statistics."""
from evisets.functions.scalar import *  # noqa: F401,F403
from evisets.functions.special import *  # noqa: F401,F403
