"""Column-expression builders (JVM-side, codegen friendly; no Python UDFs)."""

from clusterlens.functions.text import *  # noqa: F401,F403
from clusterlens.functions.vectors import *  # noqa: F401,F403
