from clusterlens.sources.io import *  # noqa: F401,F403
