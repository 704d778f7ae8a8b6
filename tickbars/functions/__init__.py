from tickbars.functions.scalars import *  # noqa: F401,F403
from tickbars.functions.time import *  # noqa: F401,F403
