from torqueline.functions.numeric import *  # noqa: F401,F403
from torqueline.functions.text import *  # noqa: F401,F403
