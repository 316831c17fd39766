from gridpulse.functions.columns import *  # noqa: F401,F403
from gridpulse.functions.weather import *  # noqa: F401,F403
