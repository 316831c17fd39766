from gridpulse.sources.readers import *  # noqa: F401,F403
from gridpulse.sources.writers import *  # noqa: F401,F403
