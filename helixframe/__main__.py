"""python -m helixframe CONFIG.toml [LOG_FILE]: assemble by a configuration file."""

import sys

from pyspark.sql import SparkSession

from helixframe.plans.assembler import assemble, set_up_logging
from helixframe.sources.readers import load_config

set_up_logging(*sys.argv[2:3])
assemble(SparkSession.builder.getOrCreate(), load_config(sys.argv[1]))
