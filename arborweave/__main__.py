"""python -m arborweave: a run on files with local cores, or on the session that spark-submit gives."""

import sys

from pyspark.sql import SparkSession

from arborweave.plans.options import parse
from arborweave.plans.run import run
from arborweave.session import local_session

if __name__ == "__main__":
    settings = parse(sys.argv[1:])
    run(SparkSession.getActiveSession() or local_session(), settings)
