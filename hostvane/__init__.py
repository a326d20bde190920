"""Host telemetry analytics and anomaly detection on Spark."""

import sys

from pyspark import cloudpickle

# Step functions travel to the Python workers with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
