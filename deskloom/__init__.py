"""deskloom: support-ticket triage, retrieval and evaluation as Spark jobs."""

from pyspark import cloudpickle

from deskloom import kernels

# Task-side helpers travel inside the pickled function, so executors need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(kernels)
