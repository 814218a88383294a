from lapforge.plans import aggregates, files, history, lapreports, live, rows, segments, streams  # noqa: F401
from lapforge.plans.registry import QUERIES, SQL  # noqa: F401
