"""Small topics by hand."""

import json

from eventlake.model import ENVELOPE
from eventlake.plans.engine import Engine


def records(spark, rows, topic="t"):
    """rows: (partition, offset, key, value, timestamp); values that aren't texts are written as JSON."""
    data = [(topic, p, o, k, v if isinstance(v, str) else json.dumps(v), t) for p, o, k, v, t in rows]
    return spark.createDataFrame(data, ENVELOPE)


def engine_of(spark, tmp_path, **topics):
    engine = Engine(spark, view_root=f"file://{tmp_path}")
    for name, frame in topics.items():
        engine.catalog.add(name, frame)
    return engine
